"""Joins with a table of one row for each key, where few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than 1 / SHARE of the rows are broadcast: fewer than SHARE of them exist.
SHARE = 1000


def join_counted(rows: DataFrame, lookup: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup`` (a row for each key; ``n`` rows have it), inner or left.

    Hot keys, fewer than SHARE by their counts, are joined where the rows lie; rows of the
    others are shuffled, each key at most 1 / SHARE of all. Both frames are read twice, so
    they should be stored. Rows with a null key match nothing."""
    total = lookup.agg(F.sum(n)).first()[0] or 0
    hot = lookup.filter(F.col(n) * SHARE > total)
    cold = lookup.filter(F.col(n) * SHARE <= total)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far.select(*near.columns))
