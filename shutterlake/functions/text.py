"""Text columns of the image information strip."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS = 512


@F.pandas_udf(T.StringType())
def _fixed1(x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.1f}" for v in x], dtype=object)


def fixed1(x: Column) -> Column:
    """One decimal, rounding the exact binary value half to even (Spark's own functions
    round the shortest decimal half up: 1.25 would become 1.3)."""
    return _fixed1(x.cast("double"))


def format_file_size(size: Column) -> Column:
    value = size.cast("double")
    unit = lambda limit, name: F.concat(fixed1(value / limit), F.lit(name))
    return (
        F.when(value >= 1e9, unit(1e9, " GB")).when(value >= 1e6, unit(1e6, " MB")).when(value >= 1e3, unit(1e3, " KB")).otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def format_modified(mtime_ns: Column, offset_seconds: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS ±HH:MM`` at the given offset; null for times up to 0."""
    seconds = F.call_function("div", mtime_ns, F.lit(1_000_000_000))
    # The shifted instant is shown through its distance from the epoch, so no session zone takes part.
    local = F.timestamp_add("SECOND", seconds + offset_seconds, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
    return F.when(mtime_ns > 0, F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), format_offset(offset_seconds)))


def format_offset(seconds: Column) -> Column:
    a = F.abs(seconds)
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), two(F.floor(a / 3600)), F.lit(":"), two(F.floor(a % 3600 / 60)))


def strip(x: Column) -> Column:
    """White space of any kind off both ends (trim takes spaces only)."""
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def compact_value(x: Column) -> Column:
    """Runs of controls and white space become one space; at most MAX_CHARS characters, of
    which the last is no space; null if nothing is left."""
    one = strip(F.regexp_replace(x, r"[\p{Cc}\s\p{Z}]+", " "))
    # A word that would start at the last character takes the place of its space.
    cut = F.when(F.substring(one, MAX_CHARS, 1) == " ", F.concat(F.substring(one, 1, MAX_CHARS - 1), F.substring(one, MAX_CHARS + 1, 1))).otherwise(F.substring(one, 1, MAX_CHARS))
    return F.nullif(cut, F.lit(""))
