"""Mixing sources to target weights by weighted fair queueing.

Targets share 150 % of all words by weight; a target stops at twice its source's size
and the excess is shared anew, which is the level at which the capped shares add up.
Each source's documents are shuffled by a digest of their id, twice over if need be; a
copy's virtual finish time is its source's running words divided by the source's target.
All copies are then ordered by finish time and cut off at the total budget.

Running sums never gather a source or the corpus in one task: rows fall into ranges (of
the digest, or of the finish time), ranges are summed first, and only rows of one range
are ordered together.

Edge cases: a null text has size 0 and is never taken; sources order by code point and a
null source comes last; a null id is an id of its own; rows with equal ids follow each
other by text; repeated rows count each; an empty table gives an empty result; further
columns are carried over and never take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.store import kept

WEIGHTS = (5, 2, 1)
SHARE = 1.5
COPIES = 2
#: Rows that one range of a running sum holds on average.
RANGE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """_source, source_size, target of each source; ``sizes`` has a row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    # Sources reach their cap in the order of size over weight. With those before capped, the
    # others share what is left; the level is the first such share below its source's cap.
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    left = SHARE * F.sum("source_size").over(total) - COPIES * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    sharing = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    leveled = weighted.withColumn("_level", left / sharing)
    cap = COPIES * F.col("source_size").cast("double")
    level = F.min(F.when(F.col("_level") * F.col("weight") <= cap, F.struct(F.col("source_size") / F.col("weight"), F.col("_level").alias("v")))).over(total)["v"]
    target = F.least(cap, F.coalesce(level * F.col("weight"), cap))
    return leveled.select("_source", "source_size", target.alias("target"))


def mix_sources(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Every row of ``df`` with size, source_size, target, copies (0, 1 or 2 whole copies)
    and taken (their words). Columns of these names are replaced."""
    carried = F.struct(*[F.col(c) for c in df.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")])
    return _mixed(_rows(df, carried, text, source, doc_id)).select("_row.*", "size", "source_size", "target", "copies", "taken")


def mix_digest(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    rows = kept(_rows(df, F.struct("doc_id"), "text", "source", "doc_id"))
    return _mixed(rows).select("_row.doc_id", "size", "source_size", "target", "taken")


def _rows(df: DataFrame, carried: Column, text: str, source: str, doc_id: str) -> DataFrame:
    word = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return df.select(
        carried.alias("_row"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_source"),
        word_count(F.col(text)).alias("size"),
        F.md5(word).alias("_key"),
        F.col(doc_id).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tie"),
    )


def _mixed(rows: DataFrame) -> DataFrame:
    ranges = max(1, rows.count() // RANGE_ROWS)
    slot = (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("long")
    rows = rows.withColumn("_slot", slot)
    sums = rows.groupBy("_source", "source", "_slot").agg(F.sum("size").alias("_sum"))
    by_source = Window.partitionBy("_source").orderBy("_slot")
    targets = source_targets(sums.groupBy("_source", "source").agg(F.sum("_sum").alias("source_size")))
    known = sums.select("_source", "_slot", (F.sum("_sum").over(by_source) - F.col("_sum")).alias("_before")).join(targets, "_source")
    inside = Window.partitionBy("_source", "_slot").orderBy("_key", F.col("_id").asc_nulls_first(), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_run", F.sum("size").over(inside)).join(known, ["_source", "_slot"])
    first = (F.col("_before") + F.col("_run")) / F.col("target")
    second = (F.col("source_size") + F.col("_before") + F.col("_run")) / F.col("target")
    # Rows of no words can't move anything: they are never taken.
    queued = placed.filter("size > 0").select("_key", "size", F.explode(F.array(first, second)).alias("_finish"))
    finish, key = _cut(queued, ranges)
    within = lambda f: ((f < finish) | ((f == finish) & (F.col("_key") <= key))).cast("long")
    copies = F.when(F.col("size") > 0, within(first) + within(second)).otherwise(0)
    return placed.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def _cut(queued: DataFrame, ranges: int) -> tuple[float, str]:
    """Finish time and key of the last copy within the budget.

    Copies are summed in ranges of finish time (the budget is spent near time 1); only the
    range in which it runs out is ordered. Two single rows reach the driver."""
    timed = queued.withColumn("_time", F.least(F.floor(F.col("_finish") * ranges), F.lit(4 * ranges)))
    sums = timed.groupBy("_time").agg(F.sum("size").alias("_sum"))
    budget = F.floor(SHARE * (F.sum("_sum").over(Window.partitionBy()) / COPIES))
    run = sums.withColumn("_budget", budget).withColumn("_done", F.sum("_sum").over(Window.orderBy("_time")))
    at = run.filter("_done >= _budget").orderBy("_time").first()
    if at is None:
        return 0.0, ""
    spent = F.lit(at["_done"] - at["_sum"]) + F.sum("size").over(Window.orderBy("_finish", "_key"))
    end = timed.filter(F.col("_time") == at["_time"]).withColumn("_spent", spent).filter(F.col("_spent") <= at["_budget"])
    last = end.agg(F.max(F.struct("_finish", "_key")).alias("last")).first()["last"]
    return (last["_finish"], last["_key"]) if last else (at["_time"] / ranges, "")
