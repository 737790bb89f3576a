"""The render store: coverage, size estimates, and what to delete."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.functions.paths import TIERS, cache_key
from shutterlake.shared import stored

DAY_NS = 24 * 3600 * 1_000_000_000
FULL_DEFAULT, BROWSE_DEFAULT, FULL_OF_BROWSE = 256 << 20, 64 << 20, 5
#: Rows that one partition of a running sum holds on average.
RANGE_ROWS = 50_000


def wanted_keys(catalog: DataFrame, quality: int, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """path, tier, key of every render that the catalogue can use."""
    each = catalog.select("path", "size", "mtime_ns", F.explode(F.array(*map(F.lit, tiers))).alias("tier"))
    return each.select("path", "tier", cache_key(F.col("path"), F.col("size"), F.col("mtime_ns"), F.col("tier"), F.lit(quality)).alias("key"))


def cache_coverage(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """The columns of ``wanted`` with ``state``: present or missing, and stale for objects
    that nobody wants (key alone). Objects have distinct keys, as files do."""
    mine = objects.select("key", F.lit(True).alias("_stored"))
    both = wanted.withColumn("_wanted", F.lit(True)).join(mine, "key", "full")
    state = F.when(F.col("_wanted").isNull(), "stale").when(F.col("_stored"), "present").otherwise("missing")
    return both.select(*wanted.columns, state.alias("state"))


def store_bytes_by_tier(entries: DataFrame) -> DataFrame:
    """folder and the bytes of each tier; rgba is browse and full together."""
    of = lambda *t: F.coalesce(F.sum(F.when(F.col("tier").isin(*t), F.col("bytes"))), F.lit(0))
    return entries.groupBy("folder").agg(*[of(t).alias(t) for t in TIERS], of("browse", "full").alias("rgba"))


def size_estimates(photos: DataFrame, observed: DataFrame) -> DataFrame:
    """folder, idx, full_bytes, browse_bytes. ``observed``: folder, idx, tier, bytes, seq.
    A photo's full size is its latest observed one, else its latest browse size times 5;
    unseen photos take the largest of their folder, folders without any the default."""
    last = lambda t: F.max_by(F.when(F.col("tier") == t, F.col("bytes")), F.when(F.col("tier") == t, F.col("seq")))
    own = observed.groupBy("folder", "idx").agg(last("full").alias("f"), last("browse").alias("b"))
    size = F.when(F.col("tier") == "full", F.col("bytes")).otherwise(F.col("bytes") * FULL_OF_BROWSE)
    # A browse observation gives no full estimate once the photo's full size was seen.
    exact = F.min(F.when(F.col("tier") == "full", F.col("seq"))).over(Window.partitionBy("folder", "idx"))
    counted = observed.withColumn("_exact", exact).filter((F.col("tier") == "full") | F.col("_exact").isNull() | (F.col("seq") < F.col("_exact")))
    top = counted.groupBy("folder").agg(F.max(size).alias("top_full"))
    top_browse = observed.filter("tier = 'browse'").groupBy("folder").agg(F.max("bytes").alias("top_browse"))
    all_ = photos.select("folder", "idx").join(own, ["folder", "idx"], "left").join(top, "folder", "left").join(top_browse, "folder", "left")
    # greatest() would pass over a missing size.
    seen = lambda c: F.when(F.col(c).isNotNull(), F.greatest(c, F.lit(1)))
    full = F.coalesce("f", F.col("b") * FULL_OF_BROWSE, seen("top_full"), F.lit(FULL_DEFAULT))
    return all_.select("folder", "idx", full.alias("full_bytes"), F.coalesce("b", seen("top_browse"), F.lit(BROWSE_DEFAULT)).alias("browse_bytes"))


def running_sum(df: DataFrame, value: str, order: str, tie: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` (whole numbers) over all rows before, by (order, tie)."""
    n = df.count()
    return _ran(df, value, order, tie, out, n)


def _ran(df: DataFrame, value: str, order: str, tie: str, out: str, n: int) -> DataFrame:
    """No task sees all rows: Spark's range partitioner cuts the order of the pair (order, tie)
    into partitions of about RANGE_ROWS rows, however many rows share one value of ``order``.
    Each partition is sorted and summed where it lies and written once; partitions are summed
    in their order, one row for each, and what lies before a partition is added to its rows."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("_run", T.LongType()), T.StructField("_part", T.IntegerType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = np.asarray(pc.fill_null(batch.column(value).cast(pa.int64()), 0))
            run = done + np.cumsum(own)
            done = int(run[-1]) if len(run) else done
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run - own), pa.array(np.full(len(own), part, np.int32))], schema=pa.schema([*batch.schema, ("_run", pa.int64()), ("_part", pa.int32())]))

    ranged = df.repartitionByRange(max(1, math.ceil(n / RANGE_ROWS)), order, tie).sortWithinPartitions(order, tie)
    placed = stored(ranged.mapInArrow(sums, schema))
    parts = placed.groupBy("_part").agg(F.max(F.col("_run") + F.coalesce(value, F.lit(0))).alias("_sum"))
    before = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    # A row for RANGE_ROWS rows: broadcast up to 100,000 partitions.
    before = F.broadcast(before) if n <= 100_000 * RANGE_ROWS else before
    return placed.join(before, "_part").select(*names, (F.col("_before") + F.col("_run")).alias(out))


def retention_to_budget(objects: DataFrame, budget: int) -> DataFrame:
    """Objects (key, bytes, mtime_ns) to delete: the oldest written, until the rest fits;
    none while all fit. Equal times go by key."""
    n, total = objects.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if total <= budget:
        return objects.filter(F.lit(False))
    return _ran(objects, "bytes", "mtime_ns", "key", "_sum", n).filter(F.lit(total) - F.col("_sum") > budget).drop("_sum")


def is_object(shard: Column, name: Column) -> Column:
    return name.rlike(r"^[0-9a-fA-F]{64}\.jpg$") & shard.rlike("^[0-9a-fA-F]{2}$") & name.startswith(shard)


def stale_temp_sweep(files: DataFrame, now_ns: int, prefix: str = ".shutterlake-") -> DataFrame:
    """Files (shard, name, mtime_ns) left by interrupted writes a day ago or earlier."""
    return files.filter(F.col("name").startswith(prefix) & F.col("name").endswith(".tmp") & (now_ns - F.col("mtime_ns") >= DAY_NS))
