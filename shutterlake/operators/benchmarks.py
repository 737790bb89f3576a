"""Benchmark records: medians and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.shared import stored

#: Buckets of one cut, and values up to which a group or bucket is put in order.
DIGITS, FEW = 1024, 10_000


def upper_median(x: Column) -> Column:
    """An aggregate: the value at half the count of the sorted values (the upper one of two
    middle ones). It holds a group as one array, so it is for groups of one run's samples;
    ``upper_medians`` takes groups of any size."""
    values = F.sort_array(F.collect_list(x))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def upper_medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys and the upper median of each value (name: numeric column), nulls left out; a group
    without any number has no row. Values are compared as DOUBLE, NaN being the largest.

    Selection by digits, for all groups and values at once: values of groups beyond FEW fall
    into DIGITS buckets between their group's least and largest, buckets are counted, and the
    one that holds the middle place is cut again until it holds FEW values or one. Only those
    are put in order. Even steps cut what lies close together, and steps of the logarithm what
    spans many sizes; they take turns. So no task holds a group, and what is shuffled before
    the end is counts."""
    kinds = df.select(*[v.alias(n) for n, v in values.items()]).schema
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    group = [*named, "_v"]
    each = F.array(*[F.struct(F.lit(i).alias("v"), v.cast("double").alias("x")) for i, v in enumerate(values.values())])
    long = df.select(*[F.col(k).alias(i) for i, k in named.items()], F.explode(each).alias("_e")).select(*named, F.col("_e.v").alias("_v"), F.col("_e.x").alias("_x")).filter("_x IS NOT NULL")
    # In place of NaN and infinities the largest numbers tell buckets apart.
    most = 1.7976931348623157e308
    long = long.withColumn("_y", F.greatest(F.least(F.nanvl("_x", F.lit(most)), F.lit(most)), F.lit(-most)))
    ends = [F.min("_y").alias("_lo"), F.max("_y").alias("_hi"), F.count("*").alias("_n")]
    every = stored(long.groupBy(*group).agg(*ends).withColumn("_place", F.floor(F.col("_n") / 2) + 1))
    open_, settled, log = every, [], False
    while True:
        few = (F.col("_n") <= FEW) | (F.col("_lo") == F.col("_hi"))
        settled.append(open_.filter(few))
        open_ = open_.filter(~few)
        if not open_.take(1):
            break
        size = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if log else (lambda c: c)
        low, high = size(F.col("_lo")), size(F.col("_hi"))
        # Halves first: the difference of the largest numbers has no number.
        step = F.when(high > low, (size(F.col("_y")) / 2 - low / 2) / (high / 2 - low / 2) * DIGITS).otherwise(F.lit(0))
        digit = F.greatest(F.least(F.floor(step), F.lit(DIGITS - 1)), F.lit(0))
        counted = _inside(long, open_, group).groupBy(*group, "_place", digit.alias("_d")).agg(*ends)
        upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_d"))
        open_ = stored(counted.withColumn("_upto", upto).filter("_upto - _n < _place AND _place <= _upto").select(*group, "_lo", "_hi", "_n", (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_place")))
        log = not log
    last = reduce(DataFrame.unionByName, settled)
    run = F.row_number().over(Window.partitionBy(*group).orderBy("_x"))
    one = last.filter(F.col("_lo") == F.col("_hi")).filter(F.abs("_lo") < most).select(*group, F.col("_lo").alias("_x"))
    rest = last.filter((F.col("_lo") < F.col("_hi")) | (F.abs("_lo") == most))
    found = one.unionByName(_inside(long, rest, group).withColumn("_run", run).filter("_run = _place").select(*group, "_x"))
    picked = found.groupBy(*named).agg(*[F.max(F.when(F.col("_v") == i, F.col("_x"))).cast(kinds[n].dataType).alias(n) for i, n in enumerate(values)])
    out = picked.select(*[F.col(i).alias(k) for i, k in named.items()], *values)
    return out


def _inside(long: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """The values of these groups between their _lo and _hi."""
    bounds = groups.select(*[F.col(g).alias(f"{g}g") for g in group], "_lo", "_hi", "_place")
    # Few groups are large: up to 100,000 rows of numbers and keys are broadcast.
    bounds = F.broadcast(bounds) if groups.count() <= 100_000 else bounds
    same = reduce(lambda a, g: a & F.col(g).eqNullSafe(F.col(f"{g}g")), group, F.lit(True))
    return long.join(bounds, same & F.col("_y").between(F.col("_lo"), F.col("_hi"))).drop(*[f"{g}g" for g in group])


def probe_summary(probe: DataFrame) -> DataFrame:
    """codec, fixture, quality and the medians of encode_ms, megapixels per second, bytes;
    rows have width, height, encode_ms, bytes."""
    speed = F.col("width") * F.col("height") / 1e6 / (F.col("encode_ms") / 1e3)
    values = {"encode_ms": F.col("encode_ms"), "mp_per_s": speed, "bytes": F.col("bytes")}
    # With a value that no row lacks, groups without samples have a row too.
    return upper_medians(probe, ["codec", "fixture", "quality"], {**values, "_row": F.lit(1)}).drop("_row")


def compare_records(records: DataFrame, least_runs: int = 3) -> DataFrame:
    """input_sha256, control_ms, candidate_ms where both variants ran often enough and all
    their outputs for the input agree."""
    ran = lambda v: F.count(F.when(F.col("variant") == v, 1)) >= least_runs
    fit = records.groupBy("input_sha256").agg(F.count_distinct("output_sha256").alias("_outputs"), (ran("control") & ran("candidate")).alias("_ran")).filter("_outputs = 1 and _ran")
    times = upper_medians(records.filter(F.col("variant").isin("control", "candidate")), ["input_sha256", "variant"], {"_ms": F.col("total_ms")})
    both = times.groupBy("input_sha256").agg(*[F.max(F.when(F.col("variant") == v, F.col("_ms"))).alias(f"{v}_ms") for v in ("control", "candidate")])
    f, b = fit.alias("f"), both.alias("b")
    return f.join(b, F.col("f.input_sha256").eqNullSafe(F.col("b.input_sha256")), "left").select("f.input_sha256", "control_ms", "candidate_ms")
