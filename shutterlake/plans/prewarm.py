"""Which previews to render next: orders and plans around the current photo.

A request is a row of session, folder, current, direction (negative: backward), zoomed,
and for adaptive plans full_budget and browse_budget. ``visible`` has folder, pos, idx; a
folder shown whole has pos = idx. Plans are rows of session, idx, tier, class, distance,
kind and ``rank``, their order in the session (ties keep the order of arrival).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.shared import stored

#: Places that browse work reaches ahead (a third of it behind), and that
#: full neighbours reach, and what a place behind counts.
BROWSE_REACH, FULL_REACH, BEHIND = 24, 1, 3

PLAN = ("session", "idx", "tier", "class", "distance", "kind", "_order")


def outward_order(photos: DataFrame) -> DataFrame:
    """Adds ``rank``: the start first, then three ahead for each one behind, in closed form;
    rows have folder, idx, start and n (the folder's size)."""
    start = F.least("start", F.col("n") - 1)
    d, j = F.col("idx") - start, start - F.col("idx")
    ahead = F.col("n") - 1 - start
    third = F.call_function("div", d - 1, F.lit(3))
    rank = F.when(d > 0, d + F.least(third, start)).when(j > 0, F.least(3 * j, ahead) + j).otherwise(0)
    return photos.withColumn("rank", rank.cast("int"))


def weighted_distance(pos: Column, at: Column, direction: Column) -> tuple[Column, Column, Column]:
    """(ahead, distance, weighted distance) of a place."""
    ahead = (pos > at) == (direction >= 0)
    distance = F.abs(pos - at)
    return ahead, distance, F.when(ahead, distance).otherwise(BEHIND * distance)


def placed_requests(requests: DataFrame, visible: DataFrame) -> DataFrame:
    """Requests with ``at``, the current photo's place (0 if it isn't shown)."""
    return requests.join(visible.select("folder", F.col("idx").alias("current"), F.col("pos").alias("at")), ["folder", "current"], "left").withColumn("at", F.coalesce("at", F.lit(0)))


def around(requests: DataFrame, visible: DataFrame) -> DataFrame:
    """All visible photos of each request's folder with ``at``, ahead, steps and weight."""
    ahead, steps, weight = weighted_distance(F.col("pos"), F.col("at"), F.col("direction"))
    return placed_requests(requests, visible).join(visible, "folder").select("*", ahead.alias("ahead"), steps.alias("steps"), weight.alias("weight"))


def _near(placed: DataFrame, visible: DataFrame, reach: Column, last: Column | None = None) -> DataFrame:
    """Visible photos up to a weighted distance of ``reach`` from ``at``, with ahead, steps and
    weight. The places in question are known, so only they are joined, not the whole folder."""
    behind = F.floor(reach / BEHIND)
    low = F.col("at") - F.when(F.col("direction") >= 0, behind).otherwise(reach)
    high = F.col("at") + F.when(F.col("direction") >= 0, reach).otherwise(behind)
    low, high = F.greatest(low, F.lit(0)).cast("long"), high.cast("long")
    high = high if last is None else F.least(high, last)
    each = placed.withColumn("pos", F.explode(F.sequence(low, F.greatest(low, high))))
    ahead, steps, weight = weighted_distance(F.col("pos"), F.col("at"), F.col("direction"))
    return each.select("*", ahead.alias("ahead"), steps.alias("steps"), weight.alias("weight")).join(visible, ["folder", "pos"])


def near_places(requests: DataFrame, visible: DataFrame, reach: int = BROWSE_REACH) -> DataFrame:
    return _near(placed_requests(requests, visible), visible, F.lit(reach))


def with_sums(sized: DataFrame, size: str) -> DataFrame:
    """folder, pos, upto: the bytes of the folder's photos up to each place, and ``last``, its
    last place; once for each folder however many requests look at it."""
    order = Window.partitionBy("folder").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return sized.select("folder", "pos", F.coalesce(F.sum(F.when(F.col(size).isNotNull(), F.greatest(size, F.lit(1)))).over(order), F.lit(0)).alias("upto"), F.max("pos").over(Window.partitionBy("folder")).alias("last"))


def budget_reach(placed: DataFrame, sums: DataFrame, budget: str, base: str) -> DataFrame:
    """session, reach, last: a weighted distance within which the budget ends, less than twice as
    far as it needs to be, and the folder's last place. Sums at the powers of two tell it: a session joins four places for each,
    not its folder. Places up to one step from the current one don't count; ``sums`` has a row
    for every place of a folder."""
    last = sums.groupBy("folder").agg(F.max("last").alias("last"))
    at, ahead = F.col("at"), F.when(F.col("direction") >= 0, 1).otherwise(-1)
    powers = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(BEHIND * (F.col("last") + 2))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("long"))
    probe = placed.join(last, "folder").select("session", "folder", "at", "last", ahead.alias("_way"), budget, base, F.explode(powers).alias("_w"))
    # Of each side the bytes from two steps on: what is up to its end less what is up to its start.
    ends = [
        F.struct((at + F.col("_way") * F.col("_w")).alias("p"), F.lit(1).alias("far"), F.col("_way").alias("way")), F.struct((at + F.col("_way")).alias("p"), F.lit(0).alias("far"), F.col("_way").alias("way")),
        F.struct((at - F.col("_way") * F.greatest(F.floor(F.col("_w") / BEHIND), F.lit(1))).alias("p"), F.lit(1).alias("far"), (-F.col("_way")).alias("way")), F.struct((at - F.col("_way")).alias("p"), F.lit(0).alias("far"), (-F.col("_way")).alias("way")),
    ]
    sides = probe.select("*", F.explode(F.array(*ends)).alias("_e")).select("session", "folder", "last", budget, base, "_w", "_e.far", "_e.way", "_e.p")
    # Towards the end ``upto`` counts the place itself; towards the start all before the place are left out.
    spot = F.when(F.col("way") > 0, F.least("p", "last")).otherwise(F.greatest("p", F.lit(0)) - 1)
    sign = F.when(F.col("far") == 1, 1).otherwise(-1) * F.col("way")
    known = sides.select("session", "last", budget, base, "_w", "folder", spot.alias("pos"), sign.alias("_sign")).join(sums.select("folder", "pos", "upto"), ["folder", "pos"], "left")
    total = known.groupBy("session", "last", budget, base, "_w").agg(F.sum(F.col("_sign") * F.coalesce("upto", F.lit(0))).alias("_sum"))
    fits = F.when(F.col(base) + F.col("_sum") <= F.col(budget), F.col("_w")).otherwise(F.lit(1))
    return total.groupBy("session", "last").agg(F.least(2 * F.max(fits), BEHIND * (F.col("last") + 1)).alias("reach"))


def budget_prefix(candidates: DataFrame, budget: str, base: str, size: str = "bytes") -> DataFrame:
    """Candidates from the nearest on (ahead before behind), up to the first that the
    budget doesn't hold beside ``base`` and those before it; none is passed over. Sizes are
    1 or more, so the running sum tells it."""
    order = Window.partitionBy("session").orderBy("weight", F.col("ahead").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return candidates.withColumn("_sum", F.col(base) + F.sum(F.greatest(size, F.lit(1))).over(order)).filter(F.col("_sum") <= F.col(budget)).drop("_sum")


def _target(df: DataFrame, tier: str, klass: Column | int, distance: Column, kind: str, order: Column | int) -> DataFrame:
    cast = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("session", "idx", F.lit(tier).alias("tier"), cast(klass).cast("int").alias("class"), distance.cast("int").alias("distance"), F.lit(kind).alias("kind"), cast(order).cast("long").alias("_order"))


def _ranked(parts: list[DataFrame]) -> DataFrame:
    plan = reduce(DataFrame.unionByName, parts)
    return plan_order(plan).drop("_order")


def plan_order(plan: DataFrame) -> DataFrame:
    """Adds ``rank`` by class, distance and arrival."""
    return plan.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy("class", "distance", "_order")) - 1)


def _current(requests: DataFrame) -> list[DataFrame]:
    now = requests.withColumn("idx", F.col("current"))
    return [_target(now, "browse", 0, F.lit(0), "display", 0), _target(now, "full", F.when(F.col("zoomed"), 0).otherwise(1), F.lit(0), "display", 1)]


def _warm(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """Browse work for the rest of the folder, by place in the folder."""
    every = requests.join(sizes, "folder").select("*", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("idx"))
    _, _, weight = weighted_distance(F.col("idx"), F.col("current"), F.col("direction"))
    return _target(every.filter((F.col("idx") != F.col("current")) & (weight > BROWSE_REACH)), "browse", 6, weight, "warm", 4_000_000_000 + F.col("idx"))


def fixed_plan(requests: DataFrame, visible: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The plan without budgets; with ``sizes`` (folder, len) warm work is added."""
    near = near_places(requests, visible).filter("idx <> current")
    beside = near.filter(F.col("steps") <= FULL_REACH)
    wide = near.filter(F.col("steps") > FULL_REACH)
    place = 2 * F.col("pos") + 2
    parts = [
        *_current(requests), _target(beside, "browse", 2, F.col("weight"), "display", place),
        _target(beside, "full", 3, F.col("weight"), "display", place + 1), _target(wide, "browse", 4, F.col("weight"), "display", place),
    ]
    return _ranked(parts + ([_warm(requests, sizes)] if sizes is not None else []))


def prewarm_plan(requests: DataFrame, visible: DataFrame, estimates: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The adaptive plan. ``estimates``: folder, idx, full_bytes, browse_bytes. Current and
    next photos are planned even over budget; further full and browse work each takes the
    longest run of nearest photos that its budget holds. While zoomed, the photo ahead gets
    its full render before its browse render."""
    sized = stored(visible.select("folder", "pos", "idx").join(estimates.select("folder", "idx", "full_bytes", "browse_bytes"), ["folder", "idx"], "left"))
    requests = stored(placed_requests(requests, sized))
    near = stored(_near(requests, sized.filter("full_bytes IS NOT NULL"), F.lit(BROWSE_REACH)))
    # Full work first holds the current photo and its neighbours, whatever the budget.
    must = F.when((F.col("idx") == F.col("current")) | (F.col("steps") <= 1), True).otherwise(False)
    own = estimates.select("folder", F.col("idx").alias("current"), F.col("full_bytes").alias("_cf"), F.col("browse_bytes").alias("_cb"))
    beside = near.filter((F.col("steps") <= 1) & (F.col("idx") != F.col("current")))
    held = beside.groupBy("session").agg(F.sum("full_bytes").alias("_nf"), F.sum("browse_bytes").alias("_nb"))
    base = requests.join(own, ["folder", "current"], "left").join(held, "session", "left").select(
        "session", (F.coalesce("_cf", F.lit(0)) + F.coalesce("_nf", F.lit(0))).alias("_full"), (F.coalesce("_cb", F.lit(0)) + F.coalesce("_nb", F.lit(0))).alias("_browse")
    )
    asked = requests.join(base, "session")
    reach = budget_reach(asked, with_sums(sized, "full_bytes"), "full_budget", "_full")
    far = _near(asked.join(reach, "session"), sized.filter("full_bytes IS NOT NULL"), F.col("reach"), F.col("last"))
    full = budget_prefix(far.filter(~must), "full_budget", "_full", "full_bytes")
    browse = budget_prefix(near.filter(~must).join(base, "session"), "browse_budget", "_browse", "browse_bytes")
    swap = F.when(F.col("zoomed") & F.col("ahead"), 1).otherwise(0)
    place = 2 * F.col("pos") + 2
    wave = 1_000_000_000 + 2 * F.col("weight") + F.when(F.col("ahead"), 0).otherwise(1)
    parts = [
        *_current(requests), _target(beside, "browse", 2, F.col("weight"), "display", place + swap), _target(beside, "full", 2, F.col("weight"), "display", place + 1 - swap),
        _target(browse, "browse", 4, F.col("weight"), "display", wave), _target(full, "full", 5, F.col("weight"), "prefetch", wave),
    ]
    return _ranked(parts + ([_warm(requests, sizes)] if sizes is not None else []))
