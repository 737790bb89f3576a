"""Connected components of links between documents or lines, as Spark joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.store import kept

#: Bytes up to which the smaller side of a join may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Links or nodes (some 50 bytes each) up to which one task holds them.
ONE_TASK = 200_000


def small(df: DataFrame) -> DataFrame:
    """Marks a stored table for broadcasting if it is small; else joins shuffle it. Numbers
    and flags count 8 bytes, an array 8 for each of its elements."""
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    size = F.lit(8 * len(df.columns) + 8)
    for name in lists:
        size = size + 8 * F.greatest(F.size(name), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def gathered(df: DataFrame) -> DataFrame:
    """The frame, stored; one partition up to ONE_TASK rows, whose joins don't shuffle then."""
    df = kept(df)
    return df.coalesce(1) if df.count() <= ONE_TASK else df


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node that links reach) for all nodes of ``links`` (a, b).

    Alternating star contraction: each round ties larger neighbours to the smallest one,
    then smaller ones; the number of rounds grows with the logarithm of the longest path.
    Up to ONE_TASK links, whose number never grows, are one partition and don't shuffle."""
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    both_ways = lambda df, *pairs: df.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")
    edges = gathered(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = both_ways(edges, pair("a", "b"), pair("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Smaller neighbours: each a of ``large`` has only smaller b.
        ties = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        edges = kept(both_ways(ties, pair("b", "m"), pair("a", "m")).filter("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return both_ways(edges, F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, so that a task returns no more links than nodes."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = top(x), top(y)
        if i != j:
            parent[i] = j
            out.append((x, y))
    return out


def in_blocks(nodes: DataFrame, size: int, most: int) -> DataFrame:
    """node, block: a component's nodes, such that any two that may be linked share a block.

    ``nodes``: node, root (of the component), step (linked nodes lie in one step or in
    neighbouring ones), owner (nodes of one owner need no block in common; null: none) and
    weight. Components of up to ``size`` nodes and ``most`` weight are one block; larger ones
    are cut into parts of one step and owner, and a block is a pair of parts."""
    parts = F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum("weight") / most), F.lit(1)).cast("int")
    whole = small(kept(nodes.groupBy("root").agg(parts.alias("_parts"))))
    # The owners and steps of small components make no difference.
    few = F.col("_parts") == 1
    held = nodes.join(whole, "root").select(
        "node", "root", F.when(few, F.lit(0)).otherwise(F.col("step")).alias("step"), F.when(few, F.lit(0)).otherwise(F.coalesce("owner", F.lit(0))).alias("owner"),
        (~few & F.col("owner").isNotNull()).alias("closed"), "weight",
    )
    kinds = ["root", "step", "owner", "closed"]
    cut = kept(held.groupBy(*kinds).agg(parts.alias("_parts")))
    name = F.xxhash64(*kinds, "part").alias("part")
    each = cut.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*kinds, name)
    a = each.select(*kinds, "part", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("other")).alias("a")
    b = each.alias("b")
    differ = (F.col("a.owner") != F.col("b.owner")) | ~F.col("a.closed") | ~F.col("b.closed")
    order = (F.col("a.step") < F.col("b.step")) | (F.col("a.part") <= F.col("b.part"))
    pairs = a.join(b, (F.col("a.root") == F.col("b.root")) & (F.col("a.other") == F.col("b.step")) & order & differ).select(F.col("a.part").alias("x"), F.col("b.part").alias("y"))
    sides = pairs.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("part"), F.xxhash64("x", "y").alias("block"))
    placed = held.join(small(cut), kinds).withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")).select("node", name)
    return placed.join(small(kept(sides)), "part").select("node", "block")
