"""The trie of conversation prefixes, by ROLLUP over positional turn-id columns.

A turn id is a digest of role and text with the text's length. A conversation is a row for
each WIDTH turns: the turn ids in positional columns, and the node that its turns before
them lead to. One ``GROUP BY prior, ROLLUP(t1, ..., t8)`` aggregates all prefixes of all
blocks together; grouping_id() tells how many columns a prefix has. Since a block's prior
node is a digest of all turns before it, long conversations need no further passes for that.

Sums over subtrees add each node's values to the nodes above it in its block. Below the end
of a block they come from the next level: there, whole blocks are the turns, the ends of
blocks are the nodes, and the totals of the blocks below them are the values. A level has
an eighth of the one below it, so a conversation of 400 turns takes three.

Edge cases: turns of null order come first, and equal ones follow each other by digest;
a null role or text is empty; rows without conv_id belong to no conversation and are left
out; repeated rows are turns of their own; a conversation that loses all its turns is a
member of the root alone; further columns never take part; a table without conversations
gives no rows. A conversation's turns are sorted in one task, which spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.skew import join_counted
from shutterlake.llm.store import kept
from shutterlake.llm.text_arrays import arrow_session

#: Positional columns of a block.
WIDTH = 8
#: Characters of a list of ids that tasks hand on as one row.
LIST_CHARS = 1 << 20
#: Conversations of which one starts with another's turns, and the most turns it takes over.
GROUP, HEAD = 100, 5

SLOTS = [f"t{i}" for i in range(1, WIDTH + 1)]


def root() -> Column:
    """The node that no turn leads to."""
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def turns_of(df: DataFrame) -> DataFrame:
    """conv_id, pos (from 1) and id of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    length = F.unhex(F.lpad(F.hex(F.char_length(text)), 8, "0"))
    rows = df.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.concat(digest, length).alias("id"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "id")


def text_length(turn_id: Column) -> Column:
    return F.conv(F.hex(F.substring(turn_id, 17, 4)), 16, 10).cast("long")


def as_they_are(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns of it), d (0: it has none), id: conversations as given."""
    size = F.count("*").over(Window.partitionBy("conv_id"))
    return turns.select("conv_id", size.alias("n"), F.col("pos").alias("d"), "id")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, n, d, id: each conversation starts with the first turns of the one that leads
    its hundred. A conversation without turns is one row with d = 0."""
    turns = kept(turns)
    lead = F.col("conv_id") - F.col("conv_id") % GROUP
    take = F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)
    heads = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") <= HEAD)).groupBy(F.col("conv_id").alias("lead"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("head"))  # HEAD at most
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("size")).withColumn("lead", lead).withColumn("h", take)
    head = F.when(F.col("head").isNull(), F.expr("array()")).otherwise(F.slice("head", 1, F.col("h").cast("int")))
    led = sizes.join(heads, "lead", "left").withColumn("head", head).withColumn("k", F.size("head").cast("long"))
    led = kept(led.withColumn("n", F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).select("conv_id", "h", "k", "n", "head"))
    first = led.filter("k > 0").select("conv_id", "n", F.explode("head").alias("e")).select("conv_id", "n", F.col("e.pos").alias("d"), F.col("e.id").alias("id"))
    rest = turns.join(led.drop("head"), "conv_id").filter("pos > h").select("conv_id", "n", (F.col("k") + F.col("pos") - F.col("h")).alias("d"), "id")
    none = led.filter("n = 0").select("conv_id", "n", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("id"))
    return first.union(rest).union(none)


def _lanes(depth: Column, turn_id: Column) -> list[Column]:
    """Two fingerprints of a turn at a depth; a node is the exclusive or of its path's."""
    return [F.xxhash64(depth, turn_id), F.xxhash64(F.lit("b"), depth, turn_id)]


def _paths(rows: DataFrame) -> DataFrame:
    """conv_id, n, d, id, node (reached with this turn), before (the node above)."""
    by_depth = Window.partitionBy("conv_id").orderBy("d")
    so_far = by_depth.rowsBetween(Window.unboundedPreceding, 0)
    a, b = (F.bit_xor(lane).over(so_far) for lane in _lanes(F.col("d"), F.col("id")))
    return rows.withColumn("node", F.struct(a.alias("a"), b.alias("b"))).withColumn("before", F.coalesce(F.lag("node").over(by_depth), root()))


def _blocks(rows: DataFrame) -> DataFrame:
    """conv_id, n, prior, above (depth of prior) and the positional columns, a row a block."""
    turn = F.sort_array(F.collect_list(F.struct("d", "id", "before")))  # WIDTH at most
    block = rows.groupBy("conv_id", "n", F.floor((F.col("d") - 1) / WIDTH).alias("block")).agg(turn.alias("turn"))
    slots = [F.get("turn", F.lit(i))["id"].alias(s) for i, s in enumerate(SLOTS)]
    return block.select("conv_id", "n", F.col("turn")[0]["before"].alias("prior"), (F.col("block") * WIDTH).alias("above"), *slots)


def _prefixes(blocks: DataFrame) -> DataFrame:
    """prior, above, t1 ..., g (columns in the prefix), n_convs, conv_id, longest of each prefix."""
    slots = ", ".join(SLOTS)
    grouped = blocks.sparkSession.sql(
        f"SELECT prior, above, {slots}, {WIDTH} - bit_count(grouping_id()) AS g, count(*) AS n_convs, min(conv_id) AS conv_id, max(n) AS longest "
        f"FROM {{blocks}} GROUP BY prior, above, ROLLUP({slots})",
        blocks=blocks,
    )
    # A block shorter than the prefix ends in a null: no prefix of it.
    return grouped.filter(F.col("g") > 0).withColumn("id", F.get(F.array(*SLOTS), F.col("g") - 1)).filter("id IS NOT NULL")


def _named(prefixes: DataFrame) -> DataFrame:
    """The prefixes with chain: the prior node and the nodes along the columns."""
    a, b = F.col("prior.a"), F.col("prior.b")
    chain = [F.col("prior")]
    for i, slot in enumerate(SLOTS, 1):
        x, y = _lanes(F.col("above") + i, F.col(slot))
        a, b = a.bitwiseXOR(x), b.bitwiseXOR(y)
        chain.append(F.struct(a.alias("a"), b.alias("b")))
    return prefixes.withColumn("chain", F.slice(F.array(*chain), 1, F.col("g") + 1))


def _spread(nodes: DataFrame, first: Column) -> DataFrame:
    """node, saved, leaves: each node's values at each node of its chain from ``first`` on."""
    held = nodes.filter("saved > 0 OR leaves > 0")
    return held.select(F.explode(F.slice("chain", first, F.size("chain"))).alias("node"), "saved", "leaves")


def _sums(values: DataFrame) -> DataFrame:
    return values.groupBy("node").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def _below(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, saved, leaves: totals below the ends of blocks. ``rows`` of conversations have a
    turn beyond the first block; ``nodes`` have their chain in the block and their values."""
    totals = _sums(nodes.select(F.col("prior").alias("node"), "saved", "leaves"))
    ends = rows.filter((F.col("d") > 0) & (F.col("d") % WIDTH == 0))
    up = ends.select("conv_id", "n", (F.col("d") / WIDTH).cast("long").alias("d"), F.col("node").alias("id"), "node")
    up = kept(up.withColumn("before", F.coalesce(F.lag("node").over(Window.partitionBy("conv_id").orderBy("d")), root())))
    prefixes = _prefixes(_blocks(up)).withColumn("chain", F.slice(F.array("prior", *SLOTS), 1, F.col("g") + 1))
    own = kept(prefixes.select("prior", "chain", F.col("id").alias("node")).join(totals, "node"))
    return _sums(_spread(_with_below(own, up), F.lit(2)))


def _with_below(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``nodes`` with what lies below the ends of blocks added to their values."""
    if not rows.filter(F.col("d") > WIDTH).take(1):
        return nodes
    below = _below(nodes, rows).select("node", F.col("saved").alias("_saved"), F.col("leaves").alias("_leaves"))
    add = lambda x: (F.col(x) + F.coalesce(f"_{x}", F.lit(0))).alias(x)
    others = [c for c in nodes.columns if c not in ("saved", "leaves")]
    return kept(nodes.join(below, "node", "left").select(*others, add("saved"), add("leaves")))


def _listed(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of each node's ids in order, comma-joined. Range
    partitions split the ids of one node; only their lists, a megabyte a row, come together."""
    arrow_session(ends.sparkSession)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, ids, size = None, None, [], 0
        row = lambda: pa.RecordBatch.from_pylist([{"a": own[0], "b": own[1], "first": first, "ids": ",".join(ids)}])
        for batch in batches:
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv_id"))):
                if (a, b) != own or size > LIST_CHARS:
                    if ids:
                        yield row()
                    own, first, ids, size = (a, b), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = None, None
        row = lambda: pa.RecordBatch.from_pylist([{"a": own[0], "b": own[1], "ends_sha256": sha.hexdigest()}])
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) != own:
                    if own is not None:
                        yield row()
                    own, sha = (a, b), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if own is not None:
            yield row()

    parts = ends.sparkSession.conf.get("spark.sql.shuffle.partitions")
    split = ends.repartitionByRange(int(parts), "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    whole = split.mapInArrow(lists, "a long, b long, first long, ids string").repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return whole.mapInArrow(digests, "a long, b long, ends_sha256 string").select(F.struct("a", "b").alias("node"), "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``conversations`` (conv_id, n, d, id)."""
    rows = kept(_paths(conversations))
    turned = rows.filter("d > 0")
    named = _named(_prefixes(_blocks(turned)))
    nodes = kept(named.select(
        "prior", "chain", F.col("chain")[F.col("g")].alias("node"), F.col("chain")[F.col("g") - 1].alias("parent"), (F.col("above") + F.col("g")).alias("depth"), "n_convs", "conv_id",
        ((F.col("n_convs") - 1) * text_length(F.col("id"))).alias("saved"), (F.col("longest") == F.col("above") + F.col("g")).cast("long").alias("leaves"),
    ))
    everyone = rows.filter("d <= 1").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    top = everyone.select(root().alias("node"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id")
    # One grouping by node: its own row, its children, and the values of its subtree. The
    # chain begins with the prior node, which takes part where it is the root.
    number = lambda x: F.lit(x).cast("long")
    own = nodes.select("node", "parent", "depth", "n_convs", "conv_id").union(top)
    own = own.select("node", F.col("parent.a").alias("pa"), F.col("parent.b").alias("pb"), "depth", "n_convs", "conv_id", number(0).alias("children"), number(0).alias("saved"), number(0).alias("leaves"))
    blank = [number(None).alias(c) for c in ("pa", "pb", "depth", "n_convs", "conv_id")]
    children = nodes.select(F.col("parent").alias("node"), *blank, number(1).alias("children"), number(0).alias("saved"), number(0).alias("leaves"))
    from_root = F.when(F.col("prior") == root(), F.lit(1)).otherwise(F.lit(2))
    spread = _spread(_with_below(nodes, turned), from_root).select("node", *blank, number(0).alias("children"), "saved", "leaves")
    most = [F.max(c).alias(c) for c in ("pa", "pb", "depth", "n_convs", "conv_id")]
    trie = own.union(children).union(spread).groupBy("node").agg(*most, *[F.sum(c).alias(c) for c in ("children", "saved", "leaves")])
    ends = _listed(rows.filter("d = n").select(F.when(F.col("d") > 0, F.col("node.a")).otherwise(F.lit(0)).alias("a"), F.when(F.col("d") > 0, F.col("node.b")).otherwise(F.lit(0)).alias("b"), "conv_id"))
    trie = kept(trie.join(ends, "node", "left"))
    above = kept(trie.filter("children > 0").select(F.col("node.a").alias("pa"), F.col("node.b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "children"))
    pair = F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))
    held = trie.drop("node").filter("depth > 0").withColumn("parent", pair).withColumnRenamed("children", "n_children")
    lower = join_counted(held, above.select(pair.alias("parent"), "parent_conv_id", "children"), "parent", "children")
    out = lambda df, parent: df.select(
        "conv_id", "depth", parent, "n_convs", "n_children", F.greatest("leaves", (F.col("n_children") == 0).cast("long")).alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    first = trie.filter("depth = 0").withColumnRenamed("children", "n_children")
    return out(lower, F.col("parent_conv_id")).union(out(first, number(None).alias("parent_conv_id")))


def trie_digest(df: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return prefix_trie(rebuilt(turns_of(df)))
