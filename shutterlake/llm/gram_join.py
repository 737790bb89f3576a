"""N-gram Jaccard join by a blocked sparse matrix product of documents by n-grams.

1. Chunks of documents count their shingles over the corpus (exchange.py): a shingle of
   one document can't take part in a link.
2. A document's shingles are ordered from rare to common. Two sets with Jaccard t share a
   shingle among the rarest n - ceil(t n) + 1 of each; these are the document's keys, and
   keys of one document go. Equal sets are one node from here on.
3. Documents that share a key and whose sizes allow a link are tied into components
   (a superset of the linked ones). A bucket of keys with more than KEY_BYTES, as one that
   most documents share makes it, is dealt out: each part ties its own documents and passes
   on, for each key, one document for each run of sizes, and these are tied to each other.
4. Blocks of documents multiply their sparse incidence matrices row by row, accumulating the
   overlap of every pair; pairs below the bound that their sizes set are dropped. A task
   returns a spanning forest of its links. A first round takes each document with one that it
   is tied to, which links most near copies; a second one takes the pairs that are left,
   cutting large components into blocks by size: documents that the first round linked, or
   whose sizes are too far apart, need no block in common.
5. Components of these links give each document its class.

Edge cases: a null text, or one without words, has an empty set, links with nothing and
is its own component; fewer words than the shingle size are one shingle; rows of equal
ids are rows of their own; a null id never is a component's id unless all are null, and rows
without one are told apart by their texts; an empty table gives an empty result; further columns are carried over by ``join_components``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import exchange
from shutterlake.llm.components import components, forest, gathered, in_blocks, small
from shutterlake.llm.store import kept
from shutterlake.llm.text_arrays import LOWER_ASCII, gram_hashes, hash_spans, mix, raw, trim, words

SHINGLE, PERCENT = 5, 75
#: Bytes of keys up to which one task ties a bucket's documents.
KEY_BYTES = 16 << 20
#: Documents and shingles of a block.
BLOCK, BLOCK_SHINGLES = 200, 1_000_000
#: Copies of one set from which on they are joined apart, by broadcast.
HOT = 5000


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the texts' offsets."""
    data, at = raw(column)
    data = LOWER_ASCII[data]
    starts, ends, of = words(data, at)
    h = hash_spans(data, starts, ends)
    rows = len(at) - 1
    grams, whole = gram_hashes(h, of, size)
    n_words = np.diff(of)
    row = np.repeat(np.arange(rows), n_words)[whole]
    grams = grams[whole]
    for k in range(1, size):  # short texts: their whole sequence
        short = np.flatnonzero(n_words == k)
        if len(short):
            row = np.append(row, short)
            grams = np.append(grams, mix(gram_hashes(h, of, k)[0][of[:-1][short]] + np.uint64(k)))
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return grams[fresh], np.searchsorted(row[fresh], np.arange(rows + 1))


def set_hashes(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash for each set: equal sets are one node."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest overlap of linked sets of these sizes: o / (a + b - o) >= percent / 100."""
    return -(-(percent * (a + b)) // (100 + percent))


def _prefixes(grams: np.ndarray, at: np.ndarray, count: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of each set's shared keys: the rarest n - ceil(t n) + 1, without lone ones."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((grams, count, row))
    rank = np.arange(len(grams)) - np.repeat(at[:-1], n)
    take = (rank < np.repeat(n - -(-percent * n // 100) + 1, n)) & (count[order] > 1)
    return row[take], grams[order][take]


_NODES = "kind int, bucket long, doc_id long, row long, n long, node long, keys binary, nodes binary, sizes binary"


def _nodes_and_keys(table: pa.Table, answers: pa.Table, buckets: int, key_buckets: int, size: int, percent: int) -> pa.Table:
    """A row for each document (kind 0), and packed keys for each key bucket (kind 1)."""
    schema = pa.schema(
        [("kind", pa.int32()), ("bucket", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("keys", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())]
    )
    if not table.num_rows:
        return schema.empty_table()
    grams, at = shingle_sets(table["text"], size)
    n = np.diff(at)
    node = set_hashes(grams, at)
    docs = pa.Table.from_arrays(
        [pa.array(np.zeros(len(n), np.int32)), pa.nulls(len(n), pa.int64()), table["doc_id"].combine_chunks(), table["row"].combine_chunks(), pa.array(n), pa.array(node.view(np.int64)), *[pa.nulls(len(n), pa.binary())] * 3],
        schema=schema,
    )
    row, key = _prefixes(grams, at, exchange.counts_of(grams, answers, buckets), percent)
    _, once = np.unique(node, return_index=True)  # equal sets of the chunk send their keys once
    first = np.zeros(len(n), bool)
    first[once] = True
    row, key = row[first[row]], key[first[row]]
    bucket = key % np.uint64(key_buckets)
    order = np.argsort(bucket, kind="stable")
    row, key, bucket = row[order], key[order], bucket[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else []
    rows = [
        (1, int(bucket[i]), None, None, None, None, key[i:j].tobytes(), node[row[i:j]].tobytes(), n[row[i:j]].astype("<u4").tobytes())
        for i, j in zip(cuts, [*cuts[1:], len(bucket)])
    ]
    return pa.concat_tables([docs, exchange.rows_table(rows, schema)])


_TIES = "a long, b long, bucket long, keys binary, nodes binary, sizes binary, tops binary"
_TIE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), *[(c, pa.binary()) for c in ("keys", "nodes", "sizes", "tops")]])


def _ties(table: pa.Table, percent: int) -> pa.Table:
    """Ties (a, b) between nodes of one key, from one bucket or a part of it. ``sizes`` and ``tops``
    are the smallest and largest size that a node stands for. A key's nodes are cut into runs where
    the next size is too large for any link across; each is tied to the first of its run. If the
    bucket is ``dealt``, a packed row names each run's first node with the sizes of the run."""
    key, node, size, top = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("keys", np.uint64), ("nodes", np.int64), ("sizes", "<u4"), ("tops", "<u4")))
    order = np.lexsort((node, size, key))
    key, node, size, top = key[order], node[order], size[order].astype(np.int64), top[order].astype(np.int64)
    other = np.ones(len(key), bool)
    other[1:] = key[1:] != key[:-1]
    # The largest size so far, key by key.
    base = np.cumsum(other) << 32
    reach = np.maximum.accumulate(base + top) - base
    new = other.copy()
    new[1:] |= 100 * reach[:-1] < percent * size[1:]
    first = np.flatnonzero(new)
    hub = node[first][np.cumsum(new) - 1]
    pairs = np.unique(np.stack([hub, node], axis=1)[hub != node], axis=0)
    rows = [(x, y, None, None, None, None, None) for x, y in forest(pairs[:, 0], pairs[:, 1])]
    if table["dealt"][0].as_py():
        last = np.append(first[1:], len(key)) - 1
        rows.append((None, None, table["bucket"][0].as_py(), key[first].tobytes(), node[first].tobytes(), size[first].astype("<u4").tobytes(), reach[last].astype("<u4").tobytes()))
    return exchange.rows_table(rows, _TIE_SCHEMA)


def tied_pairs(keys: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: ties between nodes of one key, from packed rows (bucket, keys, nodes, sizes)."""
    held = keys.groupBy("bucket").agg(F.sum(F.octet_length("keys")).alias("held")).filter(F.col("held") > KEY_BYTES)
    parts = small(kept(held.select("bucket", F.ceil(F.col("held") / KEY_BYTES).alias("parts"))))

    def ties(table: pa.Table) -> pa.Table:
        return _ties(table, percent)

    dealt = keys.join(parts, "bucket", "left").select(
        "bucket", F.coalesce(F.pmod(F.xxhash64("keys", "nodes"), "parts"), F.lit(0)).alias("part"), F.col("parts").isNotNull().alias("dealt"), "keys", "nodes", "sizes", F.col("sizes").alias("tops")
    )
    found = kept(dealt.groupBy("bucket", "part").applyInArrow(ties, _TIES))
    runs = found.filter("a is null").select("bucket", F.lit(False).alias("dealt"), "keys", "nodes", "sizes", "tops")
    between = runs.groupBy("bucket").applyInArrow(ties, _TIES)
    return found.filter("a is not null").union(between).select("a", "b")


def overlaps(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Overlap of every pair of a block's sets: the sparse incidence matrix times its
    transpose, row by row. Shingles of one set add nothing and are left out; those of the
    same sets are one column with their number as its weight."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    _, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    # Columns of equal rows, told by the sum of the rows' fingerprints.
    sums = np.zeros(len(count), np.uint64)
    np.add.at(sums, column, mix(row.astype(np.uint64) + np.uint64(1)))
    _, first, merged, weight = np.unique(np.where(count > 1, sums, np.uint64(0)), return_index=True, return_inverse=True, return_counts=True)
    use = (count[column] > 1) & (first[merged[column]] == column)
    row, column = row[use], merged[column[use]]
    by_column = np.argsort(column, kind="stable")
    holders, start = row[by_column], np.searchsorted(column[by_column], np.arange(len(first) + 1))
    size = np.diff(start)
    by_row = np.argsort(row, kind="stable")
    own, begin = column[by_row], np.searchsorted(row[by_row], np.arange(rows + 1))
    out = np.zeros((rows, rows), np.int64)
    for i in range(rows):
        mine = own[begin[i] : begin[i + 1]]
        n = size[mine]
        place = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[i] = np.bincount(holders[place], np.repeat(weight[mine], n), rows)
    return out


def block_links(texts: pa.Array, nodes: np.ndarray, size: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a block's documents."""
    grams, at = shingle_sets(texts, size)
    n = np.diff(at)
    own = set_hashes(grams, at).view(np.int64) == nodes  # other texts may stand under a node's id
    shared = overlaps(grams, at)
    a, b = np.nonzero(np.triu(shared, 1) * own[:, None] * own[None, :])
    linked = shared[a, b] >= least_overlap(n[a], n[b], percent)
    return forest(nodes[a[linked]], nodes[b[linked]])


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of ``df``."""
    own_id = F.col(doc_id).cast("long")
    docs = df.select(own_id.alias("doc_id"), F.coalesce(own_id, F.xxhash64(text)).alias("row"), F.col(text).alias("text"))
    chunked, chunks = exchange.in_chunks(docs, "text", "doc_id", "row")
    buckets, key_buckets = exchange.buckets_for(chunks), max(1, chunks // 8)

    def tokens(table: pa.Table) -> np.ndarray:
        return shingle_sets(table["text"], size)[0]

    def nodes_and_keys(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = _nodes_and_keys(table, answers, buckets, key_buckets, size, percent)
        trim()
        return found

    answers = exchange.shared_tokens(chunked, tokens, buckets)
    found = kept(chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(nodes_and_keys, _NODES))
    members = found.filter("kind = 0").select("doc_id", "row", "n", "node")
    pairs = gathered(tied_pairs(found.filter("kind = 1").select("bucket", "keys", "nodes", "sizes"), percent).distinct())
    tied = components(pairs)
    # One text of each node stands for all.
    nodes = kept(members.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.count("*").alias("copies")))
    known = gathered(nodes.join(tied, "node").select("node", "row", "n", "root"))
    # Equal rows without an id go once.
    rows = docs.filter("doc_id is not null").union(docs.filter("doc_id is null").dropDuplicates(["row"])).select("row", "text")

    def links(table: pa.Table) -> pa.Table:
        found = _links(table, size, percent)
        trim()
        return found

    def linked(blocks: DataFrame) -> DataFrame:
        wanted = kept(blocks.join(known, "node").select("block", "node", "row"))
        return rows.join(small(wanted), "row").select("block", "node", "text").groupBy("block").applyInArrow(links, "a long, b long")

    # First round: a document tied to more than one goes with the smallest of them.
    hubs = kept(pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("hub")).join(known.select("node", "n"), "node"))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    groups = hubs.join(hubs.groupBy("hub").agg(parts.alias("parts")), "hub")
    block = F.xxhash64("hub", "part").alias("block")
    stars = groups.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select("node", block)
    centers = groups.select("hub", "parts").distinct().select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("hub").alias("node"), F.xxhash64("hub", F.col("part").cast("long")).alias("block"))
    near = kept(linked(stars.union(centers)))
    classes = kept(components(near))

    # Second round: components that are not linked yet throughout.
    owned = known.join(classes.withColumnRenamed("root", "owner"), "node", "left").withColumn("owner", F.coalesce("owner", "node"))
    owners = kept(owned.groupBy("root", "owner").agg(F.count("*").alias("held")))
    open_roots = owners.groupBy("root").agg(F.count("*").alias("owners")).filter("owners > 1").select("root")
    big = owners.filter(F.col("held") > BLOCK).select("root", "owner", F.lit(True).alias("big"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / min(percent, 99))))
    left = owned.join(open_roots, "root").join(big, ["root", "owner"], "left")
    left = kept(left.select("node", "root", step.alias("step"), F.when(F.col("big"), F.col("owner")).alias("owner"), F.col("n").alias("weight")))
    found_links = linked(in_blocks(left, BLOCK, BLOCK_SHINGLES))
    return _classes(members.drop("row"), nodes, kept(components(near.union(found_links))))


def _classes(members: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every member; a node without links is its own class."""
    known = nodes.filter("n > 0").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = small(kept(known.groupBy("root").agg(F.min("doc_id").alias("component_id"))))
    known = kept(known.join(lowest, "root").select("node", "component_id", "copies"))
    hot, cool = (known.filter(f"copies {sign} {HOT}").select("node", "component_id") for sign in (">=", "<"))
    hot = small(hot)  # a row for each HOT members at most
    named = members.filter("n > 0").join(hot, "node").union(members.filter("n > 0").join(hot, "node", "left_anti").join(cool, "node").select("node", "doc_id", "n", "component_id"))
    return (
        named.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .union(members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def _links(table: pa.Table, size: int, percent: int) -> pa.Table:
    nodes = table["node"].to_numpy()
    found = block_links(table["text"].combine_chunks(), nodes, size, percent)
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose document is the first of its component. Rows without an id
    stay, and rows that share their component's smallest id stay all."""
    found = jaccard_components(df, doc_id, text).filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id))
    return df.join(small(kept(found.distinct())), doc_id, "left_anti")
