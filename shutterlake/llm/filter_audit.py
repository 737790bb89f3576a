"""What filters remove in each order, from count-weighted decision diagrams.

Spark reads the texts once, gives each document the mask of the filters that it fails and
counts the masks of each part: at most 32 rows a part, combined before they are shuffled.
A part's masks then become an ordered decision diagram: a level for each filter, an edge
for pass and one for fail, and at each node the documents that reach it (all, good and
toxic ones). Equal subdiagrams are one node, and what no document reaches has none.

Swapping two adjacent levels only rewrites the nodes of these two; the orders are walked
so that each differs from the one before by one swap. In each order the path of pass edges
from the root gives the steps: its nodes are what is kept, their fail edges what is removed.

Edge cases: a null text is empty, which fails A alone (and E beyond the first); a null
source and an empty one are the part ''; a null id is never larger than another, so it
doesn't fail E and doesn't make others fail; rows with equal ids and texts don't make each
other fail; a document is good (toxic) if any label of its id says so (a null id has
none), and labels without a document play no role; further columns never take part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.skew import join_counted
from shutterlake.llm.store import kept

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

NONE = (0, 0, 0)


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D (A: 1) that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    fails = [n < 50, F.size(F.array_distinct(words)) * 100 < n * 65, upper * 100 > F.char_length(text) * 5, text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters that they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = kept(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    texts = kept(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    rows = join_counted(rows, texts, "digest", "n", "left").select("doc_id", "part", (F.col("mask") + later).alias("mask"))
    flag = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)
    marks = labels.groupBy("doc_id").agg(flag("quality"), flag("toxic")).filter("quality + toxic > 0")
    marked = rows.join(marks, "doc_id", "left")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality"), total("toxic"))


class Diagram:
    """An ordered decision diagram whose nodes carry weights; 0 is the node of nothing."""

    def __init__(self, weights: dict[int, tuple[int, int, int]], filters: str = FILTERS):
        self.order = list(range(len(filters)))
        #: Of each node the children by pass and fail, and its weight.
        self.nodes: list[tuple[int, int, tuple]] = [(0, 0, NONE)]
        #: Nodes of each level by their children; the last level is that of the masks.
        self.levels: list[dict] = [{} for _ in range(len(filters) + 1)]
        self.root = self._build(0, weights)

    def _build(self, level: int, weights: dict) -> int:
        if not weights:
            return 0
        if level == len(self.order):
            return self._node(level, next(iter(weights.values())))
        bit = 1 << self.order[level]
        sides = ({m: w for m, w in weights.items() if not m & bit}, {m: w for m, w in weights.items() if m & bit})
        return self._node(level, tuple(self._build(level + 1, s) for s in sides))

    def _node(self, level: int, key: tuple) -> int:
        """The node of these children (on the last level: of this weight)."""
        last = level == len(self.order)
        if not last and key == (0, 0):
            return 0
        if key not in self.levels[level]:
            self.levels[level][key] = len(self.nodes)
            total = key if last else tuple(map(sum, zip(self.nodes[key[0]][2], self.nodes[key[1]][2])))
            self.nodes.append((0, 0, key) if last else (*key, total))
        return self.levels[level][key]

    def swap(self, level: int) -> None:
        """Exchanges the level with the next; what a node stands for, and so all above, stays."""
        upper, self.levels[level], self.levels[level + 1] = self.levels[level], {}, {}
        for node in upper.values():
            (pp, pf), (fp, ff) = (self.nodes[child][:2] for child in self.nodes[node][:2])
            key = (self._node(level + 1, (pp, fp)), self._node(level + 1, (pf, ff)))
            self.nodes[node] = (*key, self.nodes[node][2])
            self.levels[level][key] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple, tuple]]:
        """Filter, weight kept and weight removed of each step along the pass edges."""
        out, node = [], self.root
        for f in self.order:
            good, bad = self.nodes[node][:2]
            out.append((f, self.nodes[good][2], self.nodes[bad][2]))
            node = good
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap so that all orders of n filters are met once: the last one moves through
    each order of the others, from alternating ends."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + down  # while it stands first, the others begin one level lower
        down = not down


def part_rows(part: str, weights: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """Rows of RESULT for all orders of one part."""
    diagram = Diagram(weights)
    runs = [(list(diagram.order), diagram.steps())]
    for level in adjacent_swaps(len(FILTERS)):
        diagram.swap(level)
        runs.append((list(diagram.order), diagram.steps()))
    shapley, fails, alone = [0] * len(FILTERS), [0] * len(FILTERS), [0] * len(FILTERS)
    for order, steps in runs:
        for f, _, removed in steps:
            shapley[f] += removed[0]
        fails[order[0]] = steps[0][2][0]
        alone[order[-1]] = steps[-1][2][0]
    out = []
    for order, steps in runs:
        name = "".join(FILTERS[f] for f in order)
        for at, (f, left, gone) in enumerate(steps, 1):
            out.append((part, name, at, left[0], gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], shapley[f]))
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of RESULT for each part, order and step."""
    mask = F.struct("mask", "n", "quality", "toxic")
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(mask).alias("masks"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in RESULT.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[field.split()[1]] for field in RESULT.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                rows = part_rows(row["part"], {m["mask"]: (m["n"], m["quality"], m["toxic"]) for m in row["masks"]})
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return parts.mapInArrow(run, RESULT)
