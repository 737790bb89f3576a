"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits. Two fingerprints
that differ in 2 bits or fewer agree in one whole segment, and differ in the next one by 2
bits at most. The binary Golay code of length 23 is perfect: each word has exactly one
codeword within 3 bits. The words within one bit of a segment decode to one to six
codewords; segments that differ in 2 bits have a word within one bit of both, so they share
one of these. A key is an equal segment with a codeword of the next: 33 bits, and each
linked pair has one in common.

Spark makes fingerprints distinct first, so copies cost nothing more. Keys of up to FEW
fingerprints are compared pair by pair. Fingerprints of fuller keys, which lie close
together, are joined on their neighbours instead: two of them differ in 2 bits or fewer
exactly if they share a word that differs from each in one bit or none, and such a word has
65 neighbours at most. So no key's number of comparisons grows with its square, and no
pair is lost.

Edge cases: a null, empty or blank text has fingerprint zero and is linked like any other;
fewer than three words are one shingle; repeated rows and repeated ids are rows of their
own; a null id is never the smallest, and a component of null ids has component_id null;
further columns never take part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.components import components, gathered
from shutterlake.llm.skew import SHARE, join_counted
from shutterlake.llm.store import kept
from shutterlake.llm.text_arrays import LOWER_ASCII, map_slices, raw, words

SHINGLE = 3
SEED = 42
#: Low bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a key that are compared with each other; a neighbour join sends 65 rows each.
FEW = 64
#: Shingles whose bits are counted at a time.
PART = 1 << 16

# Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the code.
GENERATOR = 0b101011100011
LENGTH, CHECKS = 23, 11


def remainders() -> np.ndarray:
    """The syndrome of each single bit of a word."""
    out, value = [], 1
    for _ in range(LENGTH):
        out.append(value)
        value <<= 1
        if value >> CHECKS:
            value ^= GENERATOR
    return np.array(out, np.int64)


def error_patterns(bits: np.ndarray) -> np.ndarray:
    """The one pattern of up to 3 wrong bits for each syndrome."""
    out = np.zeros(1 << CHECKS, np.int64)
    for i in range(LENGTH):
        out[bits[i]] = 1 << i
        for j in range(i):
            out[bits[i] ^ bits[j]] = 1 << i | 1 << j
            for k in range(j):
                out[bits[i] ^ bits[j] ^ bits[k]] = 1 << i | 1 << j | 1 << k
    return out


class Golay:
    """Decodes words of up to 23 bits."""

    def __init__(self):
        self.bits = remainders()
        self.errors = error_patterns(self.bits)

    def syndromes(self, word: np.ndarray) -> np.ndarray:
        out = np.zeros(word.shape, np.int64)
        for i in range(LENGTH):
            out ^= np.where(word >> i & 1, self.bits[i], 0)
        return out

    def codewords(self, word: np.ndarray, width: int) -> np.ndarray:
        """Indices (12 bits) of the codewords of each word and of those a bit away from it in
        its ``width`` low bits, one row for each word."""
        flips = np.concatenate([[0], np.int64(1) << np.arange(width)])
        syndrome = self.syndromes(word)[:, None] ^ np.concatenate([[0], self.bits[:width]])
        return ((word[:, None] ^ flips) ^ self.errors[syndrome]) >> CHECKS


def fuzzy_keys(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the place of the fingerprint (unsigned) that each belongs to."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    keys, owners = [], []
    for i, part in enumerate(parts):
        j = (i + 1) % len(SEGMENTS)
        near = np.sort(golay.codewords(parts[j], SEGMENTS[j][1]), axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(first)
        keys.append(np.int64(i) << 34 | part[row] << 12 | near[row, column])
        owners.append(row)
    return np.concatenate(keys), np.concatenate(owners)


def shingle_bits(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of texts."""
    data = LOWER_ASCII[data]
    starts, ends, cut = words(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    # All words once more, one space apart.
    size = ends - starts
    to = np.cumsum(size + 1)
    text = np.full(int(to[-1]), 32, np.uint8)
    text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)]
    text = text.tobytes()
    n_words = np.diff(cut)
    n = np.where(n_words == 0, 0, np.maximum(n_words - SHINGLE + 1, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = cut[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(first + SHINGLE, cut[row + 1]) - 1
    counts = np.zeros((len(n), 64), np.int64)
    for i in range(0, len(row), PART):
        spans = zip((to[first[i : i + PART]] - size[first[i : i + PART]] - 1).tolist(), (to[last[i : i + PART]] - 1).tolist())
        hashes = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = row[i : i + PART]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``simhash``, the fingerprint as a signed integer."""

    def make():
        return lambda column: [pa.array(shingle_bits(*raw(column)).view(np.int64))]

    return map_slices(df, text, [("simhash", T.LongType())], make, keep)


def _links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all fingerprints (column ``simhash``, distinct) that differ in
    2 bits or fewer; each pair does so itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            own = batch.column("simhash").to_numpy()
            keys, at = fuzzy_keys(own.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[at])], names=["key", "simhash"])

    keyed = kept(prints.mapInArrow(run, "key long, simhash long"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > FEW)
    # At most 10 * SHARE keys by their share, whose rows are told apart before any shuffle.
    total = keyed.count()
    hot = F.broadcast(kept(counts.filter(F.col("n") * SHARE * 10 > total)).select("key"))
    rest = keyed.join(hot, "key", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    few = rest.filter(F.col("n") <= FEW).groupBy("key").agg(F.collect_list("simhash").alias("all")).select(F.explode("all").alias("a"), "all")
    near = F.filter("all", lambda b: (b > F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= 2))
    pairs = few.select("a", F.explode(near).alias("b"))
    # Fingerprints of full keys meet at their neighbours.
    full = keyed.join(hot, "key", "left_semi").select("simhash").union(rest.filter(F.col("n") > FEW).select("simhash")).distinct()
    around = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    middle = full.select("simhash", F.explode(around).alias("flip")).select("simhash", F.col("simhash").bitwiseXOR(F.col("flip")).alias("middle"))
    least = F.min("simhash").over(Window.partitionBy("middle"))
    stars = middle.select("simhash", least.alias("b")).filter("simhash <> b").select(F.col("simhash").alias("a"), "b")
    return pairs.union(stars).distinct()


def simhash_components(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = kept(fingerprints(df, ["doc_id"]))
    prints = kept(rows.groupBy("simhash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    links = gathered(_links(prints))
    tied = components(links) if links.take(1) else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    rooted = kept(prints.join(tied.withColumnRenamed("node", "simhash"), "simhash", "left").select("simhash", "n", "first", F.coalesce("root", "simhash").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = kept(join_counted(rooted, kept(smallest), "root", "members").select("simhash", "n", "component_id"))
    joined = join_counted(rows, named, "simhash", "n")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
