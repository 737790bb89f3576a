"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gives counts and four rates in parts per million. Their distribution in each
(language, source) group is sketched by counters over buckets whose width is a 16th of
their value: sketches merge by adding counters, have some hundred buckets at most however
many rows they hold, and don't depend on the order of the rows.

A group's limit is its HIGH quantile plus REACH times that quantile's distance from the
median; for a language, and for all rows, the quantile is WIDE, as a tenth of all rows is no
style of its own. A quantile of 0 doesn't mean that none is allowed, but that a text of the
group shows none with this probability: a limit is at least the rate at which a text of the
group's median length would (-log HIGH events in it, about a tenth of one). A group's limit is at most SPREAD times that of its language, and a
language's that of all rows; and it is drawn to it as if PRIOR documents of the wider
group stood in the group (the quartile of 20 values has a standard error of a tenth of
them), so small groups have their parent's limits and others their own.

A document fails if it has surely more events than its limit lets expect for its length: if
the square roots of both numbers, whose error is a half at any number of independent
events, differ by DOUBT / 2. So what one text may have grows with its length. Repeated words
count by two windows, the least that one repetition covers, and duplicate lines go by the
words of the text.

Edge cases: a null or empty text has no words and fails the base rule; a null language
or source is a group of its own; where no document passes the base rule there are no limits
and nothing is kept; repeated rows count each; an empty table gives an empty result; further columns are carried over, and columns of an output's name replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.store import kept
from shutterlake.llm.text_arrays import gram_hashes, hash_spans, map_slices, mix, raw, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
REACH, HIGH, WIDE, SPREAD, PRIOR, DOUBT = 3, 0.9, 0.75, 4, 20, 1.96
#: Count, size of one event and base of each rate.
RATES = {"symbols": ("n_symbols", 1, "word_chars"), "dup_lines": ("n_dup_lines", 1, "n_words"), "repeats": ("n_repeat_words", 2 * WINDOW, "n_words"), "word_length": ("word_chars", 1, "n_words")}
#: Lengths of texts, sketched beside the rates.
BASES = ("word_chars", "n_words")
#: Groups whose limits may be broadcast (about 100 bytes each).
BROADCAST_GROUPS = 200_000

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(column: pa.Array) -> list[np.ndarray]:
    """The arrays of COUNTS, one value for each text."""
    data, at = raw(column)
    rows = len(at) - 1
    sums = lambda mask, cut: np.diff(np.concatenate([[0], np.cumsum(mask)])[cut])
    starts, ends, of = words(data, at)
    n_words = np.diff(of)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.diff(np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])[of])
    row_key = mix(np.arange(1, rows + 1, dtype=np.uint64))

    # Lines with a word: cut at line feeds and row ends.
    feed = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([at[:-1], feed + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), len(data))
    line_ends = np.where(data[line_ends - 1] == 10, line_ends - 1, line_ends) if len(line_ends) else line_ends
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_row = np.searchsorted(at, line_starts, side="right") - 1
    n_lines = np.bincount(line_row, minlength=rows)
    _, first = np.unique(hash_spans(data, line_starts, line_ends) ^ row_key[line_row], return_index=True)
    n_dup = n_lines - np.bincount(line_row[first], minlength=rows)

    # Words in windows that come twice or more in their text.
    grams, whole = gram_hashes(hash_spans(data, starts, ends), of, WINDOW)
    where = np.flatnonzero(whole)
    word_row = np.repeat(np.arange(rows), n_words)
    _, inverse, counts = np.unique(grams[where] ^ row_key[word_row[where]], return_inverse=True, return_counts=True)
    again = where[counts[inverse] > 1] if len(where) else where
    edge = np.bincount(again, minlength=len(starts) + WINDOW) - np.bincount(again + WINDOW, minlength=len(starts) + WINDOW)
    covered = np.cumsum(edge)[: len(starts)] > 0
    return [n_words, chars, sums(_SYMBOL[data], at), n_dup, sums(covered, of), n_lines]


def measured(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append COUNTS and ``base_failed``."""

    def work(column: pa.Array) -> list[pa.Array]:
        return [pa.array(x.astype(np.int64)) for x in text_counts(column)]

    counted = map_slices(df, text, [(c, T.LongType()) for c in COUNTS], lambda: work, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _rates() -> dict:
    rates = {r: F.floor(1_000_000 * F.col(count) / F.greatest(F.col(base), F.lit(1))) for r, (count, _, base) in RATES.items()}
    return rates | {b: F.col(b) for b in BASES}


def _over(limit: dict) -> dict:
    """Whether a text has surely more events than the limit of each rate allows."""
    expected = lambda r, event, base: F.sqrt(limit[r] * F.col(base) / (1_000_000 * event))
    return {r: F.sqrt(F.col(count) / event) > expected(r, event, base) + DOUBT / 2 for r, (count, event, base) in RATES.items()}


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: the sketch of each group and rate as counters."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("value")) for k, v in _rates().items()])
    each = counted.filter(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("r")).select("lang", "source", "r.rate", "r.value")
    # Keep the value's five leading bits.
    drop = F.greatest(F.length(F.bin("value")) - 5, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(value, drop), drop)")
    return each.withColumn("drop", drop).groupBy("lang", "source", "rate", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(counters: DataFrame) -> DataFrame:
    """lang, source and max_<rate>, the limit of each rate."""
    levels = [("g", ["lang", "source"], HIGH), ("l", ["lang"], WIDE), ("a", [], WIDE)]
    own, language, every = [_limits(counters, level, high).alias(k) for k, level, high in levels]
    joined = own.join(language, F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.rate") == F.col("l.rate"))).join(every, F.col("g.rate") == F.col("a.rate"))
    drawn = lambda one, wider: (F.col(f"{one}.n") * F.least(F.col(f"{one}.limit"), SPREAD * wider) + PRIOR * wider) / (F.col(f"{one}.n") + PRIOR)
    limits = joined.select("g.lang", "g.source", "g.rate", drawn("g", drawn("l", F.col("a.limit"))).alias("limit"))
    return limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r, F.col("limit"))).alias(f"max_{r}") for r in RATES])


def _limits(counters: DataFrame, level: list[str], high: float) -> DataFrame:
    """level, rate, limit and n (documents) from the merged sketches of each group."""
    group = Window.partitionBy(*level, "rate")  # as many rows as a sketch has buckets
    merged = counters.groupBy(*level, "rate", "bucket").agg(F.sum("n").alias("n"))
    run = merged.withColumn("_upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("_all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("_upto") > q * F.col("_all"), F.col("bucket")))
    known = run.groupBy(*level, "rate").agg(at(0.5).alias("_middle"), at(high).alias("_high"), F.max("_all").alias("n"))
    end = F.expr("_high + shiftleft(1L, greatest(length(bin(_high)) - 5, 0)) - 1")  # the last value of the bucket
    fence = (end + REACH * (F.col("_high") - F.col("_middle"))).cast("double")
    of = lambda name, value: F.max(F.when(F.col("rate") == name, value))
    wide = known.groupBy(*level).agg(F.max("n").alias("n"), *[of(r, fence).alias(r) for r in RATES], *[of(b, F.col("_middle")).alias(f"_{b}") for b in BASES])
    least = {r: -math.log(high) * 1_000_000 * event / F.greatest(F.col(f"_{base}"), F.lit(1)) for r, (_, event, base) in RATES.items()}
    pairs = F.array(*[F.struct(F.lit(r).alias("rate"), F.greatest(F.col(r), least[r]).alias("limit")) for r in RATES])
    return wide.select(*level, "n", F.explode(pairs).alias("e")).select(*level, "e.rate", "e.limit", "n")


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append COUNTS, ``base_failed`` and ``kept``; the frame needs lang and source.
    Without ``keep`` the texts are carried through the intermediate table as well."""
    counted = kept(measured(df, text, keep))
    limits = kept(thresholds(sketches(counted)))
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    c, t = counted.alias("c"), limits.alias("t")
    joined = c.join(t, F.col("c.lang").eqNullSafe(F.col("t.lang")) & F.col("c.source").eqNullSafe(F.col("t.source")), "left")
    over = [F.coalesce(v, F.lit(False)) for v in _over({r: F.col(f"t.max_{r}") for r in RATES}).values()]
    verdict = ~F.col("base_failed") & ~(over[0] | over[1] | over[2] | over[3])
    return joined.select(*[F.col(f"c.`{x}`") for x in counted.columns if x.lower() != "kept"], verdict.alias("kept"))


def rules_digest(df: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each document."""
    judged = judge(df.select("doc_id", "lang", "source", "text"), keep=["doc_id", "lang", "source"])
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")
