"""Quality classifier by Bradley-Terry ranking of preference pairs.

A document's strength is linear in features of its text. Pairs of a good and a bad
labelled document are preferences; the weights minimize the logistic loss on the pairs'
feature differences. A threshold at the quantile of the bad rows' share among the
training scores separates the classes, and scores are scaled so that it lies at CUT.

The fit uses a bounded sample: the SAMPLE training rows of the smallest digest of their
id, and PAIRS pairs of them; every document is scored, over its whole text.

Edge cases: a null or empty text has all features 0 and gets a score like any other;
label rows without a class or a document are skipped; a document labelled more than once
has its lowest class; without both classes among the training rows all documents score
0.5; repeated rows score equally; an empty table gives an empty result; further columns
are carried over and are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.text_arrays import hash_spans, map_slices, raw, words

CUT = 0.3
SAMPLE = 4000
PAIRS = 20_000
FOLDS = 5

_CLASSES = [
    np.isin(np.arange(256), list(chars))
    for chars in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&", b"|<>", b"!", b".,", b"\n", b"-_=+/@:;?\"'()[]{}\\")
]
_CLASSES += [np.arange(256) >= 192, np.arange(256) <= 32]
N_FEATURES = len(_CLASSES) + 9


def text_features(column: pa.Array) -> np.ndarray:
    """Rates of byte classes, words, lines and repetition: a row for each text."""
    data, at = raw(column)
    rows = len(at) - 1
    starts, ends, of = words(data, at)
    size = np.maximum(np.diff(at), 1).astype(float)
    n_words = np.diff(of)
    count = np.maximum(n_words, 1).astype(float)
    sums = lambda mask, cut: np.diff(np.concatenate([[0], np.cumsum(mask)])[cut])
    out = [sums(c[data], at) / size for c in _CLASSES]
    length = ends - starts
    total = sums(length, of)
    out += [total / count / 16, np.sqrt(np.maximum(sums(length**2, of) / count - (total / count) ** 2, 0)) / 16]
    key = hash_spans(data, starts, ends) ^ np.repeat(np.arange(rows, dtype=np.uint64), n_words) * np.uint64(0x9E3779B97F4A7C15)
    _, first = np.unique(key, return_index=True)
    fresh = np.zeros(len(key), bool)
    fresh[first] = True
    out += [sums(fresh, of) / count]
    if len(starts):
        lead, tail = data[starts], data[ends - 1]
        upper, lower = _CLASSES[0], _CLASSES[1]
        out += [sums(upper[lead], of) / count, sums(upper[lead] & upper[tail], of) / count, sums(~(upper | lower)[tail] & (tail < 128), of) / count, sums(length == 1, of) / count]
    else:
        out += [np.zeros(rows)] * 4
    out += [np.log1p(n_words) / 10, (n_words == 0).astype(float)]
    return np.stack(out, axis=1)


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7) -> dict | None:
    """Bradley-Terry weights by Newton steps on feature differences, and the cut."""
    if not good.any() or good.all():
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(good), PAIRS)] - z[rng.choice(np.flatnonzero(~good), PAIRS)]
    w = np.zeros(x.shape[1])
    ridge = 1e-3 * len(d)
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the loss of each preference's odds
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ p - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    n_bad = int((~good).sum())
    at = float((s[n_bad - 1] + s[n_bad]) / 2)  # the quantile of the bad rows' share
    return {"mean": mean, "spread": spread, "w": w, "at": at, "scale": float(np.std(s) / 3 + 1e-9)}


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    s = (((x - model["mean"]) / model["spread"]) @ model["w"] - model["at"]) / model["scale"]
    return 1 / (1 + np.exp(-np.clip(s + np.log(CUT / (1 - CUT)), -30, 30)))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(df: DataFrame, labels: DataFrame, text: str = "text") -> dict | None:
    """Fit on labelled rows whose fold is not 0."""
    marked = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    marked = marked.filter(fold(F.col("doc_id")) != 0).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(SAMPLE)
    rows = df.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(marked), "doc_id")  # at most SAMPLE ids

    def work(column: pa.Array) -> list[pa.Array]:
        return [pa.array(list(text_features(column)), pa.list_(pa.float64()))]

    found = map_slices(rows, "_text", [("_x", T.ArrayType(T.DoubleType()))], lambda: work, ["doc_id", "_good"])
    # A document id may stand in several rows; one of each id's texts is enough.
    held = found.groupBy("doc_id").agg(F.min(F.struct("_x", "_good")).alias("r")).orderBy("doc_id").select("r.*").collect()  # at most SAMPLE rows
    if not held:
        return None
    return fit(np.array([r["_x"] for r in held]), np.array([r["_good"] == 1 for r in held]))


def score_quality(df: DataFrame, labels: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 from CUT on) to every row."""
    model = train(df, labels, text)

    def work(column: pa.Array) -> list[pa.Array]:
        s = score(model, text_features(column))
        return [pa.array(s), pa.array((s >= CUT).astype(np.int32))]

    return map_slices(df, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], lambda: work, keep)


def score_digest(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    scored = score_quality(df.select("doc_id", "text"), labels, keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
