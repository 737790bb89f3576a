"""Secret scans: rules, and a character convolutional network over further candidates.

Candidates are runs of 12 or more characters of a secret's alphabet. Overlapping windows of
INSIDE characters, STEP apart, cover each from end to end. A small network in NumPy
(character embedding, one convolution, maximum over places, one output) scores each window
with the characters around it; a candidate's score is the largest of its windows. The
network is trained on labelled findings: windows that share LEAST characters with what the
assign or access rule marks, or with a hex run with letters, are secrets, windows that share
none are not, the others are left out. Secrets are also shown without what is before them,
and behind the words of a finding that is none, so that the network learns their look. Half of
the findings fit the network, a quarter calibrates its score and sets the threshold, the highest
one that keeps RECALL of that quarter's secrets, whatever precision it costs. The last quarter
takes no part in either: recall and precision at the threshold are measured on it and held by
the network. The quarters are cut by the digest of the secret itself (of the candidate, where
there is none), so that all windows and contexts of one secret fall into one of them. For
calibration and precision each sort weighs as much as it has labelled windows in all texts, so
that a score is a probability at the table's own rates.

All labelled windows of all documents take part in this (equal views count once). The fit starts
from a network that has seen those SAMPLE / 2 of either sort with the smallest digests of their
view, and then goes on over all of its half, each window once, in up to PASS_STEPS steps whose
gradients Spark's tasks add up. Calibration, threshold, recall and precision come from counts of
the scores of all windows of their quarters. Every window of every candidate of every text is
scored. A candidate above the threshold is a finding of its own unless it lies
within a rule's finding; those carry the largest score of the candidates they touch.

Edge cases: a null or empty text has no spans; with no secrets or nothing else among the
findings no spans are added; repeated rows give repeated results; an empty table gives an
empty result; further columns are carried over.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.store import kept
from shutterlake.llm.text_arrays import arrow_session, map_slices, mix, release, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
KINDS = ("assign", "access", "hex", "cnn")

SAMPLE = 6000
RECALL = 0.98
#: A run of STEP characters lies in one of the windows; findings have LEAST characters or more.
BEFORE, INSIDE, AFTER, STEP, LEAST = 24, 40, 8, 20, 12
#: Windows that are built and scored at once, and that are held in one row for the fit.
AT_ONCE = 4096
#: Steps and rate of the pass over all windows; its gradients are summed as whole numbers of
#: 1 / PARTS_OF_ONE, so that the sum doesn't depend on its order.
PASS_STEPS, PASS_RATE, PARTS_OF_ONE = 16, 0.002, 2.0**45
#: Scores are counted by 1 / BINS of a logit, between -REACH and REACH.
BINS, REACH = 1024, 30
LENGTH, EMBED, WIDTH, FILTERS = BEFORE + INSIDE + AFTER, 8, 5, 24

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the rules' findings, kind after kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def candidate_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def touched(start: np.ndarray, end: np.ndarray, marked: list[tuple[int, int]]) -> np.ndarray:
    """Whether each span shares a character with a marked one."""
    if not marked:
        return np.zeros(len(start), bool)
    a, b = np.array(sorted(marked), np.int64).T
    furthest = np.concatenate([[-1], np.maximum.accumulate(b)])
    return furthest[np.searchsorted(a, end)] > start


def within(start: np.ndarray, end: np.ndarray, marked: list[tuple[int, int]]) -> np.ndarray:
    """Whether each span lies in a marked one."""
    if not marked:
        return np.zeros(len(start), bool)
    a, b = np.array(sorted(marked), np.int64).T
    furthest = np.concatenate([[-1], np.maximum.accumulate(b)])
    return furthest[np.searchsorted(a, start, side="right")] >= end


def windows(spans: np.ndarray) -> np.ndarray:
    """Candidate start, end and window start for each window; the last window of a
    candidate ends with it."""
    start, end = spans.reshape(-1, 2).T
    n = 1 + np.maximum(0, -(-(end - start - INSIDE) // STEP))
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start, end = np.repeat(start, n), np.repeat(end, n)
    return np.stack([start, end, np.minimum(start + number * STEP, np.maximum(start, end - INSIDE))], axis=1)


def codes_of(text: str) -> np.ndarray:
    """1 for characters beyond ASCII, ASCII from 2."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, points + 2, 1).astype(np.int16)


def views(codes: np.ndarray, parts: np.ndarray, blind: bool = False) -> np.ndarray:
    """Codes of each window and its surroundings, 0 for nothing. Codes of the candidate
    itself are moved up by 130; with ``blind`` what is before it isn't shown."""
    start, end, at = parts.T[:, :, None]
    stop, place = np.minimum(end, at + INSIDE), np.arange(LENGTH)
    behind = place >= BEFORE + INSIDE
    where = np.where(behind, stop - INSIDE, at) - BEFORE + place
    shown = (where >= (start if blind else 0)) & (where < len(codes)) & (behind | (where < stop))
    own = (where >= start) & (where < end)
    return np.where(shown, codes[np.clip(where, 0, len(codes) - 1)] + 130 * own, 0).astype(np.int16)


class CharNetwork:
    """Embedding, convolution, maximum over places, logistic output."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.parts = [
            rng.normal(0, 0.3, (260, EMBED)), rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS),
            rng.normal(0, 0.3, FILTERS), np.zeros(1),
        ]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.recall = self.precision = float("nan")

    def _forward(self, x: np.ndarray) -> tuple:
        embed, kernel, bias, out, base = self.parts
        e = embed[x]
        windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - WIDTH + 1, WIDTH * EMBED)
        h = windows @ kernel + bias
        at = h.argmax(axis=1)
        top = np.take_along_axis(h, at[:, None, :], axis=1)[:, 0, :]
        return windows, at, np.maximum(top, 0), np.maximum(top, 0) @ out + base[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._scores(self.logits(x))

    def _scores(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        embed, kernel, bias, out, base = self.parts
        windows, at, top, z = self._forward(x)
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
        d_top = d[:, None] * out * (top > 0)
        picked = np.take_along_axis(windows, at[:, :, None], axis=1)  # sample, filter, window
        d_kernel = np.einsum("nfw,nf->wf", picked, d_top)
        d_window = (d_top[:, :, None] * kernel.T[None]).reshape(len(x), FILTERS, WIDTH, EMBED)
        d_embed = np.zeros_like(embed)
        codes = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
        np.add.at(d_embed, codes, d_window)
        return [d_embed, d_kernel, d_top.sum(axis=0), top.T @ d, np.array([d.sum()])]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300, seed: int = 12) -> None:
        """Adam on balanced batches."""
        rng = np.random.default_rng(seed)
        yes, no = np.flatnonzero(y), np.flatnonzero(~y)
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        for k in range(1, steps + 1):
            pick = np.concatenate([rng.choice(yes, 64), rng.choice(no, 64)])
            for i, g in enumerate(self._gradients(x[pick], y[pick], np.ones(len(pick)))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                self.parts[i] = self.parts[i] - 0.01 * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Logistic calibration of the weighted logits, and the recall-constrained threshold."""
        self.settle(self.logits(x), y, weight)

    def settle(self, logits: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, count: np.ndarray | None = None) -> None:
        """The same for logits, each of which stands for ``count`` findings (1)."""
        count = np.ones(len(y)) if count is None else count
        weight = count if weight is None else weight
        z = np.clip(logits, -30, 30)
        d = np.stack([z / 10, np.ones(len(z))], axis=1)
        # Labels drawn in by one imagined finding a side keep separable findings finite.
        yes, no = count[y].sum(), count[~y].sum()
        soft = np.where(y, (yes + 1) / (yes + 2), 1 / (no + 2))
        w = np.zeros(2)
        for _ in range(40):
            p = 1 / (1 + np.exp(-d @ w))
            step = np.linalg.solve((d * (weight * p * (1 - p))[:, None]).T @ d + 1e-2 * np.eye(2), d.T @ (weight * (soft - p)) - 1e-2 * w)
            w = w + step * min(1, 1 / (np.abs(step).max() + 1e-12))
        self.scale, self.shift = max(float(w[0]) / 10, 1e-3), float(w[1])
        order = np.argsort(logits[y], kind="stable")
        upto = np.cumsum(count[y][order])
        score = self._scores(logits[y][order])
        self.threshold = float(score[np.searchsorted(upto, int((1 - RECALL) * yes), side="right")]) if len(score) else 1.0
        self.judge(logits, y, weight, count)

    def measure(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Recall and precision at the threshold, on findings that should be unseen ones."""
        self.judge(self.logits(x), y, weight)

    def judge(self, logits: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, count: np.ndarray | None = None) -> None:
        count = np.ones(len(y)) if count is None else count
        weight = count if weight is None else weight
        hit = self._scores(logits) >= self.threshold
        self.recall = float(count[hit & y].sum() / count[y].sum()) if y.any() else float("nan")
        self.precision = float(weight[hit & y].sum() / weight[hit].sum()) if hit.any() else float("nan")


def name_of(core: str) -> int:
    """A 62-bit name of a secret or candidate, from which its quarter follows."""
    return int.from_bytes(hashlib.blake2b(core.encode(), digest_size=8).digest()) >> 2


def owners(text: str, parts: np.ndarray, secret: np.ndarray) -> np.ndarray:
    """The name of what each window shows: the value of the rule's finding that it touches (of
    several the first one), or else its candidate."""
    values = []
    if secret.any():
        values = sorted({(m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12} | {(*m.span(), m[0]) for rule in (ACCESS, HEX) for m in rule.finditer(text)})
    ends = np.maximum.accumulate(np.array([e for _, e, _ in values], np.int64)) if values else np.zeros(0, np.int64)
    names: dict[str, int] = {}
    out = np.empty(len(parts), np.int64)
    for i, (start, end, at) in enumerate(parts.tolist()):
        core = values[int(np.searchsorted(ends, at, side="right"))][2] if secret[i] else text[start:end]
        out[i] = names.setdefault(core, name_of(core))
    return out


def labelled(text: str | None):
    """Views, bare views and labels of a text's labelled windows, AT_ONCE at a time, with a
    function that gives the owners of some of them."""
    text = text or ""
    spans = candidate_spans(text)
    if not spans:
        return
    codes, parts = codes_of(text), windows(np.array(spans, np.int64))
    marked = [(s, e) for k, s, e in base_spans(text) if k < 2 or not text[s:e].isdigit()]
    at, stop = parts[:, 2], np.minimum(parts[:, 1], parts[:, 2] + INSIDE)
    secret = touched(at + LEAST - 1, stop - LEAST + 1, marked)
    told = np.flatnonzero(secret | ~touched(at, stop, marked))
    for i in range(0, len(told), AT_ONCE):
        some = told[i : i + AT_ONCE]
        yield views(codes, parts[some]), views(codes, parts[some], True), secret[some], lambda which, some=some: owners(text, parts[some[which]], secret[some[which]])


def findings(texts: list[str | None]) -> list[list[dict]]:
    """Labelled findings of each text: a window's view and whether it is a secret."""
    each = lambda t: ((v, b, y, o) for view, bare, secret, named in labelled(t) for v, b, y, o in zip(view, bare, secret, named(slice(None))))
    return [[{"view": v.tolist(), "bare": b.tolist(), "secret": bool(y), "owner": int(o)} for v, b, y, o in each(t)] for t in texts]


def digests(x: np.ndarray) -> np.ndarray:
    """A 63-bit digest of each view."""
    odd = mix(np.arange(1, LENGTH + 1, dtype=np.uint64)) | np.uint64(1)
    return (mix((x.astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64)) >> np.uint64(1)).astype(np.int64)


def smallest(texts: DataFrame, most: int | None = None) -> DataFrame:
    """secret, digest, owner, view, bare: each task's labelled windows, of either sort those
    ``most`` of the smallest digest (or all, then equal views may come more than once); of
    those that come together one of a sort has ``n``, the number of all of them."""

    def run(batches):
        best, bound, n = {True: {}, False: {}}, {True: 2**63, False: 2**63}, {True: 0, False: 0}

        def rows_of(sort: bool):
            rows = [(sort, d, *v, n[sort] if i == 0 else 0) for i, (d, v) in enumerate(best[sort].items())]
            best[sort], n[sort] = {}, 0
            if rows:
                kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["secret", "digest", "owner", "view", "bare", "n"])

        def prune(sort: bool) -> None:
            chosen = sorted(best[sort])[:most]
            best[sort] = {d: best[sort][d] for d in chosen}
            if len(chosen) == most:
                bound[sort] = chosen[-1]

        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    for x, bare, secret, named in labelled(text):
                        digest = digests(x)
                        for sort in (True, False):
                            n[sort] += int((secret == sort).sum())
                            low = np.flatnonzero((secret == sort) & (digest <= bound[sort]))
                            for i, owner in zip(low, named(low).tolist()):
                                found = (owner, x[i].tobytes(), bare[i].tobytes())
                                best[sort][int(digest[i])] = min(best[sort].get(int(digest[i]), found), found)
                            if most is None:
                                if len(best[sort]) > AT_ONCE:
                                    yield from rows_of(sort)
                            elif len(best[sort]) > 2 * most:
                                prune(sort)
        for sort in (True, False):
            if most is not None:
                prune(sort)
            yield from rows_of(sort)
        release()

    return texts.mapInArrow(run, "secret boolean, digest long, owner long, view binary, bare binary, n long")


def shown(x: np.ndarray, bare: np.ndarray, y: np.ndarray, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Views and labels of findings as they are, bare, and secrets in the others' places."""
    moved = x.copy()
    others = np.random.default_rng(seed).integers(0, max(int((~y).sum()), 1), int(y.sum()))
    if not y.all():
        moved[y, :BEFORE] = x[~y][others, :BEFORE]
    return np.concatenate([x, bare, moved]), np.concatenate([y, y, y])


def table_rates(y: np.ndarray, total: dict[bool, int]) -> np.ndarray:
    """Weights with which the labels stand in the ratio of ``total``; they add up to their number."""
    share = np.where(y, total[True] / max(int(y.sum()), 1), total[False] / max(int((~y).sum()), 1))
    return share * len(y) / share.sum()


def bare_of(x: np.ndarray) -> np.ndarray:
    """The views without what is before the candidate (whose codes are above 130)."""
    return np.where(np.maximum.accumulate(x > 130, axis=1), x, 0).astype(np.int16)


def gathered_windows(windows: DataFrame, rows: int) -> DataFrame:
    """number, secret, turn, view: the windows packed in so many rows by their digest, and in its order."""

    def pack(table: pa.Table) -> pa.Table:
        digest, secret, owner = (table[c].to_numpy() for c in ("digest", "secret", "owner"))
        order = np.lexsort((secret, digest))
        view = table["view"].to_pylist()
        return pa.table({
            "number": pa.array([table["number"][0].as_py()], pa.int64()), "secret": pa.array([secret[order].astype(np.uint8).tobytes()], pa.binary()),
            "turn": pa.array([(owner[order] % 4).astype(np.uint8).tobytes()], pa.binary()), "view": pa.array([b"".join(view[i] for i in order.tolist())], pa.binary()),
        })

    return windows.withColumn("number", F.pmod("digest", F.lit(rows))).groupBy("number").applyInArrow(pack, "number long, secret binary, turn binary, view binary")


def unpacked(batches, turns: list[set[int]]):
    """For each row the ``shown`` windows of each set of turns: views, labels, and how often each
    counts (what shows a window that is no secret in another place is the window itself)."""
    for batch in batches:
        for row in batch.to_pylist():
            y, turn = np.frombuffer(row["secret"], bool), np.frombuffer(row["turn"], np.uint8)
            x = np.frombuffer(row["view"], np.int16).reshape(-1, LENGTH)
            for k, some in enumerate(turns):
                own = np.isin(turn, list(some))
                if own.any():
                    views_, labels = shown(x[own], bare_of(x[own]), y[own], row["number"] + 13)
                    n = int(own.sum())
                    use = np.concatenate([np.ones(2 * n, bool), y[own]])
                    yield k, views_[use], labels[use], np.concatenate([np.where(y[own], 1, 2), np.ones(n, np.int64), np.ones(int(y[own].sum()), np.int64)])


def fit_all(model: CharNetwork, packed: DataFrame, turns: set[int], rows: int, number: dict[bool, int]) -> None:
    """Adam over all windows of these turns, each once, both sorts weighing the same."""
    steps, sizes = min(PASS_STEPS, rows), [p.size for p in model.parts]
    first, second = [np.zeros_like(p) for p in model.parts], [np.zeros_like(p) for p in model.parts]
    for k in range(1, steps + 1):

        def gradients(batches):
            total = np.zeros(sum(sizes), np.int64)
            for _, x, y, n in unpacked(batches, [turns]):
                weight = n * np.where(y, 1 / number[True], 1 / number[False]) * steps / 6
                for i in range(0, len(x), 512):
                    g = model._gradients(x[i : i + 512], y[i : i + 512], weight[i : i + 512] * len(x[i : i + 512]))
                    total += np.rint(np.concatenate([p.ravel() for p in g]) * PARTS_OF_ONE).astype(np.int64)
            release()
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        own = packed.filter(F.pmod("number", F.lit(steps)) == k - 1)
        total = sum((np.frombuffer(r["total"], np.int64) for r in own.mapInArrow(gradients, "total binary").collect()), np.zeros(sum(sizes), np.int64))
        for i, g in enumerate(np.split(total / PARTS_OF_ONE, np.cumsum(sizes)[:-1])):
            g = g.reshape(model.parts[i].shape)
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            model.parts[i] = model.parts[i] - PASS_RATE * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)


def logit_counts(model: CharNetwork, packed: DataFrame, turns: list[set[int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Logits (rounded down to 1 / BINS), labels and numbers of all windows of each set of turns."""
    width = 2 * REACH * BINS + 1

    def count(batches):
        total = np.zeros((len(turns), 2, width), np.int64)
        for k, x, y, n in unpacked(batches, turns):
            at = np.floor(np.clip(model.logits(x), -REACH, REACH) * BINS).astype(np.int64) + REACH * BINS
            np.add.at(total, (k, y.astype(np.int64), at), n)
        release()
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total.ravel()[where])], names=["place", "n"])

    found = packed.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # a row for each place at most
    place, n = (np.array([r[c] for r in sorted(found)], np.int64) for c in (0, 1))
    part, sort, at = np.unravel_index(place, (len(turns), 2, width))
    return [((at[part == k] - REACH * BINS) / BINS, sort[part == k] == 1, n[part == k].astype(float)) for k in range(len(turns))]


def train(df: DataFrame, text: str = "text") -> CharNetwork | None:
    """Fit, calibrated and measured on all labelled windows; null without both sorts."""
    arrow_session(df.sparkSession)
    most = SAMPLE // 2
    each = smallest(df.select(F.col(text).alias("text"))).drop("bare").groupBy("secret", "digest")
    each = kept(each.agg(F.min(F.struct("owner", "view")).alias("f"), F.sum("n").alias("n")).select("secret", "digest", "f.owner", "f.view", "n"))
    by_turn = each.groupBy("secret", F.pmod("owner", F.lit(4)).alias("turn")).agg(F.count("*").alias("views"), F.sum("n").alias("n")).collect()
    number = lambda secret, turns: sum(r["views"] for r in by_turn if r["secret"] == secret and r["turn"] in turns)
    total = {secret: sum(r["n"] for r in by_turn if r["secret"] == secret) for secret in (True, False)}
    if not all(total.values()):
        return None
    parts = [{0, 1}, {2}, {3}]
    if not all(number(secret, turns) for turns in parts for secret in (True, False)):
        parts = [{0, 1, 2, 3}] * 3  # too few to tell parts
    first = [r for secret in (True, False) for r in each.filter(F.col("secret") == secret).orderBy("digest").limit(most).collect() if r["owner"] % 4 in parts[0]]
    model = CharNetwork()
    y = np.array([r["secret"] for r in first], bool)
    if y.any() and not y.all():
        x = np.stack([np.frombuffer(r["view"], np.int16) for r in first])
        model.fit(*shown(x, bare_of(x), y))
    rows = -(-sum(r["views"] for r in by_turn) // AT_ONCE)
    packed = kept(gathered_windows(each.drop("n"), rows))
    fit_all(model, packed, parts[0], rows, {secret: number(secret, parts[0]) for secret in (True, False)})
    held, unseen = logit_counts(model, packed, parts[1:])
    rates = lambda y, n: n * np.where(y, total[True] / n[y].sum(), total[False] / n[~y].sum())
    model.settle(*held[:2], rates(*held[1:]), held[2])
    model.judge(*unseen[:2], rates(*unseen[1:]), unseen[2])
    return model


def scan(df: DataFrame, model: CharNetwork | None, text: str = "text", out: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """Append ``out``: (kind, start, end, score) of all findings in code points, by start and
    kind. Network findings (kind cnn) are candidates that don't lie in a rule's finding.
    Without a network, and where a rule's finding touches no candidate, the score is null."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scores(texts: list[str | None], spans: list[np.ndarray]) -> np.ndarray:
        """The largest score of each candidate's windows."""
        held, size, found, first, n = [], 0, [], [], 0
        for t, own in zip(texts, spans):
            if not len(own):
                continue
            codes, parts = codes_of(t), windows(own)
            first.append(n + np.flatnonzero(np.diff(parts[:, 0], prepend=-1)))
            n += len(parts)
            for i in range(0, len(parts), AT_ONCE):
                held.append(views(codes, parts[i : i + AT_ONCE]))
                size += len(held[-1])
                if size >= AT_ONCE:
                    found.append(model.probability(np.concatenate(held)))
                    held, size = [], 0
        if held:
            found.append(model.probability(np.concatenate(held)))
        return np.maximum.reduceat(np.concatenate(found), np.concatenate(first)) if found else np.zeros(0)

    def work(column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        spans = [np.array(candidate_spans(t) if t and model is not None else [], np.int64).reshape(-1, 2) for t in texts]
        ends = np.cumsum([len(x) for x in spans])
        score = scores(texts, spans)
        rows = []
        for t, own, to in zip(texts, spans, ends.tolist()):
            base = base_spans(t or "")
            (start, end), best = own.T, score[to - len(own) : to]
            told = []
            for k, s, e in base:
                i, j = np.searchsorted(end, s, side="right"), np.searchsorted(start, e)
                told.append((s, k, e, float(best[i:j].max()) if i < j else None))
            if model is not None:
                fresh = (best >= model.threshold) & ~within(start, end, [x[1:] for x in base])
                told += [(s, 3, e, p) for s, e, p in zip(start[fresh].tolist(), end[fresh].tolist(), best[fresh].tolist())]
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(told, key=lambda x: x[:3])])
        return [pa.array(rows, arrow)]

    return map_slices(df, text, [(out, SPAN)], lambda: work, keep)


def secrets_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end) of each document."""
    docs = df.select("doc_id", "text")
    found = scan(docs, train(docs), keep=["doc_id"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = told(F.filter("spans", lambda s: s["kind"] != "cnn"))
    return found.select("doc_id", *map(count, KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
