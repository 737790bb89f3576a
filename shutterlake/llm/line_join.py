"""Line dedup by a segment-partition edit join.

A line within EDITS edits of another one, cut into EDITS + 1 segments, leaves at least one
of the other's segments whole. So each distinct line is indexed by its segments, and looks
up those substrings of its own that can match a segment of a line of its length or up to
EDITS shorter (the places that edits before and behind allow). An edit changes the parity of
two characters and of four pairs of neighbours at most: of the lines that meet in a key only
those stay a candidate pair whose parities differ in 2 * EDITS bits of characters and
4 * EDITS of neighbours or fewer. Each candidate pair gets its two texts and is verified with a
banded bit-parallel edit distance, for all pairs of a slice at once.

Lines of one template agree in a segment and often in their parities. A key with more than
ALIKE candidate pairs for each of its entries (more than FEW) is divided instead: its lines are cut again into
EDITS + 1 segments, now where the places at which they differ are shared out evenly, and
indexed by those within the key; keys that are still too full are divided again as long as this
halves the work. What can't be divided (hundreds of lines that are really near each other)
is cut into blocks of lines, and each pair of blocks joins its lines by the same keys.

A line goes if it, or a line within EDITS edits, occurs earlier (smaller document id, or
the same document and an earlier line). This is judged on the input, not on what is left.
So of equal lines only the first can stay, and it stays if no line near it comes earlier.
Lines of fewer than MIN_CHARS code points, where two edits can make another line of it, are
compared for equality only. Lines without a word, or of fewer than ``exact_chars`` code
points, always stay.

Edge cases: a null or empty text has no lines that take part and stays as it is; a null
id comes first; rows of equal ids have equally early lines, which don't remove each
other; an empty table gives an empty result; further columns are carried over.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm import exchange
from shutterlake.llm.components import components, gathered, in_blocks, small
from shutterlake.llm.store import kept, spare
from shutterlake.llm.text_arrays import arrow_session, joined_spans, mix, raw, release, slices, trim

EDITS, MIN_CHARS, EXACT_CHARS = 2, 20, 1
#: Lines and code points of a block.
BLOCK, BLOCK_CHARS = 400, 500_000
#: Pairs that are compared at once, and from how many on a key's lines are split by parities.
AT_ONCE = 1 << 21
#: Pairs of one key from which on it is divided without comparing their parities, candidate
#: pairs for each entry of a key from which on it is divided, and entries up to which it isn't.
HOT_PAIRS, ALIKE, FEW = 1 << 28, 1, 32
#: Places at which the lines of a divided key are compared; longer lines are cut into as many pieces.
PLACES = 128
PILE_CHARS = 1_000_000
NULL_ID = -(2**63)


def split_lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, end (bytes), row and number in the row of every line."""
    feed = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([at[:-1], feed + 1]))
    row = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(feed, at)) + 1)
    # A row's last line ends with the row, the others at their line feed.
    end = np.empty(len(start), np.int64)
    last = np.ones(len(start), bool)
    last[:-1] = row[1:] != row[:-1]
    end[last], end[~last] = at[1:], feed
    # Ties in the sort (an empty row before another) keep the order of rows.
    number = np.arange(len(start)) - np.searchsorted(row, row)
    return start, end, row, number


def code_points(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the places of byte cuts among them."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint32), np.asarray(cuts, np.int64)
    heads = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), heads[cuts].astype(np.int64)


def segments(length: np.ndarray, k: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment k (from 0) of lines of these lengths; the last ones are longer by one."""
    base, extra = length // (edits + 1), length % (edits + 1)
    longer = np.maximum(k - (edits + 1 - extra), 0)
    return k * base + longer, base + (k >= edits + 1 - extra)


_ODD = 0x9E3779B97F4A7C15
_CODES = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, the first ones being 1."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 19)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def running(chars: np.ndarray) -> np.ndarray:
    """Running sums of scrambled code points times powers: any substring's fingerprint is a
    difference of two of them times an inverse power."""
    if not len(chars) or chars.max() < len(_CODES):
        value = _CODES[chars]
    else:
        known = chars < len(_CODES)
        value = _CODES[np.where(known, chars, 0)]
        value[~known] = mix(chars[~known].astype(np.uint64) + np.uint64(1))
    value *= powers(len(chars) + 1)[0][:-1]
    out = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(value, out=out[1:])
    return out


def parities(chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Parities of each line's characters in 32 classes (low bits; letters of one alphabet
    have classes of their own) and of its pairs of neighbours in 32 classes (high bits)."""
    one, low = np.uint32(1), np.uint32(31)
    single, double = (np.zeros(len(chars) + 1, np.uint32) for _ in range(2))
    np.bitwise_xor.accumulate(one << (chars & low), out=single[1:])
    if len(chars) > 1:
        pair = chars[:-1] * np.uint32(0x9E3779B1) + chars[1:] * np.uint32(0x85EBCA77)
        pair ^= pair >> np.uint32(15)
        pair *= np.uint32(0x2C1B3C6D)
        np.bitwise_xor.accumulate(one << (pair >> np.uint32(27)), out=double[1:-1])
    end = start + length
    # A line of n characters has n - 1 pairs, all between its ends.
    pairs = np.where(length > 1, double[np.maximum(end - 1, 0)] ^ double[start], np.uint32(0))
    return (single[end] ^ single[start]).astype(np.uint64) | pairs.astype(np.uint64) << np.uint64(32)


def alike(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether parities differ no more than those of lines within ``edits`` can."""
    differ = a ^ b
    return (np.bitwise_count(differ & np.uint64(0xFFFFFFFF)) <= 2 * edits) & (np.bitwise_count(differ >> np.uint64(32)) <= 4 * edits)


def line_hashes(run: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    undo = powers(len(run))[1]
    return mix((run[start + length] - run[start]) * undo[start] + mix(length.astype(np.uint64)))


def line_keys(
    run: np.ndarray, start: np.ndarray, length: np.ndarray, edits: int = EDITS, salt: np.ndarray | None = None, cuts: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, probe): index keys of each line's segments, and probe keys of the
    substrings that a segment of an indexed line of length - edits .. length can match.
    Lines of different ``salt`` share no key. ``cuts`` has for each line the ends of the
    segments of lines of its length, of one less and so on (-1: there are none)."""
    undo = powers(len(run))[1]

    def key(line: np.ndarray, at: np.ndarray, size: np.ndarray, k: int, of: np.ndarray) -> np.ndarray:
        a = start[line] + at
        part = (run[a + size] - run[a]) * undo[a] + mix(of.astype(np.uint64) * np.uint64(64) + np.uint64(k))
        return mix(part if salt is None else part + salt[line])

    def segment(k: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        return segments(length - less, k, edits) if cuts is None else (cuts[:, less, k], cuts[:, less, k + 1] - cuts[:, less, k])

    every = np.arange(len(start))
    lines, keys, probes = [], [], []

    def put(line: np.ndarray, value: np.ndarray, probe: int) -> None:
        lines.append(line)
        keys.append(value)
        probes.append(np.full(len(line), probe, np.uint8))

    for k in range(edits + 1):
        at, size = segment(k, 0)
        put(every, key(every, at, size, k, length), 0)
        for less in range(edits + 1):
            of = length - less
            at, size = segment(k, less)
            # Before the segment at most k edits, behind it at most edits - k.
            for shift in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1):
                ok = np.flatnonzero((at + shift >= 0) & (at + shift + size <= length) & (size > 0))
                put(ok, key(ok, (at + shift)[ok], size[ok], k, of[ok]), 1)
    return np.concatenate(lines), np.concatenate(keys), np.concatenate(probes)


def within(chars: np.ndarray, start_a: np.ndarray, len_a: np.ndarray, start_b: np.ndarray, len_b: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Whether each pair of strings is within ``edits``: banded bit-parallel distances.

    Bit b of a column's vectors stands for row j - edits + b of the longer string, so the
    band of 2 * edits + 1 rows moves down by one each column. Vertical differences are kept
    as positive and negative bits; the distance is followed on the end's diagonal."""
    swap = len_a < len_b
    pattern, m = np.where(swap, start_b, start_a), np.where(swap, len_b, len_a)
    text, n = np.where(swap, start_a, start_b), np.where(swap, len_a, len_b)
    out = np.zeros(len(m), bool)
    live = np.flatnonzero(m - n <= edits)
    width = 2 * edits + 1
    full = np.int64((1 << width) - 1)
    score = (m - n)[live].astype(np.int64)
    diagonal = edits + score
    rise = np.full(len(live), sum(1 << b for b in range(width) if b > edits), np.int64)
    fall = np.zeros(len(live), np.int64)
    j = 0
    while len(live):
        done = n[live] == j
        if done.any() or not j % 8:
            out[live[done]] = score[done] <= edits
            stay = ~done & (score <= edits)
            live, score, diagonal, rise, fall = live[stay], score[stay], diagonal[stay], rise[stay], fall[stay]
            if not len(live):
                break
        j += 1
        now = chars[text[live] + j - 1]
        equal = np.zeros(len(live), np.int64)
        for b in range(width):
            i = j - edits + b - 1
            if i >= 0:
                inside = i < m[live]
                equal |= (inside & (chars[np.where(inside, pattern[live] + i, 0)] == now)).astype(np.int64) << b
        rise, fall = rise >> 1 | np.int64(1 << width - 1), fall >> 1
        zero = ((((equal & rise) + rise) ^ rise) | equal | fall) & full
        plus, minus = (fall | ~(zero | rise)) & full, zero & rise
        score = score + 1 - (zero >> diagonal & 1)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        rise, fall = (minus | ~(zero | plus)) & full, zero & plus
    return out


def block_pairs(chars: np.ndarray, start: np.ndarray, length: np.ndarray, edits: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of lines of one group within ``edits``."""
    salt = None if group is None else mix(group.astype(np.uint64) + np.uint64(1))
    line, key, probe = line_keys(running(chars), start, length, edits, salt)
    order = np.lexsort((probe, key))
    line, key, probe = line[order], key[order], probe[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    mids = cuts[:-1] + np.add.reduceat(probe == 0, cuts[:-1]) if len(key) else cuts[:-1]
    found = [np.zeros(0, np.int64)]
    for i, mid, j in zip(cuts[:-1], mids, cuts[1:]):
        if i < mid < j:
            a, b = np.repeat(line[i:mid], j - mid), np.tile(line[mid:j], mid - i)
            found.append(np.unique(np.minimum(a, b) * len(start) + np.maximum(a, b)))
            if len(found) > 2000:
                found = [np.unique(np.concatenate(found))]
    pairs = np.unique(np.concatenate(found))
    a, b = pairs // max(len(start), 1), pairs % max(len(start), 1)
    a, b = a[a != b], b[a != b]
    # Long pairs go together, so that short ones don't wait for them.
    order = np.argsort(length[a], kind="stable")
    a, b = a[order], b[order]
    keep = [within(chars, start[a[k : k + 50_000]], length[a[k : k + 50_000]], start[b[k : k + 50_000]], length[b[k : k + 50_000]], edits) for k in range(0, len(a), 50_000)]
    ok = np.concatenate([np.zeros(0, bool), *keep])
    return a[ok], b[ok]


class Lines(NamedTuple):
    """The lines of a slice that take part, and whether they are long enough for near ones."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    number: np.ndarray
    chars: np.ndarray
    run: np.ndarray
    at: np.ndarray
    length: np.ndarray
    line: np.ndarray
    near: np.ndarray


def lines_of(column: pa.Array, min_chars: int, exact_chars: int) -> Lines:
    data, at = raw(column)
    start, end, row, number = split_lines(data, at)
    chars, cuts = code_points(data, np.stack([start, end]))
    in_words = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data != 32) & ((data < 9) | (data > 13)), out=in_words[1:])
    part = (cuts[1] - cuts[0] >= exact_chars) & (in_words[end] > in_words[start])
    run, first, length = running(chars), cuts[0][part], (cuts[1] - cuts[0])[part]
    line = line_hashes(run, first, length).view(np.int64)
    return Lines(data, start[part], end[part], row[part], number[part], chars, run, first, length, line, length >= min_chars)


def _lines(docs: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """doc_id, number, line (hash), length of the lines that take part; of a slice's equal
    lines only the first."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = lines_of(part.column("text"), min_chars, exact_chars)
                doc = part.column("doc_id").to_numpy()[x.row]
                order = np.lexsort((x.number, doc, x.line))
                first = order[np.flatnonzero(np.diff(x.line[order], prepend=x.line[order[:1]] - 1) != 0)] if len(order) else order
                yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(x.number[first]), pa.array(x.line[first]), pa.array(x.length[first])], names=["doc_id", "number", "line", "length"])
        release()

    return docs.mapInArrow(run, "doc_id long, number long, line long, length long")


SENT = pa.schema([("bucket", pa.int64()), ("rest", pa.binary()), ("line", pa.binary()), ("parity", pa.binary()), ("probe", pa.binary())])
SENT_COLUMNS = "bucket long, rest binary, line binary, parity binary, probe binary"


def _packed(name: np.ndarray, parity: np.ndarray, keys: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int) -> pa.Table:
    """Keys of lines with these names and parities, a row for each key bucket."""
    line, key, probe = keys
    places = exchange.place(key, buckets)
    order = np.argsort((places >> np.uint64(40)).astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
    places, line, probe = places[order], line[order], probe[order]
    rows = [
        (b, exchange.planes(places[i:j] & exchange.REST), exchange.planes(name[line[i:j]].view(np.uint64), 8), exchange.planes(parity[line[i:j]], 8), probe[i:j].tobytes())
        for b, i, j in exchange.by_bucket(places)
    ]
    return exchange.rows_table(rows, SENT)


def _sent_keys(docs: DataFrame, buckets: int, edits: int, min_chars: int) -> DataFrame:
    """Packed keys of each slice's distinct lines, for the key buckets."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = lines_of(part.column("text"), min_chars, min_chars)
                name, once = np.unique(x.line, return_index=True)
                if len(once):
                    parity = parities(x.chars, x.at[once], x.length[once])
                    yield from _packed(name, parity, line_keys(x.run, x.at[once], x.length[once], edits), buckets).to_batches()
        release()

    return docs.select("text").mapInArrow(run, SENT_COLUMNS)


def even_cuts(counts: np.ndarray, edges: np.ndarray, edits: int) -> list[int]:
    """Ends of edits + 1 segments between which the entropy of the places is shared out evenly.
    ``counts``: of 16 classes at each place; ``edges``: where the places start and end."""
    share = counts / counts.sum(axis=1, keepdims=True)
    weight = np.cumsum(-(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1) + 1e-3)
    at = edges[1 + np.searchsorted(weight, weight[-1] * np.arange(1, edits + 1) / (edits + 1))]
    k = np.arange(1, edits + 1)  # a segment has a character at least
    at = np.minimum(np.maximum.accumulate(np.maximum(at, k) - k) + k, edges[-1] - (edits + 1 - k))
    return [0, *at.tolist(), int(edges[-1])]


def _cuts(held: DataFrame, edits: int) -> DataFrame:
    """hot, length, cuts: where the lines of each length in each divided key are cut, and before
    that where those of one character less are, and so on. A part of a key's lines (the one with
    the most, of those in one task) decides for all of them; this bears on speed alone."""

    def run(batches):
        now, counts, edges, n = None, None, None, 0
        for batch in batches:
            for part in slices(batch, "line_text"):
                chars, at = code_points(*raw(part.column("line_text")))
                sums, undo = running(chars), powers(len(chars) + 1)[1]
                hot, length = (part.column(c).to_numpy() for c in ("hot", "length"))
                change = np.flatnonzero(np.append(True, (hot[1:] != hot[:-1]) | (length[1:] != length[:-1])))
                for i, j in zip(change.tolist(), [*change[1:].tolist(), len(hot)]):
                    if now != (hot[i], length[i]):
                        if n:
                            yield pa.RecordBatch.from_pylist([{"hot": int(now[0]), "length": int(now[1]), "n": n, "cuts": even_cuts(counts, edges, edits)}], CUTS)
                        now, n = (hot[i], length[i]), 0
                        places = min(int(length[i]), PLACES)
                        edges = int(length[i]) * np.arange(places + 1) // places
                        counts = np.zeros((places, 16), np.int64)
                    for m in range(i, j, 2000):
                        where = at[m : min(m + 2000, j), None] + edges
                        piece = mix((sums[where[:, 1:]] - sums[where[:, :-1]]) * undo[where[:, :-1]]) >> np.uint64(60)
                        counts += np.bincount((piece.astype(np.int64) + 16 * np.arange(len(counts))).ravel(), minlength=counts.size).reshape(counts.shape)
                    n += j - i
        if n:
            yield pa.RecordBatch.from_pylist([{"hot": int(now[0]), "length": int(now[1]), "n": n, "cuts": even_cuts(counts, edges, edits)}], CUTS)
        release()

    ordered = held.select("hot", "length", "line_text", "line").repartitionByRange("hot", "length", "line").sortWithinPartitions("hot", "length")
    parts = ordered.drop("line").mapInArrow(run, "hot long, length long, n long, cuts array<int>")
    each = parts.groupBy("hot", "length").agg(F.max(F.struct("n", "cuts"))["cuts"].alias("cuts"))
    longer = each.select("hot", "cuts", F.posexplode(F.sequence(F.col("length"), F.col("length") + edits)).alias("less", "length"))
    none = F.array_repeat(F.lit(-1), edits + 2)
    by_less = [F.coalesce(F.max(F.when(F.col("less") == k, F.col("cuts"))), none) for k in range(edits + 1)]
    return longer.groupBy("hot", "length").agg(F.concat(*by_less).alias("cuts"))


CUTS = pa.schema([("hot", pa.int64()), ("length", pa.int64()), ("n", pa.int64()), ("cuts", pa.list_(pa.int32()))])


def _divided_keys(held: DataFrame, buckets: int, edits: int) -> DataFrame:
    """Packed keys of the lines of each divided key, by segments of their own."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "line_text"):
                chars, at = code_points(*raw(part.column("line_text")))
                start, length = at[:-1], np.diff(at)
                cuts = part.column("cuts").flatten().to_numpy().astype(np.int64).reshape(len(start), edits + 1, edits + 2)
                salt = mix(part.column("hot").to_numpy().view(np.uint64))
                keys = line_keys(running(chars), start, length, edits, salt, cuts)
                yield from _packed(part.column("line").to_numpy(), parities(chars, start, length), keys, buckets).to_batches()
        release()

    columns = held.join(small(kept(_cuts(held, edits))), ["hot", "length"]).select("hot", "line", "line_text", "cuts")
    return columns.mapInArrow(run, SENT_COLUMNS)


def _groups(group: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, indexed and probing lines of each group, and the group of each line."""
    cut = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)
    count = np.diff(np.append(cut, len(group)))
    of = np.repeat(np.arange(len(cut)), count)
    indexed = np.bincount(of, probe == 0, len(cut)).astype(np.int64)
    return cut, indexed, count - indexed, of


def _by_parts(parity: np.ndarray, edits: int):
    """(part, its value for each line) of the characters' parities cut in 2 * edits + 1 parts:
    lines that may be near have the same value of one of them at least."""
    edges = np.linspace(0, 32, 2 * edits + 2).astype(np.uint64)
    for part, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        yield part, (parity >> lo & ((np.uint64(1) << hi - lo) - np.uint64(1))).astype(np.int64)


def _crossed(group: np.ndarray, parity: np.ndarray, probe: np.ndarray, edits: int, split: bool = True):
    """(a, b), part by part: places of indexed and probing lines of one group (sorted, the
    indexed ones first) whose parities differ little enough. Large groups are split by equal
    parts of the parities."""
    cut, indexed, probing, of = _groups(group, probe)
    large = (indexed * probing > AT_ONCE) if split else np.zeros(len(cut), bool)
    each = np.flatnonzero((probe == 0) & ~large[of] & (probing[of] > 0)) if len(cut) else cut
    upto = np.cumsum(probing[of[each]])
    i = 0
    while i < len(each):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AT_ONCE, side="right")))
        some = each[i:j]
        n = probing[of[some]]
        a = np.repeat(some, n)
        b = np.repeat((cut + indexed)[of[some]], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        ok = alike(parity[a], parity[b], edits)
        yield a[ok], b[ok]
        i = j
    if large.any():
        own = np.flatnonzero(large[of])
        for _, value in _by_parts(parity[own], edits):
            part = of[own] * 2**16 + value
            order = np.lexsort((probe[own], part))
            for a, b in _crossed(part[order], parity[own[order]], probe[own[order]], edits, False):
                yield own[order[a]], own[order[b]]


def _ties(table: pa.Table, edits: int, hot_pairs: int, alike_most: int, few: int) -> pa.Table:
    """For one key bucket: pairs of lines of one key that may be near by their parities (a, b),
    and the lines (a) of keys that have too many of them (hot)."""
    rest = np.concatenate([exchange.joined(x) for x in table["rest"].to_pylist()])
    line = np.concatenate([exchange.joined(x, 8) for x in table["line"].to_pylist()]).view(np.int64)
    parity = np.concatenate([exchange.joined(x, 8) for x in table["parity"].to_pylist()])
    probe = np.concatenate([np.frombuffer(x, np.uint8) for x in table["probe"].to_pylist()])
    order = np.lexsort((line, probe, rest))
    rest, line, parity, probe = rest[order], line[order], parity[order], probe[order]
    fresh = np.ones(len(order), bool)  # equal lines of several slices are one
    fresh[1:] = (rest[1:] != rest[:-1]) | (line[1:] != line[:-1]) | (probe[1:] != probe[:-1])
    rest, line, parity, probe = rest[fresh], line[fresh], parity[fresh], probe[fresh]
    cut, indexed, probing, of = _groups(np.cumsum(np.append(True, rest[1:] != rest[:-1])) - 1, probe)
    over = indexed * probing > hot_pairs
    cold = ~over[of]
    pairs, full = _near_pairs(of[cold], line[cold], parity[cold], probe[cold], edits, np.where(indexed + probing > few, alike_most * (indexed + probing), indexed * probing))
    hot = np.flatnonzero((over | full)[of])
    bucket = np.uint64(table["bucket"][0].as_py())
    members = np.unique(np.stack([mix(rest[hot] | bucket << np.uint64(40)).view(np.int64), line[hot]], axis=1), axis=0)
    return pa.table({
        "a": pa.array(np.concatenate([pairs[:, 0], members[:, 1]])), "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(members), pa.int64())]),
        "hot": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(members[:, 0])]),
    })


def _near_pairs(group: np.ndarray, line: np.ndarray, parity: np.ndarray, probe: np.ndarray, edits: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lines whose parities allow that they are near, of the groups with no more than
    ``most`` of them, and which groups have more."""
    count = np.zeros(len(most), np.int64)
    held: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
    size, bound = 0, AT_ONCE

    def calm() -> np.ndarray:
        x = np.concatenate(held, axis=1)
        return x[:, count[x[0]] <= most[x[0]]]

    for a, b in _crossed(group, parity, probe, edits):
        other = line[a] != line[b]
        a, b = a[other], b[other]
        np.add.at(count, group[a], 1)
        held.append(np.stack([group[a], line[a], line[b]]))
        size += len(a)
        if size > bound:
            held = [calm()]
            size = held[0].shape[1]
            bound = max(AT_ONCE, 2 * size)
    _, x, y = calm()  # equal pairs of parts may have been counted more than once
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0), count > most


def _pairs_later(pairs: DataFrame, edits: int) -> DataFrame:
    """line: of each pair within the edits (a_text, b_text, a_at, b_at) the later one."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "a_text"):
                texts = pa.concat_arrays([part.column("a_text"), part.column("b_text")])
                chars, at = code_points(*raw(texts))
                start, length = at[:-1], np.diff(at)
                n = part.num_rows
                order = np.argsort(length[:n], kind="stable")  # long pairs go together, so that short ones don't wait
                ok = np.zeros(n, bool)
                for i in range(0, n, 50_000):
                    a = order[i : i + 50_000]
                    ok[a] = within(chars, start[a], length[a], start[a + n], length[a + n], edits)
                later = pc.if_else(part.column("a_is_later"), part.column("a"), part.column("b"))
                yield pa.RecordBatch.from_arrays([later.filter(pa.array(ok))], names=["line"])
        release()

    return pairs.mapInArrow(run, "line long")


def _texts(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """line, line_text of the lines of ``wanted`` (line, first_doc, first_number), from where they first stand."""
    by_doc = small(kept(wanted.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_set("line").alias("lines"))))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = lines_of(part.column("text"), min_chars, min_chars)
                lists = part.column("lines")
                names = lists.flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                # A row's lines are told from other rows' by the row's number.
                ours, theirs = (mix(line.view(np.uint64) + mix(row.astype(np.uint64))) for line, row in ((x.line, x.row), (names, of)))
                _, once = np.unique(ours, return_index=True)
                once = once[np.isin(ours[once], theirs)]
                text = pa.array([x.data[a:b].tobytes().decode() for a, b in zip(x.start[once], x.end[once])], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x.line[once]), text], names=["line", "line_text"])
        release()

    return docs.join(by_doc, "doc_id").select("text", "lines").mapInArrow(run, "line long, line_text string")


def _later(table: pa.Table, edits: int) -> pa.Table:
    """For a pile of pairs of blocks: the lines within the edits of an earlier one."""
    data, at = raw(table["line_text"])
    chars, at = code_points(data, at)
    a, b = block_pairs(chars, at[:-1], np.diff(at), edits, table["block"].to_numpy())
    doc, number = table["first_doc"].to_numpy(), table["first_number"].to_numpy()
    later = np.where((doc[b] < doc[a]) | ((doc[b] == doc[a]) & (number[b] < number[a])), a, b)
    differ = (doc[a] != doc[b]) | (number[a] != number[b])  # rows of one id may hold both at one place
    return pa.table({"line": pa.array(np.unique(table["line"].to_numpy()[later[differ]]))})


def _blocks_later(full: DataFrame, known: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """line: the later lines of pairs within the edits among lines of one key, in blocks."""
    least = full.groupBy("hot").agg(F.min("line").alias("b"))
    roots = components(full.join(small(kept(least)), "hot").select(F.col("line").alias("a"), "b"))
    # Lines of a component are near only if their lengths are.
    nodes = roots.join(known.withColumnRenamed("line", "node"), "node").select("node", "root", F.floor(F.col("length") / max(edits, 1)).alias("step"), F.lit(None).cast("long").alias("owner"), F.col("length").alias("weight"))
    blocks = kept(in_blocks(nodes, BLOCK, BLOCK_CHARS).withColumnRenamed("node", "line").join(known.select("line", "length"), "line"))
    # Blocks are piled up to fill a worker's arrays; a pile holds whole blocks.
    piles = max(1, (blocks.agg(F.sum("length")).first()[0] or 0) // PILE_CHARS)
    shipped = blocks.drop("length").join(texts, "line").withColumn("pile", F.pmod("block", F.lit(piles)))

    def later(table: pa.Table) -> pa.Table:
        found = _later(table, edits)
        trim()
        return found

    return shipped.groupBy("pile").applyInArrow(later, "line long")


def staying_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """doc_id and ``stay``: number and hash of its lines that take part and stay."""
    if min_chars <= 2 * edits:
        raise ValueError("lines must be longer than twice the edits")
    arrow_session(df.sparkSession)
    docs = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size // exchange.CHUNK_BYTES)
    place = F.struct(F.col("doc_id").alias("doc"), F.col("number").alias("number"))
    firsts = kept(_lines(docs, min_chars, exact_chars).groupBy("line").agg(F.min(place).alias("first"), F.first("length").alias("length")))

    limits = HOT_PAIRS, ALIKE, FEW

    def ties(table: pa.Table) -> pa.Table:
        found = _ties(table, edits, *limits)
        trim()
        return found

    def tied(keys: DataFrame) -> DataFrame:
        return kept(keys.groupBy("bucket").applyInArrow(ties, "a long, b long, hot long"))

    found = tied(_sent_keys(docs, buckets, edits, min_chars))
    wanted = found.select(F.explode(F.array("a", "b")).alias("line")).filter("line is not null").distinct()
    known = gathered(wanted.join(firsts, "line").select("line", "length", F.col("first.doc").alias("first_doc"), F.col("first.number").alias("first_number")))
    texts = kept(_texts(docs, known, min_chars).dropDuplicates(["line"]).join(known, "line"))
    pairs, full = [found.filter("hot is null").select("a", "b")], found.filter("hot is not null").select("hot", F.col("a").alias("line"))
    work = None
    while True:
        # Pairs that a key's lines could make, at most; dividing goes on while it halves them.
        before, work = work, full.groupBy("hot").count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0] or 0.0
        if not work or (before is not None and work > before / 2):
            break
        held = kept(full.join(texts, "line").select("hot", "line", "length", "line_text"))
        size = held.agg(F.sum(F.octet_length("line_text"))).first()[0]
        found = tied(_divided_keys(held, max(1, size // exchange.CHUNK_BYTES), edits))
        pairs.append(found.filter("hot is null").select("a", "b"))
        full = found.filter("hot is not null").select("hot", F.col("a").alias("line"))
    place_of = F.struct("first_doc", "first_number")
    of = lambda side: texts.select(F.col("line").alias(side), F.col("line_text").alias(f"{side}_text"), place_of.alias(f"{side}_at"))
    both = reduce(DataFrame.unionByName, pairs).distinct().join(of("a"), "a").join(of("b"), "b").filter("a_at <> b_at")  # rows of one id may hold both at one place
    near = _pairs_later(both.select("a", "b", "a_text", "b_text", (F.col("a_at") > F.col("b_at")).alias("a_is_later")), edits)
    if work:
        near = near.unionByName(_blocks_later(full, known, texts, edits))
    near = near.distinct()
    stay = firsts.join(small(kept(near)), "line", "left_anti").select(F.col("first.doc").alias("doc_id"), F.struct(F.col("first.number").alias("number"), "line").alias("stay"))
    return stay.groupBy("doc_id").agg(F.sort_array(F.collect_list("stay")).alias("stay"))


def _staying(x: Lines, stay: pa.Array) -> np.ndarray:
    """Whether each line that takes part is on its row's list."""
    flat = stay.flatten()
    row = np.repeat(np.arange(len(stay)), stay.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    number, line = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
    listed, own = row * 2**40 + number, x.row * 2**40 + x.number
    ok, at = np.zeros(len(own), bool), np.searchsorted(listed, own)
    while True:  # rows of one id may have several lines of one number
        inside = np.flatnonzero(at < len(listed))
        inside = inside[listed[at[inside]] == own[inside]]
        if not len(inside):
            return ok
        ok[inside] |= line[at[inside]] == x.line[inside]
        at[inside] += 1


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, report: bool = False, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """``df`` without its repeated lines; with ``report`` n_lines and n_removed are
    appended, in place of columns of these names."""
    own_id, own_stay = spare(df, "_id", "_stay")
    stay = staying_lines(df, doc_id, text, edits, min_chars, exact_chars).select(F.col("doc_id").alias(own_id), F.col("stay").alias(own_stay))
    counts = ["n_lines", "n_removed"] if report else []
    carried = [c for c in df.columns if c.lower() not in counts]
    keyed = df.withColumn(own_id, F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)))
    joined = keyed.join(stay, own_id, "left")
    schema = T.StructType([*(df.schema[c] for c in carried), *(T.StructField(c, T.LongType()) for c in counts)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                x = lines_of(column, min_chars, exact_chars)
                start, end, row, number = split_lines(*raw(column))
                gone = ~_staying(x, part.column(own_stay))
                left = np.ones(len(start), bool)
                left[np.searchsorted(row, x.row[gone]) + x.number[gone]] = False
                n_lines, n_left = (np.bincount(r, minlength=len(column)) for r in (row, row[left]))
                null = column.is_null().to_numpy(zero_copy_only=False)
                new = joined_spans(x.data, start[left], end[left], n_left, 10)
                columns = [pc.if_else(pa.array(null), pa.scalar(None, pa.string()), new) if c == text else part.column(c) for c in carried]
                if report:
                    columns += [pa.array(np.where(null, 0, n_lines)), pa.array(n_lines - n_left)]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, *counts])
        release()

    return joined.select(*carried, own_stay).mapInArrow(run, schema)


def lines_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of each document."""
    left = dedup_lines(df.select("doc_id", "text"), report=True)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
