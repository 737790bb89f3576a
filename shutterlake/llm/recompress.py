"""Substring dedup by recompression.

Words of all documents are recompressed in rounds: the first names runs of one word (in
later ones a look at both neighbours would widen what symbols depend on), and each names
pairs of a left and a right symbol, the side being a bit of the symbol's name. Symbols of
GROWN words or more rest. A name is a fingerprint of what it stands for, so the same runs
and pairs get the same name in every document, and equal substrings get the same symbols
but near their borders. Each symbol keeps the words that its forming depended on, so that
it is known which windows imply it.

1. Spark counts the names of all documents (exchange.py). A window that implies a symbol
   which stands nowhere else can't be a repeat.
2. What is left of the windows, the insides of long repeats, is named by the symbols that it
   implies and the words between them. A chunk keeps the first of each of its windows of one
   name and sends the name, with 32 bits of a second hash of the words, to the buckets, where
   the earliest document and start wins; the others are answered as repeats.
3. Words that repeats cover are removed from their documents.

Edge cases: a null text has no words; windows never cross documents; a text shorter than
a window keeps everything; documents order by id, a null id first; rows with equal ids
and starts are equally early and don't remove each other's words; an empty table gives an
empty result; further columns take no part and are not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm import exchange
from shutterlake.llm.text_arrays import gram_hashes, hash_spans, joined_spans, mix, raw, words

WINDOW = 20
ROUNDS, RUN_ROUNDS, GROWN, SENT_WORDS = 6, 1, 4, 3
NULL_ID = -(2**63)


def symbols(names: np.ndarray, offsets: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """name, start, end, low, high of the symbols that the words of each row become: words
    start..end are the symbol's, and low..high are those that its forming depended on."""
    rows = len(offsets) - 1
    start = np.arange(len(names))
    end = start + 1
    low, high = start.copy(), end.copy()
    row = np.repeat(np.arange(rows), np.diff(offsets))

    def neighbours() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        same = np.zeros(len(names) + 1, bool)
        same[1:-1] = row[1:] == row[:-1]
        # Reaching for a neighbour beyond the row's border depends on the border itself.
        left = np.where(same[:-1], np.roll(low, 1), start - 1)
        right = np.where(same[1:], np.roll(high, -1), end + 1)
        return same, left, right

    def put(first: np.ndarray, name: np.ndarray) -> None:
        nonlocal names, start, end, low, high, row
        names, start, row = name, start[first], row[first]
        end = np.append(start[1:], end[-1])
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)

    for k in range(rounds):
        if not len(names):
            break
        rests = end - start >= GROWN
        if k < RUN_ROUNDS:
            # Runs of one symbol.
            same, left, right = neighbours()
            equal = np.zeros(len(names) + 1, bool)
            equal[1:-1] = same[1:-1] & (names[1:] == names[:-1]) & ~rests[1:]
            low, high = np.where(rests | equal[:-1], low, np.minimum(low, left)), np.where(rests | equal[1:], high, np.maximum(high, right))
            first = np.flatnonzero(~equal[:-1])
            length = np.diff(np.append(first, len(names))).astype(np.uint64)
            put(first, np.where(length > 1, mix(names[first] * np.uint64(0xC2B2AE3D27D4EB4F) + length), names[first]))
        # Pairs of a left and a right symbol.
        rests = end - start >= GROWN
        side = mix(names ^ np.uint64(k + 1)) & np.uint64(1)
        lefts, rights = (side == 0) & ~rests, (side == 1) & ~rests
        same, left, right = neighbours()
        pair = np.zeros(len(names) + 1, bool)
        pair[1:-1] = same[1:-1] & lefts[:-1] & rights[1:]
        high = np.where(lefts & ~pair[1:], np.maximum(high, right), high)
        low = np.where(rights & ~pair[:-1], np.minimum(low, left), low)
        first = np.flatnonzero(~pair[:-1])
        name = names[first]
        two = np.flatnonzero(pair[1:][first])
        name[two] = mix(mix(names[first[two]]) * np.uint64(0x9FB21C651E98DF25) + names[first[two] + 1])
        put(first, name)
    return names, start, end, low, high


def _hashes(column: pa.Array) -> tuple:
    data, at = raw(column)
    starts, ends, of = words(data, at)
    return data, at, starts, ends, of, hash_spans(data, starts, ends)


def _sendable(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    return (end - start >= SENT_WORDS) & (high - low <= window)


def candidates(name: np.ndarray, low: np.ndarray, high: np.ndarray, lone: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    """Starts of whole windows that imply no lone symbol."""
    n = len(whole)
    # A lone symbol rules out the starts from high - window to low.
    a, b = np.maximum(high[lone] - window, 0), np.minimum(low[lone], n - 1) + 1
    ok = a < b
    edge = np.bincount(a[ok], minlength=n + 1) - np.bincount(b[ok], minlength=n + 1)
    return np.flatnonzero(whole & (np.cumsum(edge)[:n] == 0))


_PLACES = mix(np.arange(1, 1 << 12, dtype=np.uint64)) | np.uint64(1)


def window_names(table: tuple[np.ndarray, ...], word: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A name for the window at each start, put together from the symbols that the window
    implies and the words between them. Equal windows imply the same symbols at the same
    places, so they have the same name."""
    name, start, end, low, high = table
    symbol = np.full(len(word), -1)
    symbol[start] = np.arange(len(start))
    inside = mix(name ^ np.uint64(0xD1B54A32D192ED03))
    total, until = np.zeros(len(at), np.uint64), at.copy()
    for k in range(window):
        place = at + k
        own = symbol[place]
        free = place >= until
        implied = free & (own >= 0) & (low[own] >= at) & (high[own] <= at + window)
        total += np.where(free, np.where(implied, inside[own], word[place]), np.uint64(0)) * _PLACES[k]
        until = np.where(implied, end[own], until)
    return mix(total)


def _ordered(table: pa.Table) -> pa.Table:
    """A chunk's rows by id, then by text, so that every pass numbers them alike."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table


_SPANS = "bucket long, chunk long, hash binary, more binary, doc binary, row binary, start binary"
_SPAN_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("hash", "more", "doc", "row", "start")]])


def _first_windows(table: pa.Table, answers: pa.Table, buckets: int, chunks: int, window: int) -> pa.Table:
    """The chunk's first window of each content, for the buckets; repeats within the chunk
    travel as spans (without a hash) that a bucket passes on."""
    if not table.num_rows:
        return _SPAN_SCHEMA.empty_table()
    chunk = table["chunk"][0].as_py()
    table = _ordered(table)
    data, _, starts, ends, of, h = _hashes(table["text"])
    table_of = symbols(h, of)
    name, start, end, low, high = table_of
    use = _sendable(start, end, low, high, window)
    name, low, high = name[use], low[use], high[use]
    other, whole = gram_hashes(hash_spans(data, starts, ends, 1), of, window)
    at = candidates(name, low, high, exchange.counts_of(name, answers, buckets) == 1, whole, window)
    more = other[at] & np.uint64(0xFFFFFFFF)
    row = np.repeat(np.arange(len(of) - 1), np.diff(of))[at]
    doc = table["doc_id"].fill_null(NULL_ID).to_numpy()[row]
    where, hashed = at - of[row], window_names(table_of, h, at, window)
    order = np.lexsort((where, doc, more, hashed))
    row, doc, where, hashed, more = row[order], doc[order], where[order], hashed[order], more[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (more[1:] != more[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.empty(0, np.int64)
    later = (doc > doc[lead]) | (where > where[lead])
    rows = []
    first = np.flatnonzero(~later)  # rows of one id that stand at one place go together
    bucket = hashed[first] % np.uint64(chunks)
    order = np.argsort(bucket, kind="stable")
    first, bucket = first[order], bucket[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.empty(0, np.int64)
    for i, j in zip(cuts, [*cuts[1:], len(bucket)]):
        f = first[i:j]
        rows.append((int(bucket[i]), chunk, planes8(hashed[f]), exchange.planes(more[f], 4), planes8(doc[f].view(np.uint64)), exchange.planes(row[f], 4), exchange.planes(where[f], 4)))
    own = np.flatnonzero(later)
    if len(own):
        rows.append((chunk % chunks, chunk, None, None, None, exchange.planes(row[own], 4), exchange.planes(where[own], 4)))
    return exchange.rows_table(rows, _SPAN_SCHEMA)


def planes8(values: np.ndarray) -> bytes:
    return exchange.planes(values, 8)


_REPEATS = pa.schema([("chunk", pa.int64()), ("row", pa.binary()), ("start", pa.binary())])


def _repeats(table: pa.Table) -> pa.Table:
    """For one bucket: the windows that start earlier in another chunk."""
    rows = table.to_pylist()
    out = [(r["chunk"], r["row"], r["start"]) for r in rows if r["hash"] is None]
    sent = [r for r in rows if r["hash"] is not None]
    if sent:
        hashed, doc = (np.concatenate([exchange.joined(r[c], 8) for r in sent]) for c in ("hash", "doc"))
        more, row, start = (np.concatenate([exchange.joined(r[c], 4) for r in sent]) for c in ("more", "row", "start"))
        doc = doc.view(np.int64)
        source = np.repeat(np.arange(len(sent)), [len(r["row"]) // 4 for r in sent])
        order = np.lexsort((start, doc, more, hashed))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(hashed[order]) != 0) | (np.diff(more[order]) != 0)
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.zeros(len(order), bool)
        later[order] = (doc[order] > doc[lead]) | (start[order] > start[lead])
        found = np.flatnonzero(later)
        cuts = np.flatnonzero(np.diff(source[found], prepend=-1)) if len(found) else found
        for i, j in zip(cuts, [*cuts[1:], len(found)]):
            own = found[i:j]
            out.append((sent[source[own[0]]]["chunk"], exchange.planes(row[own], 4), exchange.planes(start[own], 4)))
    return exchange.rows_table(out, _REPEATS)


_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _without(table: pa.Table, repeats: pa.Table, window: int) -> pa.Table:
    """The chunk's documents without the words that repeats cover."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    if not table.num_rows:
        return schema.empty_table()
    table = _ordered(table)
    data, at = raw(table["text"])
    starts, ends, of = words(data, at)
    edge = np.zeros(len(starts) + 1, np.int64)
    for r in repeats.to_pylist():
        row, start = (exchange.joined(r[c], 4).astype(np.int64) for c in ("row", "start"))
        np.add.at(edge, of[row] + start, 1)
        np.add.at(edge, of[row] + start + window, -1)
    stay = np.cumsum(edge)[:-1] == 0
    n_kept = np.diff(np.concatenate([[0], np.cumsum(stay)])[of])
    kept = joined_spans(data, starts[stay], ends[stay], n_kept, 32)
    n_words = np.diff(of)
    return pa.Table.from_arrays([table["doc_id"].combine_chunks(), pa.array(n_words), pa.array(n_words - n_kept), kept], schema=schema)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words that stay joined by spaces."""
    if not 0 < window < len(_PLACES):
        raise ValueError("windows have 1 to 4,094 words")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunked, chunks = exchange.in_chunks(docs, "text", "doc_id")
    buckets = exchange.buckets_for(chunks)

    def tokens(table: pa.Table) -> np.ndarray:
        *_, of, h = _hashes(table["text"])
        name, start, end, low, high = symbols(h, of)
        return name[_sendable(start, end, low, high, window)]

    def first_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _first_windows(table, answers, buckets, chunks, window)

    def without(table: pa.Table, repeats: pa.Table) -> pa.Table:
        return _without(table, repeats, window)

    answers = exchange.shared_tokens(chunked, tokens, buckets)
    groups = chunked.groupBy("chunk")
    sent = groups.cogroup(answers.groupBy("chunk")).applyInArrow(first_windows, _SPANS)
    repeats = sent.groupBy("bucket").applyInArrow(_repeats, "chunk long, row binary, start binary")
    return groups.cogroup(repeats.groupBy("chunk")).applyInArrow(without, _KEPT)


def repeats_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    return remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
