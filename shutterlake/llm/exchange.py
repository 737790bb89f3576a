"""Counting tokens of all documents, with the documents kept in place.

Documents fall into chunks by a hash of the row, small enough for one worker. Each chunk
sends its distinct tokens to token buckets; each bucket answers each chunk with those of
its tokens that occur elsewhere too, with their counts. Both ways carry packed arrays:
one row for each (chunk, bucket), whose entries are 40 bits of a token's hash beside the
bits that name the bucket. Hash clashes can only make a count too large, and callers
verify what they find. A token that all chunks share is one entry of each, so hot tokens
don't gather.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.text_arrays import arrow_session, trim

#: Text of a chunk, and of the chunks whose tokens one bucket could hold: a (chunk, bucket)
#: row holds about CHUNK_BYTES * BUCKET_BYTES / input of them. Both grow with the executors.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
REST = np.uint64((1 << 40) - 1)

SENT = "bucket long, chunk long, rest binary, n binary"
ANSWER = "chunk long, bucket long, rest binary, n binary"


def in_chunks(df: DataFrame, text: str, *keys: str) -> tuple[DataFrame, int]:
    """The keys and text with the row's ``chunk``, and the number of chunks."""
    arrow_session(df.sparkSession)
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    key = F.pmod(F.xxhash64(*keys, text), F.lit(chunks))
    return df.select(key.alias("chunk"), *keys, F.col(text).alias("text")), chunks


def buckets_for(chunks: int) -> int:
    return max(1, chunks * CHUNK_BYTES // BUCKET_BYTES)


def planes(values: np.ndarray, width: int = 5) -> bytes:
    """The low bytes of integers, byte by byte, so that compression finds equal bytes together."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def joined(data: bytes, width: int = 5) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def place(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and rest of each token hash as one integer."""
    b = np.uint64(buckets)
    return (tokens % b) << np.uint64(40) | (tokens // b & REST)


def by_bucket(places: np.ndarray):
    """(bucket, from, to) of sorted places."""
    own = (places >> np.uint64(40)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(own, prepend=-1)) if len(own) else np.empty(0, np.int64)
    return zip(own[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(own)])


def send(tokens: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """Rows of SENT for the tokens (repeats count) of one chunk."""
    places, n = np.unique(place(tokens, buckets), return_counts=True)
    n = np.minimum(n, 65535)
    rows = [(b, chunk, planes(places[i:j] & REST), planes(n[i:j], 2)) for b, i, j in by_bucket(places)]
    return rows_table(rows, pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("rest", pa.binary()), ("n", pa.binary())]))


def rows_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def answer(table: pa.Table) -> pa.Table:
    """For one bucket: each chunk's tokens whose count over all chunks is 2 or more."""
    chunk, bucket = table["chunk"].to_pylist(), table["bucket"].to_pylist()
    size = [len(x) // 5 for x in table["rest"].to_pylist()]
    rest = np.concatenate([joined(x) for x in table["rest"].to_pylist()])
    order = np.argsort(rest)
    rest = rest[order]
    first = np.flatnonzero(np.concatenate([rest[:1] == rest[:1], rest[1:] != rest[:-1]]))
    del rest  # a bucket's tokens are held once or twice at a time, not eight times
    n = np.concatenate([joined(x, 2).astype(np.uint16) for x in table["n"].to_pylist()])
    sums = np.minimum(np.add.reduceat(n[order], first, dtype=np.int64), 65535).astype(np.uint16) if len(first) else n
    n[order] = np.repeat(sums, np.diff(first, append=len(order)))
    del order
    rows, at = [], 0
    for c, b, k, sent in zip(chunk, bucket, size, table["rest"].to_pylist()):
        count = n[at : at + k]
        at += k
        shared = count > 1
        if shared.any():
            rows.append((c, b, planes(joined(sent)[shared]), planes(count[shared], 2)))
    return rows_table(rows, pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("rest", pa.binary()), ("n", pa.binary())]))


def shared_tokens(chunked: DataFrame, tokens, buckets: int) -> DataFrame:
    """Rows of ANSWER; ``tokens`` gives the token hashes of a chunk's table."""

    def emit(table: pa.Table) -> pa.Table:
        sent = send(tokens(table), table["chunk"][0].as_py(), buckets)
        trim()
        return sent

    def answers(table: pa.Table) -> pa.Table:
        found = answer(table)
        trim()
        return found

    return chunked.groupBy("chunk").applyInArrow(emit, SENT).groupBy("bucket").applyInArrow(answers, ANSWER)


def counts_of(tokens: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """Count of each token over all chunks (1: in no answer)."""
    rows = answers.to_pylist()
    out = np.ones(len(tokens), np.int64)
    if not rows or not len(tokens):
        return out
    known = np.concatenate([joined(r["rest"]) | np.uint64(r["bucket"]) << np.uint64(40) for r in rows])
    n = np.concatenate([joined(r["n"], 2) for r in rows]).astype(np.int64)
    order = np.argsort(known)
    known, n = known[order], n[order]
    own = place(tokens, buckets)
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    hit = known[at] == own
    out[hit] = n[at[hit]]
    return out
