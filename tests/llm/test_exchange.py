"""The answer of one token bucket: its counts, and the memory that it takes."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from shutterlake.llm import exchange

SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("rest", pa.binary()), ("n", pa.binary())])


def sent(chunks: list[list[int]], counts: list[list[int]]) -> pa.Table:
    rows = [(3, c, exchange.planes(np.array(t, np.uint64)), exchange.planes(np.array(n, np.uint64), 2)) for c, (t, n) in enumerate(zip(chunks, counts))]
    return exchange.rows_table(rows, SENT)


def test_answers():
    rng = np.random.default_rng(7)
    chunks = [sorted(rng.choice(400, rng.integers(0, 90), replace=False).tolist()) for _ in range(20)]
    counts = [rng.choice([1, 1, 2, 60_000], len(t)).tolist() for t in chunks]
    total = Counter()
    for t, n in zip(chunks, counts):
        for x, k in zip(t, n):
            total[x] += k
    got = {r["chunk"]: (r["bucket"], exchange.joined(r["rest"]).tolist(), exchange.joined(r["n"], 2).tolist()) for r in exchange.answer(sent(chunks, counts)).to_pylist()}
    want = {c: (3, own, [min(total[x], 65535) for x in own]) for c, t in enumerate(chunks) if (own := [x for x in t if total[x] > 1])}
    assert got == want
    assert exchange.answer(sent([[]], [[]])).num_rows == 0


def test_answer_memory():
    """Two buckets are answered beside an executor's heap."""
    rng = np.random.default_rng(8)
    chunks = [np.unique(rng.integers(0, 1 << 40, 50_000)).tolist() for _ in range(8)]
    table = sent(chunks, [[1] * len(t) for t in chunks])
    tracemalloc.start()
    exchange.answer(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * sum(map(len, chunks))
