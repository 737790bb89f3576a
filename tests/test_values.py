"""Queries on values that the given tables hold rarely or not at all."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shutterlake.queries import QUERIES, SQL
from shutterlake.sources import catalog as sources

PIXELS = ("a10_image_error_metrics", "a11_neighbor_delta_mae", "x1_levels", "x2_superpixels", "x3_calibrate", "x4_pack_rgba", "x5_rotate", "x6_downscale", "x7_validate_pixels", "x8_develop_crop")


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Embeddings of the floats around each limit between two pixel values, and of some beyond all limits."""
    near = [(np.arange(256) / 127.5 - 1).astype(np.float32)]
    for _ in range(2):
        near = [np.nextafter(near[0], np.float32(-9)), *near, np.nextafter(near[-1], np.float32(9))]
    values = np.concatenate([*near, np.full(64, np.nan, np.float32), np.tile(np.array([np.inf, -np.inf, 1e30, -3], np.float32), 16)])
    values = np.concatenate([values, np.random.default_rng(5).permutation(values)]).reshape(-1, 64)
    folder = tmp_path_factory.mktemp("edges")
    table = pa.table({"vec_id": pa.array(range(len(values)), pa.int64()), "embedding": pa.array(values.tolist(), pa.list_(pa.float32()))})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", PIXELS)
def test_pixel_limits(spark, edges, name):
    frame = QUERIES[name](spark, edges)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{edges}/embeddings.parquet'")
    want = con.execute(f"select {', '.join(frame.columns)} from ({SQL[name]}) q order by vec_id").fetchall()
    assert [tuple(r) for r in frame.orderBy("vec_id").collect()] == want


def test_places_of_many_photos(spark, tmp_path):
    """Far more photos than Spark draws to cut its ranges."""
    pq.write_table(pa.table({"doc_id": range(60_000), "n_chars": range(60_000)}), f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = con.execute(f"select folder, file_name, place from ({SQL['t1_order_catalog']}) q order by place").fetchall()
    off = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.exchange.reuse")
    for name in off:  # either may hide that ranges were drawn twice
        spark.conf.set(name, "false")
    try:
        got = QUERIES["t1_order_catalog"](spark, str(tmp_path)).collect()
    finally:
        for name in off:
            spark.conf.unset(name)
    assert sorted(map(tuple, got), key=lambda r: r[2]) == want


def test_listing_by_tasks(spark, tmp_path):
    """The driver gets no row for a file: nothing of its size is sent to it. Names need no escape."""
    for k in range(40):
        (tmp_path / f"d {k}" / "a%20b").mkdir(parents=True)
        for n in ("_x.ARW", "ü#1.dng", ".h.arw", "y.jpg"):
            (tmp_path / f"d {k}" / "a%20b" / n).write_bytes(b"abc" * k)
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "z.arw").write_bytes(b"abc")
    (tmp_path / "d 1" / "n.xmp").write_bytes(b"\xff")
    out = sources.scan_catalog(spark, str(tmp_path))
    assert sorted((r["path"], r["folder"], r["file_name"], r["size"]) for r in out.collect()) == sorted((f"file:{tmp_path}/d {k}/a%20b/{n}", f"file:{tmp_path}/d {k}/a%20b", n, 3 * k) for k in range(40) for n in ("_x.ARW", "ü#1.dng"))
    assert not any(str(tmp_path) in f for f in out.inputFiles())  # no index of the photos on the driver
    found = sources.read_sidecars(spark, str(tmp_path))
    assert [(r["owner"], r["rating"]) for r in found.collect()] == [(f"file:{tmp_path}/d 1/n.xmp", None)]


def compared(spark, folder, name, ids, values):
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32()))})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    frame = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.execute(f"select {', '.join(frame.columns)} from ({SQL[name]}) q").fetchall()
    key = lambda r: (r[0] is None, r[0] or 0)
    return sorted(map(tuple, frame.collect()), key=key), sorted(want, key=key)


@pytest.mark.parametrize("name", ("x2_superpixels", "x3_calibrate", "x4_pack_rgba", "x8_develop_crop"))
def test_pixels_of_odd_ids(spark, tmp_path, name):
    """Without an id the SQL takes the last pattern; of negative ids it has a pattern where 4 divides them."""
    got, want = compared(spark, tmp_path, name, [None, 7, -4, 2**40 + 1], np.random.default_rng(7).normal(0, 0.3, (4, 64)).tolist())
    assert got == want
    ids = [-1, -2, -3]
    rows, _ = compared(spark, tmp_path, name, ids, np.random.default_rng(8).normal(0, 0.3, (3, 64)).tolist())
    same, _ = compared(spark, tmp_path, name, [i + 4 for i in ids], np.random.default_rng(8).normal(0, 0.3, (3, 64)).tolist())
    assert [r[1:] for r in rows] == [r[1:] for r in same]


def test_turned_null_image(spark, tmp_path):
    values = [None, *np.random.default_rng(9).normal(0, 0.3, (2, 64)).tolist()]
    got, want = compared(spark, tmp_path, "x5_rotate", [0, 1, 2], values)
    assert got == want and got[0] == (0, None)


def test_shrunk_ties(spark, tmp_path):
    """Values halfway between two, which the SQL rounds up."""
    weights, rng = np.array([[111, 111, 29, -9], [-9, 29, 111, 111]]), np.random.default_rng(3)
    image = rng.integers(0, 256, (60_000, 4, 4, 4))
    tie = (np.einsum("ri,cj,nijk->nrck", weights, weights, image) % 58_564 == 29_282).any(axis=(1, 2, 3))
    assert tie.sum() >= 10
    values = ((image[tie].reshape(-1, 64) + 0.5) / 127.5 - 1).astype(np.float32)
    got, want = compared(spark, tmp_path, "x6_downscale", range(len(values)), values.tolist())
    assert got == want
