"""Many small files: written by tasks, found again through a manifest or by listing.

File systems are those of PyArrow (local and shared mounts, S3, GCS, HDFS), opened in the
task that writes, lists or reads; the driver neither lists nor opens files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.xmp import xmp_parse_rating
from shutterlake.shared import stored

MANIFEST = "name string, file string, bytes bigint, sha256 string"
LISTED = "path string, name string, is_file boolean, size bigint, mtime_ns bigint"
#: Tasks that list the folders of one depth, and rows of a batch of what they find.
LISTERS, LISTED_ROWS = 10_000, 10_000


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path on it."""
    return fs.FileSystem.from_uri(root)


def qualified(spark: SparkSession, root: str) -> str:
    """The root with its file system, as Spark names files: ``file:/photos`` for a local path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def placed(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified root, and the path on it."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    store, base = opened(root.replace("s3a:", "s3:", 1) if root.startswith("s3a:") else root)
    return store, base.rstrip("/")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name, size, mtime_ns (whole milliseconds) of every file below ``root``. Folders whose
    names begin with ``.`` or ``_`` are left out. Tasks list the folders, one depth after the
    other; the driver sees how many there are."""
    top = qualified(spark, root)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = placed(top)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = store.get_file_info(fs.FileSelector(base + folder[len(top) :]))
                for i in range(0, len(found), LISTED_ROWS):
                    part = found[i : i + LISTED_ROWS]
                    columns = [f"{folder}/{f.base_name}" for f in part], [f.base_name for f in part], [f.is_file for f in part], [f.size for f in part], [None if f.mtime_ns is None else f.mtime_ns // 1_000_000 * 1_000_000 for f in part]
                    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "name", "is_file", "size", "mtime_ns"])

    depths, folders, n = [], spark.createDataFrame([(top,)], "path string"), 1
    while n:
        depths.append(stored(folders.repartition(min(n, LISTERS), "path").mapInArrow(listed, LISTED)))
        folders = depths[-1].filter(~F.col("is_file") & ~F.col("name").rlike("^[._]")).select("path")
        n = folders.count()
    every = depths[0]
    for depth in depths[1:]:
        every = every.union(depth)
    return every.filter("is_file").drop("is_file")


def contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` (of ``list_files``) with the content of each; null if it is gone."""
    top = qualified(files.sparkSession, root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = placed(top)
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with store.open_input_stream(base + path[len(top) :]) as found:
                        content = found.read()
                except FileNotFoundError:
                    content = None
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], names=[*batch.schema.names, "content"])

    spread = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(read, "path string, name string, size bigint, mtime_ns bigint, content binary")


def write_files(frame: DataFrame, root: str, extension: str) -> DataFrame:
    """Writes each row of ``name`` and ``content`` (binary) as a file below ``root`` and returns
    the manifest, which is stored under ``root``/manifest: name, file, bytes, sha256.

    Files lie in 256 folders by the digest of their name, whatever the names are, so no folder
    holds them all. A file is written aside and moved into place, so a task that runs again, or
    twice at once, leaves whole files; names should be distinct."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                key = hashlib.sha256(name.encode()).hexdigest()
                file = f"files/{key[:2]}/{key}.{extension}"
                aside = f"{base}/files/{key[:2]}/.{key}-{uuid.uuid4().hex}.tmp"
                store.create_dir(f"{base}/files/{key[:2]}", recursive=True)
                with store.open_output_stream(aside) as out:
                    out.write(content)
                store.move(aside, f"{base}/{file}")
                rows.append((name, file, len(content), hashlib.sha256(content).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["name", "file", "bytes", "sha256"])

    named = frame.filter("name IS NOT NULL AND content IS NOT NULL").select("name", F.col("content").cast("binary").alias("content"))
    named.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{root}/manifest")
    return frame.sparkSession.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """name, content, ok of the files that the manifest names; ok: content has its digest. A
    missing file has null content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            for name, file, digest in zip(*(batch.column(c).to_pylist() for c in ("name", "file", "sha256"))):
                try:
                    with store.open_input_stream(f"{base}/{file}") as found:
                        content = found.read()
                except FileNotFoundError:
                    content = None
                ok = content is not None and hashlib.sha256(content).hexdigest() == digest
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([ok])], names=["name", "content", "ok"])

    listed = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    # A partition for each core at least: opening a file takes longer than reading its row.
    spread = listed.repartition(max(1, spark.sparkContext.defaultParallelism), "file")
    return spread.mapInArrow(read, "name string, content binary, ok boolean")


def publish_sidecars(documents: DataFrame, root: str) -> DataFrame:
    """Writes documents (owner, xml; null: nothing to write) as XMP files; the manifest."""
    return write_files(documents.select(F.col("owner").alias("name"), F.encode("xml", "UTF-8").alias("content")), root, "xmp")


def published_ratings(spark: SparkSession, root: str) -> DataFrame:
    """owner, rating of published sidecars; damaged files have no rating."""
    text = F.when(F.col("ok"), F.try_validate_utf8(F.col("content").cast("string")))
    return read_files(spark, root).select(F.col("name").alias("owner"), xmp_parse_rating(text).alias("rating"))
