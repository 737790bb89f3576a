"""Sources and sinks of the catalogue: listings, sidecars, records and state snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake import schemas
from shutterlake.functions.paths import is_raw_name, sidecar_owner
from shutterlake.functions.xmp import xmp_new_sidecar, xmp_parse_rating, xmp_update_rating
from shutterlake.sources.files import contents, list_files


def catalog_from_listing(listing: DataFrame) -> DataFrame:
    """Photos of a listing (folder, name, is_file, size, mtime_ns): regular files of a known
    extension that aren't hidden. Times beyond 64 bits or missing are 0, which fits nothing."""
    return listing.filter(F.col("is_file") & is_raw_name(F.col("name"))).withColumn("mtime_ns", F.coalesce("mtime_ns", F.lit(0).cast("bigint")))


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Photos below ``root`` from the file system: folder, file_name, path, size, mtime_ns.
    Contents aren't read. Tasks list the folders; those whose names begin with ``.`` or ``_`` are
    left out. Times are whole milliseconds; a listing table keeps more."""
    found = list_files(spark, root).filter(is_raw_name(F.col("name")))
    return found.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.col("name").alias("file_name"), "path", "size", "mtime_ns")


def order_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("folder", "file_name")


def with_owner(catalog: DataFrame, folder_ignores_case: Column | None = None) -> DataFrame:
    return catalog.withColumn("owner", sidecar_owner(F.col("path"), F.lit(False) if folder_ignores_case is None else folder_ignores_case))


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """owner, sidecar_mtime_ns, rating of the sidecars below ``root``; what isn't UTF-8 or
    not well formed has no rating."""
    files = contents(list_files(spark, root).filter(F.col("name").rlike("[.][xX][mM][pP]$") & ~F.col("name").startswith(".")), root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.col("path").alias("owner"), F.col("mtime_ns").alias("sidecar_mtime_ns"), xmp_parse_rating(text).alias("rating"))


def sidecar_ratings(sidecars: DataFrame) -> DataFrame:
    """The same from a table with the documents in ``xml``."""
    return sidecars.withColumn("rating", xmp_parse_rating(F.col("xml")))


def sidecar_documents(due: DataFrame) -> DataFrame:
    """owner, xml, status for rows of owner, xml (null: no file) and rating: ``new``,
    ``updated``, or ``failed`` with the reason in ``error`` and nothing to write."""
    done = xmp_update_rating(F.col("xml"), F.col("rating"))
    out = due.select("owner", F.col("xml").isNull().alias("_new"), done.alias("d"))
    status = F.when(F.col("d.error").isNotNull(), "failed").when(F.col("_new"), "new").otherwise("updated")
    return out.select("owner", F.col("d.xml").alias("xml"), status.alias("status"), F.col("d.error").alias("error"))


def write_sidecars(due: DataFrame, path: str) -> None:
    """Publishes the documents as a table; a later step copies them beside the photos."""
    sidecar_documents(due).write.mode("overwrite").parquet(path)


def verify_content_hash(files: DataFrame, expected: DataFrame) -> DataFrame:
    """path, ok: whether the content's SHA-256 is the expected digest, in either case."""
    return files.join(expected, "path").select("path", (F.sha2("content", 256) == F.lower("sha256")).alias("ok"))


def read_develop_records(spark: SparkSession, path: str, schema: T.StructType = schemas.DEVELOP_RECORD) -> DataFrame:
    """One JSON object for each benchmark run; only records of the first schema."""
    return spark.read.schema(schema).json(path).filter("schema_version = 1")


def write_state(frames: dict[str, DataFrame], root: str) -> str:
    """Stores a snapshot of the state tables in a new folder and returns it; whoever
    publishes the folder's name swaps the state at once."""
    folder = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}")
    return folder


def read_state(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
