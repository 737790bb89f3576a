"""Schemas of the stored tables. Times in nanoseconds are BIGINT: timestamps would lose digits."""

from __future__ import annotations

from pyspark.sql import types as T

LISTING = "folder string, name string, is_file boolean, size bigint, mtime_ns bigint"
CATALOG = "folder string, file_name string, path string, owner string, size bigint, mtime_ns bigint"
IMAGES = (
    "path string, size bigint, mtime_ns bigint, rating smallint, sidecar_mtime_ns bigint, "
    "sidecar_dirty boolean, sidecar_quarantined boolean, sidecar_owner string"
)
IMAGE_REVISIONS = "path string, revision bigint"
OWNER_REVISIONS = "owner string, revision bigint, global_revision bigint"
QUARANTINE = IMAGES + ", quarantined_at timestamp"
COMMANDS = "seq bigint, ts timestamp, owner string, path string, size bigint, mtime_ns bigint, rating smallint"
PIXELS = "width int, height int, rgba binary"

RATIONAL = T.StructType([T.StructField("n", T.LongType()), T.StructField("d", T.LongType())])
CAPTURE = T.StructType([T.StructField("local", T.TimestampNTZType()), T.StructField("subsecond", T.StringType()), T.StructField("offset_seconds", T.IntegerType())])

STAGE_REPORT = T.StructType([T.StructField("name", T.StringType()), T.StructField("ms", T.DoubleType())])
DEVELOP_RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("variant", "input_sha256", "output_sha256")]
    + [T.StructField("schema_version", T.IntegerType()), T.StructField("total_ms", T.DoubleType()), T.StructField("stages", T.ArrayType(STAGE_REPORT))]
)
