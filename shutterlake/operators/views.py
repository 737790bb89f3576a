"""Culling views: positions, neighbours, slices and star markers of visible photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions import exif, text

MAX_BUCKETS = 65_536


def folder_index(catalog: DataFrame) -> DataFrame:
    """Adds ``idx``, the photo's place in its folder by name."""
    return catalog.withColumn("idx", F.row_number().over(Window.partitionBy("folder").orderBy("file_name")) - 1)


def visible_positions(photos: DataFrame, *keep: str) -> DataFrame:
    """folder, idx, pos, and the columns of ``keep``, of the photos that are shown."""
    return photos.select("folder", "idx", *keep, (F.row_number().over(Window.partitionBy("folder").orderBy("idx")) - 1).alias("pos"))


def current_position(visible: DataFrame, current: DataFrame) -> DataFrame:
    """folder, current, pos, exact: where ``current`` (folder, current) stands: its own
    place, else the next visible photo's, the last one's at most."""
    joined = visible.join(current.select("folder", "current").distinct(), "folder").groupBy("folder", "current").agg(
        F.count(F.when(F.col("idx") < F.col("current"), 1)).alias("before"), F.count("*").alias("n"), F.max(F.col("idx") == F.col("current")).alias("exact")
    )
    return joined.select("folder", "current", F.least("before", F.col("n") - 1).cast("int").alias("pos"), "exact", F.col("n").cast("int").alias("n"))


def navigate(visible: DataFrame, current: DataFrame) -> DataFrame:
    """folder, current, target: ``delta`` steps from current, within the view. Forward from
    a photo that is filtered out the first step lands on the next visible photo itself."""
    at = current_position(visible, current).join(current, ["folder", "current"])
    start = F.col("pos") + F.col("delta") - F.when(~F.col("exact") & (F.col("delta") > 0), 1).otherwise(0)
    to = at.withColumn("pos", F.greatest(F.lit(0), F.least(start, F.col("n") - 1)).cast("int"))
    return to.join(visible, ["folder", "pos"]).select("folder", "current", "delta", F.col("idx").alias("target"))


def neighbors(visible: DataFrame, reach: int = 2) -> DataFrame:
    """Adds previous, next, and ``window``, the photos up to ``reach`` places away."""
    order = Window.partitionBy("folder").orderBy("pos")
    return visible.select(
        "*", F.lag("idx").over(order).alias("previous"), F.lead("idx").over(order).alias("next"), F.collect_list("idx").over(order.rowsBetween(-reach, reach)).alias("window")
    )


def pins(visible: DataFrame, tiers: tuple[str, ...] = ("thumb", "browse", "full")) -> DataFrame:
    """folder, pos, idx, tier to hold for the photo at each place: itself and its neighbours."""
    return neighbors(visible, 1).select("folder", "pos", F.explode("window").alias("idx")).select("*", F.explode(F.array(*map(F.lit, tiers))).alias("tier"))


def normalize_sequence(sequence: DataFrame, sizes: DataFrame) -> DataFrame:
    """folder, idx, pos: entries (folder, pos, idx) within the folder's size, each once at
    its first place, places closed up."""
    valid = sequence.join(sizes, "folder").filter("idx >= 0 and idx < len").groupBy("folder", "idx").agg(F.min("pos").alias("pos"))
    return valid.select("folder", "idx", (F.row_number().over(Window.partitionBy("folder").orderBy("pos")) - 1).alias("pos"))


def viewport_slice(visible: DataFrame, start: float, end: float, column: float, spacing: float, overscan: int = 0) -> DataFrame:
    """Cells that a viewport shows, with ``overscan`` more on both sides; a viewport beyond
    the end shows as many from the tail. Rows have folder, pos; sizes come from the data."""
    stride = column + spacing
    low, high = max(min(start, end), 0.0), max(start, end, 0.0)
    first, last = int(low // stride), -int(-high // stride)
    total = F.count("*").over(Window.partitionBy("folder"))
    beyond = F.lit(last) > total
    a = F.when(beyond, F.greatest(total - (last - first), F.lit(0))).otherwise(F.least(F.lit(first), total))
    b = F.when(beyond, total).otherwise(F.lit(last))
    cut = visible.withColumn("_a", a - overscan).withColumn("_b", F.least(b + overscan, total))
    return cut.filter((F.col("pos") >= F.col("_a")) & (F.col("pos") < F.col("_b"))).drop("_a", "_b")


def star_marker_buckets(stars: DataFrame, totals: DataFrame, track: float, pixels_per_point: float, column: float, spacing: float, left: float = 0.0) -> DataFrame:
    """folder, bucket, x, count, pos: starred places (folder, pos) of a strip of ``total``
    cells drawn on a track; a bucket is a pixel, its place the nearest to the centre."""
    last = min(max(int(-(-track * pixels_per_point // 1)) + 1, 1), MAX_BUCKETS) - 1
    stride = column + spacing
    width = F.col("total") * stride - spacing
    part = F.least(F.greatest((F.col("pos") * stride + column / 2) / width, F.lit(0.0)), F.lit(1.0))
    placed = stars.join(totals, "folder").filter("pos < total").withColumn("_f", part)
    bucket = F.round(F.col("_f") * last).cast("int") if last else F.lit(0)
    placed = placed.withColumn("bucket", bucket)
    x = F.lit(left) + (F.col("bucket") / last * track if last else F.lit(track / 2))
    near = placed.withColumn("x", x).withColumn("_d", F.abs(left + F.col("_f") * track - F.col("x")))
    return near.groupBy("folder", "bucket", "x").agg(F.count("*").alias("count"), F.min(F.struct("_d", "pos"))["pos"].alias("pos"))


def nearest_marker(buckets: DataFrame, pointer_x: float, radius: float) -> DataFrame:
    """folder, pos of the marker nearest to the pointer within the radius."""
    d = F.abs(F.col("x") - pointer_x)
    return buckets.filter(d <= radius).groupBy("folder").agg(F.min(F.struct(d.alias("d"), "pos"))["pos"].alias("pos"))


# ---- the information strip

FIELDS = ("file_name", "captured", "modified", "camera", "lens", "iso", "shutter", "aperture", "focal_length", "file_size")
#: Labels of a strip, by verbosity.
LABELS = {
    "none": {},
    "minimal": {"captured": "Shot", "modified": "Modified", "iso": "ISO"},
    "verbose": dict(zip(FIELDS, ("File", "Captured", "Modified", "Camera", "Lens", "ISO", "Shutter", "Aperture", "Focal", "Size"))),
}


def image_info(photos: DataFrame, fields: tuple[str, ...] = FIELDS, labels: str = "verbose") -> DataFrame:
    """Adds ``info``: (field, text) of the enabled fields that aren't blank, in order. The
    rows have file_name, size, mtime_ns, offset_seconds, and captured, camera, lens, iso,
    shutter, aperture, focal_mm from the metadata."""
    value = {
        "file_name": F.col("file_name"), "captured": exif.format_capture(F.col("captured")), "modified": text.format_modified(F.col("mtime_ns"), F.col("offset_seconds")),
        "camera": F.col("camera"), "lens": F.col("lens"), "iso": F.col("iso").cast("string"), "shutter": F.col("shutter"), "aperture": F.col("aperture"),
        "focal_length": exif.format_focal(F.col("focal_mm")), "file_size": text.format_file_size(F.col("size")),
    }
    items = []
    for f in FIELDS:
        if f in fields:
            shown = text.compact_value(value[f])
            label = LABELS[labels].get(f)
            items.append(F.struct(F.lit(f).alias("field"), (F.concat(F.lit(label + " "), shown) if label else shown).alias("text")))
    return photos.withColumn("info", F.filter(F.array(*items), lambda x: x["text"].isNotNull()))
