"""Display columns from EXIF fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.text import fixed1, format_offset, strip


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s\x00]+|[\s\x00]+$", "")


def _local(x: Column) -> Column:
    x = _bare(x)
    ok = x.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$")
    return F.when(ok, F.try_to_timestamp(F.concat(x, F.lit("Z")), F.lit("yyyy:MM:dd HH:mm:ssX")))


def _subsecond(x: Column) -> Column:
    x = _bare(x)
    return F.when(x.rlike(r"^[0-9]{1,9}$"), x)


def _offset(x: Column) -> Column:
    x = _bare(x)
    hours, minutes = F.substring(x, 2, 2).try_cast("int"), F.substring(x, 5, 2).try_cast("int")
    ok = x.rlike(r"^[+-]\d{2}:\d{2}$") & (hours <= 23) & (minutes <= 59)
    return F.when(ok, (hours * 3600 + minutes * 60) * F.when(x.startswith("-"), -1).otherwise(1))


def capture_time(e: dict[str, Column]) -> Column:
    """STRUCT(local, subsecond, offset_seconds): the original triplet, else the create-date
    one, never a mixture. The older hour offset stands in for an original without a valid
    offset. ``e`` holds date_time_original, sub_sec_time_original, offset_time_original,
    timezone_offset, create_date, sub_sec_time_digitized and offset_time_digitized."""
    # Parsed as UTC and counted from the epoch, the wall time meets no session zone.
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    wall = lambda x: F.timestamp_add("SECOND", F.unix_seconds(_local(x)), epoch)
    legacy = F.try_element_at(e["timezone_offset"], F.lit(1)).cast("int") * 3600
    original = F.struct(
        wall(e["date_time_original"]).alias("local"), _subsecond(e["sub_sec_time_original"]).alias("subsecond"),
        F.coalesce(_offset(e["offset_time_original"]), legacy).alias("offset_seconds"),
    )
    created = F.struct(wall(e["create_date"]).alias("local"), _subsecond(e["sub_sec_time_digitized"]).alias("subsecond"), _offset(e["offset_time_digitized"]).alias("offset_seconds"))
    return F.when(_local(e["date_time_original"]).isNotNull(), original).when(_local(e["create_date"]).isNotNull(), created)


def format_capture(c: Column) -> Column:
    tail = F.concat(F.coalesce(F.concat(F.lit("."), c["subsecond"]), F.lit("")), F.coalesce(F.concat(F.lit(" "), format_offset(c["offset_seconds"])), F.lit("")))
    return F.concat(F.date_format(c["local"], "yyyy-MM-dd HH:mm:ss"), tail)


def display_iso(sensitivity_type: Column, legacy: Column, iso_speed: Column, recommended: Column) -> Column:
    """One ISO value: what the sensitivity type names comes first; 0 and a full 16-bit
    legacy value say nothing."""
    old = F.when((legacy != 0) & (legacy != 65535), legacy.cast("bigint"))
    speed, index = F.nullif(iso_speed.cast("bigint"), F.lit(0)), F.nullif(recommended.cast("bigint"), F.lit(0))
    return (
        F.when(sensitivity_type.isin(2, 4), F.coalesce(index, old, speed))
        .when(sensitivity_type.isin(3, 5, 6, 7), F.coalesce(speed, old, index))
        .otherwise(F.coalesce(old, speed, index))
    )


def format_shutter(r: Column) -> Column:
    n, d = r["n"], r["d"]
    valid = F.when((n != 0) & (d != 0), True)
    text = F.when(n == 1, F.concat(F.lit("1/"), d.cast("string"))).when(d == 1, F.concat(n.cast("string"), F.lit("s"))).otherwise(F.concat(fixed1(F.try_divide(n, d)), F.lit("s")))
    return F.when(valid, text)


def format_aperture(r: Column) -> Column:
    return F.when((r["n"] != 0) & (r["d"] != 0), F.concat(F.lit("f/"), fixed1(F.try_divide(r["n"], r["d"]))))


def focal_mm(r: Column) -> Column:
    return F.when((r["n"] != 0) & (r["d"] != 0), F.try_divide(r["n"].cast("float"), r["d"].cast("float")).cast("float"))


def format_focal(mm: Column) -> Column:
    whole = F.abs(mm - F.floor(mm)) < 1.1920929e-7
    text = F.concat(F.when(whole, F.floor(mm).cast("string")).otherwise(fixed1(mm)), F.lit(" mm"))
    return F.when((mm >= 0) & ~F.isnan(mm) & (mm < float("inf")), text)


def camera(make: Column, model: Column) -> Column:
    return strip(F.concat(F.coalesce(make, F.lit("")), F.lit(" "), F.coalesce(model, F.lit(""))))


def lens(lens_name: Column, lens_model: Column) -> Column:
    return F.coalesce(F.nullif(strip(lens_name), F.lit("")), F.nullif(strip(lens_model), F.lit("")))


def orient(exif: Column) -> Column:
    return F.when(exif.isin(3, 4), "R180").when(exif.isin(5, 6), "R90").when(exif.isin(7, 8), "R270").otherwise("R0")


def swaps_axes(orientation: Column) -> Column:
    return orientation.isin("R90", "R270")
