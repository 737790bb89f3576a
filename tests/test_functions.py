"""Literal cases of the scalar functions."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shutterlake.functions import exif, geometry, paths, pixels, text, xmp

RDF = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"'
XMP = "http://ns.adobe.com/xap/1.0/"


def one(spark, column, **values):
    frame = spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in values.items()], F.lit(1).alias("_one"))
    return frame.select(column.alias("x")).first()["x"]


def meta(inside, scope=""):
    return f'<m><r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" {scope}>{inside}</r:RDF></m>'


S = f'xmlns:s="{XMP}"'
PARSED = [
    # Attribute or direct child, first in document order, whatever the prefix.
    (meta(f'<r:Description/><r:Description {S} s:Rating="5"/>'), 5),
    (meta(f'<r:Description><s:Rating {S}>3</s:Rating></r:Description><r:Description {S} s:Rating="1"/>'), 3),
    (meta(f'<r:Description s:Rating="5"><s:Nick>x</s:Nick></r:Description>', S), 5),
    (meta(f'<r:Description {S}><s:Box><s:Rating>3</s:Rating></s:Box></r:Description>'), None),
    (meta(f'<r:Bag {S} s:Rating="3"/>'), None),
    (meta(f'<r:Description {S[:-2]}2/" s:Rating="3"/>'), None),
    (meta('<r:Description s:Rating="1"/>' + f'<r:Description {S} s:Rating="2"/>', 'xmlns:s="urn:elsewhere"'), 2),
    (meta(f'<r:Description {S} odd:Thing="1" s:Rating="2"/>'), 2),
    (meta(f"<r:Description {S} s:Rating='&#51;'/>"), 3),
    (meta(f"<!-- s:Rating --><r:Description {S}/>"), None),
    # Numbers: trimmed, truncated, between 0 and 255.
    *[(meta(f'<r:Description {S} s:Rating="{value}"/>'), want) for value, want in ((" 4.999 ", 4), ("0.99", 0), ("-0.2", 0), ("-inf", 0), ("NaN", 0), ("3e0", 3), ("1e9", 255), ("infinity", 255), ("two", None), ("2,5", None), ("1_1", None), ("", None))],
    (meta(f"<r:Description {S}><s:Rating><![CDATA[\t2.5]]></s:Rating></r:Description>"), 2),
    # Not well formed, or a name twice: no rating at all.
    (meta(f'<r:Description {S} s:Rating="3"/>') + "<second/>", None),
    (meta(f'<r:Description {S} s:Rating="3"></r:Other>'), None),
    (meta(f'<r:Description {S} s:Rating="3"/>')[:-4], None),
    (meta(f'<r:Description {S} s:Rating=3/>'), None),
    (meta(f'<r:Description {S} bare s:Rating="3"/>'), None),
    (meta(f'<r:Description {S} xmlns:t="{XMP}" s:Rating="1" t:Rating="1"/>'), None),
    (meta(f'<r:Description {S} s:Rating="3"/>', 'xmlns:xmlns="urn:z"'), None),
    ("Rating", None), ("", None), (None, None),
]


@pytest.mark.parametrize("document,rating", PARSED)
def test_xmp_parse(document, rating):
    assert xmp.parse_rating(document) == rating


@pytest.mark.parametrize("document,rating", PARSED)
def test_xmp_update(document, rating):
    if rating is not None:
        assert xmp.parse_rating(xmp.update_rating(document, 1)) == 1


def test_xmp_update_keeps_other_bytes():
    before = meta(f'<r:Description s:Rating="7"/>\n <r:Description  {S} s:Rating = \'1\'\ts:Mood="calm" /><?keep this?>', 'xmlns:s="urn:elsewhere"')
    assert xmp.update_rating(before, 5) == before.replace("'1'", "'5'")
    assert "<s:Rating>2</s:Rating>" in xmp.update_rating(meta(f"<r:Description {S}><s:Rating/></r:Description>"), 2)
    free = xmp.update_rating(meta('<r:Description r:about="x"/>'), 3)
    assert 'r:about="x"' in free and 'xmp:Rating="3"' in free and xmp.parse_rating(free) == 3
    taken = xmp.update_rating(meta("<r:Description/>", 'xmlns:xmp="urn:a" xmlns:stars="urn:b"'), 3)
    assert "stars_:Rating" in taken and xmp.parse_rating(taken) == 3
    for bad in ("<m/>", "<m", "", meta("<r:Bag/>")):
        with pytest.raises(xmp.Malformed):
            xmp.update_rating(bad, 1)


def test_xmp_columns(spark):
    rows = spark.createDataFrame([(1, None, 3), (2, "<a", 4), (3, PARSED[0][0], 5)], "k int, xml string, r int")
    out = {r["k"]: r for r in rows.select("k", xmp.xmp_update_rating(F.col("xml"), F.col("r")).alias("u")).select("k", "u.*", xmp.xmp_parse_rating(F.col("u.xml")).alias("again")).collect()}
    assert out[1]["again"] == 3 and out[1]["xml"].startswith('<?xpacket begin="﻿"')
    assert out[2]["xml"] is None and out[2]["error"]
    assert out[3]["again"] == 5


def test_tokens_and_owners(spark):
    names = ["/a/Photo.ARW", "/b/photo.DNG", "/a/café.ARW", "/a/café.DNG", "/a/STRASSE.ARW", "/a/straße.dng"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(paths.collision_token(F.col("p"))).collect()]
    assert got[0] == got[1] == "photo" and got[2] == got[3] and got[4] == got[5] == "strasse"
    assert one(spark, paths.sidecar_owner(F.col("p"), F.lit(True)), p="/A/Img.ARW") == "/A/img.xmp"
    assert one(spark, paths.sidecar_owner(F.col("p"), F.lit(False)), p="/A/Img.ARW") == "/A/Img.xmp"
    assert one(spark, paths.object_path(F.col("p")), p="ab") is None


EXIF = ("date_time_original", "sub_sec_time_original", "offset_time_original", "timezone_offset", "create_date", "sub_sec_time_digitized", "offset_time_digitized")


@pytest.mark.parametrize(
    "fields,want",
    [
        (("1999:07:04 06:05:04", "000123456", "+13:45", None, None, None, None), "1999-07-04 06:05:04.000123456 +13:45"),
        # An hour that no day has: the other triplet, with nothing of the first.
        (("2010:10:10 24:00:00", "5", "-03:30", [4], "2010:10:11 00:00:01", None, None), "2010-10-11 00:00:01"),
        (("2011:02:29 10:00:00", None, None, None, "2011:03:01 10:00:00", "7", "-03:30"), "2011-03-01 10:00:00.7 -03:30"),
        # Fractions of 1 to 9 digits, offsets up to 23:59; others are left out.
        (("2001:01:31 12:34:56", "1234567890", "+24:00", None, None, None, None), "2001-01-31 12:34:56"),
        (("2001:01:31 12:34:56", "", "-23:59", [3], None, None, None), "2001-01-31 12:34:56 -23:59"),
        (("2001:01:31 12:34:56", "9a", "05:00", [3, 8], None, None, None), "2001-01-31 12:34:56 +03:00"),
        (("  2001:01:31 12:34:56\x00", None, "+01:60", None, None, None, None), "2001-01-31 12:34:56"),
        (("2001:1:31 12:34:56", None, None, [3], None, "4", "+01:00"), None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_capture_time(spark, fields, want, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    kinds = ", ".join(f"{n} {'array<smallint>' if n == 'timezone_offset' else 'string'}" for n in EXIF)
    row = spark.createDataFrame([fields], kinds)
    got = row.select(exif.format_capture(exif.capture_time({n: F.col(n) for n in EXIF})).alias("x")).first()["x"]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want


@pytest.mark.parametrize("n,d,shutter,aperture", [(1, 1600, "1/1600", "f/0.0"), (2, 1, "2s", "f/2.0"), (3, 2, "1.5s", "f/1.5"), (0, 4, None, None), (4, 0, None, None), (5, 4, "1.2s", "f/1.2")])
def test_rationals(spark, n, d, shutter, aperture):
    r = F.struct("n", "d")
    row = spark.createDataFrame([(n, d)], "n bigint, d bigint").select(exif.format_shutter(r).alias("s"), exif.format_aperture(r).alias("a")).first()
    assert (row["s"], row["a"]) == (shutter, aperture)


def test_iso(spark):
    """All combinations against the rule: the kind of sensitivity tells which value comes first."""

    def model(kind, old, speed, index):
        old, speed, index = (None if v == 0 else v for v in (None if old == 65_535 else old, speed, index))
        named = {2: index, 4: index, 3: speed, 5: speed, 6: speed, 7: speed}.get(kind)
        return next((v for v in (named, old, speed, index) if v is not None), None)

    settings = list(itertools.product((None, 0, 1, 2, 3, 4, 5, 6, 7, 9), (None, 0, 250, 65_535), (None, 0, 3200), (None, 0, 12_800)))
    rows = spark.createDataFrame(settings, "t int, old bigint, speed bigint, index bigint")
    for r in rows.select("*", exif.display_iso(F.col("t"), F.col("old"), F.col("speed"), F.col("index")).alias("iso")).collect():
        assert r["iso"] == model(*r[:4]), r


def test_texts(spark):
    assert one(spark, exif.lens(F.col("a"), F.col("b")), a=" \t ", b="  EXIF Lens  ") == "EXIF Lens"
    assert one(spark, exif.format_focal(F.col("a")), a=F.lit(50.0).cast("float")) == "50 mm"
    assert one(spark, exif.format_focal(F.col("a")), a=F.lit(18.25).cast("float")) == "18.2 mm"
    for size, want in ((999, "999 B"), (1000, "1.0 KB"), (1_250_000, "1.2 MB"), (3_000_000_000, "3.0 GB")):
        assert one(spark, text.format_file_size(F.col("a")), a=size) == want
    assert one(spark, text.format_modified(F.col("a"), F.lit(-3600)), a=1_700_000_000_999_999_999) == "2023-11-14 21:13:20 -01:00"
    assert one(spark, text.format_modified(F.col("a"), F.lit(0)), a=0) is None

    def model(value):
        out, pending = "", False
        for c in value:
            if c.isspace() or ord(c) < 32:
                pending = bool(out)
                continue
            if len(out) >= 512:
                break
            if pending and len(out) + 1 < 512:
                out += " "
            pending = False
            out += c
        return out or None

    for value in ("a \t\n b", "  ", "x" * 511 + " yz", "x" * 510 + " yz", "x" * 512 + " y", "x" * 600, "a\x00b"):
        assert one(spark, text.compact_value(F.col("a")), a=value) == model(value)


def test_fit_dimensions(spark):
    rows = spark.range(1, 60).selectExpr("id AS w").crossJoin(spark.range(1, 60, 7).selectExpr("id AS h"))
    for w, h, f in rows.select("w", "h", geometry.fit_dimensions(F.col("w"), F.col("h"), F.lit(20)).alias("f")).collect():
        if max(w, h) <= 20:
            assert f is None
        else:
            s = 20 / max(w, h)
            assert (f["width"], f["height"]) == (max(1, int(w * s + 0.5)), max(1, int(h * s + 0.5)))


def test_tone_table_matches_column(spark):
    values = np.linspace(0, 1, 300)
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(geometry.tone_curve(F.col("v"))).collect()]
    table = pixels.tone_table()[(values * 65_535 + 0.5).astype(int)]
    assert np.abs(np.array(got) - table.astype(int)).max() <= 1


def test_develop_and_rotate():
    raw = np.arange(5 * 7, dtype=np.uint16).reshape(5, 7) * 10
    n = pixels.normalized(raw, [5.0, 5, 5, 5], [105.0, 105, 105, 105])
    assert n[0, 0] == 0 and n[0, 1] == np.float32(0.05) and n[4, 6] == raw[4, 6] and n[0, 6] == raw[0, 6]
    for cfa in pixels.QUADS:
        plane = np.tile(np.array([[{"R": 1, "G": 2, "B": 3}[c] for c in cfa[i : i + 2]] for i in (0, 2)], np.float32), (3, 3))
        for x, y in ((0, 0), (1, 0), (0, 1), (1, 1)):
            assert (pixels.superpixel(plane, cfa, (x, y, 4, 4)) == [1, 2, 3]).all()
    assert (pixels.calibrated(np.full((1, 1, 3), 0.5, np.float32), [float("nan"), 1, 1], list(np.eye(3).ravel())) == 0.5).all()
    image = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    assert (pixels.turned(image, "R90")[0, 0] == image[1, 0]).all() and (pixels.turned(image, "R270")[0, 0] == image[0, 2]).all()
    flat = np.full((9, 12, 4), 77, np.uint8)
    assert pixels.shrunk(flat, 4).shape == (3, 4, 4) and (pixels.shrunk(flat, 4) == 77).all()


def test_jpeg_sampling():
    assert pixels.sampling_of(b"no")[1] and pixels.sampling_of(b"\xff\xd8\xff\xd9\x00\x00")[1]
    head = bytes.fromhex("FFD8FFFFE00004AAAAFFC00011080010001003011100021100031100")
    assert pixels.sampling_of(head) == ("4:4:4", None)
    assert pixels.sampling_of(head.replace(b"\x01\x11", b"\x01\x22")) == ("other", None)


def test_bands_and_cells():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 4000, (2 * pixels.BAND * 2 + 7, 31), np.uint16)
    area, levels = (1, 1, 29, len(raw) - 2), ([5.0, 6, 7, 8], [3000.0, 3100, 3200, 3300])
    whole = pixels.packed(pixels.calibrated(pixels.superpixel(pixels.normalized(raw, *levels), "GRBG", area), [2.0, 1, 1.5], list(np.eye(3).ravel())))
    assert np.abs(pixels.developed(raw, "GRBG", area, *levels, [2.0, 1, 1.5], list(np.eye(3).ravel())).astype(int) - whole).max() <= 1
    assert pixels.developed(raw, "none", area, *levels, [1.0] * 3, [1.0] * 9) is None
    image = rng.integers(0, 256, (700, 300, 4), np.uint8)
    dense = np.einsum("ih,jw,hwc->ijc", pixels.catmull_rom(700, 210), pixels.catmull_rom(300, 90), image.astype(float), optimize=True)
    assert np.abs(pixels.shrunk(image, 210) - np.clip(dense + 0.5, 0, 255).astype(np.uint8).astype(int)).max() <= 1
    column = pa.array([{"width": 2, "height": 1, "rgba": bytes(range(8))}, None, {"width": 1, "height": 2, "rgba": bytes(8)}], pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary())]))
    out = pixels.rotate_cells(column, pa.array(["R180", "R90", None]))
    assert out.to_pylist() == [{"width": 2, "height": 1, "rgba": bytes([4, 5, 6, 7, 0, 1, 2, 3])}, None, None]
    assert pixels.rotate_cells(column[1:1], pa.array([], pa.string())).to_pylist() == []


def test_frames_of_24_megapixels(spark):
    """A worker's own memory stays under 2 GB while it turns, shrinks and develops frames."""
    w, h = 6000, 4000

    @F.arrow_udf("long")
    def peak(image: pa.Array, cfa: pa.Array, names: pa.Array) -> pa.Array:
        with open("/proc/self/clear_refs", "w") as f:
            f.write("5")  # the peak counts from here
        rows = len(image)
        flat = pa.array([[0, 0, w, h]] * rows), *(pa.array([[x] * 4] * rows) for x in (0.0, 4000.0, 1.0)), pa.array([list(np.eye(3).ravel())] * rows)
        for out in (lambda: pixels.rotate_cells(image, pa.array(["R90"] * rows)), lambda: pixels.downscale_cells(image, 1500), lambda: pixels.develop_cells(cfa, names, *flat)):
            assert out().null_count == 0
        with open("/proc/self/status") as f:
            most = next(int(line.split()[1]) for line in f if line.startswith("VmHWM"))
        return pa.array([most] * rows)

    frame = lambda name, size: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"), F.expr(f"unhex(repeat(hex(160 + id), {size}))").alias(name))
    rows = spark.range(0, 5, 1, 1).select(frame("rgba", w * h * 4).alias("i"), frame("cfa", w * h * 2).alias("c"), F.lit("RGGB").alias("n"))
    peaks = [r[0] for r in rows.select(peak("i", "c", "n")).collect()]
    assert len(peaks) == 5 and max(peaks) < 2 << 20, peaks
