"""One query for each operator over the given tables, with SQL for the same rows.

The tables hold no catalogue of their own, so inputs are derived from them; remainders of
ids only deal rows out to the roles that an operator needs (old and new rows, files and
rows, accepted and late commands). No query leaves rows out to be cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.functions import exif, geometry, paths, pixels, text, xmp
from shutterlake.operators import benchmarks, journal, ratings, reconcile, stores, views
from shutterlake.plans import prewarm
from shutterlake.shared import new_folder, stored
from shutterlake.sources import catalog as sources
from shutterlake.sources import derived as d
from shutterlake.sources import files
from shutterlake.streaming import ratings as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


# ---- inputs: the same rows on both sides

CAT_SQL = f"SELECT *, row_number() OVER (PARTITION BY folder ORDER BY file_name) - 1 AS idx FROM ({d.CATALOG}) q WHERE (lower(file_name) LIKE '%.arw' OR lower(file_name) LIKE '%.dng') AND file_name NOT LIKE '.%'"
IMG_SQL = d.IMAGES
NOTE_SQL = f"SELECT owner, sidecar_mtime_ns, CASE WHEN form IN (0, 1) THEN true_rating END AS rating FROM ({d.SIDECARS}) s"
RATED_SQL = f"SELECT *, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 6 END AS rating FROM ({CAT_SQL}) r"
SHOWN_SQL = f"SELECT * FROM (SELECT *, max(CASE WHEN coalesce(rating, 0) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY folder) AS anyp FROM ({RATED_SQL}) a) b WHERE coalesce(rating, 0) >= 2 OR anyp = 0"
VIS_SQL = f"SELECT folder, idx, row_number() OVER (PARTITION BY folder ORDER BY idx) - 1 AS pos FROM ({SHOWN_SQL}) v"
REQ_SQL = f"SELECT folder AS session, folder, CAST(count(*) / 3 AS BIGINT) AS current, CASE WHEN count(*) % 2 = 0 THEN 1 ELSE -1 END AS direction, count(*) % 3 = 0 AS zoomed, 400000 AS full_budget, 60000 AS browse_budget FROM ({CAT_SQL}) c GROUP BY folder"
REQ_SQL = REQ_SQL.replace("CAST(count(*) / 3 AS BIGINT)", "CAST((count(*) - count(*) % 3) / 3 AS BIGINT)")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    return d.derived(spark, sf, d.CATALOG).withColumn("name", F.col("file_name")).withColumn("is_file", F.lit(True))


def cat(spark: SparkSession, sf: str) -> DataFrame:
    return views.folder_index(sources.catalog_from_listing(listing(spark, sf))).drop("name", "is_file")


def img(spark: SparkSession, sf: str) -> DataFrame:
    return d.derived(spark, sf, d.IMAGES)


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return sources.sidecar_ratings(d.derived(spark, sf, d.SIDECARS).withColumn("xml", F.expr(d.xml_of()))).select("owner", "sidecar_mtime_ns", "rating")


def rated(spark: SparkSession, sf: str) -> DataFrame:
    return cat(spark, sf).withColumn("rating", F.expr("CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 6 END"))


def visible(spark: SparkSession, sf: str) -> DataFrame:
    return views.visible_positions(ratings.rating_filter(rated(spark, sf), 2))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*")
    third = F.call_function("div", n, F.lit(3))
    return cat(spark, sf).groupBy("folder").agg(third.alias("current"), F.when(n % 2 == 0, 1).otherwise(-1).alias("direction"), (n % 3 == 0).alias("zoomed")).select(
        F.col("folder").alias("session"), "*", F.lit(400_000).alias("full_budget"), F.lit(60_000).alias("browse_budget")
    )


def commands(spark: SparkSession, sf: str) -> DataFrame:
    return d.derived(spark, sf, d.COMMANDS)


def owner_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return d.derived(spark, sf, d.SIDECARS).filter("true_rating = 4").select("owner", F.lit(1).cast("bigint").alias("revision"), F.lit(7).cast("bigint").alias("global_revision"))


LEDGER_SQL = f"SELECT owner FROM ({d.SIDECARS}) s WHERE true_rating = 4"

# ---- sources, scalars


@query(f"SELECT doc_id, folder, file_name, size, mtime_ns FROM ({CAT_SQL}) c")
def s2_catalog_from_listing(spark, sf):
    return sources.catalog_from_listing(listing(spark, sf)).select("doc_id", "folder", "file_name", "size", "mtime_ns")


@query(NOTE_SQL)
def s3_f1_read_sidecars(spark, sf):
    return notes(spark, sf)


@query(f"SELECT owner, CASE WHEN form = 2 THEN 'failed' ELSE 'updated' END AS status, CASE WHEN form <> 2 THEN (true_rating + 1) % 6 END AS again FROM ({d.SIDECARS}) s")
def s4_f2_write_sidecars(spark, sf):
    due = d.derived(spark, sf, d.SIDECARS).selectExpr("owner", f"{d.xml_of()} AS xml", "(true_rating + 1) % 6 AS rating")
    done = sources.sidecar_documents(due)
    return done.select("owner", "status", xmp.xmp_parse_rating(F.col("xml")).alias("again"))


@query(SQL["s4_f2_write_sidecars"])
def s4_sidecar_table(spark, sf):
    """The published documents, read again."""
    folder = new_folder(spark)
    sources.write_sidecars(d.derived(spark, sf, d.SIDECARS).selectExpr("owner", f"{d.xml_of()} AS xml", "(true_rating + 1) % 6 AS rating"), folder)
    return spark.read.parquet(folder).select("owner", "status", xmp.xmp_parse_rating(F.col("xml")).alias("again"))


@query(f"SELECT path, size, mtime_ns, rating, sidecar_dirty FROM ({IMG_SQL}) i")
def s7_state_snapshot(spark, sf):
    """A snapshot of the state, written and read again."""
    folder = sources.write_state({"images": img(spark, sf)}, new_folder(spark))
    return sources.read_state(spark, folder, "images")["images"].select("path", "size", "mtime_ns", "rating", "sidecar_dirty")


def _files(frame, kind, by):
    """Writes lines as files with an extension of three letters, in a folder for each ``by``."""
    folder = new_folder(frame.sparkSession)
    frame.write.partitionBy(by).option("extension", kind).option("quote", "\u0000").option("sep", "\u0001").csv(folder)
    return folder


@query("SELECT printf('d%02d', doc_id % 37) AS folder, CAST(sum(2 * coalesce(strlen(text), 0) + 2) AS BIGINT) AS size FROM documents GROUP BY doc_id % 37")
def s1_scan_catalog(spark, sf):
    """Photos written in folders and found again: a line of hexadecimal digits for each text."""
    lines = spark.read.parquet(f"{sf}/documents.parquet").select(F.format_string("d%02d", F.col("doc_id") % 37).alias("folder"), F.concat(F.lit("x"), F.coalesce(F.hex("text"), F.lit(""))).alias("line"))
    found = sources.scan_catalog(spark, _files(lines, "arw", "folder"))
    return found.groupBy(F.regexp_extract("folder", "folder=([^/]*)$", 1).alias("folder")).agg(F.sum("size").alias("size"))


@query("SELECT CAST(doc_id AS VARCHAR) AS name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents")
def s1_scan_files(spark, sf):
    """A photo for each text, scanned: every file with its size."""
    folder = new_folder(spark)
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    written = files.write_files(texts, folder, "ARW").select("name", F.regexp_extract("file", "([^/]*)$", 1).alias("file_name"))
    return sources.scan_catalog(spark, f"{folder}/files").join(written, "file_name").select("name", "size")


@query(f"SELECT owner, rating FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq DESC) AS n FROM (SELECT event_id AS seq, printf('P%06d', user_id) AS owner, CAST(floor(value) AS INT) % 6 AS rating FROM events) c) q WHERE n = 1")
def s3_s4_sidecar_files(spark, sf):
    """Sidecars updated with the last command of each owner, as files, and their ratings read again."""
    last = journal.latest_command(commands(spark, sf)).selectExpr("regexp_extract(owner, '([^/]*)[.]xmp$', 1) AS owner", f"{d.xml_of('seq % 2', '0')} AS xml", "rating")
    folder = new_folder(spark)
    files.publish_sidecars(sources.sidecar_documents(last), folder)
    return files.published_ratings(spark, folder)


@query("SELECT CAST(user_id AS VARCHAR) AS input_sha256, event_type AS variant, value AS total_ms, event_id AS seq FROM events WHERE event_id % 3 <> 0")
def s6_develop_records(spark, sf):
    """Records of two schemas, written as JSON; those of the first are read."""
    folder = new_folder(spark)
    records = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "CAST(user_id AS STRING) AS input_sha256", "event_type AS variant", "'' AS output_sha256", "CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS schema_version", "value AS total_ms",
        "array(named_struct('name', 'decode', 'ms', CAST(event_id AS DOUBLE))) AS stages",
    )
    records.write.json(folder)
    return sources.read_develop_records(spark, folder).select("input_sha256", "variant", "total_ms", F.col("stages")[0]["ms"].cast("bigint").alias("seq"))


@query(f"SELECT owner, true_rating AS again FROM ({d.SIDECARS}) s")
def f3_new_sidecar(spark, sf):
    return d.derived(spark, sf, d.SIDECARS).select("owner", xmp.xmp_parse_rating(xmp.xmp_new_sidecar(F.col("true_rating"))).alias("again"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS ok FROM documents")
def s5_verify_content_hash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    files = docs.select("doc_id", F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    want = docs.select(F.col("doc_id").alias("path"), F.upper(F.sha2(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("")).cast("binary"), 256)).alias("sha256"))
    return sources.verify_content_hash(files, want).select(F.col("path").alias("doc_id"), "ok")


@query(f"SELECT path, regexp_replace(path, '\\.[^./]+$', '.xmp') AS sidecar, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')) AS token, CASE WHEN idx % 2 = 0 THEN regexp_extract(path, '^.*/') || lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '.xmp')) ELSE regexp_replace(path, '\\.[^./]+$', '.xmp') END AS owner FROM ({CAT_SQL}) c")
def f4_f5_f6_paths(spark, sf):
    p = F.col("path")
    return cat(spark, sf).select("path", paths.sidecar_path(p).alias("sidecar"), paths.collision_token(p).alias("token"), paths.sidecar_owner(p, F.col("idx") % 2 == 0).alias("owner"))


KEY_SQL = "sha256(path || chr(1) || CAST(size AS VARCHAR) || chr(1) || CAST(mtime_ns AS VARCHAR) || chr(1) || '7' || chr(1) || tier || chr(1) || 'jpeg-quality' || chr(1) || '90')"
WANTED_SQL = f"SELECT path, tier, {KEY_SQL} AS key FROM ({CAT_SQL}) c CROSS JOIN (SELECT unnest(['thumb', 'browse', 'full']) AS tier) t"


@query(f"SELECT path, tier, key, substr(key, 1, 2) || '/' || key || '.jpg' AS object FROM ({WANTED_SQL}) w")
def f7_f8_cache_keys(spark, sf):
    return stores.wanted_keys(cat(spark, sf), 90).withColumn("object", paths.object_path(F.col("key")))


EXIF = "SELECT doc_id, CAST(doc_id % 7 AS BIGINT) AS n, CAST(doc_id % 5 * 4 AS BIGINT) AS d, n_chars, CAST(doc_id % 9 AS INT) AS code, CAST(n_chars % 3 * 32767 AS BIGINT) AS legacy, CAST(doc_id % 4 * 100 AS BIGINT) AS speed, CAST(doc_id % 5 * 1000 AS BIGINT) AS recommended FROM documents"


@query(
    f"""SELECT doc_id, CASE WHEN n = 0 OR d = 0 THEN NULL WHEN n = 1 THEN '1/' || CAST(d AS VARCHAR) WHEN d = 1 THEN CAST(n AS VARCHAR) || 's' ELSE printf('%.1fs', n * 1.0 / d) END AS shutter,
 CASE WHEN n <> 0 AND d <> 0 THEN printf('f/%.1f', n * 1.0 / d) END AS aperture,
 CASE WHEN code IN (3, 4) THEN 'R180' WHEN code IN (5, 6) THEN 'R90' WHEN code IN (7, 8) THEN 'R270' ELSE 'R0' END AS orientation,
 CASE WHEN code IN (2, 4) THEN coalesce(nullif(recommended, 0), CASE WHEN legacy <> 0 AND legacy <> 65535 THEN legacy END, nullif(speed, 0))
  WHEN code IN (3, 5, 6, 7) THEN coalesce(nullif(speed, 0), CASE WHEN legacy <> 0 AND legacy <> 65535 THEN legacy END, nullif(recommended, 0))
  ELSE coalesce(CASE WHEN legacy <> 0 AND legacy <> 65535 THEN legacy END, nullif(speed, 0), nullif(recommended, 0)) END AS iso,
 CASE WHEN n_chars >= 1000000 THEN printf('%.1f MB', n_chars / 1e6) WHEN n_chars >= 1000 THEN printf('%.1f KB', n_chars / 1e3) ELSE CAST(n_chars AS VARCHAR) || ' B' END AS size_text
 FROM ({EXIF}) e"""
)
def f11_f17_exif_columns(spark, sf):
    e = d.derived(spark, sf, EXIF)
    r = F.struct("n", "d")
    iso = exif.display_iso(F.col("code"), F.col("legacy"), F.col("speed"), F.col("recommended"))
    return e.select("doc_id", exif.format_shutter(r).alias("shutter"), exif.format_aperture(r).alias("aperture"), exif.orient(F.col("code")).alias("orientation"), iso.alias("iso"), text.format_file_size(F.col("n_chars")).alias("size_text"))


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_id % 3 = 0 THEN '.' || CAST(event_id % 1000 AS VARCHAR) ELSE '' END || CASE WHEN event_id % 2 = 0 THEN ' +05:30' ELSE '' END AS captured FROM events"""
)
def f9_f10_capture_time(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    none = F.lit(None).cast("string")
    fields = {
        "date_time_original": F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), "sub_sec_time_original": F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 1000).cast("string")).otherwise("bad"),
        "offset_time_original": F.when(F.col("event_id") % 2 == 0, "+05:30").otherwise("+99:00"), "timezone_offset": F.lit(None).cast("array<smallint>"),
        "create_date": F.lit("2000:01:01 00:00:00"), "sub_sec_time_digitized": none, "offset_time_digitized": none,
    }
    return e.select("event_id", exif.format_capture(exif.capture_time(fields)).alias("captured"))


@query("SELECT doc_id, strftime(to_timestamp(1700000000 + doc_id * 1000003 // 1000000000) AT TIME ZONE 'UTC' + INTERVAL 19800 SECOND, '%Y-%m-%d %H:%M:%S') || ' +05:30' AS modified FROM documents".replace("to_timestamp(1700000000 + doc_id * 1000003 // 1000000000) AT TIME ZONE 'UTC'", "TIMESTAMP '2023-11-14 22:13:20' + to_seconds(CAST(doc_id * 1000003 // 1000000000 AS BIGINT))"))
def f18_format_modified(spark, sf):
    return d.derived(spark, sf, d.CATALOG).select("doc_id", text.format_modified(F.col("mtime_ns"), F.lit(19_800)).alias("modified"))


@query("SELECT doc_id, md5(CASE WHEN length(c) > 512 AND substr(c, 512, 1) = ' ' THEN substr(c, 1, 511) || substr(c, 513, 1) ELSE substr(c, 1, 512) END) AS compact FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents) q")
def f19_compact_value(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(text.compact_value(F.col("text"))).alias("compact"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN greatest(w, h) > 20 THEN greatest(CAST(round(w * (20.0 / greatest(w, h))) AS INTEGER), 1) END AS fit_w, CASE WHEN greatest(w, h) > 20 THEN greatest(CAST(round(h * (20.0 / greatest(w, h))) AS INTEGER), 1) END AS fit_h
 FROM (SELECT *, CAST(l_quantity AS INTEGER) AS w, l_linenumber * 7 AS h FROM lineitem) q"""
)
def f20_fit_dimensions(spark, sf):
    q = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("f", geometry.fit_dimensions(F.col("l_quantity").cast("int"), F.col("l_linenumber") * 7, F.lit(20.0)))
    return q.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("f.width").alias("fit_w"), F.col("f.height").alias("fit_h"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 100 - doc_id % 7 - 5 WHEN 2 THEN 200 - doc_id % 11 - 9 WHEN 3 THEN doc_id % 7 ELSE doc_id % 11 END AS x, CASE doc_id % 4 WHEN 1 THEN doc_id % 11 WHEN 2 THEN 100 - doc_id % 7 - 5 WHEN 3 THEN 200 - doc_id % 11 - 9 ELSE doc_id % 7 END AS y FROM documents")
def f21_oriented_rect(spark, sf):
    turn = F.element_at(F.array(*map(F.lit, ("R0", "R90", "R180", "R270"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rect = geometry.oriented_rect(turn, F.col("doc_id") % 11, F.col("doc_id") % 7, F.lit(9), F.lit(5), F.lit(200), F.lit(100))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", rect["x"].alias("x"), rect["y"].alias("y"))


@query(
    "SELECT event_id, CAST(round(255 * (0.65 * g + 0.35 * g * g * (3 - 2 * g))) AS INTEGER) AS tone FROM (SELECT event_id, CASE WHEN e <= 0.0031308 THEN 12.92 * e ELSE 1.055 * pow(e, 1 / 2.4) - 0.055 END AS g FROM (SELECT event_id, 1.3 * v / (1 + 0.3 * v) AS e FROM (SELECT event_id, least(greatest(value / 100, 0), 1) AS v FROM events) a) b) c"
)
def f22_tone_curve(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", geometry.tone_curve(F.col("value") / 100).alias("tone"))


NAMES = "SELECT doc_id, chr(9) || lang || ' ' AS make, source || chr(9) AS model, CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(9) ELSE lang END AS lens_name, CASE WHEN doc_id % 2 = 0 THEN ' ' || source END AS lens_model FROM documents"


@query(f"SELECT doc_id, lang || '  ' || source AS camera, CASE WHEN doc_id % 3 <> 0 THEN lang WHEN doc_id % 2 = 0 THEN source END AS lens, CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 4 = 3 THEN 'f' ELSE CAST(doc_id % 4 AS VARCHAR) END END AS focal, doc_id % 9 >= 5 AS swaps FROM documents".replace("CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 4 = 3 THEN 'f' ELSE CAST(doc_id % 4 AS VARCHAR) END END AS focal", "CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 4 = 2 THEN CAST(doc_id // 2 AS VARCHAR) || ' mm' ELSE CAST(doc_id // 2 AS VARCHAR) || '.5 mm' END END AS focal"))
def f13_f15_camera_lens(spark, sf):
    e = d.derived(spark, sf, NAMES)
    ratio = F.struct(F.when(F.col("doc_id") % 4 > 0, F.col("doc_id")).otherwise(0).alias("n"), F.lit(2).alias("d"))
    return e.select(
        "doc_id", exif.camera(F.col("make"), F.col("model")).alias("camera"), exif.lens(F.col("lens_name"), F.col("lens_model")).alias("lens"),
        exif.format_focal(exif.focal_mm(ratio)).alias("focal"), exif.swaps_axes(exif.orient(F.col("doc_id") % 9)).alias("swaps"),
    )


# ---- ratings


@query(f"SELECT folder, file_name FROM ({CAT_SQL}) c")
def t1_order_catalog(spark, sf):
    return sources.order_catalog(cat(spark, sf)).select("folder", "file_name")


@query(f"SELECT folder, file_name, idx FROM ({CAT_SQL}) c")
def w1_folder_index(spark, sf):
    return cat(spark, sf).select("folder", "file_name", "idx")


@query(f"SELECT owner, CAST(min(idx) AS VARCHAR) || ',' || CAST(max(idx) AS VARCHAR) AS members FROM ({CAT_SQL}) c GROUP BY owner HAVING count(*) >= 2")
def a1_owner_groups(spark, sf):
    return ratings.owner_groups(cat(spark, sf)).select("owner", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"SELECT doc_id, rating FROM ({SHOWN_SQL}) s")
def p1_rating_filter(spark, sf):
    return ratings.rating_filter(rated(spark, sf), 2).select("doc_id", "rating")


@query(f"SELECT i.path, i.size = c.size AND i.mtime_ns = c.mtime_ns AS same FROM ({IMG_SQL}) i JOIN ({CAT_SQL}) c ON i.path = c.path")
def p2_identity_match(spark, sf):
    return img(spark, sf).alias("i").join(cat(spark, sf).alias("c"), F.col("i.path") == F.col("c.path")).select("i.path", ratings.identity_match("i", "c").alias("same"))


@query(f"SELECT path, rating FROM ({IMG_SQL}) i WHERE sidecar_dirty AND NOT sidecar_quarantined AND rating IS NOT NULL")
def p3_pending_sidecars(spark, sf):
    return journal.pending_sidecars(img(spark, sf)).select("path", "rating")


KNOWN_SQL = f"SELECT i.*, coalesce(i.size = c.size AND i.mtime_ns = c.mtime_ns, FALSE) AS ok FROM ({IMG_SQL}) i LEFT JOIN ({CAT_SQL}) c ON i.path = c.path WHERE NOT i.sidecar_quarantined"
TOKEN_SQL = "lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''))"
REJECTED_SQL = f"SELECT DISTINCT {TOKEN_SQL} AS token FROM ({IMG_SQL}) i WHERE sidecar_owner IS NULL AND NOT sidecar_quarantined AND (NOT path_stable OR derived_owner IS NULL)"
OWNER_RATING_SQL = f"""
SELECT o.owner, CASE
 WHEN w.owner IS NOT NULL THEN CASE WHEN w.sidecar_dirty THEN w.rating WHEN s.rating IS NOT NULL AND s.sidecar_mtime_ns >= w.sidecar_mtime_ns THEN s.rating ELSE w.rating END
 WHEN t.token IS NOT NULL THEN s.rating
 WHEN f.n_dirty > 0 THEN CASE WHEN f.n = 1 AND f.n_ok = 1 THEN f.any_rating END
 WHEN s.rating IS NOT NULL AND s.sidecar_mtime_ns >= coalesce(f.newest, 0) THEN s.rating
 WHEN f.n_ok > 0 AND f.n_ok = f.n_rated AND f.low = f.high THEN f.low END AS rating
FROM (SELECT owner, min({TOKEN_SQL}) AS token FROM ({CAT_SQL}) c GROUP BY owner) o
LEFT JOIN (SELECT sidecar_owner AS owner, rating, sidecar_mtime_ns, sidecar_dirty FROM ({KNOWN_SQL}) k WHERE ok AND sidecar_owner IS NOT NULL) w ON w.owner = o.owner
LEFT JOIN (SELECT * FROM ({NOTE_SQL}) n WHERE rating IS NOT NULL) s ON s.owner = o.owner
LEFT JOIN ({REJECTED_SQL}) t ON t.token = o.token
LEFT JOIN (SELECT derived_owner, count(*) AS n, sum(CASE WHEN sidecar_dirty THEN 1 ELSE 0 END) AS n_dirty, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS n_ok,
  sum(CASE WHEN ok AND rating IS NOT NULL THEN 1 ELSE 0 END) AS n_rated, max(rating) AS any_rating, max(CASE WHEN ok THEN sidecar_mtime_ns END) AS newest,
  min(CASE WHEN ok THEN rating END) AS low, max(CASE WHEN ok THEN rating END) AS high FROM ({KNOWN_SQL}) k2 WHERE sidecar_owner IS NULL AND derived_owner IS NOT NULL GROUP BY derived_owner) f ON f.derived_owner = o.owner
"""
RESOLVED_SQL = f"SELECT c.path, r.rating FROM ({CAT_SQL}) c JOIN ({OWNER_RATING_SQL}) r ON c.owner = r.owner WHERE r.rating IS NOT NULL"


@query(RESOLVED_SQL)
def j1_j2_resolve_ratings(spark, sf):
    return ratings.resolve_ratings(cat(spark, sf), img(spark, sf), notes(spark, sf))


@query(f"SELECT path, pos FROM (SELECT c.path, row_number() OVER (PARTITION BY c.folder ORDER BY c.idx) - 1 AS pos FROM (SELECT *, max(CASE WHEN coalesce(rating, 0) >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY folder) AS anyp FROM (SELECT c1.*, r1.rating FROM ({CAT_SQL}) c1 LEFT JOIN ({RESOLVED_SQL}) r1 ON c1.path = r1.path) j) c WHERE coalesce(rating, 0) >= 3 OR anyp = 0) q")
def flagship_open_library(spark, sf):
    photos = cat(spark, sf)
    resolved = ratings.resolve_ratings(photos, img(spark, sf), notes(spark, sf))
    shown = ratings.rating_filter(photos.join(resolved, "path", "left"), 3)
    return views.visible_positions(shown, "path").select("path", "pos")


@query(f"SELECT folder, idx, coalesce(CASE WHEN doc_id % 8 = 0 THEN doc_id % 6 END, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 END, CASE WHEN doc_id % 4 > 0 THEN least(doc_id % 9, 5) END) AS rating FROM ({CAT_SQL}) c WHERE doc_id % 8 = 0 OR doc_id % 3 = 0 OR (doc_id % 4 > 0 AND doc_id % 9 > 0)".replace("CASE WHEN doc_id % 4 > 0 THEN", "CASE WHEN doc_id % 4 > 0 AND doc_id % 9 > 0 THEN"))
def j3_merge_rating_layers(spark, sf):
    c = cat(spark, sf)
    layer = lambda cond, value: c.filter(cond).select("folder", "idx", F.expr(value).alias("rating"))
    return ratings.merge_rating_layers(layer("doc_id % 3 = 0", "doc_id % 5"), layer("doc_id % 4 > 0", "doc_id % 9"), layer("doc_id % 8 = 0", "doc_id % 6"))


@query(REJECTED_SQL)
def j4_rejected_history(spark, sf):
    return ratings.rejected_history(img(spark, sf))


@query(f"SELECT i.path FROM ({IMG_SQL}) i WHERE i.sidecar_owner IS NOT NULL OR i.derived_owner IS NULL OR NOT EXISTS (SELECT 1 FROM ({LEDGER_SQL}) l WHERE l.owner = i.derived_owner)")
def j5_separate_history(spark, sf):
    return ratings.separate_history(img(spark, sf), owner_ledger(spark, sf)).select("path")


@query(f"SELECT v.folder, v.pos FROM ({VIS_SQL}) v JOIN ({RATED_SQL}) r ON v.folder = r.folder AND v.idx = r.idx WHERE r.rating > 0")
def j6_starred_positions(spark, sf):
    return ratings.starred_positions(visible(spark, sf), rated(spark, sf).select("folder", "idx", "rating"))


@query(
    f"""SELECT i.path, i.rating, i.sidecar_dirty FROM ({IMG_SQL}) i WHERE NOT EXISTS (SELECT 1 FROM ({CAT_SQL}) c WHERE c.doc_id % 6 = 0 AND (c.path = i.path OR c.owner = i.sidecar_owner))
 UNION ALL SELECT path, doc_id % 5 AS rating, FALSE AS sidecar_dirty FROM ({CAT_SQL}) c WHERE doc_id % 6 = 0"""
)
def j7_upsert_ratings(spark, sf):
    new = cat(spark, sf).filter("doc_id % 6 = 0").selectExpr("path", "size", "mtime_ns", "doc_id % 5 AS rating", "mtime_ns AS sidecar_mtime_ns", "owner AS sidecar_owner")
    return journal.upsert_ratings(img(spark, sf), new).select("path", "rating", "sidecar_dirty")


STATE = "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id"
PROPOSALS = "SELECT event_id AS seq, user_id, CAST(user_id AS STRING) AS path, '/u/' || CAST(user_id % 50 AS STRING) AS owner, event_id % 4 <> 0 AS seen_present, event_id % 3 AS seen_image, user_id % 2 + event_id % 2 AS seen_owner, event_id % 7 AS seen_global FROM events"


def _proposals(spark, sf):
    p = d.derived(spark, sf, PROPOSALS)
    now = p.select("path", "owner", "user_id").distinct().selectExpr(
        "path", "owner", "true AS present", "user_id % 3 AS image_revision", "user_id % 2 AS owner_revision", "user_id % 7 AS owner_global_revision"
    )
    return p, now


@query(f"SELECT seq, path FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq) AS n FROM ({PROPOSALS}) p WHERE seen_present AND seen_image = user_id % 3 AND seen_owner = user_id % 2) q WHERE n = 1")
def j8_compare_and_set_owner(spark, sf):
    p, now = _proposals(spark, sf)
    p = p.withColumnsRenamed({"seen_image": "seen_image_revision", "seen_owner": "seen_owner_revision"})
    return journal.compare_and_set_owner(p, now).select("seq", "path")


@query(f"SELECT seq, path FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq) AS n FROM ({PROPOSALS}) p WHERE seen_owner = 1 AND seen_image = user_id % 3 AND user_id % 7 <= seen_global) q WHERE n = 1")
def j9_compare_and_set_global(spark, sf):
    p, now = _proposals(spark, sf)
    p = p.withColumnsRenamed({"seen_image": "seen_image_revision", "seen_owner": "seen_ownerless"})
    return journal.compare_and_set_global(p, now, 1).select("seq", "path")


def _due(spark, sf):
    images = img(spark, sf)
    due = images.filter("sidecar_dirty").selectExpr("path", "size", "mtime_ns", "CASE WHEN size % 9 = 1 THEN 9 ELSE rating END AS rating", "coalesce(sidecar_owner, derived_owner) AS owner")
    writes = images.selectExpr("path", "size % 4 <> 0 AS ok", "mtime_ns + 5 AS sidecar_mtime_ns")
    return journal.classify_outcomes(due, images, cat(spark, sf), writes.select("path", "ok", "sidecar_mtime_ns"))


OUTCOME_SQL = f"""SELECT i.path, CASE WHEN i.sidecar_quarantined OR i.rating IS NULL OR i.size % 9 = 1 AND i.rating <> 9 THEN 'superseded'
 WHEN i.sidecar_owner IS NULL OR i.sidecar_owner <> coalesce(c.owner, i.sidecar_owner, i.derived_owner) THEN 'owner_changed' WHEN c.path IS NULL THEN 'discarded' WHEN i.size % 4 = 0 THEN 'write_failed' ELSE 'written' END AS outcome
 FROM ({IMG_SQL}) i LEFT JOIN ({CAT_SQL}) c ON i.path = c.path AND i.size = c.size AND i.mtime_ns = c.mtime_ns WHERE i.sidecar_dirty"""


@query(OUTCOME_SQL)
def j10_sync_outcomes(spark, sf):
    return _due(spark, sf).select("path", "outcome")


@query(
    f"""SELECT i.path, i.rating, i.sidecar_dirty AND coalesce(o.outcome <> 'written', TRUE) AS sidecar_dirty, CASE WHEN o.outcome = 'written' THEN i.mtime_ns + 5 ELSE i.sidecar_mtime_ns END AS sidecar_mtime_ns, coalesce(o.outcome = 'owner_changed', FALSE) AS archived
 FROM ({IMG_SQL}) i LEFT JOIN ({OUTCOME_SQL}) o ON o.path = i.path WHERE coalesce(o.outcome <> 'discarded', TRUE)"""
)
def j10_apply_outcomes(spark, sf):
    images = img(spark, sf)
    left, archived = journal.apply_outcomes(images, images.limit(0), _due(spark, sf))
    both = left.withColumn("archived", F.lit(False)).unionByName(archived.withColumn("archived", F.lit(True)))
    return both.select("path", "rating", "sidecar_dirty", "sidecar_mtime_ns", "archived")


def _stored(spark, sf):
    wanted = stores.wanted_keys(cat(spark, sf), 90)
    return wanted, wanted.filter("tier <> 'full'").select("key").union(d.derived(spark, sf, d.OBJECTS).select("key"))


@query(f"SELECT key, 'missing' AS state FROM ({WANTED_SQL}) w WHERE tier = 'full' UNION ALL SELECT key, 'present' AS state FROM ({WANTED_SQL}) w WHERE tier <> 'full' UNION ALL SELECT key, 'stale' AS state FROM ({d.OBJECTS_DUCKDB}) o")
def j11_cache_coverage(spark, sf):
    return stores.cache_coverage(*_stored(spark, sf)).select("key", "state")


@query(
    f"""SELECT path, rating FROM (SELECT c.path, coalesce(max(CASE WHEN doc_id % 13 = 0 THEN 5 END) OVER (PARTITION BY c.owner), rating) AS rating FROM ({RATED_SQL}) c) q WHERE rating IS NOT NULL"""
)
def j12_rate_with_members(spark, sf):
    r = rated(spark, sf)
    return ratings.rate_with_members(r.drop("rating"), r, r.filter("doc_id % 13 = 0").selectExpr("path", "5 AS rating"), 3)[0]


@query(f"SELECT folder, max(CASE WHEN coalesce(rating, 0) < 3 THEN 1 ELSE 0 END) = 1 AS crossed FROM (SELECT c.*, max(CASE WHEN doc_id % 13 = 0 THEN 1 END) OVER (PARTITION BY c.owner) AS hit FROM ({RATED_SQL}) c) q WHERE hit = 1 GROUP BY folder")
def j12_crossed_folders(spark, sf):
    r = rated(spark, sf)
    return ratings.rate_with_members(r.drop("rating"), r, r.filter("doc_id % 13 = 0").selectExpr("path", "5 AS rating"), 3)[1]


@query(f"SELECT derived_owner AS owner, CASE WHEN count(*) = count(rating) AND min(rating) = max(rating) THEN min(rating) END AS rating, coalesce(max(CASE WHEN NOT sidecar_dirty THEN sidecar_mtime_ns END), 0) AS newest FROM ({IMG_SQL}) i WHERE derived_owner IS NOT NULL GROUP BY derived_owner")
def a2_a3_owner_aggregates(spark, sf):
    rows = img(spark, sf).filter("derived_owner is not null")
    return rows.groupBy(F.col("derived_owner").alias("owner")).agg(ratings.unanimous_rating(F.col("rating")).alias("rating"), ratings.newest_db_sidecar(~F.col("sidecar_dirty"), F.col("sidecar_mtime_ns")).alias("newest"))


# ---- views and plans


@query(VIS_SQL)
def w2_visible_positions(spark, sf):
    return visible(spark, sf)


NAV_SQL = f"SELECT r.folder, r.current, r.direction, count(CASE WHEN v.idx < r.current THEN 1 END) AS before, count(*) AS n, max(CASE WHEN v.idx = r.current THEN 1 ELSE 0 END) AS exact FROM ({REQ_SQL}) r JOIN ({VIS_SQL}) v ON r.folder = v.folder GROUP BY r.folder, r.current, r.direction"


@query(f"SELECT q.folder, q.current, v.idx AS target FROM (SELECT *, greatest(0, least(least(before, n - 1) + direction * 2 - CASE WHEN exact = 0 AND direction > 0 THEN 1 ELSE 0 END, n - 1)) AS pos FROM ({NAV_SQL}) a) q JOIN ({VIS_SQL}) v ON q.folder = v.folder AND q.pos = v.pos")
def w3_navigate(spark, sf):
    current = requests(spark, sf).select("folder", "current", (F.col("direction") * 2).alias("delta"))
    return views.navigate(visible(spark, sf), current).select("folder", "current", "target")


@query(f"SELECT folder, idx, pos, lag(idx) OVER (PARTITION BY folder ORDER BY pos) AS previous, lead(idx) OVER (PARTITION BY folder ORDER BY pos) AS next, CAST(sum(idx) OVER (PARTITION BY folder ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS window_sum FROM ({VIS_SQL}) v")
def w4_neighbors(spark, sf):
    n = views.neighbors(visible(spark, sf))
    return n.select("folder", "idx", "pos", "previous", "next", F.aggregate("window", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("window_sum"))


@query(f"SELECT a.folder, a.pos, b.idx, t.tier FROM ({VIS_SQL}) a JOIN ({VIS_SQL}) b ON a.folder = b.folder AND abs(a.pos - b.pos) <= 1 CROSS JOIN (SELECT unnest(['thumb', 'browse', 'full']) AS tier) t")
def w4_pins(spark, sf):
    return views.pins(visible(spark, sf))


@query(f"SELECT folder, idx, CASE WHEN idx = s THEN 0 WHEN idx > s THEN (idx - s) + least((idx - s - 1) // 3, s) ELSE least(3 * (s - idx), n - 1 - s) + (s - idx) END AS rank FROM (SELECT c.folder, c.idx, r.current AS s, count(*) OVER (PARTITION BY c.folder) AS n FROM ({CAT_SQL}) c JOIN ({REQ_SQL}) r ON c.folder = r.folder) q")
def w5_outward_order(spark, sf):
    sized = cat(spark, sf).join(requests(spark, sf).select("folder", F.col("current").alias("start")), "folder")
    n = cat(spark, sf).groupBy("folder").agg(F.count("*").alias("n"))
    return prewarm.outward_order(sized.join(n, "folder")).select("folder", "idx", "rank")


AROUND_SQL = f"""SELECT r.session, r.folder, r.current, r.direction, r.zoomed, v.idx, v.pos, a.at, (v.pos > a.at) = (r.direction >= 0) AS ahead, abs(v.pos - a.at) AS steps, abs(v.pos - a.at) * CASE WHEN (v.pos > a.at) = (r.direction >= 0) THEN 1 ELSE 3 END AS weight
 FROM ({REQ_SQL}) r JOIN (SELECT r0.folder, coalesce(v0.pos, 0) AS at FROM ({REQ_SQL}) r0 LEFT JOIN ({VIS_SQL}) v0 ON r0.folder = v0.folder AND r0.current = v0.idx) a ON a.folder = r.folder JOIN ({VIS_SQL}) v ON v.folder = r.folder"""


@query(f"SELECT session, idx, ahead, steps, weight FROM ({AROUND_SQL}) q")
def w6_weighted_distance(spark, sf):
    return prewarm.around(requests(spark, sf), visible(spark, sf)).select("session", "idx", "ahead", "steps", "weight")


@query(f"SELECT session, idx FROM (SELECT session, idx, 1000 + sum(size) OVER (PARTITION BY session ORDER BY weight, CASE WHEN ahead THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT a.*, c.size FROM ({AROUND_SQL}) a JOIN ({CAT_SQL}) c ON a.folder = c.folder AND a.idx = c.idx WHERE steps >= 2) q) z WHERE used <= 20000")
def w7_budget_prefix(spark, sf):
    near = prewarm.around(requests(spark, sf), visible(spark, sf)).filter("steps >= 2").join(cat(spark, sf).select("folder", "idx", F.col("size").alias("bytes")), ["folder", "idx"])
    near = near.withColumn("base", F.lit(1000)).withColumn("budget", F.lit(20_000))
    return prewarm.budget_prefix(near, "budget", "base").select("session", "idx")


SIZED_SQL = f"SELECT a.*, c.size AS bytes FROM ({AROUND_SQL}) a JOIN ({CAT_SQL}) c ON a.folder = c.folder AND a.idx = c.idx"
HELD_SQL = f"SELECT r.session, coalesce(max(c.size), 0) + coalesce(sum(b.bytes), 0) AS held FROM ({REQ_SQL}) r LEFT JOIN ({CAT_SQL}) c ON c.folder = r.folder AND c.idx = r.current LEFT JOIN (SELECT * FROM ({SIZED_SQL}) z WHERE steps <= 1 AND idx <> current) b ON b.session = r.session GROUP BY r.session"
WAVE_SQL = f"SELECT f.session, f.idx, f.weight, f.ahead, (h.held + sum(f.bytes) OVER (PARTITION BY f.session ORDER BY f.weight, CASE WHEN f.ahead THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING)) AS used FROM ({SIZED_SQL}) f JOIN ({HELD_SQL}) h ON h.session = f.session WHERE f.steps >= 2 AND f.idx <> f.current"


@query(
    f"""SELECT session, idx, tier, class, distance, kind FROM (
 SELECT session, current AS idx, 'browse' AS tier, 0 AS class, 0 AS distance, 'display' AS kind FROM ({REQ_SQL}) r UNION ALL SELECT session, current, 'full', CASE WHEN zoomed THEN 0 ELSE 1 END, 0, 'display' FROM ({REQ_SQL}) r
 UNION ALL SELECT session, idx, 'browse', 2, weight, 'display' FROM ({AROUND_SQL}) a WHERE steps <= 1 AND idx <> current UNION ALL SELECT session, idx, 'full', 2, weight, 'display' FROM ({AROUND_SQL}) a WHERE steps <= 1 AND idx <> current
 UNION ALL SELECT session, idx, 'browse', 4, weight, 'display' FROM ({WAVE_SQL}) w WHERE weight <= 24 AND used <= 60000 UNION ALL SELECT session, idx, 'full', 5, weight, 'prefetch' FROM ({WAVE_SQL}) w WHERE 5 * used <= 400000) q"""
)
def w8_prewarm_plan(spark, sf):
    return _adaptive(spark, sf).drop("rank")


def _adaptive(spark, sf):
    estimates = cat(spark, sf).select("folder", "idx", (F.col("size") * 5).alias("full_bytes"), F.col("size").alias("browse_bytes"))
    return prewarm.prewarm_plan(requests(spark, sf), visible(spark, sf), estimates)


PLACE_SQL = f"SELECT session, idx, weight, 2 * pos + 2 AS place, CASE WHEN zoomed AND ahead THEN 1 ELSE 0 END AS swap FROM ({AROUND_SQL}) a WHERE steps <= 1 AND idx <> current"
QUEUE_SQL = f"SELECT session, idx, weight, used, 1000000000 + 2 * weight + CASE WHEN ahead THEN 0 ELSE 1 END AS place FROM ({WAVE_SQL}) w"


@query(
    f"""SELECT session, idx, tier, row_number() OVER (PARTITION BY session ORDER BY class, distance, place) - 1 AS rank FROM (
 SELECT session, current AS idx, 'browse' AS tier, 0 AS class, 0 AS distance, 0 AS place FROM ({REQ_SQL}) r UNION ALL SELECT session, current, 'full', CASE WHEN zoomed THEN 0 ELSE 1 END, 0, 1 FROM ({REQ_SQL}) r
 UNION ALL SELECT session, idx, 'browse', 2, weight, place + swap FROM ({PLACE_SQL}) p UNION ALL SELECT session, idx, 'full', 2, weight, place + 1 - swap FROM ({PLACE_SQL}) p
 UNION ALL SELECT session, idx, 'browse', 4, weight, place FROM ({QUEUE_SQL}) w WHERE weight <= 24 AND used <= 60000 UNION ALL SELECT session, idx, 'full', 5, weight, place FROM ({QUEUE_SQL}) w WHERE 5 * used <= 400000) q"""
)
def w8_plan_ranks(spark, sf):
    return _adaptive(spark, sf).select("session", "idx", "tier", "rank")


@query(f"SELECT session, idx, tier, row_number() OVER (PARTITION BY session ORDER BY class, distance, place) - 1 AS rank FROM (SELECT session, idx, 'browse' AS tier, CASE WHEN steps <= 1 THEN 2 ELSE 4 END AS class, weight AS distance, 2 * pos + 2 AS place FROM ({AROUND_SQL}) a WHERE weight <= 24 AND idx <> current) q")
def t3_plan_order(spark, sf):
    plan = prewarm.fixed_plan(requests(spark, sf), visible(spark, sf)).filter("tier = 'browse' and class > 0").withColumnRenamed("rank", "_order")
    return prewarm.plan_order(plan).select("session", "idx", "tier", "rank")


@query(
    f"""SELECT session, idx, tier, class, distance FROM (
 SELECT session, current AS idx, 'browse' AS tier, 0 AS class, 0 AS distance FROM ({REQ_SQL}) r UNION ALL SELECT session, current, 'full', CASE WHEN zoomed THEN 0 ELSE 1 END, 0 FROM ({REQ_SQL}) r
 UNION ALL SELECT session, idx, 'browse', 2, weight FROM ({AROUND_SQL}) a WHERE steps <= 1 AND idx <> current UNION ALL SELECT session, idx, 'full', 3, weight FROM ({AROUND_SQL}) a WHERE steps <= 1 AND idx <> current
 UNION ALL SELECT session, idx, 'browse', 4, weight FROM ({AROUND_SQL}) a WHERE steps > 1 AND weight <= 24 AND idx <> current) q"""
)
def w9_fixed_plan(spark, sf):
    return prewarm.fixed_plan(requests(spark, sf), visible(spark, sf)).select("session", "idx", "tier", "class", "distance")


@query(f"SELECT key FROM (SELECT key, sum(bytes) OVER () AS total, sum(bytes) OVER (ORDER BY mtime_ns, key ROWS UNBOUNDED PRECEDING) - bytes AS before FROM ({d.OBJECTS_DUCKDB}) o) q WHERE total - before > 500000000")
def w10_retention_to_budget(spark, sf):
    return stores.retention_to_budget(d.derived(spark, sf, d.OBJECTS), 500_000_000).select("key")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 AND (event_id % 100) * 3600 >= 86400")
def w11_stale_temp_sweep(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    now = 1_800_000_000_000_000_000
    files = e.selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN '.shutterlake-' || event_id || '.tmp' ELSE event_id || '.jpg' END AS name", f"{now} - (event_id % 100) * 3600000000000 AS mtime_ns")
    return stores.stale_temp_sweep(files, now).select("event_id")


@query(f"SELECT owner, seq, rating FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq DESC) AS n FROM ({d.COMMANDS.replace('AS STRING', 'AS VARCHAR')}) c) q WHERE n = 1")
def w12_latest_command(spark, sf):
    return journal.latest_command(commands(spark, sf)).select("owner", "seq", "rating")


@query("SELECT CAST(user_id AS VARCHAR) AS path, CAST(sum(CASE WHEN event_id % 3 <> 2 OR event_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS revision FROM events GROUP BY user_id HAVING sum(CASE WHEN event_id % 3 <> 2 OR event_id % 2 = 0 THEN 1 ELSE 0 END) > 0")
def w13_revision_counters(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS seq", "CAST(user_id AS STRING) AS path", "element_at(array('insert', 'delete', 'update'), CAST(event_id % 3 AS INT) + 1) AS kind", "event_id % 2 = 0 AS changed")
    return journal.revision_counters(e, spark.createDataFrame([], "path string, revision bigint"))


@query("SELECT CAST(user_id AS VARCHAR) AS owner, count(*) AS revision, max(g) AS global_revision FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) AS g FROM events) q GROUP BY user_id")
def w13_owner_revisions(spark, sf):
    accepted = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS seq", "CAST(user_id AS STRING) AS owner", "md5(CAST(event_id AS STRING)) AS key")
    return journal.owner_revisions(accepted, spark.createDataFrame([], "owner string, revision bigint, global_revision bigint"))


STAR = dict(track=500.0, pixels_per_point=2.0, column=80.0, spacing=4.0)
STAR_SQL = f"SELECT folder, CAST(round(f * 1000) AS INTEGER) AS bucket, pos, abs(f * 500.0 - CAST(round(f * 1000) AS INTEGER) / 1000.0 * 500.0) AS dist FROM (SELECT v.folder, v.pos, least(greatest((v.pos * 84.0 + 40.0) / (count(*) OVER (PARTITION BY v.folder) * 84.0 - 4.0), 0), 1) AS f, r.rating FROM ({VIS_SQL}) v JOIN ({RATED_SQL}) r ON v.folder = r.folder AND v.idx = r.idx) q WHERE rating > 3"


def _markers(spark, sf):
    v = visible(spark, sf)
    stars = ratings.starred_positions(v, rated(spark, sf).filter("rating > 3").select("folder", "idx", "rating"))
    return views.star_marker_buckets(stars, v.groupBy("folder").agg(F.count("*").alias("total")), **STAR)


@query(f"SELECT folder, bucket, count(*) AS count, arg_min(pos, dist) AS pos FROM ({STAR_SQL}) s GROUP BY folder, bucket")
def a4_star_marker_buckets(spark, sf):
    return _markers(spark, sf).select("folder", "bucket", "count", "pos")


@query(f"SELECT folder, pos FROM (SELECT folder, pos, row_number() OVER (PARTITION BY folder ORDER BY abs(bucket / 1000.0 * 500.0 - 250.0), pos) AS k FROM (SELECT folder, bucket, arg_min(pos, dist) AS pos FROM ({STAR_SQL}) s GROUP BY folder, bucket) m WHERE abs(bucket / 1000.0 * 500.0 - 250.0) <= 40) q WHERE k = 1")
def w14_nearest_marker(spark, sf):
    return views.nearest_marker(_markers(spark, sf), 250.0, 40.0)


@query(f"SELECT folder, idx, pos FROM (SELECT *, count(*) OVER (PARTITION BY folder) AS n FROM ({VIS_SQL}) v) q WHERE pos >= CASE WHEN 11 > n THEN greatest(n - 9, 0) ELSE least(2, n) END - 1 AND pos < least(CASE WHEN 11 > n THEN n ELSE 11 END + 1, n)")
def t2_viewport_slice(spark, sf):
    return views.viewport_slice(visible(spark, sf), 200.0, 900.0, 80.0, 4.0, 1)


@query(f"SELECT folder, idx, row_number() OVER (PARTITION BY folder ORDER BY pos) - 1 AS pos FROM (SELECT folder, idx, min(pos) AS pos FROM (SELECT folder, idx * 3 % 40 AS idx, idx AS pos, count(*) OVER (PARTITION BY folder) AS len FROM ({CAT_SQL}) c) q WHERE idx < len GROUP BY folder, idx) z")
def p5_normalize_sequence(spark, sf):
    c = cat(spark, sf)
    return views.normalize_sequence(c.selectExpr("folder", "idx AS pos", "idx * 3 % 40 AS idx"), c.groupBy("folder").agg(F.count("*").alias("len")))


@query(f"SELECT doc_id, file_name || '|ISO ' || CAST(doc_id % 900 + 100 AS VARCHAR) AS info FROM ({CAT_SQL}) c")
def p4_image_info(spark, sf):
    photos = cat(spark, sf).selectExpr(
        "doc_id", "file_name", "size", "mtime_ns", "0 AS offset_seconds", "CAST(NULL AS struct<local:timestamp_ntz,subsecond:string,offset_seconds:int>) AS captured", "' \t ' AS camera",
        "CAST(NULL AS STRING) AS lens", "doc_id % 900 + 100 AS iso", "CAST(NULL AS STRING) AS shutter", "CAST(NULL AS STRING) AS aperture", "CAST(NULL AS FLOAT) AS focal_mm",
    )
    info = views.image_info(photos, ("file_name", "captured", "camera", "lens", "iso"), "minimal")
    return info.select("doc_id", F.array_join(F.transform("info", lambda x: x["text"]), "|").alias("info"))


INFO_SQL = f"""SELECT doc_id, file_name || CASE WHEN doc_id % 4 <> 0 THEN '|Shot ' || strftime(TIMESTAMP '2021-03-04 05:06:07' + INTERVAL 1 SECOND * doc_id, '%Y-%m-%d %H:%M:%S') || '.25 +01:30' ELSE '' END
 || '|Modified ' || strftime(make_timestamp(mtime_ns // 1000) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') || ' +02:00' || CASE WHEN doc_id % 3 <> 0 THEN '|Maker ' || doc_id % 7 ELSE '' END || '|Lens ' || doc_id % 5 || '|ISO ' || CAST(doc_id % 900 + 100 AS VARCHAR)
 || CASE WHEN doc_id % 6 = 0 THEN '' ELSE '|1/' || (doc_id % 50 + 2) END || '|f/' || printf('%.1f', (doc_id % 30 + 10) / 10.0) || '|' || (doc_id % 400 + 1) || CASE WHEN doc_id % 2 = 0 THEN ' mm' ELSE '.5 mm' END
 || '|' || CASE WHEN size >= 1000 THEN printf('%.1f KB', size / 1000.0) ELSE size || ' B' END AS info FROM ({CAT_SQL}) c"""


@query(INFO_SQL)
def p4_image_info_fields(spark, sf):
    """Every field, from EXIF values and listing, of which some are blank."""
    at = F.timestamp_add("SECOND", F.col("doc_id"), F.to_timestamp_ntz(F.lit("2021-03-04 05:06:07")))
    photos = cat(spark, sf).select(
        "doc_id", "file_name", "size", "mtime_ns", F.lit(7200).alias("offset_seconds"), F.when(F.col("doc_id") % 4 != 0, F.struct(at.alias("local"), F.lit("25").alias("subsecond"), F.lit(5400).alias("offset_seconds"))).alias("captured"),
        F.when(F.col("doc_id") % 3 == 0, " \t").otherwise(exif.camera(F.lit(" Maker"), F.concat(F.col("doc_id") % 7, F.lit("\t")))).alias("camera"), exif.lens(F.lit(" "), F.concat(F.lit("Lens "), F.col("doc_id") % 5)).alias("lens"), (F.col("doc_id") % 900 + 100).alias("iso"),
        exif.format_shutter(F.struct(F.when(F.col("doc_id") % 6 == 0, 0).otherwise(1).alias("n"), (F.col("doc_id") % 50 + 2).alias("d"))).alias("shutter"), exif.format_aperture(F.struct((F.col("doc_id") % 30 + 10).alias("n"), F.lit(10).alias("d"))).alias("aperture"),
        (F.col("doc_id") % 400 + 1 + F.col("doc_id") % 2 / 2).cast("float").alias("focal_mm"),
    )
    info = views.image_info(photos, labels="minimal")
    return info.select("doc_id", F.array_join(F.transform("info", lambda x: x["text"]), "|").alias("info"))


@query(f"SELECT folder, file_name, row_number() OVER (ORDER BY folder, file_name) - 1 AS place FROM ({CAT_SQL}) c")
def t1_order_catalog(spark, sf):
    """Each photo's place in the ordered catalogue, as the sorted partitions lie."""
    ordered = sources.order_catalog(cat(spark, sf).select("folder", "file_name"))
    # Ids grow with the partition and the row in it; only rows of one partition are numbered together. They are stored, as
    # Spark draws other ranges each time that it sorts.
    placed = ordered.withColumn("_id", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("_part", F.shiftright("_id", 33)))
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return placed.join(F.broadcast(before), "_part").select("folder", "file_name", (F.col("_before") + F.col("_id") - F.shiftleft(F.col("_part"), 33)).alias("place"))


# ---- stores, records, reconciliation

SEEN = "SELECT folder, idx, CASE WHEN doc_id % 3 = 0 THEN 'full' ELSE 'browse' END AS tier, size AS bytes, doc_id AS seq FROM ({}) c WHERE doc_id % 4 <> 0"


def _seen(spark, sf):
    return cat(spark, sf).filter("doc_id % 4 <> 0").selectExpr("folder", "idx", "CASE WHEN doc_id % 3 = 0 THEN 'full' ELSE 'browse' END AS tier", "size AS bytes", "doc_id AS seq")


@query(f"SELECT folder, CAST(0 AS BIGINT) AS thumb, CAST(sum(CASE WHEN tier = 'browse' THEN bytes ELSE 0 END) AS BIGINT) AS browse, CAST(sum(CASE WHEN tier = 'full' THEN bytes ELSE 0 END) AS BIGINT) AS \"full\", CAST(sum(bytes) AS BIGINT) AS rgba FROM ({SEEN.format(CAT_SQL)}) s GROUP BY folder")
def a5_store_bytes_by_tier(spark, sf):
    return stores.store_bytes_by_tier(_seen(spark, sf))


@query(
    f"""SELECT c.folder, c.idx, coalesce(CASE WHEN s.tier = 'full' THEN s.bytes END, CASE WHEN s.tier = 'browse' THEN s.bytes * 5 END, t.f, 268435456) AS full_bytes, coalesce(CASE WHEN s.tier = 'browse' THEN s.bytes END, t.b, 67108864) AS browse_bytes
 FROM ({CAT_SQL}) c LEFT JOIN ({SEEN.format(CAT_SQL)}) s ON c.folder = s.folder AND c.idx = s.idx
 LEFT JOIN (SELECT folder, max(CASE WHEN tier = 'full' THEN bytes ELSE bytes * 5 END) AS f, max(CASE WHEN tier = 'browse' THEN bytes END) AS b FROM ({SEEN.format(CAT_SQL)}) s2 GROUP BY folder) t ON c.folder = t.folder"""
)
def a6_size_estimates(spark, sf):
    return stores.size_estimates(cat(spark, sf), _seen(spark, sf))


@query("SELECT CAST(user_id % 20 AS BIGINT) AS grp, value AS median FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id % 20 ORDER BY value) AS n, count(*) OVER (PARTITION BY user_id % 20) AS c FROM events) q WHERE n = c // 2 + 1")
def a7_upper_median(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("grp", F.col("user_id") % 20)
    return benchmarks.upper_medians(e, ["grp"], {"median": F.col("value")})


def _records(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "CAST(user_id AS STRING) AS input_sha256", "CASE WHEN event_id % 2 = 0 THEN 'control' ELSE 'candidate' END AS variant",
        "CAST(CASE WHEN user_id % 5 = 0 THEN event_id % 2 ELSE 0 END AS STRING) AS output_sha256", "value AS total_ms", "event_type AS codec", "user_id % 3 AS fixture", "90 AS quality",
        "100 AS width", "50 AS height", "floor(value) + 1 AS encode_ms", "event_id AS bytes",
    )


@query(
    """SELECT codec, fixture, 90 AS quality, max(CASE WHEN ne = c // 2 + 1 THEN e END) AS encode_ms, max(CASE WHEN nb = c // 2 + 1 THEN event_id END) AS bytes FROM (SELECT event_type AS codec, user_id % 3 AS fixture, event_id, CAST(floor(value) + 1 AS BIGINT) AS e,
 row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY floor(value)) AS ne, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) AS nb, count(*) OVER (PARTITION BY event_type, user_id % 3) AS c FROM events) q GROUP BY codec, fixture"""
)
def a8_probe_summary(spark, sf):
    return benchmarks.probe_summary(_records(spark, sf)).drop("mp_per_s")


@query(
    """SELECT codec, fixture, max(CASE WHEN n = c // 2 + 1 THEN speed END) AS mp_per_s FROM (SELECT *, row_number() OVER (PARTITION BY codec, fixture ORDER BY speed) AS n, count(*) OVER (PARTITION BY codec, fixture) AS c
 FROM (SELECT event_type AS codec, user_id % 3 AS fixture, 5000 / CAST(1e6 AS DOUBLE) / ((floor(value) + 1) / CAST(1e3 AS DOUBLE)) AS speed FROM events) e) q GROUP BY codec, fixture"""
)
def a8_probe_speeds(spark, sf):
    return benchmarks.probe_summary(_records(spark, sf)).select("codec", "fixture", "mp_per_s")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS input_sha256, max(CASE WHEN v = 0 AND n = c // 2 + 1 THEN value END) AS control_ms, max(CASE WHEN v = 1 AND n = c // 2 + 1 THEN value END) AS candidate_ms FROM (SELECT user_id, value, event_id % 2 AS v,
 row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY value) AS n, count(*) OVER (PARTITION BY user_id, event_id % 2) AS c FROM events) q GROUP BY user_id
 HAVING sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) >= 3 AND sum(CASE WHEN v = 1 THEN 1 ELSE 0 END) >= 3 AND user_id % 5 <> 0"""
)
def a9_compare_records(spark, sf):
    return benchmarks.compare_records(_records(spark, sf))


M1_SQL = f"""WITH i AS (SELECT *, {TOKEN_SQL} AS token FROM ({IMG_SQL}) x), u AS (SELECT * FROM i WHERE sidecar_owner IS NULL), w AS (SELECT * FROM i WHERE sidecar_owner IS NOT NULL),
 bad AS (SELECT token FROM u WHERE NOT path_stable OR representation_collision OR derived_owner IS NULL UNION SELECT token FROM w WHERE owner_key_version < 8 AND NOT path_stable AND token IN (SELECT token FROM u WHERE sidecar_dirty))
SELECT u.path, CASE WHEN l.owner IS NOT NULL THEN CASE WHEN u.sidecar_dirty THEN 'quarantine' ELSE 'discard' END
 WHEN NOT u.path_stable OR u.representation_collision OR (u.sidecar_dirty AND b.token IS NOT NULL) THEN CASE WHEN u.sidecar_dirty THEN 'quarantine' ELSE 'discard' END
 WHEN n.c > 1 OR u.size % 2 = 1 OR (u.sidecar_dirty AND u.rating IS NULL) THEN CASE WHEN u.sidecar_dirty THEN 'quarantine' ELSE 'keep' END
 WHEN h.owner IS NOT NULL THEN CASE WHEN u.sidecar_dirty THEN 'quarantine' ELSE 'discard' END ELSE 'promote' END AS decision
FROM u LEFT JOIN ({LEDGER_SQL}) l ON l.owner = u.derived_owner LEFT JOIN (SELECT DISTINCT token FROM bad) b ON b.token = u.token
 LEFT JOIN (SELECT derived_owner, count(*) AS c FROM u GROUP BY derived_owner) n ON n.derived_owner = u.derived_owner
 LEFT JOIN (SELECT sidecar_owner AS owner FROM w GROUP BY sidecar_owner) h ON h.owner = u.derived_owner"""


def _ownerless(spark, sf):
    rows = img(spark, sf).withColumn("identity_matches", F.col("size") % 2 == 0)
    return rows.filter("sidecar_owner is null"), rows.filter("sidecar_owner is not null").withColumn("derived_owner", F.col("sidecar_owner"))


@query(M1_SQL)
def m1_reconcile_ownerless(spark, sf):
    ownerless, owned = _ownerless(spark, sf)
    return reconcile.reconcile_ownerless(ownerless, owned, owner_ledger(spark, sf)).select("path", "decision")


@query(
    f"""WITH w AS (SELECT *, {TOKEN_SQL} AS token FROM ({IMG_SQL}) x WHERE sidecar_owner IS NOT NULL) SELECT w.path, CASE WHEN owner_key_version >= 8 THEN 'keep'
 WHEN size % 2 = 0 AND path_stable AND n.c = 1 AND b.token IS NULL THEN 'rekey' WHEN sidecar_dirty THEN 'quarantine' ELSE 'discard' END AS decision
 FROM w LEFT JOIN (SELECT sidecar_owner, count(*) AS c FROM w GROUP BY sidecar_owner) n ON n.sidecar_owner = w.sidecar_owner
 LEFT JOIN (SELECT DISTINCT token FROM w WHERE owner_key_version < 8 AND (NOT path_stable OR representation_collision)) b ON b.token = w.token"""
)
def m2_rekey_owners(spark, sf):
    return reconcile.rekey_owners(_ownerless(spark, sf)[1]).select("path", "decision")


@query(f"SELECT path FROM ({IMG_SQL}) i UNION SELECT path FROM ({CAT_SQL}) c WHERE doc_id % 2 = 0")
def u1_path_history(spark, sf):
    return journal.path_history(img(spark, sf), cat(spark, sf).filter("doc_id % 2 = 0"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events")
def u2_dedup_paths(spark, sf):
    return journal.dedup_paths(spark.read.parquet(f"{sf}/events.parquet").selectExpr("CAST(user_id AS STRING) AS path"))


@query(f"SELECT path, 'added' AS change FROM ({CAT_SQL}) c WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0 UNION ALL SELECT path, 'removed' FROM ({CAT_SQL}) c WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def u3_pin_delta(spark, sf):
    c = cat(spark, sf)
    added, removed = journal.pin_delta(c.filter("doc_id % 2 = 0").select("path"), c.filter("doc_id % 3 = 0").select("path"))
    return added.withColumn("change", F.lit("added")).union(removed.withColumn("change", F.lit("removed")))


# ---- streams (the batch forms; tests compare the streams with them)


@query(
    f"""SELECT owner, seq, rating FROM (SELECT *, row_number() OVER (PARTITION BY owner, s ORDER BY seq DESC) AS k FROM (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY owner ORDER BY ts, seq) IS NULL OR ts > lag(ts) OVER (PARTITION BY owner ORDER BY ts, seq) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM ({d.COMMANDS.replace('AS STRING', 'AS VARCHAR')}) c) a) b) z WHERE k = 1"""
)
def r1_debounce_ratings(spark, sf):
    return streams.debounce_ratings(commands(spark, sf), "6 hours").select("owner", "seq", "rating")


FLUSHED = "SELECT 'lib' || CAST(user_id % 5 AS STRING) AS library, CAST(user_id AS STRING) AS owner, event_id AS seq, ts, CAST(floor(value) AS INT) % 6 AS rating, CASE WHEN event_id % 17 = 0 THEN 'flush' ELSE 'rate' END AS kind FROM events"
R2_SQL = f"""WITH c AS (SELECT *, sum(CASE WHEN kind = 'flush' THEN 1 ELSE 0 END) OVER (PARTITION BY library ORDER BY seq ROWS UNBOUNDED PRECEDING) AS f FROM ({FLUSHED.replace('STRING', 'VARCHAR')}) q),
 r AS (SELECT *, CASE WHEN lag(seq) OVER (PARTITION BY library, owner ORDER BY seq) IS NULL OR lag(f) OVER (PARTITION BY library, owner ORDER BY seq) <> f OR (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY library, owner ORDER BY seq) > 21600000 THEN 1 ELSE 0 END AS fresh FROM c WHERE kind = 'rate'),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY library, owner ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM r), l AS (SELECT *, row_number() OVER (PARTITION BY library, owner, s ORDER BY seq DESC) AS k FROM s)
SELECT l.library, l.owner, l.seq, l.rating, least((epoch_us(l.ts) // 1000) + 21600000, coalesce((epoch_us(m.ts) // 1000), (epoch_us(l.ts) // 1000) + 21600000)) AS due FROM l LEFT JOIN (SELECT library, f - 1 AS f, ts FROM c WHERE kind = 'flush') m ON m.library = l.library AND m.f = l.f WHERE l.k = 1"""


@query(R2_SQL)
def r2_debounce_with_flush(spark, sf):
    out = streams.debounce_with_flush(d.derived(spark, sf, FLUSHED), 6 * 3600 * 1000)
    return out.withColumn("due", F.unix_millis("due"))


@query("SELECT user_id % 10 AS f, user_id AS idx, rating FROM (SELECT user_id, CAST(floor(value) AS BIGINT) % 8 AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, least(CAST(floor(value) AS BIGINT) % 8, 5) AS rating FROM events WHERE CAST(floor(value) AS BIGINT) % 8 > 0) q WHERE n = 1")
def r3_first_metadata_fill(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id % 10 AS folder", "user_id AS idx", "event_id AS seq", "CAST(floor(value) AS BIGINT) % 8 AS rating")
    none = spark.createDataFrame([], "folder bigint, idx bigint, rating bigint")
    return streams.first_metadata_fill(e, none, none)[1].selectExpr("folder AS f", "idx", "rating")


LAYERS_SQL = """WITH e AS (SELECT user_id % 10 AS folder, user_id AS idx, event_id AS seq, CAST(floor(value) AS BIGINT) % 8 AS rating FROM events),
 m AS (SELECT folder, idx, arg_max(seq, seq) AS seq, arg_max(rating, seq) AS own FROM e GROUP BY folder, idx), f AS (SELECT folder, idx, arg_min(rating, seq) AS rating FROM e WHERE rating > 0 GROUP BY folder, idx),
 p AS (SELECT folder, idx, max(seq) % 6 AS rating FROM e WHERE idx % 3 = 0 GROUP BY folder, idx), x AS (SELECT folder, idx, min(seq) % 6 AS rating FROM e WHERE idx % 5 = 0 GROUP BY folder, idx)
SELECT m.folder, m.idx, m.seq, m.own, coalesce(x.rating, p.rating, least(f.rating, 5)) AS rating FROM m LEFT JOIN f ON f.folder = m.folder AND f.idx = m.idx LEFT JOIN p ON p.folder = m.folder AND p.idx = m.idx LEFT JOIN x ON x.folder = m.folder AND x.idx = m.idx"""


@query(LAYERS_SQL)
def r3_metadata_layers(spark, sf):
    """Metadata and ratings of photos of which some have a persisted or an explicit rating, 0 among them."""
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id % 10 AS folder", "user_id AS idx", "event_id AS seq", "CAST(floor(value) AS BIGINT) % 8 AS rating")
    persisted = e.filter("idx % 3 = 0").groupBy("folder", "idx").agg((F.max("seq") % 6).alias("rating"))
    explicit = e.filter("idx % 5 = 0").groupBy("folder", "idx").agg((F.min("seq") % 6).alias("rating"))
    meta, rated_ = streams.first_metadata_fill(e, persisted, explicit)
    return meta.select("folder", "idx", "seq", F.col("rating").alias("own")).join(rated_, ["folder", "idx"], "left")


@query("SELECT event_id FROM events WHERE event_id % 10 = 0")
def r4_metadata_failures(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("event_type", F.when(F.col("event_id") % 10 == 0, "failed").otherwise("ready"))
    return streams.metadata_failures(e)[1].select("event_id")


@query("SELECT e.event_id AS seq, CAST(e.user_id AS VARCHAR) AS owner FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS m FROM events WHERE event_id % 2 = 0 GROUP BY user_id) k ON k.user_id = e.user_id WHERE e.event_id % 2 = 1 AND (k.m IS NULL OR e.event_id > k.m)")
def r5_late_commands(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id AS seq", "CAST(user_id AS STRING) AS owner")
    return journal.late_commands(e.filter("seq % 2 = 1"), e.filter("seq % 2 = 0"))


@query(
    f"""SELECT path, rating, sidecar_dirty, sidecar_mtime_ns FROM (SELECT i.path, i.rating, i.sidecar_dirty, i.sidecar_mtime_ns FROM ({IMG_SQL}) i WHERE NOT EXISTS (SELECT 1 FROM ({CAT_SQL}) c WHERE c.doc_id % 4 = 0 AND c.sibling = 0 AND (c.path = i.path OR c.owner = i.sidecar_owner))
 UNION ALL SELECT c.path, 5 - c.doc_id % 6 AS rating, TRUE AS sidecar_dirty, coalesce(i.sidecar_mtime_ns, 0) AS sidecar_mtime_ns FROM ({CAT_SQL}) c LEFT JOIN ({IMG_SQL}) i ON c.path = i.path WHERE c.doc_id % 4 = 0 AND c.sibling = 0) q"""
)
def r6_journal(spark, sf):
    c = cat(spark, sf).filter("doc_id % 4 = 0 and sibling = 0")
    twice = c.selectExpr("doc_id AS seq", "owner", "path", "size", "mtime_ns", "0 AS rating").union(c.selectExpr("doc_id + 1 AS seq", "owner", "path", "size", "mtime_ns", "5 - doc_id % 6 AS rating"))
    return journal.journal_ratings(img(spark, sf), twice).select("path", "rating", "sidecar_dirty", "sidecar_mtime_ns")


# ---- pixels

# In the type of the values, as DuckDB reads its decimal literals beside a FLOAT (Spark's would make it a DOUBLE); limits come before
# the floor, where NaN is still the largest value.
PIX = "SELECT vec_id, transform(embedding, x -> CAST(floor(least(greatest((x + CAST(1.0 AS FLOAT)) * CAST(127.5 AS FLOAT), CAST(0 AS FLOAT)), CAST(255 AS FLOAT))) AS INT)) AS p FROM embeddings"


def _images(spark, sf):
    p = d.derived(spark, sf, PIX)
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    other = F.unhex(F.array_join(F.transform("p", lambda x: F.lpad(F.hex(F.call_function("div", x, F.lit(2))), 2, "0")), ""))
    image = lambda b: F.struct(F.lit(4).alias("width"), F.lit(4).alias("height"), b.alias("rgba"))
    mosaic = F.unhex(F.array_join(F.transform("p", lambda x: F.concat(F.lpad(F.hex(x), 2, "0"), F.lit("10"))), ""))
    return p.select("vec_id", "p", image(data).alias("a"), image(other).alias("b"), F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), mosaic.alias("cfa")).alias("m"))


def _bytes(image):
    return F.hex(image["rgba"])


PV = "list_transform(embedding, lambda x: CAST(least(greatest(floor((x + 1.0) * 127.5), 0), 255) AS INTEGER))"


@query(f"SELECT vec_id, max(CASE WHEN (i - 1) % 4 < 3 THEN v - v // 2 END) AS max_error, CAST(sum(CASE WHEN (i - 1) % 4 < 3 THEN (v - v // 2) * (v - v // 2) ELSE 0 END) AS BIGINT) AS squares FROM (SELECT vec_id, unnest({PV}) AS v, unnest(range(1, 65)) AS i FROM embeddings) q GROUP BY vec_id")
def a10_image_error_metrics(spark, sf):
    m = _images(spark, sf).select("vec_id", pixels.image_error_metrics(F.col("a"), F.col("b")).alias("e"))
    return m.select("vec_id", F.col("e.max_error").alias("max_error"), F.round(255 * 255 * 48 / F.pow(F.lit(10.0), F.col("e.psnr") / 10)).cast("bigint").alias("squares"))


@query(f"WITH q AS (SELECT vec_id, unnest({PV}) AS v, unnest(range(0, 64)) AS i FROM embeddings) SELECT a.vec_id, CAST(sum(abs((a.v - b.v) - (a.v // 2 - b.v // 2))) AS BIGINT) AS total FROM q a JOIN q b ON a.vec_id = b.vec_id AND a.i = b.i + 4 WHERE a.i % 4 < 3 AND a.i // 16 = b.i // 16 GROUP BY a.vec_id")
def a11_neighbor_delta_mae(spark, sf):
    return _images(spark, sf).select("vec_id", F.round(36 * pixels.neighbor_delta_mae(F.col("a"), F.col("b"))).cast("bigint").alias("total"))


@query()
def x1_normalize_cfa(spark, sf):
    four = lambda x: F.array(*[F.lit(float(x + i)) for i in range(4)])
    out = _images(spark, sf).select("vec_id", pixels.normalize_cfa(F.col("m"), four(4096), four(8192)).alias("n"))
    return out.select("vec_id", "n.width", "n.height", F.sha2("n.values", 256).alias("values_sha256"))


# Scaled sites of the mosaic in steps of 1/256: whole numbers, so every later product is exact.
LEVEL_SQL = f"SELECT vec_id, i, i // 8 % 2 * 2 + i % 2 AS c, i // 16 * 4 + i % 8 // 2 AS quad, greatest(v - (i // 8 % 2 * 2 + i % 2), 0) AS level FROM (SELECT vec_id, unnest({PV}) AS v, unnest(range(0, 64)) AS i FROM embeddings) q"
SITES_SQL = f"SELECT vec_id, quad, max(CASE WHEN c = 0 THEN level END) AS a, max(CASE WHEN c = 1 THEN level END) AS b, max(CASE WHEN c = 2 THEN level END) AS c, max(CASE WHEN c = 3 THEN level END) AS d FROM ({LEVEL_SQL}) l GROUP BY vec_id, quad"
RGB_SQL = f"SELECT vec_id, quad, CASE vec_id % 4 WHEN 0 THEN a WHEN 1 THEN d WHEN 2 THEN c ELSE b END / 256.0 AS r, CASE WHEN vec_id % 4 < 2 THEN b + c ELSE a + d END / 512.0 AS g, CASE vec_id % 4 WHEN 0 THEN d WHEN 1 THEN a WHEN 2 THEN b ELSE c END / 256.0 AS b FROM ({SITES_SQL}) s"
LINEAR_SQL = f"SELECT vec_id, quad, unnest([least(greatest(3.0 * r - 0.25 * g - 0.375 * b, 0), 1), least(greatest(1.75 * g - r - 0.375 * b, 0), 1), least(greatest(2.25 * b - 0.5 * g, 0), 1)]) AS x, unnest([0, 1, 2]) AS k FROM ({RGB_SQL}) p"
LIFT_SQL = f"SELECT vec_id, quad, k, {geometry.GAIN} * v / (1 + ({geometry.GAIN} - 1) * v) AS l FROM (SELECT vec_id, quad, k, floor(CAST(x AS FLOAT) * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) / CAST(65535 AS DOUBLE) AS v FROM ({LINEAR_SQL}) x) y"
GAMMA_SQL = f"SELECT vec_id, quad, k, CASE WHEN l <= 0.0031308 THEN 12.92 * l ELSE 1.055 * pow(l, 1 / CAST(2.4 AS DOUBLE)) - 0.055 END AS g FROM ({LIFT_SQL}) l"


def _pattern():
    """By the id's remainder, the last one without an id; negative ids have a remainder too."""
    return F.element_at(F.array(*map(F.lit, pixels.QUADS)), F.coalesce(F.pmod("vec_id", F.lit(4)) + 1, F.lit(4)).cast("int"))


def _scaled(spark, sf):
    four = lambda x: F.array(*[F.lit(float(x + i)) for i in range(4)])
    return _images(spark, sf).select("vec_id", pixels.normalize_cfa(F.col("m"), four(4096), four(4352)).alias("n"))


def _developed(spark, sf, upto):
    """RGB planes after quads are joined, and after calibration."""
    pattern = _pattern()
    rgb = _scaled(spark, sf).select("vec_id", pixels.superpixels(F.col("n"), pattern, F.array(*map(F.lit, (0, 0, 8, 8)))).alias("p"))
    if upto == "quads":
        return rgb
    gains, matrix = (F.array(*map(F.lit, x)) for x in ((2.0, 1.0, 1.5), (1.5, -0.25, -0.25, -0.5, 1.75, -0.25, 0.0, -0.5, 1.5)))
    return rgb.select("vec_id", pixels.calibrate(F.col("p"), gains, matrix).alias("p"))


def _steps(plane, scale):
    return F.array_join(F.transform(pixels.plane_values(plane), lambda x: (x * scale).cast("bigint")), ",")


@query(f"SELECT vec_id, string_agg(level, ',' ORDER BY i) AS levels FROM ({LEVEL_SQL}) l GROUP BY vec_id")
def x1_levels(spark, sf):
    return _scaled(spark, sf).select("vec_id", _steps(F.col("n"), 256).alias("levels"))


@query(f"SELECT vec_id, string_agg(CAST(512 * x AS BIGINT), ',' ORDER BY quad, k) AS rgb FROM (SELECT vec_id, quad, unnest([r, g, b]) AS x, unnest([0, 1, 2]) AS k FROM ({RGB_SQL}) p) q GROUP BY vec_id")
def x2_superpixels(spark, sf):
    return _developed(spark, sf, "quads").select("vec_id", _steps(F.col("p"), 512).alias("rgb"))


@query(f"SELECT vec_id, string_agg(CAST(8192 * x AS BIGINT), ',' ORDER BY quad, k) AS rgb FROM ({LINEAR_SQL}) q GROUP BY vec_id")
def x3_calibrate(spark, sf):
    return _developed(spark, sf, "calibrated").select("vec_id", _steps(F.col("p"), 8192).alias("rgb"))


@query(f"SELECT vec_id, string_agg(upper(lpad(to_hex(CAST(floor((g + {geometry.BLEND} * (g * g * (3 - 2 * g) - g)) * 255 + 0.5) AS BIGINT)), 2, '0')) || CASE WHEN k = 2 THEN 'FF' ELSE '' END, '' ORDER BY quad, k) AS rgba FROM ({GAMMA_SQL}) q GROUP BY vec_id")
def x4_pack_rgba(spark, sf):
    packed = _developed(spark, sf, "calibrated").select("vec_id", pixels.pack_rgba(F.col("p")).alias("i"))
    return packed.select("vec_id", _bytes(F.col("i")).alias("rgba"))


@query()
def x2_x8_develop_browse(spark, sf):
    four = lambda x: F.array(*[F.lit(float(x)) for _ in range(4)])
    camera = F.array(*[F.lit(x) for x in (1.4, -0.3, -0.1, -0.2, 1.3, -0.1, 0.0, -0.4, 1.4)])
    dev = pixels.develop_browse(F.col("m"), _pattern(), F.array(*map(F.lit, (1, 1, 6, 6))), four(4096), four(4351), four(1.5), camera)
    return _images(spark, sf).select("vec_id", dev.alias("i")).select("vec_id", "i.width", "i.height", _bytes(F.col("i")).alias("rgba"))


# Quads of the area from 1, 1 on, six sites wide and high: each colour lies across in its quad.
CROP_SQL = f"SELECT vec_id, (i // 8 - 1) // 2 * 3 + (i % 8 - 1) // 2 AS quad, (i // 8 - 1) % 2 * 2 + (i % 8 - 1) % 2 AS c, level FROM ({LEVEL_SQL}) l WHERE i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6"
CROP_SITES_SQL = f"SELECT vec_id, quad, max(CASE WHEN c = 0 THEN level END) AS a, max(CASE WHEN c = 1 THEN level END) AS b, max(CASE WHEN c = 2 THEN level END) AS c, max(CASE WHEN c = 3 THEN level END) AS d FROM ({CROP_SQL}) l GROUP BY vec_id, quad"
CROP_RGB_SQL = f"SELECT vec_id, quad, CASE vec_id % 4 WHEN 0 THEN d WHEN 1 THEN a WHEN 2 THEN b ELSE c END / 256.0 AS r, CASE WHEN vec_id % 4 < 2 THEN b + c ELSE a + d END / 512.0 AS g, CASE vec_id % 4 WHEN 0 THEN a WHEN 1 THEN d WHEN 2 THEN c ELSE b END / 256.0 AS b FROM ({CROP_SITES_SQL}) s"


@query(SQL["x4_pack_rgba"].replace(RGB_SQL, CROP_RGB_SQL).replace("SELECT vec_id, string_agg", "SELECT vec_id, 3 AS width, 3 AS height, string_agg", 1))
def x8_develop_crop(spark, sf):
    """A cropped area from mosaic to opaque image in one step; levels and matrix are exact in binary."""
    four = lambda x: F.array(*[F.lit(float(x + i)) for i in range(4)])
    pattern = _pattern()
    area, gains, matrix = (F.array(*map(F.lit, x)) for x in ((1, 1, 6, 6), (2.0, 1.0, 1.5), (1.5, -0.25, -0.25, -0.5, 1.75, -0.25, 0.0, -0.5, 1.5)))
    made = _images(spark, sf).select("vec_id", pixels.develop_browse(F.col("m"), pattern, area, four(4096), four(4352), gains, matrix).alias("i"))
    return made.select("vec_id", "i.width", "i.height", _bytes(F.col("i")).alias("rgba"))


@query(f"SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY j) AS rgba FROM (SELECT vec_id, v, CASE vec_id % 2 WHEN 0 THEN (15 - (i - 1) // 4) * 4 + (i - 1) % 4 ELSE ((i - 1) // 4 % 4 * 4 + 3 - (i - 1) // 16) * 4 + (i - 1) % 4 END AS j FROM (SELECT vec_id, unnest({PV}) AS v, unnest(range(1, 65)) AS i FROM embeddings) q) z GROUP BY vec_id")
def x5_rotate(spark, sf):
    turned = pixels.rotate(F.col("a"), F.when(F.col("vec_id") % 2 == 0, "R180").otherwise("R90"))
    shown = F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda k: F.conv(F.substring(F.hex(F.col("r.rgba")), k, F.lit(2)), 16, 10))
    return _images(spark, sf).select("vec_id", turned.alias("r")).select("vec_id", F.when(F.col("r").isNotNull(), F.array_join(shown, ",")).alias("rgba"))


@query(
    f"""SELECT vec_id, 2 AS width, 2 AS height, string_agg(upper(lpad(to_hex(value), 2, '0')), '' ORDER BY r, c, k) AS rgba FROM (
 SELECT vec_id, r, c, k, greatest(least((2 * n + 58564) // 117128, 255), 0) AS value FROM (SELECT vec_id, o.r, o.c, i % 4 AS k, CAST(sum(v * (CASE WHEN o.r = 0 THEN [111, 111, 29, -9] ELSE [-9, 29, 111, 111] END)[i // 16 + 1] * (CASE WHEN o.c = 0 THEN [111, 111, 29, -9] ELSE [-9, 29, 111, 111] END)[i // 4 % 4 + 1]) AS BIGINT) AS n
 FROM (SELECT vec_id, unnest({PV}) AS v, unnest(range(0, 64)) AS i FROM embeddings) q CROSS JOIN (SELECT unnest([0, 0, 1, 1]) AS r, unnest([0, 1, 0, 1]) AS c) o GROUP BY vec_id, o.r, o.c, i % 4) s) z GROUP BY vec_id"""
)
def x6_downscale(spark, sf):
    return _images(spark, sf).select("vec_id", pixels.downscale(F.col("a"), 2).alias("i")).select("vec_id", "i.width", "i.height", _bytes(F.col("i")).alias("rgba"))


@query(f"SELECT vec_id, TRUE AS valid, min(CASE WHEN (i - 1) % 4 = 3 THEN v END) = 255 AS opaque FROM (SELECT vec_id, unnest({PV}) AS v, unnest(range(1, 65)) AS i FROM embeddings) q GROUP BY vec_id")
def x7_validate_pixels(spark, sf):
    return _images(spark, sf).select("vec_id", pixels.validate_pixels(F.col("a")).alias("v")).select("vec_id", "v.valid", "v.opaque")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '4:4:4' WHEN 1 THEN 'other' END AS sampling FROM documents")
def f23_jpeg_sampling(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    head = lambda s: f"FFD8FFE00004AAAAFFC0001108001000100301{s}00021100031100FFD9"
    data = F.unhex(F.when(F.col("doc_id") % 3 == 0, head("11")).when(F.col("doc_id") % 3 == 1, head("22")).otherwise("FFD8FFE0FFFF"))
    return docs.select("doc_id", pixels.jpeg_sampling(data).alias("j")).select("doc_id", "j.sampling")


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN CASE WHEN doc_id % 2 = 0 THEN '4:4:4' ELSE 'other' END END AS sampling FROM documents")
def f23_jpeg_comments(spark, sf):
    """Headers that carry the whole text in comments before the frame; every third is cut in the last comment."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_t", F.coalesce(F.hex("text"), F.lit("")))
    starts = F.sequence(F.lit(0), F.call_function("div", F.length("_t"), F.lit(120_000)))
    part = lambda i: F.substring(F.col("_t"), i * 120_000 + 1, F.lit(120_000))
    comment = F.transform(starts, lambda i: F.concat(F.lit("FFFE"), F.lpad(F.hex(F.call_function("div", F.length(part(i)), F.lit(2)) + 2), 4, "0"), part(i)))
    frame = F.concat(F.lit("FFC000110800100010030111"), F.when(F.col("doc_id") % 2 == 0, "00021100").otherwise("00022200"), F.lit("031100FFD9"))
    data = F.unhex(F.concat(F.lit("FFD8"), F.array_join(comment, ""), F.when(F.col("doc_id") % 3 == 2, "FFFE0009AA").otherwise(frame)))
    return docs.select("doc_id", pixels.jpeg_sampling(data).alias("j")).select("doc_id", "j.sampling")
