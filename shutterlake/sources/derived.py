"""Catalogue inputs derived from the given tables, by SQL that other engines run as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG = """
SELECT doc_id, folder, file_name, folder || '/' || file_name AS path, folder || '/' || stem || '.xmp' AS owner, size, mtime_ns, sibling FROM (
 SELECT doc_id, sibling, '/lib/d' || lpad(CAST(k % 37 AS STRING), 2, '0') AS folder, stem,
  CASE WHEN doc_id % 17 = 5 THEN '.' ELSE '' END || stem || CASE WHEN doc_id % 19 = 7 THEN '.JPG' WHEN sibling = 1 THEN '.DNG' WHEN doc_id % 2 = 0 THEN '.ARW' ELSE '.arw' END AS file_name,
  n_chars AS size, 1700000000000000000 + doc_id * 1000003 AS mtime_ns
 FROM (SELECT doc_id, n_chars, sibling, k, 'IMG' || lpad(CAST(CAST((k - k % 37) / 37 AS BIGINT) AS STRING), 6, '0') AS stem
  FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS sibling, doc_id - CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS k FROM documents) a) b) c
"""

IMAGES = f"""
SELECT c.path, c.size + CASE WHEN c.doc_id % 7 = 3 THEN 1 ELSE 0 END AS size, c.mtime_ns, CASE WHEN c.doc_id % 11 = 0 THEN NULL ELSE c.doc_id % 6 END AS rating,
 c.mtime_ns + (c.doc_id % 3 - 1) * 1000 AS sidecar_mtime_ns, l.toxic = 1 AS sidecar_dirty, c.doc_id % 29 = 4 AS sidecar_quarantined,
 CASE WHEN c.sibling = 1 OR c.doc_id % 5 = 4 THEN NULL ELSE c.owner END AS sidecar_owner, c.doc_id % 31 <> 9 AS path_stable,
 CASE WHEN c.sibling = 1 OR c.doc_id % 5 = 4 THEN c.owner END AS derived_owner, c.doc_id % 41 = 11 AS representation_collision, 7 + c.doc_id % 2 AS owner_key_version
 FROM ({CATALOG}) c JOIN labels l ON c.doc_id = l.doc_id
"""

SIDECARS = f"SELECT owner, mtime_ns AS sidecar_mtime_ns, doc_id % 6 AS true_rating, doc_id % 4 AS form FROM ({CATALOG}) c WHERE sibling = 0 AND doc_id % 3 <> 1"

COMMANDS = "SELECT event_id AS seq, ts, '/lib/u/P' || lpad(CAST(user_id AS STRING), 6, '0') || '.xmp' AS owner, CAST(floor(value) AS INT) % 6 AS rating FROM events"

OBJECTS = """
SELECT sha2(CAST(l_orderkey AS STRING) || '|' || CAST(l_linenumber AS STRING) || '|' || CAST(l_partkey AS STRING) || '|' || CAST(l_suppkey AS STRING) || '|' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), 256) AS key,
 CAST(round(l_extendedprice) AS BIGINT) AS bytes, CAST(datediff(l_shipdate, DATE '1990-01-01') AS BIGINT) AS mtime_ns FROM lineitem
"""
OBJECTS_DUCKDB = OBJECTS.replace("sha2(", "sha256(").replace(", 256) AS key", ") AS key").replace("datediff(l_shipdate, DATE '1990-01-01')", "date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))")

TABLES = ("documents", "labels", "events", "lineitem", "embeddings")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **used)


def xml_of(form: str = "form", rating: str = "true_rating") -> str:
    """The document of a sidecar: attribute, element, cut, or without a rating."""
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/"'
    tail = "</rdf:RDF></x:xmpmeta>"
    return (
        f"CASE {form} WHEN 0 THEN '{head} xmp:Rating=\"' || CAST({rating} AS STRING) || '\"/>{tail}' "
        f"WHEN 1 THEN '{head}><xmp:Rating>' || CAST({rating} AS STRING) || '</xmp:Rating></rdf:Description>{tail}' "
        f"WHEN 2 THEN '{head} xmp:Rating=\"3\"><cut>' ELSE '{head}/>{tail}' END"
    )
