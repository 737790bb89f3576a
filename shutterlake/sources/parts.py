"""Tables in parts, with a manifest for each batch.

A batch writes the parts that it touches into a folder of its own; its manifest names the
folder of every part, most of them older ones. A manifest is moved into place when all its
parts are written, so readers see whole batches, and a batch that runs again either finds
its manifest or writes the same folders anew. Folders that no manifest names any longer are
removed after the new one is in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manifests that stay: the newest, and those that readers may still hold or a batch that
#: runs again may start from.
KEEP = 3

Entries = dict[tuple[str, int], str]


def place(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches with a manifest, in order."""
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{root}/manifest") if n.endswith(".json"))


def read_manifest(spark: SparkSession, root: str, n: int) -> tuple[Entries, int]:
    """Folders (below ``root``) by table and part, and the counter stored with them."""
    lines = [json.loads(r[0]) for r in spark.read.text(f"{root}/manifest/{n}.json").collect()]
    return {(x["table"], x["part"]): x["folder"] for x in lines[1:]}, lines[0]["counter"]


def put_manifest(spark: SparkSession, root: str, n: int, entries: Entries, counter: int) -> None:
    lines = [{"counter": counter}, *({"table": t, "part": p, "folder": f} for (t, p), f in sorted(entries.items()))]
    fs, draft = _path(spark, f"{root}/manifest/.{n}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray("\n".join(map(json.dumps, lines)).encode()))
    out.close()
    fs.rename(draft, _path(spark, f"{root}/manifest/{n}.json")[1])


def write_parts(frame: DataFrame, root: str, n: int, table: str) -> Entries:
    """Writes the frame's parts (column ``part``) as those of batch n."""
    folder = f"batch={n}/{table}"
    frame.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/{folder}")
    return {(table, int(p.removeprefix("part="))): f"{folder}/{p}" for p in _names(frame.sparkSession, f"{root}/{folder}") if p.startswith("part=")}


def read_parts(spark: SparkSession, root: str, entries: Entries, table: str, schema: str, parts: set[int] | None = None) -> DataFrame:
    """The table, or those of its parts."""
    folders = [f"{root}/{f}" for (t, p), f in sorted(entries.items()) if t == table and (parts is None or p in parts)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def expire(spark: SparkSession, root: str, keep: int = KEEP) -> list[str]:
    """Removes all but the last manifests, and what only the removed ones name."""
    known = batches(spark, root)
    old, new = known[:-keep], known[-keep:]
    if not old:
        return []
    live = {f for n in new for f in read_manifest(spark, root, n)[0].values()}
    gone = sorted({f for n in old for f in read_manifest(spark, root, n)[0].values()} - live)
    # Folders first: if this run ends here, the manifests still tell the next one what to remove.
    for name in [*gone, *(f"manifest/{n}.json" for n in old)]:
        fs, path = _path(spark, f"{root}/{name}")
        fs.delete(path, True)
    return gone
