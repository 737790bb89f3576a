"""Streams give what the batch forms give."""

import datetime as dt
import pathlib
import random
import time

from pyspark.sql import functions as F

from shutterlake import schemas
from shutterlake.operators import journal
from shutterlake.sources import parts
from shutterlake.streaming import ratings as streams

START = dt.datetime(2024, 1, 1)


def rows(*items):
    return [(i, START + dt.timedelta(milliseconds=ms), lib, owner, kind, r) for i, (ms, lib, owner, kind, r) in enumerate(items)]


SCHEMA = "seq bigint, ts timestamp, library string, owner string, kind string, rating int"
ITEMS = rows(
    (0, "l", "a", "rate", 1), (300, "l", "a", "rate", 2), (350, "l", "b", "rate", 3), (1100, "l", "a", "rate", 4), (1150, "l", None, "flush", None), (1200, "l", "a", "rate", 5),
    (1250, "m", "c", "rate", 1), (5000, "l", "b", "rate", 2),
)
FAR = [(99, START + dt.timedelta(days=400), "z", "z", "rate", 0)]


def run(spark, frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path, items):
    for k, part in enumerate((items, FAR, FAR)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))


def test_debounce(spark, tmp_path):
    rates = [r for r in ITEMS if r[4] == "rate"]
    want = {(r["owner"], r["seq"], r["rating"]) for r in streams.debounce_ratings(spark.createDataFrame(rates, SCHEMA)).collect()}
    assert want == {("a", 1, 2), ("b", 2, 3), ("a", 5, 5), ("c", 6, 1), ("b", 7, 2)}
    out = run(spark, streams.debounce_ratings(source(spark, tmp_path, rates), delay="1 second"), "debounced")
    assert {(r["owner"], r["seq"], r["rating"]) for r in out.collect() if r["owner"] != "z"} == want


def test_flush(spark, tmp_path):
    batch = streams.debounce_with_flush(spark.createDataFrame(ITEMS, SCHEMA))
    want = {(r["library"], r["owner"], r["seq"], r["rating"], r["due"]) for r in batch.select("library", "owner", "seq", "rating", F.unix_millis("due").alias("due")).collect()}
    ms = lambda x: int((START - dt.datetime(1970, 1, 1)).total_seconds() * 1000) + x
    assert want == {("l", "a", 1, 2, ms(700)), ("l", "b", 2, 3, ms(750)), ("l", "a", 3, 4, ms(1150)), ("l", "a", 5, 5, ms(1600)), ("m", "c", 6, 1, ms(1650)), ("l", "b", 7, 2, ms(5400))}
    out = run(spark, streams.debounce_with_flush_stream(source(spark, tmp_path, ITEMS)), "flushed")
    assert {(r["library"], r["owner"], r["seq"], r["rating"]) for r in out.collect() if r["owner"] != "z"} == {w[:4] for w in want}


def test_late(spark, tmp_path):
    parts = [[(3, "a", 1), (5, "a", 2)], [(4, "a", 3), (5, "a", 4), (6, "a", 5), (1, "b", 6)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "seq bigint, owner string, rating int").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema("seq bigint, owner string, rating int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = run(spark, streams.late_commands_stream(stream), "late")
    assert {(r["owner"], r["seq"]) for r in out.collect()} == {("a", 3), ("a", 5), ("a", 6), ("b", 1)}


def test_journal(spark, tmp_path):
    kind = "seq bigint, owner string, path string, size bigint, mtime_ns bigint, rating int"
    parts = [[(1, "o", "p", 1, 1, 2), (2, "o", "p", 1, 1, 3)], [(3, "o", "q", 1, 1, 4), (4, "n", "r", 1, 1, 5)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    q = streams.journal_stream(stream, spark.createDataFrame([], schemas.IMAGES), str(tmp_path / "state"), str(tmp_path / "check"))
    q.awaitTermination(120)
    folder = spark.read.text(str(tmp_path / "state" / "after" / "1")).first()[0]
    assert {(r["path"], r["rating"]) for r in spark.read.parquet(f"{folder}/images").collect()} == {("q", 4), ("r", 5)}


def test_metadata(spark):
    kind = "folder string, idx int, seq int, event_type string, rating int, camera string"
    events = spark.createDataFrame([("f", 0, 1, "ready", 0, "x"), ("f", 0, 2, "ready", 9, "y"), ("f", 0, 3, "ready", 1, "z"), ("f", 1, 1, "failed", None, None), ("f", 2, 1, "ready", 3, "x")], kind)
    ready, failed = streams.metadata_failures(events)
    assert failed.count() == 1
    some = spark.createDataFrame([("f", 2, 0)], "folder string, idx int, rating int")
    meta, ratings = streams.first_metadata_fill(ready, some, some.limit(0))
    assert {r["idx"]: r["camera"] for r in meta.collect()} == {0: "z", 2: "x"}
    assert {r["idx"]: r["rating"] for r in ratings.collect()} == {0: 5, 2: 0}


def test_metadata_stream_over_restarts(spark, tmp_path):
    kind = "folder string, idx int, seq int, event_type string, rating int, camera string"
    rng = random.Random(4)
    events = [(f"f{rng.randrange(3)}", rng.randrange(12), seq, "ready", rng.choice([None, 0, 0, 3, 9]), f"c{seq}") for seq in range(240)]
    persisted = spark.createDataFrame([("f0", 1, 0), ("f1", 2, 4), ("f2", 3, None)], "folder string, idx int, rating int")
    explicit = spark.createDataFrame([("f0", 1, 5), ("f2", 5, 0), ("f1", 40, 2)], "folder string, idx int, rating int")
    layers = lambda: persisted.union(explicit)
    root = str(tmp_path / "out")
    for run_ in range(3):  # the same checkpoint each time
        for k in range(2):
            at = (2 * run_ + k) * 40
            spark.createDataFrame(events[at : at + 40], kind).coalesce(1).write.parquet(str(tmp_path / f"in{run_}{k}"))
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
        assert streams.first_metadata_fill_stream(stream, layers, root, str(tmp_path / "check")).awaitTermination(180)
    meta, rated = streams.filled_metadata(spark, root, persisted, explicit)
    want_meta, want_rated = streams.first_metadata_fill(spark.createDataFrame(events, kind), persisted, explicit)
    rows_of = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    assert rows_of(meta) == rows_of(want_meta)
    assert rows_of(rated) == rows_of(want_rated)
    fills = spark.read.parquet(f"{root}/fills")
    assert fills.count() == fills.select("folder", "idx").distinct().count() > 10
    assert fills.join(layers().filter("rating is not null"), ["folder", "idx"]).count() == 0


COMMAND = "seq bigint, owner string, path string, size bigint, mtime_ns bigint, rating int"


def images_of(n):
    return [(f"/l/{i}.ARW", i, i, i % 6, i * 10, False, False, None if i % 7 == 3 else f"/l/{i}.xmp") for i in range(n)]


def test_journal_in_parts(spark, tmp_path):
    rng = random.Random(1)
    images = spark.createDataFrame(images_of(300), schemas.IMAGES)
    batches = [[(k * 20 + j, f"/l/{rng.choice([i, i + 1])}.xmp", f"/l/{i}.ARW", 1, 1, rng.randrange(6)) for j, i in enumerate(rng.sample(range(320), 20))] for k in range(4)]
    root, want, counted = str(tmp_path / "state"), images, spark.createDataFrame([], schemas.OWNER_REVISIONS)
    for k, part in enumerate(batches):
        frame = spark.createDataFrame(part, COMMAND)
        frame.coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        want = spark.createDataFrame(journal.journal_ratings(want, frame).collect(), schemas.IMAGES)
        counted = spark.createDataFrame(journal.owner_revisions(frame, counted, 20 * k, tie="path").collect(), schemas.OWNER_REVISIONS)
    stream = spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    assert streams.journal_parts_stream(stream, images, root, str(tmp_path / "check"), parts=8).awaitTermination(300)
    got, owners = streams.journal_state(spark, root)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert sorted(map(tuple, owners.collect())) == sorted(map(tuple, counted.select(owners.columns).collect()))
    # Only the last manifests and what they name are left.
    assert parts.batches(spark, root) == [1, 2, 3]
    live = {f for n in (1, 2, 3) for f in parts.read_manifest(spark, root, n)[0].values()}
    left = {str(p.relative_to(root)) for p in pathlib.Path(root).glob("batch=*/*/part=*")}
    assert left == live


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    root = str(tmp_path / "state")
    streams.start_parts(spark.createDataFrame(images_of(2000), schemas.IMAGES), root, 32)
    streams.start_parts(spark.createDataFrame([], schemas.IMAGES), root, 32)  # it is there
    one = spark.createDataFrame([(1, "/l/5.xmp", "/l/5.ARW", 1, 1, 4), (2, "/l/new.xmp", "/l/5.ARW", 1, 1, 4)], COMMAND)
    streams.journal_batch(one.filter("seq = 1"), root, 0, 32)
    before, after = (parts.read_manifest(spark, root, n)[0] for n in (-1, 0))
    changed = [k for k in after if before.get(k) != after[k]]
    assert {t for t, _ in changed} == {"images", "paths", "owners"} and len(changed) == 3
    size = lambda pattern: sum(f.stat().st_size for f in pathlib.Path(root).glob(pattern))
    assert 8 * size("batch=0/**/*.parquet") < size("batch=-1/**/*.parquet")
    # The path's row lies with its old owner; the batch finds it there.
    streams.journal_batch(one.filter("seq = 2"), root, 1, 32)
    images, owners = streams.journal_state(spark, root)
    whole = sorted(map(tuple, images.collect()))
    assert [r[-1] for r in whole if r[0] == "/l/5.ARW"] == ["/l/new.xmp"] and len(whole) == 2000
    assert {(r["owner"], r["global_revision"]) for r in owners.collect()} == {("/l/5.xmp", 1), ("/l/new.xmp", 2)}
    # Run again, a batch changes nothing; without its manifest it gives the same one.
    text = (tmp_path / "state/manifest/1.json").read_text()
    streams.journal_batch(one.filter("seq = 1"), root, 1, 32)
    assert (tmp_path / "state/manifest/1.json").read_text() == text
    (tmp_path / "state/manifest/1.json").unlink()
    streams.journal_batch(one.filter("seq = 2"), root, 1, 32)
    assert (tmp_path / "state/manifest/1.json").read_text() == text
    assert sorted(map(tuple, streams.journal_state(spark, root)[0].collect())) == whole


def test_settling_takes_steps_in_proportion(spark):
    def steps(n):
        rows = [(i // 50, i, f"o{i}", 1) for i in range(n)] + [(n // 50 + 10, n, None, None)]
        out, taken = streams.settle({}, rows, 400)
        assert len(out) == n and [o[3] for o in out] == sorted(o[3] for o in out)
        return taken

    assert steps(20_000) <= 2.1 * steps(10_000)


def test_flush_of_a_large_library(spark, tmp_path):
    n = 100_000
    frame = spark.range(n + 1).selectExpr(
        "id AS seq", f"timestamp_millis(1704067200000 + if(id = {n}, 1100, id div 100)) AS ts", "'l' AS library", f"if(id = {n}, NULL, concat('o', id % {n // 2})) AS owner",
        f"if(id = {n}, 'flush', 'rate') AS kind", f"if(id = {n}, NULL, CAST(id % 6 AS INT)) AS rating",
    )
    for k, part in enumerate((frame, spark.createDataFrame(FAR, SCHEMA), spark.createDataFrame(FAR, SCHEMA))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = run(spark, streams.debounce_with_flush_stream(stream, parts=8), "large").filter("library = 'l'")
    keys = ["owner", "seq", "rating", "due"]
    got = {tuple(r) for r in out.selectExpr("owner", "seq", "rating", "due_ms AS due").collect()}
    want = {tuple(r) for r in streams.debounce_with_flush(frame).withColumn("due", F.unix_millis("due")).select(keys).collect()}
    assert got == want


def test_late_rows_are_counted(spark, tmp_path):
    """Two owners' commands of one time are two late rows; each is counted once."""
    counts = streams.LateCounts()
    spark.streams.addListener(counts)
    on_time = rows(*[(i * 100, "l", f"o{i % 4}", "rate", i % 6) for i in range(40)])
    late = [(100 + i, START + dt.timedelta(milliseconds=50), "l", "o1" if i < 3 else "o2", "rate", 1) for i in range(7)] + [on_time[0]]
    for k, part in enumerate((on_time, on_time[-2:], late, FAR, FAR)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = run(spark, streams.debounce_ratings(streams.commands_in_time(stream, "1 second")), "counted").filter("owner <> 'z'")
    want = streams.debounce_ratings(spark.createDataFrame(on_time, SCHEMA))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    kind = "seq bigint, owner string, rating int"
    for k, part in enumerate([[(3, "a", 1), (5, "a", 2)], [(4, "a", 3), (5, "a", 4), (6, "a", 5), (1, "b", 6)], [(2, "b", 1), (2, "b", 2), (1, "b", 3)]]):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"seq{k}"))
    run(spark, streams.late_commands_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "seq*"))), "judged")
    for _ in range(50):  # progress is told a little later
        table = counts.table(spark).groupBy("query").agg(F.sum("dropped").alias("dropped"), F.sum("late").alias("late")).collect()
        if sorted((r["dropped"], r["late"]) for r in table) == [(0, 4), (8, 0)]:
            break
        time.sleep(0.2)
    spark.streams.removeListener(counts)
    assert sorted((r["dropped"], r["late"]) for r in table) == [(0, 4), (8, 0)]
