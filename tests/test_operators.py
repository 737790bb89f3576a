"""Rules, precedence tables and small models of the operators."""

import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from shutterlake import schemas
from shutterlake.operators import benchmarks, journal, ratings, reconcile, stores, views
from shutterlake.plans import prewarm
from shutterlake.sources import catalog as sources
from shutterlake.sources import files

IMAGES = schemas.IMAGES


def photos(spark, *names):
    rows = [("/f", n, f"/f/{n}", f"/f/{n.rsplit('.', 1)[0]}.xmp", 10, 100, i) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, schemas.CATALOG + ", idx int")


def test_files_through_the_manifest(spark, tmp_path):
    root = str(tmp_path / "out")
    due = spark.createDataFrame([(f"/photos of {i}/é {i}.xmp", None if i % 3 else "<cut", i % 6) for i in range(40)], "owner string, xml string, rating int")
    manifest = files.publish_sidecars(sources.sidecar_documents(due), root).collect()
    assert len(manifest) == 26 and {r["file"].count("/") for r in manifest} == {2}
    want = {f"/photos of {i}/é {i}.xmp": i % 6 for i in range(40) if i % 3}
    assert {r["owner"]: r["rating"] for r in files.published_ratings(spark, root).collect()} == want
    # Published again the files are the same ones; damaged and missing ones are told.
    assert sorted(files.publish_sidecars(sources.sidecar_documents(due), root).collect()) == sorted(manifest)
    assert len([p for p in (tmp_path / "out/files").rglob("*") if p.is_file()]) == 26
    first, second = sorted(r["file"] for r in manifest)[:2]
    (tmp_path / "out" / first).write_text("other")
    (tmp_path / "out" / second).unlink()
    assert [(r["ok"], r["content"] is None) for r in files.read_files(spark, root).filter("not ok").orderBy(F.col("content").isNull()).collect()] == [(False, False), (False, True)]


def image(name, rating, dirty=False, owner=True, mtime=500, size=10, quarantined=False):
    return (f"/f/{name}", size, 100, rating, mtime, dirty, quarantined, f"/f/{name.rsplit('.', 1)[0]}.xmp" if owner else None)


def resolved(spark, names, images, notes=()):
    notes = spark.createDataFrame(list(notes), "owner string, sidecar_mtime_ns bigint, rating smallint")
    out = ratings.resolve_ratings(photos(spark, *names), spark.createDataFrame(images, IMAGES), notes)
    return {r["path"][3:]: r["rating"] for r in out.collect()}


def test_listing(spark):
    """Two extensions in any case, regular files, not hidden; order is by bytes."""
    listed = [("zebra.arw", True, 5), ("Zebra.DnG", True, 6), ("roll 7.ARw", True, 7), ("_cut.dng", True, 8), ("dng", True, 1), ("x.arw.bak", True, 1), ("x.nef", True, 1), (".arw", True, 1), (".trash.dng", True, 1), ("folder.dng", False, 1)]
    rows = spark.createDataFrame([("/f", n, ok, s, None if s == 5 else s * 11) for n, ok, s in listed], schemas.LISTING)
    out = sources.order_catalog(sources.catalog_from_listing(rows).withColumnRenamed("name", "file_name")).collect()
    assert [(r["file_name"], r["size"], r["mtime_ns"]) for r in out] == [("Zebra.DnG", 6, 66), ("_cut.dng", 8, 88), ("roll 7.ARw", 7, 77), ("zebra.arw", 5, 0)]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("x.ARW", ".h.arw", "y.jpg"):
        (tmp_path / "a" / n).write_bytes(b"abc")
    (tmp_path / "a" / "x.xmp").write_text('<d:Description xmlns:d="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://ns.adobe.com/xap/1.0/" x:Rating="4"/>')
    (tmp_path / "a" / "z.xmp").write_bytes(b"\xff\xfeRating")
    out = sources.scan_catalog(spark, str(tmp_path)).collect()
    assert [(r["file_name"], r["size"]) for r in out] == [("x.ARW", 3)]
    assert {r["owner"].rsplit("/", 1)[1]: r["rating"] for r in sources.read_sidecars(spark, str(tmp_path)).collect()} == {"x.xmp": 4, "z.xmp": None}
    folder = sources.write_state({"images": spark.createDataFrame([image("a.ARW", 3)], IMAGES)}, str(tmp_path / "s"))
    assert sources.read_state(spark, folder, "images")["images"].first()["rating"] == 3
    (tmp_path / "r.json").write_text('{"schema_version": 1, "variant": "control", "total_ms": 2.5, "stages": [{"name": "a", "ms": 1}]}\n{"schema_version": 2}\n')
    record = sources.read_develop_records(spark, str(tmp_path / "r.json")).collect()
    assert len(record) == 1 and record[0]["stages"][0]["ms"] == 1.0
    sources.write_sidecars(spark.createDataFrame([("o", None, 3)], "owner string, xml string, rating int"), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).first()["status"] == "new"


def test_precedence(spark):
    names = [f"{n}.ARW" for n in ("current", "stale", "row", "note", "broken", "nothing")]
    images = [image("current.ARW", 2), image("stale.ARW", 1), image("row.ARW", 3), image("broken.ARW", 2)]
    notes = [("/f/current.xmp", 500, 5), ("/f/stale.xmp", 499, 4), ("/f/note.xmp", 1, 0), ("/f/broken.xmp", 900, None)]
    assert resolved(spark, names, images, notes) == {"current.ARW": 5, "stale.ARW": 1, "row.ARW": 3, "note.ARW": 0, "broken.ARW": 2}


@pytest.mark.parametrize(
    "images,want",
    [
        ([image("photo.ARW", 4)], 4),
        ([image("photo.ARW", 5, dirty=True), image("photo.DNG", 2, owner=False)], 5),
        ([image("photo.ARW", 5), image("photo.DNG", 2, owner=False)], 5),
        ([image("photo.DNG", 3, owner=False)], 3),
        ([image("photo.ARW", 2, owner=False), image("photo.DNG", 5, owner=False)], None),
        ([image("photo.ARW", 2, owner=False, dirty=True), image("photo.DNG", 2, owner=False)], None),
        ([image("photo.ARW", 2, owner=False, dirty=True)], 2),
        ([image("photo.ARW", None, dirty=True)], None),
        ([image("photo.ARW", 4, quarantined=True)], None),
        ([image("photo.ARW", 4, size=11)], None),
    ],
)
def test_siblings(spark, images, want):
    assert resolved(spark, ["photo.ARW", "photo.DNG"], images) == ({} if want is None else {"photo.ARW": want, "photo.DNG": want})


def test_dirty_fallback_hides_sidecar_and_rejection_prefers_it(spark):
    rows = [image("photo.ARW", 2, owner=False, dirty=True), image("photo.DNG", 2, owner=False)]
    assert resolved(spark, ["photo.ARW", "photo.DNG"], rows, [("/f/photo.xmp", 9999, 4)]) == {}
    images = spark.createDataFrame([(*image("photo.ARW", 2, owner=False), "/f/photo.xmp", False)], IMAGES + ", derived_owner string, path_stable boolean")
    notes = spark.createDataFrame([("/f/photo.xmp", 1, 4)], "owner string, sidecar_mtime_ns bigint, rating smallint")
    assert [r["rating"] for r in ratings.resolve_ratings(photos(spark, "photo.ARW"), images, notes).collect()] == [4]


def test_photo_without_owner(spark):
    alone = photos(spark, "a.ARW", "b.ARW").withColumn("owner", F.lit(None).cast("string"))
    images = spark.createDataFrame([image("a.ARW", 3, dirty=True), image("b.ARW", 3)], IMAGES)
    notes = spark.createDataFrame([("/f/a.xmp", 900, 1), ("/f/b.xmp", 900, 1)], "owner string, sidecar_mtime_ns bigint, rating smallint")
    assert {r["path"]: r["rating"] for r in ratings.resolve_ratings(alone, images, notes).collect()} == {"/f/a.ARW": 3, "/f/b.ARW": 1}


def test_layers(spark):
    layer = lambda d: spark.createDataFrame([("f", k, v) for k, v in d.items()], "folder string, idx int, rating int")
    out = ratings.merge_rating_layers(layer({0: 5, 1: 4}), layer({0: 1, 2: 9, 3: 0}), layer({1: 0, 3: 2}))
    assert {r["idx"]: r["rating"] for r in out.collect()} == {0: 5, 1: 0, 2: 5, 3: 2}


def test_members_and_crossing(spark):
    c = photos(spark, "a.ARW", "a.DNG", "b.ARW")
    had = spark.createDataFrame([("/f/a.ARW", 1), ("/f/b.ARW", 5)], "path string, rating int")
    after, crossed = ratings.rate_with_members(c, had, spark.createDataFrame([("/f/a.DNG", 3)], "path string, rating int"), 3)
    assert {r["path"]: r["rating"] for r in after.collect()} == {"/f/a.ARW": 3, "/f/a.DNG": 3, "/f/b.ARW": 5}
    assert crossed.first()["crossed"]


def order_model(n, start):
    out, ahead, back = [start], start + 1, start - 1
    while len(out) < n:
        for _ in range(3):
            if ahead < n:
                out.append(ahead)
                ahead += 1
        if back >= 0:
            out.append(back)
            back -= 1
    return out


def test_outward_order(spark):
    cases = [(n, s, i) for n in range(1, 45) for s in range(0, n, 3) for i in range(n)]
    frame = spark.createDataFrame(cases, "n int, start int, idx int")
    got = {}
    for r in prewarm.outward_order(frame).collect():
        got.setdefault((r["n"], r["start"]), {})[r["rank"]] = r["idx"]
    for (n, s), ranks in got.items():
        assert [ranks[k] for k in range(n)] == order_model(n, s)
    assert order_model(10, 3)[:5] == [3, 4, 5, 6, 2]


def plan_model(n, order, current, direction, zoomed, size, full_budget, browse_budget):
    """A walk over places, for whole folders of equal sizes or given ones."""
    at = order.index(current) if current in order else 0
    out = [(0, 0, current, "browse"), (0 if zoomed else 1, 0, current, "full")]
    weigh = lambda p: abs(p - at) * (1 if (p > at) == (direction >= 0) else 3)
    ahead_of = lambda p: (p > at) == (direction >= 0)
    beside = [p for p in (at - 1, at, at + 1) if 0 <= p < len(order) and order[p] != current]
    for p in beside:
        pair = [(2, weigh(p), order[p], "browse"), (2, weigh(p), order[p], "full")]
        out += pair[::-1] if zoomed and ahead_of(p) else pair
    wave = sorted((p for p in range(len(order)) if abs(p - at) >= 2), key=lambda p: (weigh(p), not ahead_of(p)))
    for tier, klass, budget, factor in (("browse", 4, browse_budget, 1), ("full", 5, full_budget, 5)):
        used = factor * (size[current] + sum(size[order[p]] for p in beside))
        for p in wave:
            if tier == "browse" and weigh(p) > 24:
                break
            used += factor * size[order[p]]
            if used > budget:
                break
            out.append((klass, weigh(p), order[p], tier))
    return sorted(out, key=lambda x: x[:2])


def test_prewarm_plan(spark):
    rng = random.Random(5)
    cases, rows, shown, sizes = [], [], [], []
    for k in range(40):
        n = rng.randint(1, 60)
        order = sorted(rng.sample(range(n), rng.randint(1, n))) if k % 2 else list(range(n))
        size = [rng.randint(1, 200) for _ in range(n)]
        case = (n, order, rng.choice(order), rng.choice([-1, 0, 1]), rng.random() < 0.5, size, rng.randint(0, 8000), rng.randint(0, 3000))
        cases.append(case)
        rows.append((f"s{k}", f"f{k}", case[2], case[3], case[4], case[6], case[7]))
        shown += [(f"f{k}", p, i) for p, i in enumerate(order)]
        sizes += [(f"f{k}", i, 5 * size[i], size[i]) for i in range(n)]
    plan = prewarm.prewarm_plan(
        spark.createDataFrame(rows, "session string, folder string, current int, direction int, zoomed boolean, full_budget bigint, browse_budget bigint"),
        spark.createDataFrame(shown, "folder string, pos int, idx int"), spark.createDataFrame(sizes, "folder string, idx int, full_bytes bigint, browse_bytes bigint"),
    )
    got = {}
    for r in plan.orderBy("session", "rank").collect():
        got.setdefault(r["session"], []).append((r["class"], r["distance"], r["idx"], r["tier"]))
    for k, case in enumerate(cases):
        assert got[f"s{k}"] == plan_model(*case), case


def test_full_targets(spark):
    request = spark.createDataFrame([("s", "f", 50, 1, False, 700, 400)], "session string, folder string, current int, direction int, zoomed boolean, full_budget bigint, browse_budget bigint")
    shown = spark.range(100).selectExpr("'f' AS folder", "CAST(id AS INT) AS pos", "CAST(id AS INT) AS idx")
    plan = prewarm.prewarm_plan(request, shown, shown.selectExpr("folder", "idx", "100 AS full_bytes", "100 AS browse_bytes"), spark.createDataFrame([("f", 100)], "folder string, len int"))
    rows = plan.orderBy("rank").collect()
    assert sorted((r["idx"], r["distance"]) for r in rows if r["tier"] == "full") == [(49, 3), (50, 0), (51, 1), (52, 2), (53, 3), (54, 4), (55, 5)]
    assert [r["idx"] for r in rows if r["tier"] == "browse" and r["kind"] != "warm"] == [50, 51, 49, 52]
    assert sum(r["kind"] == "warm" for r in rows) == 100 - 1 - 24 - 8


def test_budgets_end_within_their_reach(spark):
    """Requests at all places of folders, with budgets from nothing to more than all."""
    rng = random.Random(7)
    shown = [(f"f{n}", p, p * 2) for n in (1, 2, 5, 40) for p in range(n)]
    sizes = [(f, i, rng.choice([0, 1, 5, 50]), 1) for f, _, i in shown if rng.random() < 0.9]
    asked = [(f"{f}-{k}", f, rng.choice([i, i + 1]), rng.choice([1, -1]), False, rng.choice([0, 7, 60, 300, 10_000]), 0) for k, (f, _, i) in enumerate(shown)]
    visible = spark.createDataFrame(shown, "folder string, pos int, idx int")
    bytes_ = spark.createDataFrame(sizes, "folder string, idx int, full_bytes bigint, browse_bytes bigint")
    requests = spark.createDataFrame(asked, "session string, folder string, current int, direction int, zoomed boolean, full_budget bigint, browse_budget bigint").withColumn("_full", F.lit(3))
    every = prewarm.around(requests, visible).join(bytes_, ["folder", "idx"]).filter("idx <> current and steps > 1")
    want = prewarm.budget_prefix(every, "full_budget", "_full", "full_bytes").groupBy("session").agg(F.max("weight").alias("w"), F.count("*").alias("n"))
    sized = visible.join(bytes_, ["folder", "idx"], "left")
    placed = prewarm.placed_requests(requests, visible)
    reach = prewarm.budget_reach(placed, prewarm.with_sums(sized, "full_bytes"), "full_budget", "_full")
    near = prewarm._near(placed.join(reach, "session"), sized.filter("full_bytes is not null"), F.col("reach"), F.col("last"))
    got = prewarm.budget_prefix(near.filter("idx <> current and steps > 1"), "full_budget", "_full", "full_bytes").groupBy("session").agg(F.max("weight").alias("w"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # What is joined follows the plan: a small budget in a large folder joins few places.
    large = spark.range(20_000).selectExpr("'g' AS folder", "CAST(id AS INT) AS pos", "CAST(id AS INT) AS idx", "10L AS full_bytes")
    one = prewarm.placed_requests(requests.limit(1).selectExpr("'s' AS session", "'g' AS folder", "9000 AS current", "1 AS direction", "500L AS full_budget", "3 AS _full"), large)
    reach = prewarm.budget_reach(one, prewarm.with_sums(large, "full_bytes"), "full_budget", "_full")
    assert 37 <= reach.first()["reach"] <= 80
    assert prewarm._near(one.join(reach, "session"), large, F.col("reach"), F.col("last")).count() <= 110


def test_retention(spark, monkeypatch):
    three = spark.createDataFrame([("a", 1000, 1), ("b", 1000, 2), ("c", 1000, 3)], "key string, bytes bigint, mtime_ns bigint")
    assert [r["key"] for r in stores.retention_to_budget(three, 2500).collect()] == ["a"]
    assert not stores.retention_to_budget(three, 3000).count()
    monkeypatch.setattr(stores, "RANGE_ROWS", 40)
    rng = random.Random(2)
    rows = [(f"{rng.getrandbits(64):016x}", rng.randint(1, 50), rng.choice([7, 7, 7, rng.randint(0, 40)])) for _ in range(700)]
    frame = spark.createDataFrame(rows, "key string, bytes bigint, mtime_ns bigint")
    for budget in (0, 3000, 9000):
        left, gone = sum(r[1] for r in rows), set()
        for key, size, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            if left > budget:
                gone.add(key)
                left -= size
        assert {r["key"] for r in stores.retention_to_budget(frame, budget).collect()} == gone


def test_object_names(spark):
    rows = spark.createDataFrame([("ab", "ab" + "0" * 62 + ".jpg"), ("ac", "ab" + "0" * 62 + ".jpg"), ("ab", "abc.jpg")], "s string, n string")
    assert [r[0] for r in rows.select(stores.is_object(F.col("s"), F.col("n"))).collect()] == [True, False, False]


def test_journal(spark):
    images = spark.createDataFrame([image("a.ARW", 1), ("/g/a.ARW", 1, 1, 2, 7, False, False, "/f/a.xmp"), image("b.ARW", 2)], IMAGES)
    commands = spark.createDataFrame([(1, "/f/a.xmp", "/f/a.ARW", 10, 100, 4), (2, "/f/a.xmp", "/f/a.ARW", 10, 100, 5)], "seq bigint, owner string, path string, size bigint, mtime_ns bigint, rating int")
    out = {r["path"]: (r["rating"], r["sidecar_dirty"], r["sidecar_mtime_ns"]) for r in journal.journal_ratings(images, commands).collect()}
    assert out == {"/f/a.ARW": (5, True, 500), "/f/b.ARW": (2, False, 500)}
    twice = spark.createDataFrame([image("a.ARW", 1, dirty=True), ("/g/a.ARW", 1, 1, 2, 7, True, False, "/f/a.xmp")], IMAGES)
    with pytest.raises(journal.ConflictError):
        journal.pending_sidecars(twice)


def test_revisions(spark):
    events = spark.createDataFrame([(1, "p", "insert", True), (2, "p", "update", True), (3, "p", "update", True), (4, "p", "complete", False), (5, "p", "update", True), (6, "p", "complete", False), (7, "p", "update", True), (8, "p", "delete", True)], "seq int, path string, kind string, changed boolean")
    out = journal.revision_counters(events, spark.createDataFrame([("q", 4)], "path string, revision bigint"))
    assert {r["path"]: r["revision"] for r in out.collect()} == {"p": 6, "q": 4}


def test_compare_and_set(spark):
    now = spark.createDataFrame([("p", "o", True, 3, 2)], "path string, owner string, present boolean, image_revision int, owner_revision int")
    seen = [(1, "p", "o", True, 3, 1), (2, "p", "o", True, 2, 2), (3, "p", "o", False, 3, 2), (4, "p", "x", True, 3, 2), (5, "p", "o", True, 3, 2), (6, "p", "o", True, 3, 2)]
    proposals = spark.createDataFrame(seen, "seq int, path string, owner string, seen_present boolean, seen_image_revision int, seen_owner_revision int")
    assert [r["seq"] for r in journal.compare_and_set_owner(proposals, now).collect()] == [5]


def test_outcomes_applied(spark):
    images = spark.createDataFrame([image(f"{n}.ARW", 3, dirty=True) for n in "abcd"], IMAGES)
    outcomes = spark.createDataFrame([("/f/a.ARW", "written", 900), ("/f/b.ARW", "owner_changed", None), ("/f/c.ARW", "discarded", None), ("/f/d.ARW", "write_failed", None)], "path string, outcome string, sidecar_mtime_ns bigint")
    left, archive = journal.apply_outcomes(images, images.limit(0), outcomes)
    assert {r["path"]: (r["sidecar_dirty"], r["sidecar_mtime_ns"]) for r in left.collect()} == {"/f/a.ARW": (False, 900), "/f/d.ARW": (True, 500)}
    assert [r["path"] for r in archive.collect()] == ["/f/b.ARW"]


def test_reconcile(spark):
    base = IMAGES + ", derived_owner string, path_stable boolean, representation_collision boolean, identity_matches boolean, owner_key_version int"
    row = lambda n, dirty, owner, stable=True, same=True, rating=3: (f"/f/{n}", 10, 100, rating, 5, dirty, False, None, owner, stable, False, same, 7)
    rows = [row("led.ARW", True, "L"), row("unst.ARW", False, "U", False), row("null.ARW", False, None), row("two.ARW", True, "T"), row("two2.ARW", False, "T"), row("diff.ARW", False, "D", same=False), row("held.ARW", False, "H"), row("good.ARW", True, "G"), row("none.ARW", True, "N", rating=None)]
    owned = spark.createDataFrame([("/g/held.ARW", 1, 1, 1, 5, False, False, "H", "H", True, False, True, 8)], base)
    out = reconcile.reconcile_ownerless(spark.createDataFrame(rows, base), owned, spark.createDataFrame([("L", 1)], "owner string, revision bigint"))
    want = {"led": "quarantine", "unst": "discard", "null": "keep", "two": "quarantine", "two2": "keep", "diff": "keep", "held": "discard", "good": "promote", "none": "quarantine"}
    assert {r["path"][3:-4]: r["decision"] for r in out.collect()} == want
    rows, revisions = reconcile.promoted(out, spark.createDataFrame([("G", 4)], "owner string, revision bigint"))
    assert rows.first()["sidecar_owner"] == "G" and revisions.first()["revision"] == 5


def test_medians(spark):
    rows = spark.createDataFrame([("a", x) for x in (4, 1, 3, 2)] + [("b", 5)], "k string, x int")
    assert {r["k"]: r["m"] for r in rows.groupBy("k").agg(benchmarks.upper_median(F.col("x")).alias("m")).collect()} == {"a": 3, "b": 5}


def test_medians_of_large_groups(spark, monkeypatch):
    """A hot group is cut into ranges and never held as one array."""
    monkeypatch.setattr(benchmarks, "FEW", 50)
    rows = [("hot", 1 + i * 7919 % 1000 // 3) for i in range(3000)] + [("even", x) for x in (4, 1, 3, 2)] + [(None, 5), ("one", 9), ("gaps", None), ("gaps", 8), ("none", None)]
    got = benchmarks.upper_medians(spark.createDataFrame(rows, "k string, x int"), ["k"], {"m": F.col("x")}).collect()
    want = {k: sorted(x for j, x in rows if j == k and x is not None) for k in {k for k, _ in rows}}
    assert len(got) == 5 and {r["k"]: r["m"] for r in got} == {k: v[len(v) // 2] for k, v in want.items() if v}
    probe = [(k, 1, 90, 10, 10, x, x) for k, x in rows]
    out = benchmarks.probe_summary(spark.createDataFrame(probe, "codec string, fixture int, quality int, width int, height int, encode_ms int, bytes int"))
    assert out.columns == ["codec", "fixture", "quality", "encode_ms", "mp_per_s", "bytes"]
    assert {r["codec"]: r["encode_ms"] for r in out.collect()} == {k: v[len(v) // 2] if v else None for k, v in want.items()}
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_medians_of_wide_values(spark, monkeypatch):
    """Sizes from the least to the largest numbers, infinities, NaN and repeated ones."""
    monkeypatch.setattr(benchmarks, "FEW", 5)
    monkeypatch.setattr(benchmarks, "DIGITS", 8)
    rng = random.Random(3)
    groups = {
        "wide": [10.0 ** rng.randint(-300, 300) for _ in range(400)], "signs": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-9, 9) for _ in range(301)], "same": [2.5] * 90,
        "ends": [math.inf] * 40 + [-math.inf] * 20 + [1.7e308, -1.7e308] * 5, "nan": [math.nan] * 30 + [1.0, 2.0], "close": [1e15 + i for i in range(200)],
    }
    rows = [(k, x) for k, own in groups.items() for x in own]
    got = {r["k"]: (r["x"], r["n"]) for r in benchmarks.upper_medians(spark.createDataFrame(rows, "k string, x double"), ["k"], {"x": F.col("x"), "n": F.lit(7)}).collect()}
    want = {k: sorted(own, key=lambda x: (math.isnan(x), x))[len(own) // 2] for k, own in groups.items()}
    assert {k: str(x) for k, (x, _) in got.items()} == {k: str(x) for k, x in want.items()} and all(n == 7 for _, n in got.values())


def test_markers_and_slices(spark):
    stars = spark.createDataFrame([("f", p) for p in (0, 1, 2, 9)], "folder string, pos int")
    total = spark.createDataFrame([("f", 10)], "folder string, total int")
    out = views.star_marker_buckets(stars, total, 4.0, 1.0, 10.0, 0.0).orderBy("bucket").collect()
    assert [(r["bucket"], r["count"], r["pos"]) for r in out] == [(0, 1, 0), (1, 2, 2), (4, 1, 9)]
    shown = spark.range(10).selectExpr("'f' AS folder", "CAST(id AS INT) AS pos")
    cells = lambda *a: sorted(r["pos"] for r in views.viewport_slice(shown, *a).collect())
    assert cells(25.0, 45.0, 10.0, 0.0, 0) == [2, 3, 4] and cells(25.0, 45.0, 10.0, 0.0, 1) == [1, 2, 3, 4, 5] and cells(500.0, 530.0, 10.0, 0.0, 0) == [7, 8, 9]


def test_navigate(spark):
    shown = spark.createDataFrame([("f", i, p) for p, i in enumerate((2, 5, 7))], "folder string, idx int, pos int")
    steps = [(5, 1), (5, -1), (5, 9), (4, 1), (4, -1), (9, 1), (0, -1), (4, 0)]
    out = views.navigate(shown, spark.createDataFrame([("f", c, d) for c, d in steps], "folder string, current int, delta int"))
    got = {(r["current"], r["delta"]): r["target"] for r in out.collect()}
    assert [got[s] for s in steps] == [7, 2, 7, 5, 2, 7, 2, 5]


def test_running_sum_over_many_ranges(spark, monkeypatch):
    """Many partitions, and one value that holds a third of all rows."""
    monkeypatch.setattr(stores, "RANGE_ROWS", 7)
    rng = random.Random(4)
    rows = [(500 if i % 3 == 0 else rng.choice([rng.randint(-9, 9), 10**15 + i, rng.randint(0, 1000)]), f"{rng.randrange(16**4):04x}{i:04d}", rng.randint(0, 50)) for i in range(400)]
    for part in (rows, rows[:3], []):
        got = {r["key"]: r["before"] for r in stores.running_sum(spark.createDataFrame(part, "at bigint, key string, n bigint"), "n", "at", "key", "before").collect()}
        total, want = 0, {}
        for _, key, n in sorted(part):
            want[key] = total
            total += n
        assert got == want


def test_running_sum_of_one_time_and_paths(spark, monkeypatch):
    """All rows share one value and their keys a long prefix: partitions still share the work."""
    monkeypatch.setattr(stores, "RANGE_ROWS", 100)
    frame = spark.range(3000).selectExpr("7L AS at", "'/library/of/one/owner/IMG' || lpad(id * 7919 % 3000, 8, '0') AS key", "id % 9 AS n")
    out = stores.running_sum(frame, "n", "at", "key", "before")
    total, want = 0, {}
    for r in frame.orderBy("key").collect():
        want[r["key"]] = total
        total += r["n"]
    assert {r["key"]: r["before"] for r in out.collect()} == want
    assert out.columns == ["at", "key", "n", "before"]
    placed = [d for d in pathlib.Path(spark.conf.get("spark.checkpoint.dir")).iterdir() if d.is_dir()]
    newest = max(placed, key=lambda d: d.stat().st_mtime)
    sizes = [r["count"] for r in spark.read.parquet(str(newest)).groupBy("_part").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400


def test_flushes_in_ranges(spark, monkeypatch):
    from shutterlake.streaming import ratings as streams

    rng = random.Random(5)
    rows, at = [], 0
    for seq in range(300):
        at += rng.choice([1, 100, 500])
        flush = rng.random() < 0.1
        rows.append((seq * 3, at, rng.choice("xy") if seq % 2 else "hot", None if flush else rng.choice("abc"), "flush" if flush else "rate", rng.randint(0, 5)))
    frame = spark.createDataFrame(rows, "seq bigint, ms bigint, library string, owner string, kind string, rating int").withColumn("ts", F.timestamp_millis("ms"))
    once = sorted(map(tuple, streams.debounce_with_flush(frame).collect()))
    monkeypatch.setattr(streams, "RANGE_ROWS", 10)
    assert sorted(map(tuple, streams.debounce_with_flush(frame).collect())) == once and len(once) > 50
