"""Ratings: one value for each photo out of journal, sidecars, snapshots and files.

An absent rating is NULL and differs from 0, a known "unrated". Photos that share a sidecar
(its owner) share their rating. Nanosecond times are BIGINT throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.paths import collision_token, sidecar_path


def identity_match(row: str, file: str) -> Column:
    """A stored row speaks of the file only if size and time both agree."""
    return F.coalesce((F.col(f"{row}.size") == F.col(f"{file}.size")) & (F.col(f"{row}.mtime_ns") == F.col(f"{file}.mtime_ns")), F.lit(False))


def passes(rating: Column, minimum: int, unrated_only: bool) -> Column:
    known = F.coalesce(rating, F.lit(0))
    return known == 0 if unrated_only else known >= minimum


def rating_filter(photos: DataFrame, minimum: int = 0, unrated_only: bool = False) -> DataFrame:
    """Photos that pass; all of a folder's photos where none does."""
    each = photos.withColumn("_pass", passes(F.col("rating"), minimum, unrated_only))
    marked = each.withColumn("_any", F.max("_pass").over(Window.partitionBy("folder")))
    return marked.filter(F.col("_pass") | ~F.col("_any")).drop("_pass", "_any")


def owner_groups(catalog: DataFrame) -> DataFrame:
    """owner, members (sorted idx) of owners with two photos or more; unresolved ones never group."""
    groups = catalog.filter("owner is not null").groupBy("owner").agg(F.sort_array(F.collect_list("idx")).alias("members"))
    return groups.filter(F.size("members") >= 2)


def unanimous_rating(rating: Column) -> Column:
    """An aggregate: the rating if all have one and the same."""
    return F.when((F.count(F.lit(1)) == F.count(rating)) & (F.min(rating) == F.max(rating)), F.min(rating))


def newest_db_sidecar(match: Column, sidecar_mtime_ns: Column) -> Column:
    """An aggregate: the latest sidecar time of matching rows, 0 without any."""
    return F.coalesce(F.max(F.when(match, sidecar_mtime_ns)), F.lit(0))


def rejected_history(images: DataFrame) -> DataFrame:
    """Distinct tokens of ownerless rows whose path is unstable or names no owner; the rows
    have ``derived_owner`` and ``path_stable``."""
    unsafe = images.filter("sidecar_owner is null and not sidecar_quarantined and (not path_stable or derived_owner is null)")
    return unsafe.select(collision_token(F.col("path")).alias("token")).distinct()


def separate_history(images: DataFrame, owner_revisions: DataFrame) -> DataFrame:
    """Rows without those ownerless ones whose derived owner has a ledger entry of its own;
    an older spelling equal to the entry (``legacy_owner``) is exempt."""
    legacy = F.col("i.legacy_owner") if "legacy_owner" in images.columns else F.lit(None).cast("string")
    own = F.col("i.sidecar_owner").isNull() & (F.col("i.derived_owner") == F.col("r.owner")) & ~F.coalesce(legacy == F.col("r.owner"), F.lit(False))
    return images.alias("i").join(owner_revisions.alias("r"), own, "left_anti")


def _with_derived(images: DataFrame) -> DataFrame:
    if "derived_owner" not in images.columns:
        images = images.withColumn("derived_owner", F.when(F.col("sidecar_owner").isNull(), sidecar_path(F.col("path"))))
    return images if "path_stable" in images.columns else images.withColumn("path_stable", F.lit(True))


def resolve_ratings(catalog: DataFrame, images: DataFrame, sidecars: DataFrame, unlisted: DataFrame | None = None) -> DataFrame:
    """path, rating of every photo that has one.

    ``sidecars``: owner, sidecar_mtime_ns, rating (null: unreadable, as if absent).
    ``unlisted``: path, size, mtime_ns of files that exist outside the catalogue.
    For each owner the first rule that applies decides:
    1. the owned row, if it is the current file's: the rating if dirty (none if null), else
       the sidecar's if as new as the row knows it, else the row's;
    2. an owner whose token is rejected: the sidecar's;
    3. ownerless rows of this owner with a dirty one: that row's, if it is the only one,
       current and rated; else none, not even the sidecar's;
    4. the sidecar's, if as new as the current rows know it;
    5. the current clean rows' rating, if they agree.
    Photos without owner: their own current owned row, by the first rule."""
    rows = _with_derived(images).filter("not sidecar_quarantined")
    files = catalog.select("path", "size", "mtime_ns")
    files = files if unlisted is None else files.unionByName(unlisted.select("path", "size", "mtime_ns").join(files, "path", "left_anti"))
    i, f = rows.alias("i"), files.alias("f")
    known = i.join(f, F.col("i.path") == F.col("f.path"), "left").select("i.*", identity_match("i", "f").alias("match"))

    # Fallback rows are summed up before any join, so that nothing fans out.
    fallback = known.filter("sidecar_owner is null and derived_owner is not null").groupBy(F.col("derived_owner").alias("owner")).agg(
        F.count("*").alias("n"),
        F.max("sidecar_dirty").alias("dirty"),
        F.max("match").alias("match"),
        F.max("rating").alias("only_rating"),
        newest_db_sidecar(F.col("match"), F.col("sidecar_mtime_ns")).alias("newest"),
        F.count(F.when(F.col("match"), 1)).alias("n_match"),
        F.count(F.when(F.col("match"), F.col("rating"))).alias("n_rated"),
        F.min(F.when(F.col("match"), F.col("rating"))).alias("low"),
        F.max(F.when(F.col("match"), F.col("rating"))).alias("high"),
    )
    owned = known.filter("sidecar_owner is not null and match").select(
        F.col("sidecar_owner").alias("owner"), F.col("rating").alias("own_rating"), F.col("sidecar_mtime_ns").alias("own_mtime"), F.col("sidecar_dirty").alias("own_dirty"), F.lit(True).alias("own")
    )
    notes = sidecars.filter("rating is not null").select("owner", F.col("rating").alias("note"), F.col("sidecar_mtime_ns").alias("note_mtime"))
    owners = catalog.filter("owner is not null").groupBy("owner").agg(F.min("path").alias("first_path"))
    rejected = rejected_history(_with_derived(images))
    told = owners.withColumn("token", collision_token(F.col("first_path"))).join(rejected.withColumn("rejected", F.lit(True)), "token", "left")
    told = told.join(owned, "owner", "left").join(notes, "owner", "left").join(fallback, "owner", "left")
    fresh = lambda since: F.col("note").isNotNull() & (F.col("note_mtime") >= since)
    by_row = F.when(F.col("own_dirty"), F.col("own_rating")).when(fresh(F.col("own_mtime")), F.col("note")).otherwise(F.col("own_rating"))
    agreed = F.when((F.col("n_match") == F.col("n_rated")) & (F.col("low") == F.col("high")), F.col("low"))
    rating = (
        F.when(F.col("own"), by_row)
        .when(F.col("rejected"), F.col("note"))
        .when(F.col("dirty"), F.when((F.col("n") == 1) & F.col("match"), F.col("only_rating")))
        .when(fresh(F.coalesce("newest", F.lit(0))), F.col("note"))
        .otherwise(agreed)
    )
    by_owner = expand_owner_rating(told.select("owner", rating.alias("rating")), catalog)
    # Photos without owner: the exact path's own row; its sidecar is that of the row's owner.
    p = catalog.filter("owner is null").alias("p")
    alone = p.join(known.filter("match and sidecar_owner is not null").alias("i"), F.col("p.path") == F.col("i.path"))
    alone = alone.select("p.path", F.col("i.sidecar_owner").alias("owner"), F.col("i.rating").alias("own_rating"), F.col("i.sidecar_mtime_ns").alias("own_mtime"), F.col("i.sidecar_dirty").alias("own_dirty"))
    alone = alone.join(notes, "owner", "left").select("path", by_row.alias("rating"))
    return by_owner.unionByName(alone).filter("rating is not null")


def expand_owner_rating(by_owner: DataFrame, catalog: DataFrame) -> DataFrame:
    """path, rating: an owner's rating on each of its photos."""
    return catalog.select("path", "owner").join(by_owner, "owner").select("path", "rating")


def merge_rating_layers(persisted: DataFrame, embedded: DataFrame, explicit: DataFrame) -> DataFrame:
    """folder, idx, rating: explicit, else persisted, else the file's own above 0 (5 at most)."""
    named = [x.select("folder", "idx", F.col("rating").alias(n)) for x, n in ((persisted, "p"), (embedded, "m"), (explicit, "e"))]
    all_ = reduce(lambda a, b: a.join(b, ["folder", "idx"], "full"), named)
    own = F.when(F.col("m") > 0, F.least("m", F.lit(5)))
    return all_.select("folder", "idx", F.coalesce("e", "p", own).alias("rating")).filter("rating is not null")


def starred_positions(visible: DataFrame, ratings: DataFrame) -> DataFrame:
    """folder, pos of visible photos rated above 0."""
    return visible.join(ratings.filter("rating > 0"), ["folder", "idx"]).select("folder", "pos")


def rate_with_members(catalog: DataFrame, ratings: DataFrame, commands: DataFrame, minimum: int = 0, unrated_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(path, rating) after explicit ratings (path, rating) reached all siblings, and
    (folder, crossed): whether any of the folder's photos crossed the filter."""
    key = F.coalesce("owner", F.concat(F.lit("\x00"), F.col("path")))
    photos = catalog.withColumn("_key", key)
    set_ = photos.join(commands.select("path", F.col("rating").alias("new")), "path").groupBy("_key").agg(F.max("new").alias("new"))
    now = photos.join(ratings.select("path", "rating"), "path", "left").join(set_, "_key", "left").withColumn("after", F.coalesce("new", "rating"))
    moved = passes(F.col("rating"), minimum, unrated_only) != passes(F.col("after"), minimum, unrated_only)
    crossed = now.filter("new is not null").groupBy("folder").agg(F.max(moved).alias("crossed"))
    return now.filter("after is not null").select("path", F.col("after").alias("rating")), crossed
