"""The rating journal: upserts, revisions, compare-and-set and write outcomes.

State tables are snapshots: each function takes frames and returns the new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators.stores import running_sum

IMAGE = ("path", "size", "mtime_ns", "rating", "sidecar_mtime_ns", "sidecar_dirty", "sidecar_quarantined", "sidecar_owner")


class ConflictError(ValueError):
    pass


def latest_command(commands: DataFrame) -> DataFrame:
    """The last command of each owner; columns as they come, owner among them."""
    rest = [c for c in commands.columns if c != "owner"]
    return commands.groupBy("owner").agg(F.max_by(F.struct(*rest), "seq").alias("c")).select("owner", *[F.col(f"c.{c}").alias(c) for c in rest])


def pending_sidecars(images: DataFrame) -> DataFrame:
    """Rows whose sidecar is to be written. Two rows of one owner are an error."""
    due = images.filter("sidecar_dirty and not sidecar_quarantined and rating is not null")
    twice = due.filter("sidecar_owner is not null").groupBy("sidecar_owner").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ConflictError(f"two rows share the sidecar {twice[0][0]}")
    return due


def upsert_ratings(images: DataFrame, incoming: DataFrame) -> DataFrame:
    """The snapshot after ``incoming`` (path, size, mtime_ns, rating, sidecar_mtime_ns,
    sidecar_owner; paths and owners distinct): rows are replaced and clean, and rows of
    other paths with an incoming row's owner go."""
    new = incoming.select(
        "path", "size", "mtime_ns", "rating", "sidecar_mtime_ns", F.lit(False).alias("sidecar_dirty"), F.lit(False).alias("sidecar_quarantined"), "sidecar_owner"
    )
    owners = new.filter("sidecar_owner is not null").select("sidecar_owner")
    return images.join(new, "path", "left_anti").join(owners, "sidecar_owner", "left_anti").select(*IMAGE).unionByName(new)


def journal_ratings(images: DataFrame, commands: DataFrame) -> DataFrame:
    """The snapshot after rating commands (seq, owner, path, size, mtime_ns, rating): the
    last one of each owner becomes its dirty row, which keeps the path's known sidecar time
    (0 for a new row); other paths' rows of the owner go."""
    last = latest_command(commands)
    old = images.select("path", F.col("sidecar_mtime_ns").alias("known"))
    new = last.join(old, "path", "left").select(
        "path", "size", "mtime_ns", F.col("rating").cast("smallint").alias("rating"), F.coalesce("known", F.lit(0).cast("bigint")).alias("sidecar_mtime_ns"),
        F.lit(True).alias("sidecar_dirty"), F.lit(False).alias("sidecar_quarantined"), F.col("owner").alias("sidecar_owner"),
    )
    return images.join(new, "path", "left_anti").join(new, "sidecar_owner", "left_anti").select(*IMAGE).unionByName(new)


def revision_counters(events: DataFrame, revisions: DataFrame) -> DataFrame:
    """path, revision after events (seq, path, kind, changed): an insert, a delete and an
    update of size, time or rating count one; completing a write doesn't. Counters of
    deleted paths stay."""
    counts = events.filter("kind in ('insert', 'delete') or (kind = 'update' and changed)").groupBy("path").agg(F.count("*").alias("n"))
    both = revisions.join(counts, "path", "full")
    return both.select("path", (F.coalesce("revision", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("revision"))


def owner_revisions(accepted: DataFrame, ledger: DataFrame, base: int = 0, tie: str = "key") -> DataFrame:
    """owner, revision, global_revision after accepted journal writes (seq, owner, key):
    each counts one for its owner and one globally, in the order of ``seq``."""
    one = accepted.select("seq", "owner", tie, F.lit(1).cast("bigint").alias("_one"))
    placed = running_sum(one, "_one", "seq", tie, "_before").withColumn("_global", F.lit(base) + F.col("_before") + 1)
    new = placed.groupBy("owner").agg(F.count("*").alias("n"), F.max("_global").alias("g"))
    both = ledger.join(new, "owner", "full")
    return both.select("owner", (F.coalesce("revision", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("revision"), F.coalesce("g", "global_revision").alias("global_revision"))


def compare_and_set_owner(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """Proposals (seq, path, owner, seen_present, seen_image_revision, seen_owner_revision)
    whose view is still true; ``current`` has path, owner, present, image_revision,
    owner_revision. The first of an owner wins: it changes what the others saw."""
    p, c = proposals.alias("p"), current.alias("c")
    same = (
        (F.col("p.path") == F.col("c.path")) & F.col("p.owner").eqNullSafe(F.col("c.owner")) & F.col("p.seen_present").eqNullSafe(F.col("c.present"))
        & F.col("p.seen_image_revision").eqNullSafe(F.col("c.image_revision")) & F.col("p.seen_owner_revision").eqNullSafe(F.col("c.owner_revision"))
    )
    held = p.join(c, same).select("p.*")
    order = Window.partitionBy("owner").orderBy("seq")
    return held.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def compare_and_set_global(proposals: DataFrame, current: DataFrame, ownerless_revision: int) -> DataFrame:
    """Proposals that had no owner (seq, path, owner, seen_ownerless, seen_image_revision,
    seen_global): accepted if neither the ownerless count nor the image changed, and the
    owner's last global revision isn't after the one seen. The first of an owner wins."""
    p, c = proposals.alias("p"), current.alias("c")
    on = (F.col("p.path") == F.col("c.path")) & F.col("p.owner").eqNullSafe(F.col("c.owner"))
    fits = (
        (F.col("p.seen_ownerless") == ownerless_revision)
        & F.col("p.seen_image_revision").eqNullSafe(F.col("c.image_revision"))
        & (F.coalesce("c.owner_global_revision", F.lit(0)) <= F.col("p.seen_global"))
    )
    held = p.join(c, on).filter(fits).select("p.*")
    return held.withColumn("_n", F.row_number().over(Window.partitionBy("owner").orderBy("seq"))).filter("_n = 1").drop("_n")


def late_commands(late: DataFrame, known: DataFrame) -> DataFrame:
    """Late commands (seq, owner) that no command of their owner follows or equals."""
    last = known.groupBy("owner").agg(F.max("seq").alias("_last"))
    return late.join(last, "owner", "left").filter(F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).drop("_last")


def classify_outcomes(due: DataFrame, images: DataFrame, catalog: DataFrame, writes: DataFrame) -> DataFrame:
    """due (path, size, mtime_ns, rating, owner) with ``outcome`` and the written sidecar's
    time. ``writes``: path, ok, sidecar_mtime_ns of the attempts.
    superseded: no dirty row with exactly these values; owner_changed: the row is another
    owner's; discarded: the photo was replaced; write_failed; written."""
    d, i = due.alias("d"), images.filter("sidecar_dirty and not sidecar_quarantined").alias("i")
    exact = (F.col("d.path") == F.col("i.path")) & (F.col("d.size") == F.col("i.size")) & (F.col("d.mtime_ns") == F.col("i.mtime_ns")) & (F.col("d.rating") == F.col("i.rating"))
    row = d.join(i, exact, "left").select("d.*", F.col("i.path").isNotNull().alias("_row"), F.col("i.sidecar_owner").alias("_owner"))
    r, c = row.alias("r"), catalog.alias("c")
    file = r.join(c, (F.col("r.path") == F.col("c.path")) & (F.col("r.size") == F.col("c.size")) & (F.col("r.mtime_ns") == F.col("c.mtime_ns")), "left")
    file = file.select("r.*", F.col("c.path").isNotNull().alias("_file"), F.col("c.owner").alias("_now")).join(writes, "path", "left")
    outcome = (
        F.when(~F.col("_row"), "superseded").when(~F.col("_owner").eqNullSafe(F.coalesce("_now", "owner")), "owner_changed").when(~F.col("_file"), "discarded")
        .when(~F.coalesce("ok", F.lit(False)), "write_failed").otherwise("written")
    )
    return file.select("path", "size", "mtime_ns", "rating", "owner", outcome.alias("outcome"), "sidecar_mtime_ns")


def apply_outcomes(images: DataFrame, quarantine: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, quarantine) afterwards: owner_changed rows are archived and removed, discarded
    ones removed, written ones clean with the sidecar's time; the others stay as they are."""
    o = outcomes.select("path", "outcome", F.col("sidecar_mtime_ns").alias("_mtime"))
    j = images.join(o, "path", "left")
    written = F.col("outcome") == "written"
    stay = j.filter(F.col("outcome").isNull() | ~F.col("outcome").isin("owner_changed", "discarded"))
    stay = stay.withColumn("sidecar_dirty", F.when(written, False).otherwise(F.col("sidecar_dirty"))).withColumn("sidecar_mtime_ns", F.when(written, F.col("_mtime")).otherwise(F.col("sidecar_mtime_ns")))
    moved = j.filter("outcome = 'owner_changed'").select(*IMAGE)
    return stay.select(*IMAGE), quarantine.select(*IMAGE).unionByName(moved)


def path_history(images: DataFrame, image_revisions: DataFrame) -> DataFrame:
    return images.select("path").union(image_revisions.select("path")).distinct()


def dedup_paths(requested: DataFrame) -> DataFrame:
    return requested.dropDuplicates(["path"])


def pin_delta(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) keys."""
    return new.subtract(old), old.subtract(new)
