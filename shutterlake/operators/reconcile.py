"""Reconciling older rating rows with today's sidecar owners.

Rows carry what was found out about their files: ``derived_owner`` (null: unresolved),
``path_stable``, ``representation_collision`` and ``identity_matches``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.paths import collision_token

OWNER_KEY_VERSION = 8


def unsafe_tokens(ownerless: DataFrame, owned: DataFrame) -> DataFrame:
    """Distinct tokens that no row may be promoted under: those of rows of unsafe history or
    without a derived owner, and of unstable older owned rows that share one with a dirty
    ownerless row."""
    rows = ownerless.withColumn("token", collision_token(F.col("path")))
    unsafe = rows.filter("not path_stable or representation_collision or derived_owner is null").select("token")
    old = owned.filter((F.col("owner_key_version") < OWNER_KEY_VERSION) & ~F.col("path_stable")).withColumn("token", collision_token(F.col("path")))
    return unsafe.union(old.join(rows.filter("sidecar_dirty").select("token").distinct(), "token", "left_semi").select("token")).distinct()


def reconcile_ownerless(ownerless: DataFrame, owned: DataFrame, owner_revisions: DataFrame) -> DataFrame:
    """``ownerless`` with ``decision``: promote, quarantine, discard or keep. The first rule
    that applies decides:
    1. the derived owner has a ledger entry: dirty rows are archived, clean ones go;
    2. unsafe history, or dirty under an unsafe token: the same;
    3. no derived owner: the row is kept;
    4. several rows of one owner: dirty ones are archived, clean ones kept;
    5. not the current file's, or dirty without a rating: the same;
    6. another path owns the sidecar: dirty rows are archived, clean ones go;
    7. the row is promoted."""
    rows = ownerless.withColumn("_token", collision_token(F.col("path")))
    tokens = unsafe_tokens(ownerless, owned).select(F.col("token").alias("_token"), F.lit(True).alias("_unsafe"))
    ledger = owner_revisions.select(F.col("owner").alias("derived_owner"), F.lit(True).alias("_ledger")).distinct()
    holder = owned.filter("sidecar_owner is not null").groupBy(F.col("sidecar_owner").alias("derived_owner")).agg(F.min("path").alias("_low"), F.max("path").alias("_high"))
    # Unresolved rows are no group: they'd be one huge one.
    n = rows.filter("derived_owner is not null").groupBy("derived_owner").agg(F.count("*").alias("_n"))
    j = rows.join(tokens, "_token", "left").join(ledger, "derived_owner", "left").join(n, "derived_owner", "left").join(holder, "derived_owner", "left")
    dirty = F.col("sidecar_dirty")
    or_gone, or_kept = F.when(dirty, "quarantine").otherwise("discard"), F.when(dirty, "quarantine").otherwise("keep")
    unsafe = ~F.col("path_stable") | F.col("representation_collision") | (dirty & F.col("derived_owner").isNull())
    other = (F.col("_low") != F.col("path")) | (F.col("_high") != F.col("path"))
    decision = (
        F.when(F.col("_ledger"), or_gone)
        .when(unsafe | (dirty & F.coalesce("_unsafe", F.lit(False))), or_gone)
        .when(F.col("derived_owner").isNull(), or_kept)
        .when(F.col("_n") > 1, or_kept)
        .when(~F.col("identity_matches") | (dirty & F.col("rating").isNull()), or_kept)
        .when(other, or_gone)
        .otherwise("promote")
    )
    return j.select(*ownerless.columns, decision.alias("decision"))


def promoted(decided: DataFrame, owner_revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owned rows, owner revisions) after the promotions."""
    rows = decided.filter("decision = 'promote'").withColumn("sidecar_owner", F.col("derived_owner")).withColumn("owner_key_version", F.lit(OWNER_KEY_VERSION))
    up = rows.groupBy(F.col("derived_owner").alias("owner")).agg(F.count("*").alias("_n"))
    both = owner_revisions.join(up, "owner", "full")
    return rows.drop("decision"), both.select("owner", (F.coalesce("revision", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("revision"))


def rekey_owners(owned: DataFrame) -> DataFrame:
    """``owned`` rows with ``decision``: rows of the current key version stay; older ones
    are rekeyed if they are the current file's, stable, alone of their derived owner and
    unambiguous; else dirty ones are archived and clean ones go."""
    old = F.col("owner_key_version") < OWNER_KEY_VERSION
    rows = owned.withColumn("_token", collision_token(F.col("path")))
    unsafe = rows.filter(old & (~F.col("path_stable") | F.col("representation_collision") | F.col("derived_owner").isNull())).select("_token").distinct()
    n = owned.filter("derived_owner is not null").groupBy("derived_owner").agg(F.count("*").alias("_n"))
    j = rows.join(unsafe.withColumn("_unsafe", F.lit(True)), "_token", "left").join(n, "derived_owner", "left")
    good = F.col("identity_matches") & F.col("path_stable") & (F.col("_n") == 1) & F.col("_unsafe").isNull()
    decision = F.when(~old, "keep").when(F.coalesce(good, F.lit(False)), "rekey").when(F.col("sidecar_dirty"), "quarantine").otherwise("discard")
    return j.select(*owned.columns, decision.alias("decision"))


def owners_without_conflict(owned: DataFrame) -> DataFrame:
    """Rows whose owner no other path has."""
    return owned.withColumn("_n", F.count("*").over(Window.partitionBy("sidecar_owner"))).filter("_n = 1").drop("_n")
