"""A corpus pipeline of five operators: documents in, token ids out.

Each stage takes all that its predecessor kept. The first four return the columns of
documents; the last one returns doc_id, n_tokens, ids (packed little-endian unsigned
32-bit) and exact (whether the ids decode to the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import entry
from shutterlake.llm.fair_mix import mix_sources
from shutterlake.llm.gram_join import keep_first
from shutterlake.llm.line_join import dedup_lines
from shutterlake.llm.pair_rank import score_quality
from shutterlake.llm.piece_codec import code_pieces
from shutterlake.llm.store import stored

WORD = r"[^\x20\x09-\x0D]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = score_quality(docs, entry.table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that lost all they had with them."""
    left = dedup_lines(docs, report=True).filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id."""
    return keep_first(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows are dropped, kept or doubled."""
    mixed = mix_sources(docs).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, decoded again as a check."""
    back = code_pieces(docs, entry.piece_model(), keep=["doc_id", "text"])
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("exact"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("pieces", pieces)]

#: SQL can't express the fitted classifier or the piece encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = entry.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
