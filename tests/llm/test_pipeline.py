"""The pipeline's stages, each on what its predecessor kept."""

import collections

import corpus_pipeline
import duckdb
import numpy as np
import sentencepiece

from shutterlake.llm import entry, oracles, pair_rank, piece_codec
from shutterlake.llm.store import stored

from .test_llm_operators import ROWS, SCHEMA, WORD, classes, early_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = entry.documents(spark, SF)
    columns, seen = docs.columns, []
    labels = {r["doc_id"]: r["quality"] for r in entry.table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF))
        seen.append(name)
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(ids) <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name != "pieces":
            assert docs.columns == columns
        if name == "quality":
            good = [i for i, q in labels.items() if q == 1]
            assert len(set(good) & set(ids)) >= 0.97 * len(good)
        if name == "line_dedup":
            assert docs.filter("n_chars <> char_length(text)").count() == 0
        if name in ("quality", "line_dedup", "near_duplicates"):
            assert len(ids) == len(set(ids))
    lib = sentencepiece.SentencePieceProcessor(model_file=entry.piece_model())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in docs.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == [1, *lib.encode(texts[r["doc_id"]] or ""), 2] and r["n_tokens"] == len(r["ids"]) // 4 and r["exact"]
    assert seen == ["quality", "line_dedup", "near_duplicates", "mixing", "pieces"]


def test_awkward_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        if name == "near_duplicates":
            assert {r["doc_id"] for r in out} >= {None, 0, 1, 6} and not {r["doc_id"] for r in out} & {7, 8}
        if name == "line_dedup":
            assert next(r["text"] for r in out if r["doc_id"] == 0) is None
        if name == "pieces":
            assert len(out) == len(ROWS)


def test_pieces_in_one_worker(spark):
    """Ids and their texts come from one Python worker of each task: workers live on, with their model."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for coded in (dict(corpus_pipeline.STAGES)["pieces"](spark, docs, SF), piece_codec.token_digest(docs, entry.piece_model())):
        assert coded._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    back = piece_codec.decode_pieces(piece_codec.encode_pieces(docs, entry.piece_model()), entry.piece_model())
    both = piece_codec.code_pieces(docs, entry.piece_model())
    assert both.columns == back.columns and both.exceptAll(back).count() == 0 == back.exceptAll(both).count()


def test_empty(spark):
    docs = entry.documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() == 0


def test_short_repeated_lines_go(spark):
    """Exact copies of lines too short for the search of near ones; blank lines stay."""
    texts = ["Ietzte.\n\nfirst one\n \t\nß", "Ietzte.\n\nfirst two\n \t\nß\nß ", "Ietzte!\nfirst one\nIetzte!", "ß\nIetzte.", "\n \t"]
    rows = [(i, t, "en", "s1", len(t)) for i, t in enumerate(texts)]
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    want = {0: texts[0], 1: "\nfirst two\n \t\nß ", 2: "Ietzte!", 4: "\n \t"}
    assert left == {i: (t, len(t)) for i, t in want.items()}


def test_stages_against_brute_force(spark, tmp_path):
    """The rows of every stage from those of the one before it, by plain means."""
    docs = entry.documents(spark, SF)
    stages = dict(corpus_pipeline.STAGES)
    rows = [tuple(r) for r in docs.collect()]
    for name in ("quality", "line_dedup", "near_duplicates", "mixing"):
        before, docs = docs, stored(stages[name](spark, docs, SF))
        got = collections.Counter(tuple(r) for r in docs.collect())
        if name == "quality":
            good = {r["doc_id"] for r in pair_rank.score_digest(before, entry.table(spark, SF, "labels")).filter("score >= 0.3").collect()}
            want = collections.Counter(r for r in rows if r[0] in good)
        if name == "line_dedup":
            early, want = early_lines(rows), collections.Counter()
            for i, t, *rest in rows:
                left = "\n".join(x for n, x in enumerate(t.split("\n")) if not (WORD.search(x) and early[x] < ((True, i), n)))
                if left == t or WORD.search(left):
                    want[(i, left, *rest[:-1], len(left))] += 1
        if name == "near_duplicates":
            first = {c for _, _, c in classes(rows)}
            want = collections.Counter(r for r in rows if r[0] in first)
        if name == "mixing":
            before.write.parquet(f"{tmp_path}/documents")
            con = duckdb.connect()
            con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
            out = con.execute(oracles.MIX)
            at = {c[0]: k for k, c in enumerate(out.description)}
            copies = {r[at["doc_id"]]: r[at["taken"]] // max(r[at["size"]], 1) for r in out.fetchall()}
            want = collections.Counter({r: copies[r[0]] for r in rows if copies[r[0]]})
        assert got == want, name
        rows = list(got.elements())
