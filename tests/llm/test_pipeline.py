"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline as cp
from reelmill.llm import queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before, name
        if name == "toxicity":
            assert before - set(ids) <= toxic
        if name == "line_dedup":
            assert set(ids) == before
        before = set(ids)
    tokens = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in tokens} == before and all(len(r.ids) == r.n_tokens for r in tokens)


def test_run_gives_the_last_stage(spark, sf_dir):
    assert "ids" in cp.run(spark, sf_dir).columns


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


EDGES = [
    (1, None, "en", "src1", 0), (2, "", "en", "src1", 0), (3, "one two three four five six", None, "src1", 3), (3, "one two three four five six", None, "src1", 3), (None, "no id of its own here at all", "en", None, 5),
    (None, "no id of its own here at all", "en", None, 5), (5, "a b c d e f " * 3000, "en", "src2", 1), (6, "a b c d e f " * 3000, "en", "src2", 1), (7, "\n\n \n", "en/x", "src2", 4), (8, "é世 " * 40, "zh", "none", None),
] + [(100 + i, "the same long line is in all of these documents here\n" + f"and one of its own {i} " * 9, "en", "src3", 9) for i in range(6)]


def test_stages_over_edge_rows(spark, sf_dir):
    from pyspark.sql import functions as F

    clash = {c: F.lit("x") for c in ("fp", "key", "keys", "score", "predicted", "leaf", "epoch", "domain", "component_id", "n_lines", "root", "shingle")}
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    before = [r.asDict() for r in docs.collect()]
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in before], docs.schema)
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns, name
        after = [r.asDict() for r in made.collect()]
        assert all(r["fp"] == "x" and r["domain"] == "x" for r in after), name
        ids = lambda rows: sorted(str(r["doc_id"]) for r in rows)
        if name == "line_dedup":
            assert ids(after) == ids(before)
            same = [r for r in after if r["text"].startswith("the same long line")]
            assert [r["doc_id"] for r in same] == [105]
        if name == "near_duplicates":
            kept = ids(after)
            assert kept.count("None") == 2 and kept.count("3") == 1 and "5" in kept and "6" not in kept and "2" not in kept
        if name == "toxicity":
            assert ids(after) == ids(before)  # none of these is toxic
        before = after
    tokens = cp.STAGES[-1][1](spark, spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in before], docs.schema), sf_dir).collect()
    assert len(tokens) == len(before) and all((r.n_tokens == 0) == (not t["text"]) for r, t in zip(sorted(tokens, key=lambda r: str(r.doc_id)), sorted(before, key=lambda r: str(r["doc_id"])))) 


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        made = stage(spark, docs, sf_dir)
        assert made.count() == 0 and (name == "bpe" or made.columns == docs.columns), name
