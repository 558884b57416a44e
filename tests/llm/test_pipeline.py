"""The pipeline as a whole and stage by stage, against plain references."""

import corpus_pipeline
import pytest

from fixwave.llm import jaccard, leaks


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out, docs, root = [spark.read.parquet(f"{sf}/documents.parquet")], None, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, out[-1], sf)
        docs.write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return out


def test_stages_keep_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_good_documents(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    assert stages[1].join(labels, "doc_id").count() >= 0.95 * stages[0].join(labels, "doc_id").count()


def test_one_of_each_group_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    assert {r["doc_id"] for r in stages[2].collect()} == {d for d, (_, c) in jaccard.brute_force(texts).items() if d == c}


def test_leaks_go_and_others_stay(spark, sf, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    found = {rows[t][0] for t, *_ in leaks.brute_force([t for _, t in rows], items)}
    assert {r["doc_id"] for r in stages[3].collect()} == {d for d, _ in rows} - found


def test_texts_are_masked_and_packed(stages):
    masked = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert masked.keys() == {r["doc_id"] for r in stages[3].collect()}
    assert not any("@" in t and ".example.com" in t for t in masked.values())
    pieces = stages[5].toPandas()
    assert set(pieces["doc_id"]) == masked.keys() and (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()


def test_run_equals_stages(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[5].count()


def test_awkward_tables_pass_through_all_stages(spark, tmp_path):
    """Nulls, blanks, repeated rows, a long text, and columns whose names the operators use inside."""
    words = [f"{a}{b}" for a in ("so", "me", "plain", "or", "dinary") for b in ("ly", "ing", "ed", "er", "s")]
    text = lambda k, n: " ".join(words[(k * 7 + i * i) % 25] for i in range(n)) + "."
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, text(3, 80)), (4, text(3, 80)), (4, text(3, 80)), (5, text(5, 20000)), (6, "mail a.b@example.com today " + text(6, 40)), *[(k, text(k, 60)) for k in range(10, 40)]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, bucket int, score double, base string"
    full = [(d, t, None, "s", None, "x", 1, 0.5, None) for d, t in rows]
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(10, 40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, text(12, 30))], "item_id long, text string")
    for name, data in (("full", full), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        pieces = corpus_pipeline.run(spark, str(folder)).toPandas()
        if name == "none":
            assert len(pieces) == 0
        else:
            assert set(pieces["doc_id"]) <= {d for d, _ in rows} and 12 not in set(pieces["doc_id"])
            by = pieces.sort_values(["sequence_id", "offset"])
            assert by.groupby("sequence_id")["length"].sum().iloc[:-1].eq(2048).all()
