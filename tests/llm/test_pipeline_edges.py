"""Each stage of the pipeline on rows with nulls, empty and blank texts, ties, repeated rows and clashing columns, and on none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import registry

WORDS = ["alpha", "Beta", "gamma", "delta", "éa", "eins", "zwei", "mot", "x1", "of", "the"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    sentence = lambda n: " ".join(rng.choice(WORDS, n)) + "."
    passage, leak = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(20))
    texts = [None, "", " \n", "one", *(sentence(int(rng.integers(20, 90))) for _ in range(40))]
    texts += [texts[9]] * 3 + [texts[9] + " end"] + [sentence(30) + " " + passage, passage + " " + sentence(40), sentence(20) + " " + leak + " tail"]
    texts += [" ".join(w + "***" for w in rng.choice(WORDS, 40)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], (12, "another text of that id " + sentence(30), None, None, None), (None, sentence(30), None, None, None), (None, None, None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("text_key", "spans", "label", "node", "_key", "score", "shingle", "part"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 0 if "***" in (t or "") else 1, None) for i, t in enumerate(texts)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None), (None, "x"), (1, leak)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), docs, rows


def test_stages_keep_columns_and_rows(spark, tables):
    sf, docs, rows = tables
    now, by_name = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.common.stage(stage(spark, now, sf), f"test-{name}")
        assert now.columns == docs.columns
        by_name[name] = now.collect()
    kept = [r["text"] for r in by_name["quality_classifier"]]
    assert not any("***" in (t or "") for t in kept) and sum(t is None for t in kept) in (0, sum(r[1] is None for r in rows))  # one score for all
    deduped = by_name["simhash_dedup"]
    ids = [r["doc_id"] for r in deduped if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and sum(r["doc_id"] is None for r in deduped) == sum(r["doc_id"] is None for r in by_name["quality_classifier"])
    assert sum((r["text"] or "").strip() == "" for r in deduped if r["doc_id"] is not None) <= 1  # null, empty and blank texts are copies
    cut = by_name["substring_dedup"]
    assert len(cut) == len(deduped) and not any("p30 p31" in (r["text"] or "") for r in cut)
    clean = by_name["benchmark_decontamination"]
    assert len(clean) == len(cut) and not any("q5 q6" in (r["text"] or "") for r in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in clean if r["text"] is not None)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}


def test_stages_take_empty_tables(spark, tables):
    sf, docs, _ = tables
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = registry.op4_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 40 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95
