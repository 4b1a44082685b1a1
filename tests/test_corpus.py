"""Searches from end to end: text to chunks, index, vectors and a page of hits, on a small corpus of twenty documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import catalog, search

TOPICS = {
    "Backups": "nightly snapshot of the ledger volume, restore drill, retention of tape archives",
    "Bread": "sourdough starter, rye flour, proofing basket and a hot oven with steam",
    "Cycling": "chain lubricant, derailleur hanger, tubeless tyre sealant for gravel rides",
    "Gardens": "compost heap, pruning shears, tomato trellis and slug traps",
    "Harbour": "mooring buoy, tide table, pilot vessel and container crane",
    "Ink": "fountain nib, waterproof pigment, blotting paper and calligraphy strokes",
    "Kernel": "scheduler preemption, page cache writeback, interrupt affinity tuning",
    "Looms": "warp tension, shuttle repair, weft density of linen cloth",
    "Maps": "contour interval, projection distortion, survey datum and hill shading",
    "Night": "lantern wick, moth trap, constellation chart with dew shield",
    "Optics": "achromatic lens, focal plane, prism dispersion on a bench",
    "Pumps": "impeller cavitation, priming valve, suction head of the bilge",
    "Queues": "consumer lag, dead letter topic, broker partition rebalance",
    "Rails": "ballast tamping, signal interlocking, pantograph wear",
    "Search": "inverted index, stemming analyser, relevance judgement pool",
    "Tea": "oolong leaf, gaiwan lid, roasting basket and spring harvest",
    "Umbrellas": "rib stretcher, canopy fabric, ferrule and crook handle",
    "Violins": "spruce soundpost, horsehair bow, rosin dust and gut string",
    "Wells": "artesian aquifer, casing screen, drawdown test of groundwater",
    "Yeast": "sourdough starter hydration, ferment temperature, flour protein",
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, 1 if i < 15 else 2, f"d{i}", t, f"# {t}\n\n{body}.\n\nMore on {t.lower()}: {body}.", 100 + i, 200 + i) for i, (t, body) in enumerate(TOPICS.items())]
    docs = spark.createDataFrame(rows, "id long, project_id long, source_doc_id string, title string, content string, created_at long, updated_at long")
    docs = docs.withColumn("summary", F.when(F.col("title") == "Tea", "about tea").otherwise(""))
    projects = spark.createDataFrame([(1, "a", "active"), (2, "b", "active"), (3, "c", "disabled")], "id long, name string, status string")
    chunks = catalog.index_chunks(docs.select(F.col("id").alias("document_id"), "title", F.col("content").alias("text")))
    vectors = chunks.select(F.col("id").alias("chunk_id"), V.quantize_i8(V.embed(F.col("content"))).alias("embedding"))
    return docs, projects, chunks, vectors


@pytest.fixture(scope="module")
def corpus(tables):
    docs, projects, chunks, vectors = tables
    return search.Corpus(docs, projects, chunks, vectors=vectors)


def titles(page):
    return [r["title"] for r in page.collect()]


@pytest.mark.parametrize(("text", "title"), [("impeller cavitation", "Pumps"), ("gaiwan lid", "Tea"), ("dead letter topic", "Queues"), ("soundpost", "Violins"), ("kernel scheduler", "Kernel"), ("tide table", "Harbour"), ("datum", "Maps"), ("wicks lantern", "Night")])
def test_keyword_search_puts_the_document_first(corpus, text, title):
    assert titles(corpus.search(search.SearchQuery(text, mode="fts")))[0] == title


def test_unrelated_words_find_nothing(corpus):
    for text in ("zebra quasar", "xylophone", "ophthalmology"):
        assert titles(corpus.search(search.SearchQuery(text, mode="fts"))) == []


def test_shared_words_rank_both(corpus):
    assert set(titles(corpus.search(search.SearchQuery("sourdough starter", mode="fts", limit=2)))) == {"Bread", "Yeast"}


def test_vector_and_hybrid_search_read_the_text(tables, corpus):
    for mode in ("vector", "hybrid"):
        for title in ("Rails", "Ink", "Wells"):
            asked = search.SearchQuery(TOPICS[title], mode=mode, limit=3)
            hits = search.top(search.rrf(corpus.fts(asked), corpus.vector(asked, None)), 3) if mode == "hybrid" else corpus.vector(asked, None)
            best = hits.orderBy("rank").first()["chunk_id"]
            assert tables[2].where(F.col("id") == best).first()["title"] == title
    scoped = search.SearchQuery("rosin dust", project_ids=[1])
    assert "Violins" not in titles(corpus.search(scoped))


def test_hybrid_falls_back_to_keywords(tables):
    docs, projects, chunks, vectors = tables
    V.register_embedder("broken", 4, lambda: lambda texts: 1 / 0)
    broken = search.Corpus(docs, projects, chunks, vectors=vectors, embedder="broken")
    with pytest.warns(UserWarning, match="vector side left out"):
        assert titles(broken.search(search.SearchQuery("gaiwan lid")))[0] == "Tea"
    assert titles(search.Corpus(docs, projects, chunks, index=broken.index).search(search.SearchQuery("gaiwan lid")))[0] == "Tea"


def test_summary_takes_the_place_of_the_snippet(corpus):
    page = {r["title"]: r["snippet"] for r in corpus.search(search.SearchQuery("basket", mode="fts"), summaries=True).collect()}
    assert page["Tea"] == "about tea" and "<b>basket</b>" in page["Bread"]


def test_feedback_turns_the_order(spark, tables):
    docs, projects, chunks, _ = tables
    plain = search.Corpus(docs, projects, chunks)
    asked = search.SearchQuery("sourdough starter", mode="fts", limit=2)
    first, second = [r["document_id"] for r in plain.search(asked).collect()]
    empty = spark.createDataFrame([], catalog.SCHEMAS["document_feedbacks"])
    rows = spark.createDataFrame([(d, "agent", s, "s", 1) for d, s in ((first, -1.0), (second, 1.0)) for _ in range(9)], catalog.SCHEMAS["document_feedbacks"])
    feedback = search.record_feedback(empty, rows, docs)
    turned = search.Corpus(docs, projects, chunks, index=plain.index, feedback=feedback)
    assert [r["document_id"] for r in turned.search(asked).collect()] == [second, first]
    for bad in ((first, "a", 1.5, "s", 1), (first, "a", float("nan"), "s", 1), (999, "a", 0.5, "s", 1)):
        with pytest.raises(ValueError, match="feedback"):
            search.record_feedback(empty, spark.createDataFrame([bad], catalog.SCHEMAS["document_feedbacks"]), docs)


def test_prefixes_underscores_and_empty_queries(corpus):
    assert titles(corpus.search(search.SearchQuery("gai", mode="fts"))) == ["Tea"]
    assert titles(corpus.search(search.SearchQuery("signal_interlocking", mode="fts")))[0] == "Rails"
    assert titles(corpus.search(search.SearchQuery('("^~', mode="fts"))) == [] == titles(corpus.search(search.SearchQuery(" ")))
    assert len(titles(corpus.search(search.SearchQuery("", project_ids=[2], limit=50)))) == 5


def test_index_reads_its_keys_only(corpus):
    """Keys and bounds of a search reach the scan of the blocks, which is read once."""
    plan = corpus.fts(search.SearchQuery("tea gaiwan"))._jdf.queryExecution()
    assert "EqualTo(key,gaiwan)" in plan.toString() and "EqualTo(key,tea*)" in plan.toString() and "GreaterThanOrEqual(top," in plan.toString()
    scans = [line for line in plan.executedPlan().toString().splitlines() if "FileScan" in line and "freqs" in line]
    assert len(scans) == 1, plan.executedPlan().toString()


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (700, 6))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<tinyint>").repartition(3)
    asked = vectors.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in search.knn(vectors, asked, 7, None).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for i in range(0, 700, 2):
        d = ((x - x[i]) ** 2).sum(1)
        assert got[i] == sorted(range(700), key=lambda j: (d[j], j))[:7]
