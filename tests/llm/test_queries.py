"""Registered queries and the pipeline over the whole small tables, against brute force."""

import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import common, registry

from . import brute
from .test_operators import hashed, ranked


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in common.table(spark, sf, "documents").collect()}


@pytest.fixture(scope="module")
def items(spark, sf):
    return [(r["item_id"], r["text"]) for r in common.table(spark, sf, "benchmark").collect()]


def test_substrings_query(spark, sf, texts):
    want = {d: x for d, x in zip(texts, brute.substrings(list(texts.values())), strict=True)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in registry.op3_substrings(spark, sf).collect()} == want


def test_decontamination_query(spark, sf, texts, items):
    want = {d: x for d, x in zip(texts, brute.contamination(list(texts.values()), items), strict=True)}
    got = registry.op5_decontamination(spark, sf).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == want


def test_simhash_query(spark, sf, texts):
    fps = {d: brute.fingerprint(t) for d, t in texts.items()}
    comp = brute.components_of(fps)
    got = registry.op9_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{fps[d]:016x}", comp[d]) for d in fps}


def test_embeddings_query(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in common.table(spark, sf, "embeddings").collect()]
    want = {v: (*x, v == x[1]) for (v, _), x in zip(vectors, brute.cosines(vectors), strict=True)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in registry.op6_embeddings(spark, sf).collect()} == want


def test_licences_query(spark, sf, texts):
    got = registry.op10_licenses(spark, sf).collect()
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in got} == {d: brute.licences(t) for d, t in texts.items()}


def test_sharding_query(spark, sf, texts):
    got = registry.op8_sharding(spark, sf).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {d: (len((t or "").encode()) + 1, brute.crc(t)) for d, t in texts.items()}
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and {r["law"] for r in got} == {"rows"}
    want = ranked(list(map(tuple, hashed(common.table(spark, sf, "documents")))))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == Counter(want)


def test_warc_query_matches_its_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{Path(sf) / 'pages.parquet'}'")
    found = con.execute(registry.oracle_sql()["op7_warc"])
    names = [d[0] for d in found.description]
    got = registry.op7_warc(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(found.fetchall())


def test_pipeline(spark, sf, texts, items):
    """Each stage against brute force on the rows that the stage before it kept."""
    docs = common.table(spark, sf, "documents")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    kept = common.stage(stages["quality_classifier"](spark, docs, sf), "test-pipeline")
    quality = {r["doc_id"]: r["predicted"] for r in registry.op2_quality(spark, sf).collect()}
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == columns and rows == {d: t for d, t in texts.items() if quality[d] == 1} and rows

    deduped = common.stage(stages["simhash_dedup"](spark, kept, sf), "test-pipeline")
    comp = brute.jaccard_components(rows)
    left = {r["doc_id"]: r["text"] for r in deduped.collect()}
    assert deduped.columns == columns and left == {d: rows[d] for d in set(comp.values())}

    cut = common.stage(stages["substring_dedup"](spark, deduped, sf), "test-pipeline")
    want = dict(zip(left, brute.substrings(list(left.values())), strict=True))
    shorter = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert cut.columns == columns and {d: len(t.encode().split()) for d, (t, _) in shorter.items()} == {d: n - gone for d, (n, gone, _) in want.items()}
    assert all(t == left[d] for d, (t, _) in shorter.items() if not want[d][1]) and all(len(t) == n for t, n in shorter.values())

    clean = common.stage(stages["benchmark_decontamination"](spark, cut, sf), "test-pipeline")
    want = dict(zip(shorter, brute.contamination([t for t, _ in shorter.values()], items), strict=True))
    cleaned = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == columns and {d: len(brute.WORDS.findall(brute.lower(t))) for d, t in cleaned.items()} == {d: x[0] - x[1] for d, x in want.items()}
    assert all(cleaned[d] == shorter[d][0] for d, x in want.items() if not x[4])

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in cleaned.items()}
    packed = stages["pack"](spark, clean, sf).collect()
    assert Counter({d: len(x) for d, x in ids.items()}) == sum((Counter({r["doc_id"]: r["length"]}) for r in packed), Counter())
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in packed)
