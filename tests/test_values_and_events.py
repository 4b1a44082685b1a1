"""Declared namespaces, kinds of audit events, and documents fetched from a source, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import catalog
from corpusloom.sources import connector

KV = catalog.SCHEMAS["plugin_kv"]


def test_values_are_set_in_declared_namespaces_only(spark):
    names = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "b"), ("p", "")], "plugin_id string, namespace string")
    old = spark.createDataFrame([("p", "a", "k", b"old", 1), ("q", "b", "k", b"other", 1)], KV)
    rows = spark.createDataFrame(
        [("p", "a", "k", b"1", 5), ("p", "a", "k", b"3", 7), ("p", "a", "k", b"2", 7), ("p", "b", "k", b"x", 9), ("p", None, "k", b"x", 9), (None, "a", "k", b"x", 9), ("p", "a", None, b"x", 9), ("p", "a", "n", None, 9), ("p", "", "e", b"empty", 9), ("p", "A", "k", b"x", 9)], KV
    )
    table, refused = catalog.put_values(old, rows, names)
    assert {(r["plugin_id"], r["namespace"], r["key"]): bytes(r["value"]) for r in table.collect()} == {("p", "a", "k"): b"3", ("q", "b", "k"): b"other", ("p", "", "e"): b"empty"}
    why = sorted(r["error"] for r in refused.collect())
    assert why == ["namespace not allowed: A", "namespace not allowed: a", "namespace not allowed: b", "namespace not allowed: null", "no key", "no value"]
    asked = spark.createDataFrame([("p", "a", "k"), ("p", "a", "none"), ("p", "b", "k"), ("q", "b", "k")], "plugin_id string, namespace string, key string")
    got = {(r["plugin_id"], r["namespace"], r["key"]): (r["value"] and bytes(r["value"]), r["error"]) for r in catalog.get_values(table, asked, names).collect()}
    assert got == {("p", "a", "k"): (b"3", None), ("p", "a", "none"): (None, None), ("p", "b", "k"): (None, "namespace not allowed: b"), ("q", "b", "k"): (b"other", None)}
    same, none = catalog.put_values(old, rows.limit(0), names)
    assert same.count() == 2 and none.count() == 0


def test_kinds_of_events(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, 4, "x"), (2, None, "y")], "project_id long, docs_indexed long, more string")
    made = catalog.event_rows(rows, "index_complete").collect()
    assert sorted((json.loads(r["payload"])["index_complete"]["docs_indexed"] or 0, r["project_id"]) for r in made) == [(0, 2), (4, 1)]
    assert all(set(json.loads(r["payload"])["index_complete"]) == {"project_id", "docs_indexed"} for r in made)
    with pytest.raises(ValueError, match="plugin_error needs plugin_id, message"):
        catalog.event_rows(rows, "plugin_error")
    with pytest.raises(ValueError, match="no kind"):
        catalog.event_rows(rows, "made_up")
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    error = spark.createDataFrame([("m", "a"), ("m", "b")], "module string, message string")
    assert catalog.record_events(store, catalog.event_rows(rows, "index_complete", keep=("docs_indexed",)), 10, order="docs_indexed")
    assert catalog.record_events(store, catalog.event_rows(error, "system_error"), 20)
    log = store.load("audit_log")
    assert sorted((r["id"], r["created_at"]) for r in log.collect()) == [(1, 10), (2, 10), (3, 20), (4, 20)]
    assert catalog.clear_audit(log).count() == 0
    assert sorted(r["id"] for r in catalog.clear_audit(log, before=20).collect()) == [3, 4]
    assert sorted(r["id"] for r in catalog.clear_audit(log, before=30, kinds=("system_error",)).collect()) == [1, 2]

    def full(self, *a, **k):
        raise OSError("disk full")

    monkeypatch.setattr(catalog.Catalog, "merge", full)
    with pytest.warns(UserWarning, match="disk full"):
        assert not catalog.record_events(store, catalog.event_rows(error, "system_error"), 30)
    assert store.load("audit_log").count() == 4


class Answers(connector.DocumentSource):
    def fetch(self, source_doc_id):
        if source_doc_id == "broken":
            raise TimeoutError("30 s")
        return {"title": "T", "content": "text", "tags": ["t"], "metadata": {"k": "v"}, "updated_at": 5} if source_doc_id == "there" else None


def test_documents_of_a_source(spark):
    asked = spark.createDataFrame([(1, "there"), (2, "broken"), (3, "gone"), (4, None), (5, "there")], "id long, source_doc_id string")
    got = {r["id"]: r for r in connector.fetch_documents(Answers({}), asked).collect()}
    assert {k: r["error"] for k, r in got.items()} == {1: None, 2: "TimeoutError: 30 s", 3: "not found", 4: "not found", 5: None}
    assert got[1]["metadata"] == {"k": "v"} and got[5]["tags"] == ["t"] and got[1]["source_doc_id"] == "there" and got[2]["content"] is None
    assert connector.fetch_documents(Answers({}), asked.limit(0)).count() == 0


def test_a_fetched_document_is_cached_for_its_own_source(spark):
    docs = spark.createDataFrame([(1, "p", "there"), (2, "q", "there"), (3, "p", "broken")], "id long, plugin_id string, source_doc_id string")
    local = spark.createDataFrame([(3, None)], "document_id long, content string")
    cache = spark.createDataFrame([("q", "there", "q's own", 1, 100, None, None), ("p", "there", "old", 1, 10, None, None)], catalog.SCHEMAS["content_cache"])
    chunks = spark.createDataFrame([(3, 0, "kept")], "document_id long, chunk_index int, content string")
    calls = []

    def fetch(asked):
        calls.append(sorted(r["id"] for r in asked.collect()))
        return connector.fetch_documents(Answers({}), asked)

    found, after, errors = catalog.fetched_content(docs, local, cache, chunks, 50, fetch, ttl_minutes=60)
    assert {r["document_id"]: (r["content"], r["origin"]) for r in found.collect()} == {1: ("text", "source"), 2: ("q's own", "cache"), 3: ("kept", "chunks")}
    assert [(r["document_id"], r["error"]) for r in errors.collect()] == [(3, "TimeoutError: 30 s")]
    after = spark.createDataFrame(after.collect(), after.schema)
    assert {(r["plugin_id"], r["doc_id"]): (r["content"], r["expires_at"]) for r in after.collect()} == {("q", "there"): ("q's own", 100), ("p", "there"): ("text", 50 + 3600)}
    found, _, _ = catalog.fetched_content(docs.where(F.col("id") < 3), local, after, chunks, 60, fetch)
    assert {r["document_id"]: r["origin"] for r in found.collect()} == {1: "cache", 2: "cache"}
    assert calls == [[1, 3], []]
