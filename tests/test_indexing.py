"""A run over changes leaves what a run over everything makes, also after failures."""

import pytest

from corpusloom.operators import blocks, catalog, indexing

DOCS = "project_id long, source_doc_id string, title string, file_path string, content string, created_at long, updated_at long"
FIRST = {
    "a": ("Tea", "# Leaves\n\ngaiwan lid and [[Bread]]\n\n# Water\n\nsoft spring", 10),
    "b": ("Bread", "# Dough\n\nsourdough starter [[Rails]] [[Tea]]", 10),
    "c": ("Wells", "# Depth\n\nbucket rope", 10),
    "same": ("Same", "# S\n\nnothing new [[Wells]]", 10),
}
LATER = {
    "a": ("Tea", "# Leaves\n\nonly oolong", 20),
    "b": FIRST["b"],
    "same": FIRST["same"],
    "d": ("Rails", "# Signal\n\ninterlocking sourdough", 20),
    "e": ("Empty", "", 20),
}


def table(spark, docs):
    return spark.createDataFrame([(1, k, t, f"{k}.md", c, at, at) for k, (t, c, at) in docs.items()], DOCS)


def state(store, index):
    docs = {r["id"]: r["source_doc_id"] for r in store.load("documents").collect()}
    chunks = {r["id"]: (docs[r["document_id"]], r["chunk_index"]) for r in store.load("chunks").collect()}
    links = sorted((docs[r["source_id"]], r["target_raw"], docs.get(r["target_id"]), r["resolution"]) for r in store.load("document_links").collect())
    vectors = sorted((chunks[r["chunk_id"]], tuple(r["embedding"])) for r in store.load("chunk_embeddings").collect())
    asked = [(i, [([w], False)]) for i, w in enumerate(("sourdough", "gaiwan", "oolong", "bucket", "nothing", "interlocking"))]
    hits = sorted((r["query_id"], chunks[r["chunk_id"]], round(r["score"], 9)) for r in index.search(asked, 10).collect())
    return sorted(docs.values()), sorted(chunks.values()), links, vectors, hits


@pytest.fixture(scope="module")
def expected(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    store = catalog.Catalog(spark, str(root / "c"))
    index, _ = indexing.run(store, blocks.BlockIndex.open(spark, str(root / "i")), table(spark, LATER), 99)
    return state(store, index)


def test_changes_leave_what_a_whole_run_makes(spark, tmp_path, expected, monkeypatch):
    """An update, a new document, a deletion, one left alone; the second run dies after each save and is repeated."""
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    index, done = indexing.run(store, blocks.BlockIndex.open(spark, str(tmp_path / "i")), table(spark, FIRST), 50)
    assert {r["source_doc_id"]: r["action"] for r in done.collect()} == dict.fromkeys(FIRST, "indexed")
    ids = {r["source_doc_id"]: r["id"] for r in store.load("documents").collect()}
    merge = catalog.Catalog.merge
    for dies in ("chunk_embeddings", "chunks", "document_links"):

        def dying(self, name, *a, dies=dies, **b):
            merge(self, name, *a, **b)
            if name == dies:
                raise OSError("gone")

        monkeypatch.setattr(catalog.Catalog, "merge", dying)
        with pytest.raises(OSError, match="gone"):
            indexing.run(store, blocks.BlockIndex.open(spark, str(tmp_path / "i")), table(spark, LATER), 60)
    monkeypatch.setattr(catalog.Catalog, "merge", merge)
    index, done = indexing.run(store, blocks.BlockIndex.open(spark, str(tmp_path / "i")), table(spark, LATER), 70)
    assert {r["source_doc_id"]: r["action"] for r in done.collect()} == {"a": "indexed", "c": "deleted", "d": "indexed", "e": "indexed"}
    assert state(store, index) == expected
    rows = {r["source_doc_id"]: r for r in store.load("documents").collect()}
    assert all(rows[k]["id"] == ids[k] for k in ("a", "b", "same"))
    assert rows["a"]["created_at"] == 10 and rows["a"]["last_indexed"] == 70 and rows["b"]["last_indexed"] == 50
    links = {(r["source_id"], r["target_raw"]): r["resolution"] for r in store.load("document_links").collect()}
    assert links[(ids["b"], "Rails")] == "project" and links[(ids["same"], "Wells")] == "unresolved"


def test_increment_takes_named_deletions_only(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    index, _ = indexing.run(store, blocks.BlockIndex.open(spark, str(tmp_path / "i")), table(spark, FIRST), 50)
    some = table(spark, LATER).where("source_doc_id = 'd'")
    gone = spark.createDataFrame([(1, "c"), (1, "never")], "project_id long, source_doc_id string")
    index, done = indexing.run(store, index, some, 60, whole=False, deleted=gone)
    assert {r["source_doc_id"]: r["action"] for r in done.collect()} == {"d": "indexed", "c": "deleted"}
    assert state(store, index)[0] == ["a", "b", "d", "same"]
    _, done = indexing.run(store, index, some.limit(0), 70, whole=False)
    assert done.count() == 0


def test_a_run_leaves_no_staged_copies(spark, tmp_path, monkeypatch):
    """Of what two runs stage only lists of documents and of links' targets stay; no text, chunk, vector or posting does."""
    from corpusloom import staging

    for module in (staging, blocks):
        monkeypatch.setattr(module, "stage_dir", lambda spark: str(tmp_path / "staged"))
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    index, _ = indexing.run(store, blocks.BlockIndex.open(spark, str(tmp_path / "i")), table(spark, FIRST), 50, buckets=2)
    _, done = indexing.run(store, index, table(spark, LATER), 60, buckets=2)
    assert {r["source_doc_id"]: r["action"] for r in done.collect()} == {"a": "indexed", "c": "deleted", "d": "indexed", "e": "indexed"}
    assert {p.name.rpartition("-")[0] for p in (tmp_path / "staged").iterdir()} <= {"touched-documents", "link-targets", "link-ends", "suffixes"}
