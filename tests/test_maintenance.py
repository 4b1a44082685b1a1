"""Catalog, links, freshness, sync, schedules, sources and streams on small hand-written tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import catalog, freshness, graph, reports, schedule, sync
from corpusloom.sources import connector, documents as readers
from corpusloom.streaming import jobs

DOCS = "id long, project_id long, source_doc_id string, file_path string, title string, content_hash string, last_indexed long, created_at long, updated_at long"


def epoch(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.UTC).timestamp())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(1, 1, "a", "notes/a.md", "Alpha", "h1", 10, 100, 200), (2, 1, "b", "notes/sub/b.md", "Beta", "h2", 10, 100, 200), (3, 2, "c", "wiki/c.md", "Alpha", None, 10, None, None), (4, 2, "d", "wiki/sub/b.md", "", "h4", None, 5, 6)],
        DOCS,
    )


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_upsert_documents(spark, docs):
    new = spark.createDataFrame([(None, 1, "a", None, "A2", "h9", 50, 900, 950), (9, 3, "z", "z.md", "Z", "h", 50, 900, None)], DOCS)
    got = {r["source_doc_id"]: r for r in catalog.upsert_documents(docs, new).collect()}
    assert len(got) == 5
    assert (got["a"]["id"], got["a"]["created_at"], got["a"]["updated_at"], got["a"]["file_path"], got["a"]["title"]) == (1, 100, 950, "notes/a.md", "A2")
    assert got["z"]["created_at"] == 900 and got["b"]["title"] == "Beta"


def test_catalog_snapshots(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    assert store.load("document_tags").count() == 0
    store.save("document_tags", spark.createDataFrame([(1, "x")], catalog.SCHEMAS["document_tags"]))
    opened = store.load("document_tags")
    store.save("document_tags", opened.unionByName(spark.createDataFrame([(2, "y")], catalog.SCHEMAS["document_tags"])))
    assert opened.count() == 1 and store.load("document_tags").count() == 2 and store.version("document_tags") == 2


def test_catalog_survives_a_save_that_dies(spark, tmp_path):
    """A snapshot without its marker isn't seen, and the next save steps over it; the note goes with the rows."""
    store, one = catalog.Catalog(spark, str(tmp_path / "c")), spark.createDataFrame([(1, "x")], catalog.SCHEMAS["document_tags"])
    store.save("document_tags", one, note={"batch": 4})
    one.write.parquet(f"{store.path}/document_tags/v2")  # died before the marker
    assert store.version("document_tags") == 1 and store.load("document_tags").count() == 1
    store.save("document_tags", one.unionByName(one))
    assert store.version("document_tags") == 3 and store.load("document_tags").count() == 2 and store.note("document_tags") == {"batch": 4}
    store.vacuum("document_tags", keep=1)
    assert sorted(p.name for p in (tmp_path / "c" / "document_tags").iterdir() if not p.name.startswith(".")) == ["v3", "v3.done"]


def test_a_merge_rewrites_its_own_buckets(spark, tmp_path):
    """One key in a hundred, all in few buckets: only their files are new, the others are the ones of before."""
    store, put = catalog.Catalog(spark, str(tmp_path / "c")), lambda old, new: catalog.upsert(old, new, ["id"])
    table = spark.range(2000).select("id", F.lit("old").alias("x"))
    assert len(store.merge("t", table, ["id"], lambda old, new: new, buckets=32, note={"a": 1})) == 32
    bucket = F.pmod(F.xxhash64("id"), F.lit(32))
    few = table.where(bucket.isin(3, 4, 20)).limit(20).withColumn("x", F.lit("new"))
    few = spark.createDataFrame(few.collect(), few.schema)
    files = set(store.load("t").inputFiles())
    wrote = store.merge("t", few.unionByName(spark.createDataFrame([(-1, "new")], few.schema).where(bucket == 3)), ["id"], put)
    assert wrote and set(wrote) <= {3, 4, 20}
    after = set(store.load("t").inputFiles())
    number = lambda f: int(f.rsplit("_bucket=", 1)[1].split("/")[0])
    assert {number(f) for f in after - files} == set(wrote) == {number(f) for f in files - after}
    assert store.load("t").where("x = 'new'").count() == few.count() and store.load("t").count() >= 2000 and store.note("t") == {"a": 1}
    # deletes; an empty bucket goes; what a kept snapshot reads survives the vacuum
    gone = table.where(bucket == 7).select("id")
    assert store.merge("t", gone, ["id"], lambda old, g: old.join(g, "id", "left_anti"), note={"b": 2}) == []
    store.vacuum("t", keep=1)
    assert store.note("t") == {"b": 2} and store.load("t").where(bucket == 7).count() == 0 and store.load("t").count() == 2000 - gone.count() + store.load("t").where("id < 0").count()
    with pytest.raises(ValueError, match="dealt by"):
        store.merge("t", few, ["x"], put)


def test_a_plain_table_becomes_bucketed(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    store.save("view_counts", spark.createDataFrame([(i, 1, 5) for i in range(50)], catalog.SCHEMAS["view_counts"]))
    store.merge("view_counts", spark.createDataFrame([(3, 2, 9), (99, 1, 9)], catalog.SCHEMAS["view_counts"]), ["document_id"], jobs.merge_views)
    got = {r["document_id"]: (r["count"], r["last_viewed"]) for r in store.load("view_counts").collect()}
    assert len(got) == 51 and got[3] == (3, 9) and got[99] == (1, 9) and got[4] == (1, 5)
    store.save("view_counts", store.load("view_counts").where("document_id < 5"))  # and plain again
    assert store.load("view_counts").count() == 5


def test_view_counts_as_a_stream(spark, tmp_path):
    schema, source, store = "document_id long, ts timestamp", str(tmp_path / "in"), catalog.Catalog(spark, str(tmp_path / "c"))
    for seconds in (0, 100):
        spark.createDataFrame([(r[1], r[2]) for r in access(("", 1, seconds), ("", 1, seconds + 9), ("", 2, seconds))], schema).write.mode("append").parquet(source)
        for _ in range(2):  # a second run adds nothing
            jobs.stream_view_counts(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "k")).awaitTermination(120)
    assert {r["document_id"]: r["count"] for r in store.load("view_counts").collect()} == {1: 4, 2: 2}


def test_default_jobs_of_each_owner(spark):
    day = 86400
    owners = spark.createDataFrame([(1, 10 * day), (2, 10 * day + 4 * 3600), (None, 0)], "owner long, since long")
    own = spark.createDataFrame([(1, "freshness", "{}", "builtin", False, False, 5)], "owner long, name string, schedule_json string, executor string, enabled boolean, immutable boolean, next_run long")
    once = schedule.install_defaults(own, owners)
    got = {(r["owner"], r["name"]): r["next_run"] for r in once.collect()}
    assert got == {
        (1, "freshness"): 5, (1, "prune_co_refs"): 10 * day + 4 * 3600, (2, "freshness"): 11 * day + 3 * 3600, (2, "prune_co_refs"): 11 * day + 4 * 3600,
        (None, "freshness"): 3 * 3600, (None, "prune_co_refs"): 4 * 3600,
    }
    assert schedule.install_defaults(once, owners).count() == once.count()


def test_audit_numbers_have_no_gaps(spark):
    events = spark.range(500).repartition(7).select(F.lit("e").alias("event"), F.lit(1).cast("long").alias("project_id"), F.col("id").alias("n"))
    log = spark.createDataFrame([(7, "start", None, None, 0)], catalog.SCHEMAS["audit_log"])
    got = catalog.audit(log, events, 5, order="n").where("event = 'e'").collect()
    assert sorted((r["id"], r["payload"]) for r in got) == [(8 + n, f'{{"n":{n}}}') for n in range(500)]
    assert sorted(r["id"] for r in catalog.audit(log, events.unionByName(events), 5).collect()) == list(range(7, 1008))


def test_children_aliases_and_violations(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "document_id long, tag string")
    new = spark.createDataFrame([(1, "n"), (1, "n")], "document_id long, tag string")
    changed = spark.createDataFrame([(1,)], "document_id long")
    got = catalog.replace_children(old, new, changed, unique=["document_id", "tag"]).collect()
    assert sorted(map(tuple, got)) == [(1, "n"), (2, "y")]
    alias = spark.createDataFrame([(5, "k"), (3, "k")], "document_id long, alias string")
    assert [tuple(r) for r in catalog.first_alias(alias).collect()] == [(3, "k")]
    bad = spark.createDataFrame([("active",), ("odd",), ("odd",)], "status string")
    assert [tuple(r) for r in catalog.violations("projects", bad).collect()] == [("projects", "status", "odd", 2)]


def test_content_and_cache(spark, docs):
    chunks = spark.createDataFrame([(1, 1, "two"), (1, 0, "one"), (2, 0, None), (2, 1, "x")], "document_id long, chunk_index int, content string")
    assert by(catalog.rebuild_content(chunks), "document_id", "content") == {1: "one\ntwo", 2: "\nx"}
    cache = spark.createDataFrame([("p", "b", "cached", 0, 100), ("p", "c", "old", 0, 10)], "plugin_id string, doc_id string, content string, cached_at long, expires_at long")
    local = spark.createDataFrame([(1, "file")], "document_id long, content string")
    got = catalog.full_content(docs, local, cache, chunks, now=50)
    assert by(got, "document_id", "origin") == {1: "local", 2: "cache", 3: "not_found", 4: "not_found"}
    # a time to live below ten minutes counts as ten; touching doesn't revive what has expired
    entry = spark.createDataFrame([("p", "b", "new")], "plugin_id string, doc_id string, content string")
    assert by(catalog.cache_set(cache, entry, now=50, ttl_minutes=1), "doc_id", "expires_at") == {"b": 650, "c": 10}
    assert by(catalog.cache_touch(cache, now=50), "doc_id", "expires_at") == {"b": 50 + 360 * 60, "c": 10}
    assert catalog.cache_cleanup(cache, 50).count() == 1 and catalog.cache_invalidate(cache, "p").count() == 0


def test_audit_appends(spark):
    log = catalog.empty(spark, "audit_log")
    events = spark.createDataFrame([("sync", 1, "n")], "event string, project_id long, note string")
    once = catalog.audit(log, events, 7)
    first, second = catalog.audit(once, events, 8).orderBy("id").collect()  # ids grow; they may have gaps
    assert 0 < first["id"] < second["id"] and (second["event"], second["payload"], second["created_at"]) == ("sync", '{"note":"n"}', 8)


def test_suffix_join_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab/é") for _ in range(rng.randint(0, n)))
    paths = [(rng.choice("xy"), word(9), i) for i in range(600)] + [(None, "ab", 9), ("x", None, 9), ("x", "a%b", 700), ("y", "ab" * 40, 5), ("y", "ab" * 40, 4)]
    targets = [(rng.choice("xyz"), word(5)) for _ in range(400)] + [("x", ""), ("y", "b"), ("x", "%b"), (None, "a"), ("x", None), ("y", "ab" * 40)]
    got = {(r["scope"], r["suffix"]): r["id"] for r in graph.suffix_join(spark.createDataFrame(targets, "scope string, suffix string").repartition(3), spark.createDataFrame(paths, "scope string, path string, id long")).collect()}
    want = {}
    for scope, suffix in targets:
        ids = [i for s, p, i in paths if s == scope and s is not None and p is not None and suffix is not None and p.endswith(suffix)]
        if ids:
            want[scope, suffix] = min(ids)
    assert got == want and len(want) > 100
    none = spark.createDataFrame([], "scope string, suffix string")
    assert graph.suffix_join(none, spark.createDataFrame(paths, "scope string, path string, id long")).count() == 0
    assert graph.suffix_join(spark.createDataFrame(targets, "scope string, suffix string"), spark.createDataFrame([], "scope string, path string, id long")).count() == 0


def test_links_resolve_in_order(spark, docs):
    links = spark.createDataFrame([(1, "Beta"), (1, "Alpha"), (1, "../sub/b.md|shown"), (3, "b"), (2, "nick"), (1, "nothing"), (1, "doc://ext/c"), (1, "ES/SUB/B"), (1, "iki/c"), (1, ""), (9, "beta")], "source_id long, target_raw string")
    aliases = spark.createDataFrame([(4, "nick"), (3, "nick")], "document_id long, alias string")
    projects = spark.createDataFrame([(1, "own"), (2, "ext")], "id long, source_project_id string")
    got = {(r["source_id"], r["target_raw"]): (r["target_id"], r["resolution"]) for r in graph.resolve(links, docs, aliases, projects).collect()}
    assert got == {
        (1, "Beta"): (2, "project"), (1, "Alpha"): (1, "project"), (1, "../sub/b.md|shown"): (2, "project"), (3, "b"): (4, "project"),
        (2, "nick"): (3, "alias"), (1, "nothing"): (None, "unresolved"), (1, "doc://ext/c"): (3, "uri"),
        (1, "ES/SUB/B"): (2, "project"), (1, "iki/c"): (3, "global"), (1, ""): (None, "unresolved"), (9, "beta"): (2, "global"),
    }


def test_paths_in_a_cyclic_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 33), (33, 4), (1, 1)], "source_id long, target_id long")
    assert by(graph.distances(edges, spark.createDataFrame([(1,)], "id long")), "id", "hops") == {1: 0, 2: 1, 3: 2, 33: 3, 4: 4}
    assert [tuple(r) for r in graph.shortest_path(edges, 1, 4).collect()] == [([1, 2, 3, 33, 4], 4)]
    assert graph.shortest_path(edges, 1, 4, max_hops=3).count() == 0 and graph.shortest_path(edges, 4, 1).count() == 0


def test_two_sided_search_equals_brute_force(spark):
    """Random graphs with cycles and loops: length and smallest path; a source with very many neighbours stays cheap."""
    import random

    rng = random.Random(4)
    pairs = [(rng.randint(0, 40), rng.choice([None, *range(41)])) for _ in range(90)]
    edges = spark.createDataFrame(pairs, "source_id long, target_id long")
    for source, target in [(0, 40), (3, 17), (5, 5), (8, 30), (11, 2), (0, 99)]:
        best, paths = None, [[source]]
        for _ in range(7):
            best = min((p for p in paths if p[-1] == target), default=None)
            if best:
                break
            paths = [[*p, t] for p in paths for t in sorted({b for a, b in pairs if a == p[-1] and b is not None and b not in p})]
        got = [tuple(r) for r in graph.shortest_path(edges, source, target).collect()]
        assert got == ([(best, len(best) - 1)] if best else []), (source, target)
    hub = spark.range(3000).select(F.lit(-1).cast("long").alias("source_id"), F.col("id").alias("target_id")).unionByName(spark.createDataFrame([(7, -2), (-2, -3)], "source_id long, target_id long"))
    assert [tuple(r) for r in graph.shortest_path(hub, -1, -3).collect()] == [([-1, 7, -2, -3], 3)]


def test_freshness_life_cycle(spark, docs):
    day = 86400
    projects = spark.createDataFrame([(1, "github", '{"sensitivity_mode":"STRICT"}'), (2, "vault", None)], "id long, source_type string, freshness_policy_json string")
    rows = freshness.initial(docs, projects, as_of=200)
    assert by(rows, "document_id", "retention_tier") == {1: "short", 2: "short", 3: "mid", 4: "mid"}
    now = 200 + 45 * day
    aged = freshness.recompute(rows, docs, projects, as_of=now)
    scores = by(aged, "document_id", "freshness_score")
    assert scores[1] == pytest.approx(25.0) and scores[3] == pytest.approx(100 * math.sqrt(0.5))
    assert by(aged, "document_id", "status")[1] == "stale" and by(aged, "document_id", "status")[3] == "fresh"
    longer = freshness.set_tier(aged, docs, projects, 1, "long", now)
    assert by(longer, "document_id", "tier_source")[1] == "user" and by(longer, "document_id", "freshness_score")[1] == pytest.approx(100 * 2 ** (-45 / 90))
    with pytest.raises(ValueError):
        freshness.set_tier(aged, docs, projects, 1, "eternal", now)
    changes = freshness.content_changes(docs, docs.withColumn("content_hash", F.when(F.col("id") == 1, "new").otherwise(F.col("content_hash"))), now)
    fresh = {r["document_id"]: r for r in freshness.reset_changed(aged, changes).collect()}
    assert (fresh[1]["status"], fresh[1]["change_count"], fresh[2]["change_count"]) == ("fresh", 1, 0)


def test_needs_reindexing_and_full_index(spark, docs):
    incoming = spark.createDataFrame([(1, "a", "h1", 200), (1, "b", "h2", 300), (2, "c", "x", None), (2, "new", "h", 1)], "project_id long, source_doc_id string, content_hash string, updated_at long")
    assert by(sync.needs_reindexing(incoming, docs), "source_doc_id", "needs") == {"a": False, "b": True, "c": True, "new": True}
    after, happened = sync.full_index(incoming, docs, started=999)
    assert by(happened, "source_doc_id", "action") == {"a": "skipped", "b": "indexed", "c": "indexed", "new": "indexed", "d": "deleted"}
    assert by(after, "source_doc_id", "last_indexed") == {"a": 999, "b": 999, "c": 999, "new": 999}


def test_conflicts(spark, docs):
    same = spark.createDataFrame([("same text",)], "t string").select(X.content_hash(F.col("t"))).first()[0]
    pairs = spark.createDataFrame([(1, same, "same text"), (2, "other", "remote")], "document_id long, local_hash string, remote string")
    assert by(sync.resolve_conflicts(pairs), "document_id", "decision") == {1: "skip", 2: "use_remote"}
    out, events = sync.apply_conflicts(docs, pairs)
    assert by(out, "id", "content_hash")[1] == "h1" and by(out, "id", "content_hash")[2] not in ("h2", None) and events.count() == 1


def test_sync_policies(spark):
    rows = [(1, '{"mode":"realtime"}', 0, True), (2, '{"mode":"on_focus"}', 900, True), (3, '{"mode":"on_focus"}', 900, False), (4, '{"mode":"interval","interval_seconds":100}', 895, True), (5, None, None, True)]
    table = spark.createDataFrame(rows, "id long, sync_policy_json string, last_synced long, is_local boolean")
    assert by(sync.should_sync(table, "focus", 1000), "id", "sync") == {1: False, 2: True, 3: False, 4: False, 5: False}
    assert by(sync.should_sync(table, "periodic", 1000), "id", "sync") == {1: False, 2: False, 3: False, 4: True, 5: False}
    assert all(by(sync.should_sync(table, "manual", 1000), "id", "sync").values())
    waits = spark.range(8).select("id", sync.backoff(F.col("id")).alias("w"))
    assert [by(waits, "id", "w")[i] for i in range(6)] == [10, 20, 40, 80, 160, 300]


def test_retry():
    waits, fails = [], iter([sync.RateLimited(5), OSError(), OSError()])

    def call():
        for e in fails:
            raise e
        return "done"

    assert sync.with_retry(call, retries=2, sleep=waits.append, jitter=lambda: 0) == "done" and waits == [5, 1.0, 2.0]
    with pytest.raises(sync.RateLimited):
        sync.with_retry(lambda: (_ for _ in ()).throw(sync.RateLimited(301)), sleep=waits.append)
    tries = []
    with pytest.raises(sync.Fatal):
        sync.with_retry(lambda: tries.append(1) or (_ for _ in ()).throw(sync.Fatal()), sleep=waits.append)
    assert len(tries) == 1


def test_reindex_scopes(spark, docs):
    assert by(sync.reindex_targets(docs, 2), "source_doc_id", "action") == {"c": "skip", "d": "reindex"}
    assert by(sync.reindex_targets(docs, 1, "documents", ["b"], force=True), "source_doc_id", "action") == {"b": "reindex"}
    after, summary = sync.reindex(docs, 2, now=77, dry_run=True)
    assert by(after, "id", "last_indexed")[4] is None and summary.first()["processed"] == 1
    assert by(sync.reindex(docs, 2, now=77)[0], "id", "last_indexed")[4] == 77
    with pytest.raises(ValueError):
        sync.reindex_targets(docs, 1, "galaxy")


def test_next_run(spark):
    after = epoch(2024, 1, 31, 12, 0)  # a Wednesday
    kinds = [
        (1, '{"type":"interval","seconds":90}', after + 90), (2, '{"type":"daily","hour":3,"minute":30}', epoch(2024, 2, 1, 3, 30)), (3, '{"type":"daily","hour":13}', epoch(2024, 1, 31, 13)),
        (4, '{"type":"weekly","weekday":0,"hour":1}', epoch(2024, 2, 4, 1)), (5, '{"type":"weekly","weekday":3,"hour":12}', epoch(2024, 2, 7, 12)), (6, '{"type":"monthly","day":31,"hour":0}', epoch(2024, 2, 29)),
        (7, '{"type":"daily","hour":12,"minute":0}', epoch(2024, 2, 1, 12)), (8, "{}", None),
    ]
    table = spark.createDataFrame([k[:2] for k in kinds], "id long, s string").select("id", schedule.next_run(F.col("s"), F.lit(after).cast("long")).alias("at"))
    assert by(table, "id", "at") == {k[0]: k[2] for k in kinds}


def test_jobs(spark):
    jobs_table = spark.createDataFrame([(1, "f", '{"type":"interval","seconds":60}', "builtin", True, True, None, 100, None), (2, "g", '{"type":"interval","seconds":60}', "builtin", True, False, 5, 90, None)], catalog.SCHEMAS["scheduled_jobs"])
    assert [r["id"] for r in schedule.due_jobs(jobs_table, 100).collect()] == [1]
    assert [r["id"] for r in schedule.due_jobs(jobs_table, 100, idle_minutes=6).collect()] == [2, 1]
    done = spark.createDataFrame([(1, 100, 110, "ok", None)], catalog.SCHEMAS["job_runs"])
    after, runs = schedule.finish(jobs_table, catalog.empty(spark, "job_runs"), done)
    assert by(after, "id", "next_run") == {1: 170, 2: 90} and runs.count() == 1
    edited = schedule.edit(jobs_table, 1, 500, name="renamed")
    assert by(edited, "id", "name")[1] == "f" and by(edited, "id", "next_run")[1] == 560
    refs = spark.createDataFrame([(1, 2, 2, 0), (1, 3, 3, 0), (2, 3, 1, 40 * 86400)], catalog.SCHEMAS["document_co_refs"])
    assert schedule.prune_co_refs(refs, 45 * 86400).count() == 2


def test_hits_by_project(spark):
    hits = spark.createDataFrame([(1, "p", 2), (2, "p", 1), (3, "q", 3)], "document_id long, project string, rank int")
    assert by(reports.hits_by_project(hits), "project", "document_ids") == {"p": [2, 1], "q": [3]}


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "no.md").write_text("x")
    (tmp_path / "a b.md").write_text("---\ntitle: Named\ntags: [t1, t2]\n---\n# Heading\nbody #tag3 [[Other|o]]")
    (tmp_path / "sub" / "c+d.md").write_text("# From heading\ntext")
    (tmp_path / "sub" / "plain.md").write_text("no heading é")
    (tmp_path / "skip.txt").write_text("x")
    got = {r["source_doc_id"]: r for r in readers.parse_markdown(readers.markdown_listing(spark, str(tmp_path))).collect()}
    assert {k: r["title"] for k, r in got.items()} == {"a b.md": "Named", "sub/c+d.md": "From heading", "sub/plain.md": "plain"}
    assert sorted(got["a b.md"]["tags"]) == ["t1", "t2", "tag3"] and got["a b.md"]["links"] == ["Other"]


def test_write_back(spark, tmp_path):
    rows = spark.createDataFrame([("f", "T", "one", "2024"), ("f", "T", "two", "2024"), ("../up", "T", "bad", "2024")], "folder string, title string, content string, created string")
    assert [r["error"] for r in readers.write_documents(rows, str(tmp_path)).collect() if r["error"]] == ["folder isn't a valid path"]
    back = readers.parse_markdown(readers.markdown_listing(spark, str(tmp_path))).collect()
    assert len(back) == 2 and {r["title"] for r in back} == {"T"}


def test_code_host_and_pages(spark):
    issues = spark.createDataFrame([(1, "Bug", "see [[x]]", "open", "u", None, "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"), (2, "PR", "", "open", "u", "yes", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")], "number long, title string, body string, state string, html_url string, pull_request string, created_at string, updated_at string")
    row = readers.code_host(issues=issues).collect()
    assert [(r["source_doc_id"], r["tags"], r["links"], r["updated_at"]) for r in row] == [("issue:1", ["issue", "open"], ["x"], epoch(2024, 1, 2))]
    page = readers.pages(spark.createDataFrame([(7, "u", '<title> T </title><a href="/a">x</a><a href="/a">y</a>')], "page_id long, url string, html string")).first()
    assert (page["title"], page["links"]) == ("T", ["/a"])


def test_wiki_tree(spark):
    rows = [(1, None, "Root", "<p>r</p>", ["l"], "u", "2024-01-01T00:00:00Z"), (2, 1, "Kid", "<h1>K</h1><p>b</p>", [], "u", "2024-01-03T00:00:00Z"), (3, None, "Other", None, [], "u", "2024-01-03T00:00:00Z")]
    table = spark.createDataFrame(rows, "page_id long, parent_id long, title string, storage string, labels array<string>, url string, updated_at string")
    got = readers.wiki_pages(table, root=1).collect()
    assert [r["source_doc_id"] for r in got] == ["1", "2"] and got[1]["content"].startswith("# K") and got[0]["metadata"] == {"is_parent": "true"}
    assert [r["source_doc_id"] for r in readers.wiki_pages(table, since=epoch(2024, 1, 2)).collect()] == ["2", "3"]


def test_connector_reads_pages_and_changes(spark, tmp_path):
    class Numbers(connector.DocumentSource):
        @classmethod
        def name(cls):
            return "numbers"

        def total(self):
            return 7

        def page(self, start, size):
            return [{"source_doc_id": str(i), "updated_at": i} for i in range(start, min(start + size, 7))]

        def changes(self, cursor):
            at = cursor.get("at", 0)
            return ([{"source_doc_id": f"c{at}", "content": "x", "updated_at": at}], {"at": at + 1}) if at < 2 else ([], cursor)

    connector.register_source(spark, Numbers)
    read = spark.read.format("numbers").option("page_size", 3).load()
    assert read.rdd.getNumPartitions() == 3 and sorted(r["source_doc_id"] for r in read.collect()) == list("0123456")


def access(*rows):
    return [(s, d, dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=t)) for s, d, t in rows]


def test_session_pairs_batch_and_stream(spark, tmp_path):
    schema = "session_id string, document_id long, ts timestamp"
    rows = access(("s1", 10, 0), ("s1", 20, 60), ("s1", 10, 90), ("s2", 20, 0), ("s2", 10, 10), ("s3", 5, 0), ("s3", 6, 4000))
    table = spark.createDataFrame(rows, schema)
    assert [(r[0], r[1], r[2]) for r in jobs.session_pairs(table).collect()] == [(10, 20, 2)]
    source, store = str(tmp_path / "in"), catalog.Catalog(spark, str(tmp_path / "c"))
    table.write.parquet(source)
    spark.createDataFrame(access(("late", 1, 90_000)), schema).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new and counts nothing twice
        jobs.stream_session_pairs(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "k")).awaitTermination(120)
    assert [(r[0], r[1], r[2]) for r in store.load("document_co_refs").collect()] == [(10, 20, 2)]


def test_stream_counts_a_batch_once_when_it_dies(spark, tmp_path, monkeypatch):
    """The stream dies just before and just after the act that saves a batch; run again, each pair counts once."""
    schema = "session_id string, document_id long, ts timestamp"
    source, store = str(tmp_path / "in"), catalog.Catalog(spark, str(tmp_path / "c"))
    spark.createDataFrame(access(("s1", 1, 0), ("s1", 2, 9), ("late", 3, 90_000)), schema).write.parquet(source)
    save = catalog.Catalog.merge

    def run():
        stream = jobs.stream_session_pairs(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "k"))
        try:
            stream.awaitTermination(120)
        except Exception:
            return False
        return True

    def before(self, *a, **b):
        raise OSError("gone")

    def after(self, *a, **b):
        save(self, *a, **b)
        raise OSError("gone")

    for fault in (before, after):
        monkeypatch.setattr(catalog.Catalog, "merge", fault)
        assert not run()
        monkeypatch.setattr(catalog.Catalog, "merge", save)
    assert run()
    assert [tuple(r)[:3] for r in store.load("document_co_refs").collect()] == [(1, 2, 1)]


def test_views_and_debounce(spark):
    views = spark.createDataFrame(access(("", 1, 0), ("", 1, 9), ("", 2, 3)), "x string, document_id long, ts timestamp")
    assert by(jobs.view_counts(views), "document_id", "count") == {1: 2, 2: 1}
    changes = spark.createDataFrame([("p", 0.0), ("p", 1.0), ("p", 4.0), ("q", 1.0)], "path string, s double").select("path", F.timestamp_seconds("s").alias("ts"))
    assert jobs.debounced(changes).count() == 3
