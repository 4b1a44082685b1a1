"""Streams of changes: a feed applied to the catalog with its cursor, and changes debounced by path."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import catalog, sync
from corpusloom.sources import connector
from corpusloom.streaming import jobs

FEED = "source_doc_id string, content string, updated_at long, deleted boolean"
DOCS = "id long, project_id long, source_doc_id string, file_path string, title string, content_hash string, last_indexed long, created_at long, updated_at long"


def test_change_feed_reaches_the_catalog(spark, tmp_path):
    """Each batch's latest row of a document is applied, deletions too; a batch that runs again changes nothing."""
    source, store = str(tmp_path / "in"), catalog.Catalog(spark, str(tmp_path / "c"))
    store.save("documents", spark.createDataFrame([(1, 1, "old", None, "t", "h", 1, 1, 1), (2, 1, "gone", None, "t", "h", 1, 1, 1)], DOCS))

    def apply(batch, number):
        if number <= store.note("documents").get("feed", -1):
            return
        rows = batch.withColumns({"project_id": F.lit(1).cast("long"), "content_hash": F.sha2("content", 256)})
        after, cursor = sync.apply_page(store.load("documents"), rows.where("not deleted").drop("content", "deleted"), rows.where("deleted").select("project_id", "source_doc_id"), str(number), 50)
        store.save("documents", after, note={"feed": number, "cursor": cursor})

    def run():
        jobs.stream_changes(spark.readStream.schema(FEED).parquet(source), apply, str(tmp_path / "k")).awaitTermination(120)

    spark.createDataFrame([("old", "a", 10, False), ("old", "b", 20, False), ("new", "x", 5, False), ("gone", None, 30, True)], FEED).coalesce(1).write.parquet(source)
    run()
    run()
    got = {r["source_doc_id"]: (r["updated_at"], r["content_hash"]) for r in store.load("documents").collect()}
    assert set(got) == {"old", "new"} and got["old"][0] == 20 and store.note("documents") == {"feed": 0, "cursor": "0"} and store.version("documents") == 2
    spark.createDataFrame([("new", "y", 40, False)], FEED).write.mode("append").parquet(source)
    run()
    assert store.note("documents")["cursor"] == "1" and {r["source_doc_id"]: r["updated_at"] for r in store.load("documents").collect()} == {"old": 20, "new": 40}


def let_through(times, quiet=0.5, cooldown=2.0):
    """A clock of tenths of seconds, without any state but a list."""
    out, passed = [], None
    todo = sorted(times)
    while todo:
        at = todo.pop(0)
        if passed is not None and at < passed + cooldown:
            continue
        while todo and todo[0] <= at + quiet:
            at = todo.pop(0)
        out.append(at)
        passed = at + quiet
    return out


def changes(spark, rows):
    return spark.createDataFrame(rows, "path string, s double").select("path", F.timestamp_millis((F.round(F.col("s") * 1000)).cast("long")).alias("ts"))


TIMES = {"p": [0.0, 0.3, 0.6, 1.0, 2.4, 3.8, 4.0, 9.0], "q": [0.1], "r": [0.0, 0.5, 1.1, 1.2, 3.5, 3.9, 4.3, 7.0, 7.6], "s": [5.0, 5.0, 5.2, 5.9]}


def test_debounce_in_batch(spark):
    rows = changes(spark, [(p, t) for p, times in TIMES.items() for t in times]).repartition(3)
    got = {}
    for r in jobs.debounced_quietly(rows).select("path", F.col("ts").cast("double").alias("s")).collect():
        got.setdefault(r["path"], []).append(round(r["s"], 3))
    assert {p: sorted(x) for p, x in got.items()} == {p: let_through(t) for p, t in TIMES.items()}


def test_stream_debounces_by_path(spark, tmp_path):
    """The stream lets through what the batch form does, whatever the micro-batches, over a restart."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        stream = jobs.stream_debounced(spark.readStream.schema("path string, ts timestamp").parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start().awaitTermination(180)

    try:
        for low, high in ((0, 1.05), (1.05, 4.1), (4.1, 100)):
            changes(spark, [(p, t) for p, times in TIMES.items() for t in times if low <= t < high]).write.mode("append").parquet(source)
            run()
        changes(spark, [("end", 500.0)]).write.mode("append").parquet(source)
        run()
    finally:
        spark.conf.unset(provider)
    got = {}
    for r in spark.read.parquet(out).select("path", F.col("ts").cast("double").alias("s")).collect():
        got.setdefault(r["path"], []).append(round(r["s"], 3))
    assert {p: sorted(x) for p, x in got.items() if p != "end"} == {p: let_through(t) for p, t in TIMES.items()}


class Log(connector.ChangeFeed):
    """Changes in numbered files beside a head; asked heads are noted down."""

    @classmethod
    def name(cls):
        return "change_log"

    def head(self, etag):
        from pathlib import Path

        root = Path(self.options["root"])
        found = json.loads((root / "head.json").read_text())
        with (root / "asked").open("a") as f:
            f.write("304\n" if found["etag"] == etag else "200\n")
        return None if found["etag"] == etag else (found["at"], found["etag"])

    def changes(self, low, high):
        from pathlib import Path

        for n in range(low, high):
            yield json.loads((Path(self.options["root"]) / f"{n}.json").read_text())


def put(root, changes):
    """Appends (id, content, deleted) to the log."""
    root.mkdir(exist_ok=True)
    at = len([p for p in root.glob("*.json") if p.stem.isdigit()])
    for n, (doc, content, gone) in enumerate(changes, at):
        (root / f"{n}.json").write_text(json.dumps({"position": n, "source_doc_id": doc, "title": doc, "content": content, "updated_at": 100 + n, "created_at": 100 + n, "deleted": gone}))
    (root / "head.json").write_text(json.dumps({"at": at + len(changes), "etag": f"e{at + len(changes)}"}))


def test_feed_is_read_in_stretches():
    reader = Log({"root": "x", "stretch": "3"}).streamReader(None)
    assert [(p.low, p.high) for p in reader.partitions({"at": 2, "etag": None}, {"at": 9, "etag": "e"})] == [(2, 5), (5, 8), (8, 9)]
    assert reader.partitions({"at": 9, "etag": "e"}, {"at": 9, "etag": "e"}) == [] and reader.last == {"at": 9, "etag": "e"}


def test_feed_with_deletions_survives_restarts(spark, tmp_path, monkeypatch):
    """Updates, deletions and re-creations reach the catalog once, though the query dies before and after a save."""
    root, store = tmp_path / "log", catalog.Catalog(spark, str(tmp_path / "c"))
    connector.register_source(spark, Log)

    def run():
        feed = spark.readStream.format("change_log").option("root", str(root)).option("stretch", 2).load()
        jobs.stream_feed(feed, store, str(tmp_path / "k"), 1, 500).awaitTermination(120)

    def documents():
        return {r["source_doc_id"]: (r["updated_at"], r["created_at"]) for r in store.load("documents").collect()}

    put(root, [("a", "one", False), ("b", "two", False), ("a", "later", False), ("c", "x", False), ("c", None, True)])
    run()
    assert documents() == {"a": (102, 102), "b": (101, 101)}
    version = store.version("documents")
    run()  # nothing new: the head says so
    assert store.version("documents") == version and (root / "asked").read_text().splitlines()[-1] in ("304", "200")
    put(root, [("b", None, True), ("a", "again", False), ("c", "back", False)])
    merge = catalog.Catalog.merge

    def before(self, *a, **b):
        raise OSError("gone")

    def after(self, *a, **b):
        merge(self, *a, **b)
        raise OSError("gone")

    for fault in (before, after):
        monkeypatch.setattr(catalog.Catalog, "merge", fault)
        with pytest.raises(Exception, match="gone"):
            run()
        monkeypatch.setattr(catalog.Catalog, "merge", merge)
    run()
    assert documents() == {"a": (106, 102), "c": (107, 107)} and store.version("documents") == version + 1
    assert store.load("documents").select("id").distinct().count() == 2
