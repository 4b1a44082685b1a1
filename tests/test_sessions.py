"""Sessions of any length as a stream, against the batch form."""

import datetime as dt
import random

import pytest

from corpusloom.operators import catalog
from corpusloom.streaming import jobs

SCHEMA = "session_id string, document_id long, ts timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def counts(rows):
    return sorted((r["doc_a_id"], r["doc_b_id"], r["co_occurrence_count"]) for r in rows.collect())


def test_pairs_equal_the_batch_form_over_restarts_and_failures(spark, tmp_path, monkeypatch, rocks):
    """Accesses come out of order, in batches that cut sessions; the query dies after each of its two saves."""
    source, store = str(tmp_path / "in"), catalog.Catalog(spark, str(tmp_path / "c"))
    rng = random.Random(3)
    rows = [("s%d" % rng.randrange(4), rng.randrange(9), rng.randrange(0, 6000)) for _ in range(120)]
    rows += [("long", d, 30 * d) for d in range(100, 160)] + [("long", 100, 5000), ("x", None, 3), (None, 4, 4), ("edge", 1, 0), ("edge", 2, 300), ("edge", 3, 599)]
    batches = [[r for r in rows if i * 2000 <= r[2] < (i + 1) * 2000] for i in range(3)]
    merge = catalog.Catalog.merge
    die = {"at": None}

    def dying(self, name, *a, **b):
        when = die["at"]
        if when == (name, "before"):
            raise OSError("gone")
        merge(self, name, *a, **b)
        if when == (name, "after"):
            raise OSError("gone")

    monkeypatch.setattr(catalog.Catalog, "merge", dying)

    def run():
        stream = jobs.stream_long_sessions(spark.readStream.schema(SCHEMA).parquet(source), store, str(tmp_path / "k"))
        stream.awaitTermination(180)

    faults = [None, ("document_co_refs", "after"), ("session_documents", "after")]
    for batch, fault in zip(batches, faults, strict=True):
        rng.shuffle(batch)
        table = spark.createDataFrame([(s, d, at(t)) for s, d, t in batch], SCHEMA)
        table.coalesce(1).write.mode("append").parquet(source)
        die["at"] = fault
        if fault:
            with pytest.raises(Exception, match="gone"):
                run()
            die["at"] = None
        run()
    spark.createDataFrame([("end", 1, at(90_000))], SCHEMA).write.mode("append").parquet(source)
    run()
    whole = spark.createDataFrame([(s, d, at(t)) for s, d, t in rows], SCHEMA)
    assert counts(store.load("document_co_refs")) == counts(jobs.session_pairs(whole))


def test_sessions_are_cut_as_in_batch(spark, tmp_path, rocks):
    """Gaps of exactly the idle time end a session; a repeated document counts once; times are those of the first."""
    source, store = str(tmp_path / "in"), catalog.Catalog(spark, str(tmp_path / "c"))
    rows = [("s", 1, 0), ("s", 2, 299), ("s", 1, 598), ("s", 3, 898), ("t", 7, 5), ("t", 7, 6), ("end", 0, 90_000)]
    spark.createDataFrame([(s, d, at(t)) for s, d, t in rows], SCHEMA).coalesce(1).write.parquet(source)
    jobs.stream_long_sessions(spark.readStream.schema(SCHEMA).parquet(source), store, str(tmp_path / "k")).awaitTermination(180)
    got = [tuple(r) for r in store.load("document_co_refs").select("doc_a_id", "doc_b_id", "co_occurrence_count", "last_accessed").collect()]
    assert got == [(1, 2, 1, int(at(299).replace(tzinfo=dt.UTC).timestamp()))]
    assert store.load("session_documents").count() == 0 or store.load("session_documents").where("session_id = 't'").count() <= 1
