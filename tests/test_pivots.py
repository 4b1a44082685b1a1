"""Searches by pivots against comparing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import pivots, search

SCHEMA = "chunk_id long, embedding array<tinyint>"


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(parts)


def asked(vectors, step):
    return vectors.where(F.col("chunk_id") % step == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


def rows(found):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["distance"], 9), round(r["score"], 12)) for r in found.collect())


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    middles = rng.integers(-100, 101, (12, 8))
    return np.clip(middles[rng.integers(0, 12, n)] + rng.integers(-6, 7, (n, 8)), -128, 127)


def test_equals_comparing_all_and_compares_few(spark, tmp_path):
    x = clustered(1500)
    x[200:700] = x[7]  # a third are copies, so ties by id decide
    vectors = table(spark, x)
    index = pivots.PivotIndex.build(vectors, str(tmp_path / "i"))
    queries = asked(vectors, 50)
    for k, most in ((7, None), (7, 9.0), (1, 0.0), (600, None)):
        assert rows(index.search(queries, k, most)) == rows(search.knn(vectors, queries, k, most))
    seen = {r["query_id"]: r["compared"] for r in index.compared(queries, 7, None).collect()}
    assert len(seen) == 30 and sum(seen.values()) < 0.5 * 30 * 1500
    assert rows(pivots.PivotIndex(spark, str(tmp_path / "i")).search(queries, 3, None)) == rows(search.knn(vectors, queries, 3, None))


def test_vectors_without_clusters(spark):
    rng = np.random.default_rng(2)
    vectors = table(spark, rng.integers(-3, 4, (700, 6)))
    queries = asked(vectors, 2)
    assert rows(pivots.PivotIndex.build(vectors, pivots=20).search(queries, 7, None)) == rows(search.knn(vectors, queries, 7, None))


def test_blocks_and_conditions_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 9)
    monkeypatch.setattr(pivots, "CONDITIONS", 2)
    vectors = table(spark, clustered(600, 8))
    queries = asked(vectors, 20)
    assert rows(pivots.PivotIndex.build(vectors).search(queries, 5, None)) == rows(search.knn(vectors, queries, 5, None))


def test_bounds_reach_the_scan(spark):
    vectors = table(spark, clustered(600))
    found = pivots.PivotIndex.build(vectors)
    near = np.zeros((1, len(found.cells)), bool)
    near[0, 3] = True
    root = np.full((1, len(found.cells)), 10.0)
    plan = found._scan(np.array([1]), np.zeros((1, 8), np.int64), root, near, np.array([4]), 3)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cell,3), LessThanOrEqual(cell,3)" in plan and "IsNotNull(square)" in plan


def test_odd_tables(spark):
    some = spark.createDataFrame([(1, [1, 2]), (2, None), (None, [1, 1]), (3, [None, 1]), (4, [-128, 127])], SCHEMA)
    index = pivots.PivotIndex.build(some)
    queries = spark.createDataFrame([(9, [1, 2]), (8, None), (None, [1, 1])], "query_id long, vector array<tinyint>")
    assert [(r[0], r[2]) for r in rows(index.search(queries, 5, None))] == [(9, 1), (9, 4)]
    assert rows(index.search(queries.limit(0), 5, None)) == []
    with pytest.raises(ValueError, match="components"):
        index.search(spark.createDataFrame([(9, [1])], "query_id long, vector array<tinyint>"), 5)
    none = pivots.PivotIndex.build(some.limit(0))
    assert rows(none.search(queries, 5, None)) == []
