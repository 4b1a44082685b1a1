"""Centroid clustering in integers: distances to fixed pivots are stored once and bound every centroid in every round."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Components of a vector, centroids, rounds, seed of the start, integers of one unit, pivots, vectors they are chosen from.
DIM, CENTROIDS, ROUNDS, SEED, SCALE, PIVOTS, POOL = 64, 40, 5, 2, 256, 8, 512
#: Largest integer of a component: squared distances of DIM of them fit a long.
LARGEST = (1 << 27) - 1
#: Vectors that a task compares at a time.
BLOCK = 4096

SUMS = "cluster int, axis int, total long, n long"
ASSIGNED = "vec_id long, cluster int, distance long"


def scaled(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the floored integers, of the vectors with `dim` components, none of them null or non-finite."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.least(F.greatest(F.floor(v.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return vectors.where(x.isNotNull() & (F.size(x) == dim) & good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, as 64-bit integers."""
    d = a - b
    return np.einsum("nd,nd->n", d, d)


def _to_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([_squared(rows, p[None, :]) for p in pivots], axis=1).astype(np.float64))


def choose(pool: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots out of a pool: each is the row furthest, in the sum of its distances, from those before it."""
    chosen, total = [0], np.zeros(len(pool))
    while len(chosen) < min(pivots, len(pool)):
        total += _to_pivots(pool, pool[chosen[-1]][None, :])[:, 0]
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return pool[chosen]


def _stored(batches, pivots: np.ndarray):
    for batch in batches:
        if batch.num_rows:
            far = _to_pivots(_matrix(batch.column("q")), pivots)
            at = pa.array(np.arange(0, far.size + 1, far.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(far.ravel()))], [*batch.schema.names, "far"])


def nearest(rows: np.ndarray, far: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray):
    """Nearest centroid of each row (ties: the smaller number), the exact squared distance, and how many were computed.

    A row and a centroid are at least as far apart as their distances to any pivot differ. The centroid with the least
    bound is measured first; of the others, those whose bound does not exceed that distance are measured too.
    """
    bound = np.zeros((len(rows), len(centroids)))
    for p in range(far.shape[1]):
        np.maximum(bound, np.abs(far[:, p, None] - to_pivots[None, :, p]), out=bound)
    first = bound.argmin(axis=1)
    best = _squared(rows, centroids[first])
    # roots are rounded: a bound must exceed the distance by more than that to rule a centroid out
    slack = 1e-12 * (1 + far.max(axis=1) + to_pivots.max())
    alive = bound <= (np.sqrt(best.astype(np.float64)) + slack)[:, None]
    alive[np.arange(len(rows)), first] = False
    i, j = np.nonzero(alive)
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[np.arange(len(rows)), first] = best
    exact[i, j] = _squared(rows[i], centroids[j])
    label = exact.argmin(axis=1)
    return label, exact[np.arange(len(rows)), label], len(rows) + len(i)


def _labelled(batches, centroids: np.ndarray, to_pivots: np.ndarray):
    for batch in batches:
        for s in range(0, batch.num_rows, BLOCK):
            part = batch.slice(s, BLOCK)
            rows, far = _matrix(part.column("q")), part.column("far")
            far = far.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            yield part, rows, *nearest(rows, far, centroids, to_pivots)


def _sums(batches, centroids: np.ndarray, to_pivots: np.ndarray):
    """One row for each cluster and component that a task has vectors of."""
    total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
    for _, rows, label, _, _ in _labelled(batches, centroids, to_pivots):
        order = np.argsort(label, kind="stable")
        used, first = np.unique(label[order], return_index=True)
        total[used] += np.add.reduceat(rows[order], first, axis=0)
        n += np.bincount(label, minlength=len(n))
    used, dim = np.flatnonzero(n), centroids.shape[1]
    columns = [np.repeat(used, dim).astype(np.int32), np.tile(np.arange(dim, dtype=np.int32), len(used)), total[used].ravel(), np.repeat(n[used], dim)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "axis", "total", "n"])


def _assigned(batches, centroids: np.ndarray, to_pivots: np.ndarray):
    for part, _, label, distance, measured in _labelled(batches, centroids, to_pivots):
        share = np.full(len(label), measured / max(1, len(label)))
        yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(distance), pa.array(share)], ["vec_id", "cluster", "distance", "measured"])


def cluster(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, pivots: int = PIVOTS
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured of the vectors (vec_id, embedding).

    Lloyd's rounds over integers: vectors become floor(scale * x), the first centroids are the vectors with the smallest
    hashes of seed and vec_id, a centroid moves to the floored mean of its vectors. Distances of all vectors to a few
    pivots (chosen far apart among POOL vectors of small hash) are written once beside the vectors; each round, their
    differences to a centroid's own bound its distance from below, and only centroids that the bound leaves are measured,
    exactly. `measured` is how many of them a vector of its block met on average, in the last assignment.
    Vectors are never shuffled: a task sends a row for each cluster and component it met, and the driver holds centroids
    and pivots, whose number is a parameter. Each round reads the written table anew, so a lost task costs itself only.

    Vectors of another length, null ones, and those with null or non-finite components have no row. Integers beyond
    +-2**27 are held at that bound, so that squared distances fit a long; an inertia beyond a long is null. With fewer
    vectors than centroids each starts one. Ties of hash (repeated or null ids; a null id hashes as an empty one) start
    in the order of their components. Repeated rows are vectors of their own. An empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    kept = scaled(vectors, dim, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    pool = [r["q"] for r in kept.select("q", order.alias("hash")).orderBy("hash", "q").limit(max(centroids, POOL)).collect()]
    if not pool:
        return spark.createDataFrame([], f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string, measured double")
    pool = np.array(pool, np.int64).reshape(len(pool), dim)
    place, fixed = pool[:centroids].copy(), choose(pool, pivots)
    stored = common.stage(kept.mapInArrow(lambda it: _stored(it, fixed), "vec_id long, q array<int>, far array<double>"), "pivot-table")
    for _ in range(rounds):
        sums = _run(stored, _sums, SUMS, place, fixed).groupBy("cluster", "axis").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():
            place[r["cluster"], r["axis"]] = r["total"] // r["n"]
    found = common.stage(_run(stored, _assigned, f"{ASSIGNED}, measured double", place, fixed), "clusters")
    common.unstage(stored)
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}

    def held(x):
        return x if x < 1 << 63 else None

    rows = [(j, held(x), held(sum(sums.values())), hashlib.sha256(",".join(map(str, place[j].tolist())).encode()).hexdigest()) for j, x in sums.items()]
    # one row a cluster: the number of centroids bounds what is broadcast
    known = spark.createDataFrame(rows, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(known), F.col("cluster") == F.col("number"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")


def _run(stored: DataFrame, task, schema: str, place: np.ndarray, fixed: np.ndarray) -> DataFrame:
    now, to_pivots = place.copy(), _to_pivots(place, fixed)
    return stored.mapInArrow(lambda it: task(it, now, to_pivots), schema)


def _oracle() -> str:
    """DuckDB SQL for cluster() with its default parameters over embeddings, without `measured`."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT k, q AS c FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, q FROM kept) WHERE k < {CENTROIDS}
)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(row(list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, k)) AS best FROM kept, c{i} GROUP BY r
)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (
  SELECT best[2] AS k, axis, sum(q[axis])::BIGINT AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, {DIM + 1}) AS axes(axis) GROUP BY ALL
), m{i} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY axis) AS moved FROM s{i} GROUP BY k
), c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(moved, c) AS c FROM c{i} LEFT JOIN m{i} USING (k)
)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia,
  sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} ON k = best[2]"""


ORACLE = _oracle()
