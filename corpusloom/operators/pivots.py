"""Exact k nearest int8 vectors without comparing all: vectors by nearest pivot, read by bounds on their distances."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import stage, stage_dir
from .search import KNN_QUERIES, KNN_ROWS, MAX_DISTANCE, vector_score

#: Vectors that pivots are learned from, pivots at most, rounds of moving them, queries searched together, conditions of a scan.
SAMPLE, MOST, ROUNDS, BLOCK, CONDITIONS = 20_000, 1024, 4, 4096, 64
#: What rounding may add to a distance from integers, many times over.
SLACK = 1e-6
_FAR = np.iinfo(np.int64).max
_MADE = "query_id long, chunk_id long, square long, compared long"


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and of b, int8 values in any type, as exact integers."""
    exact = np.float32 if a.shape[1] <= 1024 else np.float64  # sums of products of int8 are exact in these
    own = lambda x: (x.astype(np.int64) ** 2).sum(1)
    return own(a)[:, None] + own(b)[None, :] - 2 * np.rint(a.astype(exact) @ b.astype(exact).T).astype(np.int64)


def _learn(sample: np.ndarray, n: int) -> np.ndarray:
    """n or fewer different pivots: seeded picks, moved to the middles of what is nearest to them, in order along the
    direction in which they differ most, so that near cells have near numbers."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(0)
    found = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)].astype(np.int64)
    for _ in range(ROUNDS):
        near = np.concatenate([_squares(sample[i : i + KNN_ROWS], found).argmin(1) for i in range(0, len(sample), KNN_ROWS)])
        total = np.zeros(found.shape)
        np.add.at(total, near, sample)
        held = np.bincount(near, minlength=len(found))[:, None]
        found = np.where(held > 0, np.rint(total / np.maximum(held, 1)), found).astype(np.int64)
    found = np.unique(found, axis=0)
    middle = found - found.mean(0)
    return found[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]


class PivotIndex:
    """Vectors (chunk_id, int8 embedding of one length) at a path, sorted by nearest pivot and distance from it.

    A vector x of pivot c is no nearer to a query q than |d(q, c) - d(x, c)|, nor than q is to the plane between c and
    its own nearest pivot. A search compares each query with its nearest cells until they hold k vectors; the k-th of
    these bounds which other cells, and which distances in them, are read at all, by filters that reach the scan. The
    rest is compared exactly: results are those of comparing all. It pays where vectors lie in clusters that are narrow
    beside the distances between them; where neighbours are nearly as far as the pivots, all are read, and
    `search.knn` is the faster way. `compared` tells which.

    Rows without an id, a vector, or with a null component are left out; lengths that differ are an error. A hot cell,
    many equal vectors among them, is cut over partitions by chunk_id. The driver holds the pivots: at most MOST.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        cells = sorted(spark.read.parquet(f"{path}/cells").collect())  # as many as pivots
        self.cells = np.array([c["cell"] for c in cells], np.int64)
        self.pivots = np.array([c["pivot"] for c in cells], np.int64)
        self.held, low, high = (np.array([c[name] for c in cells], np.int64) for name in ("held", "low", "high"))
        self.low, self.high = np.sqrt(low), np.sqrt(high)

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, pivots: int | None = None) -> PivotIndex:
        """Index vectors, with a pivot for each of the square root of their number unless told. The cells are written
        last: a path without them is no index."""
        spark = vectors.sparkSession
        path = path or f"{stage_dir(spark)}/pivots-{uuid.uuid4().hex}"
        whole = "chunk_id is not null and embedding is not null and not exists(embedding, x -> x is null)"
        rows = vectors.where(whole).select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")
        n = rows.count()
        taken = rows.select("embedding").sample(min(1.0, 2 * SAMPLE / max(n, 1)), 0).limit(SAMPLE).toPandas()["embedding"]
        found = np.empty((0, 0), np.int64)
        if len(taken):
            found = _learn(np.stack(taken.to_numpy()).astype(np.int64), pivots or min(MOST, max(8, int(n**0.5))))

        def deal(batches):
            for pdf in batches:
                for at in range(0, len(pdf), KNN_ROWS):
                    part = pdf.iloc[at : at + KNN_ROWS]
                    to = _squares(np.stack(part["embedding"].to_numpy()), found)
                    cell = to.argmin(1)
                    yield part.assign(cell=cell.astype(np.int32), square=to[np.arange(len(part)), cell])

        dealt = rows.mapInPandas(deal, "chunk_id long, embedding array<tinyint>, cell int, square long")
        if not len(taken) and n:
            raise ValueError("no vector was sampled")
        dealt.repartitionByRange("cell", "square", "chunk_id").sortWithinPartitions("cell", "square").write.parquet(f"{path}/rows")
        held = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("held"), F.min("square").alias("low"), F.max("square").alias("high"))
        table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(found)], "cell int, pivot array<int>")
        held.join(F.broadcast(table), "cell").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, max_distance: float | None = MAX_DISTANCE) -> DataFrame:
        """query_id, chunk_id, distance, score, rank, as `search.knn` gives them, for queries (query_id, vector)."""
        ranked = self._ranked(self._made(queries, k, max_distance), k).withColumn("distance", F.sqrt(F.col("square").cast("double")))
        if max_distance is not None:
            ranked = ranked.where(F.col("distance") <= max_distance)
        return ranked.select("query_id", "chunk_id", "distance", "rank", vector_score(F.col("distance")).alias("score"))

    def compared(self, queries: DataFrame, k: int, max_distance: float | None = MAX_DISTANCE) -> DataFrame:
        """query_id and the number of vectors that a search compares it with."""
        return self._made(queries, k, max_distance).groupBy("query_id").agg(F.sum("compared").alias("compared"))

    @staticmethod
    def _ranked(made: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy("square", "chunk_id")
        return made.where("chunk_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _made(self, queries: DataFrame, k: int, max_distance: float | None) -> DataFrame:
        """Candidates of all queries, a stated set in blocks: the k nearest among them, and rows without a chunk that count."""
        wanted = queries.where("query_id is not null and vector is not null").select("query_id", "vector")
        blocks, out = max(1, -(-wanted.count() // BLOCK)), None
        for b in range(blocks):
            part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            rows = part.collect()  # about a block of queries
            if rows and len(self.cells):
                made = self._block(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), k, max_distance)
                out = made if out is None else out.unionByName(made)
        return self.spark.createDataFrame([], _MADE) if out is None else out

    def _block(self, ids: np.ndarray, q: np.ndarray, k: int, max_distance: float | None) -> DataFrame:
        if q.shape[1] != self.pivots.shape[1]:
            raise ValueError(f"vectors have {self.pivots.shape[1]} components, a query {q.shape[1]}")
        square = _squares(q, self.pivots)
        root = np.sqrt(square)
        cap = np.full(len(ids), _FAR if max_distance is None else int(max_distance**2) + 1)
        # first each query's nearest cells, as many as it takes to hold k vectors
        order = square.argsort(1, kind="stable")
        before = np.cumsum(self.held[order], axis=1) - self.held[order]
        near = np.zeros(root.shape, bool)
        np.put_along_axis(near, order, before < k, axis=1)
        made = stage(self._scan(ids, q, root, near & self._may_hold(root, square, cap), cap, k), "nearest")
        # then whatever may hold a vector no farther than the k-th of these
        kth = self._ranked(made, k).where(F.col("rank") == k).select("query_id", "square").collect()  # at most one a query
        known = {r[0]: r[1] for r in kth}
        cap = np.minimum(cap, [known.get(int(i), _FAR) for i in ids])
        return made.unionByName(self._scan(ids, q, root, ~near & self._may_hold(root, square, cap), cap, k))

    def _may_hold(self, root: np.ndarray, square: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """Queries x cells: may the cell hold a vector whose squared distance is within the query's cap?"""
        reach = np.sqrt(cap.astype(np.float64))[:, None] + SLACK
        own = square.argmin(1)
        apart = np.sqrt(_squares(self.pivots, self.pivots).astype(np.float64))[own]
        plane = (square - square[np.arange(len(own)), own][:, None]) / np.maximum(2 * apart, 1e-9)
        return (root - self.high <= reach) & (self.low - root <= reach) & (plane <= reach)

    def _scan(self, ids, q, root, asked, cap, k) -> DataFrame:
        """Compare queries with the vectors of the cells they ask for whose distance from the pivot is within their reach."""
        reach = np.sqrt(cap.astype(np.float64)) + SLACK
        each = np.nonzero(asked.any(0))[0]
        if not len(each):
            return self.spark.createDataFrame([], _MADE)
        low = np.where(asked, root - reach[:, None], np.inf).min(0)
        high = np.where(asked, root + reach[:, None], -np.inf).max(0)
        rows = self.spark.read.parquet(f"{self.path}/rows").where(self._condition(each, low, high))
        cells = {int(self.cells[c]): (np.nonzero(asked[:, c])[0], root[:, c]) for c in each}
        return rows.select("chunk_id", "embedding", "cell", "square").mapInPandas(lambda it: _nearest(it, ids, q, cells, reach, cap, k), _MADE)

    def _condition(self, each: np.ndarray, low: np.ndarray, high: np.ndarray) -> Column:
        """Cells and distances as ranges that the scan can test; the smallest gaps are read through where there are many."""
        gaps = np.diff(self.cells[each])
        cut = np.sort(np.argsort(-gaps, kind="stable")[: CONDITIONS - 1]) + 1
        out = None
        for run in np.split(each, cut):
            a, b = max(0.0, low[run].min() - SLACK) ** 2, (high[run].max() + SLACK) ** 2
            one = F.col("cell").between(int(self.cells[run[0]]), int(self.cells[run[-1]]))
            one = one & F.col("square").between(int(a), int(min(b, 2.0**62)) + 1)
            out = one if out is None else out | one
        return out


def _nearest(batches, ids, q, cells, reach, cap, k):
    best = [np.empty(0, np.int64)] * 3  # number of the query, squared distance, chunk
    worst, compared, waiting = cap.copy(), np.zeros(len(ids), np.int64), []

    def settle():
        nonlocal best
        row, d, c = (np.concatenate(x) for x in zip(best, *waiting, strict=True))
        waiting.clear()
        order = np.lexsort((c, d, row))
        row, d, c = row[order], d[order], c[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == k - 1
        worst[row[full]] = np.minimum(worst[row[full]], d[full])
        best = [x[place < k] for x in (row, d, c)]

    for pdf in batches:
        for cell, part in pdf.groupby("cell", sort=False):
            if cell not in cells:
                continue
            who, root = cells[cell]
            for at in range(0, len(part), KNN_ROWS):
                rows = part.iloc[at : at + KNN_ROWS]
                away = np.sqrt(rows["square"].to_numpy().astype(np.float64))
                x, chunk = np.stack(rows["embedding"].to_numpy()), rows["chunk_id"].to_numpy()
                for b in range(0, len(who), KNN_QUERIES):
                    some = who[b : b + KNN_QUERIES]
                    within = np.abs(away[None, :] - root[some][:, None]) <= reach[some][:, None]
                    rows_of, some = np.nonzero(within.any(0))[0], some[within.any(1)]
                    if not len(some):
                        continue
                    square = _squares(q[some], x[rows_of])
                    compared[some] += len(rows_of)
                    row, column = np.nonzero(square <= worst[some][:, None])
                    waiting.append((some[row], square[row, column], chunk[rows_of[column]]))
                    if sum(len(w[0]) for w in waiting) > 200_000:
                        settle()
    settle()
    row, d, c = best
    yield pd.DataFrame({"query_id": ids[row], "chunk_id": pd.array(c, dtype="Int64"), "square": d, "compared": 0})
    seen = np.nonzero(compared)[0]
    yield pd.DataFrame({"query_id": ids[seen], "chunk_id": pd.array([None] * len(seen), dtype="Int64"), "square": 0, "compared": compared[seen]})
