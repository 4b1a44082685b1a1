"""Embedding near-dedup: tiles of PCA-ordered vectors compared by leading dimensions, with suffix-norm bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .substrings import mixed

#: Cosine that links, dimensions after which the bound is tested, tiles that a home tile meets in one task.
COSINE, CUTS, UNIT = 0.95, (16, 32, 48), 4
#: Leading principal coordinates by which tiles are cut and pruned, and leaves of that cut at most.
AXES, LEAVES = 3, 2048
#: Bytes of a tile's vectors at most, fewest rows of a tile, and tiles wished for in a small table (for parallel work).
TILE_BYTES, TILE_ROWS, TILES = 16_000_000, 2048, 12
#: Rows from which the cut is learned. It only shapes tiles: every vector is compared whatever it is.
SAMPLE = 50_000
#: The bound is computed in single precision; this much is allowed for.
SLACK = 1e-4

LINKS = "u long, v long, n long"


def _matrix(column) -> np.ndarray:
    """Arrow lists of equal length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length one. Scaled by a power of two near the largest component first (which is exact), so that no square
    over- or underflows."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -exponent)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embedding: str = "embedding"):
    """Vectors that can link: not null, no null or non-finite component, not zero."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0)


def _moments(batches):
    """Sum of outer products of unit vectors; one row a task and row of the matrix."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _unit_rows(_matrix(batch.column("embedding")))
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        for i in range(0, len(total), 256):
            part = total[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array([r.tobytes() for r in part], pa.binary())], ["i", "sums"])


def _added(key, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
    return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal axes, largest first, of all unit vectors: sums are made in the tasks and added up by matrix row. The
    driver gets `dim` rows of `dim` doubles."""
    rows = vectors.mapInArrow(_moments, "i long, sums binary").groupBy("i").applyInArrow(lambda key, t: _added(key, t), "i long, sums binary").collect()
    total = np.zeros((dim, dim))
    for r in rows:
        total[r["i"]] = np.frombuffer(r["sums"], np.float64)
    _, axes = np.linalg.eigh(total)
    return np.ascontiguousarray(axes[:, ::-1])


class Tile:
    """Vectors of a tile: as given (for exact cosines), and rotated with suffix norms (for bounds)."""

    def __init__(self, rep, copies, raw: np.ndarray, axes: np.ndarray, cuts):
        unit = _unit_rows(raw)
        turned = unit @ axes
        order = np.lexsort((rep, turned[:, 0]))
        self.rep, self.copies, self.unit, turned = rep[order], copies[order], unit[order], turned[order]
        self.first = turned[:, 0].copy()
        self.turned = turned.astype(np.float32)
        tail = np.sqrt(np.cumsum((turned**2)[:, ::-1], axis=1))[:, ::-1].astype(np.float32)
        # leading dimensions and the norm of the rest: the product of two such rows bounds the cosine from above
        self.lead = [np.concatenate([self.turned[:, :c], tail[:, c : c + 1]], axis=1) for c in cuts if c < raw.shape[1]]


def compare(a: Tile, b: Tile, same: bool, cosine: float, reach: float):
    """Links of two tiles (of a with itself: i < j): yields index arrays (i, j), block by block. Rows of a tile are in the
    order of their first coordinate, so a block meets only the stretch of the other tile within reach."""
    for s in range(0, len(a.rep), 256):
        block = slice(s, s + 256)
        low = np.searchsorted(b.first, a.first[s] - reach)
        high = np.searchsorted(b.first, a.first[block][-1] + reach, side="right")
        for t in range(max(low, s) if same else low, high, 4096):
            other = slice(t, min(t + 4096, high))
            if a.lead:
                i, j = np.nonzero(a.lead[0][block] @ b.lead[0][other].T >= cosine - SLACK)
            else:
                i, j = (x.ravel() for x in np.indices((len(a.unit[block]), len(b.unit[other]))))
            i, j = i + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            dense = len(i) > len(a.unit[block]) * len(b.unit[other]) // 32
            for mine, theirs in zip(a.lead[1:], b.lead[1:], strict=True) if not dense else ():
                near = np.einsum("nd,nd->n", mine[i], theirs[j]) >= cosine - SLACK
                i, j = i[near], j[near]
            if not len(i):
                continue
            if dense:  # many survive: one exact product of the rows and columns left
                rows, cols = np.unique(i), np.unique(j)
                exact = (a.unit[rows] @ b.unit[cols].T)[np.searchsorted(rows, i), np.searchsorted(cols, j)]
            else:
                exact = np.einsum("nd,nd->n", a.unit[i], b.unit[j])
            keep = exact >= cosine
            if keep.any():
                yield i[keep], j[keep]


def _unit(key, table: pa.Table, axes: np.ndarray, cosine: float, reach: float, cuts) -> pa.Table:
    """A home tile against up to UNIT tiles: link counts of every vector, and links that span its components."""
    tile_of = table.column("tile").to_numpy()
    raw = _matrix(table.column("embedding").combine_chunks())
    rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
    home_id = key[0].as_py()

    def tile(t):
        at = np.flatnonzero(tile_of == t)
        return Tile(rep[at], copies[at], raw[at], axes, cuts)

    us, vs, who, number = [], [], [], []
    if (tile_of == home_id).any():  # a home without vectors has nothing to meet
        home = tile(home_id)
        own = np.zeros(len(home.rep), np.int64)
        guests = table.column("guest").to_numpy(zero_copy_only=False)
        for other_id in np.unique(tile_of[guests]).tolist():
            same = other_id == home_id
            other = home if same else tile(other_id)
            total = own if same else np.zeros(len(other.rep), np.int64)
            for i, j in compare(home, other, same, cosine, reach):
                own += np.bincount(i, weights=other.copies[j], minlength=len(own)).astype(np.int64)
                total += np.bincount(j, weights=home.copies[i], minlength=len(total)).astype(np.int64)
                nodes, at = np.unique(np.concatenate([home.rep[i], other.rep[j]]), return_inverse=True)
                label = common.forest(at[: len(i)], at[len(i) :], len(nodes))
                child = np.flatnonzero(label != np.arange(len(nodes)))
                us.append(nodes[child])
                vs.append(nodes[label[child]])
            if not same:
                who.append(other.rep[total > 0])
                number.append(total[total > 0])
        who.append(home.rep[own > 0])
        number.append(own[own > 0])
    u, v, who, number = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs, who, number))
    return pa.table({"u": np.concatenate([u, who]), "v": np.concatenate([v, who]), "n": np.concatenate([np.zeros(len(u), np.int64), number])})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tile: int | None = None, cuts=CUTS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    Equal vectors are one group before anything is compared. Groups are cut into tiles by their AXES leading principal
    coordinates; tiles whose boxes of those coordinates are further apart than the largest distance that links don't
    meet. Inside a pair of tiles the leading dimensions are multiplied first; the product of the rest is bounded by the
    suffix norms, and a pair goes on only while the bound reaches the threshold. What is left is decided by the exact
    cosine in double precision; a cosine of exactly the threshold links. Tasks return counts and spanning links, never
    all pairs. Components may be tiny or huge: vectors are scaled by their largest before anything is squared.
    A home tile meets the others in units of at most UNIT tiles of at most TILE_BYTES (or `tile` rows), so a task holds
    UNIT + 1 tiles whatever the input. A vector travels once for each tile near its own: with tiles of 16 MB that is
    little beside the products, but both are quadratic in vectors that the leading coordinates can't tell apart; the
    method has no way around that.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of another
    length than the commonest one are compared among themselves. Repeated rows count as vectors of their own; a row
    with a null vec_id keeps its counts, has a null component where no named vector is in it, and isn't kept.
    """
    rows = common.stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vectors")
    good = rows.where(usable())
    group = good.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    # ids may repeat, so a group has a number of its own; it is written once and read from then on
    group = common.stage(group.select(F.monotonically_increasing_id().alias("rep"), "low", "copies", "embedding"), "vector-groups")
    links = counts = None
    for (dim,) in group.select(F.size("embedding")).distinct().collect():
        found = common.stage(_linked(group.where(F.size("embedding") == dim), dim, cosine, tile, cuts), "vector-links")
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = links.where("n > 0").groupBy("u").agg(F.sum("n").alias("others"))
    comps = common.components(links.where("n = 0").select("u", "v"), "vector-components")
    named = group.join(comps, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(low, "component").join(counts, F.col("rep") == F.col("u"), "left")
    named = named.select(F.col("embedding").alias("_embedding"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = good.join(named, F.col("embedding") == F.col("_embedding")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


class Cut:
    """A tree of splits of the leading coordinates, learned from a sample. Leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, border, what is below, what is not (~leaf or node)
        self.leaves = 0
        self.root = self._grow(sample, leaves)

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        spread = rows.max(axis=0) - rows.min(axis=0) if leaves > 1 and len(rows) > 1 else np.zeros(1)
        if not spread.max() > 0:
            self.leaves += 1
            return ~(self.leaves - 1)
        axis = int(spread.argmax())
        border = float(np.quantile(rows[:, axis], (leaves // 2) / leaves))
        below = rows[:, axis] < border
        if not below.any():  # many ties at the least value
            border = float(rows[rows[:, axis] > rows[:, axis].min(), axis].min())
            below = rows[:, axis] < border
        at = len(self.splits)
        self.splits.append((axis, border, 0, 0))
        left, right = self._grow(rows[below], leaves // 2), self._grow(rows[~below], leaves - leaves // 2)
        self.splits[at] = (axis, border, left, right)
        return at

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        while len(live := np.flatnonzero(node >= 0)):
            for split in np.unique(node[live]).tolist():
                axis, border, left, right = self.splits[split]
                at = live[node[live] == split]
                node[at] = np.where(x[at, axis] < border, left, right)
        return ~node


def _leads(batch, axes: np.ndarray) -> np.ndarray:
    return _unit_rows(_matrix(batch.column("embedding"))) @ axes


def _linked(group: DataFrame, dim: int, cosine: float, tile: int | None, cuts) -> DataFrame:
    """Links (u, v, n = 0) that span components, and counts (u, u, n > 0), of groups with vectors of one length.

    What the driver holds is bounded: dim * dim sums, SAMPLE rows of AXES numbers, a box for each of at most LEAVES leaves.
    """
    axes = rotation(group.select("embedding"), dim)
    lead = np.ascontiguousarray(axes[:, :AXES])
    width = lead.shape[1]
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6  # the largest distance of unit vectors that link
    rows = group.select("rep", "copies", "embedding")
    n = rows.count()
    tile = tile or int(min(max(-(-n // TILES), TILE_ROWS), max(TILE_BYTES // (8 * dim), 256)))
    names = [f"c{k}" for k in range(width)]

    def coordinates(batches):
        for batch in batches:
            if batch.num_rows:
                x = _leads(batch, lead)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), *(pa.array(x[:, k]) for k in range(width))], ["rep", *names])

    placed = rows.mapInArrow(coordinates, ", ".join(["rep long", *(f"{c} double" for c in names)]))
    wanted = min(LEAVES, -(-n // tile))
    sample = np.zeros((1, width))
    if wanted > 1:
        sample = np.array(placed.orderBy(F.xxhash64("rep"), "rep").select(*names).limit(SAMPLE).collect(), dtype=np.float64)
    cut = Cut(sample, wanted)

    def leaves(batches):
        for batch in batches:
            if batch.num_rows:
                x = _leads(batch, lead)
                yield pa.RecordBatch.from_arrays([pa.array(cut.leaf(x)), *(pa.array(x[:, k]) for k in range(width))], ["leaf", *names])

    boxed = rows.mapInArrow(leaves, ", ".join(["leaf long", *(f"{c} double" for c in names)])).groupBy("leaf")
    boxed = boxed.agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.min, names)).alias("low"), F.array(*map(F.max, names)).alias("high"))
    size, low, high = np.zeros(cut.leaves, np.int64), np.full((cut.leaves, width), np.inf), np.full((cut.leaves, width), -np.inf)
    for r in boxed.collect():
        size[r["leaf"]], low[r["leaf"]], high[r["leaf"]] = r["n"], r["low"], r["high"]
    # a leaf that is large, by equal coordinates or by a large input, is cut into tiles by hash
    parts = np.where(size > 0, np.maximum(1, -(-size // (2 * tile))), 0)
    start = np.concatenate([[0], np.cumsum(parts)])
    meets = np.zeros((cut.leaves, cut.leaves), bool)  # leaves within reach of each other
    for k in np.flatnonzero(size):
        gap = np.maximum(np.maximum(low[size > 0] - high[k], low[k] - high[size > 0]), 0)
        meets[k, size > 0] = (gap**2).sum(axis=1) <= reach**2

    def journeys(t: int) -> np.ndarray:
        """Where tile t goes: as a guest to every home tile near it and not behind it, as host to its units. Each as one
        number: home, unit, guest."""
        leaf = int(np.searchsorted(start, t, side="right") - 1)
        all_near = np.concatenate([np.arange(start[m], start[m + 1]) for m in np.flatnonzero(meets[leaf])])
        homes = all_near[all_near <= t]
        host = np.setdiff1d(all_near[all_near > t] // UNIT, [t // UNIT])
        return np.concatenate([(homes << 32) | (t // UNIT << 1) | 1, (t << 32) | (host << 1)])

    def tiles(batches):
        routes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = cut.leaf(_leads(batch, lead))
            spread = mixed(batch.column("rep").to_numpy().view(np.uint64)) % np.maximum(parts[leaf], 1).astype(np.uint64)
            own = start[leaf] + spread.astype(np.int64)
            for t in np.unique(own).tolist():
                if t not in routes:
                    routes[t] = journeys(t)
            each = [routes[t] for t in own.tolist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "embedding")), pa.array(own), codes], ["rep", "copies", "embedding", "tile", "codes"])

    kind = rows.schema["embedding"].dataType.simpleString()
    sent = rows.mapInArrow(tiles, f"rep long, copies long, embedding {kind}, tile long, codes array<long>")
    sent = sent.select("rep", "copies", "embedding", "tile", F.explode("codes").alias("code")).select(
        "rep", "copies", "embedding", "tile",
        F.shiftright("code", 32).alias("home"),
        F.shiftright(F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)), 1).alias("unit"),
        (F.col("code").bitwiseAND(F.lit(1)) == 1).alias("guest"),
    )
    return sent.groupBy("home", "unit").applyInArrow(lambda key, t: _unit(key, t, axes, cosine, reach, cuts), LINKS)
