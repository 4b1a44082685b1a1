"""SimHash near-dedup: word-shingle fingerprints, segment popcounts as a grid, exact verification, components."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, jaccard

#: Fixed values of the fingerprint: shingle width in words, hash seed, largest number of differing bits that links.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: The 64 bits are 32 segments of two bits in GROUPS groups. Two fingerprints within RADIUS differ in RADIUS groups at
#: most: on the popcounts of all segments of the others they agree, and the popcounts of these few are near.
GROUPS = 4
LOW_BITS = 0x5555555555555555
#: Parts that a cell is dealt in, and fingerprints of a cell that are compared pair by pair as they come.
SPLITS, SMALL = 16, 48


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of one text; null, empty and blank texts give 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    counts, total = np.zeros((8, 8), dtype=np.int64), max(1, n - SHINGLE + 1)
    for start in range(0, total, 1 << 18):  # long texts: a bounded number of hashes at a time
        part = words[start : start + (1 << 18) + SHINGLE - 1]
        shingles = zip(*(part[i:] for i in range(SHINGLE)), strict=False) if n >= SHINGLE else [part]
        hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in shingles], dtype=np.uint64)
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            counts[lane] += np.bincount(lanes[:, lane], minlength=256) @ BITS
    bits = (2 * counts > total).reshape(64)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _fingerprints(batches):
    for batch in batches:
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])


def group_masks(groups: int = GROUPS) -> list[int]:
    """Bit masks of the groups of whole two-bit segments."""
    cuts = [round(i * 32 / groups) * 2 for i in range(groups + 1)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def neighbours(dimensions: int, radius: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite non-zero steps with a Manhattan length of at most radius."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=dimensions) if 0 < sum(map(abs, s)) <= radius]
    return [s for s in steps if s > tuple(-x for x in s)]


def agreed_masks(groups: int = GROUPS, radius: int = RADIUS) -> list[int]:
    """For each choice of groups that may differ, the bits of the others."""
    masks = group_masks(groups)
    return [sum(m for i, m in enumerate(masks) if i not in free) for free in combinations(range(groups), radius)]


def cells(fps: DataFrame, groups: int = GROUPS, radius: int = RADIUS) -> DataFrame:
    """The grid range-join's two sides, dealt by cell: key, guest, agreed, fp.

    For each choice of groups that may differ, a cell is the segment popcounts of the others and a place in the grid of
    the chosen groups' popcounts. A fingerprint is at home in its own cell and a guest in the neighbouring ones, up to a
    Manhattan distance of radius on one side: of each pair within it, one is at home where the other is a guest.
    Every pair within radius has a choice under which all other bits are equal, not their popcounts alone. So each cell
    is dealt to SPLITS tasks by a hash of these bits, and no pair is lost.
    """
    # popcount of every two-bit segment, in place: 1 where the bits differ, 2 where both are set
    first, second = F.col("fp").bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(LOW_BITS))
    counts = first.bitwiseXOR(second).bitwiseOR(F.shiftleft(first.bitwiseAND(second), 1))
    keys = []
    rows = fps.select("fp", counts.alias("c"), *(F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias(f"g{i}") for i, m in enumerate(group_masks(groups))))
    for number, (free, mask) in enumerate(zip(combinations(range(groups), radius), agreed_masks(groups, radius), strict=True)):
        same, bits = (F.col(c).bitwiseAND(F.lit(_signed(mask))) for c in ("c", "fp"))
        part = F.pmod(F.xxhash64(bits), F.lit(SPLITS))
        for step in [(0,) * radius, *neighbours(radius, radius)]:
            place = [F.col(f"g{i}") + F.lit(d) for i, d in zip(free, step, strict=True)]
            # a number for the cell; where two cells share one, the exact check parts them
            keys.append(F.struct(F.xxhash64(F.lit(number), same, *place, part).alias("key"), F.lit(any(step)).alias("guest"), F.lit(_signed(mask)).alias("agreed")))
    return rows.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.guest", "k.agreed", "fp")


def _pairs_of(home: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a cell within radius, home with home and home with guests, as a spanning forest of fingerprints."""
    both = np.concatenate([home, guests])
    left, right = [], []
    for a in range(0, len(home), 256):
        for b in range(a, len(both), 1 << 16):
            i, j = np.nonzero(np.bitwise_count(home[a : a + 256, None] ^ both[None, b : b + (1 << 16)]) <= radius)
            i, j = i + a, j + b
            left.append(i[i < j])
            right.append(j[i < j])
    nodes, at = np.unique(both, return_inverse=True)
    i, j = (at[np.concatenate(x)] if x else np.empty(0, np.int64) for x in (left, right))
    label = common.forest(i, j, len(nodes))
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of rows that are equal in all columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.concatenate([starts[1:], [len(new)]])


def _cell_links(batches, radius: int):
    """Rows come sorted by (key, guest, fp), so those at home first. Links inside each cell, verified exactly.

    A cell of few is compared pair by pair. A larger one is ordered by the bits that its choice leaves alone, and only
    fingerprints that have all of these in common are compared: under some choice every pair within radius does.
    """

    def near(fp, guest, starts, ends):
        """Pairs of small runs, all at once; and the other runs."""
        size = ends - starts
        small = (size > 1) & (size <= SMALL)
        u, v = [], []
        for shift in range(1, int(size[small].max()) if small.any() else 0):
            s, e = starts[small & (size > shift)], ends[small & (size > shift)]
            n = e - s - shift
            at = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            at = at[~guest[at] & (np.bitwise_count(fp[at] ^ fp[at + shift]) <= radius)]
            u.append(fp[at])
            v.append(fp[at + shift])
        return u, v, np.flatnonzero(size > SMALL)

    def links(key, guest, agreed, fp):
        if not len(key):
            return
        starts, ends = _runs(key)
        u, v, large = near(fp, guest, starts, ends)
        if len(large):
            rows = np.concatenate([np.arange(starts[c], ends[c]) for c in large])
            cell = np.repeat(large, ends[large] - starts[large])
            bits = fp[rows] & agreed[rows]
            order = np.lexsort((fp[rows], guest[rows], bits, cell))
            rows = rows[order]
            fp, guest = fp[rows], guest[rows]
            starts, ends = _runs(cell[order], bits[order])
            more_u, more_v, large = near(fp, guest, starts, ends)
            u, v = u + more_u, v + more_v
            for s, e in zip(starts[large], ends[large], strict=True):
                own = guest[s:e]
                i, j = _pairs_of(fp[s:e][~own], fp[s:e][own], radius)
                u.append(i)
                v.append(j)
        if u and sum(map(len, u)):
            yield pd.DataFrame({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    held: list = []  # the last cell so far
    for pdf in batches:
        if not len(pdf):
            continue
        held.append((pdf["key"].to_numpy(), pdf["guest"].to_numpy(), pdf["agreed"].to_numpy().view(np.uint64), pdf["fp"].to_numpy().view(np.uint64)))
        key = held[-1][0]
        if held[0][0][0] == key[0] and key[0] == key[-1] and len(held) > 1:
            continue
        rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from links(*(x[:last] for x in rows))
        held = [tuple(x[last:] for x in rows)]
    if held:
        yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """Links (u, v) of different fingerprints (fp) within radius by the grid range-join, verified exactly: a spanning forest
    of each large cell's, and all of a small one's."""
    keyed = cells(fps, groups, radius).repartition("key").sortWithinPartitions("key", "guest", "fp")
    return keyed.mapInPandas(lambda it: _cell_links(it, radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """doc_id, text_key, fp (signed 64 bits) and component_id of every row of docs (doc_id, text; others are ignored).

    Fingerprints link at `radius` or fewer differing bits. Equal fingerprints are one group before anything is
    compared, so exact copies, however many, cost one row. Segment popcounts embed each group as a point: a change of
    one bit moves one popcount by one, so the Manhattan distance between two points never exceeds the number of
    differing bits. A grid range-join under that distance finds the candidates, which are then verified exactly. A task
    holds one part of a cell at a time (25 bytes a fingerprint, all different) and passes on links.
    Null and blank texts have fingerprint 0 and link like any other; very long texts are hashed a stretch at a time. A
    null doc_id keeps its row and links, but names no component (a component of such rows only is null). Repeated rows
    give repeated rows; an empty table gives none. Of equal distances none is dropped.
    """
    fps = common.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.text_key().alias("text_key")).mapInArrow(_fingerprints, "doc_id long, text_key long, fp long"), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comps = common.components(near_fingerprints(distinct.select("fp"), radius, groups), "simhash-components")
    # fingerprints are the nodes: an id that repeats with other texts joins nothing
    labelled = distinct.join(comps, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    low = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    labelled = labelled.join(low, "component").select("fp", "component_id")
    return fps.join(labelled, "fp", "left").select("doc_id", "text_key", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest doc_id stays.

    Where that doc_id repeats, the text with the smallest key stays, once. Rows with a null doc_id can't be told apart
    from copies and stay. All columns of docs are kept.
    """
    return common.keep_first(docs, near_duplicates(docs, **options))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without near copies of whole texts: one document of each group of texts whose five-word shingles have a Jaccard
    similarity of 0.8 or more, by the same rule as keep_first.

    Fingerprints of the shingles propose the first links; the sets themselves decide every link and find the rest, which
    are out of a fingerprint's reach (see jaccard). Null, empty and blank texts are copies of each other; rows with a null
    doc_id stay; repeated rows, and texts that share a doc_id, leave one; an empty table gives none; other columns are kept.
    """
    return common.keep_first(docs, jaccard.near_duplicates(docs))
