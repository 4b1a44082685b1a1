"""Near copies of whole texts for the SimHash operator: exact set similarity of word shingles, links found by stars first.

A 64-bit fingerprint can't carry a similarity of 0.8: such texts differ in about ten bits of 64, some in nineteen, while
texts that have nothing in common differ in 32 give or take four. So fingerprints only propose the first links here, and
an exact join of shingle sets finds all the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .substrings import mixed

#: Words of a shingle. Sets link at a Jaccard similarity of 0.8 or more: with o shared of S in both, where 9 o >= 4 S.
SHINGLE = 5
#: Documents from which frequent shingles are told (the order of shingles only, never the result), and how many are kept.
SAMPLE, FREQUENT = 4_000, 50_000
#: Shingles that so many sets have among their first ones, or those of twice that number, come after the others; CELLS
#: hashed cells hold the logarithm of these counts. Like the sample they only settle an order: cells that shingles share
#: cost time, no result.
HEAVY, CELLS = 8, 1 << 22
#: Fewest bits of the parity bitmap of a set; larger sets have as many as shingles, at least. Two bitmaps never differ in
#: more bits than the sets in shingles.
BITMAP = 512
#: Leading sets that each set is held against first.
LEADS = 3
#: 64-bit words of the filter that keeps texts no pair asks for from travelling. As it fills it lets more through; it
#: never holds back a text that is asked for.
FILTER = 1 << 18


def shingles(text: str | None) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes; a text with fewer words has one, a blank one none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(SHINGLE, len(words))
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    grams = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        grams = mixed(grams + hashes[i : len(words) - width + 1 + i])
    return np.unique(grams)


def _node(found: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(found.tobytes())


def _fingerprint(found: np.ndarray) -> int:
    """Bits set in more than half of the shingles' hashes."""
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(found) else np.zeros((1, 64), np.uint8)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits), bitorder="little").view(np.int64)[0])


def _bitmap(found: np.ndarray) -> bytes:
    """For each of a power of two of stretches of the hashes' range, whether the set has an odd number of shingles there."""
    bits = max(BITMAP.bit_length() - 1, int(len(found) - 1).bit_length())
    odd = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the larger one is folded to the other's stretches."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(y) > len(x):
        bits = np.unpackbits(y, bitorder="little").reshape(8 * len(x), -1)
        y = np.packbits(np.bitwise_xor.reduce(bits, axis=1), bitorder="little")
    return int(np.bitwise_count(x ^ y).sum())


def _sets(batches):
    for batch in batches:
        nodes, sizes, prints, bits = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text)
            nodes.append(_node(found))
            sizes.append(len(found))
            prints.append(_fingerprint(found))
            bits.append(_bitmap(found))
        columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(bits, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n", "fp", "bits"])


def _all(batches):
    for batch in batches:
        for text in batch.column("text").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["shingle"])


def _cell(shingles: np.ndarray) -> np.ndarray:
    return ((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - CELLS.bit_length())).astype(np.int64)


def _ordered(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, levels: np.ndarray | None = None) -> np.ndarray:
    """A set's shingles, rare ones first, by an order that is common to all sets: by the sample's count, then by the level of
    their cell, then by their hash."""
    level = np.zeros(len(found), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        level = np.where(frequent[at] == found, counts[at], 0)
    if levels is not None:
        level = (level << 8) + levels[_cell(found)]
    return found[np.argsort(level, kind="stable")]


def _first(n: int) -> int:
    """How many first shingles of a set of n two sets that link share one of."""
    return n - (4 * n + 4) // 5 + 1


def _early(batches, frequent: np.ndarray, counts: np.ndarray):
    """Twice as many first shingles of each set as a link needs."""
    for batch in batches:
        held: list[np.ndarray] = [np.empty(0, np.uint64)]
        for text in batch.column("text").to_pylist():
            if len(found := shingles(text)):
                held.append(_ordered(found, frequent, counts)[: 2 * _first(len(found))])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["shingle"])


def _levels(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each cell the logarithm of the largest count of a shingle there that HEAVY sets or more have early; 0: none. At
    most CELLS rows reach the driver."""
    early = docs.select("text").mapInArrow(lambda it: _early(it, frequent, counts), "shingle long")
    # nearly all of them are different, so they are sorted and not put in hash tables
    made = _together(early).mapInArrow(_heavy, "cell int, level int").groupBy("cell").agg(F.max("level").alias("level")).toPandas()
    levels = np.zeros(CELLS, np.uint8)
    levels[made["cell"].to_numpy(np.int64)] = made["level"].to_numpy(np.uint8)
    return levels


def _together(rows: DataFrame) -> DataFrame:
    """rows dealt and sorted by shingle."""
    return rows.repartition("shingle").sortWithinPartitions("shingle")


def _heavy(batches):
    """Rows come sorted by shingle. Cell and level of each shingle of HEAVY rows or more."""

    def made(keys, counts):
        heavy = counts >= HEAVY
        cell = _cell(keys[heavy].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.log2(counts[heavy]).astype(np.int32))], ["cell", "level"])

    last, before = np.empty(0, np.int64), np.empty(0, np.int64)  # the last shingle and its rows so far
    for batch in batches:
        if not batch.num_rows:
            continue
        found = batch.column("shingle").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        keys, counts = found[starts], np.diff(starts, append=len(found))
        if len(last) and keys[0] == last[0]:
            counts[0] += before[0]
        else:
            keys, counts = np.concatenate([last, keys]), np.concatenate([before, counts])
        last, before = keys[-1:], counts[-1:]
        yield made(keys[:-1], counts[:-1])
    yield made(last, before)


def _shared(batches):
    """Rows come sorted by shingle. Those whose shingle another row has too."""
    names = ["shingle", "node", "at"]
    last, met = [np.empty(0, np.int64)] * 3, False  # the last row, and whether the one before it has its shingle
    made = lambda columns: pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(last, names, strict=True)]
        same = rows[0][1:] == rows[0][:-1]
        keep = np.concatenate([[met], same])
        keep[:-1] |= same
        yield made([x[:-1][keep[:-1]] for x in rows])
        last, met = [x[-1:].copy() for x in rows], bool(keep[-1])
    if met:
        yield made(last)


def _prefixes(batches, frequent: np.ndarray, counts: np.ndarray, levels: np.ndarray):
    """The first shingles of each set, rare ones first: two sets that link share one of them. Equal sets go once a task
    and hundred thousand sets. `at` holds the set's size and the shingle's place."""
    seen: set[int] = set()
    for batch in batches:
        parts, held = [], 0
        for text in batch.column("text").to_pylist():
            found = shingles(text)
            n, node = len(found), _node(found)
            if not n or node in seen:
                continue
            if len(seen) >= 100_000:
                seen.clear()
            seen.add(node)
            first = _ordered(found, frequent, counts, levels)[: _first(n)]
            parts.append((first.view(np.int64), np.full(len(first), node, np.uint64).view(np.int64), (n << 31) + np.arange(len(first))))
            held += len(first)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["shingle", "node", "at"])
                parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["shingle", "node", "at"])


def _wanted(nodes: DataFrame) -> np.ndarray:
    """The filter's bits for a column `node`: at most FILTER numbers reach the driver."""
    # floor division of a signed number by a power of two is a shift
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(node, {FILTER.bit_length() - 1}), 64) as int))")
    made = nodes.groupBy(F.pmod("node", F.lit(FILTER)).alias("word")).agg(F.bit_or(bit).alias("bits"))
    bits = np.zeros(FILTER, np.uint64)
    got = made.toPandas()
    bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _asked(node: int, bits: np.ndarray) -> bool:
    signed = node - (1 << 64) if node >= 1 << 63 else node
    return bool(int(bits[signed % FILTER]) >> ((signed // FILTER) % 64) & 1)


def _contents(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and content (a text with its shingles, compressed) of the sets that nodes names, each once."""
    bits = _wanted(nodes)

    def contents(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column("text").to_pylist()
            named = [(node, t) for t in texts if _asked(node := _node(shingles(t)), bits)]
            made = [pa.array(np.array([n for n, _ in named], np.uint64).view(np.int64)), pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for _, t in named], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["node", "content"])

    made = docs.select("text").mapInArrow(contents, "node long, content binary")
    return made.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _likely(batches):
    """Pairs that their bitmaps don't rule out."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("n", "m", "bits", "others"))
        keep = [9 * _differ(a, b) <= n + m for n, m, a, b in zip(*columns, strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _verified(batches):
    """Pairs that the sets themselves confirm. Rows come sorted by v, so a set is made once for all its pairs in a row."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    sets = lambda packed: shingles(unpack(packed).decode("utf-8", "surrogatepass"))
    last, theirs = None, None
    for batch in batches:
        keep = []
        for v, a, b in zip(*(batch.column(c).to_pylist() for c in ("v", "content", "other")), strict=True):
            if v != last:
                last, theirs = v, sets(b)
            mine = sets(a)
            keep.append(9 * len(np.intersect1d(mine, theirs, assume_unique=True)) >= 4 * (len(mine) + len(theirs)))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those of the pairs (u, v) of sets whose similarity is 0.8 or more; bitmaps drop most others before any text travels."""
    bits = sets.select("node", "n", "bits")
    mine = bits.withColumnRenamed("node", "u")
    theirs = bits.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("bits").alias("others"))
    near = pairs.join(mine, "u").join(theirs, "v").where("5 * least(n, m) >= 4 * greatest(n, m)")
    likely = common.stage(near.mapInArrow(_likely, "u long, v long"), f"{name}-pairs")
    named = likely.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    contents = common.stage(_contents(docs, named), f"{name}-contents")
    one, other = contents.withColumnRenamed("node", "u"), contents.select(F.col("node").alias("v"), F.col("content").alias("other"))
    joined = likely.join(one, "u").join(other, "v").sortWithinPartitions("v")
    links = common.stage(joined.mapInArrow(_verified, "u long, v long"), f"{name}-links")
    common.unstage(likely)
    common.unstage(contents)
    return links


def _named(nodes: DataFrame, comps: DataFrame, name: str) -> DataFrame:
    """nodes and the component of each: its own number where it has no link."""
    comps = comps.withColumnsRenamed({"node": "_node", "component": name})
    return nodes.join(comps, F.col("node") == F.col("_node"), "left").drop("_node").withColumn(name, F.coalesce(name, "node"))


def _stars(placed: DataFrame) -> DataFrame:
    """Pairs (u, v) of each set in placed (shingle, node, i, kind) with the LEADS sets that lead the most of its shingles:
    of a shingle and a kind, the set that has it earliest."""
    least = placed.groupBy("shingle", "kind").agg(F.min(F.struct("i", "node"))["node"].alias("lead"), F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets")
    met = placed.join(least, ["shingle", "kind"]).where("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("k"))
    turn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("k"), "lead"))
    return met.withColumn("turn", turn).where(F.col("turn") <= LEADS).select(F.col("node").alias("u"), F.col("lead").alias("v"))


def _alike(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets whose fingerprints are equal or near by the operator's grid join, a spanning forest of them."""
    from . import simhash  # which imports this module

    prints = distinct.groupBy("fp").agg(F.min("node").alias("v"))
    equal = distinct.select(F.col("node").alias("u"), "fp").join(prints, "fp").where("u <> v").select("u", "v")
    near = simhash.near_fingerprints(prints.select("fp"))
    one, other = (prints.select(F.col("fp").alias(c), F.col("v").alias(f"_{c}")) for c in ("u", "v"))
    return equal.unionByName(near.join(one, "u").join(other, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")))


def _links(docs: DataFrame, sets: DataFrame, distinct: DataFrame, sample: int) -> DataFrame:
    """Links (u, v) of sets with a similarity of 0.8 or more that give the components of all such links."""
    share = max(1, sets.count() // sample)
    seen = docs.where(F.pmod("text_key", F.lit(share)) == 0).select("text").mapInArrow(_all, "shingle long")
    seen = seen.groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(FREQUENT).collect()
    seen.sort(key=lambda r: r["shingle"] % (1 << 64))
    frequent, counts = np.array([r[0] for r in seen], np.int64).view(np.uint64), np.array([r[1] for r in seen], np.int64)
    levels = _levels(docs, frequent, counts)
    rows = docs.select("text").mapInArrow(lambda it: _prefixes(it, frequent, counts, levels), "shingle long, node long, at long")
    live = common.stage(_together(rows).mapInArrow(_shared, rows.schema), "shingle-prefixes")

    # first links: each set with the sets that stand first at the most of its own first shingles, and with those that the
    # grid join finds near its fingerprint. The place of a shingle that many near copies share is the number of rarer ones
    # before it, so the copy with the fewest edits stands first, and the others link with it: a link a set, not one a pair.
    kind = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int").alias("kind")
    placed = live.withColumn("n", F.shiftright("at", 31)).withColumn("i", F.col("at").bitwiseAND(F.lit((1 << 31) - 1))).select("shingle", "node", "i", kind)
    first = verified(docs, distinct, _stars(placed).unionByName(_alike(distinct)).distinct(), "shingle-first")

    # what is left: pairs of different components. Shingles whose sets are all in one are done with.
    parts = common.stage(_named(live.select("node").distinct(), common.components(first, "shingle-parts"), "part"), "shingle-parts")
    placed = live.join(parts, "node")
    several = placed.groupBy("shingle").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("shingle")
    placed = common.stage(placed.join(several, "shingle"), "shingle-left")
    mine = placed.select("shingle", F.col("node").alias("u"), F.col("part").alias("p"), F.shiftright("at", 31).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).alias("i"))
    theirs = mine.select("shingle", F.col("u").alias("v"), F.col("p").alias("q"), F.col("n").alias("m"), F.col("i").alias("j"))
    # what the sets can share from their first common shingle on must suffice
    pairs = mine.join(theirs, "shingle").where("p < q and 5 * least(n, m) >= 4 * greatest(n, m) and 9 * least(n - i, m - j) >= 4 * (n + m)")
    rest = verified(docs, distinct, pairs.select("u", "v").distinct(), "shingle-rest")
    for done in (live, parts, placed):
        common.unstage(done)
    return first.unionByName(rest)


def near_duplicates(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text_key and component_id of every row of docs (doc_id, text; others are ignored).

    Texts link where their sets of five-word shingles (A-Z lower-cased, words parted by ASCII white space) have a Jaccard
    similarity of 0.8 or more. Equal sets are one group before anything is compared. Two sets that link share one of
    their first shingles in any order common to all; rare ones come first. Every set is first held against one other, so
    that large groups of near copies become components in a link a set; then the pairs of different components that
    share a first shingle pass by three bounds (sizes, places, bitmaps), none of which loses a pair, and what is left is
    decided by the sets themselves. No link between components is lost; links inside one aren't all made. Many sets that
    share most shingles and are still less similar than 0.8 are compared pair by pair: no bound is known for these.
    Texts with one to four words have one shingle, null, empty and blank ones none: those are equal to each other. A very
    long text is held whole in its task, with 8 bytes a shingle. A null doc_id keeps its row and links, but names no
    component. Repeated rows give repeated rows; a similarity of exactly 0.8 links; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.text_key().alias("text_key"))
    with common.small_batches(docs.sparkSession):  # all Python of the stage runs here
        sets = common.stage(rows.mapInArrow(_sets, "doc_id long, text_key long, node long, n long, fp long, bits binary"), "shingle-sets")
        distinct = common.stage(sets.groupBy("node").agg(F.min("doc_id").alias("low"), *(F.first(c).alias(c) for c in ("n", "fp", "bits"))), "shingle-distinct")
        comps = common.components(_links(rows, sets, distinct, sample), "shingle-components")
    labelled = _named(distinct.select("node", "low"), comps, "component")
    low = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    return sets.select("doc_id", "text_key", "node").join(labelled.join(low, "component").select("node", "component_id"), "node", "left").select("doc_id", "text_key", "component_id")
