"""Sharding: proportional stratified interleaving of seeded-shuffled sources, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shards, seed of the shuffle, hash cells of a source (a power of two). Cells are stretches of the hash's own order, so
#: their number splits the work and never moves a row.
SHARDS, SEED, CELLS = 16, 42, 4096


def _ranked(rows: DataFrame, keys: list[str], cell: str, order: list, out: str) -> DataFrame:
    """Rank from 0 of each row within `keys` by (cell, order), and the keys' total. Cells split even a key that holds
    all rows: counts of cells are pre-aggregated, summed up within a key, and added to the rank inside a cell."""
    counts = rows.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(cell)
    counts = counts.select(
        *(F.col(k).alias(f"_{k}") for k in [*keys, cell]),
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{out}_total"),
    )
    on = None
    for k in [*keys, cell]:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    inside = F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order))
    joined = rows.withColumn("_inside", inside).join(counts, on)
    return joined.withColumn(out, F.col("_before") + F.col("_inside") - 1).drop("_before", "_inside", *(f"_{k}" for k in [*keys, cell]))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source", cells: int = CELLS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of every row of docs (doc_id, text, source): law `rows`.

    Rows of a source are shuffled by a seeded hash of their id, checksum and size and ranked from 0; (rank + 1/2) / rows
    of the source is their fractional rank. All rows are ordered by it and cut into `shards` runs whose counts differ by
    one at most, so each shard holds each source in proportion, and so does every stretch of a shard. slot counts from 0
    in a shard. Seed and rows alone decide the places: no setting of the session, no number of tasks or cells.
    No text is shuffled. Ranks come from pre-aggregated counts of `cells` stretches of a source's hashes and of `cells`
    equal stretches of the fractional rank, so no source and no task meets more than a cell's rows in one place.
    Null text: size 1, crc of nothing; empty text the same. Very long texts only cost their size and checksum. A null
    source is a source of its own; null and repeated ids are kept, rows that agree in id, size and checksum are
    interchangeable. Equal fractional ranks are ordered by source. An empty table gives no rows; other columns are ignored.
    """
    if cells & (cells - 1) or not 0 < cells <= 1 << 30:
        raise ValueError("cells must be a power of two")
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(source).alias("source"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("shuffle", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    # the hash's leading bits, sign included: in the order of the hash itself
    rows = rows.withColumn("hash_cell", F.floor(F.shiftright("shuffle", 32) / F.lit((1 << 32) // cells)))
    tie = ["shuffle", "doc_id", "text_crc32", "size"]
    ranked = _ranked(rows, ["source"], "hash_cell", tie, "rank")
    ranked = ranked.withColumn("fraction", (F.col("rank") + 0.5) / F.col("rank_total"))
    ranked = ranked.withColumn("stretch", F.floor(F.col("fraction") * cells)).withColumn("one", F.lit(0))
    # the same ranking over all rows: `stretch` is uniform by construction, and the table of its counts has `cells` rows
    placed = _ranked(ranked, ["one"], "stretch", ["fraction", "source", *tie], "place")
    shard = F.expr(f"place * {shards} div place_total")
    first = F.expr(f"(shard * place_total + {shards} - 1) div {shards}")
    return placed.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"))


def report(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source."""
    return interleave(docs, shards, **options).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """The documents as Parquet, one folder a shard, rows in slot order within its files. Columns of docs named shard or
    slot give way to these."""
    docs = docs.drop("shard", "slot")
    placed = interleave(docs, shards, **options).select(
        F.col("doc_id").alias("_loom_doc"), F.col("source").alias("_loom_source"), F.col("text_crc32").alias("_loom_crc"), "shard", "slot"
    )
    # copies that agree in id, source and text take their places in turn
    turn = Window.partitionBy("_loom_doc", "_loom_source", "_loom_crc").orderBy("slot", "shard")
    own = Window.partitionBy("doc_id", "source", "_loom_own").orderBy("doc_id")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.withColumn("_loom_own", crc).withColumn("_loom_turn", F.row_number().over(own))
    placed = placed.withColumn("_loom_place", F.row_number().over(turn))
    on = F.col("doc_id").eqNullSafe(F.col("_loom_doc")) & F.col("source").eqNullSafe(F.col("_loom_source")) & (F.col("_loom_own") == F.col("_loom_crc")) & (F.col("_loom_turn") == F.col("_loom_place"))
    out = rows.join(placed, on).drop("_loom_doc", "_loom_source", "_loom_crc", "_loom_own", "_loom_turn", "_loom_place")
    out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
