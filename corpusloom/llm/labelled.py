"""Bounded, class-balanced samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key


def remainder(modulus: int, doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id's text, modulo."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """Labelled training documents (doc_id, text, label) and each class's weight (labelled rows a sampled row).

    Rows whose remainder is `held_out`, null labels and null ids are out. Of each class the `per_class` rows with the
    smallest hash of their id are taken (a bound that doesn't grow with the corpus; below it, all rows). Repeated
    equal labels count once; a document labelled both ways counts for both. Rows of docs that share a labelled id count
    as one document, so at most 2 * `per_class` rows come back however often an id repeats.
    """
    known = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(modulus) != held_out))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
        .distinct()
    )
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumnRenamed("doc_id", "_id")
    # at most 2 * per_class rows of 12 bytes: proven small enough to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("_key"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # ids may repeat in docs, so the bound holds only for one row an id and label: of its texts the one with the least key
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct("_key", "text"))["text"].alias("text"))
    weights = {label: n / min(n, per_class) for label, n in totals.items()}
    return rows.select("doc_id", "text", "label"), weights
