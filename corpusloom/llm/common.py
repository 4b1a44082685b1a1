"""Shared pieces: staged tables, graph components over DataFrames, and small numpy helpers."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import stage, stage_dir, unstage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The session setting that bounds what an Arrow function gets at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, limit: str = "2m"):
    """Jobs started meanwhile pass rows to Arrow functions in batches of some `limit` of bytes, one row at least: ten
    thousand texts at once, Spark's own bound, take hundreds of MB beside an executor's heap. Never a larger limit than the
    session has. Jobs that other threads start meanwhile in the same session get it too, which changes no result."""
    before = spark.conf.get(BATCH_BYTES)
    sizes = spark._jvm.org.apache.spark.network.util.JavaUtils
    if sizes.byteStringAsBytes(limit) < sizes.byteStringAsBytes(before):
        spark.conf.set(BATCH_BYTES, limit)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def text_key(text: str = "text") -> F.Column:
    """Tells rows apart that share a doc_id: rows that agree on both are copies and get the same result."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without near duplicates, where found has doc_id, text_key, component_id of every row: of each component the
    row with the smallest doc_id, and of its texts the one with the smallest key, once; rows with a null doc_id stay.
    Documents move once."""
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias("_loom_text"))
    kept = kept.withColumnRenamed("doc_id", "_loom_doc")
    rows = docs.where("doc_id is not null").withColumn("_loom_id", F.col("doc_id").cast("long")).withColumn("_loom_key", text_key())
    rows = rows.join(kept, (F.col("_loom_id") == F.col("_loom_doc")) & (F.col("_loom_key") == F.col("_loom_text")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("_loom_id", "_loom_key").orderBy(F.lit(0)))
    rows = rows.withColumn("_loom_turn", turn).where("_loom_turn = 1").drop("_loom_id", "_loom_key", "_loom_turn")
    return rows.unionByName(docs.where("doc_id is null"))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index for each of n nodes under the links a[i]-b[i]."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        # only roots are hooked: a link to another root than the smallest stays for the next round
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


EDGE = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _contract(batches):
    """Per task: replace its links by a spanning star of each local component, at most one row a node."""
    import pandas as pd

    us, vs = [], []

    def packed():
        u, v = np.concatenate(us), np.concatenate(vs)
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = forest(at[: len(u)], at[len(u) :], len(nodes))
        child = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[child], nodes[label[child]]

    held = 0
    for pdf in batches:
        if len(pdf):
            us.append(pdf["u"].to_numpy())
            vs.append(pdf["v"].to_numpy())
            held += len(pdf)
            if held > 2_000_000:
                u, v = packed()
                us, vs = [u], [v]
                if len(u) > 1_000_000:  # little to contract: pass them on and start anew
                    yield pd.DataFrame({"u": u, "v": v})
                    us, vs = [], []
                held = sum(map(len, us))
    if us:
        u, v = packed()
        yield pd.DataFrame({"u": u, "v": v})


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links (u, v): one row (node, component) for each node that has a link.

    component is the smallest node reachable. Large-star and small-star rounds over DataFrames; each round's links
    are written to the shared folder, minima are pre-aggregated, and nothing but two checksums reaches the driver.
    """
    spark = edges.sparkSession
    links = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").mapInPandas(_contract, EDGE)
    # v is the smaller end of every link from here on
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        count, check = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if count == 0 or (count, check) == seen:
            break
        seen = (count, check)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("n <> m").select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(low, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        before, links = links, stage(small, name)
        unstage(before)
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
