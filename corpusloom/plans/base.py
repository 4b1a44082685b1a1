"""The logical catalog derived from the driver's tables, in Spark and as the same SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Times of the derived catalog: documents begin here, and reports are as of this second.
EPOCH, AS_OF = 1_700_000_000, 1_710_000_000


def query(oracle: str | None = None):
    """Registers a query under its function's name, and its oracle (the catalog's WITH clauses are put before it)."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:  # it may begin with further WITH clauses
            ORACLES[f.__name__] = f"WITH RECURSIVE {CATALOG_SQL}\n{oracle}"
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each source, numbered by name; src7 is disabled, src1 and src2 are of type github."""
    names = read(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    # one row a source: a window over all of them is small
    return names.select(
        F.dense_rank().over(Window.orderBy("name")).cast("long").alias("id"),
        "name",
        F.when(F.col("name") == "src7", "disabled").otherwise("active").alias("status"),
        F.when(F.col("name").isin("src1", "src2"), "github").otherwise("vault").alias("source_type"),
        F.when(F.col("name") == "src3", '{"sensitivity_mode":"Strict"}').when(F.col("name") == "src4", '{"sensitivity_mode":"relaxed"}').alias("freshness_policy_json"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with ids, project, title (first 40 characters), content and times made from the id."""
    rows = read(spark, sf_dir, "documents")
    owner = projects(spark, sf_dir).select(F.col("id").alias("project_id"), F.col("name").alias("source"))
    created = F.lit(EPOCH) + F.col("doc_id") * 3600
    return rows.join(F.broadcast(owner), "source").select(
        F.col("doc_id").alias("id"),
        "project_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_doc_id"),
        F.substring("text", 1, 40).alias("title"),
        F.col("text").alias("content"),
        F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"),
        created.alias("created_at"),
        (created + F.col("doc_id") % 30 * 86400).alias("updated_at"),
        "lang",
        "source",
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, tag: language and source."""
    rows = read(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("document_id"), F.explode(F.array("lang", F.upper("source"))).alias("tag"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic links between documents: id -> id * 7 + 1 and id -> id * 3 + 2, modulo their number."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"))
    n = rows.count()
    return rows.select("source_id", F.explode(F.array((F.col("source_id") * 7 + 1) % n, (F.col("source_id") * 3 + 2) % n)).alias("target_id"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback: quality +1 or -1, toxic -1."""
    rows = read(spark, sf_dir, "labels")
    scores = F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, 1.0).otherwise(-1.0), F.when(F.col("toxic") == 1, -1.0))))
    return rows.select(F.col("doc_id").alias("document_id"), scores.alias("score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import quantize_i8

    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), quantize_i8(F.col("embedding")).alias("embedding"))


CATALOG_SQL = f"""
projs AS (
  SELECT dense_rank() OVER (ORDER BY name) AS id, name, CASE WHEN name = 'src7' THEN 'disabled' ELSE 'active' END AS status,
    CASE WHEN name IN ('src1', 'src2') THEN 'github' ELSE 'vault' END AS source_type,
    CASE name WHEN 'src3' THEN 'strict' WHEN 'src4' THEN 'relaxed' ELSE 'normal' END AS mode
  FROM (SELECT DISTINCT source AS name FROM documents)
), docs AS (
  SELECT d.doc_id AS id, p.id AS project_id, 'doc-' || d.doc_id AS source_doc_id, substr(d.text, 1, 40) AS title, d.text AS content,
    d.source || '/' || d.lang || '/doc-' || d.doc_id || '.md' AS file_path,
    {EPOCH} + d.doc_id * 3600 AS created_at, {EPOCH} + d.doc_id * 3600 + d.doc_id % 30 * 86400 AS updated_at, d.lang, d.source
  FROM documents d JOIN projs p ON p.name = d.source
), dtags AS (
  SELECT doc_id AS document_id, lang AS tag FROM documents UNION ALL SELECT doc_id, upper(source) FROM documents
), links AS (
  SELECT doc_id AS source_id, (doc_id * 7 + 1) % (SELECT count(*) FROM documents) AS target_id FROM documents
  UNION ALL SELECT doc_id, (doc_id * 3 + 2) % (SELECT count(*) FROM documents) FROM documents
), fb AS (
  SELECT doc_id AS document_id, CASE WHEN quality = 1 THEN 1.0 ELSE -1.0 END AS score FROM labels
  UNION ALL SELECT doc_id, -1.0 FROM labels WHERE toxic = 1
), vecs AS (
  SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: greatest(-128, least(127, CASE WHEN x < 0 THEN -floor(-x::DOUBLE * 128 + 0.5) ELSE floor(x::DOUBLE * 128 + 0.5) END))::INTEGER) AS v FROM embeddings
)"""
