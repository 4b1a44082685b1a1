"""Listings, counts and operational reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import catalog

SORTS = ("source_doc_id", "title", "created_at", "updated_at", "last_indexed")
LEVELS = {"error": 0, "warn": 1, "info": 2, "debug": 3, "all": 4}


def resolve_document_id(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """requests (request, project_id or null) with document_id: a number as an id (in the project where one is given),
    else a source id of the project, else 0 for a virtual document."""
    number = F.expr("try_cast(request as long)")
    rows = requests.withColumn("_n", number)
    by_id = documents.select(F.col("id").alias("_id"), F.col("project_id").alias("_p1"))
    by_sid = documents.select(F.col("id").alias("_sid"), F.col("source_doc_id").alias("_s"), F.col("project_id").alias("_p2"))
    rows = rows.join(by_id, (F.col("_n") == F.col("_id")) & (F.col("project_id").isNull() | (F.col("project_id") == F.col("_p1"))), "left")
    rows = rows.join(by_sid, (F.col("request") == F.col("_s")) & (F.col("project_id") == F.col("_p2")), "left")
    return rows.withColumn("document_id", F.coalesce("_id", "_sid", F.lit(0).cast("long"))).select(*requests.columns, "document_id")


def documents_page(documents: DataFrame, project_id: int, sort_by: str = "source_doc_id", ascending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a project's documents with the next cursor (null where the page isn't full). Nulls sort first ascending."""
    if sort_by not in SORTS:
        raise ValueError(f"sort by one of {SORTS}")
    order = [F.asc(sort_by) if ascending else F.desc(sort_by), F.asc("id")]
    page = documents.where(F.col("project_id") == project_id).orderBy(*order).offset(offset).limit(limit)
    full = F.count(F.lit(1)).over(Window.partitionBy()) == limit
    return page.select("id", "source_doc_id", "title", "created_at", "updated_at", F.when(full, offset + limit).alias("next_cursor"))


def all_documents(documents: DataFrame, projects: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    joined = documents.join(projects.where("status = 'active'").select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    title = F.coalesce(F.nullif("title", F.lit("")), "source_doc_id")
    return joined.select("id", "project", title.alias("title"), "updated_at").orderBy("project", "title", "id").offset(offset).limit(limit)


def top_viewed(documents: DataFrame, views: DataFrame, limit: int = 5, project_id: int | None = None) -> DataFrame:
    """Documents by view count, never viewed ones at 0."""
    rows = documents if project_id is None else documents.where(F.col("project_id") == project_id)
    joined = rows.join(views.select(F.col("document_id").alias("id"), "count"), "id", "left")
    return joined.select("id", "title", F.coalesce("count", F.lit(0)).alias("views")).orderBy(F.desc("views"), "id").limit(limit)


def top_tags(tags: DataFrame, limit: int = 10) -> DataFrame:
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "tag").limit(limit)


def recent_documents(documents: DataFrame, limit: int = 5) -> DataFrame:
    return documents.where("last_indexed is not null").orderBy(F.desc("last_indexed"), "id").limit(limit).select("id", "title", "last_indexed")


def document_tags(tags: DataFrame) -> DataFrame:
    """document_id and its sorted tags."""
    return tags.groupBy("document_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(counts, "id", "left").select("id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def inspect_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Metadata, chunk count and status: indexed where it was indexed and has chunks, else pending_indexing."""
    joined = documents.join(chunk_counts(documents, chunks), "id")
    done = F.col("last_indexed").isNotNull() & (F.col("chunk_count") > 0)
    return joined.select("id", "source_doc_id", "project_id", "title", "content_hash", "last_indexed", "chunk_count", F.when(done, "indexed").otherwise("pending_indexing").alias("status"))


def corpus_status(projects: DataFrame, documents: DataFrame, chunks: DataFrame, instances: DataFrame) -> DataFrame:
    """One row of counts."""
    p = projects.agg(F.count(F.lit(1)).alias("projects"), F.coalesce(F.sum((F.col("status") == "active").cast("long")), F.lit(0)).alias("active_projects"))
    d = documents.agg(F.count(F.lit(1)).alias("documents"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    i = instances.agg(F.count_distinct("plugin_id").alias("plugins"))
    one = F.lit(1).alias("_one")
    out = p.select("*", one)
    for part in (d, c, i):  # one row each
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one")


def agent_summary(projects: DataFrame, instances: DataFrame, documents: DataFrame) -> DataFrame:
    """Active projects with document counts and the latest sync of their instances."""
    docs = documents.groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
    synced = instances.groupBy(F.col("project_id").alias("id")).agg(F.max("last_synced").alias("last_synced"))
    rows = projects.where("status = 'active'").join(docs, "id", "left").join(synced, "id", "left")
    return rows.select("id", "name", "source_type", F.coalesce("documents", F.lit(0)).alias("documents"), "last_synced").orderBy("name")


def plugin_instances(instances: DataFrame, projects: DataFrame) -> DataFrame:
    """Instances and last sync of each plugin (a project's type where an instance names none)."""
    rows = instances.join(projects.select(F.col("id").alias("project_id"), "source_type"), "project_id", "left")
    return rows.groupBy(F.coalesce("plugin_id", "source_type").alias("plugin_id")).agg(F.count(F.lit(1)).alias("instances"), F.max("last_synced").alias("last_synced"))


def logs(plugin_logs: DataFrame, plugin_id: str, level: str = "info", limit: int = 50) -> DataFrame:
    """Newest first, of the level and all graver ones."""
    rank = F.lit(99)
    for name, n in LEVELS.items():
        rank = F.when(F.col("level") == name, n).otherwise(rank)
    rows = plugin_logs.where((F.col("plugin_id") == plugin_id) & ((rank <= LEVELS[level]) if level != "all" else F.lit(True)))
    return rows.orderBy(F.desc("created_at"), "message").limit(limit)


def newest(history: DataFrame, limit: int, at: str = "started_at") -> DataFrame:
    """Reindex history (10), job runs (50), audit log (50): newest first."""
    return history.orderBy(F.desc(at), *(c for c in ("id", "job_id") if c in history.columns)).limit(limit)


def get_documents(documents: DataFrame, chunks: DataFrame, ids: list[int]) -> DataFrame:
    """id, title, content of known ids, content rebuilt from chunks."""
    rows = documents.where(F.col("id").isin(ids))
    return rows.join(catalog.rebuild_content(chunks).withColumnRenamed("document_id", "id"), "id", "left").select("id", "title", "content")


def resolve_alias(aliases: DataFrame, documents: DataFrame, projects: DataFrame, alias: str) -> DataFrame:
    rows = catalog.first_alias(aliases.where(F.col("alias") == alias))
    rows = rows.join(documents.select(F.col("id").alias("document_id"), "project_id", "source_doc_id"), "document_id")
    return rows.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id").select("project", "source_doc_id", "document_id")


def hits_by_project(hits: DataFrame) -> DataFrame:
    """project, hits (in rank order) and their count."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "document_id")))
    return hits.groupBy("project").agg(F.count(F.lit(1)).alias("hits"), F.transform(ordered, lambda h: h["document_id"]).alias("document_ids"))


def search_quality(hits: DataFrame, expected: DataFrame, at: int = 5) -> DataFrame:
    """One row: queries, top1, top3, mrr, recall and precision at `at`, over queries (query_id) with expected documents."""
    want = expected.select("query_id", "document_id").distinct()
    found = want.join(hits.where(F.col("rank") <= at).select("query_id", "document_id", "rank"), ["query_id", "document_id"], "left")
    each = found.groupBy("query_id").agg(F.min("rank").alias("best"), F.count("rank").alias("hit"), F.count(F.lit(1)).alias("wanted"))
    share = lambda ok: F.avg(F.coalesce(ok, F.lit(False)).cast("double"))
    return each.agg(
        F.count(F.lit(1)).alias("queries"), share(F.col("best") == 1).alias("top1"), share(F.col("best") <= 3).alias("top3"), F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"),
        F.avg(F.col("hit") / F.col("wanted")).alias("recall"), F.avg(F.col("hit") / F.lit(at)).alias("precision"),
    )


def reciprocal_ranks(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, reciprocal_rank of its first expected document (0 where no hit is one), hits: of each query with expected
    documents."""
    want = expected.select("query_id", "document_id").distinct()
    best = hits.join(want, ["query_id", "document_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("_best"))
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = want.select("query_id").distinct().join(best, "query_id", "left").join(found, "query_id", "left")
    return rows.select("query_id", F.coalesce(1 / F.col("_best"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce("_n", F.lit(0)).alias("hits"))


def enriched_hits(hits: DataFrame, documents: DataFrame, projects: DataFrame, freshness: DataFrame, tags: DataFrame, instances: DataFrame) -> DataFrame:
    """Hits with title, display path, project, url, tags, freshness and the cache lifetime of their plugin. The path is
    without the project's root where projects has one."""
    from ..functions.text import display_path
    from .freshness import with_freshness

    docs = documents.select(F.col("id").alias("document_id"), "project_id", "source_doc_id", "title", "url", "metadata_json", "file_path")
    root = F.coalesce(F.col("path"), F.lit("")) if "path" in projects.columns else F.lit("")
    rows = hits.join(docs, "document_id").join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"), root.alias("_root")), "project_id")
    rows = rows.withColumn("display_path", display_path(F.col("file_path"), F.col("_root"), F.col("project"))).drop("_root", "file_path")
    rows = with_freshness(rows, freshness).join(document_tags(tags), "document_id", "left")
    ttl = instances.groupBy("project_id").agg(F.max("cache_ttl_minutes").alias("cache_ttl_minutes"))
    return rows.join(ttl, "project_id", "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "source_doc_id"))


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in conditions.items()))
