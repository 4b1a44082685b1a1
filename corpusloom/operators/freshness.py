"""Freshness: exponential decay by tier and sensitivity, status, reports, overrides and resets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half-lives in days by tier, their factor by sensitivity, and the score from which a status holds.
HALF_LIFE = {"short": 45.0, "mid": 90.0, "long": 180.0}
SENSITIVITY = {"strict": 0.5, "normal": 1.0, "relaxed": 1.5}
FRESH_FROM, AGING_FROM = 70.0, 40.0
SHORT_SOURCES = ("github",)


def _choice(value: Column, table: dict, default: float) -> Column:
    out = F.lit(default)
    for name, number in table.items():
        out = F.when(value == name, number).otherwise(out)
    return out


def score(days: Column, tier: Column, mode: Column) -> Column:
    """100 * 2^(-days / half life), clamped to 0..100; unknown tiers are mid, unknown modes normal."""
    life = _choice(tier, HALF_LIFE, HALF_LIFE["mid"]) * _choice(mode, SENSITIVITY, 1.0)
    return F.least(F.greatest(100 * F.exp(-math.log(2) / life * days), F.lit(0.0)), F.lit(100.0))


def status(value: Column) -> Column:
    return F.when(value >= FRESH_FROM, "fresh").when(value >= AGING_FROM, "aging").otherwise("stale")


def default_tier(source_type: Column) -> Column:
    return F.when(source_type.isin(*SHORT_SOURCES), "short").otherwise("mid")


def sensitivity(policy_json: Column) -> Column:
    return F.coalesce(F.lower(F.get_json_object(policy_json, "$.sensitivity_mode")), F.lit("normal"))


def initial(documents: DataFrame, projects: DataFrame, as_of: int) -> DataFrame:
    """A freshness row for every document."""
    joined = documents.join(projects.select(F.col("id").alias("project_id"), "source_type"), "project_id", "left")
    seen = F.coalesce("updated_at", "created_at", F.lit(as_of).cast("long"))
    return joined.select(
        F.col("id").alias("document_id"), F.lit(100.0).alias("freshness_score"), F.lit("fresh").alias("status"), default_tier(F.col("source_type")).alias("retention_tier"),
        F.lit("auto").alias("tier_source"), F.lit(0).cast("long").alias("change_count"), seen.alias("first_seen_at"), seen.alias("last_content_change"), F.lit(as_of).cast("long").alias("score_updated_at"),
    )


def recompute(freshness: DataFrame, documents: DataFrame, projects: DataFrame, as_of: int, project_id: int | None = None, document_id: int | None = None) -> DataFrame:
    """Scores and statuses as of a time, for all documents, a project's, or one; others are left as they are."""
    owner = documents.select(F.col("id").alias("document_id"), "project_id").join(projects.select(F.col("id").alias("project_id"), "freshness_policy_json"), "project_id", "left")
    rows = freshness.join(owner, "document_id", "left")
    days = (F.lit(as_of) - F.coalesce("last_content_change", F.lit(as_of))) / 86400.0
    new = score(days, F.col("retention_tier"), sensitivity(F.col("freshness_policy_json")))
    hit = F.lit(True)
    if project_id is not None:
        hit = hit & (F.col("project_id") == project_id)
    if document_id is not None:
        hit = hit & (F.col("document_id") == document_id)
    rows = rows.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_new", new)
    rows = rows.withColumn("freshness_score", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("freshness_score")))
    rows = rows.withColumn("status", F.when(F.col("_hit"), status(F.col("_new"))).otherwise(F.col("status")))
    rows = rows.withColumn("score_updated_at", F.when(F.col("_hit"), F.lit(as_of).cast("long")).otherwise(F.col("score_updated_at")))
    return rows.select(*freshness.columns)


def set_tier(freshness: DataFrame, documents: DataFrame, projects: DataFrame, document_id: int, tier: str, as_of: int) -> DataFrame:
    """A user's tier for a document, its score recomputed."""
    if tier not in HALF_LIFE:
        raise ValueError(f"unknown tier {tier!r}")
    mine = F.col("document_id") == document_id
    out = freshness.withColumn("retention_tier", F.when(mine, tier).otherwise(F.col("retention_tier"))).withColumn("tier_source", F.when(mine, "user").otherwise(F.col("tier_source")))
    return recompute(out, documents, projects, as_of, document_id=document_id)


def content_changes(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """document_id, old_hash, new_hash, changed_at of documents whose hash differs between two snapshots."""
    pairs = old.select(F.col("id").alias("document_id"), F.col("content_hash").alias("old_hash")).join(new.select(F.col("id").alias("document_id"), F.col("content_hash").alias("new_hash")), "document_id")
    return pairs.where("old_hash is not null and new_hash is not null and old_hash <> new_hash").withColumn("changed_at", F.lit(now).cast("long"))


def reset_changed(freshness: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed documents are fresh again and counted."""
    hits = changes.groupBy("document_id").agg(F.max("changed_at").alias("_at"), F.count(F.lit(1)).alias("_n"))
    rows, hit = freshness.join(hits, "document_id", "left"), F.col("_at").isNotNull()
    for column, value in (("freshness_score", F.lit(100.0)), ("status", F.lit("fresh")), ("change_count", F.col("change_count") + F.col("_n")), ("last_content_change", F.col("_at")), ("score_updated_at", F.col("_at"))):
        rows = rows.withColumn(column, F.when(hit, value).otherwise(F.col(column)))
    return rows.select(*freshness.columns)


def report(freshness: DataFrame, documents: DataFrame | None = None, project_id: int | None = None) -> DataFrame:
    """One row: total, fresh, aging, stale, obsolete, average_score (0 where there is nothing)."""
    rows = freshness
    if project_id is not None and documents is not None:
        mine = documents.where(F.col("project_id") == project_id).select(F.col("id").alias("_d"))
        rows = rows.join(mine, F.col("document_id") == F.col("_d"), "left_semi")
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s)
    return rows.agg(F.count(F.lit(1)).alias("total"), *map(count, ("fresh", "aging", "stale", "obsolete")), F.coalesce(F.avg("freshness_score"), F.lit(0.0)).alias("average_score"))


def stalest(freshness: DataFrame, documents: DataFrame, projects: DataFrame, limit: int = 20) -> DataFrame:
    """Stale and aging documents of active projects, lowest score first."""
    active = projects.where("status = 'active'").select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    rows = freshness.where(F.col("status").isin("stale", "aging")).join(documents.select(F.col("id").alias("document_id"), "project_id", "source_doc_id", "title"), "document_id").join(active, "project_id")
    return rows.orderBy("freshness_score", "document_id").limit(limit).select("document_id", "project", "source_doc_id", "title", "freshness_score", "status", "retention_tier")


def with_freshness(hits: DataFrame, freshness: DataFrame) -> DataFrame:
    """Hits with score and tier; documents without a row count as 100 and mid."""
    extra = freshness.select("document_id", "freshness_score", "retention_tier")
    out = hits.join(extra, "document_id", "left")
    return out.withColumn("freshness_score", F.coalesce("freshness_score", F.lit(100.0))).withColumn("retention_tier", F.coalesce("retention_tier", F.lit("mid")))
