"""Change detection, incremental sync, reindexing, conflicts, sync policies and retry, as set operations."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import catalog

#: Seconds: default interval, focus cooldowns of local and other sources; retry limits.
DEFAULT_INTERVAL, LOCAL_COOLDOWN, REMOTE_COOLDOWN = 7200, 60, 900
RETRY_BASE, RETRY_CAP, FREE_WAIT, GIVE_UP = 10, 300, 300, 3


def needs_reindexing(incoming: DataFrame, indexed: DataFrame, content_hash: Column | None = None) -> DataFrame:
    """incoming with `needs`: never indexed, or times differ, or (without times) hashes differ, or neither is known.
    content_hash: of incoming, where it isn't a column; it is worked out only where times don't decide."""
    content_hash = F.col("content_hash") if content_hash is None else content_hash
    known = indexed.select("project_id", "source_doc_id", F.col("updated_at").alias("_at"), F.col("content_hash").alias("_hash"), F.col("last_indexed").alias("_indexed"))
    rows = incoming.join(known, ["project_id", "source_doc_id"], "left")
    needs = (
        F.when(F.col("_indexed").isNull(), True)
        .when(F.col("updated_at").isNotNull() & F.col("_at").isNotNull(), F.col("updated_at") != F.col("_at"))
        .when(content_hash.isNotNull() & F.col("_hash").isNotNull(), content_hash != F.col("_hash"))
        .otherwise(True)
    )
    return rows.withColumn("needs", needs).drop("_at", "_hash", "_indexed")


def full_index(incoming: DataFrame, indexed: DataFrame, started: int) -> tuple[DataFrame, DataFrame]:
    """(documents after the run, what happened to each: indexed, skipped or deleted).

    Unchanged documents are skipped but marked as seen; documents of the same projects not seen in this run go.
    """
    rows = needs_reindexing(incoming, indexed)
    seen = rows.withColumn("last_indexed", F.lit(started).cast("long"))
    merged = catalog.upsert_documents(indexed, _as_documents(seen.where("needs"), indexed))
    touched = seen.where("not needs").select("project_id", "source_doc_id", F.lit(started).cast("long").alias("_seen"))
    merged = merged.join(touched, ["project_id", "source_doc_id"], "left").withColumn("last_indexed", F.coalesce("_seen", "last_indexed")).drop("_seen")
    scope = incoming.select(F.col("project_id").alias("_p")).distinct()
    inside = merged.join(scope, F.col("project_id") == F.col("_p"), "left_semi")
    gone = inside.where(F.col("last_indexed").isNull() | (F.col("last_indexed") < started)).select("project_id", "source_doc_id")
    kept = merged.join(gone, ["project_id", "source_doc_id"], "left_anti").select(*indexed.columns)
    happened = rows.select("project_id", "source_doc_id", F.when(F.col("needs"), "indexed").otherwise("skipped").alias("action"))
    return kept, happened.unionByName(gone.withColumn("action", F.lit("deleted")))


def _as_documents(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None).cast(like.schema[c].dataType)).alias(c) for c in like.columns))


def incremental_index(incoming: DataFrame, indexed: DataFrame, since: int | None, deleted: DataFrame | None, started: int) -> DataFrame:
    """Documents after applying changes since a time and deletions; without a time, a full run."""
    if since is None:
        return full_index(incoming, indexed, started)[0]
    changed = needs_reindexing(incoming.where(F.col("updated_at") > since), indexed).where("needs").withColumn("last_indexed", F.lit(started).cast("long"))
    merged = catalog.upsert_documents(indexed, _as_documents(changed, indexed))
    return merged.join(deleted, ["project_id", "source_doc_id"], "left_anti").select(*indexed.columns) if deleted is not None else merged


def apply_page(indexed: DataFrame, updates: DataFrame, deleted: DataFrame, next_cursor: str | None, now: int) -> tuple[DataFrame, str | None]:
    """(documents after one page of a source, the cursor to store with them): updates are taken as they come, deletions
    (project_id, source_doc_id) go. Saved with the cursor as its note, a snapshot is applied whole or not at all."""
    seen = _as_documents(updates.withColumn("last_indexed", F.lit(now).cast("long")), indexed)
    merged = catalog.upsert_documents(indexed, seen)
    return merged.join(deleted, ["project_id", "source_doc_id"], "left_anti").select(*indexed.columns), next_cursor


def deleted_ids(known: DataFrame, present: DataFrame, key: str = "source_doc_id") -> DataFrame:
    """Known ids that the source no longer has."""
    return known.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def resolve_conflicts(pairs: DataFrame) -> DataFrame:
    """local_hash and remote text to decision: skip where the cleaned remote text has the local hash, else use_remote."""
    return pairs.withColumn("decision", F.when(X.content_hash(F.col("remote")) == F.col("local_hash"), "skip").otherwise("use_remote"))


def apply_conflicts(documents: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with the remote hash where remote wins, audit events of those)."""
    won = resolve_conflicts(pairs).where("decision = 'use_remote'").select(F.col("document_id").alias("_d"), X.content_hash(F.col("remote")).alias("_h"))
    out = documents.join(won, F.col("id") == F.col("_d"), "left").withColumn("content_hash", F.coalesce("_h", "content_hash")).drop("_d", "_h")
    events = won.select(F.lit("sync_conflict").alias("event"), F.lit(None).cast("long").alias("project_id"), F.col("_d").alias("document_id"), F.col("_h").alias("new_hash"))
    return out, events


def due_instances(instances: DataFrame, projects: DataFrame, now: int, interval: int = DEFAULT_INTERVAL) -> DataFrame:
    """Instances of active projects never synced or synced at least an interval ago, oldest first."""
    active = projects.where("status = 'active'").select(F.col("id").alias("_p"))
    rows = instances.join(active, F.col("project_id") == F.col("_p"), "left_semi")
    return rows.where(F.col("last_synced").isNull() | (F.lit(now) - F.col("last_synced") >= interval)).orderBy(F.asc_nulls_first("last_synced"), "id")


def should_sync(rows: DataFrame, trigger: str, now: int, jitter: float = 0.0) -> DataFrame:
    """`sync` by policy JSON {mode, interval_seconds}: realtime sources push; on_focus syncs on focus after a cooldown
    (local or remote); interval syncs periodically with a jitter of at most a tenth; manual never by itself."""
    mode = F.coalesce(F.lower(F.get_json_object("sync_policy_json", "$.mode")), F.lit("interval"))
    interval = F.coalesce(F.get_json_object("sync_policy_json", "$.interval_seconds").cast("double"), F.lit(float(DEFAULT_INTERVAL)))
    jitter = max(-0.1, min(0.1, jitter))
    age = F.lit(now) - F.coalesce("last_synced", F.lit(0))
    cooldown = F.when(F.col("is_local"), LOCAL_COOLDOWN).otherwise(REMOTE_COOLDOWN)
    hit = F.when(mode == "on_focus", F.lit(trigger == "focus") & (age >= cooldown)).when(mode == "interval", F.lit(trigger == "periodic") & (age >= interval * (1 + jitter))).otherwise(False)
    return rows.withColumn("sync", F.when(F.lit(trigger == "manual"), True).otherwise(hit))


def backoff(attempt: Column, base: int = RETRY_BASE, cap: int = RETRY_CAP) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt), F.lit(cap)).cast("long")


def may_retry(tracker: DataFrame, now: int) -> DataFrame:
    """Instances with fewer than three failures whose next retry is due."""
    return tracker.where((F.col("failures") < GIVE_UP) & (F.coalesce("next_retry_at", F.lit(0)) <= now))


class RateLimited(Exception):
    def __init__(self, retry_after: float):
        super().__init__(f"retry after {retry_after} s")
        self.retry_after = retry_after


class Fatal(Exception):
    """Not worth another try: missing, forbidden, or malformed."""


def transient(error: BaseException) -> bool:
    return not isinstance(error, (Fatal, ValueError, KeyError, PermissionError, FileNotFoundError))


def with_retry(call: Callable, retries: int = 3, base: float = 1.0, cap: float = 60.0, sleep: Callable = time.sleep, jitter: Callable = random.random):
    """call() with exponential waits; a rate limit of at most five minutes waits without using up a try."""
    used = 0
    while True:
        try:
            return call()
        except RateLimited as e:
            if e.retry_after > FREE_WAIT:
                raise
            sleep(e.retry_after)
        except Exception as e:
            if not transient(e) or used >= retries:
                raise
            sleep(min(base * 2**used, cap) + jitter())
            used += 1


def reindex_targets(documents: DataFrame, project_id: int, scope: str = "full", ids: list[str] | None = None, created: tuple = (None, None), force: bool = False) -> DataFrame:
    """Documents of a project in scope (full, document, documents, date_range) with `action`: reindex with force, or
    where a document isn't present yet; otherwise skip."""
    rows = documents.where(F.col("project_id") == project_id)
    if scope in ("document", "documents"):
        rows = rows.where(F.col("source_doc_id").isin(ids or []))
    elif scope == "date_range":
        low, high = created
        rows = rows if low is None else rows.where(F.col("created_at") >= low)
        rows = rows if high is None else rows.where(F.col("created_at") <= high)
    elif scope != "full":
        raise ValueError(f"unknown scope {scope!r}")
    return rows.withColumn("action", F.when(F.lit(force) | F.col("last_indexed").isNull(), "reindex").otherwise("skip"))


def reindex(documents: DataFrame, project_id: int, now: int, dry_run: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(documents after the run, its one-row summary): nothing changes in a dry run."""
    targets = reindex_targets(documents, project_id, **options)
    counts = targets.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum((F.col("action") == "reindex").cast("long")), F.lit(0)).alias("processed"))
    summary = counts.select("total", "processed", (F.col("total") - F.col("processed")).alias("skipped"), F.lit(0).cast("long").alias("errors"), F.lit(dry_run).alias("dry_run"))
    if dry_run:
        return documents, summary
    hit = targets.where("action = 'reindex'").select(F.col("id").alias("_d"))
    out = documents.join(hit, F.col("id") == F.col("_d"), "left")
    return out.withColumn("last_indexed", F.when(F.col("_d").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("last_indexed"))).drop("_d"), summary


def stale_copies(documents: DataFrame, current: DataFrame) -> DataFrame:
    """Documents whose current cleaned text has another hash: reindexed when they are read."""
    now = current.select("document_id", X.content_hash(F.col("text")).alias("_now"))
    return documents.join(now, F.col("id") == F.col("document_id")).where("content_hash is null or content_hash <> _now").drop("document_id", "_now")
