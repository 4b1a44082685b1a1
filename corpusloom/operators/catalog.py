"""The logical catalog: schemas, validation, and keyed snapshots with upsert and replace semantics."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..staging import stage, unstage

#: Allowed values of enumerated columns.
ENUMS = {
    ("projects", "status"): ("active", "disabled"),
    ("projects", "storage_strategy"): ("full", "reference"),
    ("document_freshness", "status"): ("fresh", "aging", "stale", "obsolete"),
    ("document_freshness", "retention_tier"): ("short", "mid", "long"),
    ("document_freshness", "tier_source"): ("auto", "user"),
    ("scheduled_jobs", "executor"): ("builtin", "plugin"),
}

#: The tables' columns.
SCHEMAS = {
    "projects": "id long, name string, display_name string, description string, path string, status string, created_at long, updated_at long, source_type string, config_json string, is_default boolean, storage_strategy string, source_project_id string, sync_policy_json string, freshness_policy_json string, last_fetched_at long",
    "documents": "id long, project_id long, source_doc_id string, file_path string, title string, content_hash string, plugin_id string, last_indexed long, created_at long, updated_at long, metadata_json string, url string, summary string",
    "chunks": "id long, document_id long, heading_path string, content string, chunk_index int, start_byte long, end_byte long",
    "chunk_embeddings": "chunk_id long, embedding array<tinyint>",
    "document_tags": "document_id long, tag string",
    "document_aliases": "document_id long, alias string",
    "document_metadata": "document_id long, key string, value string",
    "document_links": "source_id long, target_id long, target_raw string, link_type string, resolution string",
    "document_freshness": "document_id long, freshness_score double, status string, retention_tier string, tier_source string, change_count long, first_seen_at long, last_content_change long, score_updated_at long",
    "document_change_log": "document_id long, old_hash string, new_hash string, changed_at long",
    "document_feedbacks": "document_id long, agent_id string, score double, session_id string, created_at long",
    "document_co_refs": "doc_a_id long, doc_b_id long, co_occurrence_count long, last_accessed long",
    "view_counts": "document_id long, count long, last_viewed long",
    "content_cache": "plugin_id string, doc_id string, content string, cached_at long, expires_at long, etag string, last_modified string",
    "source_instances": "id long, plugin_id string, project_id long, name string, config_json string, sync_status string, last_synced long, sync_cursor string, created_at long, cache_ttl_minutes int",
    "plugins": "id string, name string, version string, enabled boolean, trust_level string, installed_at long",
    "plugin_logs": "plugin_id string, level string, message string, created_at long",
    "session_documents": "session_id string, started long, document_id long, at long, last long",
    "plugin_kv": "plugin_id string, namespace string, key string, value binary, updated_at long",
    "system_config": "key string, value string, updated_at long",
    "audit_log": "id long, event string, project_id long, payload string, created_at long",
    "scheduled_jobs": "id long, name string, schedule_json string, executor string, enabled boolean, immutable boolean, idle_minutes int, next_run long, last_run long",
    "job_runs": "job_id long, started_at long, finished_at long, status string, message string",
    "reindex_history": "id long, project_id long, scope string, total long, processed long, skipped long, errors long, started_at long, finished_at long, status string",
}

#: Kinds of audit events and the fields of each.
EVENTS = {
    "index_start": ("project_id",),
    "index_complete": ("project_id", "docs_indexed"),
    "plugin_error": ("plugin_id", "message"),
    "sync_start": ("source_instance_id",),
    "sync_complete": ("source_instance_id", "docs_synced"),
    "document_fetch_error": ("project", "doc_id", "message"),
    "system_error": ("module", "message"),
}

#: Column and key of a bucketed table's layout.
BUCKETED = "_bucket"


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


class Catalog:
    """Tables as Parquet snapshots under a folder. A save writes the next snapshot, then one act makes it
    the current one: a marker file of its number, which holds a note that is thus saved with the rows or not at all.

    Readers keep the snapshot that they opened; nothing overwrites files that are read. A save that dies leaves a
    snapshot without a marker, which no reader sees and the next save steps over.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, name: str) -> tuple[list[int], list[int]]:
        """Numbers of snapshots that are complete, and of all."""
        fs, p = self._fs(f"{self.path}/{name}")
        names = [str(f.getPath().getName()) for f in fs.listStatus(p)] if fs.exists(p) else []
        numbers = lambda end: sorted(int(n[1 : len(n) - len(end)]) for n in names if n[:1] == "v" and n.endswith(end) and n[1 : len(n) - len(end)].isdigit())
        return numbers(".done"), numbers("")

    def exists(self, name: str) -> bool:
        return self.version(name) > 0

    def version(self, name: str) -> int:
        return max(self._numbers(name)[0], default=0)

    def _marker(self, name: str, n: int) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/{name}/v{n}.done").first()[0]) if n else {}

    def note(self, name: str) -> dict:
        """What was noted with the current snapshot."""
        return {k: v for k, v in self._marker(name, self.version(name)).items() if k != BUCKETED}

    def load(self, name: str) -> DataFrame:
        n = self.version(name)
        if not n:
            return empty(self.spark, name)
        layout = self._marker(name, n).get(BUCKETED)
        return self._buckets(name, layout, layout["at"]) if layout else self.spark.read.parquet(f"{self.path}/{name}/v{n}")

    def _buckets(self, name: str, layout: dict, buckets) -> DataFrame:
        """Rows of some buckets, from the snapshots that wrote them."""
        schema = T.StructType.fromJson(layout["schema"])
        paths = [f"{self.path}/{name}/v{layout['at'][b]}/{BUCKETED}={b}" for b in buckets if b in layout["at"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _begin(self, name: str) -> int:
        return max(self._numbers(name)[1], default=0) + 1

    def _finish(self, name: str, n: int, marker: dict) -> None:
        """Makes snapshot n the current one."""
        fs, draft = self._fs(f"{self.path}/{name}/v{n}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()
        if not fs.rename(draft, self._fs(f"{self.path}/{name}/v{n}.done")[1]):
            raise OSError(f"snapshot {n} of {name} could not be made the current one")

    def save(self, name: str, df: DataFrame, partition_by: list[str] | None = None, note: dict | None = None) -> None:
        """df as the next snapshot; note (kept from the current one where it is None) goes with it."""
        note = self.note(name) if note is None else note
        n = self._begin(name)
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{name}/v{n}")
        self._finish(name, n, note)

    def merge(self, name: str, rows: DataFrame, keys: list[str], combine, buckets: int = 256, note: dict | None = None) -> list[int]:
        """combine(old, rows) becomes the table's rows, and only the buckets that rows fall into are read and written.

        A table is dealt into `buckets` by the hash of its keys (its first merge settles both, and deals what was there
        before); a snapshot is a list of which earlier snapshot holds each bucket, so the others stay as they are.
        combine gets the touched buckets' old rows and the new rows, must work key by key (an upsert, a sum, a
        replacement of a document's children), and may drop rows: an empty bucket goes. Returns the numbers of the
        buckets that were written. One marker makes it current, as with save, together with note.
        """
        marker, n = self._marker(name, self.version(name)), self._begin(name)
        layout = marker.get(BUCKETED)
        rows = stage(rows, f"merge-{name}")
        if layout is not None and layout["keys"] != keys:
            raise ValueError(f"{name} is dealt by {layout['keys']}")
        known = layout or {"keys": keys, "n": buckets, "at": {}}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(known["n"])).cast("int")
        if layout is None:
            touched, old = None, self.load(name) if self.exists(name) or name in SCHEMAS else self.spark.createDataFrame([], rows.schema)
        else:
            touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # as many as buckets, at most
            old = self._buckets(name, layout, sorted(map(str, touched)))
        layout = known
        out = combine(old, rows)
        layout["schema"] = json.loads(out.schema.json())
        width = layout["n"] if touched is None else max(1, len(touched))
        dealt = out.withColumn(BUCKETED, bucket).repartition(min(width, layout["n"]), BUCKETED)
        dealt.write.mode("errorifexists").option("compression", "zstd").partitionBy(BUCKETED).parquet(f"{self.path}/{name}/v{n}")
        fs, p = self._fs(f"{self.path}/{name}/v{n}")
        wrote = [str(f.getPath().getName()).partition("=")[2] for f in fs.listStatus(p) if str(f.getPath().getName()).startswith(f"{BUCKETED}=")]
        kept = {} if touched is None else {b: v for b, v in layout["at"].items() if int(b) not in touched}
        layout["at"] = kept | dict.fromkeys(wrote, n)
        note = {k: v for k, v in marker.items() if k != BUCKETED} if note is None else note
        self._finish(name, n, note | {BUCKETED: layout})
        unstage(rows)
        return sorted(map(int, wrote))

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Delete all but the latest `keep` snapshots; readers of older ones must be done."""
        done, every = self._numbers(name)
        kept = set(done[-keep:])
        read = {v for n in kept for v in self._marker(name, n).get(BUCKETED, {}).get("at", {}).values()}  # buckets that later snapshots left as they were
        for n in every:
            if n not in kept and n < max(done, default=0):
                for path in (f"v{n}.done",) if n in read else (f"v{n}.done", f"v{n}"):
                    fs, p = self._fs(f"{self.path}/{name}/{path}")
                    fs.delete(p, True)


def violations(name: str, df: DataFrame) -> DataFrame:
    """Rows of a table whose enumerated column has a value that isn't allowed: table, column, value, rows."""
    checks = [
        df.where(~F.col(c).isin(*allowed)).groupBy(F.lit(name).alias("table"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
        for (table, c), allowed in ENUMS.items()
        if table == name and c in df.columns
    ]
    out = df.sparkSession.createDataFrame([], "table string, column string, value string, rows long")
    for check in checks:
        out = out.unionByName(check)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: tuple = (), keep_new: tuple = ()) -> DataFrame:
    """Full-outer merge on keys: columns in keep_old prefer the old value, in keep_new the new one, falling back to the
    other; the rest are overwritten where the key is new data."""
    a, b = old.alias("o"), new.withColumn("_hit", F.lit(True)).alias("n")
    on = None
    for k in keys:
        same = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = same if on is None else on & same

    def value(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in keys or c in keep_new:
            return F.coalesce(n, o)
        if c in keep_old:
            return F.coalesce(o, n)
        return F.when(F.col("n._hit"), n).otherwise(o)

    return a.join(b, on, "full").select(*(value(c).alias(c) for c in old.columns))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by (project_id, source_doc_id): the first creation time, the latest known update time and path."""
    return upsert(old, new, ["project_id", "source_doc_id"], keep_old=("created_at", "id"), keep_new=("updated_at", "file_path"))


def replace_children(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "document_id", unique: list[str] | None = None) -> DataFrame:
    """Child rows of changed documents replaced, others kept; duplicates by `unique` dropped."""
    kept = old.join(changed.select(F.col(changed.columns[0]).alias("_changed")), F.col(key) == F.col("_changed"), "left_anti")
    out = kept.unionByName(new)
    return out.dropDuplicates(unique) if unique else out


def first_alias(aliases: DataFrame) -> DataFrame:
    """One document an alias, globally: the smallest document id wins."""
    return aliases.groupBy("alias").agg(F.min("document_id").alias("document_id")).select("document_id", "alias")


def stored_content(chunks: DataFrame, strategies: DataFrame) -> DataFrame:
    """Chunk content dropped for documents of projects that store by reference; the index keeps its postings."""
    joined = chunks.join(strategies, "document_id", "left")
    return joined.withColumn("content", F.when(F.coalesce("storage_strategy", F.lit("full")) == "reference", F.lit(None).cast("string")).otherwise(F.col("content"))).drop("storage_strategy")


def rebuild_content(chunks: DataFrame) -> DataFrame:
    """document_id and content put together from its chunks in order; a null chunk is an empty line."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("content", F.lit("")).alias("content"))))
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content"))


def full_content(documents: DataFrame, local: DataFrame, cache: DataFrame, chunks: DataFrame, now: int, fetched: DataFrame | None = None) -> DataFrame:
    """document_id, content, origin: local text first, then an unexpired cache entry, then what a source gave (fetched:
    document_id, content), then the chunks."""
    live = cache.where(F.col("expires_at") > now).select(F.col("doc_id").alias("source_doc_id"), F.col("content").alias("cached"))
    built = rebuild_content(chunks).withColumnRenamed("content", "built")
    joined = documents.select(F.col("id").alias("document_id"), "source_doc_id").join(local.select("document_id", F.col("content").alias("local")), "document_id", "left")
    joined = joined.join(live, "source_doc_id", "left").join(built, "document_id", "left")
    if fetched is None:
        joined = joined.withColumn("given", F.lit(None).cast("string"))
    else:
        joined = joined.join(fetched.select("document_id", F.col("content").alias("given")), "document_id", "left")
    steps = {"local": "local", "cached": "cache", "given": "source", "built": "chunks"}
    origin = F.coalesce(*(F.when(F.col(c).isNotNull(), name) for c, name in steps.items()), F.lit("not_found"))
    return joined.select("document_id", F.coalesce(*steps).alias("content"), origin.alias("origin"))


def fetched_content(documents: DataFrame, local: DataFrame, cache: DataFrame, chunks: DataFrame, now: int, fetch: Callable[[DataFrame], DataFrame], ttl_minutes: int = 360) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(full_content, the cache after it, errors) where sources are asked for what neither the local text nor the cache has.

    fetch takes the documents (id, plugin_id, source_doc_id) that are asked for and gives id, content and error, as
    `connector.fetch_documents` does for one source; it runs once. What it gives is cached for ttl_minutes. A document
    that a source fails for falls back on its chunks, and its error (document_id, error) is told.
    """
    # a cache entry is its plugin's: two sources may name different documents alike
    own = documents.select("plugin_id", "source_doc_id", F.col("id").alias("document_id"))
    held = cache.withColumn("_key", F.struct("plugin_id", "doc_id"))
    live = held.where(F.col("expires_at") > now).select("_key", "content", "expires_at")
    live = own.withColumn("_key", F.struct("plugin_id", F.col("source_doc_id").alias("doc_id"))).join(live, "_key").select("document_id", "content", "expires_at")
    have = local.where("content is not null").select("document_id").unionByName(live.where("content is not null").select("document_id"))
    asked = own.join(have.distinct(), "document_id", "left_anti").withColumnRenamed("document_id", "id")
    got = stage(fetch(asked).select(F.col("id").alias("document_id"), "content", "error"), "fetched")
    given = got.where("error is null and content is not null")
    entries = given.join(own, "document_id").select("plugin_id", F.col("source_doc_id").alias("doc_id"), "content").dropDuplicates(["plugin_id", "doc_id"])
    by_id = live.select(F.col("document_id").cast("string").alias("doc_id"), "content", "expires_at")
    found = full_content(documents.withColumn("source_doc_id", F.col("id").cast("string")), local, by_id, chunks, now, given)
    return found, cache_set(cache, entries, now, ttl_minutes), got.where("error is not null").select("document_id", "error")


MIN_TTL_MINUTES, DEFAULT_TTL_MINUTES = 10, 360


def cache_set(cache: DataFrame, entries: DataFrame, now: int, ttl_minutes: int = DEFAULT_TTL_MINUTES) -> DataFrame:
    expires = now + 60 * max(ttl_minutes, MIN_TTL_MINUTES)
    fresh = entries.withColumn("cached_at", F.lit(now).cast("long")).withColumn("expires_at", F.lit(expires).cast("long"))
    for c in cache.columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(cache.schema[c].dataType))
    return upsert(cache, fresh, ["plugin_id", "doc_id"])


def cache_get(cache: DataFrame, now: int) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def cache_touch(cache: DataFrame, now: int, ttl_minutes: int = DEFAULT_TTL_MINUTES) -> DataFrame:
    """Live rows get a new expiry; expired ones stay expired."""
    expires = now + 60 * max(ttl_minutes, MIN_TTL_MINUTES)
    return cache.withColumn("expires_at", F.when(F.col("expires_at") > now, F.lit(expires).cast("long")).otherwise(F.col("expires_at")))


def cache_invalidate(cache: DataFrame, plugin_id: str, doc_id: str | None = None) -> DataFrame:
    hit = F.col("plugin_id") == plugin_id
    return cache.where(~(hit & (F.col("doc_id") == doc_id) if doc_id else hit))


def cache_cleanup(cache: DataFrame, now: int) -> DataFrame:
    return cache_get(cache, now)


def install_missing(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """table and those of the rows whose key no row of it has: default jobs, migrated rows."""
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti").select(*table.columns))


def put(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key-value upsert: plugin_kv by (plugin_id, namespace, key), system_config by key."""
    return upsert(table, rows, keys)


def declared(rows: DataFrame, namespaces: DataFrame) -> DataFrame:
    """rows (plugin_id, namespace, ...) with `error`: null where the plugin has declared the namespace in namespaces
    (plugin_id, namespace), else why it is refused. Names are told apart exactly; the empty one has to be declared, too."""
    known = namespaces.select(F.col("plugin_id").alias("_plugin"), F.col("namespace").alias("_name"), F.lit(True).alias("_ok")).distinct()
    joined = rows.join(known, (F.col("plugin_id") == F.col("_plugin")) & (F.col("namespace") == F.col("_name")), "left")
    error = F.when(F.col("_ok").isNull(), F.concat(F.lit("namespace not allowed: "), F.coalesce("namespace", F.lit("null"))))
    return joined.withColumn("error", error).drop("_plugin", "_name", "_ok")


def put_values(table: DataFrame, rows: DataFrame, namespaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plugin_kv after rows of it are set, the rows refused, with `error`). Of several rows of a key the one with the
    latest updated_at is set (the largest value where these are equal); rows without a key or a value are refused."""
    checked = declared(rows, namespaces)
    lacks = F.when(F.col("key").isNull(), "no key").when(F.col("value").isNull(), "no value")
    checked = checked.withColumn("error", F.coalesce("error", lacks))
    keys = ["plugin_id", "namespace", "key"]
    last = checked.where("error is null").groupBy(*keys).agg(F.max(F.struct("updated_at", "value")).alias("_v")).select(*keys, "_v.value", "_v.updated_at")
    return put(table, last, keys), checked.where("error is not null")


def get_values(table: DataFrame, asked: DataFrame, namespaces: DataFrame) -> DataFrame:
    """asked (plugin_id, namespace, key) with value and error: a refused namespace has an error and no value; a key that
    isn't there has neither."""
    rows = declared(asked, namespaces)
    held = table.select(F.col("plugin_id").alias("_p"), F.col("namespace").alias("_n"), F.col("key").alias("_k"), "value")
    same = F.col("error").isNull() & (F.col("plugin_id") == F.col("_p")) & (F.col("namespace") == F.col("_n")) & (F.col("key") == F.col("_k"))
    return rows.join(held, same, "left").select(*asked.columns, "value", "error")


def event_rows(rows: DataFrame, kind: str, kinds: dict[str, tuple] = EVENTS, keep: tuple = ()) -> DataFrame:
    """event, project_id and payload of one kind of audit event for each of rows, which have the kind's fields. The payload
    is the kind with its fields (nulls included) as JSON; project_id is null where the kind has none. Columns in keep, such
    as one to order by, stay. An unknown kind, or a field that rows don't have, is a ValueError before anything runs."""
    if kind not in kinds:
        raise ValueError(f"no kind of audit event: {kind}")
    if lacking := [f for f in kinds[kind] if f not in rows.columns]:
        raise ValueError(f"{kind} needs {', '.join(lacking)}")
    payload = F.to_json(F.struct(F.struct(*kinds[kind]).alias(kind)), {"ignoreNullFields": "false"})
    project = F.col("project_id") if "project_id" in kinds[kind] else F.lit(None)
    return rows.select(F.lit(kind).alias("event"), project.cast("long").alias("project_id"), payload.alias("payload"), *keep)


def audit_rows(log: DataFrame, events: DataFrame, now: int, order: str | None = None) -> DataFrame:
    """Rows of the audit log for events (event, project_id, and a payload, or any columns that become one as JSON),
    numbered on from the log without gaps, in the order of one of the events' columns (a hash of their content where none
    is named)."""
    names = [c for c in events.columns if c not in ("event", "project_id")]
    start = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # dealt by ranges of the order: counts of ranges are summed up, rows are ranked inside one
    place = F.xxhash64(F.to_json(F.struct(*events.columns))) if order is None else F.col(order)
    payload = F.col("payload") if "payload" in names else F.to_json(F.struct(*names))
    rows = events.select("event", "project_id", payload.alias("payload"), place.alias("_place")).repartitionByRange("_place")
    rows = stage(rows.withColumn("_cell", F.spark_partition_id()), "audit")
    cells = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select(F.col("_cell").alias("_at"), (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("_place", "event", "project_id", "payload"))
    rows = rows.withColumn("_inside", inside).join(cells, F.col("_cell") == F.col("_at"))
    return rows.select((F.lit(start) + F.col("_before") + F.col("_inside")).alias("id"), "event", "project_id", "payload", F.lit(now).cast("long").alias("created_at"))


def audit(log: DataFrame, events: DataFrame, now: int, order: str | None = None) -> DataFrame:
    """The log with events appended, as `audit_rows` numbers them."""
    return log.unionByName(audit_rows(log, events, now, order))


def record_events(store: Catalog, events: DataFrame, now: int, order: str | None = None) -> bool:
    """Append events to the catalog's audit log. Where that fails it warns and returns False: what is watched goes on.

    The log is dealt by time, so an append rewrites the bucket of its own time and no other.
    """
    try:
        rows = audit_rows(store.load("audit_log"), events, now, order)
        store.merge("audit_log", rows, ["created_at"], lambda old, new: old.unionByName(new))
    except Exception as error:  # a log that can't be written must not stop the run that it tells of
        warnings.warn(f"audit log not written: {error}", stacklevel=2)
        return False
    return True


def clear_audit(log: DataFrame, before: int | None = None, kinds: tuple = ()) -> DataFrame:
    """The log without events before a time, of some kinds; without either it is emptied."""
    goes = F.lit(True)
    if before is not None:
        goes = goes & (F.col("created_at") < before)
    if kinds:
        goes = goes & F.col("event").isin(*kinds)
    return log.where(~F.coalesce(goes, F.lit(False)))


def reset_schedule(instances: DataFrame) -> DataFrame:
    """Every instance due at once."""
    return instances.withColumn("last_synced", F.lit(0).cast("long"))


def index_chunks(documents: DataFrame, limit: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of documents (document_id, title, text): cleaned, split, numbered; id = document_id * 2^20 + index."""
    from ..functions.markdown import chunk_column

    made = documents.select("document_id", "title", F.explode(chunk_column(X.clean_markdown(F.col("text")), limit, overlap)).alias("c"))
    return made.select(
        (F.col("document_id") * (1 << 20) + F.col("c.chunk_index")).alias("id"), "document_id", "title", "c.heading_path", "c.content", "c.chunk_index", "c.start_byte", "c.end_byte"
    )


def integrity(chunks: DataFrame, embeddings: DataFrame, postings: DataFrame) -> DataFrame:
    """Counts of chunks, embeddings and indexed chunks, and of those without a chunk."""
    ids = chunks.select(F.col("id").alias("chunk_id"))
    indexed = postings.select("chunk_id").distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [
        count(ids, "chunks"), count(embeddings, "embeddings"), count(indexed, "indexed_chunks"),
        count(embeddings.join(ids, "chunk_id", "left_anti"), "orphan_embeddings"), count(indexed.join(ids, "chunk_id", "left_anti"), "orphan_postings"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
