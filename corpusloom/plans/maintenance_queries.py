"""Freshness, change detection, co-occurrence, reports, extraction and scheduling queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as X
from ..operators import blocks, catalog, freshness, indexing, reports, schedule, sync
from ..sources.documents import pages
from ..staging import stage_dir
from ..streaming import jobs
from . import base
from .base import AS_OF, query

_CLEAN = "regexp_replace(regexp_replace({0}, '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '[ \\t]+', ' ', 'g')"
_FRESH = f"""fresh AS (SELECT docs.id AS document_id, project_id, CASE WHEN source_type = 'github' THEN 'short' ELSE 'mid' END AS retention_tier,
  least(greatest(100 * exp(-ln(2) / (CASE WHEN source_type = 'github' THEN 45 ELSE 90 END * CASE mode WHEN 'strict' THEN 0.5 WHEN 'relaxed' THEN 1.5 ELSE 1.0 END) * (({AS_OF} - updated_at) / 86400.0)), 0), 100) AS score
  FROM docs JOIN projs ON projs.id = project_id), stat AS (SELECT *, CASE WHEN score >= 70 THEN 'fresh' WHEN score >= 40 THEN 'aging' ELSE 'stale' END AS status FROM fresh)
"""


def _freshness(spark, sf_dir):
    docs, projects = base.documents(spark, sf_dir), base.projects(spark, sf_dir)
    return freshness.recompute(freshness.initial(docs, projects, AS_OF), docs, projects, AS_OF), docs, projects


@query(", " + _FRESH + "SELECT document_id, retention_tier, round(score, 6) AS score, status FROM stat")
def freshness_score(spark, sf_dir):
    """Every document's score and status as of a fixed time."""
    rows, _, _ = _freshness(spark, sf_dir)
    return rows.select("document_id", "retention_tier", F.round("freshness_score", 6).alias("score"), "status")


@query(", " + _FRESH + "SELECT count(*) AS total, count(*) FILTER (status = 'fresh') AS fresh, count(*) FILTER (status = 'aging') AS aging, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'obsolete') AS obsolete, round(avg(score), 6) AS average_score FROM stat")
def freshness_status_report(spark, sf_dir):
    """Counts by status and the mean score."""
    rows, _, _ = _freshness(spark, sf_dir)
    return freshness.report(rows).withColumn("average_score", F.round("average_score", 6))


@query(", " + _FRESH + "SELECT s.document_id, p.name AS project, round(score, 6) AS score, s.status FROM stat s JOIN projs p ON p.id = s.project_id WHERE s.status <> 'fresh' AND p.status = 'active' ORDER BY s.score, document_id LIMIT 20")
def stale_documents(spark, sf_dir):
    """The 20 stalest documents of active projects."""
    rows = freshness.stalest(*_freshness(spark, sf_dir))
    return rows.select("document_id", "project", F.round("freshness_score", 6).alias("score"), "status")


@query(f"SELECT id, sha256({_CLEAN.format('content')}) AS content_hash FROM docs")
def content_hash(spark, sf_dir):
    """SHA-256 of cleaned texts."""
    return base.documents(spark, sf_dir).select("id", X.content_hash(F.col("content")).alias("content_hash"))


def _snapshots(spark, sf_dir):
    """(incoming, indexed): of the indexed ones every seventh is missing, every fifth is older, every third lacks a time
    (and of those every second has another hash), every eleventh is gone from the source."""
    docs = base.documents(spark, sf_dir).select("id", "project_id", "source_doc_id", "file_path", "title", X.content_hash(F.col("content")).alias("content_hash"), "created_at", "updated_at")
    incoming = docs.where("id % 11 <> 0").withColumn("updated_at", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("updated_at")))
    old = docs.where("id % 7 <> 0").withColumn("updated_at", F.when(F.col("id") % 5 == 0, F.col("updated_at") - 60).otherwise(F.col("updated_at")))
    old = old.withColumn("content_hash", F.when(F.col("id") % 6 == 0, "other").otherwise(F.col("content_hash"))).withColumn("last_indexed", F.lit(base.EPOCH).cast("long"))
    return incoming, old


_SNAP = f"""snap AS (SELECT id, project_id, source_doc_id, title, sha256({_CLEAN.format('content')}) AS h, created_at, updated_at FROM docs),
inc AS (SELECT id, project_id, source_doc_id, title, h, created_at, CASE WHEN id % 3 = 0 THEN NULL ELSE updated_at END AS updated_at FROM snap WHERE id % 11 <> 0),
old AS (SELECT id, project_id, source_doc_id, title, CASE WHEN id % 6 = 0 THEN 'other' ELSE h END AS h, created_at, CASE WHEN id % 5 = 0 THEN updated_at - 60 ELSE updated_at END AS updated_at FROM snap WHERE id % 7 <> 0),
chk AS (SELECT inc.*, CASE WHEN old.id IS NULL THEN true WHEN inc.updated_at IS NOT NULL AND old.updated_at IS NOT NULL THEN inc.updated_at <> old.updated_at WHEN inc.h IS NOT NULL AND old.h IS NOT NULL THEN inc.h <> old.h ELSE true END AS needs
  FROM inc LEFT JOIN old USING (project_id, source_doc_id))
"""


@query(", " + _SNAP + "SELECT source_doc_id, needs FROM chk")
def change_detection(spark, sf_dir):
    """Which incoming documents need to be indexed again."""
    return sync.needs_reindexing(*_snapshots(spark, sf_dir)).select("source_doc_id", "needs")


@query(", " + _SNAP + "SELECT source_doc_id, CASE WHEN needs THEN 'indexed' ELSE 'skipped' END AS action FROM chk UNION ALL SELECT source_doc_id, 'deleted' FROM old WHERE source_doc_id NOT IN (SELECT source_doc_id FROM inc) AND project_id IN (SELECT project_id FROM inc)")
def full_index(spark, sf_dir):
    """What a full run does to each document."""
    incoming, old = _snapshots(spark, sf_dir)
    return sync.full_index(incoming, old, AS_OF)[1].select("source_doc_id", "action")


@query(", " + _SNAP + "SELECT coalesce(old.source_doc_id, inc.source_doc_id) AS source_doc_id, coalesce(old.created_at, inc.created_at) AS created_at, coalesce(inc.updated_at, old.updated_at) AS updated_at, CASE WHEN inc.id IS NOT NULL THEN inc.h ELSE old.h END AS content_hash FROM old FULL JOIN inc USING (project_id, source_doc_id)")
def upsert_merge(spark, sf_dir):
    """Documents merged by key, first creation and latest update kept."""
    incoming, old = _snapshots(spark, sf_dir)
    merged = catalog.upsert_documents(old, incoming.withColumn("last_indexed", F.lit(AS_OF).cast("long")))
    return merged.select("source_doc_id", "created_at", "updated_at", "content_hash")


@query(", " + _SNAP + "SELECT source_doc_id FROM old WHERE source_doc_id NOT IN (SELECT source_doc_id FROM inc)")
def deleted_documents(spark, sf_dir):
    """Indexed documents that the source no longer has."""
    incoming, old = _snapshots(spark, sf_dir)
    return sync.deleted_ids(old, incoming)


@query(f"SELECT id AS document_id, CASE WHEN id % 4 = 0 THEN 'use_remote' ELSE 'skip' END AS decision FROM docs")
def conflict_resolution(spark, sf_dir):
    """Skip where the remote text is what we have, else take it."""
    docs = base.documents(spark, sf_dir)
    remote = F.when(F.col("id") % 4 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.concat("content", F.lit("<!-- note -->")))
    pairs = docs.select(F.col("id").alias("document_id"), X.content_hash(F.col("content")).alias("local_hash"), remote.alias("remote"))
    return sync.resolve_conflicts(pairs).select("document_id", "decision")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'reindex' ELSE 'skip' END AS action FROM docs WHERE project_id = 2 AND created_at >= 1700100000")
def reindex_targets(spark, sf_dir):
    """A project's documents created in a range, and what reindexing does to them."""
    docs = base.documents(spark, sf_dir).withColumn("last_indexed", F.when(F.col("id") % 2 == 1, F.lit(AS_OF)))
    return sync.reindex_targets(docs, 2, "date_range", created=(1_700_100_000, None)).select("id", "action")


def _accesses(spark, sf_dir):
    events, n = base.read(spark, sf_dir, "events"), base.read(spark, sf_dir, "documents").count()
    return events.select(F.col("user_id").cast("string").alias("session_id"), F.pmod("event_id", F.lit(n)).alias("document_id"), "ts")


_PAIRS = """, acc AS (SELECT user_id::VARCHAR AS session_id, event_id % (SELECT count(*) FROM documents) AS document_id, ts FROM events),
gap AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM acc),
ses AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM gap),
sets AS (SELECT session_id, n, max(ts) AS seen, list_distinct(list(document_id)) AS d FROM ses GROUP BY 1, 2),
prs AS (SELECT a.document_id AS doc_a_id, b.document_id AS doc_b_id, seen FROM (SELECT session_id, n, seen, unnest(d) AS document_id FROM sets) a JOIN (SELECT session_id, n, unnest(d) AS document_id FROM sets) b USING (session_id, n) WHERE a.document_id < b.document_id),
co AS (SELECT doc_a_id, doc_b_id, count(*) AS co_occurrence_count, floor(epoch(max(seen)))::BIGINT AS last_accessed FROM prs GROUP BY 1, 2)
"""


@query(_PAIRS + "SELECT * FROM co")
def cooccurrence_pairs(spark, sf_dir):
    """Pairs of documents seen in the same session (six hours' gap)."""
    return jobs.session_pairs(_accesses(spark, sf_dir), "6 hours")


@query(_PAIRS + "SELECT * FROM co WHERE co_occurrence_count >= 3 OR last_accessed >= 1706500000 - 30 * 86400 + 20 * 86400")
def cooccurrence_prune(spark, sf_dir):
    """Pairs left after rare and old ones go."""
    return schedule.prune_co_refs(jobs.session_pairs(_accesses(spark, sf_dir), "6 hours"), 1_706_500_000, days=10)


@query("SELECT event_id % (SELECT count(*) FROM documents) AS document_id, count(*) AS count, floor(epoch(max(ts)))::BIGINT AS last_viewed FROM events WHERE event_type = 'view' GROUP BY 1")
def view_counts(spark, sf_dir):
    """Views of each document."""
    return jobs.view_counts(_views(spark, sf_dir))


def _views(spark, sf_dir):
    events = base.read(spark, sf_dir, "events").where("event_type = 'view'")
    return events.select(F.pmod("event_id", F.lit(base.read(spark, sf_dir, "documents").count())).alias("document_id"), "ts")


@query(", vc AS (SELECT event_id % (SELECT count(*) FROM documents) AS document_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) SELECT id, title, coalesce(n, 0) AS views FROM docs LEFT JOIN vc ON vc.document_id = docs.id ORDER BY views DESC, id LIMIT 20")
def top_documents(spark, sf_dir):
    """Most viewed documents."""
    return reports.top_viewed(base.documents(spark, sf_dir), jobs.view_counts(_views(spark, sf_dir)), 20)


@query(""", e AS (SELECT user_id::VARCHAR AS path, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events) SELECT path, ts FROM e WHERE g IS NULL OR g >= 3600000000""")
def debounced_changes(spark, sf_dir):
    """Changes at least an hour after the one before on the same path."""
    events = base.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "ts")
    return jobs.debounced(events, 3600.0)


@query("SELECT tag, count(*) AS documents FROM dtags GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_tags(spark, sf_dir):
    """The ten commonest tags."""
    return reports.top_tags(base.tags(spark, sf_dir))


@query("SELECT document_id, list(DISTINCT tag ORDER BY tag) AS tags FROM dtags GROUP BY 1")
def document_tags(spark, sf_dir):
    """Each document's sorted tags."""
    return reports.document_tags(base.tags(spark, sf_dir))


def _instances(spark, sf_dir):
    return base.projects(spark, sf_dir).select(
        F.col("id"), F.when(F.col("id") % 3 != 0, F.col("source_type")).alias("plugin_id"), F.col("id").alias("project_id"), F.when(F.col("id") % 4 != 0, F.lit(AS_OF) - F.col("id") * 1000).alias("last_synced"), F.lit(360).alias("cache_ttl_minutes")
    )


_INST = f"inst AS (SELECT id, CASE WHEN id % 3 <> 0 THEN source_type END AS plugin_id, id AS project_id, CASE WHEN id % 4 <> 0 THEN {AS_OF} - id * 1000 END AS last_synced FROM projs)"


@query(f", {_INST} SELECT (SELECT count(*) FROM projs) AS projects, (SELECT count(*) FROM projs WHERE status = 'active') AS active_projects, (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs) AS chunks, (SELECT count(DISTINCT plugin_id) FROM inst) AS plugins")
def corpus_status(spark, sf_dir):
    """Counts of everything."""
    docs = base.documents(spark, sf_dir)
    return reports.corpus_status(base.projects(spark, sf_dir), docs, docs.select("id"), _instances(spark, sf_dir))


@query(f", {_INST} SELECT p.id, p.name, p.source_type, count(docs.id) AS documents, max(inst.last_synced) AS last_synced FROM projs p LEFT JOIN docs ON docs.project_id = p.id LEFT JOIN inst ON inst.project_id = p.id WHERE p.status = 'active' GROUP BY 1, 2, 3")
def agent_summary(spark, sf_dir):
    """Active projects with their documents and last sync."""
    return reports.agent_summary(base.projects(spark, sf_dir), _instances(spark, sf_dir), base.documents(spark, sf_dir))


@query(f", {_INST} SELECT coalesce(plugin_id, source_type) AS plugin_id, count(*) AS instances, max(last_synced) AS last_synced FROM inst JOIN projs ON projs.id = project_id GROUP BY 1")
def plugin_instances(spark, sf_dir):
    """Instances of each plugin."""
    return reports.plugin_instances(_instances(spark, sf_dir), base.projects(spark, sf_dir))


@query(f", {_INST} SELECT inst.id, last_synced FROM inst JOIN projs ON projs.id = project_id WHERE status = 'active' AND (last_synced IS NULL OR {AS_OF} - last_synced >= 7200)")
def due_instances(spark, sf_dir):
    """Instances whose interval is over."""
    return sync.due_instances(_instances(spark, sf_dir), base.projects(spark, sf_dir), AS_OF).select("id", "last_synced")


@query(f"SELECT id, title, updated_at AS last_indexed FROM docs WHERE id % 3 <> 0 ORDER BY updated_at DESC, id LIMIT 5")
def recent_documents(spark, sf_dir):
    """The five documents indexed last."""
    docs = base.documents(spark, sf_dir).withColumn("last_indexed", F.when(F.col("id") % 3 != 0, F.col("updated_at")))
    return reports.recent_documents(docs)


@query("SELECT id, source_doc_id, title, created_at, updated_at, CASE WHEN count(*) OVER () = 25 THEN 50 END AS next_cursor FROM (SELECT * FROM docs WHERE project_id = 2 ORDER BY updated_at DESC, id LIMIT 25 OFFSET 25)")
def list_documents_page(spark, sf_dir):
    """A page of a project's documents, and the next cursor."""
    return reports.documents_page(base.documents(spark, sf_dir), 2, "updated_at", False, 25, 25)


@query("SELECT docs.id, p.name AS project, coalesce(nullif(title, ''), source_doc_id) AS title, updated_at FROM docs JOIN projs p ON p.id = project_id WHERE status = 'active' ORDER BY project, coalesce(nullif(title, ''), source_doc_id), docs.id LIMIT 100")
def list_all_documents(spark, sf_dir):
    """The first hundred documents by project and title."""
    return reports.all_documents(base.documents(spark, sf_dir), base.projects(spark, sf_dir))


@query("SELECT request, project_id, CASE request WHEN '5' THEN 5 WHEN 'doc-8' THEN 8 ELSE 0 END::BIGINT AS document_id FROM (SELECT '5' AS request, NULL::BIGINT AS project_id UNION ALL SELECT 'doc-8', (SELECT project_id FROM docs WHERE id = 8) UNION ALL SELECT 'nowhere', 1)")
def resolve_document_id(spark, sf_dir):
    """Documents by number, by source id, and a virtual one."""
    docs = base.documents(spark, sf_dir)
    named = docs.where("id = 8").select(F.lit("doc-8").alias("request"), "project_id")
    fixed = spark.createDataFrame([("5", None), ("nowhere", 1)], "request string, project_id long")
    return reports.resolve_document_id(fixed.unionByName(named), docs)


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*(?:>|\\z)', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, sf_dir):
    """Pages without tags."""
    return base.read(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def title_from_html(spark, sf_dir):
    """Pages' titles."""
    return pages(base.read(spark, sf_dir, "pages")).select(F.col("source_doc_id").cast("long").alias("page_id"), "title")


@query("SELECT id, '- ' || source_doc_id || chr(10) || '  - ' || lang AS toc FROM docs")
def toc(spark, sf_dir):
    """Headings of documents that a template wraps around each text."""
    docs = base.documents(spark, sf_dir)
    text = F.concat(F.lit("# "), "source_doc_id", F.lit("\n"), F.regexp_replace("content", r"(?m)^\s*#+", ""), F.lit("\n## "), "lang", F.lit("\n"))
    return docs.select("id", X.toc(text).alias("toc"))




_SENTENCES = "string_split(regexp_replace({0}, '([.?!])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@query(f""", plain AS (SELECT id, list_filter(list_transform({_SENTENCES.format("regexp_replace(content, '<[^>]+>', '', 'g')")}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS s FROM docs),
three AS (SELECT id, array_to_string(s[1:3], ' ') AS t FROM plain)
SELECT id, trim(CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END) AS summary FROM three""")
def summary_lead3(spark, sf_dir):
    """Three-sentence summaries of all documents."""
    return base.documents(spark, sf_dir).select("id", M.summary_column(F.col("content")).alias("summary"))


_CHUNKS = f""", body AS (SELECT id, regexp_replace(regexp_replace(content, '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '[ \\t]+', ' ', 'g') AS t FROM docs),
span AS (SELECT id, t, length(t) - length(ltrim(t, ' ' || chr(10))) AS a, length(rtrim(t, ' ' || chr(10))) AS b FROM body),
parts AS (SELECT id, {_SENTENCES.format("substr(t, a + 1, b - a)")} AS s, a FROM span WHERE b - a > 1000),
sent AS (SELECT id, k, a + coalesce(list_sum(list_transform(s[1:k - 1], lambda x: length(x))), 0)::BIGINT AS sa, a + list_sum(list_transform(s[1:k], lambda x: length(x)))::BIGINT AS sb FROM (SELECT id, s, a, unnest(range(1, len(s) + 1)) AS k FROM parts)),
walk(id, k, oa, ob, ea, eb) AS (SELECT id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM parts UNION ALL
  SELECT w.id, w.k + 1, CASE WHEN sb - sa > 1000 THEN NULL WHEN oa IS NULL THEN sa WHEN sb - oa > 1000 THEN greatest(oa, ob - 200) ELSE oa END, CASE WHEN sb - sa > 1000 THEN NULL ELSE sb END,
    CASE WHEN sb - sa > 1000 OR sb - oa > 1000 THEN oa END, CASE WHEN sb - sa > 1000 OR sb - oa > 1000 THEN ob END
  FROM walk w JOIN sent ON sent.id = w.id AND sent.k = w.k + 1),
wide(id, k, pos, take, sb) AS (SELECT id, k, sa, least(1000, sb - sa), sb FROM sent WHERE sb - sa > 1000 UNION ALL
  SELECT id, k, pos + take - least(200, take // 2), least(1000, sb - (pos + take - least(200, take // 2))), sb FROM wide WHERE pos + take - least(200, take // 2) < sb),
cuts AS (SELECT id, k, 0 AS o, ea AS a, eb AS b FROM walk WHERE ea IS NOT NULL UNION ALL SELECT id, k, 1, pos, pos + take FROM wide
  UNION ALL SELECT w.id, w.k + 1, 0, oa, ob FROM walk w JOIN (SELECT id, max(k) AS k FROM walk GROUP BY 1) m USING (id, k) WHERE oa IS NOT NULL
  UNION ALL SELECT id, 1, 0, a, b FROM span WHERE b - a <= 1000 AND b > a)
"""


@query(_CHUNKS + "SELECT id AS document_id, (row_number() OVER (PARTITION BY id ORDER BY k, o, cuts.a) - 1)::INTEGER AS chunk_index, md5(trim(substr(t, cuts.a + 1, cuts.b - cuts.a), ' ' || chr(10))) AS content_md5, strlen(substr(t, 1, cuts.a))::BIGINT AS start_byte, strlen(substr(t, 1, cuts.b))::BIGINT AS end_byte FROM cuts JOIN span USING (id)")
def chunk_documents(spark, sf_dir):
    """Chunks of all documents: whole sentences with an overlap, longer sentences in windows, byte offsets."""
    docs = base.documents(spark, sf_dir).select(F.col("id").alias("document_id"), "title", F.col("content").alias("text"))
    return catalog.index_chunks(docs).select("document_id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("content_md5"), "start_byte", "end_byte")


@query("SELECT id AS document_id, content FROM docs")
def rebuild_content(spark, sf_dir):
    """Texts put together again from their lines."""
    docs = base.documents(spark, sf_dir)
    lines = docs.select(F.col("id").alias("document_id"), F.posexplode(F.split("content", "\n")).alias("chunk_index", "content"))
    return catalog.rebuild_content(lines)


@query("SELECT o_orderkey, epoch(CASE WHEN o_orderkey % 2 = 0 THEN (date_trunc('day', o_orderdate) + INTERVAL 27 HOUR) ELSE date_trunc('day', o_orderdate) + INTERVAL (((7 + 1 - dayofweek(o_orderdate)) % 7) * 24 + CASE WHEN dayofweek(o_orderdate) = 1 THEN 168 + 6 ELSE 6 END) HOUR END)::BIGINT AS next_run FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 9 HOUR AS o_orderdate FROM orders)")
def next_run(spark, sf_dir):
    """Next daily or weekly run after each order's day at nine."""
    orders = base.read(spark, sf_dir, "orders")
    plan = F.when(F.col("o_orderkey") % 2 == 0, '{"type":"daily","hour":3,"minute":0}').otherwise('{"type":"weekly","weekday":1,"hour":6,"minute":0}')
    after = F.unix_timestamp(F.date_trunc("day", "o_orderdate")) + 9 * 3600
    return orders.select("o_orderkey", schedule.next_run(plan, after).alias("next_run"))


@query("SELECT id, CASE WHEN project_id % 2 = 0 THEN NULL ELSE content END AS content FROM docs")
def storage_strategy(spark, sf_dir):
    """Chunk content dropped for projects that store by reference."""
    docs = base.documents(spark, sf_dir)
    chunks = docs.select(F.col("id").alias("document_id"), "content")
    how = docs.select(F.col("id").alias("document_id"), F.when(F.col("project_id") % 2 == 0, "reference").otherwise("full").alias("storage_strategy"))
    return catalog.stored_content(chunks, how).select(F.col("document_id").alias("id"), "content")


@query("""SELECT a.source_doc_id, 'doc-' || a.k AS target_raw, b.source_doc_id AS target,
  CASE WHEN b.id IS NULL THEN 'unresolved' WHEN b.project_id = a.project_id THEN 'project' ELSE 'global' END AS resolution,
  CASE WHEN a.id % 7 = 0 OR a.id % 5 = 0 THEN 20 ELSE 10 END AS last_indexed
FROM (SELECT *, (id * 7 + 1) % (SELECT count(*) FROM docs) AS k FROM docs WHERE id % 11 <> 0) a LEFT JOIN docs b ON b.id = a.k AND b.id % 11 <> 0""")
def index_run(spark, sf_dir):
    """Links and times of all documents after two runs of an index: the second finds new, changed and deleted ones, and
    settles links of documents that it doesn't touch. Every seventh is new then, every fifth changed, every eleventh gone."""
    docs = base.documents(spark, sf_dir)
    link = (F.col("id") * 7 + 1) % docs.count()
    docs = docs.withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit(" [[doc-"), link.cast("string"), F.lit("]]")))
    early = docs.where("id % 7 <> 0").withColumn("updated_at", F.when(F.col("id") % 5 == 0, F.col("updated_at") - 60).otherwise(F.col("updated_at")))
    late, gone = docs.where("id % 11 <> 0"), docs.where("id % 11 = 0")
    path = f"{stage_dir(spark)}/run-{uuid.uuid4().hex}"
    store, index = catalog.Catalog(spark, f"{path}/catalog"), blocks.BlockIndex.open(spark, f"{path}/index", pairs=False)
    index, _ = indexing.run(store, index, early, 10, buckets=32)
    indexing.run(store, index, late, 20, deleted=gone.select("project_id", "source_doc_id"), buckets=32)
    held = store.load("documents").select("id", "source_doc_id", "last_indexed")
    links = store.load("document_links").select(F.col("source_id").alias("id"), "target_raw", "target_id", "resolution")
    to = held.select(F.col("id").alias("target_id"), F.col("source_doc_id").alias("target"))
    return held.join(links, "id").join(to, "target_id", "left").select("source_doc_id", "target_raw", "target", "resolution", F.col("last_indexed").cast("int").alias("last_indexed"))
