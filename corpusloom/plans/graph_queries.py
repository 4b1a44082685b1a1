"""Link graph and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph
from . import base
from .base import query


def _docs(spark, sf_dir):
    return base.documents(spark, sf_dir).select("id", "source_doc_id", "title", "project_id", "file_path")


@query("SELECT DISTINCT docs.id, source_doc_id, title FROM links JOIN docs ON docs.id = target_id WHERE source_id = 11")
def outgoing_links(spark, sf_dir):
    """Documents that one links to."""
    return graph.outgoing(base.edges(spark, sf_dir), _docs(spark, sf_dir), 11)


@query("SELECT DISTINCT docs.id, source_doc_id, title FROM links JOIN docs ON docs.id = source_id WHERE target_id = 11")
def backlinks(spark, sf_dir):
    """Documents that link to one."""
    return graph.backlinks(base.edges(spark, sf_dir), _docs(spark, sf_dir), 11)


@query("SELECT DISTINCT * FROM (SELECT source_id AS document_id, target_id AS neighbour_id FROM links UNION ALL SELECT target_id, source_id FROM links)")
def neighbours(spark, sf_dir):
    """All documents' neighbours in either direction."""
    return graph.neighbours(base.edges(spark, sf_dir))


@query(""", walk(id, path, hops) AS (
  SELECT 1::BIGINT, [1::BIGINT], 0 UNION ALL
  SELECT target_id, list_append(path, target_id), hops + 1 FROM walk JOIN (SELECT DISTINCT * FROM links) l ON l.source_id = walk.id WHERE hops < 6 AND NOT list_contains(path, target_id)
) SELECT path, hops FROM walk WHERE id = 183 ORDER BY hops, path LIMIT 1""")
def shortest_path(spark, sf_dir):
    """A directed shortest path within six hops."""
    return graph.shortest_path(base.edges(spark, sf_dir), 1, 183)


@query(""", walk(source, id, hops) AS (
  SELECT id, id, 0 FROM docs WHERE project_id = 1 UNION
  SELECT source, target_id, hops + 1 FROM walk JOIN links ON source_id = walk.id WHERE hops < 3
) SELECT source, id, min(hops) AS hops FROM walk GROUP BY 1, 2""")
def distances_batch(spark, sf_dir):
    """Distances to three hops from every document of a project, in one job."""
    return graph.distances(base.edges(spark, sf_dir), _docs(spark, sf_dir).where("project_id = 1").select("id"), 3)


@query(""", walk(source, id, hops) AS (
  SELECT id, id, 0 FROM docs WHERE id % 50 = 0 UNION
  SELECT source, target_id, hops + 1 FROM walk JOIN links ON source_id = walk.id WHERE hops < 3
) SELECT source, id, min(hops) AS hops FROM walk GROUP BY 1, 2""")
def distances_fiftieth(spark, sf_dir):
    """Distances to three hops from every fiftieth document, in one job."""
    return graph.distances(base.edges(spark, sf_dir), _docs(spark, sf_dir).where("id % 50 = 0").select("id"), 3)


@query(""", walk(id, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT target_id, depth + 1 FROM walk JOIN links ON source_id = walk.id WHERE depth < 3) SELECT id, depth FROM walk""")
def cluster_directed(spark, sf_dir):
    """Documents within three directed steps, by level."""
    return graph.cluster(base.edges(spark, sf_dir), 5, 3)


@query(""", undirected AS (SELECT source_id AS a, target_id AS b FROM links UNION SELECT target_id, source_id FROM links),
walk(id, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT b, depth + 1 FROM walk JOIN undirected ON a = walk.id WHERE depth < 2) SELECT id, depth FROM walk""")
def cluster_undirected(spark, sf_dir):
    """Documents within two steps in either direction, by level."""
    return graph.cluster(base.edges(spark, sf_dir), 5, 2, directed=False)


@query(""" SELECT 'node' AS kind, id::VARCHAR AS source, NULL::VARCHAR AS target, title AS label FROM docs
UNION ALL SELECT DISTINCT 'node', 'tag:' || tag, NULL, tag FROM dtags
UNION ALL SELECT 'edge', source_id::VARCHAR, target_id::VARCHAR, 'link' FROM links
UNION ALL SELECT 'edge', document_id::VARCHAR, 'tag:' || tag, 'tag_rel' FROM dtags""")
def graph_export(spark, sf_dir):
    """Nodes and edges of documents and tags."""
    return graph.export(_docs(spark, sf_dir), base.edges(spark, sf_dir), base.tags(spark, sf_dir))


@query("""SELECT source_id::VARCHAR AS source, target_id::VARCHAR AS target, 'link' AS kind FROM links WHERE source_id IN (SELECT id FROM docs WHERE project_id IN (1, 2, 3, 4, 5)) AND target_id IN (SELECT id FROM docs WHERE project_id IN (1, 2, 3, 4, 5))
UNION ALL SELECT document_id::VARCHAR, 'tag:' || tag, 'tag_rel' FROM dtags WHERE document_id IN (SELECT id FROM docs WHERE project_id IN (1, 2, 3, 4, 5))""")
def graph_view(spark, sf_dir):
    """Edges whose ends are in chosen projects."""
    nodes = base.documents(spark, sf_dir).select(F.col("id").cast("string").alias("node"), "project_id", F.lit(False).alias("is_tag"))
    edges = graph.export(_docs(spark, sf_dir), base.edges(spark, sf_dir), base.tags(spark, sf_dir)).where("kind = 'edge'").select("source", "target", F.col("label").alias("kind"))
    return graph.graph_view(nodes, edges, [1, 2, 3, 4, 5])


_RAW = "CASE id % 5 WHEN 0 THEN 'doc-' || (id // 2) WHEN 1 THEN '../doc-' || (id // 3) || '.md|alias' WHEN 2 THEN 'alias-' || (id // 4) WHEN 3 THEN source || '/' || lang || '/doc-' || id ELSE 'missing-' || id END"


def _raw_links(spark, sf_dir):
    docs = base.documents(spark, sf_dir)
    text = lambda c: c.cast("string")
    raw = (
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("doc-"), text(F.expr("id div 2"))))
        .when(F.col("id") % 5 == 1, F.concat(F.lit("../doc-"), text(F.expr("id div 3")), F.lit(".md|alias")))
        .when(F.col("id") % 5 == 2, F.concat(F.lit("alias-"), text(F.expr("id div 4"))))
        .when(F.col("id") % 5 == 3, F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), text(F.col("id"))))
        .otherwise(F.concat(F.lit("missing-"), text(F.col("id"))))
    )
    return docs, docs.select(F.col("id").alias("source_id"), raw.alias("target_raw"))


@query(f""", raw AS (SELECT id AS source_id, project_id, {_RAW} AS target_raw, CASE id % 5 WHEN 0 THEN id // 2 WHEN 1 THEN id // 3 WHEN 2 THEN id // 4 WHEN 3 THEN id END AS want, id % 5 AS form FROM docs)
SELECT source_id, target_raw, docs.id AS target_id, CASE WHEN docs.id IS NULL THEN 'unresolved' WHEN form = 2 THEN 'alias' WHEN docs.project_id = raw.project_id THEN 'project' ELSE 'global' END AS resolution
FROM raw LEFT JOIN docs ON docs.id = raw.want""")
def resolve_links(spark, sf_dir):
    """Raw targets (ids, relative paths with aliases, aliases, paths, missing ones) resolved as one join."""
    docs, links = _raw_links(spark, sf_dir)
    aliases = docs.select(F.col("id").alias("document_id"), F.concat(F.lit("alias-"), F.col("id").cast("string")).alias("alias"))
    return graph.resolve(links, docs.withColumn("title", F.concat(F.lit("T "), "source_doc_id")), aliases)


@query(""", parts AS (SELECT id, string_split(regexp_replace(file_path, '\\.md$', ''), '/') AS p FROM docs),
pre AS (SELECT id, len(p) AS n, unnest(range(1, len(p) + 1)) AS depth, p FROM parts)
SELECT array_to_string(p[1:depth], '/') AS path, array_to_string(p[1:depth - 1], '/') AS parent, p[depth] AS name, depth::INTEGER AS depth, min(CASE WHEN depth = n THEN id END) AS document_id, bool_or(depth = n) AS is_leaf
FROM pre GROUP BY 1, 2, 3, 4""")
def path_tree(spark, sf_dir):
    """The tree of documents' paths."""
    return graph.path_tree(_docs(spark, sf_dir))


@query(""", up(page_id, cur, path, parent) AS (SELECT id, CASE WHEN id = 0 THEN NULL ELSE (id - 1) // 3 END, source_doc_id, id FROM docs UNION ALL
  SELECT u.page_id, CASE WHEN d.id = 0 THEN NULL ELSE (d.id - 1) // 3 END, d.source_doc_id || '/' || u.path, d.id FROM up u JOIN docs d ON d.id = u.cur)
SELECT page_id, path, page_id IN (SELECT (id - 1) // 3 FROM docs WHERE id > 0) AS is_parent FROM up WHERE cur IS NULL""")
def ancestor_paths(spark, sf_dir):
    """Title paths from the root for a tree of pages."""
    docs = base.documents(spark, sf_dir)
    pages = docs.select(F.col("id").alias("page_id"), F.when(F.col("id") > 0, F.expr("(id - 1) div 3")).alias("parent_id"), F.col("source_doc_id").alias("title"))
    return graph.ancestor_paths(pages)


@query("SELECT page_id, list_distinct(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)).list_sort() AS links FROM pages")
def page_links(spark, sf_dir):
    """Distinct link targets of each page."""
    from ..sources.documents import pages

    return pages(base.read(spark, sf_dir, "pages")).select(F.col("source_doc_id").cast("long").alias("page_id"), F.array_sort("links").alias("links"))


@query("SELECT id, list_distinct(['Other', 'x/y.md']).list_sort() AS links FROM docs")
def link_extract(spark, sf_dir):
    """Wiki and inline links of documents that a template wraps around each text."""
    docs = base.documents(spark, sf_dir)
    text = F.concat(F.lit("[[Other|alias]] [t](x/y.md) [u](https://a.b/c) [[Other]]\n"), F.regexp_replace("content", r"[\[\]()#]", " "))
    return docs.select("id", F.array_sort(X.links(text)).alias("links"))


_ENDS = "CASE id % 6 WHEN 0 THEN substr(upper(source || '/' || lang || '/doc-' || (id // 2)), 3) WHEN 1 THEN 'see doc://ext ' || (id % 9 + 1) || '/doc-' || (id // 3) WHEN 2 THEN './../c-' || (id // 4) || '.md|x' WHEN 3 THEN right('doc-' || id, 2) WHEN 4 THEN lang || '/doc-' || (id // 5) || '.md' ELSE 'doc-%' END"


@query(f""", raw AS (SELECT id AS source_id, project_id, {_ENDS} AS target_raw FROM docs),
form AS (SELECT DISTINCT project_id AS p, target_raw, trim(split_part(target_raw, '|', 1)) AS t, regexp_extract(target_raw, 'doc://([^/\\s]+(?: [^/\\s]+)*)/([^\\s\\]\\).,]+)', 1) AS u, regexp_extract(target_raw, 'doc://([^/\\s]+(?: [^/\\s]+)*)/([^\\s\\]\\).,]+)', 2) AS v FROM raw),
norm AS (SELECT *, lower(t) AS lt, lower(regexp_replace(regexp_replace(regexp_replace(t, '^(\\./)+', ''), '^(\\.\\./)+', ''), '\\.md$', '')) AS ln FROM form),
hits AS (
  SELECT p, target_raw, 1 AS step, d.id FROM norm JOIN docs d ON u = 'ext ' || d.project_id AND v = d.source_doc_id
  UNION ALL SELECT p, target_raw, CASE WHEN d.project_id = p THEN 2 ELSE 3 END, d.id FROM norm JOIN docs d
    ON lower(d.source_doc_id) IN (lt, ln) OR ends_with(lower(d.file_path), lt) OR ends_with(lower(d.file_path), ln) OR ends_with(lower(d.file_path), ln || '.md')
), best AS (SELECT p, target_raw, min(row(step, id)) AS b FROM hits GROUP BY ALL)
SELECT source_id, raw.target_raw, b[2] AS target_id, CASE WHEN b IS NULL THEN 'unresolved' ELSE ['uri', 'project', 'global'][b[1]] END AS resolution FROM raw LEFT JOIN best ON p = project_id AND best.target_raw = raw.target_raw""")
def resolve_suffixes(spark, sf_dir):
    """Targets that are proper ends of paths (in any case, shared by many files), internal URIs, and wildcards taken literally."""
    docs = base.documents(spark, sf_dir)
    text = lambda c: F.expr(c).cast("string")
    doc = lambda c: F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), text(c))
    forms = [
        F.substring(F.upper(doc("id div 2")), 3, 1000), F.concat(F.lit("see doc://ext "), text("id % 9 + 1"), F.lit("/doc-"), text("id div 3")), F.concat(F.lit("./../c-"), text("id div 4"), F.lit(".md|x")),
        F.right(F.concat(F.lit("doc-"), text("id")), F.lit(2)), F.concat("lang", F.lit("/doc-"), text("id div 5"), F.lit(".md")), F.lit("doc-%"),
    ]
    links = docs.select(F.col("id").alias("source_id"), F.element_at(F.array(*forms), (F.col("id") % 6 + 1).cast("int")).alias("target_raw"))
    projects = base.projects(spark, sf_dir).withColumn("source_project_id", F.concat(F.lit("ext "), F.col("id").cast("string")))
    return graph.resolve(links, docs.withColumn("title", F.lit(None).cast("string")), spark.createDataFrame([], "document_id long, alias string"), projects)
