"""Text, Markdown and version functions over every document, on texts made from its columns by one SQL expression.

The driver's texts have no headings, links, tags or frontmatter, so these are made from each row's id, language, source
and first words, by an expression that Spark and the oracle both read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as X
from ..functions import versions
from . import base
from .base import query

_ID = "CAST(id AS STRING)"
#: The first forty characters without what Markdown or a field would read: plain letters and single blanks.
_PLAIN = "trim(regexp_replace(title, '[^a-zA-Z]+', ' '{g}))"
_HEAD = f"'# Part ' || CAST(id % 5 AS STRING)"
_SUB = f"'## Sub ' || CAST(id % 3 AS STRING)"
_SECTION1 = f"{_HEAD} || chr(10) || chr(10) || 'Body of ' || source || ': ' || {_PLAIN} || '.' || chr(10) || chr(10)"
_SECTION2 = f"{_SUB} || chr(10) || chr(10) || 'More ' || lang || ' text number ' || {_ID} || '.' || chr(10)"
_FRONT = f"'---' || chr(10) || 'title: Doc ' || {_ID} || chr(10) || 'tags: [' || lang || ', s' || CAST(id % 7 AS STRING) || ']' || chr(10) || 'created: 2024-01-0' || CAST(id % 9 + 1 AS STRING) || 'T00:00:00Z' || chr(10) || 'aliases:' || chr(10) || '- a' || {_ID} || chr(10) || '- \"b ' || {_ID} || '\"' || chr(10) || '---' || chr(10) || chr(10)"
_BODY = f"{_SECTION1} || {_SECTION2}"
_FULL = f"{_FRONT} || {_BODY}"


def _sql(text: str) -> str:
    """The expression as DuckDB reads it: every match is replaced there only with the flag g."""
    return text.replace("{g}", ", 'g'")


def made(spark, sf_dir, text: str):
    """Documents with a column `text` made by an expression."""
    return base.documents(spark, sf_dir).withColumn("text", F.expr(text.replace("{g}", "")))


@query(f"SELECT id, 'Doc ' || {_ID} AS title, '2024-01-0' || CAST(id % 9 + 1 AS STRING) || 'T00:00:00Z' AS created, md5({_sql(_BODY)}) AS body_md5 FROM docs")
def frontmatter_parse(spark, sf_dir):
    """Fields and body of a leading block."""
    rows = made(spark, sf_dir, _FULL).select("id", M.frontmatter_column(F.col("text")).alias("f"))
    return rows.select("id", F.col("f.fields")["title"].alias("title"), F.col("f.fields")["created"].alias("created"), F.md5(F.col("f.body").cast("binary")).alias("body_md5"))


@query(f"SELECT id, 'Doc ' || {_ID} AS title, '2024-01-0' || CAST(id % 9 + 1 AS STRING) || 'T00:00:00Z' AS created, [lang, 's' || CAST(id % 7 AS STRING)] AS tags, ['a' || {_ID}, 'b ' || {_ID}] AS aliases FROM docs")
def frontmatter_metadata(spark, sf_dir):
    """Title, time, inline tags and block aliases."""
    return made(spark, sf_dir, _FULL).select("id", M.metadata_column(F.col("text")).alias("m")).select("id", "m.*")


@query(f"SELECT id, md5('---' || chr(10) || 'title: ' || title || chr(10) || 'id: ' || {_ID} || chr(10) || '---' || chr(10) || chr(10) || content) AS built, 'Re: ' || lang || ' by ' || source || ' / ' || lang AS filled FROM docs")
def frontmatter_build(spark, sf_dir):
    """A block before each text, and a template's placeholders filled."""
    docs = base.documents(spark, sf_dir)
    built = X.build_frontmatter([("title", F.col("title")), ("id", F.col("id"))], F.col("content"))
    filled = X.fill_placeholders(F.lit("Re: {{lang}} by {{source}} / {{lang}}"), {"lang": F.col("lang"), "source": F.col("source")})
    return docs.select("id", F.md5(built.cast("binary")).alias("built"), filled.alias("filled"))


@query(f"SELECT id, md5(CASE WHEN id % 3 = 0 THEN content ELSE {_sql(_BODY)} END) AS body_md5 FROM docs")
def frontmatter_strip(spark, sf_dir):
    """The body for previews; texts without a block stay."""
    rows = made(spark, sf_dir, f"CASE WHEN id % 3 = 0 THEN content ELSE {_FULL} END")
    return rows.select("id", F.md5(X.strip_frontmatter(F.col("text")).cast("binary")).alias("body_md5"))


@query(f"""SELECT id, {_HEAD} AS heading, 1 AS level, md5({_sql(_SECTION1)}) AS content_md5 FROM docs
UNION ALL SELECT id, {_SUB}, 2, md5({_sql(_SECTION2)}) FROM docs""")
def parse_sections(spark, sf_dir):
    """Sections by heading; those of a fenced block and of frontmatter don't count."""
    rows = made(spark, sf_dir, _FULL).select("id", F.explode(M.section_column(F.col("text"))).alias("s"))
    return rows.select("id", "s.heading", "s.level", F.md5(F.col("s.content").cast("binary")).alias("content_md5"))


_P = [f"repeat('{c}' || CAST(id % 10 AS STRING), 300)" for c in "pqr"]
_CHUNKED = f"'intro ' || lang || chr(10) || chr(10) || {_HEAD} || chr(10) || chr(10) || {_P[0]} || chr(10) || chr(10) || {_P[1]} || chr(10) || chr(10) || {_P[2]}"


@query(f"""SELECT id, 0 AS chunk_index, NULL AS heading_path, md5('intro ' || lang) AS content_md5 FROM docs
UNION ALL SELECT id, 1, {_HEAD}, md5({_HEAD} || chr(10) || chr(10) || {_P[0]}) FROM docs
UNION ALL SELECT id, 2, {_HEAD}, md5({_P[0]} || chr(10) || chr(10) || {_P[1]}) FROM docs
UNION ALL SELECT id, 3, {_HEAD}, md5({_P[1]} || chr(10) || chr(10) || {_P[2]}) FROM docs""")
def split_chunks(spark, sf_dir):
    """Paragraphs of 600 characters: each chunk takes the paragraph before it along."""
    rows = made(spark, sf_dir, _CHUNKED).select("id", F.explode(M.chunk_column(F.col("text"))).alias("c"))
    return rows.select("id", "c.chunk_index", "c.heading_path", F.md5(F.col("c.content").cast("binary")).alias("content_md5"))


_S = "repeat(CAST(id % 10 AS STRING), 298) || '. '"
_LONG = " || ".join([_S] * 5)


@query(f"""SELECT id, 0 AS chunk_index, md5(trim(substr(t, 1, 899))) AS content_md5 FROM (SELECT id, {_LONG} AS t FROM docs)
UNION ALL SELECT id, 1, md5(trim(substr(t, 700, 800))) FROM (SELECT id, {_LONG} AS t FROM docs)""")
def split_long_paragraph(spark, sf_dir):
    """A paragraph of five sentences with 300 characters each: whole sentences, 200 characters carried over."""
    rows = made(spark, sf_dir, _LONG).select("id", F.explode(M.chunk_column(F.col("text"))).alias("c"))
    return rows.select("id", "c.chunk_index", F.md5(F.col("c.content").cast("binary")).alias("content_md5"))


@query(f"SELECT id, CASE WHEN id % 3 = 1 THEN {_sql(_SECTION2)} END AS section FROM docs")
def extract_section(spark, sf_dir):
    """The section of a title, in any case; null where there is none."""
    return made(spark, sf_dir, _FULL).select("id", M.extract_section_column(F.col("text"), "sub 1").alias("section"))


@query(f"""SELECT id, CASE WHEN id % 5 = 2 THEN md5({_sql(_FRONT)} || {_HEAD} || chr(10) || 'new' || chr(10) || {_sql(_SECTION2)}) END AS replaced,
CASE WHEN id % 5 = 2 THEN md5({_sql(_FRONT)} || {_sql(_SECTION1)} || 'new' || chr(10) || {_sql(_SECTION2)}) END AS followed,
CASE WHEN id % 5 = 2 THEN md5({_sql(_FRONT)} || {_sql(_SECTION2)}) END AS removed FROM docs""")
def edit_section(spark, sf_dir):
    """A section's body replaced, text put after it, and the section taken out; null where it is missing."""
    rows = made(spark, sf_dir, _FULL)
    edits = {"replaced": ("replace", "new"), "followed": ("after", "new"), "removed": ("delete", "")}
    return rows.select("id", *(F.md5(M.edit_section_column(F.col("text"), "Part 2", a, new).cast("binary")).alias(name) for name, (a, new) in edits.items()))


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 'About ' || lang WHEN id % 4 = 1 THEN 'One ' || source || '. Two! Three?' ELSE '[목차: ' || {_HEAD} || ', ' || {_SUB} || ']' END AS summary FROM docs")
def summary_outline(spark, sf_dir):
    """A description, an outline, or the first three sentences."""
    text = f"CASE WHEN id % 4 = 0 THEN '---' || chr(10) || 'description: \"About ' || lang || '\"' || chr(10) || '---' || chr(10) || {_BODY} WHEN id % 4 = 1 THEN '```' || chr(10) || 'Code. ' || chr(10) || '```' || chr(10) || 'One <b>' || source || '</b>. Two!' || chr(10) || 'Three? Four.' ELSE {_FULL} END"
    return made(spark, sf_dir, text).select("id", M.summary_column(F.col("text")).alias("summary"))


@query("SELECT id, md5('[Title: ' || title || '] ' || CASE WHEN id % 2 = 0 THEN '' ELSE '[Section: ' || repeat('h', 150) || '...] ' END || content) AS text_md5 FROM docs WHERE trim(title) <> '' UNION ALL SELECT id, md5(CASE WHEN id % 2 = 0 THEN '' ELSE '[Section: ' || repeat('h', 150) || '...] ' END || content) FROM docs WHERE trim(title) = ''")
def embedding_text(spark, sf_dir):
    """Title and section before the body, cut to 150 characters, left out where blank."""
    docs = base.documents(spark, sf_dir)
    heading = F.when(F.col("id") % 2 == 1, F.repeat(F.lit("h"), 151)).otherwise(" ")
    return docs.select("id", F.md5(X.embedding_text(F.col("title"), heading, F.col("content")).cast("binary")).alias("text_md5"))


@query("""SELECT id, substr(text, ((low - low % 2) // 2 + 1)::BIGINT, ((high + high % 2 - low + low % 2) // 2)::BIGINT) AS snippet FROM (
SELECT id, repeat('é', 50) || repeat('ß', 50) AS text, id % 61 + 10 AS low, least(id % 61 + 10 + 100 + id % 7, 200) AS high FROM docs)""")
def byte_range_snippet(spark, sf_dir):
    """Fifty bytes more on either side, widened to whole characters."""
    rows = made(spark, sf_dir, "repeat('é', 50) || repeat('ß', 50)")
    start = F.col("id") % 61 + 60
    return rows.select("id", X.byte_range(F.col("text"), start.cast("int"), (start + F.col("id") % 7).cast("int")).alias("snippet"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN lang || '/x.md' WHEN 1 THEN 'x.md' WHEN 2 THEN 'other/' || source || '.md' ELSE 'sub/' || lang || '.md' END AS path FROM docs")
def display_path(spark, sf_dir):
    """Paths without their project's root, a leading slash, and a repeated virtual root."""
    path = F.expr("CASE id % 4 WHEN 0 THEN '/data/vault/' || lang || '/x.md' WHEN 1 THEN '/data/vault/' || source || '/x.md' WHEN 2 THEN 'other/' || source || '.md' ELSE '/data/vault/space/vault/sub/' || lang || '.md' END")
    return base.documents(spark, sf_dir).select("id", X.display_path(path, F.lit("/data/vault"), F.col("source")).alias("path"))


@query("SELECT id, id % 6 IN (1, 2, 3, 4) AS ignored FROM docs")
def watcher_ignore(spark, sf_dir):
    """Hidden parts, build folders and the engine's own files."""
    path = F.expr("CASE id % 6 WHEN 0 THEN 'notes/' || lang || '.md' WHEN 1 THEN '.git/' || lang WHEN 2 THEN 'a/node_modules/' || lang || '.md' WHEN 3 THEN 'notes/.' || lang || '/x.md' WHEN 4 THEN 'index.db-wal' ELSE 'a/targets/' || lang || '.md' END")
    return base.documents(spark, sf_dir).select("id", X.watcher_ignores(path).alias("ignored"))


@query("SELECT id, [lang, source, 's' || CAST(id % 7 AS STRING)] AS tags FROM docs")
def tag_query(spark, sf_dir):
    """Tags as a user types them."""
    typed = F.expr("'#' || lang || ', ' || source || ' ;  #s' || CAST(id % 7 AS STRING) || ' '")
    return base.documents(spark, sf_dir).select("id", X.tag_query(typed).alias("tags"))


@query(f"""SELECT id, md5('# ' || title || chr(10) || 'project: ' || source || chr(10) || 'id: ' || source_doc_id || chr(10) || 'updated: ' || CAST(updated_at AS STRING)) AS header_md5,
CAST(id AS STRING) || '. ' || source_doc_id || ' (0.' || CAST(id % 10 AS STRING) || '000) ' || substr(replace(content, chr(10), ' '), 1, 120) AS line,
CASE WHEN id % 3 = 0 THEN 'Untitled' ELSE source_doc_id END AS title FROM docs""")
def hit_rendering(spark, sf_dir):
    """Header blocks, one-line hits and fallback titles."""
    docs = base.documents(spark, sf_dir)
    score = (F.col("id") % 10) / 10.0
    blank = F.when(F.col("id") % 6 == 0, "  ").when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("source_doc_id"))
    return docs.select(
        "id",
        F.md5(X.header_block(F.col("title"), F.col("source"), F.col("source_doc_id"), F.col("updated_at")).cast("binary")).alias("header_md5"),
        X.compact_hit(F.col("id"), F.col("source_doc_id"), F.col("content"), score).alias("line"),
        X.title_or_untitled(blank).alias("title"),
    )


@query("""SELECT id, source || '/' || lang AS folder, 'doc-' || CAST(id AS STRING) || '.md' AS name, id % 5 NOT IN (1, 2, 3, 4) AS valid, 'a_b_c_ ' || lang AS safe FROM docs""")
def paths_and_titles(spark, sf_dir):
    """Folder and name of a path, whether a path is valid, and a title that a file can have."""
    docs = base.documents(spark, sf_dir)
    path = F.expr("CASE id % 5 WHEN 0 THEN file_path WHEN 1 THEN '../' || file_path WHEN 2 THEN source || '//' || lang WHEN 3 THEN '/' || file_path ELSE source || chr(92) || lang END")
    split = X.parent_and_name(F.col("file_path"))
    return docs.select("id", split["folder"].alias("folder"), split["name"].alias("name"), X.valid_path(path).alias("valid"), X.sanitise_title(F.concat(F.lit(" a/b:c? "), "lang")).alias("safe"))


@query(f"SELECT id, strftime(make_timestamp(updated_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS text, updated_at AS seconds FROM docs")
def times_rfc3339(spark, sf_dir):
    """Epoch seconds to RFC 3339 and back."""
    docs = base.documents(spark, sf_dir).select("id", X.seconds_rfc3339(F.col("updated_at")).alias("text"))
    return docs.withColumn("seconds", X.rfc3339_seconds(F.col("text")))


@query("""SELECT id, (id % 4 > 2 OR (id % 4 = 2 AND id % 10 >= 3)) AS caret, (id % 4 = 2 AND id % 10 >= 3) AS tilde, (id % 4 < 2) AS ranged, (id % 4 = 1 AND id % 10 = 5) AS exact FROM docs""")
def version_match(spark, sf_dir):
    """Versions 1.x.y against ^1.2.3, ~1.2.3, >=1.0,<1.2 and 1.1.5."""
    version = F.concat(F.lit("1."), (F.col("id") % 4).cast("string"), F.lit("."), (F.col("id") % 10).cast("string"))
    wants = {"caret": "^1.2.3", "tilde": "~1.2.3", "ranged": ">=1.0, <1.2", "exact": "1.1.5"}
    return base.documents(spark, sf_dir).select("id", *(versions.satisfies_column(version, F.lit(w)).alias(n) for n, w in wants.items()))


@query("""SELECT source AS plugin_id, '1.' || CAST(k // 100 AS STRING) || '.' || CAST(k % 100 AS STRING) AS version FROM (SELECT source, max(CASE WHEN id % 13 >= 2 THEN (id % 13) * 100 + id % 17 END) AS k FROM docs GROUP BY 1) WHERE k IS NOT NULL""")
def version_best(spark, sf_dir):
    """The highest version of each plugin that meets ^1.2."""
    version = F.concat(F.lit("1."), (F.col("id") % 13).cast("string"), F.lit("."), (F.col("id") % 17).cast("string"))
    return versions.best_match(base.documents(spark, sf_dir).select(F.col("source").alias("plugin_id"), version.alias("version")), "^1.2")


@query("SELECT id, id % 6 = 0 AS safe FROM docs")
def base_url_safety(spark, sf_dir):
    """https to public hosts only."""
    url = F.expr("CASE id % 6 WHEN 0 THEN 'https://' || lang || '.example.com/x' WHEN 1 THEN 'http://' || lang || '.example.com' WHEN 2 THEN 'https://127.0.0.1/' || lang WHEN 3 THEN 'https://10.0.0.' || CAST(id % 200 AS STRING) WHEN 4 THEN 'https://' || lang || '.local' ELSE 'https://169.254.1.1' END")
    return base.documents(spark, sf_dir).select("id", versions.safe_base_url_column(url).alias("safe"))


_TAGGED = f"'#' || lang || ' text ' || {_PLAIN} || chr(10) || 'and `#code` #s' || CAST(id % 7 AS STRING) || '/x #' || lang || ' #1no' || chr(10) || '```' || chr(10) || '#fenced' || chr(10) || '```' || chr(10) || 'a#b'"


@query("SELECT id, [lang, 's' || CAST(id % 7 AS STRING) || '/x'] AS tags FROM docs")
def body_tags(spark, sf_dir):
    """Tags of the body, outside code."""
    return made(spark, sf_dir, _TAGGED).select("id", X.body_tags(F.col("text")).alias("tags"))


_LINKED = f"{_PLAIN} || ' [[Doc ' || {_ID} || '|shown]] then [x](../' || lang || '/' || {_ID} || '.md) and [y](https://example.com/z) doc://' || source || '/d' || {_ID} || '. [[' || lang || ']] [[Doc ' || {_ID} || ']]'"


@query(f"SELECT id, ['Doc ' || {_ID}, lang, '../' || lang || '/' || {_ID} || '.md', 'doc://' || source || '/d' || {_ID}] AS links FROM docs")
def text_links(spark, sf_dir):
    """Wiki, Markdown and internal links among the text's own words."""
    return made(spark, sf_dir, _LINKED).select("id", X.links(F.col("text")).alias("links"))


@query(f"SELECT id, '- Part ' || CAST(id % 5 AS STRING) || chr(10) || '  - Sub ' || CAST(id % 3 AS STRING) AS toc FROM docs")
def text_toc(spark, sf_dir):
    """The table of contents among the text's own words."""
    return made(spark, sf_dir, _BODY).select("id", X.toc(F.col("text")).alias("toc"))


_STORED = f"'<h2>T ' || {_ID} || '</h2><p>' || {_PLAIN} || ' <strong>' || lang || '</strong><ac:link><ri:page ri:content-title=\"P ' || source || '\" /><ac:link-body>see</ac:link-body></ac:link></p><ul><li>one</li><li>' || source || '</li></ul><ac:structured-macro ac:name=\"code\"><ac:parameter ac:name=\"language\">sql</ac:parameter><ac:plain-text-body><![CDATA[SELECT ' || {_ID} || ' < 3]]></ac:plain-text-body></ac:structured-macro>'"


@query(f"SELECT id, '## T ' || {_ID} || chr(10) || chr(10) || {_sql(_PLAIN)} || ' **' || lang || '**[see](P ' || source || ')' || chr(10) || chr(10) || '- one' || chr(10) || '- ' || source || chr(10) || chr(10) || '```sql' || chr(10) || 'SELECT ' || {_ID} || ' < 3' || chr(10) || '```' AS markdown FROM docs WHERE {_sql(_PLAIN)} <> '' UNION ALL SELECT id, '## T ' || {_ID} || chr(10) || chr(10) || ' **' || lang || '**[see](P ' || source || ')' || chr(10) || chr(10) || '- one' || chr(10) || '- ' || source || chr(10) || chr(10) || '```sql' || chr(10) || 'SELECT ' || {_ID} || ' < 3' || chr(10) || '```' FROM docs WHERE {_sql(_PLAIN)} = ''")
def storage_markdown(spark, sf_dir):
    """Wiki storage format to Markdown: headings, marks, page links, lists, code."""
    return made(spark, sf_dir, _STORED).select("id", M.storage_column(F.col("text")).alias("markdown"))


@query(f"SELECT id, '<h2>T ' || {_ID} || '</h2>' || chr(10) || '<p>' || lang || ' <strong>' || source || '</strong> &lt;x&gt;</p>' || chr(10) || '<ul><li>one</li><li><input type=\"checkbox\" disabled checked> ' || lang || '</li></ul>' || chr(10) || '<pre><code class=\"language-sql\">SELECT ' || {_ID} || chr(10) || '</code></pre>' AS html FROM docs")
def markdown_html(spark, sf_dir):
    """Markdown to HTML: headings, marks, lists with tasks, code."""
    text = f"'## T ' || {_ID} || chr(10) || chr(10) || lang || ' **' || source || '** <x>' || chr(10) || chr(10) || '- one' || chr(10) || '- [x] ' || lang || chr(10) || chr(10) || '```sql' || chr(10) || 'SELECT ' || {_ID} || chr(10) || '```'"
    return made(spark, sf_dir, text).select("id", M.markdown_to_html_column(F.col("text")).alias("html"))
