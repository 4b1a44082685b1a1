"""Readers of document collections: Markdown trees, code-host exports, wiki exports; incremental reads; write-back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as X
from ..staging import stage
from . import vault

#: Columns of every reader: what a connector hands to indexing.
DOCUMENT = "source_doc_id string, title string, content string, file_path string, url string, tags array<string>, aliases array<string>, links array<string>, metadata map<string,string>, created_at long, updated_at long"


def markdown_listing(spark: SparkSession, root: str, since: int | None = None) -> DataFrame:
    """source_doc_id (path below root), path, updated_at and text of a tree's .md files, hidden parts left out."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").split("://")[-1].replace("file:", "")
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), rf"^.*?{re.escape(base)}/", "")
    rows = files.select(path.alias("source_doc_id"), F.col("value").alias("text"), F.unix_timestamp("_metadata.file_modification_time").alias("updated_at"))
    rows = rows.where(~F.rlike("source_doc_id", F.lit(r"(^|/)\.")))
    return rows if since is None else rows.where(F.col("updated_at") > since)


def parse_markdown(files: DataFrame, scheme: str = "doc") -> DataFrame:
    """Documents of a listing: title from frontmatter, else the first `#` line, else the file's stem; creation from
    frontmatter, else the file's time; tags, aliases and links."""
    rows = files.withColumn("meta", M.metadata_column(F.col("text"))).withColumn("body", X.strip_frontmatter(F.col("text")))
    stem = F.regexp_extract("source_doc_id", r"([^/]*?)(?:\.md)?$", 1)
    heading = F.trim(F.regexp_extract("body", r"(?m)^#\s+(.+)$", 1))
    created = F.coalesce(X.rfc3339_seconds(F.col("meta.created")), F.col("updated_at"))
    return rows.select(
        "source_doc_id",
        F.coalesce(F.nullif("meta.title", F.lit("")), F.nullif(heading, F.lit("")), stem).alias("title"),
        F.col("text").alias("content"),
        F.col("source_doc_id").alias("file_path"),
        F.lit(None).cast("string").alias("url"),
        F.array_distinct(F.concat("meta.tags", X.body_tags(F.col("body")))).alias("tags"),
        F.array_distinct("meta.aliases").alias("aliases"),
        F.array_sort(X.links(F.col("body"), scheme)).alias("links"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        created.alias("created_at"),
        "updated_at",
    )


def _document(**columns):
    """Columns in the readers' order, missing ones null."""
    fields = dict(x.split(" ") for x in DOCUMENT.split(", "))
    return [(columns[n] if n in columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields.items()]


def code_host(issues: DataFrame | None = None, wiki: DataFrame | None = None, discussions: DataFrame | None = None, repo: str = "owner/repo", since: int | None = None) -> DataFrame:
    """Documents of exported issues (number, title, body, state, html_url, pull_request, created_at, updated_at), wiki
    pages (slug, title, body, updated_at) and discussions; pull requests are dropped. With `since`, later updates only."""
    parts = []
    when = lambda c: X.rfc3339_seconds(F.col(c))
    for kind, rows in (("issue", issues), ("discussion", discussions)):
        if rows is None:
            continue
        if "pull_request" in rows.columns:
            rows = rows.where("pull_request is null")
        name = F.concat(F.col("number").cast("string"), F.lit("_"), X.sanitise_title(F.col("title")), F.lit(".md"))
        tags = F.array(F.lit("issue"), F.col("state")) if kind == "issue" else F.array(F.lit("discussion"))
        parts.append(rows.select(*_document(
            source_doc_id=F.concat(F.lit(f"{kind}:"), F.col("number").cast("string")), title=F.col("title"), content=F.coalesce("body", F.lit("")),
            file_path=F.concat(F.lit(f"{repo}/{'Issues' if kind == 'issue' else 'Discussions'}/"), name), url=F.col("html_url"), tags=tags, aliases=F.array(),
            links=X.links(F.coalesce("body", F.lit(""))), created_at=when("created_at"), updated_at=when("updated_at"),
        )))
    if wiki is not None:
        parts.append(wiki.select(*_document(
            source_doc_id=F.concat(F.lit("wiki:"), "slug"), title=F.col("title"), content=F.coalesce("body", F.lit("")), file_path=F.concat(F.lit(f"{repo}/Wiki/"), "slug", F.lit(".md")),
            tags=F.array(F.lit("wiki")), aliases=F.array(), links=X.links(F.coalesce("body", F.lit(""))), updated_at=when("updated_at"),
        )))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out if since is None else out.where(F.col("updated_at") >= since)


def wiki_pages(pages: DataFrame, root: int | None = None, since: int | None = None) -> DataFrame:
    """Documents of exported wiki pages (page_id, parent_id, title, storage, labels, url, updated_at): below `root` and
    itself where given; storage HTML becomes Markdown, labels tags, ancestor titles the path."""
    from ..operators.graph import ancestor_paths

    paths = ancestor_paths(pages)
    rows = pages
    if root is not None:
        tree = stage(pages.select("page_id", "parent_id"), "page-tree")
        down = ids = tree.where(F.col("page_id") == root).select("page_id")
        for _ in range(50):  # each level starts from a written table, not from the levels above it
            down = stage(tree.join(down.withColumnRenamed("page_id", "_up"), F.col("parent_id") == F.col("_up")).select("page_id"), "page-level")
            if down.isEmpty():
                break
            ids = ids.unionByName(down)
        rows = pages.join(ids.distinct(), "page_id", "left_semi")
    rows = rows.withColumn("at", X.rfc3339_seconds(F.col("updated_at")))
    if since is not None:
        rows = rows.where(F.col("at") > since)
    body = M.storage_column(F.coalesce("storage", F.lit("")))
    return rows.join(paths, "page_id").select(*_document(
        source_doc_id=F.col("page_id").cast("string"), title=F.col("title"), content=body, file_path=F.concat("path", F.lit(".md")), url=F.col("url"), tags=F.col("labels"), aliases=F.array(),
        links=F.array(), metadata=F.create_map(F.lit("is_parent"), F.col("is_parent").cast("string")), updated_at=F.col("at"),
    )).orderBy(F.col("source_doc_id").cast("long"))


def pages(table: DataFrame) -> DataFrame:
    """Documents of raw web pages (page_id, url, html): title element, tags stripped, links from href."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    href = F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), F.lit(1))
    return table.select(*_document(source_doc_id=F.col("page_id").cast("string"), title=title, content=X.strip_html(F.col("html")), url=F.col("url"), links=F.array_distinct(href), tags=F.array(), aliases=F.array()))


def write_documents(documents: DataFrame, root: str) -> DataFrame:
    """Write-back of documents (folder, title, content, created): Markdown files with frontmatter under root.

    Titles are made safe; equal names in a folder are numbered in the order of content and title, after the names that
    root has already, and no file is written over. One transaction, see `vault`. root may be any path that Spark and
    Arrow's file systems open from every executor. Null contents are empty. Returns path, title and error of each row:
    error is null where a file was written, else says why the row was left out. The writing is done when this returns.
    """
    rows = documents.select(F.lit("create").alias("action"), "folder", "title", "content", F.col("created").cast("string").alias("created"))
    return vault.change_documents(rows, root).select("path", "title", "error")
