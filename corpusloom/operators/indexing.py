"""One run from a source's documents to all that is derived from them: chunks, postings, vectors and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as X
from ..functions import vectors as V
from ..staging import stage, unstage
from . import blocks, graph, sync
from . import catalog as C

KEYS = ["project_id", "source_doc_id"]


def touched(incoming: DataFrame, known: DataFrame, whole: bool = True, deleted: DataFrame | None = None) -> DataFrame:
    """incoming's columns with `id` and `action` of the documents that a run works on: indexed, or deleted (then content is
    null). With `whole` incoming is all that its projects hold, so their other documents are gone.

    A known document keeps its id; a new one is numbered by a hash of its key. incoming has one row a document.
    """
    hashed = X.content_hash(F.col("content"))
    old = known.select(*KEYS, F.col("id").alias("_id"))
    new = sync.needs_reindexing(incoming.drop("content_hash"), known, hashed).where("needs").drop("needs", "id").withColumn("content_hash", hashed).join(old, KEYS, "left")
    new = new.withColumn("id", F.coalesce("_id", F.xxhash64(*KEYS))).drop("_id").withColumn("action", F.lit("indexed"))
    gone = old.join(deleted.select(*KEYS).distinct(), KEYS, "left_semi") if deleted is not None else old.limit(0)
    if whole:
        inside = old.join(incoming.select(F.col("project_id").alias("_p")).distinct(), F.col("project_id") == F.col("_p"), "left_semi")
        gone = gone.unionByName(inside.join(incoming.select(*KEYS), KEYS, "left_anti")).distinct()
    return new.unionByName(gone.select(*KEYS, F.col("_id").alias("id"), F.lit("deleted").alias("action")), allowMissingColumns=True)


def chunk_rows(documents: DataFrame) -> DataFrame:
    """Rows of `chunks`, with title, of documents (id, title, content); a chunk is numbered by its document and place."""
    each = documents.select(F.col("id").alias("document_id"), "title", F.posexplode(M.chunk_column(F.col("content"))).alias("at", "c"))
    number = F.xxhash64("document_id", "at")
    return each.select(number.alias("id"), "document_id", "title", "c.heading_path", "c.content", F.col("at").alias("chunk_index"), F.col("c.start_byte").cast("long").alias("start_byte"), F.col("c.end_byte").cast("long").alias("end_byte"))


def _replace(key: str, present: Column):
    """combine for Catalog.merge: the rows of each key among the new ones take the place of its old ones; rows that only
    name a key leave nothing."""
    return lambda old, new: old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.where(present).select(*old.columns))


def run(store: C.Catalog, index: blocks.BlockIndex, incoming: DataFrame, now: int, embedder: str = "hashing", whole: bool = True, deleted: DataFrame | None = None, projects: DataFrame | None = None, buckets: int = 256):
    """(the index after the run, source_doc_id, project_id and action of what was done), for incoming documents
    (project_id, source_doc_id, title, file_path, content, created_at, updated_at; more columns of `documents` may follow).

    Only changed documents are cut, tokenised, embedded and searched for links; the catalog rewrites the buckets of their
    keys, and the index gets one segment. Links of other documents that had not been resolved, or that led to one that is
    gone, are tried again. Documents are saved last: a run that fails anywhere is repeated whole by the next one, and each
    step replaces by key, so nothing is left over or doubled. The embedded text names title and section. A table's first
    merge deals it into `buckets`. What the run stages for itself goes as soon as nothing reads it: a run holds changed
    texts once, and their chunks once beside those of the catalog.
    """
    known = store.load("documents")
    work = stage(touched(incoming, known, whole, deleted), "touched")
    # documents are saved without their texts
    named = stage(work.select(*(c for c in work.columns if c in known.columns or c == "action")), "touched-documents")
    new, ids = work.where("action = 'indexed'"), work.select(F.col("id").alias("document_id"))
    chunks = stage(chunk_rows(new), "chunks")
    # what these documents had before: the table of chunks still says so, as it is replaced after all that hangs on it
    before = stage(store.load("chunks").join(ids, "document_id", "left_semi").select("id"), "chunks-before")
    index = index.update(chunks.select("id", "title", "heading_path", "content"), before)

    made = V.embed_i8(X.embedding_text(F.col("title"), F.col("heading_path"), F.col("content")), embedder)
    vectors = chunks.select(F.col("id").alias("chunk_id"), made.alias("embedding"))
    old = before.select(F.col("id").alias("chunk_id"), F.lit(None).cast("array<tinyint>").alias("embedding"))
    store.merge("chunk_embeddings", vectors.unionByName(old), ["chunk_id"], _replace("chunk_id", F.col("embedding").isNotNull()), buckets)

    rows = chunks.drop("title").unionByName(ids, allowMissingColumns=True)
    store.merge("chunks", rows, ["document_id"], _replace("document_id", F.col("id").isNotNull()), buckets)
    for done in (chunks, before):
        unstage(done)

    def documents(old: DataFrame, rows: DataFrame) -> DataFrame:
        fresh = rows.where("action = 'indexed'").withColumn("last_indexed", F.lit(now).cast("long"))
        return C.upsert_documents(old, sync._as_documents(fresh, old)).join(rows.where("action = 'deleted'").select(*KEYS), KEYS, "left_anti").select(*old.columns)

    after = stage(documents(known, named), "documents-after").select("id", "project_id", "source_doc_id", "file_path", "title")
    own = stage(new.select(F.col("id").alias("source_id"), F.explode(X.links(F.col("content"))).alias("target_raw")), "links-own")
    held = store.load("document_links").join(ids.withColumnRenamed("document_id", "source_id"), "source_id", "left_anti")
    gone = work.where("action = 'deleted'").select(F.col("id").alias("target_id"))
    again = held.where("target_id is null").select("source_id").unionByName(held.join(gone, "target_id", "left_semi").select("source_id")).distinct()
    again = stage(held.join(again, "source_id", "left_semi").select("source_id", "target_raw"), "links-again")
    found = graph.resolve(own.unionByName(again).distinct(), after, store.load("document_aliases"), projects).withColumn("link_type", F.lit("link"))
    rows = found.unionByName(ids.withColumnRenamed("document_id", "source_id"), allowMissingColumns=True)
    store.merge("document_links", rows, ["source_id"], _replace("source_id", F.col("target_raw").isNotNull()), buckets)

    for done in (work, after, own, again):
        unstage(done)

    store.merge("documents", named, KEYS, documents, buckets)
    return index, named.select(*KEYS, "action")
