"""Quicker forms of text, chunk and vector functions give what the plain ones do, and a run does each of its works once."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import markdown, vectors
from corpusloom.functions import text as X
from corpusloom.operators import blocks, catalog, indexing

PIECES = ["Tea", "tea's ", "Ünï_x ", "İ", "K", "é", "straße ", "́", "x²", "½", "漢字 ", "🙂", "​", "–", "…", " ", "  ", "\t", "\n", "\n\n", "\n\n\n", ". ", "? ", "!", "word ", "# H\n", "<!-- c -->", "<!--", "[[a|b]]", "[t](u.md)", "[t](http://x/y)", "doc://p/i ", "_", "7"]


def texts():
    deal = random.Random(5)
    return [None, "", " "] + ["".join(deal.choices(PIECES, k=deal.randint(1, 40))) for _ in range(400)]


def test_tokens_links_and_cleaned_texts_are_the_same(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "id int, t string").repartition(2)
    t = F.col("t")
    clean = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?(?:-->|\z)", ""), r"[ \t]+", " ")
    wiki = F.transform(F.regexp_extract_all(t, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(F.split_part(x, F.lit("|"), F.lit(1))))
    inline = F.filter(F.regexp_extract_all(t, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda x: ~F.contains(x, F.lit("://")) | F.startswith(x, F.lit("doc://")))
    uris = F.regexp_extract_all(t, F.lit(r"(doc://[^/\s]+(?: [^/\s]+)*/[^\s\]\).,]+)"), F.lit(1))
    links = F.array_distinct(F.filter(F.concat(wiki, inline, uris), lambda x: x != ""))
    pairs = {"tokens": (X.token_text(t), F.array_join(X.tokens(t), " ")), "clean": (X.clean_markdown(t), clean), "links": (X.links(t), links)}
    for name, (have, want) in pairs.items():
        assert rows.select("t", have.alias("a"), want.alias("b")).where("not (a <=> b)").collect() == [], name


def test_vectors_are_the_same(spark):
    def plain(text, dim):
        out = np.zeros(dim, np.float32)
        for word in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(word.encode())
            out[h % dim] += 1.0 if h & 0x80000000 else -1.0
        length = np.linalg.norm(out)
        return out / length if length else out

    given = texts()
    assert np.array_equal(vectors._hashing(48)(given), np.array([plain(t, 48) for t in given]))
    rows = spark.createDataFrame([(t,) for t in given], "t string")
    name = vectors.register_hashing(48)
    assert rows.select("t", vectors.embed_i8(F.col("t"), name).alias("a"), vectors.quantize_i8(vectors.embed(F.col("t"), name)).alias("b")).where("not (a <=> b)").collect() == []
    odd = [0.5 / 128, -0.5 / 128, 1.5 / 128, 2.5 / 128, -2.5 / 128, 1.0, -1.0, 0.0, 0.00390624, 1e-30, 3e38, float("inf"), float("-inf"), float("nan")]
    want = spark.createDataFrame([(odd,)], "v array<float>").select(vectors.quantize_i8(F.col("v"))).first()[0]
    assert vectors._quantized(np.array([odd], np.float32))[0].tolist() == want


def test_stretches_are_the_same():
    deal = random.Random(9)
    for text in texts()[1:]:
        a, b = sorted((deal.randint(0, len(text)), deal.randint(0, len(text))))
        split = [markdown._strip(text, m.span()) for m in re.compile(r"(?:(?!\n\n).)+", re.S).finditer(text, a, b)]
        assert [s for s in (markdown._strip(text, p) for p in markdown._paragraphs(text, a, b)) if s[0] < s[1]] == [s for s in split if s[0] < s[1]]
        assert list(markdown._sentences(text, a, b)) == [m.span() for m in markdown.SENTENCE.finditer(text, a, b) if m.end() > m.start()]


def test_a_run_finds_links_once_and_hashes_what_changed(spark, tmp_path, monkeypatch):
    """Before, links were found three times a document, and texts of unchanged documents were hashed."""
    rows = [(1, f"d{i}", f"T{i}", f"d{i}.md", f"body {i} [[d{i + 1}]]", 10, 10) for i in range(20)]
    docs = spark.createDataFrame(rows, "project_id long, source_doc_id string, title string, file_path string, content string, created_at long, updated_at long")
    found, links, content_hash = spark.sparkContext.accumulator(0), X.links, X.content_hash

    @F.udf("string")
    def seen(text):
        found.add(1)
        return text

    monkeypatch.setattr(indexing.X, "links", lambda text: links(seen(text)))
    monkeypatch.setattr(indexing.X, "content_hash", lambda text: F.when(F.contains(text, F.lit("as it was")), F.raise_error(F.lit("hashed"))).otherwise(content_hash(text)))
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    index, _ = indexing.run(store, blocks.BlockIndex.open(spark, str(tmp_path / "i"), pairs=False), docs, 50, buckets=2)
    assert found.value == 20 and not index.pairs
    changed = F.col("source_doc_id") == "d3"
    later = docs.withColumn("updated_at", F.when(changed, 11).otherwise(F.col("updated_at"))).withColumn("content", F.when(changed, F.col("content")).otherwise("as it was"))
    index, done = indexing.run(store, index, later, 60, buckets=2)
    assert [r["source_doc_id"] for r in done.collect()] == ["d3"]
    assert found.value == 21 and not index.pairs
