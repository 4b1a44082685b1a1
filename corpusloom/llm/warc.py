"""WARC derivatives: response records become linked metadata and plain-text conversion records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is no text, and elements that part lines.
HIDDEN = ("script", "style", "template", "noscript")
BLOCK = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html"
    "|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
#: Named references decoded, the ampersand last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&euro;", "€"), ("&amp;", "&"),
)
SPACE = r"[ \t\r\n\f]"
#: (pattern, replacement) from HTML to text, in order; the same in Java's and RE2's syntax.
STEPS = (
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    *((rf"(?is)<{tag}(?:[ \t\r\n\f/][^>]*)?>.*?(?:</{tag}{SPACE}*>|\z)", " ") for tag in HIDDEN),
    (rf"(?i)</?(?:{BLOCK})(?:[ \t\r\n\f/][^>]*)?>", "\n"),
    (r"<[/!?a-zA-Z][^>]*(?:>|\z)", ""),
)
TIDY = ((r"[ \t\r\f\x0B]+", " "), (r" ?\n[ \n]*", "\n"), (r"\A[ \n]+|[ \n]+\z", ""))
#: The names of BLOCK by what they begin with: the same language, but a tag is not tried against each of them.
BLOCK_BY_START = (
    "a(?:ddress|rticle|side)|b(?:lockquote|ody|r)|d(?:[dtl]|iv)|f(?:i(?:eldset|gcaption|gure)|o(?:oter|rm))|h(?:[1-6r]|ead(?:er)?|tml)"
    "|li|main|nav|o(?:l|ption)|p(?:re)?|section|t(?:able|body|[dhr]|foot|head|itle)|ul"
)
TITLE = rf"(?is)<title(?:{SPACE}[^>]*)?>(.*?)</title"
LINK = rf'(?i)<a{SPACE}[^>]*href="([^"]*)"'
#: Capture date of pages that carry none.
DATE = "2024-01-01T00:00:00Z"


def plain(html: Column) -> Column:
    """The text of HTML: comments and hidden elements go, block tags part lines, other tags vanish, references are decoded."""
    out = html
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern.replace(BLOCK, BLOCK_BY_START), to)
    out = decoded(out)
    for pattern, to in TIDY[:-1]:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out, F.lit(" \n"))


def decoded(text: Column) -> Column:
    """The text with ENTITIES decoded, all in one pass: what one gives is never part of another, but for the ampersand,
    which is decoded last and so but once."""
    named = F.create_map(*(F.lit(x) for name, to in ENTITIES for x in (name[1:], to)))

    def piece(x: Column, i: Column) -> Column:
        name = F.regexp_extract(x, r"\A#?[a-z0-9]+;", 0)
        to = F.when(i > 0, F.try_element_at(named, name))
        return F.when(i == 0, x).when(to.isNull(), F.concat(F.lit("&"), x)).otherwise(F.concat(to, F.substr(x, F.length(name) + 1)))

    return F.array_join(F.transform(F.split(text, "&"), piece), "")  # text stands here once: what it is made by runs once


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def urn(kind: str, *parts: Column) -> Column:
    """A record id that only depends on what it is made from: a lost task makes the same one again."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (page_id, record_id, target_uri, record_date, http_headers, payload, payload_digest) from
    pages (page_id, url, html). Null html is an empty payload, a null url an empty target."""
    payload, uri = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        "page_id", uri.alias("target_uri"), F.lit(date).alias("record_date"), headers.alias("http_headers"), payload.alias("payload"), digest(payload).alias("payload_digest")
    ).withColumn("record_id", urn("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload_digest")))


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: a metadata and a conversion record.

    Columns: page_id, record_type, record_id, refers_to, target_uri, record_date, source_headers, source_digest,
    content_type, content_length, block_digest, block. Both refer to their response's id, target and date, carry its
    HTTP headers and payload digest unchanged, and a digest of their own block. The metadata block has warc-fields: the
    title, the source's type and digest, and each link. Ids are made from the response's id, so repeated responses give
    repeated records. A response with an empty payload has an empty conversion block; a null column of a response counts
    as empty. Very long payloads are held whole, as one row. An empty table gives no rows; other columns, whatever their
    names, are ignored. One map pass; nothing shuffles.
    """
    lines = lambda s: F.regexp_replace(s, r"[\r\n]+", " ")
    rows = records.withColumn("text", plain(F.col("payload")))
    rows = rows.withColumn("title", lines(plain(F.regexp_extract("payload", TITLE, 1))))
    links = F.transform(F.regexp_extract_all("payload", F.lit(LINK), 1), lambda u: F.concat(F.lit("outlink: "), lines(u)))
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("title: "), F.col("title")),
        F.concat(F.lit("source-content-type: "), F.trim(F.regexp_extract("http_headers", r"(?i)\nContent-Type:([^\r\n]*)", 1))),
        F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")),
        F.concat(F.lit("text-length: "), F.octet_length("text").cast("string")),
        F.array_join(links, "\r\n"),
    )
    rows = rows.withColumn("fields", fields)

    def record(kind: str, content_type: str, block: str) -> Column:
        return F.struct(
            F.lit(kind).alias("record_type"), urn(kind, F.col("record_id")).alias("record_id"), F.lit(content_type).alias("content_type"),
            F.octet_length(block).cast("long").alias("content_length"), digest(F.col(block)).alias("block_digest"), F.col(block).alias("block"),
        )

    made = F.array(record("metadata", "application/warc-fields", "fields"), record("conversion", "text/plain; charset=utf-8", "text"))
    return rows.select(
        "page_id", F.col("record_id").alias("refers_to"), "target_uri", "record_date", F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"),
        F.explode(made).alias("r"),
    ).select(
        "page_id", "r.record_type", "r.record_id", "refers_to", "target_uri", "record_date", "source_headers", "source_digest",
        "r.content_type", "r.content_length", "r.block_digest", "r.block",
    )


def report(pages: DataFrame) -> DataFrame:
    return derive(responses(pages))


def write(records: DataFrame, path: str, compress: bool = True) -> int:
    """Derived records as WARC/1.1 files, one a task, each record a gzip member of its own, as readers that seek expect.
    path may be any that Arrow's file systems open from every executor; a task that runs again writes its file again,
    under a name of its own first. Returns the number of records."""
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.concat(F.lit("WARC-Date: "), F.col("record_date")), F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")), F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Refers-To-Date: "), F.col("record_date")), F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
        F.concat(F.lit("X-Source-Payload-Digest: "), F.col("source_digest")),
        F.concat(F.lit("X-Source-Headers: "), F.replace(F.col("source_headers"), F.lit("\r\n"), F.lit(" | "))),
        F.concat(F.lit("Content-Type: "), F.col("content_type")), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    text = F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n"))
    root, end = path.rstrip("/"), ".warc.gz" if compress else ".warc"

    def written(batches):
        import gzip
        import uuid

        from pyarrow import fs as files
        from pyspark import TaskContext

        to, base = files.FileSystem.from_uri(root) if "://" in root else (files.LocalFileSystem(), root)
        to.create_dir(base, recursive=True)
        name, count = f"{base}/part-{TaskContext.get().partitionId():05d}{end}", 0
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        with to.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for record in batch.column("value").to_pylist():
                    raw = record.encode("utf-8", "surrogatepass")
                    out.write(gzip.compress(raw, mtime=0) if compress else raw)
                    count += 1
        to.move(draft, name) if count else to.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    return records.select(text.alias("value")).mapInArrow(written, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the .warc and .warc.gz files under path: file, warc_type, headers (names in lower case), block.

    Spark streams the files record by record (uncompressed ones in splits), so a task holds one record, not a file.
    What can't be read is a row of type `malformed` with the reason among its headers, and no block: a record whose
    Content-Length is missing or no number, and one that its file ends in. A gzip file that breaks off gives the records
    before that. A block that holds the words that begin a record is put together again, but for one that lies across
    two splits.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("lineSep", MARK.decode()).option("ignoreCorruptFiles", "true").text(path)
    parts = files.select(F.concat_ws("#", "_metadata.file_path", F.col("_metadata.file_block_start").cast("string")).alias("split"), F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("part"))
    return parts.mapInArrow(_records, "file string, warc_type string, headers map<string,string>, block binary")


#: What begins a record.
MARK = b"WARC/1."


def _parsed(raw: bytes, ended: bool):
    """(headers, block) of a record without its mark, (headers, None) where it is malformed, or None where more must follow."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return ({"warc-type": "malformed", "reason": "no end of the headers"}, None) if ended else None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return headers | {"warc-type": "malformed", "reason": "no valid Content-Length"}, None
    block = raw[end + 4 : end + 4 + int(size)]
    if len(block) < int(size):
        return (headers | {"warc-type": "malformed", "reason": "cut off"}, None) if ended else None
    return headers, block


def _records(batches):
    """Records from the stretches between marks, which come in the order of their file."""
    names, at, held, size, need, rows = ["file", "warc_type", "headers", "block"], (None, None), None, 0, 0, []

    def batch_of(rows):
        files, found = zip(*rows, strict=True)
        headers = pa.array([list(h.items()) for h, _ in found], pa.map_(pa.string(), pa.string()))
        kinds = pa.array([h.get("warc-type") for h, _ in found], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(files), kinds, headers, pa.array([b for _, b in found], pa.binary())], names)

    for batch in batches:
        for split, file, part in zip(*(batch.column(c).to_pylist() for c in ("split", "file", "part")), strict=True):
            if split != at[0]:  # what stands before a split's first mark is no record, or the end of another split's
                if held and (found := _parsed(MARK.join(held), True)):
                    rows.append((at[1], found))
                at, held = (split, file), None
                if not part.startswith((b"0\r\n", b"1\r\n")):
                    continue
            if held is None:
                held, size, need = [], 0, 0
            held.append(part)
            size += len(part) + len(MARK)
            if size >= need and (found := _parsed(MARK.join(held), False)):
                rows.append((file, found))
                held = None
            else:
                need = max(need, 2 * size) if len(held) > 64 else 0  # a block with very many marks isn't joined for each
            if len(rows) >= 256:
                yield batch_of(rows)
                rows = []
    if held and (found := _parsed(MARK.join(held), True)):
        rows.append((at[1], found))
    if rows:
        yield batch_of(rows)


def as_responses(records: DataFrame) -> DataFrame:
    """The HTTP responses among read records, as derive() takes them (page_id is null; payloads read as UTF-8)."""
    rows = records.where("warc_type = 'response'")
    text = F.col("block").cast("string")
    cut = F.instr(text, "\r\n\r\n")
    payload = F.when(cut > 0, F.substr(text, cut + 4)).otherwise(F.lit(""))
    return rows.select(
        F.lit(None).cast("long").alias("page_id"),
        F.coalesce(F.col("headers")["warc-target-uri"], F.lit("")).alias("target_uri"),
        F.coalesce(F.col("headers")["warc-date"], F.lit("")).alias("record_date"),
        F.when(cut > 0, F.substr(text, F.lit(1), cut - 1)).otherwise(text).alias("http_headers"),
        payload.alias("payload"),
        F.coalesce(F.col("headers")["warc-payload-digest"], digest(payload)).alias("payload_digest"),
        F.coalesce(F.col("headers")["warc-record-id"], urn("response", text)).alias("record_id"),
    )


def _sql_text(html: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    escaped = lambda s: quote(s) if "\n" not in s else "chr(10)"
    out = html
    for pattern, to in STEPS:
        out = f"regexp_replace({out}, {quote(pattern)}, {escaped(to)}, 'g')"
    for name, to in ENTITIES:
        out = f"replace({out}, {quote(name)}, {quote(to)})"
    for pattern, to in TIDY:
        out = f"regexp_replace({out}, {quote(pattern)}, {escaped(to)}, 'g')"
    return out


def _sql_urn(made: str) -> str:
    return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({made}) AS h))"


ORACLE = rf"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS source_digest,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) AS source_headers
  FROM pages
), named AS (
  SELECT *, {_sql_urn("'response|' || coalesce(page_id::VARCHAR, '') || '|' || target_uri || '|' || source_digest")} AS refers_to,
    {_sql_text("payload")} AS text,
    regexp_replace({_sql_text(f"regexp_extract(payload, '{TITLE}', 1)")}, '[\r\n]+', ' ', 'g') AS title,
    list_transform(regexp_extract_all(payload, '{LINK}', 1), lambda u: 'outlink: ' || regexp_replace(u, '[\r\n]+', ' ', 'g')) AS links
  FROM source
), blocks AS (
  SELECT *, concat_ws(chr(13) || chr(10), 'title: ' || title, 'source-content-type: text/html; charset=utf-8', 'source-payload-digest: ' || source_digest,
    'text-length: ' || strlen(text), array_to_string(links, chr(13) || chr(10))) AS fields
  FROM named
), made AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, fields AS block FROM blocks
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM blocks
)
SELECT page_id, record_type, {_sql_urn("record_type || '|' || refers_to")} AS record_id, refers_to, target_uri, '{DATE}' AS record_date, source_headers, source_digest,
  content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, block
FROM made
"""
