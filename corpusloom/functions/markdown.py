"""Structure of Markdown and HTML documents: sections, chunks, frontmatter, summaries and edits.

Small per-document helpers on spans (start, end) of characters, and the Arrow functions that run them in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape, unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Chunk length, overlap and summary lengths in characters; outline budget in bytes.
MAX_CHARS, OVERLAP, SUMMARY_CHARS, OUTLINE_BYTES = 1000, 200, 500, 150
HEADING = re.compile(r"^ *(#{1,6})(?: +(.*?))? *$")
FENCE = re.compile(r"^\s*(```|~~~)")
END = re.compile(r"[.?!](?=\s|\Z)")
SENTENCE = re.compile(r".*?(?:[.?!](?=\s|\Z)|\Z)", re.S)

Span = tuple[int, int]


def frontmatter(text: str) -> tuple[list[tuple[str, str]] | None, str]:
    """Ordered `key: value` pairs of a leading block between `---` lines, and the body; None without a closed block."""
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        return None, text
    for n, line in enumerate(lines[1:], 1):
        if line.rstrip() == "---":
            fields = [(k.strip(), v.strip()) for k, sep, v in (x.partition(":") for x in lines[1:n]) if sep and k.strip()]
            return fields, "\n".join(lines[n + 1 :]).lstrip("\n")
    return None, text


def metadata(text: str) -> dict:
    """title, created, tags and aliases from frontmatter: scalars, inline `[a, b]` and block `- a` lists."""
    found: dict = {"title": None, "created": None, "tags": [], "aliases": []}
    lines = text.split("\n")
    if lines[0].rstrip() != "---" or not any(x.rstrip() == "---" for x in lines[1:]):
        return found
    unquote = lambda s: s.strip().strip("\"'").strip()
    key = None
    for line in lines[1:]:
        if line.rstrip() == "---":
            break
        item = re.match(r"^\s*-\s+(.*)$", line)
        if item and key in ("tags", "aliases"):
            found[key].append(unquote(item[1]).lstrip("#"))
            continue
        name, sep, value = line.partition(":")
        key = name.strip().lower() if sep else None
        value = value.strip()
        if key in ("tags", "aliases") and value:
            parts = value[1:-1].split(",") if value.startswith("[") and value.endswith("]") else value.split(",")
            found[key] += [unquote(p).lstrip("#") for p in parts]
        elif key == "title" and value:
            found["title"] = unquote(value)
        elif key in ("created", "date") and value and found["created"] is None:
            found["created"] = unquote(value)
    for key in ("tags", "aliases"):
        found[key] = [x for x in found[key] if x]
    return found


def sections(text: str) -> list[tuple[str, int, int, int]]:
    """(heading, level, start, end) of each section; a section runs to the next heading of any level.

    Headings inside frontmatter and code fences don't count.
    """
    at, found, fence = 0, [], None
    if "#" not in text:
        return []
    fields, body = frontmatter(text)
    skip = len(text) - len(body) if fields is not None else 0
    for line in text.split("\n"):
        mark = FENCE.match(line)
        if at >= skip:
            if mark and fence in (None, line[:1]):
                fence = line[:1] if fence is None else None
            elif fence is None and not mark and (h := HEADING.match(line)):
                found.append((f"{h[1]} {h[2] or ''}".rstrip(), len(h[1]), at))
        at += len(line) + 1
    ends = [x[2] for x in found[1:]] + [len(text)] * bool(found)
    return [(h, level, start, end) for (h, level, start), end in zip(found, ends, strict=True)]


def _paragraphs(text: str, a: int, b: int) -> Iterator[Span]:
    """Stretches of a span between pairs of newlines."""
    while a < b:
        end = text.find("\n\n", a, b)
        end = b if end < 0 else end
        yield a, end
        a = end + 2


def _sentences(text: str, a: int, b: int) -> Iterator[Span]:
    """Sentences of a span: each to the end of its mark, the last to the end."""
    for m in END.finditer(text, a, b):
        yield a, m.end()
        a = m.end()
    if a < b:
        yield a, b


def _strip(text: str, span: Span) -> Span:
    a, b = span
    piece = text[a:b]
    return a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())


def _sentence_windows(text: str, span: Span, limit: int, overlap: int) -> list[Span]:
    """Chunks of a paragraph longer than the limit: whole sentences with the last `overlap` characters carried over; a
    longer sentence in windows that step back by the overlap, at most half a window."""
    out: list[Span] = []
    open_: Span | None = None
    for a, b in _sentences(text, *span):
        if b - a > limit:
            out += [open_] if open_ else []
            open_, at = None, a
            while at < b:
                take = min(limit, b - at)
                out.append((at, at + take))
                at += take - min(overlap, take // 2)
        elif open_ is None:
            open_ = (a, b)
        elif b - open_[0] > limit:
            out.append(open_)
            open_ = (max(open_[0], open_[1] - overlap), b)
        else:
            open_ = (open_[0], b)
    return out + ([open_] if open_ else [])


def _paragraph_windows(text: str, span: Span, limit: int, overlap: int) -> list[Span]:
    """Chunks of a stretch: runs of whole paragraphs, trailing ones carried over while they fit in the overlap (one at
    least)."""
    out: list[Span] = []
    run: list[Span] = []
    size = 0
    for paragraph in _paragraphs(text, *span):
        a, b = _strip(text, paragraph)
        if a >= b:
            continue
        if b - a > limit:
            out += [(run[0][0], run[-1][1])] if run else []
            run, size = [], 0
            out += _sentence_windows(text, (a, b), limit, overlap)
            continue
        if run and size + (b - a) + 2 > limit:
            out.append((run[0][0], run[-1][1]))
            kept = 1
            total = run[-1][1] - run[-1][0]
            while kept < len(run) and total + run[-kept - 1][1] - run[-kept - 1][0] <= min(overlap, limit // 2):
                total += run[-kept - 1][1] - run[-kept - 1][0]
                kept += 1
            run, size = run[-kept:], total
        run.append((a, b))
        size += b - a + 2
    return out + ([(run[0][0], run[-1][1])] if run else [])


def chunks(text: str | None, limit: int = MAX_CHARS, overlap: int = OVERLAP, keep_lead: bool = True) -> list[dict]:
    """chunk_index, heading_path, content, start_byte, end_byte of a document's chunks, numbered through its sections.

    Text before the first heading is a chunk without a heading (dropped with keep_lead=False). Byte offsets are exact
    for any text.
    """
    if not text:
        return []
    parts = [(h, a, b) for h, _, a, b in sections(text)]
    if not parts:
        parts = [(None, 0, len(text))]
    elif keep_lead and parts[0][1] > 0:
        parts.insert(0, (None, 0, parts[0][1]))
    out = []
    bytes_at, chars_at = 0, 0
    for heading, a, b in parts:
        for s, e in _paragraph_windows(text, (a, b), limit, overlap):
            if s >= chars_at:
                bytes_at, chars_at = bytes_at + len(text[chars_at:s].encode()), s
                start = bytes_at
            else:
                start = bytes_at - len(text[s:chars_at].encode())
            content = text[s:e]
            out.append({"chunk_index": len(out), "heading_path": heading, "content": content.strip(), "start_byte": start, "end_byte": start + len(content.encode())})
    return out


CHUNK = "array<struct<chunk_index:int,heading_path:string,content:string,start_byte:long,end_byte:long>>"


def _arrow(kind: str, f: Callable):
    """A scalar function of text as an Arrow-batched column function."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f(t) if isinstance(t, str) else f("") for t in texts], index=texts.index, dtype=object)

    return run


def chunk_column(text: Column, limit: int = MAX_CHARS, overlap: int = OVERLAP, keep_lead: bool = True) -> Column:
    kind = pa.list_(pa.struct({"chunk_index": pa.int32(), "heading_path": pa.string(), "content": pa.string(), "start_byte": pa.int64(), "end_byte": pa.int64()}.items()))

    @F.arrow_udf(CHUNK)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([chunks(t, limit, overlap, keep_lead) for t in texts.to_pylist()], kind)

    return run(text)


def section_column(text: Column) -> Column:
    """Sections with byte offsets."""

    def rows(t: str):
        size = lambda n: len(t[:n].encode())
        return [{"heading": h, "level": level, "content": t[a:b], "start_byte": size(a), "end_byte": size(b)} for h, level, a, b in sections(t)]

    return _arrow("array<struct<heading:string,level:int,content:string,start_byte:long,end_byte:long>>", rows)(text)


def frontmatter_column(text: Column) -> Column:
    """fields (map) and body."""

    def row(t: str):
        fields, body = frontmatter(t)
        return {"fields": dict(fields) if fields is not None else None, "body": body}

    run = F.udf(row, "struct<fields:map<string,string>,body:string>", useArrow=True)
    return run(F.coalesce(text, F.lit("")))


def metadata_column(text: Column) -> Column:
    kind = "struct<title:string,created:string,tags:array<string>,aliases:array<string>>"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([metadata(t or "") for t in texts], columns=["title", "created", "tags", "aliases"])

    return run(text)


def summary(text: str) -> str:
    """A description from frontmatter, else an outline of headings to level 3, else the first three sentences; code
    fences and tags left out, 500 characters and `...` at most."""
    if not text.strip():
        return ""
    fields, body = frontmatter(text)
    described = dict(fields or []).get("description", "").strip("\"'").strip()
    if described:
        found = described
    else:
        kept, fenced = [], False
        for line in body.split("\n"):
            if line.strip().startswith("```"):
                fenced = not fenced
            elif not fenced:
                kept.append(line)
        plain = re.sub(r"<[^>]+>", "", "\n".join(kept))
        outline, room = [], OUTLINE_BYTES
        for m in re.finditer(r"^\s*(#{1,3})(?!#)\s*(\S.*?)\s*$", plain, re.M):
            item = f"{m[1]} {m[2]}"
            room -= len(item.encode()) + 2
            if room < 0:
                break
            outline.append(item)
        if outline:
            found = f"[목차: {', '.join(outline)}]"
        else:
            sentences = (" ".join(m[0].split()) for m in SENTENCE.finditer(plain))
            found = " ".join([s for s in sentences if s][:3])
    return (found[:SUMMARY_CHARS] + "..." if len(found) > SUMMARY_CHARS else found).strip()


def summary_column(text: Column) -> Column:
    return _arrow("string", summary)(text)


def extract_section(text: str, heading: str) -> str | None:
    """The section whose title equals, or else contains, the heading in any case; to the next heading of its level or above."""
    want = heading.lstrip("#").strip().lower()
    found = sections(text)
    titles = [h.lstrip("#").strip().lower() for h, *_ in found]
    at = next((i for i, t in enumerate(titles) if t == want), None)
    at = at if at is not None else next((i for i, t in enumerate(titles) if want in t), None)
    if at is None:
        return None
    end = next((s[2] for s in found[at + 1 :] if s[1] <= found[at][1]), len(text))
    return text[found[at][2] : end]


def extract_section_column(text: Column, heading: str) -> Column:
    return _arrow("string", lambda t: extract_section(t, heading))(text)


def edit_section(text: str, heading: str, action: str, new: str = "", occurrence: int = 0) -> str:
    """`replace` the section's body, insert `after` it, or `delete` it; KeyError where the heading is missing."""
    found = [s for s in sections(text) if heading in (s[0], s[0].lstrip("#").strip())]
    if occurrence >= len(found):
        raise KeyError(f"no section {heading!r} (occurrence {occurrence})")
    head, _, start, end = found[occurrence]
    if action == "delete":
        return text[:start] + text[end:]
    if action == "after":
        lead = text[:end]
        return (lead if lead.endswith("\n") else lead + "\n") + new.rstrip("\n") + "\n" + text[end:]
    if action == "replace":
        line_end = text.find("\n", start, end)
        first = text[start:] if line_end < 0 else text[start:line_end]
        return text[:start] + first + "\n" + new.rstrip("\n") + "\n" + text[end:]
    raise ValueError(f"unknown action {action!r}")


def edit_section_column(text: Column, heading: str, action: str, new: str = "", occurrence: int = 0) -> Column:
    """edit_section of each text; null where the section is missing."""
    if action not in ("replace", "after", "delete"):
        raise ValueError(f"unknown action {action!r}")

    def edited(t: str) -> str | None:
        try:
            return edit_section(t, heading, action, new, occurrence)
        except KeyError:
            return None

    return _arrow("string", edited)(text)


class _ToMarkdown(HTMLParser):
    """Collects Markdown while it reads HTML."""

    BREAKS = frozenset("p div section article ul ol table blockquote".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.href: list[str] = []
        self.lists: list[list] = []
        self.pre = 0
        self.cells: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append(f"\n\n```{given.get('data-language') or ''}\n")
        elif tag == "a":
            self.href.append(given.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{given.get('alt') or ''}]({given.get('src') or ''})")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "tr":
            self.cells = []
            self.out.append("\n| ")
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag in self.BREAKS and tag not in ("ul", "ol"):
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")
            if tag == "th" and self.cells is not None:
                self.cells.append("---")
        elif tag == "tr" and self.cells:
            self.out.append("\n| " + " | ".join(self.cells) + " |")
        elif tag in self.BREAKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def storage_to_markdown(html: str) -> str:
    """Wiki storage format to Markdown: code macros become fences, page links links, other macros go; "" for nothing."""
    if not html.strip():
        return ""

    def code(m: re.Match) -> str:
        language = re.search(r'<ac:parameter ac:name="language">(.*?)</ac:parameter>', m[0], re.S)
        body = re.search(r"<ac:plain-text-body>\s*<!\[CDATA\[(.*?)\]\]>\s*</ac:plain-text-body>", m[0], re.S)
        return f'<pre data-language="{escape(language[1]) if language else ""}">{escape(body[1] if body else "")}</pre>'

    def link(m: re.Match) -> str:
        title = re.search(r'ri:content-title="(.*?)"', m[0])
        text = re.search(r"<ac:(?:plain-text-)?link-body>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</ac:", m[0], re.S)
        name = unescape(title[1]) if title else ""
        return f'<a href="{escape(name)}">{escape(unescape(text[1]) if text else name)}</a>'

    html = re.sub(r'<ac:structured-macro[^>]*ac:name="code".*?</ac:structured-macro>', code, html, flags=re.S)
    html = re.sub(r"<ac:link\b.*?</ac:link>", link, html, flags=re.S)
    html = re.sub(r"<ac:parameter\b.*?</ac:parameter>", "", html, flags=re.S)
    html = re.sub(r"</?(?:ac|ri):[^>]*>", "", html)
    parser = _ToMarkdown()
    parser.feed(html)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(parser.out))).strip()


def storage_column(html: Column) -> Column:
    return _arrow("string", storage_to_markdown)(html)


def markdown_to_html(text: str) -> str:
    """GitHub-flavoured Markdown to HTML: headings, fences, tables, lists with tasks, quotes, rules, and inline marks."""

    def inline(s: str) -> str:
        s = escape(s, quote=False)
        s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
        s = re.sub(r"!\[([^\]]*)\]\(([^)]+)\)", r'<img src="\2" alt="\1">', s)
        s = re.sub(r"\[([^\]]+)\]\(([^)]+)\)", r'<a href="\2">\1</a>', s)
        s = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", s)
        s = re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<em>\1</em>", s)
        return re.sub(r"~~(.+?)~~", r"<del>\1</del>", s)

    lines, out, n = text.split("\n"), [], 0
    item = re.compile(r"^\s*(?:([-*+])|\d+\.)\s+(.*)$")
    while n < len(lines):
        line = lines[n]
        if FENCE.match(line):
            end = next((k for k in range(n + 1, len(lines)) if FENCE.match(lines[k])), len(lines))
            language = line.strip()[3:].strip()
            out.append(f"<pre><code{f' class={chr(34)}language-{language}{chr(34)}' if language else ''}>{escape(chr(10).join(lines[n + 1 : end]), quote=False)}\n</code></pre>")
            n = end
        elif h := HEADING.match(line):
            out.append(f"<h{len(h[1])}>{inline(h[2] or '')}</h{len(h[1])}>")
        elif re.match(r"^\s*(?:---+|\*\*\*+)\s*$", line):
            out.append("<hr>")
        elif "|" in line and n + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+", lines[n + 1]) and "|" in lines[n + 1]:
            cells = lambda s: [inline(c.strip()) for c in s.strip().strip("|").split("|")]
            rows = ["<tr>" + "".join(f"<th>{c}</th>" for c in cells(line)) + "</tr>"]
            n += 2
            while n < len(lines) and "|" in lines[n]:
                rows.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells(lines[n])) + "</tr>")
                n += 1
            out.append("<table>" + "".join(rows) + "</table>")
            continue
        elif m := item.match(line):
            tag, rows = ("ul" if m[1] else "ol"), []
            while n < len(lines) and (m := item.match(lines[n])):
                task = re.match(r"^\[([ xX])\]\s+(.*)$", m[2])
                box = f'<input type="checkbox" disabled{" checked" if task[1] != " " else ""}> ' if task else ""
                rows.append(f"<li>{box}{inline(task[2] if task else m[2])}</li>")
                n += 1
            out.append(f"<{tag}>{''.join(rows)}</{tag}>")
            continue
        elif line.startswith(">"):
            out.append(f"<blockquote><p>{inline(line[1:].strip())}</p></blockquote>")
        elif line.strip():
            run = [line]
            while n + 1 < len(lines) and lines[n + 1].strip() and not HEADING.match(lines[n + 1]) and not item.match(lines[n + 1]) and not FENCE.match(lines[n + 1]):
                n += 1
                run.append(lines[n])
            out.append(f"<p>{inline(chr(10).join(run))}</p>")
        n += 1
    return "\n".join(out)


def markdown_to_html_column(text: Column) -> Column:
    return _arrow("string", markdown_to_html)(text)


def register(spark: SparkSession) -> None:
    """The functions under stable SQL names: doc_sections, doc_chunks, doc_summary, doc_frontmatter, doc_metadata, doc_section,
    doc_edit_section, storage_markdown, markdown_html."""
    rows = lambda t: [{"heading": h, "level": level, "content": t[a:b]} for h, level, a, b in sections(t or "")]

    def edited(t, heading, action, new):
        try:
            return edit_section(t or "", heading, action, new or "")
        except KeyError:
            return None

    for name, f, kind in (
        ("doc_sections", rows, "array<struct<heading:string,level:int,content:string>>"),
        ("doc_chunks", chunks, CHUNK),
        ("doc_summary", lambda t: summary(t or ""), "string"),
        ("doc_frontmatter", lambda t: dict(frontmatter(t or "")[0] or []), "map<string,string>"),
        ("doc_metadata", lambda t: metadata(t or ""), "struct<title:string,created:string,tags:array<string>,aliases:array<string>>"),
        ("doc_edit_section", edited, "string"),
        ("doc_section", lambda t, h: extract_section(t or "", h), "string"),
        ("storage_markdown", lambda t: storage_to_markdown(t or ""), "string"),
        ("markdown_html", lambda t: markdown_to_html(t or ""), "string"),
    ):
        spark.udf.register(name, F.udf(f, kind, useArrow=True))
