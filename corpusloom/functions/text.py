"""Text functions as column expressions: everything here runs in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining marks that a word is read without, alone or joined to a Latin letter: fixed values of the search tokenizer.
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
#: Small letters that count as another one: fixed values of the search tokenizer. 1fbe is a Greek iota of its own.
ALIKE = {"µ": "μ", "ſ": "s", "ẛ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε", "\u1fbe": "ι"}


def _marked() -> dict[str, str]:
    """Small letters of all of Unicode that are one of a to z with one mark, and which; ß, ł, ø and letters with two marks
    are letters of their own."""
    parted = ((chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0x80, 0x3000))
    return {c: d[0] for c, d in parted if len(d) == 2 and "a" <= d[0] <= "z" and d[1] in MARKS}


_FOLDS = _marked() | ALIKE
#: The fold as two strings for `translate`: what has no counterpart goes.
MARKED, PLAIN = "".join(_FOLDS) + MARKS, "".join(_FOLDS.values())
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
SNIPPET_MARGIN, CONTEXT_HIT = 50, 120


def clean_markdown(text: Column) -> Column:
    """HTML comments out (an unterminated one eats the rest), runs of spaces and tabs to one space; newlines stay."""
    # most texts have neither, and looking for a string is much quicker than a pattern
    without = F.when(F.contains(text, F.lit("<!--")), F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", "")).otherwise(text)
    wide = F.contains(without, F.lit("  ")) | F.contains(without, F.lit("\t"))
    return F.when(wide, F.regexp_replace(without, r"[ \t]+", " ")).otherwise(without)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    small = F.lower(text)
    # `translate` looks up each character, and none of ASCII's is in the table
    return F.when(F.length(text) == F.octet_length(text), small).otherwise(F.translate(small, MARKED, PLAIN))


def fold_word(word: str) -> str:
    """The same for a word that the driver holds."""
    return word.lower().translate(str.maketrans(_FOLDS) | dict.fromkeys(map(ord, MARKS)))


def tokens(text: Column) -> Column:
    """Search tokens in order: runs of letters, digits and private-use characters, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_text(text: Column) -> Column:
    """The same tokens as one string, parted by spaces."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), f"[^{TOKEN[1:]}", " "))


def embedding_text(title: Column, heading: Column, body: Column, max_chars: int = 1000) -> Column:
    """`[Title: t] [Section: h] body`, t and h cut to max(15 % of max_chars, 20) characters with `...`."""
    room = max(int(max_chars * 0.15), 20)

    def cut(c: Column) -> Column:
        return F.when(F.length(c) > room, F.concat(F.substring(c, 1, room), F.lit("..."))).otherwise(c)

    def part(name: str, c: Column) -> Column:
        return F.when(F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0, F.concat(F.lit(f"[{name}: "), cut(c), F.lit("] "))).otherwise("")

    return F.concat(part("Title", title), part("Section", heading), body)


def content_hash(text: Column) -> Column:
    """SHA-256 of the cleaned text, the same on both sides of every comparison."""
    return F.sha2(clean_markdown(text), 256)


def quoted(word: str) -> str:
    """A literal for a Java regex."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", word)


def highlight(text: Column, query: str) -> Column:
    """The text with each of the query's words in <b>: leftmost first, ASCII letters in any case."""
    words = list(dict.fromkeys(query.split()))
    return F.regexp_replace(text, f"(?i)({'|'.join(map(quoted, words))})", "<b>$1</b>") if words else text


def highlight_count(text: Column, query: str) -> Column:
    words = list(dict.fromkeys(query.split()))
    return F.regexp_count(text, F.lit(f"(?i)({'|'.join(map(quoted, words))})")) if words else F.lit(0)


def byte_range(text: Column, start: Column, end: Column, margin: int = SNIPPET_MARGIN) -> Column:
    """Bytes [start - margin, end + margin) of the text, widened to whole characters."""
    raw = F.encode(text, "UTF-8")
    low, high = F.greatest(start - margin, F.lit(0)), F.least(end + margin, F.octet_length(text))
    # continuation bytes are 10xxxxxx: step outwards over at most three of them

    def continues(at: Column) -> Column:
        return F.substr(F.hex(F.substr(raw, at + 1, F.lit(1))), F.lit(1), F.lit(1)).isin("8", "9", "A", "B")

    def widen(at: Column, step: int) -> Column:
        out = at
        for _ in range(3):
            out = F.when(continues(out), out + step).otherwise(out)
        return out

    low, high = widen(low, -1), F.least(widen(high, 1), F.octet_length(text))
    return F.decode(F.substr(raw, low + 1, high - low), "UTF-8")


def strip_html(text: Column) -> Column:
    """Tags to single spaces (an unterminated one eats the rest), whitespace squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*(?:>|\z)", " "), r"[ \t\r\n\f]+", " "))


def body_tags(text: Column) -> Column:
    """`#tag`s of the body: outside fences and inline code, starting with a letter; first occurrence kept."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)(```|~~~).*?(?:\1|\z)", " "), r"`[^`\n]*`", " ")
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?:^|\s)#(\p{L}[\p{L}\p{N}_/-]*)"), F.lit(1)))


def links(text: Column, scheme: str = "doc") -> Column:
    """Link targets in the order wiki, Markdown, internal URI; duplicates keep the first.

    `[[target|alias]]` gives target, `[text](target)` the target unless it is a URL of another scheme, and
    `scheme://project/id` itself up to a space or one of `] ) . ,`.
    """

    def found(mark: str, pattern: str) -> Column:
        """All matches of a pattern that needs the mark: it is tried only where that is."""
        return F.when(F.contains(text, F.lit(mark)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).when(text.isNotNull(), F.array().cast("array<string>"))

    wiki = F.transform(found("[[", r"\[\[([^\]]+)\]\]"), lambda x: F.trim(F.split_part(x, F.lit("|"), F.lit(1))))
    inline = F.filter(found("](", r"\[[^\]]*\]\(([^)]+)\)"), lambda x: ~F.contains(x, F.lit("://")) | F.startswith(x, F.lit(f"{scheme}://")))
    uris = found(f"{scheme}://", rf"({scheme}://[^/\s]+(?: [^/\s]+)*/[^\s\]\).,]+)")
    return F.array_distinct(F.filter(F.concat(wiki, inline, uris), lambda x: x != ""))


def toc(text: Column) -> Column:
    """Indented list of headings (two spaces a level below the first); code fences aren't told apart."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"^\s{0,3}#{1,6}(?:\s|$)")))

    def item(x: Column) -> Column:
        level = F.length(F.regexp_extract(x, r"^\s{0,3}(#{1,6})", 1))
        title = F.trim(F.regexp_extract(x, r"^\s{0,3}#{1,6}(?:\s+(.*)|$)", 1))
        return F.concat(F.repeat(F.lit("  "), level - 1), F.lit("- "), title)

    return F.array_join(F.transform(lines, item), "\n")


def display_title(title: Column, source_doc_id: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), source_doc_id)


def title_or_untitled(title: Column) -> Column:
    return F.when(F.coalesce(F.length(F.trim(title)), F.lit(0)) > 0, title).otherwise("Untitled")


def display_path(path: Column, root: Column, project: Column) -> Column:
    """A document's path without its project's root, a leading slash, and a repeated virtual root."""
    cut = F.when(F.startswith(path, root), F.substr(path, F.length(root) + 1)).otherwise(path)
    cut = F.regexp_replace(cut, r"^/+", "")
    last = F.element_at(F.split(F.regexp_replace(root, "/+$", ""), "/"), -1)
    for name in (F.lit("project"), F.lit("space"), project, last):
        cut = F.when(F.startswith(cut, F.concat(name, F.lit("/"))), F.substr(cut, F.length(name) + 2)).otherwise(cut)
    return cut


def strip_frontmatter(text: Column) -> Column:
    """The body after a leading `---` block, for previews."""
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)\n*", "")


def fill_placeholders(template: Column, values: dict[str, Column]) -> Column:
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def build_frontmatter(fields: list[tuple[str, Column]], body: Column) -> Column:
    """`---` block with the fields in order, then the body."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)


def header_block(title: Column, project: Column, source_doc_id: Column, updated_at: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.concat(F.lit("project: "), project), F.concat(F.lit("id: "), source_doc_id), F.concat(F.lit("updated: "), updated_at.cast("string")))


def compact_hit(rank: Column, title: Column, snippet: Column, score: Column) -> Column:
    """One line a hit: rank, title, score with four digits, 120 characters without newlines."""
    flat = F.substring(F.replace(snippet, F.lit("\n"), F.lit(" ")), 1, CONTEXT_HIT)
    return F.concat(rank.cast("string"), F.lit(". "), title, F.lit(" ("), F.format_string("%.4f", score), F.lit(") "), flat)


def valid_path(path: Column) -> Column:
    """Relative, no empty, dot or dot-dot part, no backslash or NUL."""
    parts = F.split(path, "/")
    ok = ~F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce(ok & ~F.rlike(path, F.lit(r"[\\\x00]")) & (F.length(F.trim(path)) > 0), F.lit(False))


def sanitise_title(title: Column) -> Column:
    """Characters that file names can't have become `_`."""
    return F.trim(F.translate(title, '/\\:*?"<>|', "_" * 9))


def parent_and_name(path: Column) -> Column:
    """Folder and last part of a hierarchical path."""
    return F.struct(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name"))


def tag_query(text: Column) -> Column:
    """Tags typed by a user: split at commas, semicolons and blanks, without leading `#`."""
    parts = F.transform(F.split(text, r"[,;\s]+"), lambda x: F.regexp_replace(x, "^#", ""))
    return F.filter(parts, lambda x: x != "")


def watcher_ignores(path: Column, database: str = "index.db") -> Column:
    """Hidden parts, build folders and the engine's own files don't count as changes."""
    return F.rlike(path, F.lit(r"(^|/)\.[^/]")) | F.rlike(path, F.lit(r"(^|/)(node_modules|target|dist)(/|$)")) | F.rlike(path, F.lit(rf"(^|/){quoted(database)}[^/]*$"))


def rfc3339_seconds(text: Column) -> Column:
    """Epoch seconds of an RFC 3339 time; null where it isn't one."""
    return F.unix_timestamp(F.try_to_timestamp(text))


def seconds_rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
