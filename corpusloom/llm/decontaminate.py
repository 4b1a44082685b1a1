"""Benchmark decontamination: an FM-index over each shard of training text, searched for test phrases."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window.
WINDOW = 10
#: Bytes to bytes: A-Z to lower case, digits, a-z and all bytes of non-ASCII characters stay, the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Phrases:
    """Distinct windows of a block of benchmark items, by length, and the items that own them."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        ids: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            words = [ids.setdefault(w, len(ids)) for w in words_of(text)]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[at : at + window]), set()).add(item)
        self.words = list(ids)
        self.by_length: dict[int, tuple[np.ndarray, list]] = {}
        for n in sorted({len(w) for w in owners}):
            chosen = [w for w in owners if len(w) == n]
            self.by_length[n] = np.array(chosen, dtype=np.int64), [sorted(owners[w]) for w in chosen]


class FMIndex:
    """Index of a sequence of ints that ends with its only 0: wavelet matrix over its Burrows-Wheeler transform, sampled positions."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        self.n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        counts = np.bincount(text, minlength=symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels = []
        current = bwt
        for shift in reversed(range(max(1, int(symbols).bit_length()))):
            bit = (current >> shift) & 1
            packed = np.packbits(np.pad(bit.astype(np.uint8), (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = self.n - int(bit.sum())
            self.levels.append((shift, packed, ones, zeros))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        # where each symbol's run begins in the last level
        self.base = np.zeros(symbols + 1, dtype=np.int64)
        all_symbols = np.arange(symbols + 1)
        for level in self.levels:
            self.base = self._down(level, all_symbols, self.base)
        sampled = order % sample == 0
        self.bwt, self.sampled, self.at = bwt.astype(np.int32), sampled, np.cumsum(sampled) - 1
        self.positions = order[sampled]

    @staticmethod
    def _down(level, symbol, i):
        shift, packed, ones, zeros = level
        one = ones[i >> 6] + np.bitwise_count(packed[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where((symbol >> shift) & 1, zeros + one, i - one)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol[k] stands before row i[k] of the transform."""
        for level in self.levels:
            i = self._down(level, symbol, i)
        return i - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each pattern (one a row), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[live, column]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to the nearest sampled position."""
        rows, found, steps, live = rows.copy(), np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            hit = self.sampled[rows[live]]
            found[live[hit]] = self.positions[self.at[rows[live[hit]]]] + steps
            live = live[~hit]
            symbol = self.bwt[rows[live]]
            rows[live] = self.first[symbol] + self.rank(symbol, rows[live])
            steps += 1
        return found % self.n


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling the compared prefix; suffixes that are told apart drop out."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length()) if n else 1
    width = max(1, 62 // bits)  # as many symbols as fit into one key are compared at once
    width = min(width, 4)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= text[k:]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    lead = key[order]
    # a suffix shorter than `width` ends with the only 0, so no other has its key
    fresh = np.concatenate([[True], lead[1:] != lead[:-1]])[:n]
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while True:
        lead = rank[order]
        tied = np.concatenate([[False], lead[1:] == lead[:-1]])
        tied[:-1] |= tied[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        rows = order[slots]
        after = rows + width
        key = lead[slots] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[slots] = rows[by]
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[rows[by]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        width *= 2


class Shard:
    """Stretches of documents' words with an FM-index over all of them: every word of the training text is a symbol."""

    def __init__(self, stretches: list[tuple[int, int, list[bytes]]]):
        """stretches: (row, number of its first word, words)."""
        flat = [w for _, _, words in stretches for w in words]
        vocabulary = dict.fromkeys(flat)
        for number, word in enumerate(vocabulary):
            vocabulary[word] = number + 2  # 0 ends the text, 1 parts stretches
        self.vocabulary = vocabulary
        lengths = np.array([len(words) for _, _, words in stretches], np.int64)
        self.row = np.array([r for r, _, _ in stretches], np.int64)
        self.first = np.array([f for _, f, _ in stretches], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.ones(self.starts[-1] + 1, np.int64)
        places = np.ones(len(text), bool)
        places[self.starts[1:] - 1] = places[-1] = False
        text[places] = np.fromiter(map(vocabulary.__getitem__, flat), np.int64, len(flat))
        text[-1] = 0
        self.index = FMIndex(text, len(vocabulary) + 1)

    def find(self, phrases: Phrases):
        """Every occurrence of every phrase: yields (row, first word, phrase length, number among those of its length)."""
        known = np.fromiter((self.vocabulary.get(w, -1) for w in phrases.words), np.int64, len(phrases.words))
        for n, (patterns, _) in phrases.by_length.items():
            symbols = known[patterns]
            there = np.flatnonzero((symbols >= 0).all(axis=1))
            if not len(there):
                continue
            low, high = self.index.search(symbols[there])
            found = np.flatnonzero(low < high)
            if not len(found):
                continue
            count = high[found] - low[found]
            rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            at = self.index.locate(rows)
            stretch = np.searchsorted(self.starts, at, side="right") - 1
            yield self.row[stretch], self.first[stretch] + at - self.starts[stretch], n, np.repeat(there[found], count)


def stretches(text: str | None, row: int, window: int, limit: int):
    """The words of a text in stretches of about `limit` bytes that overlap by window - 1 words: no window is cut."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    at, first, tail = 0, 0, []
    while at < len(raw):
        end = raw.find(b" ", at + limit) if at + limit < len(raw) else len(raw)
        end = len(raw) if end < 0 else end
        words = tail + raw[at:end].split()
        yield row, first, words, end - at
        tail = words[-(window - 1) :] if window > 1 else []
        first, at = first + len(words) - len(tail), end


def shards(texts: list[str | None], window: int, limit: int):
    """Shards of about `limit` bytes of text, and the number of words of each text so far (complete after the last)."""
    held, size, lengths = [], 0, np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        for _, first, words, taken in stretches(text, row, window, limit):
            lengths[row] = first + len(words)
            if words:
                held.append((row, first, words))
            size += taken
            if size >= limit:
                if held:
                    yield Shard(held), lengths
                held, size = [], 0
    yield (Shard(held) if held else None), lengths


def merged(pairs: np.ndarray) -> list[int]:
    """Spans (start, end) in any order as disjoint ones, flat."""
    if not len(pairs):
        return []
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])
    return np.stack([pairs[new, 0], ends[last]], axis=1).ravel().tolist()


def hits(found, phrases: Phrases, n_rows: int) -> tuple[list, list]:
    """For each row its merged spans and its items, from what Shard.find gave."""
    spans, items = [[] for _ in range(n_rows)], [set() for _ in range(n_rows)]
    parts = {}
    for row, first, n, which in found:
        parts.setdefault(n, []).append((row, first, which))
    rows, starts, ends = [], [], []
    for n, many in parts.items():
        row, first, which = (np.concatenate(x) for x in zip(*many, strict=True))
        rows.append(row)
        starts.append(first)
        ends.append(first + n)
        owners = phrases.by_length[n][1]
        for r, w in np.unique(np.stack([row, which], axis=1), axis=0).tolist():
            items[r].update(owners[w])
    if rows:
        row, pairs = np.concatenate(rows), np.stack([np.concatenate(starts), np.concatenate(ends)], axis=1)
        order = np.argsort(row, kind="stable")
        row, pairs = row[order], pairs[order]
        hit, at = np.unique(row, return_index=True)
        for r, own in zip(hit.tolist(), np.split(pairs, at[1:]), strict=True):
            spans[r] = merged(own)
    return spans, [sorted(x) for x in items]


NAMES = ["n_words", "spans", "items"]
HITS = "n_words long, spans array<long>, items array<long>"
LONGS = pa.list_(pa.int64())


def _searched(batches, items, window: int, shard_bytes: int):
    """Batches with n_words, spans and items of each row."""
    phrases = Phrases(items, window)
    for batch in batches:
        texts, found, lengths = batch.column("text").to_pylist(), [], np.zeros(0, np.int64)
        for shard, lengths in shards(texts, window, shard_bytes):
            if shard is not None:
                found += shard.find(phrases)
        yield batch, [pa.array(lengths), *(pa.array(x, LONGS) for x in hits(found, phrases, len(texts)))]


def _indexed(batches, window: int, shard_bytes: int):
    """Rows of two kinds: a document (row number, id, key, words), and a shard (its index, with row numbers of its own)."""
    import pickle

    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    names = ["row", "doc_id", "text_key", "n_words", "shard"]
    for batch in batches:
        n = batch.num_rows
        for shard, lengths in shards(batch.column("text").to_pylist(), window, shard_bytes):
            if shard is not None:
                shard.row = shard.row + base
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([pickle.dumps(shard)], pa.binary())], names)
        numbers = pa.array(np.arange(base, base + n))
        yield pa.RecordBatch.from_arrays([numbers, batch.column("doc_id"), batch.column("text_key"), pa.array(lengths), pa.nulls(n, pa.binary())], names)
        base += n


def _search_indexes(batches, items, window: int):
    """Spans and items of the rows of each shard that have any."""
    import pickle

    phrases = Phrases(items, window)
    for batch in batches:
        for blob in batch.column("shard"):
            shard = pickle.loads(blob.as_py())
            numbers, shard.row = np.unique(shard.row, return_inverse=True)
            spans, owners = hits(shard.find(phrases), phrases, len(numbers))
            some = [k for k, s in enumerate(spans) if s]
            arrays = [pa.array(numbers[some]), pa.array([spans[k] for k in some], LONGS), pa.array([owners[k] for k in some], LONGS)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "spans", "items"])


def blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    """The benchmark in parts of about block_chars characters each, by item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-chars // block_chars) if chars > block_chars else 1
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) if n > 1 else items for i in range(n)]


def _items(block: DataFrame) -> list[tuple[int, str]]:
    return [(r[0], r[1]) for r in block.collect()]  # one block: bounded by block_chars


def _merge(batches):
    for batch in batches:
        spans = [merged(np.array([x for one in lists for x in one], np.int64).reshape(-1, 2)) for lists in batch.column("spans").to_pylist()]
        items = [sorted({i for one in lists for i in one}) for lists in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, LONGS), pa.array(items, LONGS)], ["row", "spans", "items"])


SCHEMA = f"doc_id long, text_key long, {HITS}"


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = 8_000_000, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, text_key, n_words, spans (start and end word of each hit stretch, flat) and items of every row of docs.

    About shard_bytes bytes of text in a task are a training shard with an FM-index over all its words. Every window of
    `window` benchmark words (an item of fewer words: all of them) is searched backwards in it, occurrences are located
    by sampled positions and merged into spans. Documents never shuffle. The benchmark goes to the tasks in blocks of
    about block_chars characters. Where there are several, the indexes are written once and each block is searched in
    all of them, so the documents are read and indexed once however large the benchmark is.
    A text longer than a shard is cut into stretches that overlap by window - 1 words, so no window is lost.
    Null and blank texts have no words and no hits; a null item_id or text of the benchmark is no item. Repeated rows
    give repeated rows, repeated items count once; an empty benchmark hits nothing, an empty table gives no rows. Other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.text_key().alias("text_key"))
    parts = blocks(benchmark, block_chars)
    if len(parts) == 1:
        items = _items(parts[0])

        def rows_of(batches):
            for batch, made in _searched(batches, items, window, shard_bytes):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *made], ["doc_id", "text_key", *NAMES])

        return rows.mapInArrow(rows_of, SCHEMA)
    kinds = "row long, doc_id long, text_key long, n_words long, shard binary"
    built = common.stage(rows.mapInArrow(lambda it: _indexed(it, window, shard_bytes), kinds), "training-shards")
    indexes, found = built.where("shard is not null").select("shard"), None
    for part in parts:
        items = _items(part)
        one = indexes.mapInArrow(lambda it, items=items: _search_indexes(it, items, window), "row long, spans array<long>, items array<long>")
        one = common.stage(one, "shard-hits")
        found = one if found is None else found.unionByName(one)
    lists = found.groupBy("row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))  # one a block and stretch
    hit = lists.mapInArrow(_merge, "row long, spans array<long>, items array<long>")
    none = F.array().cast("array<long>")
    joined = built.where("shard is null").drop("shard").join(hit, "row", "left")
    return joined.select("doc_id", "text_key", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", none).alias("items"))


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""

    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]

    def rows(batches):
        for batch in batches:
            items = batch.column("items").to_pylist()
            hit = np.array([sum(s[1::2]) - sum(s[::2]) for s in batch.column("spans").to_pylist()], dtype=np.int64)
            made = [pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array([digest(x) for x in items], pa.string()), pa.array(hit > 0)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *made, batch.column("spans")], names)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<long>"
    return find(docs, benchmark, **options).mapInArrow(rows, schema)


def cut_words(text: str, spans, word_bytes: bytes = WORD_BYTES) -> str:
    """text without the characters from the first to the last of each span of words."""
    raw = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(raw.translate(word_bytes), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], is_word.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[at : begin[a]])
        at = end[b - 1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = 8_000_000, block_chars: int = 8_000_000) -> DataFrame:
    """docs with hit spans removed from text and n_chars (where docs has it) counted anew; other columns are kept.

    With one benchmark block this is one pass in which no document moves. A null text stays null; a text without hits
    stays as it is; repeated rows are cut each; an empty table gives no rows.
    """
    parts = blocks(benchmark, block_chars)
    if len(parts) == 1:
        items, schema = _items(parts[0]), docs.schema

        def cut(batches):
            for batch, (_, spans, _) in _searched(batches, items, window, shard_bytes):
                pairs = zip(batch.column("text").to_pylist(), spans.to_pylist(), strict=True)
                named = {f.name: batch.column(f.name) for f in schema}
                named["text"] = pa.array([cut_words(t, s) if s else t for t, s in pairs], pa.string())
                yield pa.RecordBatch.from_pydict(named)

        return counted(docs.mapInArrow(cut, schema))
    found = find(docs, benchmark, window, shard_bytes, block_chars).where("size(spans) > 0")
    spans = found.groupBy("doc_id", "text_key").agg(F.first("spans").alias("_loom_spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_loom_doc", "text_key": "_loom_text"})
    rows = docs.withColumn("_loom_key", common.text_key())
    rows = rows.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("_loom_doc")) & (F.col("_loom_key") == F.col("_loom_text")), "left")
    return cut_spans(rows.drop("_loom_doc", "_loom_key", "_loom_text"), docs.schema)


def counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where it has that column, counted from text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def cut_spans(rows: DataFrame, schema, word_bytes: bytes = WORD_BYTES, spans_of=lambda s: s) -> DataFrame:
    """rows (a table's columns and _loom_spans) as that table, the spans cut out of text and n_chars counted anew."""

    def cut(batches):
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("_loom_spans").to_pylist(), strict=True)
            texts = [cut_words(t, spans_of(s), word_bytes) if s else t for t, s in pairs]
            named = {f.name: batch.column(f.name) for f in schema}
            named["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(named)

    return counted(rows.mapInArrow(cut, schema))
