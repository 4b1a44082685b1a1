"""Substring dedup: repeated word windows found by super-k-mer partitioning, counted exactly in buckets."""

from __future__ import annotations

import hashlib
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import cut_spans

#: Words of a window, and words of the m-mers of which a window's smallest hash is its minimiser.
WINDOW, MMER = 35, 5
#: Bytes of text for each bucket, and buckets at least. Windows that a bucket sorts at a time.
BUCKET_BYTES, LEAST_BUCKETS, PASS_WINDOWS = 8_000_000, 96, 4_000_000
#: Rows from which frequent m-mers are told, the share of them from which an m-mer is frequent, m-mers told at most.
#: Frequent ones come last in the order of m-mers. The order deals windows to buckets and never changes a result.
SAMPLE, FREQUENT, TOLD = 4_000, 0.002, 50_000
#: Bytes that part words: space and 0x09 to 0x0D.
WORD_BYTES = bytes(32 if b == 32 or 9 <= b <= 13 else 97 for b in range(256))
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

SPANS = "doc_id long, text_key long, spans binary"
BLOCK = "bucket int, docs binary, meta binary, strings binary, known binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x + np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def mmers(words: list[bytes], mmer: int) -> np.ndarray:
    """Hash of each run of mmer words; none where there are fewer words."""
    from xxhash import xxh64_intdigest

    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    grams = np.zeros(max(0, len(words) - mmer + 1), np.uint64)
    for i in range(mmer if len(grams) else 0):
        grams = mixed(grams + hashes[i : len(words) - mmer + 1 + i])
    return grams


def minimisers(words: list[bytes], window: int, mmer: int, late: np.ndarray | None = None) -> np.ndarray:
    """For each window the first of its m-mers in an order common to all texts: by hash, those marked in `late` last."""
    grams = mmers(words, mmer)
    if late is not None:
        grams = (grams >> np.uint64(1)) | (late[grams & np.uint64(len(late) - 1)] << np.uint64(63))
    low, width, span = grams, 1, window - mmer + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(low) - (span - width)], low[span - width :]) if span > width else low


class _Blocks:
    """Super-k-mers of a stretch of documents, by bucket; equal strings go once."""

    def __init__(self, buckets: int, late: np.ndarray | None):
        self.buckets, self.late, self.size = buckets, late, 0
        self.docs: list[tuple[int, int]] = []
        self.seen: dict[bytes, list] = {}
        self.known: list[tuple] = []  # (bucket, doc, first, last word) of strings that a task has met twice

    def add(self, doc_id, key, text, window: int, mmer: int) -> None:
        words = words_of(text)
        if len(words) < window:
            return
        low = minimisers(words, window, mmer, self.late)
        doc = len(self.docs)
        self.docs.append((doc_id, key))
        joined = b" ".join(words)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()
        cut = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]])
        for a, b, bucket in zip(cut[:-1].tolist(), cut[1:].tolist(), (low[cut[:-1]] % np.uint64(self.buckets)).tolist(), strict=True):
            string = joined[at[a] : at[b + window - 1] - 1]
            found = self.seen.get(string)
            if found is None:
                self.seen[string] = [bucket, doc, a, b + window - 1, False]
                self.size += len(string)
            else:  # all its windows start here and there
                self.known.append((bucket, doc, a, b + window - 1))
                if not found[4]:
                    self.known.append(tuple(found[:4]))
                    found[4] = True

    def flush(self):
        """One row a bucket: the documents named, (document, first word, bytes) of each string, the strings, and spans known already."""
        import zstandard

        by: dict[int, tuple[list, list, list]] = {}
        for string, (bucket, doc, a, _, _) in self.seen.items():
            meta, strings, _ = by.setdefault(bucket, ([], [], []))
            meta.append((doc, a, len(string)))
            strings.append(string)
        for bucket, *span in self.known:
            by[bucket][2].append(span)
        pack = zstandard.ZstdCompressor(level=1).compress
        all_docs = np.array(self.docs, dtype=np.int64).reshape(-1, 2)
        rows = []
        for bucket, (meta, strings, spans) in by.items():
            meta, spans = (np.array(x, dtype=np.int64).reshape(-1, 3) for x in (meta, spans))
            used, at = np.unique(np.concatenate([meta[:, 0], spans[:, 0]]), return_inverse=True)
            meta[:, 0], spans[:, 0] = at[: len(meta)], at[len(meta) :]
            rows.append((bucket, all_docs[used].tobytes(), pack(meta.astype("<i4").tobytes()), pack(b"".join(strings)), spans.astype("<i4").tobytes()))
        self.docs, self.seen, self.known, self.size = [], {}, [], 0
        for i in range(0, len(rows), 64):
            columns = list(zip(*rows[i : i + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], [f.split()[0] for f in BLOCK.split(", ")])


def _split(batches, buckets: int, window: int, mmer: int, block_bytes: int, late: np.ndarray | None):
    blocks = _Blocks(buckets, late)
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text")), strict=True):
            blocks.add(*row, window, mmer)
            if blocks.size >= block_bytes:
                yield from blocks.flush()
    if blocks.docs:
        yield from blocks.flush()


def _keys(ids: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all windows of strings of word ids, laid end to end."""
    total = len(ids)
    n = lengths - window + 1
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    starts = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    odd = 0x5851F42D4C957F2D
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(total, odd, np.uint64)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(total, pow(odd, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(ids.astype(np.uint64)) * power[:-1], dtype=np.uint64)])
    return starts, mixed((sums[starts + window] - sums[starts]) * back[starts])


def _same(ids: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows that start at a[k] and b[k] are the same words."""
    out = np.ones(len(a), bool)
    for i in range(window):
        out &= ids[a + i] == ids[b + i]
    return out


def repeated(ids: np.ndarray, lengths: np.ndarray, window: int, limit: int = PASS_WINDOWS) -> np.ndarray:
    """For strings of word ids, laid end to end, the starts of windows that start anywhere else among them too.

    Windows are sorted by a hash, and those that tie are compared word by word. At most about `limit` windows are sorted
    at a time: a larger table is gone through once for each stretch of the hash's range.
    """
    ends = np.cumsum(lengths)
    total = int((lengths - window + 1).sum())
    passes = -(-total // limit) if total else 1
    out = []
    for part in range(passes):
        low, high = (part << 64) // passes, ((part + 1) << 64) // passes - 1
        starts, keys, at = [], [], 0
        while at < len(lengths):  # strings that hold a million words at a time
            begin = int(ends[at] - lengths[at])
            to = max(at + 1, int(np.searchsorted(ends, begin + 1_000_000, side="right")))
            s, k = _keys(ids[begin : int(ends[to - 1])], lengths[at:to], window)
            if passes > 1:
                mine = (k >= np.uint64(low)) & (k <= np.uint64(high))
                s, k = s[mine], k[mine]
            starts.append(s + begin)
            keys.append(k)
            at = to
        if not starts:
            continue
        starts, keys = np.concatenate(starts), np.concatenate(keys)
        order = np.argsort(keys)
        keys, starts = keys[order], starts[order]
        tie = np.flatnonzero(keys[1:] == keys[:-1])
        true = _same(ids, starts[tie], starts[tie + 1], window)
        twice = np.zeros(len(keys), bool)
        if true.all():
            twice[tie] = twice[tie + 1] = True
        else:  # a hash that different windows share: tell its windows apart by their words
            tied = np.unique(np.concatenate([tie, tie + 1]))
            words = ids[starts[tied][:, None] + np.arange(window)]
            _, which, count = np.unique(words, axis=0, return_inverse=True, return_counts=True)
            twice[tied] = count[which.ravel()] > 1
        out.append(starts[twice])
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def _count(key, table: pa.Table, window: int) -> pa.Table:
    """One bucket: all its strings' windows counted; out come the word spans of repeated ones, by document."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    numbers = counter()
    ids: dict[bytes, int] = {}
    docs, owner, begin, lengths, parts, out = [], [], [], [], [], []
    base = 0
    get = ids.get
    for row in table.select(["docs", "meta", "strings", "known"]).to_batches():
        for named, meta, strings, known in zip(*(c.to_pylist() for c in row.columns), strict=True):
            named = np.frombuffer(named, "<i8").reshape(-1, 2)
            known = np.frombuffer(known, "<i4").reshape(-1, 3).astype(np.int64)
            known[:, 0] += base
            out.append(known)
            meta = np.frombuffer(unpack(meta), "<i4").reshape(-1, 3).astype(np.int64)
            strings, at = unpack(strings), 0
            owner.append(meta[:, 0] + base)
            begin.append(meta[:, 1])
            sizes = []
            for size in meta[:, 2].tolist():
                words = strings[at : at + size].split(b" ")
                at += size
                sizes.append(len(words))
                numbered = [get(w) for w in words]
                if None in numbered:
                    for w in words:
                        if w not in ids:
                            ids[w] = next(numbers)
                    numbered = [get(w) for w in words]
                parts.append(np.array(numbered, np.int32))
            lengths.append(np.array(sizes, np.int64))
            docs.append(named)
            base += len(named)
    docs = np.concatenate(docs) if docs else np.empty((0, 2), np.int64)
    if parts:
        lengths = np.concatenate(lengths)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        found = repeated(np.concatenate(parts), lengths, window)
        string = np.searchsorted(first, found, side="right") - 1
        new = np.concatenate([[True], (np.diff(found) > window) | (np.diff(string) > 0)])[: len(found)]
        if len(found):
            heads = np.flatnonzero(new)
            tails = np.concatenate([heads[1:], [len(found)]]) - 1
            string = string[heads]
            shift = np.concatenate(begin)[string] - first[string]
            out.append(np.stack([np.concatenate(owner)[string], found[heads] + shift, found[tails] + window + shift], axis=1))
    spans = np.concatenate(out) if out else np.empty((0, 3), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    used, at = np.unique(spans[:, 0], return_index=True)
    packed = [x.astype("<i4").tobytes() for x in np.split(np.ascontiguousarray(spans[:, 1:]), at[1:])] if len(used) else []
    return pa.table({"doc_id": pa.array(docs[used, 0]), "text_key": pa.array(docs[used, 1]), "spans": pa.array(packed, pa.binary())})


def _frequent(rows: DataFrame, mmer: int, total: int) -> np.ndarray:
    """A table of marks: m-mers that many of a bounded sample of rows have (and a few that share a place with them)."""

    def own(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(mmers(words_of(text), mmer)).view(np.int64))], ["m"])

    share = max(1, total // SAMPLE)
    seen = rows.where(F.pmod("text_key", F.lit(share)) == 0).select("text").mapInArrow(own, "m long").groupBy("m").count()
    told = seen.where(F.col("count") >= max(3, int(FREQUENT * total / share))).orderBy(F.desc("count"), "m").limit(TOLD).collect()
    late = np.zeros(1 << 22, np.uint64)
    late[np.array([r[0] for r in told], np.int64).view(np.uint64) & np.uint64(len(late) - 1)] = 1
    return late


def repeated_spans(docs: DataFrame, window: int = WINDOW, mmer: int = MMER, buckets: int | None = None, block_bytes: int = 24_000_000) -> DataFrame:
    """doc_id, text_key, spans (int32 pairs of words, one binary a bucket) of documents with repeated windows.

    Windows in a row that share their first m-mer travel as one string; the m-mer's hash chooses the bucket, so equal
    windows meet there. A task sends equal strings once, and answers for their copies itself: a group of copies reaches
    a bucket at most once a task and block, however large it is. m-mers that many texts share come last, so a line that
    is in a third of all texts draws no windows but those that lie inside it, and these are few. `buckets` follows from
    the bytes of the texts; a bucket beyond PASS_WINDOWS is counted in several passes over its word numbers.
    """
    # a null id is written as the least long; its rows are joined by text_key alone
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), common.text_key().alias("text_key"), "text")
    total, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = buckets or max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    late = _frequent(rows, mmer, total)
    blocks = rows.mapInArrow(lambda it: _split(it, buckets, window, mmer, block_bytes, late), BLOCK)
    return blocks.groupBy("bucket").applyInArrow(lambda key, t: _count(key, t, window), SPANS)


def with_spans(docs: DataFrame, **options) -> DataFrame:
    """docs and _loom_packed: the list of its packed spans, null where it has none."""
    found = repeated_spans(docs, **options).groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("_loom_packed"))
    found = found.withColumnsRenamed({"doc_id": "_loom_doc", "text_key": "_loom_key"})
    on = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == F.col("_loom_doc")) & (common.text_key() == F.col("_loom_key"))
    return docs.join(found, on, "left").drop("_loom_doc", "_loom_key")


def covered(packed: list[bytes] | None, n: int) -> np.ndarray:
    """Which of n words the spans cover."""
    if not packed:
        return np.zeros(n, bool)
    pairs = np.frombuffer(b"".join(packed), "<i4").reshape(-1, 2)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, pairs[:, 0], 1)
    np.add.at(depth, pairs[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def _report(batches):
    for batch in batches:
        total, gone, digests = [], [], []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("_loom_packed").to_pylist(), strict=True):
            words = words_of(text)
            drop = covered(packed, len(words))
            if drop.any():
                keep = np.flatnonzero(~drop).tolist()
                kept = [words[i] for i in keep]
            else:
                kept = words
            total.append(len(words))
            gone.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs: words under a window that starts anywhere else too are removed.

    Words are runs of bytes other than space and 0x09 to 0x0D. Null, empty and blank texts have no words; texts shorter
    than a window lose nothing. A very long text is held whole, with some 100 bytes a word, in the task that reads it.
    Repeated rows are copies of each other. Rows with a null doc_id are kept. An empty table gives no rows; other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_spans(rows, **options).mapInArrow(_report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _merged(packed: list[bytes] | None) -> list[int]:
    if not packed:
        return []
    pairs = np.frombuffer(b"".join(packed), "<i4").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])
    return np.stack([pairs[new, 0], ends[last]], axis=1).ravel().tolist()


def remove(docs: DataFrame, **options) -> DataFrame:
    """docs with those words cut from text (what stands between kept words stays) and n_chars counted anew where docs has it."""
    return cut_spans(with_spans(docs, **options).withColumnRenamed("_loom_packed", "_loom_spans"), docs.schema, WORD_BYTES, _merged)
