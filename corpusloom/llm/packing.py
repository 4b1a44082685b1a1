"""Hierarchical multi-length packing of tokenised documents into context windows."""

from __future__ import annotations

import base64
import bisect
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Context-size tiers, shortest first; every window of a tier is filled to its last token.
TIERS = (256, 512, 1024, 2048)
#: Id that ends every document.
END = 1

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


def encoder(path: str):
    """Text to ids as the tokenizers library gives them for the vocabulary file at `path` (its tiktoken twin, which
    gives the same ids several times faster, where the file has one beside it)."""
    import os

    twin = path.removesuffix(".json") + ".tiktoken"
    if path.endswith(".json") and os.path.exists(twin):
        import public_tokenizers
        import tiktoken

        with open(twin, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        # text that spells the special token is that token, as in the tokenizers library
        return lambda text: own.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class _Packer:
    """Packs one task's documents. State: the open tails of each tier (below `pool` in number) and two counters."""

    def __init__(self, part: int, tiers, pool: int, step_tokens: int):
        self.tiers, self.pool, self.step_tokens = tuple(sorted(tiers)), pool, step_tokens
        self.next_id, self.next_step = part << 40, part << 40
        self.tails: list[tuple] = []
        self.rows: list[list] = []
        self.closed: list[tuple[int, int, int]] = []  # (tokens, first row, last row) of sequences without a step yet

    def close(self, pieces) -> None:
        """One sequence from (doc_id, start, ids, doc_tokens) pieces."""
        at, size = 0, sum(len(p[2]) for p in pieces)
        tier = next((t for t in self.tiers if t >= size), self.tiers[-1])
        self.closed.append((size, len(self.rows), len(self.rows) + len(pieces)))
        for doc, start, ids, total in pieces:
            crc = zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
            self.rows.append([doc, start, len(ids), crc, total, self.next_id, at, tier, None])
            at += len(ids)
        self.next_id += 1

    def deal(self) -> None:
        """Step groups for the sequences closed so far: longest first, each to the group whose attention costs least (the
        squares of its sequences' lengths) and that has room. Lengths are powers of two, so room is never split."""
        groups = [(0, 0, g) for g in range(-(-sum(c[0] for c in self.closed) // self.step_tokens))]  # (cost, tokens, group)
        for size, a, b in sorted(self.closed, key=lambda c: (-c[0], c[1])):
            full = []
            while groups and groups[0][1] + size > self.step_tokens:
                full.append(heapq.heappop(groups))
            cost, tokens, group = heapq.heappop(groups) if groups else (0, 0, len(full))
            for row in self.rows[a:b]:
                row[8] = self.next_step + group
            for g in full:
                if g[1] < self.step_tokens:
                    heapq.heappush(groups, g)
            heapq.heappush(groups, (cost + size * size, tokens + size, group))
        self.next_step += -(-sum(c[0] for c in self.closed) // self.step_tokens)
        self.closed = []

    def add(self, doc, ids: np.ndarray) -> None:
        """Full windows of the longest tier at once; what is left is routed to a tier by its length."""
        top, total = self.tiers[-1], len(ids)
        for start in range(0, total - top + 1, top):
            self.close([(doc, start, ids[start : start + top], total)])
        if total % top:
            start = total - total % top
            self.tails.append((doc, start, ids[start:].copy(), total))
        if len(self.tails) >= self.pool:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        """Fill windows tier by tier, longest first: a tail opens its window, shorter tails close its gap. The largest
        that fits goes whole; where none fits, the smallest is cut to the gap."""
        tails = sorted(self.tails, key=lambda t: len(t[2]))
        sizes = [len(t[2]) for t in tails]
        self.tails = []
        while tails:
            opened = tails.pop()
            size = sizes.pop()
            window = next((t for t in self.tiers if t >= size), self.tiers[-1])
            pieces, gap = [opened], window - size
            while gap and tails:
                k = bisect.bisect_right(sizes, gap)
                if k:
                    pieces.append(tails.pop(k - 1))
                    gap -= sizes.pop(k - 1)
                    continue
                doc, start, ids, total = tails.pop(0)
                sizes.pop(0)
                pieces.append((doc, start, ids[:gap], total))
                rest = (doc, start + gap, ids[gap:], total)
                at = bisect.bisect_left(sizes, len(rest[2]))
                tails.insert(at, rest)
                sizes.insert(at, len(rest[2]))
                gap = 0
            if not gap:
                self.close(pieces)
            elif last:
                self.finish(pieces)
            else:
                self.tails = pieces

    def finish(self, pieces) -> None:
        """The task's last tokens: windows of falling powers of two, so that even these need no padding."""
        while pieces:
            room = 1 << (sum(len(p[2]) for p in pieces).bit_length() - 1)
            taken, rest = [], []
            for doc, start, ids, total in pieces:
                if room:
                    taken.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], total))
                room = max(0, room - len(ids))
            self.close(taken)
            pieces = rest

    def flush(self) -> pa.RecordBatch:
        self.deal()
        columns, self.rows = list(zip(*self.rows, strict=True)) or [()] * 9, []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def _pack(batches, path: str, tiers, pool: int, step_tokens: int):
    encode, packer = encoder(path), None
    for batch in batches:
        for part, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
            packer = packer or _Packer(part, tiers, pool, step_tokens)
            packer.add(doc, np.array([*encode(text or ""), END], dtype=np.uint32))
            if len(packer.rows) > 20_000:
                yield packer.flush()
    if packer:
        packer.pack(last=True)
        yield packer.flush()


def pack(docs: DataFrame, tokenizer: str, tiers=TIERS, pool: int = 4096, step_tokens: int = 16 * 2048) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Documents are cut freely; each id is in one piece. Full windows of the longest tier come first; the rest of each
    document is routed to the smallest tier that holds it, opens a window there, and gaps are filled from shorter
    tiers. Each sequence fills its tier (a power of two), but for a task's last ones, which are smaller powers of two:
    no padding anywhere. step_group deals some thousands of sequences at a time into groups of at most `step_tokens`
    tokens that mix all tiers: the groups of one deal hold nearly the same tokens and cost nearly the same attention.
    Packing is local to the tasks that read the documents: token ids never travel, a source or a group of copies weighs
    what its text weighs, and a task holds at most `pool` tails. sequence_id and step_group begin with the task's
    number, so a lost task gives the same rows again.
    Null and empty texts are a document of one id (the end). A very long text is encoded whole in its task and cut into
    full windows at once. Of tails of one length the order of arrival decides. A null doc_id is kept; repeated rows are
    packed each.
    An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _pack(it, tokenizer, tiers, pool, step_tokens), SCHEMA)
