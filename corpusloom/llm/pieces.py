"""SentencePiece encoding that keeps offsets: every piece is projected to the bytes of the text that it came from."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character that stands for a space in pieces.
SPACE = "▁"
#: Kinds of pieces in a model file that are treated apart (fixed values of the format).
USER_DEFINED, BYTE = 4, 6

ENCODED = "doc_id long, ids array<int>, begins array<long>, ends array<long>"
REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, covered_bytes long, spans_crc32 long"


def rules(charsmap: bytes) -> dict[str, str]:
    """Source to replacement of every rule of a compiled character map: four bytes with the trie's size, a double-array
    trie over source bytes, and the replacements, each ended by a zero byte. The trie is walked once, breadth first."""
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units, texts = np.frombuffer(charsmap[4 : 4 + size], "<u4").astype(np.int64), charsmap[4 + size :]

    def jump(unit):
        return (unit >> 10) << ((unit & 0x200) >> 6)

    found, symbols = {}, np.arange(256)
    open_nodes = [(int(jump(units[0])), b"")]
    while open_nodes:
        base, prefix = open_nodes.pop()
        at = base ^ symbols
        inside = at < len(units)
        children = symbols[inside][(units[at[inside]] & 0x800000FF) == symbols[inside]]
        for symbol in children.tolist():
            unit = int(units[base ^ symbol])
            child, source = (base ^ symbol) ^ jump(unit), prefix + bytes([symbol])
            if unit >> 8 & 1:
                start = int(units[child]) & 0x7FFFFFFF
                found[source.decode()] = texts[start : texts.index(b"\0", start)].decode()
            open_nodes.append((child, source))
    return found


def byte_offsets(text: str) -> np.ndarray:
    """Where each character of text starts in its UTF-8 bytes, and the length."""
    if text.isascii():
        return np.arange(len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return np.concatenate([[0], np.cumsum(width)])


class Encoder:
    """One model: normalises a text with alignment, has its pieces merged, and names the original bytes of each."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.library = SentencePieceProcessor(model_proto=model.SerializeToString())
        spec, train = model.normalizer_spec, model.trainer_spec
        self.space = SPACE if spec.escape_whitespaces else " "
        self.prefix = spec.add_dummy_prefix and not train.treat_whitespace_as_suffix
        self.suffix = spec.add_dummy_prefix and train.treat_whitespace_as_suffix
        self.squeeze = spec.remove_extra_whitespaces
        self.unknown = train.unk_id
        # user-defined symbols are kept whole and go before the character map's rules
        own = {p.piece for p in model.pieces if p.type == USER_DEFINED}
        mapped = rules(spec.precompiled_charsmap)
        self.replacement = mapped | {p: p for p in own}
        # a regular expression tries alternatives in order: the first that matches is the longest
        ordered = [p for p in (self._any_of(own), self._any_of(mapped)) if p]
        self.rule = re.compile("|".join(ordered)) if ordered else None
        # characters that an id stands for; a byte piece none but the last of its character's
        self.width = np.array([len(p.piece) for p in model.pieces])
        self.byte = np.full(len(model.pieces), -1)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[i] = int(p.piece[3:5], 16)
        # the same pieces and scores, with nothing left to normalise: what it reads is normalised already
        spec.precompiled_charsmap, spec.remove_extra_whitespaces, spec.add_dummy_prefix = b"", False, False
        self.merger = SentencePieceProcessor(model_proto=model.SerializeToString())

    @staticmethod
    def _any_of(words):
        """A pattern for the longest of these words, by first character so that a text is passed over quickly."""
        if not words:
            return None
        by_first: dict[str, list[str]] = {}
        for w in sorted(words, key=len, reverse=True):
            by_first.setdefault(w[0], []).append(w[1:])
        alone = "".join(re.escape(c) for c, rest in by_first.items() if rest == [""])
        parts = [f"{re.escape(c)}(?:{'|'.join(map(re.escape, rest))})" for c, rest in by_first.items() if rest != [""]]
        return "|".join(parts + ([f"[{alone}]"] if alone else []))

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the byte of the text where it comes from."""
        if not text:
            return "", np.zeros(1, np.int64)
        at = byte_offsets(text)
        if self.rule is None and not self.squeeze:
            norm, origin = text.replace(" ", self.space), at
        else:
            norm, origin = self._mapped(text, at)
            if not norm:
                return "", origin
        if self.prefix:
            norm, origin = self.space + norm, np.concatenate([origin[:1], origin])
        if self.suffix:
            norm, origin = norm + self.space, np.concatenate([origin, origin[-1:]])
        return norm, origin

    def _mapped(self, text: str, at: np.ndarray) -> tuple[str, np.ndarray]:
        """Rules applied longest prefix first; runs of spaces squeezed where the model says so."""
        parts, origins, after_space, done = [], [], self.squeeze, 0

        def add(chunk: str, origin: np.ndarray):
            nonlocal after_space
            if chunk:
                parts.append(chunk)
                origins.append(origin)
                after_space = self.squeeze and chunk.endswith(" ")

        def plain(start: int, end: int):
            """Characters that no rule touches; each is a chunk of its own, so a space goes where one stands before it."""
            run = text[start:end]
            if self.squeeze and " " in run:
                blank = np.frombuffer(run.encode("utf-32-le"), "<u4") == 32
                keep = ~(blank & np.concatenate([[after_space], blank[:-1]]))
                run = "".join(c for c, k in zip(run, keep.tolist(), strict=True) if k)
                add(run, at[start:end][keep])
            else:
                add(run, at[start:end])

        for m in self.rule.finditer(text) if self.rule else ():
            plain(done, m.start())
            chunk = self.replacement[m.group()]
            chunk = chunk.lstrip(" ") if after_space else chunk
            add(chunk, np.full(len(chunk), at[m.start()]))
            done = m.end()
        plain(done, len(text))
        norm, origin = "".join(parts).replace(" ", self.space), np.concatenate([*origins, at[-1:]])
        if self.squeeze:
            kept = len(norm.rstrip(self.space))
            norm, origin = norm[:kept], origin[: kept + 1]
        return norm, origin

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first and end byte of each in the text."""
        norm, origin = self.normalise(text or "")
        ids = np.asarray(self.merger.encode(norm), np.int32)
        if (ids == self.unknown).any():  # characters without a piece and without bytes: a run of them is one id
            width = np.array([len(p) for p in self.merger.encode(norm, out_type=str)])
        else:
            width, byte = self.width[ids], self.byte[ids]
            if (byte >= 0).any():
                # a character's bytes end where no continuation byte follows
                follows = np.concatenate([(byte[1:] & 0xC0) == 0x80, [False]]) & (np.concatenate([byte[1:], [-1]]) >= 0)
                width = np.where(byte >= 0, ~follows, width)
        ends = np.cumsum(width, dtype=np.int64)
        return ids, origin[ends - width], origin[ends]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The model's encoder, read once a worker process."""
    return Encoder(path)


def _encode(batches, model: str):
    own = encoder(model)
    for batch in batches:
        # a few rows at a time, so that a batch of long texts never has all its ids in memory
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            found = [own.encode(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([f[0] for f in found], pa.list_(pa.int32())), *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (1, 2))],
                ["doc_id", "ids", "begins", "ends"],
            )


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins, ends of every row of docs (doc_id, text) under the model file at `model`.

    The text is normalised by the model's compiled character map: at each place the longest source of a rule is replaced,
    spaces are marked (and squeezed where the model says so), and each normalised character keeps the byte of the text
    that it came from. The library merges pieces in the normalised text (by a twin of the model that normalises nothing), and begins[k] to ends[k] are the bytes of the text (UTF-8)
    that id k stands for. A character that is spelled by byte pieces belongs to the last of them; the others are empty,
    as is the mark put before a text. ids equal the sentencepiece library's, without begin or end ids.
    One map pass: nothing is shuffled, nothing is collected. Null and empty texts have no ids. Very long texts are encoded
    whole. Repeated rows and null ids are kept; an
    empty table gives no rows; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _encode(it, model), ENCODED)


def _decode(batches, model: str):
    library = encoder(model).library
    for batch in batches:
        texts = [library.decode([i for i in ids if i is not None]) if ids else "" for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of every row of encoded (doc_id, ids). Null or empty ids give an empty text; null members are passed
    over; an id that the model doesn't have is an error of the library's. Other columns are ignored."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lambda it: _decode(it, model), "doc_id long, text string")


def _report(batches, model: str):
    own = encoder(model)
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids, begins, ends = own.encode(text)
            listed = ids.tolist()
            decoded = own.library.decode(listed) if listed else ""
            crc = zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(begins.astype("<i8").tobytes()))
            rows.append((doc, len(ids), hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), len((text or "").encode()), int((ends - begins).sum()), crc))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        fields = [f.split() for f in REPORT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, covered_bytes, spans_crc32 of every row: encode() and
    decode() in one pass, so that no ids leave the task. covered_bytes adds up the lengths of the spans: it equals n_bytes
    where every byte of the text belongs to exactly one piece. spans_crc32 is that of all begins, then all ends, as
    little-endian 64-bit integers. Rows as in encode()."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _report(it, model), REPORT)
