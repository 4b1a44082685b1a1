"""Vector functions: quantisation, cosine, distances, and a deterministic embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantize_i8(vector: Column) -> Column:
    """x * 128 rounded half away from zero and clamped to [-128, 127], as bytes."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.round(x.cast("double") * 128))).cast("tinyint"))


def _quantized(rows: np.ndarray) -> np.ndarray:
    """The same for rows of single floats in a task: halves are exact there, so adding one and cutting rounds away from zero."""
    wide = np.nan_to_num(rows.astype(np.float64) * 128, nan=127, posinf=127, neginf=-128)
    return np.clip(np.trunc(wide + np.copysign(0.5, wide)), -128, 127).astype(np.int8)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0, an error where lengths differ."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length")).isNull()
    return F.when(same & (norm(a) * norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two int8 vectors, from exact integer sums."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("int") - y.cast("int")) * (x.cast("int") - y.cast("int"))), F.lit(0), lambda t, v: t + v)
    return F.sqrt(total.cast("double"))


#: Words whose places a worker remembers.
WORDS = 1 << 17

Embedder = Callable[[list[str]], np.ndarray]
_EMBEDDERS: dict[str, tuple[int, Callable[[], Embedder]]] = {}


def register_embedder(name: str, dim: int, make: Callable[[], Embedder]) -> None:
    """An embedder by name: `make` is called once a worker process and returns texts -> rows of `dim` floats."""
    _EMBEDDERS[name] = (dim, make)


def register_hashing(dim: int) -> str:
    """The hashing embedder at a dimension, registered under the name that is returned."""
    name = f"hashing-{dim}"
    register_embedder(name, dim, lambda: _hashing(dim))
    return name


def rebuild(chunks: DataFrame, embedder: str, dim: int | None = None, text: str = "content", keep: tuple = ()) -> DataFrame:
    """chunk_id and int8 embedding of all chunks, made anew: for another embedder, or the hashing one at another dimension.
    Columns in keep stay beside them."""
    name = register_hashing(dim) if embedder == "hashing" and dim else embedder
    if dim and _EMBEDDERS[name][0] != dim:
        raise ValueError(f"{name} has dimension {_EMBEDDERS[name][0]}, not {dim}")
    return chunks.select(F.col("id").alias("chunk_id"), embed_i8(F.col(text), name).alias("embedding"), *keep)


def _hashing(dim: int) -> Embedder:
    import re
    import zlib

    class Slots(dict):
        """Of a word, its place and, in the lowest bit, its sign; words that come again are not hashed again."""

        def __missing__(self, word: bytes) -> int:
            if len(self) >= WORDS:
                self.clear()
            h = zlib.crc32(word)
            self[word] = slot = h % dim * 2 + (h >> 31)
            return slot

    ascii_, pattern, slots = bytes(range(128)), re.compile(r"\w+"), Slots()
    blank = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))

    def words(text: str) -> list[bytes]:
        """What the pattern finds, in UTF-8. Where all that isn't ASCII is a letter or a number, other bytes just part words;
        a few other characters become blanks before."""
        raw = text.encode()
        rest = raw.translate(None, ascii_).decode()
        if rest and not rest.isalnum():
            signs = {c for c in rest if not c.isalnum()}
            if len(signs) > 8:
                return " ".join(pattern.findall(text)).encode().split()
            for c in signs:
                raw = raw.replace(c.encode(), b" ")
        return raw.translate(blank).split()

    def embed(texts: list[str]) -> np.ndarray:
        flat, sizes = [], []
        for text in texts:
            found = words((text or "").lower())
            flat += map(slots.__getitem__, found)
            sizes.append(len(found))
        at = np.array(flat, np.int64) + np.repeat(np.arange(len(texts)) * dim * 2, sizes)
        counts = np.bincount(at, minlength=len(texts) * dim * 2).reshape(len(texts), dim, 2)
        out = (counts[:, :, 1] - counts[:, :, 0]).astype(np.float32)
        for row in out:
            length = np.linalg.norm(row)
            if length:
                row /= length
        return out

    return embed


register_embedder("hashing", 384, lambda: _hashing(384))
register_embedder("mock", 384, lambda: lambda texts: np.full((len(texts), 384), 0.1, np.float32))
register_embedder("none", 0, lambda: lambda texts: np.zeros((len(texts), 0), np.float32))


def embed(text: Column, name: str = "hashing", batch: int = 32) -> Column:
    """Embeddings of texts: the model is made once a worker and fed in batches. `none` gives empty vectors."""
    return _embedded(text, name, batch, "array<float>", lambda rows: rows)


def embed_i8(text: Column, name: str = "hashing", batch: int = 32) -> Column:
    """What `quantize_i8` makes of the embeddings, in the tasks that make them."""
    return _embedded(text, name, batch, "array<tinyint>", _quantized)


def _embedded(text: Column, name: str, batch: int, kind: str, given: Callable[[np.ndarray], np.ndarray]) -> Column:
    _, make = _EMBEDDERS[name]

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.fillna("").tolist()
            rows = [r for i in range(0, len(texts), batch) for r in given(model(texts[i : i + batch]))]
            yield pd.Series(rows, index=part.index, dtype=object)

    return run(text)
