"""Target-distribution importance resampling: hashed word runs, gains of the target over the corpus, Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Longest run of words that is a feature, hash buckets, seed of the draw, percentage drawn, fewest words to be drawn.
RUN, BUCKETS, SEED, PERCENT, LEAST = 1, 10_000, 2024, 10, 20
#: Scores that are summed up in one window; their number of cells is some hundreds, whatever the input.
CELL = 128
#: Bytes of text that a task turns into arrays at a time.
BLOCK_BYTES = 4_000_000

SCORED = "doc_id long, n_words long, n_features long, weight long"


def _crc_table() -> np.ndarray:
    """What each byte does to a reflected CRC-32 (polynomial 0xEDB88320)."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


CRC = _crc_table()
#: Every byte with A-Z in lower case, and whether it belongs to a word: a digit, a letter, or part of a longer character.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def crc_columns(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional uint8 array: all rows advance together, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = CRC[(crc ^ column) & 0xFF] ^ crc >> 8
    return ~crc


def hashed(data: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each feature data[start : start + length]. Features of one length are a matrix of bytes; its distinct rows
    are hashed once, and their buckets go back to wherever they occur."""
    out = np.empty(len(start), np.int64)
    if not len(start):
        return out
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, at in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
        step = max(1, BLOCK_BYTES // size)
        for s in range(0, len(at), step):
            some = at[s : s + step]
            matrix = data[start[some, None] + np.arange(size)]
            coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(some), [None, pa.py_buffer(matrix)]).dictionary_encode()
            distinct = np.frombuffer(coded.dictionary.buffers()[1], np.uint8, len(coded.dictionary) * size).reshape(-1, size)
            out[some] = (crc_columns(distinct) % buckets)[coded.indices.to_numpy()]
    return out


def _features(texts: pa.Array, run: int, buckets: int):
    """Of a block of texts: words of each, features of each, and all features' buckets in the texts' order."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = LOWER[raw]
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)  # texts lie side by side: a word ends where its text does
    edge[offsets] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(offsets, begin, side="right") - 1
    words = np.bincount(owner, minlength=len(texts))
    if run > 1:  # words joined by single spaces, so that runs are stretches of it
        size = end - begin
        at = np.concatenate([[0], np.cumsum(size + 1)])
        joined = np.full(int(at[-1]), 32, np.uint8)
        joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside]
        data, begin, end = joined, at[:-1], at[:-1] + size
    found, owners = [], []
    for k in range(1, run + 1):
        first = np.arange(max(0, len(begin) - k + 1))
        first = first[owner[first] == owner[first + k - 1]]
        found.append(hashed(data, begin[first], end[first + k - 1] - begin[first], buckets))
        owners.append(owner[first])
    return words, np.concatenate(owners), np.concatenate(found)


def _blocks(batches):
    """Rows (doc_id, text) in blocks of some bytes; a longer text is a block of its own."""
    for batch in batches:
        size = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(size.buffers()[1], np.int64, len(size) + 1, size.offset * 8)
        s = 0
        while s < batch.num_rows:
            e = max(s + 1, int(np.searchsorted(at, at[s] + BLOCK_BYTES, side="right")) - 1)
            yield batch.slice(s, e - s)
            s = e


def _count(batches, run: int, buckets: int):
    total = np.zeros(buckets, np.int64)
    for block in _blocks(batches):
        _, _, found = _features(block.column("text"), run, buckets)
        total += np.bincount(found, minlength=buckets)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def bucket_counts(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks count their own; the driver gets one row a bucket."""
    rows = docs.select("text").mapInArrow(lambda it: _count(it, run, buckets), "bucket long, n long")
    total = np.zeros(buckets)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / smoothed share in the corpus)) of each bucket."""
    buckets = len(corpus)
    return np.floor(1000 * np.log((target + 1) * (corpus.sum() + buckets) / ((corpus + 1) * (target.sum() + buckets)))).astype(np.int64)


def _weigh(batches, run: int, gain: np.ndarray):
    for block in _blocks(batches):
        words, owner, found = _features(block.column("text"), run, len(gain))
        n = np.bincount(owner, minlength=block.num_rows)
        total = np.zeros(block.num_rows, np.int64)
        np.add.at(total, owner, gain[found])
        weight = total // np.maximum(n, 1)
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])


def weigh(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of docs (doc_id, text): the floored mean gain of its features.

    Features are the runs of 1 to `run` words, joined by one space, hashed by CRC-32. Each task groups the distinct
    features of a block by length into matrices of bytes and advances the checksums of a matrix column by column. Texts
    are read twice (counts, weights) and never shuffled; what travels is one count a task and bucket, and `buckets`
    gains, a bound that doesn't grow with the data.
    """
    gain = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _weigh(it, run, gain), SCORED)


def report(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every row of docs (doc_id, text), drawn towards target (text).

    score adds Gumbel noise, made from a hash of seed and doc_id, to the weight: the `percent` highest scores of the
    documents with at least `least` words are a sample without replacement in proportion to exp(weight / 1000). rank
    counts them from 1, ties to the smaller doc_id; it is null for all others.
    Scores are integers of a narrow range (logarithms), so ranks come from counts a score: these are summed up by cells
    of scores, some hundreds in all, and only rows of one score are ordered among themselves, rows that agree in all
    columns as one. No text and no undrawn row is shuffled for it.
    Null texts are empty: no features, weight 0. Very long texts are read whole, some MB at a time. Repeated rows are
    ranked each; a null doc_id hashes as an empty one and comes first among ties. An empty table gives no rows, an empty
    target no feature; other columns are ignored.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = common.stage(weigh(docs, target, run, buckets).withColumn("score", F.col("weight") + noise), "importance")
    able = F.col("n_words") >= least
    # one row a score: how many score higher (within a cell of scores, and in higher cells), and how many are drawn in all
    counts = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.floor(F.col("score") / CELL))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("cell"))) - F.col("n")
    cells = cells.select(F.col("cell").alias("at"), above.alias("above"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("draws"))
    higher = F.sum("n").over(Window.partitionBy("cell").orderBy(F.desc("score"))) - F.col("n")
    counts = counts.withColumn("higher", higher).join(cells, F.col("cell") == F.col("at")).select("score", "draws", (F.col("above") + F.col("higher")).alias("before"))
    counts = common.stage(counts.where("before < draws"), "importance-counts")
    cut, draws = counts.agg(F.min("score"), F.max("draws")).first()
    columns = ["doc_id", "n_features", "weight", "score", "n_words"]
    drawn = F.coalesce(able & (F.col("score") >= F.lit(cut).cast("long")), F.lit(False))
    same = rows.where(drawn).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    inside = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(counts.select(F.col("score").alias("at"), "before"), F.col("score") == F.col("at"))
    ranked = same.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn"), (F.col("before") + F.col("inside")).alias("upto"))
    place = F.col("upto") + F.col("turn")
    ranked = ranked.select(*columns, F.when(place <= F.lit(draws), place).cast("long").alias("rank"))
    out = ranked.unionByName(rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs (doc_id, text), with all their columns. Columns of docs named like the working ones stay as
    they are. Rows that share a drawn doc_id all stay."""
    drawn = report(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_loom_doc")).distinct()
    return docs.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col("_loom_doc")), "left_semi")


#: DuckDB SQL for report() with its default parameters over documents and benchmark. CRC-32 is taken byte by byte for each
#: distinct word; the table of 256 entries is made by its rule.
ORACLE = f"""
WITH RECURSIVE table_steps AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_steps WHERE k < 8
), crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM table_steps WHERE k = 8),
split AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), uses AS MATERIALIZED (
  SELECT side, r, word, count(*) AS n FROM (SELECT side, r, unnest(words) AS word FROM split) GROUP BY ALL
), spelled AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM uses)
), crcs AS (
  SELECT word, h, 4294967295::BIGINT AS c, 0 AS k FROM spelled
  UNION ALL
  SELECT word, h, xor(t[xor(c & 255, ('0x' || h[2 * k + 1 : 2 * k + 2])::BIGINT) + 1], c >> 8), k + 1 FROM crcs, crc_table WHERE 2 * k < length(h)
), buckets AS MATERIALIZED (
  SELECT word, xor(c, 4294967295) % {BUCKETS} AS bucket FROM crcs WHERE 2 * k = length(h)
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM uses JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS gain FROM counts
), sums AS (
  SELECT r, sum(n * gain)::BIGINT AS total FROM uses JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r
), weighed AS (
  SELECT r, doc_id, len(words) AS n_words, coalesce(floor(total / len(words)), 0)::BIGINT AS weight, ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM split LEFT JOIN sums USING (r) WHERE side = 0
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= {LEAST}) OVER () AS able FROM scored
)
SELECT doc_id, n_words::BIGINT AS n_features, weight, score, CASE WHEN n_words >= {LEAST} AND place <= {PERCENT} * able // 100 THEN place END AS rank, n_words::BIGINT AS n_words FROM ranked
"""
