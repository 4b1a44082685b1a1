"""Pieces with offsets, pivot-table clustering and importance resampling against the library, SQL and plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from corpusloom.llm import centroids, common, importance, pieces, registry

from . import brute
from .test_operators import SCHEMA, bag, docs, nothing, rows  # noqa: F401

MODEL = registry.tokenizer_path("piece_bpe_32k.model")
ODD = ["", "  ", "\t\n x", "a▁b ▁▁ c", "   lead  trail  ", "é😀日本語 텍스트", "x" * 3000, "日本" * 900, "\x00a", "<s></s><0x41>", "½²ｆｕｌｌ ａ  ﬁ", "１２３", "è", "　wide nb  ​ z", "㈱ ㍿", "a\r\nb", "ⅣⅣ Ⅳ  Ⅳ"]


def against_library(path, texts):
    """ids and byte spans of each text equal the library's."""
    own, library = pieces.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in texts:
        ids, begins, ends = own.encode(text)
        want = library.encode(text, return_type="proto").pieces
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == [(p.id, p.begin, p.end) for p in want], text[:50]
        assert ids.tolist() == library.encode(text)


def variant(tmp_path, change, name="other.model"):
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(Path(MODEL).read_bytes())
    change(model)
    (tmp_path / name).write_bytes(model.SerializeToString())
    return str(tmp_path / name)


def test_pieces_equal_the_library(spark, sf):
    against_library(MODEL, ODD + [r["text"] for r in common.table(spark, sf, "documents").collect()])


@pytest.fixture(scope="module")
def charsmap():
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    return model.normalizer_spec.precompiled_charsmap


@pytest.mark.parametrize("squeeze", [False, True])
def test_pieces_under_a_character_map(spark, sf, tmp_path, charsmap, squeeze):
    def change(model):
        model.normalizer_spec.precompiled_charsmap, model.normalizer_spec.remove_extra_whitespaces = charsmap, squeeze

    texts = [r["text"] for r in common.table(spark, sf, "documents").limit(60).collect()]
    against_library(variant(tmp_path, change), ODD + texts)


def test_character_map_rules(charsmap):
    found = pieces.rules(charsmap)
    assert found["ﬁ"] == "fi" and found["㍿"] == "株式会社" and found["\t"] == " " and found["è"] == "è" and len(found) > 200_000
    assert pieces.rules(b"") == {}


def test_pieces_of_other_models(tmp_path):
    def symbols(model):  # a piece that is always kept, and pieces that are taken apart again
        model.pieces[500].type, model.pieces[700].type, model.pieces[310].type = 4, 5, 5

    def no_bytes(model):
        model.trainer_spec.byte_fallback, model.trainer_spec.treat_whitespace_as_suffix = False, True
        for p in model.pieces:
            p.type = 1 if p.type == 6 else p.type

    texts = [*ODD, "the user under U the </ tag", "é" * 5 + "日本語 텍스트 x"]
    against_library(variant(tmp_path, symbols), texts)
    against_library(variant(tmp_path, no_bytes, "suffix.model"), texts)


def test_encode_and_decode(docs, rows, nothing):  # noqa: F811
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = pieces.encode(docs, MODEL)
    got = bag((r["doc_id"], tuple(r["ids"])) for r in encoded.collect())
    assert got == bag((r[0], tuple(library.encode(r[1] or ""))) for r in rows)
    assert bag(pieces.decode(encoded, MODEL).collect()) == bag((r[0], library.decode(library.encode(r[1] or "")) if r[1] else "") for r in rows)
    # spans are the text's own bytes, in order, without gaps
    for r in encoded.join(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").where("doc_id <> 8").collect():
        raw = (r["text"] or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r["begins"], r["ends"], strict=True)) == raw
    assert pieces.encode(nothing, MODEL).count() == pieces.report(nothing, MODEL).count() == pieces.decode(pieces.encode(nothing, MODEL), MODEL).count() == 0


def test_pieces_query(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in common.table(spark, sf, "documents").collect():
        ids = library.encode(r["text"] or "")
        want.add((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    got = registry.op11_pieces(spark, sf).collect()
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    assert all(r["covered_bytes"] == r["n_bytes"] for r in got)


def lloyd(vectors, k, rounds, seed, scale, dim):
    """{row: (cluster, distance)} and centroids, in plain Python integers."""
    kept = [(v, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(float(x) * scale))) for x in e]) for v, e in vectors if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda p: (hashlib.sha256(f"{seed}:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))
    place = [list(q) for _, q in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(place)) for _, q in kept]

    for _ in range(rounds):
        label = [j for _, j in assign()]
        for j in set(label):
            own = [q for (_, q), i in zip(kept, label, strict=True) if i == j]
            place[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    sums = Counter()
    for d, j in found:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in place]
    held = lambda x: x if x < 1 << 63 else None
    return Counter((v, j, d, held(sums[j]), held(sum(sums.values())), sha[j]) for (v, _), (d, j) in zip(kept, found, strict=True))


def vectors(spark, rows):  # noqa: F811
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("cluster", F.lit("clash")).withColumn("q", F.lit(1))


def test_centroids_on_odd_vectors(spark):
    rng = np.random.default_rng(3)
    made = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8]) for i in range(120)]  # many ties
    made += made[:9] + [(None, made[3][1]), (None, made[4][1]), (200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 0.0, 0.0, 0.0]), (205, [float("inf"), 0.0, 0.0, 0.0])]
    made += [(7, [0.0] * 4), (300, [1e30, -1e30, 0.0, 5e-5])]
    for k in (1, 5, 500):
        got = centroids.cluster(vectors(spark, made), k, 4, dim=4, pivots=3).drop("measured").collect()
        assert Counter(map(tuple, got)) == lloyd(made, k, 4, centroids.SEED, centroids.SCALE, 4)


def test_centroids_of_nothing(spark):
    for rows_ in ([], [(1, None)]):
        got = centroids.cluster(vectors(spark, rows_) if rows_ else spark.createDataFrame([], "vec_id long, embedding array<float>"), dim=4)
        assert got.count() == 0 and "centroid_sha256" in got.columns


def test_an_empty_cluster_keeps_its_centroid(spark):
    made = [(i, [1.0, 2.0]) for i in range(30)] + [(99, [9.0, 9.0])]
    got = centroids.cluster(vectors(spark, made), 6, 3, dim=2).drop("measured").collect()
    assert Counter(map(tuple, got)) == lloyd(made, 6, 3, centroids.SEED, centroids.SCALE, 2)


def test_pivots_rule_centroids_out():
    """The bound never costs the nearest centroid, and where clusters are apart most centroids are not measured."""
    rng = np.random.default_rng(4)
    middle = rng.integers(-2000, 2000, (40, 64))
    data = middle[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 64))
    fixed = centroids.choose(data[:500], 8)
    label, distance, measured = centroids.nearest(data, centroids._to_pivots(data, fixed), middle, centroids._to_pivots(middle, fixed))
    every = ((data[:, None] - middle[None]) ** 2).sum(axis=2)
    assert (label == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and measured < 2 * len(data)


def test_checksums_column_by_column():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 100):
        block = rng.integers(0, 256, (50, size), dtype=np.uint8)
        assert importance.crc_columns(block).tolist() == [zlib.crc32(r.tobytes()) for r in block]


def resampled(docs, target, run=1, buckets=importance.BUCKETS, seed=importance.SEED, percent=importance.PERCENT, least=importance.LEAST):  # noqa: F811
    """{(doc_id, n_features, weight, score, rank, n_words): count} in plain Python; ties of all columns as one."""

    def features(text):
        w = brute.WORDS.findall(brute.lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(w) - k + 1)]

    found = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, fs in found for b in fs), Counter(b for text in target for b in features(text)[1])
    total, aim = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (aim + buckets))))
    out = []
    for d, n, fs in found:
        weight = sum(map(gain, fs)) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2], r[4]))
    drawn = able[: percent * len(able) // 100]
    rest = Counter(out) - Counter(drawn)
    return Counter((*r[:4], n, r[4]) for n, r in enumerate(drawn, 1)) + Counter({(*r[:4], None, r[4]): c for r, c in rest.items()})


@pytest.mark.parametrize(("run", "percent", "least"), [(1, 10, 20), (3, 55, 1), (2, 100, 0)])
def test_resampling_of_odd_texts(spark, docs, rows, nothing, run, percent, least):  # noqa: F811
    target = [(1, rows[8][1]), (2, None), (3, ""), (4, "mit license é")]
    aim = spark.createDataFrame(target, "item_id long, text string")
    got = Counter(map(tuple, importance.report(docs, aim, run=run, percent=percent, least=least).collect()))
    assert got == resampled([r[:2] for r in rows], [t for _, t in target], run, percent=percent, least=least)
    drawn = {r["doc_id"] for r in importance.report(docs, aim, run=run, percent=percent, least=least).where("rank is not null").collect()}
    kept = importance.resample(docs, aim, run=run, percent=percent, least=least)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == drawn


def test_resampling_of_nothing(docs, nothing):  # noqa: F811
    assert importance.report(nothing, nothing).count() == 0
    got = importance.report(docs, nothing).collect()  # without a target all gains stem from smoothing alone
    assert len(got) == docs.count() and all(r["weight"] is not None for r in got)


def test_block_borders_change_nothing(rows, monkeypatch):  # noqa: F811
    want = importance._features(importance.pa.array([r[1] for r in rows]), 2, 1000)
    batch = importance.pa.record_batch({"doc_id": importance.pa.array([r[0] for r in rows]), "text": importance.pa.array([r[1] for r in rows])})
    monkeypatch.setattr(importance, "BLOCK_BYTES", 300)
    parts = [importance._features(b.column("text"), 2, 1000) for b in importance._blocks([batch])]
    assert len(parts) > 10 and np.concatenate([p[0] for p in parts]).tolist() == want[0].tolist()
    assert Counter(np.concatenate([p[2] for p in parts]).tolist()) == Counter(want[2].tolist())


@pytest.mark.parametrize("name", ["op12_centroids", "op13_importance"])
def test_query_matches_its_oracle(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(sf) / table}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = getattr(registry, name)(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(found.fetchall())


def test_importance_query_equals_plain_python(spark, sf):
    docs_ = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").collect()]
    items = [r["text"] for r in common.table(spark, sf, "benchmark").collect()]
    assert Counter(map(tuple, registry.op13_importance(spark, sf).collect())) == resampled(docs_, items)


def test_centroids_query_equals_plain_python(spark, sf):
    made = [(r["vec_id"], r["embedding"]) for r in common.table(spark, sf, "embeddings").collect()]
    want = lloyd(made, centroids.CENTROIDS, centroids.ROUNDS, centroids.SEED, centroids.SCALE, centroids.DIM)
    assert Counter(map(tuple, registry.op12_centroids(spark, sf).collect())) == want


def test_word_pattern_is_the_contract_s():
    assert re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "a-b é9_") == ["a", "b", "é9"]
    assert importance.IN_WORD.sum() == 10 + 26 + 128
