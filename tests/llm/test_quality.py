"""The quality classifier's parts against plain-Python versions, and its query on held-out labels."""

import math
import zlib

import numpy as np
import pytest

from corpusloom.llm import common, labelled, quality, registry


def test_indicators_read_words_and_letters():
    plain = quality.indicators("the quick brown fox jumps over it. fine day")
    rude = quality.indicators("you dumb vile idiot trash over it. fine day")
    assert len(np.setxor1d(plain, rude)) > 20
    assert len(quality.indicators(None)) == len(quality.indicators("")) == 0
    assert set(quality.indicators("one two")) <= set(quality.indicators("zero one two three"))
    word = "x" * 5_000_000  # one token longer than a piece
    assert len(quality.indicators(word)) > 0
    pieces = "alpha beta " * 300_000  # pairs across a cut are the same pairs
    assert set(quality.indicators(pieces)) == set(quality.indicators("alpha beta " * 50))


def test_log_count_ratios():
    rows = [np.array(x) for x in ([5, 9], [5], [5, 7], [7], [7], [9])]
    good = np.array([True, True, True, False, False, False])
    ratio = quality.log_count_ratios(rows, good)
    assert ratio[5] == pytest.approx(math.log((4 / 4) / (1 / 4)))
    assert ratio[7] == pytest.approx(math.log((2 / 4) / (3 / 4)))
    assert ratio[9] == 0.0 and ratio[1] == 0.0  # two rows, and none


def test_hinge_reaches_the_optimum():
    """The objective of dual coordinate descent against plain subgradient steps on the same loss."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(80)]
    good = np.array([(5 in x) ^ (rng.random() < 0.1) for x in rows])
    ratio = np.zeros(1 << quality.BITS)
    ratio[:12] = rng.normal(size=12)
    cost = 0.5
    cap = cost * 0.5 / np.where(good, good.mean(), 1 - good.mean())

    def objective(w, b):
        margins = np.array([(w[x] * ratio[x]).sum() + b for x in rows])
        return 0.5 * (w @ w + b * b) + (cap * np.maximum(0, 1 - np.where(good, 1, -1) * margins)).sum()

    scaled, offset = quality.hinge(rows, good, ratio, cost, rounds=300)
    w = np.divide(scaled, ratio, out=np.zeros_like(scaled), where=ratio != 0)
    best, v, b = math.inf, np.zeros_like(ratio), 0.0
    for step in range(1, 4000):
        gw, gb = v.copy(), b
        for x, y, c in zip(rows, good, cap, strict=True):
            s = 1 if y else -1
            if s * ((v[x] * ratio[x]).sum() + b) < 1:
                gw[x] -= c * s * ratio[x]
                gb -= c * s
        v, b = v - gw / step, b - gb / step
        best = min(best, objective(v, b))
    assert objective(w, offset) <= best * 1.001


def test_sample_is_bounded_by_ids_that_repeat(spark):
    docs = spark.createDataFrame([(1, "same")] * 300 + [(1, "other")] * 300 + [(2, "two"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (4, 1)], "doc_id long, quality int")
    rows, weights = labelled.sample(docs, labels, "quality", 4, 9, per_class=10)
    got = sorted((r["doc_id"], r["label"]) for r in rows.collect())
    assert got == [(1, 1), (2, 0), (4, 0), (4, 1)] and set(weights) == {0, 1}


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    got = registry.op2_quality(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in common.table(spark, sf, "documents").select("doc_id").collect())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95
