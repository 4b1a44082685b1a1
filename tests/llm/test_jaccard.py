"""The pipeline's near-dedup stage against brute-force Jaccard similarity."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom.llm import common, jaccard

from . import brute


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = [None, "", " \n", "one two", "One  TWO", "a b c d", "a b c d e", "a b c d e f"]
    boiler = " ".join(f"b{i}" for i in range(30))
    for k in range(12):  # families around 0.8, each text with a passage that all share
        words = [f"w{k}_{i}" for i in range(int(rng.integers(8, 250)))]
        for edits in (0, 0, 1, 2, 3, 5, 8):
            w = list(words)
            for at in rng.integers(0, len(w), edits):
                w[at] = f"x{rng.integers(1 << 40)}"
            out.append(" ".join(w) + " " + boiler)
    for n in (20, 21, 24, 25, 26, 29, 30):  # at the border: the first n words of one text
        out.append(" ".join(f"c{i}" for i in range(n)))
    return [*enumerate(out), (3, "another text of id three"), (None, boiler), (None, boiler), (9, out[9])]


def test_near_duplicates(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    comp = brute.jaccard_components({i: t for i, (_, t) in enumerate(rows)})
    low = {}
    for i, c in comp.items():
        if rows[i][0] is not None:
            low[c] = min(low.get(c, 1 << 60), rows[i][0])
    want = Counter((d, low.get(comp[i])) for i, (d, _) in enumerate(rows))
    assert 20 < len(low) < len(rows) - 20
    for sample in (20_000, 10):
        assert Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs, sample=sample).collect()) == want
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_stage_drops_every_near_copy(spark, sf):
    docs = common.table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    comp = brute.jaccard_components(texts)
    got = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, sf)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {d: texts[d] for d in set(comp.values())}


def test_bitmaps_never_differ_in_more_bits_than_the_sets():
    rng = np.random.default_rng(6)
    for n, m in ((5, 9), (500, 620), (511, 640), (3000, 2600), (1500, 9000)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: min(n, m) * 9 // 10], rng.integers(0, 1 << 63, m // 5, dtype=np.int64).view(np.uint64) * np.uint64(2)]))
        assert jaccard._differ(jaccard._bitmap(a), jaccard._bitmap(b)) <= len(np.setxor1d(a, b))
        assert jaccard._differ(jaccard._bitmap(a), jaccard._bitmap(a)) == 0


def test_a_family_of_edited_copies_is_linked_by_its_centre(spark, monkeypatch):
    """400 copies with one to three edits each, most of them less similar than 0.8: a few pairs a copy, not all pairs."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(400):
        w = list(words)
        for at in rng.integers(0, len(w), int(rng.integers(1, 4))):
            w[at] = f"x{k}_{at}"
        texts.append(" ".join(w))
    counts, own = {}, jaccard.verified

    def counted(docs, sets, pairs, name):
        pairs = common.stage(pairs, "counted")
        counts[name] = pairs.count()
        return own(docs, sets, pairs, name)

    monkeypatch.setattr(jaccard, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute.jaccard_components(dict(enumerate(texts)))
    assert sum(counts.values()) <= 8 * len(texts), counts


def test_a_passage_that_some_texts_share_makes_few_pairs(spark, monkeypatch):
    """20 passages, each in 30 otherwise different texts, which the sample doesn't show: their shingles come last."""
    texts = []
    for k in range(600):
        own = [f"w{k}_{i}" for i in range(150)]
        texts.append(" ".join(own[:70] + [f"p{k % 20}_{i}" for i in range(50)] + own[70:]))
    texts.append(texts[7].replace("w7_3 ", "x "))
    counts, own = {}, jaccard.verified

    def counted(docs, sets, pairs, name):
        pairs = common.stage(pairs, "counted")
        counts[name] = pairs.count()
        return own(docs, sets, pairs, name)

    monkeypatch.setattr(jaccard, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, sample=10).collect()}
    assert got == {k: k for k in range(600)} | {600: 7}
    assert sum(counts.values()) <= len(texts), counts


def test_near_fingerprints_propose_links(spark):
    """Equal fingerprints and those that the grid join finds within two bits are held against each other."""
    rows = [(10, 0), (11, 0), (12, 3), (13, 255), (14, -1), (15, -1 ^ (1 << 40))]
    distinct = spark.createDataFrame(rows, "node long, fp long")
    assert {tuple(sorted(r)) for r in jaccard._alike(distinct).collect()} == {(10, 11), (10, 12), (14, 15)}


def _batches(columns, names, cuts):
    cuts = [0, *sorted(cuts), len(columns[0])]
    return [pa.RecordBatch.from_arrays([pa.array(x[a:b]) for x in columns], names) for a, b in zip(cuts, cuts[1:], strict=False)]


def test_runs_of_shingles_over_batches():
    """Shared and heavy shingles, however the sorted rows are cut into batches, empty ones included."""
    rng = np.random.default_rng(8)
    for _ in range(50):
        found = np.sort(rng.choice(rng.integers(-1 << 62, 1 << 62, 12), int(rng.integers(0, 90))))
        at = np.arange(len(found))
        counts, cuts = Counter(found.tolist()), rng.integers(0, len(found) + 1, 6)
        got = [r for b in jaccard._shared(_batches([found, at, -at], ["shingle", "node", "at"], cuts)) for r in zip(*b.to_pydict().values(), strict=True)]
        assert got == [(s, i, -i) for s, i in zip(found.tolist(), at.tolist(), strict=True) if counts[s] > 1]
        got = Counter(r for b in jaccard._heavy(_batches([found], ["shingle"], cuts)) for r in zip(*b.to_pydict().values(), strict=True))
        heavy = {s: k for s, k in counts.items() if k >= jaccard.HEAVY}
        assert got == Counter((int(jaccard._cell(np.array([s]).view(np.uint64))[0]), k.bit_length() - 1) for s, k in heavy.items())


def test_python_gets_small_batches(spark, monkeypatch):
    """Every staged step of the near-dedup stage runs under the bound, which holds for real batches and is taken back."""
    before, seen, own = spark.conf.get(common.BATCH_BYTES), [], common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: seen.append(spark.conf.get(common.BATCH_BYTES)) or own(df, name))
    docs = spark.range(2000, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 1000) as text")
    jaccard.near_duplicates(docs).count()
    assert seen and set(seen) == {"2m"} and spark.conf.get(common.BATCH_BYTES) == before

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "rows"])

    with common.small_batches(spark):
        got = docs.select("text").mapInArrow(sizes, "size long, rows long").collect()
    assert max(r["size"] for r in got) < 4 << 20 and sum(r["rows"] for r in got) == 2000
