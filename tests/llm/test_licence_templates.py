"""The rare-word lookup of licence passages against a plain-Python version, and files that hold several notices."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from corpusloom.llm import common, licenses

from . import brute


def lookup(texts, rarest=licenses.RAREST, agree=licenses.AGREE):
    """[(labels, score)]: word frequencies, rarest words, offsets, key phrases, all by brute force."""
    split = [brute.WORDS.findall(brute.lower(t)) for t in texts]
    df = Counter(w for words in split for w in set(words))
    out = []
    for words, text in zip(split, texts, strict=True):
        joined, labels, score = " " + " ".join(words) + " ", set(filter(None, brute.licences(text)[4].split(","))), 0.0
        if labels:
            score = 0.5
        for label, phrases, passage in licenses.TEMPLATES:
            own = licenses.plain_words(passage)
            probe = sorted(set(own), key=lambda w: (df[w], w))[:rarest]
            here = [w for w in probe if w in words]
            lined = {}
            for at, w in enumerate(words):
                for place, x in enumerate(own):
                    if w == x and w in here:
                        lined.setdefault(at - place, set()).add(w)
            best = max(map(len, lined.values()), default=0)
            if len(here) >= 2 and best >= 2 and best >= agree * len(here) and any(f" {p} " in joined for p in phrases.split("|")):
                labels.add(label)
                score = max(score, best / len(here))
        out.append((",".join(sorted(labels)), score))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    out = [None, "", "  ", "we use this in the public and it is free", "Licensed under the Apache License", "CC BY-NC"]
    fill = ["the", "this", "of", "software", "license", "copy", "fee", "any", "zz", "alpha", "permission", "public"]
    for _, _, passage in licenses.TEMPLATES:
        words = passage.split()
        out.append(passage)
        for share in (0.1, 0.4):  # words left out and replaced: offsets shift
            keep = [w if rng.random() > share else str(rng.choice(fill)) for w in words if rng.random() > share / 3]
            out.append(" ".join([*rng.choice(fill, 20), *keep, *rng.choice(fill, 20)]))
        out.append(" ".join(rng.permutation(words)))
    return out + [out[7], out[7]]


def test_lookup_is_the_brute_force_one(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(docs).collect()}
    want = {i: (labels, round(score, 9)) for i, (labels, score) in enumerate(lookup(texts))}
    assert got == want
    assert {x for labels, _ in want.values() for x in labels.split(",") if x} == {label for label, _, _ in licenses.TEMPLATES}


def test_query_is_the_brute_force_one(spark, sf):
    docs = common.table(spark, sf, "documents")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(docs).collect()}
    want = dict(zip((r["doc_id"] for r in rows), ((a, round(b, 9)) for a, b in lookup([r["text"] for r in rows])), strict=True))
    assert got == want


def test_every_notice_of_a_file_is_found(spark):
    first = {}
    for label, _, passage in licenses.TEMPLATES:
        first.setdefault(label, passage)
    names = sorted(set(first) - {"lgpl", "agpl"})  # these hold a base phrase, and with it gpl
    sets = [tuple(names), *combinations(["apache", "bsd", "cc", "gpl", "mit", "mpl"], 3)]
    rows = [(i, " filler words ".join(first[n] for n in s)) for i, s in enumerate(sets)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, s in enumerate(sets):
        assert set(s) <= set(got[i]["labels"].split(","))
    assert {r["score"] for r in got.values()} == {1.0}
