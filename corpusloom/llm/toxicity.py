"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

#: Rows kept for training: crc32 of the id modulo 5 isn't 0. Labelled rows a class to fit on; learned lexicon entries.
MODULUS, HELD_OUT, PER_CLASS, ENTRIES = 5, 0, 6_000, 5_000
TOXIC_FROM = 0.5
#: Insults, second-person words, and characters that stand for letters.
INSULTS = frozenset(
    """clown disgusting dumb fool garbage hate idiot imbecile jerk loser moron pathetic scum shut stupid trash ugly useless vermin
    worthless dumm dummkopf abschaum versager trottel widerlich imbécile crétin débile minable ordure raclure
    estúpido imbécil escoria basura inútil asqueroso perdedor""".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton vous votre tú ti usted vosotros".split())
STANDS_FOR = str.maketrans("0134578@$!|*", "oieastbasii ", "._-")
WORD = re.compile(r"[^\W\d_]+")
#: Signs between two letters mark a token as masked. No backtracking: the signs are no letters, so linear in any text.
MASK = re.compile(r"[^\W\d_][0-9@$!|*._-]++[^\W\d_]")
NAMES = ("fixed", "learned", "strong", "kinds", "peak", "second", "capitals", "shouted", "punctuation", "obfuscated", "masked_hits", "log_words")


def stems(word: str) -> list[str]:
    """A word's lexicon keys: itself, and its beginnings of 4 to 7 letters (marked)."""
    return [word, *(word[:n] + "-" for n in range(4, min(8, len(word) + 1)))]


class Lexicon:
    """Learned keys and their log odds; a word scores as its best key."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.cache = odds, {}

    def score(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            found = self.cache[word] = max((self.odds.get(s, 0.0) for s in stems(word)), default=0.0)
        return found


def masked_tokens(text: str) -> list[str]:
    """Tokens between white space with signs inside a word, in order."""
    return [t for t in text.split() if MASK.search(t)] if MASK.search(text) else []


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text, all rates but the last; all 0 for null and empty texts."""
    text = text or ""
    words = WORD.findall(text)
    if not words:
        return [0.0] * len(NAMES)
    # in ASCII text the words of the lower-cased text are the lower-cased words
    lower = " ".join(words).lower().split(" ") if text.isascii() else WORD.findall(text.lower())
    counts = Counter(lower)
    known = {w: lexicon.score(w) for w in counts}
    odds = [known[w] for w in lower]
    n = len(lower)
    hot = {w for w, o in known.items() if o >= 2.0 or w in INSULTS}
    strong = [i for i, w in enumerate(lower) if w in hot] if hot else []
    fixed = sum(counts[w] for w in hot if w in INSULTS)
    near = 0
    if strong:  # second-person words at most four away, from running counts
        upto, at = np.cumsum([0, *map(SECOND.__contains__, lower)]), np.array(strong)
        near = int((upto[np.minimum(at + 5, n)] > upto[np.maximum(at - 4, 0)]).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    letters = max(1, sum(map(len, words)))
    masked = masked_tokens(text)
    hits = sum(any(w in INSULTS or lexicon.score(w) >= 2.0 for w in WORD.findall(m.lower().translate(STANDS_FOR))) for m in masked)
    return [
        fixed / n,
        sum(odds) / n,
        len(strong) / n,
        math.log1p(len(hot)),
        max(odds),
        near / n,
        kinds[65:91].sum() / letters,
        sum(len(w) > 2 and w.isupper() for w in words) / n,
        (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / len(raw),
        len(masked) / n,
        hits / n,
        math.log1p(n),
    ]


def _count(batches):
    """Documents with each key, by half of the sample and label, summed in the task."""
    counts: dict[int, Counter] = {k: Counter() for k in range(4)}
    for batch in batches:
        for half, label, text in zip(*(batch.column(c).to_pylist() for c in ("half", "label", "text")), strict=True):
            keys = {s for w in set(WORD.findall((text or "").lower())) for s in stems(w)}
            counts[2 * half + label].update(keys)
    keys = list(set().union(*counts.values()))
    for i in range(0, len(keys), 100_000):
        part = keys[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[k] for k in part], pa.int64()) for c in counts.values())], ["key", "n0", "t0", "n1", "t1"])


def learn_lexicons(chosen: DataFrame, entries: int = ENTRIES) -> list[Lexicon]:
    """A lexicon from each half of the sample, and one from both."""
    sizes = {(r[0], r[1]): r[2] for r in chosen.groupBy("half", "label").count().collect()}
    counts = chosen.mapInArrow(_count, "key string, n0 long, t0 long, n1 long, t1 long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")))
    counts = common.stage(counts, "toxic-counts")  # three lexicons read it
    out = []
    for halves in ((0,), (1,), (0, 1)):
        toxic, clean = (sum(sizes.get((h, label), 0) for h in halves) for label in (1, 0))
        t, n = (sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in "tn")
        odds = F.log(((t + 0.5) / (toxic + 1)) / ((n + 0.5) / (clean + 1)))
        best = counts.where((t >= 3) & (odds >= 1.5)).select("key", odds.alias("odds"), (t * odds).alias("gain")).orderBy(F.desc("gain"), "key").limit(entries)
        out.append(Lexicon({r["key"]: r["odds"] for r in best.collect()}))
    return out


def _featured(docs: DataFrame, lexicons: list[Lexicon], extra: list[str]) -> DataFrame:
    """extra columns and features; column `lexicon` says which one a row takes (the last where there is none)."""

    def rows(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            which = batch.column("lexicon").to_pylist() if "lexicon" in batch.schema.names else [-1] * len(texts)
            made = [features(t, lexicons[k]) for t, k in zip(texts, which, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(made, pa.list_(pa.float64()))], [*extra, "dense"])

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.mapInArrow(rows, f"{fields}, dense array<double>")


class Model:
    """The lexicon, the trees and the calibration; or a constant where the labels have no two classes."""

    def __init__(self, lexicon: Lexicon, trees=None, isotonic=None, constant: float = 0.5):
        self.lexicon, self.trees, self.isotonic, self.constant = lexicon, trees, isotonic, constant

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score of every row of docs; every whole text is scored."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if self.trees is None:
            return rows.select("doc_id", F.lit(self.constant).alias("score"))
        dense = _featured(rows, [self.lexicon], ["doc_id"]).select("doc_id", array_to_vector("dense").alias("features"))
        raw = self.trees.transform(dense).select("doc_id", vector_to_array("probability")[1].alias("raw"))
        smooth = F.least(F.greatest(F.lit(0.999) * F.col("calibrated") + F.lit(0.001) * F.col("raw"), F.lit(0.0)), F.lit(1.0))
        return self.isotonic.transform(raw).select("doc_id", smooth.alias("score"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 7) -> Model:
    """Fit on at most `per_class` labelled training rows of each class.

    Each half of the sample is featured with the lexicon of the other; trees fit on seven tenths, the calibration on
    the rest, weighted to the classes' shares among all labelled training rows. Without labels scores are 0.5; with one
    class only, that class.
    """
    chosen, weights = labelled.sample(docs, labels, "toxic", MODULUS, HELD_OUT, per_class)
    if set(weights) != {0, 1}:
        return Model(Lexicon({}), constant=float(max(weights)) if weights else 0.5)
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(20))
    chosen = common.stage(chosen.withColumn("half", (part % 2).cast("int")).withColumn("fit", part < 14), "toxic-sample")
    present = [r[0] for r in chosen.select("label").distinct().collect()]
    if len(present) < 2:  # labelled documents of one class or none are in docs
        return Model(Lexicon({}), constant=float(present[0]) if present else 0.5)
    lexicons = learn_lexicons(chosen)
    # a row's lexicon is learned on the other half
    rows = chosen.withColumn("lexicon", 1 - F.col("half"))
    dense = common.stage(_featured(rows, lexicons, ["label", "fit"]), "toxic-features").select(
        F.col("label").cast("double").alias("label"),
        "fit",
        array_to_vector("dense").alias("features"),
        F.when(F.col("label") == 1, weights[1]).otherwise(weights[0]).alias("weight"),
    )
    if dense.where("fit").select("label").distinct().count() < 2 or dense.where("not fit").select("label").distinct().count() < 2:
        dense = dense.drop("fit").withColumn("fit", F.lit(True)).unionByName(dense.withColumn("fit", F.lit(False)))
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.25, minInstancesPerNode=5, maxBins=64, seed=seed).fit(dense.where("fit").coalesce(6))
    raw = trees.transform(dense.where("not fit")).select("label", "weight", vector_to_array("probability")[1].alias("raw"))
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(raw)
    return Model(lexicons[2], trees, isotonic)


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (null ids: held_out is null).

    Labels, lang, source and doc_id are no inputs of a score. Null and empty texts, and all without a letter, score as a
    text whose features are all 0. A very long text is held whole in its task, in linear time. Repeated rows are scored
    each; a score of exactly 0.5 is predicted toxic; an empty table gives no rows; other columns are ignored.
    """
    return fit(docs, labels, **options).score(docs).select(
        "doc_id",
        (labelled.remainder(MODULUS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )
