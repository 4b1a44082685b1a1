"""Quality classifier: naive Bayes support vectors over word and character n-gram indicators."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled

#: Hashed n-gram space, bytes of a character n-gram, labelled rows a class to fit on, score from which a text is accepted.
BITS, LETTERS, PER_CLASS, ACCEPT = 17, 3, 4_000, 0.7
#: Rows kept for training: crc32 of the id modulo 4 isn't 2.
MODULUS, HELD_OUT = 4, 2
#: Words are runs of letters, digits and underscores; every other sign that isn't white space is a word of its own.
WORD = re.compile(r"\w+|[^\w\s]")
#: Longest n-gram of the shape: the text with each run of small or non-ASCII letters, capitals or digits as one letter.
SHAPES = 4
#: Shares of neighbouring equal words from which a text has each indicator of repetition.
REPEATS = (0.02, 0.1, 0.3)
#: Fitted rows that must have an n-gram for it to weigh anything.
LEAST = 3
#: Characters of a text that are held as words at a time.
PIECE = 1 << 20


def _classes() -> np.ndarray:
    """A class for each byte: lower case and non-ASCII 1, capitals 2, digits 3, other bytes their own."""
    table = np.arange(256, dtype=np.uint32) + 4
    table[ord("a") : ord("z") + 1] = table[128:] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    return table


CLASSES = _classes()


def _pieces(text: str):
    """The text in pieces of at most PIECE characters, cut at white space where there is any."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = max(text.rfind(" ", at + PIECE // 2, end), text.rfind("\n", at + PIECE // 2, end)) + 1 or end
        yield text[at:end]
        at = end


def indicators(text: str | None) -> np.ndarray:
    """Sorted slots of the whole text's distinct n-grams: words and pairs of neighbouring words (lower-cased, a sign is a
    word), runs of LETTERS bytes as they stand, runs of up to SHAPES signs of the shape, and indicators of repetition.
    Null and empty texts have none."""
    from xxhash import xxh32_intdigest

    found = np.zeros(1 << BITS, bool)
    shift, last, pairs, same = np.uint32(32 - BITS), None, 0, 0
    for piece in _pieces(text or ""):
        words = [w.encode("utf-8", "surrogatepass") for w in WORD.findall(piece.lower())]
        if words:
            ids = np.fromiter(map(xxh32_intdigest, words), np.uint32, len(words))
            found[ids >> shift] = True
            chain = ids if last is None else np.concatenate([[last], ids])
            found[((chain[:-1] * np.uint32(0x9E3779B1)) ^ (chain[1:] * np.uint32(0x85EBCA77))) >> shift] = True
            pairs, same, last = pairs + len(chain) - 1, same + int((chain[1:] == chain[:-1]).sum()), ids[-1]
        raw = np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)
        shape = CLASSES[raw]
        shape = shape[np.concatenate([[True], (shape[1:] != shape[:-1]) | (shape[1:] > 3)])]
        for n, units, salt in [(LETTERS, raw.astype(np.uint32), 1), *((n, shape, n * 7919) for n in range(1, SHAPES + 1))]:
            if len(units) >= n:
                grams = np.full(len(units) - n + 1, salt, np.uint32)
                for i in range(n):
                    grams = (grams + units[i : len(units) - n + 1 + i]) * np.uint32(0x9E3779B1)
                    grams ^= grams >> np.uint32(15)
                found[(grams * np.uint32(0xC2B2AE3D)) >> shift] = True
    if pairs:
        found[: len(REPEATS)] |= np.array([same > share * pairs for share in REPEATS])
    return np.flatnonzero(found).astype(np.uint32)


class Model:
    """Weights of the scaled indicators, an offset, and a logistic scale that turns margins into scores."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weights[found].sum()) + self.offset
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Class log-count ratio of each indicator, smoothed by one row; 0 for those that fewer than LEAST rows have."""
    up, down = np.ones(1 << BITS), np.ones(1 << BITS)
    for found, y in zip(rows, good, strict=True):
        (up if y else down)[found] += 1
    ratio = np.log((up / (1 + good.sum())) / (down / (1 + len(good) - good.sum())))
    return np.where(up + down >= LEAST + 2, ratio, 0.0)


def hinge(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, cost: float, rounds: int = 10, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss on indicators scaled by their ratio; classes weigh the same."""
    weights, offset, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    norm = np.array([(ratio[x] ** 2).sum() + 1 for x in rows])
    share = np.where(good, good.mean(), 1 - good.mean())
    cap, sign, order = cost * 0.5 / share, np.where(good, 1.0, -1.0), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for k in order.permutation(len(rows)):
            x = rows[k]
            slack = sign[k] * (float((weights[x] * ratio[x]).sum()) + offset) - 1
            new = min(max(alpha[k] - slack / norm[k], 0.0), cap[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * sign[k]
                moved = max(moved, abs(step))
                weights[x] += step * ratio[x]
                offset += step
                alpha[k] = new
        if moved < 1e-3 * cost:
            break
    return weights * ratio, offset


def logistic(margins: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton steps with smoothed targets."""
    up, down = good.sum(), len(good) - good.sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * margins).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def _packed(slots: np.ndarray) -> bytes:
    """Slots as a bitmap, or one by one where that is shorter."""
    if 4 * len(slots) < (1 << BITS) // 8:
        return slots.tobytes()
    full = np.zeros(1 << BITS, bool)
    full[slots] = True
    return np.packbits(full).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    if len(packed) < (1 << BITS) // 8:
        return np.frombuffer(packed, np.uint32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, cost: float = 0.01) -> Model:
    """Fit on at most `per_class` labelled training rows of each class; one in five sets the logistic scale.

    Without labels every score is 0.5; with labels of one class only, every score is near that class.
    """

    def found(batches):
        for batch in batches:
            made = [indicators(t) for t in batch.column("text").to_pylist()]
            packed = [_packed(x) for x in made]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "slots"])

    chosen, weights = labelled.sample(docs, labels, "quality", MODULUS, HELD_OUT, per_class)
    # 2 * per_class rows of 2^BITS / 8 bytes at most: 131 MB, and 2 KB or so for a usual text
    got = chosen.mapInArrow(found, "doc_id long, label int, slots binary").orderBy("doc_id", "label", "slots").collect()
    if not got:
        return Model(np.zeros(1 << BITS), 0.0, 1.0, 0.0)
    rows = [_unpacked(r["slots"]) for r in got]
    good = np.array([r["label"] == 1 for r in got])
    if good.all() or not good.any():
        return Model(np.zeros(1 << BITS), 4.0 if good.all() else -4.0, 1.0, 0.0)
    check = np.arange(len(rows)) % 5 == 0
    if min(good[check].sum(), (~good[check]).sum(), good[~check].sum(), (~good[~check]).sum()) == 0:
        check = np.zeros(len(rows), bool)
    fitted = [x for x, c in zip(rows, check, strict=True) if not c]
    ratio = log_count_ratios(fitted, good[~check])
    scaled, offset = hinge(fitted, good[~check], ratio, cost)
    over = check if check.any() else ~check
    margins = np.array([scaled[x].sum() + offset for x, c in zip(rows, over, strict=True) if c])
    weight = np.where(good[over], weights.get(1, 1.0), weights.get(0, 1.0))
    return Model(scaled, offset, *logistic(margins, good[over], weight / weight.mean()))


def score(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """docs and its scores; every whole text is scored, null and empty ones by the offset alone. A column of that name
    is replaced."""
    docs = docs.drop(column)

    def scores(batches):
        for batch in batches:
            made = pa.array([model.score(indicators(t)) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, column])

    schema = docs.select("*", F.lit(0.0).alias(column)).schema
    return docs.mapInArrow(scores, schema)


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (null ids: held_out is null). Labels, lang, source and
    doc_id are no inputs of a score. Repeated rows are scored each; an empty table gives no rows. Null and empty texts
    score by the offset alone, very long ones whole, a piece at a time; a score of exactly 0.7 is accepted."""
    model = fit(docs, labels, **options)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        (labelled.remainder(MODULUS) == HELD_OUT).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = ACCEPT, **options) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with docs' columns."""
    scored = score(docs, fit(docs, labels, **options), "_loom_score")
    return scored.where(F.col("_loom_score") >= threshold).drop("_loom_score")
