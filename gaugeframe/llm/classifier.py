"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 poor, 2 good. All grades share the weights of hashed text features, and two ordered
thresholds cut the score: P(grade <= k) = sigmoid(threshold_k - score). The model is fitted on ``most`` labelled rows
(a parameter; which ones depends on a hash of their ids), whose features, not texts, come to the driver; every document
is scored on the executors in one pass without a shuffle. Selection is by the tail probability P(grade >= 2).

Features are taken from the whole text: lower-case words, the first five letters of longer words, and
classed shares (symbols, capitals, exclamation marks, bars, distinct words, equal neighbours). Features that fewer
than ``MIN_ROWS`` sampled rows have weigh nothing.

Defined cases: null text scores as empty; labels that are null or without a document are ignored, several for a
document count as the worst; without labels there is no model: score and probabilities are null and all is kept;
repeated rows and null ids give a row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REMEMBERED, begin, fresh_name, table, texts_of

SIZE = 1 << 18
MIN_ROWS = 3
SAMPLE = 8_000
GRADES = 3
_EDGE = ".,;:!?\"'()[]#*$%&|<>"
_SHARES = (0.0, 0.002, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)


def _slot(name: str) -> int:
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(name.encode()) % SIZE


class _Slots(dict):
    """Word -> slots of its features; forgotten when there are too many."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 50_000:
            self.clear()
        bare = word.strip(_EDGE)
        value = self[word] = (*((_slot("w " + bare),) if bare else ()), *((_slot("p " + bare[:5]),) if len(bare) > 6 else ()))
        return value


_SLOTS = _Slots()
REMEMBERED["classifier"] = _SLOTS.clear
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SYMBOLS = re.compile(r"[#*$%&<>]")


#: Classed shares count this often, so that they are heard beside hundreds of words.
SHAPE_WEIGHT = 4
_SHAPES = {k: [_slot(f"s {k} {i}") for i in range(len(_SHARES) + 1)] for k in ("symbols", "capitals", "shouts", "bars", "distinct", "neighbours")}


def features(text: str) -> np.ndarray:
    """The slots of a text's features: words and beginnings once, classed shares SHAPE_WEIGHT times."""
    words = text.lower().split()
    distinct = set(words)
    found = set().union(*map(_SLOTS.__getitem__, distinct))
    n, c = max(1, len(words)), max(1, len(text))
    shares = {
        "symbols": len(_SYMBOLS.findall(text)) / c, "capitals": len(_CAPITALS.findall(text)) / c, "shouts": text.count("!") / n, "bars": text.count("|") / n,
        "distinct": len(distinct) / n if n >= 30 else 1.0, "neighbours": sum(map(str.__eq__, words[1:], words)) / n,
    }
    shape = [_SHAPES[k][sum(v > s for s in _SHARES)] for k, v in shares.items()] * SHAPE_WEIGHT
    return np.array([*found, *shape], np.int32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str) -> float:
        return float(self.weights[features(text)].sum())


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 600, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Maximum likelihood of the cumulative-link model by Adam, whose steps shrink to zero; the second threshold is the first plus exp(gap)."""
    index = np.concatenate(rows)
    seen = np.bincount(index, minlength=SIZE)
    useful = seen >= MIN_ROWS
    useful[[s for slots in _SHAPES.values() for s in slots]] = True
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[useful[index]]
    used = np.flatnonzero(useful & (seen > 0))
    place = np.zeros(SIZE, np.intp)
    place[used] = np.arange(len(used))
    index = place[index[useful[index]]]
    n = len(rows)
    cumulative = [np.clip(np.mean(grades <= k), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)]
    start = [np.log(p / (1 - p)) for p in cumulative]
    params = np.concatenate([np.zeros(len(used)), [start[0], np.log(max(start[1] - start[0], 0.1))]])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        score = np.bincount(row, params[index], n)
        low, gap = params[-2], np.exp(params[-1])
        upper = np.where(grades == 0, low, low + gap) - score  # P(y <= g) = F(upper), P(y <= g - 1) = F(lower)
        lower = np.where(grades == 2, low + gap, low) - score
        fu, fl = np.where(grades == 2, 1.0, sigmoid(upper)), np.where(grades == 0, 0.0, sigmoid(lower))
        p = np.maximum(fu - fl, 1e-9)
        du, dl = np.where(grades == 2, 0.0, fu * (1 - fu)) / p, np.where(grades == 0, 0.0, fl * (1 - fl)) / p
        to_low = -(du - dl)
        to_gap = -(np.where(grades == 1, du, 0.0) - np.where(grades == 2, dl, 0.0))
        grad = np.concatenate([np.bincount(index, (du - dl)[row], len(used)) / n + ridge * params[:-2], [to_low.mean(), to_gap.mean() * gap]])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        params = params - rate * (1 - t / rounds) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(SIZE, np.float32)
    weights[used] = params[:-2]
    return Model(weights, np.array([params[-2], params[-2] + np.exp(params[-1])]))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def slots(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("classifier")
        for texts in batches:
            yield pa.array([features(t) for t in texts_of(texts)], pa.list_(pa.int32()))

    slots.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    slots = F.arrow_udf(slots, "array<int>")
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", slots("text").alias("slots")).toArrow()  # of ``most`` ids
    if not found.num_rows:
        return None
    lists = found["slots"].combine_chunks()
    flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    return fit([np.sort(flat[bounds[i] : bounds[i + 1]]) for i in order], found["grade"].to_numpy()[order])


def scores(text: Column, model: Model) -> Column:
    def typed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("classifier")
        for texts in batches:
            yield pa.array([model.score(t) for t in texts_of(texts)], pa.float64())

    typed.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(typed, "double")(text)


def _tail(score: Column, threshold: float) -> Column:
    return 1 / (1 + F.exp(F.lit(float(threshold)) - score))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.65, most: int = SAMPLE) -> DataFrame:
    """(doc_id, score, expected_grade, p_poor_or_better, p_good, kept) for each document."""
    model = train(docs, labels, most)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", *(none.alias(c) for c in ("score", "expected_grade", "p_poor_or_better", "p_good")), F.lit(True).alias("kept"))
    scored = docs.select("doc_id", scores(docs["text"], model).alias("score"))
    tails = scored.select("doc_id", "score", *(_tail(F.col("score"), t).alias(c) for t, c in zip(model.thresholds, ("p_poor_or_better", "p_good"), strict=True)))
    return tails.select("doc_id", "score", (F.col("p_poor_or_better") + F.col("p_good")).alias("expected_grade"), "p_poor_or_better", "p_good", (F.col("p_good") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.65, most: int = SAMPLE) -> DataFrame:
    """docs without the documents that the classifier rejects; same columns."""
    model = train(docs, labels, most)
    if model is None:
        return docs
    score = fresh_name(docs, "score")
    return docs.withColumn(score, scores(docs["text"], model)).where(_tail(F.col(score), model.thresholds[1]) >= least).drop(score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
