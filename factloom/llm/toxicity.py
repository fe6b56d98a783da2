"""Toxic severity by cumulative-link ordinal regression over sparse text features.

Features are the distinct lower-cased words of a text and the words' prefixes of 4 to 6
letters, as presences. A bounded sample of labelled documents (at most TRAIN_ROWS, those
with the smallest hash of the id) selects the features whose rate in toxic texts is at least
LIFT times that in clean ones, by a Z_LIMIT-fold standard error; at most MAX_FEATURES.

Where labels have a column of severity grades, `grade_col` names it. Labels that say only
toxic or not are given grades by how much speaks for them: grade 0 is not toxic, and toxic
sample texts are divided into GRADES - 1 equal parts by their number of selected features,
so severity then orders texts by evidence and is no annotated degree. The model has one weight vector shared
by all thresholds: P(grade <= k) = sigmoid(threshold_k - weights . features), fitted by
gradient descent with an L2 penalty. Scores are the expected grade, the probability of
any toxicity, and the decision `toxic` where that probability is at least LIMIT.

Edge cases: null texts are empty and have no features; whole texts are scored; labels that
are null or name no document are ignored, a document labelled twice counts as toxic if one
label says so, repeated labelled rows count once; without labelled texts of both kinds
nothing is toxic; ties don't matter; empty tables give empty results; other columns pass
through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship_package, stage

TRAIN_ROWS = 8_192
MAX_FEATURES = 2_048
MIN_DOCUMENTS = 3
GRADES = 4
LIFT = 10.0
Z_LIMIT = 4.0
LIMIT = 0.5
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
SCORES = "severity double, p_toxic double, grade int"


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word itself, and its prefixes marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    """Feature weights and ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    _known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> tuple[float, float, int]:
        """Expected grade, probability of a grade above 0, most probable grade."""
        if not self.thresholds:
            return 0.0, 0.0, 0
        present: set[str] = set()
        for word in words_of(text):
            known = self._known.get(word)
            if known is None:
                known = tuple(x for x in features_of(word) if x in self.weights)
                if len(self._known) < 200_000:
                    self._known[word] = known
            present.update(known)
        total = sum(self.weights[x] for x in sorted(present))
        above = [1 / (1 + float(np.exp(np.clip(t - total, -500, 500)))) for t in self.thresholds]
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        return sum(above), above[0], int(np.argmax(each))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, grade_col: str = "toxic") -> DataFrame:
    """doc_id, text and grade of at most `rows` labelled documents."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(grade_col).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.greatest(F.col(grade_col), F.lit(0)).cast("int")).alias("grade"))
        .orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most TRAIN_ROWS rows
    return stage(texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text")), "toxicity-sample")


def select_features(sample: DataFrame, limit: int = MAX_FEATURES) -> list[tuple[str, float]]:
    """Features of toxic texts and their z-scores, the largest first."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist(), strict=True):
                found = {x for w in words_of(text) for x in features_of(w)}
                names += found
                toxic += [int(label > 0)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], names=["feature", "toxic"])

    totals = sample.agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("int")).alias("t")).first()
    n1 = totals.t or 0
    n0 = totals.n - n1
    if not n0 or not n1:
        return []
    counts = sample.select("text", "grade").mapInArrow(emit, "feature string, toxic int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    rate = F.col("n") / (n0 + n1)
    z = (F.col("t") / n1 - (F.col("n") - F.col("t")) / n0) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0) + 1e-12)
    lift = ((F.col("t") + 0.5) / n1) / ((F.col("n") - F.col("t") + 0.5) / n0)
    found = counts.filter((F.col("n") >= MIN_DOCUMENTS) & (lift >= LIFT)).select("feature", z.alias("z")).filter(F.col("z") >= Z_LIMIT)
    return [(r.feature, r.z) for r in found.orderBy(F.col("z").desc(), "feature").limit(limit).collect()]


def thresholds_of(first: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Increasing thresholds: the first one and the logarithms of the gaps between them."""
    return first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def loss_gradient(x: np.ndarray, grades: np.ndarray, w: np.ndarray, first: np.ndarray, gaps: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The penalised loss and its gradient by (w, first, gaps); clean and toxic texts weigh the same."""
    n, steps = len(x), len(gaps) + 1
    balance = np.where(grades == 0, 0.5 / max(1, (grades == 0).sum()), 0.5 / max(1, (grades > 0).sum()))
    total = (x @ w.astype(x.dtype)).astype(np.float64)
    cumulative = 1 / (1 + np.exp(np.clip(total[:, None] - thresholds_of(first, gaps), -50, 50)))
    upper = np.concatenate([cumulative, np.ones((n, 1))], axis=1)
    lower = np.concatenate([np.zeros((n, 1)), cumulative], axis=1)
    rows = np.arange(n)
    p = np.maximum(upper[rows, grades] - lower[rows, grades], 1e-12)
    slope = cumulative * (1 - cumulative)
    # d(-log p)/d theta_k: -slope_k / p where k is the grade, + slope_k / p just below it
    is_upper = (grades[:, None] == np.arange(steps)).astype(float)
    is_lower = (grades[:, None] == np.arange(1, steps + 1)).astype(float)
    by_theta = (is_lower - is_upper) * slope / p[:, None] * balance[:, None]
    by_w = -(x.T @ by_theta.sum(axis=1).astype(x.dtype)) + penalty * w
    sums = by_theta.sum(axis=0)
    tails = np.cumsum(sums[::-1])[::-1]
    loss = float((-np.log(p) * balance).sum() + penalty / 2 * (w @ w))
    return loss, np.concatenate([by_w, [sums.sum()], tails[1:] * np.exp(gaps)])


def fit_thresholds(x: np.ndarray, grades: np.ndarray, levels: int, *, penalty: float = 1e-3, steps: int = 400, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and increasing thresholds of the cumulative-link model (Adam)."""
    m = x.shape[1]
    w, first, gaps = np.zeros(m), np.array([1.0]), np.zeros(levels - 2)
    moment, square = np.zeros(m + levels - 1), np.zeros(m + levels - 1)
    for step in range(1, steps + 1):
        _, gradient = loss_gradient(x, grades, w, first, gaps, penalty)
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = rate * (1 - step / (steps + 1)) * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, first, gaps = w - move[:m], first - move[m : m + 1], np.clip(gaps - move[m + 1 :], -6, 4)
    return w, thresholds_of(first, gaps)


def by_evidence(strength: np.ndarray, toxic: np.ndarray, grades: int) -> np.ndarray:
    """Grades of texts that are only known to be toxic or not."""
    cuts = np.quantile(strength[toxic], np.arange(1, grades - 1) / (grades - 1))
    return np.where(toxic, 1 + (strength[:, None] > cuts).sum(axis=1), 0)


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, grade_col: str | None = None, grades: int = GRADES) -> Model:
    """A model from the labelled documents; empty where one of the kinds is missing.

    grade_col: annotated severity, 0 where not toxic; without it grades come from `toxic`.
    """
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, labels, rows, grade_col or "toxic")
    chosen = select_features(sample)
    if not chosen:
        return Model()
    place = {name: i for i, (name, _) in enumerate(chosen)}

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted({place[x] for w in words_of(t) for x in features_of(w) if x in place}) for t in texts])

    coded = sample.select("doc_id", "grade", encoded("text").alias("x")).orderBy("doc_id").collect()  # at most `rows`
    x = np.zeros((len(coded), len(place)), np.float32)
    for i, r in enumerate(coded):
        x[i, r.x] = 1
    given = np.array([r.grade for r in coded])
    present, grade = np.unique(given if grade_col else by_evidence(x.sum(axis=1), given > 0, grades), return_inverse=True)
    weights, thresholds = fit_thresholds(x, grade, len(present))
    return Model({name: float(w) for (name, _), w in zip(chosen, weights, strict=True)}, tuple(float(t) for t in thresholds))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds severity (expected grade), p_toxic, grade and toxic."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # at most MAX_FEATURES

    @F.pandas_udf(SCORES)
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for texts in batches:
            yield pd.DataFrame([own.score(t) for t in texts], columns=["severity", "p_toxic", "grade"])

    out = docs.withColumn("_scores", scores(F.col(text_col)))
    added = {name: F.col(f"_scores.{name}") for name in ("severity", "p_toxic", "grade")}
    return out.withColumns(added | {"toxic": F.col("_scores.p_toxic") >= LIMIT}).drop("_scores")


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns."""
    model = fit(docs, labels, **options)
    scored = score_documents(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text")), model, "_text")
    return scored.filter(~F.col("toxic")).select("_row.*")
