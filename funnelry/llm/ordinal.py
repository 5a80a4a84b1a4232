"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document's features are its distinct words and their first three to six bytes, numbered by hash.
The model is P(grade > j) = sigmoid(x . w - theta_j): all thresholds share the weights w, and theta
rises with j. The expected severity is the sum of these probabilities.

It is fitted on at most `max_train` labelled documents, chosen by a digest of their ids. Their
features are counted by Spark; those that go with the label (chi-square) are kept, and only they
come to the driver. Scoring runs over all documents and needs no shuffle.

Edge cases: NULL texts have no words and get the severity of the thresholds alone; rows of a
labelled id are all used; labels without a grade or a document are left out; with fewer than two
grades in the labels there is nothing to learn and every document gets grade and severity 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelry.llm.stores import pick, small_batches, stored
from funnelry.llm.text import BETWEEN_SPACES, LETTERS_AND_DIGITS, slices, words_of

MAX_TRAIN = 8_000
MAX_FEATURES = 4_096
#: Entries of the table that finds a feature; its full number decides.
TABLE_BITS = 20
HEADS = (3, 4, 5, 6)
MIN_CHI2 = 25.0
L2 = 1e-5
STEPS = 1_000
#: A document is rejected from this probability of any severity on.
REJECT = 0.5

LETTERS = LETTERS_AND_DIGITS & BETWEEN_SPACES


@dataclass
class Model:
    """Feature f may be in slot[its first bits] and is if it has that slot's number; slot 0 stands
    for all features that are not used."""

    slot: np.ndarray
    number: np.ndarray
    weight: np.ndarray
    theta: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.theta) + 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every word and word head."""
    words = words_of(texts, LETTERS)
    found = [words.number, *(words.head(n) ^ np.uint64(n) for n in HEADS)]
    row = np.tile(words.row(), len(found))
    return row, np.concatenate(found)


def _entry(number: np.ndarray) -> np.ndarray:
    return (number >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _distinct(row: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots row after row, and where each row begins."""
    key = np.unique(row.astype(np.int64) << np.int64(32) | slot.astype(np.int64))
    first = np.searchsorted(key >> np.int64(32), np.arange(n + 1))
    return (key & np.int64(0xFFFFFFFF)).astype(np.int32), first


def _sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(grade, features) of at most `max_train` labelled documents."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_train)
    chosen = chosen.withColumnRenamed("doc_id", "id")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("grade", "text")
    schema = T.StructType(
        [
            T.StructField("grade", T.IntegerType()),
            T.StructField("features", T.ArrayType(T.LongType())),
        ]
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature = features(part.column(1))
                own = [np.unique(feature[row == r]).view(np.int64) for r in range(len(part))]
                lists = pa.array(own, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], schema.names)

    return stored(rows.mapInArrow(extract, schema), "labelled")


def _chosen_features(rows: DataFrame, n: int, n_high: int, max_features: int) -> list:
    """Features that go with a grade above 0, strongest first: (feature, documents, high ones)."""
    counts = rows.select(F.explode("features").alias("f"), (F.col("grade") > 0).cast("long").alias("high"))
    counts = counts.groupBy("f").agg(F.count(F.lit(1)).alias("docs"), F.sum("high").alias("high"))
    docs, high = F.col("docs").cast("double"), F.col("high").cast("double")
    excess = high * n - docs * n_high
    spread = docs * (n - docs) * float(n_high) * float(n - n_high)
    counts = counts.where("docs >= 3").withColumn("chi2", excess * excess * n / F.nullif(spread, F.lit(0.0)))
    strong = counts.where(F.col("chi2") >= MIN_CHI2)
    return strong.orderBy(F.desc("chi2"), "f").limit(max_features).collect()


def fit_link(rows: list[np.ndarray], grade: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean negative log-likelihood plus an L2 penalty.

    Slot 0 keeps weight 0. Thresholds are one base and logarithms of the gaps between them; the base
    is held where a text without any feature is no more likely to be toxic than texts are at large.
    """
    top = int(grade.max())
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    weight, base, gaps = np.zeros(n_features + 1), np.zeros(1), np.zeros(top - 1)
    share = np.clip(np.mean(grade > 0), 1e-3, 1 - 1e-3)
    base[0] = least = np.log(1 / share - 1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weight, base, gaps)]
    n = len(rows)
    for step in range(1, STEPS + 1):
        theta = base[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(owner, weight[flat], n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30)))
        wide = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        at = np.arange(n)
        p = np.maximum(wide[at, grade] - wide[at, grade + 1], 1e-9)
        slope = wide * (1 - wide)
        by_score = (slope[at, grade] - slope[at, grade + 1]) / p
        by_theta = np.zeros((n, top + 2))
        by_theta[at, grade] -= slope[at, grade] / p
        by_theta[at, grade + 1] += slope[at, grade + 1] / p
        by_theta = by_theta[:, 1:-1].mean(0)
        grad = np.bincount(flat, by_score[owner], n_features + 1) / n - L2 * weight
        grad[0] = 0
        tails = np.cumsum(by_theta[::-1])[::-1]
        grads = (grad, np.array([by_theta.sum()]), tails[1:] * np.exp(gaps))
        for param, g, (m, v) in zip((weight, base, gaps), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            rate = 0.1 * (1 - step / STEPS) + 1e-3
            param += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        base[0] = max(base[0], least)
    return weight, base[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, split: bool = True) -> Model | None:
    """A model from labels (doc_id, grade); None if they hold fewer than two grades.

    With `split`, labels that know only two grades are refined: a model of the two is fitted, and
    the upper one is halved at its median score. Any finer grade must be one that the shared
    weights can tell, or it flattens them for all thresholds.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, doc_id="doc_id", text="text")
    labels = pick(labels, doc_id="doc_id", grade="grade").where("doc_id IS NOT NULL AND grade IS NOT NULL")
    rows = _sample(docs, labels.select("doc_id", F.col("grade").cast("int")).distinct(), max_train)
    n, n_high = rows.agg(F.count(F.lit(1)), F.count_if(F.col("grade") > 0)).first()
    if not 0 < n_high < n:
        return None
    chosen = _chosen_features(rows, n, n_high, MAX_FEATURES)
    # Of features that share a table entry the strongest stays.
    _, first = np.unique(_entry(np.array([r.f for r in chosen], np.int64).view(np.uint64)), return_index=True)
    chosen = [chosen[k] for k in np.sort(first)]
    number = np.array([0, *(r.f for r in chosen)], np.int64).view(np.uint64)
    slot = np.zeros(1 << TABLE_BITS, np.int32)
    slot[_entry(number[1:])] = np.arange(1, len(number))
    wanted = F.array(*(F.lit(r.f) for r in chosen)).cast("array<long>")
    found = rows.select("grade", F.array_intersect("features", wanted).alias("f")).collect()
    found.sort(key=lambda r: (r.grade, r.f))  # the same sums in every run
    slots = [slot[_entry(np.array(r.f, np.int64).view(np.uint64))] for r in found]
    grade = np.array([r.grade for r in found])
    grade = np.searchsorted(np.unique(grade), grade)
    if split and grade.max() == 1:
        weight, _ = fit_link(slots, grade, len(chosen))
        score = np.array([weight[s].sum() for s in slots])
        grade[(grade == 1) & (score > np.median(score[grade == 1]))] = 2
    weight, theta = fit_link(slots, grade, len(chosen))
    return Model(slot, number, weight, theta)


def predict(model: Model | None, texts: pa.Array) -> np.ndarray:
    """Texts x thresholds: the probabilities of a grade above each."""
    n = len(texts)
    if model is None:
        return np.zeros((n, 1))
    row, feature = features(texts)
    slot = model.slot[_entry(feature)]
    used = np.flatnonzero(slot)
    used = used[model.number[slot[used]] == feature[used]]
    slot, first = _distinct(row[used], slot[used], n)
    owner = np.repeat(np.arange(n), np.diff(first))
    score = np.bincount(owner, model.weight[slot], n)
    return 1 / (1 + np.exp(-np.clip(score[:, None] - model.theta, -30, 30)))


SCORES = [
    T.StructField("severity", T.DoubleType()),
    T.StructField("grade", T.IntegerType()),
    T.StructField("p_toxic", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
]


def _scores(above: np.ndarray) -> list[pa.Array]:
    return [
        pa.array(above.sum(1)),
        pa.array((above >= 0.5).sum(1), pa.int32()),
        pa.array(above[:, 0]),
        pa.array(above[:, 0] >= REJECT),
    ]


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows as columns `_0`, `_1`, ... and the scores."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    numbered = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*numbered.schema.fields, *SCORES])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"_{place}"):
                above = predict(sent.value, part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, *_scores(above)], schema.names)

    return numbered.mapInArrow(score, schema)


def severities(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, severity (expected grade), grade, p_toxic and rejected."""
    found = scored(pick(docs, doc_id="doc_id", text="text"), model)
    return found.select(F.col("_0").alias("doc_id"), *(f.name for f in SCORES))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    found = scored(docs, model).where(~F.col("rejected"))
    return found.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
