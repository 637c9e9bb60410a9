"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; texts drawn from the labelled rows of the training fold,
their labels withheld, are the unlabelled ones. With the class prior p, the risk of a linear classifier f is
p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]): the second part estimates the risk on negatives, and
is kept from going below zero by stepping back whenever it does. Features are the distinct words of
a text with their beginnings and ends, so that inflected or compounded insults share a weight. Which
features count is found by one aggregation over the sample's texts; the driver fits on what is left.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_text, in_training_fold, sample_ids, sampled_rows, small_batches

#: Most positives and most unlabelled texts (labelled rows, whatever their label) that the classifier is
#: fitted on; bytes are bounded too (``common.SAMPLE_BYTES``).
MAX_POSITIVE, MAX_UNLABELLED = 2000, 6000
#: A feature counts if its share differs between positives and unlabelled texts by this factor and
#: this many standard errors.
LIFT, ERRORS = 2.0, 3.0
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weight: dict[str, float]
    bias: float


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """The whole word, and its beginnings and ends of four and five letters."""
    found = [word]
    for k in (4, 5):
        if len(word) > k:
            found += ["^" + word[:k], word[-k:] + "$"]
    return found


def counts_of(text: str) -> Counter:
    """How many distinct words of the text have each feature."""
    return Counter(f for w in words_of(text) for f in features_of(w))


def clear_features(in_p: Column, in_u: Column, n_p: int, n_u: int) -> Column:
    """Does a feature that so many positives and unlabelled texts have differ clearly between them?"""
    p, u = (in_p + 0.5) / (n_p + 1), (in_u + 0.5) / (n_u + 1)
    error = F.abs(p - u) / F.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u + 1e-12)
    return (in_p > 0) & (error >= ERRORS) & (F.greatest(p / u, u / p) >= LIFT)


def gradient(theta: np.ndarray, cols: np.ndarray, values: np.ndarray, rows: np.ndarray, n_p: int, n: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk with the logistic loss, and the direction of descent (no decay): its slope, or
    that of the risk on negatives turned round where it is below zero. The first ``n_p`` texts are positives."""
    k = len(theta) - 1
    f = np.bincount(rows, theta[cols] * values, n) + theta[k]
    up = 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # the slope of the loss of -f; that of f is up - 1
    soft = np.logaddexp(0, f)
    negative = soft[n_p:].mean() - prior * soft[:n_p].mean()
    risk = prior * np.logaddexp(0, -f[:n_p]).mean() + max(0.0, negative)
    g = np.empty(n)
    if negative >= 0:
        g[:n_p], g[n_p:] = -prior / n_p, up[n_p:] / (n - n_p)
    else:
        g[:n_p], g[n_p:] = prior * up[:n_p] / n_p, -up[n_p:] / (n - n_p)
    return float(risk), np.append(np.bincount(cols, g[rows] * values, k), g.sum())


def fit(found: list[tuple[int, list[str], list[int]]], n_p: int, n: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Adam on the non-negative risk. ``found``: number of a text (positives first), its features and their counts."""
    if not n_p or n_p == n:
        return Model({}, -10.0)
    names = sorted({f for _, fs, _ in found for f in fs})
    index = {f: i for i, f in enumerate(names)}
    cols = np.array([index[f] for _, fs, _ in found for f in fs], int)
    values = np.array([c for _, _, cs in found for c in cs], float)
    rows = np.repeat(np.array([t for t, _, _ in found], int), [len(fs) for _, fs, _ in found])
    k = len(names)
    theta = np.zeros(k + 1)
    theta[k] = np.log(prior / (1 - prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        slope = gradient(theta, cols, values, rows, n_p, n, prior)[1] + decay * np.append(theta[:k], 0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3}, float(theta[k]))


def score(model: Model, text: str) -> float:
    weight = model.weight
    f = model.bias + math.fsum(weight[x] for w in words_of(text) for x in features_of(w) if x in weight)
    return float(1 / (1 + np.exp(-np.clip(f, -30, 30))))


def _features(texts: DataFrame) -> DataFrame:
    """``positive, doc_id, feature, n`` of sampled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for positive, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("positive", "doc_id", "text")), strict=True):
                found = counts_of(text)
                cols = [pa.array([positive] * len(found), pa.bool_()), pa.array([doc_id] * len(found), pa.int64()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["positive", "doc_id", "feature", "n"])

    return texts.mapInArrow(run, "positive boolean, doc_id long, feature string, n int")


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on bounded samples of the labelled rows of the training fold; the class prior is that of all of them."""
    small_batches(docs.sparkSession)
    known = labels.where(in_training_fold(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    texts = id_text(docs)
    drawn = ((True, sample_ids(known.where("toxic = 1"), "doc_id", max_positive, 8)), (False, sample_ids(known, "doc_id", max_unlabelled, 9)))
    p_texts, u_texts = (sampled_rows(texts, ids).select(F.lit(positive).alias("positive"), "doc_id", "text") for positive, ids in drawn)
    sample = checkpointed(p_texts.unionByName(u_texts))
    numbers = {(r.positive, r.doc_id): k for k, r in enumerate(sample.select("positive", "doc_id").orderBy(F.col("positive").desc(), "doc_id").collect())}
    n_p = sum(positive for positive, _ in numbers)
    if not n_p or n_p == len(numbers):
        return Model({}, -10.0)
    rows = checkpointed(_features(sample))
    shares = rows.groupBy("feature").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    clear = shares.where(clear_features(F.col("p"), F.col("u"), n_p, len(numbers) - n_p)).select("feature")
    kept = rows.join(clear, "feature").groupBy("positive", "doc_id").agg(F.sort_array(F.collect_list(F.struct("feature", "n"))).alias("f"))
    found = sorted((numbers[r.positive, r.doc_id], [x.feature for x in r.f], [x.n for x in r.f]) for r in kept.collect())
    prior = min(max((toxic or 0) / n if n else 0.0, 1e-4), 0.9)
    return fit(found, n_p, len(numbers), prior)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null text counts as empty, repeated rows
    stay, a null id is held out, scores at the threshold count as toxic, an empty table gives an empty one.
    Without a confirmed toxic example every score is near 0. Texts are read whole, further columns ignored."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([score(model, t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), scores], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    found = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return found.select(
        "doc_id", (~F.coalesce(in_training_fold(F.col("doc_id")), F.lit(False))).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
