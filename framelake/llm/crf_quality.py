"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features and those of the lines beside it, with
transition weights between neighbouring labels. A document's quality is the mean of its lines'
forward-backward marginals, weighted by line length. The field is fitted on a bounded sample of
labelled documents (each line inherits its document's label) and then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import id_text, in_training_fold, sample_ids, sampled_texts, small_batches, tidied

#: Most documents of each label that the field is fitted on.
SAMPLE_PER_LABEL = 1500
THRESHOLD = 0.3

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!#$%&*|~^<>{}=+@_/\\`", ".,;:?'\"()[]-", " \t\r\v\f")
_LUT = np.full(256, 6, np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _LUT[[ord(c) for c in _chars]] = _k
_LUT[10] = 7


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x features) of all lines of the texts, their lengths, and the lines per text."""
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    buf = b"\n".join(texts) + b"\n"
    kinds = _LUT[np.frombuffer(buf, np.uint8)]
    ends = np.flatnonzero(kinds == 7)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype(float)
    share = [np.add.reduceat((kinds == k).astype(np.uint8), starts, dtype=np.int64) / np.maximum(length, 1) for k in range(7)]
    words, distinct, same = np.empty(len(starts)), np.empty(len(starts)), np.zeros(len(starts))
    before = None
    for i, line in enumerate(buf[:-1].split(b"\n")):
        w = line.split()
        words[i], distinct[i] = len(w), len(set(w))
        same[i] = line == before and len(w) > 0
        before = line
    own = np.column_stack([
        np.log1p(length), *share, np.log1p(words), length / np.maximum(words, 1), distinct / np.maximum(words, 1),
        np.log1p(distinct) / np.log1p(np.maximum(words, 1)), same, length == 0, (share[3] > 0.05).astype(float), (share[0] > 0.5).astype(float),
    ])
    return own, length, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A line's features beside those of the lines before and after it in its text (zeros at the ends)."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int)
    last = first + counts - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    edge = np.zeros((len(own), 3))
    edge[first, 0], edge[last, 1], edge[:, 2] = 1, 1, 1
    return np.hstack([own, before, after, edge])


@dataclass
class Field:
    mean: np.ndarray
    std: np.ndarray
    weight: np.ndarray
    trans: np.ndarray  # from, to
    start: np.ndarray

    def inputs(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return with_neighbours(np.clip((own - self.mean) / self.std, -6, 6), counts)


def forward_backward(scores: np.ndarray, counts: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (lines x 2) and the expected transitions (2 x 2) of chains laid end to end.

    All chains advance together, longest first, so that those still running are a prefix.
    """
    order = np.argsort(-counts, kind="stable")
    size, first = counts[order], (np.cumsum(counts) - counts)[order]
    running = lambda t: first[: np.searchsorted(-size, -t, side="left")]  # noqa: E731  chains longer than t
    alpha, beta = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    alpha[first] = scores[first] + start
    for t in range(1, size[0] if len(size) else 0):
        at = running(t) + t
        a = alpha[at - 1]
        alpha[at] = scores[at] + np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1])
    for t in range((size[0] if len(size) else 0) - 2, -1, -1):
        at = running(t + 1) + t
        b = beta[at + 1] + scores[at + 1]
        beta[at] = np.logaddexp(trans[:, 0] + b[:, :1], trans[:, 1] + b[:, 1:])
    both = alpha + beta
    norm = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.ones(len(scores), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] + trans + (scores[at] + beta[at])[:, None, :] - norm[at][:, None, None]
    return np.exp(both - norm[:, None]), np.exp(pair).sum(axis=0)


def fit(texts: list[bytes], labels: list[int], rounds: int = 80, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by full-batch Adam. Without both labels, the field says what it has seen."""
    own, _, counts = line_features(texts or [b""])
    mean, std = own.mean(axis=0), own.std(axis=0) + 1e-3
    field = Field(mean, std, np.zeros(3 * own.shape[1] + 3), np.zeros((2, 2)), np.zeros(2))
    if len(set(labels)) < 2:
        field.weight[-1] = 0.0 if not labels else 3.0 * (2 * labels[0] - 1)
        return field
    x, y = field.inputs(own, counts), np.repeat(np.array(labels), counts)
    of = np.repeat(np.arange(len(counts)), counts)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:-1][of[1:] == of[:-1]], y[1:][of[1:] == of[:-1]]), 1)
    first = np.cumsum(counts) - counts
    starts = np.bincount(y[first], minlength=2)
    theta = np.zeros(len(field.weight) + 6)
    m, v, n, k = np.zeros_like(theta), np.zeros_like(theta), len(y), len(field.weight)
    for step in range(1, rounds + 1):
        scores = np.column_stack([np.zeros(n), x @ theta[:k]])
        marg, moved = forward_backward(scores, counts, theta[k : k + 4].reshape(2, 2), theta[k + 4 :])
        slope = np.concatenate([x.T @ (y - marg[:, 1]), (pairs - moved).ravel(), starts - marg[first].sum(axis=0)]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.weight, field.trans, field.start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
    return field


def score(field: Field, texts: list[bytes]) -> np.ndarray:
    """Quality of each text: length-weighted mean of its lines' marginals for good (an empty line weighs 1)."""
    if not texts:
        return np.zeros(0)
    own, length, counts = line_features(texts)
    scores = np.column_stack([np.zeros(len(own)), field.inputs(own, counts) @ field.weight])
    good = forward_backward(scores, counts, field.trans, field.start)[0][:, 1]
    first = np.cumsum(counts) - counts
    weight = length + 1
    return np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0, 1)


#: Most lines that the field is fitted on.
SAMPLE_LINES = 300_000


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, max_lines: int = SAMPLE_LINES) -> Field:
    """Fit on at most ``per_label`` documents of each label, ``common.SAMPLE_BYTES`` of text and ``max_lines`` lines (a
    document that does not fit any more is passed over), from the training fold only."""
    known = labels.where(in_training_fold(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    ids = sample_ids(known.where("quality = 0"), "doc_id", per_label, 6).union(sample_ids(known.where("quality = 1"), "doc_id", per_label, 6))
    label = dict(known.groupBy("doc_id").agg(F.max("quality")).join(F.broadcast(ids), "doc_id").distinct().collect())
    found, lines = [], 0
    for i, text in sorted(sampled_texts(id_text(docs), ids), key=lambda r: crc32(str(r[0]).encode()[::-1])):
        n = text.count("\n") + 1
        if i in label and lines + n <= max_lines:
            found.append((text.encode(), int(label[i])))
            lines += n
    return fit([t for t, _ in found], [y for _, y in found])


def scored(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` added: the quality of each whole text (null counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(text_col).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(field, texts))], names=[*b.schema.names, out])

    small_batches(docs.sparkSession)
    kept = docs.drop(out)
    schema = StructType([*kept.schema.fields, StructField(out, DoubleType())])
    return kept.mapInArrow(tidied(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row. Null text counts as empty, repeated rows stay, a null
    id is held out, a score at the threshold counts as good, an empty table gives an empty one. A text of n
    lines takes n steps forward and back, whatever their length; further columns are ignored."""
    texts = id_text(docs)
    found = scored(texts, train(docs, labels, per_label)).drop("text")
    return found.select(
        "doc_id", (~F.coalesce(in_training_fold(F.col("doc_id")), F.lit(False))).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """The rows of ``docs``, unchanged, whose quality reaches the threshold. Null texts count as empty, repeated
    rows are judged alike, an empty table gives an empty one; without labels all rows score 0.5 and stay."""
    field = train(docs, labels, per_label)
    name = "__quality"
    while name in docs.columns:
        name += "_"
    return scored(docs, field, out=name).where(F.col(name) >= threshold).drop(name)
