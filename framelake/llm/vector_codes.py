"""Product codes of vectors, trained and assigned by equal-average search.

A vector is cut into parts; each part has a codebook of 256 entries, trained by rounds of assigning every part to its
nearest entry and moving entries to the floor of their parts' mean. The nearest entry is found by equal-average
search: the squared gap between two vectors' component sums, divided by the dimension, is at most their squared distance. So
entries are sorted by their sum, and a part's search starts at its own sum and expands outward on both sides,
until the squared gap over the dimension strictly exceeds the best distance (strictly: ties go to the lower index).
Parts of a batch are sorted by their sums and expanded in runs, so that a step is a small matrix product; a part
leaves its run's search as soon as its own gap is too large.

Codebooks are a bounded number of whole numbers: tasks get them with their code and return sums per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import matrix, whole_vectors

#: Parts of a vector, entries of a codebook, rounds of training, factor of the components.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components stay below this: squared distances of up to 64 dimensions fit a long.
BELOW = 1 << 27
#: Parts of a run, entries that a step expands to on each side.
RUN, STEP = 256, 16


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) and squared distance of every part, by equal-average search."""
    rows, d = parts.shape
    sums, entry_sums = parts.sum(axis=1), book.sum(axis=1)
    by_sum = np.argsort(entry_sums, kind="stable")
    ordered, sorted_sums = book[by_sum], entry_sums[by_sum]
    small = d * (2 * max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))) ** 2 < 1 << 52
    kind = np.float64 if small else np.int64  # floating point is exact for small numbers, and faster
    real, squares = ordered.astype(kind), (ordered * ordered).sum(axis=1).astype(kind)
    index, best = np.full(rows, len(book)), np.full(rows, np.iinfo(np.int64).max)
    order = np.argsort(sums, kind="stable")
    for a in range(0, rows, RUN):
        live = order[a : a + RUN]
        left = right = int(np.searchsorted(sorted_sums, sums[live[len(live) // 2]]))
        while len(live):
            low, high = max(0, left - STEP), min(len(book), right + STEP)
            fresh = np.r_[low:left, right:high]
            if not len(fresh):
                break
            x = parts[live].astype(kind)
            distance = ((x * x).sum(axis=1)[:, None] - 2 * (x @ real[fresh].T) + squares[fresh]).astype(np.int64)
            least = distance.min(axis=1)
            which = np.where(distance == least[:, None], by_sum[fresh], len(book)).min(axis=1)
            better = (least < best[live]) | ((least == best[live]) & (which < index[live]))
            index[live[better]], best[live[better]] = which[better], least[better]
            left, right = low, high
            # the next entry on each side, and whether it may still be as near
            gap_left = sums[live] - (sorted_sums[left - 1] if left else 0)
            gap_right = (sorted_sums[right] if right < len(book) else 0) - sums[live]
            open_left = (left > 0) & _within(gap_left, best[live], d)
            open_right = (right < len(book)) & _within(gap_right, best[live], d)
            live = live[open_left | open_right]
    return index, best


def _within(gap: np.ndarray, best: np.ndarray, d: int) -> np.ndarray:
    """Whether gap^2 / d does not exceed ``best``. A gap on the way to the part's own sum is not one yet."""
    ahead = np.maximum(gap, 0)
    return ahead.astype(np.float64) ** 2 <= best.astype(np.float64) * d * (1 + 1e-12)


def cuts(d: int) -> list[int]:
    """Borders of the parts: equal where the number of parts divides the dimension."""
    return [d * k // PARTS for k in range(PARTS + 1)]


def train(rows: DataFrame, first: np.ndarray) -> list[np.ndarray]:
    """The codebooks after all rounds, from the vectors they start with; ``rows`` has whole vectors ``v``."""
    at = cuts(first.shape[1])
    books = [first[:, a:b].copy() for a, b in zip(at, at[1:], strict=False)]
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros_like(b) for b in books]
            counts = [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                if batch.num_rows:
                    v = matrix(batch.column("v"))
                    for p, book in enumerate(books):
                        part = v[:, at[p] : at[p + 1]]
                        found, _ = nearest(part, book)
                        np.add.at(sums[p], found, part)
                        counts[p] += np.bincount(found, minlength=len(book))
            keys = [(p, e) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
            for p, e in keys:
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([int(e)]), pa.array([int(counts[p][e])]), pa.array([sums[p][e].tolist()], pa.list_(pa.int64()))], names=["p", "e", "n", "s"])

        sent = rows.select("v").mapInArrow(run, "p long, e long, n long, s array<long>")
        places = sent.select("p", "e", "n", F.posexplode("s").alias("at", "x"))
        whole = places.groupBy("p", "e", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # a number per place of an entry
        books = [b.copy() for b in books]
        for r in whole:
            books[r.p][r.e, r.at] = r.x // r.n
    return books


def book_hash(books: list[np.ndarray]) -> str:
    """sha256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row.

    Null vectors, those with null, non-finite or absurd (2^17 or more) components and those of another length than
    most are dropped; repeated rows stay, each counts. Codebooks start with the rows of the smallest ids (of rows that
    share an id the least vector first, rows without one last), with fewer rows than 256 with those there are. Rows
    without a label add up together. A dimension that the parts do not divide is cut as evenly as can be; an empty
    table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, SCALE, BELOW, {"vec_id": F.col(id_col), "label": F.col(label_col)}, vector_col)
    kind, label = dict(rows.dtypes)["vec_id"], dict(rows.dtypes)["label"]
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()  # the entries that codebooks start with
    if not first or not first[0].v:
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    books = train(rows, np.array([r.v for r in first], np.int64))
    at = cuts(len(first[0].v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                found = [nearest(v[:, at[p] : at[p + 1]], book) for p, book in enumerate(books)]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([bytes(c).hex() for c in codes]), pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])

    coded = checkpointed(rows.mapInArrow(run, f"vec_id {kind}, label {label}, code string, error long"))
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book_hash(books)).alias("codebooks_sha256"))
