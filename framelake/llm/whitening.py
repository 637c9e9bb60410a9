"""Whitening of embeddings from exact second moments: bit-sliced scatter.

Components become whole numbers. The fit list, each distinct vector once, goes through its tasks batch by batch: each
dimension is shifted by its least value in the batch, cut into bit planes, and each plane is packed across rows into
64-bit words. The cross-product of two dimensions is the sum of popcount(plane a AND plane b), weighted by 2^(a + b),
and the shifts are undone exactly. Tasks send their sums as limbs of 40 bits, so that adding them in Spark never
overflows; n times the covariances, times n again, is a whole number, and only that is divided before the eigenvectors
are taken. The driver holds one matrix of dimensions x dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, whole_vectors

#: Each entry c becomes floor(SCALE * c) + OFFSET; below this it stays far inside a long.
SCALE, OFFSET, BELOW = 64, 1_000_000, 1 << 61
#: Components returned, and bits of a limb of a sum.
COMPONENTS, LIMB = 16, 40
#: Eigenvalues up to this share of the largest are taken as 0: there is no direction to scale.
FLAT = 1e-12


def scatter(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums per dimension and of all products of two dimensions, as Python integers."""
    rows, d = z.shape
    shift = z.min(axis=0)
    shifted = z.astype(np.uint64) - shift.astype(np.uint64)  # modulo 2^64, as the difference is
    planes, weight = [], []
    for j in range(d):
        for bit in range(int(shifted[:, j].max()).bit_length()):
            packed = np.packbits(((shifted[:, j] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8))
            planes.append(np.pad(packed, (0, -len(packed) % 8)))
            weight.append((j, bit))
    words = np.array(planes, np.uint8).reshape(len(planes), -1).view(np.uint64) if planes else np.zeros((0, 0), np.uint64)
    wide = 2 * (max((bit for _, bit in weight), default=0) + 1) + rows.bit_length() > 62
    kind = object if wide else np.int64
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        counts[p, p:] = counts[p:, p] = np.bitwise_count(words[p] & words[p:]).sum(axis=1)
    spread = np.zeros((d, len(planes)), kind)
    for p, (j, bit) in enumerate(weight):
        spread[j, p] = 1 << bit
    cross = (spread @ counts.astype(kind) @ spread.T).astype(object) if planes else np.zeros((d, d), object)
    sums = (spread @ np.diagonal(counts).astype(kind)).astype(object) if planes else np.zeros(d, object)
    s = np.array([int(x) for x in shift], object)
    return sums + rows * s, cross + np.outer(s, sums) + np.outer(sums, s) + rows * np.outer(s, s)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Limb numbers and limbs of a number, the highest with its sign."""
    k = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield k, value & ((1 << LIMB) - 1)
        value, k = value >> LIMB, k + 1
    if value:
        yield k, value


def moments(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross-products (Python integers) of a column ``v`` of whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, 0, 0
        for b in batches:
            if b.num_rows:
                s, c = scatter(matrix(b.column("v")))
                n, sums, cross = n + b.num_rows, sums + s, cross + c
        if n:
            d = len(sums)
            entries = [(-1, -1, n)] + [(j, -1, int(sums[j])) for j in range(d)] + [(i, j, int(cross[i, j])) for i in range(d) for j in range(i, d)]
            rows = [(i, j, k, x) for i, j, value in entries for k, x in _limbs(value)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["i", "j", "k", "x"])

    parts = fit.select("v").mapInArrow(run, "i long, j long, k long, x long").groupBy("i", "j", "k").agg(F.sum("x").alias("x")).toArrow()  # limbs of dimensions x dimensions numbers
    total: dict[tuple[int, int], int] = {}
    for i, j, k, x in zip(*(parts[c].to_pylist() for c in ("i", "j", "k", "x")), strict=True):
        total[i, j] = total.get((i, j), 0) + (x << (LIMB * k))
    n = total.get((-1, -1), 0)
    size = fit.select(F.size("v").alias("d")).first() if n else None
    d = size.d if size else 0
    cross = np.array([[total.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)], object).reshape(d, d)
    return n, np.array([total.get((j, -1), 0) for j in range(d)], object), cross


def axes(n: int, sums: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, unit eigenvectors (columns), shares of the trace. Centred as whole numbers."""
    exact = n * cross - np.outer(sums, sums)
    v = np.array([[int(x) / (n * n) for x in row] for row in exact], np.float64).reshape(len(sums), len(sums))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = sum(int(exact[j, j]) for j in range(len(sums))) / (n * n)
    return values, vectors, values / trace if trace else np.zeros(len(values))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Null vectors and those with null, non-finite or absurd (2^55 or more) entries are dropped, and those of another
    length than most; repeated rows and rows without an id stay, the fit list has each distinct vector once. With fewer
    dimensions than ``components`` there are as many components as dimensions. A component without variance is 0 for
    every row, and takes no part in ``identity_error``; ``deviation`` is null where it does not fit a long. An empty
    table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, SCALE, BELOW, {"vec_id": F.col(id_col)}, vector_col)
    fit = rows.select("v").distinct()
    n, sums, cross = moments(fit)  # of x - OFFSET: covariances and deviations are the same
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double"
    if not n or not len(sums):
        return spark.createDataFrame([], f"{schema}, explained double, identity_error double")
    values, basis, shares = axes(n, sums, cross)
    m = min(components, len(sums))
    real = values[:m] > max(values[0], 0.0) * FLAT if values[0] > 0 else np.zeros(m, bool)
    scaled = np.where(real, basis[:, :m] / np.sqrt(np.where(real, values[:m], 1.0)), 0.0)

    def project(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n z - sums as whole numbers, and the whitened components."""
        far = n * int(np.abs(z).max(initial=0)) + max(abs(int(s)) for s in sums)
        off = z * n - sums.astype(np.int64) if far < 1 << 62 else z.astype(object) * n - sums
        return off, (off / n).astype(np.float64) @ scaled

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m))
        for b in batches:
            if b.num_rows:
                w = project(matrix(b.column("v")))[1]
                total += w.T @ w
        i, j = np.indices((m, m))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "x"])

    measured = np.zeros((m, m))
    for r in fit.mapInArrow(products, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # components x components numbers
        measured[r.i, r.j] = r.x / n
    error = float(np.abs(measured - np.eye(m))[np.ix_(real, real)].max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                off, w = project(matrix(part.column("v")))
                rows_n, ids = len(off), part.column("vec_id")
                if off.dtype != object and float((off.astype(np.float64) ** 2).sum(axis=1).max()) < 2.0**62:
                    deviation = pa.array((off * off).sum(axis=1))
                else:
                    exact = [sum(int(x) ** 2 for x in row) for row in off]
                    deviation = pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())
                each = pa.array(np.repeat(np.arange(rows_n), m))
                yield pa.RecordBatch.from_arrays([ids.take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows_n)), pa.array(np.full(rows_n * m, n)), deviation.take(each), pa.array(w.ravel())], names=["vec_id", "component", "n", "deviation", "whitened"])

    shown = F.array(*[F.lit(float(x)) for x in shares[:m]])
    return rows.mapInArrow(run, schema).withColumns({"explained": shown[F.col("component") - 1], "identity_error": F.lit(error)})
