"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_vectors(df: DataFrame, scale: int, below: int, keep: dict[str, Column], vector_col: str = "embedding") -> DataFrame:
    """The columns ``keep`` and ``v``: floor(scale * component), as long, of vectors of one length.

    Null vectors and those with a null, non-finite or absurd component (``below`` or more after scaling: sums
    would leave a long) are dropped, and so are vectors of another length than most (of equally many the
    longest); an empty table stays empty. Only the named columns are read, whatever others there are.
    """
    small = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < below / scale, F.lit(False)))
    rows = df.where(F.col(vector_col).isNotNull() & small).select(F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale)).alias("v"), *[c.alias(n) for n, c in keep.items()])
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (most.d if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
