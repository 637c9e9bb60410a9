"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch of the Python stages: keeps a worker's memory bounded when texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows for the Python stages of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tidied(run: Callable) -> Callable:
    """A function over batches that gives back, at its end, the memory that its worker has no use for any more."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or that the session has set. A
    temporary one is made only where neither is there and driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="framelake-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and where it is: lineage is cut, and later steps know its size."""
    folder = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def dropped(spark: SparkSession, folder: str) -> None:
    """Remove a table that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, as ``doc_id`` and ``text`` (null text: empty).

    Selecting first makes further columns harmless, whatever they are called.
    """
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def in_training_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def sample_ids(df: DataFrame, id_col: str, n: int, salt: int) -> DataFrame:
    """At most ``n`` ids, the ones with the smallest hash: a bounded sample that any cluster repeats."""
    ids = df.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    return ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(n)


#: Most bytes of text that a classifier is fitted on.
SAMPLE_BYTES = 24 << 20


def sampled_rows(docs: DataFrame, ids: DataFrame, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``doc_id, text`` of a bounded set of ids (the smallest text where an id is repeated): as many
    as ``max_bytes`` hold, in the order of a hash; a longer text alone is passed over."""
    found = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sizes = found.select("doc_id", F.octet_length("text").alias("n")).where(F.col("n") <= max_bytes).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").collect()  # ids and sizes of a bounded sample
    total, kept = 0, []
    for r in sizes:
        if total + r.n <= max_bytes:
            total += r.n
            kept.append((r.doc_id,))
    chosen = docs.sparkSession.createDataFrame(kept, "doc_id long")
    return found.join(F.broadcast(chosen), "doc_id", "left_semi")


def sampled_texts(docs: DataFrame, ids: DataFrame, max_bytes: int = SAMPLE_BYTES) -> list[tuple[int, str]]:
    """The rows of ``sampled_rows``, sorted by id."""
    return sorted((r.doc_id, r.text) for r in sampled_rows(docs, ids, max_bytes).collect())
