"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common neighbour within half of it on either side.
So every distinct fingerprint emits all variants within ``ceil(radius / 2)`` bits, variants are
shuffled, and those that meet in a variant are verified and linked. Copies share a fingerprint and
are collapsed before anything is emitted; a variant is met by as many fingerprints as its own ball
holds at most (65 at radius 2), so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, id_text, small_batches
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42


def fingerprint(data: bytes, k: int = SHINGLE) -> int:
    """SimHash of UTF-8 bytes: lower-cased A-Z, words between ASCII white space, shingles of ``k`` words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        starts = [0, *ends[: len(words) - k]]
        hashes = [digest(view[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)]
    octets = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(octets), 16384):
        ones += np.unpackbits(octets[at : at + 16384], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def ball_masks(reach: int) -> list[int]:
    """All bit patterns of at most ``reach`` ones, as signed longs."""
    masks = [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u, v`` whose closure is that of all pairs of distinct ``fp`` within ``radius`` bits."""
    reach = (radius + 1) // 2
    masks = fps.sparkSession.createDataFrame([(ball_masks(reach),)], "masks array<long>").first().masks
    variants = fps.select("fp", F.explode(F.transform(F.lit(masks), lambda m: m.bitwiseXOR(F.col("fp")))).alias("variant"))
    distance = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    if 2 * reach == radius:  # all that meet are within the radius of each other: a star holds the group
        met = variants.withColumn("low", F.min("fp").over(Window.partitionBy("variant")))
        return met.where("fp <> low").where(distance("fp", "low") <= radius).select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()
    met = variants.groupBy("variant").agg(F.sort_array(F.collect_set("fp")).alias("all")).where(F.size("all") > 1)
    one = met.select("all", F.explode("all").alias("u"))
    return one.select("u", F.explode("all").alias("v")).where("v < u").where(distance("u", "v") <= radius).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``.

    component_id: smallest doc_id reachable over links, the document's own included. Documents
    without words share fingerprint zero and link like others. A null doc_id never names a
    component unless its whole component has none. Repeated rows stay; empty table: empty result.
    """
    rows = checkpointed(fingerprints(docs))
    groups = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(groups.select("fp"), radius))
    of = groups.join(found, groups.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = of.groupBy("component").agg(F.min("low").alias("component_id"))
    named = checkpointed(of.join(lows, "component").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays."""
    return keep_lowest(docs, near_duplicates(docs, radius))


def keep_lowest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is the ``component_id`` that ``found`` has for it.

    doc_id is the key: of rows that repeat a kept one, one stays (the first where they differ). Rows
    without a doc_id are kept, since nothing names them. The texts are shuffled once, by the key, for
    both steps. Columns may have any names and types.
    """
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").cast("string").alias("key")).distinct()
    own = F.concat(F.lit("row "), F.monotonically_increasing_id())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), own).alias("key"), F.monotonically_increasing_id().alias("at"), row)
    first = Window.partitionBy("key").orderBy("at")
    return keyed.join(drop, "key", "left_anti").withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*")
