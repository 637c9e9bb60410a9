"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are grouped by length: classes of lengths within a factor of ``RATIO``, cut by a hash into shards and,
longest first, into buckets of some thousand vectors. A query's inner product with a vector of length l is at most
|q| l, so with a lower bound of its k-th best score, ``need`` = bound / |q|, only buckets with a vector that long
matter. Such a bound comes first from one bounded bucket of the longest class. Queries are cut into blocks; a tile is
a shard and a group of blocks, and shards that no query of a group can need are never joined to it. In a tile the
bound of every query rises from bucket to bucket. The local cosine threshold need / (longest of the bucket) decides
between two ways, for each query and bucket: up to ``COORD_FROM`` the vectors that are long enough are multiplied
(length pruning); above it, only vectors whose normalised components at the query's largest coordinates lie in the
interval that such a cosine allows (coordinate pruning). What is left is verified by its exact integer product.

A task holds one shard and one block, however many rows there are; a vector that many rows share is
dealt over the shards of its class by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, tidied
from .vectors import batches_of, matrix, whole_vectors

#: Lengths of a class differ by less than this factor.
RATIO = 0.95
#: Components of a bucket, of a shard, and of a block of queries, at most (a shard's by a hash, so about).
BUCKET_CELLS, SHARD_CELLS, BLOCK_CELLS = 1 << 17, 1 << 22, 1 << 16
#: Blocks that share a tile.
GROUP_BLOCKS = 16
#: Local cosine threshold from which coordinates prune better than lengths, and the coordinates looked at.
COORD_FROM, FOCUS = 0.8, 3
#: Rounding of the floating-point bounds: bounds are loosened by it, products are exact.
LOOSE = 1e-9
#: Class of vectors of length 0, and the bound of a query that has none.
NOTHING, UNBOUND = 1 << 20, np.iinfo(np.int64).min
#: Scaled components must stay below this; then products of up to 64 components fit a long.
BELOW = 1 << 28


class Bucket:
    """Vectors by falling length, with sorted coordinates made when they are first asked for."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, copies: np.ndarray, data: np.ndarray) -> None:
        self.ids, self.known, self.copies, self.data = ids, known, copies, data
        self.largest = int(np.abs(data).max(initial=0))
        self.length = np.sqrt((data.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(self.length[0]) if len(ids) else 0.0
        self.real = data.astype(np.float64)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.unit = self.real / np.maximum(self.length, 1e-300)[:, None]

    def column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = (self.unit[order, f], order)
        return self.sorted[f]

    def by_coordinates(self, unit_q: np.ndarray, t: float, need: float) -> np.ndarray:
        """Places of the vectors that a cosine of ``t`` or more to ``unit_q`` and a length of ``need`` leave."""
        focus = np.argsort(-np.abs(unit_q), kind="stable")[:FOCUS]
        t = min(max(t, -1.0), 1.0)
        spread = np.sqrt(np.maximum(0.0, (1 - t * t) * (1 - unit_q[focus] ** 2))) + math.sqrt(LOOSE)
        low, high = t * unit_q[focus] - spread, t * unit_q[focus] + spread
        high = np.where(unit_q[focus] >= t, 1.1, high)  # a unit vector along the axis itself has that cosine
        low = np.where(-unit_q[focus] >= t, -1.1, low)
        values, order = self.column(int(focus[0]))
        found = order[np.searchsorted(values, low[0], "left") : np.searchsorted(values, high[0], "right")]
        for f, a, b in zip(focus[1:], low[1:], high[1:], strict=True):
            x = self.unit[found, f]
            found = found[(x >= a) & (x <= b)]
        return found[self.length[found] >= need * (1 - LOOSE)]


def products(data: np.ndarray, bucket: Bucket, upto: int) -> np.ndarray:
    """Inner products of ``data`` with the first vectors of a bucket: by floating point where that is exact."""
    if bucket.data.shape[1] * bucket.largest * int(np.abs(data).max(initial=0)) < 1 << 53:
        return (data.astype(np.float64) @ bucket.real[:upto].T).astype(np.int64)
    return data @ bucket.data[:upto].T


class Best:
    """The k best candidates so far of each query of a block; ties to the smaller id, none last."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, bound: np.ndarray, k: int) -> None:
        self.ids, self.data, self.bound, self.k = ids, data, bound.copy(), k
        self.length = np.sqrt((data.astype(np.float64) ** 2).sum(axis=1))
        self.row, self.score, self.id, self.copies = (np.zeros(0, np.int64) for _ in range(4))
        self.known = np.zeros(0, bool)

    def needs(self) -> np.ndarray:
        return np.where((self.length > 0) & (self.bound != UNBOUND), self.bound / np.maximum(self.length, 1e-300), -np.inf)

    def offer(self, row: np.ndarray, score: np.ndarray, bucket: Bucket, at: np.ndarray) -> None:
        """Take the vectors ``at`` of a bucket for the queries ``row``, where they are good enough."""
        other = (score >= self.bound[row]) & ~(bucket.known[at] & (bucket.ids[at] == self.ids[row]))
        row, score, at = row[other], score[other], at[other]
        new = ((self.row, row), (self.score, score), (self.id, bucket.ids[at]), (self.known, bucket.known[at]), (self.copies, bucket.copies[at]))
        row, score, id_, known, copies = (np.concatenate(pair) for pair in new)
        order = np.lexsort((id_, ~known, -score, row))
        row, score, id_, known, copies = row[order], score[order], id_[order], known[order], copies[order]
        starts = np.searchsorted(row, row, "left")
        place = np.arange(len(row)) - starts
        full = place == self.k - 1
        self.bound[row[full]] = np.maximum(self.bound[row[full]], score[full])
        keep = place < self.k
        self.row, self.score, self.id, self.known, self.copies = row[keep], score[keep], id_[keep], known[keep], copies[keep]

    def search(self, bucket: Bucket) -> None:
        """Offer the vectors of a bucket that may be among the best."""
        need = self.needs()
        t = need / bucket.longest if bucket.longest > 0 else np.where(need > 0, np.inf, -np.inf)
        live = t <= 1 + LOOSE
        by_length = np.flatnonzero(live & (t < COORD_FROM))
        if len(by_length):
            upto = int((bucket.length >= need[by_length].min() * (1 - LOOSE)).sum()) if need[by_length].min() > 0 else len(bucket.ids)
            scores = products(self.data[by_length], bucket, upto)
            scores[bucket.known[:upto] & (bucket.ids[:upto] == self.ids[by_length][:, None])] = UNBOUND
            cut = np.partition(scores, upto - self.k, axis=1)[:, upto - self.k] if upto > self.k else np.full(len(by_length), UNBOUND)
            r, c = np.nonzero(scores >= np.maximum(cut, self.bound[by_length])[:, None])
            self.offer(by_length[r], scores[r, c], bucket, c)
        for q in np.flatnonzero(live & (t >= COORD_FROM)):
            found = bucket.by_coordinates(self.data[q] / self.length[q], t[q] * (1 - LOOSE), need[q])
            if len(found):
                exact = bucket.data[found] @ self.data[q]
                self.offer(np.full(len(found), q), exact, bucket, found)


def _columns(group: pa.Table, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them there are, copies and vectors of rows ``id, copies, v``."""
    ids, copies, v = (group[c].combine_chunks() for c in ("id", "copies", "v"))
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), copies.to_numpy(), matrix(v).reshape(-1, d)


def _packed(ids: np.ndarray, known: np.ndarray, copies: np.ndarray, data: np.ndarray) -> dict[str, bytes]:
    return {"ids": ids.tobytes(), "known": known.tobytes(), "copies": copies.tobytes(), "data": data.astype(np.int32).tobytes()}


def _unpacked(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, copies = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64)
    return ids, np.frombuffer(row["known"], bool), copies, np.frombuffer(row["data"], np.int32).reshape(len(ids), d).astype(np.int64)


PACKED = ["ids", "known", "copies", "data"]
BYTES = ", ".join(f"{c} binary" for c in PACKED)
FOUND = "query_id long, rank int, vec_id long, score long"


def _arrow(numbers: list[str], more: tuple[str, ...] = ()) -> pa.Schema:
    return pa.schema([(c, pa.int64()) for c in numbers] + [(c, pa.binary()) for c in (*more, *PACKED)])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` other rows of the highest integer inner product.

    Components become floor(scale * x). Queries are the rows with ``is_query`` and an id; of query rows that
    share an id the least vector is asked for. Every row whose id is not the query's is a candidate, repeated
    rows each for itself, rows without an id too (last among equal scores). Null vectors, those with null,
    non-finite or absurd components and those of another length than most take no part; an empty table gives an
    empty one, and fewer candidates than ``k`` give all.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale, BELOW, {"id": F.col(id_col).cast("long"), "q": F.coalesce(is_query, F.lit(False))}, vector_col)
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    kind = F.when(F.col("__s") > 0, F.floor(-F.log("__s") / (-2 * math.log(RATIO)))).otherwise(NOTHING).cast("long")
    classed = rows.withColumn("__s", squares).withColumn("kind", kind).drop("__s")
    counts = classed.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(F.size("v")).alias("d")).orderBy("kind").collect()  # lengths of a long: under 900 classes
    if not counts or not sum(r.q for r in counts):
        return spark.createDataFrame([], FOUND)
    total, d = sum(r.n for r in counts), max(1, counts[0].d)
    bucket_rows = max(64, BUCKET_CELLS // d)
    per_shard = min(max(bucket_rows, SHARD_CELLS // d), max(bucket_rows, math.ceil(total / (2 * spark.sparkContext.defaultParallelism))))
    first, shards, upper = {}, 0, []
    for r in counts:
        first[r.kind] = (shards, n := math.ceil(r.n / per_shard))
        shards += n
        upper.append((math.exp(r.kind * math.log(RATIO)) * (1 + LOOSE) if r.kind < NOTHING else 0.0, shards - 1))
    at = F.create_map(*[F.lit(x) for c, (a, n) in first.items() for x in (c, a)])
    of = F.create_map(*[F.lit(x) for c, (a, n) in first.items() for x in (c, n)])
    whole = classed.groupBy("id", "v", "kind").agg(F.least(F.count("*"), F.lit(k)).alias("copies"), F.max("q").alias("q"))
    placed = whole.withColumn("shard", (at[F.col("kind")] + F.pmod(F.xxhash64("id", "v"), of[F.col("kind")])).cast("long"))

    def pack(group: pa.Table) -> pa.Table:
        columns = _columns(group, d)
        order = np.lexsort((columns[0], -(columns[3].astype(np.float64) ** 2).sum(axis=1)))
        cuts = (order[a : a + bucket_rows] for a in range(0, len(order), bucket_rows))
        shard = group["shard"][0].as_py()
        return pa.Table.from_pylist([{"shard": shard, "no": n, **_packed(*[c[o] for c in columns])} for n, o in enumerate(cuts)], _arrow(["shard", "no"]))

    buckets = placed.select("shard", "id", "copies", "v").groupBy("shard").applyInArrow(pack, f"shard long, no long, {BYTES}")

    # a lower bound of the k-th best score of every query: its products with a bucket's worth of long vectors
    share = math.ceil(counts[0].n / bucket_rows)
    some = classed.where((F.col("kind") == counts[0].kind) & (F.pmod(F.xxhash64("v", "id"), F.lit(share)) == 0)).select("id", F.lit(1).cast("long").alias("copies"), "v")
    seed = _columns(some.limit(bucket_rows).toArrow(), d)  # copies of a row may be among them: they are told apart below
    seed = [c[np.unique(np.column_stack([seed[1], seed[0], seed[3]]), axis=0, return_index=True)[1]] for c in seed]
    order = np.argsort(-(seed[3].astype(np.float64) ** 2).sum(axis=1), kind="stable")
    seed = [c[order] for c in seed]

    block_rows = max(16, BLOCK_CELLS // d)
    blocks_n = math.ceil(sum(r.q for r in counts) / block_rows)

    def block(group: pa.Table) -> pa.Table:
        columns = _columns(group, d)
        best = Best(columns[0], columns[3], np.full(group.num_rows, UNBOUND), k)
        if len(seed[0]):
            best.search(Bucket(*seed))
        least, last = best.needs().min(), -1
        for longest, upto in upper:
            if longest >= least * (1 - LOOSE) or least <= 0:
                last = upto
        no = group["block"][0].as_py()
        return pa.Table.from_pylist([{"block": no, "grp": no // GROUP_BLOCKS, "last": last, "bound": best.bound.tobytes(), **_packed(*columns)}], _arrow(["block", "grp", "last"], ("bound",)))

    asked = whole.where(F.col("q") & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v")).withColumns({"copies": F.lit(1).cast("long"), "block": F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks_n))})
    blocks = checkpointed(asked.groupBy("block").applyInArrow(block, f"block long, grp long, last long, bound binary, {BYTES}"))

    tiles = blocks.groupBy("grp").agg(F.max("last").alias("last")).where("last >= 0").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("shard"))
    side = buckets.join(tiles, "shard").select("shard", "grp", F.lit(0).alias("kind"), "no", F.lit(None).cast("binary").alias("bound"), *PACKED)
    over = blocks.where("last >= 0").select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("shard"), "grp", F.lit(1).alias("kind"), F.col("block").alias("no"), "bound", *PACKED)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["grp"]) != tile:
                    tile, held = (row["shard"], row["grp"]), []
                if row["kind"] == 0:
                    held.append(Bucket(*_unpacked(row, d)))
                    continue
                ids, _, _, data = _unpacked(row, d)
                best = Best(ids, data, np.frombuffer(row["bound"], np.int64), k)
                for bucket in held:
                    best.search(bucket)
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.row]), pa.array(best.id, mask=~best.known), pa.array(best.score), pa.array(best.copies)], names=["query_id", "vec_id", "score", "copies"])

    met = side.unionByName(over).repartition("shard", "grp").sortWithinPartitions("shard", "grp", "kind", "no")
    with batches_of(spark, 8):
        found = checkpointed(met.mapInArrow(tidied(search), "query_id long, vec_id long, score long, copies long"))
    order_by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
