"""Aggregations: one shuffle by group key each, with partial aggregation before it."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import idiv
from .folds import SEGMENT, Columns, Composable, fold_in_segments


def stream_summary(packets: DataFrame, tb: tuple[int, int], by: str = "stream_id") -> DataFrame:
    """Packets, bytes, first and last pts, duration in ticks, mean bit rate and frame rate per stream."""
    ticks = F.max(F.col("pts") + F.col("duration")) - F.min("pts")
    seconds = F.col("ticks") * tb[0] / tb[1]
    return packets.groupBy(by).agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"), ticks.alias("ticks")
    ).withColumns({
        "bit_rate": F.when(F.col("ticks") > 0, F.round(F.col("bytes") * 8 / seconds, 6)), "fps": F.when(F.col("ticks") > 0, F.round(F.col("n") / seconds, 6)),
    })


def frame_type_totals(frames: DataFrame, by: tuple[str, ...] = ("ftype",)) -> DataFrame:
    """Per type: frames, bits, and complexity: the sum of floor(bits * qp + 0.5)."""
    return frames.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("bits").alias("bits"), F.sum(F.floor(F.col("bits") * F.col("qp") + 0.5)).cast("long").alias("complexity")
    )


def gop_summary(frames: DataFrame, bit_rate: int, fps: int, by: str = "stream_id") -> DataFrame:
    """Per group: P and B frames, bits allotted and used, and what is left over, carried on."""
    is_ = lambda t: F.sum((F.col("ftype") == t).cast("long"))
    groups = frames.groupBy(by, "gop").agg(is_("P").alias("np"), is_("B").alias("nb"), F.sum("bits").alias("used"))
    allotted = F.floor((1 + F.col("np") + F.col("nb")) * F.lit(bit_rate) / F.lit(fps) + 0.5).cast("long")
    left = F.sum(F.col("allotted") - F.col("used")).over(Window.partitionBy(by).orderBy("gop").rowsBetween(Window.unboundedPreceding, 0))
    return groups.withColumn("allotted", allotted).withColumn("left_over", left)


def gop_initial_qp(gops: DataFrame, first_qp: int, qp_min: int = 0, qp_max: int = 51, by: str = "stream_id", segment: int = SEGMENT) -> DataFrame:
    """``by, gop, qp``: first quantiser of every group (gop, np, nb, sum_qp, last_qp of its P frames) from the
    group before. The limit of two steps from the value before chains; a step maps each of the few quantisers to
    one of them, so a segment of groups brings such a table, and tables compose."""
    domain = np.array(sorted({first_qp, *range(qp_min, qp_max + 1)}))

    def averages(columns: Columns) -> np.ndarray:
        n_p, n_b, total, last = (columns[c] for c in ("np", "nb", "sum_qp", "last_qp"))
        average = np.floor(total / np.maximum(n_p, 1) + 0.5) - np.minimum(2, np.floor((n_p + n_b + 1) / 15 + 0.5))
        return (average - (average > last - 2)).astype(np.int64)

    def moved(qp: np.ndarray, average: int) -> np.ndarray:
        return np.clip(np.maximum(qp - 2, np.minimum(qp + 2, average)), qp_min, qp_max)

    def effect(columns: Columns) -> list:
        table = domain
        for n_p, average in zip(columns["np"].tolist(), averages(columns).tolist(), strict=True):
            table = moved(table, average) if n_p else table
        return table.tolist()

    def fill(state: list, columns: Columns) -> list:
        qp, out = state[0], []
        for n_p, average in zip(columns["np"].tolist(), averages(columns).tolist(), strict=True):
            out.append(qp)
            qp = int(moved(np.array(qp), average)) if n_p else qp
        return [out]

    fold = Composable([first_qp], effect, lambda state, table: [table[int(np.searchsorted(domain, state[0]))]], fill)
    rows = gops.select(by, F.col("gop").cast("long").alias("gop"), *[F.col(c).cast("long").alias(c) for c in ("np", "nb", "sum_qp", "last_qp")])
    return fold_in_segments(rows, by, "gop", fold, "qp int", segment=segment)


def pixel_errors(cur: DataFrame, ref: DataFrame, by: list[str], pixel: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Sum and mean of absolute and squared differences per group, and the signal-to-noise ratio."""
    both = cur.join(ref.select(*by, *pixel, F.col("v").alias("__r")), [*by, *pixel])
    d = (F.col("v") - F.col("__r")).cast("long")
    found = both.groupBy(*by).agg(F.sum(F.abs(d)).alias("sad"), F.round(F.avg(F.abs(d)), 6).alias("mad"), F.avg(d * d).alias("__mse"))
    psnr = F.when(F.col("__mse") > 0, F.round(10 * F.log10(F.lit(255.0 * 255.0) / F.col("__mse")), 6))
    return found.withColumns({"mse": F.round("__mse", 6), "psnr": psnr}).drop("__mse")


def frame_mad(cur: DataFrame, ref: DataFrame, mb_size: int = 16, by: str = "frame_no") -> DataFrame:
    """Mean over a frame's macroblocks of their mean absolute difference."""
    cells = lambda df: df.withColumns({"bx": idiv(F.col("x"), mb_size), "by": idiv(F.col("y"), mb_size)})
    per_mb = pixel_errors(cells(cur), cells(ref), [by, "bx", "by"])
    return per_mb.groupBy(by).agg(F.round(F.avg(F.col("sad") / (mb_size * mb_size)), 6).alias("frame_mad"))


def ssim(cur: DataFrame, ref: DataFrame, win: int = 8, by: str = "frame_no") -> DataFrame:
    """Mean structural similarity over non-overlapping windows."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    both = cur.join(ref.select(by, "x", "y", F.col("v").alias("__r")), [by, "x", "y"])
    a, b = F.col("v").cast("double"), F.col("__r").cast("double")
    m = both.groupBy(by, idiv(F.col("x"), win).alias("wx"), idiv(F.col("y"), win).alias("wy")).agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(a * a).alias("aa"), F.avg(b * b).alias("bb"), F.avg(a * b).alias("ab")
    )
    va, vb, cov = F.col("aa") - F.col("ma") ** 2, F.col("bb") - F.col("mb") ** 2, F.col("ab") - F.col("ma") * F.col("mb")
    value = (2 * F.col("ma") * F.col("mb") + c1) * (2 * cov + c2) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (va + vb + c2))
    return m.groupBy(by).agg(F.round(F.avg(value), 6).alias("ssim"))


def dc_weight(cur: DataFrame, refs: DataFrame, by: str = "frame_no") -> DataFrame:
    """Weight of each reference (``by``, ref_no, v): 32 times the ratio of luma sums, rounded; 32 where
    the reference is black or the weight is out of range."""
    own = cur.groupBy(by).agg(F.sum("v").alias("__o"))
    ref = refs.groupBy(by, "ref_no").agg(F.sum("v").alias("__s"))
    w = F.when(F.col("__s") != 0, (F.lit(32.0) * F.col("__o") / F.nullif(F.col("__s"), F.lit(0).cast("long")) + 0.5).cast("long")).otherwise(F.lit(32).cast("long"))
    return ref.join(own, by).select(by, "ref_no", w.alias("w")).withColumn("w", F.when(F.col("w").between(-64, 127), F.col("w")).otherwise(32))


def letter_counts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, sym, n``: how often each of the letters a to z is in the lower-cased text; letters that are not there are
    left out. One pass over the bytes of each text: no letter is part of another character in UTF-8."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.zeros((b.num_rows, 256), np.int64)
            for k, value in enumerate(b.column("t")):
                if value.is_valid:
                    counts[k] = np.bincount(np.frombuffer(value.as_buffer(), np.uint8), minlength=256)
            rows, letters = np.nonzero(counts[:, 97:123])
            syms = pa.array([chr(97 + x) for x in range(26)]).take(pa.array(letters))
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows)), syms, pa.array(counts[rows, letters + 97])], names=[key, "sym", "n"])

    return texts.select(key, F.lower(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, sym string, n long")


def symbol_histogram(symbols: DataFrame, key: str) -> DataFrame:
    """Counts and shares of symbols (key, sym, n) per key."""
    counts = symbols.groupBy(key, "sym").agg(F.sum("n").alias("n"))
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(key)), 9))


def entropy(symbols: DataFrame, key: str) -> DataFrame:
    """Bits per symbol of each key."""
    counts = symbols.groupBy(key, "sym").agg(F.sum("n").alias("n"))
    shared = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    return shared.groupBy(key).agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("entropy"))


MAX_ALPHABET = 1000


def prefix_code_lengths(symbols: DataFrame) -> DataFrame:
    """``sym, length`` of an optimal prefix code over all counts; ties go to the smaller symbol.

    The alphabet (at most ``MAX_ALPHABET`` symbols, checked) is merged on the driver.
    """
    rows = symbols.groupBy("sym").agg(F.sum("n").alias("n")).orderBy("n", "sym").limit(MAX_ALPHABET + 1).collect()
    if len(rows) > MAX_ALPHABET:
        raise ValueError(f"more than {MAX_ALPHABET} symbols")
    heap = [(r.n, k, [r.sym]) for k, r in enumerate(rows)]
    lengths = {r.sym: 1 if len(rows) == 1 else 0 for r in rows}
    made = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            lengths[s] += 1
        heapq.heappush(heap, (n + m, made, a + b))
        made += 1
    return symbols.sparkSession.createDataFrame(sorted(lengths.items()), "sym string, length int")


def coded_size(symbols: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Coded bits of each key."""
    return symbols.join(F.broadcast(lengths), "sym").groupBy(key).agg(F.sum(F.col("n") * F.col("length")).alias("bits"))


def model_cost(symbols: DataFrame, model: dict[str, float], key: str) -> DataFrame:
    """Ideal bits of each key under a fixed model; symbols outside it cost nothing and are counted."""
    probs = F.create_map(*[F.lit(x) for kv in model.items() for x in kv])
    p = F.element_at(probs, F.col("sym"))
    return symbols.groupBy(key).agg(
        F.round(F.sum(F.when(p.isNotNull(), -F.log2(p) * F.col("n")).otherwise(0.0)), 6).alias("bits"),
        F.sum(F.when(p.isNull(), F.col("n")).otherwise(0)).alias("outside"),
    )


def in_force(sps: DataFrame) -> DataFrame:
    """Sequence sets with the fields that are not in force set to null."""
    only = lambda c, when: F.when(when, F.col(c)).alias(c)
    rules = {
        "log2_max_poc_lsb": F.col("poc_type") == 0, "offset_non_ref": F.col("poc_type") == 1, "offsets_ref": F.col("poc_type") == 1,
        "mb_adaptive": F.col("frame_mbs_only") == 0, "crop_left": F.col("cropping") == 1, "crop_right": F.col("cropping") == 1,
        "crop_top": F.col("cropping") == 1, "crop_bottom": F.col("cropping") == 1,
    }
    return sps.select(*[only(c, rules[c]) if c in rules else F.col(c) for c in sps.columns])


def distinct_param_sets(sps: DataFrame, ignore: tuple[str, ...] = ("file", "pos")) -> DataFrame:
    """How often each distinct set occurs, by what is in force; an invalid set equals no other."""
    fields = [c for c in sps.columns if c not in ignore]
    valid = in_force(sps.where("valid = 1")).groupBy(*fields).agg(F.count("*").alias("n"))
    return valid.unionByName(sps.where("valid <> 1").select(*fields).withColumn("n", F.lit(1).cast("long")))


def coeff_histograms(stats: DataFrame) -> DataFrame:
    """How many blocks have each (non-zeros, trailing ones, total zeros)."""
    return stats.groupBy("total", "trailing_ones", "total_zeros").agg(F.count("*").alias("n"))


def run_histogram(stats: DataFrame) -> DataFrame:
    return stats.select(F.explode("runs_before").alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def rtp_loss_summary(rtp: DataFrame, by: str = "ssrc") -> DataFrame:
    """Expected, received, lost and repeated packets from sequence numbers unwrapped in arrival order."""
    order = Window.partitionBy(by).orderBy("arrival")
    diff = F.pmod(F.col("seq") - F.lag("seq").over(order) + 32768, F.lit(65536)) - 32768
    steps = rtp.withColumn("__d", F.coalesce(diff, F.lit(0)))
    whole = steps.withColumn("__s", F.sum("__d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    once = whole.groupBy(by, "__s").agg(F.count("*").alias("__n"))
    found = once.groupBy(by).agg((F.max("__s") - F.min("__s") + 1).alias("expected"), F.sum("__n").alias("received"), F.count("*").alias("__u"))
    return found.select(by, "expected", "received", (F.col("expected") - F.col("__u")).alias("lost"), (F.col("received") - F.col("__u")).alias("repeated"))


def corruption_summary(blocks: DataFrame, segments: DataFrame, by: str = "frame_no") -> DataFrame:
    """Per frame: blocks by state, and corrupted segments counted once each."""
    state = lambda s: F.sum((F.col("state") == s).cast("long")).alias(f"state_{s}")
    bad = segments.where("bad <> 0").groupBy(by).agg(F.countDistinct("start_mb").alias("bad_segments"))
    return blocks.groupBy(by).agg(*map(state, (0, 1, 2, 3))).join(bad, by, "left").fillna(0, ["bad_segments"])


def _solved(m: DataFrame, by: list[str]) -> DataFrame:
    """x1, x2 from the sums a00, a01, a11, b0, b1 of each group, and whether all its q are the same."""
    det = F.col("a00") * F.col("a11") - F.col("a01") * F.col("a01")
    second = ~F.col("same") & (F.abs(det) > 1e-6)
    return m.select(
        *by, F.round(F.when(second, (F.col("b0") * F.col("a11") - F.col("b1") * F.col("a01")) / det).otherwise(F.col("b0") / F.col("a00")), 4).alias("x1"),
        F.round(F.when(second, (F.col("b1") * F.col("a00") - F.col("b0") * F.col("a01")) / det).otherwise(F.lit(0.0)), 4).alias("x2"),
    )


def fit_rate_model(points: DataFrame, by: list[str]) -> DataFrame:
    """x1, x2 of rate = x1 / q + x2 / q^2 by least squares over (q, r); first order where all q are
    equal or the determinant vanishes."""
    q, r = F.col("q").cast("double"), F.col("r").cast("double")
    m = points.groupBy(*by).agg(
        F.count("*").cast("double").alias("a00"), F.sum(1 / q).alias("a01"), F.sum(1 / (q * q)).alias("a11"),
        F.sum(q * r).alias("b0"), F.sum(r).alias("b1"), (F.min("q") == F.max("q")).alias("same"),
    )
    return _solved(m, by)


def aggregate_with(points: DataFrame, by: list[str], partial: Callable, values: list[str], made: list[str], combine: dict[str, Callable]) -> DataFrame:
    """Groups by a user's own aggregate over Arrow arrays. ``partial`` takes the columns ``values`` (double) of the rows
    of a group that lie in one input partition, and gives a list of numbers, named ``made``; these are combined by Spark
    with the functions of ``combine`` (sum if none is named). So no task holds more of a group than a partition has."""
    own = F.arrow_udf(partial, "array<double>", F.ArrowUDFType.GROUPED_AGG)
    parts = points.select(*by, *[F.col(v).cast("double").alias(v) for v in values]).withColumn("__part", F.spark_partition_id())
    sums = parts.groupBy(*by, "__part").agg(own(*values).alias("__m"))
    return sums.groupBy(*by).agg(*[combine.get(n, F.sum)(F.col("__m")[k]).alias(n) for k, n in enumerate(made)])


def fit_rate_model_with(points: DataFrame, by: list[str]) -> DataFrame:
    """``fit_rate_model`` by an aggregate of one's own, in numpy."""

    def moments(q: pa.Array, r: pa.Array) -> list[float]:
        x, y = q.to_numpy(zero_copy_only=False), r.to_numpy(zero_copy_only=False)
        return [float(len(x)), float((1 / x).sum()), float((1 / (x * x)).sum()), float((x * y).sum()), float(y.sum()), float(x.min()), float(x.max())]

    m = aggregate_with(points, by, moments, ["q", "r"], ["a00", "a01", "a11", "b0", "b1", "low", "high"], {"low": F.min, "high": F.max})
    return _solved(m.withColumn("same", F.col("low") == F.col("high")), by)


def fit_linear_predictor(points: DataFrame, by: list[str]) -> DataFrame:
    """c1, c2 of y = c1 x + c2 by least squares; where all y are equal, the mean of y / x and 0;
    where the determinant vanishes, sum of y over sum of x and 0."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = points.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"),
        F.avg(F.try_divide(y, x)).alias("ratio"), (F.min("y") == F.max("y")).alias("same"),
    )
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    full = F.abs(det) > 1e-6
    c1 = F.when(F.col("same"), F.col("ratio")).when(full, F.try_divide(F.col("sxy") * F.col("n") - F.col("sy") * F.col("sx"), det)).otherwise(F.try_divide(F.col("sy"), F.col("sx")))
    c2 = F.when(~F.col("same") & full, F.try_divide(F.col("sy") * F.col("sxx") - F.col("sxy") * F.col("sx"), det)).otherwise(F.lit(0.0))
    return m.select(*by, F.round(c1, 6).alias("c1"), F.round(c2, 6).alias("c2"))


def sei_totals(sei: DataFrame) -> DataFrame:
    """Messages, bytes and filler bytes (type 3) per payload type."""
    return sei.groupBy("payload_type").agg(
        F.count("*").alias("n"), F.sum("payload_size").alias("bytes"),
        F.sum(F.when(F.col("payload_type") == 3, F.col("payload_size")).otherwise(0)).alias("filler"),
    )


def box_downscale(pixels: DataFrame, k: int, by: str = "frame_no") -> DataFrame:
    return pixels.groupBy(by, idiv(F.col("x"), k).alias("x"), idiv(F.col("y"), k).alias("y")).agg(F.round(F.avg("v"), 6).alias("v"))


def pack_flags(df: DataFrame, flags: list[str]) -> DataFrame:
    """``flags``: the named 0/1 columns packed, the first in the lowest bit."""
    packed = sum((F.shiftleft((F.col(c) != 0).cast("long"), k) for k, c in enumerate(flags)), F.lit(0).cast("long"))
    return df.withColumn("flags", packed)


def flag_usage(df: DataFrame, flags: list[str]) -> DataFrame:
    """How many rows have each flag of the packed column set."""
    bits = F.array(*[F.struct(F.lit(c).alias("flag"), F.shiftright("flags", k).bitwiseAND(1).alias("on")) for k, c in enumerate(flags)])
    return df.select(F.inline(bits)).groupBy("flag").agg(F.sum("on").cast("long").alias("n"))
