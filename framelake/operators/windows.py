"""Window operators: one shuffle and sort by stream, on which all windows of an operator are stacked."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import idiv
from .folds import SEGMENT as ROWS
from .folds import Columns, Composable, fold_in_segments


def _upto(by: list[str] | str, order: list[str] | str) -> Window:
    by, order = ([x] if isinstance(x, str) else x for x in (by, order))
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _before(by: list[str] | str, order: list[str] | str) -> Window:
    by, order = ([x] if isinstance(x, str) else x for x in (by, order))
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def unit_lengths(units: DataFrame, by: str = "file", pos: str = "pos") -> DataFrame:
    """Units with ``length``: up to the next start code (or ``file_size``), less the trailing zeros
    ``zeros``; ``pos`` is the first byte behind the start code of ``start_code_len`` bytes."""
    order = Window.partitionBy(by).orderBy(pos)
    following = F.coalesce(F.lead(F.col(pos) - F.col("start_code_len")).over(order), F.col("file_size"))
    return units.withColumn("length", following - F.col(pos) - F.col("zeros"))


def access_units(nal: DataFrame, by: str = "file", pos: str = "pos") -> DataFrame:
    """Units with ``au`` and ``au_position`` (both from 1): a delimiter, parameter set, SEI or type
    13 to 18 opens an access unit if a picture's unit came since the last opening."""
    opener = F.col("nal_type").isin(6, 7, 8, 9) | F.col("nal_type").between(13, 18)
    vcl = F.col("nal_type").between(1, 5)
    kind = F.when(vcl, F.lit("v")).when(opener, F.lit("o"))
    last = F.last(kind, ignorenulls=True).over(_before(by, pos))
    opened = nal.withColumn("__new", F.coalesce((opener & (last == "v")).cast("long"), F.lit(0)))
    counted = opened.withColumn("au", F.sum("__new").over(_upto(by, pos)) + 1).drop("__new")
    return counted.withColumn("au_position", F.row_number().over(Window.partitionBy(by, "au").orderBy(pos)).cast("long"))


def gop_id(frames: DataFrame, idr: Column, by: str = "stream_id", order: str = "i") -> DataFrame:
    """Frames with ``gop``: the number of instantaneous refreshes so far."""
    return frames.withColumn("gop", F.sum(idr.cast("long")).over(_upto(by, order)))


def poc_type0(slices: DataFrame, max_lsb: int, by: tuple[str, ...] = ("stream_id", "gop"), order: str = "i") -> DataFrame:
    """Picture order count from its low bits, relative to the last reference picture of the period."""
    w = list(by)
    ref_lsb = F.coalesce(F.last(F.when(F.col("is_ref") == 1, F.col("poc_lsb")), ignorenulls=True).over(_before(w, order)), F.lit(0))
    d = F.col("poc_lsb") - F.col("__prev")
    step = F.when(-d >= max_lsb // 2, 1).when(d > max_lsb // 2, -1).otherwise(0)
    stepped = slices.withColumn("__prev", ref_lsb).withColumn("__step", F.when(F.col("idr") == 1, 0).otherwise(step))
    earlier = F.coalesce(F.sum(F.when(F.col("is_ref") == 1, F.col("__step")).otherwise(0)).over(_before(w, order)), F.lit(0))
    return stepped.withColumn("poc", (max_lsb * (earlier + F.col("__step")) + F.col("poc_lsb")).cast("long")).drop("__prev", "__step")


def _frame_num_offset(slices: DataFrame, max_frame_num: int, by: list[str], order: str, refs_only: bool) -> DataFrame:
    """``__offset``: how often the frame number has fallen so far, times its range."""
    if refs_only:
        prev = F.coalesce(F.last(F.when(F.col("is_ref") == 1, F.col("frame_num")), ignorenulls=True).over(_before(by, order)), F.lit(0))
        fell = slices.withColumn("__fall", (F.col("frame_num") < prev).cast("long"))
        earlier = F.coalesce(F.sum(F.when(F.col("is_ref") == 1, F.col("__fall")).otherwise(0)).over(_before(by, order)), F.lit(0))
        return fell.withColumn("__offset", max_frame_num * (earlier + F.col("__fall"))).drop("__fall")
    prev = F.coalesce(F.lag("frame_num").over(Window.partitionBy(*by).orderBy(order)), F.lit(0))
    fell = slices.withColumn("__fall", (F.col("frame_num") < prev).cast("long"))
    return fell.withColumn("__offset", max_frame_num * F.sum("__fall").over(_upto(by, order))).drop("__fall")


def poc_type1(
    slices: DataFrame, max_frame_num: int, ref_offsets: list[int], non_ref_offset: int, by: tuple[str, ...] = ("stream_id", "gop"), order: str = "i"
) -> DataFrame:
    """Picture order count from frame numbers and the cycle of expected steps (frames, no deltas)."""
    n = len(ref_offsets)
    out = _frame_num_offset(slices, max_frame_num, list(by), order, False)
    number = (F.col("__offset") + F.col("frame_num")) if n else F.lit(0).cast("long")
    number = F.when((F.col("is_ref") == 0) & (number > 0), number - 1).otherwise(number)
    table = F.array(*[F.lit(x) for x in (ref_offsets or [0])])
    rest = F.aggregate(F.slice(table, 1, F.pmod(F.col("__abs") - 1, F.lit(max(n, 1))).cast("int") + 1), F.lit(0), lambda a, x: a + x)
    expected = F.when(F.col("__abs") > 0, idiv(F.col("__abs") - 1, max(n, 1)) * sum(ref_offsets) + rest).otherwise(0)
    expected = expected + F.when(F.col("is_ref") == 0, non_ref_offset).otherwise(0)
    return out.withColumn("__abs", number).withColumn("poc", expected.cast("long")).drop("__abs", "__offset")


def poc_type2(slices: DataFrame, max_frame_num: int, by: tuple[str, ...] = ("stream_id", "gop"), order: str = "i") -> DataFrame:
    """Twice the unwrapped frame number, less one for non-references; 0 at a refresh."""
    out = _frame_num_offset(slices, max_frame_num, list(by), order, True)
    poc = 2 * (F.col("__offset") + F.col("frame_num")) - (F.col("is_ref") == 0).cast("long")
    return out.withColumn("poc", F.when(F.col("idr") == 1, 0).otherwise(poc).cast("long")).drop("__offset")


def display_order(frames: DataFrame, by: tuple[str, ...] = ("stream_id", "gop"), tie: str = "i") -> DataFrame:
    """Rank (from 0) by picture order within a period."""
    return frames.withColumn("display", (F.row_number().over(Window.partitionBy(*by).orderBy("poc", tie)) - 1).cast("long"))


def bump_output(frames: DataFrame, capacity: int, by: str = "stream_id", order: str = "i") -> DataFrame:
    """``by, n, i, poc``: pictures (poc, idr) in output order. Up to ``capacity`` are held; when one more comes the
    smallest picture order goes out, and a refresh or the end sends out all. Periods between refreshes go through
    their tasks side by side, with a heap of ``capacity`` pictures each; their sizes number the output."""
    key = [by, "__period"]
    cut = gop_id(frames.select(by, order, "poc", "idr"), F.col("idr") == 1, by, order).select(by, F.col("gop").alias("__period"), order, F.col("poc").cast("long").alias("poc"))
    kinds = dict(cut.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        period, heap, k = None, [], 0
        for b in batches:
            out = []
            for s, g, i, poc in zip(*(b.column(c).to_pylist() for c in (by, "__period", order, "poc")), strict=True):
                if (s, g) != period:
                    out += [(*period, k + n, j, p) for n, (p, j) in enumerate(sorted(heap))] if period else []
                    period, heap, k = (s, g), [], 0
                heapq.heappush(heap, (poc, i))
                if len(heap) > capacity:
                    p, j = heapq.heappop(heap)
                    out.append((s, g, k, j, p))
                    k += 1
            yield made(out)
        if period:
            yield made([(*period, k + n, j, p) for n, (p, j) in enumerate(sorted(heap))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[by, "__period", "k", order, "poc"])

    sorted_rows = cut.repartition(*key).sortWithinPartitions(*key, order)
    sent = sorted_rows.mapInArrow(run, f"`{by}` long, __period long, k long, `{order}` long, poc long").withColumn(by, F.col(by).cast(kinds[by]))
    sizes = cut.groupBy(*key).agg(F.count("*").alias("__n"))
    starts = sizes.select(*key, F.coalesce(F.sum("__n").over(_before(by, "__period")), F.lit(0)).alias("__start"))
    return sent.join(starts, key).select(by, (F.col("__start") + F.col("k")).alias("n"), order, "poc")


def unwrap_rtp_ts(rtp: DataFrame, by: str = "ssrc", order: str = "arrival") -> DataFrame:
    """Running time from an 8-bit clock: a step back of more than 10 is a wrap; a thousand per tick; first 0."""
    d = F.coalesce(F.col("tr") - F.lag("tr").over(Window.partitionBy(by).orderBy(order)), F.lit(0))
    steps = rtp.withColumn("__d", d)
    return steps.withColumn("ts", (1000 * F.sum(F.when(F.col("__d") < -10, F.col("__d") + 256).otherwise(F.col("__d"))).over(_upto(by, order))).cast("long")).drop("__d")


def seq_gaps(rtp: DataFrame, by: str = "ssrc", order: str = "arrival") -> DataFrame:
    """Packets missing before each, by the 16-bit difference to the one before (null for the first)."""
    d = F.pmod(F.col("seq") - F.lag("seq").over(Window.partitionBy(by).orderBy(order)), F.lit(65536))
    return rtp.withColumn("gap", (d - 1).cast("long"))


def default_rates(frames: DataFrame, k: int = 4, by: str = "stream_id") -> DataFrame:
    """Rates per frame interval: the mean and steps of a quarter above it, truncated."""
    mean = frames.groupBy(by).agg(F.avg("bits").alias("__m"))
    steps = F.array(*[F.floor(F.col("__m") * (1 + j / 4)).cast("long") for j in range(k)])
    return mean.select(by, F.explode(steps).alias("rate"))


def leaky_bucket(frames: DataFrame, rates: DataFrame, by: str = "stream_id", order: str = "i", segment: int = ROWS) -> DataFrame:
    """Smallest bucket ``b`` and initial fullness ``f`` of every stream and rate (bits per frame interval)
    that never underflow, where the bucket saturates at full.

    Closed form over prefix sums: with C the bits so far and S = n r - C + bits, the need of a frame is the largest S
    so far minus S plus its bits, and the bucket is the largest need. The level saturates at the first frame (``brk``)
    whose level y reaches bucket - rate; up to there, and up to the first frame of the largest need, the fullness must
    cover C - n r. Segments of ``order`` are worked through side by side: count, sum and largest S and C - n r of each
    compose over the segments before, then largest need with its first frame and largest y, then the frames up to the
    limit. No window runs over a whole stream.
    """
    pair = [by, "rate"]
    key = [*pair, "__seg"]
    rows = frames.select(by, order, "bits", idiv(F.col(order), segment).alias("__seg")).join(rates, by)
    upto, earlier = _upto(key, order), _before(pair, "__seg")
    # inside a segment, counted from its first frame
    local = rows.withColumns({"__k": F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1, "__in": F.sum("bits").over(upto)})
    over = F.col("__in") - F.col("__k") * F.col("rate")
    ends = local.groupBy(*key).agg(
        F.count("*").alias("__rows"), F.sum("bits").alias("__sum"), F.min_by("bits", order).alias("__first"), F.max(F.col("bits") - over).alias("__s"), F.max(over).alias("__o")
    )
    before = ends.withColumns({"__n0": F.coalesce(F.sum("__rows").over(earlier), F.lit(0)), "__c0": F.coalesce(F.sum("__sum").over(earlier), F.lit(0)), "__b0": F.first("__first").over(_upto(pair, "__seg"))})
    lead = F.col("__n0") * F.col("rate") - F.col("__c0")  # what a segment's own S and C - n r lack
    carry = before.select(*key, "__n0", "__c0", "__b0", F.max(lead + F.col("__s")).over(earlier).alias("__s0"), F.max(F.col("__o") - lead).over(earlier).alias("__o0"))
    placed = local.join(carry, key).withColumns({"__n": F.col("__n0") + F.col("__k"), "__low": over - lead})
    s = F.col("bits") - F.col("__low")
    highest = F.greatest(F.col("__o0"), F.max("__low").over(upto)) - F.col("__b0")
    level = F.col("__b0") - F.col("__low") + F.greatest(F.lit(0), highest)
    needs = placed.withColumns({"__need": F.greatest(F.col("__s0"), F.max(s).over(upto)) - s + F.col("bits"), "__full": level + F.col("rate")})
    # over the segments of a stream and rate: the bucket, the first frame that needs it, and the segment that saturates
    tops = needs.groupBy(*key).agg(F.max(F.struct("__need", -F.col("__n"))).alias("__top"), F.max("__full").alias("__most"))
    whole = Window.partitionBy(*pair)
    sized = tops.withColumn("__t", F.max("__top").over(whole)).select(*key, F.col("__t.__need").alias("__b"), (-F.col("__t.col2")).alias("__fi"), "__most")
    limits = sized.select(*key, "__b", "__fi", F.min(F.when(F.col("__most") > F.col("__b"), F.col("__seg"))).over(whole).alias("__stop"))
    ended = F.coalesce(F.max("__full").over(_before(key, order)) > F.col("__b"), F.lit(False))
    early = (F.col("__n") <= F.col("__fi")) & (F.col("__stop").isNull() | (F.col("__seg") < F.col("__stop")) | ((F.col("__seg") == F.col("__stop")) & ~F.col("__ended")))
    judged = needs.join(limits, key).withColumn("__ended", ended)
    return judged.groupBy(*pair).agg(F.max("__b").cast("long").alias("b"), F.greatest(F.max("__b0"), F.max(F.when(early, F.col("__low")))).cast("long").alias("f"))


def running(rows: DataFrame, value: str, by: list[str], order: str, segment: int) -> DataFrame:
    """``rows`` with ``__n`` and ``__sum``: rows and values of a key up to each. A long key is summed in
    segments of ``order`` side by side, to which one row per segment brings what came before it."""
    key = [*by, "__seg"]
    cut = rows.withColumn("__seg", idiv(F.col(order), segment))
    ends = cut.groupBy(*key).agg(F.count("*").alias("__c"), F.sum(value).alias("__s"))
    earlier = _before(by, "__seg")
    carry = ends.select(*key, F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__c"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s"))
    inside = cut.withColumns({"__n": F.row_number().over(Window.partitionBy(*key).orderBy(order)), "__sum": F.sum(value).over(_upto(key, order))})
    return inside.join(carry, key).select(*rows.columns, (F.col("__n") + F.col("__c")).alias("__n"), (F.col("__sum") + F.col("__s")).alias("__sum"))


def buffer_fullness(frames: DataFrame, rate: int, fps: int, omega: float = 0.9, by: str = "stream_id", order: str = "i", segment: int = 1 << 16) -> DataFrame:
    """Encoder buffer: bits in, rate / fps out; size 2.56 rate, bounds around it that move the other way."""
    level = F.col("__sum") - F.col("__n") * (rate / fps)
    size = 2.56 * rate
    return running(frames, "bits", [by], order, segment).withColumn("fullness", F.round(level, 6)).withColumns({
        "upper1": F.round(F.lit(0.8 * size) - level, 6), "upper2": F.round((F.lit(0.8 * size) - level) * omega, 6), "lower": F.round(F.lit(rate / fps) - level, 6),
    }).drop("__n", "__sum")


def complexity_ema(frames: DataFrame, by: str = "stream_id", order: str = "i", value: str = "complexity", segment: int = ROWS) -> DataFrame:
    """``by, order, weight``: the average weight of the B frames so far. Of n frames the newest counts
    (n - 1) / n and the average before it 1 / n while n < 8, then an eighth and seven eighths.

    A step is ``x -> a x + b``, and so is a run of them: segments bring two numbers.
    """
    values = frames.select(by, order, F.col(value).cast("double").alias("value"))

    def steps(columns: Columns) -> tuple[np.ndarray, np.ndarray]:
        n, w = columns["n"].astype(np.float64), columns["value"]
        a = np.where(n == 1, 0.0, np.where(n < 8, 1 / n, 7 / 8))
        return a, np.where(n == 1, w, np.where(n < 8, w * (n - 1) / n, w / 8))

    def effect(columns: Columns) -> list:
        a, b = 1.0, 0.0
        for x, y in zip(*steps(columns), strict=True):
            a, b = a * x, b * x + y
        return [float(a), float(b)]

    def fill(state: list, columns: Columns) -> list:
        out, at = [], state[0]
        for x, y in zip(*steps(columns), strict=True):
            at = at * x + y
            out.append(at)
        return [out]

    fold = Composable([0.0], effect, lambda state, e: [e[0] * state[0] + e[1]], fill, "double")
    counted = running(values, "value", [by], order, segment).select(by, order, "value", F.col("__n").alias("n"))
    return fold_in_segments(counted, by, order, fold, "weight double", segment=segment)


def bucket_levels(frames: DataFrame, rate: int, size: int, by: str = "stream_id", order: str = "i", segment: int = ROWS) -> DataFrame:
    """``by, order, level, alert``: level of a bucket that is drained by ``rate`` before each frame, floored at empty
    and capped at ``size``; ``overflow`` where a frame did not fit, else ``underflow`` where less than ``rate`` was there.

    A step is ``x -> min(high, max(low, x + a))``, and so is a run of them: segments bring three numbers.
    """
    none = 1 << 62

    def effect(columns: Columns) -> list:
        a, low, high = 0, -none, none
        for bits in columns["bits"].tolist():
            floor = min(bits, size)
            a, low, high = a + bits - rate, *(min(size, max(floor, x + bits - rate)) for x in (low, high))
        return [a, low, high]

    def fill(state: list, columns: Columns) -> list:
        level, levels, alerts = state[0], [], []
        for bits in columns["bits"].tolist():
            full = max(level - rate, 0) + bits
            alerts.append("overflow" if full > size else "underflow" if level < rate else None)
            level = min(full, size)
            levels.append(level)
        return [levels, alerts]

    fold = Composable([0], effect, lambda state, e: [min(e[2], max(e[1], state[0] + e[0]))], fill)
    return fold_in_segments(frames.select(by, order, F.col("bits").cast("long").alias("bits")), by, order, fold, "level long, alert string", segment=segment)


def frame_num_gaps(slices: DataFrame, max_frame_num: int, gaps_allowed: Column, by: str = "stream_id", order: str = "i") -> DataFrame:
    """Slices whose frame number neither repeats that of the last reference nor follows it."""
    prev = F.last(F.when(F.col("is_ref") == 1, F.col("frame_num")), ignorenulls=True).over(_before(by, order))
    jumped = (F.col("frame_num") != F.col("prev")) & (F.col("frame_num") != F.pmod(F.col("prev") + 1, F.lit(max_frame_num)))
    return slices.withColumn("prev", prev).where(jumped & (F.col("idr") == 0) & ~gaps_allowed)


def pair_fields(pictures: DataFrame, by: str = "stream_id", order: str = "i") -> DataFrame:
    """Output frames of pictures with ``structure`` T, B or F: adjacent fields of opposite parity pair
    up, from the start of each run of alternating fields; what is left over is output alone."""
    w = Window.partitionBy(by).orderBy(order)
    prev = F.lag("structure").over(w)
    breaks = prev.isNull() | (prev == F.col("structure")) | (prev == "F") | (F.col("structure") == "F")
    runs = pictures.withColumn("__new", breaks.cast("long")).withColumn("__run", F.sum("__new").over(_upto(by, order)))
    placed = runs.withColumn("__pair", idiv(F.row_number().over(Window.partitionBy(by, "__run").orderBy(order)) - 1, 2))
    return placed.groupBy(by, "__run", "__pair").agg(F.min(order).alias(order), F.count("*").alias("n_pictures"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order, "structure"))), lambda s: s["structure"])).alias("structure")).drop("__run", "__pair")


def reframe(samples: DataFrame, n: int, by: str | tuple[str, ...] = "file") -> DataFrame:
    """Frames of ``n`` samples (the last may be shorter), values in order."""
    keys = [by] if isinstance(by, str) else list(by)
    return samples.groupBy(*keys, idiv(F.col("idx"), n).alias("frame")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "s"))), lambda e: e["s"]).alias("samples")
    )


def _next_groups(ends: np.ndarray, cap: int) -> np.ndarray:
    """The unit that opens the next group, if each unit opened one: binary search over the prefix sums ``ends``."""
    n = len(ends)
    begins = np.concatenate([[0], ends[:-1]])
    return np.maximum(np.searchsorted(ends, begins + cap, "right"), np.arange(1, n + 1))


def pack_by_bytes(units: DataFrame, cap: int, by: str = "stream_id", order: str = "pos", size: str = "size", segment: int = ROWS) -> DataFrame:
    """``by, order, size, group``: a new group starts when the cap would be exceeded (greedy); a larger unit is alone.

    Each unit points at the one that would open the next group. Only the units of a segment's first ``cap`` bytes can
    open its first own group; pointer doubling tells for each of them how many groups the segment then opens and how
    full the last one is. So segments are chained by looking up one of these entries, and filled in side by side.
    """

    def effect(columns: Columns) -> list:
        ends = np.cumsum(columns[size])
        n = len(ends)
        jump = np.append(_next_groups(ends, cap), n)
        opened, last = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
        while (jump[:n] < n).any():
            opened, last = opened + opened[jump], np.where(jump < n, last[jump], last)
            jump = jump[jump]
        entries = min(n, int(np.searchsorted(ends, cap, "right")) + 1)
        left = ends[-1] - np.where(last[:entries] > 0, ends[last[:entries] - 1], 0)
        return [int(ends[-1]), *np.column_stack([ends[:entries], opened[:entries], left]).ravel().tolist()]

    def first(state: list, ends: np.ndarray) -> int:
        """The first unit that does not fit the open group."""
        return 0 if state[0] < 0 else int(np.searchsorted(ends, cap - state[1], "right"))

    def advance(state: list, effect: list) -> list:
        entries = np.array(effect[1:], np.int64).reshape(-1, 3)
        k = first(state, entries[:, 0])
        return [state[0] + int(entries[k, 1]), int(entries[k, 2])] if k < len(entries) else [state[0], state[1] + effect[0]]

    def fill(state: list, columns: Columns) -> list:
        ends = np.cumsum(columns[size])
        follows, at, opens = _next_groups(ends, cap), first(state, ends), np.zeros(len(ends), np.int64)
        while at < len(ends):
            opens[at] = 1
            at = int(follows[at])
        return [state[0] + np.cumsum(opens)]

    rows = units.select(by, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size))
    return fold_in_segments(rows, by, order, Composable([-1, 0], effect, advance, fill), "group long", carry=(size,), segment=segment)


#: Frames of a segment: places that all frames share are worked through in segments side by side.
SEGMENT = 4096


def _carried(blocks: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """``by, __seg, __carry``: the last ``value`` that is not null in the segments before each, one row per place and segment."""
    last = blocks.groupBy(*by, "__seg").agg(F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias("__last"))
    return last.select(*by, "__seg", F.last("__last", ignorenulls=True).over(_before(by, "__seg")).alias("__carry"))


def conceal_by_copy(blocks: DataFrame, by: tuple[str, ...] = ("x", "y"), order: str = "frame_no", segment: int = SEGMENT) -> DataFrame:
    """Lost blocks (state up to 1) with the value at their place in the latest earlier frame that has one.

    There are few places and many frames: windows run over segments of frames, and what a segment takes
    over from those before it comes from one row per place and segment.
    """
    key = [*by, "__seg"]
    cut = blocks.withColumn("__seg", idiv(F.col(order), segment))
    good = F.when(F.col("state") > 1, F.col("v"))
    inside = cut.withColumn("__in", F.last(good, ignorenulls=True).over(_upto(key, order)))
    carried = _carried(cut, list(by), order, good)
    return inside.join(carried, key, "left").select(*blocks.columns, F.coalesce("__in", "__carry").alias("concealed"))


def conceal_by_neighbours(pixels: DataFrame, size: int, by: str = "frame_no") -> DataFrame:
    """Pixels of lost blocks of ``size`` from the edges of good blocks above, left, below and right,
    weighted by nearness; 127 where there is none. ``pixels``: x, y, v and the state of their block."""
    cell = pixels.withColumns({"bx": idiv(F.col("x"), size), "by": idiv(F.col("y"), size), "row": F.pmod("y", F.lit(size)), "col": F.pmod("x", F.lit(size))})
    good, lost = cell.where("state > 1"), cell.where("state <= 1")
    line = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))

    def edge(where: Column, dx: int, dy: int, across: str) -> DataFrame:
        other = "row" if across == "col" else "col"
        e = good.where(where).select(by, (F.col("bx") + dx).alias("bx"), (F.col("by") + dy).alias("by"), F.col(across), F.col("v").alias("__v"), F.explode(line).alias(other))
        weight = {(0, 1): size - F.col("row"), (1, 0): size - F.col("col"), (0, -1): F.col("row") + 1, (-1, 0): F.col("col") + 1}[dx, dy]
        return e.select(by, "bx", "by", "row", "col", (weight * F.col("__v")).alias("__t"), weight.alias("__w"))

    last = F.lit(size - 1)
    edges = edge(F.col("row") == last, 0, 1, "col").unionByName(edge(F.col("col") == last, 1, 0, "row")).unionByName(
        edge(F.col("row") == 0, 0, -1, "col")).unionByName(edge(F.col("col") == 0, -1, 0, "row"))
    sums = edges.groupBy(by, "bx", "by", "row", "col").agg(F.sum("__t").alias("__t"), F.sum("__w").alias("__w"))
    key = [by, "bx", "by", "row", "col"]
    return lost.join(sums, key, "left").select(by, "x", "y", F.coalesce(idiv(F.col("__t"), F.col("__w")), F.lit(127)).cast("long").alias("v"))


def dts_violations(packets: DataFrame, by: str = "stream_id", order: str = "pos") -> DataFrame:
    """Packets whose dts does not rise, or whose pts is before it; ``rule`` says which (the first that holds)."""
    prev = F.lag("dts").over(Window.partitionBy(by).orderBy(order))
    rule = F.when(F.col("dts") <= F.col("prev_dts"), F.lit("dts")).when(F.col("pts") < F.col("dts"), F.lit("pts"))
    return packets.withColumn("prev_dts", prev).withColumn("rule", rule).where("rule is not null")


def linear_resample(samples: DataFrame, src_rate: int, dst_rate: int, by: list[str]) -> DataFrame:
    """Samples at another rate: ceil(n dst / src) of them, at j src / dst between neighbours."""
    order = Window.partitionBy(*by).orderBy("idx")
    spans = samples.select(*by, "idx", "s", F.lead("s").over(order).alias("__next"))
    first = idiv(F.col("idx") * dst_rate + (src_rate - 1), src_rate)
    last = idiv((F.col("idx") + 1) * dst_rate + (src_rate - 1), src_rate) - 1
    made = spans.withColumns({"__a": first, "__b": last}).where("__a <= __b").select(*by, "idx", "s", "__next", F.explode(F.sequence("__a", "__b")).alias("j"))
    t = F.col("j") * F.lit(src_rate / dst_rate) - F.col("idx")
    return made.select(*by, "j", F.round(F.col("s") + t * (F.coalesce("__next", "s") - F.col("s")), 6).alias("s"))


def refresh_age(blocks: DataFrame, cap: int, by: tuple[str, ...] = ("x", "y"), order: str = "frame_no", segment: int = SEGMENT) -> DataFrame:
    """Pictures since a block was refreshed (1 when it is), at most ``cap``; before its first refresh since the
    start. Counted in segments of pictures, to which those before them add their counts."""
    key = [*by, "__seg"]
    cut = blocks.withColumn("__seg", idiv(F.col(order), segment))
    now = F.col("refreshed") == 1
    at = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    inside = cut.withColumn("__at", at).withColumn("__hit", F.last(F.when(now, F.col("__at")), ignorenulls=True).over(_upto(key, order)))
    ends = cut.groupBy(*key).agg(F.count("*").alias("__n"), F.max(F.when(now, F.col(order))).alias("__last"))
    behind = cut.join(ends.select(*key, "__last"), key).where(F.col("__last").isNull() | (F.col(order) >= F.col("__last"))).groupBy(*key).agg(F.count("*").alias("__tail"))
    ends = ends.join(behind, key, "left")
    whole = _before(list(by), "__seg")
    run = F.sum(F.col("__last").isNotNull().cast("long")).over(_upto(list(by), "__seg"))
    tails = ends.withColumn("__run", run).withColumn("__sum", F.sum("__tail").over(Window.partitionBy(*by, "__run").orderBy("__seg").rowsBetween(Window.unboundedPreceding, 0)))
    carry = tails.select(*key, F.coalesce(F.last("__sum").over(whole), F.lit(0)).alias("__carry"))
    age = F.when(F.col("__hit").isNotNull(), F.col("__at") - F.col("__hit") + 1).otherwise(F.col("__at") + F.col("__carry"))
    return inside.join(carry, key).select(*blocks.columns, F.least(age, F.lit(cap)).cast("long").alias("age"))


def next_in_group(mbs: DataFrame, by: str = "frame_no", group: str = "slice_group", mb: str = "mb") -> DataFrame:
    """Units with the next of their group (-1: none) and the group's first and last."""
    w = Window.partitionBy(by, group)
    return mbs.withColumns({
        "next_mb": F.coalesce(F.lead(mb).over(w.orderBy(mb)), F.lit(-1)), "first_mb": F.min(mb).over(w), "last_mb": F.max(mb).over(w),
    })
