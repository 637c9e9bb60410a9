"""Joins: as-of, interval, rectangle, grid, overlay, and the equi joins of streams and pictures.

Sides are broadcast only where Spark finds them small; range conditions are turned into equi joins
on the dyadic cells that a range is made of, so every join is dealt out by its keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, idiv


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, value: Column, name: str) -> DataFrame:
    """``left`` with ``name``: ``value`` of the newest row of ``right`` at or before each left row.

    Both sides are stacked and sorted once per key; a right row comes before a left row at the same
    position. Of several right rows at one position the one with the largest value counts.
    """
    none = F.lit(None)
    defs = right.select(*by, F.col(right_at).alias("__at"), F.lit(0).alias("__kind"), F.struct(value.alias("v")).alias("__v"), none.alias("__row"))
    uses = left.select(*by, F.col(left_at).alias("__at"), F.lit(1).alias("__kind"), none.alias("__v"), F.struct(*left.columns).alias("__row"))
    order = Window.partitionBy(*by).orderBy("__at", "__kind", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = defs.unionByName(uses).withColumn("__v", F.last("__v", ignorenulls=True).over(order))
    return both.where("__kind = 1").select("__row.*", F.col("__v.v").alias(name))


def best_stream(streams: DataFrame, rank: list[Column], by: tuple[str, ...] = ("file", "media_type")) -> DataFrame:
    """The stream of each type and file that ranks first; then the lowest index."""
    order = Window.partitionBy(*by).orderBy(*rank, "stream_index")
    return streams.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def active_param_set(slices: DataFrame, pps: DataFrame, sps: DataFrame) -> DataFrame:
    """Slices (file, pos, pps_id) with the newest picture set of their id and its newest sequence set
    (``pps``: file, pos, id, sps_id, body; ``sps``: file, pos, id, body)."""
    with_pps = as_of(slices, pps.withColumnRenamed("id", "pps_id"), ["file", "pps_id"], "pos", "pos", F.struct("sps_id", "body"), "__pps")
    named = with_pps.withColumns({"sps_id": F.col("__pps.sps_id"), "pps_body": F.col("__pps.body")}).drop("__pps")
    return as_of(named, sps.withColumnRenamed("id", "sps_id"), ["file", "sps_id"], "pos", "pos", F.col("body"), "sps_body")


def dangling_refs(slices: DataFrame, defs: DataFrame) -> DataFrame:
    """Slices (file, pos, id) for which no valid definition of their id came before."""
    return as_of(slices, defs.where("valid = 1"), ["file", "id"], "pos", "pos", F.col("body"), "__body").where("__body is null").drop("__body")


def dyadic_cells(ranges: DataFrame, start: str, end: str, level: str, cell: str) -> DataFrame:
    """``ranges`` with a row per dyadic cell (``level``, ``cell``: the whole numbers from ``cell`` 2^level on, 2^level of
    them) of a range from ``start`` to ``end``, both included: disjoint cells, two a level at most, so that a range of a
    billion numbers has under 60. Ranges that are null or empty have none."""
    levels = F.sequence(F.lit(0), F.length(F.bin(F.greatest(F.col("__until") - F.col("__from"), F.lit(1)))))
    shift = lambda x, n: F.call_function("shiftright", x, n)
    spans = ranges.withColumns({"__from": F.col(start).cast("long"), "__until": F.col(end).cast("long") + 1}).where("__from < __until")
    at = spans.withColumn(level, F.explode(levels)).withColumns({"__low": -shift(-F.col("__from"), F.col(level)), "__high": shift(F.col("__until"), F.col(level))})
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1).cast("long"))
    first = F.when((F.col("__low") < F.col("__high")) & (odd("__low") == 1), F.col("__low"))
    last = F.when((odd("__high") == 1) & (F.col("__low") + odd("__low") < F.col("__high")), F.col("__high") - 1)
    return at.withColumn(cell, F.explode(F.array_compact(F.array(first, last)))).drop("__from", "__until", "__low", "__high")


def _stabbed(points: DataFrame, at: list[str], cells: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """Distinct ``by`` and ``at`` of ``points`` with ``name``: ``value`` over the ranges that hold them. ``cells`` has
    ``__l0, __c0`` (and ``__l1, __c1``) for ``at``; a point looks its cell up on the levels that there are."""
    dims = range(len(at))
    levels = [f"__l{k}" for k in dims]
    there = [tuple(r) for r in cells.select(*levels).distinct().collect()] or [(0,) * len(at)]  # at most 64 levels a dimension
    looked = points.select(*by, *at).distinct().withColumn("__l", F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(levels, r, strict=True)]) for r in there])))
    looked = looked.select(*by, *at, *[F.col(f"__l.{n}").alias(n) for n in levels])
    looked = looked.withColumns({f"__c{k}": F.call_function("shiftright", F.col(at[k]).cast("long"), F.col(levels[k])) for k in dims})
    return looked.join(cells, [*by, *levels, *[f"__c{k}" for k in dims]]).groupBy(*by, *at).agg(value.alias(name))


def mark_segments(blocks: DataFrame, segments: DataFrame, by: str = "frame_no", mb: str = "mb") -> DataFrame:
    """Blocks with ``bad`` of the segment that holds their unit (null: no segment; several: the worst)."""
    cells = dyadic_cells(segments.select(by, "start_mb", "end_mb", "bad"), "start_mb", "end_mb", "__l0", "__c0").drop("start_mb", "end_mb")
    return blocks.join(_stabbed(blocks, [mb], cells, [by], F.max("bad"), "bad"), [by, mb], "left")


def apply_zones(frames: DataFrame, zones: DataFrame, no: str = "i", default_qp: int = 26) -> DataFrame:
    """Frames with the zone that holds their number (lowest zone_id wins), its quantiser, and the factor by
    which it changes the bit rate (1 where the zone sets none; a zone has one or the other)."""
    cells = dyadic_cells(zones, "start_i", "end_i", "__l0", "__c0").select("__l0", "__c0", "zone_id", "qp", "bitrate_factor")
    first = _stabbed(frames, [no], cells, [], F.min(F.struct("zone_id", "qp", "bitrate_factor")), "__z")
    return frames.join(first, no, "left").select(
        *frames.columns, F.col("__z.zone_id").alias("zone_id"), F.coalesce("__z.qp", F.lit(default_qp)).cast("long").alias("qp"),
        F.coalesce("__z.bitrate_factor", F.lit(1.0)).alias("bitrate_factor"),
    )


def slice_group_of(mbs: DataFrame, rects: DataFrame, n_groups: int) -> DataFrame:
    """Units (x, y) with ``slice_group``: the lowest group whose rectangle holds them, else the last."""
    wide = dyadic_cells(rects.select("group_id", "left", "right", "top", "bottom"), "left", "right", "__l0", "__c0")
    cells = dyadic_cells(wide, "top", "bottom", "__l1", "__c1").select("__l0", "__c0", "__l1", "__c1", "group_id")
    lowest = _stabbed(mbs, ["x", "y"], cells, [], F.min("group_id"), "slice_group")
    return mbs.join(lowest, ["x", "y"], "left").withColumn("slice_group", F.coalesce("slice_group", F.lit(n_groups - 1)).cast("long"))


def dispersed_group(mb: Column, width: int, n_groups: int) -> Column:
    return F.pmod(F.pmod(mb, F.lit(width)) + idiv(idiv(mb, width) * n_groups, 2), F.lit(n_groups))


def interleaved_group(mb: Column, run_lengths: list[int]) -> Column:
    """Runs of units dealt to the groups in turn."""
    at = F.pmod(mb, F.lit(sum(run_lengths)))
    ends = [sum(run_lengths[: k + 1]) for k in range(len(run_lengths))]
    return reduce(lambda rest, k: F.when(at < ends[k], F.lit(k)).otherwise(rest), range(len(ends) - 2, -1, -1), F.lit(len(ends) - 1)).cast("long")


def raster_group(mb: Column, units_in_first: int, backwards: bool) -> Column:
    return F.when(mb < units_in_first, F.lit(int(backwards))).otherwise(F.lit(1 - int(backwards))).cast("long")


def wipe_group(mb: Column, width: int, height: int, units_in_first: int, backwards: bool) -> Column:
    """Columns from the left."""
    return raster_group(F.pmod(mb, F.lit(width)) * height + idiv(mb, width), units_in_first, backwards)


def explicit_group(mbs: DataFrame, ids: DataFrame, by: str = "frame_no", mb: str = "mb") -> DataFrame:
    """Units with the slice group that a list names for each (``by``, unit, slice_group); 0 where it names none."""
    return mbs.join(ids.select(by, mb, F.col("slice_group").alias("__g")), [by, mb], "left").withColumn("slice_group", F.coalesce("__g", F.lit(0)).cast("long")).drop("__g")


def unit_to_mb_group(group_of_unit: DataFrame, width: int, field: bool, by: str = "frame_no") -> DataFrame:
    """``by, mb, slice_group`` of macroblocks from the groups of map units where a frame codes its rows in
    pairs: a unit stands for two macroblocks one above the other (``field``: in the same row of both fields,
    otherwise in adjacent rows of a pair)."""
    unit = F.col("mb")
    row, col = idiv(unit, width), F.pmod(unit, F.lit(width))
    pair = F.array(2 * row * width + col, (2 * row + 1) * width + col)
    return group_of_unit.select(by, F.explode(pair).alias("mb"), "slice_group")


def mux_interleave(video: DataFrame, audio: DataFrame, by: str = "file", order: str = "pos", pts: str = "pts") -> DataFrame:
    """Packets of both inputs in writing order: video while its last written time is not later than
    audio's; the first input to run out ends the file. ``pts`` must be in one clock.

    A packet's key is the latest time of those before it in its own stream.
    """

    def keyed(df: DataFrame, kind: int) -> DataFrame:
        rows = df.select(by, order, pts).withColumn("__last", F.lag(pts).over(Window.partitionBy(by).orderBy(order)))
        key = F.max(F.greatest(F.coalesce(F.col("__last"), F.lit(0)), F.lit(0))).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumns({"__key": key, "kind": F.lit(kind), "__end": F.lit(0)})
        tail = df.groupBy(by).agg(F.max(order).alias("__m"), F.max(F.greatest(F.col(pts), F.lit(0))).alias("__key"))
        ends = tail.select(by, (F.col("__m") + 1).alias(order), F.lit(None).cast("long").alias(pts), "__key", F.lit(kind).alias("kind"), F.lit(1).alias("__end"))
        return rows.select(by, order, pts, "__key", "kind", "__end").unionByName(ends)

    both = keyed(video, 0).unionByName(keyed(audio, 1))
    out = Window.partitionBy(by).orderBy("__key", "kind", order)
    stopped = both.withColumn("__stop", F.max("__end").over(out.rowsBetween(Window.unboundedPreceding, 0))).where("__stop = 0")
    return stopped.withColumn("n", (F.row_number().over(out) - 1).cast("long")).select(by, "n", "kind", order, pts)


def align_frames(decoded: DataFrame, reference: DataFrame, offset: int, poc_scale: int) -> DataFrame:
    """Decoded pictures (poc) beside the reference picture of number poc / scale + offset."""
    ref = reference.select(*[F.col(c).alias("ref_" + c) for c in reference.columns])
    return decoded.join(ref, idiv(F.col("poc"), poc_scale) + offset == F.col("ref_frame_no"))


def apply_qpfile(frames: DataFrame, forced: DataFrame, qp_min: int, qp_max: int, no: str = "i") -> DataFrame:
    """Forced type and quantiser where given, the quantiser within limits."""
    return frames.join(forced.select(no, F.col("ftype").alias("__t"), F.col("qp").alias("__q")), no, "left").select(
        *[c for c in frames.columns if c not in ("ftype", "qp")], F.coalesce("__t", "ftype").alias("ftype"),
        clamp(F.coalesce("__q", "qp"), qp_min, qp_max).alias("qp"),
    )


def check_hrd(decoders: DataFrame, buckets: DataFrame, by: str = "stream_id") -> DataFrame:
    """Decoders (rate, buffer, fullness) against a stream's bucket table (rate, b, f), between whose
    rows size and fullness are interpolated; below the first rate nothing can be said."""
    order = Window.partitionBy(by).orderBy("rate")
    spans = buckets.select(
        by, F.col("rate").alias("r0"), F.col("b").alias("b0"), F.col("f").alias("f0"), F.lead("rate").over(order).alias("r1"),
        F.lead("b").over(order).alias("b1"), F.lead("f").over(order).alias("f1"),
    )
    inside = (F.col("rate") >= F.col("r0")) & (F.col("r1").isNull() | (F.col("rate") < F.col("r1")))
    t = F.coalesce((F.col("rate") - F.col("r0")) / (F.col("r1") - F.col("r0")), F.lit(0.0))
    lerp = lambda a, b: F.col(a) + t * (F.coalesce(F.col(b), F.col(a)) - F.col(a))
    found = decoders.join(spans.withColumnRenamed(by, "__by"), (F.col(by) == F.col("__by")) & inside, "left")
    return found.select(*decoders.columns, lerp("b0", "b1").alias("need_b"), lerp("f0", "f1").alias("need_f")).withColumn(
        "compliant", (F.col("buffer") > F.col("need_b")) & (F.col("fullness") > F.col("need_f"))
    )


def selected_packets(packets: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    return packets.join(chosen.select(*on), on, "left_semi")


def missing_units(received: DataFrame, frames: DataFrame, n_units: int, by: str = "frame_no", unit: str = "mb") -> DataFrame:
    """Units 0 to n - 1 of every frame that were never received."""
    grid = frames.select(by).distinct().withColumn(unit, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_units - 1).cast("long"))))
    return grid.join(received.select(by, unit), [by, unit], "left_anti")


NEIGHBOURS = ((-1, 0), (0, -1), (1, 0), (0, 1), (-1, -1), (1, -1), (1, 1), (-1, 1))


def neighbour_states(blocks: DataFrame, n: int = 8, step: int = 1, usable_from: int = 2, by: str = "frame_no") -> DataFrame:
    """Blocks with ``n_neighbours`` (inside the frame) and ``n_usable`` (state at least ``usable_from``).

    Every block names itself to the cells around it, so one shuffle by cell counts them.
    """
    moves = F.array(*[F.struct(F.lit(dx * step).alias("dx"), F.lit(dy * step).alias("dy")) for dx, dy in NEIGHBOURS[:n]])
    told = blocks.select(by, "x", "y", "state", F.explode(moves).alias("m")).select(
        by, (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), (F.col("state") >= usable_from).cast("long").alias("__ok")
    )
    counts = told.groupBy(by, "x", "y").agg(F.count("*").alias("n_neighbours"), F.sum("__ok").alias("n_usable"))
    return blocks.join(counts, [by, "x", "y"], "left").fillna(0, ["n_neighbours", "n_usable"])


def block_match(cur: DataFrame, ref: DataFrame, reach: int, by: list[str], size: int = 4) -> DataFrame:
    """For every block of ``cur`` the displacement within ``reach`` with the least sum of absolute
    differences to ``ref`` (same ``by`` keys); the first candidate in raster order wins ties. Only
    displacements that keep the whole block inside count."""
    offsets = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    moves = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dy, dx) in enumerate(offsets)])
    tried = cur.select(*by, "x", "y", F.col("v").alias("__c"), F.explode(moves).alias("m"))
    shifted = ref.select(*by, F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("v").alias("__r"))
    pairs = tried.withColumns({"__x": F.col("x") + F.col("m.dx"), "__y": F.col("y") + F.col("m.dy")}).join(shifted, [*by, "__x", "__y"])
    block = [idiv(F.col("x"), size).alias("block_x"), idiv(F.col("y"), size).alias("block_y")]
    sads = pairs.groupBy(*by, *block, F.col("m.k").alias("k"), F.col("m.dx").alias("dx"), F.col("m.dy").alias("dy")).agg(
        F.sum(F.abs(F.col("__c") - F.col("__r"))).alias("sad"), F.count("*").alias("n")
    )
    whole = sads.where(F.col("n") == size * size)
    best = whole.groupBy(*by, "block_x", "block_y").agg(F.min(F.struct("sad", "k", "dx", "dy")).alias("m"))
    return best.select(*by, "block_x", "block_y", F.col("m.dx").cast("long").alias("dx"), F.col("m.dy").cast("long").alias("dy"), F.col("m.sad").cast("long").alias("sad"))


def reference_lists(slices: DataFrame, n: int, by: list[str], order: str = "k") -> tuple[DataFrame, DataFrame]:
    """The ``n`` last references before and the ``n`` first behind every picture that is none, as two tables
    of ``*by, i, idx, poc``: references are numbered, and a picture names the numbers around it."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = slices.withColumn("__r", F.sum((F.col("is_ref") == 1).cast("long")).over(upto))
    refs = numbered.where("is_ref = 1").select(*by, "__r", F.col(order).alias("idx"), "poc")
    cur = numbered.where("is_ref = 0").select(*by, "i", F.col("__r").alias("__c"))
    beside = lambda first, last: cur.withColumn("__r", F.explode(F.sequence(F.col("__c") + first, F.col("__c") + last))).join(refs, [*by, "__r"]).select(*by, "i", "idx", "poc")
    return beside(1 - n, 0), beside(1, n)


def implicit_weights(cur: DataFrame, list0: DataFrame, list1: DataFrame, by: list[str]) -> DataFrame:
    """Weights of every pair of references of a picture, from distances in picture order."""
    pairs = cur.join(list0.select(*by, F.col("idx").alias("idx0"), F.col("poc").alias("poc0")), by).join(
        list1.select(*by, F.col("idx").alias("idx1"), F.col("poc").alias("poc1")), by
    )
    pt, p0 = (F.col("poc1") - F.col("poc0")).cast("long"), (F.col("poc") - F.col("poc0")).cast("long")
    x = F.when(pt != 0, idiv(F.lit(16384) + F.shiftright(pt, 1), F.nullif(pt, F.lit(0).cast("long"))))
    z = clamp(F.shiftright((x * p0 + 32).cast("long"), 6), -1024, 1023)
    w1 = F.shiftright(z.cast("long"), 2)
    fits = F.coalesce((pt != 0) & w1.between(-64, 128), F.lit(False))
    return pairs.withColumns({"w0": F.when(fits, 64 - w1).otherwise(F.lit(32)).cast("long"), "w1": F.when(fits, w1).otherwise(F.lit(32)).cast("long")})


def av_align(video: DataFrame, audio: DataFrame, tolerance: int, by: str = "file") -> DataFrame:
    """Video packets (ts) with the newest audio time at or before them and the drift, null beyond the tolerance."""
    found = as_of(video, audio, [by], "ts", "ts", F.col("ts"), "audio_ts")
    near = F.col("ts") - F.col("audio_ts") <= tolerance
    return found.withColumn("audio_ts", F.when(near, F.col("audio_ts"))).withColumn("drift", F.col("ts") - F.col("audio_ts"))


def overlay_configs(layers: DataFrame, keys: list[str], run: str = "run_id") -> DataFrame:
    """One row per run: for every key the value of the last layer that sets it."""
    set_ = layers.where("value is not null").groupBy(run, "key").agg(F.max_by("value", "layer").alias("value"))
    return set_.groupBy(run).pivot("key", keys).agg(F.first("value"))


def session_codecs(attrs: DataFrame) -> DataFrame:
    """Payload types of a session's sections: codec, clock, parameters, feedback, and the type that a
    retransmission repeats."""
    key = ["session", "section", "pt"]
    rtpmap = attrs.where("attr = 'rtpmap'").select(
        *key, F.regexp_extract("value", r"^(\S+?)/", 1).alias("codec"), F.regexp_extract("value", r"/(\d+)", 1).cast("int").alias("clock")
    )
    fmtp = attrs.where("attr = 'fmtp'").groupBy(*key).agg(F.concat_ws(";", F.sort_array(F.collect_list("value"))).alias("params"))
    feedback = attrs.where("attr = 'rtcp-fb'").groupBy(*key).agg(F.sort_array(F.collect_list("value")).alias("feedback"))
    whole = rtpmap.join(fmtp, key, "left").join(feedback, key, "left").withColumn("apt", F.regexp_extract("params", r"(?:^|;)apt=(\d+)", 1).try_cast("int"))
    base = rtpmap.select("session", "section", F.col("pt").alias("apt"), F.col("codec").alias("apt_codec"))
    return whole.join(base, ["session", "section", "apt"], "left")


def ssrc_groups(attrs: DataFrame) -> DataFrame:
    """Members of each source group with the attributes of every member."""
    groups = attrs.where("attr = 'ssrc-group'").select("session", "section", F.split("value", " ").alias("p")).select(
        "session", "section", F.get("p", F.lit(0)).alias("semantics"), F.posexplode(F.slice("p", 2, 1 << 20)).alias("n", "ssrc")
    )
    said = attrs.where("attr = 'ssrc'").select("session", "section", F.split("value", " ", 2).alias("p")).select(
        "session", "section", F.get("p", F.lit(0)).alias("ssrc"), F.get("p", F.lit(1)).alias("said")
    ).groupBy("session", "section", "ssrc").agg(F.sort_array(F.collect_list("said")).alias("attributes"))
    return groups.join(said, ["session", "section", "ssrc"], "left")
