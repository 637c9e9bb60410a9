"""Operators that change rows one by one (or look up the row before)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import idiv, rtp_header_fields, weight_pixels

#: Sample formats and their raw names (planar ones are written as one packed channel).
SAMPLE_FORMATS = {
    "u8": "u8", "s16": "s16le", "s32": "s32le", "flt": "f32le", "dbl": "f64le",
    "u8p": "u8", "s16p": "s16le", "s32p": "s32le", "fltp": "f32le", "dblp": "f64le",
}


def fill_missing_pts(packets: DataFrame, fps: int, tb: tuple[int, int], by: str = "stream_id", order: str = "pos") -> DataFrame:
    """A missing pts becomes n frames of floor(1e6 / fps) microseconds in stream ticks, n counting all
    packets of the stream; its duration likewise."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    frame_us = 1_000_000 // fps
    ticks = lambda us: idiv(us.cast("decimal(20,0)") * F.lit(tb[1]), 1_000_000 * tb[0]).cast("long")
    missing = F.col("pts").isNull()
    return packets.withColumn("__n", n).withColumns({
        "pts": F.when(missing, ticks(F.col("__n") * F.lit(frame_us))).otherwise(F.col("pts")),
        "duration": F.when(missing, ticks(F.lit(frame_us))).otherwise(F.col("duration")),
    }).drop("__n")


def hflip(pixels: DataFrame, width: int) -> DataFrame:
    return pixels.withColumn("x", F.lit(width - 1) - F.col("x"))


def crop(pixels: DataFrame, left: int, top: int, right: int, bottom: int, width: int, height: int) -> DataFrame:
    """What is inside the margins, with the origin moved."""
    inside = F.col("x").between(left, width - 1 - right) & F.col("y").between(top, height - 1 - bottom)
    return pixels.where(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def select_every(frames: DataFrame, step: int, offsets: list[int], no: str = "frame_no") -> DataFrame:
    """Frames whose number modulo ``step`` is among the offsets; ``out_no`` numbers them in the order of the offsets."""
    found = F.array_position(F.array(*map(F.lit, offsets)), F.pmod(F.col(no), F.lit(step)).cast("int"))
    kept = frames.where(found > 0)
    return kept.withColumn("out_no", idiv(F.col(no), step) * len(offsets) + F.array_position(F.array(*map(F.lit, offsets)), F.pmod(F.col(no), F.lit(step)).cast("int")) - 1)


def seek(frames: DataFrame, n: int, no: str = "frame_no") -> DataFrame:
    return frames.where(F.col(no) >= n).withColumn(no, F.col(no) - n)


def frame_skip(frames: DataFrame, k: int, no: str = "frame_no") -> DataFrame:
    """One frame, then ``k`` left out."""
    return frames.where(F.pmod(F.col(no), F.lit(k + 1)) == 0)


def crop_units(pixels: DataFrame, left: int, top: int, right: int, bottom: int, width: int, height: int, field_capable: bool = False) -> DataFrame:
    """Crop stored in units of two samples (four lines where fields are possible)."""
    v = 4 if field_capable else 2
    return crop(pixels, 2 * left, v * top, 2 * right, v * bottom, width, height)


def profile_violations(configs: DataFrame) -> DataFrame:
    """``configs`` with ``violations``: the names of all rules that the profile breaks."""
    profile = F.col("profile")
    rule = lambda p, cond, name: F.when((profile == p) & cond, F.lit(name))
    some = lambda c: F.col(c) != 0
    rules = [
        F.when(~profile.isin(66, 77, 88), F.lit("profile")),
        rule(66, some("bframes"), "bframes"), rule(66, some("sp"), "sp"), rule(66, some("partition_mode"), "partition_mode"),
        rule(66, some("weighted"), "weighted"), rule(66, some("weighted_bi"), "weighted_bi"), rule(66, F.col("cabac") == 1, "cabac"),
        rule(77, some("sp"), "sp"), rule(77, some("partition_mode"), "partition_mode"), rule(77, some("slice_groups"), "slice_groups"),
        rule(77, some("redundant"), "redundant"),
        rule(88, F.col("direct_8x8") == 0, "direct_8x8"), rule(88, F.col("cabac") == 1, "cabac"),
    ]
    return configs.withColumn("violations", F.array_compact(F.array(*rules)))


def format_name(streams: DataFrame, fmt: str = "sample_fmt") -> tuple[DataFrame, DataFrame]:
    """Streams with ``raw_name`` and ``out_channels`` (planar: 1), and those of unknown formats."""
    names = F.create_map(*[F.lit(x) for kv in SAMPLE_FORMATS.items() for x in kv])
    named = streams.withColumn("raw_name", F.element_at(names, F.col(fmt)))
    planar = F.col(fmt).endswith("p")
    known = named.where("raw_name is not null").withColumn("out_channels", F.when(planar, F.lit(1)).otherwise(F.col("channels")).cast("long"))
    return known, named.where("raw_name is null").drop("raw_name")


def weighted(pixels: DataFrame, w: Column) -> DataFrame:
    return pixels.withColumn("v", weight_pixels(F.col("v"), w))


def split_fields(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Even lines and odd lines, each numbered anew."""
    half = pixels.withColumn("__odd", F.pmod(F.col("y"), F.lit(2))).withColumn("y", idiv(F.col("y"), 2))
    return half.where("__odd = 0").drop("__odd"), half.where("__odd = 1").drop("__odd")


def weave_fields(top: DataFrame, bottom: DataFrame, key: str = "frame_no") -> DataFrame:
    """Line y of a top field becomes line 2y, of a bottom field 2y + 1. Where the fields of a frame
    differ in size, or one is missing, both stay as they are; ``woven`` says which."""
    size = lambda df, side: df.groupBy(key).agg((F.max("x") + 1).alias(f"__w{side}"), (F.max("y") + 1).alias(f"__h{side}"))
    fit = size(top, 0).join(size(bottom, 1), key, "full").select(
        key, F.coalesce((F.col("__w0") == F.col("__w1")) & (F.col("__h0") == F.col("__h1")), F.lit(False)).alias("woven")
    )
    both = top.withColumn("parity", F.lit(0)).unionByName(bottom.withColumn("parity", F.lit(1)))
    return both.join(fit, key).withColumn("y", F.when(F.col("woven"), 2 * F.col("y") + F.col("parity")).otherwise(F.col("y")))


def zero_byte_warnings(nal: DataFrame) -> DataFrame:
    """Units (with ``au_position`` in their access unit) whose three-byte start code is too short:
    parameter sets and the first unit of an access unit."""
    return nal.where((F.col("start_code_len") == 3) & (F.col("nal_type").isin(7, 8) | (F.col("au_position") == 1)))




def parted_rtp(packets: DataFrame, packet: str = "packet", layout: str = "rfc3550") -> tuple[DataFrame, DataFrame]:
    """Packets with their header fields (column ``rtp``): those that are valid, and the others in quarantine
    with the first ``reason`` that holds."""
    fields = packets.withColumn("rtp", rtp_header_fields(F.col(packet), layout))
    f = F.col("rtp")
    reason = (
        F.when(F.col(packet).isNull() | (F.octet_length(packet) < 12), F.lit("short")).when(f["version"] != 2, F.lit("version")).when(f["padding"] != 0, F.lit("padding"))
        .when(f["extension"] != 0, F.lit("extension")).when(f["csrc_count"] != 0, F.lit("sources"))
    )
    judged = fields.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
