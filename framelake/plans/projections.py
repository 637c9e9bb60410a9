"""Queries of the projections, filters and column functions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import projections as P
from ..operators import selection
from .registry import Entry

CAST = lambda *names: [F.col(n).cast("long").alias(n) for n in names]

_BOUNDS = ", ".join(f"({i}, {b})" for i, b in enumerate(C.qstep_upper_bounds()[:-1]))
_PROFILE_SQL = """
select run_id, array_to_string(list_filter([
  case when profile not in (66, 77, 88) then 'profile' end,
  case when profile = 66 and bframes <> 0 then 'bframes' end, case when profile = 66 and sp <> 0 then 'sp' end,
  case when profile = 66 and partition_mode <> 0 then 'partition_mode' end, case when profile = 66 and weighted <> 0 then 'weighted' end,
  case when profile = 66 and weighted_bi <> 0 then 'weighted_bi' end, case when profile = 66 and cabac = 1 then 'cabac' end,
  case when profile = 77 and sp <> 0 then 'sp' end, case when profile = 77 and partition_mode <> 0 then 'partition_mode' end,
  case when profile = 77 and slice_groups <> 0 then 'slice_groups' end, case when profile = 77 and redundant <> 0 then 'redundant' end,
  case when profile = 88 and direct_8x8 = 0 then 'direct_8x8' end, case when profile = 88 and cabac = 1 then 'cabac' end
], lambda x: x is not null), ',') as violations from {m_configs}"""


def _formats(t):
    fmt = F.element_at(F.array(*map(F.lit, ("u8", "s16p", "fltp", "s32", "dblp", "xyz"))), (F.col("stream_index") % 6 + 1).cast("int"))
    known, rejected = P.format_name(t("m_streams").withColumn("sample_fmt", fmt))
    return known.select("stream_index", "raw_name", "out_channels").unionByName(
        rejected.select("stream_index", F.lit(None).cast("string").alias("raw_name"), F.lit(None).cast("long").alias("out_channels"))
    )


def _woven(t):
    top, bottom = P.split_fields(t("m_pixels").select("frame_no", "x", "y", "v"))
    short = bottom.where(~((F.col("frame_no") % 5 == 0) & (F.col("y") == 3)))  # every fifth frame has a bottom field of another size
    return P.weave_fields(top, short).select("frame_no", "parity", *CAST("x", "y", "v"), "woven")


def _samples(t):
    rows = t("m_samples").groupBy("file", "idx").agg(F.array_sort(F.collect_list(F.struct("ch", "s"))).alias("c"))
    return rows.select("file", "idx", F.transform("c", lambda e: e["s"]).alias("ch"))


def _channels(t):
    ch = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("ch") == k, F.struct("idx", "s")))), lambda e: F.round(e["s"], 6))
    both = t("m_samples").groupBy("file").agg(ch(0).alias("l"), ch(1).alias("r"))
    mixed = both.withColumn("mixed", C.interleave(F.col("l"), F.col("r")))
    return mixed.select("file", F.posexplode("mixed").alias("n", "s"), C.deinterleave(F.col("mixed"), 2, 1).alias("again")).select(
        "file", F.col("n").cast("long").alias("n"), "s", F.size("again").cast("long").alias("n_right")
    )


ENTRIES = {
    "prj01_rescale_ts": Entry(
        lambda t: t("m_packets").select(
            "stream_id", "pos", C.rescale_ts(F.col("pts"), (1, 90000), (1, 44100)).alias("near"), C.rescale_ts(-F.col("pts") - 1, (1, 90000), (1, 1000)).alias("negative"),
            C.rescale_ts(F.col("pts") + 7, (1, 90000), (1, 44100), "up").alias("up"),
        ),
        """select stream_id, pos, cast((2 * cast(pts as hugeint) * 44100 + 90000) // 180000 as bigint) as near,
cast(-((2 * (cast(pts as hugeint) + 1) * 1000 + 90000) // 180000) as bigint) as negative,
cast(((cast(pts as hugeint) + 7) * 44100 + 89999) // 90000 as bigint) as up from {m_packets}""",
    ),
    "prj02_fill_missing_pts": Entry(
        lambda t: P.fill_missing_pts(t("m_packets"), 30, (1, 90000)).select("stream_id", "pos", "pts", "duration"),
        """select stream_id, pos, cast(coalesce(pts, cast(pos as hugeint) * 33333 * 90000 // 1000000) as bigint) as pts,
cast(case when pts is null then cast(33333 as bigint) * 90000 // 1000000 else duration end as bigint) as duration from {m_packets}""",
    ),
    "prj03_nal_header_fields": Entry(
        lambda t: t("events").select("event_id", C.nal_header_fields(F.col("event_id") % 256).alias("h")).select("event_id", *[F.col(f"h.{c}").cast("long").alias(c) for c in ("forbidden", "ref_idc", "nal_type")]).withColumn(
            "back", C.nal_header_byte(F.col("forbidden"), F.col("ref_idc"), F.col("nal_type"))
        ),
        """select event_id, (event_id % 256) >> 7 & 1 as forbidden, (event_id % 256) >> 5 & 3 as ref_idc, event_id % 32 as nal_type,
event_id % 256 as back from {events}""",
    ),
    "prj08_exp_golomb": Entry(
        lambda t: t("m_frame_log").select("event_id", C.ue_bits(F.col("bits")).alias("ue_len"), C.se_bits(F.col("bits") - 20000).alias("se_len"), C.ue_code(F.col("bits")).alias("code")),
        """select event_id, cast(length(bin(bits + 1)) * 2 - 1 as bigint) as ue_len,
cast(length(bin(case when bits > 20000 then 2 * (bits - 20000) - 1 else 2 * (20000 - bits) end + 1)) * 2 - 1 as bigint) as se_len,
repeat('0', length(bin(bits + 1)) - 1) || bin(bits + 1) as code from {m_frame_log}""",
    ),
    "prj09_slice_type_name": Entry(
        lambda t: t("events").select("event_id", C.slice_type_name(F.col("event_id") % 10).alias("name"), (F.col("event_id") % 10 >= 5).alias("whole_picture")),
        "select event_id, ['P', 'B', 'I', 'SP', 'SI'][event_id % 5 + 1] as name, event_id % 10 >= 5 as whole_picture from {events}",
    ),
    "prj10_quantiser_steps": Entry(
        lambda t: t("m_frame_log").select(
            "event_id", C.qp_to_qstep(F.col("bits") % 52).alias("step"), C.qstep_to_qp(F.col("bits") / 150.0).alias("qp"), C.qstep_to_qp(C.qp_to_qstep(F.col("bits") % 52)).alias("back")
        ),
        f"""with bounds(qp, b) as (values {_BOUNDS})
select event_id, cast([0.625, 0.6875, 0.8125, 0.875, 1.0, 1.125][bits % 52 % 6 + 1] as double) * pow(2.0, bits % 52 // 6) as step,
cast((select count(*) from bounds where b < bits / 150.0) as bigint) as qp, bits % 52 as back from {{m_frame_log}}""",
    ),
    "prj11_block_positions": Entry(
        lambda t: t("events").select("event_id", C.mb_xy(F.col("event_id"), 11).alias("m"), C.block_pos(F.col("event_id") % 16).alias("b")).select(
            "event_id", "m.x", "m.y", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("row", "col")], C.block_index(F.col("b.row"), F.col("b.col")).cast("long").alias("back")
        ),
        """select event_id, event_id % 11 as x, event_id // 11 as y, event_id % 16 // 8 * 2 + event_id % 4 // 2 as row,
event_id % 16 // 4 % 2 * 2 + event_id % 2 as col, event_id % 16 as back from {events}""",
    ),
    "prj12_gain_to_s16": Entry(
        lambda t: _samples(t).select("file", "idx", F.posexplode(C.to_s16(C.apply_gain(F.col("ch"), 2.5))).alias("ch", "s")).select("file", "idx", *CAST("ch", "s")),
        "select file, idx, ch, cast(greatest(-32768, least(32767, round(s * 2.5 * 32768))) as bigint) as s from {m_samples}",
    ),
    "prj13_interleave": Entry(
        _channels, "select file, idx * 2 + ch as n, round(s, 6) as s, cast(count(*) filter (ch = 1) over (partition by file) as bigint) as n_right from {m_samples}"
    ),
    "prj14_downmix": Entry(
        lambda t: _samples(t).select("file", "idx", (F.round(C.downmix(F.col("ch")), 6) + 0.0).alias("s")), "select file, idx, round(avg(s), 6) + 0.0 as s from {m_samples} group by file, idx"
    ),
    "prj15_hflip_crop": Entry(
        lambda t: selection.chain(t("m_pixels"), [partial(P.hflip, width=8), partial(P.crop, left=1, top=2, right=1, bottom=0, width=8, height=8)]).select("frame_no", *CAST("x", "y", "v")),
        "select frame_no, 7 - x - 1 as x, y - 2 as y, cast(v as bigint) as v from {m_pixels} where 7 - x between 1 and 6 and y >= 2",
    ),
    "prj15_stored_crop": Entry(
        lambda t: P.crop_units(t("m_pixels"), 1, 0, 0, 1, 8, 8, True).select("frame_no", *CAST("x", "y", "v")),
        "select frame_no, x - 2 as x, y, cast(v as bigint) as v from {m_pixels} where x >= 2 and y <= 3",
    ),
    "prj15_select_every": Entry(
        lambda t: P.select_every(P.seek(t("m_frame_log").withColumnRenamed("i", "frame_no"), 3), 5, [3, 0]).select("stream_id", "frame_no", F.col("out_no").cast("long").alias("out_no"), "bits"),
        """select stream_id, i - 3 as frame_no, (i - 3) // 5 * 2 + case (i - 3) % 5 when 3 then 0 else 1 end as out_no, bits
from {m_frame_log} where i >= 3 and (i - 3) % 5 in (3, 0)""",
    ),
    "prj15_frame_skip": Entry(
        lambda t: P.frame_skip(t("m_frame_log"), 2, "i").select("stream_id", "i", "bits"), "select stream_id, i, bits from {m_frame_log} where i % 3 = 0"
    ),
    "prj16_profile_violations": Entry(lambda t: P.profile_violations(t("m_configs")).select("run_id", F.array_join("violations", ",").alias("violations")), _PROFILE_SQL),
    "prj17_coefficient_stats": Entry(
        lambda t: t("m_coeff").select("frame_no", "block", C.coeff_stats(F.col("c")).alias("s")).select(
            "frame_no", "block", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("total", "trailing_ones", "total_zeros")], F.array_join("s.runs_before", ",").alias("runs")
        ),
        """with nz as (select frame_no, block, p, c, row_number() over (partition by frame_no, block order by p desc) as k,
    max(case when abs(c) > 1 then p end) over (partition by frame_no, block) as big,
    p - lag(p) over (partition by frame_no, block order by p) - 1 as run
  from (select frame_no, block, unnest(c) as c, unnest(range(16)) as p from {m_coeff}) where c <> 0),
s as (select frame_no, block, count(*) as total, least(3, count(*) filter (big is null or p > big)) as ones, max(p) + 1 - count(*) as zeros,
    coalesce(string_agg(cast(run as varchar), ',' order by k) filter (run is not null), '') as runs from nz group by frame_no, block)
select b.frame_no, b.block, coalesce(total, 0) as total, coalesce(ones, 0) as trailing_ones, coalesce(zeros, 0) as total_zeros,
  coalesce(runs, '') as runs from {m_coeff} b left join s using (frame_no, block)""",
    ),
    "prj18_format_name": Entry(
        _formats,
        """select stream_index, case stream_index % 6 when 0 then 'u8' when 1 then 's16le' when 2 then 'f32le' when 3 then 's32le' when 4 then 'f64le' end as raw_name,
case stream_index % 6 when 1 then 1 when 2 then 1 when 4 then 1 when 5 then null else channels end as out_channels from {m_streams}""",
    ),
    "prj20_weight_pixels": Entry(
        lambda t: P.weighted(t("m_pixels"), F.col("frame_no") % 100).select("frame_no", *CAST("x", "y", "v")),
        "select frame_no, x, y, cast(greatest(0, least(255, (v * (frame_no % 100) + 16) >> 5)) as bigint) as v from {m_pixels}",
    ),
    "prj21_weave_fields": Entry(
        _woven,
        """select frame_no, cast(y % 2 as int) as parity, x, case when frame_no % 5 = 0 then y // 2 else y end as y, cast(v as bigint) as v, frame_no % 5 <> 0 as woven
from {m_pixels} where not (frame_no % 5 = 0 and y = 7)""",
    ),
}
