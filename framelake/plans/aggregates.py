"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from .registry import Entry


def _pair(t):
    """Frames beside the frame before them."""
    px = t("m_pixels").select("frame_no", "x", "y", "v")
    return px, px.withColumn("frame_no", F.col("frame_no") + 1)


def _sps(t):
    e = F.col("event_id")
    return t("events").select(
        F.col("user_id").alias("file"), e.alias("pos"), (e % 3).alias("poc_type"), (e % 5).alias("log2_max_poc_lsb"), (e % 7).alias("offset_non_ref"), (e % 2).alias("frame_mbs_only"),
        F.floor(e % 4 / 2).alias("mb_adaptive"), F.when(e % 6 < 3, 1).otherwise(0).alias("cropping"), (e % 3 + 1).alias("crop_left"), F.when(e % 101 == 0, 0).otherwise(1).alias("valid"),
    )


def _gops(t):
    p = F.col("ftype") == "P"
    qp = F.col("bits") % 40 + 10
    return t("m_gop").groupBy("stream_id", "gop").agg(
        F.sum(p.cast("int")).alias("np"), F.sum((F.col("ftype") == "B").cast("int")).alias("nb"), F.sum(F.when(p, qp).otherwise(0)).alias("sum_qp"),
        F.coalesce(F.max_by(F.when(p, qp), F.when(p, F.col("i"))), F.lit(26)).cast("int").alias("last_qp"),
    )


FLAGS = ["bframes", "sp", "partition_mode", "weighted", "cabac", "slice_groups"]
_ERRORS_SQL = "from {m_pixels} a join {m_pixels} b on a.frame_no = b.frame_no + 1 and a.x = b.x and a.y = b.y"

def _points(t):
    return t("m_candidates").select("mb", (F.col("rate") % 13 + 1).alias("q"), F.col("dist").alias("r"))


_FIT_SQL = """with m as (select mb, cast(count(*) as double) as a00, sum(1.0 / q) as a01, sum(1.0 / (q * q)) as a11, cast(sum(q * r) as double) as b0, cast(sum(r) as double) as b1, min(q) = max(q) as same
  from (select mb, cast(rate % 13 + 1 as double) as q, cast(dist as double) as r from {m_candidates}) group by mb)
select mb, round(case when not same and abs(a00 * a11 - a01 * a01) > 1e-6 then (b0 * a11 - b1 * a01) / (a00 * a11 - a01 * a01) else b0 / a00 end, 4) as x1,
round(case when not same and abs(a00 * a11 - a01 * a01) > 1e-6 then (b1 * a00 - b0 * a01) / (a00 * a11 - a01 * a01) else 0.0 end, 4) as x2 from m"""

ENTRIES = {
    "ag01_stream_summary": Entry(
        lambda t: A.stream_summary(t("m_packets"), (1, 90000)),
        """select *, round(bytes * 8 / (ticks / 90000.0), 6) as bit_rate, round(n / (ticks / 90000.0), 6) as fps from (
select stream_id, count(*) as n, cast(sum(size) as bigint) as bytes, min(pts) as first_pts, max(pts) as last_pts, max(pts + duration) - min(pts) as ticks from {m_packets} group by stream_id)""",
    ),
    "ag02_frame_type_totals": Entry(
        lambda t: A.frame_type_totals(t("m_frame_log").withColumn("qp", F.col("bits") % 52 + 0.25), ("stream_id", "ftype")),
        "select stream_id, ftype, count(*) as n, cast(sum(bits) as bigint) as bits, cast(sum(cast(floor(bits * (bits % 52 + 0.25) + 0.5) as bigint)) as bigint) as complexity from {m_frame_log} group by stream_id, ftype",
    ),
    "ag03_gop_summary": Entry(
        lambda t: A.gop_summary(t("m_gop"), 500000, 30),
        """select *, cast(sum(allotted - used) over (partition by stream_id order by gop rows unbounded preceding) as bigint) as left_over from (
select stream_id, gop, count(*) filter (ftype = 'P') as np, count(*) filter (ftype = 'B') as nb, cast(sum(bits) as bigint) as used,
cast(floor((1 + count(*) filter (ftype in ('P', 'B'))) * 500000 / 30.0 + 0.5) as bigint) as allotted from {m_gop} group by stream_id, gop)""",
    ),
    "ag04_gop_initial_qp": Entry(
        lambda t: A.gop_initial_qp(_gops(t), 26).withColumn("qp", F.col("qp").cast("long")),
        """with recursive q as (select stream_id, gop, count(*) filter (ftype = 'P') as np, count(*) filter (ftype = 'B') as nb, coalesce(sum(bits % 40 + 10) filter (ftype = 'P'), 0) as total,
  coalesce(max_by(bits % 40 + 10, i) filter (ftype = 'P'), 26) as last from {m_gop} group by stream_id, gop),
n as (select *, row_number() over (partition by stream_id order by gop) as k, floor(total / greatest(np, 1) + 0.5) - least(2, floor((np + nb + 1) / 15.0 + 0.5)) as a from q),
v as (select *, case when a > last - 2 then a - 1 else a end as average from n),
e as (select stream_id, gop, k, cast(26 as double) as qp from v where k = 1 union all
  select v.stream_id, v.gop, v.k, case when b.np > 0 then greatest(0, least(51, greatest(e.qp - 2, least(e.qp + 2, b.average)))) else e.qp end
  from e join v b on b.stream_id = e.stream_id and b.k = e.k join v on v.stream_id = e.stream_id and v.k = e.k + 1)
select stream_id, gop, cast(qp as bigint) as qp from e""",
    ),
    "ag05_pixel_errors": Entry(
        lambda t: A.pixel_errors(*_pair(t), ["frame_no"]),
        f"""select a.frame_no, cast(sum(abs(a.v - b.v)) as bigint) as sad, round(avg(abs(a.v - b.v)), 6) as mad, round(avg((a.v - b.v) * (a.v - b.v)), 6) as mse,
case when sum(abs(a.v - b.v)) > 0 then round(10 * log10(65025.0 / avg((a.v - b.v) * (a.v - b.v))), 6) end as psnr {_ERRORS_SQL} group by a.frame_no""",
    ),
    "ag05_frame_mad": Entry(
        lambda t: A.frame_mad(*_pair(t), 4),
        f"select frame_no, round(avg(s / 16.0), 6) as frame_mad from (select a.frame_no, cast(sum(abs(a.v - b.v)) as double) as s {_ERRORS_SQL} group by a.frame_no, a.x // 4, a.y // 4) group by frame_no",
    ),
    "ag06_ssim": Entry(
        lambda t: A.ssim(*_pair(t)),
        f"""select frame_no, round(avg((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225))), 6) as ssim from (
select a.frame_no, avg(a.v) as ma, avg(b.v) as mb, avg(a.v * a.v) as aa, avg(b.v * b.v) as bb, avg(a.v * b.v) as ab {_ERRORS_SQL} group by a.frame_no) group by frame_no""",
    ),
    "ag07_dc_weight": Entry(
        lambda t: A.dc_weight(t("m_pixels"), t("m_pixels").select((F.col("frame_no") + 1).alias("frame_no"), F.lit(0).alias("ref_no"), "v").unionByName(t("m_pixels").select((F.col("frame_no") + 2).alias("frame_no"), F.lit(1).alias("ref_no"), "v"))).select(
            "frame_no", F.col("ref_no").cast("long").alias("ref_no"), F.col("w").cast("long").alias("w")
        ),
        """with s as (select frame_no, cast(sum(v) as double) as s from {m_pixels} group by frame_no),
w as (select a.frame_no, k.ref_no, b.s as r, case when b.s = 0 then 32 else cast(trunc(32.0 * a.s / b.s + 0.5) as bigint) end as w
  from s a join (select unnest(range(2)) as ref_no) k on true join s b on b.frame_no = a.frame_no - 1 - k.ref_no)
select frame_no, ref_no, case when w between -64 and 127 then w else 32 end as w from w""",
    ),
    "ag08_symbol_histogram": Entry(
        lambda t: A.symbol_histogram(t("m_symbols"), "doc_id"),
        "select doc_id, sym, n, round(n / sum(n) over (partition by doc_id), 9) as p from {m_symbols}",
    ),
    "ag08_entropy": Entry(
        lambda t: A.entropy(t("m_symbols"), "doc_id"),
        "select doc_id, round(sum(-p * log2(p)), 6) as entropy from (select doc_id, n / sum(n) over (partition by doc_id) as p from {m_symbols}) group by doc_id",
    ),
    "ag09_coded_size": Entry(
        lambda t: A.coded_size(t("m_symbols"), A.prefix_code_lengths(t("m_symbols")), "doc_id").withColumn("bits", F.col("bits").cast("long")),
        """with recursive c as (select sym, cast(sum(n) as bigint) as n, row_number() over (order by sum(n), sym) - 1 as k from {m_symbols} group by sym),
h as (select list_sort(list({'n': n, 'k': k, 's': [sym]})) as heap, count(*) as made, cast([] as varchar[]) as deeper from c union all
  select list_sort(list_append(heap[3:], {'n': heap[1].n + heap[2].n, 'k': made, 's': list_concat(heap[1].s, heap[2].s)})), made + 1, list_concat(deeper, list_concat(heap[1].s, heap[2].s)) from h where len(heap) > 1),
l as (select unnest(deeper) as sym from h where len(heap) = 1),
d as (select sym, count(*) as length from l group by sym)
select doc_id, cast(sum(n * length) as bigint) as bits from {m_symbols} join d using (sym) group by doc_id""",
    ),
    "ag10_model_cost": Entry(
        lambda t: A.model_cost(t("m_symbols"), {"a": 0.5, "e": 0.25, "i": 0.125, "o": 0.1}, "doc_id"),
        """select doc_id, round(sum(n * case sym when 'a' then 1.0 when 'e' then 2.0 when 'i' then 3.0 when 'o' then -log2(0.1) else 0.0 end), 6) as bits,
cast(sum(case when sym in ('a', 'e', 'i', 'o') then 0 else n end) as bigint) as outside from {m_symbols} group by doc_id""",
    ),
    "ag11_distinct_param_sets": Entry(
        lambda t: A.distinct_param_sets(_sps(t)).select(*[F.col(c).cast("long").alias(c) for c in ("poc_type", "log2_max_poc_lsb", "offset_non_ref", "frame_mbs_only", "mb_adaptive", "cropping", "crop_left", "valid", "n")]),
        """with s as (select event_id % 3 as poc_type, event_id % 5 as lsb, event_id % 7 as off, event_id % 2 as fmo, event_id % 4 // 2 as mba, case when event_id % 6 < 3 then 1 else 0 end as cropping,
  event_id % 3 + 1 as cl, case when event_id % 101 = 0 then 0 else 1 end as valid, event_id from {events}),
f as (select poc_type, case when valid = 0 or poc_type = 0 then lsb end as log2_max_poc_lsb, case when valid = 0 or poc_type = 1 then off end as offset_non_ref, fmo as frame_mbs_only,
  case when valid = 0 or fmo = 0 then mba end as mb_adaptive, cropping, case when valid = 0 or cropping = 1 then cl end as crop_left, valid, case when valid = 0 then event_id end as own from s)
select poc_type, log2_max_poc_lsb, offset_non_ref, frame_mbs_only, mb_adaptive, cast(cropping as bigint) as cropping, crop_left, cast(valid as bigint) as valid, count(*) as n
from f group by poc_type, log2_max_poc_lsb, offset_non_ref, frame_mbs_only, mb_adaptive, cropping, crop_left, valid, own""",
    ),
    "ag12_coefficient_histogram": Entry(
        lambda t: A.coeff_histograms(t("m_coeff").select(C.coeff_stats(F.col("c")).alias("s")).select("s.*")).select(*[F.col(c).cast("long").alias(c) for c in ("total", "trailing_ones", "total_zeros", "n")]),
        """with e as (select frame_no, block, unnest(c) as c, unnest(range(16)) as p from {m_coeff}),
s as (select frame_no, block, count(*) filter (c <> 0) as total, max(case when c <> 0 then p end) as last, max(case when abs(c) > 1 then p end) as big from e group by frame_no, block),
o as (select s.frame_no, s.block, total, least(3, count(*) filter (abs(e.c) = 1 and (big is null or e.p > big))) as ones, coalesce(last, -1) - total + 1 as zeros
  from s join e on s.frame_no = e.frame_no and s.block = e.block group by s.frame_no, s.block, total, last)
select total, ones as trailing_ones, zeros as total_zeros, count(*) as n from o group by all""",
    ),
    "ag12_run_histogram": Entry(
        lambda t: A.run_histogram(t("m_coeff").select(C.coeff_stats(F.col("c")).alias("s")).select("s.*")).select(F.col("run").cast("long").alias("run"), "n"),
        """select run, count(*) as n from (select p - lag(p) over (partition by frame_no, block order by p) - 1 as run
from (select frame_no, block, unnest(c) as c, unnest(range(16)) as p from {m_coeff}) where c <> 0) where run is not null group by run""",
    ),
    "ag13_rtp_loss_summary": Entry(
        lambda t: A.rtp_loss_summary(t("m_rtp").withColumn("seq", F.when(F.col("arrival") % 11 == 5, F.col("seq") - 1).otherwise(F.col("seq")) % 65536)),
        """with r as (select ssrc, arrival, case when arrival % 11 = 5 then seq - 1 else seq end % 65536 as seq from {m_rtp}),
d as (select *, coalesce(((seq - lag(seq) over (partition by ssrc order by arrival) + 32768) % 65536 + 65536) % 65536 - 32768, 0) as d from r),
s as (select ssrc, sum(d) over (partition by ssrc order by arrival rows unbounded preceding) as s from d)
select ssrc, cast(max(s) - min(s) + 1 as bigint) as expected, count(*) as received, cast(max(s) - min(s) + 1 - count(distinct s) as bigint) as lost,
count(*) - count(distinct s) as repeated from s group by ssrc""",
    ),
    "ag14_corruption_summary": Entry(
        lambda t: A.corruption_summary(t("m_blocks"), t("m_segments")),
        """select b.*, coalesce(s.n, 0) as bad_segments from (select frame_no, count(*) filter (state = 0) as state_0, count(*) filter (state = 1) as state_1,
count(*) filter (state = 2) as state_2, count(*) filter (state = 3) as state_3 from {m_blocks} group by frame_no) b
left join (select frame_no, count(distinct start_mb) as n from {m_segments} where bad <> 0 group by frame_no) s on b.frame_no = s.frame_no""",
    ),
    "ag15_fit_rate_model": Entry(lambda t: A.fit_rate_model(_points(t), ["mb"]), _FIT_SQL),
    "ud04_fit_rate_model": Entry(lambda t: A.fit_rate_model_with(_points(t), ["mb"]), _FIT_SQL),
    "ag16_fit_linear_predictor": Entry(
        lambda t: A.fit_linear_predictor(t("m_candidates").select("mb", F.col("rate").alias("x"), (F.col("dist") % 1000).alias("y")), ["mb"]),
        """with m as (select mb, cast(count(*) as double) as n, sum(x) as sx, sum(x * x) as sxx, sum(y) as sy, sum(x * y) as sxy, avg(y / nullif(x, 0)) as ratio, min(y) = max(y) as same
  from (select mb, cast(rate as double) as x, cast(dist % 1000 as double) as y from {m_candidates}) group by mb)
select mb, round(case when same then ratio when abs(n * sxx - sx * sx) > 1e-6 then (sxy * n - sy * sx) / (n * sxx - sx * sx) else sy / nullif(sx, 0) end, 6) as c1,
round(case when not same and abs(n * sxx - sx * sx) > 1e-6 then (sy * sxx - sxy * sx) / (n * sxx - sx * sx) else 0.0 end, 6) as c2 from m""",
    ),
    "ag17_sei_totals": Entry(
        lambda t: A.sei_totals(t("m_frame_log").select((F.col("event_id") % 20).alias("payload_type"), F.floor(F.col("bits") / 8).alias("payload_size"))),
        """select event_id % 20 as payload_type, count(*) as n, cast(sum(bits // 8) as bigint) as bytes,
cast(sum(case when event_id % 20 = 3 then bits // 8 else 0 end) as bigint) as filler from {m_frame_log} group by event_id % 20""",
    ),
    "ag18_box_downscale": Entry(
        lambda t: A.box_downscale(t("m_pixels"), 2).select("frame_no", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "v"),
        "select frame_no, x // 2 as x, y // 2 as y, round(avg(v), 6) as v from {m_pixels} group by all",
    ),
    "ag19_feature_flags": Entry(
        lambda t: A.pack_flags(t("m_configs"), FLAGS).groupBy("profile", "flags").agg(F.count("*").alias("n")).select(F.col("profile").cast("long").alias("profile"), "flags", "n"),
        """select cast(profile as bigint) as profile, cast((bframes <> 0)::int + 2 * (sp <> 0)::int + 4 * (partition_mode <> 0)::int + 8 * (weighted <> 0)::int + 16 * (cabac <> 0)::int + 32 * (slice_groups <> 0)::int as bigint) as flags,
count(*) as n from {m_configs} group by all""",
    ),
    "ag19_flag_usage": Entry(
        lambda t: A.flag_usage(A.pack_flags(t("m_configs"), FLAGS), FLAGS),
        " union all ".join(f"select '{c}' as flag, count(*) filter ({c} <> 0) as n from {{m_configs}}" for c in FLAGS),
    ),
}
