"""Queries of sorting, choosing and set operations."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import projections as P
from ..operators import selection as S
from ..operators import windows as W
from .registry import Entry


def _redundant(t):
    return t("m_frame_log").select("stream_id", F.floor(F.col("i") / 3).alias("pic"), F.lit(0).alias("first_mb"), (F.col("bits") % 4).alias("redundant_pic_cnt"), F.col("i").alias("pos"))


def _deliveries(t):
    d = t("m_param_defs").select("file", "id", (F.col("body") % 50).alias("body"))
    return d.where("file % 2 = 0").select("id", "body"), d.where("file % 2 = 1").select("id", "body")


def _sets(t):
    e = F.col("event_id")
    s = t("events").select("user_id", (e % 3).alias("poc_type"), (e % 5).alias("log2_max_poc_lsb"), (e % 7).alias("offset_non_ref"))
    return s.where("user_id % 2 = 0").drop("user_id"), s.where("user_id % 2 = 1").drop("user_id")


#: A picture chain: every other picture, mirrored, two columns and a line cut off, pictures counted anew.
PICTURE_CHAIN = [
    partial(P.frame_skip, k=1),
    partial(P.hflip, width=8),
    partial(P.crop, left=2, top=1, right=0, bottom=0, width=8, height=8),
    partial(P.seek, n=4),
]


ENTRIES = {
    "ud01_picture_chain": Entry(
        lambda t: S.chain(t("m_pixels").select("frame_no", "x", "y", "v"), PICTURE_CHAIN).withColumn("v", F.col("v").cast("long")),
        "select frame_no - 4 as frame_no, 5 - x as x, y - 1 as y, cast(v as bigint) as v from {m_pixels} where frame_no % 2 = 0 and x <= 5 and y >= 1 and frame_no >= 4",
    ),
    "ud01_packet_chain": Entry(
        lambda t: S.chain(t("m_frame_log").select("stream_id", F.col("i").alias("frame_no"), "bits"), [partial(P.select_every, step=4, offsets=[1, 3]), partial(S.frame_range, seek=2, n=6, order="out_no")]),
        """with k as (select stream_id, i as frame_no, bits, i // 4 * 2 + case i % 4 when 3 then 1 else 0 end as out_no from {m_frame_log} where i % 4 in (1, 3))
select stream_id, frame_no, bits, out_no from k qualify row_number() over (partition by stream_id order by out_no) between 3 and 8""",
    ),
    "so01_sort_rates": Entry(
        lambda t: S.sort_rates(W.default_rates(t("m_frame_log"))),
        "select stream_id, cast(floor(avg(bits) * (1 + k / 4.0)) as bigint) as rate from {m_frame_log}, (select unnest(range(4)) as k) group by stream_id, k order by rate",
    ),
    "so02_best_mode": Entry(
        lambda t: S.best_mode(t("m_candidates"), 85.5),
        """with r as (select mb, cand, dist + 85.5 * rate as cost, row_number() over (partition by mb order by dist + 85.5 * rate, cand, rate, dist) as n from {m_candidates})
select mb, max(case when n = 1 then cand end) as cand, round(cast(min(cost) as double), 6) as cost, case when count(*) > 1 then round(cast(max(cost) - min(cost) as double), 6) end as margin from r where n <= 2 group by mb""",
    ),
    "so03_frame_range": Entry(lambda t: S.frame_range(t("m_frame_log"), 5, 20).select("stream_id", "i", "bits"), "select stream_id, i, bits from {m_frame_log} where i between 5 and 24"),
    "so04_rd_front": Entry(
        lambda t: S.rd_front(t("m_candidates")),
        """with o as (select mb, rate, min(dist) as dist from {m_candidates} group by mb, rate)
select mb, rate, dist from (select *, min(dist) over (partition by mb order by rate rows between unbounded preceding and 1 preceding) as low from o) where low is null or dist < low""",
    ),
    "st01_mux_union": Entry(
        lambda t: S.mux_union([
            (t("m_packets").where("ftype = 'P'").select("stream_id", "pos", "pts"), C.rescale_ts(F.col("pts"), (1, 90000), (1, 1000))),
            (t("m_packets").where("ftype = 'B'").select("stream_id", "pos", "pts"), C.rescale_ts(F.col("pts"), (1, 48000), (1, 1000))),
        ]),
        "select stream_id, pos, cast((2 * pts * 1000 + case ftype when 'P' then 90000 else 48000 end) // (2 * case ftype when 'P' then 90000 else 48000 end) as bigint) as pts from {m_packets} where ftype in ('P', 'B')",
    ),
    "st02_prefer_primary": Entry(
        lambda t: S.prefer_primary(_redundant(t)).select("stream_id", F.col("pic").cast("long").alias("pic"), "redundant_pic_cnt", "pos"),
        """select stream_id, pic, redundant_pic_cnt, pos from (select *, row_number() over (partition by stream_id, pic order by redundant_pic_cnt, pos) as n
from (select stream_id, i // 3 as pic, bits % 4 as redundant_pic_cnt, i as pos from {m_frame_log})) where n = 1""",
    ),
    "st03_param_set_changes": Entry(
        lambda t: S.param_set_changes(*_deliveries(t)),
        """with a as (select id, body % 50 as body from {m_param_defs} where file % 2 = 0), b as (select id, body % 50 as body from {m_param_defs} where file % 2 = 1)
select *, 'a' as side from (select * from a except all select * from b) union all select *, 'b' as side from (select * from b except all select * from a)""",
    ),
    "st03_changes_in_force": Entry(
        lambda t: S.param_set_changes(*_sets(t), normalise=True).groupBy("side", "poc_type", "log2_max_poc_lsb", "offset_non_ref").agg(F.count("*").alias("n")),
        """with s as (select user_id % 2 as half, event_id % 3 as poc_type, case when event_id % 3 = 0 then event_id % 5 end as log2_max_poc_lsb, case when event_id % 3 = 1 then event_id % 7 end as offset_non_ref from {events}),
d as (select *, 'a' as side from (select poc_type, log2_max_poc_lsb, offset_non_ref from s where half = 0 except all select poc_type, log2_max_poc_lsb, offset_non_ref from s where half = 1)
  union all select *, 'b' from (select poc_type, log2_max_poc_lsb, offset_non_ref from s where half = 1 except all select poc_type, log2_max_poc_lsb, offset_non_ref from s where half = 0))
select side, poc_type, log2_max_poc_lsb, offset_non_ref, count(*) as n from d group by all""",
    ),
    "st03_param_sets_in_common": Entry(
        lambda t: S.param_sets_in_common(*_deliveries(t)),
        "select id, body % 50 as body from {m_param_defs} where file % 2 = 0 intersect select id, body % 50 from {m_param_defs} where file % 2 = 1",
    ),
}
