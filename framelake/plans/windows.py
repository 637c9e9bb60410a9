"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rate_model
from ..operators import windows as W
from ..operators.joins import slice_group_of
from .joins import _POC_SQL, _RECTS, LEAKY_CTES, _mbs, _rects
from .registry import Entry


def _units(t):
    e = F.col("event_id")
    rows = t("events").select(F.col("user_id").alias("file"), (e * 10 + 4).alias("pos"), F.when(e % 3 == 0, 4).otherwise(3).alias("start_code_len"), (e % 2).alias("zeros"))
    return rows.join(rows.groupBy("file").agg((F.max("pos") + 9).alias("file_size")), "file")


def _nal(t):
    kinds = F.array(*map(F.lit, (1, 5, 6, 7, 8, 9, 1, 1, 14, 1)))
    return t("m_frame_log").select(F.col("stream_id").alias("file"), F.col("i").alias("pos"), F.element_at(kinds, (F.col("bits") % 10 + 1).cast("int")).alias("nal_type"))


_AU_SQL = """with n as (select stream_id as file, i as pos, [1, 5, 6, 7, 8, 9, 1, 1, 14, 1][bits % 10 + 1] as nal_type from {m_frame_log}),
k as (select *, case when nal_type between 1 and 5 then 'v' when nal_type in (6, 7, 8, 9) or nal_type between 13 and 18 then 'o' end as kind from n),
l as (select *, last_value(kind ignore nulls) over (partition by file order by pos rows between unbounded preceding and 1 preceding) as before from k),
a as (select *, cast(1 + sum(case when kind = 'o' and before = 'v' then 1 else 0 end) over (partition by file order by pos rows unbounded preceding) as bigint) as au from l)"""

_LEAKY_SQL = f"with {LEAKY_CTES} select * from leaky"


def _dts(t):
    return t("m_packets").where("pts is not null").select("stream_id", "pos", "pts", (F.col("pos") * 3600 + (F.col("size") % 5 - 2) * 3000).alias("dts"))


def _skipping(t):
    """Slices whose frame numbers jump by two more at every sixth event: their pictures have not come."""
    skipped = F.sum((F.col("event_id") % 6 == 1).cast("long")).over(Window.partitionBy("stream_id", "gop").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return t("m_slices").withColumn("frame_num", (F.col("k") + 2 * skipped) % 8)


_BEFORE = "rows between unbounded preceding and 1 preceding"

def fields(t):
    """Pictures as top or bottom fields or whole frames."""
    kinds = F.array(*map(F.lit, "TBFBT"))
    return t("m_frame_log").select("stream_id", "i", F.element_at(kinds, (F.col("bits") % 5 + 1).cast("int")).alias("structure"))


PAIRED_SQL = """with recursive p as (select stream_id, i, ['T', 'B', 'F', 'B', 'T'][bits % 5 + 1] as s, row_number() over (partition by stream_id order by i) as n from {m_frame_log}),
e as (select stream_id, n, i, s, case when s = 'F' then null else i end as held, case when s = 'F' then null else s end as held_s, case when s = 'F' then 1 else 0 end as alone, false as pairs from p where n = 1 union all
  select p.stream_id, p.n, p.i, p.s, case when p.s = 'F' or (e.held_s is not null and e.held_s <> p.s) then null else p.i end, case when p.s = 'F' or (e.held_s is not null and e.held_s <> p.s) then null else p.s end,
    0, p.s <> 'F' and e.held_s is not null and e.held_s <> p.s from e join p on p.stream_id = e.stream_id and p.n = e.n + 1),
m as (select *, lead(pairs) over (partition by stream_id order by n) as taken, lead(s) over (partition by stream_id order by n) as next_s from e)
select stream_id, i, case when taken then 2 else 1 end as n_pictures, case when taken then s || next_s else s end as structure from m where not pairs"""

ENTRIES = {
    "wn01_unit_lengths": Entry(
        lambda t: W.unit_lengths(_units(t)).select("file", "pos", "length"),
        """with u as (select user_id as file, event_id * 10 + 4 as pos, case when event_id % 3 = 0 then 4 else 3 end as scl, event_id % 2 as zeros from {events}),
s as (select file, max(pos) + 9 as file_size from u group by file)
select u.file, u.pos, coalesce(lead(u.pos - scl) over (partition by u.file order by u.pos), file_size) - u.pos - zeros as length from u join s on u.file = s.file""",
    ),
    "wn02_access_units": Entry(
        lambda t: W.access_units(_nal(t)).select("file", "pos", F.col("nal_type").cast("long").alias("nal_type"), "au", "au_position"),
        _AU_SQL + " select file, pos, cast(nal_type as bigint) as nal_type, au, row_number() over (partition by file, au order by pos) as au_position from a",
    ),
    "wn03_gop_id": Entry(
        lambda t: W.gop_id(t("m_frame_log"), (F.col("ftype") == "IDR") | (F.col("i") == 0)).select("stream_id", "i", "gop"), "select stream_id, i, gop from {m_gop}"
    ),
    "wn04_poc_type0": Entry(
        lambda t: W.poc_type0(t("m_slices"), 16).select("stream_id", "i", "poc"), f"with {_POC_SQL} select stream_id, i, cast(poc as bigint) as poc from poc"
    ),
    "wn05_poc_type1": Entry(
        lambda t: W.poc_type1(t("m_slices"), 8, [2, 4, 3], -1).select("stream_id", "i", "poc"),
        f"""with f as (select *, case when frame_num < coalesce(lag(frame_num) over (partition by stream_id, gop order by i), 0) then 1 else 0 end as fall from {{m_slices}}),
o as (select *, 8 * sum(fall) over (partition by stream_id, gop order by i rows unbounded preceding) + frame_num as a0 from f),
a as (select *, case when is_ref = 0 and a0 > 0 then a0 - 1 else a0 end as a from o)
select stream_id, i, cast(case when a > 0 then (a - 1) // 3 * 9 + [2, 6, 9][cast((a - 1) % 3 + 1 as bigint)] else 0 end + case when is_ref = 0 then -1 else 0 end as bigint) as poc from a""",
    ),
    "wn05_poc_type2": Entry(
        lambda t: W.poc_type2(t("m_slices"), 8).select("stream_id", "i", "poc"),
        f"""with p as (select *, coalesce(last_value(case when is_ref = 1 then frame_num end ignore nulls) over (partition by stream_id, gop order by i {_BEFORE}), 0) as prev from {{m_slices}}),
f as (select *, case when frame_num < prev then 1 else 0 end as fall from p),
o as (select *, 8 * (coalesce(sum(case when is_ref = 1 then fall else 0 end) over (partition by stream_id, gop order by i {_BEFORE}), 0) + fall) + frame_num as a from f)
select stream_id, i, cast(case when idr = 1 then 0 else 2 * a - case when is_ref = 0 then 1 else 0 end end as bigint) as poc from o""",
    ),
    "wn06_display_order": Entry(
        lambda t: W.display_order(W.poc_type0(t("m_slices"), 16)).select("stream_id", "i", "display"),
        f"with {_POC_SQL} select stream_id, i, row_number() over (partition by stream_id, gop order by poc, i) - 1 as display from poc",
    ),
    "wn07_unwrap_rtp_ts": Entry(
        lambda t: W.unwrap_rtp_ts(t("m_rtp")).select("ssrc", "arrival", "ts"),
        """with d as (select *, coalesce(tr - lag(tr) over (partition by ssrc order by arrival), 0) as d from {m_rtp})
select ssrc, arrival, cast(1000 * sum(case when d < -10 then d + 256 else d end) over (partition by ssrc order by arrival rows unbounded preceding) as bigint) as ts from d""",
    ),
    "wn08_seq_gaps": Entry(
        lambda t: W.seq_gaps(t("m_rtp")).select("ssrc", "arrival", "gap"),
        "select ssrc, arrival, (seq - lag(seq) over (partition by ssrc order by arrival) + 65536) % 65536 - 1 as gap from {m_rtp}",
    ),
    "wn09_leaky_bucket": Entry(lambda t: W.leaky_bucket(t("m_frame_log"), W.default_rates(t("m_frame_log"))), _LEAKY_SQL),
    "wn10_buffer_fullness": Entry(
        lambda t: W.buffer_fullness(t("m_frame_log"), 700000, 30).select("stream_id", "i", "fullness", "upper1", "upper2", "lower"),
        """with l as (select stream_id, i, sum(bits) over w - row_number() over w * (700000 / 30.0) as level from {m_frame_log} window w as (partition by stream_id order by i rows unbounded preceding))
select stream_id, i, round(level, 6) as fullness, round(0.8 * 2.56 * 700000 - level, 6) as upper1, round((0.8 * 2.56 * 700000 - level) * 0.9, 6) as upper2, round(700000 / 30.0 - level, 6) as lower from l""",
    ),
    "wn11_complexity_ema": Entry(
        lambda t: W.complexity_ema(t("m_frame_log").where("ftype = 'B'").withColumn("complexity", F.col("bits") / 100)).select("stream_id", "i", F.round("weight", 6).alias("weight")),
        """with recursive b as (select stream_id, i, bits / 100.0 as w, row_number() over (partition by stream_id order by i) as n from {m_frame_log} where ftype = 'B'),
e as (select stream_id, i, n, cast(w as double) as a from b where n = 1 union all
  select b.stream_id, b.i, b.n, case when b.n < 8 then cast(b.w as double) * (b.n - 1) / b.n + e.a / b.n else cast(b.w as double) / 8 + 7 * e.a / 8 end from e join b on b.stream_id = e.stream_id and b.n = e.n + 1)
select stream_id, i, round(a, 6) as weight from e""",
    ),
    "wn12_rolling_rate_model": Entry(
        lambda t: rate_model.rolling_rate_model(
            t("m_frame_log").where("ftype = 'P'").select("stream_id", "i", (F.col("bits") % 40 + 1.0).alias("q"), F.col("bits").cast("double").alias("bits"), (F.col("bits") % 17 + 1.0).alias("mad"))
        )
    ),
    "wn13_frame_num_gaps": Entry(
        lambda t: W.frame_num_gaps(_skipping(t), 8, F.col("pps_id") == 3).select("stream_id", "i", "frame_num", "prev"),
        f"""select stream_id, i, frame_num, prev from (select *, last_value(case when is_ref = 1 then frame_num end ignore nulls) over (partition by stream_id order by i {_BEFORE}) as prev
from (select * replace (cast((k + 2 * sum(case when event_id % 6 = 1 then 1 else 0 end) over (partition by stream_id, gop order by k rows unbounded preceding)) % 8 as bigint) as frame_num)
  from {{m_slices}})) where frame_num <> prev and frame_num <> (prev + 1) % 8 and idr = 0 and pps_id <> 3""",
    ),
    "wn14_pair_fields": Entry(lambda t: W.pair_fields(fields(t)), PAIRED_SQL),
    "wn15_reframe": Entry(
        lambda t: W.reframe(t("m_samples"), 12, ("file", "ch")).select("file", "ch", F.col("frame").cast("long").alias("frame"), F.size("samples").cast("long").alias("n"), F.round(F.element_at("samples", 1), 6).alias("first"), F.round(F.element_at("samples", -1), 6).alias("last")),
        "select file, ch, idx // 12 as frame, count(*) as n, round(arg_min(s, idx), 6) as first, round(arg_max(s, idx), 6) as last from {m_samples} group by file, ch, idx // 12",
    ),
    "wn16_pack_by_bytes": Entry(
        lambda t: W.pack_by_bytes(t("m_packets"), 12000),
        """with recursive p as (select stream_id, pos, size, row_number() over (partition by stream_id order by pos) as n from {m_packets}),
e as (select stream_id, pos, size, n, cast(0 as bigint) as g, size as fill from p where n = 1 union all
  select p.stream_id, p.pos, p.size, p.n, case when e.fill + p.size <= 12000 then e.g else e.g + 1 end, case when e.fill + p.size <= 12000 then e.fill + p.size else p.size end
  from e join p on p.stream_id = e.stream_id and p.n = e.n + 1)
select stream_id, pos, size, g as "group" from e""",
    ),
    "wn17_conceal_by_copy": Entry(
        lambda t: W.conceal_by_copy(t("m_blocks")).select("frame_no", "x", "y", F.col("concealed").cast("long").alias("concealed")),
        "select frame_no, x, y, cast(last_value(case when state > 1 then v end ignore nulls) over (partition by x, y order by frame_no rows unbounded preceding) as bigint) as concealed from {m_blocks}",
    ),
    "wn18_conceal_by_neighbours": Entry(
        lambda t: W.conceal_by_neighbours(_lossy(t), 2),
        """with p as (select frame_no, x, y, v, case when (frame_no * 31 + (y // 2 * 4 + x // 2) * 17) % 10 < 3 then 1 else 3 end as state from {m_pixels}),
l as (select * from p where state = 1),
e as (select l.frame_no, l.x, l.y, e.v, case when e.x = l.x then case when e.y < l.y then 2 - l.y % 2 else l.y % 2 + 1 end else case when e.x < l.x then 2 - l.x % 2 else l.x % 2 + 1 end end as w
  from l join p e on e.frame_no = l.frame_no and e.state = 3 and ((e.x = l.x and (e.y = l.y // 2 * 2 - 1 or e.y = l.y // 2 * 2 + 2)) or (e.y = l.y and (e.x = l.x // 2 * 2 - 1 or e.x = l.x // 2 * 2 + 2))))
select l.frame_no, l.x, l.y, cast(coalesce(sum(e.w * e.v) // sum(e.w), 127) as bigint) as v from l left join e on l.frame_no = e.frame_no and l.x = e.x and l.y = e.y group by l.frame_no, l.x, l.y""",
    ),
    "wn19_dts_violations": Entry(
        lambda t: W.dts_violations(_dts(t)).select("stream_id", "pos", "dts", "prev_dts", "rule"),
        """with d as (select stream_id, pos, pts, pos * 3600 + (size % 5 - 2) * 3000 as dts from {m_packets} where pts is not null),
p as (select *, lag(dts) over (partition by stream_id order by pos) as prev_dts from d)
select stream_id, pos, dts, prev_dts, case when dts <= prev_dts then 'dts' else 'pts' end as rule from p where dts <= prev_dts or pts < dts""",
    ),
    "wn20_linear_resample": Entry(
        lambda t: W.linear_resample(t("m_samples"), 44100, 22050 * 3, ["file", "ch"]).select("file", "ch", "j", "s"),
        """with s as (select *, lead(s) over (partition by file, ch order by idx) as nxt from {m_samples}), n as (select file, ch, count(*) as n from {m_samples} group by file, ch),
g as (select file, ch, unnest(range((n * 66150 + 44099) // 44100)) as j from n)
select g.file, g.ch, g.j, round(s.s + (g.j * (44100 / 66150.0) - s.idx) * (coalesce(nxt, s.s) - s.s), 6) as s from g join s on g.file = s.file and g.ch = s.ch and s.idx = g.j * 44100 // 66150""",
    ),
    "wn21_refresh_age": Entry(
        lambda t: W.refresh_age(t("m_blocks").withColumn("refreshed", (F.col("state") == 1).cast("int")), 6).select("frame_no", "x", "y", "age"),
        """select frame_no, x, y, cast(least(6, row_number() over (partition by x, y, run order by frame_no)) as bigint) as age from
(select *, sum(case when state = 1 then 1 else 0 end) over (partition by x, y order by frame_no rows unbounded preceding) as run from {m_blocks})""",
    ),
    "wn22_next_in_group": Entry(
        lambda t: W.next_in_group(slice_group_of(_mbs(t), _rects(t), 4)).select("frame_no", "mb", "slice_group", "next_mb", "first_mb", "last_mb"),
        f"""with {_RECTS},
g as (select frame_no, y * 8 + x as mb, cast(coalesce((select min(group_id) from rects where x between l and r and y between t and b), 3) as bigint) as slice_group from {{m_blocks}})
select frame_no, mb, slice_group, coalesce(lead(mb) over (partition by frame_no, slice_group order by mb), -1) as next_mb, min(mb) over (partition by frame_no, slice_group) as first_mb,
max(mb) over (partition by frame_no, slice_group) as last_mb from g""",
    ),
}


def _lossy(t):
    state = F.when((F.col("frame_no") * 31 + (F.floor(F.col("y") / 2) * 4 + F.floor(F.col("x") / 2)) * 17) % 10 < 3, 1).otherwise(3)
    return t("m_pixels").select("frame_no", "x", "y", "v", state.alias("state"))
