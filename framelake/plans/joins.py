"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import windows as W
from .registry import Entry


def _uses(t):
    return t("m_frame_log").where("ftype in ('P', 'B')").select(F.col("stream_id").alias("file"), F.col("event_id").alias("pos"), (F.col("event_id") % 4).alias("id"))


def _active(t):
    pps = t("m_param_defs").select("file", "pos", "id", (F.col("body") % 3).alias("sps_id"), "body")
    sps = t("m_frame_log").where("ftype = 'I'").select(F.col("stream_id").alias("file"), F.col("event_id").alias("pos"), (F.col("event_id") % 3).alias("id"), F.col("bits").alias("body"))
    slices = _uses(t).withColumnRenamed("id", "pps_id")
    return J.active_param_set(slices, pps, sps).select("file", "pos", "pps_id", "sps_id", "pps_body", "sps_body")


def _mbs(t):
    return t("m_blocks").withColumn("mb", F.col("y") * 8 + F.col("x"))


def _rects(t):
    rows = [(0, 0, 2, 0, 2), (1, 1, 4, 1, 3), (2, 5, 7, 4, 7)]
    return t("region").sparkSession.createDataFrame(rows, 'group_id long, left long, right long, top long, bottom long')


_RECTS = "rects(group_id, l, r, t, b) as (values (0, 0, 2, 0, 2), (1, 1, 4, 1, 3), (2, 5, 7, 4, 7))"


def _clocked(t, kind):
    rows = t("m_packets").where(F.col("pts").isNotNull() & (F.col("ftype").isin("P", "B") if kind == "video" else F.col("ftype").isin("I", "X")))
    scale = 3 if kind == "video" else 5
    return rows.select(F.col("stream_id").alias("file"), "pos", (F.col("pts") * scale + F.col("size")).alias("ts"), F.lit(kind).alias("kind"))


def _hrd(t):
    decoders = t("m_frame_log").select("stream_id", "i", (F.col("bits") * 2).alias("rate"), (F.col("bits") * 9).alias("buffer"), (F.col("bits") * 7).alias("fullness"))
    found = J.check_hrd(decoders, W.leaky_bucket(t("m_frame_log"), W.default_rates(t("m_frame_log"))))
    return found.select("stream_id", "i", F.round("need_b", 6).alias("need_b"), F.round("need_f", 6).alias("need_f"), "compliant")


LEAKY_CTES = """rates as (select stream_id, cast(floor(avg(bits) * (1 + k / 4.0)) as bigint) as rate from {m_frame_log}, (select unnest(range(4)) as k) group by stream_id, k),
a as (select f.stream_id, r.rate, i as n, bits, sum(bits) over w as c, first_value(bits) over w as b0 from {m_frame_log} f join rates r on f.stream_id = r.stream_id
  window w as (partition by f.stream_id, r.rate order by i rows unbounded preceding)),
b as (select *, max(n * rate - c + bits) over w - (n * rate - c + bits) + bits as need, b0 + n * rate - c + greatest(0, max(c - b0 - n * rate) over w) as y, c - n * rate as low from a
  window w as (partition by stream_id, rate order by n rows unbounded preceding)),
m as (select *, max(need) over (partition by stream_id, rate) as bmax from b),
f as (select *, min(case when need = bmax then n end) over (partition by stream_id, rate) as fi, min(case when y + rate > bmax then n end) over (partition by stream_id, rate) as brk from m),
leaky as (select stream_id, rate, cast(max(bmax) as bigint) as b, cast(greatest(max(b0), max(case when n <= least(fi, coalesce(brk, fi)) then low end)) as bigint) as f from f group by stream_id, rate)"""


def _qpfile(t):
    forced = t("m_frame_log").where("i % 7 = 2").select("stream_id", "i", F.lit("I").alias("ftype"), (F.col("bits") % 70).alias("qp"))
    frames = t("m_frame_log").select("stream_id", "i", "ftype", (F.col("bits") % 40).alias("qp"))
    one = frames.withColumn("i", F.col("stream_id") * 100000 + F.col("i"))
    two = forced.withColumn("i", F.col("stream_id") * 100000 + F.col("i")).drop("stream_id")
    return J.apply_qpfile(one, two, 10, 45).select("stream_id", "i", "ftype", F.col("qp").cast("long").alias("qp"))


def _overlay(t):
    c = t("m_configs")
    layer = lambda n, every: c.where(F.col("run_id") % every == 0).select("run_id", F.lit(n).alias("layer"), F.explode(F.create_map(F.lit("profile"), F.col("profile") + n, F.lit("cabac"), F.when(F.col("cabac") > 0, F.col("cabac") + n))).alias("key", "v"))
    layers = layer(0, 1).unionByName(layer(1, 2)).unionByName(layer(2, 3)).select("run_id", "layer", "key", F.col("v").cast("string").alias("value"))
    return J.overlay_configs(layers, ["profile", "cabac"])


def _implicit(t):
    s = W.poc_type0(t("m_slices"), 16)
    per = ["stream_id", "gop"]
    before, behind = J.reference_lists(s, 2, per)
    return J.implicit_weights(s.where("is_ref = 0").select(*per, "i", "poc"), before, behind, [*per, "i"]).select("stream_id", "i", "idx0", "idx1", "w0", "w1")


def _group_lists(t):
    """Explicit groups: a list names two of three units; and groups of map units whose macroblocks lie in pairs of rows."""
    mbs = _mbs(t).select("frame_no", "mb")
    ids = mbs.where("mb % 3 <> 0").select("frame_no", "mb", (F.col("mb") % 4).alias("slice_group"))
    explicit = J.explicit_group(mbs, ids)
    frames, fields = (J.unit_to_mb_group(explicit, 8, field).withColumnRenamed("slice_group", n) for field, n in ((False, "of_pair"), (True, "of_field")))
    return frames.join(fields, ["frame_no", "mb"]).join(explicit, ["frame_no", "mb"], "left").select("frame_no", "mb", "slice_group", "of_pair", "of_field")


_POC_SQL = """poc as (select *, 16 * (coalesce(sum(case when is_ref = 1 then step else 0 end) over (partition by stream_id, gop order by i rows between unbounded preceding and 1 preceding), 0) + step) + poc_lsb as poc
  from (select *, case when idr = 1 then 0 when prev - poc_lsb >= 8 then 1 when poc_lsb - prev > 8 then -1 else 0 end as step
    from (select *, coalesce(last_value(case when is_ref = 1 then poc_lsb end ignore nulls) over (partition by stream_id, gop order by i rows between unbounded preceding and 1 preceding), 0) as prev from {m_slices})))"""

ENTRIES = {
    "jn01_best_stream": Entry(
        lambda t: J.best_stream(t("m_streams"), [F.when(F.col("media_type") == "video", -F.col("width") * F.col("height")).otherwise(-F.col("channels"))]).select("file", "media_type", "stream_index"),
        """select file, media_type, stream_index from (select *, row_number() over (partition by file, media_type
order by case when media_type = 'video' then -width * height else -channels end, stream_index) as n from {m_streams}) where n = 1""",
    ),
    "jn02_active_param_set": Entry(
        _active,
        """with pps as (select file, pos, id, body % 3 as sps_id, body from {m_param_defs}),
sps as (select stream_id as file, event_id as pos, event_id % 3 as id, bits as body from {m_frame_log} where ftype = 'I'),
s as (select u.stream_id as file, u.event_id as pos, u.event_id % 4 as pps_id, p.sps_id, p.body as pps_body
  from {m_frame_log} u asof left join pps p on u.stream_id = p.file and u.event_id % 4 = p.id and u.event_id >= p.pos where u.ftype in ('P', 'B'))
select s.file, s.pos, s.pps_id, s.sps_id, s.pps_body, q.body as sps_body
from s asof left join sps q on s.file = q.file and s.sps_id = q.id and s.pos >= q.pos""",
    ),
    "jn03_mark_segments": Entry(
        lambda t: J.mark_segments(_mbs(t), t("m_segments")).select("frame_no", "mb", "bad"),
        "select b.frame_no, y * 8 + x as mb, s.bad from {m_blocks} b left join {m_segments} s on b.frame_no = s.frame_no and y * 8 + x between start_mb and end_mb",
    ),
    "jn04_apply_zones": Entry(
        lambda t: J.apply_zones(t("m_frame_log"), t("m_zones")).select("stream_id", "i", "zone_id", "qp", "bitrate_factor"),
        """with z as (select k.i, z.*, row_number() over (partition by k.i order by zone_id) as n from (select distinct i from {m_frame_log}) k join {m_zones} z on k.i between start_i and end_i)
select f.stream_id, f.i, z.zone_id, coalesce(z.qp, 26) as qp, coalesce(z.bitrate_factor, 1.0) as bitrate_factor from {m_frame_log} f left join z on f.i = z.i and z.n = 1""",
    ),
    "jn05_explicit_groups": Entry(
        _group_lists,
        """with e as (select frame_no, x, y, case when (y * 8 + x) % 3 <> 0 then (y * 8 + x) % 4 else 0 end as g from {m_blocks}),
p as (select frame_no, (2 * y + k) * 8 + x as mb, g from e, (select unnest(range(2)) as k))
select p.frame_no, p.mb, o.g as slice_group, p.g as of_pair, p.g as of_field from p left join e o on o.frame_no = p.frame_no and o.y * 8 + o.x = p.mb""",
    ),
    "jn05_slice_groups": Entry(
        lambda t: J.slice_group_of(_mbs(t), _rects(t), 4).select(
            "frame_no", "mb", "slice_group", J.dispersed_group(F.col("mb"), 8, 3).cast("long").alias("dispersed"), J.interleaved_group(F.col("mb"), [5, 3, 4]).alias("interleaved"),
            J.raster_group(F.col("mb"), 20, False).alias("raster"), J.wipe_group(F.col("mb"), 8, 8, 20, True).alias("wipe"),
        ),
        f"""with {_RECTS} select frame_no, y * 8 + x as mb,
cast(coalesce((select min(group_id) from rects where x between l and r and y between t and b), 3) as bigint) as slice_group,
cast((x + y * 3 // 2) % 3 as bigint) as dispersed, cast(case when (y * 8 + x) % 12 < 5 then 0 when (y * 8 + x) % 12 < 8 then 1 else 2 end as bigint) as interleaved,
cast(case when y * 8 + x < 20 then 0 else 1 end as bigint) as raster, cast(case when x * 8 + y < 20 then 1 else 0 end as bigint) as wipe from {{m_blocks}}""",
    ),
    "jn06_mux_interleave": Entry(
        lambda t: J.mux_interleave(_clocked(t, "video"), _clocked(t, "audio"), "file", "pos", "ts").select("file", "n", F.col("kind").cast("long").alias("kind"), "pos", "ts"),
        """with p as (select stream_id as file, pos, case when ftype in ('P', 'B') then 0 else 1 end as kind, pts * case when ftype in ('P', 'B') then 3 else 5 end + size as ts
  from {m_packets} where pts is not null and ftype in ('P', 'B', 'I', 'X')),
k as (select file, kind, pos, ts, 0 as fin, greatest(0, coalesce(max(ts) over (partition by file, kind order by pos rows between unbounded preceding and 1 preceding), 0)) as key from p
  union all select file, kind, max(pos) + 1, null, 1, greatest(0, max(ts)) from p group by file, kind),
o as (select *, max(fin) over (partition by file order by key, kind, pos rows unbounded preceding) as stop from k)
select file, row_number() over (partition by file order by key, kind, pos) - 1 as n, cast(kind as bigint) as kind, pos, ts from o where stop = 0""",
    ),
    "jn07_align_frames": Entry(
        lambda t: J.align_frames(t("m_pixels").select("frame_no", "x", "y", "v", (F.col("frame_no") * 2).alias("poc")), t("m_pixels").select("frame_no", "x", "y", "v"), 1, 2).where("x = ref_x and y = ref_y").groupBy("frame_no", "ref_frame_no").agg(
            F.sum(F.abs(F.col("v") - F.col("ref_v"))).cast("long").alias("sad")
        ),
        "select a.frame_no, b.frame_no as ref_frame_no, cast(sum(abs(a.v - b.v)) as bigint) as sad from {m_pixels} a join {m_pixels} b on a.frame_no + 1 = b.frame_no and a.x = b.x and a.y = b.y group by a.frame_no, b.frame_no",
    ),
    "jn08_apply_qpfile": Entry(
        _qpfile,
        """select stream_id, stream_id * 100000 + i as i, case when i % 7 = 2 then 'I' else ftype end as ftype,
greatest(10, least(45, case when i % 7 = 2 then bits % 70 else bits % 40 end)) as qp from {m_frame_log}""",
    ),
    "jn09_check_hrd": Entry(
        _hrd,
        f"""with {LEAKY_CTES},
s as (select *, lead(rate) over w as r1, lead(b) over w as b1, lead(f) over w as f1 from leaky window w as (partition by stream_id order by rate)),
d as (select d.stream_id, d.i, d.bits, s.b + coalesce((d.bits * 2 - s.rate) / (r1 - s.rate), 0.0) * (coalesce(b1, s.b) - s.b) as nb,
  s.f + coalesce((d.bits * 2 - s.rate) / (r1 - s.rate), 0.0) * (coalesce(f1, s.f) - s.f) as nf
  from {{m_frame_log}} d left join s on d.stream_id = s.stream_id and d.bits * 2 >= s.rate and (r1 is null or d.bits * 2 < r1))
select stream_id, i, round(cast(nb as double), 6) as need_b, round(cast(nf as double), 6) as need_f, bits * 9 > nb and bits * 7 > nf as compliant from d""",
    ),
    "jn10_dangling_refs": Entry(
        lambda t: J.dangling_refs(_uses(t), t("m_param_defs")).select("file", "pos", "id"),
        """select stream_id as file, event_id as pos, event_id % 4 as id from {m_frame_log} u where ftype in ('P', 'B') and not exists
(select 1 from {m_param_defs} d where valid = 1 and d.file = u.stream_id and d.id = u.event_id % 4 and d.pos <= u.event_id)""",
    ),
    "jn11_selected_packets": Entry(
        lambda t: J.selected_packets(t("m_packets"), t("m_streams").where("media_type = 'video'").select(F.col("stream_index").alias("stream_id")), ["stream_id"]).select("stream_id", "pos", "size"),
        "select stream_id, pos, size from {m_packets} where stream_id in (select stream_index from {m_streams} where media_type = 'video')",
    ),
    "jn12_missing_units": Entry(
        lambda t: J.missing_units(_mbs(t).where("state = 3"), t("m_blocks"), 70).select("frame_no", "mb"),
        """select frame_no, mb from (select distinct frame_no from {m_blocks}), (select unnest(range(70)) as mb)
where (frame_no, mb) not in (select (frame_no, y * 8 + x) from {m_blocks} where state = 3)""",
    ),
    "jn13_neighbour_states": Entry(
        lambda t: J.neighbour_states(t("m_blocks")).select("frame_no", "x", "y", "n_neighbours", "n_usable"),
        """select a.frame_no, a.x, a.y, count(*) as n_neighbours, count(*) filter (b.state >= 2) as n_usable from {m_blocks} a
join {m_blocks} b on a.frame_no = b.frame_no and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and not (a.x = b.x and a.y = b.y) group by a.frame_no, a.x, a.y""",
    ),
    "jn14_block_match": Entry(
        lambda t: J.block_match(
            t("m_pixels").select("frame_no", "x", "y", "v"), t("m_pixels").select((F.col("frame_no") + 1).alias("frame_no"), "x", "y", "v"), 2, ["frame_no"]
        ).select("frame_no", F.col("block_x").cast("long").alias("block_x"), F.col("block_y").cast("long").alias("block_y"), "dx", "dy", "sad"),
        """with m as (select dx, dy, (dy + 2) * 5 + dx + 2 as k from (select unnest(range(-2, 3)) as dx), (select unnest(range(-2, 3)) as dy)),
s as (select a.frame_no, a.x // 4 as block_x, a.y // 4 as block_y, dx, dy, k, sum(abs(a.v - b.v)) as sad, count(*) as n from {m_pixels} a, m, {m_pixels} b
  where b.frame_no = a.frame_no - 1 and b.x = a.x + dx and b.y = a.y + dy group by all)
select frame_no, block_x, block_y, cast(dx as bigint) as dx, cast(dy as bigint) as dy, cast(sad as bigint) as sad
from (select *, row_number() over (partition by frame_no, block_x, block_y order by sad, k) as r from s where n = 16) where r = 1""",
    ),
    "jn16_implicit_weights": Entry(
        _implicit,
        f"""with {_POC_SQL},
r as (select *, row_number() over (partition by stream_id, gop order by k) as n from poc where is_ref = 1),
u as (select *, coalesce((select count(*) from r where r.stream_id = poc.stream_id and r.gop = poc.gop and r.k < poc.k), 0) as c from poc where is_ref = 0),
p as (select c.stream_id, c.i, a.k as idx0, b.k as idx1, b.poc - a.poc as pt, c.poc - a.poc as p0 from u c
  join r a on a.stream_id = c.stream_id and a.gop = c.gop and a.n in (c.c, c.c - 1)
  join r b on b.stream_id = c.stream_id and b.gop = c.gop and b.n in (c.c + 1, c.c + 2)),
w as (select *, greatest(-1024, least(1023, cast(floor((case when pt = 0 then 0 else trunc((16384 + floor(pt / 2.0)) / pt) end * p0 + 32) / 64.0) as bigint))) as z from p),
v as (select *, cast(floor(z / 4.0) as bigint) as w1x from w)
select stream_id, i, idx0, idx1, case when pt <> 0 and w1x between -64 and 128 then 64 - w1x else 32 end as w0,
case when pt <> 0 and w1x between -64 and 128 then w1x else 32 end as w1 from v""",
    ),
    "jn17_av_align": Entry(
        lambda t: J.av_align(_clocked(t, "video"), _clocked(t, "audio"), 60000).select("file", "pos", "ts", "audio_ts", "drift"),
        """with p as (select stream_id as file, pos, case when ftype in ('P', 'B') then 0 else 1 end as kind, pts * case when ftype in ('P', 'B') then 3 else 5 end + size as ts
  from {m_packets} where pts is not null and ftype in ('P', 'B', 'I', 'X')),
j as (select v.file, v.pos, v.ts, max(a.ts) as a from p v left join p a on a.kind = 1 and a.file = v.file and a.ts <= v.ts where v.kind = 0 group by all)
select file, pos, ts, case when ts - a <= 60000 then a end as audio_ts, case when ts - a <= 60000 then ts - a end as drift from j""",
    ),
    "jn18_overlay_configs": Entry(
        _overlay,
        """with l as (select run_id, 0 as layer, profile, cabac from {m_configs} union all select run_id, 1, profile + 1, case when cabac > 0 then cabac + 1 end from {m_configs} where run_id % 2 = 0
  union all select run_id, 2, profile + 2, case when cabac > 0 then cabac + 2 end from {m_configs} where run_id % 3 = 0)
select run_id, cast(max_by(profile, layer) as varchar) as profile, cast(max_by(case when cabac > 0 then cabac end, layer) filter (cabac > 0) as varchar) as cabac from l group by run_id""",
    ),
}
