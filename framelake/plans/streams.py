"""Streams that run to the end over three or more micro-batches, and the batch forms of the event-time operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..streaming import stateful
from ..streaming import windows as S
from .files import new_folder
from .joins import _POC_SQL
from .payloads import SCAN_SQL, _byte_streams
from .registry import Entry
from .windows import PAIRED_SQL, fields

_STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows of a file of a piece, about; a micro-batch takes the files of one piece.
FILE_ROWS = 3_000_000


def _third(df, order):
    """Which third of the values of ``order`` a row lies in."""
    low, high = df.agg(F.coalesce(F.min(order), F.lit(0)), F.coalesce(F.max(order), F.lit(0))).first()
    return F.least(F.lit(2), F.floor((F.col(order) - low) * 3 / (high - low + 1))).cast("int")


def _run(t, sources, build, piece):
    """Result and progress of what ``build`` makes of streams of the tables ``sources``: each is written in three
    pieces by ``piece`` and read piece by piece, so that state crosses at least two borders of micro-batches."""
    spark, folder = t("events").sparkSession, new_folder(t)
    streams = []
    for k, df in enumerate(sources):
        numbered = df.withColumn("__piece", piece(df))
        numbered.write.partitionBy("__piece").parquet(f"{folder}/all{k}")  # what makes the table runs once, not for each piece
        numbered = spark.read.schema(numbered.schema).parquet(f"{folder}/all{k}")
        files = 1 + numbered.count() // (3 * FILE_ROWS)
        for part in range(3):  # one after the other, so that the stream reads them in this order
            numbered.where(F.col("__piece") == part).drop("__piece").repartition(files).write.mode("append").parquet(f"{folder}/in{k}")
        streams.append(S.ingest(spark, f"{folder}/in{k}", df.schema, files_per_trigger=files))
    before = spark.conf.get(_STATE[0], None)
    spark.conf.set(*_STATE)
    try:
        out = build(*streams)
        progress = S.run_to_end(out, f"{folder}/out", f"{folder}/state")
    finally:
        spark.conf.set(_STATE[0], before) if before else spark.conf.unset(_STATE[0])
    if len(progress) < 3:
        raise RuntimeError(f"{len(progress)} micro-batches ran where three or more were meant to")
    return spark.read.schema(out.schema).parquet(f"{folder}/out"), progress


def _streamed(t, sources, order, build):
    return _run(t, sources, build, lambda df: _third(df, order))[0]


def _dropped(t):
    """Rows that a deduplicating stream drops as too late: every seventh event of the first third comes last."""
    log = t("m_frame_log").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    top = log.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0] + 1
    thirds = F.floor(F.col("event_id") * 3 / top).cast("int")
    arrived = F.when((thirds == 0) & (F.col("event_id") % 7 == 0), 2).otherwise(thirds)
    _, progress = _run(t, [log], lambda s: S.dedup_stream(s, ["event_id"], "1 day"), lambda df: arrived)
    return S.dropped_rows(t("events").sparkSession, progress).orderBy("batch").select("batch", "n", "late")


def _ended(t):
    """Chunks of byte streams with the mark of a file's last."""
    chunks = _byte_streams(t)
    return chunks.withColumn("last", F.col("chunk_no") == F.max("chunk_no").over(Window.partitionBy("file"))).select("file", "chunk_no", "data", "last")


def _third_of_file(df):
    """Every file in three pieces: its units straddle the borders of micro-batches."""
    n = F.max("chunk_no").over(Window.partitionBy("file")) + 1
    return F.floor(F.col("chunk_no") * 3 / n).cast("int")


def _packets_by_time(t):
    return t("m_frame_log").select((F.col("stream_id") % 4).alias("file"), F.col("ts").cast("timestamp").alias("ts"), F.col("stream_id").alias("stream_index"), F.col("event_id").alias("pos"))


_BUMP_SQL = f"""with recursive {_POC_SQL},
f as (select stream_id, i, poc, idr, row_number() over (partition by stream_id order by i) as n from poc),
e as (select stream_id, n, [struct_pack(poc := poc, i := i)] as held, list_filter([struct_pack(poc := poc, i := i)], lambda x: false) as sent from f where n = 1 union all
  select stream_id, n, case when len(whole) > 3 then whole[2:] else whole end, flushed || case when len(whole) > 3 then whole[1:1] else whole[1:0] end from (
    select f.stream_id, f.n, case when f.idr = 1 then e.held else e.held[1:0] end as flushed, list_sort(case when f.idr = 1 then e.held[1:0] else e.held end || [struct_pack(poc := f.poc, i := f.i)]) as whole
    from e join f on f.stream_id = e.stream_id and f.n = e.n + 1)),
sent as (select stream_id, n, k, sent[k] as o from e, range(1, 1 + len(sent)) r(k)),"""


def _pairs(t):
    cols = [(F.col("stream_id") % 3).alias("file"), "ts", F.col("event_id").alias("pos")]
    log = t("m_frame_log").withColumn("ts", F.col("ts").cast("timestamp"))
    return log.where("ftype = 'P'").select(*cols), log.where("ftype = 'B'").select(*cols)


_LEVELS = """with recursive e as (select stream_id, i, least(bits, 60000) as level, case when bits > 60000 then 'overflow' else 'underflow' end as alert from {m_frame_log} where i = 0 union all
  select f.stream_id, f.i, least(greatest(e.level - 20000, 0) + f.bits, 60000), case when greatest(e.level - 20000, 0) + f.bits > 60000 then 'overflow' when e.level < 20000 then 'underflow' end
  from e join {m_frame_log} f on f.stream_id = e.stream_id and f.i = e.i + 1)
select stream_id, i, level, alert from e"""

ENTRIES = {
    "sm01_scan_stream": Entry(
        lambda t: _run(t, [_ended(t)], stateful.scan_stream, _third_of_file)[0].select("file", "pos", F.col("start_code_len").cast("long").alias("start_code_len"), "length", "zeros", *[F.col(c).cast("long").alias(c) for c in ("forbidden", "ref_idc", "nal_type")]),
        SCAN_SQL,
    ),
    "sm02_interleave_stream": Entry(
        lambda t: _streamed(t, [_packets_by_time(t)], "pos", lambda s: stateful.interleave_stream(s, "1 day", 21_600_000)),
        """with p as (select user_id % 4 as file, ts, user_id as stream_index, event_id as pos from {events}),
n as (select *, row_number() over (partition by file order by ts, stream_index, pos) - 1 as n from p)
select file, n, ts, stream_index, pos from n where (epoch_ms(ts) // 21600000 + 1) * 21600000 <= (select epoch_ms(max(ts)) - 86400000 from p)""",
    ),
    "sm07_dropped_rows": Entry(
        _dropped,
        """with e as (select event_id, ts, event_id * 3 // (select max(event_id) + 1 from {events}) as third from {events}),
a as (select ts, case when third = 0 and event_id % 7 = 0 then 2 else third end as batch from e),
b as (select batch, count(*) as n, max(ts) as top from a group by batch),
l as (select batch, n, max(top) over (order by batch rows between unbounded preceding and 2 preceding) - interval 1 day as behind from b)
select l.batch, l.n, count(*) filter (a.ts <= l.behind) as late from l join a on l.batch = a.batch group by l.batch, l.n""",
    ),
    "wn06_bump_output": Entry(
        lambda t: W.bump_output(W.poc_type0(t("m_slices"), 16), 3).select("stream_id", "n", "i", "poc"),
        _BUMP_SQL
        + """ rest as (select e.stream_id, e.n + 1 as n, k, held[k] as o from e join (select stream_id, max(n) as n from f group by stream_id) m on e.stream_id = m.stream_id and e.n = m.n, range(1, 1 + len(held)) r(k))
select stream_id, row_number() over (partition by stream_id order by n, k) - 1 as n, o.i as i, cast(o.poc as bigint) as poc from (select * from sent union all select * from rest)""",
    ),
    "sm08_reorder_stream": Entry(
        lambda t: _streamed(t, [W.poc_type0(t("m_slices"), 16).select("stream_id", "i", "poc", "idr")], "i", lambda s: stateful.reorder_stream(s, 3)),
        _BUMP_SQL.rstrip(",") + " select stream_id, row_number() over (partition by stream_id order by n, k) - 1 as n, o.i as i, cast(o.poc as bigint) as poc from sent",
    ),
    "sm10_pair_fields_stream": Entry(lambda t: _streamed(t, [fields(t)], "i", stateful.pair_fields_stream), PAIRED_SQL + " and not (next_s is null and s <> 'F')"),
    "sm03_seq_gap_stream": Entry(
        lambda t: _streamed(t, [t("m_rtp").select("ssrc", "arrival", "seq")], "arrival", stateful.seq_gap_stream),
        "select ssrc, arrival, seq, (seq - lag(seq) over (partition by ssrc order by arrival) + 65536) % 65536 - 1 as gap from {m_rtp}",
    ),
    "sm06_leaky_bucket_stream": Entry(lambda t: _streamed(t, [t("m_frame_log").select("stream_id", "i", "bits")], "i", lambda s: stateful.leaky_bucket_stream(s, 20000, 60000)), _LEVELS),
    "sm06_bucket_levels": Entry(lambda t: W.bucket_levels(t("m_frame_log"), 20000, 60000), _LEVELS),
    "sm09_dedup_stream": Entry(
        lambda t: _streamed(t, [t("m_frame_log").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")], "event_id", lambda s: S.dedup_stream(s, ["event_id"], "1 hour")).select("event_id"),
        "select event_id from {m_frame_log}",
    ),
    "sm11_av_join_stream": Entry(
        lambda t: _streamed(t, _pairs(t), "pos", lambda v, a: S.av_join_stream(v, a, "2 hours", "60 days")).select("file", "video_pos", "audio_pos"),
        """select v.user_id % 3 as file, v.event_id as video_pos, a.event_id as audio_pos from {events} v join {events} a on v.user_id % 3 = a.user_id % 3
and v.event_type = 'click' and a.event_type = 'view' and a.ts between v.ts - interval 2 hours and v.ts + interval 2 hours""",
    ),
    "sm04_bitrate_windows": Entry(
        lambda t: S.bitrate_windows(t("m_frame_log"), "1 day"),
        "select stream_id, cast(date_trunc('day', ts) as timestamp) as start, count(*) as n, cast(sum(bits) as bigint) as bits from {m_frame_log} group by all",
    ),
    "sm04_sliding_over_limit": Entry(
        lambda t: S.over_limit(S.bitrate_windows(t("m_frame_log"), "2 days", "1 day"), 60000),
        """select stream_id, start, count(*) as n, cast(sum(bits) as bigint) as bits from (
select stream_id, bits, cast(date_trunc('day', ts) - to_days(k) as timestamp) as start from {m_frame_log}, (select cast(unnest(range(2)) as integer) as k)) group by stream_id, start having sum(bits) > 60000""",
    ),
    "sm07_late_rows": Entry(
        lambda t: S.late_rows(t("m_frame_log").select("stream_id", (F.col("i") + F.when(F.col("ftype") == "B", 3).otherwise(0)).alias("arrival"), "i", "ts").withColumn("arrival", F.col("arrival") * 10 + F.col("i") % 10), "12 hours"),
        """with a as (select stream_id, ts, (i + case when ftype = 'B' then 3 else 0 end) * 10 + i % 10 as arrival from {m_frame_log}),
l as (select *, max(ts) over (partition by stream_id order by arrival rows between unbounded preceding and 1 preceding) as newest from a)
select stream_id, count(*) as n, count(*) filter (ts < newest - interval 12 hours) as late from l group by stream_id""",
    ),
    "sm05_bursts": Entry(
        lambda t: S.bursts(t("m_frame_log"), "6 hours").withColumn("end", F.col("end")),
        """with g as (select *, case when ts - lag(ts) over (partition by stream_id order by ts, event_id) < interval 6 hour then 0 else 1 end as fresh from {m_frame_log}),
s as (select *, sum(fresh) over (partition by stream_id order by ts, event_id rows unbounded preceding) as k from g)
select stream_id, min(ts) as start, max(ts) as "end", count(*) as n, cast(sum(bits) as bigint) as bits from s group by stream_id, k""",
    ),
}
