"""Streams run to the end over split input must give what their batch twins give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from framelake.operators import windows as W
from framelake.plans.bindings import bind
from framelake.streaming import stateful, windows


def run(spark, tmp_path, df, order, build, name, parts=3, mode="append"):
    """``build`` on a stream of ``df`` split in files along ``order``."""
    path = str(tmp_path / name)
    rows = df.orderBy(order).toPandas()
    n = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows.iloc[k * n : (k + 1) * n], df.schema).coalesce(1).write.mode("append").parquet(path)
    stream = build(windows.ingest(spark, path, df.schema))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture(scope="module")
def few(spark, sf_dir):
    return bind(spark, sf_dir, "m_frame_log").where("stream_id < 12").withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows_equal_batch(spark, tmp_path, few):
    batch = windows.bitrate_windows(few, "1 day")
    got = run(spark, tmp_path, few, "ts", lambda s: windows.bitrate_windows(windows.late_limit(s, "1 hour"), "1 day"), "rates", mode="complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_sessions_equal_batch(spark, tmp_path, few):
    batch = {tuple(r) for r in windows.bursts(few, "6 hours").collect()}
    got = {tuple(r) for r in run(spark, tmp_path, few, "ts", lambda s: windows.bursts(windows.late_limit(s, "1 hour"), "6 hours"), "bursts").collect()}
    assert got and got <= batch  # the last sessions wait for the watermark


def test_dedup_and_late_rows(spark, tmp_path, few):
    twice = few.union(few).select("stream_id", "i", "ts")
    got = run(spark, tmp_path, twice, "ts", lambda s: windows.dedup_stream(s, ["stream_id", "i"], "1 hour"), "once")
    assert got.count() == few.count()


def test_seq_gaps_equal_batch(spark, tmp_path, sf_dir):
    rtp = bind(spark, sf_dir, "m_rtp").where("ssrc < 12")
    got = run(spark, tmp_path, rtp, "arrival", stateful.seq_gap_stream, "gaps")
    want = W.seq_gaps(rtp).select("ssrc", "arrival", "seq", "gap")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_leaky_bucket_levels(spark, tmp_path, few):
    got = run(spark, tmp_path, few, "i", lambda s: stateful.leaky_bucket_stream(s, 20000, 60000), "levels")
    want = {}
    for r in few.orderBy("stream_id", "i").collect():
        level = want.get((r.stream_id, r.i - 1), (0, None))[0]
        full = max(level - 20000, 0) + r.bits
        want[r.stream_id, r.i] = (min(full, 60000), "overflow" if full > 60000 else "underflow" if level < 20000 else None)
    assert {(r.stream_id, r.i): (r.level, r.alert) for r in got.collect()} == want


def test_pair_fields_equal_batch(spark, tmp_path, few):
    fields = few.select("stream_id", "i", F.element_at(F.array(*map(F.lit, "TBFBT")), (F.col("bits") % 5 + 1).cast("int")).alias("structure"))
    got = {tuple(r) for r in run(spark, tmp_path, fields, "i", stateful.pair_fields_stream, "pairs").collect()}
    want = {(r.stream_id, r.i, r.n_pictures, r.structure) for r in W.pair_fields(fields).collect()}
    assert got <= want
    waiting = want - got  # at most the last field of each stream
    assert all(n == 1 for _, _, n, _ in waiting) and len(waiting) <= 12


def test_reorder_equals_display_order(spark, tmp_path, sf_dir):
    slices = W.poc_type0(bind(spark, sf_dir, "m_slices").where("stream_id < 12"), 16).select("stream_id", "i", "gop", "poc", "idr")
    got = run(spark, tmp_path, slices.drop("gop"), "i", lambda s: stateful.reorder_stream(s, 10), "display")
    want = {}
    for r in W.display_order(slices).orderBy("stream_id", "gop", "display").collect():
        want.setdefault(r.stream_id, []).append(r.i)
    out = {}
    for r in got.orderBy("stream_id", "n").collect():
        out.setdefault(r.stream_id, []).append(r.i)
    for s, order in out.items():
        assert order == want[s][: len(order)]


def test_interleave_by_time(spark, tmp_path, few):
    packets = few.select((F.col("stream_id") % 2).alias("file"), "ts", F.col("stream_id").alias("stream_index"), F.col("i").alias("pos"))
    got = run(spark, tmp_path, packets, "ts", lambda s: stateful.interleave_stream(s, "1 second"), "mixed").collect()
    for f in (0, 1):
        times = [r.ts for r in got if r.file == f]
        assert times and times == sorted(times)
    assert len({(r.stream_index, r.pos) for r in got}) == len(got)


def test_av_join(spark, tmp_path, few):
    cols = [(F.col("stream_id") % 3).alias("file"), "ts", F.col("event_id").alias("pos")]
    video, audio = few.where("ftype = 'P'").select(*cols), few.where("ftype = 'B'").select(*cols)
    batch = {(r.file, r.video_pos, r.audio_pos) for r in windows.av_join_stream(video, audio, "2 hours").collect()}
    for name, df in (("v", video), ("a", audio)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    v, a = (windows.ingest(spark, str(tmp_path / n), video.schema) for n in "va")
    q = windows.av_join_stream(v, a, "2 hours").writeStream.format("memory").queryName("av").option("checkpointLocation", str(tmp_path / "av-state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.file, r.video_pos, r.audio_pos) for r in spark.table("av").collect()} == batch


def test_av_join_compares_slots_not_whole_files(spark):
    """Packets meet by more than their file, and the pairs are those of all by all: on borders, before 1970, for no and for odd tolerances."""
    micros = [(k * 1_800_000_000) + d for k in range(-30, 30) for d in (0, 1, 1_799_999_999)]
    rows = [(k % 2, at, k) for k, at in enumerate(micros)] + [(0, None, -1)]
    packets = spark.createDataFrame(rows, "file long, us long, pos long").selectExpr("file", "timestamp_micros(us) as ts", "pos")
    for tolerance, seconds in (("2 hours", 7200), ("30 minutes", 1800), ("0 seconds", 0), ("1 day 1 second", 86401), ("7 milliseconds", 0.007)):
        joined = windows.av_join_stream(packets, packets, tolerance)
        got = sorted((r.file, r.video_pos, r.audio_pos) for r in joined.collect())
        assert got == sorted((a % 2, a, b) for a in range(len(micros)) for b in range(a % 2, len(micros), 2) if abs(micros[a] - micros[b]) <= round(seconds * 1e6))
        assert joined.columns == ["file", "video_ts", "video_pos", "audio_ts", "audio_pos"]
    keys = re.findall(r"Join \[([^\]]*)\]", joined._jdf.queryExecution().sparkPlan().toString())
    assert keys and all(len(k.split(",")) > 1 for k in keys), keys


def test_scan_stream_shares_state_between_files(spark, tmp_path, monkeypatch):
    """Files of a group share a state; units that straddle micro-batches, and files that end in different ones, equal the batch scan."""
    from framelake.sources import media

    monkeypatch.setattr(stateful, "GROUPS", 4, raising=False)
    rnd = random.Random(5)
    rows = []
    for f in range(60):
        data = b"".join(rnd.choice([b"\0", b"\0\0\1", b"\0\0\0\1", b"ab", b"\7"]) for _ in range(rnd.randrange(1, 40)))
        cuts = sorted(rnd.choices(range(len(data) + 1), k=rnd.randrange(5)))
        ends = list(zip([0, *cuts], [*cuts, len(data)]))
        start, many = rnd.randrange(3), len(ends)
        rows += [(f"f{f}", k, a, data[a:b], k == many - 1, min(2, start + k * 3 // many)) for k, (a, b) in enumerate(ends)]
    df = spark.createDataFrame(rows, "file string, chunk_no long, offset long, data binary, last boolean, piece int")
    for k in range(3):
        df.where(F.col("piece") == k).drop("offset", "piece").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stateful.scan_stream(windows.ingest(spark, str(tmp_path / "in"), df.drop("offset", "piece").schema))
    progress = windows.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    held = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert len(held) >= 3 and 0 < max(held) <= 4 and held[-1] == 0, held
    cols = ["file", "pos", "start_code_len", "zeros", "length", "nal_type"]
    want = media.scan_start_codes(df.drop("last", "piece")).select(cols).collect()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).select(cols).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 100


def test_start_code_table_function(spark):
    windows.start_codes(spark)
    df = spark.createDataFrame([(1, b"\0\0\1a\0\0\0\1b"), (2, b"none"), (3, None)], "k long, data binary")
    df.createOrReplaceTempView("pieces")
    got = spark.sql("select k, c.pos, c.start_code_len from pieces, lateral start_codes(data) c").collect()
    assert sorted(map(tuple, got)) == [(1, 3, 3), (1, 8, 4)]
