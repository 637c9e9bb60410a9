"""Queries of sources and sinks: files and lines are made of the tables by Spark, written, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators.joins import session_codecs, ssrc_groups
from ..sources import media, sinks
from .registry import Entry
from .windows import _nal


def new_folder(t) -> str:
    """A new folder in the cluster's shared one (a temporary one only where driver and executors are one process)."""
    sc = t("events").sparkSession.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if root is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{root or tempfile.mkdtemp(prefix='framelake-')}/files-{uuid.uuid4().hex}"


def _read_again(t, df, write, read):
    path = new_folder(t)
    write(df, path)
    return read(df.sparkSession, path)


def _session(t):
    """Sessions of nations: each customer is a section with a payload type and the one that repeats it."""
    s = t("m_streams").select(F.col("file").cast("string").alias("session"), (F.col("stream_index") * 5).alias("at"), "media_type", (96 + F.col("stream_index") % 30 * 2).alias("pt"))
    pt = lambda text: F.format_string(text, "pt")
    codec = F.when(F.col("media_type") == "video", F.lit("H264/90000")).otherwise(F.lit("opus/48000"))
    lines = F.array(
        F.format_string("m=%s 5004 RTP/AVP %d", "media_type", "pt"), F.concat(pt("a=rtpmap:%d "), codec), F.format_string("a=rtpmap:%d rtx/90000", F.col("pt") + 1),
        F.format_string("a=fmtp:%d apt=%d", F.col("pt") + 1, "pt"), pt("a=rtcp-fb:%d nack"),
    )
    body = s.select("session", "at", F.posexplode(lines).alias("k", "line")).select("session", (F.col("at") + F.col("k") + 1).alias("line_no"), "line")
    return body.unionByName(s.select("session", F.lit(0).cast("long").alias("line_no"), F.lit("v=0").alias("line")).distinct())


_SESSION = """s as (select cast(file as varchar) as session, stream_index * 5 as base, media_type, 96 + stream_index % 30 * 2 as pt, row_number() over (partition by file order by stream_index) as section,
  case when media_type = 'video' then 'H264' else 'opus' end as codec, case when media_type = 'video' then 90000 else 48000 end as clock from {m_streams})"""


def _trace(t):
    """A dashed line before every picture, and three lines about it."""
    s = t("m_slices").select(F.col("stream_id").alias("file"), "i", "ftype", "frame_num")
    lines = F.array(F.lit("-----"), F.concat(F.lit("Type: "), "ftype"), F.concat(F.lit("Frame num: "), F.col("frame_num").cast("string")), F.lit("no name"))
    return s.select("file", F.posexplode(lines).alias("k", "line"), "i").select("file", (F.col("i") * 4 + F.col("k")).alias("line_no"), "line")


def _sources(t):
    """Sections with two grouped sources each: the second repeats the first, and both say who they are."""
    s = t("m_streams").select(F.col("file").cast("string").alias("session"), (F.col("stream_index") * 6).alias("at"), (F.col("stream_index") * 2 + 1000).alias("src"))
    lines = F.array(
        F.lit("m=video 9 RTP/AVP 96"), F.format_string("a=ssrc-group:FID %d %d", "src", F.col("src") + 1), F.format_string("a=ssrc:%d cname:c%d", "src", "src"),
        F.format_string("a=ssrc:%d cname:c%d", F.col("src") + 1, "src"), F.format_string("a=ssrc:%d msid:m", F.col("src") + 1),
    )
    return s.select("session", "at", F.posexplode(lines).alias("k", "line")).select("session", (F.col("at") + F.col("k")).alias("line_no"), "line")


def _little_endian(value, digits):
    """Bytes of a whole number, as a hex string of ``digits``, from the lowest on."""
    whole = F.lpad(F.hex(value.bitwiseAND(F.lit((1 << 4 * digits) - 1))), digits, "0")
    return F.concat(*[F.substring(whole, digits - 1 - 2 * k, 2) for k in range(digits // 2)])


def _packed(t, pieces, read):
    """``pieces`` (file, pos, data) written as byte streams, whose parts are files of whole records, and read by ``read``."""
    path = new_folder(t)
    sinks.write_units(pieces, path)
    return read(pieces.sparkSession, f"{path}/*/part-*")


def _frames(t):
    """Luma of 8 x 8 pixels, the frame's number in the 16 bytes of one chroma plane, nothing in the other."""
    luma = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda e: F.lpad(F.hex(e["v"].cast("long")), 2, "0")))
    rows = t("m_pixels").groupBy(F.col("label").cast("string").alias("file"), F.col("frame_no").alias("pos")).agg(luma.alias("h"))
    return rows.select("file", "pos", F.unhex(F.concat("h", F.lpad(F.hex("pos"), 32, "0"), F.lit("00" * 16))).alias("data"))


def _sums(t):
    frames = _packed(t, _frames(t), lambda spark, path: media.read_planar_frames(spark, path, 8, 8))
    named = frames.select("file", "frame_no", F.conv(F.hex("u"), 16, 10).cast("long").alias("number"), "complete")
    lines = media.frame_pixels(frames).groupBy("file", "frame_no").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("x")).alias("by_x"), F.sum(F.col("v") * F.col("y")).alias("by_y"))
    return named.join(lines, ["file", "frame_no"]).select("number", "complete", "total", "by_x", "by_y")


def _samples(t):
    """Four channels of 16 bits: number, index, and the two samples."""
    level = lambda ch: F.sum(F.when(F.col("ch") == ch, F.floor(F.col("s") * 1000)))
    rows = t("m_samples").groupBy("file", "idx").agg(level(0).alias("a"), level(1).alias("b"))
    values = F.concat(*[_little_endian(F.col(c), 4) for c in ("file", "idx", "a", "b")])
    return rows.select((F.col("file") % 7).cast("string").alias("file"), (F.col("file") * 100 + F.col("idx")).alias("pos"), F.unhex(values).alias("data"))


def _dump(t):
    """Packets of a text of their own, of very different length."""
    text = F.concat_ws("/", F.repeat(F.lit("x"), (F.col("seq") % 97).cast("int")), F.col("ssrc").cast("string"), F.col("arrival").cast("string"))
    rows = t("m_rtp").select((F.col("ssrc") % 5).cast("string").alias("file"), (F.col("arrival") * 1000 + F.col("ssrc")).alias("pos"), F.col("tr"), F.encode(text, "UTF-8").alias("p"))
    head = F.concat(_little_endian(F.octet_length("p").cast("long"), 8), _little_endian(F.col("tr"), 8))
    return rows.select("file", "pos", F.concat(F.unhex(head), "p").alias("data"))


def _catalog(t):
    """Bytes by kind of what two writers have written: lines of text, and byte streams whose names have no ending."""
    path = new_folder(t)
    t("m_frame_log").select(F.col("event_id").cast("string").alias("value")).write.text(f"{path}/lines")
    sinks.write_units(t("m_rtp").select((F.col("ssrc") % 3).cast("string").alias("file"), F.col("arrival").alias("pos"), F.encode(F.col("seq").cast("string"), "UTF-8").alias("data")), f"{path}/streams")
    files = media.media_catalog(t("events").sparkSession, path).where(~F.col("path").contains("_SUCCESS"))
    return files.groupBy("kind").agg(F.sum("length").alias("bytes"), (F.min("modified").isNotNull()).alias("dated"))


def _rewritten(t):
    """Units written as byte streams in parts, read in chunks and scanned again."""
    nal = _nal(t).select(
        F.col("file").cast("string").alias("file"), "pos", "nal_type", (F.col("pos") % 2 + 3).alias("start_code_len"), F.lit(0).alias("forbidden"), (F.col("pos") % 4).alias("ref_idc"), F.encode(F.col("pos").cast("string"), "UTF-8").alias("payload")
    )
    path = new_folder(t)
    sinks.write_units(sinks.extract_units(nal, F.lit(True)), path)
    units = media.scan_start_codes(sinks.read_units(t("events").sparkSession, path, 100))
    return units.select(F.col("file").cast("long").alias("file"), "pos", *[F.col(c).cast("long").alias(c) for c in ("start_code_len", "length", "zeros", "ref_idc", "nal_type")])


ENTRIES = {
    "src01_media_catalog": Entry(
        _catalog,
        """select 'text' as kind, cast(sum(length(cast(event_id as varchar)) + 1) as bigint) as bytes, true as dated from {events} having count(*) > 0
union all select '<UNKNOWN>', cast(sum(length(cast(seq as varchar))) as bigint), true from {m_rtp} having count(*) > 0""",
    ),
    "src02_planar_frames": Entry(
        _sums,
        "select frame_no as number, true as complete, cast(sum(v) as bigint) as total, cast(sum(v * x) as bigint) as by_x, cast(sum(v * y) as bigint) as by_y from {m_pixels} group by frame_no",
    ),
    "src03_pcm": Entry(
        lambda t: _packed(t, _samples(t), lambda spark, path: media.read_pcm(spark, path, 4, "s16le")).select(*[F.col("ch")[k].cast("long").alias(c) for k, c in enumerate(("number", "at", "a", "b"))], "complete"),
        """select ((file + 32768) % 65536) - 32768 as number, idx as at, cast(sum(case when ch = 0 then floor(s * 1000) end) as bigint) as a, cast(sum(case when ch = 1 then floor(s * 1000) end) as bigint) as b, true as complete
from {m_samples} group by file, idx""",
    ),
    "src05_rtp_dump": Entry(
        lambda t: _packed(t, _dump(t), lambda spark, path: media.read_rtp_dump(spark, path, 4096)).select(F.col("time").cast("long").alias("time"), F.decode("packet", "UTF-8").alias("said"), "torn"),
        "select tr as time, repeat('x', seq % 97) || '/' || ssrc || '/' || arrival as said, false as torn from {m_rtp}",
    ),
    "src07_zones": Entry(
        lambda t: _read_again(
            t, t("m_zones").select(F.format_string("%d,%d,%s", "start_i", "end_i", F.coalesce(F.concat(F.lit("q="), F.col("qp").cast("string")), F.concat(F.lit("b="), F.col("bitrate_factor").cast("string")))).alias("value")),
            lambda df, path: df.write.text(path), media.read_zones,
        ).drop("zone_id"),
        "select start_i, end_i, qp, case when qp is null then bitrate_factor end as bitrate_factor from {m_zones}",
    ),
    "src07_timecodes": Entry(
        lambda t: _read_again(
            t, t("m_frame_log").select(F.col("stream_id").alias("file"), F.col("i").alias("pos"), F.encode(F.format_string("%.3f\n", F.col("i") * 40 + F.col("stream_id") / 8), "UTF-8").alias("data")),
            sinks.write_units, lambda spark, path: media.timecodes(sinks.read_units(spark, path, media.TEXT_BYTES)),
        ).select(F.col("file").cast("long").alias("stream"), "frame_no", "ms"),
        "select stream_id as stream, i as frame_no, i * 40 + stream_id / 8 as ms from {m_frame_log}",
    ),
    "jn15_ssrc_groups": Entry(
        lambda t: ssrc_groups(media.session_lines(_sources(t))).select("session", "section", "semantics", F.col("n").cast("long").alias("n"), "ssrc", F.array_join("attributes", ",").alias("attributes")),
        """with s as (select cast(file as varchar) as session, row_number() over (partition by file order by stream_index) as section, stream_index * 2 + 1000 as src from {m_streams})
select session, section, 'FID' as semantics, n, cast(src + n as varchar) as ssrc, 'cname:c' || src || case when n = 1 then ',msid:m' else '' end as attributes from s, (select unnest(range(2)) as n)""",
    ),
    "snk04_write_units": Entry(
        _rewritten,
        """with u as (select stream_id as file, i, [1, 5, 6, 7, 8, 9, 1, 1, 14, 1][bits % 10 + 1] as nal_type, i % 2 + 3 as scl, 1 + length(cast(i as varchar)) as length from {m_frame_log})
select file, cast(sum(scl + length) over (partition by file order by i rows unbounded preceding) - length as bigint) as pos, scl as start_code_len, length, 0 as zeros, i % 4 as ref_idc, cast(nal_type as bigint) as nal_type from u""",
    ),
    "src06_session_lines": Entry(
        lambda t: media.session_lines(_session(t)),
        f"""with {_SESSION},
l as (select session, base + 1 as line_no, section, 'm' as key, null as attr, null as pt, media_type || ' 5004 RTP/AVP ' || pt as value from s
  union all select session, base + 2, section, 'a', 'rtpmap', cast(pt as varchar), codec || '/' || clock from s
  union all select session, base + 3, section, 'a', 'rtpmap', cast(pt + 1 as varchar), 'rtx/90000' from s
  union all select session, base + 4, section, 'a', 'fmtp', cast(pt + 1 as varchar), 'apt=' || pt from s
  union all select session, base + 5, section, 'a', 'rtcp-fb', cast(pt as varchar), 'nack' from s)
select * from l union all select distinct session, 0, 0, 'v', null, null, '0' from s""",
    ),
    "jn15_session_codecs": Entry(
        lambda t: session_codecs(media.session_lines(_session(t))).select("session", "section", "pt", "codec", F.col("clock").cast("long").alias("clock"), "params", F.array_join("feedback", ",").alias("feedback"), F.col("apt").cast("long").alias("apt"), "apt_codec"),
        f"""with {_SESSION} select session, section, cast(pt as varchar) as pt, codec, clock, null as params, 'nack' as feedback, null as apt, null as apt_codec from s
union all select session, section, cast(pt + 1 as varchar), 'rtx', 90000, 'apt=' || pt, null, pt, codec from s""",
    ),
    "src07_frame_log": Entry(
        lambda t: _read_again(
            t, t("m_frame_log").select(F.col("event_id").alias("frame_no"), "ftype", (F.col("bits") % 52 + 0.25).alias("qp"), "bits"), lambda df, path: df.write.csv(path, header=True), media.read_frame_log
        ),
        "select event_id as frame_no, ftype, bits % 52 + 0.25::double as qp, bits from {m_frame_log}",
    ),
    "src07_qpfile": Entry(
        lambda t: _read_again(
            t, t("m_frame_log").select(F.format_string("%d %s %d", "event_id", "ftype", F.when(F.col("bits") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("bits") % 52)).alias("value")), lambda df, path: df.write.text(path), media.read_qpfile
        ),
        "select event_id as i, ftype, case when bits % 3 <> 0 then bits % 52 end as qp from {m_frame_log}",
    ),
    "src08_trace_blocks": Entry(
        lambda t: media.trace_blocks(_trace(t), ["Type", "Frame num"]).withColumnRenamed("Frame num", "frame_num"),
        "select stream_id as file, i + 1 as block, ftype as \"Type\", cast(frame_num as varchar) as frame_num from {m_slices}",
    ),
    "snk01_write_by_stream": Entry(
        lambda t: _read_again(
            t, t("m_packets").select(F.lit(1).alias("file"), F.col("stream_id").alias("stream_index"), "pos", "size"),
            lambda df, path: sinks.write_by_stream(df, path, t("m_streams").where("media_type = 'video'").select(F.lit(1).alias("file"), "stream_index").distinct()),
            lambda spark, path: spark.read.schema("file int, pos long, size long, stream_index long").parquet(path).select("stream_index", "pos", "size"),
        ),
        "select stream_id as stream_index, pos, size from {m_packets} where stream_id in (select stream_index from {m_streams} where media_type = 'video')",
    ),
    "snk02_write_display_order": Entry(
        lambda t: _read_again(
            t, t("m_slices").select(F.col("stream_id").alias("file"), "i", F.col("poc_lsb").alias("poc"), (F.col("event_id") % 7 == 0).alias("non_existing")), sinks.write_display_order, lambda spark, path: spark.read.parquet(path)
        ),
        "select stream_id as file, i, poc_lsb as poc from {m_slices} where event_id % 7 <> 0",
    ),
    "snk03_write_timecodes": Entry(
        lambda t: _read_again(
            t, t("m_packets").where("pts is not null").select(F.col("stream_id").alias("file"), "pts"), lambda df, path: sinks.write_timecodes(df, path, (1, 90000)),
            lambda spark, path: spark.read.schema("value string, file long").text(path).select("file", F.col("value").cast("long").alias("ms")),
        ),
        "select stream_id as file, cast((2 * pts * 1000 + 90000) // 180000 as bigint) as ms from {m_packets} where pts is not null",
    ),
}
