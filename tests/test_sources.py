import random
import struct

import pytest
from pyspark.sql import functions as F

from framelake.operators.projections import zero_byte_warnings
from framelake.operators.joins import session_codecs, ssrc_groups
from framelake.operators.windows import access_units
from framelake.sources import media, sinks

R = random.Random(3)


def test_media_catalog(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.mp4", "b.wav", "c.h264", "sub/d.zzz", "e.txt"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.length) for r in media.media_catalog(spark, str(tmp_path)).collect()}
    assert got == {"a.mp4": ("video", 5), "b.wav": ("audio", 5), "c.h264": ("video", 6), "d.zzz": ("<UNKNOWN>", 9), "e.txt": ("text", 5)}


def test_planar_frames_and_pixels(spark, tmp_path):
    w, h, n = 4, 2, 3
    size = w * h * 3 // 2
    data = bytes(R.randrange(256) for _ in range(n * size)) + b"xyz"
    (tmp_path / "a.yuv").write_bytes(data)
    rows = media.read_planar_frames(spark, str(tmp_path / "a.yuv"), w, h)
    got = {r.frame_no: (bytes(r.y), bytes(r.u), bytes(r.v), r.complete) for r in rows.collect()}
    for k in range(n):
        f = data[k * size : (k + 1) * size]
        assert got[k] == (f[:8], f[8:10], f[10:12], True)
    assert got[n][3] is False and len(got) == n + 1
    px = {(r.frame_no, r.x, r.y): r.v for r in media.frame_pixels(rows.where("complete")).collect()}
    assert all(px[k, x, y] == data[k * size + y * w + x] for k in range(n) for x in range(w) for y in range(h))


@pytest.mark.parametrize("fmt,letter", [("s16le", "<h"), ("f32be", ">f"), ("u8", "B")])
def test_pcm(spark, tmp_path, fmt, letter):
    values = [R.randrange(0, 200) for _ in range(9)]
    (tmp_path / "a.pcm").write_bytes(b"".join(struct.pack(letter, v) for v in values))
    got = [(r.idx, r.ch, r.complete) for r in media.read_pcm(spark, str(tmp_path / "a.pcm"), 2, fmt).orderBy("idx").collect()]
    assert got == [(k, [float(v) for v in values[2 * k : 2 * k + 2]], 2 * k + 2 <= 9) for k in range(5)]


def test_large_files_are_split(spark, tmp_path):
    data = bytes(R.randrange(256) for _ in range(1000))
    (tmp_path / "big.bin").write_bytes(data)
    (tmp_path / "tail.bin").write_bytes(data + b"xyz")
    rows = media._records(spark, str(tmp_path), 10, split_above=100, split_bytes=70)
    assert rows.rdd.getNumPartitions() >= 2 * 15  # whatever the length, no task reads more than seven records
    got = {(r.file[-8:], r.record): bytes(r.data) for r in rows.collect()}
    want = {(f, k): data[10 * k : 10 * k + 10] for f in ("/big.bin", "tail.bin") for k in range(100)}
    assert got == want | {("tail.bin", 100): b"xyz"}


def loop_units(data):
    """Start codes one by one: (pos, code length, length, zeros)."""
    codes, at = [], data.find(b"\0\0\1")
    while at >= 0:
        codes.append((at + 3, 4 if at > 0 and data[at - 1] == 0 else 3))
        at = data.find(b"\0\0\1", at + 1)
    out = []
    for k, (pos, n) in enumerate(codes):
        end = codes[k + 1][0] - codes[k + 1][1] if k + 1 < len(codes) else len(data)
        body = data[pos:end].rstrip(b"\0")
        out.append((pos, n, len(body), end - pos - len(body)))
    return out


@pytest.mark.parametrize("chunk", [1, 2, 7, 16, 4096])
def test_scan_start_codes(spark, tmp_path, chunk):
    for f in range(3):
        data = b"\0" * R.randrange(3)
        for _ in range(12):
            data += R.choice([b"\0\0\1", b"\0\0\0\1"]) + bytes([R.choice([0x65, 0x41, 0x67, 0x09])]) + bytes(R.choice([1, 3, 200, 0, 7]) for _ in range(R.randrange(12))).replace(b"\0\0", b"\0\5") + b"\x80" + b"\0" * R.choice([0, 0, 1, 5, 20])
        (tmp_path / f"{chunk}-{f}.h264").write_bytes(data)
    units = media.scan_start_codes(media.read_chunks(spark, str(tmp_path), chunk))
    got = {}
    for r in units.orderBy("file", "pos").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.pos, r.start_code_len, r.length, r.zeros))
    for f in range(3):
        name = f"{chunk}-{f}.h264"
        assert got[name] == loop_units((tmp_path / name).read_bytes())


def test_scan_shuffles_no_payload(spark):
    chunks = spark.createDataFrame([("a", 0, 0, b"\0\0\1x")], "file string, chunk_no long, offset long, data binary")
    plan = media.scan_start_codes(chunks)._jdf.queryExecution().executedPlan().toString()
    exchanged = plan[: plan.index("MapInArrow")]
    assert "Exchange" in exchanged and "data#" not in exchanged and "Exchange" not in plan[plan.index("MapInArrow") :]


def test_rtp_dump(spark, tmp_path):
    packets = [bytes(R.randrange(256) for _ in range(R.randrange(12, 30))) for _ in range(5)]
    data = b"".join(struct.pack("<Ii", len(p), k * 40) + p for k, p in enumerate(packets))
    (tmp_path / "whole.rtp").write_bytes(data)
    (tmp_path / "torn.rtp").write_bytes(data[:-3])
    rows = media.read_rtp_dump(spark, str(tmp_path)).collect()
    whole = sorted((r.n, r.time, bytes(r.packet), r.torn) for r in rows if r.file.endswith("whole.rtp"))
    assert whole == [(k, k * 40, p, False) for k, p in enumerate(packets)]
    assert [r.torn for r in sorted((r for r in rows if r.file.endswith("torn.rtp")), key=lambda r: r.n)] == [False] * 4 + [True]


def loop_dump(data):
    at, out = 0, []
    while at < len(data):
        if at + 8 > len(data):
            return [*out, (len(out), None, data[at:], True)]
        size, time = struct.unpack_from("<Ii", data, at)
        torn = size > 65508 or at + 8 + size > len(data)
        out.append((len(out), time, data[at + 8 : at + 8 + min(size, 65516)], torn))
        if torn:
            break
        at += 8 + size
    return out


@pytest.mark.parametrize("ranged", [1, 13, 100, 997, 1 << 20])
def test_rtp_dump_in_ranges(spark, tmp_path, ranged):
    """Files cut in ranges equal a loop from the start: packets longer than a range, zeros that look like records,
    torn tails, a length that cannot be, an empty file."""
    def dump(packets):
        return b"".join(struct.pack("<Ii", len(p), k * 40) + p for k, p in enumerate(packets))

    packets = [R.choice([bytes(R.randrange(60)), R.randbytes(R.randrange(90)), struct.pack("<Ii", 4, 1) * 5, b""]) for _ in range(40)]
    data = dump(packets)
    files = {"whole": data, "torn": data[:-3], "head": data + b"\1\0\0", "bad": data + struct.pack("<Ii", 1 << 31, 7) + data, "none": b"", "zeros": bytes(2000), "long": dump([R.randbytes(3000), b"x"])}
    if ranged == 1:
        files = {k: v[:400] for k, v in files.items()}
    for name, content in files.items():
        (tmp_path / f"{name}.rtp").write_bytes(content)
    got = {}
    for r in media.read_rtp_dump(spark, str(tmp_path), ranged, split_above=R.choice([0, 1 << 30])).collect():
        got.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append((r.n, r.time, bytes(r.packet), r.torn))
    for name, content in files.items():
        assert sorted(got.get(name, [])) == loop_dump(content), name


def test_what_is_read_at_once_is_bounded(spark, tmp_path):
    """Short records with a long overlap come in batches of few bytes, and a file of some size is not one row."""
    from framelake.sources import records

    (tmp_path / "100%25.bin").write_bytes(bytes(20 << 20))
    reader = records.RecordSource({"path": str(tmp_path), "record_size": "4096", "overlap": "65516"}).reader(None)
    assert max(b.nbytes for p in reader.partitions()[:1] for _, b in zip(range(3), reader.read(p))) < 9 << 20
    rows = media._records(spark, str(tmp_path / "*.bin"), 1 << 20)
    assert (rows.count(), rows.select("file").distinct().count()) == (20, 1)
    assert "BatchScan fixed_records" in rows._jdf.queryExecution().sparkPlan().toString()


def test_rtp_dump_of_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "BLOCK_BYTES", 5000)
    data = b"".join(struct.pack("<Ii", len(p), 7) + p for p in (R.choice([bytes(R.randrange(300)), R.randbytes(R.randrange(9000))]) for _ in range(60)))
    files = {"whole": data, "torn": data[:-1], "bad": data + struct.pack("<Ii", 1 << 31, 7) + data}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {}
    for r in media.read_rtp_dump(spark, str(tmp_path), 700).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.n, r.time, bytes(r.packet), r.torn))
    assert {name: sorted(rows) for name, rows in got.items()} == {name: loop_dump(content) for name, content in files.items()}


SESSION = """v=0
s=-
a=group:BUNDLE 0 1
m=audio 9 UDP/TLS/RTP/SAVPF 111
a=rtpmap:111 opus/48000/2
a=rtcp-fb:111 transport-cc
a=fmtp:111 minptime=10;useinbandfec=1
m=video 9 UDP/TLS/RTP/SAVPF 96 97
a=rtpmap:96 VP8/90000
a=rtcp-fb:96 nack
a=rtcp-fb:96 nack pli
a=rtpmap:97 rtx/90000
a=fmtp:97 apt=96
a=ssrc-group:FID 1001 1002
a=ssrc:1001 cname:abc
a=ssrc:1002 cname:abc
"""


def test_sessions(spark, tmp_path):
    (tmp_path / "one.sdp").write_text(SESSION)
    attrs = media.read_session_lines(spark, str(tmp_path / "one.sdp"))
    codecs = {r.pt: r for r in session_codecs(attrs).collect()}
    assert (codecs["111"].codec, codecs["111"].clock, codecs["111"].section) == ("opus", 48000, 1)
    assert codecs["96"].feedback == ["nack", "nack pli"] and codecs["96"].apt is None
    assert (codecs["97"].apt, codecs["97"].apt_codec) == (96, "VP8")
    assert sorted((r.semantics, r.ssrc, r.attributes) for r in ssrc_groups(attrs).collect()) == [("FID", "1001", ["cname:abc"]), ("FID", "1002", ["cname:abc"])]


def test_text_logs(spark, tmp_path):
    (tmp_path / "q.txt").write_text("0 I 10\n3 P\n5 b -1\n\n")
    assert [tuple(r) for r in media.read_qpfile(spark, str(tmp_path / "q.txt")).orderBy("i").collect()] == [(0, "I", 10), (3, "P", None), (5, "b", None)]
    (tmp_path / "z.txt").write_text("0,9,q=20/10,19,b=1.5")
    assert [tuple(r) for r in media.read_zones(spark, str(tmp_path / "z.txt")).orderBy("zone_id").collect()] == [(0, 0, 9, 20, None), (1, 10, 19, None, 1.5)]
    (tmp_path / "t.txt").write_text("# timecode format v2\n0\n33.4\n66.7\n")
    assert [(r.frame_no, r.ms) for r in media.read_timecodes(spark, str(tmp_path / "t.txt")).orderBy("frame_no").collect()] == [(0, 0.0), (1, 33.4), (2, 66.7)]
    (tmp_path / "f.csv").write_text("frame,type,qp,bits\n0,I,20.5,900\n")
    assert tuple(media.read_frame_log(spark, str(tmp_path / "f.csv")).first()) == (0, "I", 20.5, 900)
    (tmp_path / "tr.txt").write_text("-----\nslice_type: 2\nframe_num : 7\n-----\nslice_type: 0\n-----\n")
    rows = media.read_trace_blocks(spark, str(tmp_path / "tr.txt"), ["slice_type", "frame_num"]).orderBy("block").collect()
    assert [(r.slice_type, r.frame_num) for r in rows] == [("2", "7"), ("0", None)]
    lines = spark.createDataFrame([(1, 0, 'InputFile = "a b.yuv" # name'), (1, 1, "QPISlice=28"), (1, 1, "# none")], "run_id long, layer long, line string")
    assert sorted(tuple(r) for r in media.config_lines(lines).collect()) == [(1, 0, "InputFile", "a b.yuv"), (1, 1, "QPISlice", "28")]


def test_sinks(spark, tmp_path):
    packets = spark.createDataFrame([(1, s, p, p * 9000) for s in (0, 1, 2) for p in range(4)], "file long, stream_index long, pos long, pts long")
    chosen = spark.createDataFrame([(1, 0), (1, 2)], "file long, stream_index long")
    sinks.write_by_stream(packets, str(tmp_path / "s"), chosen)
    assert {r.stream_index: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("stream_index").count().collect()} == {0: 4, 2: 4}
    frames = spark.createDataFrame([(1, p, p == 6) for p in (4, 0, 2, 6)], "file long, poc long, non_existing boolean")
    sinks.write_display_order(frames, str(tmp_path / "d"))
    assert sorted(r.poc for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [0, 2, 4]
    sinks.write_timecodes(packets.where("stream_index = 0"), str(tmp_path / "t"), (1, 90000))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["0", "100", "200", "300"]
    nal = spark.createDataFrame([(1, 4, 3, 0, 3, 5, b"ab"), (1, 9, 4, 0, 2, 1, b"cd"), (1, 20, 3, 0, 3, 7, b"e")], "file string, pos long, start_code_len int, forbidden int, ref_idc int, nal_type int, payload binary")
    units = sinks.extract_units(nal, F.col("nal_type") < 6)
    assert bytes(sinks.stream_pieces(units).first().data) == b"\0\0\1\x65ab" + b"\0\0\0\1\x41cd"
    assert bytes(sinks.extract_units(nal, F.col("nal_type") == 7, single=True).first().data) == b"\0\0\0\1\x67e"


@pytest.mark.parametrize(("part_bytes", "chunk"), [(1, 5), (40, 64), (1 << 20, 4096)])
def test_byte_streams_are_written_in_parts(spark, tmp_path, part_bytes, chunk):
    rows = [(f"a/{f} b", p * 100, R.choice([3, 4]), 0, R.randrange(4), R.choice([1, 5, 7]), b"\x80" + bytes(R.choice([3, 9, 200]) for _ in range(R.randrange(40)))) for f in range(3) for p in range(30)]
    nal = spark.createDataFrame(rows, "file string, pos long, start_code_len int, forbidden int, ref_idc int, nal_type int, payload binary").repartition(5)
    path = str(tmp_path / "streams")
    for _ in range(2):  # what is written again replaces what was there
        sinks.write_units(sinks.extract_units(nal, F.lit(True)), path, part_bytes=part_bytes)
    for f in range(3):
        want = b"".join((b"\0\0\1" if r[2] == 3 else b"\0\0\0\1") + bytes([r[4] << 5 | r[5]]) + r[6] for r in rows if r[0] == f"a/{f} b")
        parts = sorted((tmp_path / "streams" / f"a%2F{f}%20b").iterdir())
        assert b"".join(p.read_bytes() for p in parts if not p.name.startswith(".")) == want and (part_bytes > 1 or len(parts) == 30)
    assert not list((tmp_path / "streams" / "_temporary").iterdir())
    units = media.scan_start_codes(sinks.read_units(spark, path, chunk))
    got = {}
    for r in units.orderBy("file", "pos").collect():
        got.setdefault(r.file, []).append((r.start_code_len, r.length, r.zeros, r.ref_idc, r.nal_type))
    assert got == {f"a/{f} b": [(r[2], len(r[6]) + 1, 0, r[4], r[5]) for r in rows if r[0] == f"a/{f} b"] for f in range(3)}


def test_many_short_streams_are_read_together(spark, tmp_path):
    """A stream is a folder: short ones share tasks, and a long one beside them is still cut."""
    from framelake.sources import byte_streams

    want = {f"s{k}": b"%d" % k * (k % 9) for k in range(400)} | {"long": R.randbytes(60 << 10)}
    units = spark.createDataFrame([(f, p, d[p : p + 5000]) for f, d in want.items() for p in range(0, max(1, len(d)), 5000)], "file string, pos long, data binary")
    path = str(tmp_path / "streams")
    sinks.write_units(units, path)
    rows = sinks.read_units(spark, path, 7)
    assert rows.rdd.getNumPartitions() <= 10
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file, r.chunk_no)):
        assert r.offset == 7 * r.chunk_no == len(got.get(r.file, b""))
        got[r.file] = got.get(r.file, b"") + bytes(r.data)
    assert got == {f: d for f, d in want.items() if d}
    reader = byte_streams.ByteStreamReader(path, 1024, 20 << 10)
    assert len([p for p in reader.partitions() if any(s.file == "long" for s in p.stretches)]) == 3
    reader = byte_streams.ByteStreamReader(path, 7, 1 << 30)
    assert max(b.num_rows for p in reader.partitions() for b in reader.read(p)) <= byte_streams.BATCH_ROWS


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_timecodes_in_chunks(spark, size):
    """Lines that borders cut, ends of lines of both kinds, none at the end, other lines; an empty file."""
    texts = {"a": "# timecode format v2\n0.000\n40.125\r\n 80 \n\nx\n120", "b": "7\n" * 9, "c": "", "d": "1\r", "e": "5.5"}
    chunks = [(f, k, t.encode()[p : p + size]) for f, t in texts.items() for k, p in enumerate(range(0, len(t), size))]
    got = {}
    for r in media.timecodes(spark.createDataFrame(chunks[::-1], "file string, chunk_no long, data binary")).orderBy("file", "frame_no").collect():
        assert r.frame_no == len(got.setdefault(r.file, []))
        got[r.file].append(r.ms)
    assert got == {"a": [0.0, 40.125, 80.0, 120.0], "b": [7.0] * 9, "d": [1.0], "e": [5.5]}


def test_a_failed_write_leaves_no_parts(spark, tmp_path):
    from pyspark.errors import PySparkException

    units = spark.range(10).select(F.lit("s").alias("file"), F.col("id").alias("pos"), F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit(b"x")).cast("binary").alias("data"))
    with pytest.raises(PySparkException):
        sinks.write_units(units, str(tmp_path / "w"))
    assert not [p for p in tmp_path.rglob("part-*")]


def test_zero_byte_warnings(spark):
    nal = spark.createDataFrame([("a", 0, 4, 9), ("a", 1, 3, 7), ("a", 2, 3, 5), ("a", 3, 3, 9), ("a", 4, 3, 1)], "file string, pos long, start_code_len int, nal_type int")
    assert sorted(r.pos for r in zero_byte_warnings(access_units(nal)).collect()) == [1, 3]


def test_record_source_reads_a_folder_in_ranges(spark, tmp_path):
    from framelake.sources.records import RecordSource

    data = {f"{n}.bin": bytes(R.randrange(256) for _ in range(n)) for n in (0, 5, 24, 101)}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    spark.dataSource.register(RecordSource)
    rows = spark.read.format("fixed_records").option("path", str(tmp_path)).option("record_size", 8).option("split_bytes", 16).load()
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file, r.record)):
        got[r.file.rsplit("/", 1)[1]] = got.get(r.file.rsplit("/", 1)[1], b"") + bytes(r.data)
    assert got == {n: raw for n, raw in data.items() if raw}
    assert rows.columns == ["file", "record", "data"] and rows.agg(F.max(F.octet_length("data"))).first()[0] == 8
