"""Sources of media material: raw frames and samples, byte streams, RTP dumps, sessions, logs.

Files of fixed-size records are split into ranges of whole records, so one large file is read by
many tasks. Small files are read through Spark's own readers; those above ``SPLIT_ABOVE`` in ranges, by pyarrow's file systems.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import idiv, nal_header_fields
from ..operators.folds import fold_in_order
from .records import BATCH_BYTES, SPLIT_BYTES, RecordSource

#: Bytes and number types of sample formats.
SAMPLES = {"u8": (1, "u1"), "s16le": (2, "<i2"), "s32le": (4, "<i4"), "f32le": (4, "<f4"), "f64le": (8, "<f8"), "s16be": (2, ">i2"), "s32be": (4, ">i4"), "f32be": (4, ">f4"), "f64be": (8, ">f8")}
KINDS = {
    "video": "mp4 mkv flv avi mov ts yuv h264 264 mpg webm".split(), "audio": "mp3 aac wav pcm flac ogg m4a".split(),
    "text": "txt cfg csv sdp log".split(), "image": "png jpg jpeg bmp gif".split(),
}


def media_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, time and kind of every file below ``path``; unknown kinds are ``<UNKNOWN>``. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.coalesce(*[F.when(ext.isin(*exts), F.lit(k)) for k, exts in KINDS.items()], F.lit("<UNKNOWN>"))
    return files.withColumn("kind", kind)


#: Larger files are read in byte ranges by many tasks.
SPLIT_ABOVE = 16 << 20


def _records(spark: SparkSession, path: str, size: int, split_above: int | None = None, split_bytes: int = SPLIT_BYTES, overlap: int = 0) -> DataFrame:
    """``file, record, data``: whole records of ``size`` bytes, numbered per file, and a short last one; with ``overlap``
    so many of the bytes that follow a record lie behind it.

    Files are cut up in the task that reads them; large ones, whatever their length, are read in ranges.
    """
    limit = SPLIT_ABOVE if split_above is None else split_above
    files = spark.read.format("binaryFile").load(path)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, BATCH_BYTES // (size + overlap))
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                n = -(-len(content) // size)
                for first in range(0, n, step):
                    ks = range(first, min(first + step, n))
                    yield pd.DataFrame({"file": file, "record": ks, "data": [bytes(content[k * size : (k + 1) * size + overlap]) for k in ks]})

    schema = "file string, record long, data binary"
    found = files.where(F.col("length") <= limit).select(F.col("path").alias("file"), "content").mapInPandas(cut, schema)
    spark.dataSource.register(RecordSource)
    large = sorted(file for (file,) in files.where(F.col("length") > limit).select("path").collect())  # names only
    if large:
        ranges = spark.read.format("fixed_records").option("paths", json.dumps(large)).option("record_size", size).option("split_bytes", split_bytes).option("overlap", overlap).load()
        found = found.unionByName(ranges)
    return found


def read_planar_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """``file, frame_no, w, h, y, u, v, complete``: a frame is w h 3/2 bytes; a short last one is marked."""
    luma = width * height
    chroma = luma // 4
    rows = _records(spark, path, luma + 2 * chroma)
    return rows.select(
        "file", F.col("record").alias("frame_no"), F.lit(width).alias("w"), F.lit(height).alias("h"), F.substring("data", 1, luma).alias("y"),
        F.substring("data", luma + 1, chroma).alias("u"), F.substring("data", luma + chroma + 1, chroma).alias("v"),
        F.coalesce(F.octet_length("data") == luma + 2 * chroma, F.lit(False)).alias("complete"),
    )


def frame_pixels(frames: DataFrame, plane: str = "y") -> DataFrame:
    """One row per pixel of a plane (chroma planes have half the size)."""
    half = 1 if plane == "y" else 2
    w = idiv(F.col("w"), half)
    hexes = F.regexp_extract_all(F.hex(plane), F.lit("(..)"), 1)
    return frames.select("file", "frame_no", w.alias("w"), F.posexplode(hexes).alias("p", "b")).select(
        "file", "frame_no", F.pmod("p", "w").cast("long").alias("x"), idiv(F.col("p"), F.col("w")).alias("y"), F.conv("b", 16, 10).cast("int").alias("v")
    )


def read_pcm(spark: SparkSession, path: str, channels: int, fmt: str = "f32le") -> DataFrame:
    """``file, idx, ch, complete``: interleaved samples as one array per index; a short tail is marked and
    keeps the channels that it has."""
    size, letter = SAMPLES[fmt]
    rows = _records(spark, path, channels * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [d[: len(d) // size * size] for d in b.column("data").to_pylist()]
            n = np.array([len(d) // size for d in data], np.int64)
            values = np.frombuffer(b"".join(data), letter).astype(np.float64)
            ch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("record"), ch, pa.array(n == channels)], names=["file", "idx", "ch", "complete"])

    return rows.mapInArrow(run, "file string, idx long, ch array<double>, complete boolean")


def read_chunks(spark: SparkSession, path: str, size: int = 4096) -> DataFrame:
    """``file, chunk_no, offset, data``: a byte stream in bounded chunks."""
    rows = _records(spark, path, size)
    return rows.select("file", F.col("record").alias("chunk_no"), (F.col("record") * size).alias("offset"), "data")


def _within_chunks(chunks: DataFrame, by: str) -> DataFrame:
    """A short row per chunk: its borders (``head``, ``tail``), the end of its last byte that is not zero (``used``), and
    ``codes``: start codes that lie in it, each with the end of the last such byte before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, heads, tails, used, codes = [], [], [], [], []
            for offset, value in zip(b.column("offset").to_pylist(), b.column("data"), strict=True):
                data = value.as_py() or b""
                found, seen, last, at = [], 0, None, data.find(b"\0\0\1")
                while at >= 0:
                    four = data[at - 1] == 0 if at else None
                    kept = len(data[seen : at - bool(four)].rstrip(b"\0"))
                    last = offset + seen + kept if kept else last
                    found.append({"pos": offset + at + 3, "four": four, "b0": data[at + 3] if at + 3 < len(data) else None, "used": last})
                    seen, last = at + 3, offset + at + 3
                    at = data.find(b"\0\0\1", at + 1)
                kept = len(data[seen:].rstrip(b"\0"))
                sizes.append(len(data))
                heads.append(data[:4])
                tails.append(data[-3:])
                used.append(offset + seen + kept if kept else last)
                codes.append(found)
            yield pa.RecordBatch.from_arrays(
                [b.column(by), b.column("chunk_no"), b.column("offset"), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary()), pa.array(tails, pa.binary()), pa.array(used, pa.int64()), pa.array(codes, pa.list_(pa.struct(CODE)))],
                names=[by, "chunk_no", "offset", "size", "head", "tail", "used", "codes"],
            )

    kind = dict(chunks.dtypes)[by]
    return chunks.select(by, F.col("chunk_no").cast("long").alias("chunk_no"), F.col("offset").cast("long").alias("offset"), "data").mapInArrow(
        run, f"`{by}` {kind}, chunk_no long, offset long, size long, head binary, tail binary, used long, codes array<struct<pos: long, four: boolean, b0: long, used: long>>"
    )


CODE = [("pos", pa.int64()), ("four", pa.bool_()), ("b0", pa.int64()), ("used", pa.int64())]


def scan_start_codes(chunks: DataFrame, by: str = "file") -> DataFrame:
    """Units of a chunked byte stream: ``file, pos, start_code_len, zeros, file_size, length`` and the
    fields of the header byte. ``pos`` is the first byte behind the start code; trailing zeros belong to
    no unit.

    Chunks are searched where they are. What is shuffled is a short row per chunk: the codes in it, and its first and last
    bytes, from which codes that straddle a border are found, once, by the chunk that holds the 01.
    """
    order = Window.partitionBy(by).orderBy("chunk_no")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(by)
    tails = F.concat(*[F.coalesce(F.lag("tail", k).over(order), F.lit(b"")) for k in (3, 2, 1)])
    bordered = _within_chunks(chunks, by).withColumns({
        "before": F.substring(tails, -3, 3), "used_before": F.max("used").over(earlier), "after": F.first(F.when(F.col("size") > 0, F.substring("head", 1, 1)), ignorenulls=True).over(later),
        "file_size": F.max(F.col("offset") + F.col("size")).over(whole), "file_used": F.max("used").over(whole),
    })

    def straddling(before: pd.Series, head: pd.Series, offset: pd.Series) -> pd.Series:
        found = []
        for b, h, o in zip(before, head, offset, strict=True):
            whole, low, codes = bytes(b) + bytes(h), len(b), []
            at = whole.find(b"\0\0\1")
            while 0 <= at < low:
                if at + 2 >= low:
                    codes.append({"pos": o + at + 3 - low, "four": at > 0 and whole[at - 1] == 0, "b0": whole[at + 3] if at + 3 < len(whole) else None, "used": None})
                at = whole.find(b"\0\0\1", at + 1)
            found.append(codes)
        return pd.Series(found, dtype=object)

    crossing = F.pandas_udf(straddling, "array<struct<pos: long, four: boolean, b0: long, used: long>>")
    told = bordered.withColumn("c", F.explode(F.concat(crossing("before", "head", "offset"), "codes")))
    four = F.coalesce("c.four", F.substring("before", -1, 1) == F.lit(b"\0"))
    byte = F.when(F.octet_length("after") > 0, F.conv(F.hex("after"), 16, 10).cast("long"))
    codes = told.select(
        by, F.col("c.pos").alias("pos"), F.when(four, 4).otherwise(3).alias("start_code_len"), F.coalesce("c.b0", byte).alias("b0"),
        F.coalesce("c.used", "used_before").alias("__used"), "file_size", "file_used",
    )
    upto = Window.partitionBy(by).orderBy("pos")
    end = F.coalesce(F.lead(F.col("pos") - F.col("start_code_len")).over(upto), F.col("file_size"))
    last = F.when(F.lead("pos").over(upto).isNull(), F.col("file_used")).otherwise(F.lead("__used").over(upto))
    units = codes.withColumns({"__end": end, "__last": last}).withColumn("zeros", F.col("__end") - F.greatest("__last", "pos"))
    return units.withColumn("length", F.col("__end") - F.col("pos") - F.col("zeros")).select("*", nal_header_fields(F.col("b0")).alias("h")).select(
        by, "pos", "start_code_len", "zeros", "file_size", "length", "h.*"
    )


RTP_DUMP_SCHEMA = "file string, n long, time int, packet binary, torn boolean"
#: The largest packet of a dump (a longer one is corruption), and bytes of a record's head.
MAX_PACKET, HEAD = 65508, 8
#: Bytes that are read at once, about: the ranges of a block share what follows it.
BLOCK_BYTES = 1 << 20
#: Where a chain of records ends, torn or not.
ENDED = 1 << 62


def _chains(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a range at which a record may start, where the chain from each leaves the range (from its start on;
    ``ENDED``: it breaks off), and its number of records. A record fits if its length is allowed and its bytes are there.

    ``data``: the range of ``size`` bytes and what follows it. Chains are followed by pointer doubling.
    """
    places = np.arange(max(0, min(size, len(data) - HEAD + 1)))
    b = data.astype(np.int64)
    lengths = b[places] | b[places + 1] << 8 | b[places + 2] << 16 | b[places + 3] << 24
    fits = (lengths <= MAX_PACKET) & (places + HEAD + lengths <= len(data))
    places, jump = places[fits], (places + HEAD + lengths)[fits]
    count, where = np.ones(len(places), np.int64), np.searchsorted(places, jump)
    inside = jump < size
    known = inside & (where < len(places)) & (places[np.minimum(where, len(places) - 1)] == jump) if len(places) else inside
    # a chain that goes on in the range at a place where no whole record fits breaks off there, after that torn one
    count = count + (inside & ~known)
    jump = np.where(inside & ~known, ENDED, jump)
    open_ = np.where(known, where, -1)
    while (open_ >= 0).any():
        at = np.flatnonzero(open_ >= 0)
        count[at], jump[at], open_[at] = count[at] + count[open_[at]], jump[open_[at]], open_[open_[at]]
    return places, jump, count


def read_rtp_dump(spark: SparkSession, path: str, range_bytes: int = 1 << 20, split_above: int | None = None) -> DataFrame:
    """Records of length (u32), time (i32) and packet, little-endian; a torn record is marked and ends its file.

    The chain of lengths is followed in ranges of bytes side by side: a range tries every place of its first bytes at which
    a record may start, and tells where each chain leaves it; the chains are joined end to start per file, from one
    short row per range; then the records of the one true chain are read. Bytes are read in blocks of ranges.
    """
    reach = MAX_PACKET + HEAD
    if range_bytes < 1:
        raise ValueError("range_bytes must be positive")
    per = max(1, BLOCK_BYTES // range_bytes)
    block_bytes = per * range_bytes
    blocks = _records(spark, path, block_bytes, split_above, overlap=reach)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, value in zip(b.column("file").to_pylist(), b.column("record").to_pylist(), b.column("data"), strict=True):
                whole, rows = np.frombuffer(value.as_buffer(), np.uint8), []
                for k in range(block * per, block * per + min(per, -(-len(whole) // range_bytes))):
                    start = k * range_bytes
                    data = whole[start - block * block_bytes :][: range_bytes + reach]
                    places, jump, count = _chains(data, range_bytes)
                    first = places < (1 if k == 0 else reach)
                    rows.append(np.column_stack([places + start, np.where(jump == ENDED, ENDED, jump + start), count])[first].astype(np.int64).tobytes())
                numbers = range(block * per, block * per + len(rows))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(numbers, pa.int64()), pa.array(numbers, pa.int64()), pa.array(rows, pa.binary())], names=["file", "record", "k", "entries"])

    def step(state: list, row: tuple) -> tuple[list, tuple]:
        """State: the place at which the next record starts, and the records before it."""
        k, table = row[0], np.frombuffer(row[1], np.int64).reshape(-1, 3)
        at, n = state
        if not k * range_bytes <= at < (k + 1) * range_bytes:
            return state, ([ENDED, n],)
        found = np.searchsorted(table[:, 0], at)
        if found == len(table) or table[found, 0] != at:
            return [ENDED, n + 1], (state,)
        return [int(table[found, 1]), n + int(table[found, 2])], (state,)

    chained = fold_in_order(blocks.mapInArrow(entries, "file string, record long, k long, entries binary"), "file", "record", [0, 0], step, "state array<long>")
    # the first record of a block leads to all that start in it
    starts = chained.where(F.col("state")[0] < ENDED).groupBy("file", idiv(F.col("record"), per).alias("record")).agg(F.min("state").alias("state"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, k, value, (at, n) in zip(b.column("file").to_pylist(), b.column("record").to_pylist(), b.column("data"), b.column("state").to_pylist(), strict=True):
                data, at, rows = value.as_py(), at - k * block_bytes, []
                while at < min(block_bytes, len(data)):
                    size, time = struct.unpack_from("<Ii", data, at) if at + HEAD <= len(data) else (None, None)
                    torn = size is None or size > MAX_PACKET or at + HEAD + size > len(data)
                    packet = data[at:] if size is None else data[at + HEAD : at + HEAD + min(size, reach)]
                    rows.append((time, packet, torn))
                    at = len(data) if torn else at + HEAD + size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows), pa.string()), pa.array(range(n, n + len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.bool_())],
                    names=["file", "n", "time", "packet", "torn"],
                )

    return blocks.join(starts, ["file", "record"]).select("file", "record", "data", "state").mapInArrow(read, RTP_DUMP_SCHEMA)


def session_lines(lines: DataFrame) -> DataFrame:
    """``session, line_no, section, key, attr, pt, value`` of lines (session, line_no, line): attributes
    ``a=name[:value]`` are taken apart, and lines from an ``m=`` on belong to its section (from 1)."""
    kv = lines.where(F.col("line").rlike("^[a-z]=")).withColumns({"key": F.substring("line", 1, 1), "rest": F.expr("substring(line, 3)")})
    order = Window.partitionBy("session").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_a = F.col("key") == "a"
    attr = F.when(is_a, F.substring_index("rest", ":", 1))
    said = F.when(is_a, F.when(F.instr("rest", ":") > 0, F.expr("substring(rest, instr(rest, ':') + 1)"))).otherwise(F.col("rest"))
    typed = kv.withColumns({"section": F.sum((F.col("key") == "m").cast("long")).over(order), "attr": attr, "value": said})
    of_type = F.col("attr").isin("rtpmap", "fmtp", "rtcp-fb")
    return typed.select(
        "session", "line_no", "section", "key", "attr", F.when(of_type, F.regexp_extract("value", r"^(\d+|\*)", 1)).alias("pt"),
        F.when(of_type, F.regexp_replace("value", r"^\S+\s+", "")).otherwise(F.col("value")).alias("value"),
    )


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("session"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return session_lines(whole)


def read_frame_log(spark: SparkSession, path: str) -> DataFrame:
    """CSV of frames: number, type, quantiser, bits."""
    return spark.read.csv(path, header=True, schema="frame_no long, ftype string, qp double, bits long")


def read_qpfile(spark: SparkSession, path: str) -> DataFrame:
    """``i, ftype, qp``: a number, a type, and a quantiser that may be missing or -1 (none forced)."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.get(p, F.lit(0)).cast("long").alias("i"), F.get(p, F.lit(1)).alias("ftype"), F.nullif(F.get(p, F.lit(2)).cast("long"), F.lit(-1).cast("long")).alias("qp"))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """``zone_id, start_i, end_i, qp, bitrate_factor`` of ``start,end,q=`` or ``b=`` items, split by ``/`` or lines."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"[/\r\n]+")).alias("zone_id", "item")).where("trim(item) <> ''")
    p = F.split("item", ",")
    return rows.select(
        F.col("zone_id").cast("long").alias("zone_id"), F.trim(F.get(p, F.lit(0))).cast("long").alias("start_i"), F.trim(F.get(p, F.lit(1))).cast("long").alias("end_i"),
        F.nullif(F.regexp_extract("item", r"\bq=(\d+)", 1), F.lit("")).cast("long").alias("qp"),
        F.nullif(F.regexp_extract("item", r"\bb=([\d.]+)", 1), F.lit("")).cast("double").alias("bitrate_factor"),
    )


#: Bytes of a chunk of a text that is read in chunks.
TEXT_BYTES = 1 << 20


def timecodes(chunks: DataFrame) -> DataFrame:
    """``file, frame_no, ms`` of timecode files in chunks (file, chunk_no, data): a number a line after the header. Chunks
    of a file meet as bytes, in order; a line that a border cuts waits for its rest, so no file is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rest, n = None, b"", 0

        def numbers(lines: list[bytes]) -> pa.RecordBatch:
            nonlocal n
            ms = [float(line) for line in (line.strip(b" ") for line in lines) if re.fullmatch(rb"[\d.]+\r?", line)]
            n += len(ms)
            return pa.RecordBatch.from_arrays([pa.array([file] * len(ms), pa.string()), pa.array(range(n - len(ms), n), pa.int64()), pa.array(ms, pa.float64())], names=["file", "frame_no", "ms"])

        for b in batches:
            for name, data in zip(b.column("file").to_pylist(), b.column("data").to_pylist(), strict=True):
                if name != file:
                    if rest:
                        yield numbers([rest])
                    file, rest, n = name, b"", 0
                *lines, rest = (rest + data).split(b"\n")
                if lines:
                    yield numbers([line.removesuffix(b"\r") for line in lines])
        if rest:
            yield numbers([rest])

    ordered = chunks.select("file", "chunk_no", "data").repartition("file").sortWithinPartitions("file", "chunk_no")
    return ordered.mapInArrow(run, "file string, frame_no long, ms double")


def read_timecodes(spark: SparkSession, path: str) -> DataFrame:
    """``file, frame_no, ms`` of timecode files: a number a line after the header."""
    return timecodes(read_chunks(spark, path, TEXT_BYTES))


def trace_blocks(lines: DataFrame, names: list[str]) -> DataFrame:
    """One row per block of a trace (file, line_no, line): blocks lie between dashed lines and hold ``Name: value`` lines."""
    dashed = F.trim("line").rlike("^-{3,}")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("block", F.sum(dashed.cast("long")).over(order)).where(F.col("line").contains(":") & ~dashed)
    kv = rows.select("file", "block", F.trim(F.substring_index("line", ":", 1)).alias("name"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("said"))
    return kv.groupBy("file", "block").pivot("name", names).agg(F.first("said"))


def read_trace_blocks(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return trace_blocks(lines, names)


CONFIG_LINE = r"^\s*([A-Za-z_]\w*)\s*=\s*(\"[^\"]*\"|[^\s#]+)"


def config_lines(lines: DataFrame, run: str = "run_id") -> DataFrame:
    """``run, layer, key, value`` of ``Name = value # comment`` lines."""
    key, said = F.regexp_extract("line", CONFIG_LINE, 1), F.regexp_extract("line", CONFIG_LINE, 2)
    return lines.where(key != "").select(run, "layer", key.alias("key"), F.regexp_replace(said, '^"|"$', "").alias("value"))
