"""Writers: packets by stream, frames in display order, timecodes, and byte streams of chosen units."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import nal_header_byte, rescale_ts
from .byte_streams import PART_BYTES, ByteStreamSource


def write_by_stream(packets: DataFrame, path: str, chosen: DataFrame | None = None) -> None:
    """Each packet to the folder of its stream; packets of other than the chosen streams are dropped."""
    kept = packets if chosen is None else packets.join(chosen.select("file", "stream_index"), ["file", "stream_index"], "left_semi")
    kept.write.mode("overwrite").partitionBy("stream_index").parquet(path)


def write_display_order(frames: DataFrame, path: str) -> None:
    """Pictures by file and picture order; those that do not exist are left out."""
    kept = frames.where(~F.coalesce(F.col("non_existing"), F.lit(False))).drop("non_existing")
    kept.repartitionByRange("file", "poc").sortWithinPartitions("file", "poc").write.mode("overwrite").parquet(path)


def write_timecodes(packets: DataFrame, path: str, tb: tuple[int, int]) -> None:
    """A line of milliseconds per packet, by file and time, in one folder per file."""
    ms = rescale_ts(F.col("pts"), tb, (1, 1000))
    lines = packets.select("file", ms.alias("ms"))
    ordered = lines.repartitionByRange("file", "ms").sortWithinPartitions("file", "ms")
    ordered.select("file", F.col("ms").cast("string").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def unit_bytes(start_code_len: Column, forbidden: Column, ref_idc: Column, nal_type: Column, payload: Column) -> Column:
    """Start code, header byte rebuilt from its fields, and payload."""
    code = F.when(start_code_len == 3, F.unhex(F.lit("000001"))).otherwise(F.unhex(F.lit("00000001")))
    head = F.unhex(F.lpad(F.hex(nal_header_byte(forbidden, ref_idc, nal_type).cast("long")), 2, "0"))
    return F.concat(code, head, payload)


def extract_units(nal: DataFrame, predicate: Column, single: bool = False) -> DataFrame:
    """``file, pos, data`` of the chosen units as a byte stream; a unit extracted alone has a four-byte code."""
    code = F.lit(4) if single else F.col("start_code_len")
    return nal.where(predicate).select("file", "pos", unit_bytes(code, F.col("forbidden"), F.col("ref_idc"), F.col("nal_type"), F.col("payload")).alias("data"))


def write_units(units: DataFrame, path: str, mode: str = "overwrite", part_bytes: int = PART_BYTES) -> None:
    """Byte streams of units (file, pos, data): a folder per file, whose parts one after the other are the stream
    (``byte_streams``). Tasks write parts of ranges of (file, pos) side by side; the job's commit puts them in place."""
    units.sparkSession.dataSource.register(ByteStreamSource)
    ordered = units.select(F.col("file").cast("string").alias("file"), F.col("pos").cast("long").alias("pos"), "data").repartitionByRange("file", "pos").sortWithinPartitions("file", "pos")
    ordered.write.format("byte_stream").mode(mode).option("part_bytes", part_bytes).save(path)


def read_units(spark: SparkSession, path: str, size: int = 4096) -> DataFrame:
    """``file, chunk_no, offset, data``: what ``write_units`` wrote, in chunks, for ``scan_start_codes``."""
    spark.dataSource.register(ByteStreamSource)
    return spark.read.format("byte_stream").option("chunk_size", size).load(path)


def stream_pieces(units: DataFrame) -> DataFrame:
    """Consecutive pieces of a partition joined: ``file, pos, data`` with as many bytes as fit in 4 MB."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, pos, held = None, None, bytearray()
        for b in batches:
            rows = []
            for f, p, d in zip(b["file"], b["pos"], b["data"], strict=True):
                if held and (f != file or len(held) > 4 << 20):
                    rows.append((file, pos, bytes(held)))
                    held = bytearray()
                if not held:
                    file, pos = f, p
                held += d
            yield pd.DataFrame(rows, columns=["file", "pos", "data"])
        if held:
            yield pd.DataFrame([(file, pos, bytes(held))], columns=["file", "pos", "data"])

    ordered = units.repartitionByRange("file", "pos").sortWithinPartitions("file", "pos")
    return ordered.mapInPandas(run, "file string, pos long, data binary")
