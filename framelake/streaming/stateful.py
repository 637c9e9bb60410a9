"""Stateful streaming operators on ``transformWithStateInPandas``.

Each processor keeps a few values or a bounded list per key; the batch twins are in ``operators``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import nal_header_fields


def _joined(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


class SequenceGaps(StatefulProcessor):
    """Last sequence number per source; every packet with its gap: missing before it, -1 repeated,
    lower when it comes late. Packets of a batch are taken in arrival order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part = _joined(rows).sort_values("arrival")
        last = self.last.get()[0] if self.last.exists() else None
        gaps = []
        for seq in part["seq"]:
            gaps.append(None if last is None else (int(seq) - last) % 65536 - 1)
            last = int(seq)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"ssrc": key[0], "arrival": part["arrival"], "seq": part["seq"], "gap": pd.array(gaps, "Int64")})

    def close(self) -> None:
        pass


def seq_gap_stream(rtp: DataFrame) -> DataFrame:
    """Gaps of a stream of packets (ssrc, arrival, seq)."""
    return rtp.select("ssrc", "arrival", "seq").groupBy("ssrc").transformWithStateInPandas(
        statefulProcessor=SequenceGaps(), outputStructType="ssrc long, arrival long, seq long, gap long", outputMode="Append", timeMode="None"
    )


class BucketLevel(StatefulProcessor):
    """Level of a leaky bucket: drained before each frame, floored at empty, capped at full."""

    def __init__(self, rate: int, size: int) -> None:
        self.rate, self.size = rate, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part = _joined(rows).sort_values("i")
        level = self.level.get()[0] if self.level.exists() else 0
        levels, alerts = [], []
        for bits in part["bits"]:
            drained = level - self.rate
            full = max(drained, 0) + int(bits)
            alerts.append("overflow" if full > self.size else "underflow" if drained < 0 else None)
            level = min(full, self.size)
            levels.append(level)
        self.level.update((level,))
        yield pd.DataFrame({"stream_id": key[0], "i": part["i"], "level": levels, "alert": pd.Series(alerts, dtype=object, index=part.index)})

    def close(self) -> None:
        pass


def leaky_bucket_stream(frames: DataFrame, rate: int, size: int) -> DataFrame:
    """Levels and alerts of frames (stream_id, i, bits)."""
    return frames.select("stream_id", "i", "bits").groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=BucketLevel(rate, size), outputStructType="stream_id long, i long, level long, alert string", outputMode="Append", timeMode="None"
    )


class FieldPairs(StatefulProcessor):
    """One pending field per stream; opposite parity completes a frame, the same parity or a whole frame flushes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "i long, structure string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part = _joined(rows).sort_values("i")
        held = tuple(self.pending.get()) if self.pending.exists() else None
        out = []
        for i, s in zip(part["i"], part["structure"], strict=True):
            if s == "F":
                out += [(held[0], 1, held[1])] if held else []
                out.append((i, 1, s))
                held = None
            elif held and held[1] != s:
                out.append((held[0], 2, held[1] + s))
                held = None
            else:
                out += [(held[0], 1, held[1])] if held else []
                held = (int(i), s)
        if held:
            self.pending.update(held)
        else:
            self.pending.clear()
        yield pd.DataFrame({"stream_id": key[0], **{c: [r[k] for r in out] for k, c in enumerate(("i", "n_pictures", "structure"))}}).astype({"structure": object})

    def close(self) -> None:
        pass


def pair_fields_stream(pictures: DataFrame) -> DataFrame:
    """Output frames of fields (stream_id, i, structure); the last field waits for its partner."""
    return pictures.select("stream_id", "i", "structure").groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=FieldPairs(), outputStructType="stream_id long, i long, n_pictures long, structure string", outputMode="Append", timeMode="None"
    )


class Reorder(StatefulProcessor):
    """Up to ``capacity`` pictures are held; when one more comes the smallest picture order goes out.
    A refresh sends out all that are held."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "poc long, i long")
        self.sent = handle.getValueState("sent", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part = _joined(rows).sort_values("i")
        held = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        out = []
        for i, poc, idr in zip(part["i"], part["poc"], part["idr"], strict=True):
            if idr:
                out += held
                held = []
            held = sorted([*held, (int(poc), int(i))])
            if len(held) > self.capacity:
                out.append(held.pop(0))
        n = self.sent.get()[0] if self.sent.exists() else 0
        self.sent.update((n + len(out),))
        if held:
            self.held.put(held)
        else:
            self.held.clear()
        yield pd.DataFrame({"stream_id": key[0], "n": range(n, n + len(out)), "i": [r[1] for r in out], "poc": [r[0] for r in out]})

    def close(self) -> None:
        pass


def reorder_stream(frames: DataFrame, capacity: int = 10) -> DataFrame:
    """Pictures (stream_id, i, poc, idr) in output order, numbered from 0 per stream."""
    return frames.select("stream_id", "i", "poc", "idr").groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=Reorder(capacity), outputStructType="stream_id long, n long, i long, poc long", outputMode="Append", timeMode="None"
    )


class Interleave(StatefulProcessor):
    """Packets of a file wait until the watermark passes their slot of time, then go out by time. What waits is
    held by slot, so a timer reads and clears only its own packets."""

    def __init__(self, slot_ms: int) -> None:
        self.slot = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot long", "us array<long>, stream array<long>, pos array<long>")
        self.sent = handle.getValueState("sent", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part = _joined(rows)
        part["us"] = part["ts"].astype("datetime64[us]").astype("int64")
        for slot, new in part.groupby(part["us"] // (1000 * self.slot)):
            at = (int(slot),)
            lists = [[int(x) for x in new[c]] for c in ("us", "stream_index", "pos")]
            if self.held.containsKey(at):
                lists = [list(old) + x for old, x in zip(self.held.getValue(at), lists, strict=True)]
            self.held.updateValue(at, tuple(lists))
            self.handle.registerTimer((int(slot) + 1) * self.slot)
        yield pd.DataFrame({"file": [], "n": [], "ts": [], "stream_index": [], "pos": []}).astype({"file": "int64", "n": "int64", "ts": "datetime64[us]", "stream_index": "int64", "pos": "int64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() // self.slot - 1,)
        out = sorted(zip(*self.held.getValue(at), strict=True))
        self.held.removeKey(at)
        n = self.sent.get()[0] if self.sent.exists() else 0
        self.sent.update((n + len(out),))
        yield pd.DataFrame({"file": key[0], "n": range(n, n + len(out)), "ts": pd.to_datetime([r[0] for r in out], unit="us"), "stream_index": [r[1] for r in out], "pos": [r[2] for r in out]})

    def close(self) -> None:
        pass


def interleave_stream(packets: DataFrame, delay: str = "10 seconds", slot_ms: int = 1000) -> DataFrame:
    """Packets (file, ts, stream_index, pos) of all streams of a file by time, numbered from 0 per file (``n``),
    once none older than the end of their slot of ``slot_ms`` can come."""
    return packets.select("file", "ts", "stream_index", "pos").withWatermark("ts", delay).groupBy("file").transformWithStateInPandas(
        statefulProcessor=Interleave(slot_ms), outputStructType="file long, n long, ts timestamp, stream_index long, pos long", outputMode="Append", timeMode="EventTime"
    )


#: Groups that files are dealt to: files of a group share a call and a state, since each of these has its price.
GROUPS = 1024


class UnitScanner(StatefulProcessor):
    """Units of byte streams that come in chunks, for a group of files. Between chunks a file keeps its last three bytes,
    where its open unit began, and where the last byte that is not zero ended; a unit goes out when the next start code
    or the last chunk closes it. A group's open files are one row of arrays."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "file array<string>, offset array<long>, tail array<binary>, pos array<long>, code array<int>, head array<int>, used array<long>")

    @staticmethod
    def scan(state: tuple, data: bytes, last: bool, out: list) -> tuple:
        """State of a file behind ``data``; its units go to ``out``."""
        offset, tail, pos, code, head, used = state
        if pos == offset and head is None and data:
            head = data[0]
        whole, base, seen = tail + data, offset - len(tail), 0
        at = whole.find(b"\0\0\1")
        while at >= 0:
            if base + at + 2 >= offset:  # the 01 is new
                fresh = 4 if at > 0 and whole[at - 1] == 0 else 3
                end = at + 3 - fresh
                kept = len(whole[seen:end].rstrip(b"\0"))
                used = base + seen + kept if kept else used
                if pos is not None:
                    out.append((pos, code, base + end - max(used, pos), base + end - pos, head))
                pos, code, head = base + at + 3, fresh, whole[at + 3] if at + 3 < len(whole) else None
                seen, used = at + 3, pos
            at = whole.find(b"\0\0\1", at + 1)
        kept = len(whole[seen:].rstrip(b"\0"))
        used = max(used, base + seen + kept) if kept else used
        offset, tail = offset + len(data), whole[-3:]
        if last and pos is not None:
            out.append((pos, code, offset - max(used, pos), offset - pos, head))
        return offset, tail, pos, code, head, used

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        part = _joined(rows).sort_values(["file", "chunk_no"])
        held = self.state.get()
        states = {f: (o, bytes(t), *rest) for f, o, t, *rest in zip(*held, strict=True)} if held else {}
        files, out = [], []
        for file, chunks in groupby(zip(part["file"], part["data"], part["last"], strict=True), key=lambda row: row[0]):
            data, last = zip(*((bytes(d), e) for _, d, e in chunks), strict=True)
            state = self.scan(states.pop(file, (0, b"", None, None, None, 0)), b"".join(data), any(last), out)
            files += [file] * (len(out) - len(files))
            if not any(last):
                states[file] = state
        if states:
            self.state.update(tuple(map(list, zip(*((f, *x) for f, x in states.items()), strict=True))))
        elif held:
            self.state.clear()
        if out:
            found = {c: [r[k] for r in out] for k, c in enumerate(("pos", "start_code_len", "zeros", "length", "b0"))}
            made = pd.DataFrame({"file": files, **found}).astype({"b0": "Int64"})
            yield made.assign(length=made["length"] - made["zeros"])

    def close(self) -> None:
        pass


def scan_stream(chunks: DataFrame) -> DataFrame:
    """Units of byte streams as ``scan_start_codes`` finds them, from a stream of chunks (file, chunk_no, data, last):
    chunks of a file come in order, and ``last`` marks the one that ends it and flushes its open unit."""
    dealt = chunks.select(F.pmod(F.xxhash64("file"), F.lit(GROUPS)).alias("group"), "file", "chunk_no", "data", "last")
    found = dealt.groupBy("group").transformWithStateInPandas(
        statefulProcessor=UnitScanner(), outputStructType="file string, pos long, start_code_len int, zeros long, length long, b0 long", outputMode="Append", timeMode="None"
    )
    return found.select("*", nal_header_fields(F.col("b0")).alias("h")).select("file", "pos", "start_code_len", "zeros", "length", "h.*")
