"""Queries of the byte operators: packets and payloads are bytes derived from the documents' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import windows as W
from ..operators.projections import parted_rtp, zero_byte_warnings
from ..sources import media, sinks
from ..streaming.windows import start_codes
from .registry import Entry
from .windows import _AU_SQL, _nal


def _digest(t):
    return t("documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"))


def _sparse(t):
    """Payloads of zeros, ones, threes and others: two of three hex digits become a zero byte."""
    hexes = F.regexp_replace(F.regexp_replace(F.regexp_replace("h", "[c-f]", "L"), "[ab]", "M"), "[89]", "N")
    hexes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(hexes, "[0-7]", "00"), "L", "c8"), "M", "03"), "N", "01")
    return _digest(t).select("doc_id", F.unhex(hexes).alias("p"))


def _byte_streams(t, chunk=64):
    """A file per document whose spaces are zeros and whose e are ones, in chunks of 64 bytes."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[^ -~]", ""), "[ ,]", "\u0000"), "e", "\u0001")
    rows = t("documents").select(F.col("doc_id").cast("string").alias("file"), text.alias("s"))
    n = F.greatest(F.ceil(F.length("s") / chunk).cast("int"), F.lit(1))
    return rows.select("file", "s", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select(
        "file", F.col("k").cast("long").alias("chunk_no"), (F.col("k") * chunk).cast("long").alias("offset"), F.encode(F.substring("s", F.col("k") * chunk + 1, F.lit(chunk)), "ISO-8859-1").alias("data")
    )


_RTP = [("version", "b0 & 3"), ("padding", "b0 >> 2 & 1"), ("extension", "b0 >> 3 & 1"), ("csrc_count", "b0 >> 4 & 15"), ("marker", "b1 & 1"), ("payload_type", "b1 >> 1")]

SCAN_SQL = r"""with s as (select cast(doc_id as varchar) as file, regexp_replace(text, '[^ -~]', '', 'g') as raw from {documents}),
b as (select file, raw, translate(translate(raw, 'ZO', 'zo'), ' ,e', 'ZZO') as s from s),
c as (select file, raw, s, unnest(range(1, length(s) - 1)) as p from b where length(s) > 2),
u as (select file, raw, s, p + 2 as pos, case when p > 1 and substr(s, p - 1, 1) = 'Z' then 4 else 3 end as start_code_len from c where substr(s, p, 3) = 'ZZO'),
e as (select *, coalesce(lead(pos - start_code_len) over (partition by file order by pos), length(s)) as stop from u),
z as (select *, length(substr(s, pos + 1, stop - pos)) - length(rtrim(substr(s, pos + 1, stop - pos), 'Z')) as zeros,
  case substr(s, pos + 1, 1) when 'Z' then 0 when 'O' then 1 when '' then null else ascii(substr(raw, pos + 1, 1)) end as b0 from e)
select file, pos, start_code_len, stop - pos - zeros as length, zeros, b0 >> 7 & 1 as forbidden, b0 >> 5 & 3 as ref_idc, b0 & 31 as nal_type from z"""

def _called(t):
    """Start codes of whole byte streams by a table function, joined laterally."""
    spark = t("documents").sparkSession
    codes = start_codes(spark)
    streams = _byte_streams(t, chunk=1 << 30).select("file", "data")
    return streams.lateralJoin(codes(F.col("data").outer())).select("file", F.col("pos").cast("long").alias("pos"), F.col("start_code_len").cast("long").alias("start_code_len"))


ENTRIES = {
    "ud03_start_codes": Entry(_called, SCAN_SQL[: SCAN_SQL.index(",\ne as (")] + "\nselect file, pos, start_code_len from u"),
    "prj04_rtp_header_fields": Entry(
        lambda t: _digest(t).withColumn("d", F.unhex("h")).withColumn("f", C.rtp_header_fields(F.col("d"), "low_first")).select(
            "doc_id", *[F.col(f"f.{c}").cast("long").alias(c) for c in ("version", "padding", "extension", "csrc_count", "marker", "payload_type", "seq", "timestamp", "ssrc")],
            C.rtp_valid(F.col("d"), F.col("f")).alias("valid"), F.lower(F.hex("f.payload")).alias("payload"),
        ),
        "with b as (select doc_id, md5(text) as h, cast('0x' || substr(md5(text), 1, 2) as bigint) as b0, cast('0x' || substr(md5(text), 3, 2) as bigint) as b1 from {documents}) select doc_id, "
        + ", ".join(f"{e} as {n}" for n, e in _RTP)
        + ", cast('0x' || substr(h, 7, 2) || substr(h, 5, 2) as bigint) as seq, cast('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) as bigint) as timestamp"
        + ", cast('0x' || substr(h, 23, 2) || substr(h, 21, 2) || substr(h, 19, 2) || substr(h, 17, 2) as bigint) as ssrc, b0 = 2 as valid, substr(h, 25) as payload from b",
    ),
    "prj04_quarantine": Entry(
        lambda t: parted_rtp(_digest(t).withColumn("packet", F.unhex("h")), layout="low_first")[1].groupBy("reason").agg(F.count("*").alias("n")),
        """with b as (select cast('0x' || substr(md5(text), 1, 2) as bigint) as b0 from {documents})
select case when b0 & 3 <> 2 then 'version' when b0 >> 2 & 1 <> 0 then 'padding' when b0 >> 3 & 1 <> 0 then 'extension' else 'sources' end as reason, count(*) as n from b where b0 <> 2 group by all""",
    ),
    "prj05_emulation": Entry(
        lambda t: _sparse(t).select("doc_id", F.hex(C.insert_emulation(F.col("p"))).alias("inserted"), F.hex(C.strip_emulation(F.col("p"))).alias("stripped"), (C.strip_emulation(C.insert_emulation(F.col("p"))) == F.col("p")).alias("round_trip")),
        """with recursive d as (select doc_id, list_transform(range(32), lambda k: case when substr(md5(text), k + 1, 1) in ('8', '9') then 1 when substr(md5(text), k + 1, 1) in ('a', 'b') then 3 when substr(md5(text), k + 1, 1) between 'c' and 'f' then 200 else 0 end) as p from {documents}),
e as (select doc_id, p, 1 as k, cast([] as integer[]) as ins, 0 as zi, cast([] as integer[]) as cut, 0 as zc from d union all
  select doc_id, p, k + 1, list_concat(ins, case when zi = 2 and p[k] <= 3 then [3, p[k]] else [p[k]] end), case when p[k] = 0 then case when zi = 2 then 1 else zi + 1 end else 0 end,
    list_concat(cut, case when zc = 2 and p[k] = 3 then cast([] as integer[]) else [p[k]] end), case when p[k] = 0 then zc + 1 else 0 end from e where k <= 32)
select doc_id, upper(array_to_string(list_transform(ins, lambda b: lpad(hex(b), 2, '0')), '')) as inserted, upper(array_to_string(list_transform(cut, lambda b: lpad(hex(b), 2, '0')), '')) as stripped, true as round_trip from e where k = 33""",
    ),
    "prj06_payload_bits": Entry(
        lambda t: _digest(t).select("doc_id", C.payload_bits(F.unhex(F.regexp_replace("h", "..$", "00"))).alias("bits")),
        """with p as (select doc_id, regexp_replace(substr(md5(text), 1, 30), '(00)+$', '') as h from {documents}),
v as (select doc_id, length(h) * 4 as n, cast('0x' || right(h, 2) as bigint) as v from p)
select doc_id, cast(n - log2(v & -v) - 1 as bigint) as bits from v""",
    ),
    "prj07_slice_lead_fields": Entry(
        lambda t: _digest(t).select("doc_id", C.slice_lead_fields(F.unhex(F.concat(F.lit("65"), F.lit("4b"), F.col("h")))).alias("f")).select("doc_id", *[F.col(f"f.{c}").cast("long").alias(c) for c in ("first_mb", "slice_type", "pps_id")]),
        """with recursive b as (select doc_id, array_to_string(list_transform(range(16), lambda k: lpad(bin(cast('0x' || substr('4b' || md5(text), 2 * k + 1, 2) as bigint)), 8, '0')), '') as s from {documents}),
v as (select doc_id, s, 0 as n, cast([] as bigint[]) as said from b union all
  select doc_id, substr(s, 2 * strpos(s, '1')), n + 1, list_append(said, list_reduce(list_concat([cast(0 as bigint)], list_transform(string_split(substr(s, strpos(s, '1'), strpos(s, '1')), ''), lambda c: cast(c as bigint))), lambda a, c: 2 * a + c) - 1) from v where n < 3)
select doc_id, said[1] as first_mb, said[2] % 5 as slice_type, said[3] as pps_id from v where n = 3""",
    ),
    "prj19_zero_byte_warnings": Entry(
        lambda t: zero_byte_warnings(W.access_units(_nal(t).withColumn("start_code_len", (F.col("pos") % 2 + 3)))).select("file", "pos", F.col("nal_type").cast("long").alias("nal_type"), "au"),
        _AU_SQL + ", q as (select *, row_number() over (partition by file, au order by pos) as n from a) select file, pos, cast(nal_type as bigint) as nal_type, au from q where pos % 2 = 0 and (nal_type in (7, 8) or n = 1)",
    ),
    "src04_scan_start_codes": Entry(
        lambda t: media.scan_start_codes(_byte_streams(t)).select("file", "pos", "start_code_len", "length", "zeros", *[F.col(c).cast("long").alias(c) for c in ("forbidden", "ref_idc", "nal_type")]).withColumn("start_code_len", F.col("start_code_len").cast("long")),
        SCAN_SQL,
    ),
    "snk04_extract_units": Entry(
        lambda t: sinks.extract_units(
            _nal(t).withColumns({"start_code_len": F.col("pos") % 2 + 3, "forbidden": F.lit(0), "ref_idc": F.col("pos") % 4, "payload": F.encode(F.col("pos").cast("string"), "UTF-8")}), F.col("nal_type").isin(1, 5)
        ).select("file", "pos", F.lower(F.hex("data")).alias("data")),
        """select stream_id as file, i as pos, case when i % 2 = 0 then '000001' else '00000001' end || lower(lpad(hex(i % 4 * 32 + k), 2, '0')) || lower(hex(encode(cast(i as varchar)))) as data
from (select *, [1, 5, 6, 7, 8, 9, 1, 1, 14, 1][bits % 10 + 1] as k from {m_frame_log}) where k in (1, 5)""",
    ),
}
