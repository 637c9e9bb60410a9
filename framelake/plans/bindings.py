"""The test tables as media tables: frame logs, packets, slices, pixels and so on.

``bind`` gives a DataFrame; ``duck`` wraps SQL for DuckDB with the same definitions. A binding has
one text for both engines, or two where arrays or generators differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.aggregates import letter_counts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

#: name: (Spark SQL, DuckDB SQL or None for the same); {x} names a table or an earlier binding
_PIXEL = "least(255, greatest(0, cast(floor(cast(e as double) * 512) + 128 as int)))"
BINDINGS: dict[str, tuple[str, str | None]] = {
    "m_frame_log": (
        """select user_id as stream_id,
       cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i, event_id, ts,
       case event_type when 'signup' then 'IDR' when 'purchase' then 'I' when 'click' then 'P'
                       when 'view' then 'B' else 'X' end as ftype,
       cast(round(value * 100) as bigint) as bits
from {events}""",
        None,
    ),
    "m_packets": (
        """select stream_id, i as pos, ftype, ts, cast(ceil(bits / 8.0) as bigint) as size,
       case when mod(i, 7) = 3 then null else i * 3600 end as pts, cast(3600 as bigint) as duration
from {m_frame_log}""",
        None,
    ),
    "m_rtp": (
        """select stream_id as ssrc, i as arrival,
       cast(mod(65500 + i + 2 * sum(case when ftype = 'X' then 1 else 0 end)
           over (partition by stream_id order by i rows unbounded preceding), 65536) as bigint) as seq,
       cast(mod(i * 3 + case when ftype = 'B' then 253 else 0 end, 256) as bigint) as tr
from {m_frame_log}""",
        None,
    ),
    "m_gop": (
        """select *, cast(sum(case when ftype = 'IDR' or i = 0 then 1 else 0 end)
            over (partition by stream_id order by i rows unbounded preceding) as bigint) as gop
from {m_frame_log}""",
        None,
    ),
    "m_slices": (
        """select stream_id, i, k, ftype, case when k = 0 then 1 else 0 end as idr,
       case when ftype = 'B' and k > 0 then 0 else 1 end as is_ref, gop,
       cast(case when k = 0 then 0
            else mod(2 * k + case when ftype = 'B' then -3 else 0 end + 16, 16) end as bigint) as poc_lsb,
       cast(mod(k, 8) as bigint) as frame_num, mod(event_id, 4) as pps_id, event_id
from (select *, cast(row_number() over (partition by stream_id, gop order by i) - 1 as bigint) as k from {m_gop}) t""",
        None,
    ),
    "m_param_defs": (
        """select user_id as file, event_id as pos, mod(event_id, 4) as id,
       cast(round(value * 100) as bigint) as body,
       case when mod(event_id, 11) = 0 then 0 else 1 end as valid
from {events} where event_type = 'signup'""",
        None,
    ),
    "m_zones": (
        """select p_partkey as zone_id, mod(p_partkey * 3, 60) as start_i,
       mod(p_partkey * 3, 60) + mod(p_size, 5) as end_i,
       case when mod(p_partkey, 4) <> 1 then cast(mod(p_size, 52) as bigint) end as qp,
       case when mod(p_partkey, 4) = 1 then cast(mod(p_size, 8) as double) / 4 + 0.25 end as bitrate_factor
from {part}""",
        None,
    ),
    "m_configs": (
        """select o_orderkey as run_id,
       case mod(o_orderkey, 5) when 0 then 66 when 1 then 77 when 2 then 88 else 100 end as profile,
       mod(o_custkey, 2) as bframes, mod(o_custkey, 3) as sp, mod(o_custkey, 5) as partition_mode,
       mod(o_custkey, 7) as weighted, mod(o_custkey, 13) as weighted_bi, mod(o_orderkey, 3) as cabac,
       mod(o_custkey, 11) as slice_groups, mod(o_custkey, 4) as redundant, mod(o_orderkey, 2) as direct_8x8
from {orders}""",
        None,
    ),
    "m_candidates": (
        """select l_suppkey as mb, l_partkey as cand, cast(l_quantity as bigint) as rate,
       cast(floor(l_extendedprice) as bigint) as dist
from {lineitem}""",
        None,
    ),
    "m_pixels": (
        f"""select vec_id as frame_no, label, cast(mod(p, 8) as bigint) as x, cast(p div 8 as bigint) as y, {_PIXEL} as v
from (select vec_id, label, posexplode(embedding) as (p, e) from {{embeddings}}) t""",
        f"""select vec_id as frame_no, label, cast(mod(p, 8) as bigint) as x, cast(p // 8 as bigint) as y, {_PIXEL} as v
from (select vec_id, label, unnest(range(64)) as p, unnest(embedding) as e from {{embeddings}}) t""",
    ),
    "m_blocks": (
        """select frame_no, x, y, v,
       case when mod(frame_no * 31 + (y * 8 + x) * 17, 10) < 2 then 1 else 3 end as state
from {m_pixels}""",
        None,
    ),
    "m_segments": (
        """select frame_no, cast(start_mb as bigint) as start_mb, cast(start_mb + 7 as bigint) as end_mb,
       cast(mod(frame_no + start_mb, 3) as bigint) as bad
from (select distinct frame_no from {m_pixels}) f
cross join (select 0 as start_mb union all select 16 union all select 40) k""",
        None,
    ),
    "m_coeff": (
        """select frame_no, cast(y div 2 as bigint) as block, collect_list(c) as c from (
  select frame_no, y, cast(case when abs(v - 128) < 40 then 0 else (v - 128) div 40 end as int) as c
  from (select * from {m_pixels} distribute by frame_no sort by frame_no, y, x) s) t group by frame_no, y div 2""",
        """select frame_no, cast(y // 2 as bigint) as block, list(cast(case when abs(v - 128) < 40 then 0 else (v - 128) // 40 end as int) order by y, x) as c
from {m_pixels} group by frame_no, y // 2""",
    ),
    "m_samples": (
        """select vec_id as file, cast(p div 2 as bigint) as idx, cast(mod(p, 2) as bigint) as ch, cast(e as double) as s
from (select vec_id, posexplode(embedding) as (p, e) from {embeddings}) t""",
        """select vec_id as file, cast(p // 2 as bigint) as idx, cast(mod(p, 2) as bigint) as ch, cast(e as double) as s
from (select vec_id, unnest(range(64)) as p, unnest(embedding) as e from {embeddings}) t""",
    ),
    "m_streams": (
        """select c_nationkey as file, c_custkey as stream_index,
       case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'audio' else 'video' end as media_type,
       cast(round(c_acctbal) as bigint) as width, cast(2 as bigint) as height, cast(mod(c_custkey, 6) as bigint) as channels
from {customer}""",
        None,
    ),
}
# the blocks' coefficients must come in scan order, which collect_list after a sort does not promise
BINDINGS["m_coeff"] = (
    """select frame_no, cast(y div 2 as bigint) as block,
       transform(array_sort(collect_list(struct(y, x, c))), t -> t.c) as c from (
  select frame_no, y, x, cast(case when abs(v - 128) < 40 then 0 else (v - 128) div 40 end as int) as c from {m_pixels}) t
group by frame_no, y div 2""",
    BINDINGS["m_coeff"][1],
)


#: Media tables that a function makes of the tables, beside SQL for DuckDB.
BUILT: dict[str, tuple[Callable[[Callable[[str], DataFrame]], DataFrame], str]] = {
    "m_symbols": (
        lambda t: letter_counts(t("documents")),
        """select doc_id, sym, count(*) as n
from (select doc_id, unnest(string_split(regexp_replace(lower(text), '[^a-z]', '', 'g'), '')) as sym from {documents}) t
where sym <> '' group by doc_id, sym""",
    ),
}


def _needs(sql: str) -> list[str]:
    return [n for n in (*TABLES, *BINDINGS, *BUILT) if "{" + n + "}" in sql]


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or one of the media tables made from it."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in BUILT:
        return BUILT[name][0](lambda n: bind(spark, sf_dir, n))
    sql = BINDINGS[name][0]
    return spark.sql(sql, **{n: bind(spark, sf_dir, n) for n in _needs(sql)})


def duck(sql: str) -> str:
    """DuckDB SQL in which ``{m_x}`` stands for a media table: the needed ones go before it."""
    made: dict[str, str] = {}

    def need(text: str) -> str:
        for n in _needs(text):
            if n not in TABLES and n not in made:
                made[n] = need(BUILT[n][1] if n in BUILT else BINDINGS[n][1] or BINDINGS[n][0])
        for n in (*TABLES, *BINDINGS, *BUILT):
            text = text.replace("{" + n + "}", n)
        return text

    body = need(sql)
    if not made:
        return body
    ctes = ",\n".join(f"{n} as ({text})" for n, text in made.items())
    body = body.lstrip()
    for opening in ("with recursive ", "with "):
        if body.startswith(opening):
            return f"{opening}{ctes},\n{body.removeprefix(opening)}"
    return f"with {ctes}\n{body}"
