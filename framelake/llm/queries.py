"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from . import crf_quality, decontaminate, html_template, media, packing, pii, pu_toxicity, simhash, suffix_dedup, top_k, url_filter, vector_codes, whitening
from .common import table

TOKENIZER = tokenizer_path("word_bpe_49k.json")
Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_features(media.store_texts(table(spark, sf_dir, "documents")))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_pages(table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = packing.word_encoder(TOKENIZER)
    packed = packing.pack(packing.pieces(table(spark, sf_dir, "documents"), encode))
    return packed.withColumn("length", F.col("length").cast("long"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_media_columns": op2_media_columns,
    "op3_html_text": op3_html_text,
    "op4_url_filter": op4_url_filter,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_top_k": op11_top_k,
    "op12_whitening": op12_whitening,
    "op13_vector_codes": op13_vector_codes,
}

OP4_SQL = r"""
with rests as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from (select page_id, coalesce(url, '') as url from pages)),
ends as (
  select page_id, rest, least(coalesce(nullif(strpos(rest, '/'), 0), length(rest) + 1), coalesce(nullif(strpos(rest, '?'), 0), length(rest) + 1),
                              coalesce(nullif(strpos(rest, '#'), 0), length(rest) + 1)) as h from rests),
tails as (
  select page_id, translate(substr(rest, 1, h - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(rest, h) as tail from ends),
parts as (
  select page_id, host, substr(tail, 1, least(coalesce(nullif(strpos(tail, '?'), 0), length(tail) + 1),
                                              coalesce(nullif(strpos(tail, '#'), 0), length(tail) + 1)) - 1) as path from tails),
site(rule, verdict) as (values ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'block'),
                               ('example.net/de/8', 'block'), ('org/es/', 'block')),
words(word) as (values ('cheap-pills'), ('casino-win'), ('free-bets'), ('spam-farm'), ('ads-track'), ('link-farm'),
                       ('click-bait'), ('adult-cams'), ('payday-loans'), ('warez-zone')),
best as (
  select host, path, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict
  from (select distinct host, path from parts) u join site s
    on ends_with('.' || host, '.' || split_part(rule, '/', 1)) and starts_with(path, substr(rule, strpos(rule, '/')))
  group by host, path),
spam as (
  select distinct host from (select distinct host from parts) h join words w
    on regexp_matches(host, '(^|[^a-z0-9])' || replace(word, '-', '[^a-z0-9]') || '([^a-z0-9]|$)', 's'))
select p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, case when s.host is not null then 'block' else 'allow' end) as verdict
from parts p left join best b on p.host = b.host and p.path = b.path left join spam s on p.host = s.host
"""

FINITE = "embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0"

OP11_SQL = f"""
with v as (select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) as v from embeddings where {FINITE}),
scores as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
           from v q join v c on q.vec_id % 50 = 0 and q.vec_id is distinct from c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id nulls last)::int as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def _op13_sql() -> str:
    """Codebooks and assignments of each round, one after the other."""
    far = "list_dot_product(a.part, a.part) - 2 * list_dot_product(a.part, b.c) + list_dot_product(b.c, b.c)"
    steps = []
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""near{k} as materialized (
  select n, p, any_value(vec_id) as vec_id, any_value(label) as label, any_value(part) as part, min(struct_pack(d := d, e := e)) as best
  from (select a.*, {far} as d, b.e from parts a join book{k} b on a.p = b.p) group by n, p)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""book{k + 1} as materialized (
  select b.p, b.e, coalesce(m.c, b.c) as c from book{k} b left join (
    select p, e, list(x order by i) as c from (
      select p, best.e as e, i, floor(sum(part[i]) / count(*)) as x from near{k}, range(1, 1 + len(part)) r(i) group by p, best.e, i) group by p, e) m
  on b.p = m.p and b.e = m.e)""")
    last = vector_codes.ROUNDS
    return f"""
with x as (select row_number() over (order by vec_id) as n, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::double)) as v from embeddings where {FINITE}),
parts as materialized (select n, vec_id, label, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] as part from x, range(4) r(p)),
book0 as materialized (select p, n - 1 as e, part as c from parts where n <= 256),
{", ".join(steps)},
coded as (select n, any_value(vec_id) as vec_id, any_value(label) as label, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from near{last} group by n),
hashed as (select sha256(string_agg(y::bigint::varchar, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, i, c[i] as y from book{last}, range(1, 1 + len(c)) r(i)))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, hashed
"""


ORACLE_SQL: dict[str, str] = {"op4_url_filter": OP4_SQL, "op11_top_k": OP11_SQL, "op13_vector_codes": _op13_sql()}
