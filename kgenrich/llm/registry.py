"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (centroids, decontam, kdshard, langid, linededup, mixing, neardup, quality, secrets, suffixdedup, topk,
               url_filter, whitening)
from .common import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_line_dedup")
def op1(spark, sf):
    return linededup.line_dedup(read(spark, sf, "documents"))


@register("op2_minhash_near_dedup")
def op2(spark, sf):
    return neardup.near_duplicates(read(spark, sf, "documents"))


@register("op3_decontamination", rf"""
with dw as (select doc_id, coalesce(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents),
iw as (select item_id, regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
win as (select distinct item_id, list_slice(ws, i, i + 12) as g from (select item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) as i from iw where len(ws) > 0)),
lens as (select distinct len(g) as l from win),
occ as (select d.doc_id, d.i, len(w.g) as l, w.item_id from
  (select doc_id, i, list_slice(ws, i, i + l - 1) as g from (select doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) as i from dw, lens)) d
  join win w on d.g = w.g),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from occ) group by doc_id)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.ws) as contaminated
from dw d left join hit using (doc_id) left join its using (doc_id)""")
def op3(spark, sf):
    return decontam.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark")).drop("row_key")


@register("op4_kd_sharding")
def op4(spark, sf):
    s = kdshard.kd_shards(read(spark, sf, "documents"), n_shards=24)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op5_secret_scan")
def op5(spark, sf):
    return secrets.scan(read(spark, sf, "documents"))


@register("op6_exact_top_k", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
e as (select vec_id, unnest(q) as x, unnest(range(len(q))) as i from v),
s as (select a.vec_id as query_id, b.vec_id, cast(sum(a.x * b.x) as bigint) as score from e a join e b on a.i = b.i and a.vec_id <> b.vec_id
  where a.vec_id % 50 = 0 group by a.vec_id, b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5""")
def op6(spark, sf):
    v = read(spark, sf, "embeddings")
    return topk.top_k(v, v.where("vec_id % 50 = 0"), k=5)


@register("op7_url_filter", f"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UP}', '{LOW}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select *, case
  when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from h)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from m""")
def op7(spark, sf):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_filter.judge(read(spark, sf, "pages").select("page_id", "url"), rules) \
        .select("page_id", "host", "path", "rule", "verdict")


@register("op8_source_mixing")
def op8(spark, sf):
    return mixing.taken_words(read(spark, sf, "documents"))


HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"


@register("op9_language_id")
def op9(spark, sf):
    docs = read(spark, sf, "documents").withColumn("held_out", F.coalesce(F.expr(HELD_OUT), F.lit(False)))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"])


@register("op10_suffix_array_dedup")
def op10(spark, sf):
    return suffixdedup.suffix_dedup(read(spark, sf, "documents"))


def kmeans_sql(rounds: int = 10, k: int = 8) -> str:
    """The clustering contract in DuckDB: one row per vector and component, every round a CTE."""
    nearest = """select vec_id, min(c) as c, min(d) as d from (select vec_id, c, d, rank() over (partition by vec_id order by d, c) as r
  from (select e.vec_id, o.c, sum((e.x - o.x) * (e.x - o.x)) as d from e join c{r} o on e.i = o.i group by e.vec_id, o.c)) where r = 1 group by vec_id"""
    parts = [f"""e as materialized (select vec_id, unnest(range(64)) as i, unnest(list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint))) as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             f"""c0 as materialized (select f.c, e.i, e.x from e join (select vec_id, row_number() over (order by sha256('3:' || vec_id)) - 1 as c
  from (select distinct vec_id from e)) f on e.vec_id = f.vec_id where f.c < {k})"""]
    for r in range(rounds):
        parts.append(f"a{r} as materialized ({nearest.format(r=r)})")
        parts.append(f"""m{r} as materialized (select c, i, (s - ((s % n) + n) % n) // n as x from
  (select a.c, e.i, sum(e.x) as s, count(*) as n from a{r} a join e on a.vec_id = e.vec_id group by a.c, e.i))""")
        parts.append(f"c{r + 1} as materialized (select * from m{r} union all select * from c{r} where c not in (select c from m{r}))")
    parts.append(f"z as materialized ({nearest.format(r=rounds)})")
    return "with " + ",\n".join(parts) + f"""
select z.vec_id, cast(z.c as int) as cluster, cast(z.d as bigint) as distance, cast(sum(z.d) over (partition by z.c) as bigint) as cluster_inertia,
  cast(sum(z.d) over () as bigint) as inertia, h.h as centroid_sha256
from z join (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as h from c{rounds} group by c) h on z.c = h.c"""


@register("op11_centroid_clusters", kmeans_sql())
def op11(spark, sf):
    return centroids.centroid_clusters(read(spark, sf, "embeddings"))


@register("op12_embedding_whitening")
def op12(spark, sf):
    return whitening.whiten(read(spark, sf, "embeddings"))


@register("op13_quality_rules")
def op13(spark, sf):
    return quality.quality_rules(read(spark, sf, "documents"), read(spark, sf, "labels"))


@register("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)
