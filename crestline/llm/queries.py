"""The operators over their whole tables, with production parameters, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import decontam, embed_dedup, licenses, mixing, pii, quality, secrets, toxicity, warc
from crestline.llm.common import read
from crestline.llm.simhash import simhash_components
from crestline.llm.spans import digest


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_sources(read(spark, sf_dir, "documents"), budget_ratio=1.25).rows
    return rows.withColumn("weight", F.round("weight", 9))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pii.pii_spans(read(spark, sf_dir, "documents")), pii.KINDS)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(read(spark, sf_dir, "embeddings"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secrets.secret_spans(read(spark, sf_dir, "documents")), secrets.KINDS)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_digest(licenses.licence_scan(read(spark, sf_dir, "documents")))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_warc_archives": op2_warc_archives,
    "op3_source_mixing": op3_source_mixing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_pii_spans": op5_pii_spans,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_license_scan": op10_license_scan,
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SHINGLES = "case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end"

ORACLE_SQL: dict[str, str] = {
    "op2_warc_archives": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
             f as (select sha256(payload) as d, min(page_id) as first from p where octet_length(payload) >= 100 group by 1)
        select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest,
               case when page_id = first or first is null then 'response' else 'revisit' end as record_type,
               case when page_id = first or first is null then null else first end as refers_to
        from p left join f on sha256(payload) = d and octet_length(payload) >= 100""",
    "op3_source_mixing": r"""
        with t as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+'))::bigint as n_tokens,
                   case when source is null then 'n' else 's' || source end as skey,
                   substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 16) as h from documents),
        s as (select skey, sum(n_tokens)::bigint as tokens, ln(sum(n_tokens)::double) as x from t group by 1 having sum(n_tokens) > 0),
        g as (select count(*) as n, max(x) as top, min(x) as low, floor(sum(tokens) * 1.25)::double as total from s),
        z as (select k, k / 1048576::double as a, sum(exp(k / 1048576::double * (x - top))) as z, sum(x * exp(k / 1048576::double * (x - top))) as zx
              from range(1048577) r(k), s, g group by k),
        e as (select greatest(max(k) filter (ln(z) + a * top - a * zx / z >= 0.95::double * ln(n) - 1e-12),
                              coalesce(min(k) filter (total * exp(a * (low - top) - low) / z <= 4), 1048576)) as k from z, g),
        w as (select skey, tokens, exp(a * (x - top)) / z as weight, floor(exp(a * (x - top)) / z * total + 0.5)::bigint as budget
              from s, g, z where k = (select k from e)),
        b as (select skey, weight, budget // tokens as epochs, budget % tokens as room from w),
        p as (select *, substr(md5('mix:' || epochs || ':' || substr(h, 1, 2)), 1, 8) || substr(h, 1, 2)
                     || substr(md5('mix:' || epochs || ':' || substr(h, 3, 2)), 1, 8) || substr(h, 3, 2)
                     || substr(md5('mix:' || epochs || ':' || substr(h, 5, 2)), 1, 8) || substr(h, 5, 2) || h as place from t join b using (skey)),
        u as (select *, epochs + (sum(n_tokens) over (partition by skey order by place) <= room)::bigint as times from p),
        r as (select doc_id, source, n_tokens, weight, h, unnest(range(times))::bigint as epoch from u)
        select doc_id, source, n_tokens, round(weight, 9) as weight, epoch,
               substr(md5('mix:' || epoch || ':' || substr(h, 1, 2)), 1, 8) || substr(h, 1, 2)
               || substr(md5('mix:' || epoch || ':' || substr(h, 3, 2)), 1, 8) || substr(h, 3, 2)
               || substr(md5('mix:' || epoch || ':' || substr(h, 5, 2)), 1, 8) || substr(h, 5, 2) || h as order_key from r""",
    # every pair; the operator finds them all where a window holds all vectors, as at small scales
    "op6_embedding_near_dedup": """
        with recursive e as (select vec_id, embedding::double[] as x from embeddings),
             ok as (select vec_id, x from e where len(x) > 0 and len(list_filter(x, lambda v: v is null or isnan(v) or isinf(v))) = 0 and len(list_filter(x, lambda v: v <> 0)) > 0),
             li as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.9),
             re(a, b) as (select a, b from li union select re.a, li.b from re join li on re.b = li.a),
             n as (select a as vec_id, count(*) as n_links from li group by 1), c as (select a as vec_id, min(b) as low from re group by 1)
        select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, least(vec_id, coalesce(low, vec_id)) = vec_id as kept
        from e left join n using (vec_id) left join c using (vec_id)""",
    "op7_benchmark_decontamination": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
             i as (select item_id, {_WORDS} as w from benchmark),
             ds as (select doc_id, unnest({_SHINGLES}) as s from d),
             it as (select item_id, {_SHINGLES} as ss from i),
             si as (select item_id, len(ss)::bigint as n_item, unnest(ss) as s from it)
        select doc_id, item_id, count(*)::bigint as n_shared, n_item, count(*)::double / n_item as containment
        from ds join si using (s) group by doc_id, item_id, n_item having count(*) >= 0.8 * n_item - 1e-9""",
}
