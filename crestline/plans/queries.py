"""Every operator of the engine as a query over the driver's tables, and the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.config import AnomalyConfig, Config, DedupConfig, SnapshotConfig, WindowConfig
from crestline.functions.text import identity, normalize_query
from crestline.operators import dedup, panes, stoplist, topk
from crestline.operators.anomaly import anomaly_flags, ewma_at, ewma_history
from crestline.operators.events import normalize, with_reject_reason
from crestline.operators.snapshot import first
from crestline.plans.trending import classify, since_us, trending, valid_events
from crestline.sources.events import decode_json, encode_json, user_events
from crestline.sources.generator import generate_events
from crestline.sources.storage import scratch
from crestline.streaming.dedup import drop_repeats_stream
from crestline.streaming.metrics import bucket_of
from crestline.streaming.trending import build_snapshot, read_panes, start_panes, valid_stream, windowed_panes

HOUR = 3600
AS_OF = 1_705_708_800_000_000  # 2024-01-20, UTC
#: the tables' events are sparse, so hours stand where a live stream has seconds
CFG = Config(
    max_age_s=24 * HOUR,
    window=WindowConfig(24 * HOUR, HOUR),
    dedup=DedupConfig(6 * HOUR, 3),
    anomaly=AnomalyConfig(bucket_s=HOUR, threshold=2.0, min_age_s=24 * HOUR, ttl_s=240 * HOUR),
    snapshot=SnapshotConfig(max_size=50),
)
#: events may be twice as old as the window, so that some come too late for it
TWO_DAYS = replace(CFG, max_age_s=48 * HOUR)
STOP = ["purchase", " K13 ", "42", "7", " \t "]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, query: str = "event_type", first_us: int | None = None, last_us: int | None = None) -> DataFrame:
    return user_events(table(spark, sf_dir, "events"), query, first_us, last_us)


def recent(spark: SparkSession, sf_dir: str, query: str, cfg: Config = CFG) -> DataFrame:
    """The events that a snapshot at AS_OF can depend on."""
    return events(spark, sf_dir, query, since_us(cfg, AS_OF)[1], AS_OF)


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with every fault of validation in them, by the number of the event."""
    n = F.col("event_id").cast("long")
    rows = events(spark, sf_dir)
    nobody = n % 79 == 0
    return rows.select(
        F.when(n % 97 == 0, "").otherwise(F.col("event_id")).alias("event_id"),
        F.when(n % 73 == 0, F.unhex(F.lit("FFFEFD")).cast("string")).when(n % 89 == 0, " \t ").when(n % 83 == 0, F.repeat(F.lit("x"), 257)).otherwise(F.concat(F.lit("  "), F.upper("query"), F.lit("\t\n Z "))).alias("query"),
        F.when(nobody, " ").otherwise(F.col("user_id")).alias("user_id"),
        F.when(nobody, "").otherwise(F.col("session_id")).alias("session_id"),
        "timestamp",
    )


def _valid(spark: SparkSession, sf_dir: str, query: str = "event_type") -> DataFrame:
    return valid_events(events(spark, sf_dir, query), CFG)


def _panes(spark: SparkSession, sf_dir: str, query: str = "event_type") -> DataFrame:
    return panes.pane_counts(_valid(spark, sf_dir, query), CFG.window.pane_us)


def _stop(spark: SparkSession) -> DataFrame:
    return stoplist.normalised(spark.createDataFrame([(w,) for w in STOP], "word string"))


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = normalize_query(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("query"), F.length(text).cast("long").alias("chars"), (F.length(text) > CFG.max_query_chars).alias("too_long"))


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_reject_reason(dirty_events(spark, sf_dir), AS_OF, round(CFG.max_age_s * 1e6), CFG.max_query_chars)
    return rows.select("event_id", "ts_us", "identity", F.coalesce("reject_reason", F.lit("ok")).alias("reason"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty_events(spark, sf_dir).withColumn("malformed", F.col("event_id").endswith("7") & F.col("event_id").startswith("1"))
    return classify(rows, TWO_DAYS, AS_OF).groupBy("status").agg(F.count("*").alias("n"))


def identity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(identity(F.col("user_id"), F.col("session_id")).alias("identity")).agg(F.count("*").alias("n"))


def dedup_rotating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_repeats(_valid(spark, sf_dir), CFG.dedup.rotation_us, CFG.dedup.rotations)


def dedup_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.mark_repeats(_valid(spark, sf_dir), CFG.dedup.rotation_us, CFG.dedup.rotations).select("event_id", "repeat")


def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = dedup.first_touches(_valid(spark, sf_dir), CFG.dedup.rotation_us, CFG.dedup.rotations)
    kept = F.count_if("keep")
    return heads.groupBy("query").agg(kept.alias("kept"), (F.sum("touches") - kept).alias("repeats"), F.count_distinct("identity").alias("identities"))


def pane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panes(spark, sf_dir)


def window_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(panes.window_counts(_panes(spark, sf_dir, "k"), AS_OF, CFG.window.size_us), 25)


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.sliding_counts(_panes(spark, sf_dir), CFG.window.size_us, CFG.window.pane_us)


def pane_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.pane_top_k(_panes(spark, sf_dir, "k"), 3)


def merge_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    guest = F.col("user_id") == ""
    rows = _valid(spark, sf_dir)
    return panes.merge_panes(panes.pane_counts(rows.where(guest), CFG.window.pane_us), panes.pane_counts(rows.where(~guest), CFG.window.pane_us))


def expire_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.expire(_panes(spark, sf_dir), AS_OF, CFG.window.size_us)


def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ewma_at(_panes(spark, sf_dir), AS_OF, CFG.anomaly).select("query", F.round("ewma", 6).alias("ewma"), "current", "first_us", "last_us")


def ewma_by_pane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ewma_history(_panes(spark, sf_dir), CFG.anomaly).select("query", "pane_us", "cnt", F.round("ewma", 6).alias("ewma"))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly_flags(_panes(spark, sf_dir, "k"), AS_OF, CFG.anomaly).select("query", F.round("ewma", 6).alias("ewma"), "current", "anomaly")


def stoplist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stoplist.exclude(panes.window_counts(_panes(spark, sf_dir, "k"), AS_OF, CFG.window.size_us), _stop(spark))


def stoplist_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation")
    stop = stoplist.add(_stop(spark), names.select("n_name"))
    return stoplist.listed(stoplist.remove(stop, names.where("n_regionkey = 1").select("n_name")))


def trending_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending(recent(spark, sf_dir, "k"), AS_OF, CFG, _stop(spark))


def trending_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first(trending(recent(spark, sf_dir, "k"), AS_OF, CFG, _stop(spark)), 10)


def topk_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.sketch_top_k(_valid(spark, sf_dir, "k"), 20, 10_000)


def topk_space_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.space_saving(_valid(spark, sf_dir, "k"), 1000, 100)


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value is not null").groupBy(bucket_of(F.col("value"), 1e-3, 24).alias("bucket")).agg(F.count("*").alias("n"))


def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages, some of them spoilt, decoded again."""
    n, text = F.col("event_id").cast("long"), encode_json(events(spark, sf_dir))
    spoilt = F.when(n % 11 == 0, F.concat(text, F.lit(" x"))).when(n % 13 == 0, F.lit('{"query":5}')).when(n % 17 == 0, F.lit("[]")).otherwise(text)
    decoded = decode_json(events(spark, sf_dir).select(n.alias("n"), spoilt.alias("value")))
    return decoded.select("n", "event_id", "query", "user_id", "session_id", F.unix_micros("timestamp").alias("ts_us"), "malformed")


def generated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generate_events(spark, 20_000, AS_OF, bot_share=0.3, seed=7)
    return made.groupBy("query").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


# ---- streams: files replayed to their end give the batch results -------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, query: str = "event_type") -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    files = f"{sf_dir}/events.parquet*"  # a stream's path must be a folder or a pattern
    return user_events(spark.readStream.schema(schema).parquet(files), query)


def _run(writer, path: str) -> None:
    done = writer.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    done.awaitTermination()


def stream_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "panes")
    start_panes(valid_stream(_stream(spark, sf_dir), CFG, clock=False), path, f"{path}-state", CFG.window.pane_us, availableNow=True).awaitTermination()
    return read_panes(spark, path)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "unique")
    rows = normalize(_stream(spark, sf_dir)).select("identity", "query", "event_id", "ts_us", "timestamp")
    unique = drop_repeats_stream(rows, CFG.dedup.rotation_us, CFG.dedup.rotations, "10 days")
    _run(unique.writeStream.format("parquet").outputMode("append").option("path", path), path)
    return spark.read.schema(unique.schema).parquet(path).select("identity", "query", "ts_us", "event_id")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode gives panes once they are complete; what the watermark has not passed is not among them."""
    path = scratch(spark, "windows")
    out = windowed_panes(valid_stream(_stream(spark, sf_dir), CFG, clock=False), "1 hour", "5 minutes")
    _run(out.writeStream.format("parquet").outputMode("append").option("path", path), path)
    return spark.read.schema(out.schema).parquet(path)


def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panes written by a stream, ranked at one point in time."""
    path = scratch(spark, "live")
    start_panes(valid_stream(_stream(spark, sf_dir, "k"), CFG, clock=False), path, f"{path}-state", CFG.window.pane_us, availableNow=True).awaitTermination()
    return spark.createDataFrame(build_snapshot(spark, path, AS_OF, CFG, _stop(spark)), "query string, count long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_documents": normalize_documents, "reject_reasons": reject_reasons, "status_counts": status_counts, "identity_key": identity_key,
    "dedup_rotating": dedup_rotating, "dedup_marked": dedup_marked, "dedup_stats": dedup_stats, "pane_counts": pane_counts, "window_topk": window_topk,
    "sliding_counts": sliding_counts, "pane_topk": pane_topk, "merge_panes": merge_panes, "expire_panes": expire_panes, "ewma_at": ewma,
    "ewma_history": ewma_by_pane, "anomaly_flags": anomalies, "stoplist_filter": stoplist_filter, "stoplist_edit": stoplist_edit,
    "trending_snapshot": trending_snapshot, "trending_limit": trending_limit, "topk_sketch": topk_sketch, "topk_space_saving": topk_space_saving,
    "latency_histogram": latency_histogram, "json_events": json_events, "generated_events": generated_events, "stream_panes": stream_panes,
    "stream_dedup": stream_dedup, "stream_windows": stream_windows, "stream_snapshot": stream_snapshot,
}

# ---- the same in SQL ---------------------------------------------------------------------------------------------

_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DAY = 24 * HOUR * 1_000_000
_ROT = CFG.dedup.rotation_us


def _norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')"


def _ev(query: str = "event_type") -> str:
    key = "event_type" if query == "event_type" else "json_extract_string(props, '$.k')"
    return f"""ev as (select event_id, event_id::varchar as id, {_norm(key)} as query, epoch_us(ts) as ts_us,
        case when user_id % 10 = 0 then 's:s' || user_id else 'u:' || user_id end as identity from events),
        va as (select * from ev where query <> '' and length(query) <= 256)"""


def _pn(source: str = "va", name: str = "pn") -> str:
    return f"{name} as (select query, ts_us - ts_us % {CFG.window.pane_us} as pane_us, count(*) as cnt, min(ts_us) as first_us, max(ts_us) as last_us from {source} group by 1, 2)"


_DD = f"""dd as (select *, lag(ts_us // {_ROT}) over (partition by identity, query order by ts_us, id) as before from va),
        un as (select identity, query, ts_us, id, before is null or ts_us // {_ROT} - before >= {CFG.dedup.rotations} as keep from dd)"""
_WC = f"wc as (select query, sum(cnt)::bigint as cnt from pn where pane_us > {AS_OF - CFG.window.size_us} and pane_us <= {AS_OF} group by 1)"
_TTL = round(CFG.anomaly.ttl_s * 1e6)


def _ew(source: str) -> str:
    a = CFG.anomaly.alpha
    return f"""g1 as (select *, pane_us // {CFG.anomaly.bucket_us} as i, case when first_us - lag(last_us) over (partition by query order by pane_us) > {_TTL} then 1 else 0 end as fresh
                   from {source} where pane_us <= {AS_OF}),
        g2 as (select *, sum(fresh) over (partition by query order by pane_us) as life from g1),
        g3 as (select *, max(life) over (partition by query) as top, max(i) over (partition by query) as last from g2),
        ew as (select query, sum(case when i < last then {a}::double * pow({1 - a}::double, last - 1 - i) * cnt else 0 end) as ewma,
                      sum(case when i = last then cnt else 0 end)::bigint as current, min(first_us) as first_us, max(last_us) as last_us
               from g3 where life = top group by query)"""


_FLAG = f"{AS_OF} - first_us >= {round(CFG.anomaly.min_age_s * 1e6)} and {AS_OF} - last_us <= {_TTL} and ewma >= 1 and current > ewma * {CFG.anomaly.threshold}::double"
_ST = "st as (select * from (values " + ", ".join(f"('{w.strip().lower()}')" for w in STOP if w.strip()) + ") t(word))"
_DIRTY = """dy as (select event_id as n, case when event_id % 97 = 0 then '' else event_id::varchar end as event_id,
        case when event_id % 73 = 0 then 'invalid' when event_id % 89 = 0 then '' when event_id % 83 = 0 then repeat('x', 257) else event_type || ' z' end as query,
        case when event_id % 79 = 0 then 's:' when user_id % 10 = 0 then 's:s' || user_id else 'u:' || user_id end as identity, epoch_us(ts) as ts_us from events)"""
_REASON = f"""case when event_id = '' then 'empty_event_id' when query = '' then 'empty_query' when n % 73 = 0 then 'invalid_utf8' when length(query) > 256 then 'query_too_long'
        when identity = 's:' then 'no_identifier' when ts_us > {AS_OF} then 'future_time' when {AS_OF} - ts_us > {_DAY} then 'stale_event' else 'ok' end"""
_SNAP = f"""{_ev("k")}, {_DD}, uk as (select * from un where keep and ts_us <= {AS_OF}), {_pn("uk")}, {_ew("pn")},
        uw as (select * from uk where ts_us > {AS_OF - CFG.window.size_us}), {_pn("uw", "pw")}, {_ST},
        wc as (select query, sum(cnt)::bigint as cnt from pw where pane_us > {AS_OF - CFG.window.size_us} and pane_us <= {AS_OF} group by 1),
        ca as (select * from wc order by cnt desc, query limit {CFG.snapshot.max_size * CFG.snapshot.candidate_factor}),
        sc as (select ca.query, coalesce({_FLAG}, false) as anomaly, cnt * case when coalesce({_FLAG}, false) then {CFG.snapshot.penalty}::double else 1.0::double end as score
               from ca left join ew using (query) where ca.query not in (select word from st)),
        sn as (select query, trunc(score)::bigint as count, score, anomaly from sc order by score desc, query limit {CFG.snapshot.max_size})"""



def _uniform_sql(name: str, seed: int = 7) -> str:
    return f"('0x' || substr(md5('{name}-{seed}-' || i), 1, 13))::bigint / 4503599627370496::double"


ORACLE_SQL: dict[str, str] = {
    "normalize_documents": f"select doc_id, {_norm('text')} as query, length({_norm('text')})::bigint as chars, length({_norm('text')}) > 256 as too_long from documents",
    "reject_reasons": f"with {_DIRTY} select event_id, ts_us, identity, {_REASON} as reason from dy",
    "status_counts": f"""with {_DIRTY}, rs as (select *, event_id like '1%7' as malformed, {_REASON.replace(str(_DAY), str(2 * _DAY))} as reason from dy),
        ok as (select *, lag(ts_us // {_ROT}) over (partition by identity, query order by ts_us, event_id) as before from rs where reason = 'ok' and not malformed),
        al as (select case when not (before is null or ts_us // {_ROT} - before >= {CFG.dedup.rotations}) then 'dropped_dedup'
                           when ts_us > {AS_OF} or {AS_OF} - ts_us >= {CFG.window.size_us} then 'dropped_stale' else 'ok' end as status from ok
               union all select case when malformed then 'dropped_unmarshal' else 'dropped_validation' end from rs where reason <> 'ok' or malformed)
        select status, count(*) as n from al group by 1""",
    "identity_key": f"with {_ev()} select identity, count(*) as n from ev group by 1",
    "dedup_rotating": f"with {_ev()}, {_DD} select identity, query, ts_us, id as event_id from un where keep",
    "dedup_marked": f"with {_ev()}, {_DD} select id as event_id, not keep as repeat from un",
    "dedup_stats": f"with {_ev()}, {_DD} select query, count(*) filter (keep) as kept, count(*) filter (not keep) as repeats, count(distinct identity) as identities from un group by 1",
    "pane_counts": f"with {_ev()}, {_pn()} select * from pn",
    "window_topk": f"with {_ev('k')}, {_pn()}, {_WC} select * from wc order by cnt desc, query limit 25",
    "sliding_counts": f"""with {_ev()}, {_pn()} select query, pane_us, (sum(cnt) over (partition by query order by pane_us
        range between {CFG.window.size_us - CFG.window.pane_us} preceding and current row))::bigint as window_cnt from pn""",
    "pane_topk": f"""with {_ev('k')}, {_pn()}, rk as (select pane_us, query, cnt, row_number() over (partition by pane_us order by cnt desc, query)::int as rank from pn)
        select * from rk where rank <= 3""",
    "merge_panes": f"with {_ev()}, {_pn()} select * from pn",
    "expire_panes": f"with {_ev()}, {_pn()} select * from pn where pane_us > {AS_OF - CFG.window.size_us}",
    "ewma_at": f"with {_ev()}, {_pn()}, {_ew('pn')} select query, round(ewma, 6) as ewma, current, first_us, last_us from ew",
    "ewma_history": f"""with {_ev()}, {_pn()}, nu as (select *, pane_us // {CFG.anomaly.bucket_us} as i from pn)
        select a.query, a.pane_us, a.cnt, round(coalesce(sum({CFG.anomaly.alpha}::double * pow({1 - CFG.anomaly.alpha}::double, a.i - 1 - b.i) * b.cnt), 0), 6) as ewma
        from nu a left join nu b on a.query = b.query and b.i < a.i group by 1, 2, 3""",
    "anomaly_flags": f"with {_ev('k')}, {_pn()}, {_ew('pn')} select query, round(ewma, 6) as ewma, current, {_FLAG} as anomaly from ew",
    "stoplist_filter": f"with {_ev('k')}, {_pn()}, {_WC}, {_ST} select * from wc where query not in (select word from st)",
    "stoplist_edit": f"with {_ST} select word from (select word from st union select lower(n_name) from nation) where word not in (select lower(n_name) from nation where n_regionkey = 1)",
    "trending_snapshot": f"with {_SNAP} select * from sn",
    "trending_limit": f"with {_SNAP} select query, count from sn order by score desc, query limit 10",
    "topk_sketch": f"with {_ev('k')} select query, count(*) as cnt from va group by 1 order by 2 desc, 1 limit 20",
    "topk_space_saving": f"with {_ev('k')} select query, count(*) as cnt, 0::bigint as error from va group by 1 order by 2 desc, 1 limit 100",
    "latency_histogram": "select (" + " + ".join(f"case when value > {1e-3 * 2**i!r}::double then 1 else 0 end" for i in range(24)) + ")::bigint as bucket, count(*) as n from events where value is not null group by 1",
    "json_events": """with b as (select event_id as n, event_id % 11 = 0 or event_id % 13 = 0 or event_id % 17 = 0 as malformed, * from events)
        select n, case when malformed then '' else event_id::varchar end as event_id, case when malformed then '' else event_type end as query,
               case when malformed or user_id % 10 = 0 then '' else user_id::varchar end as user_id,
               case when not malformed and user_id % 10 = 0 then 's' || user_id else '' end as session_id,
               case when not malformed then epoch_us(ts) end as ts_us, malformed from b""",
    "generated_events": f"""with ra as (select i as rank, pow(1 + i, -1.2::double) as w from range(5000) t(i)),
        cu as (select rank, sum(w) over (order by rank) as hi from ra),
        zi as (select rank, coalesce(lag(hi) over (order by rank), 0) / (select max(hi) from cu) as lo from cu),
        ge as (select i as id, {_uniform_sql("query")} as u, {_uniform_sql("bot")} < 0.3 as bot, {_uniform_sql("who")} as who from range(20000) t(i)),
        na as (select ge.*, zi.rank from ge asof join zi on ge.u >= zi.lo)
        select case when bot then 'fake-trend' else 'query-' || rank end as query, count(*) as n,
               count(distinct case when bot then 'bot-' || floor(who * 20)::bigint else 'user-' || floor(who * 50000)::bigint end) as users from na group by 1""",
    "stream_panes": f"with {_ev()}, {_pn()} select * from pn",
    "stream_dedup": f"with {_ev()}, {_DD} select identity, query, ts_us, id as event_id from un where keep",
    "stream_windows": f"""with {_ev()}, {_pn()} select query, pane_us, cnt from pn
        where pane_us + {CFG.window.pane_us} <= (select max(ts_us) from ev) - 300000000""",
    "stream_snapshot": f"""with {_ev("k")}, {_pn()}, {_ew("pn")}, {_ST}, {_WC},
        ca as (select * from wc order by cnt desc, query limit {CFG.snapshot.max_size * CFG.snapshot.candidate_factor}),
        sc as (select ca.query, cnt * case when coalesce({_FLAG}, false) then {CFG.snapshot.penalty}::double else 1.0::double end as score
               from ca left join ew using (query) where ca.query not in (select word from st))
        select query, trunc(score)::bigint as count from sc order by score desc, query limit {CFG.snapshot.max_size}""",
}
