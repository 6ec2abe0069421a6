"""Operators under the conditions that the plain queries do not meet: bursts, pauses, full summaries, late and future events,
restarts, and the parts of the service; each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

import io
import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.config import AnomalyConfig, Config, DedupConfig, SnapshotConfig, WindowConfig
from crestline.functions.text import csv_values, ring_index
from crestline.logs import configure
from crestline.operators import bloom, panes, stoplist, topk
from crestline.operators.anomaly import anomaly_flags, ewma_at, ewma_history
from crestline.operators.snapshot import first, limit_of, scored
from crestline.plans import queries as Q
from crestline.plans.queries import AS_OF, CFG, HOUR
from crestline.plans.trending import trending, valid_events
from crestline.sources.events import decode_messages, encode_messages, user_events
from crestline.sources.storage import scratch
from crestline.streaming.dedup import drop_repeats_closed
from crestline.streaming.live import start
from crestline.streaming.metrics import Metrics, ProgressListener, lag_of
from crestline.streaming.serve import Service, StopWords
from crestline.streaming.trending import SnapshotHolder, compact, read_panes, start_panes, valid_stream, windowed_panes

_H = HOUR * 1_000_000
SLOW = replace(CFG, anomaly=replace(CFG.anomaly, alpha=0.01))
BRIEF = replace(CFG, anomaly=replace(CFG.anomaly, ttl_s=3 * HOUR))
SMALL = replace(CFG, snapshot=SnapshotConfig(max_size=2, candidate_factor=2))
SLOTS = 24
BLOOM_KEYS, BLOOM_SHARE = 500, 0.05
CAPACITY = 200

# ---- bursts: every event four times, and eighty times in the hour before the snapshot for two of the types -----------


def burst_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.events(spark, sf_dir, last_us=AS_OF)
    hot = F.col("query").isin("purchase", "click") & (F.unix_micros("timestamp") > AS_OF - _H)
    many = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(hot, F.lit(83)).otherwise(F.lit(4)))))
    return many.withColumn("user_id", F.concat_ws("-", F.lit("b"), "event_id", F.col("i").cast("string"))).drop("i")


def _burst_panes(spark: SparkSession, sf_dir: str, cfg: Config = CFG) -> DataFrame:
    return panes.pane_counts(valid_events(burst_events(spark, sf_dir), cfg), cfg.window.pane_us)


def burst_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly_flags(_burst_panes(spark, sf_dir), AS_OF, CFG.anomaly).select("query", F.round("ewma", 6).alias("ewma"), "current", "anomaly")


def burst_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trending(burst_events(spark, sf_dir), AS_OF, CFG)


def burst_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates are cut before stop words go, so fewer than max_size can be left."""
    flags = anomaly_flags(_burst_panes(spark, sf_dir), AS_OF, CFG.anomaly)
    counts = panes.window_counts(_burst_panes(spark, sf_dir), AS_OF, CFG.window.size_us)
    return scored(counts, SMALL.snapshot, flags, Q._stop(spark)).select("query", "score", "anomaly")


def trending_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No stop-list, no repeats dropped, no bursts looked for."""
    return trending(Q.recent(spark, sf_dir, "k"), AS_OF, CFG, None, dedup=False, anomaly=False)


def trending_fresh_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline sees only events that the window admits."""
    return trending(burst_events(spark, sf_dir), AS_OF, replace(CFG, anomaly=replace(CFG.anomaly, include_stale=False)))


# ---- pauses and long memories ----------------------------------------------------------------------------------------


def ewma_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses longer than the time to live begin a new life; queries silent for longer are forgotten."""
    known = ewma_at(Q._panes(spark, sf_dir, "k"), AS_OF, BRIEF.anomaly)
    return known.select("query", F.round("ewma", 6).alias("ewma"), "current", "first_us", "last_us", (F.col("last_us") >= AS_OF - 3 * _H).alias("alive"))


def ewma_slow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ewma_history(Q._panes(spark, sf_dir, "k"), SLOW.anomaly).select("query", "pane_us", "cnt", F.round("ewma", 6).alias("ewma"))


def ewma_last_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the greatest alpha the mean is the count of the pane before."""
    return ewma_history(Q._panes(spark, sf_dir), AnomalyConfig(bucket_s=HOUR, alpha=1.0)).select("query", "pane_us", "cnt", "ewma")


def window_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither future events nor those as old as the window."""
    rows = Q._valid(spark, sf_dir).withColumn("status", F.when(F.col("ts_us") > AS_OF, "future").when(F.lit(AS_OF) - F.col("ts_us") >= CFG.window.size_us, "too_old").otherwise("admitted"))
    taken = panes.admitted(rows, AS_OF, CFG.window.size_us).groupBy("query").agg(F.count("*").alias("taken"), F.count_if(F.col("status") != "admitted").alias("wrong"))
    return rows.groupBy("query", "status").agg(F.count("*").alias("n")).join(taken, "query")


# ---- rings and filters -----------------------------------------------------------------------------------------------


def ring_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panes.latest_in_ring(Q._panes(spark, sf_dir), CFG.window.pane_us, SLOTS).select("slot", "query", "pane_us", "cnt")


def ring_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also before 1970."""
    us = F.col("ts_us") - F.lit(AS_OF)
    return Q._valid(spark, sf_dir).select("event_id", ring_index(us, CFG.window.pane_us, SLOTS).alias("slot"))


_SIZES = ((1, 0.5), (1, 0.99), (500, 0.05), (10_000, 0.01), (333_333, 0.01), (1_000_000, 0.001))


def bloom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, p, *bloom.bloom_size(n, p)) for n, p in _SIZES], "n long, share double, bits long, hashes long")


def _bloom(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    bits, hashes = bloom.bloom_size(BLOOM_KEYS, BLOOM_SHARE)
    rows = Q.events(spark, sf_dir).withColumn("n", F.col("event_id").cast("long")).where(f"n < {4 * BLOOM_KEYS}")
    a, b = (bloom.bloom_filter(rows.where(f"n < {BLOOM_KEYS} and n % 2 = {k}"), F.col("event_id"), bits, hashes) for k in (0, 1))
    return rows, bloom.merge_filters(a, b, bloom.reset(a)), a, bits, hashes


def bloom_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter of half of the keys, merged with that of the other half and an empty one."""
    return _bloom(spark, sf_dir)[1]


def bloom_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, both, _, bits, hashes = _bloom(spark, sf_dir)
    return bloom.seen_keys(rows, F.col("event_id"), both, bits, hashes)


# ---- summaries that are full -----------------------------------------------------------------------------------------


def crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven queries with a third of all events, and as many others as there are events left."""
    n = F.col("event_id").cast("long")
    return Q.events(spark, sf_dir).select(F.when(n % 3 == 0, F.concat(F.lit("hot"), (n % 7).cast("string"))).otherwise(F.concat(F.lit("cold"), n.cast("string"))).alias("query"))


def _with_truth(found: DataFrame, rows: DataFrame, inside) -> DataFrame:
    """(query, true_cnt, found, inside) of the queries with more than a share of 1 / CAPACITY."""
    total = rows.count()
    true = rows.groupBy("query").agg(F.count("*").alias("true_cnt")).where(F.col("true_cnt") > total / CAPACITY)
    return true.join(found, "query", "left").select("query", "true_cnt", F.col("cnt").isNotNull().alias("found"), F.coalesce(inside(total), F.lit(False)).alias("inside"))


def topk_evicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far more keys than places: every frequent key is found, and its true count lies within the bounds."""
    rows = crowded(spark, sf_dir)
    found = topk.space_saving(rows.repartition(7), CAPACITY, CAPACITY, fan_in=3)
    return _with_truth(found, rows, lambda _: (F.col("true_cnt") <= F.col("cnt")) & (F.col("cnt") - F.col("error") <= F.col("true_cnt")))


def sketch_evicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crowded(spark, sf_dir)
    found = topk.sketch_top_k(rows, CAPACITY, 4 * CAPACITY)
    return _with_truth(found, rows, lambda total: F.abs(F.col("cnt") - F.col("true_cnt")) <= total / CAPACITY)


def topk_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of 0 or less gives nothing, whatever finds the largest; one line for each."""
    counts = panes.window_counts(Q._panes(spark, sf_dir), AS_OF, CFG.window.size_us)
    kinds = {"exact": topk.top_k(counts, 0), "negative": topk.top_k(counts, -3), "sketch": topk.sketch_top_k(Q._valid(spark, sf_dir), 0), "summary": topk.space_saving(Q._valid(spark, sf_dir), 10, 0)}
    out = None
    for name, df in kinds.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---- parameters and small functions ----------------------------------------------------------------------------------

_LIMITS = ("", "10", "1", "1000", "0", "1001", "-1", "abc", "1.5", "+7", "99999999999", " 5")


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _LIMITS], "given string").select("given", limit_of(F.col("given")).alias("limit"))


def csv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = Q.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " ,, ").alias("names"))
    return names.select("n_regionkey", F.explode(csv_values(F.concat(F.lit(","), "names", F.lit(", "))))).withColumnRenamed("col", "name")


def stop_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are looked up as they are written: a list holds normalised ones."""
    names = Q.table(spark, sf_dir, "nation")
    stop = stoplist.add(Q._stop(spark), names.where("n_regionkey < 3").select("n_name"))
    return stoplist.contains_all(stop, names.select("n_name").union(names.select(F.lower("n_name"))))


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters from variables, and what is refused."""
    env = {"KAFKA_BROKERS": "a:1, b:2,", "KAFKA_TOPIC": "t", "KAFKA_GROUP_ID": "g", "HTTP_PORT": "81", "LOG_LEVEL": "warn", "LOG_FORMAT": "json", "WINDOW_SIZE": "1m30s", "BUCKET_DURATION": "15s", "SPACE_SAVING_K": "5", "SNAPSHOT_INTERVAL": "250ms", "SNAPSHOT_MAX_SIZE": "7"}
    c, d = Config.from_env(env), Config.from_env({})
    rows = [(who, name, str(value)) for who, x in (("given", c), ("default", d)) for name, value in (
        ("brokers", ";".join(x.brokers)), ("topic", x.topic), ("port", x.http_port), ("level", x.log_level), ("format", x.log_format), ("window_us", x.window.size_us),
        ("pane_us", x.window.pane_us), ("k", x.window.sketch_k), ("interval_ms", round(x.snapshot.interval_s * 1000)), ("max_size", x.snapshot.max_size), ("max_age_s", round(x.max_age_s)),
        ("rotation_us", x.dedup.rotation_us), ("rotations", x.dedup.rotations), ("threshold", x.anomaly.threshold), ("panes", panes.bucket_count(x.window.size_us, x.window.pane_us)))]
    return spark.createDataFrame(rows, "who string, name string, value string")


def _refused(make: Callable[[], object]) -> bool:
    try:
        make()
    except ValueError:
        return True
    return False


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    makers = {
        "capacity": lambda: topk.SpaceSaving(0), "capacity_of_one": lambda: topk.SpaceSaving(1), "pane_of_window": lambda: WindowConfig(300, 7), "window_below_pane": lambda: WindowConfig(5, 10),
        "alpha": lambda: AnomalyConfig(alpha=0), "alpha_of_one": lambda: AnomalyConfig(alpha=1), "threshold": lambda: AnomalyConfig(threshold=1), "penalty": lambda: SnapshotConfig(penalty=0),
        "rotations": lambda: DedupConfig(30, 1), "bloom_keys": lambda: bloom.bloom_size(0, 0.1), "bloom_share": lambda: bloom.bloom_size(5, 1.0), "port": lambda: Config(http_port=0), "brokers": lambda: Config(brokers=()),
    }
    return spark.createDataFrame([(k, _refused(f)) for k, f in makers.items()], "given string, refused boolean")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written at each level and in each format."""
    rows = []
    for level in ("debug", "info", "warn", "error"):
        for kind in ("text", "json"):
            log, out = configure(level, kind), io.StringIO()
            log.handlers[0].setStream(out)
            for say in (log.debug, log.info, log.warning, log.error):
                say("%s and é", say.__name__)
            lines = out.getvalue().splitlines()
            rows.append((level, kind, len(lines), sum(json.loads(x)["msg"].endswith("and é") for x in lines) if kind == "json" else sum(x.endswith("and é") for x in lines)))
    configure()
    return spark.createDataFrame(rows, "level string, kind string, n long, whole long")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the parts hold, and their parameters."""
    summary, words = topk.SpaceSaving(3), StopWords()
    for key in "aabcd":
        summary.add(key)
    for w in Q.STOP:
        words.add(w)
    known = ewma_at(Q._panes(spark, sf_dir), AS_OF, CFG.anomaly).count()
    rows = [("summary_keys", len(summary)), ("summary_capacity", summary.capacity), ("window_panes", panes.bucket_count(CFG.window.size_us, CFG.window.pane_us)), ("stop_words", len(words.list())), ("queries_known", known), ("bloom_bits", bloom.bloom_size(BLOOM_KEYS, BLOOM_SHARE)[0]), ("bloom_hashes", bloom.bloom_size(BLOOM_KEYS, BLOOM_SHARE)[1])]
    return spark.createDataFrame(rows, "name string, n long")


# ---- topics ----------------------------------------------------------------------------------------------------------


def topic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a topic's rows (key, value, topic, partition, offset, timestamp), decoded again; some values are no events."""
    rows = encode_messages(Q.events(spark, sf_dir))
    n = F.expr("cast(string(key) as long)")
    value = F.when(n % 19 == 0, F.lit(None)).when(n % 23 == 0, F.unhex(F.lit("FF00"))).otherwise(F.col("value"))
    topic = rows.select("key", value.alias("value"), F.lit("search.events").alias("topic"), (n % 3).cast("int").alias("partition"), n.alias("offset"), F.current_timestamp().alias("timestamp"))
    return decode_messages(topic).groupBy("malformed", "query").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.min(F.unix_micros("timestamp")).alias("first_us"))


def topic_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread messages from offsets as progress reports them; a partition that was not read yet counts from its start."""
    n = F.col("event_id").cast("long")
    parts = Q.events(spark, sf_dir).groupBy("query", (n % 3).cast("string").alias("p")).agg(F.max(n).alias("latest"), F.max(F.when(n % 5 == 0, n)).alias("done"))
    as_map = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("p", c))))
    ends = parts.groupBy("query").agg(as_map("latest").alias("latest"), as_map("done").alias("done"))
    return ends.select("query", lag_of(F.to_json(F.create_map(F.lit("t"), "done")), F.to_json(F.create_map(F.lit("t"), "latest"))).alias("lag"))


# ---- streams ---------------------------------------------------------------------------------------------------------


def _slices(spark: SparkSession, sf_dir: str, n: int, late_us: int) -> DataFrame:
    """The events as a stream of n files, by time, but each event up to late_us later than it happened."""
    path = scratch(spark, "slices")
    rows = Q.events(spark, sf_dir)
    lo, hi = rows.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    arrival = F.unix_micros("timestamp") + F.pmod(F.xxhash64("event_id"), F.lit(late_us))
    slot = F.least(F.floor((arrival - lo) * n / (hi + late_us - lo)), F.lit(n - 1))
    for k in range(n):  # one after the other, so that they are read in this order
        rows.where(slot == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_dedup_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events up to a day late, in six batches: the repeats are those of the batch plan."""
    from crestline.operators.events import normalize

    path = scratch(spark, "closed")
    rows = normalize(_slices(spark, sf_dir, 6, 24 * _H)).select("identity", "query", "event_id", "ts_us", "timestamp")
    unique = drop_repeats_closed(rows, CFG.dedup.rotation_us, CFG.dedup.rotations, "24 hours")
    Q._run(unique.writeStream.format("parquet").outputMode("append").option("path", path), path)
    return spark.read.schema(unique.schema).parquet(path)


def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopped after each batch, started again from its checkpoint, merged on the way: no event is lost or counted twice."""
    path = scratch(spark, "restarted")
    stream = valid_stream(_slices(spark, sf_dir, 4, _H), CFG, clock=False)

    def then(batch: DataFrame, batch_id: int) -> None:
        compact(spark, path, batch_id, 0)
        if batch_id < 2:
            raise InterruptedError("stopped on purpose")

    for _ in range(3):
        try:
            start_panes(stream, path, f"{path}-state", CFG.window.pane_us, then, availableNow=True).awaitTermination()
        except Exception as e:
            if "stopped on purpose" not in str(e):
                raise
            then = lambda batch, batch_id: compact(spark, path, batch_id, 0)
    return read_panes(spark, path)


def stream_triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that a clock starts, until nothing is left to read."""
    path = scratch(spark, "triggered")
    query = start_panes(valid_stream(_slices(spark, sf_dir, 3, _H), CFG, clock=False), path, f"{path}-state", CFG.window.pane_us)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return read_panes(spark, path)


def stream_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that claim to come from the future go before the watermark sees them, so that no other one is late."""
    path = scratch(spark, "future")
    rows = _slices(spark, sf_dir, 3, 60_000_000)
    ahead = rows.withColumn("timestamp", F.when(F.col("event_id").cast("long") % 50 == 0, F.col("timestamp") + F.expr("interval 1000 days")).otherwise(F.col("timestamp")))
    out = windowed_panes(valid_stream(ahead, replace(CFG, max_age_s=100_000 * HOUR), clock=False, now=F.lit(AS_OF + 400 * 24 * _H)), "1 hour", "5 minutes")
    Q._run(out.writeStream.format("parquet").outputMode("append").option("path", path), path)
    return spark.read.schema(out.schema).parquet(path)


def service_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of the service over a table: what its series say afterwards."""
    path, metrics, stop = scratch(spark, "service"), Metrics(), StopWords()
    for w in Q.STOP:
        stop.add(w)
    schema = Q.table(spark, sf_dir, "events").schema
    stream = user_events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    n = F.col("event_id").cast("long")
    dirty = stream.select(F.when(n % 97 == 0, "").otherwise(F.col("event_id")).alias("event_id"), F.when(n % 89 == 0, " ").otherwise(F.col("query")).alias("query"), "user_id", "session_id", "timestamp", (n % 101 == 0).alias("malformed"))
    listener = ProgressListener(metrics)
    spark.streams.addListener(listener)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    try:
        start(dirty, CFG, path, f"{path}-state", SnapshotHolder(), stop, metrics, clock=lambda: AS_OF, wall_clock=False, availableNow=True).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if metrics.value("trending_events_consumed_total", status="ok"):
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
        spark.conf.set(provider, before)
    statuses = ("ok", "dropped_dedup", "dropped_stale", "dropped_unmarshal", "dropped_validation")
    rows = [(s, int(metrics.value("trending_events_consumed_total", status=s))) for s in statuses]
    rows += [(s, int(metrics.value(f"trending_{s}"))) for s in ("snapshot_size", "stoplist_size", "http_requests_in_flight", "snapshot_last_built_seconds")]
    return spark.createDataFrame(rows, "name string, n long")


_REQUESTS = (
    ("GET", "/healthz", {}, ""), ("GET", "/readyz", {}, ""), ("GET", "/api/v1/trending", {"limit": "10"}, ""), ("GET", "/api/v1/trending", {}, ""), ("GET", "/api/v1/trending", {"limit": "0"}, ""),
    ("POST", "/api/v1/stoplist", {}, '{"word":" Spam "}'), ("POST", "/api/v1/stoplist", {}, '{"word":" "}'), ("POST", "/api/v1/stoplist", {}, "{"), ("GET", "/api/v1/stoplist", {}, ""),
    ("DELETE", "/api/v1/stoplist/spam", {}, ""), ("DELETE", "/api/v1/stoplist/spam", {}, ""), ("GET", "/nowhere", {}, ""),
)


def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests before and after the first snapshot: status, and how many items or which first one the answer holds."""
    holder = SnapshotHolder()
    service = Service(holder, StopWords())
    rows = [(0, *service.handle("GET", "/readyz")), (1, *service.handle("GET", "/api/v1/trending"))]
    best = first(trending(Q.recent(spark, sf_dir, "k"), AS_OF, CFG, Q._stop(spark)), 1000).collect()
    holder.publish([(r["query"], r["count"]) for r in best], AS_OF)
    rows += [(i + 2, *service.handle(method, path, query, body.encode())) for i, (method, path, query, body) in enumerate(_REQUESTS)]
    items = [body["data"] if isinstance(body, dict) and "data" in body else [] for _, _, body in rows]
    return spark.createDataFrame([(n, status, len(x), json.dumps(x[0], sort_keys=True) if x else "") for (n, status, _), x in zip(rows, items, strict=True)], "n long, status long, items long, first string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        burst_flags, burst_snapshot, burst_candidates, trending_plain, trending_fresh_baseline, ewma_lives, ewma_slow, ewma_last_only, window_admission, ring_panes, ring_slots, bloom_sizes, bloom_words, bloom_seen,
        topk_evicting, sketch_evicting, topk_none, limits, csv_words, stop_contains, environment, refusals, log_lines, sizes, topic_messages, topic_lag, stream_dedup_late, stream_restart, stream_triggered, stream_future, service_metrics, service_answers,
    )
}

# ---- the same in SQL -------------------------------------------------------------------------------------------------

_BE = f"""{Q._ev()}, be as (select query, ts_us, i, 'u:b-' || id || '-' || i as identity, id from va, range(1, 84) t(i)
        where ts_us <= {AS_OF} and i <= case when query in ('purchase', 'click') and ts_us > {AS_OF - _H} then 83 else 4 end)"""
_PENALTY = f"case when coalesce({Q._FLAG}, false) then {CFG.snapshot.penalty}::double else 1.0::double end"


def _burst(baseline: str = "be") -> str:
    return f"""with {_BE}, fr as (select * from be where ts_us > {AS_OF - CFG.window.size_us}), {Q._pn(baseline)}, {Q._ew("pn")}, {Q._pn("be", "pw")},
        wc as (select query, sum(cnt)::bigint as cnt from pw where pane_us > {AS_OF - CFG.window.size_us} and pane_us <= {AS_OF} group by 1)"""


_SNAPSHOT = f"""select query, trunc(score)::bigint as count, score, anomaly from (select query, coalesce({Q._FLAG}, false) as anomaly, cnt * {_PENALTY} as score from wc left join ew using (query))
        order by score desc, query limit {CFG.snapshot.max_size}"""
_BK, _BH = bloom.bloom_size(BLOOM_KEYS, BLOOM_SHARE)
_AT = f"(('0x' || substr(md5(event_id::varchar), 1, 15))::bigint % {_BK} + i * (('0x' || substr(md5(event_id::varchar), 16, 15))::bigint % {_BK})) % {_BK}"
_FILTER = f"fi as (select pos // 32 as word, bit_or(1::bigint << (pos % 32)::int) as bits from (select {_AT} as pos from events, range({_BH}) t(i) where event_id < {BLOOM_KEYS}) group by 1)"
_CROWD = f"""cr as (select case when event_id % 3 = 0 then 'hot' || (event_id % 7) else 'cold' || event_id end as query from events)
        select query, count(*) as true_cnt, true as found, true as inside from cr group by 1 having count(*) > (select count(*) from cr) / {CAPACITY}::double"""


def _values(rows, columns: str) -> str:
    text = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::bigint" if isinstance(x, int) else f"{x!r}::double" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") t({columns})"


ORACLE_SQL: dict[str, str] = {
    "burst_flags": f"{_burst()} select query, round(ewma, 6) as ewma, current, {Q._FLAG} as anomaly from ew",
    "burst_snapshot": f"{_burst()} {_SNAPSHOT}",
    "burst_candidates": f"""{_burst()}, {Q._ST}, ca as (select * from wc order by cnt desc, query limit {SMALL.snapshot.max_size * SMALL.snapshot.candidate_factor})
        select ca.query, cnt * {_PENALTY} as score, coalesce({Q._FLAG}, false) as anomaly from ca left join ew using (query) where ca.query not in (select word from st)""",
    "trending_plain": f"""with {Q._ev("k")}, up as (select * from va where ts_us <= {AS_OF}), {Q._pn("up")}, {Q._WC} select query, cnt as count, cnt::double as score, false as anomaly from wc order by cnt desc, query limit {CFG.snapshot.max_size}""",
    "trending_fresh_baseline": f"{_burst(baseline='fr')} {_SNAPSHOT}",
    "ewma_lives": f"""with {Q._ev("k")}, {Q._pn()}, {Q._ew("pn").replace(f"> {Q._TTL} then", f"> {3 * _H} then")}
        select query, round(ewma, 6) as ewma, current, first_us, last_us, last_us >= {AS_OF - 3 * _H} as alive from ew""",
    "ewma_slow": f"""with {Q._ev("k")}, {Q._pn()}, nu as (select *, pane_us // {CFG.anomaly.bucket_us} as i from pn)
        select a.query, a.pane_us, a.cnt, round(coalesce(sum(0.01::double * pow(0.99::double, a.i - 1 - b.i) * b.cnt), 0), 6) as ewma
        from nu a left join nu b on a.query = b.query and b.i < a.i group by 1, 2, 3""",
    "ewma_last_only": f"""with {Q._ev()}, {Q._pn()} select a.query, a.pane_us, a.cnt, coalesce(b.cnt, 0)::double as ewma
        from pn a left join pn b on a.query = b.query and b.pane_us = a.pane_us - {_H}""",
    "window_admission": f"""with {Q._ev()}, st as (select query, case when ts_us > {AS_OF} then 'future' when {AS_OF} - ts_us >= {CFG.window.size_us} then 'too_old' else 'admitted' end as status from va),
        tk as (select query, count(*) as taken from st where status = 'admitted' group by 1)
        select query, status, count(*) as n, any_value(taken) as taken, 0::bigint as wrong from st join tk using (query) group by 1, 2""",
    "ring_panes": f"""with {Q._ev()}, {Q._pn()}, sl as (select *, (pane_us // {CFG.window.pane_us}) % {SLOTS} as slot from pn), ne as (select slot, max(pane_us) as newest from sl group by 1)
        select slot, query, pane_us, cnt from sl join ne using (slot) where pane_us = newest""",
    "ring_slots": f"""with {Q._ev()} select id as event_id, ((floor((ts_us - {AS_OF}) / {CFG.window.pane_us}::double)::bigint % {SLOTS}) + {SLOTS}) % {SLOTS} as slot from va""",
    "bloom_sizes": f"""with g as ({_values(_SIZES, "n, share")}), b as (select n, share, greatest(64, ceil(-n * ln(share) / (ln(2) * ln(2))))::bigint as raw from g)
        select n, share, ((raw + 63) // 64 * 64)::bigint as bits, greatest(1, ceil(raw / n::double * ln(2)))::bigint as hashes from b""",
    "bloom_words": f"with {_FILTER} select word, bits from fi",
    "bloom_seen": f"""with {_FILTER}, pr as (select event_id::varchar as key, {_AT} as pos from events, range({_BH}) t(i) where event_id < {4 * BLOOM_KEYS})
        select key, bool_and(coalesce((bits >> (pos % 32)::int) & 1, 0) = 1) as seen from pr left join fi on pos // 32 = word group by 1""",
    "topk_evicting": f"with {_CROWD}",
    "sketch_evicting": f"with {_CROWD}",
    "topk_none": _values([(k, 0) for k in ("exact", "negative", "sketch", "summary")], "kind, n"),
    "limits": f"""select given, case when given = '' then 100 when regexp_full_match(given, '[+-]?[0-9]{{1,9}}') and given::int between 1 and 1000 then given::int end as limit from ({_values([(x,) for x in _LIMITS], "given")})""",
    "csv_words": "select n_regionkey, n_name as name from nation",
    "stop_contains": f"""with {Q._ST}, al as (select word from st union select lower(n_name) from nation where n_regionkey < 3),
        wo as (select n_name as word from nation union all select lower(n_name) from nation) select word, word in (select word from al) as listed from wo""",
    "environment": _values(
        [("given", *x) for x in (("brokers", "a:1;b:2"), ("topic", "t"), ("port", "81"), ("level", "warn"), ("format", "json"), ("window_us", "90000000"), ("pane_us", "15000000"), ("k", "5"), ("interval_ms", "250"), ("max_size", "7"), ("max_age_s", "300"), ("rotation_us", "10000000"), ("rotations", "3"), ("threshold", "5.0"), ("panes", "6"))]
        + [("default", *x) for x in (("brokers", "localhost:9092"), ("topic", "search.events"), ("port", "8080"), ("level", "info"), ("format", "text"), ("window_us", "300000000"), ("pane_us", "10000000"), ("k", "10000"), ("interval_ms", "1000"), ("max_size", "1000"), ("max_age_s", "300"), ("rotation_us", "10000000"), ("rotations", "3"), ("threshold", "5.0"), ("panes", "30"))],
        "who, name, value",
    ),
    "refusals": _values([(k, k not in ("capacity_of_one", "alpha_of_one")) for k in ("capacity", "capacity_of_one", "pane_of_window", "window_below_pane", "alpha", "alpha_of_one", "threshold", "penalty", "rotations", "bloom_keys", "bloom_share", "port", "brokers")], "given, refused"),
    "log_lines": _values([(level, kind, n, n) for level, n in (("debug", 4), ("info", 3), ("warn", 2), ("error", 1)) for kind in ("text", "json")], "level, kind, n, whole"),
    "sizes": f"""with {Q._ev()}, {_values([("summary_keys", 3), ("summary_capacity", 3), ("window_panes", 24), ("stop_words", 4), ("bloom_bits", _BK), ("bloom_hashes", _BH)], "name, n").join(("fx as (", ")"))}
        select name, n from fx union all select 'queries_known', count(distinct query) from va where ts_us <= {AS_OF}""",
    "topic_messages": """with b as (select event_id % 19 = 0 or event_id % 23 = 0 as malformed, * from events)
        select malformed, case when malformed then '' else event_type end as query, count(*) as n, count(distinct case when malformed then '' else event_id::varchar end) as ids,
               min(case when not malformed then epoch_us(ts) end) as first_us from b group by 1, 2""",
    "topic_lag": """with p as (select event_type as query, event_id % 3 as p, max(event_id) as latest, max(event_id) filter (event_id % 5 = 0) as done from events group by 1, 2)
        select query, sum(latest - coalesce(done, 0))::bigint as lag from p group by 1""",
    "stream_dedup_late": f"""with {Q._ev()}, {Q._DD} select identity, query, ts_us, id as event_id from un
        where keep and (ts_us // {Q._ROT} + 1) * {Q._ROT} < (select max(ts_us) // 1000 from ev) * 1000 - {24 * _H}""",
    "stream_restart": f"with {Q._ev()}, {Q._pn()} select * from pn",
    "stream_triggered": f"with {Q._ev()}, {Q._pn()} select * from pn",
    "stream_future": f"""with {Q._ev()}, ok as (select * from va where event_id % 50 <> 0), {Q._pn("ok")} select query, pane_us, cnt from pn
        where pane_us + {_H} <= (select max(ts_us) from ok) - 300000000""",
    "service_metrics": f"""with {Q._ev()}, ca as (select *, event_id % 101 = 0 as bad, event_id % 97 = 0 or event_id % 89 = 0 as invalid from va),
        ok as (select *, lag(ts_us // {Q._ROT}) over (partition by identity, query order by ts_us, id) as before from ca where not bad and not invalid),
        st as (select case when before is null or ts_us // {Q._ROT} - before >= {CFG.dedup.rotations} then 'ok' else 'dropped_dedup' end as name from ok
               union all select case when bad then 'dropped_unmarshal' else 'dropped_validation' end from ca where bad or invalid),
        un as (select query, count(*) as n from ok where (before is null or ts_us // {Q._ROT} - before >= {CFG.dedup.rotations}) and ts_us > {AS_OF - CFG.window.size_us} and ts_us <= {AS_OF} + {_H} group by 1),
        sn as (select * from un where query <> 'purchase')
        select name, count(*) as n from st group by 1 union all select 'dropped_stale', 0 union all select 'stoplist_size', 4
        union all select 'http_requests_in_flight', 0 union all select 'snapshot_last_built_seconds', {AS_OF // 1_000_000} union all select 'snapshot_size', count(*) from sn""",
    "service_answers": f"""with {Q._SNAP}, bs as (select query, count from sn order by score desc, query limit 1), sz as (select count(*) as k from sn),
        an as ({_values([(0, 503, 0), (1, 200, 0), (2, 200, 0), (3, 200, 0), (4, 200, 10), (5, 200, 100), (6, 400, 0), (7, 201, 0), (8, 400, 0), (9, 400, 0), (10, 200, 1), (11, 200, 0), (12, 404, 0), (13, 404, 0)], "n, status, most")})
        select n, status, case when n in (4, 5) then least(most, k) else most end as items,
               case when n in (4, 5) then '{{"count": ' || count || ', "query": "' || query || '"}}' when n = 10 then '"spam"' else '' end as first from an, sz, bs""",
}
