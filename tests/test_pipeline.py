import datetime as dt
import time

import pytest

from crestline.config import Config, SnapshotConfig
from crestline.plans.trending import classify, trending
from crestline.sources.events import decode_json, encode_json
from crestline.sources.generator import generate_events, zipf_table
from crestline.streaming.metrics import Metrics, ProgressListener, observed
from crestline.streaming.trending import SnapshotHolder, pane_sink, publishing, read_panes, start_panes, valid_stream

S = 1_000_000
NOW = 1_779_624_000 * S
AT = dt.datetime(2026, 5, 24, 12)


def event(n, query, user, ago):
    return (f"e{n}", query, user, "", AT - dt.timedelta(seconds=ago))


SCHEMA = "event_id string, query string, user_id string, session_id string, timestamp timestamp"


def test_bots_do_not_trend(spark):
    rows = [event(i, "Popular ", f"u{i}", i % 200) for i in range(40)]
    rows += [event(1000 + i, "fake", "bot", 100 + i % 10) for i in range(500)]
    got = trending(spark.createDataFrame(rows, SCHEMA), NOW, Config()).collect()
    assert [(r.query, r["count"]) for r in got] == [("popular", 40), ("fake", 1)]
    raw = trending(spark.createDataFrame(rows, SCHEMA), NOW, Config(), dedup=False, anomaly=False).first()
    assert (raw.query, raw["count"]) == ("fake", 500)


def test_burst_is_penalised(spark):
    rows = [event(i, "burst", f"u{i}", 290 - 10 * (i // 5)) for i in range(140)]
    rows += [event(1000 + i, "burst", f"v{i}", 5) for i in range(300)]
    rows += [event(5000 + i, "calm", f"w{i}", 290 - i) for i in range(100)]
    got = {r.query: (r["count"], r.anomaly) for r in trending(spark.createDataFrame(rows, SCHEMA), NOW, Config()).collect()}
    assert got["calm"] == (100, False)
    assert got["burst"] == (44, True)  # a tenth of 440


def test_statuses(spark):
    rows = [event(1, "a", "u", 10), event(2, "a", "u", 9), event(3, "a", "v", 300), event(4, "a", "w", 301), event(5, "", "u", 1)]
    good = spark.createDataFrame(rows, SCHEMA)
    messages = good.select(encode_json(good).alias("value")).union(spark.createDataFrame([("nonsense",)], "value string"))
    got = {r.status: r["count"] for r in classify(decode_json(messages), Config(), NOW).groupBy("status").count().collect()}
    assert got == {"ok": 1, "dropped_dedup": 1, "dropped_stale": 1, "dropped_validation": 2, "dropped_unmarshal": 1}


def test_generator(spark):
    made = generate_events(spark, 5000, NOW, rps=1000, queries=100, users=50, bot_share=0.2, seed=3).cache()
    assert made.count() == made.select("event_id").distinct().count() == 5000
    bots = made.where("query = 'fake-trend'").count()
    assert 800 < bots < 1200
    top = made.where("query <> 'fake-trend'").groupBy("query").count().orderBy("count", ascending=False).first()
    share = zipf_table(spark, 100).where("rank = 0").selectExpr("sum(hi - lo) s").first().s
    assert top.query == "query-0" and abs(top["count"] / (5000 - bots) - share) < 0.05
    assert generate_events(spark, 0, NOW).count() == 0
    spread = made.selectExpr("max(unix_micros(timestamp)) - min(unix_micros(timestamp)) d").first().d
    assert spread == 4_999_000


def test_live_snapshot(spark, tmp_path):
    holder, metrics, cfg = SnapshotHolder(), Metrics(), Config(snapshot=SnapshotConfig(max_size=3))
    df = spark.createDataFrame([event(i, f"q{i % 4}", f"u{i}", i % 100) for i in range(120)], SCHEMA)
    for k in range(3):
        df.where(f"cast(substr(event_id, 2) as int) % 3 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    listener = ProgressListener(metrics)
    spark.streams.addListener(listener)
    path = str(tmp_path / "panes")
    marked = valid_stream(stream, cfg, clock=False).selectExpr("*", "'ok' as status")
    query = start_panes(observed(marked), path, str(tmp_path / "state"), cfg.window.pane_us, publishing(spark, path, cfg, holder, lambda: NOW), availableNow=True)
    query.awaitTermination(120)
    spark.streams.removeListener(listener)
    assert holder.ready and [q for q, _ in holder.get()] == ["q0", "q1", "q2"] and holder.get(1) == [("q0", 30)]
    assert read_panes(spark, path).selectExpr("sum(cnt) s").first().s == 120
    assert read_panes(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_inputs(spark, n):
    rows = spark.createDataFrame([event(i, "a", "u", 1) for i in range(n)], SCHEMA)
    assert trending(rows, NOW, Config()).count() == n


def test_service_on_a_stream(spark, tmp_path):
    from crestline.streaming.live import start
    from crestline.streaming.serve import Service, StopWords
    from crestline.streaming.trending import compact

    rows = [event(i, f"q{i % 3}", f"u{i % 30}", i % 90) for i in range(90)] + [event(500 + i, "q0", "bot", 1 + i % 5) for i in range(50)]
    good = spark.createDataFrame(rows, SCHEMA)
    messages = good.select(encode_json(good).alias("value")).union(spark.createDataFrame([("junk",)], "value string"))
    messages.coalesce(1).write.text(str(tmp_path / "in"))
    holder, stop, metrics = SnapshotHolder(), StopWords(), Metrics()
    stop.add("q2")
    spark.streams.addListener(listener := ProgressListener(metrics))
    stream = decode_json(spark.readStream.text(str(tmp_path / "in")))
    path = str(tmp_path / "panes")
    query = start(stream, Config(), path, str(tmp_path / "state"), holder, stop, metrics, clock=lambda: NOW, wall_clock=False, availableNow=True)
    query.awaitTermination(120)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    time.sleep(1)
    spark.streams.removeListener(listener)
    service = Service(holder, stop, metrics)
    status, body = service.handle("GET", "/api/v1/trending", {"limit": "5"})
    want = trending(good, NOW, Config(), stop.table(spark)).collect()
    assert status == 200 and [(x["query"], x["count"]) for x in body["data"]] == [(r.query, r["count"]) for r in want]
    assert metrics.value("trending_snapshot_size") == 2 and metrics.value("trending_stoplist_size") == 1
    assert {s: metrics.value("trending_events_consumed_total", status=s) for s in ("ok", "dropped_dedup", "dropped_unmarshal")} == {"ok": 91, "dropped_dedup": 49, "dropped_unmarshal": 1}
    panes = read_panes(spark, path).collect()
    assert compact(spark, path, 0, NOW - 600 * S) == 0 and compact(spark, path, 100, NOW - 600 * S) >= 1
    assert sorted(read_panes(spark, path).collect()) == sorted(panes) and compact(spark, path, 101, 0) == 0
    pane_sink(path, 10 * S)(spark.createDataFrame([("q9", NOW)], "query string, ts_us long"), 100)
    assert compact(spark, path, 101, NOW + 600 * S) == 2 and read_panes(spark, path).count() == 0
    assert compact(spark, str(tmp_path / "nothing"), 5, NOW) == 0


def test_command_line(spark, tmp_path):
    from crestline.__main__ import main

    main(["generate", str(tmp_path / "made"), "--rps", "50", "--duration", "4", "--bot-share", "0.5"])
    made = decode_json(spark.read.text(str(tmp_path / "made")))
    assert made.count() == 200 and made.where("malformed").count() == 0


def test_logging(capsys):
    import json as j

    from crestline.logs import configure

    log = configure("warn", "json")
    log.info("quiet")
    log.warning("loud %s", "é")
    lines = capsys.readouterr().err.strip().splitlines()
    assert [j.loads(x)["msg"] for x in lines] == ["loud é"]
    configure()


def test_replayed_batch_counts_once(spark, tmp_path):
    sink, path = pane_sink(str(tmp_path / "panes"), 10 * S), str(tmp_path / "panes")
    batch = spark.createDataFrame([("a", NOW), ("a", NOW + S), ("b", NOW)], "query string, ts_us long")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.limit(1), 1)
    assert {r.query: r.cnt for r in read_panes(spark, path).collect()} == {"a": 3, "b": 1}


def test_snapshot_reads_only_what_matters(spark, tmp_path):
    """Old events change nothing, and the bounds reach the scan."""
    rows = [event(i, f"q{i % 5}", f"u{i % 9}", i * 3 % 900) for i in range(400)]
    rows += [event(1000 + i, "q0", f"old{i}", 40_000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "events"))
    plan = trending(spark.read.parquet(str(tmp_path / "events")), NOW, Config())
    assert "GreaterThanOrEqual(timestamp" in plan._jdf.queryExecution().toString()
    assert plan.collect() == trending(df.where("query <> 'q0' or not user_id like 'old%'"), NOW, Config()).collect()


def test_closed_epochs_in_any_order(spark, tmp_path):
    import random

    from crestline.operators.dedup import drop_repeats
    from crestline.streaming.dedup import drop_repeats_closed

    rng = random.Random(2)
    rows = [(f"u:{rng.randrange(4)}", f"q{rng.randrange(3)}", (1000 + i * 3 + rng.randrange(100)) * S, f"{i:06d}") for i in range(400)]
    df = spark.createDataFrame(rows, "identity string, query string, ts_us long, event_id string").selectExpr("*", "timestamp_micros(ts_us) as timestamp")
    for k in range(4):
        df.where(f"cast(event_id as int) div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drop_repeats_closed(stream, 10 * S, 3, "100 seconds")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    closed = max(r[2] for r in rows) - 100 * S
    want = {tuple(r) for r in drop_repeats(df, 10 * S, 3).collect() if (r.ts_us // (10 * S) + 1) * 10 * S < closed}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want and len(want) > 30
