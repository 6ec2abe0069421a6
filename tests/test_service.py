import json
import urllib.error
import urllib.request

import pytest

from crestline.config import AnomalyConfig, Config, DedupConfig, SnapshotConfig, WindowConfig, csv, seconds
from crestline.operators import stoplist
from crestline.sources.events import kafka_options
from crestline.streaming.metrics import Metrics, ProgressListener, bucket_edges
from crestline.streaming.serve import Service, StopWords, serve
from crestline.streaming.trending import SnapshotHolder


def words(spark, *items):
    return spark.createDataFrame([(w,) for w in items], "word string")


def test_stoplist_frames(spark):
    stop = stoplist.normalised(words(spark, "  ReKlAmA  ", " ", "reklama", None))
    assert [r.word for r in stop.collect()] == ["reklama"]
    stop = stoplist.add(stop, words(spark, "c", "A", "b", ""))
    assert [r.word for r in stoplist.listed(stop).collect()] == ["a", "b", "c", "reklama"]
    assert [r.word for r in stoplist.listed(stoplist.remove(stop, words(spark, " B ", "x"))).collect()] == ["a", "c", "reklama"]
    assert stoplist.contains(stop, "a") and not stoplist.contains(stop, "A")
    rows = spark.createDataFrame([("a", 1), ("a b", 2)], "query string, cnt long")
    assert [r.query for r in stoplist.exclude(rows, stop).collect()] == ["a b"]
    assert stoplist.exclude(rows, None).count() == 2


def test_service():
    holder = SnapshotHolder()
    s = Service(holder, StopWords())
    assert s.handle("GET", "/healthz")[0] == 200
    assert s.handle("GET", "/readyz")[0] == 503
    assert s.handle("GET", "/api/v1/trending") == (200, {"data": []})
    holder.publish([(f"q{i}", 200 - i) for i in range(150)], 1)
    assert s.handle("GET", "/readyz")[0] == 200
    assert len(s.handle("GET", "/api/v1/trending")[1]["data"]) == 100
    assert s.handle("GET", "/api/v1/trending", {"limit": "1"}) == (200, {"data": [{"query": "q0", "count": 200}]})
    assert all(s.handle("GET", "/api/v1/trending", {"limit": x})[0] == 400 for x in ("abc", "0", "99999"))
    assert s.handle("POST", "/api/v1/stoplist", body=b'{"word":" Spam "}')[0] == 201
    assert s.handle("POST", "/api/v1/stoplist", body=b'{"word":"spam"}')[0] == 201
    assert s.handle("GET", "/api/v1/stoplist") == (200, {"data": ["spam"]})
    assert s.handle("DELETE", "/api/v1/stoplist/spam")[0] == 200
    assert s.handle("DELETE", "/api/v1/stoplist/spam")[0] == 404
    assert all(s.handle("POST", "/api/v1/stoplist", body=b)[0] == 400 for b in (b"x", b'{"word":" "}', b"{}", b'{"word":5}'))
    assert s.handle("GET", "/nowhere")[0] == 404


def test_http():
    holder = SnapshotHolder()
    holder.publish([("a", 2)], 1)
    service = Service(holder, StopWords())
    server = serve(service, port=0)
    base = f"http://127.0.0.1:{server.server_address[1]}"
    with urllib.request.urlopen(f"{base}/api/v1/trending?limit=5", timeout=10) as r:
        assert json.load(r) == {"data": [{"query": "a", "count": 2}]} and r.headers["X-Request-ID"]
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{base}/api/v1/trending?limit=0", timeout=10)
    with urllib.request.urlopen(f"{base}/metrics", timeout=10) as r:
        text = r.read()
        assert b"trending_http_request_duration_seconds_count" in text and b"trending_http_requests_in_flight 1" in text
    server.shutdown()


def test_metrics():
    m = Metrics()
    m.add("trending_events_consumed_total", 3, status="ok")
    m.set("trending_snapshot_size", 7)
    m.observe("trending_snapshot_build_duration_seconds", 0.0015)
    assert m.value("trending_events_consumed_total", status="ok") == 3
    text = m.text()
    assert 'trending_events_consumed_total{status="ok"} 3' in text and "trending_snapshot_size 7" in text
    assert 'le="0.002"} 1' in text and 'le="0.001"} 0' in text
    assert bucket_edges(1.0, 3) == [1.0, 2.0, 4.0]


@pytest.mark.parametrize(
    "make",
    [
        lambda: WindowConfig(300, 7), lambda: WindowConfig(5, 10), lambda: WindowConfig(300, 0), lambda: WindowConfig(sketch_k=0), lambda: DedupConfig(0), lambda: DedupConfig(30, 1),
        lambda: AnomalyConfig(alpha=0), lambda: AnomalyConfig(alpha=1.1), lambda: AnomalyConfig(threshold=1), lambda: AnomalyConfig(min_age_s=-1), lambda: AnomalyConfig(gc_s=0), lambda: AnomalyConfig(ttl_s=0),
        lambda: SnapshotConfig(penalty=0), lambda: SnapshotConfig(penalty=1.5), lambda: SnapshotConfig(max_size=0), lambda: SnapshotConfig(interval_s=0), lambda: Config(http_port=0), lambda: Config(log_level="loud"),
        lambda: Config.from_env({"WINDOW_SIZE": "x"}), lambda: Config.from_env({"HTTP_PORT": "x"}),
    ],
)
def test_bad_config(make):
    with pytest.raises(ValueError):
        make()


def test_config_from_env():
    assert Config.from_env({}) == Config()
    cfg = Config.from_env({"KAFKA_BROKERS": "a:1, b:2,", "WINDOW_SIZE": "1m30s", "BUCKET_DURATION": "15s", "SNAPSHOT_MAX_SIZE": "5", "SNAPSHOT_INTERVAL": "250ms"})
    assert (cfg.brokers, cfg.window.size_s, cfg.window.pane_s, cfg.anomaly.bucket_s, cfg.snapshot.max_size, cfg.snapshot.interval_s) == (("a:1", "b:2"), 90, 15, 15, 5, 0.25)
    assert seconds("1h2m3s") == 3723 and csv(" a,, b ") == ["a", "b"]


class Client:
    """Stands for an admin client of the JVM."""

    def __init__(self, error=None):
        self.error, self.asked, self.closed = error, [], False

    def createTopics(self, wanted):  # noqa: N802
        self.asked += list(wanted)
        return self

    def all(self):
        return self

    def get(self):
        if self.error:
            raise RuntimeError(self.error)

    def close(self):
        self.closed = True


def test_topic(spark, monkeypatch):
    from crestline.sources import topics

    monkeypatch.setattr(topics, "_new_topic", lambda jvm, *what: ",".join(map(str, what)))
    for error, new in ((None, True), ("org.apache.kafka.common.errors.TopicExistsException: it is there", False)):
        client = Client(error)
        assert topics.ensure_topic(spark, ["a:1"], "t", client=client) is new and client.asked == ["t,3,1"] and client.closed
    with pytest.raises(RuntimeError):
        topics.ensure_topic(spark, ["a:1"], "t", client=Client("TimeoutException"))


def test_kafka_options():
    got = kafka_options(["a:1", "b:2"], "t", "g", 500)
    assert got == {"kafka.bootstrap.servers": "a:1,b:2", "subscribe": "t", "startingOffsets": "earliest", "failOnDataLoss": "false", "groupIdPrefix": "g", "maxOffsetsPerTrigger": "500"}
    assert "groupIdPrefix" not in kafka_options(["a"], "t") and "maxOffsetsPerTrigger" not in kafka_options(["a"], "t")
    with pytest.raises(ValueError):
        kafka_options([], "t")


def test_listener_takes_differences():
    from types import SimpleNamespace as N

    class Row:
        def __init__(self, **x):
            self.x = x

        def asDict(self):  # noqa: N802
            return dict(self.x)

    m = Metrics()
    seen = {"received": Row(dropped_unmarshal=2, dropped_validation=3, valid=10), "unique": Row(ok=6, dropped_stale=1)}
    progress = N(observedMetrics=seen, batchDuration=20, sources=[N(metrics={"maxOffsetsBehindLatest": "7"}), N(metrics=None)])
    ProgressListener(m).onQueryProgress(N(progress=progress))
    status = lambda s: m.value("trending_events_consumed_total", status=s)
    assert [status(s) for s in ("ok", "dropped_dedup", "dropped_stale", "dropped_unmarshal", "dropped_validation")] == [6, 3, 1, 2, 3]
    assert m.value("trending_kafka_consumer_lag") == 7
