import random

import pytest

from crestline.config import AnomalyConfig, SnapshotConfig
from crestline.operators import panes
from crestline.operators.anomaly import anomaly_flags, ewma_at, ewma_history, reach
from crestline.operators.snapshot import first, parse_limit, rank

S = 1_000_000
NOW = 1_779_624_000 * S  # 2026-05-24T12:00:00Z
W, D = 30 * S, 10 * S
CFG = AnomalyConfig(bucket_s=10, alpha=0.3, threshold=5, min_age_s=60, gc_s=60, ttl_s=600)


def events(spark, *groups):
    """groups: (query, count, microseconds)."""
    return spark.createDataFrame([(q, t) for q, n, t in groups for _ in range(n)], "query string, ts_us long")


def window(spark, as_of, *groups, size=W):
    rows = panes.admitted(events(spark, *groups), as_of, size)
    return {r.query: r.cnt for r in panes.window_counts(panes.pane_counts(rows, D), as_of, size).collect()}


@pytest.mark.parametrize(
    ("as_of", "groups", "expected"),
    [
        (NOW, [("iphone", 5, NOW), ("samsung", 3, NOW)], {"iphone": 5, "samsung": 3}),
        (NOW, [("x", 1, NOW + S)], {}),
        (NOW, [("x", 1, NOW - 31 * S)], {}),
        (NOW, [("x", 1, NOW - 30 * S)], {}),
        (NOW + 5 * S, [("x", 1, NOW - 20 * S)], {"x": 1}),
        (NOW + 30 * S, [("old", 5, NOW), ("new", 1, NOW + 30 * S)], {"new": 1}),
        (NOW + 60 * S, [("x", 5, NOW)], {}),
        (NOW + 25 * S, [("fresh", 1, NOW + 20 * S)], {"fresh": 1}),
        (NOW + 30 * S, [("first", 10, NOW), ("second", 7, NOW + 30 * S)], {"second": 7}),
        (NOW + 10 * S, [("a", 1, NOW), ("a", 1, NOW + 3 * S), ("a", 1, NOW + 9_999_000)], {"a": 3}),
    ],
)
def test_window(spark, as_of, groups, expected):
    assert window(spark, as_of, *groups) == expected


def test_long_window_and_merge(spark):
    groups = [("a", 1, NOW), ("b", 1, NOW - 15 * S), ("c", 1, NOW - 25 * S)]
    assert window(spark, NOW, *groups, size=300 * S) == {"a": 1, "b": 1, "c": 1}
    p = panes.pane_counts(events(spark, ("a", 2, NOW), ("b", 1, NOW - D)), D)
    merged = panes.merge_panes(p, p)
    assert {(r.query, r.cnt) for r in merged.collect()} == {("a", 4), ("b", 2)}
    assert {r.query for r in panes.expire(merged, NOW + W, W).collect()} == set()
    assert {(r.query, r.window_cnt) for r in panes.sliding_counts(panes.pane_counts(events(spark, ("a", 2, NOW), ("a", 3, NOW + 2 * D), ("a", 4, NOW + 4 * D)), D), W, D).collect()} == {("a", 2), ("a", 5), ("a", 7)}


def flags(spark, as_of, *groups):
    p = panes.pane_counts(events(spark, *groups), D)
    return {r.query: r.anomaly for r in anomaly_flags(p, as_of, CFG).collect()}


def steady(query, n, count=20):
    return [(query, n, NOW + i * D) for i in range(count)]


def test_anomalies(spark):
    at = NOW + 205 * S
    assert flags(spark, NOW, ("x", 1000, NOW)) == {"x": False}
    assert flags(spark, at, *steady("x", 10), ("x", 10, at)) == {"x": False}
    assert flags(spark, at, *steady("x", 5), ("x", 100, at)) == {"x": True}
    assert flags(spark, NOW + S, ("x", 1000, NOW)) == {"x": False}
    assert flags(spark, at, *steady("victim", 5), *steady("normal", 5), ("victim", 100, at), ("normal", 5, at)) == {"victim": True, "normal": False}


def test_anomaly_expiry(spark):
    m = 60 * S
    assert flags(spark, NOW + 15 * m, ("old", 1, NOW), ("fresh", 1, NOW + 5 * m)) == {"old": False, "fresh": False}
    late = NOW + 205 * S
    burst = [*steady("x", 5), ("x", 100, late)]
    assert flags(spark, late + 9 * m, *burst) == {"x": True}  # the flag stays with the last observed pane
    assert flags(spark, late + 11 * m, *burst) == {"x": False}
    state = {r.query: (r.first_us, r.ewma) for r in ewma_at(panes.pane_counts(events(spark, *burst, ("x", 3, late + 30 * m)), D), late + 30 * m, CFG).collect()}
    assert state["x"] == (late + 30 * m, 0.0)  # a life of its own


def test_closed_form_equals_recurrence(spark):
    rng, groups, expected = random.Random(3), [], {}
    for q in range(60):
        counts = {i: rng.randrange(1, 40) for i in sorted(rng.sample(range(50), rng.randrange(1, 20)))}
        groups += [(f"q{q}", n, NOW + i * D + rng.randrange(D)) for i, n in counts.items()]
        mean, last = 0.0, None
        for i, n in counts.items():
            if last is not None:
                mean = CFG.alpha * counts[last] + (1 - CFG.alpha) * mean
                mean *= (1 - CFG.alpha) ** (i - last - 1)
            last = i
        expected[f"q{q}"] = (mean, counts[last])
    p = panes.pane_counts(events(spark, *groups), D)
    got = {r.query: (r.ewma, r.current) for r in ewma_at(p, NOW + 10_000 * S, CFG).collect()}
    assert got.keys() == expected.keys()
    for q, (mean, current) in expected.items():
        assert got[q] == (pytest.approx(mean, abs=1e-9), current)
    newest = {}
    for r in ewma_history(p, CFG).orderBy("pane_us").collect():
        newest[r.query] = r.ewma
    assert newest == {q: pytest.approx(m, abs=1e-9) for q, (m, _) in expected.items()}


@pytest.mark.parametrize("alpha", [1.0, 0.9, 0.3, 0.01, 0.001])
def test_history_equals_recurrence(spark, alpha):
    rng, rows, expected = random.Random(4), [], {}
    for q in range(6):
        mean, last = 0.0, None
        for i in sorted(rng.sample(range(-30, 3000), 200)):
            n = rng.randrange(1, 10**rng.randrange(1, 9))
            if last is not None:
                mean = (alpha * last[1] + (1 - alpha) * mean) * (1 - alpha) ** (i - last[0] - 1)
            expected[f"q{q}", i * D] = mean
            last = i, n
            rows.append((f"q{q}", i * D, n, i * D, i * D))
    p = spark.createDataFrame(rows, "query string, pane_us long, cnt long, first_us long, last_us long")
    got = {(r.query, r.pane_us): r.ewma for r in ewma_history(p, AnomalyConfig(alpha=alpha)).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in expected.items()}
    assert reach(alpha) == 1 if alpha == 1 else (1 - alpha) ** reach(alpha) <= 1e-12 < (1 - alpha) ** (reach(alpha) - 1)


def counts_frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "query string, cnt long")


def flag_frame(spark, *queries):
    return spark.createDataFrame([(q, True) for q in queries], "query string, anomaly boolean")


def test_rank(spark):
    cfg = SnapshotConfig(max_size=10)
    got = lambda df: [(r.query, r["count"]) for r in df.collect()]
    assert got(rank(counts_frame(spark, {"iphone": 100, "samsung": 50, "xiaomi": 30}), cfg)) == [("iphone", 100), ("samsung", 50), ("xiaomi", 30)]
    assert got(rank(counts_frame(spark, {"victim": 1000, "normal": 150}), cfg, flag_frame(spark, "victim"))) == [("normal", 150), ("victim", 100)]
    stop = spark.createDataFrame([("bad",)], "word string")
    assert got(rank(counts_frame(spark, {"good": 100, "bad": 200}), cfg, None, stop)) == [("good", 100)]
    many = counts_frame(spark, {f"k{i:03d}": 100 - i for i in range(100)})
    assert got(rank(many, SnapshotConfig(max_size=5))) == [(f"k{i:03d}", 100 - i) for i in range(5)]
    assert got(rank(counts_frame(spark, {"x": 7}), cfg, flag_frame(spark, "x"))) == [("x", 0)]
    words = spark.createDataFrame([(f"k{i:03d}",) for i in range(8)], "word string")
    assert got(rank(many, SnapshotConfig(max_size=5), None, words)) == [("k008", 92), ("k009", 91)]  # cut before stop words
    assert got(first(rank(many, cfg), 2)) == [("k000", 100), ("k001", 99)]


def test_parse_limit():
    assert parse_limit(None) == parse_limit("") == 100
    assert parse_limit("10") == 10
    for bad in ("abc", "0", "1001", "-1", "1.5"):
        with pytest.raises(ValueError):
            parse_limit(bad)
