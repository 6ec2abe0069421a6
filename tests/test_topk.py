import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crestline.operators.bloom import bloom_filter, bloom_size, merge_filters, reset, seen_keys
from crestline.operators.topk import SpaceSaving, pane_top_k, sketch_top_k, space_saving, top_k


def summary(capacity, text):
    s = SpaceSaving(capacity)
    for part in text.split():
        s.add(part[0], int(part[1:]))
    return s


def test_small_summaries():
    assert [x[:2] for x in summary(10, "a5 b3 c4 d1").top(3)] == [("a", 5), ("c", 4), ("b", 3)]
    assert len(summary(10, "a1 b1").top(100)) == 2
    assert summary(10, "a1").top(0) == summary(10, "a1").top(-1) == []
    assert len(summary(3, "a1 b1 c1 d1 e1 f1")) == 3
    assert summary(3, "h100 1_1".replace("1_1", " ".join(f"{c}1" for c in "qrstuvw"))).top(1)[0][:2] == ("h", 100)
    assert ("c", 3, 2) in summary(2, "a3 b2 c1").entries()
    assert summary(2, "a5 b3 c4").entries() == [("c", 7, 3), ("a", 5, 0)]
    assert summary(5, "h100 h50 w10 c0").entries() == [("h", 150, 0), ("w", 10, 0)]
    with pytest.raises(ValueError):
        SpaceSaving(0)


def test_ties_are_first_come():
    assert [x[0] for x in summary(5, "b2 a2 c2 b1 a1").entries()] == ["b", "a", "c"]


def test_merge_keeps_errors():
    a, b = summary(10, "x3 y1"), summary(10, "x2 z5")
    a.merge(b)
    assert {k: c for k, c, _ in a.entries()} == {"x": 5, "y": 1, "z": 5}
    c = summary(2, "a3 b2 c1")
    d = SpaceSaving(10)
    d.merge(c)
    assert ("c", 3, 2) in d.entries()


@pytest.mark.parametrize("seed", range(5))
def test_bounds(seed):
    rng, s, true = random.Random(seed), SpaceSaving(50), Counter()
    for _ in range(20_000):
        key = f"k{int(rng.paretovariate(0.7)) % 1000}"
        s.add(key)
        true[key] += 1
    found = {k: (c, e) for k, c, e in s.entries()}
    assert sum(c for c, _ in found.values()) == 20_000
    assert all(c - e <= true[k] <= c for k, (c, e) in found.items())
    assert all(k in found for k, n in true.items() if n > 20_000 / 50)


def test_frames(spark):
    rows = spark.createDataFrame([(q,) for q, n in (("b", 3), ("a", 3), ("c", 1)) for _ in range(n)], "query string")
    counts = rows.groupBy("query").count().withColumnRenamed("count", "cnt")
    expected = [("a", 3), ("b", 3)]
    assert [tuple(r) for r in top_k(counts, 2).collect()] == expected
    assert top_k(counts, 0).count() == 0
    assert [tuple(r) for r in sketch_top_k(rows, 2).collect()] == expected
    assert sketch_top_k(rows, 0).count() == 0
    with pytest.raises(ValueError):
        sketch_top_k(rows, 5, 3)
    assert {tuple(r)[:2] for r in space_saving(rows.repartition(5), 10, 2, fan_in=2).collect()} == set(expected)
    panes = spark.createDataFrame([("a", 0, 5), ("b", 0, 5), ("c", 0, 1), ("a", 10, 2)], "query string, pane_us long, cnt long")
    assert [(r.pane_us, r.query, r["rank"]) for r in pane_top_k(panes, 2).orderBy("pane_us", "rank").collect()] == [(0, "a", 1), (0, "b", 2), (10, "a", 1)]


@pytest.mark.parametrize(("parts", "fan_in"), [(1, 32), (9, 2), (9, 3)])
def test_merged_summaries_keep_their_bounds(spark, parts, fan_in):
    rng, true = random.Random(parts), Counter()
    keys = [f"k{int(rng.paretovariate(0.6)) % 2000}" for _ in range(20_000)]
    true.update(keys)
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "query string").repartition(parts)
    found = {r.query: (r.cnt, r.error) for r in space_saving(rows, 100, 100, fan_in=fan_in).collect()}
    assert len(found) == 100 and all(true[k] <= c and c - e <= true[k] for k, (c, e) in found.items())
    assert all(k in found for k, n in true.items() if n > 20_000 / 100)


def test_filters(spark):
    bits, hashes = bloom_size(2000, 0.01)
    assert bits % 64 == 0 and bloom_size(1, 0.9)[0] == 64
    rows = spark.range(30_000).selectExpr("cast(id as string) as k")
    key = F.col("k")
    made = bloom_filter(rows.where("cast(k as int) < 2000"), key, bits, hashes)
    seen = {int(r.key): r.seen for r in seen_keys(rows.union(rows.limit(5)), key, made, bits, hashes).collect()}
    assert all(seen[i] for i in range(2000)) and len(seen) == 30_000
    assert sum(seen[i] for i in range(2000, 30_000)) / 28_000 <= 0.025
    assert not any(r.seen for r in seen_keys(rows.limit(50), key, reset(made), bits, hashes).collect())
    again = merge_filters(made, made)
    assert sorted(again.collect()) == sorted(made.collect()) and made.count() <= bits // 32
    assert bloom_filter(spark.createDataFrame([(None,)], "k string"), key, bits, hashes).count() == 0
