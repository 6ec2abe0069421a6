import math

import duckdb
import pytest

from crestline.llm.mixing import find_exponent, mix_sources, word_count
from crestline.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, text string, source string, weight string"


def corpus():
    rows, i = [], 0
    for source, docs, words in (("hot", 300, 40), ("mid", 60, 30), ("small", 12, 20), (None, 8, 10), ("one", 1, 400), ("blank", 3, 0)):
        for k in range(docs):
            rows.append((i, " ".join(["w"] * (words + k % 7 if words else 0)), source, "clash"))
            i += 1
    return rows


def check_against_sql(rows, got, ratio, target, repeats):
    sql = ORACLE_SQL["op3_source_mixing"].replace("* 1.25", f"* {ratio}").replace("0.95::double", f"{target}::double").replace("<= 4)", f"<= {repeats})")
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar, source varchar, weight varchar)")
    if rows:
        c.executemany("insert into documents values (?, ?, ?, ?)", rows)
    rel = c.sql(sql)
    order = ["doc_id", "source", "n_tokens", "weight", "epoch", "order_key"]
    want = sorted((tuple(r[rel.columns.index(k)] for k in order) for r in rel.fetchall()), key=str)
    assert sorted(((*r[:3], round(r[3], 9), *r[4:]) for r in map(tuple, got)), key=str) == want


@pytest.mark.parametrize(("ratio", "target", "repeats"), [(1.0, 0.95, 4.0), (1.25, 0.95, 4.0), (0.5, 0.99, 100.0), (1.0, 0.999, 2.0), (3.0, 0.5, 4.0), (0.0, 0.9, 4.0)])
def test_against_sql(spark, ratio, target, repeats):
    rows = corpus()
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), target, repeats, ratio).rows.collect()
    check_against_sql(rows, got, ratio, target, repeats)


def test_budgets_and_permutations(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    m = mix_sources(df, target=0.95, max_repeats=50)
    rows = m.rows.collect()
    budgets = {r.skey: r for r in m.sources.collect()}
    tokens = {k: r.tokens for k, r in budgets.items()}
    assert 0 < m.exponent < 1
    p = {k: r.weight for k, r in budgets.items()}
    assert abs(sum(p.values()) - 1) < 1e-9
    assert -sum(w * math.log(w) for w in p.values()) >= 0.95 * math.log(len(p)) - 1e-9
    largest = {"shot": 46, "smid": 36, "ssmall": 26, "n": 16, "sone": 400}
    for k, b in budgets.items():
        used = sum(r.n_tokens for r in rows if ("n" if r.source is None else "s" + r.source) == k)
        assert b.budget - largest[k] < used <= b.budget, k
    assert not any(r.source == "blank" for r in rows)
    small = [[r.doc_id for r in sorted(rows, key=lambda r: r.order_key) if r.source == "small" and r.epoch == e] for e in (0, 1)]
    assert sorted(small[0]) == sorted(small[1]) and small[0] != small[1] and tokens["ssmall"] * 2 <= budgets["ssmall"].budget


def test_repetition_limit_wins(spark):
    m = mix_sources(spark.createDataFrame(corpus(), SCHEMA), target=1.0, max_repeats=1.5)
    assert all(r.budget <= 1.5 * r.tokens + 1 for r in m.sources.collect())


def brute_exponent(tokens, target, repeats, budget):
    def weights(a):
        z = sum(t**a for t in tokens)
        return [t**a / z for t in tokens]

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a))

    k1 = max(k for k in range(1025) if k == 0 or entropy(k / 1024) >= target * math.log(len(tokens)))
    k2 = next((k for k in range(1025) if max(w * budget / t for w, t in zip(weights(k / 1024), tokens, strict=True)) <= repeats), 1024)
    return max(k1, k2) / 1024


@pytest.mark.parametrize(("tokens", "target", "repeats"), [([1000, 10, 5], 0.9, 9.0), ([1000, 10, 5], 0.9, 3.0), ([5, 5], 0.99, 4.0), ([7], 0.9, 4.0), ([10**9, 1], 0.5, 1e9)])
def test_exponent(spark, tokens, target, repeats):
    df = spark.createDataFrame([(t,) for t in [*tokens, 0]], "tokens long")
    assert find_exponent(df, target, repeats, sum(tokens))[0] == pytest.approx(brute_exponent(tokens, target, repeats, sum(tokens)), abs=2 / 1024)


def test_edges(spark):
    rows = [(1, "a b", "x", None), (1, "a b", "x", None), (None, "c d e", "x", None), (2, None, "y", None), (3, " \t ", "x", None), (4, "w " * 60_000, "z", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(df, budget_ratio=1.25).rows.collect()
    check_against_sql(rows, got, 1.25, 0.95, 4)
    assert mix_sources(df.limit(0)).rows.count() == 0
    assert mix_sources(df.where("doc_id = 2")).rows.count() == 0
    assert [r.n for r in df.select("doc_id", word_count(df.text).alias("n")).orderBy("doc_id", "n").collect()] == [3, 2, 2, 0, 0, 60_000]


def test_native(spark):
    plan = mix_sources(spark.createDataFrame(corpus(), SCHEMA)).rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
