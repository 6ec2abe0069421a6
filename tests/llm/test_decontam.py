import random

import duckdb
import pytest

from crestline.llm import decontam as D
from crestline.llm.queries import ORACLE_SQL, QUERIES


def brute(docs, items, n=5, threshold=0.8):
    out = []
    for d, text in docs:
        have = set(D.shingles_of(D.words_of((text or "").encode()), n))
        for i, item in items:
            want = set(D.shingles_of(D.words_of((item or "").encode()), n))
            if want and len(have & want) >= threshold * len(want):
                out.append((d, i, len(have & want), len(want), len(have & want) / len(want)))
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 5, 6, 9, 20, 40, 60, 130])))) for i in range(40)]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.choice([0, 3, 30, 300, 3000]))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                if part:
                    part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if rng.random() < 0.3 else w + "," for w in part]
        docs.append((d, " ".join(words)))
    docs += [(900 + i, t) for i, t in items[:5]]
    return docs, items


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    docs, items = make(seed)
    got = D.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_blocks_of_items_and_words(spark, monkeypatch):
    docs, items = make(2)
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 7)
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, D.contaminated_pairs(df, it).collect()), key=str) == brute(docs, items)
    kept = {r.doc_id for r in D.drop_contaminated(df, it).collect()}
    assert kept == {d for d, _ in docs} - {b[0] for b in brute(docs, items)}
    monkeypatch.setattr(D, "_SLICE_WORDS", 50)
    half = [D.build_index(items[:20]), D.build_index(items[20:])]
    sizes = sorted({size for x in half for size in x.partitions})
    got = sorted(((docs[d][0], i, n) for d, i, n, _ in D.search(lambda: half, sizes, [t.encode() for _, t in docs])), key=str)
    assert got == [b[:3] for b in brute(docs, items)]


def test_repeated_items_in_bounded_blocks(spark, monkeypatch):
    """One text that most items share is one entry of one index; blocks are counted before they are collected."""
    docs, items = make(4)
    items += [(1000 + i, items[7][1] or "w1 w2 w3") for i in range(300)] + [(2000 + i, f"only words of item {i}") for i in range(60)]
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 9)
    taken, plain = [], D.item_blocks
    monkeypatch.setattr(D, "item_blocks", lambda x: (taken.append(len(b)) or b for b in plain(x)))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, D.contaminated_pairs(df, it).collect()), key=str) == brute(docs, items)
    assert len(taken) > 9 and max(taken) <= 9 and sum(taken) == len({t for _, t in items})
    kept = {r.doc_id for r in D.drop_contaminated(df, it).collect()}
    assert kept == {d for d, _ in docs} - {b[0] for b in brute(docs, items)}


def test_dropping_from_odd_tables(spark):
    docs = [(1, None, "k", 1), (2, "", "k", 2), (None, "p q r s t u", "k", 3), (3, "p q r s t u v", "k", 4), (3, "p q r s t u v", "k", 5), (4, "clean text here", "k", 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, n_item long")
    items = spark.createDataFrame([(None, "p q r s t u", 0), (1, "p q r s t u", 0), (2, None, 0), (3, "", 0)], "item_id long, text string, doc_id long")
    assert sorted(r.n_item for r in D.drop_contaminated(df, items).collect()) == [1, 2, 6]
    assert D.drop_contaminated(df, items.limit(0)).count() == 6 and D.drop_contaminated(df.limit(0), items).count() == 0


def test_edges(spark):
    long = "x y " * 100_000
    docs = [(1, None, "k"), (2, "", "k"), (3, "a b c", "k"), (3, "A, b c!", "k"), (None, "p q r s t u v", "k"), (4, long + "p q r s t u v", "k"), (5, "a b c d", "k")]
    items = [(10, "a b c", 1.0), (10, "p q r s t u", 1.0), (None, "q r s t u", 1.0), (11, None, 1.0), (12, "", 1.0)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, containment double")
    assert sorted(map(tuple, D.contaminated_pairs(df, it).collect()), key=str) == brute([d[:2] for d in docs], [i[:2] for i in items])
    for a, b in ((df.limit(0), it), (df, it.limit(0))):
        assert D.contaminated_pairs(a, b).count() == 0
        assert D.drop_contaminated(a, b).count() == a.count()


def test_query(spark, sf):
    got = QUERIES["op7_benchmark_decontamination"](spark, sf).collect()
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.sql(ORACLE_SQL["op7_benchmark_decontamination"]).fetchall())
