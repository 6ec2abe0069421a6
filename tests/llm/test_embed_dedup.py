import numpy as np
import pytest

from crestline.llm import embed_dedup
from crestline.llm.embed_dedup import agreement, codes_for, embedding_components, near, near_pairs, passes_for


def brute(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= threshold
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(near, root[None, :], len(x)).min(1)
        if (new == root).all():
            break
        root = new
    return near.sum(1) - 1, root


@pytest.mark.parametrize(("window", "block"), [(1024, 2048), (128, 20)])
def test_against_brute_force(spark, window, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 500)] + rng.normal(size=(500, 16)) * 0.33, np.repeat(centres[:1], 30, 0)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    links, root = brute(x)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=window, block=block).collect()}
    assert got == {i: (links[i], root[i], root[i] == i) for i in range(len(x))}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [1.0, 0.0], 1), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (None, [0.0, 1.0], 0), (None, [0.0, 1.0], 0), (10, [1e300, 1e300], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector int")
    got = sorted(map(tuple, embedding_components(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 1, None, False), (None, 1, None, False), *alone], key=str)
    assert embedding_components(df.limit(0)).count() == 0
    assert embedding_components(df.where("vec_id = 5")).collect()[0].kept


def test_more_vectors_need_more_passes():
    passes = [min(passes_for(meet) for _, meet in codes_for(n)) for n in (1, 10_000, 1_000_000, 1_000_000_000)]
    assert passes[0] == 2 and passes == sorted(passes) and passes[-1] <= 80
    assert 0.4 < agreement(0.9, 64) < agreement(0.9, 8) < agreement(0.95, 8) < 1


def test_borderline_pairs_get_one_answer():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 48))
    x /= np.sqrt((x * x).sum(1))[:, None]
    whole = near(x, x, 0.0)
    for t in np.unique((x[:20] * x[100]).sum(1)):  # each of these is some pair's cosine
        whole = near(x, x, t)
        found = np.zeros_like(whole)
        found[near_pairs(x, x, t)] = True
        assert (found == whole).all()
        for rows in (1, 7, 64):
            assert all((near(x[lo : lo + rows], x[90:111], t) == whole[lo : lo + rows, 90:111]).all() for lo in range(0, 21, rows))


@pytest.mark.parametrize("parallelism", [4, 1000])
def test_links_do_not_depend_on_the_cluster(spark, monkeypatch, parallelism):
    """A thousand planted pairs, pieces of 64 rows, windows of 32: whatever the number of tasks, the same links."""
    monkeypatch.setattr(embed_dedup, "ROWS_PER_TASK", 64)
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base, aside = unit(rng.normal(size=(1000, 32))), rng.normal(size=(1000, 32))
    aside = unit(aside - (aside * base).sum(1)[:, None] * base)
    c = rng.uniform(0.901, 0.93, 1000)[:, None]
    x = np.concatenate([base, base * c + aside * (1 - c * c) ** 0.5])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(parallelism if parallelism < 100 else 50)
    spark.conf.set("spark.sql.shuffle.partitions", "4" if parallelism == 4 else "60")
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(df, window=32).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    links, root = brute(x)
    assert sum(got[i] == (links[i], root[i]) for i in got) >= 0.995 * len(x)
    seen = test_links_do_not_depend_on_the_cluster.__dict__.setdefault("seen", got)
    assert seen == got


def test_hot_cone_against_brute_force(spark):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    axis, n, d = unit(rng.normal(size=256)), 6000, 256
    cone = unit(axis * 0.8**0.5 + unit(rng.normal(size=(n // 3, d))) * 0.2**0.5)
    aside = unit(rng.normal(size=(300, d)))
    aside = unit(aside - (aside * cone[:300]).sum(1)[:, None] * cone[:300])
    pairs = cone[:300] * 0.905 + aside * (1 - 0.905**2) ** 0.5
    x = np.concatenate([cone, pairs, unit(rng.normal(size=(n - n // 3, d)))])
    links, root = brute(x)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embedding_components(df, window=32).collect()}
    linked = [i for i in range(len(x)) if root[i] != i]
    assert len(linked) >= 300
    missed = sum(got[i] != root[i] for i in linked)
    print("linked", len(linked), "missed", missed)
    assert missed <= 0.01 * len(linked)
