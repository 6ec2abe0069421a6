import random

import numpy as np
import pytest

from crestline.llm import neardup
from crestline.llm.neardup import drop_near_duplicates, jaccard, shared_counts, shingle_set
from crestline.llm.simhash import fingerprint, words_of


def text(rng, n=120):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, words, k):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def brute_keep(rows):
    sets = [shingle_set(words_of((t or "").encode())) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    best = {}
    for i in range(len(rows)):
        r = find(i)
        if r not in best or order(i) < order(best[r]):
            best[r] = i
    return sorted((rows[i] for i in best.values()), key=str)


@pytest.mark.parametrize("block", [256, 4])
def test_against_brute_force(spark, block):
    rng, rows = random.Random(5), []
    for _ in range(30):
        base = text(rng)
        rows.append(base)
        for _ in range(rng.randrange(0, 4)):
            rows.append(edited(rng, base, rng.choice([0, 1, 2])))
    base = text(rng)
    rows += [edited(rng, base, 1) for _ in range(20)]  # every two differ in two places, the base is not among them
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, drop_near_duplicates(df, block=block).collect()), key=str)
    assert got == brute_keep(rows)


def test_edges(spark):
    rows = [(4, None, 1), (2, "", 2), (8, "same words here in this text", 3), (8, "same words here in this text", 3), (6, "same words here in this text", 4), (None, "only null has this one text", 5), (None, "only null has this one text", 5), (9, "x " * 50_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 long")
    got = sorted(map(tuple, drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([(2, "", 2), (6, rows[2][1], 4), (None, rows[5][1], 5), rows[7]], key=str)
    assert drop_near_duplicates(df.limit(0)).columns == df.columns
    assert drop_near_duplicates(df.limit(0)).count() == 0
    other = spark.createDataFrame([(1, "a b c d e f g", k, "x") for k in (3, 1, 2, 1)] + [(2, "a b c d e f g", 0, None)], "doc_id long, text string, _near0 long, _NEAR1 string")
    kept = [drop_near_duplicates(other.repartition(n)).collect() for n in (1, 3, 4)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1 and kept[0][0].doc_id == 1 and kept[0][0].asDict().keys() == {"doc_id", "text", "_near0", "_NEAR1"}
    twice = spark.createDataFrame([(1, "a b c d e f g", 1), (1, "a b c d e f g", 1)], "doc_id long, text string, k1 long")
    assert drop_near_duplicates(twice).count() == 1


@pytest.mark.parametrize("edit", ["append", "cut", "spread"])
def test_recall_by_kind_of_edit(spark, monkeypatch, edit):
    """Pairs at a similarity of 0.80 to 0.85, with tables that are broadcast and with tables that are not."""
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0 if edit == "cut" else 1 << 19)
    rng, rows = random.Random(edit), []
    while len(rows) < 300:
        base = [f"v{rng.randrange(20_000)}" for _ in range(220)]
        if edit == "append":
            other = base + [f"v{rng.randrange(20_000)}" for _ in range(rng.randrange(38, 54))]
        elif edit == "cut":
            other = base[: -rng.randrange(32, 43)]
        else:
            other = edited(rng, base, rng.choice([4, 5]))
        if 0.8 <= jaccard(*(shingle_set([w.encode() for w in x]) for x in (base, other))) <= 0.85:
            rows += [base, other]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == list(range(0, 300, 2))


def test_shingle_hashes_stand_for_shingles():
    rng = random.Random(12)
    for n in (0, 1, 4, 5, 6, 60):
        words = [b"w%d" % rng.randrange(4) for _ in range(n)]
        plain = {tuple(words[i : i + 5]) for i in range(max(1, n - 4))} if words else set()
        assert len(shingle_set(words)) == len(plain)
        other = [*words[1:], b"x"]
        both = plain & ({tuple(other[i : i + 5]) for i in range(max(1, len(other) - 4))} if words else set())
        assert len(np.intersect1d(shingle_set(words), shingle_set(other))) == len(both) or not words


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(0)
    rows, columns = ([np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(n)] for n in (7, 9))
    want = [[len(np.intersect1d(a, b)) for b in columns] for a in rows]
    assert shared_counts(rows, columns).tolist() == want
    monkeypatch.setattr(neardup, "COLUMNS_AT_ONCE", 5)
    assert shared_counts(rows, columns).tolist() == want
    assert shared_counts([], columns).shape == (0, 9) and not shared_counts(rows[:1], [np.zeros(0, np.int64)]).any()


def test_passages_against_brute_force(spark):
    rng, rows = random.Random(8), []
    for _ in range(12):
        base, more = text(rng, 200), text(rng, 30)
        k = rng.randrange(20, 150)
        rows += [base, base + more, base[:k] + more + base[k:], base[:k] + base[k + 24 :], base[:-30]]
        short = text(rng, 17)
        rows += [short, short[:-2]]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(brute_keep(rows)) == 24
    assert sorted(map(tuple, drop_near_duplicates(df).collect()), key=str) == brute_keep(rows)


@pytest.mark.parametrize("seed", [12044, 14974, 17080, 17658])
def test_simhash_finds_what_no_band_holds(spark, seed):
    """A similarity of 0.8 exactly, equal fingerprints and, with production parameters, no band in common."""
    base = [f"{c}{seed}" for c in "vwxyz"] * 40 + [f"{c}{seed}" for c in "abc"]
    pair = [base, base + [f"{c}{seed}" for c in "de"]]
    words = [[w.encode() for w in x] for x in pair]
    a, b = map(shingle_set, words)
    assert jaccard(a, b) == 0.8 and fingerprint(words[0]) == fingerprint(words[1])
    assert not (neardup.band_keys(a) == neardup.band_keys(b)).any()
    rows = [(i, " ".join(w)) for i, w in enumerate([*pair, ["of", "no", "group", "is", "this", "one"]])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, drop_near_duplicates(df).collect())) == [rows[0], rows[2]] == brute_keep(rows)


def test_simhash_links_are_verified(spark):
    """Equal fingerprints from a passage that repeats; what else these texts hold has nothing in common."""
    rows = [(i, " ".join(["v", "w", "x", "y", "z"] * 40 + [f"{c}{i}" for c in "abcd"])) for i in range(6)]
    assert len({fingerprint(words_of(t.encode())) for _, t in rows}) == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, drop_near_duplicates(df).collect())) == rows == brute_keep(rows)


def test_bands_meet_whatever_the_edit():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.choice([4, 36, 400, 4000])
        base = np.unique(np.array([rng.getrandbits(63) for _ in range(n)], np.int64))
        less = base[: -(-len(base) * 4 // 5)]
        assert jaccard(base, less) >= 0.8 or n < 5
        assert jaccard(base, less) < 0.8 or (neardup.band_keys(base) == neardup.band_keys(less)).any()
    assert len(neardup.band_keys(np.zeros(0, np.int64))) == neardup.BANDS
