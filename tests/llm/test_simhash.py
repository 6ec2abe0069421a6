import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from crestline.llm import simhash as S
from crestline.llm.components import connected_components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " ", "A", "a b", "A b\tC\nd", "é à É b", "x " * 10, "The cat sat on the mat. The cat sat."])
def test_fingerprint(text):
    assert S.fingerprint(S.words_of(text.encode())) == brute_fingerprint(text)


def test_long_texts_in_chunks(monkeypatch):
    rng = random.Random(0)
    words = [f"w{rng.randrange(50)}".encode() for _ in range(500)]
    whole = S.fingerprint(words)
    monkeypatch.setattr(S, "_CHUNK", 7)
    assert S.fingerprint(words) == whole


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_every_pair_within_the_radius_meets(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    assert any((x & m) & (2**64 - 1) == (y & m) & (2**64 - 1) for m in S.covering_masks(3))


def test_masks_of_larger_radii():
    rng = random.Random(1)
    masks = S.covering_masks(5)
    assert len(masks) == 63
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), 5))
        assert any(not flips & m & (2**64 - 1) for m in masks)


def brute_components(ids, prints, radius=3):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


@pytest.mark.parametrize("block", [2048, 3])
def test_links_against_brute_force(spark, block):
    rng = random.Random(block)
    prints = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints.append(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5)))
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    labels = {r.fp: r.component_id for r in S.label_fingerprints(df, block=block).collect()}
    assert [labels[x] for x in signed] == brute_components(list(range(len(prints))), prints)


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 500), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 400)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_of_the_contract(spark):
    rows = [(5, None, "x"), (3, "", "x"), (7, "\t ", "x"), (1, "one two", "x"), (1, "one two", "x"), (None, "one two", "x"), (9, "w " * 70_000, "x"), (None, "alone here now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = [tuple(r) for r in S.simhash_components(df).collect()]
    zero = "0" * 16
    assert sorted(got, key=str) == sorted([(5, zero, 3), (3, zero, 3), (7, zero, 3), *[(1, f"{brute_fingerprint('one two'):016x}", 1)] * 2, (None, f"{brute_fingerprint('one two'):016x}", 1), (9, f"{brute_fingerprint('w ' * 5):016x}", 9), (None, f"{brute_fingerprint('alone here now'):016x}", None)], key=str)
    assert S.simhash_components(df.limit(0)).count() == 0
