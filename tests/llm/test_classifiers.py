import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from crestline.llm import quality, toxicity
from crestline.llm.training import MAX_WORD, fit_temperature, labelled_sample, pieces, text_batches, words_of


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", *(f"word{i}" for i in range(300))]) for _ in range(n)).capitalize() + "."


def toxic_rows(rng, n):
    rows = []
    for i in range(n):
        words, y = prose(rng, rng.randrange(20, 300)).split(), rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if y else 0):
            words.insert(rng.randrange(len(words)), f"nastyx{rng.randrange(10**6)}")
        rows.append((" ".join(words), int(y)))
    return rows


def junk_rows(rng, n):
    rows = []
    for _ in range(n):
        y = rng.random() < 0.7
        text = prose(rng, rng.randrange(10, 200))
        rows.append((text if y else rng.choice([text.upper().replace(" ", "!! "), " ".join(w for w in text.split() for _ in range(9)), text.replace(" ", "### ")]), int(y)))
    return rows


def accuracy(module, rows, test):
    model = module.fit(rows)
    scores = module.score(model, pa.array([t for t, _ in test]))
    assert ((0 <= scores) & (scores <= 1)).all()
    return float(((scores >= 0.5) == np.array([bool(y) for _, y in test])).mean())


def test_unseen_spellings_of_toxic_words():
    rng = random.Random(0)
    assert accuracy(toxicity, toxic_rows(rng, 800), toxic_rows(rng, 300)) >= 0.97


def test_junk():
    rng = random.Random(0)
    assert accuracy(quality, junk_rows(rng, 500), junk_rows(rng, 200)) >= 0.97


@pytest.mark.parametrize("module", [quality, toxicity])
def test_degenerate_samples(module):
    texts = pa.array(["a b", "", "c"])
    assert module.score(module.fit([]), texts).tolist() == [0.5] * 3
    assert (module.score(module.fit([("a", 1), ("b", 1)]), texts) > 0.5).all()
    assert (module.score(module.fit([("a", 0)]), texts) < 0.5).all()
    assert len(module.score(module.fit([("", 0), ("", 1)]), texts)) == 3


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_do_not_depend_on_batches(module, monkeypatch):
    rng = random.Random(1)
    rows = (junk_rows if module is quality else toxic_rows)(rng, 120)
    model, texts = module.fit(rows), pa.array([t for t, _ in rows])
    whole = module.score(model, texts)
    single = np.concatenate([module.score(model, texts.slice(i, 1)) for i in range(len(texts))])
    monkeypatch.setattr(module, "SLICE", 13)
    assert np.allclose(whole, single, atol=1e-5) and np.allclose(whole, module.score(model, texts), atol=1e-5)


def test_convolution_against_plain_loops():
    rng = random.Random(2)
    model = toxicity.fit(toxic_rows(rng, 60))
    texts = ["One two three, four!", "", "a", "nastyx1 nastyx22 b c d"]
    got = toxicity._pooled(model, *words_of(pa.array(texts, pa.large_string()), True, toxicity.TRIM))
    for row, text in zip(got, texts, strict=True):
        words = [w.strip(toxicity.TRIM) for w in text.lower().split()]
        vectors = [model.table[toxicity.hash_words(pa.array([w], pa.large_string()), len(model.table))[0]].mean(0) for w in words]
        want = []
        for width, f in model.filters.items():
            out = [sum(vectors[i + j] @ f[j] for j in range(width)) for i in range(len(words) - width + 1)]
            want.append(np.maximum(0, np.max(out, axis=0)) if out else np.zeros(f.shape[2]))
        assert np.allclose(row, np.concatenate(want), atol=1e-4)


def test_index_vectors_and_shapes():
    v = quality.index_vector("unit")
    assert (v == quality.index_vector("unit")).all() and 1 <= np.abs(v).sum() <= quality.NONZERO
    assert [quality.shape(w) for w in ("The", "THE!!", "a-b", "x12###", "été.")] == ["Aa", "A!!", "a-a", "a9##", "a."]


def test_every_byte_of_a_word_counts():
    for word in ("a" * 64 + "b", "ab" * 5000, "你好世界" * 20 + "abc" * 10 + "世", "x" * 100 + "世" + "y" * 3, "ü" * 70):
        assert "".join(pieces(word)) == word and max(len(x.encode()) for x in pieces(word)) <= MAX_WORD
    assert pieces("你好a" * 20)[:3] == ["你", "好", "a"]
    numbers, words, starts = words_of(pa.array(["a " + "b" * 65 + " c", "", "d" * 64], pa.large_string()), False, None)
    assert [words[i].as_py() for i in numbers] == ["a", *["b" * 16] * 4, "b", "c", "d" * 64] and starts.tolist() == [0, 7, 7, 8]
    a, b = (toxicity.hash_words(pa.array([w], pa.large_string()), 1 << 40)[0, 0] for w in ("a" * 80 + "x", "a" * 80 + "y"))
    assert a != b
    assert quality.shape("a1" * 40) == "a9" * 40


def test_pooled_vectors_and_network_against_plain_loops():
    rng = random.Random(5)
    model = quality.fit(junk_rows(rng, 150))
    texts = [t for t, _ in junk_rows(rng, 12)] + ["", "One one ONE? two", "a" * 200]
    for text, got in zip(texts, quality.score(model, pa.array(texts)), strict=True):
        words, total, before = [p for w in text.split() for p in (pieces(w) if len(w.encode()) > MAX_WORD else [w])], 0.0, None
        total = np.zeros(model.vectors.shape[1])
        for w in words:
            if w == before:
                unit = model.units[quality.REPEAT]
            else:
                unit = model.units.get(w, model.units.get("shape " + quality.shape(w), len(model.units)))
            total, before = total + model.vectors[unit], w
        x = (total / max(1, len(words)) - model.mean) / model.scale
        w1, b1, w2, b2 = model.layers
        hidden = [np.tanh(sum(x[i] * w1[i, h] for i in range(len(x))) + b1[h]) for h in range(len(b1))]
        logit = sum(v * w for v, w in zip(hidden, w2, strict=True)) + b2[0]
        assert got == pytest.approx(1 / (1 + np.exp(-logit / model.temperature)), abs=1e-6)


def test_word_vectors_against_plain_loops():
    texts = [t for t, _ in junk_rows(random.Random(6), 20)]
    units, vectors = quality.word_vectors(pa.array(texts, pa.large_string()), 8, min_count=5)
    names = [*units, None]
    context = np.zeros((len(names), 8))
    for text in texts:
        words = text.split()
        at = [units[quality.REPEAT] if i and words[i - 1] == w else units.get(w, units.get("shape " + quality.shape(w), len(units))) for i, w in enumerate(words)]
        for i in range(len(at)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(at):
                    context[at[i]] += vectors[at[j], :8]
    norm = np.maximum(np.linalg.norm(context, axis=1), 1e-9)
    assert np.allclose(vectors[:, 8:], context / norm[:, None])
    assert all((vectors[i, :8] == quality.index_vector(u, 8)).all() for u, i in units.items())


def test_batched_gradients_against_single_texts():
    rng, widths = np.random.default_rng(7), (1, 2, 3)
    table, slots = rng.normal(size=(50, 4)).astype(np.float32), rng.integers(0, 50, (30, 4))
    params = {f"f{w}": rng.normal(size=(w, 4, 5)).astype(np.float32) for w in widths} | {"out": rng.normal(size=15).astype(np.float32), "bias": np.zeros(1, np.float32)}
    size = np.array([7, 0, 1, 2, 12, 3])
    starts = np.concatenate([[0], np.cumsum(size)])
    numbers, y, weight = rng.integers(0, 30, starts[-1]), rng.integers(0, 2, 6).astype(float), rng.random(6)
    grads, hit, change = toxicity._step(table, slots, params, widths, *toxicity._batch(numbers, starts, np.arange(6)), y, weight)
    total = np.zeros_like(table)
    np.add.at(total, hit.ravel(), np.repeat(change, 4, axis=0) / 4)
    want, moved = {k: np.zeros_like(v) for k, v in params.items()}, np.zeros_like(table)
    for d in np.flatnonzero(size):  # the chain rule, text by text
        vectors = table[slots[numbers[starts[d] : starts[d + 1]]]].mean(1)
        top, place = np.zeros(15, np.float32), {}
        for k, w in enumerate(widths):
            for f in range(5):
                out = [sum(vectors[i + j] @ params[f"f{w}"][j][:, f] for j in range(w)) for i in range(size[d] - w + 1)]
                if out:
                    place[k * 5 + f] = int(np.argmax(out))
                    top[k * 5 + f] = max(0, max(out))
        error = (1 / (1 + np.exp(-(top @ params["out"]))) - y[d]) * weight[d]
        want["out"] += error * top
        want["bias"] += error
        for c, i in place.items():
            w, f = widths[c // 5], c % 5
            g = error * params["out"][c] * (top[c] > 0)
            for j in range(w):
                want[f"f{w}"][j][:, f] += g * vectors[i + j]
                np.add.at(moved, slots[numbers[starts[d] + i + j]], g * params[f"f{w}"][j][:, f] / 4)
    assert all(np.allclose(grads[k], want[k], atol=1e-4) for k in want) and np.allclose(total, moved, atol=1e-4)


def test_sample_is_bounded_in_bytes_and_by_repeats(spark):
    docs = spark.createDataFrame([(i % 7, "x" * (10 + i)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    ids = [i for i in range(7) if zlib.crc32(str(i).encode()) % 3 != 1]
    sample = labelled_sample(docs, labels, "quality", 3, 1, 100, 1000)  # most labelled ids have no text: more are taken
    assert sorted(sample) == sorted(("x" * (10 + i), i % 2) for i in ids)
    assert labelled_sample(docs, labels, "quality", 3, 1, 100, 1000, max_bytes=30) == sample[:2]
    assert labelled_sample(docs, labels, "quality", 3, 1, 2, 1000) == sample[:2]
    assert labelled_sample(docs, labels, "quality", 3, 1, 2, 5) == []


def test_rejecting_null_and_repeated_texts(spark):
    rows = [(1, None, 0.1), (2, "", 0.2), (3, "good words", 0.3), (3, "good words", 0.4), (None, "good words", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted(quality.reject_low_quality(docs, labels.limit(0)).collect(), key=str)
    assert got == sorted(docs.collect(), key=str)  # one half for all
    kept = {r.score for r in quality.reject_low_quality(docs, labels, threshold=0.9).collect()}
    assert kept in ({0.3, 0.4, 0.5}, set(), {0.1, 0.2}, {0.1, 0.2, 0.3, 0.4, 0.5})
    assert quality.reject_low_quality(docs.limit(0), labels).collect() == []


def test_helpers():
    numbers, words, starts = words_of(pa.array(["a b a", "", " , c."]), False, ".,")
    assert [words[i].as_py() for i in numbers] == ["a", "b", "a", "c"] and starts.tolist() == [0, 3, 3, 4]
    batches = list(text_batches(pa.array(["aa", None, "b" * 50, "c"]), 10))
    assert [x for b in batches for x in b.to_pylist()] == ["aa", "", "b" * 50, "c"] and len(batches) == 3
    y = np.array([0, 1] * 50)
    assert fit_temperature((y * 2 - 1) * 10.0 * np.where(np.arange(100) % 10 == 0, -1, 1), y) > 2


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(5, "text 5"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(3, 0, 0), (None, 1, 1), (4, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, labels, "quality", 3, 1, 1000, 100)
    ids = [int(t.split()[1]) for t, _ in sample if t]
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids) and len(set(ids)) > 100
    assert all(y == i % 2 for (t, y), i in zip([s for s in sample if s[0]], ids, strict=True))
    assert sample == labelled_sample(docs.repartition(7), labels.repartition(3), "quality", 3, 1, 1000, 100)
    assert len(labelled_sample(docs, labels, "quality", 3, 1, 10, 100)) == 10
    assert labelled_sample(docs, labels, "quality", 3, 1, 1000, 0) == [("", 1)] * (zlib.crc32(b"7") % 3 != 1)


@pytest.mark.parametrize("make", [lambda d, x: quality.quality_scores(d, x, train_rows=300), lambda d, x: toxicity.toxicity_scores(d, x, train_rows=300)])
def test_edges(spark, make):
    rows = [(1, None, "x"), (2, "", "x"), (3, "some text", "x"), (3, "some text", "x"), (None, "some text", "x"), (4, "w " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    got = make(docs, labels).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id in (3, None)}) == 1
    assert make(docs.limit(0), labels).count() == 0
    assert {r.score for r in make(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    for df, label, divisor, held, least in ((quality.quality_scores(docs, labels), "quality", 3, 1, 0.97), (toxicity.toxicity_scores(docs, labels), "toxic", 5, 0, 0.9)):
        rows = df.join(labels, "doc_id").collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == held) for r in rows)
        test = [r for r in rows if r.held_out]
        assert sum(r.predicted == r[label] for r in test) / len(test) >= least, label
