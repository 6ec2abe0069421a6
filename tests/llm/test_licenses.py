import random
import re

import pytest

from crestline.llm.licenses import BASE_PHRASES, TEMPLATES, TemplateIndex, aligned_words, licence_digest, licence_scan, licence_statistics, phrase_places, words_of


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(p)] == p]


@pytest.mark.parametrize("seed", range(3))
def test_words_and_places(seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choice(["MIT", "license", " ", "-", "é", "Licenses", "mit license", "apache license ", "general public", " license"]) for _ in range(rng.randrange(20)))
        words = words_of(text.encode())
        assert [w.decode() for w in words] == brute_words(text)
        for phrase, _ in BASE_PHRASES:
            assert phrase_places(words, phrase.encode()) == brute_places(brute_words(text), phrase)


def index():
    return TemplateIndex({b"the": 900, b"of": 900, b"this": 800, b"to": 800, b"is": 700, b"and": 900, b"in": 900, b"a": 900, b"or": 700, b"under": 300}, 1000)


@pytest.mark.parametrize(("label", "text", "_phrases"), TEMPLATES)
def test_templates_find_themselves(label, text, _phrases):
    found = index().matches(words_of(f"Some words before. {text} And some after".encode()))
    assert (label, 1.0) in [(m.label, m.score) for m in found]
    assert [m.start for m in found if m.label == label][0] >= 3


def test_changed_and_missing_words():
    text = TEMPLATES[7][1]
    assert [m.label for m in index().matches(words_of(text.replace("are permitted", "is permitted").encode()))] == ["bsd"]
    assert index().matches(words_of(text.replace("source and binary", "code and object").encode())) == []  # a key phrase is gone
    assert index().matches(words_of(b"redistribution of the license in this work")) == []


def test_many_licences_in_one_file():
    text = " and then ".join(t for _, t, _ in TEMPLATES)
    assert {m.label for m in index().matches(words_of(text.encode()))} == {label for label, _, _ in TEMPLATES}


def test_no_word_but_a_mandatory_one_is_needed():
    isc = TEMPLATES[8][1].replace("copyright notice", "note").replace("copies", "ones")
    assert [m.label for m in index().matches(words_of(isc.encode()))] == ["isc"]


@pytest.mark.parametrize(("label", "text", "phrases"), TEMPLATES)
def test_a_word_put_in_loses_no_label(label, text, phrases):
    words = words_of(text.encode())
    for k in range(1, len(words)):
        now = [*words[:k], b"more", *words[k:]]
        line = b" " + b" ".join(now) + b" "
        if all(b" " + b" ".join(words_of(p.encode())) + b" " in line for p in phrases):
            assert label in [m.label for m in index().matches(now)]


def test_aligned_words_against_recursion():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert aligned_words(a, b) == table[-1][-1]


def test_matches_against_every_offset():
    """All templates at all offsets of short files, without index or ranking."""
    rng, idx = random.Random(6), index()
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = words_of(rng.choice(TEMPLATES)[1].encode())
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice([b"other", b"the"])
            parts += [b"x"] * rng.randrange(5) + words
        want = {}
        for label, template, phrases, slack in zip(idx.labels, idx.words, idx.phrases, idx.slack, strict=True):
            for at in range(-len(template), len(parts)):
                part = parts[max(0, at - slack) : at + len(template) + slack]
                if all(b" " + p + b" " in b" " + b" ".join(part) + b" " for p in phrases):
                    score = aligned_words(template, part) / len(template)
                    if score >= 0.6:
                        want[label] = max(want.get(label, 0), score)
        got = {m.label: m.score for m in idx.matches(parts)}
        assert got.keys() <= want.keys() and all(got[k] <= want[k] + 1e-9 for k in got)
        assert {k for k, s in want.items() if s >= 0.8} <= got.keys()


def test_long_files():
    rng = random.Random(3)
    every = [w for t in index().words for w in t]
    words = [rng.choice(every) for _ in range(400_000)] + words_of(TEMPLATES[7][1].encode())
    assert "bsd" in [m.label for m in index().matches(words)]


def test_frames(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a MIT License b mit  license", 0.5), (2, None, 0.1), (3, "", 0.1), (4, f"x {gpl}", 0.1), (4, f"x {gpl}", 0.1), (None, "Licensed under CC BY-NC 4.0.", 0.0), (5, "plain " * 50_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted(map(tuple, licence_digest(licence_scan(df)).collect()), key=str)
    one = (4, 13, 1, 8, 8, "gpl", "gpl", 1.0)
    assert got == sorted([(1, 6, 2, 1, 4, "mit", "mit", 1.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), one, one, (None, 7, 0, None, None, "", "cc-by-nc", 1.0), (5, 50_000, 0, None, None, "", "", 0.0)], key=str)
    assert licence_digest(licence_scan(df.limit(0))).count() == 0
    df_of, files = licence_statistics(df)
    assert files == 7 and df_of[b"gnu"] == 2
