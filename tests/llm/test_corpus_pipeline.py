import os

import pytest

import corpus_pipeline as P
from crestline.llm import decontam, mixing, neardup, quality, secrets
from crestline.llm.common import materialise, shared_dir
from crestline.llm.queries import ORACLE_SQL, QUERIES
from crestline.llm.simhash import words_of
from crestline.llm.training import labelled_sample


def test_registered():
    import __spark_entry__ as e

    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
    assert set(ORACLE_SQL) <= set(e.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "secret_scan", "mixing"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(materialise(stage(spark, out[-1], sf), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_against_brute_force(spark, sf, stages):
    import pyarrow as pa

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs, good, unique, clean, safe, mixed = stages
    assert all(x.columns == docs.columns for x in stages[:-1])
    # quality: the model of the same sample, document by document
    model = quality.fit(labelled_sample(docs, labels, "quality", 3, 1, quality.TRAIN_ROWS, quality.TRAIN_CHARS))
    assert set(texts(good)) == {i for i, t in texts(docs).items() if quality.score(model, pa.array([t]))[0] >= 0.5}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    wrong = [i for i in texts(docs) if i in marked and (i in texts(good)) != bool(marked[i])]
    assert len(wrong) <= 0.03 * len(marked)
    # near duplicates: all pairs
    rows = texts(good)
    sets = {i: neardup.shingle_set(words_of(t.encode())) for i, t in rows.items()}
    root = {i: i for i in rows}
    ids = sorted(rows)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if neardup._near(sets[a], sets[b], 0.8)]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert set(texts(unique)) == {i for i in ids if root[i] == i}
    # leaks
    items = [set(decontam.shingles_of(decontam.words_of(r.text.encode()), 5)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, t in texts(unique).items() for s in items if len(s & set(decontam.shingles_of(decontam.words_of(t.encode()), 5))) >= 0.8 * len(s)}
    assert leaks and set(texts(clean)) == set(texts(unique)) - leaks
    # secrets
    count = secrets.token_counter(secrets.vocabulary(spark))
    want = {}
    for i, t in texts(clean).items():
        base = secrets.base_spans(t)
        want[i] = secrets.redact(t, base + secrets.random_spans(t, count, base, secrets.MAX_CHARS_PER_TOKEN, secrets.MIN_RANDOM))
    assert texts(safe) == want  # these few documents hold none; test_spans covers documents that do
    assert all(r.n_chars == len(r.text) for r in safe.collect())
    # mixture: whole documents, as they were cleaned
    rows = mixed.collect()
    assert mixed.columns == [*docs.columns, "n_tokens", "weight", "epoch", "order_key"]
    assert rows and all(want[r.doc_id] == r.text and r.n_tokens == len((r.text or "").split()) for r in rows)
    plain = mixing.mix_sources(safe).rows
    assert sorted(map(tuple, plain.collect())) == sorted(tuple(r[c] for c in plain.columns) for r in rows)


def test_run_and_empty(spark, sf, stages, tmp_path):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = P.run(spark, sf)
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"pipeline-secret_scan", "mix-tokens", "mix-budgets", "mix-ends", "mix-places", "mix-sources-ends"}  # what the result is read from
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 17])
def test_mixture_of_odd_tables(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    rows = [(1, "a b c", "x", 0.5, "k"), (1, "a b c", "x", 0.6, "k"), (None, "d e", None, 0.1, "k"), (2, None, "x", 0.2, "k"), (3, "", "y", 0.3, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Weight double, h string")
    got = mixing.mix_sources(df, carry=True).rows
    assert got.columns == ["doc_id", "text", "source", "h", "n_tokens", "weight", "epoch", "order_key"]
    assert {(r.doc_id, r.text) for r in got.collect()} <= {r[:2] for r in rows} and got.where("source = 'y'").count() == 0
    assert mixing.mix_sources(df.limit(0), carry=True).rows.count() == 0


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text, and columns named like the stages' own."""
    good = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect() if r.text and len(r.text.split()) > 40][:12]
    key = "qX7fK2pLz9VbT4mWc8RdY1sN"
    rows = [(r.doc_id, r.text, r.lang, r.source, len(r.text)) for r in good]
    rows += [(None, None, None, None, None), (None, "", "en", "web", 0), (9001, f"{good[0].text} the key is {key} here", "en", "web", 5), (9002, " ".join(r.text for r in good) * 20, "en", None, 7)]
    rows += [(rows[0][0], rows[0][1], "xx", "other", 1), rows[1], rows[1]]
    wide = [(*r, i, i * 0.5, "x", i % 2 == 0) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _near0 int, weight double, epoch string, held_out boolean"
    docs = spark.createDataFrame(wide, schema)
    assert {r._near0 for r in P.quality(spark, docs, sf).collect()} <= set(range(len(wide)))
    unique = P.near_dedup(spark, docs, sf).collect()
    assert [len([r for r in unique if r.text == rows[k][1]]) for k in (0, 1)] == [1, 1] and len([r for r in unique if not r.text]) == 1
    assert sorted(P.near_dedup(spark, docs.repartition(5), sf).collect(), key=str) == sorted(unique, key=str)
    assert {r._near0 for r in P.decontamination(spark, docs, sf).collect()} >= {12, 13}
    safe = {r._near0: r for r in P.secret_scan(spark, docs, sf).collect()}
    assert len(safe) == len(wide) and safe[12].text is None and key not in safe[14].text and "[random]" in safe[14].text and safe[14].n_chars == len(safe[14].text)
    mixed = P.mixing(spark, docs, sf)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "_near0", "held_out", "n_tokens", "weight", "epoch", "order_key"]
    assert {r._near0 for r in mixed.collect()} <= set(range(len(wide)))
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
