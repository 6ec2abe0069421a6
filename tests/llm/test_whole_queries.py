"""The queries that SQL cannot express, over whole tables, against brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_embed_dedup import brute as brute_vectors
from test_licenses import BASE_PHRASES, brute_places, brute_words
from test_simhash import brute_components, brute_fingerprint
from test_spans import key, plain_pii, plain_secrets

from crestline.llm import quality, toxicity
from crestline.llm.queries import ORACLE_SQL, QUERIES
from crestline.llm.training import labelled_sample


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_op4(spark, sf, documents):
    ids = sorted(documents)
    prints = [brute_fingerprint(documents[i]) for i in ids]
    want = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_components(ids, prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_near_dedup"](spark, sf).collect()} == want


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op5_pii_spans", plain_pii, ("email", "ip", "card", "phone")), ("op9_secret_scan", plain_secrets, ("assign", "access", "hex"))])
def test_op5_op9(spark, sf, documents, name, plain, kinds):
    rows = QUERIES[name](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        want = plain(documents[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(key(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[3] == k for x in want) for k in kinds]
        assert set(filter(None, key(want).split(","))) <= set(r.spans.split(","))


def test_op6(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    links, root = brute_vectors(np.array([r.embedding for r in table], np.float64))
    want = {r.vec_id: (n, table[c].vec_id, c == i) for i, (r, n, c) in enumerate(zip(table, links, root, strict=True))}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op6_embedding_near_dedup"](spark, sf).collect()} == want


def test_op6_with_links(spark, tmp_path):
    """The driver's vectors have no near neighbours; here a third lie in one cone, others in small groups, some repeat."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([centres[0] + 0.3 * rng.normal(size=(300, 32)), centres[rng.integers(1, 40, 400)] + 0.27 * rng.normal(size=(400, 32)), rng.normal(size=(200, 32))])
    x = unit(np.concatenate([x, x[:20], 3 * x[300:310]])).astype(np.float32)
    rows = [(i * 7, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    wide = x.astype(np.float64)
    links, root = brute_vectors(wide)
    assert 500 < (links > 0).sum() and len(set(root[:300])) < 50
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op6_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i * 7: (links[i], root[i] * 7, root[i] == i) for i in range(len(x))}
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in c.sql(ORACLE_SQL["op6_embedding_near_dedup"]).fetchall()} == got


def test_op10(spark, sf, documents):
    for r in QUERIES["op10_license_scan"](spark, sf).collect():
        words = brute_words(documents[r.doc_id])
        places = sorted((i, label) for phrase, label in BASE_PHRASES for i in brute_places(words, phrase))
        base = sorted({label for _, label in places})
        ends = (places[0][0], places[-1][0]) if places else (None, None)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), *ends, ",".join(base))
        assert set(base) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@pytest.mark.parametrize(("name", "module", "label", "divisor", "held"), [("op1_quality_classifier", quality, "quality", 3, 1), ("op8_toxicity", toxicity, "toxic", 5, 0)])
def test_op1_op8(spark, sf, documents, name, module, label, divisor, held):
    tables = [spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels")]
    model = module.fit(labelled_sample(*tables, label, divisor, held, module.TRAIN_ROWS, module.TRAIN_CHARS))
    rows = QUERIES[name](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == held)
        assert r.score == pytest.approx(module.score(model, pa.array([documents[r.doc_id]]))[0], abs=1e-4) and r.predicted == int(r.score >= 0.5)
