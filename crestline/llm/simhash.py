"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's 64 positions are mapped to the non-zero vectors of GF(2)^(r+1); table v keeps the positions whose
vector has an odd product with v. Any r positions span at most r dimensions, so some v is orthogonal to all of them:
two fingerprints that differ in r bits or fewer agree on every kept bit of that table. 2^(r+1) - 1 tables thus find
every pair within the radius, without false negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import LOWER, byte_texts, local_roots, materialise
from crestline.llm.components import connected_components

SEED = 42
RADIUS = 3
NGRAM = 3
BLOCK = 2048
_CHUNK = 1 << 16


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: A-Z lower-cased, split at space and 09-0D only."""
    return text.translate(LOWER).split()


def shingles_of(words: list[bytes], n: int) -> Iterator[bytes]:
    """Space-joined runs of n words with repeats; fewer words give the whole sequence once, none give nothing."""
    if len(words) < n:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))


def fingerprint(words: list[bytes], n: int = NGRAM, seed: int = SEED) -> int:
    """Bit set where it is set in over half of the shingles' XXH64; unsigned, zero without words."""
    counts, total = np.zeros(64, np.int64), 0
    steps = max(1, len(words) - n + 1)
    for lo in range(0, steps, _CHUNK):
        part = words[lo : lo + _CHUNK + n - 1]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles_of(part, n), repeat(seed)), np.uint64)
        if len(h):
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(h)
    bits = np.packbits(counts * 2 > total, bitorder="little") if total else np.zeros(8, np.uint8)
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """(id, fp) with the fingerprint's 64 bits in a signed long; a null text is an empty one. One narrow Arrow pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(words_of(x), ngram, seed) for x in byte_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask for each non-zero v of GF(2)^(radius+1), as signed 64-bit numbers; positions are spread evenly."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(64)] if top <= 64 else [1 + (i * 37) % (top - 1) for i in range(64)]
    masks = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _compare(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within each run of equal keys; the smallest fingerprint of a local component is its centre."""
    n = len(fps)
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    left = np.repeat(start + size, size) - np.arange(n) - 1
    us, vs, step = [], [], 1
    at = np.flatnonzero(left >= 1)
    bits = fps.view(np.uint64)
    while len(at):
        near = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= radius]
        us.append(near)
        vs.append(near + step)
        step += 1
        at = at[left[at] >= step]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    root = local_roots(n, a, b)
    child = np.flatnonzero(root != np.arange(n))
    return fps[child], fps[root[child]]


def _bucket_scan(radius: int, block: int):
    """Rows (key, fp) sorted by key into links (a, b), and (null, null, hot) for each bucket of over ``block`` rows.

    A bucket is held until it ends or proves hot; the rest of a hot one is skipped, so memory is bounded.
    """

    def out(a: np.ndarray, b: np.ndarray, hot: list[int]) -> pa.RecordBatch:
        none = pa.nulls(len(hot), pa.int64())
        columns = [pa.concat_arrays([pa.array(a), none]), pa.concat_arrays([pa.array(b), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(hot, pa.int64())])]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "hot"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, skipped = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def finished(cut: int) -> pa.RecordBatch:
            k, f = key[:cut], fp[:cut]
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if cut else np.zeros(0, np.int64)
            size = np.diff(np.append(start, cut))
            cold = np.repeat(size <= block, size)
            return out(*_compare(k[cold], f[cold], radius), k[start[size > block]].tolist())

        for batch in batches:
            more_key, more_fp = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if skipped is not None:
                keep = more_key != skipped
                more_key, more_fp = more_key[keep], more_fp[keep]
            if not len(more_key):
                continue
            key, fp, skipped = np.concatenate([key, more_key]), np.concatenate([fp, more_fp]), None
            cut = int(np.searchsorted(key, key[-1]))
            if len(key) - cut > block:  # hot: the rest of it is not needed
                skipped, cut = int(key[-1]), len(key)
            yield finished(cut)
            key, fp = key[cut:], fp[cut:]
        yield finished(len(key))

    return scan


def _pair_scan(radius: int):
    """Groups (key) of sorted rows, each no larger than two blocks: links only."""
    scan = _bucket_scan(radius, 1 << 62)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            yield batch.select(["a", "b"])

    return links


def links_within(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b) links that join all fingerprints within ``radius`` bits of each other into the same components.

    fps: distinct column ``fp``. A bucket's key is a hash of its table and masked bits, so that a row is two numbers;
    buckets that share a key are compared as one. Buckets of over ``block`` fingerprints are named by the first pass and
    dealt into blocks, and every two blocks meet in a group of their own: no task holds more than two blocks of a
    bucket and no link is lost. A task returns a spanning forest of a bucket, not its pairs.
    """
    masks = covering_masks(radius)
    keys = F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)))
    rows = fps.select(F.explode(keys).alias("key"), "fp")
    found = materialise(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_scan(radius, block), "a long, b long, hot long"), "bucket-links")
    links = found.where("hot is null").select("a", "b")
    hot = found.where("hot is not null").select(F.col("hot").alias("key")).distinct()
    if not hot.isEmpty():
        parts = materialise(rows.join(hot, "key").groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("n")), "hot-buckets")
        dealt = rows.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit("block")), "n"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        group = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        pairs = dealt.select(group.alias("key"), "fp").repartition("key").sortWithinPartitions("key")
        links = links.unionByName(pairs.mapInArrow(_pair_scan(radius), "a long, b long"))
    return links.distinct()


def label_fingerprints(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, component_id): the smallest id reachable from a fingerprint, for every distinct fp of (id, fp)."""
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("rep")), "fp-classes")
    roots = connected_components(links_within(classes.select("fp"), radius, block), label="fp-components")
    keyed = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    keyed = materialise(keyed, "fp-roots")
    least = keyed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return materialise(keyed.join(least, "root").select("fp", "component_id"), "fp-labels")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints form a class first, so copies cost one candidate. Null and empty texts have fingerprint zero
    and are linked like any other. Repeated ids keep their rows; a null id gets a fingerprint and the smallest
    non-null id of its component (null if there is none). No rows give no rows. Other columns are not read, so their
    names cannot clash.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, ngram), "fingerprints")
    labels = label_fingerprints(prints, radius, block)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(labels, "fp").select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")
