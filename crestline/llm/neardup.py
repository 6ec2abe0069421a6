"""Near-duplicate groups by SimHash and MinHash bands, held against a Jaccard similarity of word shingles.

Candidates come from two sides. The SimHash operator's components, with its own shingles and radius, hold every text
whose fingerprint is within three bits of another one's. MinHash bands follow the shingle overlap itself, so it does not
matter whether texts differ by scattered words or by a passage: two texts agree on one MinHash value with a probability
of their Jaccard similarity, and are candidates if all values of one of the bands agree. Components of both together
are then verified: every text against its component's leader, and those that are not near it against all texts of the
component, in blocks. Only verified links join documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import byte_texts, discard, local_roots, materialise
from crestline.llm.components import connected_components
from crestline.llm.decontam import shingle_hashes
from crestline.llm.simhash import fingerprint, label_fingerprints, words_of

NGRAM = 5
SIMILARITY = 0.8
#: A pair at the threshold shares none of the bands with probability (1 - 0.8 ** 7) ** 40 = 8e-5.
BANDS = 40
BAND_ROWS = 7
#: rows of five numbers that are broadcast at most, some 20 MB; larger tables are joined by a shuffle
BROADCAST_ROWS = 1 << 19
BLOCK = 256
LEADERS = 4
COLUMNS_AT_ONCE = 1 << 14
_AT_ONCE = 512
_SEED = 2_024


def _permutations(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors and terms of the MinHash values, and odd factors that mix a band's values into one number."""
    rng = np.random.default_rng(_SEED)
    a, b = (rng.integers(0, 1 << 32, bands * rows, np.uint32) for _ in range(2))
    return a | np.uint32(1), b, rng.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One signed 64-bit number for each band: a hash of the band and its MinHash values over the set of shingles."""
    a, b, odd = _permutations(bands, rows) if (bands, rows) != (BANDS, BAND_ROWS) else _STANDARD
    h = (shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(h), _AT_ONCE):
        np.minimum(low, (h[lo : lo + _AT_ONCE, None] * a + b).min(0), out=low)
    x = ((low.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * odd).sum(1, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


_STANDARD = _permutations(BANDS, BAND_ROWS)


def shingle_set(words: list[bytes], n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer than n words are one shingle."""
    return np.unique(shingle_hashes(words, n)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct numbers; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def _near(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    small, large = sorted((len(a), len(b)))
    return small >= similarity * large and jaccard(a, b) >= similarity


def _candidate_scan(ngram: int, bands: int, rows: int):
    """Fingerprint and band keys of each text, from one look at its words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part, fps, keys = batch.slice(lo, 1024), [], []
                for x in byte_texts(part.column(3)):
                    words = words_of(x)
                    fps.append(fingerprint(words))
                    keys.append(band_keys(shingle_set(words, ngram), bands, rows))
                found = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *found], names=["id", "k1", "k2", "fp", "keys"])

    return scan


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) sorted by key into links (x, y) of every node with the first one of its key."""
    key, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        firsts = np.concatenate([[0 if first is None else first], nodes[new]])[np.cumsum(new)]
        key, first, linked = keys[-1], firsts[-1], nodes != firsts
        yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(firsts[linked])], names=["x", "y"])


def _shingle_scan(ngram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [shingle_set(words_of(x), ngram) for x in byte_texts(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["root", "node", "s"])

    return scan


def _leader_scan(similarity: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [_near(a.values.to_numpy(), b.values.to_numpy(), similarity) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return scan


def shared_counts(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """How many numbers each of rows shares with each of columns (arrays of distinct numbers), by matrix products.

    Only numbers found on both sides take part, a bounded number of them at a time.
    """
    out = np.zeros((len(rows), len(columns)), np.int64)
    left, right = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, columns))
    both = np.intersect1d(left, right)
    of_left, of_right = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (rows, columns))
    for lo in range(0, len(both), COLUMNS_AT_ONCE):
        part = both[lo : lo + COLUMNS_AT_ONCE]
        sides = []
        for values, owner, n in ((left, of_left, len(rows)), (right, of_right, len(columns))):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            side = np.zeros((n, len(part)), np.float32)
            side[owner[hit], at[hit]] = 1
            sides.append(side)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def _block_scan(similarity: float):
    """Verified spanning links of sorted groups (root, o, b): outer rows against the rows of one block."""

    def links(outer: list[bool], nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        o, a = np.flatnonzero(outer), np.flatnonzero(~np.array(outer))
        size = np.array([len(x) for x in sets])
        same = shared_counts([sets[i] for i in o], [sets[i] for i in a])
        union = size[o][:, None] + size[a][None, :] - same
        i, j = np.nonzero((same >= similarity * union) & (nodes[o][:, None] != nodes[a][None, :]))
        root = local_roots(len(nodes), o[i], a[j])
        child = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[child], nodes[root[child]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, outer, nodes, sets = None, [], [], []

        def flush() -> pa.RecordBatch:
            a, b = links(outer, np.array(nodes, np.int64), sets)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for k, o, n, s in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
                if k != key:
                    if nodes:
                        yield flush()
                    key, outer, nodes, sets = k, [], [], []
                outer.append(o)
                nodes.append(n)
                sets.append(s.values.to_numpy())
        if nodes:
            yield flush()

    return scan


def verified_links(members: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect exactly the nodes of (root, node, s) that verified pairs connect.

    Every node is compared with a few leaders of its component: its root and some that a hash picks. Nodes that these
    links join to the root need no look among themselves. All other pairs have an end outside; such nodes meet every
    block of their component, in groups of at most two blocks.
    """
    bare = members.select("root", "node")
    picked = bare.groupBy("root").agg(*(F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node"))["node"].alias(f"l{k}") for k in range(LEADERS - 1)))
    leaders = picked.select("root", F.explode(F.array_distinct(F.array("root", *(f"l{k}" for k in range(LEADERS - 1))))).alias("center"))
    leaders = materialise(leaders.join(members.select(F.col("node").alias("center"), F.col("s").alias("leader")), "center"), "leaders")
    compared = members.join(leaders, "root").where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b"), "s", "leader")
    star = materialise(compared.mapInArrow(_leader_scan(similarity), "a long, b long").distinct(), "leader-links")
    joined = connected_components(star, label="leader-groups").select("node", F.col("root").alias("c"))
    joined = materialise(bare.join(joined, "node", "left").select("root", "node", F.coalesce("c", "node").alias("c")), "leader-clusters")
    inside = joined.where("node = root").select("root", F.col("c").alias("main"))
    near = materialise(joined.join(inside, "root").select("root", "node", (F.col("c") == F.col("main")).alias("near")), "near-root")
    sizes = near.groupBy("root").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("outer")).where("outer > 0")
    sizes = materialise(sizes.select("root", F.ceil(F.col("n") / block).cast("long").alias("nb"), F.ceil(F.col("outer") / block).cast("long").alias("no")), "outer-sizes")
    parts = members.join(near.select("node", "near"), "node").join(sizes, "root")
    parts = parts.withColumn("own_b", F.pmod(F.xxhash64("node"), "nb")).withColumn("own_o", F.pmod(F.xxhash64(F.lit(1), "node"), "no"))
    zero = F.lit(0).cast("long")
    columns = ("root", "o", "b", "outer", "node", "s")
    outer = parts.where(~F.col("near")).withColumn("b", F.explode(F.sequence(zero, F.col("nb") - 1))).withColumnRenamed("own_o", "o").withColumn("outer", F.lit(True)).select(*columns)
    every = parts.withColumn("o", F.explode(F.sequence(zero, F.col("no") - 1))).withColumnRenamed("own_b", "b").withColumn("outer", F.lit(False)).select(*columns)
    grouped = outer.unionByName(every).repartition("root", "o", "b").sortWithinPartitions("root", "o", "b")
    return star.unionByName(grouped.mapInArrow(_block_scan(similarity), "a long, b long").distinct())


def _bounded(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has no more than BROADCAST_ROWS rows: texts then stay where they are."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _unused(n: int, taken: list[str]) -> list[str]:
    """Names that no column has, in any case of letters."""
    known = {x.lower() for x in taken}
    return [x for x in (f"_near{i}" for i in range(n + len(known))) if x not in known][:n]


def drop_near_duplicates(docs: DataFrame, ngram: int = NGRAM, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns: of each group of near duplicates the row with the smallest doc_id stays.

    Equal texts are one class from the start (equal 128-bit hashes count as equal; null is an empty text). A null id
    is larger than any other; of rows with equal id and text the one with the smallest hash of all its columns stays, so
    that every run keeps the same. Candidates are the SimHash operator's components and texts that share a band; groups
    are connected by verified pairs only. Empty tables stay empty; columns may have any name, and very long texts are
    compared whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    bare = docs.select(F.col("doc_id").cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    prints = materialise(bare.select("id", "k1", "k2"), "text-keys")
    classes = prints.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "text-classes")
    named = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep", "node")
    match = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("id").eqNullSafe(F.col("rep"))

    scanned = bare.mapInArrow(_candidate_scan(ngram, bands, band_rows), "id long, k1 long, k2 long, fp long, keys array<long>")
    keyed = materialise(scanned.join(named, match).select("node", "fp", "keys"), "candidate-keys")
    labels = label_fingerprints(keyed.select(F.col("node").alias("id"), "fp"))
    alike = keyed.select("node", "fp").join(labels, "fp").where("node <> component_id").select(F.col("node").alias("x"), F.col("component_id").alias("y"))
    buckets = keyed.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    edges = materialise(buckets.mapInArrow(_bucket_links, "x long, y long").unionByName(alike).distinct(), "candidate-links")
    discard(keyed)
    discard(labels)
    roots = materialise(connected_components(edges, "x", "y", "candidate-components"), "candidate-roots")
    wanted = materialise(roots.join(named, "node"), "candidate-classes")
    chosen = bare.join(_bounded(wanted), match)
    members = chosen.select("root", "node", "text").mapInArrow(_shingle_scan(ngram), "root long, node long, s array<long>").groupBy("root", "node").agg(F.any_value("s").alias("s"))
    members = materialise(members, "candidate-shingles")
    groups = materialise(connected_components(verified_links(members, similarity, block), label="near-groups"), "near-roots")
    for used in (members, wanted, roots, edges):
        discard(used)

    order = F.struct(F.col("rep").isNull(), F.col("rep"), F.col("node"))
    labelled = classes.select("k1", "k2", "rep", "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = materialise(labelled, "class-groups")
    keepers = labelled.groupBy("root").agg(F.min(order)["node"].alias("node")).select("node", F.lit(True).alias("keeper"))
    kept = materialise(labelled.join(keepers, "node", "left").select("k1", "k2", "rep", F.coalesce("keeper", F.lit(False)).alias("keeper")), "class-keepers")
    # written before it is aggregated, so that AQE can split the join at a text that many rows share
    rows = prints.select("id", "k1", "k2").join(kept, ["k1", "k2"])
    rows = materialise(rows.select("id", "k1", "k2", (F.col("keeper") & F.col("id").eqNullSafe(F.col("rep"))).alias("stays")), "row-decisions")
    stays = F.col("stays")
    i1, h1, h2, r1, r2, d1, d2, d3 = _unused(8, docs.columns)
    key = lambda df: df.select(F.col("id").alias(d1), F.col("k1").alias(d2), F.col("k2").alias(d3))
    dropped = materialise(key(rows.where(~stays)).distinct(), "dropped")
    again = materialise(key(rows.where(stays).groupBy("id", "k1", "k2").count().where("count > 1")), "repeated")
    for used in (rows, kept, labelled, groups, classes, prints):
        discard(used)
    marked = docs.withColumns({i1: F.col("doc_id").cast("long"), h1: k1, h2: k2})
    match = F.col(i1).eqNullSafe(F.col(d1)) & (F.col(h1) == F.col(d2)) & (F.col(h2) == F.col(d3))
    out = marked.join(_bounded(dropped), match, "left_anti")
    if not again.isEmpty():
        whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
        ranked = out.join(_bounded(again), match, "left_semi").withColumns({r1: F.xxhash64(whole), r2: F.xxhash64(F.lit("second"), whole)})
        least = materialise(ranked.groupBy(i1, h1, h2).agg(F.min(F.struct(r1, r2)).alias("least")), "first-of-repeated")
        least = least.select(F.col(i1).alias(d1), F.col(h1).alias(d2), F.col(h2).alias(d3), "least")
        once = ranked.join(least, match & (F.struct(F.col(r1), F.col(r2)) == F.col("least")), "left_semi").dropDuplicates([i1, h1, h2])
        out = out.join(_bounded(again), match, "left_anti").unionByName(once.drop(r1, r2))
    return out.drop(i1, h1, h2)
