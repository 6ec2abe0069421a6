"""Embedding near-duplicates by sorted projection passes.

A pass orders all vectors lexicographically by concatenated random hashes and compares each with a bounded window of its
neighbours; pairs verified by cosine are joined across passes. A hash is the random projection, of several, that a vector
points along most, with its sign: two vectors at the threshold agree on one far more often than on as many bits of signs
of single projections. The number of passes follows from the number of vectors, the window, the recall asked for at the
threshold itself and how dense the cells of a sample are. The order is first taken over codes alone, which gives the
places where it is cut; vectors then go straight to their piece, together with the window before it, so that links do
not depend on the number of tasks. Links are then counted exactly within each component, without listing pairs: vectors
within half the threshold's angle of the component's leader are all linked to each other, and only the others are
compared, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import discard, local_roots, materialise
from crestline.llm.components import connected_components

THRESHOLD = 0.9
WINDOW = 1024
#: projections that a hash may choose from, bits of a code, and hashes beyond those that even cells need
WAYS, BITS, SPARE = (4, 8, 16, 32, 64), 62, 4
RECALL = 0.999
PASSES_AT_ONCE = 4
MAX_PASSES = 128
TRIALS = 2
SAMPLE = 1 << 15
ROWS_PER_TASK = 1 << 14
#: pieces of one pass at most: beyond it pieces grow, so that the list of cuts stays small
MAX_PIECES = 1 << 16
BLOCK = 2048
#: products this near to the threshold are summed again in one fixed order
_DOUBT = 1e-9
_CHUNK = 512
_SEED = 20_240


@cache
def agreement(threshold: float, ways: int) -> float:
    """How often two vectors at the threshold agree on one hash, from a fixed sample of their projections."""
    rng = np.random.default_rng(_SEED)
    x = rng.normal(size=(1 << 15, ways))
    y = threshold * x + math.sqrt(1 - threshold**2) * rng.normal(size=x.shape)
    return float((_digit(x) == _digit(y)).mean())


def _digit(projected: np.ndarray) -> np.ndarray:
    at = np.abs(projected).argmax(1)
    return 2 * at + (np.take_along_axis(projected, at[:, None], 1)[:, 0] > 0)


class Code(NamedTuple):
    """How vectors are coded: projections of a hash, and hashes one behind the other."""

    ways: int
    digits: int

    @property
    def bits(self) -> int:
        return (2 * self.ways - 1).bit_length()


def codes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW) -> list[tuple[Code, float]]:
    """Codes for n vectors, and how often each brings two vectors at the threshold within one window if cells are even.

    They must agree on so many hashes that a cell of those that do has no more rows than a window.
    """
    out = []
    for ways in WAYS:
        need = math.ceil(math.log(n / window, 2 * ways)) if n > window else 0
        out.append((Code(ways, max(1, min(need + SPARE, BITS // (2 * ways - 1).bit_length()))), agreement(threshold, ways) ** need))
    return out


def passes_for(meet: float, recall: float = RECALL) -> int:
    """Passes after which a pair has met with probability ``recall``, if it does in one with probability ``meet``."""
    return 2 if meet >= 1 else max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def meeting(codes: list[np.ndarray], code: Code, n: int, threshold: float = THRESHOLD, window: int = WINDOW) -> float:
    """How often a pair at the threshold meets in a pass, from how many leading hashes cells of at most ``window`` rows have
    around the densest tenth of rows.

    codes: those of a sample of the n vectors, an array for each trial pass. Vectors in one cone agree on most hashes, so
    that a pair must agree on far more of them before no more than a window lies between the two.
    """
    rows = max(1, window * len(codes[0]) // max(n, 1))
    if len(codes[0]) <= rows:
        return 1.0
    same, meet = agreement(threshold, code.ways), np.zeros(len(codes[0]))
    for found in codes:
        order = np.argsort(found, kind="stable")
        apart = found[order][rows:] ^ found[order][:-rows]
        shared = code.digits - np.ceil(np.ceil(np.log2(apart.astype(np.float64) + 1)) / code.bits).astype(np.int64)
        around = np.concatenate([np.full(rows, -1), shared, np.full(rows, -1)])
        depth = 1 + np.lib.stride_tricks.sliding_window_view(around, rows + 1).max(1)
        meet[order] += same ** np.clip(depth, 1, code.digits) / len(codes)
    return float(np.sort(meet)[: max(1, len(meet) // 10)].mean())


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision of a list column whose lists are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x have a cosine of at least the threshold with which rows of y; both are unit rows.

    A matrix product rounds differently by its shape, so products in doubt are summed again, term by term in one order:
    the same two vectors always get the same answer.
    """
    product = x @ y.T
    out = product >= threshold
    i, j = np.nonzero(np.abs(product - threshold) <= _DOUBT)
    for lo in range(0, len(i), 1 << 14):
        a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
        out[a, b] = (x[a] * y[b]).sum(1) >= threshold
    return out


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The (row of x, row of y) that near() marks, with one look at each product: for few pairs."""
    product = x @ y.T
    i, j = np.nonzero(product >= threshold - _DOUBT)
    keep = product[i, j] > threshold + _DOUBT
    doubt = np.flatnonzero(~keep)
    for lo in range(0, len(doubt), 1 << 14):
        at = doubt[lo : lo + (1 << 14)]
        keep[at] = (x[i[at]] * y[j[at]]).sum(1) >= threshold
    return i[keep], j[keep]


def _planes(d: int, code: Code, passes: range) -> list[np.ndarray]:
    return [np.random.default_rng(_SEED + p).normal(size=(d, code.digits * code.ways)) for p in passes]


def _coded(batches: Iterator[pa.RecordBatch], code: Code, passes: range) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(pass, codes, rows) for slices of (node, vector): the hashes of a code stand one behind the other, the first counts most."""
    planes = None
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            unit = matrix(part.column(1))
            planes = planes or _planes(unit.shape[1], code, passes)
            for p, plane in zip(passes, planes, strict=True):
                projected, found = (unit @ plane).reshape(len(unit), code.digits, code.ways), np.zeros(len(unit), np.int64)
                for k in range(code.digits):
                    found = (found << code.bits) | _digit(projected[:, k])
                yield p, found, part


def _codes(codes: list[Code], passes: range):
    """(node, vector) into (way, pass, code, node) for each of the codes and passes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for way, code in enumerate(codes):
                for p, found, part in _coded(iter([batch]), code, passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), way, np.int32)), pa.array(np.full(len(found), p, np.int32)), pa.array(found), part.column(0)], names=["way", "pass", "code", "node"])

    return scan


def plan_passes(nodes: DataFrame, n: int, threshold: float, window: int, recall: float) -> tuple[Code, int]:
    """The code and the number of passes for (node, vector): the fewest that a sample asks for, of at most SAMPLE vectors or so."""
    codes = codes_for(n, threshold, window)
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(math.ceil(n / SAMPLE))) == 0)
    trial = sample.mapInArrow(_codes([c for c, _ in codes], range(TRIALS)), "way int, pass int, code long, node long").toArrow().sort_by("node")
    way, number, found = (trial[c].to_numpy() for c in ("way", "pass", "code"))
    best: tuple[int, Code] | None = None
    for w, (code, meet) in enumerate(codes):
        if len(found):
            meet = min(meet, meeting([found[(way == w) & (number == p)] for p in range(TRIALS)], code, n, threshold, window))
        passes = min(MAX_PASSES, passes_for(meet, recall))
        if best is None or passes < best[0]:
            best = passes, code
    return best[1], best[0]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (pass, code, node, part) with their number within the task."""
    n = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + batch.num_rows))], names=["pass", "code", "node", "part", "i"])
        n += batch.num_rows


def _cuts(codes: DataFrame, n: int, passes: int, window: int) -> tuple[DataFrame, DataFrame]:
    """The order of codes as a table, and (pass, code, node, piece, held) of it: where each piece of a pass begins, and where the window before it begins (held).

    codes: (pass, code, node), n rows in each pass. Places follow from exact ranks, which only take the number of rows in each task
    of a sort of codes; there are at most two cuts a piece, so the list is small whatever n is.
    """
    size = max(ROWS_PER_TASK, window, math.ceil(n / MAX_PIECES))
    spread = codes.repartitionByRange(max(1, math.ceil(n * passes / (1 << 20))), "pass", "code", "node").sortWithinPartitions("pass", "code", "node")
    ranked = materialise(spread.select("pass", "code", "node", F.spark_partition_id().alias("part")).mapInArrow(_numbered, "pass int, code long, node long, part int, i long"), "code-order")
    counts = ranked.groupBy("part", "pass").agg(F.count("*").alias("n"), F.min("i").alias("first")).orderBy("part", "pass").collect()
    seen: dict[int, int] = {}
    rows = []
    for r in counts:  # a row for each task and pass
        rows.append((r["part"], r["pass"], seen.get(r["pass"], 0) - r["first"]))
        seen[r["pass"]] = seen.get(r["pass"], 0) + r["n"]
    shift = F.broadcast(codes.sparkSession.createDataFrame(rows, "part int, pass int, shift long"))
    rank = ranked.join(shift, ["part", "pass"]).select("pass", "code", "node", (F.col("i") + F.col("shift")).alias("rank"))
    piece, back = F.floor(F.col("rank") / size).cast("int"), F.floor((F.col("rank") + window) / size).cast("int")
    starts = rank.where(F.col("rank") % size == 0).select("pass", "code", "node", piece.alias("piece"), F.lit(False).alias("held"))
    holds = rank.where((F.col("rank") + window) % size == 0).select("pass", "code", "node", back.alias("piece"), F.lit(True).alias("held"))
    return ranked, starts.unionByName(holds)


class Cuts:
    """The cuts of one pass, to find the pieces of its rows."""

    def __init__(self, rows: list[tuple[int, int, int]], holds: list[tuple[int, int, int]]):
        """Rows and holds: (code, node, piece), sorted by code and node."""
        self.starts, self.holds = (self._table(x) for x in (rows, holds))

    @staticmethod
    def _table(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray, np.ndarray], code: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The last piece that begins at or before each row, -1 if none does."""
        codes, nodes, piece = table
        if not len(codes):
            return np.full(len(code), -1)
        lo, hi = np.searchsorted(codes, code, "left"), np.searchsorted(codes, code, "right")
        at = hi - 1
        for i in np.flatnonzero(hi > lo):  # rows that share their code with a cut
            at[i] = lo[i] + np.searchsorted(nodes[lo[i] : hi[i]], node[i], "right") - 1
        return np.where(at >= 0, piece[np.maximum(at, 0)], -1)

    def of(self, code: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece of each row, and the one after it if the row stands in the window before that, else -1."""
        own, held = self._find(self.starts, code, node), self._find(self.holds, code, node)
        return own, np.where(held > own, held, -1)


def _dealt(code: Code, passes: range, shared):
    """(node, vector) into (piece, held, code, node, vector): a row for its piece of each pass, and one for each window it stands in."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, found, part in _coded(batches, code, passes):
            node = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own, after = shared.value[p].of(found, node)
            again = np.flatnonzero(after >= 0)
            row = np.concatenate([np.arange(len(node)), again])
            piece = np.concatenate([np.maximum(own, 0), after[again]]) * len(passes) + (p - passes.start)
            held = np.repeat([False, True], [len(node), len(again)])
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(held), pa.array(found[row]), pa.array(node[row]), part.column(1).take(pa.array(row))], names=["piece", "held", "code", "node", "vector"])

    return scan


def _window_scan(threshold: float, window: int):
    """Spanning links of sorted rows (piece, held, node, vector): every row that is not held against the ``window`` rows before it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, node, piece = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new_piece, held, new_node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            new_x, before = matrix(batch.column(3)), len(node)
            x = new_x if x is None else np.concatenate([x, new_x])
            node, piece = np.concatenate([node, new_node.astype(np.int64)]), np.concatenate([piece, new_piece.astype(np.int64)])
            held = np.concatenate([np.ones(before, bool), held])
            root = np.arange(len(node))
            for lo in range(before, len(node), _CHUNK):
                hi, back = min(lo + _CHUNK, len(node)), max(0, lo - window)
                i, j = near_pairs(x[lo:hi], x[back:hi], threshold)
                i, j = i + lo, j + back
                fit = (j < i) & (i - j <= window) & (piece[i] == piece[j]) & ~held[i]
                fit = fit & (root[i] != root[j]) & (node[i] != node[j])
                if fit.any():
                    pair = np.unique(root[i[fit]] * len(node) + root[j[fit]])
                    root = local_roots(len(node), pair // len(node), pair % len(node))[root]
            child = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root[child]])], names=["a", "b"])
            x, node, piece = x[-window:].copy(), node[-window:].copy(), piece[-window:].copy()

    return scan


def _pass_links(nodes: DataFrame, n: int, threshold: float, window: int, recall: float) -> DataFrame | None:
    """(a, b) links found in all passes over (node, vector), written a few passes at a time."""
    kind, found, context = nodes.schema["vector"].dataType.simpleString(), None, nodes.sparkSession.sparkContext
    order = "pass int, code long, node long"
    code, total = plan_passes(nodes, n, threshold, window, recall)
    for lo in range(0, total, PASSES_AT_ONCE):
        passes = range(lo, min(lo + PASSES_AT_ONCE, total))
        codes = materialise(nodes.mapInArrow(_codes([code], passes), f"way int, {order}").drop("way"), "codes")
        ranked, cuts = _cuts(codes, n, len(passes), window)
        by_pass: dict[int, tuple[list, list]] = {p: ([], []) for p in passes}
        for r in cuts.collect():
            by_pass[r["pass"]][r["held"]].append((r["code"], r["node"], r["piece"]))
        shared = context.broadcast({p: Cuts(sorted(a), sorted(x for x in b if x[2] < len(a))) for p, (a, b) in by_pass.items()})
        pieces = sum(len(a) for a, _ in by_pass.values())
        rows = nodes.mapInArrow(_dealt(code, passes, shared), f"piece long, held boolean, code long, node long, vector {kind}")
        spread = rows.repartition(pieces, "piece").sortWithinPartitions("piece", "code", "node")
        links = materialise(spread.select("piece", "held", "node", "vector").mapInArrow(_window_scan(threshold, window), "a long, b long").distinct(), "embedding-links")
        discard(ranked)
        discard(codes)
        found = links if found is None else found.unionByName(links)
    return found


def _leader_scan(half: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                close = (matrix(batch.column(3)) * matrix(batch.column(4))).sum(1) >= half
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(close)], names=["root", "node", "times", "vector", "near"])

    return scan


def _block_scan(threshold: float):
    """Partial counts (node, links) of groups of outer rows and rows of one block, sorted by group."""

    def counts(outer: np.ndarray, node: np.ndarray, times: np.ndarray, close: np.ndarray, vector: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x, o, a = matrix(vector), np.flatnonzero(outer), np.flatnonzero(~outer)
        link = near(x[o], x[a], threshold) & (node[o][:, None] != node[a][None, :])
        return np.concatenate([node[o], node[a]]), np.concatenate([link @ times[a], np.where(close[a], times[o] @ link, 0)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool) -> Iterator[tuple[pa.Table, bool]]:
            key = np.stack([table[k].to_numpy() for k in ("root", "o", "b")], axis=1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                yield table.slice(lo, hi - lo), hi < len(key) or last

        def emit(parts: list[pa.Table]) -> pa.RecordBatch:
            nodes, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t in parts:
                got = counts(*(t[c].to_numpy() for c in ("outer", "node", "times", "near")), t["vector"].combine_chunks())
                nodes.append(got[0])
                links.append(got[1])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links).astype(np.int64))], names=["node", "links"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = table if held is None else pa.concat_tables([held, table])
                whole = []
                for t, complete in groups(table, False):
                    if complete:
                        whole.append(t)
                    else:
                        held = t
                yield emit(whole)
        if held is not None:
            yield emit([held])

    return scan


def _counted(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links): times that other vectors link to each of (root, node, times, vector), exact within its component."""
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    kind = members.schema["vector"].dataType.simpleString()
    leaders = members.where("node = root").select("root", F.col("vector").alias("leader"))
    near_leader = members.join(leaders, "root").select("root", "node", "times", "vector", "leader").mapInArrow(_leader_scan(half), f"root long, node long, times long, vector {kind}, near boolean")
    near_leader = materialise(near_leader, "near-leaders")
    sizes = materialise(near_leader.groupBy("root").agg(F.sum(F.when(F.col("near"), F.col("times")).otherwise(0)).alias("ball"), F.count("*").alias("n"), F.count_if(~F.col("near")).alias("outer")), "component-sizes")
    parts = near_leader.join(sizes.where("outer > 0").select("root", F.ceil(F.col("n") / block).cast("long").alias("nb"), F.ceil(F.col("outer") / block).cast("long").alias("no")), "root")
    zero = F.lit(0).cast("long")
    spread = parts.withColumn("own_b", F.pmod(F.xxhash64("node"), "nb")).withColumn("own_o", F.pmod(F.xxhash64(F.lit(1), "node"), "no"))
    columns = ("root", "o", "b", "outer", "node", "times", "near", "vector")
    outer = spread.where(~F.col("near")).withColumn("b", F.explode(F.sequence(zero, F.col("nb") - 1))).withColumnRenamed("own_o", "o").withColumn("outer", F.lit(True)).select(*columns)
    every = spread.withColumn("o", F.explode(F.sequence(zero, F.col("no") - 1))).withColumnRenamed("own_b", "b").withColumn("outer", F.lit(False)).select(*columns)
    grouped = outer.unionByName(every).repartition("root", "o", "b").sortWithinPartitions("root", "o", "b")
    partial = grouped.mapInArrow(_block_scan(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    in_ball = near_leader.join(sizes, "root").select("node", F.when(F.col("near"), F.col("ball") - F.col("times")).otherwise(F.lit(0)).alias("mutual"))
    return in_ball.join(partial, "node", "left").select("node", (F.col("mutual") + F.coalesce("links", F.lit(0))).alias("links"))


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Equal vectors are one class from the start (equal 128-bit hashes count as equal). Null, empty and zero vectors and
    those with null or non-finite components link with nothing and are their own component. Vectors of different
    lengths are never linked. Repeated ids are separate rows; a null id counts as a link, is never kept, and its
    component is the smallest non-null id reachable. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("ok", _valid(F.col("vector"))).withColumn("k1", F.when(F.col("ok"), F.xxhash64("vector"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit("second"), "vector")))
    keyed = materialise(rows.select("vec_id", "k1", "k2"), "embedding-keys")
    classes = rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.any_value("vector").alias("vector"))
    nodes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "embedding-classes")
    sizes = nodes.groupBy(F.size("vector").alias("d")).count().collect()
    links = None
    for d, n in sorted((r["d"], r["count"]) for r in sizes):
        same = nodes if len(sizes) == 1 else nodes.where(F.size("vector") == d)
        found = _pass_links(same.select("node", "vector"), n, threshold, window, recall)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    roots = materialise(connected_components(links, label="embedding-components"), "embedding-roots")
    members = materialise(nodes.join(roots, "node").select("root", "node", "times", "vector"), "embedding-members")
    counted = None
    for d in sorted(r["d"] for r in sizes):
        same = members if len(sizes) == 1 else members.where(F.size("vector") == d)
        part = _counted(same, threshold, block)
        counted = part if counted is None else counted.unionByName(part)
    joined = nodes.drop("vector").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = joined.join(least, "root").join(counted, "node", "left")
    labelled = materialise(labelled.select("k1", "k2", "component_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "embedding-labels")
    discard(members)
    bad = keyed.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    good = keyed.where("k1 is not null").join(labelled, ["k1", "k2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
