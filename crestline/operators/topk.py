"""Heavy hitters: exact, by Spark's sketch, and by Space-Saving."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.sources.storage import materialise

MAX_TRACKED = 1_000_000


def top_k(counts: DataFrame, n: int) -> DataFrame:
    """The n largest (query, cnt), ties by query; n of 0 or less gives none. A bounded heap in each task, then one merge."""
    return counts.orderBy(F.desc("cnt"), "query").limit(max(n, 0))


def pane_top_k(panes: DataFrame, n: int) -> DataFrame:
    """The n largest of each pane with their rank; Spark cuts groups before the shuffle."""
    order = Window.partitionBy("pane_us").orderBy(F.desc("cnt"), "query")
    return panes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("pane_us", "query", "cnt", "rank")


def sketch_top_k(events: DataFrame, n: int, tracked: int = 10_000, column: str = "query") -> DataFrame:
    """(query, cnt) estimates from a mergeable frequent-items sketch: memory bounded by ``tracked``, whatever the keys.

    Ties and order as in top_k; exact while there are no more than about three quarters of ``tracked`` keys.
    """
    if n <= 0:
        return events.sparkSession.createDataFrame([], "query string, cnt long")
    if not n <= tracked <= MAX_TRACKED:
        raise ValueError(f"tracked must lie between n and {MAX_TRACKED}")
    found = events.agg(F.expr(f"approx_top_k({column}, {n}, {tracked})").alias("x")).select(F.explode("x").alias("x"))
    return found.select(F.col("x.item").alias("query"), F.col("x.count").alias("cnt")).orderBy(F.desc("cnt"), "query")


class SpaceSaving:
    """The Space-Saving summary of at most ``capacity`` keys: count - error <= true count <= count for its keys.

    A full summary gives the place of its smallest key, of those the one that has had its count longest, to a new key,
    which takes over the count as its error. Counts live in a dictionary; a heap with outdated entries finds the
    smallest.
    """

    def __init__(self, capacity: int):
        if capacity <= 0:
            raise ValueError("capacity must be positive")
        self.capacity, self._clock = capacity, 0
        self._of: dict[str, tuple[int, int, int]] = {}  # key: count, error, time at which it reached the count
        self._heap: list[tuple[int, int, str]] = []

    def __len__(self) -> int:
        return len(self._of)

    def _put(self, key: str, count: int, error: int) -> None:
        self._clock += 1
        self._of[key] = (count, error, self._clock)
        heapq.heappush(self._heap, (count, self._clock, key))
        if len(self._heap) > 4 * self.capacity + 64:
            self._heap = [(c, t, k) for k, (c, _, t) in self._of.items()]
            heapq.heapify(self._heap)

    def add(self, key: str, n: int = 1) -> None:
        if n <= 0:
            return
        if key in self._of:
            count, error, _ = self._of[key]
            self._put(key, count + n, error)
        elif len(self._of) < self.capacity:
            self._put(key, n, 0)
        else:
            while True:
                count, stamp, victim = heapq.heappop(self._heap)
                if self._of.get(victim, (0, 0, 0))[2] == stamp:
                    break
            del self._of[victim]
            self._put(key, count + n, count)

    def entries(self) -> list[tuple[str, int, int]]:
        """(key, count, error), largest first, ties by who reached the count first."""
        return [(k, c, e) for k, (c, e, t) in sorted(self._of.items(), key=lambda x: (-x[1][0], x[1][2]))]

    def top(self, n: int) -> list[tuple[str, int, int]]:
        return self.entries()[: max(n, 0)]

    def merge(self, other: SpaceSaving) -> None:
        """Add the other's keys, smallest count first; their errors are kept as part of the error."""
        for key, count, error in reversed(other.entries()):
            self.add(key, count)
            c, e, t = self._of[key]
            self._of[key] = (c, e + error, t)


def space_saving(events: DataFrame, capacity: int, n: int, fan_in: int = 32, column: str = "query") -> DataFrame:
    """(query, cnt, error) of merged Space-Saving summaries: one in each task, merged ``fan_in`` at a time.

    A task counts each batch of rows in Arrow and adds a key once for the batch, not once for a row. The summaries, at
    most ``capacity`` rows a task, are written before they are merged. The result depends on how rows fall into tasks, its
    bounds do not: the largest n that are kept hold every key with more than a share of 1/capacity of all rows. No
    merge task holds more than fan_in summaries. Null keys are not counted.
    """
    names, columns = ["query", "cnt", "error", "part"], "query string, cnt long, error long, part long"

    def rows_of(sketch: SpaceSaving, part: int) -> pd.DataFrame:
        return pd.DataFrame([(*x, part) for x in sketch.entries()], columns=names).astype({"cnt": "int64", "error": "int64", "part": "int64"})

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch = SpaceSaving(capacity)
        for batch in batches:
            for key, times in zip(*pc.value_counts(batch.column(0).drop_null()).flatten(), strict=True):
                sketch.add(key.as_py(), times.as_py())
        rows = sketch.entries()
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64())], names=names)

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        sketch = SpaceSaving(capacity)
        for _, group in part.sort_values(["part", "cnt", "query"]).groupby("part"):
            other = SpaceSaving(capacity)
            for key, count, error in group[["query", "cnt", "error"]].itertuples(index=False):
                other.add(key, count)
                c, _, t = other._of[key]
                other._of[key] = (c, error, t)
            sketch.merge(other)
        return rows_of(sketch, int(part["part"].iloc[0]) // fan_in)

    now = materialise(events.select(F.col(column).cast("string").alias("query")).mapInArrow(local, columns), "summaries")
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        now = now.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(merged, columns)
        if parts <= fan_in:
            break
        parts = -(-parts // fan_in)
    return now.select("query", "cnt", "error").orderBy(F.desc("cnt"), "query").limit(max(n, 0))
