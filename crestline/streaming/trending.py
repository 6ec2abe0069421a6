"""Streams of events into pane tables and snapshots.

A query without state writes valid first touches; panes are partial counts, one file in a folder for each batch, which a
replay overwrites, so that a restart neither loses nor repeats a count. Every so often the folders of batches that can
no longer be replayed become one table, sorted by pane and without what no snapshot reads any more. A snapshot thus
opens a bounded number of files.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crestline.config import Config
from crestline.operators.anomaly import flagged_counts
from crestline.operators.events import with_reject_reason
from crestline.operators.panes import merge_panes, pane_counts
from crestline.operators.snapshot import scored
from crestline.plans.trending import history_us

PANE = "query string, pane_us long, cnt long, first_us long, last_us long"


def received_stream(events: DataFrame, cfg: Config, clock: bool = True, now: Column | None = None) -> DataFrame:
    """Normalised events of a stream with ``malformed`` and ``reject_reason``; with clock, ages are taken against each
    batch's own time, else against now, or the event's own time without it."""
    rows = events if "malformed" in events.columns else events.withColumn("malformed", F.lit(False))
    own = F.unix_micros(F.current_timestamp()) if clock else F.unix_micros(F.col("timestamp"))
    return with_reject_reason(rows, own if now is None else now, round(cfg.max_age_s * 1e6), cfg.max_query_chars)


def valid_stream(events: DataFrame, cfg: Config, clock: bool = True, now: Column | None = None) -> DataFrame:
    """The valid ones of received_stream."""
    return received_stream(events, cfg, clock, now).where("not malformed and reject_reason is null").drop("malformed", "reject_reason")


def pane_sink(path: str, pane_us: int, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch's panes into one file in path/batch=<id>; replacing the folder makes a replay harmless. then runs after each write."""

    def write(batch: DataFrame, batch_id: int) -> None:
        pane_counts(batch, pane_us).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if then is not None:
            then(batch, batch_id)

    return write


def _folders(spark: SparkSession, path: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(number, folder) of the whole merged tables, by the batch they reach to, and of the batches."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[tuple[int, str]]] = {"merged": [], "batch": []}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and number.isdigit() and (kind == "batch" or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))):
            found[kind].append((int(number), status.getPath().toString()))
    return sorted(found["merged"]), sorted(found["batch"])


def _partial(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The partial counts of the last merged table and of the batches after it, up to one."""
    merged, batches = _folders(spark, path)
    upto = merged[-1][0] if merged else 0
    paths = [f for _, f in merged[-1:]] + [f for n, f in batches if n >= upto and (below is None or n < below)]
    return spark.read.schema(PANE).parquet(*paths) if paths else spark.createDataFrame([], PANE)


def read_panes(spark: SparkSession, path: str, since_us: int | None = None) -> DataFrame:
    """The pane table that the batches wrote, added up; panes before since_us are not read."""
    rows = _partial(spark, path)
    return merge_panes(rows if since_us is None else rows.where(F.col("pane_us") > since_us))


def compact(spark: SparkSession, path: str, batch_id: int, before_us: int) -> int:
    """Merge what batches before this one wrote into one table without panes that began before before_us; how many folders went.

    While a batch runs, all earlier ones are committed and are never replayed. Readers take the merged table from the
    moment it is whole; folders that it covers are then deleted, also those that an interrupted run has left.
    """
    merged, batches = _folders(spark, path)
    if not any((merged[-1][0] if merged else 0) <= n < batch_id for n, _ in batches):
        return 0
    rows = merge_panes(_partial(spark, path, batch_id).where(F.col("pane_us") >= before_us))
    rows.coalesce(1).sortWithinPartitions("pane_us").write.mode("overwrite").parquet(f"{path}/merged={batch_id}")
    old = [f for n, f in merged if n < batch_id] + [f for n, f in batches if n < batch_id]
    for folder in old:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(old)


def start_panes(events: DataFrame, path: str, checkpoint: str, pane_us: int, then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Run events (with query and ts_us) into a pane table. trigger: processingTime='1 second' or availableNow=True."""
    writer = events.writeStream.foreachBatch(pane_sink(path, pane_us, then)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def windowed_panes(events: DataFrame, pane: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Panes by Spark's own windows and watermark: in append mode each is emitted once, when it is complete."""
    counted = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", pane), "query").agg(F.count("*").alias("cnt"))
    return counted.select("query", F.unix_micros("window.start").alias("pane_us"), "cnt")


class SnapshotHolder:
    """The latest snapshot, replaced as a whole; reads never run a job."""

    def __init__(self) -> None:
        self._lock, self._rows, self._built = threading.Lock(), (), None

    def publish(self, rows: list[tuple[str, int]], built_us: int) -> None:
        with self._lock:
            self._rows, self._built = tuple(rows), built_us

    @property
    def ready(self) -> bool:
        return self._built is not None

    @property
    def built_us(self) -> int | None:
        return self._built

    def get(self, limit: int | None = None) -> list[tuple[str, int]]:
        return list(self._rows if limit is None else self._rows[:limit])


def snapshot_candidates(spark: SparkSession, path: str, as_of_us: int, cfg: Config, stop: DataFrame | None = None) -> list[tuple[str, float, bool]]:
    """(query, score, anomaly) of the snapshot's candidates at as_of, best first, from a pane table.

    At most max_size times candidate_factor rows reach the driver.
    """
    panes = read_panes(spark, path, as_of_us - history_us(cfg))
    rows = scored(flagged_counts(panes, as_of_us, cfg.anomaly, cfg.window.size_us), cfg.snapshot, None, stop).collect()
    return sorted(((r["query"], r["score"], r["anomaly"]) for r in rows), key=lambda x: (-x[1], x[0].encode()))


def build_snapshot(spark: SparkSession, path: str, as_of_us: int, cfg: Config, stop: DataFrame | None = None) -> list[tuple[str, int]]:
    """The snapshot at as_of from a pane table: scores cut to whole numbers."""
    return [(q, int(score)) for q, score, _ in snapshot_candidates(spark, path, as_of_us, cfg, stop)[: cfg.snapshot.max_size]]


def publishing(spark: SparkSession, path: str, cfg: Config, holder: SnapshotHolder, clock: Callable[[], int], stop: Callable[[], DataFrame | None] = lambda: None) -> Callable[[DataFrame, int], None]:
    """For start_panes(then=...): rebuild and publish the snapshot after each batch."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        now = clock()
        holder.publish(build_snapshot(spark, path, now, cfg, stop()), now)

    return publish
