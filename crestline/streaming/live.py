"""The engine as a running service: a stream of events in, a ranked list out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crestline.config import Config
from crestline.plans.trending import history_us
from crestline.sources.events import kafka_events
from crestline.streaming.dedup import ROCKSDB, drop_repeats_stream
from crestline.streaming.metrics import Metrics, ProgressListener, observed_received, observed_unique
from crestline.streaming.serve import Service, StopWords, serve
from crestline.streaming.trending import SnapshotHolder, compact, received_stream, snapshot_candidates, start_panes

COMPACT_EVERY = 60


def unique_stream(events: DataFrame, cfg: Config, clock: bool = True) -> DataFrame:
    """Valid events of a stream without repeats, counted on the way. Future events go before the watermark sees them."""
    received = observed_received(received_stream(events, cfg, clock))
    valid = received.where("not malformed and reject_reason is null").select("identity", "query", "event_id", "ts_us", "timestamp")
    unique = drop_repeats_stream(valid, cfg.dedup.rotation_us, cfg.dedup.rotations, f"{round(cfg.max_age_s)} seconds")
    return observed_unique(unique, F.unix_micros(F.current_timestamp()) if clock else F.col("ts_us"), cfg.window.size_us)


def start(events: DataFrame, cfg: Config, path: str, checkpoint: str, holder: SnapshotHolder, stop: StopWords, metrics: Metrics, clock: Callable[[], int] | None = None, wall_clock: bool = True, **trigger) -> StreamingQuery:
    """Run a stream of events into panes, and publish a snapshot after each batch.

    clock gives the snapshot's time in microseconds, now by default. The state of the repeat filter is kept on disk.
    Every COMPACT_EVERY batches the panes of earlier ones become one table, without those that no snapshot reads any more.
    """
    spark, now = events.sparkSession, clock or (lambda: time.time_ns() // 1000)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def publish(batch: DataFrame, batch_id: int) -> None:
        began, as_of = time.perf_counter(), now()
        candidates = snapshot_candidates(spark, path, as_of, cfg, stop.table(spark))
        rows = [(q, int(score)) for q, score, _ in candidates[: cfg.snapshot.max_size]]
        holder.publish(rows, as_of)
        metrics.observe("trending_snapshot_build_duration_seconds", time.perf_counter() - began)
        metrics.add("trending_events_marked_anomaly_total", sum(flag for _, _, flag in candidates))
        metrics.set("trending_snapshot_size", len(rows))
        metrics.set("trending_snapshot_last_built_seconds", as_of / 1e6)
        metrics.set("trending_stoplist_size", len(stop.list()))
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            compact(spark, path, batch_id, as_of - history_us(cfg))

    trigger = trigger or {"processingTime": f"{cfg.snapshot.interval_s} seconds"}
    return start_panes(unique_stream(events, cfg, wall_clock), path, checkpoint, cfg.window.pane_us, publish, **trigger)


def run(spark: SparkSession, cfg: Config, path: str) -> None:
    """Read the configured topic, answer HTTP, and stay until the stream ends. path: a folder that executors share."""
    holder, stop, metrics = SnapshotHolder(), StopWords(), Metrics()
    spark.streams.addListener(ProgressListener(metrics))
    server = serve(Service(holder, stop, metrics), "0.0.0.0", cfg.http_port)
    try:
        start(kafka_events(spark, list(cfg.brokers), cfg.topic, group_id=cfg.group_id), cfg, f"{path}/panes", f"{path}/state", holder, stop, metrics).awaitTermination()
    finally:
        server.shutdown()
