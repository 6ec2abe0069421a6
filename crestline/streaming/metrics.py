"""Counters, gauges and histograms of a running engine, in the Prometheus text format."""

from __future__ import annotations

import threading
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: The series, their kinds, and for histograms the first edge and the number of edges, each twice the last.
SERIES = {
    "trending_events_consumed_total": ("counter", ("status",)),
    "trending_event_processing_duration_seconds": ("histogram", (), 1e-5, 15),
    "trending_events_marked_anomaly_total": ("counter", ()),
    "trending_snapshot_size": ("gauge", ()),
    "trending_snapshot_build_duration_seconds": ("histogram", (), 1e-3, 12),
    "trending_snapshot_last_built_seconds": ("gauge", ()),
    "trending_http_request_duration_seconds": ("histogram", ("method", "path", "status"), 1e-4, 14),
    "trending_http_requests_in_flight": ("gauge", ()),
    "trending_kafka_consumer_lag": ("gauge", ()),
    "trending_stoplist_size": ("gauge", ()),
}


def bucket_edges(start: float, count: int) -> list[float]:
    return [start * 2**i for i in range(count)]


def histogram(rows: DataFrame, column: str, start: float, count: int) -> DataFrame:
    """(bucket, n): values by the smallest edge not below them; bucket ``count`` is beyond the last edge."""
    return rows.where(F.col(column).isNotNull()).groupBy(bucket_of(F.col(column), start, count).alias("bucket")).agg(F.count("*").alias("n"))


def bucket_of(c: Column, start: float, count: int) -> Column:
    """How many edges lie below the value: comparisons, so that a value on an edge is never off by rounding."""
    out = F.lit(0)
    for edge in bucket_edges(start, count):
        out = out + F.when(c > edge, 1).otherwise(0)
    return out.cast("long")


class Metrics:
    """Thread-safe values of SERIES."""

    def __init__(self) -> None:
        self._lock, self._values, self._sums = threading.Lock(), {}, {}

    def add(self, name: str, by: float = 1.0, **labels: str) -> None:
        with self._lock:
            key = (name, tuple(sorted(labels.items())))
            self._values[key] = self._values.get(key, 0.0) + by

    def set(self, name: str, value: float) -> None:
        with self._lock:
            self._values[name, ()] = value

    def observe(self, name: str, value: float, **labels: str) -> None:
        _, _, start, count = SERIES[name]
        with self._lock:
            key = (name, tuple(sorted(labels.items())))
            counts, total = self._sums.get(key, ([0] * (count + 1), 0.0))
            counts[bisect_left(bucket_edges(start, count), value)] += 1
            self._sums[key] = (counts, total + value)

    def value(self, name: str, **labels: str) -> float:
        return self._values.get((name, tuple(sorted(labels.items()))), 0.0)

    def text(self) -> str:
        """The exposition format."""
        show = lambda labels: "{" + ",".join(f'{k}="{v}"' for k, v in labels) + "}" if labels else ""
        lines = []
        with self._lock:
            for name, (kind, *_rest) in SERIES.items():
                lines.append(f"# TYPE {name} {kind}")
                lines += [f"{name}{show(labels)} {value:g}" for (n, labels), value in sorted(self._values.items()) if n == name]
                for (n, labels), (counts, total) in sorted(self._sums.items()):
                    if n == name:
                        seen = 0
                        for edge, c in zip([*bucket_edges(*SERIES[name][2:]), float("inf")], counts, strict=True):
                            seen += c
                            lines.append(f"{name}_bucket{show((*labels, ('le', '+Inf' if edge == float('inf') else f'{edge:g}')))} {seen}")
                        lines += [f"{name}_sum{show(labels)} {total:g}", f"{name}_count{show(labels)} {seen}"]
        return "\n".join(lines) + "\n"


def observed(events: DataFrame, name: str = "statuses") -> DataFrame:
    """Count the rows of each status on the way, without a pass of its own."""
    statuses = ("ok", "dropped_unmarshal", "dropped_validation", "dropped_dedup", "dropped_stale")
    return events.observe(name, *(F.count_if(F.col("status") == s).alias(s) for s in statuses))


def observed_received(events: DataFrame) -> DataFrame:
    """Count malformed, invalid and valid events on the way: (malformed, reject_reason) as received_stream gives them."""
    bad, invalid = F.col("malformed"), ~F.col("malformed") & F.col("reject_reason").isNotNull()
    return events.observe("received", F.count_if(bad).alias("dropped_unmarshal"), F.count_if(invalid).alias("dropped_validation"), F.count_if(~bad & ~invalid).alias("valid"))


def observed_unique(events: DataFrame, now: Column, size_us: int) -> DataFrame:
    """Count the events that are no repeats on the way: those that a window of this size takes, and those too old for it."""
    late = now - F.col("ts_us") >= size_us
    return events.observe("unique", F.count_if(~late).alias("ok"), F.count_if(late).alias("dropped_stale"))


def lag_of(end: Column, latest: Column) -> Column:
    """Messages of a topic that are not read yet, from offsets as progress reports them: {"topic": {"partition": offset}}."""
    kind = "map<string,map<string,bigint>>"
    flat = lambda c: F.flatten(F.transform(F.map_entries(F.from_json(c, kind)), lambda t: F.transform(F.map_entries(t["value"]), lambda p: F.struct(F.concat_ws("/", t["key"], p["key"]).alias("k"), p["value"].alias("n")))))
    done = F.map_from_entries(flat(end))
    return F.aggregate(flat(latest), F.lit(0).cast("long"), lambda a, x: a + F.greatest(x["n"] - F.coalesce(F.try_element_at(done, x["k"]), F.lit(0)), F.lit(0)))


class ProgressListener(StreamingQueryListener):
    """Feeds a Metrics object from streaming progress: observed statuses, batch duration and source lag.

    Statuses come as counts of each (``statuses``), or as counts of what was received and of what was no repeat, whose
    difference are the repeats.
    """

    def __init__(self, metrics: Metrics, name: str = "statuses"):
        self._metrics, self._name = metrics, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = {k: v.asDict() for k, v in (progress.observedMetrics or {}).items()}
        counts = dict(seen.get(self._name, {}))
        if "received" in seen:
            counts |= seen["received"] | seen.get("unique", {})
            counts["dropped_dedup"] = counts.pop("valid") - counts.get("ok", 0) - counts.get("dropped_stale", 0)
        for status, n in counts.items():
            self._metrics.add("trending_events_consumed_total", n or 0, status=status)
        self._metrics.observe("trending_event_processing_duration_seconds", (progress.batchDuration or 0) / 1000)
        for source in progress.sources:
            lag = (source.metrics or {}).get("maxOffsetsBehindLatest")
            if lag is not None:
                self._metrics.set("trending_kafka_consumer_lag", float(lag))
