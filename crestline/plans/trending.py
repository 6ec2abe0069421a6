"""The whole plan: decode, normalise, validate, drop repeats, count panes, and rank the window at a point in time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.config import Config
from crestline.functions.text import micros
from crestline.operators.anomaly import anomaly_flags, flagged_counts, reach
from crestline.operators.dedup import mark_repeats, unique_touches
from crestline.operators.events import with_reject_reason
from crestline.operators.panes import admitted, pane_counts, window_counts
from crestline.operators.snapshot import rank

STATUSES = ("ok", "dropped_unmarshal", "dropped_validation", "dropped_dedup", "dropped_stale")


def valid_events(events: DataFrame, cfg: Config, now_us=None) -> DataFrame:
    """Normalised events that pass validation. now_us: a literal or column; by default each event's own arrival,
    its event time, so that only the checks on its fields apply."""
    rows = events.where(~F.col("malformed")) if "malformed" in events.columns else events
    now = micros(F.col("timestamp")) if now_us is None else now_us
    return with_reject_reason(rows, now, round(cfg.max_age_s * 1e6), cfg.max_query_chars).where("reject_reason is null").drop("reject_reason")


def classify(events: DataFrame, cfg: Config, now_us: int) -> DataFrame:
    """Each event with exactly one of STATUSES at one clock reading."""
    rows = events if "malformed" in events.columns else events.withColumn("malformed", F.lit(False))
    rows = with_reject_reason(rows, now_us, round(cfg.max_age_s * 1e6), cfg.max_query_chars)
    good = (~F.col("malformed")) & F.col("reject_reason").isNull()
    marked = mark_repeats(rows.where(good), cfg.dedup.rotation_us, cfg.dedup.rotations)
    late = (F.col("ts_us") > now_us) | (F.lit(now_us) - F.col("ts_us") >= cfg.window.size_us)
    kept = marked.withColumn("status", F.when(F.col("repeat"), "dropped_dedup").when(late, "dropped_stale").otherwise("ok")).drop("repeat")
    bad = rows.where(~good).withColumn("status", F.when(F.col("malformed"), "dropped_unmarshal").otherwise("dropped_validation"))
    return kept.unionByName(bad)


def unique_events(events: DataFrame, cfg: Config, dedup: bool = True) -> DataFrame:
    """(query, ts_us) of valid events, without repeats unless dedup is off."""
    valid = valid_events(events, cfg)
    return unique_touches(valid, cfg.dedup.rotation_us, cfg.dedup.rotations) if dedup else valid.select("query", "ts_us")


def history_us(cfg: Config) -> int:
    """How far back a snapshot reads: the window, or as far as panes weigh anything in the mean or in a query's age.

    A burst may end as long as the time to live before the snapshot, and a query's present life may have begun in a pane
    that lies a time to live before the first one that is old enough.
    """
    weighed = reach(cfg.anomaly.alpha) * cfg.anomaly.bucket_us + round((cfg.anomaly.ttl_s + cfg.anomaly.min_age_s) * 1e6)
    return max(cfg.window.size_us, weighed)


def since_us(cfg: Config, as_of_us: int, dedup: bool = True) -> tuple[int, int]:
    """(first pane that a snapshot reads, first event from which repeats in it and later are known): whole panes and epochs."""
    grid = math.lcm(cfg.window.pane_us, cfg.anomaly.bucket_us)
    first = (as_of_us - history_us(cfg)) // grid * grid
    rotation = cfg.dedup.rotation_us
    return first, (first // rotation - cfg.dedup.rotations) * rotation if dedup else first


def between(column: Column, kind: str, first_us: int, last_us: int) -> Column:
    """Timestamps of this type from first to last: a comparison of the bare column with literals, which reaches the scan."""
    low, high = (F.timestamp_micros(F.lit(x)).cast(kind) for x in (first_us, last_us))
    return (column >= low) & (column <= high)


def trending(events: DataFrame, as_of_us: int, cfg: Config, stop: DataFrame | None = None, dedup: bool = True, anomaly: bool = True) -> DataFrame:
    """The ranked snapshot at as_of: (query, count, score, anomaly).

    Only events that can matter are read: those of the panes that weigh in the mean, and before them as many epochs as
    a repeat is remembered. With equal panes for window and baseline, which is the default, one pane table gives both in
    one pass. A pane that begins inside the window holds no event outside it, so the window needs no filter of its own.
    """
    first, touched = since_us(cfg, as_of_us, dedup)
    recent = events.where(between(F.col("timestamp"), events.schema["timestamp"].dataType.simpleString(), touched, as_of_us))
    unique = unique_events(recent, cfg, dedup).where((F.col("ts_us") <= as_of_us) & (F.col("ts_us") >= first))
    if not anomaly:
        return rank(window_counts(pane_counts(unique, cfg.window.pane_us), as_of_us, cfg.window.size_us), cfg.snapshot, None, stop)
    baseline = unique if cfg.anomaly.include_stale else admitted(unique, as_of_us, cfg.window.size_us)
    if cfg.window.pane_us == cfg.anomaly.bucket_us:
        return rank(flagged_counts(pane_counts(baseline, cfg.window.pane_us), as_of_us, cfg.anomaly, cfg.window.size_us), cfg.snapshot, None, stop)
    counts = window_counts(pane_counts(unique, cfg.window.pane_us), as_of_us, cfg.window.size_us)
    return rank(counts, cfg.snapshot, anomaly_flags(pane_counts(baseline, cfg.anomaly.bucket_us), as_of_us, cfg.anomaly), stop)
