"""Removal of repeats by the same identity for the same query, forgotten a few rotations after the last touch.

Time is cut into epochs of one rotation. An event is a repeat if its key was touched fewer than ``rotations`` epochs
before, and a repeat counts as a touch: the rule follows gaps, not first occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("identity", "query")


def epoch(rotation_us: int) -> Column:
    return F.floor(F.col("ts_us") / F.lit(rotation_us)).cast("long")


def mark_repeats(events: DataFrame, rotation_us: int, rotations: int) -> DataFrame:
    """Every event with ``repeat``; events of a key are taken by (ts_us, event_id).

    Only an epoch's first event of a key can be no repeat, so a key is first reduced to one row for each epoch, with
    map-side combine, and the gaps are taken between these. A hot key costs a row for each epoch, not for each event.
    """
    heads = first_touches(events, rotation_us, rotations)
    keyed = events.withColumn("_epoch", epoch(rotation_us))
    head = heads.select(*(F.col(k).alias(f"_{k}") for k in KEY), F.col("epoch").alias("_e"), F.col("ts_us").alias("_ts"), F.col("event_id").alias("_id"), "keep")
    same = (F.col("identity") == F.col("_identity")) & (F.col("query") == F.col("_query")) & (F.col("_epoch") == F.col("_e"))
    is_head = (F.col("ts_us") == F.col("_ts")) & (F.col("event_id") == F.col("_id"))
    return keyed.join(head, same, "left").withColumn("repeat", ~F.coalesce(F.col("keep") & is_head, F.lit(False))).select(*events.columns, "repeat")


def first_touches(events: DataFrame, rotation_us: int, rotations: int) -> DataFrame:
    """(identity, query, epoch, ts_us, event_id, touches, keep): the first event of each epoch of a key."""
    first = events.groupBy(*KEY, epoch(rotation_us).alias("epoch")).agg(F.min(F.struct("ts_us", "event_id")).alias("f"), F.count("*").alias("touches"))
    return first.select(*KEY, "epoch", F.col("f.ts_us").alias("ts_us"), F.col("f.event_id").alias("event_id"), "touches", _kept(rotations).alias("keep"))


def _kept(rotations: int, key: tuple[str, ...] = KEY) -> Column:
    before = F.lag("epoch").over(Window.partitionBy(*key).orderBy("epoch"))
    return before.isNull() | (F.col("epoch") - before >= rotations)


def drop_repeats(events: DataFrame, rotation_us: int, rotations: int) -> DataFrame:
    """(identity, query, ts_us, event_id) of the events that are no repeats; two of one key with equal time and id are one."""
    return first_touches(events, rotation_us, rotations).where("keep").select(*KEY, "ts_us", "event_id")


def unique_touches(events: DataFrame, rotation_us: int, rotations: int) -> DataFrame:
    """(query, ts_us) of the events that are no repeats, for counting: aggregations and sorts over numbers only.

    A key is its 128-bit hash (equal hashes count as equal), so that no text is compared; the query comes along. The first
    shuffle carries a row for each key and epoch of a task, the second a row for each key and epoch.
    """
    hashed = events.select("query", "ts_us", epoch(rotation_us).alias("epoch"), F.xxhash64(*KEY).alias("_k1"), F.xxhash64(F.lit("second"), *KEY).alias("_k2"))
    first = hashed.groupBy("_k1", "_k2", "epoch", "query").agg(F.min("ts_us").alias("ts_us"))
    return first.select("query", "ts_us", _kept(rotations, ("_k1", "_k2")).alias("keep")).where("keep").select("query", "ts_us")
