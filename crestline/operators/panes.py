"""Tumbling panes and the sliding windows made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.functions.text import floor_to, ring_index


def pane_counts(events: DataFrame, pane_us: int) -> DataFrame:
    """(query, pane_us, cnt, first_us, last_us): the only pass over events; everything later reads panes."""
    return events.groupBy("query", floor_to(F.col("ts_us"), pane_us).alias("pane_us")).agg(F.count("*").alias("cnt"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def merge_panes(*panes: DataFrame) -> DataFrame:
    """Panes of several sources or batches added up."""
    out = panes[0]
    for p in panes[1:]:
        out = out.unionByName(p)
    return out.groupBy("query", "pane_us").agg(F.sum("cnt").alias("cnt"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def live(panes: DataFrame, as_of_us: int, size_us: int) -> DataFrame:
    """Panes that begin after as_of - size and not after as_of; the filter reaches the scan of a pane table."""
    return panes.where((F.col("pane_us") > as_of_us - size_us) & (F.col("pane_us") <= as_of_us))


def window_counts(panes: DataFrame, as_of_us: int, size_us: int) -> DataFrame:
    """(query, cnt) of the window that ends at as_of."""
    return live(panes, as_of_us, size_us).groupBy("query").agg(F.sum("cnt").alias("cnt"))


def admitted(events: DataFrame, as_of_us: int, size_us: int) -> DataFrame:
    """Events that the window takes at as_of: not in the future and younger than the window."""
    return events.where((F.col("ts_us") <= as_of_us) & (F.col("ts_us") > as_of_us - size_us))


def sliding_counts(panes: DataFrame, size_us: int, pane_us: int) -> DataFrame:
    """(query, pane_us, window_cnt): the window that ends with each pane in which the query occurs."""
    frame = Window.partitionBy("query").orderBy("pane_us").rangeBetween(-(size_us - pane_us), 0)
    return panes.select("query", "pane_us", F.sum("cnt").over(frame).alias("window_cnt"))


def latest_in_ring(panes: DataFrame, pane_us: int, slots: int) -> DataFrame:
    """The panes that a ring of ``slots`` places still holds: a pane goes when a later one needs its place.

    One row for each place is aggregated and joined back; their number is fixed.
    """
    placed = panes.withColumn("slot", ring_index(F.col("pane_us"), pane_us, slots))
    newest = placed.groupBy("slot").agg(F.max("pane_us").alias("newest"))
    return placed.join(newest, "slot").where("pane_us = newest").select("slot", *panes.columns)


def bucket_count(size_us: int, pane_us: int) -> int:
    """Panes in a window."""
    return size_us // pane_us


def expire(panes: DataFrame, as_of_us: int, keep_us: int) -> DataFrame:
    """A pane table without panes that no window can use any more."""
    return panes.where(F.col("pane_us") > as_of_us - keep_us)
