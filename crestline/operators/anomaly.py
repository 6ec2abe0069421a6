"""Bursts: the last pane of a query against an exponentially weighted mean of the panes before it.

The recurrence mean = alpha * closed + (1 - alpha) * mean, with one decay for each empty pane, has the closed form
sum over i < L of alpha * (1 - alpha)^(L - 1 - i) * c_i, L being the last observed pane. A query that was silent for
longer than the time to live starts anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.config import AnomalyConfig

#: what the panes beyond the reach weigh together in a mean, at most
TOLERANCE = 1e-12
#: natural logarithm of the largest scale inside a block of panes; doubles end near 709
_SCALE = 300.0


def reach(alpha: float, tolerance: float = TOLERANCE) -> int:
    """Panes that a mean looks back: all older ones together weigh at most ``tolerance``."""
    return 1 if alpha >= 1 else max(1, math.ceil(math.log(tolerance) / math.log1p(-alpha)))


def _numbered(panes: DataFrame, cfg: AnomalyConfig) -> DataFrame:
    return panes.withColumn("i", F.floor(F.col("pane_us") / cfg.bucket_us).cast("long"))


def with_lives(panes: DataFrame, cfg: AnomalyConfig) -> DataFrame:
    """``life`` counts the silences of more than the time to live before each pane of a query."""
    order = Window.partitionBy("query").orderBy("pane_us")
    gap = F.col("first_us") - F.lag("last_us").over(order)
    fresh = F.when(gap > round(cfg.ttl_s * 1e6), 1).otherwise(0)
    return panes.withColumn("_fresh", fresh).withColumn("life", F.sum("_fresh").over(order)).drop("_fresh")


def query_state(panes: DataFrame, as_of_us: int, cfg: AnomalyConfig, size_us: int | None = None) -> DataFrame:
    """(query, ewma, current, first_us, last_us[, cnt]) from the panes up to as_of: the baseline of the query's present
    life and, if size_us is given, its count in the window that ends at as_of.

    One shuffle by query: the windows and the aggregation share it, over a row for each pane.
    """
    whole = Window.partitionBy("query")
    known = _numbered(with_lives(panes.where(F.col("pane_us") <= as_of_us), cfg), cfg)
    known = known.withColumn("present", F.col("life") == F.max("life").over(whole)).withColumn("last", F.max("i").over(whole))
    before, present = F.col("present") & (F.col("i") < F.col("last")), F.col("present")
    decay = F.lit(cfg.alpha) * F.pow(F.lit(1.0 - cfg.alpha), (F.col("last") - 1 - F.col("i")).cast("double")) * F.col("cnt")
    state = [
        F.sum(F.when(before, decay).otherwise(0.0)).alias("ewma"), F.sum(F.when(F.col("i") == F.col("last"), F.col("cnt")).otherwise(0)).alias("current"),
        F.min(F.when(present, F.col("first_us"))).alias("first_us"), F.max("last_us").alias("last_us"),
    ]
    if size_us is not None:
        state.append(F.sum(F.when(F.col("pane_us") > as_of_us - size_us, F.col("cnt")).otherwise(0)).alias("cnt"))
    return known.groupBy("query").agg(*state)


def ewma_at(panes: DataFrame, as_of_us: int, cfg: AnomalyConfig) -> DataFrame:
    """(query, ewma, current, first_us, last_us)."""
    return query_state(panes, as_of_us, cfg)


def ewma_history(panes: DataFrame, cfg: AnomalyConfig) -> DataFrame:
    """(query, pane_us, cnt, ewma): the mean before each observed pane.

    A running sum of counts scaled up by their place in a block of panes, and scaled down again: all terms are positive,
    so nothing cancels. A block is so long that what stands before the previous one weighs less than e^-300. Each pane
    goes to its own block and, as a part of the mean with which that begins, to the next one: one shuffle by (query,
    block), no lists, and a query with a long history is spread over its blocks.
    """
    keep = 1.0 - cfg.alpha
    size = 1 if keep <= 0 else max(1, math.floor(_SCALE / -math.log(keep)))
    rows = _numbered(panes, cfg).withColumn("b", F.floor(F.col("i") / size).cast("long")).withColumn("o", F.col("i") - F.col("b") * size)
    part = F.lit(cfg.alpha) * F.col("cnt")
    own = F.struct(F.col("b"), F.col("o"), F.col("pane_us"), F.col("cnt"), F.lit(0.0).alias("begin"), (part * F.pow(F.lit(keep), -F.col("o").cast("double"))).alias("up"))
    after = F.struct((F.col("b") + 1).alias("b"), F.lit(-1).cast("long").alias("o"), F.lit(None).cast("long").alias("pane_us"), F.lit(None).cast("long").alias("cnt"), (part * F.pow(F.lit(keep), (size - 1 - F.col("o")).cast("double"))).alias("begin"), F.lit(0.0).alias("up"))
    both = rows.select("query", F.inline(F.array(own, after)))
    frame = Window.partitionBy("query", "b").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    before, begin = F.coalesce(F.sum("up").over(frame), F.lit(0.0)), F.coalesce(F.sum("begin").over(frame), F.lit(0.0))
    down = F.when(F.col("before") > 0, F.col("before") * F.pow(F.lit(keep), (F.col("o") - 1).cast("double"))).otherwise(0.0)
    known = both.select("query", "o", "pane_us", "cnt", before.alias("before"), begin.alias("begun")).where("pane_us is not null")
    return known.select("query", "pane_us", "cnt", (down + F.col("begun") * F.pow(F.lit(keep), F.col("o").cast("double"))).alias("ewma"))


def is_burst(as_of_us: int, cfg: AnomalyConfig) -> Column:
    """Over the columns of query_state. A query silent since before the time to live is forgotten and no burst."""
    old = F.lit(as_of_us) - F.col("first_us") >= round(cfg.min_age_s * 1e6)
    known = F.lit(as_of_us) - F.col("last_us") <= round(cfg.ttl_s * 1e6)
    return old & known & (F.col("ewma") >= 1) & (F.col("current") > F.col("ewma") * cfg.threshold)


def anomaly_flags(panes: DataFrame, as_of_us: int, cfg: AnomalyConfig) -> DataFrame:
    """(query, ewma, current, anomaly)."""
    return query_state(panes, as_of_us, cfg).select("query", "ewma", "current", is_burst(as_of_us, cfg).alias("anomaly"))


def flagged_counts(panes: DataFrame, as_of_us: int, cfg: AnomalyConfig, size_us: int) -> DataFrame:
    """(query, cnt, anomaly) of the window at as_of, from one pane table in one pass: nothing is left to join."""
    state = query_state(panes, as_of_us, cfg, size_us)
    return state.where("cnt > 0").select("query", "cnt", is_burst(as_of_us, cfg).alias("anomaly"))
