"""The ranked snapshot: candidates, stop-list, penalty for bursts, order and cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.config import SnapshotConfig
from crestline.operators.stoplist import exclude
from crestline.operators.topk import top_k

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


def scored(counts: DataFrame, cfg: SnapshotConfig, flags: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(query, score, anomaly) of the candidates, in no order: at most max_size times candidate_factor rows.

    counts: (query, cnt), with the flags in a column ``anomaly`` or in a table of their own, or without any. The
    candidates are the largest counts before stop words go, so the list can be short though more queries exist.
    """
    top = exclude(top_k(counts, cfg.max_size * cfg.candidate_factor), stop)
    if "anomaly" in counts.columns:
        marked = top
    elif flags is None:
        marked = top.withColumn("anomaly", F.lit(False))
    else:
        marked = top.join(flags.where("anomaly").select("query", "anomaly"), "query", "left").withColumn("anomaly", F.coalesce("anomaly", F.lit(False)))
    score = F.col("cnt").cast("double") * F.when(F.col("anomaly"), F.lit(cfg.penalty)).otherwise(F.lit(1.0))
    return marked.select("query", score.alias("score"), "anomaly")


def rank(counts: DataFrame, cfg: SnapshotConfig, flags: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(query, count, score, anomaly), best first: count is the score cut to a whole number, zeros included.

    After the cut to candidates everything is bounded by the snapshot's size.
    """
    best = scored(counts, cfg, flags, stop).orderBy(F.desc("score"), "query").limit(cfg.max_size)
    return best.select("query", F.col("score").cast("long").alias("count"), "score", "anomaly")


def limit_of(c: Column) -> Column:
    """The request limit of a text as a column: 100 if it is empty or null; null where parse_limit fails."""
    number = F.when(c.rlike(r"^[+-]?[0-9]{1,9}$"), c.cast("int"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(DEFAULT_LIMIT)).when(number.between(1, MAX_LIMIT), number)


def parse_limit(text: str | None) -> int:
    """The request limit: 100 if none is given; not a number, below 1 or above 1000 is an error."""
    if text is None or text == "":
        return DEFAULT_LIMIT
    if not text.lstrip("+-").isdigit() or not 1 <= int(text) <= MAX_LIMIT:
        raise ValueError(f"limit must be a number from 1 to {MAX_LIMIT}")
    return int(text)


def first(snapshot: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return snapshot.orderBy(F.desc("score"), "query").limit(limit).select("query", "count")
