"""Synthetic events: Zipf queries from uniform users, and a share of bots that push one query."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = 1024


def _uniform(seed: int, name: str, key: str = "id") -> Column:
    """Uniform in [0, 1) from the MD5 of the row's number: the same on every run, in every partitioning and in any engine."""
    digits = F.md5(F.concat_ws("-", F.lit(name), F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def zipf_table(spark: SparkSession, queries: int, s: float = 1.2, v: float = 1.0) -> DataFrame:
    """(cell, rank, lo, hi): the share of each rank, cut at cells of 1/CELLS so that a lookup is an equi-join."""
    weights = [(v + k) ** -s for k in range(queries)]
    total, rows, at = math.fsum(weights), [], 0.0
    for k, w in enumerate(weights):
        end = 1.0 if k == queries - 1 else at + w / total
        for cell in range(int(at * CELLS), min(CELLS - 1, int(end * CELLS)) + 1):
            rows.append((cell, k, max(at, cell / CELLS), min(end, (cell + 1) / CELLS)))
        at = end
    return spark.createDataFrame([r for r in rows if r[2] < r[3]], "cell long, rank long, lo double, hi double")


def generate_events(spark: SparkSession, n: int, start_us: int, rps: int = 1000, queries: int = 5000, users: int = 50_000, bot_share: float = 0.0, bot_query: str = "fake-trend", bots: int = 20, seed: int = 0) -> DataFrame:
    """n events of the shape of EVENT, rps a second from start_us on. The lookup table has at most queries + CELLS rows."""
    rows = spark.range(n).withColumn("u", _uniform(seed, "query")).withColumn("bot", _uniform(seed, "bot") < bot_share)
    rows = rows.withColumn("cell", F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1)).cast("long")).withColumn("who", _uniform(seed, "who"))
    table = zipf_table(spark, queries)
    rows = rows.join(F.broadcast(table), "cell").where("u >= lo and u < hi")
    user = F.floor(F.col("who") * users)
    bot = F.col("bot")
    return rows.select(
        F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))).alias("event_id"),
        F.when(bot, bot_query).otherwise(F.format_string("query-%d", "rank")).alias("query"),
        F.when(bot, F.format_string("bot-%d", F.floor(F.col("who") * bots))).otherwise(F.format_string("user-%d", user)).alias("user_id"),
        F.when(bot, "").otherwise(F.format_string("session-%d", user)).alias("session_id"),
        F.timestamp_micros(F.lit(start_us) + F.floor(F.col("id") * 1_000_000 / F.lit(rps)).cast("long")).alias("timestamp"),
    )
