"""Bloom filters as tables: words of bits, merged by a bitwise or, of a size that only their parameters decide."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.text import hash128

#: bits of a row
WORD = 32


def bloom_size(n: int, share: float) -> tuple[int, int]:
    """(bits, hashes) for n keys at this share of false positives; whole 64-bit words, one at least."""
    if n <= 0:
        raise ValueError("n must be positive")
    if not 0 < share < 1:
        raise ValueError("the share of false positives must lie in (0, 1)")
    bits = max(64, math.ceil(-n * math.log(share) / math.log(2) ** 2))
    return -(-bits // 64) * 64, max(1, math.ceil(bits / n * math.log(2)))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The places of a key, by double hashing."""
    a, b = (F.pmod(h, F.lit(bits)) for h in hash128(key))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)))


def bloom_filter(rows: DataFrame, key: Column, bits: int, hashes: int) -> DataFrame:
    """(word, bits) of the words that are not zero: at most bits / WORD rows, however many keys there are. Null is no key."""
    at = rows.where(key.isNotNull()).select(F.explode(positions(key, bits, hashes)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / WORD).cast("long").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(at % {WORD} as int))")).alias("bits"))


def merge_filters(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of several filters of one size."""
    out = filters[0]
    for x in filters[1:]:
        out = out.unionByName(x)
    return out.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def reset(filter: DataFrame) -> DataFrame:
    """An empty filter."""
    return filter.limit(0)


def seen_keys(rows: DataFrame, key: Column, filter: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(key, seen) for each distinct key of rows: true for every key of the filter, and for few others. Null is no key.

    Spark broadcasts the filter if its size allows; what is shuffled is one row for each key and task.
    """
    keys = rows.select(key.alias("key")).where("key is not null").distinct()
    probes = keys.select("key", F.explode(positions(F.col("key"), bits, hashes)).alias("at"))
    found = probes.withColumn("word", F.floor(F.col("at") / WORD).cast("long")).join(filter, "word", "left")
    hit = F.expr(f"coalesce(bits & shiftleft(1L, cast(at % {WORD} as int)), 0L) <> 0")
    return found.groupBy("key").agg(F.every(hit).alias("seen"))
