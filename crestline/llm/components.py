"""Connected components by alternating star contractions, entirely in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "components") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node reachable.

    Large-star hangs a node's larger neighbours below its smallest one, small-star its smaller ones; both keep the
    components, and a forest of stars is their fixed point, reached in a logarithmic number of rounds in practice.
    A round aggregates minima with map-side combine, writes them and joins them back; as both sides of that join are
    tables, AQE splits a hub's partition. No neighbour
    list is ever gathered. Every round is written to the shared folder. Null ends and loops are ignored; no edges
    give an empty table.
    """
    pair = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pair = pair.where("u is not null and v is not null and u <> v")
    now = materialise(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, low_of_large = materialise(large, label), low
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        small = materialise(small, label)
        discard(large)
        discard(low_of_large)
        discard(now)
        now, before = small, mark
        mark = _mark(now)
        if mark == before:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that change with the edge set: its size and a sum of hashes that no order of rows alters."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
