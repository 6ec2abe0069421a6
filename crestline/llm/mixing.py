"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations, all in DataFrame operations.

A source with t tokens gets weight t^a, normalised. The exponent a is bisected: the largest one whose weights reach the
target entropy, raised as far as needed so that no source repeats more than a limit. The budget of a source is filled
with whole epochs and the beginning of one more. An epoch orders documents by nested blocks of 256, permuted anew in each
epoch by a hash; the place where the budget ends is found block by block, from sums over at most 256 blocks of a source
at each level, so that no task ever holds a source.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import discard, materialise

TARGET_ENTROPY = 0.95
MAX_REPEATS = 4.0
SEED = "mix"
#: the exponent is a multiple of 2^-20; each pass over the sources does five bisections of both intervals
STEPS, FAN = 1 << 20, 32
LEVELS = 3
#: rows, one a source, that are broadcast at most; with more sources texts are shuffled by source
BROADCAST_SOURCES = 1 << 17


def word_count(text: Column) -> Column:
    """Words between runs of space and 09-0D; 0 for null and blank texts."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x09-\x0D\x20]+"))).cast("long")


def _entropy(z: float, zx: float, a: float, top: float) -> float:
    """Of weights exp(a x) / Z, from sums taken relative to the largest x."""
    return math.log(z) + a * top - a * zx / z


def find_exponent(sources: DataFrame, target: float, max_repeats: float, budget: float) -> tuple[float, float, float]:
    """(exponent, sum of t^a relative to the largest t, largest ln t) for (tokens) of each source.

    Entropy falls and the repetition of the smallest source falls as the exponent grows, so both conditions are
    bisected: the largest exponent with at least ``target`` of the greatest entropy, and the smallest one within
    ``max_repeats``; the limit wins. Each pass returns one row of sums.
    """
    x = F.log(F.col("tokens").cast("double"))
    known = sources.where("tokens > 0").select(x.alias("x"))
    row = known.agg(F.count("*"), F.max("x"), F.min("x")).first()
    n, top, low = row
    if not n:
        return 1.0, 1.0, 0.0

    def sums(points: list[int]) -> dict[int, tuple[float, float]]:
        cols = [c for i, k in enumerate(points) for e in [F.exp(F.lit(k / STEPS) * (F.col("x") - top))] for c in (F.sum(e).alias(f"z{i}"), F.sum(F.col("x") * e).alias(f"x{i}"))]
        got = known.agg(*cols).first()
        return {k: (got[2 * i], got[2 * i + 1]) for i, k in enumerate(points)}

    def entropic(k: int, at: tuple[float, float]) -> bool:
        return _entropy(*at, k / STEPS, top) >= target * math.log(n) - 1e-12

    def repeated(k: int, at: tuple[float, float]) -> bool:
        a = k / STEPS
        return budget * math.exp(a * (low - top) - low) / at[0] > max_repeats

    high = [0, STEPS + 1]  # the first holds the entropy (0 always does), the second does not
    less = [-1, STEPS]  # the first repeats too much, the second is taken in any case
    while high[1] - high[0] > 1 or less[1] - less[0] > 1:
        grid = {k for lo, hi in (high, less) for k in range(lo + 1, hi, max(1, (hi - lo) // FAN)) if 0 <= k <= STEPS}
        at = sums(sorted(grid))
        for k in sorted(grid):
            if high[0] < k < high[1] and entropic(k, at[k]):
                high[0] = k
            if less[0] < k < less[1] and repeated(k, at[k]):
                less[0] = k
        for k in sorted(grid, reverse=True):
            if high[0] < k < high[1] and not entropic(k, at[k]):
                high[1] = k
            if less[0] < k < less[1] and not repeated(k, at[k]):
                less[1] = k
    k = max(high[0], less[1])
    return k / STEPS, sums([k])[k][0], top


def _permuted(epoch: Column, level: int, h: Column, seed: str) -> Column:
    """The place of a document's block of this level in the epoch's permutation, as text that sorts by it."""
    byte = F.substring(h, 2 * level + 1, 2)
    return F.concat(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), byte).cast("binary")), 1, 8), byte)


def _order_key(epoch: Column, h: Column, seed: str) -> Column:
    return F.concat(*(_permuted(epoch, i, h, seed) for i in range(LEVELS)), h)


class Mixture(NamedTuple):
    rows: DataFrame
    sources: DataFrame
    exponent: float


def mix_sources(docs: DataFrame, target: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget_ratio: float = 1.0, seed: str = SEED, carry: bool = False) -> Mixture:
    """rows: (doc_id, source, n_tokens, weight, epoch, order_key), one for each time a document occurs in the mixture.

    n_tokens counts words; the mixture's budget is budget_ratio times the corpus' own tokens, rounded down. A source takes its whole
    epochs and then documents of one more epoch, in order_key order, as long as their sum stays within its budget.
    Null is a source like any other; sources without tokens get nothing, not even their empty documents. Rows that
    repeat a doc_id share a place and go in or out together; a null id hashes like the text "null". Empty input gives
    no rows. Other columns are not read. With carry, rows hold all columns of docs, texts included, and then n_tokens,
    weight, epoch and order_key, which replace columns of these names: places are found without texts, and each document
    then works out from its own columns how often it occurs, so that no text is moved but to its output.
    """
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    tokens = docs.select("doc_id", F.col("source").cast("string").alias("source"), skey.alias("skey"), word_count(F.col("text").cast("string")).alias("n_tokens"))
    tokens = materialise(tokens.withColumn("h", F.substring(h, 1, 16)), "mix-tokens")
    totals = materialise(tokens.groupBy("skey").agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = math.floor(total * budget_ratio)
    exponent, z, top = find_exponent(totals, target, max_repeats, budget)
    share = F.exp(F.lit(exponent) * (F.log(F.col("tokens").cast("double")) - F.lit(top))) / F.lit(z)
    sources = totals.where("tokens > 0").withColumn("weight", share)
    sources = sources.withColumn("budget", F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(0.5)).cast("long"))
    sources = sources.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("room", F.col("budget") - F.col("epochs") * F.col("tokens"))
    sources = materialise(sources, "mix-budgets")
    discard(totals)
    placed = tokens.join(sources.select("skey", "weight", "epochs"), "skey")
    placed = materialise(placed.select("*", *(_permuted(F.col("epochs"), i, F.col("h"), seed).alias(f"p{i}") for i in range(LEVELS))), "mix-places")

    # the block of each level in which the room of a source ends, and the room left when that block begins
    ends = sources.select("skey", "room")
    for i in range(LEVELS + 1):
        on = ["skey", *(f"p{j}" for j in range(i))]
        unit = f"p{i}" if i < LEVELS else "h"
        before = [c for c in on if c != "skey"]
        if i == 0:
            sums = placed.groupBy("skey", unit).agg(F.sum("n_tokens").alias("tokens")).join(ends, "skey")
        else:
            sums = placed.join(ends, on).groupBy(*on, unit).agg(F.sum("n_tokens").alias("tokens"), F.max("room").alias("room"))
        upto = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("skey").orderBy(unit)))
        over = upto.where("upto > room").groupBy("skey", *before).agg(F.min(F.struct(unit, (F.col("room") - F.col("upto") + F.col("tokens")).alias("room"))).alias("x"))
        ends = materialise(over.select("skey", *before, f"x.{unit}", "x.room"), "mix-ends")
    ends = ends.select("skey", *(F.col(f"p{i}").alias(f"e{i}") for i in range(LEVELS)), F.col("h").alias("eh"))

    inside = F.col("h") < F.col("eh")
    for i in reversed(range(LEVELS)):
        inside = (F.col(f"p{i}") < F.col(f"e{i}")) | ((F.col(f"p{i}") == F.col(f"e{i}")) & inside)
    # a source whose room never ends within an epoch has no row here; its room is 0 or its remaining documents are empty
    times = (F.col("epochs") + F.coalesce(inside, F.lit(True)).cast("long")).alias("times")
    added = ("n_tokens", "weight", "epoch", "order_key")
    if carry:
        mixed = materialise(sources.select("skey", "weight", "epochs").join(ends, "skey", "left"), "mix-sources-ends")
        mixed = F.broadcast(mixed) if mixed.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else mixed
        own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
        keyed = docs.select(F.struct(*own).alias("row"), skey.alias("skey"), F.substring(h, 1, 16).alias("h"), word_count(F.col("text").cast("string")).alias("n_tokens")).join(mixed, "skey")
        placed = keyed.select("*", *(_permuted(F.col("epochs"), i, F.col("h"), seed).alias(f"p{i}") for i in range(LEVELS)))
        rows = placed.select("row", "n_tokens", "weight", "h", times)
    else:
        rows = placed.join(ends, "skey", "left").select(F.struct("doc_id", "source").alias("row"), "n_tokens", "weight", "h", times)
    rows = rows.where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return Mixture(rows.select("row.*", "n_tokens", "weight", "epoch", _order_key(F.col("epoch"), F.col("h"), seed).alias("order_key")), sources, exponent)
