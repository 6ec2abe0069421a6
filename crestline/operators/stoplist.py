"""Stop-lists: one-column tables of words, and the exclusion of queries that equal one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions.text import normalize_stop_word


def normalised(words: DataFrame) -> DataFrame:
    """(word): normalised, distinct, blanks left out."""
    return words.select(normalize_stop_word(F.col(words.columns[0])).alias("word")).where("word <> ''").distinct()


def add(stop: DataFrame, words: DataFrame) -> DataFrame:
    return stop.select("word").union(normalised(words)).distinct()


def remove(stop: DataFrame, words: DataFrame) -> DataFrame:
    return stop.join(normalised(words), "word", "left_anti")


def contains(stop: DataFrame, word: str) -> bool:
    """Whether the list holds just this word; the argument is not normalised."""
    return not stop.where(F.col("word") == word).isEmpty()


def contains_all(stop: DataFrame, words: DataFrame) -> DataFrame:
    """(word, listed) for each row of words, as they are written; Spark broadcasts the list if its size allows."""
    listed_words = stop.select("word").distinct().withColumn("listed", F.lit(True))
    return words.select(F.col(words.columns[0]).alias("word")).join(listed_words, "word", "left").select("word", F.coalesce("listed", F.lit(False)).alias("listed"))


def listed(stop: DataFrame) -> DataFrame:
    """In byte order."""
    return stop.select("word").orderBy("word")


def exclude(rows: DataFrame, stop: DataFrame | None, column: str = "query") -> DataFrame:
    """Rows whose whole query is no stop word; Spark broadcasts the list if its size allows."""
    return rows if stop is None else rows.join(stop.select(F.col("word").alias(column)), column, "left_anti")
