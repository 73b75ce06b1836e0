"""Counts by facet, coverage and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _pairs(column: str) -> Column:
    return F.transform(F.col(column), lambda v: F.struct(F.lit(column).alias("facet"), v.cast("string").alias("value")))


def facets(items: DataFrame, columns: list[str], explode: list[str] = ()) -> DataFrame:
    """facet, value, n and first_seq for all facets from one pass: an item becomes one array of (facet, value) pairs, counted together."""
    one = [F.array(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))) for c in columns]
    many = [_pairs(c) for c in explode]
    pairs = items.select("seq", F.explode(F.concat(*one, *many)).alias("p")).filter(F.col("p.value").isNotNull() & (F.col("p.value") != ""))
    return pairs.groupBy("p.facet", "p.value").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def top(counts: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k most frequent values of each facet; ties in order of first appearance.  Ranks run over counts, not rows."""
    order = W.partitionBy(*by).orderBy(F.desc("n"), "first_seq")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def dotted(c: Column) -> Column:
    """A dotted id as an array of numbers, for sorting."""
    return F.transform(F.split(c, "\\."), lambda x: x.try_cast("int"))


def totals(items: DataFrame) -> DataFrame:
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("solved")).alias("no_solution"),
        F.count_if(blank("answer")).alias("no_answer"),
        F.count_if(F.size("points") == 0).alias("no_points"),
    )


def batches(items: DataFrame) -> DataFrame:
    """Per book: count, first and last seq, and the kind of its first item."""
    return items.groupBy("book").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("kind", "seq").alias("kind")
    )


def coverage(items: DataFrame, points: DataFrame) -> DataFrame:
    """Every point of the dimension with its count of items, zeros kept."""
    n = items.select("key", F.explode(F.array_distinct("points")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return points.join(n, "id", "left").select("id", "title", "topic", "section", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def topic_coverage(items: DataFrame, points: DataFrame) -> DataFrame:
    return coverage(items, points).groupBy("topic").agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("covered"))


def matrix(items: DataFrame, difficulties: list[str]) -> DataFrame:
    """Point by difficulty: one count per value, given in advance so that Spark needs no pass to find them."""
    each = items.select(F.explode("points").alias("point"), "difficulty")
    return each.groupBy("point").agg(*(F.count_if(F.col("difficulty") == d).alias(f"n{i}") for i, d in enumerate(difficulties)), F.count("*").alias("n"))


def topic_items(items: DataFrame, points: DataFrame) -> DataFrame:
    """Items per topic, an item counted once however many of its points are there."""
    each = items.select("key", F.explode("points").alias("id")).join(points.select("id", "topic"), "id")
    return each.groupBy("topic").agg(F.countDistinct("key").alias("n"))


def repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
