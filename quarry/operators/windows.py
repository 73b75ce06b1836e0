"""Order-dependent operators: running values, as-of and range joins, chunks, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _before(by: list[str], order: list, current: bool = False):
    return W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if current else -1)


def last_anchor(rows: DataFrame, by: list[str], order: list, anchor: Column, out: str) -> DataFrame:
    """As-of: the anchor value of the last row at or before each row that has one."""
    return rows.withColumn(out, F.last(anchor, ignorenulls=True).over(_before(by, order, True)))


def ends_from_next(rows: DataFrame, by: list[str], start: str, total: Column) -> DataFrame:
    """Ranges from their starts: each ends before the next one, the last at the total."""
    w = W.partitionBy(*by).orderBy(start)
    return rows.withColumn("range_end", F.coalesce(F.lead(start).over(w) - 1, total))


def increasing(rows: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Rows whose value is greater than every value before it."""
    return rows.withColumn("_m", F.max(value).over(_before(by, order))).filter(F.col("_m").isNull() | (F.col(value) > F.col("_m"))).drop("_m")


def sticky(rows: DataFrame, by: list[str], order: list, value: str, restart: Column, out: str = "flag") -> DataFrame:
    """A flag that is set where restart holds against the greatest value before (column _max), and stays set."""
    seen = rows.withColumn("_max", F.max(value).over(_before(by, order)))
    hit = F.coalesce(restart, F.lit(False))
    return seen.withColumn("_hit", hit.cast("int")).withColumn(out, F.max("_hit").over(_before(by, order, True)) == 1).drop("_max", "_hit")


def starts_like_previous(rows: DataFrame, by: list[str], order: list, text: str, n: int) -> DataFrame:
    """Whether a text begins as the one before it does, or its first n characters stand in that one's tail."""
    before = F.lag(text).over(W.partitionBy(*by).orderBy(*order))
    head = F.substring(text, 1, n)
    same = (F.length(head) > 0) & (F.startswith(before, head) | F.contains(F.right(before, F.lit(4 * n)), head))
    return rows.withColumn("like_previous", F.coalesce(same, F.lit(False)))


def covered(ranges: DataFrame, points: DataFrame, start: str, end: str, at: str, width: int) -> DataFrame:
    """Points within ranges: both are dealt to buckets of a width, so that it is an equi join with a filter."""
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    return r.join(p, "_b").filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def chunks(rows: DataFrame, order: list, size: int, by: list[str]) -> DataFrame:
    """Numbered chunks of a size in order, within each group."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("chunk", F.floor((n - 1) / size).cast("bigint"))


def place_in_group(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """index (from 0) and total of each row in its group."""
    w = W.partitionBy(*by)
    return rows.withColumn("index", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count("*").over(w))


def best_tier(rows: DataFrame, by: list[str], tier: str, order: list, value: str) -> DataFrame:
    """The values of each group's lowest tier, in order."""
    low = rows.withColumn("_t", F.min(tier).over(W.partitionBy(*by))).filter(F.col("_t") == F.col(tier))
    ranked = low.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value])
    return ranked.groupBy(*by).agg(F.min(tier).alias(tier), listed.alias("ordered"))


def stratified(rows: DataFrame, by: list[str], caps: dict[str, int], features: dict[str, Column], order: list) -> DataFrame:
    """Per group up to a cap of rows for each feature, in order; a row counts for the first feature that takes it."""
    left, out = rows, None
    for name, cap in caps.items():
        n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        took = left.filter(features[name]).withColumn("_n", n).filter(F.col("_n") <= cap).drop("_n").withColumn("feature", F.lit(name))
        out = took if out is None else out.unionByName(took)
        left = left.join(took.select("key"), "key", "left_anti")
    return out
