"""Merging a batch into the library: what a newer row may change, and what it may not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.model import has_solution

# Stars that go with a difficulty.
STARS = {"简单题": 1, "中档题": 2, "难题": 3}


def _text(c):
    return F.trim(F.coalesce(c, F.lit("")))


def upgrade(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """old joined with new by key: fields after the upgrade, and which were upgraded.  An empty new field never replaces one that is set.

    Both have key, answer, solution, difficulty and points.
    """
    o = old.select("key", *(F.col(c).alias(f"o_{c}") for c in ("answer", "solution", "difficulty", "points")))
    n = new.select("key", *(F.col(c).alias(f"n_{c}") for c in ("answer", "solution", "difficulty", "points")), F.lit(True).alias("_new"))
    b = o.join(n, "key", "left")
    has_new, has_old = has_solution(F.col("n_solution")), has_solution(F.col("o_solution"))
    solution = F.coalesce("_new", F.lit(False)) & has_new & (~has_old | (F.lit(force) & (_text(F.col("n_solution")) != _text(F.col("o_solution")))))
    answer = (_text(F.col("n_answer")) != "") & (_text(F.col("n_answer")) != _text(F.col("o_answer")))
    merged = F.array_distinct(F.concat(F.coalesce("n_points", F.array().cast("array<string>")), "o_points"))
    points = F.size(merged) > F.size("o_points")
    difficulty = (_text(F.col("n_difficulty")) != "") & (_text(F.col("o_difficulty")) == "")
    return b.select(
        "key",
        F.when(answer, F.col("n_answer")).otherwise(F.col("o_answer")).alias("answer"),
        F.when(answer & (_text(F.col("o_answer")) != ""), F.col("o_answer")).alias("answer_prev"),
        F.when(solution, F.col("n_solution")).otherwise(F.col("o_solution")).alias("solution"),
        F.when(points, merged).otherwise(F.col("o_points")).alias("points"),
        F.when(difficulty, F.col("n_difficulty")).otherwise(F.col("o_difficulty")).alias("difficulty"),
        (solution | answer | points | difficulty).alias("upgraded"),
    )


def backfill(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fills points and difficulty of old items that have no point at all; texts stay."""
    n = new.select("key", F.col("points").alias("n_points"), F.col("difficulty").alias("n_difficulty"))
    bare = F.size("points") == 0
    fill = bare & (_text(F.col("difficulty")) == "") & (_text(F.col("n_difficulty")) != "")
    stars = F.create_map(*[F.lit(x) for kv in STARS.items() for x in kv])
    return (
        old.join(n, "key", "left")
        .withColumn("stars", F.when(fill, F.coalesce(F.element_at(stars, _text(F.col("n_difficulty"))), F.lit(0))).otherwise(F.col("stars")))
        .withColumn("difficulty", F.when(fill, _text(F.col("n_difficulty"))).otherwise(F.col("difficulty")))
        .withColumn("points", F.when(bare & (F.size("n_points") > 0), F.col("n_points")).otherwise(F.col("points")))
        .drop("n_points", "n_difficulty")
    )


def compare_and_swap(items: DataFrame, patches: DataFrame) -> DataFrame:
    """items with stem replaced by patches (key, expect, stem), where the hash of the stem is the one expected.

    A patch that is there already counts as applied; if any other patch's expectation fails, or its key is unknown, none is applied.
    """
    joined = patches.join(items.select("key", F.sha2("stem", 256).alias("_h")), "key", "left")
    bad = joined.filter(F.col("_h").isNull() | ((F.col("_h") != F.col("expect")) & (F.col("_h") != F.sha2("stem", 256))))
    broken = [r.key for r in bad.select("key").limit(20).collect()]
    if broken:
        raise ValueError(f"refused: {broken}")
    new = patches.select("key", F.col("stem").alias("_stem"))
    return items.join(new, "key", "left").withColumn("stem", F.coalesce("_stem", "stem")).drop("_stem")


def free_keys(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """A key book/label#n for each row of a batch (seq, book, label): the free numbers of the prefix from 1 on, in the order of seq.

    A slash or a number sign in a name becomes its full-width form.  Of a prefix only the
    numbers in use that lie among the first (rows + numbers in use) matter; the free ones
    are what is left of these.
    """
    safe = lambda c: F.translate(F.coalesce(c, F.lit("")), "/#", "／＃")
    rows = batch.withColumn("_prefix", F.concat_ws("/", safe("book"), safe("label"))).withColumn("_n", F.row_number().over(W.partitionBy("_prefix").orderBy("seq")))
    number = F.regexp_extract("key", "#([0-9]+)$", 1).try_cast("bigint")
    used = existing.select(F.regexp_extract("key", "^(.*)#([0-9]+)$", 1).alias("_prefix"), number.alias("_used")).filter("_used > 0").distinct()
    # The k-th number in use has _used - k free ones before it; row n takes the n-th free number.
    before = used.withColumn("_k", F.row_number().over(W.partitionBy("_prefix").orderBy("_used"))).withColumn("_free", F.col("_used") - F.col("_k"))
    skipped = before.groupBy("_prefix", "_free").agg(F.max("_k").alias("_k"))
    both = rows.select("_prefix", F.col("_n").alias("_at"), F.lit(1).alias("_row")).unionByName(skipped.select("_prefix", (F.col("_free") + 1).alias("_at"), F.col("_k"), F.lit(0).alias("_row")), allowMissingColumns=True)
    over = W.partitionBy("_prefix").orderBy("_at", "_row").rowsBetween(W.unboundedPreceding, 0)
    numbered = both.withColumn("_skip", F.coalesce(F.max("_k").over(over), F.lit(0))).filter("_row = 1").select("_prefix", F.col("_at").alias("_n"), "_skip")
    joined = rows.join(numbered, ["_prefix", "_n"])
    return joined.withColumn("key", F.concat_ws("#", "_prefix", (F.col("_n") + F.col("_skip")).cast("string"))).drop("_prefix", "_n", "_skip")


def exact_duplicates(batch: DataFrame, library: DataFrame) -> DataFrame:
    """Rows of a batch (key, seq, fingerprint) that the library, or an earlier row of the batch, has by key or by fingerprint.  Two equi joins, no OR join."""
    by_key = batch.join(library.select("key").distinct(), "key", "left_semi").select("seq", F.lit("key").alias("why"))
    by_print = batch.join(library.select("fingerprint").distinct(), "fingerprint", "left_semi").select("seq", F.lit("text").alias("why"))
    w = W.partitionBy("fingerprint").orderBy("seq")
    inside = batch.withColumn("_n", F.row_number().over(w)).filter("_n > 1").select("seq", F.lit("batch").alias("why"))
    return by_key.unionByName(by_print).unionByName(inside).groupBy("seq").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("why"))


def renamed_usage(usage: DataFrame, names: DataFrame) -> DataFrame:
    """Usage counts (key, n) after renames (old, new): counts of keys that meet are added."""
    return (
        usage.join(names.withColumnRenamed("old", "key"), "key", "left").groupBy(F.coalesce("new", "key").alias("key")).agg(F.sum("n").alias("n"))
    )
