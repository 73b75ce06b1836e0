"""Versions of the item table: last-wins reads, snapshots, what changed and why, renames, tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A change is put down to the first of these stamps that is set and differs from the snapshot's.
CAUSES = ["solved", "upgraded", "edited", "migrated", "fixed"]


def last_wins(rows: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The last row of each key, at the place of its first."""
    w = W.partitionBy(key)
    last = rows.withColumn("_first", F.min(order).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc(order))))
    return last.filter("_n = 1").withColumn(order, F.col("_first")).drop("_first", "_n")


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def _kept(rows: DataFrame) -> DataFrame:
    """rows, computed once: a checkpoint where spark.checkpoint.dir names a folder, else the cache."""
    folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return rows.persist()
    rows.sparkSession.sparkContext.setCheckpointDir(folder)
    return rows.checkpoint()


def final_names(renames: DataFrame, order: str | None = None) -> DataFrame:
    """(old, new) for a ledger of renames (old, new): chains are followed to their end, of whatever length.

    Of a name's entries the last in order counts (without an order the greatest).  Names
    that lead into a cycle keep their own entry.  The ledger is joined with itself, so
    paths double each round; a round that ends no further path is the last.
    """
    last = F.max("new") if order is None else F.max_by("new", order)
    now = _kept(renames.filter("old <> new").groupBy("old").agg(last.alias("new")).withColumn("direct", F.col("new")))
    before = None
    while True:
        step = now.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        now = _kept(now.join(step, now["new"] == step["_old"], "left").select("old", F.coalesce("_new", "new").alias("new"), "direct"))
        names = now.select(F.col("old").alias("new"))
        left = now.join(names, "new", "left_semi").count()
        if left in (0, before):
            break
        before = left
    cycles = now.select(F.col("old").alias("_old"))
    return now.join(cycles, now["new"] == cycles["_old"], "left").select("old", F.when(F.col("_old").isNotNull(), F.col("direct")).otherwise(F.col("new")).alias("new"))


def changes(before: DataFrame, after: DataFrame, trash: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """key and change for every key that differs between two snapshots (key, hash, and a column per cause)."""
    if renames is not None:
        names = final_names(renames).withColumnsRenamed({"old": "key", "new": "_to"})
        before = before.join(names, "key", "left").withColumn("key", F.coalesce("_to", "key")).drop("_to")
    b = before.select("key", F.col("hash").alias("b_hash"), *(F.col(c).alias(f"b_{c}") for c in CAUSES))
    both = b.join(after.select("key", "hash", *CAUSES), "key", "full").join(trash.select("key", F.lit(True).alias("_trashed")).distinct(), "key", "left")
    stamped = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & ~F.col(c).eqNullSafe(F.col(f"b_{c}"))
    cause = F.lit("changed")
    for c in reversed(CAUSES):
        cause = F.when(stamped(c), c).otherwise(cause)
    change = (
        F.when(F.col("b_hash").isNull(), "added")
        .when(F.col("hash").isNull(), F.when(F.col("_trashed"), "trashed").otherwise("removed"))
        .when(F.col("hash") != F.col("b_hash"), cause)
    )
    return both.select("key", change.alias("change")).filter("change is not null")


def moved_to_trash(items: DataFrame, trash: DataFrame, keys: list[str], reason: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Items and trash after a deletion of all keys or, if one is unknown, of none."""
    wanted = items.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
    missing = [r.key for r in wanted.join(items.select("key"), "key", "left_anti").limit(20).collect()]
    if missing:
        raise KeyError(f"unknown keys: {missing}")
    gone = items.join(wanted, "key").withColumns({"reason": F.lit(reason), "deleted_at": F.lit(at)})
    return items.join(wanted, "key", "left_anti"), trash.unionByName(gone, allowMissingColumns=True)


def restored(items: DataFrame, trash: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    wanted = items.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
    back = trash.join(wanted, "key").drop("reason", "deleted_at")
    clash = [r.key for r in back.join(items.select("key"), "key", "left_semi").select("key").limit(20).collect()]
    if clash or back.count() != len(dict.fromkeys(keys)):
        raise KeyError(f"cannot restore: {clash or 'unknown keys'}")
    return items.unionByName(back.select(items.columns)), trash.join(wanted, "key", "left_anti")
