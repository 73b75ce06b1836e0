"""Incremental ingest as a stream: new files of a folder, exact duplicates dropped, batches merged into the item table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.history import first_of, last_wins
from quarry.operators.similarity import fingerprint
from quarry.sources.volumes import all_rows, append_batch, current


def incoming(spark: SparkSession, folder: str, schema: str, delay: str = "1 hour") -> DataFrame:
    """Rows of new Parquet files (with at: timestamp); a row that is delivered again within the watermark counts once, so that state stays bounded."""
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("fingerprint", fingerprint(F.col("stem")))
    return rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["key", "fingerprint", "at"])


def merge_into(folder: str, writer: str = ""):
    """A foreachBatch function: of a key in the batch the last row wins; rows whose text some item of the earlier batches has now, or a row before them in the batch, are left out.

    What an item said before does not count, so a text that comes back is taken.  A known
    key with a new text becomes that key's latest row (see volumes.current).  Each micro-batch
    writes a partition of its own, so nothing is rewritten, and a batch that is replayed by
    its writer replaces its own rows and sees only those of earlier ones.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        rows = last_wins(batch)
        if epoch:
            earlier = all_rows(batch.sparkSession, folder, schema=f"{_ddl(batch)}, batch int").filter(F.col("batch") < epoch)
            rows = rows.join(current(earlier).select("fingerprint").distinct(), "fingerprint", "left_anti").select(batch.columns)
        append_batch(first_of(rows, ["fingerprint"], ["seq", "key"]), folder, epoch, writer)

    return run


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)


def ingest(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str) -> StreamingQuery:
    stream = incoming(spark, folder, schema)
    return stream.writeStream.foreachBatch(merge_into(table, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, value) by window and type; works on a table and on a stream."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
