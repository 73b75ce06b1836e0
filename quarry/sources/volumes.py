"""Text volumes of items, an item table of batches, Markdown exchange, the archive of papers, and JSON-lines ledgers."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.history import _kept

#: Ranges into which the rows of one value are cut to be numbered.
RANGES = 128
# Fixed values of the volume format.
HEAD, GONE, PER_VOLUME = "%% @q ", "%% @gone", 5000
HEADER = "key string, seq bigint, type string, answer string, points array<string>"


def write_volumes(items: DataFrame, folder: str, per_volume: int = PER_VOLUME) -> None:
    """Items as text: a header line of JSON, then the stem; per_volume items a file, in the order of seq within a volume."""
    block = F.concat(F.lit(HEAD), F.to_json(F.struct("key", "seq", "type", "answer", "points")), F.lit("\n"), F.coalesce("stem", F.lit("")))
    volume = F.floor((F.col("seq") - 1) / per_volume)
    rows = items.select(volume.alias("volume"), "seq", block.alias("value"))
    rows.repartition("volume").sortWithinPartitions("volume", "seq").select("volume", "value").write.partitionBy("volume").text(folder)


def read_volumes(spark: SparkSession, folder: str) -> DataFrame:
    """The items of volumes; blocks split where a header begins, tombstones left out."""
    raw = spark.read.option("lineSep", "\n" + HEAD).text(folder)
    block = F.when(F.startswith("value", F.lit(HEAD)), F.substring("value", len(HEAD) + 1, 1 << 30)).otherwise(F.col("value"))
    parts = raw.select(block.alias("b")).filter((F.trim("b") != "") & ~F.startswith("b", F.lit(GONE)) & ~F.col("b").rlike(rf"^\{{[^\n]*\}}\n{GONE}"))
    cut = F.locate("\n", F.col("b"))
    head = F.from_json(F.when(cut > 0, F.substr("b", F.lit(1), cut - 1)).otherwise(F.col("b")), HEADER)
    body = F.when(cut > 0, F.regexp_replace(F.substr("b", cut + 1), "\n$", "")).otherwise("")
    return parts.select(head.alias("h"), body.alias("stem")).select("h.*", "stem").filter("key is not null")


def _claimed(spark: SparkSession, folder: str, batch: int, writer: str) -> str:
    """Who writes a batch: the first to create its claim."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_claims/batch={batch}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        stream = fs.open(path)
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    try:
        out.write(bytearray(writer.encode()))
    finally:
        out.close()
    return writer


def append_batch(rows: DataFrame, folder: str, batch: int, writer: str = "") -> None:
    """Rows as one batch of a table that only grows: a partition of its own, so writers of different batches never touch each other's rows.

    A batch belongs to the writer that claims it first.  The same writer may write it again,
    which replaces it and nothing else; another one is refused.
    """
    owner = _claimed(rows.sparkSession, folder, int(batch), writer)
    if owner != writer:
        raise ValueError(f"batch {int(batch)} belongs to {owner!r}")
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={int(batch)}")


def all_rows(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Every row of every batch, with batch."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("basePath", folder).parquet(f"{folder.rstrip('/')}/batch=*")


def current(rows: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Of each key the row of the latest batch, and there the last; without batch."""
    place = F.struct("batch", order)
    last = F.row_number().over(W.partitionBy(key).orderBy(place.desc()))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n", "batch")


def numbered(rows: DataFrame, by: str, order: str, n: str) -> DataFrame:
    """rows with their number from 1 within by, in order.

    A value of by may hold most of the rows, so each is cut into RANGES ranges of about as
    many rows; a range is numbered by itself and what stands before it is added.  A value's
    cuts are RANGES numbers, broadcast: by is a type or another column of few values.
    """
    # Kept: quantiles may come out otherwise when they are made again, and counts and numbers need the same ones.
    cuts = _kept(rows.groupBy(F.col(by).alias("_by")).agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)]).alias("_cuts")))
    place = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    ranged = rows.join(F.broadcast(cuts), F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("_range", F.greatest(place, F.lit(0))).drop("_by", "_cuts")
    counts = ranged.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_in")).agg(F.count("*").alias("_rows"))
    earlier = W.partitionBy("_by").orderBy("_in").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_by", "_in", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    found = ranged.join(F.broadcast(before), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_in")), "left")
    own = F.row_number().over(W.partitionBy(by, "_range").orderBy(order))
    return found.withColumn(n, F.col("_before") + own).drop("_by", "_in", "_range", "_before")


def to_markdown(items: DataFrame, per: int = 100) -> DataFrame:
    """(batch, value): items as Markdown sections, per of them a batch within each type."""
    n = F.col("_n")
    section = F.concat(
        F.lit("## "), F.col("key"), F.lit("\n\n"), F.coalesce("stem", F.lit("")), F.lit("\n\n### answer\n\n"), F.coalesce("answer", F.lit("")),
        F.lit("\n\n### solution\n\n"), F.coalesce("solution", F.lit("")),
    )
    return numbered(items, "type", "seq", "_n").select("type", F.floor((n - 1) / per).cast("int").alias("batch"), "seq", section.alias("value"))


def from_markdown(sections: DataFrame, value: str = "value") -> DataFrame:
    """key, stem, answer, solution from Markdown sections; joined by key, never by order."""
    whole = lambda i: F.coalesce(F.get(F.split(value, "\n\n### (?:answer|solution)\n\n", -1), F.lit(i)), F.lit(""))
    part = lambda i: F.trim(whole(i))
    head = F.regexp_extract(F.col(value), r"^## (\S+)", 1)
    return sections.select(head.alias("key"), F.trim(F.regexp_replace(whole(0), r"^## \S+\n\n", "")).alias("stem"), part(1).alias("answer"), part(2).alias("solution"))


def collect(library: DataFrame, returned: DataFrame, skip_bad: bool = False) -> DataFrame:
    """The library with answers and solutions that came back; a detailed item needs a solution, any other an answer.

    A row that fails, or whose key is unknown, rejects the batch; with skip_bad it is left out.
    """
    new = returned.join(library.select("key", "type"), "key", "left")
    bad = new["type"].isNull() | F.when(new["type"] == "detailed_answer", F.trim("solution") == "").otherwise(F.trim("answer") == "")
    if not skip_bad:
        wrong = [r.key for r in new.filter(bad).select("key").limit(20).collect()]
        if wrong:
            raise ValueError(f"rejected: {wrong}")
    good = new.filter(~bad).select("key", F.col("answer").alias("_a"), F.col("solution").alias("_s"))
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c))
    return library.join(good, "key", "left").withColumns({"answer": F.coalesce(filled("_a"), "answer"), "solution": F.coalesce(filled("_s"), "solution")}).drop("_a", "_s")


def saved_papers(archive: DataFrame, papers: DataFrame) -> DataFrame:
    """The archive after papers (name, keys, note, at) are saved: the last of a name wins and keeps the first's at and seq."""
    seq = F.coalesce(F.max("seq"), F.lit(0)).alias("_top")
    last = papers.groupBy("name").agg(F.max_by("keys", "at").alias("keys"), F.max_by("note", "at").alias("note"), F.max("at").alias("updated"), F.min("at").alias("_at"))
    old = archive.select("name", F.col("at").alias("_o_at"), F.col("seq").alias("_o_seq"))
    joined = last.join(old, "name", "left").crossJoin(F.broadcast(archive.agg(seq)))  # one row
    fresh = F.row_number().over(W.partitionBy(F.col("_o_seq").isNull()).orderBy("_at", "name"))
    saved = joined.select("name", "keys", "note", F.coalesce("_o_at", "_at").alias("at"), F.coalesce("_o_seq", F.col("_top") + fresh).cast("bigint").alias("seq"), "updated")
    return archive.join(last.select("name"), "name", "left_anti").unionByName(saved)


def listed_papers(archive: DataFrame) -> DataFrame:
    return archive.orderBy(F.coalesce("updated", "at").desc(), F.desc("seq"))


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines ledger; lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """A JSON tree of topics, sections and points as rows; of a repeated id the last wins."""
    tree = spark.read.schema(
        "topics array<struct<title:string,sections:array<struct<title:string,points:array<struct<id:string,title:string,stars:int,difficulty:string>>>>>>"
    ).json(path, multiLine=True)
    rows = (
        tree.select(F.posexplode("topics").alias("i", "t"))
        .select("i", F.col("t.title").alias("topic"), F.posexplode("t.sections").alias("j", "s"))
        .select("i", "j", "topic", F.col("s.title").alias("section"), F.posexplode("s.points").alias("k", "p"))
        .select("topic", "section", F.struct("i", "j", "k").alias("place"), "p.*")
    )
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("place")))).filter("_n = 1").drop("_n", "place")


def image_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder with their bytes' digest; contents stay on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("signature"))
