"""The item table, its dimension of points, and the columns derived from both.

An item: key, seq, type, stem, options, answer, solution, points (the first is the
primary one) and typed columns for what else is known of it.  Rows of a DataFrame have
no order, so ``seq`` carries the order of insertion and every stable sort ends with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the data model.
EXAM_BOOK = "高考真题"
EXAM, MOCK = "高考", "模拟"
NO_SOLUTION = ["解析无", "解析无。", "无"]
DIFFICULTIES = ["简单题", "中档题", "难题"]


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def kind(book: Column) -> Column:
    return F.when(F.contains(F.coalesce(book, F.lit("")), F.lit(EXAM_BOOK)), EXAM).otherwise(MOCK)


def has_solution(solution: Column) -> Column:
    return ~blank(solution) & ~F.trim(F.coalesce(solution, F.lit(""))).isin(NO_SOLUTION)


def difficulty_rank(difficulty: Column, other: int = 9) -> Column:
    out = F.lit(other)
    for i, d in reversed(list(enumerate(DIFFICULTIES))):
        out = F.when(difficulty == d, i).otherwise(out)
    return out


def with_derived(items: DataFrame, points: DataFrame) -> DataFrame:
    """Adds kind, topic, section, point_title, difficulty, stars, solved and source: an item's own value first, else its primary point's.

    points: id, title, topic, section, stars, difficulty.  The join is an equi join on the
    primary point; Spark broadcasts the dimension if its measured size allows.
    """
    dim = points.select(
        F.col("id").alias("_p_id"), F.col("title").alias("point_title"), "topic", "section", F.col("stars").alias("_p_stars"), F.col("difficulty").alias("_p_difficulty")
    )
    own = F.trim(F.coalesce("difficulty", F.lit("")))
    return (
        items.join(dim, F.get("points", F.lit(0)) == F.col("_p_id"), "left")
        .withColumn("kind", kind(F.col("book")))
        .withColumn("difficulty", F.when(own != "", own).otherwise(F.coalesce("_p_difficulty", F.lit(""))))
        .withColumn("stars", F.when(F.coalesce("stars", F.lit(0)) > 0, F.col("stars")).otherwise(F.coalesce("_p_stars", F.lit(0))).cast("int"))
        .withColumn("topic", F.coalesce("topic", F.lit("")))
        .withColumn("solved", has_solution(F.col("solution")))
        .withColumn("origin", F.when(~blank(F.col("region")), F.col("region")).otherwise(F.regexp_extract(F.coalesce("source_label", F.lit("")), "^(?:.*年)?(.*)$", 1)))
        .drop("_p_id", "_p_stars", "_p_difficulty")
    )


def with_titles(items: DataFrame, points: DataFrame) -> DataFrame:
    """Adds titles: the titles of all known points of an item, in their order."""
    each = items.select("key", F.posexplode("points").alias("at", "id")).join(points.select("id", "title"), "id")
    titles = each.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]), " ").alias("titles"))
    return items.join(titles, "key", "left").withColumn("titles", F.coalesce("titles", F.lit("")))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as items; what documents lack follows from their numbers."""
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    number = lambda m: (k % m).cast("string")
    return d.select(
        F.concat(F.lit("q"), k.cast("string")).alias("key"),
        (k + 1).alias("seq"),
        F.col("lang").alias("type"),
        F.col("text").alias("stem"),
        F.substring("text", 1, 12).alias("answer"),
        F.when(F.col("n_chars") % 5 == 0, "").when(F.col("n_chars") % 5 == 1, "无").otherwise(F.col("text")).alias("solution"),
        F.concat(F.col("source"), F.when(k % 3 == 0, EXAM_BOOK).otherwise("")).alias("book"),
        F.concat(F.lit("2020年"), F.col("source"), F.lit("卷")).alias("source_label"),
        F.when(k % 4 == 0, F.concat(F.lit("region"), number(6))).alias("region"),
        F.when(k % 8 == 0, "single").when(k % 12 == 4, "multi").when(k % 4 == 0, "book").alias("region_scope"),
        F.when(k % 7 != 0, 2000 + k % 25).cast("int").alias("year"),
        F.when(F.col("quality") == 1, "简单题").when(F.col("quality") == 0, "难题").alias("difficulty"),
        F.when(k % 5 == 0, k % 4).cast("int").alias("stars"),
        F.when(k % 11 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("1."), number(4), F.lit("."), number(9)), F.concat(F.lit("2."), number(3), F.lit(".1"))))
        .alias("points"),
        F.when(k % 6 == 0, False).when(k % 6 == 1, True).alias("paper_complete"),
        F.when(k % 13 == 0, "g1").alias("duplicate_group"),
        (k % 17 == 0).alias("figure_low_res"),
        F.when(k % 3 == 0, "manual").when(k % 3 == 1, "").alias("point_source"),
        F.when(k % 4 == 1, "official").when(k % 4 == 2, "").alias("answer_source"),
        F.when(k % 9 == 0, "2024-01-01 00:00").when(k % 9 == 1, "").alias("reviewed_at"),
        F.when(k % 10 == 3, F.concat(F.lit("q"), (k - 3).cast("string"))).when(k % 10 == 4, "gone").alias("dup_of"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension of points from the numbers of the parts; some are of no item and some items' points are not here."""
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("a"), (F.col("p_partkey") % 9).alias("b")).filter("b <> 7").distinct()
    return p.select(
        F.concat(F.lit("1."), F.col("a").cast("string"), F.lit("."), F.col("b").cast("string")).alias("id"),
        F.concat(F.lit("point "), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")).alias("title"),
        F.concat(F.lit("topic "), F.col("a").cast("string")).alias("topic"),
        F.concat(F.lit("section "), (F.col("b") % 3).cast("string")).alias("section"),
        (F.col("b") % 6).cast("int").alias("stars"),
        F.when(F.col("b") % 4 == 0, "简单题").when(F.col("b") % 4 == 1, "中档题").when(F.col("b") % 4 == 2, "难题").alias("difficulty"),
    )


#: The same two tables in DuckDB, to start a query with.
ITEMS_SQL = """
WITH items AS (
  SELECT 'q' || doc_id AS key, doc_id + 1 AS seq, lang AS type, text AS stem, substr(text, 1, 12) AS answer,
    CASE WHEN n_chars % 5 = 0 THEN '' WHEN n_chars % 5 = 1 THEN '无' ELSE text END AS solution,
    source || CASE WHEN doc_id % 3 = 0 THEN '高考真题' ELSE '' END AS book, '2020年' || source || '卷' AS source_label,
    CASE WHEN doc_id % 4 = 0 THEN 'region' || (doc_id % 6) END AS region,
    CASE WHEN doc_id % 8 = 0 THEN 'single' WHEN doc_id % 12 = 4 THEN 'multi' WHEN doc_id % 4 = 0 THEN 'book' END AS region_scope,
    CAST(CASE WHEN doc_id % 7 <> 0 THEN 2000 + doc_id % 25 END AS INTEGER) AS year,
    CASE quality WHEN 1 THEN '简单题' WHEN 0 THEN '难题' END AS own_difficulty, CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 4 AS INTEGER) END AS own_stars,
    CASE WHEN doc_id % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['1.' || (doc_id % 4) || '.' || (doc_id % 9), '2.' || (doc_id % 3) || '.1'] END AS points,
    CASE doc_id % 6 WHEN 0 THEN false WHEN 1 THEN true END AS paper_complete, CASE WHEN doc_id % 13 = 0 THEN 'g1' END AS duplicate_group,
    doc_id % 17 = 0 AS figure_low_res, CASE doc_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN '' END AS point_source,
    CASE doc_id % 4 WHEN 1 THEN 'official' WHEN 2 THEN '' END AS answer_source,
    CASE doc_id % 9 WHEN 0 THEN '2024-01-01 00:00' WHEN 1 THEN '' END AS reviewed_at,
    CASE doc_id % 10 WHEN 3 THEN 'q' || (doc_id - 3) WHEN 4 THEN 'gone' END AS dup_of
  FROM documents LEFT JOIN labels USING (doc_id)),
points AS (
  SELECT '1.' || a || '.' || b AS id, 'point ' || a || '-' || b AS title, 'topic ' || a AS topic, 'section ' || (b % 3) AS section,
    CAST(b % 6 AS INTEGER) AS stars, CASE b % 4 WHEN 0 THEN '简单题' WHEN 1 THEN '中档题' WHEN 2 THEN '难题' END AS difficulty
  FROM (SELECT DISTINCT p_partkey % 5 AS a, p_partkey % 9 AS b FROM part) WHERE b <> 7),
full_items AS (
  SELECT i.* EXCLUDE (own_difficulty, own_stars), title AS point_title, coalesce(topic, '') AS topic, section,
    CASE WHEN contains(book, '高考真题') THEN '高考' ELSE '模拟' END AS kind,
    coalesce(own_difficulty, p.difficulty, '') AS difficulty,
    CAST(CASE WHEN own_stars > 0 THEN own_stars ELSE coalesce(p.stars, 0) END AS INTEGER) AS stars,
    trim(solution) <> '' AND trim(solution) NOT IN ('解析无', '解析无。', '无') AS solved,
    CASE WHEN trim(coalesce(region, '')) <> '' THEN region ELSE regexp_extract(source_label, '^(?:.*年)?(.*)$', 1) END AS origin
  FROM items i LEFT JOIN points p ON p.id = i.points[1])
"""
