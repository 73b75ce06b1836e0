"""The queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import facets, history, merge, model, near, postings, predicates, search, selection, similarity, windows
from quarry.operators.model import ITEMS_SQL, items, points, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = False):
    """Registers a query under the function's name; base: its SQL starts with the item tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (ITEMS_SQL + sql) if base else sql
        return f

    return add


def full(spark: SparkSession, d: str) -> DataFrame:
    return model.with_derived(items(spark, d), points(spark, d))


# --- filters, search, sorts -------------------------------------------------

KEYWORD = "the, tion"


@query(
    """, t AS (SELECT key, string_agg(title, ' ' ORDER BY place) AS titles FROM (SELECT key, unnest(points) AS id, generate_subscripts(points, 1) AS place FROM items) x JOIN points USING (id) GROUP BY key),
s AS (
  SELECT i.*, coalesce(titles, '') AS titles, concat_ws(' ', book, source_label, region) AS src FROM full_items i LEFT JOIN t USING (key)),
w AS (SELECT unnest(['the', 'tion']) AS t),
hit AS (
  SELECT key, seq, t, contains(stem, t) AS a, contains(answer, t) AS b, contains(titles, t) AS c, contains(src, t) AS d, contains(solution, t) AS e,
    contains(substr(stem, 1, 20), t) AS early, (length(stem) - length(replace(stem, t, ''))) // length(t) AS na,
    (length(answer) - length(replace(answer, t, ''))) // length(t) AS nb, (length(solution) - length(replace(solution, t, ''))) // length(t) AS ne,
    contains(lower(coalesce(source_label, '')), t) OR contains(lower(book), t) OR contains(lower(coalesce(region, '')), t) OR contains(lower(key), t) AS any_source
  FROM s, w),
r AS (
  SELECT key, seq, sum(CASE WHEN a THEN 40 + 3 * least(na, 3) + CASE WHEN early THEN 10 ELSE 0 END ELSE 0 END + CASE WHEN b THEN 15 + least(nb, 2) ELSE 0 END
    + CASE WHEN c THEN 12 ELSE 0 END + CASE WHEN d THEN 10 ELSE 0 END + CASE WHEN e THEN 6 + least(ne, 2) ELSE 0 END) + CASE WHEN bool_and(a OR b OR c OR d OR e) THEN 20 ELSE 0 END AS score
  FROM hit GROUP BY key, seq HAVING bool_and(a OR b OR e OR any_source))
SELECT key, CAST(score AS INTEGER) AS score FROM r JOIN full_items USING (key) WHERE type IN ('en', 'fr') ORDER BY score DESC, r.seq LIMIT 50""",
    base=True,
)
def search_ranked(spark, d):
    """Filter, score, stable sort, page: the flagship."""
    rows = model.with_titles(full(spark, d), points(spark, d))
    tags = predicates.matching_tags(points(spark, d), KEYWORD)
    p = predicates.Params(types=["en", "fr"], keyword=KEYWORD)
    scored = rows.filter(predicates.build(p, tags)).withColumn("score", search.field_score(KEYWORD))
    return search.page(scored.select("key", "seq", "score"), [F.desc("score"), F.col("seq")], 50).select("key", "score")


@query(
    """SELECT key, kind, origin, difficulty FROM full_items WHERE kind = '高考' AND list_has_any(points, ['1.0.0', '1.3.3', '2.0.1']) AND difficulty IN ('简单题', '中档题', '')
  AND CAST(year AS VARCHAR) IN ('2003', '2006', '2009', '2012', '2015') AND NOT coalesce(paper_complete = false, false)""",
    base=True,
)
def filter_facets(spark, d):
    p = predicates.Params(kinds=["高考"], points=["1.0.0", "1.3.3", "2.0.1"], difficulties=["简单题", "中档题", ""], years=["2003", "2006", "2009", "2012", "2015"], paper_state="complete")
    return full(spark, d).filter(predicates.build(p)).select("key", "kind", "origin", "difficulty")


@query(
    """SELECT key, seq FROM full_items WHERE (stars > 0) AND (duplicate_group IS NOT NULL OR true) AND CASE WHEN trim(coalesce(point_source, '')) = '' THEN '无' ELSE point_source END IN ('无')
  AND CASE WHEN trim(coalesce(answer_source, '')) = '' THEN '无' ELSE answer_source END IN ('无', 'official') AND trim(coalesce(reviewed_at, '')) = ''
  AND coalesce(region_scope, 'unknown') IN ('unknown', 'multi')""",
    base=True,
)
def filter_states(spark, d):
    p = predicates.Params(star_state="rated", point_source=["无"], answer_source=["无", "official"], reviewed="no", region_scope=["unknown", "multi"])
    return full(spark, d).filter(predicates.build(p)).select("key", "seq")


@query("SELECT key FROM full_items WHERE solved AND len(points) > 0 AND NOT (duplicate_group IS NOT NULL)", base=True)
def has_and_missing(spark, d):
    return full(spark, d).filter(predicates.build(predicates.Params(has=["solution", "tag"], missing=["doubt", "no such flag"]))).select("key")


@query(
    """SELECT key FROM full_items WHERE (contains(stem, 'and') OR contains(answer, 'and') OR contains(solution, 'and') OR contains(lower(source_label), 'and') OR contains(lower(book), 'and') OR contains(lower(coalesce(region, '')), 'and'))
  AND (contains(stem, '2-') OR contains(answer, '2-') OR contains(solution, '2-') OR list_has_any(points, (SELECT list(id) FROM points WHERE contains(lower(title), '2-'))))""",
    base=True,
)
def keyword_and_tags(spark, d):
    tags = predicates.matching_tags(points(spark, d), "and；2-")
    return full(spark, d).filter(predicates.build(predicates.Params(keyword="and；2-"), tags)).select("key")


@query("SELECT * FROM (VALUES ('q9', 0), ('q2', 1), ('q7', 3)) t(key, pos) WHERE key IN (SELECT key FROM items)", base=True)
def keys_in_given_order(spark, d):
    return predicates.in_given_order(items(spark, d), ["q9", "q2", "nothing", "q7", "q9"]).select("key", "pos")


@query(
    """, p AS (SELECT *, CASE WHEN trim(coalesce(dup_of, '')) = '' THEN key ELSE dup_of END AS variant FROM items WHERE length(trim(solution)) >= 20 AND duplicate_group IS NULL AND coalesce(year, 0) >= 2005)
SELECT key, variant FROM p QUALIFY row_number() OVER (PARTITION BY variant ORDER BY seq) = 1""",
    base=True,
)
def selection_pool(spark, d):
    return predicates.selection_pool(items(spark, d), 2005).select("key", "variant")


def _sorted(name: str, sort: str, order: str):
    @query(f", s AS (SELECT * FROM full_items ORDER BY {order} LIMIT 40 OFFSET 10) SELECT key, row_number() OVER (ORDER BY {order}) AS place FROM s", base=True)
    def run(spark, d):
        from pyspark.sql import Window as W

        rows = search.page(full(spark, d).withColumn("used", F.lit(0)), search.ordering(sort), 40, 10)
        return rows.withColumn("place", F.row_number().over(W.orderBy(*search.ordering(sort))).cast("bigint")).select("key", "place")  # 40 rows

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_RANK = "CASE difficulty WHEN '简单题' THEN 0 WHEN '中档题' THEN 1 WHEN '难题' THEN 2 ELSE 9 END"
_sorted("sort_new", "new", "seq DESC")
_sorted("sort_difficulty", "diff", f"{_RANK}, seq")
_sorted("sort_difficulty_down", "diff2", f"{_RANK} DESC, seq")
_sorted("sort_year", "year", "coalesce(year, 0) = 0, coalesce(year, 0) DESC, seq")
_sorted("sort_year_up", "year2", "coalesce(year, 0) = 0, coalesce(year, 0), seq")

_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def token_index(spark, d):
    """Stored postings of tokens() of the documents."""
    return postings.index(spark, [f"{d}/documents.parquet"], read(spark, d, "documents").select("doc_id", "text"), "doc_id", search.tokens(F.col("text")), "tokens")


@query(
    f"""WITH t AS (SELECT doc_id AS key, {_TOKENS} AS w FROM documents),
c AS (SELECT key, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'tion')) AS b FROM t),
s AS (SELECT count(*) AS n, avg(n) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT key, round(greatest(ln((s.n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * c.n / av)) + greatest(ln((s.n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * c.n / av)), 6) AS score
FROM c, s WHERE a > 0 AND b > 0"""
)
def bm25_search(spark, d):
    """From the stored index, which the first search of these files builds."""
    return postings.search_words(spark, token_index(spark, d), "the tion").select("key", F.round("score", 6).alias("score"))


@query(
    f"""WITH t AS (SELECT doc_id AS key, unnest({_TOKENS}) AS token FROM documents) SELECT token, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT key, token, count(*) AS tf FROM t GROUP BY ALL) GROUP BY token"""
)
def inverted_index(spark, d):
    found, _ = search.inverted_index(read(spark, d, "documents"), "doc_id", "text")
    return found.groupBy("token").agg(F.count("*").alias("postings"), F.sum("tf").alias("tf"))


@query(
    f"""WITH t AS (SELECT doc_id AS key, {_TOKENS} AS w FROM documents), p AS (SELECT key, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS place FROM t)
SELECT token, count(DISTINCT key) AS postings, CAST(sum(place) AS BIGINT) AS places, CAST(min(place) AS INTEGER) AS first, CAST(max(place) AS INTEGER) AS last FROM p GROUP BY token"""
)
def stored_postings(spark, d):
    """The whole stored index: its postings and positions by token."""
    rows = spark.read.parquet(f"{token_index(spark, d).folder}/postings")
    places = F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return rows.groupBy("token").agg(F.count("*").alias("postings"), F.sum(places).alias("places"), F.min(F.get("positions", F.lit(0))).alias("first"), F.max(F.element_at("positions", -1)).alias("last"))


@query(
    """, o AS (SELECT * FROM full_items WHERE key = 'q5')
SELECT i.key, round((CASE WHEN i.topic <> '' AND i.topic = o.topic THEN 6 ELSE 0 END) + (CASE WHEN i.section = o.section THEN 5 ELSE 0 END) + (CASE WHEN i.difficulty = o.difficulty THEN 4 ELSE 0 END)
  + (CASE WHEN list_has_any(i.points, o.points) THEN 2 ELSE 0 END) + (CASE WHEN i.solved THEN 1 ELSE 0 END) + (CASE WHEN i.kind = o.kind THEN 0.5 ELSE 0 END) - 0.02 * least(i.seq % 30, 20), 2)::DOUBLE AS score
FROM full_items i, o WHERE i.key <> o.key AND i.type = o.type ORDER BY score DESC, i.seq LIMIT 12""",
    base=True,
)
def replacement_candidates(spark, d):
    rows = full(spark, d).withColumn("used", F.col("seq") % 30)
    return search.replacements(rows, rows.filter("key = 'q5'")).select("key", "score")


_GRAMS = "list_distinct(flatten([regexp_extract_all(substr(s, i), '(?s).{8}') for i in range(1, 9)]))"


@query(
    f"""WITH t AS (SELECT item_id AS tid, unnest({_GRAMS}) AS g FROM (SELECT item_id, regexp_replace(lower(text), '\\s+', '', 'g') AS s FROM benchmark) WHERE length(s) >= 8),
df AS (SELECT g, ln(((SELECT count(*) FROM benchmark) + 1) / (count(*) + 1)) * 1.5 AS w FROM t GROUP BY g),
q AS (SELECT doc_id AS qid, unnest({_GRAMS}) AS g FROM (SELECT doc_id, regexp_replace(lower(text), '\\s+', '', 'g') AS s FROM documents) WHERE length(s) >= 8),
r AS (SELECT qid, tid, round(sum(w), 6) AS score FROM q JOIN t USING (g) JOIN df USING (g) GROUP BY qid, tid)
SELECT qid, tid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS rank FROM r QUALIFY rank <= 5"""
)
def idf_shortlist(spark, d):
    q = read(spark, d, "documents").select(F.col("doc_id").alias("qid"), "text")
    t = read(spark, d, "benchmark").select(F.col("item_id").alias("tid"), "text")
    return search.shortlist(q, t, 5, 8).select("qid", "tid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# --- facets and statistics ----------------------------------------------------


@query(
    """, f AS (
  SELECT 'type' AS facet, type AS value, seq FROM full_items UNION ALL SELECT 'kind', kind, seq FROM full_items UNION ALL SELECT 'difficulty', difficulty, seq FROM full_items
  UNION ALL SELECT 'year', CAST(year AS VARCHAR), seq FROM full_items UNION ALL SELECT 'origin', origin, seq FROM full_items UNION ALL SELECT 'topic', topic, seq FROM full_items
  UNION ALL SELECT 'points', unnest(points), seq FROM full_items)
SELECT facet, value, count(*) AS n, min(seq) AS first_seq FROM f WHERE value <> '' GROUP BY facet, value""",
    base=True,
)
def facets_one_pass(spark, d):
    return facets.facets(full(spark, d), ["type", "kind", "difficulty", "year", "origin", "topic"], ["points"])


@query(
    """, f AS (SELECT 'book' AS facet, book AS value, count(*) AS n, min(seq) AS first_seq FROM items GROUP BY book UNION ALL SELECT 'points', p, count(*), min(seq) FROM (SELECT unnest(points) AS p, seq FROM items) GROUP BY p)
SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, first_seq) AS place FROM f QUALIFY place <= 15""",
    base=True,
)
def top_values(spark, d):
    return facets.top(facets.facets(items(spark, d), ["book"], ["points"]), ["facet"], 15).select("facet", "value", "n", F.col("place").cast("bigint").alias("place"))


@query(
    "SELECT count(*) AS total, count(*) FILTER (NOT solved) AS no_solution, count(*) FILTER (trim(answer) = '') AS no_answer, count(*) FILTER (len(points) = 0) AS no_points FROM full_items", base=True
)
def item_totals(spark, d):
    return facets.totals(full(spark, d))


@query("SELECT book, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(kind, seq) AS kind FROM full_items GROUP BY book", base=True)
def book_batches(spark, d):
    return facets.batches(full(spark, d))


@query(
    """, c AS (SELECT id, count(DISTINCT key) AS n FROM (SELECT key, unnest(points) AS id FROM items) GROUP BY id)
SELECT id, title, topic, section, coalesce(n, 0) AS n FROM points LEFT JOIN c USING (id)""",
    base=True,
)
def coverage_with_zeros(spark, d):
    return facets.coverage(items(spark, d), points(spark, d))


@query(
    """, c AS (SELECT id, count(DISTINCT key) AS n FROM (SELECT key, unnest(points) AS id FROM items) GROUP BY id)
SELECT topic, count(*) AS total, count(*) FILTER (n > 0) AS covered FROM points LEFT JOIN c USING (id) GROUP BY topic""",
    base=True,
)
def topic_coverage(spark, d):
    return facets.topic_coverage(items(spark, d), points(spark, d))


@query(
    """SELECT point, count(*) FILTER (difficulty = '简单题') AS n0, count(*) FILTER (difficulty = '中档题') AS n1, count(*) FILTER (difficulty = '难题') AS n2, count(*) AS n
FROM (SELECT unnest(points) AS point, difficulty FROM full_items) GROUP BY point""",
    base=True,
)
def point_difficulty_matrix(spark, d):
    return facets.matrix(full(spark, d), model.DIFFICULTIES)


@query("SELECT p.topic, count(DISTINCT key) AS n FROM (SELECT key, unnest(points) AS id FROM items) JOIN points p USING (id) GROUP BY p.topic", base=True)
def topic_distinct(spark, d):
    return facets.topic_items(items(spark, d), points(spark, d))


@query("SELECT text, lang, count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return facets.repeated(read(spark, d, "documents"), ["text", "lang"])


@query(
    """SELECT l_partkey % 5 AS topic, count(DISTINCT l_orderkey) AS orders, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1"""
)
def topic_orders(spark, d):
    l = read(spark, d, "lineitem").filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp"))
    return l.groupBy((F.col("l_partkey") % 5).alias("topic")).agg(
        F.countDistinct("l_orderkey").alias("orders"), F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


@query("SELECT id FROM points ORDER BY CAST(split_part(id, '.', 1) AS INT), CAST(split_part(id, '.', 2) AS INT), CAST(split_part(id, '.', 3) AS INT) LIMIT 12", base=True)
def dotted_order(spark, d):
    return points(spark, d).orderBy(facets.dotted(F.col("id"))).limit(12).select("id")


# --- joins and history ----------------------------------------------------------


@query("SELECT key, coalesce(n, 0) AS used FROM items LEFT JOIN (SELECT 'q' || (user_id % 500) AS key, count(*) AS n FROM events GROUP BY 1) USING (key)", base=True)
def usage_join(spark, d):
    usage = read(spark, d, "events").groupBy(F.concat(F.lit("q"), (F.col("user_id") % 500).cast("string")).alias("key")).agg(F.count("*").alias("n"))
    return items(spark, d).join(usage, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("used"))


@query("SELECT key, dup_of FROM items WHERE dup_of <> '' AND dup_of NOT IN (SELECT key FROM items)", base=True)
def dangling_reference(spark, d):
    from quarry.operators.quality import dangling

    return dangling(items(spark, d), "dup_of").select("key", "dup_of")


@query("SELECT a.key, b.key AS other FROM items a JOIN items b ON a.dup_of = b.key WHERE a.answer <> b.answer", base=True)
def answers_differ(spark, d):
    a = items(spark, d)
    b = a.select(F.col("key").alias("other"), F.col("answer").alias("_b"))
    return a.join(b, a["dup_of"] == b["other"]).filter(F.col("answer") != F.col("_b")).select("key", "other")


_SNAP = """WITH b AS (SELECT 'q' || doc_id AS key, sha256(text) AS hash, '' AS solved, '' AS edited FROM documents WHERE doc_id % 10 <> 1),
a AS (SELECT 'q' || doc_id AS key, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash, CASE WHEN doc_id % 14 = 0 THEN 't' ELSE '' END AS solved, CASE WHEN doc_id % 21 = 0 THEN 't' ELSE '' END AS edited FROM documents WHERE doc_id % 10 <> 2),
t AS (SELECT 'q' || doc_id AS key FROM documents WHERE doc_id % 20 = 2)
SELECT key, change FROM (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN CASE WHEN coalesce(a.key, b.key) IN (SELECT key FROM t) THEN 'trashed' ELSE 'removed' END
  WHEN a.hash <> b.hash THEN CASE WHEN a.solved <> '' THEN 'solved' WHEN a.edited <> '' THEN 'edited' ELSE 'changed' END END AS change FROM a FULL JOIN b ON a.key = b.key) WHERE change IS NOT NULL"""


@query(_SNAP)
def snapshot_diff(spark, d):
    docs, k = read(spark, d, "documents"), F.col("doc_id")
    key = F.concat(F.lit("q"), k.cast("string")).alias("key")
    none = [F.lit("").alias(c) for c in ("upgraded", "migrated", "fixed")]
    before = docs.filter(k % 10 != 1).select(key, F.sha2("text", 256).alias("hash"), F.lit("").alias("solved"), F.lit("").alias("edited"), *none)
    text = F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stamp = lambda m, c: F.when(k % m == 0, "t").otherwise("").alias(c)
    after = docs.filter(k % 10 != 2).select(key, F.sha2(text, 256).alias("hash"), stamp(14, "solved"), stamp(21, "edited"), *none)
    return history.changes(before, after, docs.filter(k % 20 == 2).select(key))


@query(
    """WITH RECURSIVE l AS (SELECT 'k' || doc_id AS old, 'k' || (doc_id + 1) AS new FROM documents WHERE doc_id % 5 <> 4),
r AS (SELECT old, new FROM l UNION ALL SELECT r.old, l.new FROM r JOIN l ON r.new = l.old) SELECT old, max_by(new, CAST(substr(new, 2) AS BIGINT)) AS new FROM r GROUP BY old"""
)
def rename_chain(spark, d):
    k = F.col("doc_id")
    ledger = read(spark, d, "documents").filter(k % 5 != 4).select(F.concat(F.lit("k"), k.cast("string")).alias("old"), F.concat(F.lit("k"), (k + 1).cast("string")).alias("new"))
    return history.final_names(ledger)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_order_wins(spark, d):
    return history.first_of(read(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, min(event_id) AS first_seq, max(event_id) AS last_seq, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins_first_place(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_id").alias("last_seq"), "value")
    return history.last_wins(e).select(F.col("key").alias("user_id"), F.col("seq").alias("first_seq"), "last_seq", "value")


_PAIR = """, o AS (SELECT key, CASE WHEN seq % 3 = 0 THEN '' ELSE answer END AS answer, CASE WHEN seq % 2 = 0 THEN '' ELSE solution END AS solution, CASE WHEN seq % 4 = 0 THEN '' ELSE difficulty END AS difficulty, points[1:1] AS points FROM full_items),
n AS (SELECT key, CASE WHEN seq % 5 = 0 THEN '' ELSE answer || '!' END AS answer, solution, difficulty, points FROM full_items WHERE seq % 2 = 0)
"""


def _halves(spark, d):
    f = full(spark, d)
    without = lambda m, c: F.when(F.col("seq") % m == 0, "").otherwise(F.col(c)).alias(c)
    old = f.select("key", without(3, "answer"), without(2, "solution"), without(4, "difficulty"), F.slice("points", 1, 1).alias("points"), "stars")
    new = f.filter("seq % 2 = 0").select("key", F.when(F.col("seq") % 5 == 0, "").otherwise(F.concat("answer", F.lit("!"))).alias("answer"), "solution", "difficulty", "points")
    return old, new


@query(
    _PAIR
    + """SELECT o.key, CASE WHEN trim(coalesce(n.answer, '')) <> '' AND trim(n.answer) <> trim(o.answer) THEN n.answer ELSE o.answer END AS answer,
  CASE WHEN n.key IS NOT NULL AND trim(n.solution) NOT IN ('', '无', '解析无', '解析无。') AND trim(o.solution) IN ('', '无', '解析无', '解析无。') THEN n.solution ELSE o.solution END AS solution,
  CASE WHEN trim(coalesce(n.difficulty, '')) <> '' AND trim(o.difficulty) = '' THEN n.difficulty ELSE o.difficulty END AS difficulty,
  CASE WHEN len(n.points) > len(o.points) THEN array_to_string(n.points, ',') ELSE array_to_string(o.points, ',') END AS points
FROM o LEFT JOIN n ON o.key = n.key""",
    base=True,
)
def merge_upgrade_only(spark, d):
    return merge.upgrade(*_halves(spark, d)).select("key", "answer", "solution", "difficulty", F.array_join("points", ",").alias("points"))


@query(
    """, o AS (SELECT key, seq, CASE WHEN seq % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE points END AS points, CASE WHEN seq % 2 = 0 THEN '' ELSE difficulty END AS difficulty, stars FROM full_items)
SELECT o.key, array_to_string(CASE WHEN len(o.points) = 0 AND len(f.points) > 0 THEN f.points ELSE o.points END, ',') AS points,
  CASE WHEN len(o.points) = 0 AND trim(o.difficulty) = '' AND trim(f.difficulty) <> '' THEN trim(f.difficulty) ELSE o.difficulty END AS difficulty,
  CAST(CASE WHEN len(o.points) = 0 AND trim(o.difficulty) = '' AND trim(f.difficulty) <> '' THEN CASE trim(f.difficulty) WHEN '简单题' THEN 1 WHEN '中档题' THEN 2 WHEN '难题' THEN 3 ELSE 0 END ELSE o.stars END AS INTEGER) AS stars
FROM o LEFT JOIN full_items f ON f.key = o.key""",
    base=True,
)
def backfill_empty(spark, d):
    f = full(spark, d)
    bare = F.when(F.col("seq") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("points"))
    old = f.select("key", bare.alias("points"), F.when(F.col("seq") % 2 == 0, "").otherwise(F.col("difficulty")).alias("difficulty"), "stars")
    return merge.backfill(old, f.select("key", "points", "difficulty")).select("key", F.array_join("points", ",").alias("points"), "difficulty", "stars")


@query(
    """WITH b AS (SELECT doc_id AS seq, 'q' || doc_id AS key, sha256(text) AS fp FROM documents WHERE doc_id % 2 = 0), l AS (SELECT CASE WHEN doc_id % 50 = 1 THEN 'q' || (doc_id + 1) ELSE 'q' || doc_id END AS key, sha256(text) AS fp FROM documents WHERE doc_id % 2 = 1),
w AS (SELECT seq, 'key' AS why FROM b WHERE key IN (SELECT key FROM l) UNION SELECT seq, 'text' FROM b WHERE fp IN (SELECT fp FROM l) UNION SELECT seq, 'batch' FROM (SELECT seq, row_number() OVER (PARTITION BY fp ORDER BY seq) AS n FROM b) WHERE n > 1)
SELECT seq, string_agg(why, ',' ORDER BY why) AS why FROM w GROUP BY seq"""
)
def exact_dup_fingerprint(spark, d):
    docs, k = read(spark, d, "documents"), F.col("doc_id")
    name = lambda n: F.concat(F.lit("q"), n.cast("string"))
    fp = F.sha2("text", 256).alias("fingerprint")
    batch = docs.filter(k % 2 == 0).select(k.alias("seq"), name(k).alias("key"), fp)
    library = docs.filter(k % 2 == 1).select(F.when(k % 50 == 1, name(k + 1)).otherwise(name(k)).alias("key"), fp)
    return merge.exact_duplicates(batch, library)


@query("""SELECT doc_id, left(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(1) || trim(lang)), 16) AS hash FROM documents""")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", similarity.content_hash("text", "lang").alias("hash"))


@query(
    """WITH u AS (SELECT 'q' || (user_id % 50) AS key, count(*) AS n FROM events GROUP BY 1) SELECT CASE WHEN CAST(substr(key, 2) AS INT) % 10 = 3 THEN 'q0' ELSE key END AS key, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1"""
)
def renamed_usage(spark, d):
    usage = read(spark, d, "events").groupBy(F.concat(F.lit("q"), (F.col("user_id") % 50).cast("string")).alias("key")).agg(F.count("*").alias("n"))
    names = spark.range(50).filter("id % 10 = 3").select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("old"), F.lit("q0").alias("new"))
    return merge.renamed_usage(usage, names)


@query(
    """WITH b AS (SELECT doc_id AS seq, source AS book, lang AS label FROM documents WHERE doc_id % 2 = 0),
e AS (SELECT DISTINCT source || '/' || lang AS p, doc_id % 400 AS u FROM documents WHERE doc_id % 2 = 1),
r AS (SELECT *, book || '/' || label AS p, row_number() OVER (PARTITION BY book, label ORDER BY seq) AS n FROM b),
c AS (SELECT p, u, u - row_number() OVER (PARTITION BY p ORDER BY u) AS free FROM e)
SELECT seq, r.p || '#' || (n + (SELECT count(*) FROM c WHERE c.p = r.p AND c.free < n)) AS key FROM r"""
)
def next_free_keys(spark, d):
    """The even documents as a batch, the odd ones' numbers in use."""
    docs = read(spark, d, "documents")
    batch = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("seq"), F.col("source").alias("book"), F.col("lang").alias("label"))
    have = docs.filter("doc_id % 2 = 1").select(F.concat("source", F.lit("/"), "lang", F.lit("#"), (F.col("doc_id") % 400).cast("string")).alias("key"))
    return merge.free_keys(batch, have).select("seq", "key")


# --- windows ---------------------------------------------------------------------


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text) AS section FROM conversations")
def asof_section(spark, d):
    c = read(spark, d, "conversations")
    return windows.last_anchor(c, ["conv_id"], ["turn", "text"], F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


@query(
    """WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, 1000) AS range_end FROM c"""
)
def lead_ranges(spark, d):
    c = read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn").distinct()
    return windows.ends_from_next(c, ["conv_id"], "turn", F.lit(1000).cast("bigint"))


@query(
    """SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR value > m"""
)
def running_maximum(spark, d):
    return windows.increasing(read(spark, d, "events"), ["user_id"], ["event_id"], "value").select("user_id", "event_id", "value")


@query(
    """WITH m AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM events)
SELECT event_id, coalesce(max(CASE WHEN value <= mx / 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) = 1, false) AS flag FROM m"""
)
def sticky_flag(spark, d):
    return windows.sticky(read(spark, d, "events"), ["user_id"], ["event_id"], "value", F.col("value") <= F.col("_max") / 10).select("event_id", "flag")


@query(
    """WITH c AS (SELECT *, lag(text) OVER (PARTITION BY role ORDER BY conv_id, turn, text) AS p FROM conversations)
SELECT conv_id, turn, text, coalesce(length(left(text, 8)) > 0 AND (starts_with(p, left(text, 8)) OR contains(right(p, 32), left(text, 8))), false) AS like_previous FROM c"""
)
def previous_row_compare(spark, d):
    return windows.starts_like_previous(read(spark, d, "conversations"), ["role"], ["conv_id", "turn", "text"], "text", 8).select("conv_id", "turn", "text", "like_previous")


@query(
    """WITH r AS (SELECT doc_id, (doc_id * 37) % 9000 AS s, (doc_id * 37) % 9000 + 40 AS e FROM documents) SELECT doc_id, count(*) AS n, round(sum(value), 4) AS total FROM r JOIN events ON event_id BETWEEN s AND e GROUP BY doc_id"""
)
def range_pages(spark, d):
    k = F.col("doc_id")
    r = read(spark, d, "documents").select(k, ((k * 37) % 9000).alias("s"), ((k * 37) % 9000 + 40).alias("e"))
    hit = windows.covered(r, read(spark, d, "events").select("event_id", "value"), "s", "e", "event_id", 64)
    return hit.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT lang, doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 100 AS BIGINT) AS chunk FROM documents")
def batch_chunks(spark, d):
    return windows.chunks(read(spark, d, "documents"), ["doc_id"], 100, ["lang"]).select("lang", "doc_id", "chunk")


@query(
    """WITH x AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t FROM lineitem), m AS (SELECT *, min(t) OVER (PARTITION BY l_orderkey) AS lo FROM x)
SELECT l_orderkey, min(t) AS tier, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_extendedprice DESC, l_linenumber) AS lines FROM m WHERE t = lo GROUP BY l_orderkey"""
)
def best_tier(spark, d):
    l = read(spark, d, "lineitem").withColumn("tier", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    l = l.withColumn("line", F.col("l_linenumber").cast("string"))
    out = windows.best_tier(l, ["l_orderkey"], "tier", [F.desc("l_extendedprice"), "l_linenumber"], "line")
    return out.select("l_orderkey", "tier", F.array_join("ordered", ",").alias("lines"))


@query(
    """, a AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY key) AS n FROM full_items WHERE figure_low_res QUALIFY n <= 3), b AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY key) AS n FROM full_items WHERE duplicate_group IS NOT NULL AND key NOT IN (SELECT key FROM a) QUALIFY n <= 4),
c AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY key) AS n FROM full_items WHERE solved AND key NOT IN (SELECT key FROM a UNION SELECT key FROM b) QUALIFY n <= 5)
SELECT type, key, 'lowres' AS feature FROM a UNION ALL SELECT type, key, 'dup' FROM b UNION ALL SELECT type, key, 'solved' FROM c""",
    base=True,
)
def stratified_caps(spark, d):
    f = full(spark, d)
    out = windows.stratified(f, ["type"], {"lowres": 3, "dup": 4, "solved": 5}, {"lowres": F.col("figure_low_res"), "dup": F.col("duplicate_group").isNotNull(), "solved": F.col("solved")}, ["key"])
    return out.select("type", "key", "feature")


# --- similarity -------------------------------------------------------------------

_BI = "[substr({0}, i, 2) for i in range(1, length({0}))]"


@query(
    f"""WITH p AS (SELECT a.item_id AS x, b.item_id AS y, a.text AS s, b.text AS t FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id + 1),
u AS (SELECT x, y, g, count(*) AS n FROM (SELECT x, y, unnest({_BI.format("s")}) AS g FROM p) GROUP BY ALL), v AS (SELECT x, y, g, count(*) AS n FROM (SELECT x, y, unnest({_BI.format("t")}) AS g FROM p) GROUP BY ALL),
c AS (SELECT x, y, sum(least(u.n, v.n)) AS k FROM u JOIN v USING (x, y, g) GROUP BY x, y)
SELECT x, y, round(2 * coalesce(k, 0) / (length(s) + length(t) - 2), 6)::DOUBLE AS dice FROM p LEFT JOIN c USING (x, y)"""
)
def dice_bigram(spark, d):
    b = read(spark, d, "benchmark")
    pairs = b.select(F.col("item_id").alias("x"), F.col("text").alias("s")).join(b.select((F.col("item_id") + 1).alias("x"), F.col("item_id").alias("y"), F.col("text").alias("t")), "x")
    return similarity.dice(pairs, "s", "t", ["x", "y"]).select("x", "y", F.round("dice", 6).alias("dice"))


_W = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(
    f"""WITH b AS (SELECT item_id, list_distinct({_W}) AS w FROM benchmark) SELECT a.item_id AS x, b.item_id AS y, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6)::DOUBLE AS overlap
FROM b a JOIN b ON a.item_id = b.item_id + 1"""
)
def token_overlap(spark, d):
    b = read(spark, d, "benchmark").select("item_id", search.tokens(F.col("text")).alias("w"))
    pairs = b.select(F.col("item_id").alias("x"), F.col("w").alias("s")).join(b.select((F.col("item_id") + 1).alias("x"), F.col("item_id").alias("y"), F.col("w").alias("t")), "x")
    return pairs.select("x", "y", F.round(similarity.overlap(F.col("s"), F.col("t")), 6).alias("overlap"))


@query(
    f"""WITH v AS (SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), 'the', '大于等于'), 'tion', '单调递增'), ' de ', 'A\\subseteq B'), 'ing', '至少一个正数') AS s FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(s, '{similarity.CRITICAL}'))), ',') AS tokens FROM v"""
)
def critical_tokens(spark, d):
    s = F.coalesce("text", F.lit(""))
    for part, words in {"the": "大于等于", "tion": "单调递增", " de ": "A\\subseteq B", "ing": "至少一个正数"}.items():
        s = F.replace(s, F.lit(part), F.lit(words))
    v = read(spark, d, "documents").select("doc_id", s.alias("s"))
    return v.select("doc_id", F.array_join(similarity.critical_tokens(F.col("s")), ",").alias("tokens"))


#: Searches ask for every document whose id is divisible by this, against all documents.
EVERY = 50


def _asked(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents")
    keyed = lambda rows: rows.select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("key"), similarity.normalised(F.col("text")).alias("norm"))
    return keyed(docs.filter(F.col("doc_id") % EVERY == 0)), keyed(docs)


@query()
def near_duplicate_items(spark, d):
    """Every EVERY-th document against all; the ratio has no SQL form."""
    return near.near(*_asked(spark, d))


@query()
def whole_item_duplicates(spark, d):
    """Of the same documents those that a more than 0.95 similar one keeps out of the library."""
    return near.same_items(*_asked(spark, d))


@query(
    r"""SELECT count(*) AS total, count(*) FILTER (n <> '') AS indexed, count(*) FILTER (n = '') AS skipped, round(count(*) FILTER (n <> '') / count(*), 4) AS coverage, count(*) FILTER (n = '') = 0 AS ready,
  array_to_string(coalesce((array_agg(doc_id ORDER BY doc_id) FILTER (n = ''))[1:3], []), ',') AS first_skipped
FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '%[^\n]*', '', 'g'), '[\s${}，。、；：？！,.;:?!（）()]', '', 'g') AS n FROM documents)"""
)
def near_index_status(spark, d):
    found = near.index_status(read(spark, d, "documents"), "doc_id", similarity.normalised(F.col("text")))
    return found.withColumn("first_skipped", F.array_join(F.col("first_skipped").cast("array<string>"), ","))


# --- selection ---------------------------------------------------------------------


@query(
    """, o AS (SELECT key, ['single_choice', 'multi_choice', 'fill_in_blank', 'detailed_answer'][1 + CAST(seq % 4 AS INT)] AS kind, difficulty, seq FROM full_items),
i AS (SELECT *, row_number() OVER (PARTITION BY kind, seq // 40 ORDER BY seq) - 1 AS idx FROM o)
SELECT key, CAST(CASE kind WHEN 'single_choice' THEN 5 WHEN 'multi_choice' THEN 6 WHEN 'fill_in_blank' THEN 5 ELSE coalesce([13, 15, 15, 17, 17][idx + 1], 15) END AS INTEGER) AS score,
  CAST(CASE kind WHEN 'single_choice' THEN CASE difficulty WHEN '简单题' THEN 3 WHEN '难题' THEN 5 ELSE 4 END WHEN 'detailed_answer' THEN CASE difficulty WHEN '简单题' THEN 10 WHEN '难题' THEN 15 ELSE 12 END
    ELSE CASE difficulty WHEN '简单题' THEN 4 WHEN '难题' THEN 6 ELSE 5 END END AS INTEGER) AS minutes
FROM i""",
    base=True,
)
def score_and_minutes(spark, d):
    kinds = F.array(*(F.lit(t) for t, _ in selection.MIX))
    o = full(spark, d).select("key", F.get(kinds, (F.col("seq") % 4).cast("int")).alias("t"), "difficulty", "seq", F.floor(F.col("seq") / 40).alias("g"))
    i = windows.place_in_group(o, ["t", "g"], ["seq"])
    return i.select("key", selection.score(F.col("t"), F.col("index")).cast("int").alias("score"), selection.minutes(F.col("t"), F.col("difficulty")).cast("int").alias("minutes"))


@query(
    """WITH i AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders),
p AS (SELECT *, CASE WHEN total < 8 THEN greatest(1, CAST(round_even(3 * total / 8, 0) AS INT)) ELSE 3 END AS e0, CASE WHEN total < 8 THEN greatest(1, CAST(round_even(2 * total / 8, 0) AS INT)) ELSE 2 END AS h FROM i),
q AS (SELECT *, CASE WHEN total >= 3 AND e0 + h > total - 1 THEN greatest(0, total - 1 - h) ELSE e0 END AS e FROM p)
SELECT o_orderkey, total, idx AS place, CASE WHEN idx < e THEN '简单题' WHEN idx >= total - h THEN '难题' ELSE '中档题' END AS difficulty FROM q"""
)
def position_difficulty(spark, d):
    """A customer's orders as the items of a paper."""
    orders = windows.place_in_group(read(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"])
    t = orders.withColumn("place", F.col("index").cast("bigint"))
    return t.select("o_orderkey", "total", "place", selection.place_difficulty(F.lit("single_choice"), F.col("place"), F.col("total")).alias("difficulty"))


@query()
def cover_plan(spark, d):
    """Greedy set cover of points; its steps depend on each other."""
    plan = selection.cover(full(spark, d).filter("difficulty <> ''"), 12, must={"1.0.0", "1.3.3"}, mix={"en": 6, "fr": 2})
    return spark.createDataFrame([(i, k) for i, k in enumerate(plan["keys"])], "place int, key string")


@query()
def compose_paper(spark, d):
    kinds = F.array(*(F.lit(t) for t, _ in selection.MIX))
    pool = predicates.selection_pool(full(spark, d)).withColumn("type", F.get(kinds, (F.col("seq") % 4).cast("int")))
    topics = {f"topic {i}": 5 for i in range(5)} | {"": 3}
    return selection.fill(pool, selection.slots(spark), topics, point_quota=3, seed=7)
