"""Queries over queues, reports and semantic rules, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import documents, postings, quality, queues, search, semantics
from quarry.operators.model import read
from quarry.plans.catalog import full, query
from quarry.plans.catalog_texts import _TYPED, _typed

_RANK = "CASE difficulty WHEN '简单题' THEN 0 WHEN '中档题' THEN 1 WHEN '难题' THEN 2 ELSE 9 END"


def _attempted(spark, d):
    return full(spark, d).withColumn("attempts", F.when(F.col("seq") % 3 == 0, F.col("seq") % 5))


@query(f"SELECT key, {_RANK} AS rank FROM full_items WHERE NOT solved AND trim(answer) <> '' AND kind = '模拟'", base=True)
def queue_export(spark, d):
    """Mock items with an answer and no solution."""
    rows = queues.to_export(full(spark, d), "solution", kind="模拟")
    return rows.select("key", queues.difficulty_rank(F.col("difficulty")).cast("int").alias("rank"))


@query("SELECT key FROM full_items WHERE NOT solved AND trim(answer) <> '' ORDER BY " + _RANK + ", key LIMIT 25 OFFSET 5", base=True)
def queue_export_page(spark, d):
    return queues.to_export(full(spark, d), "solution", limit=25, offset=5).select("key")


@query("SELECT key FROM full_items WHERE kind = '模拟' AND NOT solved AND coalesce(CASE WHEN seq % 3 = 0 THEN seq % 5 END, 0) < 3 AND difficulty IN ('简单题', '难题')", base=True)
def queue_solve(spark, d):
    return queues.to_solve(_attempted(spark, d), "简单题, 难题").select("key")


@query("SELECT key, seq FROM full_items WHERE (trim(answer) = '' OR NOT solved) AND seq <= coalesce((SELECT max(seq) FROM full_items WHERE key = 'q150' AND (trim(answer) = '' OR NOT solved)), seq)", base=True)
def queue_audit(spark, d):
    return queues.to_audit(full(spark, d), "q150", only_missing=True).select("key", "seq")


@query("SELECT key FROM full_items", base=True)
def queue_audit_without_cursor(spark, d):
    """A cursor that is gone: the whole queue."""
    return queues.to_audit(full(spark, d), "no such key").select("key")


@query(
    _TYPED.replace("AS n_options,", "AS n_options, solved,")
    + """SELECT key, 'ans' AS what FROM y WHERE solved AND trim(answer) = '' AND type <> 'detailed_answer' AND coalesce(CASE WHEN seq % 3 = 0 THEN seq % 5 END, 0) < 3
UNION ALL SELECT key, 'sol' FROM y WHERE NOT solved AND trim(answer) <> '' AND coalesce(CASE WHEN seq % 3 = 0 THEN seq % 5 END, 0) < 3""",
    base=True,
)
def queue_fill(spark, d):
    rows = _typed(spark, d).withColumn("attempts", F.when(F.col("seq") % 3 == 0, F.col("seq") % 5))
    return queues.to_fill(rows, "ans").select("key", F.lit("ans").alias("what")).unionByName(queues.to_fill(rows, "sol").select("key", F.lit("sol").alias("what")))


@query(r"SELECT doc_id, doc_id % 5 = 0 OR contains(text, 'tikzpicture') OR contains(text, '\begin{axis}') AS risky FROM documents")
def compile_risk(spark, d):
    figures = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    return read(spark, d, "documents").select("doc_id", queues.may_not_compile(F.col("text"), figures).alias("risky"))


@query("SELECT source_label, count(*) AS n FROM full_items WHERE contains(lower(source_label), 'r') GROUP BY 1 ORDER BY n DESC, source_label LIMIT 40", base=True)
def source_suggestions(spark, d):
    return queues.source_suggestions(full(spark, d), "R")


@query("SELECT CASE WHEN trim(coalesce(difficulty, '')) = '' THEN '未定' ELSE difficulty END AS difficulty, count(*) AS n FROM full_items GROUP BY 1", base=True)
def export_mix(spark, d):
    return queues.mix_by_difficulty(full(spark, d))


@query("SELECT conv_id, 2 * count(*) FILTER (role = 'assistant') > count(*) AS most FROM conversations GROUP BY 1")
def majority_vote(spark, d):
    return queues.majority(read(spark, d, "conversations"), "conv_id", F.col("role") == "assistant")


@query(
    """SELECT doc_id, list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x)))[1:3] AS mine, list_sort(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x)))[1:3] AS theirs
FROM (SELECT doc_id, string_split(source, '') AS a, string_split(lang, '') AS b FROM documents)"""
)
def token_differences(spark, d):
    mine, theirs = queues.token_difference(F.split("source", ""), F.split("lang", ""))
    return read(spark, d, "documents").select("doc_id", mine.alias("mine"), theirs.alias("theirs"))


@query("SELECT DISTINCT unnest(points) AS id FROM full_items EXCEPT SELECT unnest(points) FROM full_items WHERE seq % 7 = 0", base=True)
def uncovered_points(spark, d):
    rows = full(spark, d)
    return queues.uncovered(rows, rows.filter("seq % 7 = 0"))


@query("SELECT key, CASE WHEN seq % 4 = 0 THEN 'new' ELSE answer END AS answer FROM full_items UNION ALL SELECT 'n' || key, 'new' FROM full_items WHERE seq % 4 = 1", base=True)
def upserted_rows(spark, d):
    rows = full(spark, d).select("key", "seq", "answer")
    batch = rows.filter("seq % 4 < 2").select(F.when(F.col("seq") % 4 == 1, F.concat(F.lit("n"), "key")).otherwise(F.col("key")).alias("key"), "seq", F.lit("new").alias("answer"))
    return queues.upserted(rows, batch).select("key", "answer")


@query("SELECT (doc_id) // 500 AS volume, count(*) AS items, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def volume_sizes(spark, d):
    rows = read(spark, d, "documents").select((F.col("doc_id") + 1).alias("seq"), F.coalesce("text", F.lit("")).alias("stem"))
    return queues.volume_sizes(rows, 500)


@query("SELECT count(*) AS total, count(*) FILTER (length(text) >= 30) AS indexed, count(*) FILTER (coalesce(length(text) < 30, true)) AS skipped FROM documents")
def index_coverage(spark, d):
    return queues.index_coverage(read(spark, d, "documents"), F.col("text"), 30)


_DIMENSIONS = ["type", "kind", "difficulty", "year", "book", "topic", "origin", "stars", "point_source", "answer_source", "region_scope"]
_FLAGS = {"solved": "solved", "answered": "trim(answer) <> ''", "reviewed": "trim(coalesce(reviewed_at, '')) <> ''", "duplicate": "duplicate_group IS NOT NULL", "low_res": "figure_low_res"}


@query(
    " UNION ALL ".join(
        [f"SELECT '{c}' AS what, coalesce(CAST({c} AS VARCHAR), '') AS value, count(*) AS n FROM full_items GROUP BY ALL" for c in _DIMENSIONS]
        + [f"SELECT '{k}', 'yes', count(*) FROM full_items WHERE {v} HAVING count(*) > 0" for k, v in _FLAGS.items()]
    ),
    base=True,
)
def statistics_in_one_pass(spark, d):
    return queues.statistics(full(spark, d), _DIMENSIONS, {k: F.expr(v) for k, v in _FLAGS.items()})


@query("SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE left(s, 60) || '…' END AS line, CAST(floor(length(text) * 0.65::DOUBLE) AS INTEGER) + 200 AS tokens FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS s FROM documents)")
def lines_and_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.one_line(F.col("text"), 60).alias("line"), tx.estimated_tokens(F.col("text")).alias("tokens"))


@query(
    r"""SELECT item_id, a <> '' AND b <> '' AND a <> b AND regexp_matches(a, '^[A-F]+$') = regexp_matches(b, '^[A-F]+$') AND NOT contains(a, '见解析') AND NOT contains(b, '见解析') AS conflict
FROM (SELECT item_id, translate(regexp_replace(text, '[\s$]', '', 'g'), '（），、；：。', '(),,;:.') AS a, CASE WHEN item_id % 3 = 0 THEN a WHEN item_id % 3 = 1 THEN regexp_replace(a, '[.,]', '', 'g') ELSE 'AB' END AS b FROM benchmark)"""
)
def answer_conflicts(spark, d):
    """An item's text against itself in full-width punctuation, without some of it, or against option letters."""
    third = F.col("item_id").cast("int") % 3
    other = F.when(third == 0, F.translate("text", "(),;:.", "（），；：。")).when(third == 1, F.regexp_replace("text", "[.,]", "")).otherwise("AB")
    return read(spark, d, "benchmark").select("item_id", tx.answers_conflict(F.col("text"), other).alias("conflict"))


@query(
    _TYPED.replace("AS n_options,", "AS n_options, stars, region,")
    + r"""SELECT key, 'meta_stars_zero' AS rule, 'P3' AS level FROM y WHERE stars = 0 UNION ALL SELECT key, 'answer_has_score', 'P2' FROM y WHERE regexp_matches(answer, '[0-9]+\s*分') AND type <> 'detailed_answer'
UNION ALL SELECT key, 'sol_worker_note', 'P1' FROM y WHERE regexp_matches(solution, 'OCR')""",
    base=True,
)
def semantic_metadata(spark, d):
    return semantics.scanned(_semantic(spark, d), ["meta_stars_zero", "answer_has_score", "sol_worker_note"])


def _semantic(spark, d):
    more = full(spark, d).select("key", "stars", "region")
    return _typed(spark, d).join(more, "key")


@query()
def semantic_rules(spark, d):
    """Every rule over every item; tests check each by hand."""
    return semantics.scanned(_semantic(spark, d))


@query(
    r"""WITH n AS (SELECT DISTINCT regexp_extract(url, '://(?:www[.]|m[.]|blog[.])?([^./]+)', 1) AS name, regexp_extract(url, '[.]example[.]([a-z]+)', 1) AS province FROM pages)
SELECT page_id AS key, region, list_sort(list(DISTINCT province)) AS provinces FROM (SELECT page_id, ['com', 'net', 'org'][1 + CAST(page_id % 3 AS INT)] AS region, url FROM pages) JOIN n ON name <> '' AND contains(url, name)
GROUP BY page_id, region HAVING NOT list_contains(list(DISTINCT province), region)"""
)
def region_against_label(spark, d):
    """Addresses as labels, the names of their hosts as the gazetteer: every name inside an address counts."""
    pages = read(spark, d, "pages")
    names = pages.select(F.regexp_extract("url", "://(?:www[.]|m[.]|blog[.])?([^./]+)", 1).alias("name"), F.regexp_extract("url", "[.]example[.]([a-z]+)", 1).alias("province")).distinct()
    regions = F.array(*map(F.lit, ["com", "net", "org"]))
    items = pages.select(F.col("page_id").alias("key"), F.get(regions, (F.col("page_id") % 3).cast("int")).alias("region"), F.col("url").alias("source_label"))
    return semantics.region_vs_label(items, names, None)


@query("SELECT rule, count(*) AS n FROM (SELECT CASE WHEN (length(text) - length(replace(text, '$', ''))) % 2 = 1 THEN 'dollar' END AS rule FROM documents UNION ALL SELECT CASE WHEN contains(text, '$$') THEN 'double_dollar' END FROM documents UNION ALL SELECT CASE WHEN contains(text, '%') THEN 'comment' END FROM documents) WHERE rule IS NOT NULL GROUP BY 1")
def violation_counts(spark, d):
    return quality.violations(read(spark, d, "documents"), "doc_id", quality.conformance("text")).groupBy("rule").agg(F.count("*").alias("n"))



_SEARCHABLE = r"""' ' || array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce(text, ''), '\\[A-Za-z]+', ' ', 'g'), '([\x{3400}-\x{9fff}])', ' \1 ', 'g')), '[^\p{L}\p{N}]+'), lambda w: w <> ''), '  ') || ' '"""
_PHRASE = search.phrases("of_the and")


@query(
    f"""WITH t AS (SELECT doc_id AS key, {_SEARCHABLE} AS s FROM documents),
c AS (SELECT key, len(list_filter(string_split(s, ' '), lambda x: x <> '')) AS n, (length(s) - length(replace(s, '{_PHRASE[0]}', ''))) // {len(_PHRASE[0])} AS a, (length(s) - length(replace(s, '{_PHRASE[1]}', ''))) // {len(_PHRASE[1])} AS b FROM t),
s AS (SELECT count(*) AS n, avg(n) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT key, round(greatest(ln((s.n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * c.n / av)) + greatest(ln((s.n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * c.n / av)), 6) AS score
FROM c, s WHERE a > 0 AND b > 0"""
)
def phrase_search(spark, d):
    """From the stored index, which the first search of these files builds."""
    at = postings.index(spark, [f"{d}/documents.parquet"], read(spark, d, "documents").select("doc_id", "text"), "doc_id", search.words(F.col("text")), "words")
    found = postings.search_phrases(spark, at, "of_the and")
    return found.select("key", F.round("score", 6).alias("score"))


@query(
    _TYPED
    + """SELECT key, 'answer_place' AS rule FROM y WHERE trim(answer) <> '' AND type <> 'detailed_answer' UNION ALL SELECT key, 'blanks' FROM y WHERE type = 'fill_in_blank'""",
    base=True,
)
def item_conformance(spark, d):
    """Rules on formulas and places for answers; tests check each by hand."""
    return quality.violations(_typed(spark, d), "key", quality.item_conformance()).select("key", "rule")


@query(
    r"""WITH l AS (SELECT conv_id, turn, role, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
m AS (SELECT *, len(regexp_extract_all(line, '(^|[^A-Za-z0-9])[ABCD]\s*[.．、]')) AS n, regexp_replace(line, '(^|[^A-Za-z0-9])[ABCD]\s*[.．、].*$', '\1') AS head FROM l),
k AS (SELECT conv_id, turn, role, text, string_agg(CASE WHEN n >= 2 THEN nullif(trim(head), '') WHEN n = 1 AND length(head) <= 2 THEN NULL ELSE line END, chr(10) ORDER BY i) AS stem FROM m GROUP BY ALL),
c AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT c.conv_id, c.turn, c.role, regexp_replace(coalesce(stem, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS stem, ['Aone', 'Btwo', 'C' || c.role] AS options, CASE WHEN c.turn % 2 = 0 THEN 'multi_choice' ELSE 'single_choice' END AS type
FROM c JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn AND k.role = c.role AND k.text IS NOT DISTINCT FROM c.text"""
)
def split_and_typed(spark, d):
    """Turns with options put below them, split and typed again; a line of a turn that begins like an option is one, which the options below replace."""
    c = read(spark, d, "conversations")
    block = F.concat(F.coalesce("text", F.lit("")), F.lit("\nA. one  B．two\nC、 "), F.col("role"))
    rows = c.select("conv_id", "turn", "role", documents.split_options(block).alias("x"))
    kind = documents.classify_type(F.col("x.stem"), F.col("x.options"), F.when(F.col("turn") % 2 == 0, "AC").otherwise("B"))
    return rows.select("conv_id", "turn", "role", "x.stem", F.transform("x.options", lambda o: F.concat(o["label"], o["text"])).alias("options"), kind.alias("type"))
