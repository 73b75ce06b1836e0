"""URL filter by a tree of path templates, in DataFrame expressions only.

Fixed rules come first: a rule is a host and the start of a path, holds for the host and
all its subdomains, and the longest that fits decides.  For the other URLs a tree of path
templates per host is grown level by level, and one over all hosts beside it:

1. Segments that vary by their form are generalised: digits, long hexadecimal runs, long
   words.
2. Of a node's children those with fewer than ``SUPPORT`` URLs become one wildcard.
3. The others are merged where they are statistically similar: the same shape (whether
   they mostly end there, whether what follows mostly varies) and smoothed labelled
   purities less than a medium effect apart (cells of ``EFFECT`` on the arcsine scale,
   where a share's error does not depend on the share).  Branches with fewer than
   ``LABELLED`` labels merge among themselves only.

A template's purity is the share of blocked among its labelled URLs, smoothed towards the
purity of the same URLs' template over all hosts, and that towards the overall share.
Templates of at least ``REJECT`` are rejected.  Labels are the rules' verdicts and, if
given, a column of known ones.

Scale: only the columns that are given move.  Counts are combined before they are
shuffled, so a host or template that holds a third of all rows costs no task more.  Per
level a table of the supported children is written to the shared folder and looked up: sent
to all tasks where its size allows, else joined with salted rows.  Segments after the
``DEPTH``-th are one wildcard of the template.  Rules are a branch of an expression each.

Defined results: a URL that is null or without ``://`` has an empty host and path, fits no
rule and is allowed; rows, repeated or not, are judged one by one and all count; an empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_BYTES, read_table, written

SUPPORT, LABELLED, EFFECT, PRIOR, REJECT = 8, 4, 0.5, 4.0, 0.5
DEPTH, LONG, SALTS = 8, 40, 32
ALLOW, BLOCK = "allow", "block"
RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        h, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(start))
        found = F.when(fits, rule).otherwise(found)
    return found


def form(segment: Column) -> Column:
    """A segment with what varies by its form replaced."""
    return F.when(segment.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{16,}$"), "{x}").when(F.length(segment) > LONG, "{w}").otherwise(F.regexp_replace(segment, "[0-9]+", "{d}"))


def segments(path: Column) -> Column:
    """Forms of a path's first DEPTH segments; what follows them is one wildcard."""
    every = F.split(F.substr(path, F.lit(2)), "/")
    forms = F.transform(F.slice(every, 1, DEPTH), form)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.concat(forms, F.when(F.size(every) > DEPTH, F.array(F.lit("{**}"))).otherwise(F.array().cast("array<string>"))))


def _small(table: DataFrame) -> bool:
    """Whether a table of strings and a few numbers may be sent to all tasks."""
    size = sum((F.length(c) for c, t in table.dtypes if t == "string"), F.lit(64))
    return (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of a table that has at most one row per key; salted where the table is not small."""
    if _small(table):
        return rows.join(F.broadcast(table), keys, "left")
    salted = rows.withColumn("_q_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    every = table.withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return written(salted.join(every, [*keys, "_q_salt"], "left").drop("_q_salt"), "located")


def _level(rows: DataFrame, i: int, group: list[str], node: str, pool: str) -> DataFrame:
    """rows with node and pool, their node's purity so far, moved on by the i-th segment."""
    here, after = F.get("_q_segments", F.lit(i)), F.get("_q_segments", F.lit(i + 1))
    stats = rows.filter(F.size("_q_segments") > i).groupBy(*group, node, here.alias("_q_here")).agg(
        F.count("*").alias("n"), F.sum("_q_label").alias("blocked"), F.count("_q_label").alias("labelled"), F.max(pool).alias("pool"),
        F.count_if(after.isNull()).alias("ends"), F.count_if(F.contains(after, F.lit("{"))).alias("varied"),
    )
    purity = (F.coalesce("blocked", F.lit(0.0)) + PRIOR * F.col("pool")) / (F.col("labelled") + PRIOR)
    cell = F.when(F.col("labelled") >= LABELLED, F.floor(2 * F.asin(F.sqrt("_q_purity")) / EFFECT).cast("string")).otherwise("?")
    shape = F.concat(F.when(2 * F.col("ends") >= F.col("n"), "e").otherwise(""), F.when(2 * F.col("varied") >= F.col("n"), "v").otherwise(""))
    kept = stats.filter(F.col("n") >= SUPPORT).withColumn("_q_purity", purity).select(*group, node, "_q_here", F.concat(F.lit("<"), cell, shape, F.lit(">")).alias("_q_class"), "_q_purity")
    found = _looked_up(rows.withColumn("_q_here", here), written(kept, "children"), [*group, node, "_q_here"])
    name = F.when(F.col("_q_here").isNull(), F.col(node)).otherwise(F.concat(node, F.lit("/"), F.coalesce("_q_class", F.lit("*"))))
    return found.withColumns({node: name, pool: F.coalesce("_q_purity", pool)}).drop("_q_here", "_q_class", "_q_purity")


def _located(pages: DataFrame, url: str, rules: list[tuple[str, str]], label: str | None) -> tuple[DataFrame, float]:
    """pages with host, path, rule, label and both templates; and the overall share of blocked among the labelled."""
    host, path = parts(F.col(url))
    rows = pages.withColumns({"_q_host": host, "_q_path": path})
    rows = rows.withColumn("_q_rule", fitting(F.col("_q_host"), F.col("_q_path"), rules))
    blocking = F.col("_q_rule").isin([r for v, r in rules if v == BLOCK])
    known = F.when(F.col("_q_rule").isNotNull(), blocking.cast("double"))
    rows = rows.withColumns({"_q_label": known if label is None else F.coalesce(known, F.col(label).cast("double")), "_q_segments": segments(F.col("_q_path"))})
    share, depth = rows.agg(F.avg("_q_label"), F.max(F.size("_q_segments"))).first()
    share = share or 0.0
    rows = rows.withColumns({"_q_own": F.lit(""), "_q_own_pool": F.lit(share), "_q_all": F.lit(""), "_q_all_pool": F.lit(share)})
    for i in range(depth or 0):
        rows = _level(rows, i, ["_q_host"], "_q_own", "_q_own_pool")
        rows = _level(rows, i, [], "_q_all", "_q_all_pool")
    return rows, share


def _judged(cells: DataFrame, share: float) -> DataFrame:
    """cells (host and both templates, blocked, labelled) with their smoothed purity."""
    sums = [F.sum("blocked").alias("b"), F.sum("labelled").alias("l")]
    smoothed = lambda prior: (F.col("b") + PRIOR * prior) / (F.col("l") + PRIOR)
    everywhere = written(cells.groupBy("_q_all").agg(*sums).select("_q_all", smoothed(F.lit(share)).alias("_q_prior")), "everywhere")
    own = written(cells.groupBy("_q_host", "_q_own").agg(*sums), "own")
    found = _looked_up(_looked_up(cells, everywhere, ["_q_all"]), own, ["_q_host", "_q_own"])
    return found.select("_q_host", "_q_own", "_q_all", smoothed(F.col("_q_prior")).alias("_q_purity"))


def _cells(rows: DataFrame) -> DataFrame:
    counts = [F.count("*").alias("n"), F.coalesce(F.sum("_q_label"), F.lit(0.0)).alias("blocked"), F.count("_q_label").alias("labelled"), F.min("_q_path").alias("example")]
    return written(rows.groupBy("_q_host", "_q_own", "_q_all").agg(*counts), "cells")


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES, label: str | None = None, out: str = "_q_url") -> DataFrame:
    """pages with a struct: host, path, rule (or null), template, purity and verdict.  label: a boolean column of what is known to be blocked, or null."""
    rows, share = _located(pages, url, rules, label)
    judged = written(_judged(_cells(rows), share), "judged")
    found = _looked_up(rows, judged, ["_q_host", "_q_own", "_q_all"])
    ruled = F.when(F.col("_q_rule").isin([r for v, r in rules if v == BLOCK]), BLOCK).otherwise(ALLOW)
    learned = F.when((F.col("_q_purity") >= REJECT) & (F.col("_q_host") != ""), BLOCK).otherwise(ALLOW)
    made = F.struct(
        F.col("_q_host").alias("host"), F.col("_q_path").alias("path"), F.col("_q_rule").alias("rule"), F.col("_q_own").alias("template"), F.col("_q_purity").alias("purity"),
        F.when(F.col("_q_rule").isNotNull(), ruled).otherwise(learned).alias("verdict"),
    )
    return found.select(*pages.columns, made.alias(out))


def templates(pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES, label: str | None = None) -> DataFrame:
    """The templates: host, template, the same over all hosts, URLs, labelled, blocked, smoothed purity and an example."""
    rows, share = _located(pages, url, rules, label)
    cells = _cells(rows)
    found = _looked_up(cells, written(_judged(cells, share), "judged"), ["_q_host", "_q_own", "_q_all"])
    return found.select(F.col("_q_host").alias("host"), F.col("_q_own").alias("template"), F.col("_q_all").alias("everywhere"), "n", "labelled", "blocked", F.col("_q_purity").alias("purity"), "example")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "_q_url.host", "_q_url.path", "_q_url.rule", "_q_url.verdict")


def _oracle() -> str:
    """The same levels as common table expressions, DEPTH + 1 of them for each tree."""
    cases = " ".join(
        f"WHEN (host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda r: -len(r[1]))
    )
    blocking = ", ".join(f"'{r}'" for v, r in RULES if v == BLOCK)
    one = f"CASE WHEN regexp_matches(x, '^[0-9A-Fa-f-]{{16,}}$') AND regexp_matches(x, '[0-9]') THEN '{{x}}' WHEN length(x) > {LONG} THEN '{{w}}' ELSE regexp_replace(x, '[0-9]+', '{{d}}', 'g') END"
    out = [f"""WITH p AS (
  SELECT row_number() OVER () AS id, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
q AS (SELECT *, CASE {cases} END AS rule, CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END AS every FROM p),
l AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN CAST(rule IN ({blocking}) AS DOUBLE) END AS label,
    list_transform(every[1:{DEPTH}], lambda x: {one}) || CASE WHEN len(every) > {DEPTH} THEN ['{{**}}'] ELSE [] END AS segs FROM q),
g AS (SELECT coalesce(avg(label), 0.0) AS share FROM l),
own0 AS (SELECT id, host, segs, label, '' AS node, share AS pool FROM l, g),
all0 AS (SELECT id, '' AS host, segs, label, '' AS node, share AS pool FROM l, g)"""]  # fmt: skip
    for tree in ("own", "all"):
        for i in range(1, DEPTH + 2):
            out.append(f"""{tree}s{i} AS (
  SELECT host, node, segs[{i}] AS here, (coalesce(sum(label), 0.0) + {PRIOR} * max(pool)) / (count(label) + {PRIOR}) AS purity, count(label) AS labelled,
    CASE WHEN 2 * count(*) FILTER (len(segs) = {i}) >= count(*) THEN 'e' ELSE '' END || CASE WHEN 2 * count(*) FILTER (contains(segs[{i + 1}], '{{')) >= count(*) THEN 'v' ELSE '' END AS shape
  FROM {tree}{i - 1} WHERE len(segs) >= {i} GROUP BY host, node, segs[{i}] HAVING count(*) >= {SUPPORT}),
{tree}{i} AS (
  SELECT r.id, r.host, r.segs, r.label, CASE WHEN len(r.segs) < {i} THEN r.node WHEN s.here IS NULL THEN r.node || '/*' ELSE r.node || '/<' || CASE WHEN labelled >= {LABELLED} THEN CAST(CAST(floor(2 * asin(sqrt(purity)) / {EFFECT}) AS BIGINT) AS VARCHAR) ELSE '?' END || shape || '>' END AS node,
    coalesce(purity, pool) AS pool FROM {tree}{i - 1} r LEFT JOIN {tree}s{i} s ON r.host = s.host AND r.node = s.node AND r.segs[{i}] = s.here)""")
    last = DEPTH + 1
    out.append(f"""a AS (SELECT node, (coalesce(sum(label), 0.0) + {PRIOR} * any_value(share)) / (count(label) + {PRIOR}) AS prior FROM all{last}, g GROUP BY node),
o AS (SELECT host, node, coalesce(sum(label), 0.0) AS b, count(label) AS n FROM own{last} GROUP BY host, node)
SELECT page_id, l.host, path, rule, CASE WHEN rule IN ({blocking}) THEN 'block' WHEN rule IS NOT NULL OR l.host = '' THEN 'allow' WHEN (b + {PRIOR} * prior) / (n + {PRIOR}) >= {REJECT} THEN 'block' ELSE 'allow' END AS verdict
FROM l JOIN own{last} t USING (id) JOIN all{last} w USING (id) JOIN a ON w.node = a.node JOIN o ON t.host = o.host AND t.node = o.node""")
    return ",\n".join(out)


ORACLE_SQL = _oracle()
