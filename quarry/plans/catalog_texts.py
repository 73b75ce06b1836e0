"""Queries on texts and documents: quality rules, rewriting, reconstruction, sources, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import bodies, documents, quality, rules, semantics, similarity, tree_checks, tree_rules
from quarry.operators.model import read
from quarry.plans.catalog import full, query
from quarry.sources import volumes
from quarry.streaming import ingest

KINDS = ["single_choice", "multi_choice", "fill_in_blank", "detailed_answer"]


def option(label, text):
    return F.struct(F.lit(label).alias("label"), text.alias("text"))


def _typed(spark, d):
    """Items with a type of the four, options and figures."""
    k = F.col("seq")
    options = F.array(option("A", F.substring("stem", 1, 3)), option("B", F.substring("stem", 4, 3)), option("C", F.lit("c")))
    none = F.array().cast("array<struct<label:string,text:string>>")
    return full(spark, d).select(
        "key", "seq", "solution", "stem", F.get(F.array(*map(F.lit, KINDS)), (k % 4).cast("int")).alias("type"),
        F.when(k % 5 == 0, "").when(k % 4 < 2, F.when(k % 3 == 0, "D").otherwise("B")).otherwise(F.col("answer")).alias("answer"),
        F.when(k % 4 < 2, F.when(k % 6 == 0, F.slice(options, 1, 1)).otherwise(options)).otherwise(none).alias("options"),
        F.array().cast("array<struct<id:string>>").alias("figures"),
    )


_TYPED = """, y AS (SELECT key, seq, stem, solution, ['single_choice', 'multi_choice', 'fill_in_blank', 'detailed_answer'][1 + CAST(seq % 4 AS INT)] AS type,
  CASE WHEN seq % 5 = 0 THEN '' WHEN seq % 4 < 2 THEN CASE WHEN seq % 3 = 0 THEN 'D' ELSE 'B' END ELSE answer END AS answer,
  CASE WHEN seq % 4 < 2 THEN CASE WHEN seq % 6 = 0 THEN 1 ELSE 3 END ELSE 0 END AS n_options,
  [substr(stem, 1, 3), substr(stem, 4, 3), 'c'] AS texts FROM full_items)
"""


@query(
    _TYPED
    + """SELECT key, 'stem' AS rule FROM y WHERE trim(stem) = '' UNION ALL SELECT key, 'options' FROM y WHERE seq % 4 < 2 AND n_options < 2
UNION ALL SELECT key, 'option_text' FROM y WHERE seq % 4 < 2 AND (trim(texts[1]) = '' OR (n_options > 1 AND trim(texts[2]) = ''))
UNION ALL SELECT key, 'answer_letters' FROM y WHERE seq % 4 < 2 AND ((n_options = 1 AND answer IN ('B', 'D')) OR answer = 'D')
UNION ALL SELECT key, 'blank' FROM y WHERE type = 'fill_in_blank'""",
    base=True,
)
def structure_violations(spark, d):
    return quality.violations(_typed(spark, d), "key", quality.structure()).select("key", "rule")


@query(
    r"""SELECT doc_id, rule FROM (SELECT doc_id, 'dollar' AS rule FROM documents WHERE (length(text) - length(replace(text, '$', ''))) % 2 = 1 UNION ALL SELECT doc_id, 'double_dollar' FROM documents WHERE contains(text, '$$')
UNION ALL SELECT doc_id, 'comment' FROM documents WHERE regexp_matches(text, '(^|[^\\])%'))"""
)
def conform_parity(spark, d):
    return quality.violations(read(spark, d, "documents"), "doc_id", quality.conformance("text")).select("doc_id", "rule")


@query()
def conform_all(spark, d):
    return quality.violations(read(spark, d, "documents"), "doc_id", quality.conformance("text"))


@query(
    _TYPED
    + """SELECT key, CASE WHEN seq % 4 < 3 AND trim(answer) = '' THEN 0.0 WHEN seq % 4 < 2 AND NOT regexp_matches(trim(answer), '^[A-D]{1,4}$') THEN 0.6
  WHEN (n_options = 1 AND regexp_matches(trim(answer), '[B-D]')) OR (n_options = 3 AND contains(answer, 'D')) THEN 0.7 ELSE 1.0 END::DOUBLE AS conf_answer,
  CASE WHEN trim(solution) = '' THEN 0.0 ELSE round(greatest(0.0, 1.0::DOUBLE - CASE WHEN length(trim(solution)) < 24 THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(trim(solution), '(，|,|、|；|;|所以|因此|=)$') THEN 0.35::DOUBLE ELSE 0 END
    - CASE WHEN (length(solution) - length(replace(solution, '$', ''))) % 2 = 1 THEN 0.3::DOUBLE ELSE 0 END), 2) END::DOUBLE AS conf_solution
FROM y""",
    base=True,
)
def confidence_parts(spark, d):
    return quality.confidence(_typed(spark, d)).select("key", "conf_answer", "conf_solution")


@query()
def confidence_levels(spark, d):
    """All parts and levels; the brace walk has no SQL form."""
    return quality.confidence(_typed(spark, d)).select("key", "conf_stem", "conf_answer", "conf_solution", "overall", "level")


_DICE = """, z AS (SELECT *, regexp_replace(coalesce(stem, ''), '[^\\x{4e00}-\\x{9fff}A-Za-z0-9]', '', 'g') AS ns, regexp_replace(coalesce(solution, ''), '[^\\x{4e00}-\\x{9fff}A-Za-z0-9]', '', 'g') AS nz FROM y),
ca AS (SELECT key, substr(ns, i, 2) AS g, count(*) AS n FROM (SELECT key, ns, unnest(range(1, length(ns))) AS i FROM z) GROUP BY 1, 2), cb AS (SELECT key, substr(nz, i, 2) AS g, count(*) AS n FROM (SELECT key, nz, unnest(range(1, length(nz))) AS i FROM z) GROUP BY 1, 2),
dice AS (SELECT key, 2.0 * sum(least(ca.n, cb.n)) / any_value(length(ns) + length(nz) - 2) AS dice FROM ca JOIN cb USING (key, g) JOIN z USING (key) GROUP BY key)
"""


@query(
    _TYPED + _DICE + """SELECT key, 'P0' AS what, 'no_answer' AS rule FROM y WHERE type <> 'detailed_answer' AND trim(answer) IN ('', '{}', '无', '略', '答案：{}', '见解析', '$ $')
UNION ALL SELECT key, 'P1', 'copies_stem' FROM z JOIN dice USING (key) WHERE dice > 0.90 AND length(nz) < 1.6 * length(ns)
UNION ALL SELECT key, 'P0', 'conclusion' FROM y WHERE false""",
    base=True,
)
def contradictions(spark, d):
    return quality.violations(semantics.prepared(_typed(spark, d)), "key", quality.contradictions(semantics.of_prepared()))


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages"""
)
def html_strip(spark, d):
    return read(spark, d, "pages").select("page_id", quality.strip_html(F.col("html")).alias("text"))


@query(r"""SELECT snippet, count(*) AS n, min(page_id) AS first_key FROM (SELECT page_id, unnest(regexp_extract_all(html, '&[a-z]+;')) AS snippet FROM pages) WHERE snippet <> '&amp;' GROUP BY snippet""")
def new_noise(spark, d):
    known = spark.createDataFrame([("&amp;",)], "snippet string").select(F.sha1("snippet").alias("hash"))
    return documents.tag_noise(read(spark, d, "pages"), "page_id", "html", known, "&[a-z]+;").select("snippet", "n", "first_key")


@query(
    r"""SELECT doc_id, regexp_matches(text, '[\\%$，。]') AS concerned, CASE WHEN NOT regexp_matches(text, '[\\%$，。]') THEN text END AS text FROM documents"""
)
def rewrite_keeps_clean_text(spark, d):
    """Every document after the rules, its text returned where no rule on marks concerns it: that stays as it is.  rewritten_texts returns the others'."""
    docs = read(spark, d, "documents").withColumn("concerned", F.col("text").rlike(r"[\\%$，。]"))
    rows = docs.select("doc_id", "concerned", F.col("text").alias("solution"), F.lit("x").alias("stem"), F.lit("").alias("answer"), F.lit("").alias("source_label"), F.lit("detailed").alias("type"))
    skip = {"step_scores", "running_head", "solution_echo", "answer_from_solution"}  # these take away whole parts of a text
    out = rows
    for r in rules.RULES:
        if r.name not in skip:
            out = out.withColumns(r.rewrite(F.col))
    return out.select("doc_id", "concerned", F.when(~F.col("concerned"), F.col("solution")).alias("text"))


@query()
def rewritten_texts(spark, d):
    """Every document after all rules, field by field; the fold has no SQL form."""
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("stem"), F.col("text").alias("solution"), F.lit("").alias("answer"), F.col("source").alias("source_label"), F.lit("detailed_answer").alias("type"))
    return rules.normalise(docs, (rules.ENTRY, rules.MIGRATE)).select("doc_id", *rules.FIELDS, "fired")


@query()
def rewrite_fired(spark, d):
    """Which rules change how many documents."""
    docs = read(spark, d, "documents").select(F.col("text").alias("stem"), F.col("text").alias("solution"), F.lit("").alias("answer"), F.lit("a(b").alias("source_label"), F.lit("detailed_answer").alias("type"))
    # Outer: before a plain explode Spark asks whether the array is empty, and so folds the rules again.
    fired = rules.normalise(docs, (rules.ENTRY, rules.MIGRATE)).select(F.explode_outer("fired").alias("rule")).filter("rule is not null")
    return fired.groupBy("rule").agg(F.count("*").alias("n"))


_LINES = """WITH l AS (SELECT conv_id AS doc, turn AS page, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT conv_id, turn, replace(string_agg(text, '. ' ORDER BY text), '. ', chr(10)) AS text FROM conversations GROUP BY conv_id, turn)),
n AS (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page, i) AS line_no, trim(t) AS text FROM l WHERE trim(t) <> '')
"""


def _lines(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_list("text")), ". ").alias("text"))
    return documents.lines(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.replace("text", F.lit(". "), F.lit("\n")).alias("text")))


@query(_LINES + "SELECT doc, page, line_no, text FROM n")
def numbered_lines(spark, d):
    return _lines(spark, d).withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    _LINES
    + r""", q AS (SELECT doc, line_no AS k, text AS quote FROM n ), s AS (SELECT doc, k, left(lower(regexp_replace(quote, '\s+', '', 'g')), 24) AS a FROM q),
f AS (SELECT s.doc, k, min(line_no) AS line_no FROM s JOIN n ON n.doc = s.doc WHERE length(a) >= 6 AND contains(lower(regexp_replace(text, '\s+', '', 'g')), a) GROUP BY s.doc, k),
b AS (SELECT s.doc, k, line_no AS start FROM s JOIN f USING (doc, k)), z AS (SELECT doc, max(line_no) AS last FROM n GROUP BY doc)
SELECT doc, k, start, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start, k) - 1, last) AS range_end FROM b JOIN z USING (doc)"""
)
def anchored_blocks(spark, d):
    lines = _lines(spark, d).withColumn("line_no", F.col("line_no").cast("bigint"))
    quotes = lines.select("doc", F.col("line_no").alias("n"), F.col("text").alias("quote"))
    starts = documents.find_lines(lines, quotes).withColumnRenamed("line_no", "start")
    return documents.blocks(starts, lines).select("doc", F.col("n").alias("k"), "start", F.col("end").alias("range_end"))


@query(
    """WITH s AS (SELECT conv_id AS doc, turn AS ord, role AS type, min(length(text) % 5) AS n FROM conversations GROUP BY ALL), b AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s)
SELECT doc, type, CAST(unnest(range(before + 1, before + n + 1)) AS BIGINT) AS number FROM b WHERE n > 0"""
)
def section_numbers(spark, d):
    c = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.col("role").alias("type")).agg(F.min(F.length("text") % 5).alias("n"))
    return documents.expand_sections(c).select("doc", "type", F.col("number").cast("bigint").alias("number"))


@query(
    """WITH p AS (SELECT conv_id AS item, turn AS page, min(CASE WHEN role = 'user' THEN text END) AS answer, min(text) AS stem, max(CASE WHEN turn % 2 = 1 THEN text END) AS solution FROM conversations GROUP BY conv_id, turn)
SELECT item, arg_min(answer, page) FILTER (trim(coalesce(answer, '')) <> '') AS answer, arg_max(stem, struct_pack(a := length(stem), b := -page)) AS stem, coalesce(string_agg(solution, chr(10) ORDER BY page) FILTER (trim(coalesce(solution, '')) <> ''), '') AS solution
FROM p GROUP BY item"""
)
def folded_pages(spark, d):
    c = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("item"), F.col("turn").alias("page")).agg(
        F.min(F.when(F.col("role") == "user", F.col("text"))).alias("answer"), F.min("text").alias("stem"), F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("solution")
    )
    return documents.fold_pages(c)


@query()
def aligned_answers(spark, d):
    """Turns of users and of others aligned in order by what they share."""
    c = read(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("doc"), F.when(F.col("role") == "user", "q").otherwise("a").alias("side"), F.col("turn").alias("at"), "text")
    return documents.align(rows)


@query()
def numbered_items(spark, d):
    lines = _lines(spark, d).withColumn("text", F.concat((F.col("line_no") % 7).cast("string"), F.lit(". "), F.col("text")))
    return documents.item_starts(lines)


@query("""SELECT lang AS type, 'q' || doc_id AS key, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 100 AS INTEGER) AS batch, trim(text) AS stem, trim(source) AS answer FROM documents""")
def markdown_round_trip(spark, d):
    docs = read(spark, d, "documents").select(
        F.col("lang").alias("type"), F.col("doc_id").alias("seq"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("stem"), F.col("source").alias("answer"), F.lit("s").alias("solution")
    )
    sections = volumes.to_markdown(docs)
    back = volumes.from_markdown(sections).select("key", "stem", "answer")
    return sections.select("type", "batch", F.regexp_extract("value", r"^## (\S+)", 1).alias("key")).join(back, "key")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_activity(spark, d):
    return ingest.activity(read(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def _normalised_sql() -> str:
    """The normalisation of texts without slots, as SQL."""
    s = r"regexp_replace(regexp_replace(text, '(^|[^\\])%[^\n]*', '\1', 'g'), '[（(]\s*\\quad\s*[）)]', '_', 'g')"
    for a, b in [*((c, "") for c in similarity.LAYOUT), *similarity.UNIFIED.items()]:
        s = f"replace({s}, '{a}', '{b}')"
    s = rf"regexp_replace({s}, '（\s*）|_{{2,}}|\\underline\{{\s*\}}', '_', 'g')"
    return rf"lower(regexp_replace({s}, '[\s$\{{\}}，。、；：？！,.;:?!（）()]|\\\\', '', 'g'))"


@query(f"SELECT doc_id, sha256({_normalised_sql()}) AS fingerprint FROM documents")
def normalised_fingerprint(spark, d):
    """The fingerprint of every document; the SQL knows no slots, which these texts do not have."""
    return read(spark, d, "documents").select("doc_id", similarity.fingerprint(F.col("text")).alias("fingerprint"))


@query()
def all_fingerprints(spark, d):
    """The fingerprint of every document; slots and comments have no SQL form."""
    return read(spark, d, "documents").select("doc_id", similarity.fingerprint(F.col("text")).alias("fingerprint"))


# --- bodies in LaTeX -------------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS source_sha256, true AS has_tree FROM documents")
def body_trees(spark, d):
    """Every document as a tree in VARIANT and back."""
    kept = read(spark, d, "documents").select("doc_id", bodies.tree(F.col("text")).alias("tree"))
    return kept.select("doc_id", F.sha2(bodies.source(F.col("tree")).cast("binary"), 256).alias("source_sha256"), F.col("tree").isNotNull().alias("has_tree"))


def _bodies(spark, d):
    """Documents as bodies: a third each choices, blanks and problems, with the text as stem and solution."""
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, F.when(k % 2 == 0, "single_choice").otherwise("multi_choice")).when(k % 3 == 1, "fill_in_blank").otherwise("detailed_answer")
    docs = read(spark, d, "documents").withColumn("kind", kind)
    options = F.when(k % 3 == 0, F.array(option("A", F.col("source")), option("B", F.col("lang")), option("C", F.lit("$x$")))).otherwise(F.array().cast("array<struct<label:string,text:string>>"))
    answer = F.when(k % 3 == 0, F.when(k % 2 == 0, "B").otherwise("AC")).when(k % 3 == 1, r"$\frac{1}{2}$").otherwise("")
    return docs.select("doc_id", "kind", bodies.write(F.col("kind"), F.col("text"), options, answer, F.col("text"), F.when(k % 2 == 0, 5)).alias("body"))


_CLEANED = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '(?m)^[ \t]+', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@query(
    rf"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'single_choice' ELSE 'multi_choice' END WHEN 1 THEN 'fill_in_blank' ELSE 'detailed_answer' END AS type,
  sha256(CASE WHEN doc_id % 3 = 1 THEN regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '(?m)^[ \t]+', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') || ' \fillin[$\frac{{1}}{{2}}$]' ELSE {_CLEANED} END) AS stem_sha256,
  CASE WHEN doc_id % 3 = 0 THEN 'A:' || coalesce(source, '') || '|B:' || coalesce(lang, '') || '|C:$x$' ELSE '' END AS options,
  CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'B' ELSE 'AC' END WHEN 1 THEN '$\frac{{1}}{{2}}$' ELSE '' END AS answer,
  sha256({_CLEANED}) AS solution_sha256, CASE WHEN doc_id % 2 = 0 THEN 5.0 END::DOUBLE AS points FROM documents"""
)
def parsed_bodies(spark, d):
    """Bodies made of the documents, read again."""
    found = _bodies(spark, d).select("doc_id", bodies.read(F.col("body")).alias("q"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    options = F.array_join(F.transform("q.options", lambda o: F.concat(o["label"], F.lit(":"), o["text"])), "|")
    return found.select("doc_id", "q.type", digest("q.stem").alias("stem_sha256"), options.alias("options"), "q.answer", digest("q.solution").alias("solution_sha256"), "q.points")


@query(
    """SELECT doc_id, 'env' AS kind, CASE WHEN doc_id % 3 = 2 THEN 'problem' ELSE 'question' END AS name, CASE WHEN coalesce(text, '') <> '' THEN 'solution' END AS after FROM documents"""
)
def body_outline(spark, d):
    """What stands first and last in each body's tree, read by path."""
    kept = _bodies(spark, d).select("doc_id", bodies.tree(F.col("body")).alias("tree"))
    at = lambda path: F.try_variant_get("tree", path, "string")
    return kept.select("doc_id", at("$[0].k").alias("kind"), at("$[0].name").alias("name"), at("$[2].name").alias("after"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(text, '%[^\n]*', '', 'g'), '\s+', ' ', 'g')) AS line FROM benchmark""")
def visible_texts(spark, d):
    return read(spark, d, "benchmark").select("item_id", bodies.visible(F.col("text")).alias("line"))


@query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[${}\[\]()（）%]', '', 'g'), '\s+', ' ', 'g')) AS line FROM documents)
SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN 'Find.' || chr(10) || '\begin{enumerate}' || chr(10) || '\item ' || line || chr(10) || '\item ' || trim('b ' || line) || chr(10) || '\end{enumerate}'
    WHEN 1 THEN rtrim(line) || ' $y=$\fillin[$\frac{1}{2}$] and \fillin[{[0,1)}].'
    WHEN 2 THEN line || 'x'
    ELSE line || ' A$\cap \cup$B $x$ $\geq$0' END AS stem,
  CASE WHEN doc_id % 4 = 2 THEN 'A:' || trim('o ' || line) || '|B:$b$|C:c|D:d' ELSE '' END AS options,
  CASE doc_id % 4 WHEN 0 THEN 'parts_to_enumerate' WHEN 1 THEN 'answer_into_fillin,move_blanks_out_of_math' WHEN 2 THEN 'split_inline_options' ELSE 'unicode_math_to_tex' END AS fired FROM t"""
)
def tree_rewrites(spark, d):
    """Items made of the documents, a quarter each for parts, blanks, options and signs, after the rules on trees."""
    docs = read(spark, d, "documents")
    line = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[${}\[\]()（）%]", ""), r"\s+", " "))
    k = F.col("doc_id") % 4
    stem = (
        F.when(k == 0, F.concat(F.lit("Find.\n\n (1) "), line, F.lit("\n（2） b "), line))
        .when(k == 1, F.concat(F.rtrim(line), F.lit(r" $y=\fillin{}$ and \fillin[].")))
        .when(k == 2, F.concat(line, F.lit("x\n\nA. o "), line, F.lit("\nB、$b$\nC．c\n D. d ")))
        .otherwise(F.concat(line, F.lit(" A∩∪B $x$ ≥0")))
    )
    kind = F.get(F.array(*map(F.lit, ["detailed_answer", "fill_in_blank", "single_choice", "detailed_answer"])), k.cast("int"))
    items = docs.select("doc_id", kind.alias("type"), stem.alias("stem"), F.when(k == 1, r"\frac{1}{2}；[0,1)").alias("answer"), F.lit(None).cast("string").alias("solution"), F.lit(None).cast("array<struct<label:string,text:string>>").alias("options"), F.lit(0).alias("figures"))
    done = tree_rules.normalise(items, (rules.ENTRY, rules.MIGRATE))
    options = F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit(":"), o["text"])), "|")
    return done.select("doc_id", "stem", options.alias("options"), F.array_join("fired", ",").alias("fired"))


@query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[${}\[\]()（）%]', '', 'g'), '\s+', ' ', 'g')) AS line FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 2 THEN 'render_leak' END, CASE WHEN doc_id % 5 = 3 OR regexp_matches(line || ' ', '(^|[^0-9.])[.]\s') THEN 'sentence_period' END,
  CASE WHEN doc_id % 5 = 0 THEN 'blank_in_formula' END, CASE WHEN doc_id % 5 = 1 THEN 'bar_pair' END], lambda x: x IS NOT NULL), ',') AS faults FROM t"""
)
def tree_conformance(spark, d):
    """Documents with a slot in a formula, two kinds of bars, a command that nobody knows, a sentence or nothing after them."""
    line = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[${}\[\]()（）%]", ""), r"\s+", " "))
    ends = F.array(*map(F.lit, [r" $y=\fillin[1]$", r" $\left|x\right\|$", r" \foo{x} y", " 句.", " $\\left|\\left\\|x\\right\\|\\right|$"]))
    docs = read(spark, d, "documents").select("doc_id", F.concat(line, F.get(ends, (F.col("doc_id") % 5).cast("int"))).alias("text"))
    return docs.select("doc_id", F.array_join(tree_checks.faults(F.col("text")), ",").alias("faults"))
