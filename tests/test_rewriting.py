"""Rewrite rules and fingerprints over texts with $, %, _ and backslashes, by hand and by a plain Python form."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import rules, similarity
from quarry.plans import catalog, catalog_texts  # noqa: F401

REWRITTEN = {
    "a $$ x $$ b": "a \n\\[\nx\n\\]\n b",
    "a $$ b": "a b",
    r"\overparen{AB} \underparen {CD}": r"\overset{\frown}{AB} \underset{\frown}{CD}",
    "5% of (a)% % note\nnext": "5\\% of (a)\\% \nnext",
    r"kept \% here": r"kept \% here",
    r"$a//b//c$ // $d$": r"$a \parallel b \parallel c$ // $d$",
    r"http://x \[a//b\] // \[c\]": r"http://x \[a \parallel b\] // \[c\]",
    r"\begin{align*} x \end{align*}": "\n\\[\n\\begin{aligned}x\\end{aligned}\n\\]\n",
    "\\(x\\) and \\(y\nz\\)": "$x$ and $y\nz$",
    "x_{2}^{_y}": "x_{2}^{_y}",
    "plain": "plain",
}


def test_rewritten_texts(spark):
    rows = spark.createDataFrame([(t,) for t in REWRITTEN], "stem string").withColumns({"solution": F.lit(""), "answer": F.lit("z"), "source_label": F.lit(""), "type": F.lit("detailed_answer")})
    got = rules.normalise(rows.withColumn("given", F.col("stem")), (rules.ENTRY, rules.MIGRATE)).collect()
    assert {r["given"]: r["stem"] for r in got} == REWRITTEN
    assert all(bool(r["fired"]) == (r["given"] != r["stem"]) for r in got)


def brute(text):
    out, i, s = [], 0, text or ""
    while i < len(s):
        m = re.match(r"\\(paren|fillin)(?![A-Za-z])[ \t\n]*", s[i:])
        if not m:
            out.append(s[i])
            i += 1
            continue
        i += m.end()
        if s[i : i + 1] in ("[", "{") and i < len(s):
            left, right, depth = s[i], {"[": "]", "{": "}"}[s[i]], 0
            while i < len(s):
                if s[i] == "\\":
                    i += 2
                    continue
                depth += (s[i] == left) - (s[i] == right)
                i += 1
                if not depth:
                    break
        out.append("_")
    s = re.sub(r"(?<!\\)%[^\n]*", "", "".join(out))
    s = re.sub(r"[（(]\s*\\quad\s*[）)]", "_", s)
    for a, b in [*((c, "") for c in similarity.LAYOUT), *similarity.UNIFIED.items()]:
        s = s.replace(a, b)
    s = re.sub(r"（\s*）|_{2,}|\\underline\{\s*\}", "_", s)
    return re.sub(r"[\s$\{\}，。、；：？！,.;:?!（）()]|\\\\", "", s).lower()


SAME = [(r"a \left( x \right)", "a(x)"), (r"f \fillin{}", r"f （\quad）"), (r"\paren[B] q", r"\paren[C] q"), (r"is \fillin[$\sqrt[3]{2}$].", r"is \fillin[$3$]."), ("a % note\nb", "a\nb"), (r"\dfrac{1}{2}", r"\frac{1}{2}")]
OTHER = [(r"5\% of a", r"5\% of b"), (r"A \cup B", r"A \cap B")]


def test_fingerprints(spark):
    texts = [x for p in SAME + OTHER for x in p] + [None, "", "a_b __ c___d", r"\fillin[open", r"\parent x", "x\\\\y", r"100% \quad z"]
    got = dict(spark.createDataFrame([(t,) for t in texts], "t string").select("t", similarity.fingerprint(F.col("t"))).collect())
    assert got == {t: hashlib.sha256(brute(t).encode()).hexdigest() for t in texts}
    assert all(got[a] == got[b] for a, b in SAME) and all(got[a] != got[b] for a, b in OTHER)


@pytest.mark.parametrize("name", ["rewritten_texts", "all_fingerprints"])
def test_every_document_is_returned(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


#: rule: (scope, type, before, after), each of stem, answer, solution and source label.
BY_RULE = [
    ("answer_book_footer", "single_choice", ("q", "A", "one\n\n数学参考答案(甲版)-2\n\ntwo", ""), ("q", "A", "one\n\ntwo", "")),
    ("label_paren", "single_choice", ("q", "A", "", "卷（一（二 "), ("q", "A", "", "卷（一（二））")),
    ("label_full_width", "single_choice", ("q", "A", "", "卷(一）"), ("q", "A", "", "卷（一）")),
    ("label_full_width", "single_choice", ("q", "A", "", "卷(一)"), ("q", "A", "", "卷(一)")),
    ("answer_into_paren", "single_choice", (r"a ( ) is （\quad）.", "$B$", "", ""), (r"a ( ) is \paren[$B$].", "$B$", "", "")),
    ("answer_into_paren", "single_choice", (r"a \paren", "B", "", ""), (r"a \paren[B]", "B", "", "")),
    ("answer_into_paren", "fill_in_blank", ("a ( )", "B", "", ""), ("a ( )", "B", "", "")),
    ("paren_follows_answer", "multi_choice", (r"a \paren[AC] b", "ACD", "", ""), (r"a \paren[ACD] b", "ACD", "", "")),
    ("paren_follows_answer", "multi_choice", (r"\paren[A] \paren[B]", "C", "", ""), (r"\paren[A] \paren[B]", "C", "", "")),
    ("drop_leftover_blank", "single_choice", (r"is $(\quad)$ \paren[A]", "A", "", ""), (r"is \paren[A]", "A", "", "")),
    ("drop_leftover_blank", "single_choice", (r"is （ \paren[] ）", "A", "", ""), (r"is \paren[]", "A", "", "")),
    ("ensure_paren", "single_choice", ("q ", "A", "", ""), (r"q \paren[A]", "A", "", "")),
    ("ensure_paren", "single_choice", ("q ", "", "", ""), ("q ", "", "", "")),
    ("answer_list", "fill_in_blank", ("q", r"\begin{enumerate}\item 1 \item 2\end{enumerate}", "", ""), ("q", "1；2", "", "")),
    ("unify_detailed_answer", "detailed_answer", ("q", "7", "so 7", ""), ("q", "见解析", "so 7", "")),
    ("unify_detailed_answer", "detailed_answer", ("q", "7", "解析无", ""), ("q", "7", "解析无", "")),
    ("unify_separator", "fill_in_blank", (r"\fillin{} \fillin{}", "1, 2; 3", "", ""), (r"\fillin{} \fillin{}", "1, 2；3", "", "")),
    ("unify_separator", "fill_in_blank", (r"\fillin{}", "1; 3", "", ""), (r"\fillin{}", "1; 3", "", "")),
    ("list_options", "detailed_answer", (r"\begin{enumerate} [label=a] \item x", "", "", ""), (r"\begin{enumerate} \item x", "", "", "")),
    ("solution_tags_entry", "detailed_answer", ("q", "", "【详解】 so", ""), ("q", "", "so", "")),
    ("type_head_existing", "multi_choice", ("（多选）q", "A", "", ""), ("q", "A", "", "")),
    ("sentence_period_existing", "detailed_answer", ("成立. 因", "", "", ""), ("成立。 因", "", "", "")),
]


def test_each_rule_by_hand(spark):
    fields = ["stem", "answer", "solution", "source_label"]
    by_name = {r.name: r for r in rules.RULES}
    rows = spark.createDataFrame([(k, kind, *before) for k, (_, kind, before, _) in enumerate(BY_RULE)], "k int, type string, " + ", ".join(f"{f} string" for f in fields))
    for name in dict.fromkeys(b[0] for b in BY_RULE):
        mine = [k for k, b in enumerate(BY_RULE) if b[0] == name]
        got = rows.filter(F.col("k").isin(mine)).withColumns(by_name[name].rewrite(F.col)).select("k", *fields).collect()
        assert {r["k"]: tuple(r)[1:] for r in got} == {k: BY_RULE[k][3] for k in mine}, name


def test_rules_are_folded_once_and_make_each_text_once(spark, sf):
    from quarry.plans import catalog_texts

    for query in (catalog_texts.rewrite_fired, catalog_texts.rewritten_texts):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("double_punctuation") == 1
        assert plan.count("wideparen") == 3  # a time for each field
