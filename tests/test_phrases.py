"""Phrase search, rules on an item's writing, and the splitting of options, by hand."""

from pyspark.sql import functions as F

from quarry.operators import documents, quality, search


def test_phrase_search(spark):
    docs = spark.createDataFrame([("a", r"函数单调递增 $\frac{x}{y}$"), ("b", "单调的函数"), ("c", "函 数, Of the data data"), ("d", None)], "key string, text string")

    def keys(query):
        return {r["key"] for r in search.phrase_search(docs, "key", search.searchable(F.col("text")), query).collect()}

    assert keys("函数") == {"a", "b", "c"} and keys("函数 单调") == {"a", "b"} and keys("函数单调") == {"a"}
    assert keys("OF_the, data") == {"c"} and keys("frac") == keys("unknown") == keys("") == keys("？!") == set()
    best = search.best_phrases(docs, "key", search.searchable(F.col("text")), "函数", limit=0).collect()
    assert len(best) == 1
    items = spark.createDataFrame([("a", 1, 0), ("b", 5, 0), ("d", 9, 0)], "key string, score int, used int")
    ranked = spark.createDataFrame([("a", 0.5)], "key string, score double")
    assert [r["key"] for r in search.two_tiers(items, ranked).collect()] == ["a", "d", "b"]
    assert [r["key"] for r in search.two_tiers(items, ranked.limit(0)).collect()] == ["d", "b", "a"]


WRITING = [
    ("single_choice", r"$x\text { 或 }y$ \paren[A]", "A", "", []),
    ("single_choice", r"$x或y$ \paren[A]", "A", "", ["words_in_formula"]),
    ("detailed_answer", r"\(x\)", "", r"\left( \\( y", ["inline_marks"]),
    ("detailed_answer", "x", "", r"\left(x\right) \\(y", []),
    ("single_choice", "x", "A", "", ["answer_place"]),
    ("fill_in_blank", r"\fillin[1] \fillin[2]", "1；2", "", []),
    ("fill_in_blank", r"\fillin[1]", "1；2", "", ["blanks"]),
    ("fill_in_blank", "x", "", "", ["blanks"]),
    ("single_choice", r"（$\quad$） \paren[A]", "A", "", ["two_places"]),
    ("detailed_answer", None, None, ' [{"label": "A"}]', ["json"]),
    ("detailed_answer", "x", "", "[1, 2) 上递增", []),
]


def test_writing(spark):
    rows = spark.createDataFrame([(i, *w[:4]) for i, w in enumerate(WRITING)], "key int, type string, stem string, answer string, solution string")
    got = {i: [] for i in range(len(WRITING))}
    for r in quality.violations(rows, "key", quality.item_conformance()).collect():
        got[r["key"]].append(r["rule"])
    assert got == {i: w[4] for i, w in enumerate(WRITING)}


BLOCKS = {
    "stem\nA. 1  B. 2  C．3 D、4": ("stem", ["A1", "B2", "C3", "D4"]),
    "head A. 1 B. 2\nC. 3\nD. 4": ("head", ["A1", "B2", "C3", "D4"]),
    "see part A. here\nB. 2": ("see part A. here", ["B2"]),
    "A. 1\nA. 2": ("", ["A2"]),
    "no options": ("no options", []),
    "": ("", []),
}


def test_options(spark):
    rows = spark.createDataFrame([(b,) for b in BLOCKS], "b string").select("b", documents.split_options(F.col("b")).alias("x")).collect()
    assert {r["b"]: (r["x"]["stem"], [o["label"] + o["text"] for o in r["x"]["options"]]) for r in rows} == BLOCKS


def test_types(spark):
    cases = [("x", 4, "BCD", None, "multi_choice"), ("x", 4, "B", None, "single_choice"), ("x", 3, "", "multi_choice", "multi_choice"), ("x", 3, "B", "multi_choice", "single_choice"),
             ("x", 3, "", None, "single_choice"), ("A. 1 B. 2 C. 3", 0, "", None, "single_choice"), ("a ____ b", 0, "", None, "fill_in_blank"), ("x（ ）。", 0, "", None, "single_choice"),
             ("x", 0, "", None, "detailed_answer"), (None, 0, None, None, "detailed_answer")]
    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, s string, n int, a string, h string")
    options = F.array_repeat(F.lit("o"), F.col("n"))
    got = dict(rows.select("i", documents.classify_type(F.col("s"), options, F.col("a"), F.col("h"))).collect())
    assert got == {i: c[4] for i, c in enumerate(cases)}
