r"""The LaTeX parser and what is read from its trees, by hand and on random texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import latex
from quarry.operators import bodies

TOKENS = ["$", "$$", r"\[", r"\]", r"\(", r"\)", "{", "}", "[", "]", r"\begin{a}", r"\end{a}", r"\begin{enumerate}", r"\end{enumerate}", " ", "\n\n", "\n", "x", r"\fillin", r"\left[", r"\right)", "\\", "%", "&", r"\\", r"\item", r"\frac", r"\{", r"\$", "中"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(TOKENS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_every_text_comes_back():
    for t in texts(5000):
        tree = latex.parse(t)
        assert latex.source(tree) == t
        latex.block_text(latex.blocks(tree))


@pytest.mark.parametrize("piece", ["{", "$", "[", r"\x[", "{$", r"\x{}", r"\end{a}", r"\begin{a}", r"\begin{a}\end{b}", r"(\[", r"\left"])
def test_time_is_linear(piece):
    def took(n):
        began = time.perf_counter()
        assert latex.source(latex.parse(piece * n)) == piece * n
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 40 * took(8000) + 0.2


def shape(nodes):
    """A tree in short: math and groups as lists, commands as name and arguments."""
    out = []
    for n in nodes:
        if n["k"] == "text":
            out.append(n["s"])
        elif n["k"] == "cmd":
            out.append((n["name"], *(shape(a["c"]) for a in n["args"])))
        else:
            out.append([n.get("name", n["open"]), n["close"] != "", *shape(n["c"])])
    return out


TREES = {
    r"a $x^{2}$": ["a ", ["$", True, "x^", ["{", True, "2"]]],
    r"\fillin[$\sqrt[3]{2}$] b": [("fillin", [["$", True, ("sqrt", ["3"], ["2"])]]), " b"],
    r"\fillin [0,1) c": [("fillin",), " [0,1) c"],
    r"[$\left[ 7,4 \right)$]": ["[", ["$", True, ("left",), " 7,4 ", ("right",)], "]"],
    r"\fillin[{[0]}]x": [("fillin", [["{", True, "[0]"]]), "x"],
    r"\fillin[$[0,1]$]x": [("fillin", [["$", True, "[0,1]"]]), "x"],
    r"\fillin[[2,3)] x": [("fillin",), "[[2,3)] x"],
    "a $ b": ["a $ b"],
    "{ $ a } b$": [["{", True, " $ a "], " b$"],
    "$a$$b$": [["$", True, "a"], ["$", True, "b"]],
    r"\begin{a}{x\end{a}}": [["a", True, ["{", False, "x"]], "}"],
    r"\begin{a}\begin{a}\end{a}": [["a", False, ["a", True]]],
    r"\frac{1}" + "\n\n{2}": [("frac", ["1"]), "\n\n", ["{", True, "2"]],
    r"\{ \$": [r"\{ \$"],
    "": [],
}


@pytest.mark.parametrize("text", TREES)
def test_trees(text):
    def joined(x):  # neighbouring texts, as parts of one
        out = []
        for n in x:
            if isinstance(n, str) and out and isinstance(out[-1], str):
                out[-1] += n
            else:
                out.append(joined(n) if isinstance(n, list) and n and n[0] in ("$", "{", "a") else n)
        return out

    assert joined(shape(latex.parse(text))) == TREES[text]


def test_deep_marks_are_text():
    deep = "{" * 500 + "x" + "}" * 500 + r" \begin{a}$y$\end{a}"
    tree = latex.parse(deep)
    assert latex.source(tree) == deep and tree[0]["close"] == "}" and tree[-1]["name"] == "a"


def test_blocks_and_their_text():
    found = latex.blocks(latex.parse(r"""One $x$ % note
line \fillin[2].

\begin{enumerate}\item a \item b\[y\]\end{enumerate}
\begin{tabular}{cc}\hline 1 & 2\\ \textbf{3} & $a & b$\\\end{tabular}
\begin{center}\includegraphics[width=0.4\linewidth]{p.png}\end{center}
$$u=\fillin+1$$ \foo{z} \ldots"""))
    assert [b["t"] for b in found] == ["p", "list", "table", "box", "p"]
    assert [[x["t"] for x in i] for i in found[1]["items"]] == [["p"], ["p", "math"]]
    assert len(found[2]["rows"]) == 2 and [len(r) for r in found[2]["rows"]] == [2, 2]
    assert found[3]["blocks"] == [{"t": "fig", "id": "p.png", "width": "40%"}]
    assert [i["t"] for i in found[4]["in"]] == ["m", "blank", "m", "raw", "s"]
    assert latex.block_text(found) == r"One x line ____ . a b y 1 2 3 a & b u= ____ +1 \foo{z} …"
    assert latex.leaks(found) == [r"\foo"]


ITEMS = [
    (r"\begin{question}[points=5] Find \paren[ B ]" "\n\\begin{choices}\\item one\\item two\\end{choices}\\end{question}", ("single_choice", r"Find \paren[ B ]", ["one", "two"], "B", "", 5.0)),
    (r"\begin{question}Pick\begin{choices}\item* $a$ \item b \item*[x] c\end{choices}\end{question}\begin{solution}why\end{solution}", ("multi_choice", "Pick", ["$a$", "b", "[x] c"], "AC", "why", None)),
    (r"\begin{question}$y=\fillin[\frac{1}{2}]$ and \fillin[$\sqrt[3]{2}$], \fillin\end{question}", ("fill_in_blank", None, [], r"$\frac{1}{2}$；$\sqrt[3]{2}$", "", None)),
    (r"junk \begin{problem}[points=12.5]Prove" "\n\n\n\n   it \\begin{solution}\\textbf{答案：}42 \n so\\end{solution}\\end{problem}", ("detailed_answer", "Prove\n\nit", [], "42", "so", 12.5)),
    (r"\begin{question}no end", None),
    ("plain", None),
    (None, None),
]


def test_items(spark):
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(ITEMS)], "i int, b string").select("i", bodies.read(F.col("b")).alias("q")).collect()
    for r in rows:
        body, want = ITEMS[r.i]
        if want is None:
            assert r.q is None, body
            continue
        kind, stem, options, answer, solution, points = want
        assert (r.q.type, [o.text for o in r.q.options], r.q.answer, r.q.solution, r.q.points) == (kind, options, answer, solution, points), body
        assert stem is None or r.q.stem == stem
        assert [o.label for o in r.q.options] == list("ABCDEF")[: len(options)]


def test_figures(spark):
    tikz = r"\begin{tikzpicture}\draw;\end{tikzpicture}"
    body = rf"\begin{{question}}\includegraphics[width=3cm]{{a.png}} {tikz} \begin{{choices}}\item \includegraphics{{b.png}}\item \includegraphics{{a.png}}\end{{choices}}\end{{question}}\begin{{solution}}{tikz}\end{{solution}}"
    q = spark.createDataFrame([(body,)], "b string").select(bodies.read(F.col("b")).alias("q")).first().q
    assert [(f.id, f.kind, f.width) for f in q.figures[:2]] == [("a.png", "bitmap", "3cm"), ("b.png", "bitmap", r"0.4\linewidth")]
    assert len(q.figures) == 3 and q.figures[2].kind == "tikz" and q.figures[2].id.startswith("tikz-") and q.figures[2].tikz == tikz


def test_trees_in_variant(spark):
    rows = [*texts(300, 2), None, "", "a" * 200_000, r"\begin{a}x\end{a}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", bodies.source(bodies.tree(F.col("t"))).alias("back"), F.try_variant_get(bodies.tree(F.col("t")), "$[0].name", "string").alias("name")).collect()
    assert all(r.back == (rows[r.i] or "") for r in got) and {r.i: r.name for r in got}[len(rows) - 1] == "a"
    shown = df.filter("i >= 300").select(bodies.visible(F.col("t")), bodies.leaks(F.col("t"))).collect()
    assert [len(r[0]) for r in shown] == [0, 0, 200_000, 1] and all(r[1] == [] for r in shown)


def test_batches_are_parsed_in_pieces(spark):
    import pyarrow as pa

    from quarry.operators import bodies

    texts = [None, "", "a" * bodies.PIECE_BYTES, *(["b" * 1000, None] * 1000), "c" * (3 * bodies.PIECE_BYTES), ""]
    cut = list(bodies.pieces(pa.array(texts)))
    assert [t for piece in cut for t in piece.to_pylist()] == texts and len(cut) >= 6
    assert all(sum(len(t or "") for t in piece.to_pylist()[1:]) <= bodies.PIECE_BYTES for piece in cut)
    assert list(bodies.pieces(pa.array([], pa.string()))) == []
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    got = rows.select("n", bodies.source(bodies.tree("t")).alias("s"), bodies.visible("t").alias("v")).collect()
    assert {r.n: r.s for r in got} == {n: t or "" for n, t in enumerate(texts)}


def test_bodies_of_odd_texts_are_read_as_sql_says(spark, tmp_path):
    """Empty and blank texts, ends of lines before a slot, white space that is not ASCII, open formulas."""
    duckdb = pytest.importorskip("duckdb")
    from quarry.plans import catalog, catalog_texts  # noqa: F401

    texts = [None, "", " ", "\n", " \n\t", "a\n", "a\n\n\n", "a\n  ", "a \t", "\r\n a", "\u3000a\u3000", "\xa0", "\u2028a\x0b", "a\n   b\n\n \n c\n\t", "a$$$\n", "$$$", "$$$ a\n$$$ b", "[a\n", "{a\n", "a\\\n", "f", "\fa\f\n"]
    rows = [(6 * i + k, t, f"s{i}" if i % 4 else None, "en") for i, t in enumerate(texts) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(catalog.SQL["parsed_bodies"])
    columns = [c[0] for c in got.description]
    found = catalog.QUERIES["parsed_bodies"](spark, str(tmp_path)).select(*columns).collect()
    assert {tuple(r) for r in found} == set(got.fetchall()) and len(found) == len(rows)
