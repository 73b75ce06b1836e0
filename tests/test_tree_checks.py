"""Checks on trees, by hand."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import tree_checks

CASES = {
    r"见 $x$。\textbf{粗} \fillin[1] \ldots": [],
    r"a \foo b": ["render_leak"],
    r"\begin{tabular}{c}\foo\end{tabular}": ["render_leak"],
    r"\begin{enumerate}\item \bar x\end{enumerate}": ["render_leak"],
    r"$\foo$": [],
    "所以成立.": ["sentence_period"],
    "概率为 $x$.若": ["sentence_period"],
    "长 3.14 米... 1.": [],
    "A.第一象限": [],
    "$x. $": [],
    r"$y=\fillin$": ["blank_in_formula"],
    r"$\frac{\fillin}{2}$ \[\fillin\]": [],
    r"$\left\|x\right|$": ["bar_pair"],
    r"$\left|a\left\|b\right\|\right|$": [],
    r"$\left[0,1\right)$ \right|": [],
    r"$\left\lvert x\right\rVert$": ["bar_pair"],
    "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_checks(text):
    assert tree_checks.failed(text) == CASES[text]


def test_as_a_column(spark):
    rows = spark.createDataFrame([(t,) for t in [*CASES, None]], "t string").select("t", tree_checks.faults(F.col("t"))).collect()
    assert {r[0]: r[1] for r in rows} == CASES | {None: []}
