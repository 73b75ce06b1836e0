r"""Checks of a text that need its tree: what a reader would see of it, and what stands inside and outside its formulas."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import latex
from quarry.operators.bodies import _texts

# Bars by kind, what a sentence may end in before its stop, and ideographs.
SINGLE, DOUBLE = r"| \vert \lvert \rvert".split(), r"\| \Vert \lVert \rVert".split()
ENDS = "$)）】」』”"
IDEOGRAPH = re.compile(r"[一-鿿]")


def _outside(nodes: list[dict]) -> Iterator[str]:
    """The text outside formulas, each formula as one dollar sign."""
    for n in nodes:
        if n["k"] == "text":
            yield n["s"]
        elif n["k"] == "math" or (n["k"] == "env" and n["name"] in latex.DISPLAYED + latex.FORMULAS + latex.PICTURES):
            yield "$"
        elif n["k"] == "cmd":
            yield from _outside([x for a in n["args"] for x in a["c"]])
        else:
            yield from _outside(n["c"])


def western_stop(nodes: list[dict]) -> bool:
    """A full stop that ends a sentence: before white space or the end and after no digit or stop, or between an ideograph, a formula or a closing bracket and an ideograph."""
    text = "".join(_outside(nodes))
    at = text.find(".")
    while at >= 0:
        before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
        if (not after or after.isspace()) and not (before.isdigit() or before == "."):
            return True
        if IDEOGRAPH.match(after) and before and (before in ENDS or IDEOGRAPH.match(before)):
            return True
        at = text.find(".", at + 1)
    return False


def slot_in_formula(nodes: list[dict]) -> bool:
    """A place for an answer right inside a line's formula."""
    formulas = (n for n in latex.walk(nodes) if n["k"] == "math" and n["open"] in ("$", r"\(") and n["close"])
    return any(x["k"] == "cmd" and x["name"] in ("fillin", "paren") for n in formulas for x in n["c"])


def unlike_bars(nodes: list[dict]) -> bool:
    r"""A \left bar whose \right bar is of the other kind; other delimiters count for nothing."""
    stack: list[bool] = []
    for n in latex.walk(nodes):
        if n["k"] == "cmd" and n["name"] in ("left", "right"):
            bar = n["s"][len(n["name"]) + 1 :].strip()
            if bar in SINGLE or bar in DOUBLE:
                if n["name"] == "left":
                    stack.append(bar in DOUBLE)
                elif stack and stack.pop() != (bar in DOUBLE):
                    return True
    return False


CHECKS = {
    "render_leak": lambda nodes: bool(latex.leaks(latex.blocks(nodes))),
    "sentence_period": western_stop,
    "blank_in_formula": slot_in_formula,
    "bar_pair": unlike_bars,
}


def failed(text: str) -> list[str]:
    nodes = latex.parse(text)
    return [name for name, check in CHECKS.items() if check(nodes)]


_failed = _texts(lambda t: json.dumps(failed(t)))


def faults(text: Column) -> Column:
    """The names of the checks that a text fails, in the order of CHECKS."""
    return F.from_json(_failed(text), "array<string>")
