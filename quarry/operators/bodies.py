r"""Bodies of items in LaTeX: trees in VARIANT, items read from them, their visible text and what leaks into it.

Texts are parsed where they lie, one row at a time and in linear time; nothing is shuffled.
A tree is a VARIANT, so a query reads what it needs of it by path.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import latex

# Fixed values of the body format.
ENVIRONMENTS = ("question", "problem")
WIDTH = r"0.4\linewidth"
ITEM = "type string, stem string, options array<struct<label:string,text:string>>, answer string, solution string, figures array<struct<id:string,kind:string,width:string,tikz:string,source:string>>, points double"


#: Texts are parsed in pieces of a batch: a first text, however long, and others of so many bytes in all.
PIECE_BYTES = 1 << 18


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in pieces of about PIECE_BYTES."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.flatnonzero(np.diff(size // PIECE_BYTES, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(texts)]):
        yield texts.slice(a, b - a)


def _texts(make: Callable[[str], str | None]):
    """A string column from a function of one text; a null text is empty.  Results leave piece by piece, so a worker never holds those of a whole batch."""

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for piece in pieces(texts):
                yield pa.array([make(t or "") for t in piece.to_pylist()], pa.string())
            pa.default_memory_pool().release_unused()

    return run


_tree = _texts(lambda t: json.dumps(latex.parse(t), ensure_ascii=False))
_source = _texts(lambda t: latex.source(json.loads(t)) if t else "")
_visible = _texts(lambda t: latex.block_text(latex.blocks(latex.parse(t))))
_blocks = _texts(lambda t: json.dumps(latex.blocks(latex.parse(t)), ensure_ascii=False))
_leaks = _texts(lambda t: json.dumps(latex.leaks(latex.blocks(latex.parse(t)))) if "\\" in t else "[]")


def tree(text: Column) -> Column:
    """The text's tree as VARIANT (see latex.py); null where it is larger than a VARIANT may be."""
    return F.try_parse_json(_tree(text))


def source(tree: Column) -> Column:
    """The text that a tree was made from."""
    return _source(F.to_json(tree))


def blocks(text: Column) -> Column:
    """The text's blocks as VARIANT."""
    return F.try_parse_json(_blocks(text))


def visible(text: Column) -> Column:
    """The text as a reader sees it: blocks as plain text, white space collapsed."""
    return _visible(text)


def leaks(text: Column) -> Column:
    """The commands that a reader would see."""
    return F.from_json(_leaks(text), "array<string>")


#: White space around a part of a body; other blanks, as wide or unbroken ones, belong to the text.
BLANK = " \t\n\r\f"


def _lines(text: str) -> str:
    """No blanks before lines, one empty line between paragraphs."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+", "\n", text))


def _clean(text: str) -> str:
    return _lines(text.strip(BLANK))


def _stem(nodes: list[dict]) -> str:
    """A stem, cleaned; a slot at its end keeps the blank before it, as write() sets it, also where it begins a line."""
    text = latex.source(nodes).rstrip(BLANK)
    slots = [n for n in latex.walk(nodes) if n["k"] == "cmd" and n["name"] == "fillin"]
    slot = " " + latex.source(slots[-1:])
    if not slots or not text.endswith(slot):
        return _clean(text)
    return _lines(text[: -len(slot)].lstrip(BLANK)) + _lines(slot)


def _is(name: str) -> Callable[[dict], bool]:
    return lambda n: n["k"] == "env" and n["name"] == name


def _children(node: dict) -> list[dict]:
    return node.get("c", node.get("args", []))


def _first(nodes: list[dict], want: Callable[[dict], bool]) -> dict | None:
    return next((n for n in latex.walk(nodes) if want(n)), None)


def _without(nodes: list[dict], gone: dict | None) -> list[dict]:
    """nodes without one of the nodes in them, at whatever depth."""
    if gone is None:
        return nodes
    return [n if not _children(n) else n | {"c" if "c" in n else "args": _without(_children(n), gone)} for n in nodes if n is not gone]


def answers(nodes: list[dict], command: str) -> list[str]:
    """What the slots of a command hold, in order."""
    found = (latex.source(a["c"]).strip() for n in latex.walk(nodes) if n["k"] == "cmd" and n["name"] == command for a in n["args"])
    return [a for a in found if a]


def _as_formula(answer: str) -> str:
    """An answer from inside a formula has lost its dollar signs."""
    bare = "\\" in answer and "$" not in answer and not answer.startswith((r"\[", r"\("))
    return f"${answer}$" if bare else answer


def figures(*parts: list[dict]) -> list[dict]:
    """Pictures in the order of the parts, each once: files by name, drawings by the hash of their source; files first."""
    files, drawn = {}, {}
    for nodes in parts:
        for n in latex.walk(nodes):
            if n["k"] == "cmd" and n["name"] == "includegraphics" and (name := (latex.argument(n, "{") or "").strip()):
                width = re.search(r"width\s*=\s*([^,\]]+)", latex.argument(n, "[") or "")
                files.setdefault(name, {"id": name, "kind": "bitmap", "width": width[1].strip() if width else WIDTH, "source": "inline"})
            elif n["k"] == "env" and n["name"] == "tikzpicture" and n["close"]:
                tikz = latex.source([n])
                name = "tikz-" + hashlib.sha256(tikz.encode()).hexdigest()[:12]
                drawn.setdefault(name, {"id": name, "kind": "tikz", "tikz": tikz, "source": "tikz"})
    return [*files.values(), *drawn.values()]


def item(text: str) -> dict | None:
    """The item of a body: its first question or problem; None without one."""
    nodes = latex.parse(text)
    env = _first(nodes, lambda n: n["k"] == "env" and n["name"] in ENVIRONMENTS and n["close"])
    if env is None:
        return None
    body, head = list(env["c"]), ""
    if body and body[0]["k"] == "text" and (m := re.match(r"\[([^\]]*)\]", body[0]["s"])):
        head, body[0] = m[1], {"k": "text", "s": body[0]["s"][m.end() :]}
    inner = _first(body, _is("solution"))
    body = _without(body, inner)
    choices = _first(body, _is("choices"))
    body = _without(body, choices)
    options, right = [], ""
    if choices is not None:
        starts = [n for n in choices["c"] if n["k"] == "cmd" and n["name"] == "item"]
        parts = latex._split(choices["c"], lambda n: any(n is s for s in starts))[1:]
        for i, (mark, part) in enumerate(zip(starts, parts)):
            label = chr(ord("A") + i)
            options.append({"label": label, "text": _clean(latex.source([*mark["args"], *part]))})
            right += label if mark["s"].endswith("*") else ""
    stem, blanks = _clean(latex.source(body)) if options or env["name"] == "problem" else _stem(body), answers(body, "fillin")
    answer = right or (answers(body, "paren") or [""])[-1] or "；".join(map(_as_formula, blanks))
    told = _first(nodes, _is("solution"))
    solution = _clean(latex.source(told["c"])) if told else ""
    said = re.search(r"\\textbf\{答案：\}([^\n]*)", solution)
    if said and not answer:
        answer, solution = said[1].strip(), (solution[: said.start()] + solution[said.end() :]).strip()
    if env["name"] == "problem":
        kind = "detailed_answer"
    elif options:
        kind = "multi_choice" if len(answer) > 1 else "single_choice"
    else:
        kind = "fill_in_blank" if re.search(r"\\fillin(?![a-zA-Z])", stem) else "detailed_answer"
    points = re.search(r"points\s*=\s*([0-9]+(?:\.[0-9]+)?)", head)
    pictures = figures(body, told["c"] if told else [], choices["c"] if choices else [])
    return {"type": kind, "stem": stem, "options": options, "answer": answer, "solution": solution, "figures": pictures, "points": float(points[1]) if points else None}


def _as_json(text: str) -> str | None:
    found = item(text)
    return None if found is None else json.dumps(found, ensure_ascii=False)


_item = _texts(_as_json)


def read(body: Column) -> Column:
    """The item of a body as a struct; null if there is none."""
    return F.from_json(_item(body), ITEM)


def write(kind: Column, stem: Column, options: Column, answer: Column, solution: Column, points: Column) -> Column:
    """A body that read() reads back: options as choices with the right ones starred; the answer of an item without options in a slot of its stem, if it has one."""
    some = lambda c: F.coalesce(c, F.lit(""))
    env = F.when(kind == "detailed_answer", "problem").otherwise("question")
    choices = F.array_join(F.transform(options, lambda o: F.concat(F.when(F.contains(some(answer), o["label"]), r"\item* ").otherwise(r"\item "), some(o["text"]))), "\n")
    listed = F.when(F.size(options) > 0, F.concat(F.lit("\n\\begin{choices}\n"), choices, F.lit("\n\\end{choices}"))).otherwise("")
    slot = F.when((F.size(options) <= 0) & (some(answer) != "") & (kind == "fill_in_blank"), F.concat(F.lit(r" \fillin["), answer, F.lit("]"))).otherwise("")
    head = F.coalesce(F.concat(F.lit("[points="), points.cast("string"), F.lit("]")), F.lit(""))
    end = F.when(some(solution) != "", F.concat(F.lit("\n\\begin{solution}\n"), solution, F.lit("\n\\end{solution}"))).otherwise("")
    return F.concat(F.lit(r"\begin{"), env, F.lit("}"), head, F.lit("\n"), some(stem), slot, listed, F.lit(r"\end{"), env, F.lit("}"), end)
