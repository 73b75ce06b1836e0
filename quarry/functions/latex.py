r"""LaTeX texts as trees: one pass over tokens with a stack, and every character kept.

A node is a dict with a kind ``k``:

- ``text``: ``s``
- ``math``, ``group``, ``env``: ``open``, ``close`` (empty if nothing closes it), children ``c``; an environment has its ``name``
- ``cmd``: ``name``, ``s`` as written, ``args``: groups, each with the ``gap`` before it

``source(parse(x)) == x`` for every text.  A closing mark closes the innermost open mark of
its kind inside the same environment (a square bracket: inside the same braces, and brackets
in between pair up), and what is open in between stays unclosed; one that closes nothing is
text.  A dollar sign or square bracket that is never closed is text, its
children move up.  Marks deeper than ``DEPTH`` are text.  Time is linear in the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

DEPTH = 64
# Environments and commands by what becomes of them.
LISTS = "enumerate itemize description".split()
TABLES = "tabular tabularx longtable".split()
BOXES = "center flushleft flushright minipage quote verse multicols figure table subfigure adjustbox".split()
PICTURES = "tikzpicture pgfpicture circuitikz axis".split()
DISPLAYED = "equation equation* align align* gather gather* multline multline* eqnarray eqnarray* displaymath alignat alignat* flalign flalign*".split()
FORMULAS = "cases matrix pmatrix bmatrix vmatrix Vmatrix smallmatrix array aligned alignedat gathered subarray split dcases rcases".split()
SILENT = "label index tag vspace hspace cline caption nonumber notag hfill hfil pageref ref cite phantom hphantom vphantom smash rlap llap mathstrut strut".split()
SILENT += "noindent centering small large Large LARGE huge Huge footnotesize scriptsize normalsize tiny bfseries itshape rmfamily sffamily ttfamily rm bf it tt par hline toprule midrule".split()
SILENT += "bottomrule hdashline left right displaystyle textstyle scriptstyle limits nolimits arraystretch bigskip medskip smallskip clearpage newpage".split()
KEPT = "textbf textit textrm textsf texttt textnormal emph mbox hbox fbox underline mathrm mathbf mathit mathsf mathtt operatorname text ensuremath textsuperscript textsubscript".split()
KEPT += "bm boldsymbol vec overline widehat widetilde makebox framebox raisebox adjustbox rotatebox parbox resizebox scalebox".split()
SIGNS = {"textasciitilde": "~", "textbackslash": "\\", "textasciicircum": "^", "textbar": "|", "textless": "<", "textgreater": ">", "textbraceleft": "{", "textbraceright": "}", "textunderscore": "_",
         "ldots": "…", "dots": "…", "textellipsis": "…", "textquotedblleft": "“", "textquotedblright": "”", "textquoteleft": "‘", "textquoteright": "’", "textendash": "–", "textemdash": "—", "textdegree": "°"}
SPACES = "quad qquad".split()
BREAKS = ["newline"]

_TOKEN = re.compile(
    r"\\(?:begin|end)\{[A-Za-z]+\*?\}|\\(?:left|right|middle|[bB]igg?[lrm]?)(?![A-Za-z])[ \t]*(?:\\[A-Za-z]+|\\.|[^\\\s$])?|\\[A-Za-z]+\*?|\\[\s\S]|\\|\$\$?|[{}\[\]]|[^\\${}\[\]]+"
)
_CLOSES = {"$": "$", "$$": "$$", r"\)": r"\(", r"\]": r"\[", "}": "{", "]": "["}
_MATH = {"$", "$$", r"\(", r"\["}
#: What is text if nothing closes it.
_LOOSE = {"$", "$$", "["}


class _Frame:
    __slots__ = ("arg", "bracket", "inner", "kind", "node", "open", "pending")

    def __init__(self, kind: str, node: dict, arg: dict | None = None, around: _Frame | None = None):
        self.kind, self.node, self.arg = kind, node, arg
        # The argument in square brackets that a closing one here belongs to, and the plain brackets open in it.
        self.bracket = self if kind == "[" else None if kind in ("{", "env") else around and around.bracket
        self.inner = 0
        self.pending: list[str] = []  # text that is not a node yet
        self.open: Counter = Counter()  # marks open above this one, as far as the next environment

    def text(self, s: str) -> None:
        self.pending.append(s)

    def add(self, *nodes: dict) -> None:
        if self.pending:
            self.node["c"].append({"k": "text", "s": "".join(self.pending)})
            self.pending = []
        self.node["c"].extend(nodes)


class _Parser:
    def __init__(self):
        self.stack = [_Frame("env", {"c": []})]
        self.scopes = [self.stack[0]]  # the open environments
        self.names: Counter = Counter()
        self.deep: Counter = Counter()
        self.command: dict | None = None  # may still take an argument
        self.gap = ""

    def read(self, text: str) -> list[dict]:
        for m in _TOKEN.finditer(text):
            self.token(m[0])
        self.settle()
        while len(self.stack) > 1:
            self.pop("")
        self.stack[0].add()
        return self.stack[0].node["c"]

    def settle(self) -> None:
        """No argument comes any more."""
        self.command = None
        if self.gap:
            self.stack[-1].text(self.gap)
            self.gap = ""

    def token(self, t: str) -> None:
        if self.command is not None and t[0] in " \t\n" and not self.gap:
            rest = t.lstrip(" \t\n")
            lead = t[: len(t) - len(rest)]
            if lead.count("\n") < 2:
                self.gap = lead
                if not rest:
                    return
                t = rest
        command = self.command if t in ("{", "[") else None
        if command is None:
            self.settle()
        top = self.stack[-1]
        if t.startswith(r"\begin{"):
            self.push("env", {"k": "env", "name": t[7:-1], "open": t, "close": "", "c": []})
        elif t.startswith(r"\end{"):
            self.end(t)
        elif t == "$$" and top.kind == "$":
            self.close("$")
            self.token("$")
        elif t in ("$", "$$") and top.kind == t:
            self.close(t)
        elif t in _MATH:
            self.push(t, {"k": "math", "open": t, "close": "", "c": []})
        elif t == "{" or (t == "[" and command is not None):
            self.push(t, {"k": "group", "open": t, "close": "", "c": []}, command)
        elif t in (r"\)", r"\]", "}", "]"):
            self.close(t)
        elif t[0] == "\\" and len(t) > 1 and (t[1].isalpha() or t[1] in "\\,;:!"):
            name = re.match(r"\\([A-Za-z]+|.)", t)[1]
            node = {"k": "cmd", "name": name, "s": t, "args": []}
            top.add(node)
            if name.isalpha() and t[-1].isalpha() | (t[-1] == "*"):
                self.command = node
        else:
            if t == "[" and top.bracket:
                top.bracket.inner += 1
            top.text(t)

    def push(self, kind: str, node: dict, arg: dict | None = None) -> None:
        key = node.get("name", kind)
        if len(self.stack) >= DEPTH:
            self.settle()
            self.deep[key] += 1
            self.stack[-1].text(node["open"])
            return
        if arg is not None:
            node["gap"], self.gap = self.gap, ""
        self.command = None
        if self.gap:
            self.settle()
        frame = _Frame(kind, node, arg, self.stack[-1])
        self.stack.append(frame)
        if kind == "env":
            self.scopes.append(frame)
            self.names[key] += 1
        else:
            self.scopes[-1].open[kind] += 1

    def pop(self, closing: str) -> None:
        """Takes the innermost frame into the one around it."""
        frame = self.stack.pop()
        frame.add()
        if frame.kind == "env":
            self.scopes.pop()
            self.names[frame.node["name"]] -= 1
        else:
            self.scopes[-1].open[frame.kind] -= 1
        node, around = frame.node, self.stack[-1]
        node["close"] = closing
        if not closing and frame.kind in _LOOSE:
            around.text(node.get("gap", "") + node["open"])
            around.add(*node["c"])
        elif frame.arg is not None:
            frame.arg["args"].append(node)
            if closing:
                self.command = frame.arg
        else:
            around.add(node)

    def close(self, t: str) -> None:
        kind = _CLOSES[t]
        bracket = self.stack[-1].bracket
        if self.deep[kind]:
            self.deep[kind] -= 1
            self.stack[-1].text(t)
        elif kind == "[" and bracket and bracket.inner:
            bracket.inner -= 1
            self.stack[-1].text(t)
        elif not (bracket if kind == "[" else self.scopes[-1].open[kind]):
            self.stack[-1].text(t)
        else:
            while self.stack[-1] is not bracket if kind == "[" else self.stack[-1].kind != kind:
                self.pop("")
                self.command = None
            self.pop(t)

    def end(self, t: str) -> None:
        name = t[5:-1]
        if self.deep[name]:
            self.deep[name] -= 1
            self.stack[-1].text(t)
        elif not self.names[name]:
            self.stack[-1].text(t)
        else:
            while self.stack[-1].node.get("name") != name:
                self.pop("")
                self.command = None
            self.pop(t)


def parse(text: str | None) -> list[dict]:
    return _Parser().read(text or "")


def source(nodes: list[dict]) -> str:
    """The text that nodes stand for."""
    out = []
    for n in nodes:
        if n["k"] == "text":
            out.append(n["s"])
        elif n["k"] == "cmd":
            out.append(n["s"] + "".join(a.get("gap", "") + source([a]) for a in n["args"]))
        else:
            out.append(n["open"] + source(n["c"]) + n["close"])
    return "".join(out)


def walk(nodes: list[dict], into_math: bool = True) -> Iterator[dict]:
    """All nodes in the order of the text, arguments after their command."""
    for n in nodes:
        yield n
        if n["k"] == "cmd":
            yield from walk(n["args"], into_math)
        elif n["k"] != "text" and (into_math or n["k"] != "math"):
            yield from walk(n["c"], into_math)


# --- blocks ------------------------------------------------------------------------


def argument(node: dict, opening: str, last: bool = False) -> str | None:
    """A command's first (or last) argument in braces or square brackets, as written."""
    found = [source(a["c"]) for a in node["args"] if a["open"] == opening]
    return found[-1 if last else 0] if found else None


def _width(option: str | None) -> str:
    share = re.search(r"width\s*=\s*([\d.]+)\s*\\(?:line|text)?width", option or "")
    length = re.search(r"width\s*=\s*([\d.]+)\s*(cm|mm|in|pt)", option or "")
    if share:
        return f"{max(5, min(100, round(float(share[1]) * 100)))}%"
    if length:
        centimetres = float(length[1]) * {"cm": 1, "mm": 0.1, "in": 2.54, "pt": 1 / 28.45}[length[2]]
        return f"{max(5, min(100, round(centimetres / 15 * 100)))}%"
    return "45%"


def inlines(nodes: list[dict]) -> list[dict]:
    """What stands in a line: s(tring), m(ath), fig, blank, paren, br, sp and raw, a command that nobody knows."""
    out: list[dict] = []
    for n in nodes:
        if n["k"] == "text":
            s = re.sub(r"(?<!\\)%[^\n]*", "", n["s"])
            out.append({"t": "s", "s": re.sub(r"\\([%&_#$ {}])", r"\1", re.sub(r"\\[-/]", "", s))})
        elif n["k"] == "math":
            out += _formula(n["c"], n["open"] in ("$$", r"\["))
        elif n["k"] == "group":
            out += inlines(n["c"])
        elif n["k"] == "env":
            out.append({"t": "m", "s": source([n]), "display": n["name"] in DISPLAYED} if n["name"] in DISPLAYED + FORMULAS else {"t": "raw", "s": source([n])})
        elif n["name"] in ("fillin", "paren"):
            out.append({"t": "blank" if n["name"] == "fillin" else "paren"})
        elif n["name"] == "includegraphics":
            out.append({"t": "fig", "id": (argument(n, "{") or "").strip(), "width": _width(argument(n, "["))})
        elif n["name"] in SIGNS:
            out += [{"t": "s", "s": SIGNS[n["name"]]}, *(i for a in n["args"] for i in inlines(a["c"]))]
        elif n["name"] in SPACES or n["name"] in BREAKS or n["name"] == "\\":
            out.append({"t": "sp" if n["name"] in SPACES else "br"})
        elif n["name"] in KEPT:
            kept = [a for a in n["args"] if a["open"] == "{"][-1:]
            out += [i for a in kept for i in inlines(a["c"])]
        elif n["name"] not in SILENT and n["name"].isalpha():
            out.append({"t": "raw", "s": source([n])})
    return out


def _formula(nodes: list[dict], display: bool) -> list[dict]:
    """A formula, parted where a slot stands in it."""
    out, held = [], []
    for n in [*nodes, {"k": "cmd", "name": "fillin"}]:
        if n["k"] == "cmd" and n["name"] in ("fillin", "paren"):
            tex = source(held).strip()
            if tex:
                out.append({"t": "m", "s": tex, "display": display})
            out.append({"t": "blank" if n["name"] == "fillin" else "paren"})
            held = []
        else:
            held.append(n)
    return out[:-1]


def _split(nodes: list[dict], at) -> list[list[dict]]:
    parts: list[list[dict]] = [[]]
    for n in nodes:
        if at(n):
            parts.append([])
        else:
            parts[-1].append(n)
    return parts


def _cells(row: list[dict]) -> list[list[dict]]:
    cells: list[list[dict]] = [[]]
    for n in row:
        pieces = re.split(r"(?<!\\)&", n["s"]) if n["k"] == "text" else [n]
        for i, p in enumerate(pieces):
            if i:
                cells.append([])
            cells[-1].append({"k": "text", "s": p} if isinstance(p, str) else p)
    return cells


def blocks(nodes: list[dict]) -> list[dict]:
    """Paragraphs, formulas, lists, tables, boxes, figures and raw environments."""
    out: list[dict] = []
    line: list[dict] = []

    def end_line() -> None:
        found = [i for i in inlines(line) if i["t"] != "s" or i["s"].strip()]
        line.clear()
        if len(found) == 1 and found[0]["t"] == "fig":
            out.append(found[0])
        elif found:
            out.append({"t": "p", "in": found})

    for n in nodes:
        if n["k"] == "text":
            for i, part in enumerate(re.split(r"\n[ \t]*\n\s*", n["s"])):
                if i:
                    end_line()
                line.append({"k": "text", "s": part})
            continue
        name = n.get("name") if n["k"] == "env" else None
        slots = any(x["k"] == "cmd" and x["name"] in ("fillin", "paren") for x in n.get("c", []))
        if name is None and not (n["k"] == "math" and n["open"] in ("$$", r"\[") and not slots):
            line.append(n)
            continue
        if name in FORMULAS:
            line.append(n)
            continue
        end_line()
        if name is None or name in DISPLAYED:
            out.append({"t": "math", "tex": source(n["c"]).strip(), "display": True})
        elif name in LISTS:
            items = _split(n["c"], lambda x: x["k"] == "cmd" and x["name"] == "item")[1:]
            out.append({"t": "list", "ordered": name == "enumerate", "items": [blocks(i) for i in items]})
        elif name in TABLES:
            body = [x for x in n["c"] if not (x["k"] == "cmd" and x["name"] in SILENT)]
            body = body[next((i + 1 for i, x in enumerate(body) if x["k"] == "group" and x["open"] == "{"), 0) :]
            rows = [r for r in _split(body, lambda x: x["k"] == "cmd" and x["name"] == "\\") if source(r).strip()]
            out.append({"t": "table", "rows": [[{"in": inlines(c)} for c in _cells(r)] for r in rows]})
        elif name in PICTURES:
            out.append({"t": "raw", "env": name, "tex": source([n])})
        else:
            out.append({"t": "box", "kind": name, "blocks": blocks(n["c"])})
    end_line()
    return out


def block_text(found: list[dict]) -> str:
    """Blocks as plain text, white space collapsed."""
    shown = {"blank": "____", "paren": "（  ）", "br": " "}

    def line(nodes: list[dict]) -> str:
        return " ".join(i["s"] if "s" in i else shown.get(i["t"], "") for i in nodes)

    def one(b: dict) -> str:
        if b["t"] == "p":
            return line(b["in"])
        if b["t"] == "list":
            return " ".join(one(x) for i in b["items"] for x in i)
        if b["t"] == "table":
            return " ".join(line(c["in"]) for r in b["rows"] for c in r)
        return " ".join(map(one, b["blocks"])) if b["t"] == "box" else b.get("env") or b.get("tex", "")

    return re.sub(r"\s+", " ", " ".join(map(one, found))).strip()


def leaks(found: list[dict]) -> list[str]:
    """Commands that stay visible in a text's blocks."""
    out: list[str] = []
    for b in found:
        for i in b.get("in", []):
            out += re.findall(r"\\[A-Za-z]+", i["s"]) if i["t"] in ("s", "raw") else []
        for more in (*b.get("items", []), b.get("blocks", [])):
            out += leaks(more)
        for row in b.get("rows", []):
            out += leaks([{"in": c["in"]} for c in row])
    return out
