"""Small text functions as expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The numerals from nought to nine; tokens by character, and what stands beside them.
NUMERALS = "〇一二三四五六七八九"
TOKENS_A_CHARACTER, TOKENS_BESIDE = 0.65, 200
# Characters below this, and tables of so many pairs, are counted in an array.
IDEOGRAPHS_END, FEW_PAIRS = 0xA000, 8192


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; a lambda would compute an outer expression again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pairs(c: Column) -> Column:
    """The pairs of neighbouring characters of a text."""

    def joined(chars: Column) -> Column:
        n = F.greatest(F.lit(0), F.size(chars) - 1)
        return F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda x, y: F.concat(x, y))

    return let(F.split(c, ""), joined)


def one_line(c: Column, most: int = 220) -> Column:
    """White space collapsed; what is longer than most ends in an ellipsis."""
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n\f\u000b")), r"\s+", " ")
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.left(s, F.lit(most)), F.lit("…")))


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) * F.lit(TOKENS_A_CHARACTER)).cast("int") + TOKENS_BESIDE


def numeral(c: Column) -> Column:
    """A numeral of up to two digits around the sign for ten, as a number; null for anything else."""
    digit = lambda s: F.when(F.length(s) == 1, F.nullif(F.instr(F.lit(NUMERALS), s), F.lit(0)) - 1)
    tens, ones = F.regexp_extract(c, "^(.?)十(.?)$", 1), F.regexp_extract(c, "^(.?)十(.?)$", 2)
    some = lambda s, empty: F.when(s == "", empty).otherwise(digit(s))
    return F.when(c.rlike("^.?十.?$"), some(tens, 1) * 10 + some(ones, 0)).otherwise(digit(c)).cast("int")


def letters_only(c: Column) -> Column:
    """A text's ideographs, Latin letters and digits, without LaTeX commands."""
    t = F.coalesce(c, F.lit(""))
    bare = F.when(F.contains(t, F.lit("\\")), F.regexp_replace(t, r"\\[A-Za-z]+\*?", " ")).otherwise(t)
    return F.regexp_replace(bare, r"[^\x{4e00}-\x{9fff}A-Za-z0-9]++", "")


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique((c[:-1] << np.uint64(32)) | c[1:], return_counts=True)


def _common_pairs(x: str, y: str) -> int:
    """Pairs of neighbouring characters that two texts share, counted with repetition."""
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
    seen = np.zeros(int(max(a.max(), b.max())) + 1, bool) if max(a.max(), b.max()) < IDEOGRAPHS_END else None
    if seen is not None:
        seen[a] = seen[b] = True
        n = int(seen.sum())
        if n * n <= 4 * (len(a) + len(b)) + FEW_PAIRS:  # a table of all pairs is not much larger than the texts: no sorting
            place = np.cumsum(seen) - 1
            p, q = (np.bincount(place[c[:-1]] * n + place[c[1:]], minlength=n * n) for c in (a, b))
            return int(np.minimum(p, q).sum())
    (p, n), (q, m) = _counted(x), _counted(y)
    _, k, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    return int(np.minimum(n[k], m[j]).sum())


@F.pandas_udf(T.DoubleType())
def dice_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dice coefficient of two texts' pairs of neighbouring characters, counted with repetition; 0 if one has none."""
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        if x and y and len(x) > 1 and len(y) > 1:
            out[i] = 1.0 if x == y else 2 * _common_pairs(x, y) / (len(x) + len(y) - 2)
    return pd.Series(out)


# What an answer's writing may have that says nothing, and marks of one meaning.
SILENT = r"\left \right \! \, \; \: \quad \qquad \text \mbox \displaystyle $".split()
ALIKE = {r"\dfrac": r"\frac", r"\tfrac": r"\frac", "（": "(", "）": ")", "，": ",", "、": ",", "；": ";", "：": ":", "。": "."}


def canonical_answer(c: Column) -> Column:
    """An answer read command by command and character by character: each is left out, replaced by what it stands for, or kept."""
    known = F.create_map(*(F.lit(x) for pair in ({s: "" for s in SILENT} | ALIKE).items() for x in pair))
    atoms = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?s)\\[A-Za-z]+|\\.|[^\s\x{3000}]"), F.lit(0))
    return F.array_join(F.transform(atoms, lambda a: F.coalesce(F.try_element_at(known, a), a)), "")


def answers_conflict(one: Column, other: Column) -> Column:
    """Whether two answers say different things.  No answer, an answer that points to the solution, and option letters beside another kind of answer contradict nothing."""
    sides = F.array(canonical_answer(one), canonical_answer(other))

    def differ(s: Column) -> Column:
        silent = F.exists(s, lambda a: (a == "") | F.contains(a, F.lit("见解析")))
        kinds = F.array_distinct(F.transform(s, lambda a: a.rlike("^[A-F]+$")))
        return ~silent & (F.size(F.array_distinct(s)) == 2) & (F.size(kinds) == 1)

    return let(sides, differ)
