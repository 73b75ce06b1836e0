"""Exact duplicates of items and what near ones are told by: normalised text, fingerprints, critical tokens, verdicts, overlaps.  The search is in near.py."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import let

THRESHOLD, TOP, STRICT = 0.80, 3, 0.95
SAME, SUSPECT, NEW, VARIANT = "并入", "疑似", "新建", "变式"

# Fixed values, in the order in which they are tried: words and symbols that make another item of the same text.
CRITICAL_WORDS = (
    "单调递增 单调递减 单调不减 单调不增 递增 递减 增函数 减函数 至少一个 至多一个 有且仅有 有且只有 至少 至多 "
    "任意 任一 所有 每个 存在 不存在 唯一 正数 负数 非正 非负 为正 为负 整数 自然数 有理数 "
    "不小于 不大于 不超过 不少于 大于 小于 等于 不等于 大于等于 小于等于 恒成立 有解 无解 充分 必要 充要 "
    "相互独立 互斥 对立 放回 不放回 有放回 无放回 相切 相交 相离 内切 外切 平行 垂直 异面 "
    "并集 交集 补集 子集 真子集 空集 等差数列 等比数列 递增数列 递减数列"
).split()
CRITICAL_SYMBOLS = r"\cup \cap \subset \subseteq \supseteq \supset \varnothing \emptyset \parallel \perp \cong \equiv \geqslant \leqslant \ge \le \neq \pm \mp".split()
CRITICAL = "|".join(CRITICAL_WORDS + [re.escape(s) for s in CRITICAL_SYMBOLS])


def _nested(left: str, right: str, depth: int = 6) -> str:
    """A pattern of a bracketed part with brackets in it, or of all that follows if nothing closes it."""
    inner = ""
    for _ in range(depth):
        inner = rf"{left}(?:[^{left}{right}\\]++|\\[\s\S]{'|' + inner if inner else ''})*+{right}"
    return rf"{inner}|{left}[\s\S]*+"


# Commands that say how a text looks, and what stands for several of one meaning; in the order in which they are replaced.
LAYOUT = r"\left \right \big \Big \bigg \Bigg \quad \qquad \, \; \!".split() + ["\\ "] + r"\nolimits \limits \displaystyle \textstyle".split()
UNIFIED = {r"\dfrac": r"\frac", r"\tfrac": r"\frac", r"\cfrac": r"\frac", r"\leqslant": r"\le", r"\geqslant": r"\ge", r"\cdot": "", r"\times": "", r"\div": "", r"\varnothing": r"\emptyset"}
UNIFIED |= dict.fromkeys(r"\symbfit \symbf \boldsymbol \mathbf \mathrm \text \mbox".split(), "")
SLOT = rf"\\(?:paren|fillin)(?![A-Za-z])[ \t\n]*+(?:{_nested(chr(92) + '[', chr(92) + ']')}|{_nested(chr(92) + '{', chr(92) + '}')})?"


def normalised(text: Column) -> Column:
    """A text without comments, layout commands, white space, dollar signs, braces and punctuation, in lower case; blanks and what they hold become one mark."""
    t = F.coalesce(text, F.lit(""))
    uncommented = lambda s: F.regexp_replace(s, r"(?<!\\)%[^\n]*", "")
    s = uncommented(F.regexp_replace(t, SLOT, "_"))
    s = F.regexp_replace(s, r"[（(]\s*\\quad\s*[）)]", "_")
    for a, b in [*((c, "") for c in LAYOUT), *UNIFIED.items()]:
        s = F.replace(s, F.lit(a), F.lit(b))
    # A text without a backslash has no command and no slot.
    s = F.when(F.contains(t, F.lit("\\")), s).when(F.contains(t, F.lit("%")), uncommented(t)).otherwise(t)
    blank = r"（\s*）|_{2,}|\\underline\{\s*\}"

    s = let(s, lambda s: F.when(s.rlike("[（_]|\\\\underline"), F.regexp_replace(s, blank, "_")).otherwise(s))
    s = let(s, lambda s: F.when(F.contains(s, F.lit("\\\\")), F.replace(s, F.lit("\\\\"), F.lit(""))).otherwise(s))
    return F.lower(F.translate(s, " \t\n\r\f\u000b${}，。、；：？！,.;:?!（）()", ""))


def fingerprint(stem: Column, options: Column | None = None) -> Column:
    parts = F.array(normalised(stem)) if options is None else F.concat(F.array(normalised(stem)), F.transform(options, normalised))
    return F.sha2(F.array_join(parts, "\u0000"), 256)


def content_hash(*columns: str) -> Column:
    """The first 16 hex digits of a hash of the columns with white space collapsed."""
    flat = [F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\\s+", " ")) for c in columns]
    return F.left(F.sha2(F.concat_ws("\u0001", *flat), 256), F.lit(16))


def critical_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CRITICAL), F.lit(0))))


def classify(score: Column) -> Column:
    s = F.round(score, 3)
    return F.when(s == 1.0, SAME).when(s >= THRESHOLD, SUSPECT).otherwise(NEW)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, in bits of one number (no matching has more characters)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    left = full
    for c in b:
        u = left & at.get(c, 0)
        left = ((left + u) | (left - u)) & full
    return len(a) - left.bit_count()


def dice(pairs: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """Dice coefficient of the multisets of character pairs of two columns."""
    def bag(c: str, side: str) -> DataFrame:
        s, chars = F.col(c), F.split(c, "")
        two = F.when(F.length(s) >= 2, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.array_join(F.slice(chars, i, F.lit(2)), ""))).otherwise(F.array().cast("array<string>"))
        return pairs.select(*key, F.explode(two).alias("gram")).groupBy(*key, "gram").agg(F.count("*").alias(side))

    both = bag(a, "_n").join(bag(b, "_m"), [*key, "gram"]).groupBy(*key).agg(F.sum(F.least("_n", "_m")).alias("common"))
    size = F.greatest(F.length(a) - 1, F.lit(0)) + F.greatest(F.length(b) - 1, F.lit(0))
    return pairs.join(both, key, "left").select(*key, F.when(size > 0, 2 * F.coalesce("common", F.lit(0)) / size).otherwise(F.lit(0.0)).alias("dice"))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct elements over the smaller set's size."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(0.0)


def same_pixels(files: DataFrame) -> DataFrame:
    """Groups of files (path, signature, bytes) with the same signature: how many, and the bytes that all but the largest waste."""
    g = files.filter("signature is not null").groupBy("signature").agg(F.count("*").alias("n"), (F.sum("bytes") - F.max("bytes")).alias("waste"), F.min("path").alias("first"))
    return g.filter("n > 1")
