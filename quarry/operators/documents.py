"""Rebuilding records from lines of scanned documents: numbering, anchors, blocks, alignment, folding of pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import pairs

ANCHOR_MIN, ANCHOR_MAX, ALIGN_MIN = 6, 24, 0.22


def lines(pages: DataFrame) -> DataFrame:
    """The non-blank lines of a document's pages (doc, page, text), numbered through: doc, page, line_no, text."""
    each = pages.select("doc", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text")).withColumn("text", F.trim("text")).filter("text <> ''")
    return each.withColumn("line_no", F.row_number().over(W.partitionBy("doc").orderBy("page", "at"))).select("doc", "page", "line_no", "text")


def squeezed(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", ""))


def find_lines(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """For each quote (doc, n, quote) the first line that holds it; quotes are cut to ANCHOR_MAX and too short ones find nothing."""
    q = quotes.withColumn("_q", F.left(squeezed(F.col("quote")), F.lit(ANCHOR_MAX))).filter(F.length("_q") >= ANCHOR_MIN)
    hit = q.join(rows.select("doc", "line_no", squeezed(F.col("text")).alias("_t")), "doc").filter(F.contains("_t", F.col("_q")))
    return quotes.join(hit.groupBy("doc", "n").agg(F.min("line_no").alias("line_no")), ["doc", "n"], "left").drop("quote")


def blocks(starts: DataFrame, rows: DataFrame) -> DataFrame:
    """Line ranges from starts (doc, n, start): each ends before the next begins, the last with its document."""
    last = rows.groupBy("doc").agg(F.max("line_no").alias("_last"))
    w = W.partitionBy("doc").orderBy("start", "n")
    return starts.filter("start is not null").join(last, "doc").withColumn("end", F.coalesce(F.lead("start").over(w) - 1, "_last")).drop("_last")


def answer_heads(rows: DataFrame) -> DataFrame:
    """Lines that head an answer with a number greater than all before; none for a document with fewer than two."""
    n = F.regexp_extract("text", "^\\s*([0-9]{1,3})\\s*[.、．]", 1).try_cast("int")
    heads = rows.withColumn("n", n).filter("n is not null")
    before = W.partitionBy("doc").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    kept = heads.withColumn("_m", F.max("n").over(before)).filter(F.col("_m").isNull() | (F.col("n") > F.col("_m"))).drop("_m")
    return kept.withColumn("_k", F.count("*").over(W.partitionBy("doc"))).filter("_k >= 2").select("doc", "n", F.col("line_no").alias("start"))


def split_page(pages: DataFrame, window: int = 2) -> DataFrame:
    """The page where a document's answers begin: the best score of marks on the page, if it is 3 or more; the first of equals."""
    text = F.coalesce("text", F.lit(""))
    before = F.coalesce(F.lag("text").over(W.partitionBy("doc").orderBy("page")), F.lit(""))
    tags = lambda c: F.size(F.regexp_extract_all(c, F.lit("【(?:解析|答案|详解)】|(?i:answer)"), F.lit(0)))
    score = (
        F.when(text.rlike("参考答案|(?i:answer key)"), 3).otherwise(0)
        + F.when((tags(text) >= window) & (tags(before) == 0), 3).otherwise(0)
        + F.when(text.rlike("<table"), 2).otherwise(0)
    )
    best = pages.withColumn("score", score).groupBy("doc").agg(F.max("score").alias("score"), F.max_by("page", F.struct("score", (-F.col("page")).alias("p"))).alias("page"))
    return best.select("doc", F.when(F.col("score") >= 3, F.col("page")).alias("answers_from"), "score")


def expand_sections(sections: DataFrame) -> DataFrame:
    """(doc, ord, type, n) to (doc, number, type): the numbers that each section's count covers, one section after the other."""
    before = F.coalesce(F.sum("n").over(W.partitionBy("doc").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sections.withColumn("_before", before).filter("n > 0")
    return placed.select("doc", "type", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("n"))).alias("number"))


def fold_pages(parts: DataFrame) -> DataFrame:
    """Parts of an item found on several pages (item, page, answer, solution): the first answer, the longest stem, solutions joined in order."""
    kept = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c))
    ordered = F.array_sort(F.collect_list(F.struct("page", "solution")))
    return parts.groupBy("item").agg(
        F.min_by(kept("answer"), F.when(kept("answer").isNotNull(), F.col("page"))).alias("answer"),
        F.max_by("stem", F.struct(F.length("stem"), (-F.col("page")).alias("p"))).alias("stem"),
        F.array_join(F.filter(F.transform(ordered, lambda x: x["solution"]), lambda s: F.trim(F.coalesce(s, F.lit(""))) != ""), "\n").alias("solution"),
    )


def _chain(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of one document's pairs (q, a, score) the chain of the greatest total in which both places rise; of equal ones that of the earlier last pair."""
    rows = pairs.sort_values(["q", "a"], ignore_index=True)
    a, score = rows["a"].to_numpy(), rows["score"].to_numpy()
    total, before = score.copy(), np.full(len(rows), -1)
    first = rows.groupby("q").ngroup().to_numpy()
    starts = np.searchsorted(first, first)  # pairs of lesser questions stand before this one
    for k in range(len(rows)):
        ahead = np.flatnonzero(a[: starts[k]] < a[k])
        if len(ahead):
            best = ahead[np.argmax(total[ahead])]
            total[k], before[k] = total[best] + score[k], best
    keep, k = [], int(np.argmax(total))
    while k >= 0:
        keep.append(k)
        k = before[k]
    return rows.iloc[keep[::-1]]


def align(rows: DataFrame) -> DataFrame:
    """(doc, side 'q' or 'a', at, text) to pairs (doc, q, a, score) in order.

    Candidates are pairs that share character pairs, scored by the share of the smaller
    side's; they come from a join, so only a document's candidate pairs meet in a task.
    """
    text = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    sides = rows.select("doc", "side", F.col("at").cast("int").alias("at"), F.array_distinct(pairs(text)).alias("grams"))
    grams = sides.select("doc", "side", "at", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    q = grams.filter("side = 'q'").select("doc", "gram", F.col("at").alias("q"), F.col("n").alias("nq"))
    a = grams.filter("side = 'a'").select("doc", "gram", F.col("at").alias("a"), F.col("n").alias("na"))
    shared = q.join(a, ["doc", "gram"]).groupBy("doc", "q", "a").agg(F.count("*").alias("n"), F.min(F.least("nq", "na")).alias("least"))
    candidates = shared.select("doc", "q", "a", F.round(F.col("n") / F.col("least"), 6).alias("score")).filter(F.col("score") >= ALIGN_MIN)
    return candidates.groupBy("doc").applyInPandas(_chain, candidates.schema)


def _numbered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lines that begin an item: a number that goes on from the last, by three at most."""
    last, out = 0, []
    for r in pdf.sort_values("line_no").itertuples():
        n = r.n
        if n == n and n is not None and last < n <= last + 3:
            last = int(n)
            out.append((r.doc, last, int(r.line_no)))
    return pd.DataFrame(out, columns=["doc", "n", "start"])


def item_starts(rows: DataFrame) -> DataFrame:
    """Starts of numbered items (doc, n, start); what counts depends on the item before, so a document is read in order."""
    n = F.regexp_extract("text", "^\\s*([0-9]{1,3})\\s*[.、．]", 1).try_cast("double")
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.withColumn("n", n).filter("n is not null").select("doc", "line_no", "n").groupBy("doc").applyInPandas(_numbered, f"doc {kind}, n int, start int")


# What marks an option, a blank, and the place for a choice.
OPTION = r"(?<![A-Za-z0-9])([ABCD])\s*[.．、]\s*"
BLANK = r"\\fillin|＿{2,}|_{3,}|（\s{2,}）|\(\s{2,}\)"
CHOICE_PLACE = r"[（(]\s{0,2}[）)]\s*[。.]?\s*$"


def split_options(block: Column) -> Column:
    """A block of lines as (stem, options (label, text)): a line with two labels or more is options from the first label on, a line that begins with one is an option; the last text of a label counts."""
    each = F.transform(F.split(F.coalesce(block, F.lit("")), "\n"), lambda ln: F.struct(ln.alias("line"), F.regexp_extract_all(ln, F.lit(OPTION), F.lit(1)).alias("labels"), F.split(ln, OPTION, -1).alias("parts")))
    several = lambda x: F.size(x["labels"]) >= 2
    optional = lambda x: several(x) | ((F.size(x["labels"]) == 1) & (F.length(F.element_at(x["parts"], 1)) <= 2))
    kept = F.transform(each, lambda x: F.when(several(x), F.nullif(F.trim(F.element_at(x["parts"], 1)), F.lit(""))).when(~optional(x), x["line"]))
    named = lambda x: F.zip_with(x["labels"], F.slice(x["parts"], 2, F.size(x["labels"])), lambda a, b: F.struct(a.alias("label"), F.trim(b).alias("text")))
    found = F.flatten(F.transform(F.filter(each, optional), named))
    last = F.filter(found, lambda o, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda p: p["label"] == o["label"]))
    return F.struct(F.trim(F.array_join(F.array_compact(kept), "\n"), F.lit(" \t\r\n")).alias("stem"), F.array_sort(last).alias("options"))


def classify_type(stem: Column, options: Column, answer: Column, hint: Column | None = None) -> Column:
    """An item's type by its text; the hint decides only where there are options and no answer."""
    s, a = F.coalesce(stem, F.lit("")), F.trim(F.coalesce(answer, F.lit("")))
    choice = (F.size(options) >= 3) | (F.regexp_count(s, F.lit(OPTION)) >= 3)
    several = a.rlike("^[A-D]{2,4}$") | (~a.rlike("^[A-D]$") & (F.coalesce(hint, F.lit("")) == "multi_choice") if hint is not None else F.lit(False))
    return (
        F.when(choice, F.when(several, "multi_choice").otherwise("single_choice"))
        .when(s.rlike(BLANK), "fill_in_blank")
        .when(s.rlike(CHOICE_PLACE), "single_choice")
        .otherwise("detailed_answer")
    )


def tag_noise(texts: DataFrame, key: str, text: str, known: DataFrame, pattern: str) -> DataFrame:
    """New snippets that match a pattern: (snippet, hash, n, first_key), without those whose hash is known."""
    each = texts.select(key, F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))).alias("snippet"))
    found = each.groupBy("snippet").agg(F.count("*").alias("n"), F.min(key).alias("first_key")).withColumn("hash", F.sha1("snippet"))
    return found.join(known.select("hash"), "hash", "left_anti").select("snippet", "hash", "n", "first_key")
