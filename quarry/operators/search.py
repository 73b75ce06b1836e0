"""Ranking: field-weighted scores, BM25 over an inverted index, sorts and pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.history import _kept
from quarry.operators.model import difficulty_rank
from quarry.operators.predicates import terms

# The weights of the field score.
STEM, STEM_EACH, STEM_MOST, EARLY, EARLY_CHARS = 40, 3, 3, 10, 20
ANSWER, ANSWER_MOST, TITLE, SOURCE, SOLUTION, SOLUTION_MOST, ALL_TERMS = 15, 2, 12, 10, 6, 2, 20
# BM25.
K1, B = 1.2, 0.75
#: Grams of targets, about 100 bytes each, up to which a shortlist broadcasts them.
MOST_BROADCAST = 500_000


def occurrences(text: Column, term: str) -> Column:
    """How often a term stands in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term)))) / len(term)).cast("int")


def field_score(keyword: str) -> Column:
    """Relevance of an item (stem, answer, titles, book, source_label, region, solution) to the terms of a keyword; 0 without terms."""
    words, total, everywhere = terms(keyword), F.lit(0), F.lit(True)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    source_text = F.concat_ws(" ", "book", "source_label", "region")
    for t in words:
        stem, answer, solution = text("stem"), text("answer"), text("solution")
        n, a, s = occurrences(stem, t), occurrences(answer, t), occurrences(solution, t)
        title, source = F.contains(text("titles"), F.lit(t)), F.contains(source_text, F.lit(t))
        early = F.locate(t, F.substring(stem, 1, EARLY_CHARS)) > 0
        total = (
            total
            + F.when(n > 0, STEM + STEM_EACH * F.least(n, F.lit(STEM_MOST)) + F.when(early, EARLY).otherwise(0)).otherwise(0)
            + F.when(a > 0, ANSWER + F.least(a, F.lit(ANSWER_MOST))).otherwise(0)
            + F.when(title, TITLE).otherwise(0)
            + F.when(source, SOURCE).otherwise(0)
            + F.when(s > 0, SOLUTION + F.least(s, F.lit(SOLUTION_MOST))).otherwise(0)
        )
        everywhere = everywhere & ((n > 0) | (a > 0) | (s > 0) | title | source)
    return total + F.when(everywhere, ALL_TERMS).otherwise(0) if words else F.lit(0)


def tokens(text: Column) -> Column:
    """Words and single ideographs of a text, lower case."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "([\\x{4e00}-\\x{9fff}])", " $1 ")
    return F.filter(F.split(spaced, "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def inverted_index(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(token, key, tf) and (key, length).  Token counts are combined before they move."""
    words = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("words"))
    postings = words.select("key", F.explode("words").alias("token")).groupBy("token", "key").agg(F.count("*").alias("tf"))
    return postings, words.select("key", F.size("words").alias("length"))


def _count_of(word: str) -> Column:
    return F.size(F.filter("words", lambda w: w == word))


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key and score of the documents that hold every word of the query; a document is scored where it is, only totals move."""
    words = sorted(set(query.lower().split()))
    counted = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("words")).select(
        "key", F.size("words").alias("length"), *(_count_of(t).alias(f"tf{i}") for i, t in enumerate(words))
    )
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    return ranked(counted, stats, len(words))


def words(*columns: Column) -> Column:
    """The words of some texts in lower case; LaTeX commands and marks are gone, an ideograph is a word."""
    s = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))
    s = F.regexp_replace(s, r"\\[A-Za-z]+", " ")
    s = F.lower(F.regexp_replace(s, "([\\x{3400}-\\x{9fff}])", " $1 "))
    return F.filter(F.split(s, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def searchable(*columns: Column) -> Column:
    """words() as one text, each between spaces of its own."""
    return F.concat(F.lit(" "), F.array_join(words(*columns), "  "), F.lit(" "))


def phrases(query: str) -> list[str]:
    """The phrases of a query as they stand in searchable(): a run of ideographs is one phrase of its characters, so is a word with underscores of its parts; other characters part phrases."""
    out = []
    for run in re.findall("[\u3400-\u9fff]+|[A-Za-z0-9_]+", query or ""):
        words = list(run) if run[0] >= "\u3400" else run.lower().replace("_", " ").split()
        if words:
            out.append(" " + "  ".join(words) + " ")
    return out


def ranked(counted: DataFrame, stats: DataFrame, n: int) -> DataFrame:
    """key and BM25 score of the rows (key, length, tf0, tf1, ...) that hold all n units; stats is one row: n, avg, df0, df1, ..."""
    score = F.lit(0.0)
    for i in range(n):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg")))
    hit = reduce(lambda a, b: a & b, (F.col(f"tf{i}") > 0 for i in range(n)), F.lit(n > 0))
    return counted.filter(hit).crossJoin(F.broadcast(stats)).select("key", score.alias("score"))


def phrase_search(docs: DataFrame, key: str, document: Column, query: str) -> DataFrame:
    """key and score of the documents, given by searchable(), that hold every phrase; BM25 with a phrase as the unit.  Nothing for a query without a phrase.

    A document is scored where it is; what moves is one row of totals.  postings.py has the
    same from a stored index.
    """
    asked = phrases(query)
    counted = docs.select(F.col(key).alias("key"), document.alias("_doc")).select(
        "key", F.regexp_count("_doc", F.lit(r"\S+")).alias("length"), *(F.regexp_count("_doc", F.lit(f"(?={t})")).alias(f"tf{i}") for i, t in enumerate(asked))
    )
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))))
    return ranked(counted, stats, len(asked))


def best_phrases(docs: DataFrame, key: str, document: Column, query: str, limit: int = 2000) -> DataFrame:
    """The best of phrase_search(); the limit is held to 1 to 10000."""
    return phrase_search(docs, key, document, query).orderBy(F.desc("score"), "key").limit(max(1, min(limit, 10_000)))


def two_tiers(scored: DataFrame, ranked: DataFrame) -> DataFrame:
    """Items (key, score, used) by their place in a phrase search (key, score) first, the others, or all if it found none, by field score after them."""
    from pyspark.sql import Window as W

    place = ranked.select("key", F.row_number().over(W.orderBy(F.desc("score"), "key")).alias("rank"))  # at most 10000 rows
    return scored.join(place, "key", "left").orderBy(*ordering("", "keyword"))


def ordering(sort: str, keyword: str = "") -> list[Column]:
    """Sort keys, all of them total orders: the last one is seq."""
    seq = F.col("seq")
    rank, year = difficulty_rank(F.col("difficulty")), F.coalesce("year", F.lit(0))
    if keyword.strip() and sort in ("", "used"):
        return [F.coalesce("rank", F.lit(1e9)), F.col("score").desc(), F.col("used").desc(), F.col("key")]
    return {
        "new": [seq.desc()],
        "old": [seq],
        "": [seq],
        "diff": [rank, seq],
        "diff2": [rank.desc(), seq],
        "used": [F.col("used").desc(), seq],
        "year": [year == 0, year.desc(), seq],
        "year2": [year == 0, year, seq],
        "solved": [F.coalesce("solved_at", F.lit("")).desc(), seq],
    }[sort]


def page(df: DataFrame, order: list[Column], limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of the sorted rows; limit is held to 1 to 1000."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def replacements(items: DataFrame, one: DataFrame, limit: int = 12) -> DataFrame:
    """The best items to take the place of one (a single row), by what they share with it."""
    o = one.limit(1).select(*(F.col(c).alias(f"o_{c}") for c in ("key", "type", "topic", "section", "difficulty", "points", "kind")))
    score = (
        F.when((F.col("topic") != "") & (F.col("topic") == F.col("o_topic")), 6.0).otherwise(0.0)
        + F.when(F.col("section") == F.col("o_section"), 5.0).otherwise(0.0)
        + F.when(F.col("difficulty") == F.col("o_difficulty"), 4.0).otherwise(0.0)
        + F.when(F.arrays_overlap("points", "o_points"), 2.0).otherwise(0.0)
        + F.when(F.col("solved"), 1.0).otherwise(0.0)
        + F.when(F.col("kind") == F.col("o_kind"), 0.5).otherwise(0.0)
        - 0.02 * F.least(F.col("used"), F.lit(20))
    )
    pool = items.crossJoin(F.broadcast(o)).filter((F.col("key") != F.col("o_key")) & (F.col("type") == F.col("o_type")))  # one row
    return pool.select("key", "seq", F.round(score, 2).alias("score")).orderBy(F.desc("score"), "seq").limit(min(12, max(1, limit)))


def word_grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters of a text without its white space."""
    dense = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\s+", "")
    return F.array_distinct(F.regexp_extract_all(dense, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def shortlist(queries: DataFrame, targets: DataFrame, limit: int = 5, n: int = 4) -> DataFrame:
    """For each query (qid, text) the targets (tid, text) that share the rarest n-grams: sum of ln((N + 1) / (df + 1)), half again for n >= 3."""
    from pyspark.sql import Window as W

    grams = targets.select("tid", F.explode(word_grams(F.col("text"), n)).alias("gram"))
    idf = grams.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(targets.agg(F.count("*").alias("total"))))
    weighted = _kept(grams.join(idf.select("gram", (F.log((F.col("total") + 1) / (F.col("df") + 1)) * (1.5 if n >= 3 else 1.0)).alias("w")), "gram"))
    # A query has a gram for each of its characters: where the targets' grams can be broadcast, only those that they share move.
    few = weighted.count() <= MOST_BROADCAST
    asked = queries.select("qid", F.explode(word_grams(F.col("text"), n)).alias("gram"))
    scored = asked.join(F.broadcast(weighted) if few else weighted, "gram").groupBy("qid", "tid").agg(F.sum("w").alias("score"))
    best = W.partitionBy("qid").orderBy(F.round("score", 6).desc(), "tid")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
