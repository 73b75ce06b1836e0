"""One predicate builder for listing and for selection.

Parameters are AND-ed; a parameter with several values is any-of.  Everything becomes one
Column over the item table, so Spark prunes and pushes what it can.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.model import blank

NONE = "无"
_SPLIT = re.compile(r"[\s,，、;；]+")


@dataclass
class Params:
    types: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    points: list[str] = field(default_factory=list)
    difficulties: list[str] = field(default_factory=list)
    years: list[str] = field(default_factory=list)
    origins: list[str] = field(default_factory=list)
    region_scope: list[str] = field(default_factory=list)
    paper_state: str = ""
    star_state: str = ""
    quality: str = ""
    point_source: list[str] = field(default_factory=list)
    answer_source: list[str] = field(default_factory=list)
    reviewed: str = ""
    keyword: str = ""
    deep: bool = True
    has: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)


def terms(keyword: str) -> list[str]:
    """The words of a keyword string; runs without a separator stay whole."""
    return [t for t in _SPLIT.split(keyword.strip()) if t]


def flags() -> dict[str, Column]:
    return {"answer": ~blank(F.col("answer")), "solution": F.col("solved"), "tag": F.size("points") > 0, "doubt": F.col("duplicate_group").isNotNull()}


def keyword_hit(keyword: str, tag_ids: dict[str, list[str]], deep: bool = True) -> Column:
    """Every term is found: in stem, answer or (deep) solution as it stands, or in a tag or the origin in any case.

    tag_ids: for each term the ids of the points that match it, see matching_tags().
    """

    def one(term: str) -> Column:
        text = [F.col("stem"), F.col("answer")] + ([F.col("solution")] if deep else [])
        hit = reduce(lambda a, b: a | b, (F.contains(F.coalesce(c, F.lit("")), F.lit(term)) for c in text))
        for c in ("source_label", "book", "region", "key"):
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower()))
        ids = tag_ids.get(term) or []
        return hit | F.arrays_overlap("points", F.array(*map(F.lit, ids))) if ids else hit

    return reduce(lambda a, b: a & b, map(one, terms(keyword)), F.lit(True))


def matching_tags(points: DataFrame, keyword: str) -> dict[str, list[str]]:
    """Ids of the points whose id, title, topic or section holds a term, in any case.  The dimension is filtered by Spark; the ids are few."""
    out = {}
    for term in terms(keyword):
        t = F.lit(term.lower())
        hit = reduce(lambda a, b: a | b, (F.contains(F.lower(c), t) for c in ("id", "title", "topic", "section")))
        out[term] = [r.id for r in points.filter(hit).select("id").orderBy("id").collect()]
    return out


def build(p: Params, tag_ids: dict[str, list[str]] | None = None) -> Column:
    every: list[Column] = []
    for values, column in ((p.types, "type"), (p.kinds, "kind"), (p.difficulties, "difficulty"), (p.origins, "origin")):
        if values:
            every.append(F.col(column).isin(values))
    if p.years:
        every.append(F.col("year").cast("string").isin(p.years))
    if p.points:
        every.append(F.arrays_overlap("points", F.array(*map(F.lit, p.points))))
    if p.region_scope:
        every.append(F.when(blank(F.col("region_scope")), "unknown").otherwise(F.col("region_scope")).isin(p.region_scope))
    if p.paper_state:  # unknown counts as complete
        partial = F.col("paper_complete").eqNullSafe(False)
        every.append(partial if p.paper_state == "partial" else ~partial)
    if p.star_state:
        every.append(F.col("stars") > 0 if p.star_state == "rated" else F.col("stars") <= 0)
    if p.quality:
        every.append(F.col("duplicate_group").isNotNull() if p.quality == "dup" else F.coalesce("figure_low_res", F.lit(False)))
    if p.point_source:
        every.append(F.when(blank(F.col("point_source")), NONE).otherwise(F.col("point_source")).isin(p.point_source))
    if p.answer_source:
        every.append(F.when(blank(F.col("answer_source")), NONE).otherwise(F.col("answer_source")).isin(p.answer_source))
    if p.reviewed:
        every.append(~blank(F.col("reviewed_at")) if p.reviewed == "yes" else blank(F.col("reviewed_at")))
    if p.keyword.strip():
        every.append(keyword_hit(p.keyword, tag_ids or {}, p.deep))
    known = flags()
    every += [known.get(f, F.lit(False)) for f in p.has]
    every += [~known[f] for f in p.missing if f in known]
    return reduce(lambda a, b: a & b, every, F.lit(True))


def in_given_order(items: DataFrame, keys: list[str]) -> DataFrame:
    """The items of the keys in the order given; unknown keys are left out.  pos is the place in the list."""
    wanted = items.sparkSession.createDataFrame([(k, i) for i, k in reversed(list(enumerate(keys)))], "key string, pos int")
    return items.join(wanted.groupBy("key").agg(F.min("pos").alias("pos")), "key").orderBy("pos")


def selection_pool(items: DataFrame, year_from: int = 0, shortest: int = 20) -> DataFrame:
    """Items fit for selection: a real solution, in no duplicate group, recent enough, and the first of each variant."""
    ok = (F.length(F.trim("solution")) >= shortest) & F.col("duplicate_group").isNull() & (F.coalesce("year", F.lit(0)) >= year_from if year_from else F.lit(True))
    variant = F.when(blank(F.col("dup_of")), F.col("key")).otherwise(F.col("dup_of"))
    first = W.partitionBy("variant").orderBy("seq")
    return items.filter(ok).withColumn("variant", variant).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
