"""Queues of items that wait for work, and small reports on the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.model import blank, difficulty_rank, has_solution

MAX_ATTEMPTS = 3
MOCK, UNSET = "模拟", "未定"
ANSWERED_TYPES = ["single_choice", "multi_choice", "fill_in_blank"]


def _slice(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    out = rows.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def to_export(items: DataFrame, stage: str = "both", kind: str = "", difficulty: str = "", book: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    """Items without answer and solution (both), or with an answer and no solution (solution), from easy to hard, then by key; limit 0: all."""
    open_ = ~has_solution(F.col("solution")) & (~blank(F.col("answer")) if stage == "solution" else blank(F.col("answer")))
    for value, column in ((kind, "kind"), (difficulty, "difficulty"), (book, "book")):
        if value:
            open_ &= F.col(column) == value
    return _slice(items.filter(open_), [difficulty_rank(F.col("difficulty")), F.col("key")], limit, offset)


def to_solve(items: DataFrame, difficulties: str = "", attempts: str = "attempts") -> DataFrame:
    """Mock items without solution that have not failed too often, from easy to hard; difficulties: comma-separated, empty for all."""
    wanted = [x.strip() for x in difficulties.split(",") if x.strip()]
    open_ = (F.col("kind") == MOCK) & ~has_solution(F.col("solution")) & (F.coalesce(attempts, F.lit(0)) < MAX_ATTEMPTS)
    rows = items.filter(open_ & F.col("difficulty").isin(wanted)) if wanted else items.filter(open_)
    return _slice(rows, [difficulty_rank(F.col("difficulty")), F.col("key")], 0, 0)


def to_audit(items: DataFrame, cursor: str = "", only_missing: bool = False) -> DataFrame:
    """Items from the last to the first, from the cursor's key on; a cursor that is not in the queue starts it anew."""
    rows = items.filter(blank(F.col("answer")) | ~has_solution(F.col("solution"))) if only_missing else items
    if cursor:
        start = rows.filter(F.col("key") == cursor).agg(F.max("seq").alias("_start"))  # one row
        rows = rows.crossJoin(F.broadcast(start)).filter(F.col("_start").isNull() | (F.col("seq") <= F.col("_start"))).drop("_start")
    return rows.orderBy(F.desc("seq"))


def to_fill(items: DataFrame, what: str, attempts: str = "attempts") -> DataFrame:
    """what ans: items of the types with short answers that have a solution and no answer; sol: items with an answer and no solution.  By key."""
    answered, solved = ~blank(F.col("answer")), has_solution(F.col("solution"))
    open_ = (solved & ~answered & F.col("type").isin(ANSWERED_TYPES)) if what == "ans" else (answered & ~solved)
    return items.filter(open_ & (F.coalesce(attempts, F.lit(0)) < MAX_ATTEMPTS)).orderBy("key")


def may_not_compile(stem: Column, figures: Column) -> Column:
    """Items with figures or drawings; text and formulas alone always compile."""
    s = F.coalesce(stem, F.lit(""))
    return (F.coalesce(F.size(figures), F.lit(0)) > 0) | F.contains(s, F.lit("tikzpicture")) | F.contains(s, F.lit(r"\begin{axis}"))


def source_suggestions(items: DataFrame, part: str, most: int = 40) -> DataFrame:
    """The most frequent sources that contain a part, whatever its case."""
    found = items.filter(F.contains(F.lower("source_label"), F.lit(part.lower())))
    return found.groupBy("source_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_label").limit(most)


def mix_by_difficulty(items: DataFrame) -> DataFrame:
    return items.groupBy(F.when(blank(F.col("difficulty")), UNSET).otherwise(F.col("difficulty")).alias("difficulty")).agg(F.count("*").alias("n"))


def majority(parts: DataFrame, by: str, holds: Column) -> DataFrame:
    """Whether more than half of a group's parts hold."""
    return parts.groupBy(by).agg((2 * F.count_if(holds) > F.count("*")).alias("most"))


def token_difference(one: Column, other: Column, most: int = 3) -> tuple[Column, Column]:
    """The first tokens in order that only one of two sets has, for each side."""
    only = lambda a, b: F.slice(F.array_sort(F.array_except(a, b)), 1, most)
    return only(one, other), only(other, one)


def uncovered(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """Points that items reach and the chosen keys do not."""
    reach = items.select(F.explode("points").alias("id")).distinct()
    covered = items.join(chosen.select("key"), "key", "left_semi").select(F.explode("points").alias("id"))
    return reach.join(covered, "id", "left_anti")


def upserted(library: DataFrame, batch: DataFrame) -> DataFrame:
    """The library with a batch's rows in place of those of their keys, and its new rows."""
    return library.join(batch.select("key"), "key", "left_anti").unionByName(batch.select(library.columns))


def trash_listing(trash: DataFrame) -> DataFrame:
    """Newest first."""
    return trash.orderBy(F.desc("deleted_at"), F.desc("seq"))


def volume_sizes(items: DataFrame, per_volume: int) -> DataFrame:
    """Items and bytes of text of each volume."""
    volume = F.floor((F.col("seq") - 1) / per_volume)
    return items.groupBy(volume.alias("volume")).agg(F.count("*").alias("items"), F.sum(F.octet_length("stem")).alias("bytes"))


def index_coverage(texts: DataFrame, text: Column, least: int) -> DataFrame:
    """How many texts an index of character groups of a length can hold, and how many are too short."""
    return texts.agg(F.count("*").alias("total"), F.count_if(F.length(text) >= least).alias("indexed"), F.count_if(F.coalesce(F.length(text) < least, F.lit(True))).alias("skipped"))


def statistics(items: DataFrame, dimensions: list[str], flags: dict[str, Column]) -> DataFrame:
    """(what, value, n): counts by each dimension and of each flag, in one pass; rows are summed before they move."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = [F.struct(F.lit(c).alias("what"), text(c).alias("value")) for c in dimensions]
    each += [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("what"), F.lit("yes").alias("value"))) for name, cond in flags.items()]
    return items.select(F.explode(F.array(*each)).alias("x")).filter("x is not null").groupBy("x.what", "x.value").agg(F.count("*").alias("n"))
