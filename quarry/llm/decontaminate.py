"""Benchmark decontamination by winnowing.

Every text is cut into words.  Of each ``window - k + 1`` neighbouring k-grams the one
with the least hash is kept as a fingerprint (the rightmost of equals), so two texts
that share ``window`` consecutive words share a fingerprint inside them.  Fingerprints
of documents and benchmark items are joined and each hit is extended word by word to
both sides; a hit that reaches ``window`` words marks them all.

Scale: the documents are read once.  A bit field of bounded size over the benchmark's
fingerprints drops almost all fingerprints of documents before the join, which then
moves a few rows; nothing is broadcast but that field.

Defined results: a null or wordless text has no words and is not contaminated; an item
without words matches nothing; an item of fewer than ``window`` words is one window of
its own length; repeated items count once by their id and rows with a null item_id
count as hits but not as items; repeated documents are judged alike; empty tables give
empty results or no hits.  All columns of the documents but the ones used are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ALNUM, UID, Words, bits_of, chunks, grams, in_bits, read_table, released, with_uid, written

WINDOW, K = 13, 7
SIDE = WINDOW - K
MAX_LOG2_BITS = 27

_FOUND = "array<struct<h:bigint,pos:int,len:int,ctx:array<bigint>>>"


def _selected(g: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions that some window of SIDE + 1 neighbouring k-grams keeps; valid: of a window's first k-gram."""
    n = len(g) - SIDE
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, SIDE + 1):
        x = g[j : j + n]
        better = x <= best
        np.copyto(best, x, where=better)
        at[better] = j
    keep = np.zeros(len(g), bool)
    keep[(np.arange(n) + at)[valid[:n]]] = True
    return np.flatnonzero(keep)


def _salted(h: np.ndarray, n: int) -> np.ndarray:
    return h ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)


def _fingerprints(words: Words, lengths: list[int] | None, bits: np.ndarray | None):
    """(position, length, hash) of what is to be looked up.  lengths: the short items' lengths for documents, None for items."""
    h, ptr = words.hashes, words.ptr
    end = np.repeat(ptr[1:], np.diff(ptr))  # of the text that a word is in
    at = np.arange(len(h))
    out = []
    g = grams(h, K)
    if len(g):
        pos = _selected(g, at[: len(g)] + WINDOW <= end[: len(g)])
        out.append((pos, K, _salted(g[pos], K)))
    if lengths is None:
        for i in np.flatnonzero((np.diff(ptr) < WINDOW) & (np.diff(ptr) > 0)):
            n = int(ptr[i + 1] - ptr[i])
            out.append((np.array([ptr[i]]), n, _salted(grams(h[ptr[i] : ptr[i + 1]], n), 100 + n)))
    else:
        for n in lengths:
            g = grams(h, n)
            pos = np.flatnonzero(at[: len(g)] + n <= end[: len(g)])
            out.append((pos, n, _salted(g[pos], 100 + n)))
    for pos, n, x in out:
        if bits is not None and len(x):
            ok = in_bits(bits, x)
            pos, x = pos[ok], x[ok]
        yield pos, n, x


def _sketch(batches, column: str, lengths: list[int] | None, bits: np.ndarray | None, keep: list[str]):
    for batch in batches:
        n_words, found = [], []
        for _, parts in chunks(batch, column):
            words = Words(parts, ALNUM, lower=True)
            n_words.append(np.diff(words.ptr))
            found.append(_listed(words, list(_fingerprints(words, lengths, bits))))
        sizes = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        lists = pa.concat_arrays(found) if found else pa.array([], _KIND)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes.astype(np.int64)), lists], names=[*keep, "n_words", "found"])


_KIND = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("len", pa.int32()), ("ctx", pa.list_(pa.int64()))]))


def _listed(words: Words, prints: list[tuple[np.ndarray, int, np.ndarray]]) -> pa.ListArray:
    """The fingerprints of each text; those of k-grams in texts of a window or more with the words around them."""
    ptr, h = words.ptr, words.hashes
    pos = np.concatenate([np.zeros(0, np.int64), *(p for p, _, _ in prints)])
    n = np.concatenate([np.zeros(0, np.int64), *(np.full(len(p), k) for p, k, _ in prints)])
    x = np.concatenate([np.zeros(0, np.uint64), *(v for _, _, v in prints)])
    doc = np.searchsorted(ptr, pos, side="right") - 1
    order = np.argsort(doc, kind="stable")
    pos, n, x, doc = pos[order], n[order], x[order], doc[order]
    around = (n == K) & (ptr[doc + 1] - ptr[doc] >= WINDOW)
    at = pos[around, None] + np.arange(-SIDE, K + SIDE)
    inside = (at >= ptr[doc[around], None]) & (at < ptr[doc[around] + 1, None])
    values = np.where(inside, h[np.where(inside, at, 0)], np.uint64(0)) if len(h) else np.zeros(at.shape, np.uint64)
    width = np.where(around, K + 2 * SIDE, 0)
    edges = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    ctx = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(values).ravel().view(np.int64)), mask=pa.array(~around))
    fields = [pa.array(x.view(np.int64)), pa.array((pos - ptr[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), ctx]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(ptr))).astype(np.int32)), pa.StructArray.from_arrays(fields, names=["h", "pos", "len", "ctx"]))


def _reach(side: str) -> F.Column:
    """How many words beside a k-gram agree in d and i, up to SIDE."""
    order = range(SIDE - 1, -1, -1) if side == "left" else range(SIDE + K, 2 * SIDE + K)
    out = F.lit(0)
    for j in reversed(order):
        same = (F.col("d")[j] == F.col("i")[j]) & (F.col("d")[j] != 0)
        out = F.when(same, 1 + out).otherwise(0)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs (_q_uid, doc_id, text): _q_uid, doc_id, n_words, n_hit, items (sorted strings), contaminated."""
    schema = "n_words bigint, found " + _FOUND
    items = written(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
            lambda it: released(_sketch(it, "text", None, None, ["item_id"])), "item_id string, " + schema
        ),
        "items",
    )
    prints = items.select("item_id", F.explode("found").alias("f")).select("item_id", "f.*")
    lengths = sorted(r[0] for r in prints.filter(F.col("ctx").isNull()).select("len").distinct().collect())  # 12 values at most
    log2 = int(min(MAX_LOG2_BITS, max(16, np.ceil(np.log2(16 * max(1, prints.count()))))))
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(prints, "h", log2))
    sketch = written(
        docs.select(UID, "doc_id", "text").mapInArrow(
            lambda it: released(_sketch(it, "text", lengths, bits.value, [UID, "doc_id"])),
            f"{UID} bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + schema,
        ),
        "winnowed",
    )
    doc_prints = sketch.filter(F.size("found") > 0).select(UID, F.explode("found").alias("f")).select(UID, "f.h", "f.pos", "f.len", F.col("f.ctx").alias("d"))
    hits = (
        doc_prints.join(prints.select("h", F.col("ctx").alias("i"), "item_id", F.col("len").alias("n")), "h")
        .filter(F.col("len") == F.col("n"))
        .withColumn("l", F.when(F.col("i").isNull() | F.col("d").isNull(), 0).otherwise(_reach("left")))
        .withColumn("r", F.when(F.col("i").isNull() | F.col("d").isNull(), 0).otherwise(_reach("right")))
        .filter(F.col("i").isNull() | (F.col("l") + K + F.col("r") >= WINDOW))
        .select(UID, "item_id", F.struct((F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("len") + F.col("r")).alias("b")).alias("span"))
        .groupBy(UID)
        .agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
        .withColumn(
            "n_hit",
            F.aggregate(
                "spans",
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda acc, x: F.struct(
                    (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end")
                ),
                lambda acc: acc["n"].cast("bigint"),
            ),
        )
        .select(UID, "n_hit", "items")
    )
    return (
        sketch.select(UID, "doc_id", "n_words")
        .join(hits, UID, "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint")))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_uid(read_table(spark, sf_dir, "documents")).select(UID, "doc_id", "text")
    return contamination(docs, read_table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, p, n FROM dw JOIN bw USING (n, gram)),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
