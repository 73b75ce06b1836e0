"""Repeated passages by prefix-partitioned suffix trees.

A suffix starts at every word with at least ``WINDOW`` words from there on, and is read
``WINDOW`` words deep, on the words themselves.  Suffixes are dealt to trees by a key that
equal suffixes are sure to share, and that grows where too many share it:

- first the anchor, the ten-word gram of the least hash among the suffix's words.
  Neighbouring suffixes mostly have one anchor, so they travel as one row with their
  words written once;
- under anchors with more than ``SUBTREE_ROWS`` such rows the key is all of the suffix's
  words (their SHA-256), pre-aggregated: each node of depth ``WINDOW`` is a group.

A tree is grown over all suffixes of its rows by doubling depths: the node of a suffix at
depth 2 d is the pair of nodes at depth d, here and d words on, numbered anew, from the
words up to the whole suffix.  Numbers stand for words, not for hashes, so equal nodes
mean equal words.  A deep internal node is one at depth ``WINDOW`` with leaves of several
documents; its leaves in all but the document of the least doc_id mark the words they
cover, and what neighbouring leaves mark is one maximal repeat.

A first pass keeps suffixes without any repeat out of the trees: equal suffixes have equal
anchors, so only those whose anchor stands in two different texts enter.  Texts equal as a
whole are found by their digest, so copies alone grow no tree.

Scale: two passes over the texts.  The anchors move once, as hashes; bit fields of bounded
size tell the second pass which of them repeat, and which are hot.  A task works one tree
after the other and holds one of them at a time.  A passage that a third of all documents
share is summed before it moves.  The driver sees the bit fields only.

Defined results: a null text has no words; texts of fewer than ``WINDOW`` words keep
all; rows of equal doc_id never remove from each other; rows with a null doc_id neither
remove nor are removed from; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import NOT_SPACE, UID, Words, bits_of, chunks, grams, in_bits, read_table, with_uid, written

WINDOW = 50
K = 10
#: Rows of a tree, each some neighbouring suffixes.  A task holds a tree.
SUBTREE_ROWS = 20_000
#: Words that are grown at once, of several small trees.
UNIT_WORDS = 400_000
MAX_LOG2_BITS = 27


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """best (minimum or maximum) of the n values from each position on."""
    size = 1
    while 2 * size <= n:
        x = best(x[: len(x) - size], x[size:])
        size *= 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's hash for each position (0 where no window begins), and which positions begin a window."""
    h, ptr = words.hashes, words.ptr
    end = np.repeat(ptr[1:], np.diff(ptr))
    starts = np.arange(len(h)) + WINDOW <= end
    n = WINDOW - K + 1
    if len(h) < WINDOW:
        return np.zeros(len(h), np.uint64), starts
    least = np.zeros(len(h), np.uint64)
    least[: len(h) - WINDOW + 1] = _slide(grams(h, K), WINDOW - K + 1, np.minimum)
    return np.where(starts, least, np.uint64(0)), starts


def _whole(p: bytes) -> bytes:
    return hashlib.sha256(b" ".join(p.split())).digest()


def _anchor_rows(batches):
    """(anchor hash, digest of its text) for each run of suffixes that share an anchor."""
    for batch in batches:
        for _, parts in chunks(batch, "text"):
            words = Words(parts, NOT_SPACE, lower=False)
            least, _ = _anchors(words)
            new = np.flatnonzero((least > 0) & (least != np.concatenate([[np.uint64(0)], least[:-1]])))
            if len(new):
                whole = np.array([int.from_bytes(_whole(t)[:8], "little", signed=True) for t in parts])
                doc = np.searchsorted(words.ptr, new, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(whole[doc])], names=["key", "text"])


_RUNS = "array<struct<anchor:bigint,pos:int,n:int>>"
_ENTERED = f"n_words bigint, whole_sha256 string, text string, runs {_RUNS}, hot {_RUNS}"


def _runs_of(ptr: np.ndarray, anchor: np.ndarray, pos: np.ndarray) -> pa.ListArray:
    """Per text the runs of neighbouring positions with one anchor: the anchor, the first position in the text, and how many."""
    doc = np.searchsorted(ptr, pos, side="right") - 1
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(pos)))
    edges = np.searchsorted(pos[at], ptr).astype(np.int32)
    fields = [pa.array(anchor[at].view(np.int64)), pa.array((pos[at] - ptr[doc[at]]).astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(fields, names=["anchor", "pos", "n"]))


def _entered(batches, repeats: np.ndarray, hot: np.ndarray):
    """A row per text: its digest, the runs of suffixes that may repeat, and the text if there are any."""
    for batch in batches:
        for first, parts in chunks(batch, "text"):
            words = Words(parts, NOT_SPACE, lower=False)
            least, starts = _anchors(words)
            some = starts & in_bits(repeats, least)
            is_hot = some & in_bits(hot, least)
            cold = np.flatnonzero(some & ~is_hot)
            many = np.flatnonzero(is_hot)
            has = np.zeros(len(least) + 1, np.int64)
            has[1:] = np.cumsum(some)
            any_ = has[words.ptr[1:]] > has[words.ptr[:-1]]
            rows = batch.slice(first, len(parts))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(UID), rows.column("doc_id"), pa.array(np.diff(words.ptr).astype(np.int64)), pa.array([_whole(p).hex() for p in parts], pa.string()),
                    pa.array([p if h else None for p, h in zip(parts, any_.tolist())], pa.binary()).cast(pa.string()),
                    _runs_of(words.ptr, least[cold], cold), _runs_of(words.ptr, least[many], many),
                ],
                names=[UID, "doc_id", "n_words", "whole_sha256", "text", "runs", "hot"],
            )


def _words_of(batches):
    """A row per run of suffixes: its words, each followed by one space."""
    for batch in batches:
        runs = batch.column("runs").to_pylist()
        for first, parts in chunks(batch, "text"):
            uid, anchor, pos, n, words, row = [], [], [], [], [], []
            uids = batch.column(UID).slice(first, len(parts)).to_pylist()
            for i, p in enumerate(parts):
                w = p.split()
                for r in runs[first + i]:
                    row.append(first + i)
                    uid.append(uids[i])
                    anchor.append(r["anchor"])
                    pos.append(r["pos"])
                    n.append(r["n"])
                    words.append(b" ".join(w[r["pos"] : r["pos"] + r["n"] + WINDOW - 1]) + b" ")
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), ids, pa.array(uid, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(words, pa.binary())],
                names=["anchor", "doc_id", UID, "pos", "n", "words"],
            )


def _order(ids: pa.Array) -> np.ndarray:
    """The rank of each id among the distinct ones; -1 for null."""
    coded = ids.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[np.asarray(pc.array_sort_indices(coded.dictionary))] = np.arange(len(rank))
    at = np.asarray(pc.fill_null(coded.indices.cast(pa.int64()), -1))
    return np.where(at < 0, -1, rank[at.clip(min=0)]) if len(rank) else at


def tree_nodes(texts: pa.Array, n: np.ndarray) -> np.ndarray:
    """The node at depth WINDOW of each suffix of the rows, one row after the other: texts has their words, n how many suffixes each has."""
    data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    ends = np.flatnonzero(data == 32) + 1
    edges = np.concatenate([[0], ends]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(data)])
    node = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    begin = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
    suffix = np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    depth = 1
    while 2 * depth < WINDOW:
        node = pd.factorize(node[: len(node) - depth] * (len(node) + 1) + node[depth:])[0]
        depth *= 2
    return pd.factorize(node[suffix] * (len(node) + 1) + node[suffix + WINDOW - depth])[0]


def _later(rows: pa.Table) -> pa.RecordBatch:
    """Of whole trees: the suffixes below deep nodes whose document is not the node's least."""
    n = np.asarray(rows.column("n")).astype(np.int64)
    node = tree_nodes(rows.column("words").combine_chunks(), n)
    row = np.repeat(np.arange(len(n)), n)
    rank = _order(rows.column("doc_id").combine_chunks())[row]
    pos = np.repeat(np.asarray(rows.column("pos")).astype(np.int64), n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    known = rank >= 0
    np.minimum.at(least, node[known], rank[known])
    again = np.flatnonzero(known & (rank > least[node]))
    uid = np.asarray(rows.column(UID))
    return pa.RecordBatch.from_arrays([pa.array(uid[row[again]]), pa.array(pos[again].astype(np.int32))], names=[UID, "pos"])


def _deep_nodes(batches):
    """Rows in the order of their anchors: what _later() finds, tree after tree; small ones are grown together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def grown():
        out = _later(pa.Table.from_batches(held))
        return [out] if out.num_rows else []

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = np.asarray(batch.column("anchor"))
        total = np.concatenate([[0], np.cumsum(np.asarray(batch.column("n")).astype(np.int64) + WINDOW - 1)])
        starts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]]).tolist()
        first = 0
        for a, b in zip(starts[:-1], starts[1:]):
            words = int(total[b] - total[a])
            if size and size + words > UNIT_WORDS and (a > 0 or last != anchor[0]):
                if a > first:
                    held.append(batch.slice(first, a - first))
                yield from grown()
                held, size, first = [], 0, a
            size += words
        held.append(batch.slice(first))
        last = anchor[-1]
    if held:
        yield from grown()


def _digests(batches):
    """A row per suffix under a hot anchor: the SHA-256 of its words."""
    for batch in batches:
        hot = batch.column("hot").to_pylist()
        for first, parts in chunks(batch, "text"):
            row, uid, pos, key = [], [], [], []
            uids = batch.column(UID).slice(first, len(parts)).to_pylist()
            for i, p in enumerate(parts):
                w = p.split()
                for r in hot[first + i]:
                    for a in range(r["pos"], r["pos"] + r["n"]):
                        row.append(first + i)
                        uid.append(uids[i])
                        pos.append(a)
                        key.append(hashlib.sha256(b" ".join(w[a : a + WINDOW])).digest())
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), ids, pa.array(uid, pa.int64()), pa.array(pos, pa.int32())], names=["key", "doc_id", UID, "pos"])


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs (_q_uid, doc_id, text): a table of all rows, and (_q_uid, starts) of the suffixes that repeat a smaller doc_id's.

    Suffixes that only copies of the whole text share are not among them: see with_copies().
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = docs.select("text").mapInArrow(_anchor_rows, "key bigint, text bigint")
    anchors = raw.groupBy("key").agg(F.min("text").alias("least"), F.max("text").alias("most"), F.count("*").alias("n"))
    anchors = written(anchors.filter("least < most").select("key", "n"), "anchors")
    hot = anchors.filter(F.col("n") > SUBTREE_ROWS).select("key")
    bits = []
    for some in (anchors, hot):
        bits.append(bits_of(some, "key", int(min(MAX_LOG2_BITS, max(16, np.ceil(np.log2(16 * max(1, some.count()))))))))
    sent = spark.sparkContext.broadcast(tuple(bits))
    table = written(docs.select(UID, "doc_id", "text").mapInArrow(lambda it: _entered(it, *sent.value), f"{UID} bigint, doc_id {kind}, " + _ENTERED), "suffixes")
    rows = table.filter(F.size("runs") > 0).select(UID, "doc_id", "text", "runs").mapInArrow(_words_of, f"anchor bigint, doc_id {kind}, {UID} bigint, pos int, n int, words binary")
    found = rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_deep_nodes, f"{UID} bigint, pos int")
    digests = table.filter(F.size("hot") > 0).select(UID, "doc_id", "text", "hot").mapInArrow(_digests, f"key binary, doc_id {kind}, {UID} bigint, pos int")
    nodes = digests.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("key", "least")
    later = digests.join(nodes, "key").filter(F.col("doc_id") > F.col("least")).select(UID, "pos")
    return table, found.unionByName(later).groupBy(UID).agg(F.collect_list("pos").alias("starts"))


def with_copies(table: DataFrame) -> DataFrame:
    """The table's short columns, and whether a smaller doc_id has the same words: then all of them repeat."""
    rows = table.select(UID, "doc_id", "n_words", "whole_sha256")
    least = rows.filter(F.col("n_words") >= WINDOW).groupBy("whole_sha256").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(least, "whole_sha256", "left").withColumn("copy", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)))


def _cut(batches):
    for batch in batches:
        starts = batch.column("starts").to_pylist()
        for first, parts in chunks(batch, "text"):
            removed, sha = [], []
            for p, s in zip(parts, starts[first : first + len(parts)]):
                words = p.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if s:
                    np.add.at(gone, np.array(s), 1)
                    np.add.at(gone, np.array(s) + WINDOW, -1)
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
            rows = batch.slice(first, len(parts))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
            )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_uid(read_table(spark, sf_dir, "documents")).select(UID, "doc_id", "text")
    table, found = repeated(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_copies(table)
    hits = written(found.join(rows.filter("copy").select(UID), UID, "left_anti"), "repeats")
    some = table.filter(F.col("text").isNotNull()).select(UID, "doc_id", "n_words", "text").join(hits, UID).drop(UID)
    rest = rows.join(hits.select(UID), UID, "left_anti").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0).cast("bigint")).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
    )
    return rest.unionByName(some.mapInArrow(_cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT u, doc_id, p, sha256(array_to_string(w[p : p + 49], ' ')) AS h FROM (SELECT u, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
r AS (SELECT u, p FROM (SELECT u, p, doc_id, min(doc_id) OVER (PARTITION BY h) AS m FROM s) WHERE m < doc_id),
g AS (SELECT DISTINCT u, unnest(range(p, p + 50)) AS q FROM r),
n AS (SELECT u, count(*) AS n FROM g GROUP BY u),
x AS (SELECT u, unnest(w) AS w, generate_subscripts(w, 1) AS q FROM d),
k AS (SELECT u, string_agg(w, ' ' ORDER BY q) AS t FROM (SELECT x.u, x.w, x.q FROM x ANTI JOIN g ON g.u = x.u AND g.q = x.q) GROUP BY u)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.u = d.u LEFT JOIN k ON k.u = d.u
"""
