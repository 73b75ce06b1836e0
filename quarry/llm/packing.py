"""Packing token streams into fixed windows by non-negative least squares.

Every document becomes its byte-level BPE ids and an end id.  Whole windows of a long
document are sequences of their own; what is left of each document, its remainder, is
packed:

1. Remainders longer than ``SMALL`` fall into classes of ``GRAIN`` tokens.  All
   combinations of up to three classes that fill a window are enumerated and their
   repeat counts solved against the histogram by non-negative least squares, rounded
   down, and held to what the histogram has.
2. The residual - what no repeat took, and small remainders - is packed greedily one
   after the other, cut where a window is full.  The last window is cut to powers of
   two, which need no padding.

Scale: only counts per class and salt reach the driver (``CLASSES * SALTS`` rows at
most, whatever the input), and the plan that goes back has a run per class and
combination.  A class may hold a third of all remainders: its rows are numbered
inside ``SALTS`` salted groups, whose offsets the counts give.  Ids are moved once,
for cut remainders only.

Defined results: a null or empty text is its end id alone; repeated rows, and rows of
equal or null doc_id, are packed as documents of their own; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import UID, chunks, held, read_table, written

WINDOW = 2048
GRAIN = 8
SMALL = 64
CLASSES = WINDOW // GRAIN
SALTS = 64
END_ID = 1
VOCABULARY = "byte_bpe_50k"
CACHE_WORDS = 400_000


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, the same as the tokenizers library gives for the JSON file.

    The vocabulary's pattern never joins what stands before a space and a word after it, so
    a text is cut there and each word is encoded once and kept, up to CACHE_WORDS of them.
    Texts with other spacing are encoded whole; those with an added token's string go
    through the tokenizers library itself.
    """

    def __init__(self, folder: str | None = None):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = (lambda n: os.path.join(folder, n)) if folder else public_tokenizers.path
        self.exact = Tokenizer.from_file(path(f"{VOCABULARY}.json"))
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(path(f"{VOCABULARY}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        fast = self.fast.encode_ordinary

        class Cache(dict):
            def __missing__(self, word: str) -> bytes:
                ids = np.array(fast(" " + word), "<u4").tobytes()
                if len(self) < CACHE_WORDS and len(word) < 40:
                    self[word] = ids
                return ids

        self.words = Cache()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.split(" ")
        if len(parts) < 2:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        # a part that is empty or starts with white space means spacing other than one space before a word
        if any(not p or p[0].isspace() for p in parts[1:]):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        first = np.array(self.fast.encode_ordinary(parts[0]), "<u4").tobytes()
        return first + b"".join(map(self.words.__getitem__, parts[1:]))


_PIECE = "start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, ids binary"


def _pieces(batches, folder: str | None):
    """Whole windows (without ids) and the remainder (with ids, for later cuts) of each document."""
    encode, end = held(("tokenizer", folder), lambda: WordTokenizer(folder)).encode, np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        doc_ids = batch.column("doc_id")
        for first, parts in chunks(batch, "text"):
            row, start, length, total, crc, ids = [], [], [], [], [], []
            for i, p in enumerate(parts):
                data = encode(p.decode("utf-8", "replace")) + end
                n = len(data) // 4
                for a in range(0, n, WINDOW):
                    piece = data[4 * a : 4 * (a + WINDOW)]
                    m = len(piece) // 4
                    row.append(first + i)
                    start.append(a)
                    length.append(m)
                    total.append(n)
                    crc.append(zlib.crc32(piece))
                    ids.append(piece if m < WINDOW else None)
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc)), pa.array(ids, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"],
            )


def combinations(classes: int) -> np.ndarray:
    """Rows of one to three classes (1 to classes, 0: none) that add up to a window, the longest first."""
    out = [(classes, 0, 0)] + [(classes - a, a, 0) for a in range(1, classes // 2 + 1)]
    for a in range(1, classes // 3 + 1):
        b = np.arange(a, (classes - a) // 2 + 1)
        out += list(zip((classes - a - b).tolist(), b.tolist(), [a] * len(b)))
    return np.array(out)


def nnls(histogram: np.ndarray, combos: np.ndarray, most: int = 600) -> np.ndarray:
    """Repeat counts >= 0 with least squared misfit to the histogram (Lawson and Hanson's active sets over the sparse columns)."""
    n, m = len(histogram), len(combos)
    safe = np.where(combos > 0, combos - 1, n)

    def column(j: np.ndarray) -> np.ndarray:
        a = np.zeros((n + 1, len(j)))
        for k in range(3):
            np.add.at(a, (safe[j, k], np.arange(len(j))), 1.0)
        return a[:n]

    x, active = np.zeros(m), np.zeros(m, bool)
    residual = histogram.astype(float)
    for _ in range(most):
        gain = np.append(residual, 0.0)[safe].sum(axis=1)
        gain[active] = -1
        j = int(np.argmax(gain))
        if gain[j] <= 0.5:
            break
        active[j] = True
        while True:
            cols = np.flatnonzero(active)
            a = column(cols)
            z = np.linalg.lstsq(a, histogram, rcond=None)[0] if len(cols) > n else np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(cols)), a.T @ histogram)
            if (z > 1e-9).all():
                break
            bad = z <= 1e-9
            now = x[cols]
            step = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-12))
            moved = np.maximum(now + step * (z - now), 0)
            x[cols] = np.where(bad & (moved <= 1e-9), 0, moved)
            drop = cols[(x[cols] <= 1e-9)]
            if len(drop) == 0:
                drop = cols[bad][:1]
            x[drop], active[drop] = 0, False
        x[:] = 0
        x[cols] = z
        residual = histogram - a @ z
    return x


def repeats(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Whole repeat counts that the histogram covers."""
    counts = np.floor(nnls(histogram, combos) + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for j in np.flatnonzero(counts):
        kinds, each = np.unique(combos[j][combos[j] > 0], return_counts=True)
        counts[j] = min(int(counts[j]), int((left[kinds - 1] // each).min()))
        left[kinds - 1] -= counts[j] * each
    for j in range(len(combos)):  # what rounding left
        kinds, each = np.unique(combos[j][combos[j] > 0], return_counts=True)
        more = int((left[kinds - 1] // each).min())
        if more:
            counts[j] += more
            left[kinds - 1] -= more * each
    return counts


def _runs(counts: np.ndarray, combos: np.ndarray) -> tuple[list[tuple], np.ndarray, int]:
    """(class, first rank, last rank, first sequence, members per sequence, slot) per run; ranks used per class; sequences."""
    used, out, sequence = np.zeros(CLASSES, np.int64), [], 0
    for j in np.flatnonzero(counts):
        n, slot = int(counts[j]), 0
        kinds, each = np.unique(combos[j][combos[j] > 0], return_counts=True)
        for c, k in zip(kinds[::-1].tolist(), each[::-1].tolist()):
            out.append((c, int(used[c - 1]), int(used[c - 1]) + n * k, sequence, k, slot))
            used[c - 1] += n * k
            slot += k
        sequence += n
    return out, used, sequence


def pack(docs: DataFrame, tokenizer_folder: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, tokenizer_folder), f"doc_id {kind}, " + _PIECE)
    tokens = written(tokens.withColumn(UID, F.monotonically_increasing_id()), "tokens")
    whole = tokens.filter(F.col("length") == WINDOW)
    bounds = F.when(F.col("length") > SMALL, F.ceil(F.col("length") / GRAIN)).otherwise(0).cast("int")
    rest = tokens.filter(F.col("length") < WINDOW).select(
        UID, "doc_id", "start", "length", "doc_tokens", "ids_crc32", bounds.alias("class"), F.pmod(F.xxhash64(UID), F.lit(SALTS)).cast("int").alias("salt")
    )
    groups = rest.groupBy("class", "salt").agg(F.count("*").alias("n")).collect()  # (CLASSES + 1) * SALTS rows at most
    size = np.zeros((CLASSES + 1, SALTS), np.int64)
    for g in groups:
        size[g["class"], g["salt"]] = g["n"]
    base = np.cumsum(size, axis=1) - size
    combos = combinations(CLASSES)
    runs, used, n_sequences = _runs(repeats(size[1:].sum(axis=1), combos), combos)
    used = np.concatenate([[0], used])

    bases = spark.createDataFrame(
        [(c, s, int(base[c, s]), int(used[c])) for c, s in zip(*map(np.ndarray.tolist, np.nonzero(size)))], "class int, salt int, base bigint, used bigint"
    )
    order = W.partitionBy("class", "salt").orderBy(UID)
    ranked = (
        rest.withColumn("rn", F.row_number().over(order) - 1)
        .join(F.broadcast(bases), ["class", "salt"])
        .withColumn("rank", F.col("base") + F.col("rn"))
    )
    # The combinations' members, a run of ranks each.
    plan = spark.createDataFrame(runs, "class int, a bigint, b bigint, first bigint, each int, slot int")
    members = ranked.filter("rank < used").join(F.broadcast(plan), [ranked["class"] == plan["class"], ranked["rank"] >= plan["a"], ranked["rank"] < plan["b"]])
    at = F.col("rank") - F.col("a")
    members = members.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(at / F.col("each"))).alias("sequence_id"),
        (F.col("slot") + at % F.col("each")).alias("place"),
    )
    slots = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    members = members.withColumn("offset", F.coalesce(F.sum("length").over(slots), F.lit(0).cast("bigint"))).drop("place")

    # The residual, one after the other in a stream of tokens cut at each window's end.
    residual = ranked.filter("rank >= used").withColumn("before", F.sum("length").over(order) - F.col("length"))
    residual = written(residual.select(UID, "doc_id", "start", "length", "doc_tokens", "class", "salt", "before"), "residual")
    sums = residual.groupBy("class", "salt").agg(F.sum("length").alias("n")).orderBy("class", "salt").collect()
    total, offsets = 0, []
    for g in sums:
        offsets.append((g["class"], g["salt"], total))
        total += int(g["n"])
    streams = spark.createDataFrame(offsets, "class int, salt int, from bigint")
    tail, last = total - total % WINDOW, []  # the last window: powers of two
    bits = [1 << b for b in range(WINDOW.bit_length()) if (total % WINDOW) >> b & 1][::-1]
    for n in bits:
        last.append((tail, tail + n))
        tail += n
    edges = F.array(*(F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in last)) if last else F.array().cast("array<struct<a:bigint,b:bigint>>")
    full = total // WINDOW
    begin, finish = F.col("begin"), F.col("begin") + F.col("length")
    windows = F.transform(
        F.sequence(F.floor(begin / WINDOW), F.floor((finish - 1) / WINDOW)),
        lambda w: F.struct((w * WINDOW).alias("a"), ((w + 1) * WINDOW).alias("b"), w.alias("id")),
    )
    ends = F.transform(edges, lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), (F.lit(full) + i).cast("bigint").alias("id")))
    cells = F.filter(F.concat(F.filter(windows, lambda w: w["id"] < full), ends), lambda w: (w["a"] < finish) & (w["b"] > begin))
    cut = (
        residual.join(F.broadcast(streams), ["class", "salt"])
        .withColumn("begin", F.col("before") + F.col("from"))
        .select(UID, "doc_id", "start", "length", "doc_tokens", "begin", F.explode(cells).alias("w"))
        .withColumn("a", F.greatest("begin", "w.a"))
        .withColumn("b", F.least(F.col("begin") + F.col("length"), F.col("w.b")))
        .join(tokens.filter(F.col("length") < WINDOW).select(UID, "ids"), UID)
        .select(
            "doc_id",
            (F.col("start") + F.col("a") - F.col("begin")).alias("start"),
            (F.col("b") - F.col("a")).alias("length"),
            F.crc32(F.substr("ids", (4 * (F.col("a") - F.col("begin")) + 1).cast("int"), (4 * (F.col("b") - F.col("a"))).cast("int"))).alias("ids_crc32"),
            "doc_tokens",
            (F.col("w.id") + n_sequences).alias("sequence_id"),
            (F.col("a") - F.col("w.a")).alias("offset"),
        )
    )
    alone = whole.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col(UID) + n_sequences + full + len(last)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return alone.select(names).unionByName(members.select(names)).unionByName(cut.select(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
