"""Language-model scores by context-tree weighting over bytes.

The next byte is coded as eight binary decisions, most significant first.  Each decision
has a tree of contexts - the last none, one, two and three bytes - with a
Krichevsky-Trofimov estimate in every node.  A node's weighted probability is half its
own estimate and half the product of its children's; from the training counts that
gives each node its weight against everything below it, and a prediction mixes the
estimates of all depths with these weights.  A text's score is the sum of the log10
probabilities of its bytes and of an end mark; a context never seen in training takes
part with the depths that were.

Beside it stands a word baseline with add-one smoothing.

Scale: training counts (4-grams of bytes, words) are pre-aggregated in each task and
summed by Spark over all training documents.  All contexts take part.  The tables that
go to the tasks have the ``CONTEXTS`` most frequent three-byte contexts with 256 entries
each; of the rarer ones the tasks know only which there are (a bit each), and their bytes
are joined with estimates that Spark computes from their counts, two last bytes at a
time.  What reaches the driver of them is a sum for each two bytes.  Word counts are
not collected: the ``FREQUENT`` most frequent go to the tasks, all other words of
documents are joined with the counts.

Defined results: a null or empty text is the end alone; without training documents
every byte has probability 1/256 and the baseline knows nothing; repeated rows are
counted and scored as they stand, null ids hash as the empty text; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import NOT_SPACE, UID, Words, bits_of, chunks, in_bits, read_table, remainder, with_uid, written

CONTEXTS = 65_536
CONTEXT_BITS = 24
FREQUENT = 1 << 18
MARK = 255  # no byte of UTF-8 text: stands before and after each text
BLOCK = 1 << 21
FLUSH = 1_000_000

_WORD, _GRAM, _END = 0, 1, 2


def _marked(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with three marks before each and at the end; first byte and end mark of each."""
    data = np.frombuffer(b"\xff\xff\xff" + b"".join(p + b"\xff\xff\xff" for p in parts), np.uint8)
    sizes = np.fromiter((len(p) + 3 for p in parts), np.int64, len(parts))
    ends = np.cumsum(sizes)
    return data, 3 + ends - sizes, ends


def _contexts(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """The three bytes before each of the places a to b."""
    x = data[a - 3 : b].astype(np.uint32)
    n = b - a
    return (x[:n] << np.uint32(16)) | (x[1 : n + 1] << np.uint32(8)) | x[2 : n + 2]


class _Counts:
    """Sums counts by key within a task."""

    def __init__(self, kind: int):
        self.kind, self.keys, self.n, self.size = kind, [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.n.append(n)
        self.size += len(k)

    def merge(self) -> None:
        if len(self.keys) > 1:
            k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.keys, self.n, self.size = [k], [np.bincount(at, weights=np.concatenate(self.n)).astype(np.int64)], len(k)

    def rows(self):
        self.merge()
        if self.size:
            k, n = self.keys[0].astype(np.uint64).view(np.int64), self.n[0]
            for a in range(0, len(k), 100_000):
                m = len(k[a : a + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, self.kind, np.int32)), pa.array(k[a : a + m]), pa.array(n[a : a + m].astype(np.int64))], names=["kind", "key", "n"])
        self.keys, self.n, self.size = [], [], 0


def _count(batches):
    words, grams, docs = _Counts(_WORD), _Counts(_GRAM), 0
    for batch in batches:
        for _, parts in chunks(batch, "text"):
            docs += len(parts)
            words.add(Words(parts, NOT_SPACE, lower=True).hashes)
            data, _, ends = _marked(parts)
            for a in range(3, len(data), BLOCK):
                b = min(len(data), a + BLOCK)
                code = (_contexts(data, a, b).astype(np.uint64) << np.uint64(8)) | data[a:b]
                skip = np.concatenate([ends + 1, ends + 2]) - a  # the marks that stand before the next text
                keep = np.ones(b - a, bool)
                keep[skip[(skip >= 0) & (skip < b - a)]] = False
                grams.add(code[keep].astype(np.uint32))
            for c in (words, grams):
                if c.size > FLUSH:
                    c.merge()
                    if c.size > FLUSH // 2:
                        yield from c.rows()
    yield from words.rows()
    yield from grams.rows()
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([_END], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["kind", "key", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0 (Stirling's series after a shift)."""
    x = np.asarray(x, float)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    i = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + i / 12 - i**3 / 360 + i**5 / 1260 - shift


def _heap(counts: np.ndarray) -> np.ndarray:
    """Counts of 256 bytes as counts of the 511 nodes of their binary tree: node i has children 2 i and 2 i + 1."""
    out = np.zeros((len(counts), 512))
    out[:, 256:] = counts
    for i in range(255, 0, -1):
        out[:, i] = out[:, 2 * i] + out[:, 2 * i + 1]
    return out


def _kt(heap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the estimator's probability of what each of 256 nodes saw, and its estimate of a one."""
    n0, n1 = heap[:, 0::2], heap[:, 1::2]
    n0, n1 = n0.copy(), n1.copy()
    n0[:, 0] = n1[:, 0] = 0
    seen = n0 + n1 > 0
    log = np.zeros_like(n0)
    a, b = n0[seen], n1[seen]
    log[seen] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)
    return log, (n1 + 0.5) / (n0 + n1 + 1)


def _byte_logs(ones: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from the probability of a one at each node."""
    logs = np.zeros((len(ones), 512))
    zero, one = np.log10(1 - ones), np.log10(ones)
    for i in range(1, 256):
        logs[:, 2 * i] = logs[:, i] + zero[:, i]
        logs[:, 2 * i + 1] = logs[:, i] + one[:, i]
    return logs[:, 256:].astype(np.float32)


class Model:
    """Tables of log10 byte probabilities: one row for each context seen, at every depth."""

    def __init__(self, contexts: np.ndarray, bytes_: np.ndarray, n: np.ndarray, apart: np.ndarray, rare: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, bits: np.ndarray | None = None):
        """Counts of (three bytes as a number, next byte); apart: contexts without a table here.

        rare: of contexts that are not here the last two bytes, counts and ln of the estimator's
        probability, summed; bits: which contexts those are.
        """
        keys, at_first, row = np.unique(contexts.astype(np.int64), return_index=True, return_inverse=True)
        without = apart[at_first] if len(keys) else np.zeros(0, bool)
        more = np.zeros(0, np.int64) if rare is None else rare[0].astype(np.int64)
        two, parent = np.unique(np.concatenate([keys & 0xFFFF, more]), return_inverse=True)
        parent, others = parent[: len(keys)], parent[len(keys) :]
        one, grand = np.unique(two & 0xFF, return_inverse=True)
        order = np.argsort(row, kind="stable")
        at = np.searchsorted(row[order], np.arange(len(keys) + 1))
        counts2 = np.zeros((len(two), 256))
        below2 = np.zeros((len(two), 256))

        def block(a: int, b: int) -> np.ndarray:
            some = order[at[a] : at[b]]
            c = np.zeros((b - a, 256))
            np.add.at(c, (row[some] - a, bytes_[some].astype(int)), n[some])
            return c

        step = 2048
        for a in range(0, len(keys), step):
            b = min(len(keys), a + step)
            c = block(a, b)
            log, _ = _kt(_heap(c))
            np.add.at(counts2, parent[a:b], c)
            np.add.at(below2, parent[a:b], log)
        if rare is not None:
            np.add.at(counts2, others, rare[1])
            np.add.at(below2, others, rare[2])
        counts1, below1 = np.zeros((len(one), 256)), np.zeros((len(one), 256))
        counts0, below0 = np.zeros((1, 256)), np.zeros((1, 256))

        def inner(counts, below):
            log, p = _kt(_heap(counts))
            weight = 1 / (1 + np.exp(np.clip(below - log, -60, 60)))  # of the node's own estimate against what is below it
            return np.logaddexp(log, below) - math.log(2), p, weight

        def add(to, which, x):
            for a in range(0, len(x), step):
                np.add.at(to, which[a : a + step], x[a : a + step])

        w2, p2, s2 = inner(counts2, below2)
        add(counts1, grand, counts2)
        add(below1, grand, w2)
        w1, p1, s1 = inner(counts1, below1)
        if len(one):
            counts0[0], below0[0] = counts1.sum(axis=0), w1.sum(axis=0)
        _, p0, s0 = inner(counts0, below0)
        # Mixed from the root: a node's share of what is left, the rest goes to the next depth, or to the last that was seen.
        m0 = p0
        left1, sum1 = (1 - s0), s0 * p0
        m1 = sum1 + left1 * p1
        left2, sum2 = left1 * (1 - s1), sum1 + left1 * s1 * p1
        m2 = sum2[grand] + left2[grand] * p2
        left3, sum3 = left2[grand] * (1 - s2), sum2[grand] + left2[grand] * s2 * p2
        tables = [_byte_logs(m0), _byte_logs(m1), _byte_logs(m2)]
        self.parents, self.bits = two[others], bits
        self.above = (sum3[others], left3[others])
        kept = np.flatnonzero(~without)
        for a in range(0, len(keys), step):
            b = min(len(keys), a + step)
            _, p3 = _kt(_heap(block(a, b)))
            got = kept[(kept >= a) & (kept < b)]
            tables.append(_byte_logs(sum3[parent[got]] + left3[parent[got]] * p3[got - a]))
        self.table = np.concatenate(tables)
        self.one, self.two, self.three = one, two, keys[kept]
        self.rows: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"rows": None}

    def logs(self, contexts: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        if self.rows is None:  # the table's row for every three bytes
            at1 = np.zeros(256, np.int32)
            at1[self.one] = 1 + np.arange(len(self.one))
            at2 = np.tile(at1, 256)
            at2[self.two] = 1 + len(self.one) + np.arange(len(self.two))
            rows = np.tile(at2, 256)
            rows[self.three] = 1 + len(self.one) + len(self.two) + np.arange(len(self.three))
            self.rows = rows
        return self.table.ravel()[self.rows[contexts].astype(np.int64) * 256 + nxt]

    def rare_logs(self, two: int, contexts: np.ndarray, bytes_: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rare contexts that end with two bytes, from their counts: the contexts, and a row of byte logs for each."""
        keys, row = np.unique(contexts, return_inverse=True)
        c = np.zeros((len(keys), 256))
        np.add.at(c, (row, bytes_.astype(int)), n)
        at = int(np.searchsorted(self.parents, two))
        return keys, _byte_logs(self.above[0][at] + self.above[1][at] * _kt(_heap(c))[1])

    def score(self, parts: list[bytes], rest: list | None = None) -> np.ndarray:
        """Scores of texts.  Bytes after rare contexts count nothing; (text, four bytes as a number) of each are added to rest."""
        data, starts, ends = _marked(parts)
        out = np.zeros(len(parts))
        for a in range(3, len(data), BLOCK):
            b = min(len(data), a + BLOCK)
            contexts = _contexts(data, a, b)
            logs = self.logs(contexts, data[a:b])
            if self.bits is not None:
                gone = np.flatnonzero(in_bits(self.bits, contexts))
                logs[gone] = 0
                text = np.searchsorted(ends, a + gone)
                ok = a + gone >= np.append(starts, len(data))[text]  # not the marks that stand before a text
                rest.append((text[ok], (contexts[gone[ok]].astype(np.int64) << 8) | data[a + gone[ok]]))
            total = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
            lo, hi = np.clip(starts, a, b) - a, np.clip(ends + 1, a, b) - a
            out += total[hi] - total[lo]
        return out


def _sums(table: pa.Table) -> pa.Table:
    """The contexts that end with two bytes: their counts and ln of the estimator's probability, added up."""
    keys, row = np.unique(table.column("c").to_numpy(), return_inverse=True)
    c = np.zeros((len(keys), 256))
    np.add.at(c, (row, table.column("b").to_numpy().astype(int)), table.column("n").to_numpy())
    return pa.table(
        {
            "two": pa.array([int(keys[0] & 0xFFFF)]), "counts": pa.array([c.sum(axis=0).tolist()]), "logs": pa.array([_kt(_heap(c))[0].sum(axis=0).tolist()]),
        }
    )


def fit(counts: DataFrame) -> tuple[Model, DataFrame]:
    """The tree from counts (kind, key, n) with tables of the CONTEXTS most frequent three bytes, and the counts (c, b, n, two) of all others."""
    grams = counts.filter(F.col("kind") == _GRAM).select(F.shiftright("key", 8).alias("c"), F.col("key").bitwiseAND(F.lit(255)).alias("b"), "n")
    kept = written(grams.groupBy("c").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "c").limit(CONTEXTS).select("c"), "contexts")
    rows = grams.join(F.broadcast(kept), "c", "left_semi").toArrow()
    others = grams.join(F.broadcast(kept), "c", "left_anti").withColumn("two", F.col("c").bitwiseAND(F.lit(0xFFFF)))
    sums = others.groupBy("two").applyInArrow(_sums, "two bigint, counts array<double>, logs array<double>").toArrow()
    get = lambda name: rows.column(name).to_numpy()
    rare = bits = None
    if sums.num_rows:
        sums = sums.sort_by("two").combine_chunks()
        values = lambda name: sums.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        rare = (sums.column("two").to_numpy(), values("counts").reshape(-1, 256), values("logs").reshape(-1, 256))
        bits = bits_of(others, "c", CONTEXT_BITS)
    return Model(get("c"), get("b"), get("n"), np.zeros(rows.num_rows, bool), rare, bits), others


def _rare_logs(model):
    """For a cogroup of the bytes that are looked up and the counts: log10 of each one's probability."""

    def found(wanted: pa.Table, counts: pa.Table) -> pa.Table:
        code = wanted.column("code").to_numpy()
        if not len(code) or not counts.num_rows:
            return pa.table({"code": pa.array([], pa.int64()), "log": pa.array([], pa.float64())})
        c, b, n = (counts.column(x).to_numpy() for x in ("c", "b", "n"))
        keys, logs = model.value[0].rare_logs(int(code[0] >> 8 & 0xFFFF), c, b, n)
        return pa.table({"code": pa.array(code), "log": pa.array(logs[np.searchsorted(keys, code >> 8), code & 255].astype(float))})

    return found


_SCORED = "n_words bigint, sum_log double, n_known bigint, rare array<bigint>, score double, rest array<bigint>"


def _score(batches, model: Model, words: np.ndarray, n: np.ndarray):
    log = np.log10(n + 1.0)
    for batch in batches:
        for first, parts in chunks(batch, "text"):
            w = Words(parts, NOT_SPACE, lower=True)
            doc = np.repeat(np.arange(len(parts)), np.diff(w.ptr))
            at = np.searchsorted(words, w.hashes).clip(max=max(0, len(words) - 1))
            found = words[at] == w.hashes if len(words) else np.zeros(len(w.hashes), bool)
            known = np.bincount(doc[found], minlength=len(parts))
            total = np.bincount(doc[found], weights=log[at[found]], minlength=len(parts))
            rare, rare_doc = w.hashes[~found].view(np.int64), doc[~found]
            edges = np.searchsorted(rare_doc, np.arange(len(parts) + 1)).astype(np.int32)
            some = batch.slice(first, len(parts))
            rest: list = []
            logs = model.score(parts, rest)
            text, code = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*rest) if rest else ((), ())))
            places = np.searchsorted(text, np.arange(len(parts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(some.column(c) for c in (UID, "doc_id", "held_out")),
                    pa.array(np.diff(w.ptr).astype(np.int64)), pa.array(total.astype(float)), pa.array(known.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(rare)), pa.array(logs),
                    pa.ListArray.from_arrays(pa.array(places), pa.array(code, pa.int64())),
                ],
                names=[UID, "doc_id", "held_out", "n_words", "sum_log", "n_known", "rare", "score", "rest"],
            )


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Per row of docs (_q_uid, doc_id, held_out, text): the columns of the query, learnt from training (text)."""
    spark = docs.sparkSession
    raw = training.select("text").mapInArrow(_count, "kind int, key bigint, n bigint")
    counts = written(raw.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    model, others = fit(counts)
    totals = {r["kind"]: (r["n"], r["v"]) for r in counts.filter(F.col("kind") != _GRAM).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    (n_words, v_words), (n_docs, _) = totals.get(_WORD, (0, 0)), totals.get(_END, (0, 0))
    n, v = n_words + n_docs, v_words + (n_docs > 0)
    frequent = counts.filter(F.col("kind") == _WORD).orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n").toArrow()
    keys, order = frequent.column("key").to_numpy().view(np.uint64), None
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((model, keys[order], frequent.column("n").to_numpy()[order]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = written(
        docs.select(UID, "doc_id", "held_out", "text").mapInArrow(lambda it: _score(it, *sent.value), f"{UID} bigint, doc_id {kind}, held_out boolean, " + _SCORED), "scored"
    )
    rare = (
        scored.select(UID, F.explode("rare").alias("key"))
        .join(counts.filter(F.col("kind") == _WORD).select("key", "n"), "key")
        .groupBy(UID)
        .agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_log"), F.count("*").alias("rare_known"))
    )
    score_log = F.col("score")
    if model.bits is not None:
        looked_up = written(scored.select(UID, F.explode("rest").alias("code")).groupBy(UID, "code").agg(F.count("*").alias("times")), "looked_up")
        wanted = looked_up.select("code").distinct().withColumn("two", F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF)))
        logs = wanted.groupBy("two").cogroup(others.groupBy("two")).applyInArrow(_rare_logs(sent), "code bigint, log double")
        rest = looked_up.join(logs, "code").groupBy(UID).agg(F.sum(F.col("times") * F.col("log")).alias("rest_log"))
        scored = scored.join(rest, UID, "left")
        score_log = F.col("score") + F.coalesce("rest_log", F.lit(0.0))
    unit = F.lit(math.log10(n + v + 1))
    zero = F.lit(0).cast("bigint")
    return scored.join(rare, UID, "left").select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", zero) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("sum_log") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(math.log10(n_docs + 1)) - (F.col("n_words") + 1) * unit).alias("base_score"),
        score_log.alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    docs = with_uid(documents).select(UID, "doc_id", held_out.alias("held_out"), "text")
    return score(docs, documents.filter(~held_out))
