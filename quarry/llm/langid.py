"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled
text.  A document is parsed against each automaton into phrases, each the longest match
that continues from where the last one ended; a phrase costs log2 of the automaton's
text length, so bits per letter estimate the cross entropy.  The language that needs
the fewest normalised phrases wins.

Texts are read as letters: lower case, anything but a letter becomes one space.  The
symbols of an automaton are the bytes of the letters in UTF-8, so each language has the
alphabet of its own sample, no letter is left out and scripts of thousands of letters
need no more than 256 columns.  All documents of a batch are parsed together, segment by
segment, with one table lookup per byte and language (numpy); a parse starts anew every
``SEGMENT`` bytes, for all languages alike.

The classifier is fitted on ``SAMPLE_LETTERS`` letters for each label, or on an equal
share of ``ALL_LETTERS`` where there are many labels: stretches of ``SAMPLE_DOC_LETTERS``
letters, at a place that a hash decides, of labelled documents in hash order.  Every
label is learnt.  Everything else reads whole texts of all rows.

Scale: one pass, no shuffle but the label counts and the sample; the broadcast is the
sample, whose size ``ALL_LETTERS`` bounds, and a row for each label.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal
costs go to the label that sorts first; a table without labels gives ``und``; repeated
rows are judged alike; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import chunks, held, read_table, remainder

SAMPLE_LETTERS = 60_000
ALL_LETTERS = 480_000
SAMPLE_DOC_LETTERS = 3_000
SEGMENT = 2048
UNDETERMINED = "und"

_COUNT = np.int32(1 << 30)
_STATE = np.int32((1 << 30) - 1)


def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_letters: list[np.ndarray] = []


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, one after the other, and the count of each text's."""
    if not _letters:
        _letters.append(_is_letter())
    lows = [t.lower() for t in texts]
    joined = "\n".join(lows)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in lows), np.int64, len(lows))
    doc = np.repeat(np.arange(len(lows)), sizes)[: len(code)]
    ok = _letters[0][code]
    first = np.zeros(len(code), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0].clip(max=max(0, len(code) - 1))] = True
    before = np.concatenate([[False], ok[:-1]]) & ~first
    keep = ok | before  # a letter, or the first other character after one
    code = np.where(ok, code, 32)[keep]
    return code, np.bincount(doc[keep], minlength=len(lows))


def automaton(codes: np.ndarray, classes: int) -> np.ndarray:
    """Suffix automaton over class numbers as a table: next state, with _COUNT set where a phrase ends and the next starts at the root."""
    size = 2 * len(codes) + 2
    nxt = np.full((size, classes), -1, np.int32)
    link, length = [-1] * size, [0] * size
    last, used = 0, 1
    for c in codes.tolist():
        cur = used
        used += 1
        length[cur] = length[last] + 1
        p = last
        while p != -1 and nxt[p, c] < 0:
            nxt[p, c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = int(nxt[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = used
                used += 1
                length[clone] = length[p] + 1
                nxt[clone] = nxt[q]
                link[clone] = link[q]
                while p != -1 and nxt[p, c] == q:
                    nxt[p, c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    nxt = nxt[:used]
    root = np.where(nxt[0] < 0, 0, nxt[0]).astype(np.int32)
    return np.where(nxt < 0, root[None, :] | _COUNT, nxt).ravel()


def _bytes(code: np.ndarray) -> np.ndarray:
    return np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)


class Parser:
    """The automata of all languages, each over the bytes of its own letters."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.lookups, self.widths, self.tables, self.cost = [], [], [], []
        for name in self.names:
            data = _bytes(letters([samples[name]])[0])
            own = np.unique(data)
            lookup = np.full(256, len(own), np.int32)  # the last class: bytes that the sample does not have
            lookup[own] = np.arange(len(own))
            self.lookups.append(lookup)
            self.widths.append(np.int32(len(own) + 1))
            self.tables.append(automaton(lookup[data], len(own) + 1))
            self.cost.append(np.log2(max(2, len(data))))
        self.cost = np.array(self.cost)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and letters per text."""
        code, letters_ = letters(texts)
        symbols = _bytes(code)
        width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        sizes = np.bincount(np.repeat(np.arange(len(texts)), letters_), weights=width, minlength=len(texts)).astype(np.int64)
        n_segments = np.maximum(0, -(-sizes // SEGMENT))
        doc = np.repeat(np.arange(len(texts)), n_segments)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
        start = np.repeat(np.cumsum(sizes) - sizes, n_segments) + nth * SEGMENT
        length = np.minimum(SEGMENT, sizes[doc] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        start, length, doc = start[order], length[order], doc[order]
        out = np.zeros((len(texts), len(self.names)))
        if not len(doc):
            return out, letters_
        alive = np.searchsorted(-length, -np.arange(length[0]), side="left")  # segments longer than t
        state = np.zeros((len(self.names), len(doc)), np.int32)
        count = np.ones((len(self.names), len(doc)), np.int32)  # the phrase that is open at the end
        for t in range(int(length[0])):
            m = int(alive[t])
            c = symbols[start[:m] + t]
            for k, table in enumerate(self.tables):
                x = table[state[k, :m] * self.widths[k] + self.lookups[k][c]]
                count[k, :m] += x >> 30
                state[k, :m] = x & _STATE
        for k in range(len(self.names)):
            out[:, k] = np.bincount(doc, weights=count[k], minlength=len(texts))
        return out, letters_

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, score (how much cheaper than the next language, 0 to 1) and bits per letter."""
        counts, sizes = self.phrases(texts)
        has = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = counts * self.cost / np.maximum(1, sizes)[:, None]
        best = np.argmin(bits, axis=1)
        ordered = np.sort(bits, axis=1)
        # Posterior odds of the two cheapest over the text, at most 64 phrases' worth of evidence.
        gap = (ordered[:, 1] - ordered[:, 0]) * np.minimum(sizes, 64) if len(self.names) > 1 else np.full(len(texts), 64.0)
        score = np.where(has, 1 / (1 + np.exp2(-np.minimum(gap, 60.0))), 0.0)
        return [self.names[b] if h else UNDETERMINED for b, h in zip(best.tolist(), has.tolist())], score, np.where(has, ordered[:, 0], 0.0)


def training_sample(labelled: DataFrame) -> dict[str, str]:
    """The sample of each label of labelled (doc_id, text, lang)."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    each = min(SAMPLE_LETTERS, ALL_LETTERS // len(counts))
    most = -(-4 * each // SAMPLE_DOC_LETTERS)  # documents a label, some of them short
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = rows.sparkSession.createDataFrame([(k, int(min(1.0, 2 * most / n) * (1 << 30))) for k, n in counts.items()], "lang string, share long")
    begin = F.pmod(F.hash("doc_id", "text"), F.greatest(F.lit(1), F.length("text") - (SAMPLE_DOC_LETTERS - 1))) + 1
    picked = (
        rows.withColumn("lang", F.col("lang").cast("string"))
        .withColumn("_q_h", hashed)
        .join(F.broadcast(share), "lang")  # a row for each label
        .filter("_q_h < share")
        .select("lang", "_q_h", F.substr("text", begin, F.lit(SAMPLE_DOC_LETTERS)).alias("text"))
        .withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy("_q_h", "text")))  # about 2 * most rows a label
        .filter(F.col("rn") <= most)
        .orderBy("lang", "rn")
        .collect()
    )
    out: dict[str, str] = {}
    for r in picked:
        if len(out.get(r["lang"], "")) < each:
            out[r["lang"]] = (out.get(r["lang"], "") + " " + r["text"])[: each + 1]
    return out


def _identify(batches, samples: dict[str, str], text: str):
    parser = held(("automata", *sorted(samples.items())), lambda: Parser(samples))
    for batch in batches:
        labels, scores, bits = [], [], []
        for _, parts in chunks(batch, text):
            a, b, c = parser.predict([p.decode("utf-8", "replace") for p in parts])
            labels += a
            scores += b.tolist()
            bits += c.tolist()
        arrays = [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "lang_pred", "score", "bits_per_letter"])


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text") -> DataFrame:
    """docs and lang_pred, score and bits_per_letter, learnt from labelled (doc_id, text, lang).  docs must not have columns of these names."""
    taken = {"lang_pred", "score", "bits_per_letter"} & set(docs.columns)
    if taken:
        raise ValueError(f"docs has columns of the result's names: {sorted(taken)}")
    samples = docs.sparkSession.sparkContext.broadcast(training_sample(labelled))
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_letter", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in fields)])
    return docs.mapInArrow(lambda it: _identify(it, samples.value, text), schema)


def learnable(documents: DataFrame) -> DataFrame:
    """The documents that may be learnt from."""
    return documents.filter(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    docs = documents.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return identify(docs, learnable(documents)).drop("text")
