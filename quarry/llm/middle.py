"""Fill-in-middle transformation by succinct rank and select.

Where a token (a run of ASCII letters, or any other single character) begins is one bit
per byte of UTF-8, packed into words, with a directory of popcounts per block of
``BLOCK`` bits.  The directory's total is the number of tokens n; two pseudo-random
numbers of a document's id, mod n + 1, are ranks, and select on them gives the byte
cuts.  A second vector marks where characters begin and turns byte cuts into code points.
Cutting and joining itself is done by Spark on the bytes it holds; a task's Python side
sees a chunk of about 2 MB of text at a time and returns five numbers a text.

Scale: one pass over the rows, no shuffle, no key, nothing on the driver; a lost executor
costs its tasks alone.  Whole texts, whatever their length.

Defined results: a null text counts as empty, an empty text is plain; a null id hashes as
the empty text; rows, repeated or not, are transformed one by one; an empty table gives
an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import chunks, read_table

SEED = "1:"
#: Percent of texts that stay plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 512
#: Ranks that one select resolves at once: each takes a row of BLOCK counts.
SELECT_ROWS = 4096

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes that begin a character: all but the continuation bytes of UTF-8.
_FIRST = (np.arange(256) & 0xC0) != 0x80


class Bits:
    """A bit vector with rank and select: packed words, and the number of set bits before each block."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        room = -(-max(1, len(bits)) // BLOCK) * (BLOCK // 8)
        self.blocks = np.concatenate([packed, np.zeros(room - len(packed), np.uint8)]).reshape(-1, BLOCK // 8)
        counts = np.bitwise_count(self.blocks.view(np.uint64)).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        out = np.empty(len(at), np.int64)
        for a in range(0, len(at), SELECT_ROWS):
            p = np.asarray(at[a : a + SELECT_ROWS])
            block = np.minimum(p // BLOCK, len(self.blocks) - 1)
            mask = np.packbits(np.arange(BLOCK) < (p - block * BLOCK)[:, None], axis=1, bitorder="little")
            out[a : a + SELECT_ROWS] = self.before[block] + np.bitwise_count(self.blocks[block] & mask).sum(axis=1, dtype=np.int64)
        return out

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of the set bit that has so many set bits before it."""
        out = np.empty(len(ranks), np.int64)
        for a in range(0, len(ranks), SELECT_ROWS):
            r = np.asarray(ranks[a : a + SELECT_ROWS])
            block = np.searchsorted(self.before, r, side="right") - 1
            inside = np.cumsum(np.unpackbits(self.blocks[block], axis=1, bitorder="little"), axis=1, dtype=np.int16)
            out[a : a + SELECT_ROWS] = block * BLOCK + (inside > (r - self.before[block])[:, None]).argmax(axis=1)
        return out


def cuts(texts: list[bytes], one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its tokens, the byte places of both cuts, and the code points before each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(sizes)
    first = end - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    letter = _LETTER[data]
    begins = _FIRST[data] & ~letter
    begins[1:] |= letter[1:] & ~letter[:-1]
    begins[first[(sizes > 0) & (first < len(data))]] = True
    tokens, characters = Bits(begins), Bits(_FIRST[data])
    base = tokens.rank(first)
    n = tokens.rank(end) - base
    ranks = np.stack([np.minimum(one % (n + 1), other % (n + 1)), np.maximum(one % (n + 1), other % (n + 1))], axis=1)
    byte = np.broadcast_to(end[:, None], ranks.shape).copy()
    inside = ranks < n[:, None]
    byte[inside] = tokens.select((ranks + base[:, None])[inside])
    chars = characters.rank(byte.ravel()).reshape(-1, 2) - characters.rank(first)[:, None]
    return n, byte - first[:, None], chars


_CUTS = T.StructType([T.StructField(c, T.IntegerType() if c in "ab" else T.LongType()) for c in ("n", "a", "b", "chars_a", "chars_b")])


@F.arrow_udf(_CUTS)
def _cut(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    batch = pa.record_batch([text], ["text"])
    h1, h2 = np.asarray(one), np.asarray(other)
    found = [cuts(t, h1[a : a + len(t)], h2[a : a + len(t)]) for a, t in chunks(batch, "text")]
    found = found or [(np.empty(0, np.int64), np.empty((0, 2), np.int64), np.empty((0, 2), np.int64))]
    n, byte, chars = (np.concatenate(x) for x in zip(*found))
    columns = [n, *byte.astype(np.int32).T, *chars.T]
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["n", "a", "b", "chars_a", "chars_b"])


def numbers(key: Column, seed: str = SEED) -> list[Column]:
    """Four numbers of 32 bits from the hash of an id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def with_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "_q_fim", seed: str = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with a struct: n tokens, form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output."""
    h1, h2, h3, h4 = numbers(F.col(key), seed)
    t = F.coalesce(F.col(text), F.lit(""))
    stays = (t == "") | t.rlike("|".join((PREFIX, SUFFIX, MIDDLE))) | (h3 % 100 >= 100 - plain)
    form = F.when(stays, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    cut = docs.withColumn(out, F.struct(_cut(t, h1, h2).alias("c"), form.alias("form")))
    a, b, form, raw = F.col(f"{out}.c.a"), F.col(f"{out}.c.b"), F.col(f"{out}.form"), F.coalesce(F.col(text), F.lit("")).cast("binary")
    part = lambda x, y: F.substring(raw, x + 1, y - x).cast("string")
    prefix, middle, suffix = part(F.lit(0), a), part(a, b), part(b, F.length(raw))
    output = (
        F.when(form == "plain", F.coalesce(F.col(text), F.lit("")))
        .when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    drawn = form != "plain"
    made = F.struct(
        F.col(f"{out}.c.n").alias("n"),
        form.alias("form"),
        F.when(drawn, F.col(f"{out}.c.chars_a")).alias("prefix_chars"),
        F.when(drawn, F.col(f"{out}.c.chars_b") - F.col(f"{out}.c.chars_a")).alias("middle_chars"),
        output.alias("output"),
    )
    return cut.withColumn(out, made)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.  Texts that hold a mark stay plain, so each mark stands once."""
    before = lambda s, mark: F.substring_index(s, mark, 1)
    after = lambda s, mark: F.substring_index(s, mark, -1)
    middle = after(output, MIDDLE)
    rest = before(output, MIDDLE)
    prefix = F.when(form == "psm", after(before(rest, SUFFIX), PREFIX)).otherwise(after(rest, PREFIX))
    suffix = F.when(form == "psm", after(rest, SUFFIX)).otherwise(after(before(rest, PREFIX), SUFFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_q_fim.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tok, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT *, len(tok) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(tok) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(tok) + 1) AS y,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(tok[1:least(x, y)], '') AS p, array_to_string(tok[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(tok[greatest(x, y) + 1:], '') AS s FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f"""
