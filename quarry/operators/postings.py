"""A stored positional index: postings by token, and phrase search that reads only its words' buckets.

Postings (token, key, length, positions) lie in ``BUCKETS`` folders by the token's hash and are
sorted by token and key inside.  A bucket is dealt over salts by the key's hash, one per
``SALT_BYTES`` of the source, so the postings of one very frequent token fill many files and
no task gets them all.  A phrase is found by intersecting the positions of its words, each
shifted by its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.sources import stored

BUCKETS, SALT_BYTES = 64, 4_000_000
CHUNK_WORDS = 1_000_000
FORMAT = "3"


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of some documents: which of them hold it, how long they are, and where it stands in each."""
    for batch in batches:
        words = batch.column("words")
        ends = np.cumsum(np.asarray(pc.list_value_length(words)))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + CHUNK_WORDS, side="right")))
            yield _postings(batch.column("key").slice(first, last - first), words.slice(first, last - first))
            first = last


def _postings(keys: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
    sizes = np.asarray(pc.list_value_length(words)).astype(np.int64)
    known = words.flatten().dictionary_encode()
    document = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(document)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    both = known.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(sizes)) + document
    order = np.argsort(both, kind="stable")
    starts = np.flatnonzero(np.diff(both[order], prepend=-1))  # of a document's places of a word
    held, token = document[order[starts]], both[order[starts]] // max(1, len(sizes))
    firsts = np.flatnonzero(np.diff(token, prepend=-1))  # of a word's documents
    begins = starts - np.repeat(starts[firsts], np.diff(np.append(firsts, len(starts))))  # in the word's places
    by_word = lambda values: pa.ListArray.from_arrays(pa.array(np.append(firsts, len(starts)), pa.int32()), values)
    places = pa.ListArray.from_arrays(pa.array(np.append(starts[firsts], len(order)), pa.int32()), pa.array(place[order], pa.int32()))
    columns = [known.dictionary.take(pa.array(token[firsts])), by_word(keys.take(pa.array(held))), by_word(pa.array(sizes[held], pa.int32())), by_word(pa.array(begins, pa.int32())), places]
    return pa.RecordBatch.from_arrays(columns, ["token", "keys", "lengths", "starts", "places"])


def write(docs: DataFrame, key: str, words: Column, folder: str, buckets: int = BUCKETS, salts: int = 1) -> None:
    """Postings of documents given by their words in order, and totals; a null text has no words.  Keys are taken to be unique."""
    rows = docs.select(F.col(key).alias("key"), words.alias("words"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_grouped, f"token string, keys array<{kind}>, lengths array<int>, starts array<int>, places array<int>")
    # One shuffle, of a row for each word and chunk of documents; a chunk goes to one of the word's salts.
    dealt = found.repartition(_bucket(F.col("token"), buckets), F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(salts)))
    after = F.coalesce(F.get("starts", F.col("i") + 1), F.size("places"))
    out = dealt.select("*", F.posexplode("keys").alias("i", "key")).select(
        "token", "key", F.get("lengths", F.col("i")).alias("length"), F.slice("places", F.get("starts", F.col("i")) + 1, after - F.get("starts", F.col("i"))).alias("positions")
    )
    out.withColumn("bucket", _bucket(F.col("token"), buckets)).sortWithinPartitions("bucket", "token", "key").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/postings")
    totals = rows.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg"))
    totals.withColumns({"buckets": F.lit(buckets), "key_type": F.lit(kind)}).coalesce(1).write.parquet(f"{folder}/totals")


def index(spark: SparkSession, sources: list[str], docs: DataFrame, key: str, words: Column, name: str, force: bool = False) -> stored.Stored:
    """The index of documents that are read from sources; built if none stands for these files.  name tells indexes of different words apart."""
    definition = repr((FORMAT, BUCKETS, key, name, docs.schema.simpleString()))
    root = f"{stored.home(spark)}/postings-{name}"
    salts = max(1, stored.size(spark, sources) // (BUCKETS * SALT_BYTES))
    return stored.ensure(spark, root, stored.signature(spark, sources, definition), lambda folder: write(docs, key, words, folder, salts=salts), force)


def postings(spark: SparkSession, at: stored.Stored, tokens: list[str]) -> tuple[DataFrame, DataFrame]:
    """The postings of some tokens, read from their buckets only, and the totals (one row)."""
    totals = spark.read.parquet(f"{at.folder}/totals")
    kept = totals.first()
    buckets = kept["buckets"]
    wanted = [zlib.crc32(t.encode()) % buckets for t in tokens]
    rows = spark.read.schema(f"token string, key {kept['key_type']}, length int, positions array<int>, bucket int").parquet(f"{at.folder}/postings")
    return rows.filter(F.col("bucket").isin(*sorted(set(wanted))) & F.col("token").isin(*tokens)), totals


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by) if by else positions


def phrase_hits(spark: SparkSession, at: stored.Stored, asked: list[list[str]]) -> DataFrame:
    """key and score of the documents that hold every phrase (a list of words); BM25 with a phrase as the unit.  Nothing without a phrase."""
    words = sorted({w for phrase in asked for w in phrase})
    rows, totals = postings(spark, at, words)
    # A document has at most one posting a word, so max() picks it.
    held = rows.groupBy("key").agg(F.max("length").alias("length"), *(F.max(F.when(F.col("token") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(words)))
    place = {w: F.col(f"p{i}") for i, w in enumerate(words)}
    tf = [F.coalesce(F.greatest(F.size(reduce(F.array_intersect, (_shifted(place[w], k) for k, w in enumerate(phrase)))), F.lit(0)), F.lit(0)) for phrase in asked]
    counted = held.select("key", "length", *(t.alias(f"tf{i}") for i, t in enumerate(tf)))
    found = counted.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked)))) if asked else None
    stats = totals.select("n", "avg") if found is None else totals.select("n", "avg").crossJoin(found)  # one row each
    return search.ranked(counted, stats, len(asked))


def search_phrases(spark: SparkSession, at: stored.Stored, query: str) -> DataFrame:
    """What search.phrase_search() finds, from the index of the words of searchable()."""
    return phrase_hits(spark, at, [p.split() for p in search.phrases(query)])


def search_words(spark: SparkSession, at: stored.Stored, query: str) -> DataFrame:
    """What search.bm25() finds, from the index of tokens()."""
    return phrase_hits(spark, at, [[w] for w in sorted(set(query.lower().split()))])


def best(spark: SparkSession, at: stored.Stored, query: str, limit: int = 2000) -> DataFrame:
    """The best of search_phrases(); the limit is held to 1 to 10000."""
    return search_phrases(spark, at, query).orderBy(F.desc("score"), "key").limit(max(1, min(limit, 10_000)))
