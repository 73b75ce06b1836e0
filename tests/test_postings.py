"""Stored postings: what they find, what they read, and when they are built again."""

import random
import re
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import postings, search
from quarry.sources import stored


@pytest.fixture
def shop(spark, tmp_path):
    """A source of documents, and index names of its own."""
    source, own = str(tmp_path / "docs"), uuid.uuid4().hex

    def write(rows):
        spark.createDataFrame(rows, "key string, text string, token string, bucket int").write.mode("append").parquet(source)

    def index(name="words", words=search.words, **more):
        return postings.index(spark, [source], spark.read.parquet(source), "key", words(F.col("text")), f"{name}-{own}", **more)

    return write, index, source


def rows(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["of", "the", "data", "函数", "单调", "递增", r"\frac", "x_y", "naïve", "Of", "，", "  "]
    odd = [("d1", None, "t", 1), ("d2", "", "t", 1), ("d3", "of of of", "t", 1), ("d4", " \n", "t", 1), ("d5", "the " * 5000, "t", 1)]
    return odd + [(f"k{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), "t", 2) for i in range(n)]


QUERIES = ["of", "单调递增", "of_the, data", "of_of", "函数 递增 data", "", "frac", "the unknown"]


def scores(found):
    return {r["key"]: round(r["score"], 9) for r in found.collect()}


def test_finds_what_a_scan_finds(spark, shop):
    write, index, source = shop
    write(rows(300))
    at, docs = index(), spark.read.parquet(source)
    for q in QUERIES:
        assert scores(postings.search_phrases(spark, at, q)) == scores(search.phrase_search(docs, "key", search.searchable(F.col("text")), q)), q
    at = index("tokens", search.tokens)
    for q in ("OF the", "none", "函 数"):
        assert scores(postings.search_words(spark, at, q)) == scores(search.bm25(docs, "key", "text", q)), q
    assert len(postings.best(spark, at, "of", 0).collect()) == 1


def test_reads_only_the_buckets_of_its_words(spark, shop):
    write, index, _ = shop
    write(rows(200))
    at = index()
    asked, _ = postings.postings(spark, at, ["of", "data"])
    assert asked.agg(F.countDistinct("token")).first()[0] == 2
    buckets = {re.search(r"bucket=(\d+)", f)[1] for f in asked.inputFiles()}
    used = {str(r[0]) for r in asked.select("bucket").distinct().collect()}
    assert len(used) <= 2 and used <= buckets
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(token" in plan
    folders = list(Path(at.folder, "postings").glob("bucket=*"))
    assert len(folders) > 5


def test_a_frequent_word_fills_several_files(spark, shop, monkeypatch):
    """Four tasks read the source, so there are four chunks of documents, dealt over many salts."""
    monkeypatch.setattr(postings, "SALT_BYTES", 10)
    write, index, _ = shop
    write([(f"k{i}", "same word", "t", 1) for i in range(500)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at = index()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [list(p.glob("*.parquet")) for p in Path(at.folder, "postings").glob("bucket=*")]
    assert max(map(len, files)) >= 2 and len(scores(postings.search_phrases(spark, at, "same_word"))) == 500


def test_built_again_when_a_file_changes(spark, shop):
    write, index, source = shop
    write(rows(20))
    first, again = index(), index()
    root = first.folder.rpartition("/")[0]
    assert first.built and not again.built and again.folder == first.folder
    write([("new", "entirely new words", "t", 1)])
    newer = index()
    assert newer.built and newer.folder != first.folder and set(scores(postings.search_phrases(spark, newer, "entirely_new"))) == {"new"}
    assert scores(postings.search_phrases(spark, first, "entirely")) == {}  # who still reads the old one finds what it held
    assert stored.prune(spark, root) == 1 and stored.current(spark, root).folder == newer.folder
    assert index("words", force=True).built
    stored.invalidate(spark, root)
    assert stored.status(spark, root) == {"exists": False, "current": False, "bytes": 0} and index().built
    sign = stored.current(spark, root).signature
    assert stored.status(spark, root, sign)["current"] and stored.status(spark, root, "other") | {"bytes": 0} == {"exists": True, "current": False, "bytes": 0}


def test_a_build_that_fails_changes_nothing(spark, shop):
    write, index, _ = shop
    write(rows(5))
    kept = index()
    root = kept.folder.rpartition("/")[0]

    def fails(folder):
        spark.range(1).write.parquet(f"{folder}/part")
        raise RuntimeError("half way")

    with pytest.raises(RuntimeError):
        stored.ensure(spark, root, "another signature", fails)
    assert stored.current(spark, root) == stored.Stored(kept.folder, kept.signature) and not index().built


def test_empty_source(spark, shop):
    write, index, _ = shop
    write([])
    assert postings.search_phrases(spark, index(), "of").count() == 0
