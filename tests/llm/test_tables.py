"""Empty tables, and the pipeline."""

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, extract, jaccard, langid, packing, pii, scoring, substrings, warc
from quarry.llm.common import read_table
from tests.llm.conftest import ODD


def test_empty_tables(spark, make_docs, tmp_path):
    d = str(tmp_path)
    make_docs([]).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    for module in (decontaminate, extract, jaccard, langid, packing, pii, scoring, substrings, warc):
        assert module.query(spark, d).count() == 0, module.__name__
    assert corpus_pipeline.run(spark, d).count() == 0


def test_pipeline_stages(spark, make_docs, tmp_path):
    d = str(tmp_path)
    body = " ".join(f"word{i}" for i in range(80))
    passage = " ".join(f"bench{i}" for i in range(20))
    texts = [body, body, body + " more", passage + " and some words", "mail me at a@b.cd please today now", *(t for t in ODD if t is None or len(t) < 300_000), "clean and plain text of its own"]
    rows = [*enumerate(texts), (None, "a row without an id")]
    make_docs(rows, ["en"] * len(rows)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = read_table(spark, d, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept[0] == body and 1 not in kept and 2 not in kept and 3 not in kept
    assert kept[4] == "mail me at [EMAIL] please today now" and None in kept
    assert all(any(map(str.isalpha, t)) for t in kept.values())
    pieces = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in pieces.collect()} == set(kept)


def test_contaminated_documents_only_are_dropped(spark, sf):
    docs = read_table(spark, sf, "documents")
    found = decontaminate.query(spark, sf)
    left = corpus_pipeline.decontamination(spark, docs, sf)
    assert left.count() == found.filter(~F.col("contaminated")).count()
