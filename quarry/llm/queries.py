"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, embed, extract, jaccard, langid, middle, packing, pii, repair, scoring, substrings, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": langid.query,
    "op2_packing": packing.query,
    "op3_pii": pii.query,
    "op4_jaccard": jaccard.query,
    "op5_warc": warc.query,
    "op6_embedding_neardup": embed.query,
    "op7_extraction": extract.query,
    "op8_decontamination": decontaminate.query,
    "op9_substrings": substrings.query,
    "op10_scoring": scoring.query,
    "op11_url_filter": urls.query,
    "op12_fill_in_middle": middle.query,
    "op13_conversation_repair": repair.query,
}

SQL: dict[str, str] = {
    "op4_jaccard": jaccard.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op6_embedding_neardup": embed.ORACLE_SQL,
    "op8_decontamination": decontaminate.ORACLE_SQL,
    "op9_substrings": substrings.ORACLE_SQL,
    "op11_url_filter": urls.ORACLE_SQL,
    "op12_fill_in_middle": middle.ORACLE_SQL,
    "op13_conversation_repair": repair.ORACLE_SQL,
}
