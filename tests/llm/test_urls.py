"""URL filter: rules by brute force, templates on planted hosts, and the same with tables joined instead of sent."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import urls

SCHEMA = "page_id bigint, url string, host string, path string, n bigint, blocked int, bad boolean"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "p", 1, 2, b) for i, (u, b) in enumerate(rows)], SCHEMA)


def ruled(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), v, r) for v, r in urls.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None


ODD = [None, "", "no scheme", "http://", "://", "http://com", "http://com/", "HTTP://WWW.Example.COM/EN/1", "http://example.com/en", "http://a.example.com/en/x?y", "http://www.example.com/en/", "http://x.www.example.com/en/#a",
       "http://net/fr/", "http://planet/fr/", "http://a.net/es/1://b", "http://ÄÖ.net/es/\n2", "http://a.org" + "/x" * 30, "http://a.org/" + "9" * 100_000, "http://a.org//", "x?://com/", "a/b://example.com/en/"]


def test_rules_match_brute_force(spark):
    rows = [(u, None) for u in ODD + ODD]
    got = sorted((r["page_id"], *r["_q_url"][:3], r["_q_url"]["verdict"]) for r in urls.judge(pages(spark, rows)).collect())
    assert [g[:4] for g in got] == [(i, *ruled(u)[:3]) for i, (u, _) in enumerate(rows)]
    assert all(v == ruled(u)[3] for (u, _), (*_, v) in zip(rows, got) if ruled(u)[3])
    assert got[0][1:] == ("", "", None, "allow") and urls.judge(pages(spark, rows)).columns[:-1] == pages(spark, []).columns


def planted():
    """A host with bad and good branches under many names, and one without a label whose templates others share."""
    rng, rows = random.Random(4), []
    for i in range(400):
        for branch, bad in [("offers", True), ("deals", True), ("news", False), ("docs", False)]:
            rows.append((f"http://big.org/{branch}/{rng.randint(1, 9999)}/item-{i}", bad if rng.random() < 0.6 else None))
        rows.append((f"http://big.org/{''.join(rng.choices('abcdefgh', k=9))}", False if rng.random() < 0.5 else None))
    for i in range(40):
        rows += [(f"http://new.org/offers/{i}/item-1", None), (f"http://new.org/docs/{i}/item-2", None)]
    return rows


def wanted(url):
    return "block" if "/offers/" in url or "/deals/" in url else "allow"


@pytest.mark.parametrize("most", [None, 0])
def test_templates(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(urls, "BROADCAST_BYTES", most)
    rows = planted()
    got = urls.judge(pages(spark, rows), rules=[], label="bad").collect()
    assert len(got) == len(rows) and all(r["_q_url"]["verdict"] == wanted(r["url"]) for r in got)
    found = {r["template"]: (r["n"], r["verdict"]) for r in urls.judge(pages(spark, rows), rules=[], label="bad").groupBy("_q_url.host", "_q_url.template").agg(F.count("*").alias("n"), F.max("_q_url.verdict").alias("verdict")).filter("host = 'big.org'").collect()}
    assert {n for n, _ in found.values()} == {800, 400}  # both bad branches are one template, so are both good ones; rare names are a wildcard
    counted = urls.templates(pages(spark, rows), rules=[], label="bad").agg(F.sum("n"), F.sum("labelled")).first()
    assert tuple(counted) == (len(rows), sum(b is not None for _, b in rows))


def test_held_out_labels(spark):
    """Labels of a third of the URLs decide the others of a host whose branches are 90 percent pure."""
    rng = random.Random(9)
    truth = [(f"http://{'ab'[i % 2]}.org/{rng.choice(['spam', 'blog'])}/{i}", None) for i in range(3000)]
    bad = [("/spam/" in u) != (rng.random() < 0.1) for u, _ in truth]
    rows = [(u, b if i % 3 == 0 else None) for i, ((u, _), b) in enumerate(zip(truth, bad))]
    got = {r["page_id"]: r["_q_url"]["verdict"] == "block" for r in urls.judge(pages(spark, rows), rules=[], label="bad").collect()}
    right = [got[i] == b for i, b in enumerate(bad) if i % 3]
    assert sum(right) / len(right) > 0.87


def test_empty_table(spark, tmp_path):
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert urls.query(spark, str(tmp_path)).count() == 0
