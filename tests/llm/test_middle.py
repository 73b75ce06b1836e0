"""Fill-in-middle by rank and select, against plain Python."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import middle
from tests.llm.conftest import ODD


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
    form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return len(tokens), form, None if plain else len(p), None if plain else len(m), out


def test_cuts_match_brute_force(spark, make_docs):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab Z0é😀\n<>PSM.中") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += [*ODD, "<P>", "x<S>y", "a<M>", "<P", "é", "a", "\x00\x00", "aé" * 70_000]
    rows = [*enumerate(texts), (None, "no id here"), (5, texts[5]), (-3, "a b c d")]
    made = middle.with_middle(make_docs(rows))
    got = sorted((repr(r["doc_id"]), r["text"] or "", *r["_q_fim"], r["back"]) for r in made.withColumn("back", middle.restored(F.col("_q_fim.output"), F.col("_q_fim.form"))).collect())
    assert got == sorted((repr(i), t or "", *brute(i, t), t or "") for i, t in rows)
    assert made.columns[:-1] == make_docs([]).columns and {g[3] for g in got} == {"plain", "psm", "spm"}


def test_rank_and_select():
    rng = np.random.default_rng(1)
    for n, share in [(1, 1.0), (511, 0.5), (512, 0.01), (513, 1.0), (100_000, 0.2), (5000, 0.0005)]:
        bits = rng.random(n) < share
        bits[rng.integers(n)] = True
        vector, places = middle.Bits(bits), np.flatnonzero(bits)
        assert (vector.select(np.arange(len(places))) == places).all() and vector.before[-1] == len(places)
        at = rng.integers(0, n + 1, 9000)
        assert (vector.rank(at) == np.concatenate([[0], np.cumsum(bits)])[at]).all()


def test_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert middle.query(spark, str(tmp_path)).count() == 0
