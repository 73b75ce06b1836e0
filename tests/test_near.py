"""Near duplicates against every pair compared one by one."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import near, similarity
from quarry.plans import catalog


def brute(batch, library, threshold=similarity.THRESHOLD, top=similarity.TOP):
    out = set()
    for k, x in batch:
        found = [(r, j) for j, y in library if j != k and x and y and (r := difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()) >= threshold]
        out |= {(k, j, round(r, 3)) for r, j in sorted(found, key=lambda x: (-round(x[0], 3), x[1]))[:top]}
    return out


def found(spark, batch, library, *more):
    return near.near(*(spark.createDataFrame(x, "key string, norm string") for x in (batch, library)), *more).collect()


def noisy(rng, text, share):
    return "".join(c if rng.random() > share else "#" for c in text)


@pytest.fixture(scope="module")
def texts():
    """Far more than 60 library texts share more grams with the new text than its copies do; some share none."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    new = "".join(words[:30])
    library = [(f"l{i}", "".join(rng.sample(words, 60)) + new[:100]) for i in range(90)]
    library += [("copy", new[:70] + "zz" + new[72:]), ("same", new), ("short", "ab2cd"), ("empty", ""), ("none", None)]
    library += [(f"m{i}", "".join(rng.sample(words, 30))) for i in range(90)] + [(f"z{i}", noisy(rng, new, 0.12)) for i in range(20)]
    library += [(f"d{i}", noisy(rng, "".join(words[30:]), 0.01)) for i in range(300)] + [(f"e{i}", "same text") for i in range(50)]
    batch = [("n1", new), ("n2", "ab1cd"), ("n3", ""), ("n4", "".join(words[30:])), ("e7", "same text"), ("e8", "same text"), ("n5", None), ("n6", "x")]
    return batch, library


@pytest.mark.parametrize("run", [near.RUN, None])
def test_no_match_is_cut(spark, texts, run):
    batch, library = texts
    got = found(spark, batch, library, similarity.THRESHOLD, similarity.TOP, run)
    want = brute(batch, library)
    assert {(r.left, r.right, r.score) for r in got} == want and ("n2", "short", 0.8) in want and ("n1", "same", 1.0) in want
    assert {r.complete for r in got} == {run is None} and {r["rank"] for r in got} == {1, 2, 3}


def test_scattered_replacements_need_every_pair(spark):
    """Blocks of four characters at a ratio of 0.8: ruled out with a run of 8, found without, and the result says so."""
    rng = random.Random(1)
    one = "".join(rng.choice("abcdefghijklmnop") for _ in range(400))
    other = "".join("#" if i % 5 == 4 else c for i, c in enumerate(one))
    assert not found(spark, [("a", one)], [("b", other)])
    got = found(spark, [("a", one)], [("b", other)], 0.8, 3, None)
    assert [(r.right, r.score, r.complete) for r in got] == [("b", 0.8, True)]


def test_high_thresholds_are_complete(spark, texts):
    batch, library = texts
    got = found(spark, batch, library, 0.95, 5)
    assert {(r.left, r.right, r.score) for r in got} == brute(batch, library, 0.95, 5) and all(r.complete for r in got)


def test_blocks_of_queries(spark, texts, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_CHARS", 200)
    batch, library = texts
    assert {(r.left, r.right, r.score) for r in found(spark, batch, library)} == brute(batch, library)


def test_more_than_the_threshold(spark):
    """Exactly 0.95 does not count, more does, and a variant is no exception."""
    base = "函数单调递增" + "".join(chr(0x4E00 + 7 * i) for i in range(94))
    rows = [("a", base), ("b", base[:95] + "#####"), ("c", base[:96] + "####"), ("v", base.replace("递增", "递减"))]
    make = lambda x: spark.createDataFrame(x, "key string, norm string")
    assert near.same_items(make(rows[:1]), make(rows[1:2])).count() == 0
    assert [(r.right, r.score) for r in near.same_items(make(rows[:1]), make(rows[:3])).collect()] == [("c", 0.96)]
    assert [(r.right, r.verdict) for r in near.same_items(make(rows[:1]), make(rows)).collect()] == [("v", similarity.VARIANT)]


def test_bounds_hold():
    """Common grams, hashed or not, never fall below what the ratio needs."""
    rng = random.Random(6)
    for _ in range(300):
        x = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 120)))
        y = noisy(rng, x, rng.random() * 0.3)[rng.randint(0, 3) :] + x[:5]
        r, size = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), len(x) + len(y)
        for size_of, (gram, dims, _) in enumerate(near.SIZES):
            a, b = near.least_grams(max(r, 1e-9), None, size_of)
            gx, gy = near.gram_hashes(x, gram), near.gram_hashes(y, gram)
            common = near.common_grams(gx, gy)
            assert common >= a * size - b - 1e-6
            assert float(near._roots([gx], dims)[0] @ near._roots([gy], dims)[0]) >= 0.999 * common
        assert size * r <= 2 * np.minimum(near._characters(x), near._characters(y)).sum() + 1e-6
        assert near.subsequence(x, y) == similarity.common_length(x, y)


def test_matching_blocks_are_difflibs(monkeypatch):
    monkeypatch.setattr(near, "CELLS", 0)
    rng = random.Random(8)
    for n in (0, 1, 5, 40, 300):
        for _ in range(40):
            x = "".join(rng.choice("abc") for _ in range(n))
            y = noisy(rng, x, rng.random() * 0.4)[rng.randint(0, 3) :] + "".join(rng.choice("abé中") for _ in range(rng.randint(0, n)))
            want = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
            assert near.matched(x, y, 0) == want and near.matched(x, y, want + 1) in (0, want)


def test_long_texts(spark, monkeypatch):
    """Short and long texts, queries near the border among them."""
    monkeypatch.setattr(near, "LONG", 300)
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (45, 50, 55, 60, 65, 70, 120, 300)]
    library = [(f"r{i}", " ".join(rng.choice(words) for _ in range(rng.randint(30, 90)))) for i in range(60)]
    library += [(f"b{i}-{j}", " ".join(w if rng.random() > 0.06 else rng.choice(words) for w in t.split(" "))) for i, t in enumerate(base) for j in range(4)]
    batch = [(f"q{i}", t) for i, t in enumerate(base)]
    queries = near.Queries(batch, 0.8, 4, near.RUN)
    queries.compare(library)
    got = {(batch_key, key, score) for batch_key, key, score, _ in queries.hits()}
    assert got == brute(batch, library, 0.8, 4) and len(got) == 32


def test_status(spark, texts):
    got = near.index_status(spark.createDataFrame(texts[1], "key string, norm string"), "key", F.col("norm")).first()
    assert (got.total, got.indexed, got.skipped, got.ready, got.first_skipped) == (len(texts[1]), len(texts[1]) - 2, 2, False, ["empty", "none"])
    assert tuple(near.index_status(spark.createDataFrame([], "key string, norm string"), "key", F.col("norm")).first()) == (0, 0, 0, 1.0, True, [])


def test_documents_are_searched(spark, sf):
    got = catalog.QUERIES["near_duplicate_items"](spark, sf).collect()
    docs = catalog.read(spark, sf, "documents").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("key"), similarity.normalised(F.col("text")).alias("norm"), "doc_id").collect()
    want = brute([(r.key, r.norm) for r in docs if r.doc_id % 50 == 0 and len(r.norm) < 2500], [(r.key, r.norm) for r in docs if len(r.norm) < 3800])
    long = {r.key for r in docs if len(r.norm) >= 2500}
    assert {(r.left, r.right, r.score) for r in got if r.left not in long} == want


def test_library_is_made_once(spark, monkeypatch):
    """However many blocks of queries there are, a library text is normalised once."""
    monkeypatch.setattr(near, "BLOCK_CHARS", 60)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    rows = [(f"k{i}", "abcdefgh" * (i + 1) + "xyz"[i % 3]) for i in range(12)]
    library = spark.createDataFrame(rows, "key string, norm string").withColumn("norm", counted.asNondeterministic()("norm"))
    got = near.near(spark.createDataFrame(rows, "key string, norm string"), library).collect()
    assert {(r.left, r.right, r.score) for r in got} == brute(rows, rows) and made.value == len(rows)


@pytest.mark.parametrize("row", [2, 256])
def test_rarest_grams_lose_nothing(monkeypatch, row):
    """All queries with enough grams in common are met, whether a gram has a row or a list, and few others are."""
    monkeypatch.setattr(near, "ROW", row)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    base = ["".join(rng.choice(words) for _ in range(rng.randint(60, 120))) for _ in range(60)]
    texts = base + [noisy(rng, t, 0.04) for t in base] + [t[:90] * 3 for t in base[:10]]
    index = near.Queries([(str(i), t) for i, t in enumerate(texts)], 0.8, 4, near.RUN).indexes[0]
    assert len(index.rows) > 0 if row == 2 else not len(index.rows)
    met = 0
    for t in texts:
        found, most = index.candidates(t)
        bound = dict(zip(found.tolist(), most.tolist()))
        met += len(found)
        for i, other in enumerate(index.texts):
            n = near.common_grams(near.gram_hashes(t, index.gram), near.gram_hashes(other, index.gram))
            if len(other) <= index.share * len(t) and len(t) <= index.share * len(other) and n >= index.a * (len(t) + len(other)) - index.b:
                assert n <= bound[i]
    assert len(texts) < met < 0.1 * len(texts) ** 2


def test_runs_give_the_blocks():
    """Matching blocks of long near copies, of texts that repeat themselves and of texts with no long run."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    one = letters(1500)
    pairs = [(one, noisy(rng, one, s)) for s in (0.01, 0.05, 0.2)] + [(one, one[700:] + one[:700]), (one[:300] * 4, one[:300] * 3 + one[100:400]), ("a" * 900, "a" * 850 + "b"), (one, letters(1500))]
    for x, y in pairs:
        want = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        assert near.matched(x, y, 0) == want and near.matched(x, y, want + 1) in (0, want)
        runs = near.common_runs(x, y)
        assert runs is None or all(x[i : i + n] == y[j : j + n] for i, j, n in zip(*(r.tolist() for r in runs)))


def test_scores_to_beat_stay():
    """Another part of a library need not bring what earlier hits make too few; equal scores it must."""
    queries = near.Queries([("q", "0123456789" * 4)], 0.8, 2, near.RUN)
    queries.compare([("a", "0123456789" * 4), ("b", "0123456789" * 3 + "012345678#")])
    assert [k for _, k, *_ in queries.hits()] == ["a", "b"]
    queries.start()
    queries.compare([("c", "0123456789" * 3 + "0123456###"), ("d", "#" + "0123456789" * 3 + "123456789")])
    assert [k for _, k, *_ in queries.hits()] == ["d"]


def test_exact_bounds_take_longer_grams():
    """Where nothing can be missed, grams of eight characters rule out more, and still no pair of the threshold."""
    assert [near.gram_size(0.95, near.RUN, i) for i in (0, 1)] == [8, 8] and [near.gram_size(0.8, near.RUN, i) for i in (0, 1)] == [5, 8]
    rng = random.Random(9)
    index = near.Queries([("q", "x" * 200)], 0.95, 2, near.RUN).indexes[0]
    assert index.gram == 8
    for _ in range(200):
        x = "".join(rng.choice("abcd") for _ in range(rng.randint(40, 200)))
        y = noisy(rng, x, rng.random() * 0.06)
        if difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.95:
            assert near.common_grams(near.gram_hashes(x, 8), near.gram_hashes(y, 8)) >= index.a * (len(x) + len(y)) - index.b - 1e-6


def test_longer_grams_are_owed_to_blocks():
    """Blocks that hold the grams that a pair needs hold as many longer ones as the sieve asks for."""
    rng = random.Random(14)
    for size in (0, 1):
        gram = near.gram_size(0.8, near.RUN, size)
        a, b = near.least_grams(0.8, near.RUN, size)
        more, less, longer = near.longer_grams(a, b, gram)
        assert longer > gram and near.longer_grams(*near.least_grams(0.8, None, size), gram)[2] == gram
        for _ in range(20_000):
            blocks = [rng.choice((1, 3, gram, gram + 1, longer - 1, longer, 2 * longer, 40)) for _ in range(rng.randint(1, 60))]
            total = 2 * sum(blocks) + rng.randint(0, sum(blocks) // 2)
            if sum(max(n - gram + 1, 0) for n in blocks) >= a * total - b:
                assert sum(max(n - longer + 1, 0) for n in blocks) >= more * total - less - 1e-6


def test_texts_are_sieved_by_longer_grams():
    """Texts of the same few syllables share many short grams by chance; the sieve leaves near copies and little else, and all hits."""
    rng = random.Random(15)
    syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 3))) for _ in range(14)]
    make = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    base = [make(rng.randint(130, 180)) for _ in range(16)]
    library = [(f"l{i}", make(rng.randint(150, 200))) for i in range(16)] + [(f"h{i}", t[: len(t) // 2] * 2) for i, t in enumerate(base[:4])]
    library += [(f"c{i}", noisy(rng, t, (0.02, 0.08, 0.12)[i % 3])) for i, t in enumerate(base)]
    queries = near.Queries([(f"q{i}", t) for i, t in enumerate(base)], 0.8, 4, near.RUN)
    queries.compare(library)
    got = {(q, key, score) for q, key, score, _ in queries.hits()}
    assert got == brute([(f"q{i}", t) for i, t in enumerate(base)], library, 0.8, 4) and len(got) >= 16
    sieved, index = queries.sieves[0], queries.indexes[0]
    assert sieved.made and not index.made
    for _, t in library:
        if len(t) >= queries.sieved[0]:
            found, most = sieved.candidates(t)
            bound = dict(zip(found.tolist(), most.tolist()))
            for i, other in enumerate(index.texts):
                n = near.common_grams(near.gram_hashes(t, sieved.gram), near.gram_hashes(other, sieved.gram))
                if len(other) <= sieved.share * len(t) and len(t) <= sieved.share * len(other) and n >= sieved.a * (len(t) + len(other)) - sieved.b:
                    assert n <= bound[i]
    assert sum(len(index.enough(sieved.candidates(t)[0], t).nonzero()[0]) for _, t in library) < 3 * len(library)


def test_equal_library_texts_are_met_once(spark, monkeypatch):
    """Hundreds of copies of a text are compared once a task; the first keys count."""
    met = []
    plain = near.Queries._compare
    monkeypatch.setattr(near.Queries, "_compare", lambda self, first, index, keys, text: (met.append(text), plain(self, first, index, keys, text)))
    rows = [(f"k{i:03}", t) for i in range(300) for t in ("0123456789" * 4,)] + [("z", "0123456789" * 3 + "012345678#"), ("n", None), ("e", "")]
    task = near._search([("q", "0123456789" * 4)], "once", 0.8, 4, near.RUN)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*reversed(rows))], ["key", "norm"])
    (out,) = task(iter([batch]))
    assert sorted(out.column("right").to_pylist()) == ["k000", "k001", "k002", "k003"] and len(met) == 2
    assert {(r.left, r.right, r.score) for r in found(spark, rows[-6:], rows)} == brute(rows[-6:], rows)
