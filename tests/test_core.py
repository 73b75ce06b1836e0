"""Core operators against plain Python on small fixtures, and by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import documents, history, merge, quality, selection, semantics
from quarry.sources import volumes
from quarry.streaming import ingest


def test_quotas_add_up_and_follow_the_fractions(spark):
    assert selection.type_mix(spark, 19) == dict(selection.MIX)
    for n in (1, 5, 10, 23):
        got = selection.type_mix(spark, n)
        exact = {t: n * k / 19 for t, k in selection.MIX}
        assert sum(got.values()) == n and all(0 <= got[t] - int(exact[t]) <= 1 for t in got)
        up = [exact[t] - int(exact[t]) for t in got if got[t] > int(exact[t])]
        down = [exact[t] - int(exact[t]) for t in got if got[t] == int(exact[t])]
        assert not up or not down or min(up) >= max(down) - 1e-9
    assert selection.type_mix(spark, 0) == {} and selection.topic_quota(spark, 4, []) == {}


def braces(s):
    depth = 0
    for ch in (s or "").replace(r"\{", "").replace(r"\}", ""):
        depth += (ch == "{") - (ch == "}")
        if depth < 0:
            return False
    return depth == 0


def test_braces_and_environments(spark):
    rng = random.Random(1)
    texts = [None, "", *("".join(rng.choice(["{", "}", r"\{", r"\}", "x"]) for _ in range(rng.randint(0, 8))) for _ in range(200))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.braces_ok(F.col("t"))).collect()
    assert all(ok == braces(t) for t, ok in got)
    begin, end = (lambda n: rf"\begin{{{n}}}"), (lambda n: rf"\end{{{n}}}")
    cases = {
        "": None, begin("a") + "x" + end("a"): None, begin("a") + begin("b") + end("b") + end("a"): None, begin("a"): begin("a"), end("a"): end("a"),
        begin("a") + end("b"): end("b"), begin("a") + begin("b") + end("a") + end("b"): end("a"), begin("a") + end("a") + begin("b") + begin("c"): begin("c"),
    }
    got = dict(spark.createDataFrame([(t,) for t in cases], "t string").select("t", quality.environment_fault(F.col("t"))).collect())
    assert got == cases


def test_alignment_is_the_heaviest_increasing_chain(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(d, side, i, " ".join(rng.sample(words, 3))) for d in range(6) for side in "qa" for i in range(5)]

    def grams(s):
        s = "".join(s.split())
        return {s[i : i + 2] for i in range(len(s) - 1)}

    got = {}
    for r in documents.align(spark.createDataFrame(rows, "doc int, side string, at int, text string")).collect():
        got.setdefault(r.doc, []).append((r.q, r.a, r.score))
    for d in range(6):
        q, a = ([grams(t) for dd, s, _, t in rows if dd == d and s == side] for side in "qa")
        score = {(i, j): round(len(x & y) / min(len(x), len(y)), 6) for i, x in enumerate(q) for j, y in enumerate(a)}
        best = 0.0
        for k in range(1, 6):
            for i in itertools.combinations(range(5), k):
                for j in itertools.combinations(range(5), k):
                    each = [score[x] for x in zip(i, j)]
                    if min(each) >= documents.ALIGN_MIN:
                        best = max(best, sum(each))
        chain = got.get(d, [])
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(chain)) and all(score[x[:2]] == x[2] for x in chain)
        assert sum(x[2] for x in chain) == pytest.approx(best)


def test_item_starts(spark):
    numbers = [1, 2, 2, 9, 3, 6, 10, 7, None, 8]
    rows = [(1, i, f"{n}. x" if n else "no number") for i, n in enumerate(numbers)]
    got = [(r.n, r.start) for r in documents.item_starts(spark.createDataFrame(rows, "doc int, line_no int, text string")).orderBy("start").collect()]
    last, want = 0, []
    for i, n in enumerate(numbers):
        if n and last < n <= last + 3:
            want.append((n, i))
            last = n
    assert got == want


def test_free_keys(spark):
    rng = random.Random(5)
    used = {(b, n) for b in "xy" for n in rng.sample(range(1, 15), 6)}
    batch = [(i, rng.choice(["x", "y", "z", "a/b#c"]), "l") for i in range(40)]
    have = spark.createDataFrame([(f"{b}/l#{n}",) for b, n in used] + [("odd",), ("x/l#0",)], "key string")
    got = {r.seq: r.key for r in merge.free_keys(spark.createDataFrame(batch, "seq int, book string, label string"), have).collect()}
    taken, want = {f"{b}/l#{n}" for b, n in used}, {}
    for i, b, label in batch:
        b = b.replace("/", "／").replace("#", "＃")
        n = next(n for n in itertools.count(1) if f"{b}/{label}#{n}" not in taken)
        want[i] = f"{b}/{label}#{n}"
        taken.add(want[i])
    assert got == want


def test_rename_chains(spark):
    chain = [(f"n{i}", f"n{i + 1}", i) for i in range(90)]
    more = [("a", "b", 1), ("b", "a", 2), ("c", "a", 3), ("m", "old", 1), ("m", "late", 2), ("self", "self", 1)]
    got = dict(history.final_names(spark.createDataFrame(chain + more, "old string, new string, at int"), "at").collect())
    assert all(got[f"n{i}"] == "n90" for i in range(90)) and got["m"] == "late" and "self" not in got
    assert (got["a"], got["b"], got["c"]) == ("b", "a", "a")


def test_volumes_and_batches(spark, tmp_path):
    rows = [(f"k{i}", i, "t", "a", ["p"], f"stem {i}\nsecond line" + (" mentions %% @gone here" if i == 2 else "")) for i in range(1, 8)]
    items = spark.createDataFrame(rows, "key string, seq bigint, type string, answer string, points array<string>, stem string")
    volumes.write_volumes(items, f"{tmp_path}/v", per_volume=3)
    back = volumes.read_volumes(spark, f"{tmp_path}/v").select(items.columns).collect()
    assert sorted(map(tuple, back)) == sorted(rows)
    one = items.limit(3).withColumn("fingerprint", F.col("stem"))
    run = ingest.merge_into(f"{tmp_path}/t")
    run(one, 0)
    changed = one.filter("key = 'k1'").withColumns({"seq": F.lit(100).cast("bigint"), "stem": F.lit("new"), "fingerprint": F.lit("new")})
    for _ in range(2):  # a batch that is replayed changes nothing
        run(one.unionByName(changed), 1)
    table = volumes.all_rows(spark, f"{tmp_path}/t")
    assert table.count() == 4
    now = {r.key: r.stem for r in volumes.current(table).collect()}
    assert len(now) == 3 and now["k1"] == "new"


def test_a_text_that_comes_back_is_kept(spark, tmp_path):
    run = ingest.merge_into(f"{tmp_path}/t", "me")
    for epoch, rows in enumerate([[("k", 1, "A"), ("m", 1, "M")], [("k", 2, "B")], [("k", 3, "A"), ("n", 3, "A"), ("o", 3, "M"), ("p", 3, "B")]]):
        run(spark.createDataFrame(rows, "key string, seq bigint, fingerprint string"), epoch)
    now = {r.key: r.fingerprint for r in volumes.current(volumes.all_rows(spark, f"{tmp_path}/t")).collect()}
    assert now == {"k": "A", "m": "M"}  # n repeats k in its batch, o the item m, p what k says until this batch


def test_a_batch_belongs_to_one_writer(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1)], "key string, seq bigint")
    volumes.append_batch(rows, str(tmp_path), 3, "one")
    volumes.append_batch(rows, str(tmp_path), 3, "one")
    with pytest.raises(ValueError, match="belongs to 'one'"):
        volumes.append_batch(rows, str(tmp_path), 3, "other")
    assert volumes.all_rows(spark, str(tmp_path)).count() == 1


def test_ingest_as_a_stream(spark, tmp_path):
    schema = "key string, seq bigint, stem string, at timestamp"
    make = lambda rows: spark.createDataFrame(rows, "key string, seq bigint, stem string, at string").withColumn("at", F.to_timestamp("at"))
    for k, rows in enumerate([[("a", 1, "x", "2024-01-01 00:00:00"), ("b", 2, "x", "2024-01-01 00:10:00")], [("a", 3, "y", "2024-01-01 00:20:00"), ("c", 4, "x", "2024-01-01 00:30:00")]]):
        make(rows).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = {r.key: r.stem for r in volumes.current(volumes.all_rows(spark, f"{tmp_path}/out")).collect()}
    assert got in ({"a": "y"}, {"a": "y", "b": "x"})  # of one fingerprint a row is kept once
    assert sorted(got.values()) in (["y"], ["x", "y"])


def test_trash_and_swaps(spark):
    items = spark.createDataFrame([("a", "one"), ("b", "two")], "key string, stem string")
    left, trash = history.moved_to_trash(items, spark.createDataFrame([], "key string, stem string, reason string, deleted_at string"), ["a"], "why", "now")
    assert [r.key for r in left.collect()] == ["b"] and [tuple(r) for r in trash.collect()] == [("a", "one", "why", "now")]
    back, empty = history.restored(left, trash, ["a"])
    assert sorted(r.key for r in back.collect()) == ["a", "b"] and empty.count() == 0
    with pytest.raises(KeyError):
        history.moved_to_trash(items, trash, ["a", "z"], "", "")
    sha = items.filter("key = 'a'").select(F.sha2("stem", 256)).first()[0]
    patch = lambda expect: spark.createDataFrame([("a", expect, "new")], "key string, expect string, stem string")
    assert dict(merge.compare_and_swap(items, patch(sha)).select("key", "stem").collect()) == {"a": "new", "b": "two"}
    with pytest.raises(ValueError):
        merge.compare_and_swap(items, patch("other"))


def test_numerals_and_lines(spark):
    want = {"三": 3, "十": 10, "十一": 11, "二十": 20, "二十三": 23, "x": None, "": None}
    assert dict(spark.createDataFrame([(t,) for t in want], "t string").select("t", tx.numeral(F.col("t"))).collect()) == want
    assert spark.range(1).select(tx.one_line(F.lit(" a \n b  c "), 4)).first()[0] == "a b …"


ITEM = {"key": "k", "type": "detailed_answer", "stem": "Find x.", "answer": "", "solution": "因为 a=b 所以 c=d=e=f", "region": "", "stars": 1, "options": [], "figures": []}
CHOICES = [(c, "t") for c in "ABCD"]
BREAKS = {
    "sol_rejects_answer": {"type": "single_choice", "answer": "A", "options": CHOICES, "solution": "因为 A错误, B正确"},
    "sol_pos_set_differs": {"type": "multi_choice", "answer": "AB", "options": CHOICES, "solution": "因为 A正确；B正确；C正确；D错误"},
    "stem_sol_swapped": {"stem": "解：because of this the result is as follows, 故选A", "solution": "求x？"},
    "option_figure_partial": {"type": "single_choice", "answer": "A", "options": [("A", r"\includegraphics{x}"), ("B", "t")]},
    "sol_result_only": {"solution": "x=1"},
    "sol_scoring_rubric": {"solution": "因为 a=b=c=d 扣分"},
    "sol_worker_note": {"solution": "因为 a=b=c=d 待复核"},
    "sol_page_noise": {"solution": "因为 a=b=c=d 第 3 页"},
    "figure_needed_absent": {"stem": "如图, find x"},
    "region_garbage": {"region": "满分150"},
    "region_format_anomaly": {"region": "2020x"},
    "meta_stars_zero": {"stars": 0},
    "answer_has_score": {"type": "fill_in_blank", "answer": "3 5分"},
    "type_stem_mismatch": {"type": "single_choice", "answer": "A", "stem": "下列说法正确的有"},
    "sol_duplicated_half": {"solution": "".join(f"因为 a{i}=b 所以 c=d=e{i} 整理得到结果" for i in range(12)) * 2},
    "sol_admits_broken": {"solution": "因为 a=b=c=d 题面有误"},
    "ans_vs_sol_conclusion": {"type": "multi_choice", "answer": "AB", "options": CHOICES, "solution": "因为 a=b 故选：A、C"},
    "option_text_empty": {"type": "single_choice", "answer": "A", "options": [("A", "$ $"), ("B", "t")]},
    "answer_degenerate": {"type": "fill_in_blank", "answer": " 略 "},
    "sol_copies_stem": {"stem": "证明 a=b 且 c=d 并说明理由其中一切都成立", "solution": r"证明 a=b 且 \quad c=d 并说明理由，其中一切都成立"},
    "single_choice_multi_admit": {"type": "single_choice", "answer": "A", "options": CHOICES, "solution": "因为 两项皆真"},
    "sol_multi_conclusion": {"type": "single_choice", "answer": "A", "options": CHOICES, "solution": "故选A. 又因为 a=b=c=d, 故选：B"},
}


def test_semantic_rules_by_hand(spark):
    rows = [ITEM | {"key": "clean"}, *(ITEM | x | {"key": name} for name, x in BREAKS.items())]
    rows.append(ITEM | {"key": "denied", "type": "single_choice", "answer": "A", "options": CHOICES, "solution": "因为 故选A, 故选B错误"})
    rows.append(ITEM | {"key": "wrong_one", "type": "single_choice", "answer": "B", "options": CHOICES, "stem": "下列说法错误的是", "solution": "因为 B错误, 故选B"})
    rows.append(ITEM | {"key": "wrong_ones", "type": "multi_choice", "answer": "AB", "options": CHOICES, "stem": "选出不正确的结论", "solution": "因为 A错误；B错误；C正确；D正确"})
    rows.append(ITEM | {"key": "abab", "solution": "abab"})
    rows.append(ITEM | {"key": "bracketed", "type": "multi_choice", "answer": "ACD", "options": CHOICES, "solution": "因为 a=b 所以选 （A）（C）和 D"})
    schema = "key string, type string, stem string, answer string, solution string, region string, stars int, options array<struct<label:string,text:string>>, figures array<struct<id:string>>"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ("key", "type", "stem", "answer", "solution", "region", "stars", "options", "figures")) for r in rows], schema)
    got = {r.key: {v.rule for v in r.v} for r in df.select("key", semantics.found(semantics.semantics()).alias("v")).collect()}
    assert got["clean"] == set() and "sol_multi_conclusion" not in got["denied"]
    assert got["wrong_one"] == got["wrong_ones"] == got["bracketed"] == set() and "sol_duplicated_half" not in got["abab"]
    for name in BREAKS:
        assert name in got[name], (name, got[name])


def test_scan_finds_what_the_rules_find(spark):
    names = "key type stem answer solution region stars options figures".split()
    schema = "key string, type string, stem string, answer string, solution string, region string, stars int, options array<struct<label:string,text:string>>, figures array<struct<id:string>>"
    df = spark.createDataFrame([tuple((ITEM | x | {"key": name})[c] for c in names) for name, x in BREAKS.items()], schema)
    want = {(r.key, v.rule) for r in df.select("key", semantics.found(semantics.semantics()).alias("v")).collect() for v in r.v}
    assert {(r.key, r.rule) for r in semantics.scanned(df).collect()} == want
    some = ["sol_copies_stem", "sol_worker_note"]
    assert {(r.key, r.rule) for r in semantics.scanned(df, some).collect()} == {x for x in want if x[1] in some}


def test_texts_are_read_once(spark, sf):
    from quarry.plans import catalog_queues, catalog_texts

    plan = lambda query: query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(catalog_texts.contradictions).count("A-Za-z0-9") == 2  # the letters of stem and solution
    assert "A-Za-z0-9" not in plan(catalog_queues.semantic_metadata)  # asks for none of the rules that need them


def test_conclusions(spark):
    want = {"故选：A、C": ["AC"], "故选 (B)(A)": ["AB"], "答案为C错误": [], "故选 B 正确": [], "综上所述选 D": ["D"], "故选择x": [], "应选A 又 本题选 B": ["A", "B"], "": [], None: []}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", semantics.conclusions(F.coalesce("t", F.lit(""))))
    assert dict(map(tuple, rows.collect())) == want


def test_dice_counts_with_repetition(spark):
    from collections import Counter

    rng = random.Random(2)
    rows = [("".join(rng.choice("ab中") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ab中") for _ in range(rng.randint(0, 12)))) for _ in range(200)] + [(None, "ab"), ("ab", None)]

    def dice(x, y):
        a, b = (Counter(t[i : i + 2] for i in range(len(t) - 1)) if t else Counter() for t in (x, y))
        return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) if a and b else 0.0

    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", tx.dice_of("a", "b")).collect()
    assert all(abs(r[2] - dice(r[0], r[1])) < 1e-12 for r in got)


def test_answers(spark):
    cases = [("1，2：3。", "1,2:3.", False), (r"$\dfrac{1}{2}$", r"\frac{1}{2}", False), (r"\left[1, 2\right)", "[1,2)", False), ("1", "2", True), ("AB", "A", True), ("AB", "3", False), ("见解析", "3", False), ("", "3", False), (None, "3", False), ("A", "A", False)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert rows.filter(tx.answers_conflict(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_gazetteer_equals_one_search_per_name(spark):
    rng = random.Random(4)
    names = [("".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 3))), f"p{rng.randint(0, 4)}") for _ in range(40)] + [("", "none")]
    labels = [(i, "p1", "".join(rng.choice("甲乙丙丁戊x") for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(300, None, None), (301, "p9", "甲")]
    items = spark.createDataFrame(labels, "key int, region string, source_label string")
    table = spark.createDataFrame(names, "name string, province string")
    want = {k: sorted({p for n, p in names if n and n in (t or "")}) for k, _, t in labels}
    got = {r.key: r.provinces for r in semantics.places(items, "key", "source_label", table).collect()}
    assert got == {k: v for k, v in want.items() if v}
    wrong = {r.key for r in semantics.region_vs_label(items, table, None).collect()}
    assert wrong == {k for k, region, _ in labels if region and want[k] and region not in want[k]}
    assert semantics.region_vs_label(items, table).count() == 0  # none of them is a known province


def test_duplicates_answered_otherwise(spark):
    rows = [("a", "1", None, None, None), ("b", "2", "a", 0.95, None), ("c", "2", "a", 0.9, None), ("d", "$1$", "a", 1.0, None), ("e", "2", "a", 1.0, True), ("f", "2", "gone", 1.0, None), ("g", "见解析", "a", 1.0, False), ("h", "3", "e", 1.0, None)]
    items = spark.createDataFrame(rows, "key string, answer string, dup_of string, dup_score double, dup_answer_variant boolean")
    assert [tuple(r) for r in semantics.duplicates_answered_otherwise(items).collect()] == [("b", "a")]


def test_numbers_of_one_large_type_are_spread(spark):
    from quarry.sources import volumes

    rng = random.Random(5)
    seqs = rng.sample(range(10**9), 5000)
    rows = [("a" if i % 10 else None if i % 20 else "b", s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "type string, seq bigint")
    numbered = volumes.numbered(df, "type", "seq", "n")
    want = {(t, s): i for t in ("a", "b", None) for i, s in enumerate(sorted(s for x, s in rows if x == t), 1)}
    assert {(r.type, r.seq): r.n for r in numbered.collect()} == want
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "[type" in plan and all("_range" in x or "_rows" in x for x in plan.splitlines() if "Window [" in x)  # no window over a whole type


def test_grams_of_queries_stay_where_they_are(spark, monkeypatch):
    from quarry.operators import search

    rng = random.Random(9)
    text = lambda k: "".join(rng.choice("abc ") for _ in range(k))
    queries = spark.createDataFrame([(i, text(60)) for i in range(40)], "qid int, text string")
    targets = spark.createDataFrame([(i, text(30)) for i in range(20)], "tid int, text string")
    found = search.shortlist(queries, targets, 3, 3)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [gram" in plan and "SortMergeJoin [gram" not in plan
    monkeypatch.setattr(search, "MOST_BROADCAST", 0)
    rows = lambda df: {(r.qid, r.tid, r["rank"], round(r.score, 6)) for r in df.collect()}
    assert rows(found) == rows(search.shortlist(queries, targets, 3, 3))
