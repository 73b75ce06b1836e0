import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, extract, jaccard, langid, packing, pii, scoring, substrings, warc
from quarry.llm.common import ALNUM, NOT_SPACE, UID, Words, grams, with_uid
from tests.llm.conftest import ODD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(seed, n=40):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Short texts over few words, with copies, near copies, shared passages and odd rows."""
    rng, words = random.Random(seed), vocabulary(seed)
    shared = [rng.choice(words) for _ in range(70)]
    rows = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(0, 160))]
        if i % 4 == 0:
            at = rng.randint(0, len(body))
            body = body[:at] + shared[rng.randint(0, 10) :] + body[at:]
        rows.append(" ".join(body))
    for i in range(0, n, 5):
        rows.append(rows[i])
        near = rows[i].split()
        if near:
            near[rng.randrange(len(near))] = "changed"
        rows.append(" ".join(near).title())
    rows += ODD
    rng.shuffle(rows)
    out = list(enumerate(rows))
    return [*out, out[3], (None, rows[5]), (None, None)]


def test_words_and_grams_depend_on_the_words_only():
    parts = [b"Ab  cd\tef", b"", b"  ", b"ab cd", "é ab".encode()]
    w = Words(parts, NOT_SPACE, lower=True)
    assert np.diff(w.ptr).tolist() == [3, 0, 0, 2, 2]
    assert w.hashes[0] == w.hashes[3] == w.hashes[6] and w.hashes[1] == w.hashes[4] and len(set(w.hashes.tolist())) == 4
    assert Words([b"Ab"], NOT_SPACE, lower=False).hashes[0] != Words([b"ab"], NOT_SPACE, lower=False).hashes[0]
    assert np.diff(Words([b"a-b_c 1"], ALNUM, lower=True).ptr).tolist() == [4]
    h = Words([b"a b c a b c a b"], NOT_SPACE, lower=True).hashes
    for n in (1, 2, 3, 5, 8):
        g = grams(h, n)
        assert len(g) == 9 - n and all((g[i] == g[i + 3]) for i in range(len(g) - 3))
    assert len(grams(h, 9)) == 0


def test_decontamination_matches_brute_force(spark, make_docs):
    rows = corpus(2)
    rng, words = random.Random(4), [w for _, t in rows if t for w in t.split()[:200]]
    items = []
    for i in range(12):
        at = rng.randrange(len(words) - 40)
        items.append((i, " ".join(words[at : at + rng.choice([1, 3, 12, 13, 14, 30])])))
    items += [(20, None), (21, "!!"), (3, items[3][1]), (None, items[5][1])]
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: rx.findall((t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    want = []
    for i, t in rows:
        w, hit, ids = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                got = windows.get(tuple(w[p : p + n]))
                if got:
                    hit |= set(range(p, p + n))
                    ids |= got
        ids = sorted(str(x) for x in ids if x is not None)
        want.append((i, len(w), len(hit), tuple(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(with_uid(make_docs(rows)), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == Counter(want)


def test_substrings_match_brute_force(spark, make_docs, tmp_path):
    rows = corpus(3)
    least = {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if i is not None:
                least[k] = min(i, least.get(k, i))
    want = []
    for i, t in rows:
        w, gone = SPACED.findall(t or ""), set()
        for p in range(len(w) - 49):
            if i is not None and least[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.query(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_substrings_with_small_subtrees(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(substrings, "SUBTREE_ROWS", 2)
    test_substrings_match_brute_force(spark, make_docs, tmp_path)


def test_tree_compares_words_not_hashes():
    """Rows under one anchor, as equal hashes would bring them together: only equal words make a node."""
    a = [f"w{i}" for i in range(60)]
    rows = [(3, 30, 0, a), (1, 10, 5, a[:25] + ["other"] + a[26:]), (2, 20, 7, a[4:58]), (None, 40, 0, a), (2, 21, 0, a[:50])]
    table = pa.table(
        {
            "anchor": [5] * len(rows), "doc_id": pa.array([r[0] for r in rows], pa.int64()), UID: [r[1] for r in rows], "pos": pa.array([r[2] for r in rows], pa.int32()),
            "n": pa.array([len(r[3]) - 49 for r in rows], pa.int32()), "words": pa.array([" ".join([*r[3], ""]).encode() for r in rows], pa.binary()),
        }
    )
    for batches in (table.to_batches(), table.to_batches(max_chunksize=2)):
        got = [x for b in substrings._deep_nodes(batches) for x in zip(b.column(UID).to_pylist(), b.column("pos").to_pylist())]
        assert sorted(got) == [(30, 0), *((30, p) for p in range(4, 9))]


def jaccard_brute(rows):
    sets = []
    for _, t in rows:
        w = SPACED.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_rows(seed):
    """Groups whose pairs lie around the threshold, so that stars alone do not unite them."""
    rng, rows = random.Random(seed), []
    for g in range(6):
        base = [f"w{g}_{rng.randrange(500)}" for _ in range(120)]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(t[rng.randint(0, 12) : len(t) - rng.randint(0, 12)]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("rows", [corpus(5), near_rows(1)], ids=["corpus", "near"])
def test_jaccard_matches_brute_force(spark, make_docs, tmp_path, rows):
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = jaccard.query(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == jaccard_brute(rows)


def test_jaccard_in_small_tiles(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 3)
    monkeypatch.setattr(jaccard, "BUCKET_DOCS", 5)
    monkeypatch.setattr(jaccard, "BOX", 2)
    test_jaccard_matches_brute_force(spark, make_docs, tmp_path, near_rows(2))


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        c = int(c)
        total += c if i % 2 == 0 else 2 * c - 9 if c > 4 else 2 * c
    return total % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    out = [(m.start(), k, m.end()) for k, (rx, ok) in enumerate(rules) for m in re.finditer(rx, t or "") if ok(m.group())]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base_spans_match_brute_force(spark, make_docs):
    rng = random.Random(8)
    pieces = ["a@b.co_x@y.zz", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.04", "4111 1111 1111 1111", "+4111111111111111", "5555-5555-5555-4444", "+1 (741) 555-3069", "@@a@b.c@d.e", "é😀", "1 - 2", "+", "x.y@z", "a@b", "1.2.3", ".", "-", " ", "1234567890123456789012", "4" * 30, "word"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n", ","]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    texts += [*(t for t in ODD if t is None or len(t) < 300_000), "1" * 50_000, "a@" * 5_000, ("4111111111111111 " * 400), None]
    rows = list(enumerate(texts))
    spans = pii.with_spans(make_docs(rows))
    base = F.filter("_q_spans", lambda c: c["base"])
    for r in spans.select("doc_id", pii.written_out(base).alias("s"), pii.written_out(F.col("_q_spans")).alias("every")).collect():
        assert r.s == base_spans(texts[r.doc_id]), texts[r.doc_id][:200]
        assert not r.s or set(r.s.split(",")) <= set(r.every.split(","))


def test_pii_wider_forms_and_redaction(spark, make_docs):
    texts = ["call (555) 123-4567 now", "mail jo.do (at) example (dot) com", "order 555-12-3456 of 2020", "ip 10[.]0[.]0[.]1", None, "", "a@b.cd é +1 (741) 555-3069", "clean text of 12 words and 3.14"]
    got = [r.text for r in pii.redact(make_docs(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == ["call [PHONE] now", "mail [EMAIL]", texts[2], "ip [IP]", None, "", "[EMAIL] é [PHONE]", texts[7]]


def check_packing(rows, pieces):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        want[i, len(ids)] += len(ids)
        for p in pieces:
            if p.doc_id == i and p.doc_tokens == len(ids):
                part = ids[p.start : p.start + p.length]
                assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
    got = Counter()
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
    assert got == want
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values(), default=0) <= packing.WINDOW
    return sum(packing.WINDOW - n for n in fill.values() if n & (n - 1)) / max(1, sum(fill.values()))


def test_packing_keeps_every_token_once(spark, make_docs):
    rng, words = random.Random(3), vocabulary(9, 400)
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 20, 150, 400, 900, 2500]))) for _ in range(120)]
    texts += [t for t in ODD if t is None or len(t) < 150_000] + ["a <|endoftext|> b", "it's  a\n b", "one two"] + ["same text here"] * 40
    rows = list(enumerate(texts)) + [(5, "other text with the id of another"), (None, "no id")]
    assert check_packing(rows, packing.pack(make_docs(rows)).collect()) < 0.02


def test_packing_one_length_for_all(spark, make_docs):
    rows = [(i, " ".join(["the"] * 899)) for i in range(60)]
    assert check_packing(rows, packing.pack(make_docs(rows)).collect()) < 0.02


def test_packing_solver():
    combos = packing.combinations(packing.CLASSES)
    assert {int(c.sum()) for c in combos} == {packing.CLASSES}
    histogram = np.zeros(packing.CLASSES)
    histogram[[99, 155]] = 50
    counts = packing.repeats(histogram, combos)
    used = np.zeros(packing.CLASSES + 1)
    for j in np.flatnonzero(counts):
        for c in combos[j]:
            used[c] += counts[j]
    assert used[100] == used[156] == 50 and (used[1:] <= histogram).all()


def test_language_of_held_out_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, make_docs):
    docs = make_docs([*enumerate(ODD), (None, "und die"), (50, "the and of")], ["en"] * len(ODD) + ["de", "en"])
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), langid.learnable(docs)).collect()}
    for i, t in enumerate(ODD):
        assert (got[i].lang_pred == "und") == (not any(map(str.isalpha, t or "")))
        assert got[i].score >= 0 and (got[i].score == 0) == (got[i].lang_pred == "und")
    bare = langid.identify(docs.select("doc_id", "text"), langid.learnable(docs.limit(0)))
    assert {r.lang_pred for r in bare.collect()} == {"und"}


def test_cross_parsing_counts_longest_matches():
    parser = langid.Parser({"a": "the cat sat on the mat", "b": "xyz"})
    phrases, sizes = parser.phrases(["the cat the mat"])
    rest, n = "the cat the mat", 0
    while rest:  # greedy longest substrings of the sample
        k = max([k for k in range(1, len(rest) + 1) if rest[:k] in "the cat sat on the mat"], default=1)
        rest, n = rest[k:], n + 1
    assert sizes[0] == 15 and phrases[0, parser.names.index("a")] == n


def test_scoring_matches_brute_force(spark, make_docs, monkeypatch):
    import math

    monkeypatch.setattr(scoring, "FREQUENT", 10)
    rows = corpus(6, 30)
    train = [t for k, (_, t) in enumerate(rows) if k % 3]
    c = Counter()
    for t in train:
        c.update([*SPACED.findall((t or "").translate(LOW)), None])
    docs = make_docs(rows)
    flagged = with_uid(docs).withColumn("held_out", F.lit(False)).select(UID, "doc_id", "held_out", "text")
    got = scoring.score(flagged, make_docs(list(enumerate(train)))).collect()
    want = []
    for i, t in rows:
        w = [*SPACED.findall((t or "").translate(LOW)), None]
        want.append((i, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (sum(c.values()) + len(c) + 1)) for x in w), 5)))
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("contexts", [1, 40])
def test_scores_do_not_depend_on_how_many_contexts_are_sent(spark, make_docs, monkeypatch, contexts):
    rows = list(enumerate([*(t for _, t in corpus(8, 20)), "дом и сад", "家と庭 é😀", None, ""]))
    flagged = with_uid(make_docs(rows)).withColumn("held_out", F.lit(False)).select(UID, "doc_id", "held_out", "text")
    train = make_docs(rows[: len(rows) // 2] + rows[-4:])
    want = dict(scoring.score(flagged, train).select("doc_id", "score").collect())
    monkeypatch.setattr(scoring, "CONTEXTS", contexts)
    got = dict(scoring.score(flagged, train).select("doc_id", "score").collect())
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)


def test_scoring_tree_is_a_distribution():
    """Byte probabilities of every context add up to one, and agree with a direct computation of the weighting."""
    import math

    text = [b"abracadabra", b"abrakadabra!"]
    seen = Counter()
    for t in text:
        s = b"\xff\xff\xff" + t + b"\xff"
        for i in range(3, len(s)):
            seen[s[i - 3 : i], s[i]] += 1
    ctx = np.array([int.from_bytes(c, "big") for c, _ in seen])
    model = scoring.Model(ctx, np.array([b for _, b in seen]), np.array(list(seen.values())), np.zeros(len(ctx), bool))
    assert np.allclose((10.0 ** model.table.astype(float)).sum(axis=1), 1, atol=1e-4)

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi) if n0 + n1 else 0.0

    def counts(suffix, bits):
        n = [0, 0]
        for (c, b), k in seen.items():
            if c.endswith(suffix) and format(b, "08b").startswith(bits):
                n[int(format(b, "08b")[len(bits)])] += k
        return n

    def weighted(suffix, bits):
        own = kt(*counts(suffix, bits))
        if len(suffix) == 3:
            return own
        below = sum(weighted(bytes([x]) + suffix, bits) for x in {c[2 - len(suffix)] for c, _ in seen if c.endswith(suffix)})
        return np.logaddexp(own, below) - math.log(2)

    def predict(suffix, full, bits):
        n0, n1 = counts(suffix, bits)
        p1 = (n1 + 0.5) / (n0 + n1 + 1)
        if len(suffix) == 3:
            return p1
        longer = full[2 - len(suffix) :]
        if not any(c.endswith(longer) for c, _ in seen):
            return p1
        share = math.exp(kt(n0, n1) - math.log(2) - weighted(suffix, bits))
        return share * p1 + (1 - share) * predict(longer, full, bits)

    for full, byte in [(b"abr", ord("a")), (b"xbr", ord("a")), (b"bra", ord("k")), (b"zzz", ord("q"))]:
        bits, log = format(byte, "08b"), 0.0
        for i in range(8):
            p1 = predict(b"", full, bits[:i])
            log += math.log10(p1 if bits[i] == "1" else 1 - p1)
        got = model.logs(np.array([int.from_bytes(full, "big")]), np.array([byte]))[0]
        assert abs(got - log) < 1e-3, (full, byte)
    assert np.allclose(model.score([b"abra", b""]), [sum(model.logs(np.array([int.from_bytes((b"\xff" * 3 + b"abra")[i : i + 3], "big")]), np.array([(b"abra\xff")[i]]))[0] for i in range(5)), model.logs(np.array([0xFFFFFF]), np.array([255]))[0]], atol=1e-3)


def test_warc_round_trip(spark):
    body = "<p>" + "same " * 40 + "</p>"
    rows = [(3, "http://a/3", body), (1, "http://a/1", body), (2, None, body), (4, "http://a\r\nx", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (1, "again", body), (None, "u", "é" * 60), (None, "u", "é" * 60)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, offset int")
    index = warc.write_archives(pages)
    got = warc.read_records(index).collect()
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        want[i, len(p), hashlib.sha256(p).hexdigest()] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds[1, "response", None] == kinds[1, "revisit", 1] == kinds[2, "revisit", 1] == kinds[3, "revisit", 1] == 1
    assert kinds[4, "response", None] == kinds[5, "response", None] == 1
    assert kinds[None, "response", None] == kinds[None, "revisit", None] == 1
    assert {r.payload.decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h in rows}
    heads = []
    for path in {r.path for r in index.collect()}:
        raw = gzip.open(path.removeprefix("file:"), "rb").read()
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        while raw:
            head, _, raw = raw.partition(b"\r\n\r\n")
            heads.append(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]))
            raw = raw[int(heads[-1]["Content-Length"]) + 4 :]
    by_id = {h["WARC-Record-ID"]: h for h in heads}
    assert len(by_id) == len(heads) and all("WARC-Date" in h for h in heads)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            first = by_id[h["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and first["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"]
    named = warc.read_records(warc.write_archives(pages.withColumn("page_id", F.concat(F.lit("p/ é"), "page_id"))))
    assert "p/ é1" in {r.page_id for r in named.filter("record_type = 'response'").collect()}
    one = warc.read_records(index.filter("page_id = 4")).collect()
    assert len(one) == 1 and one[0].payload == b"short"


def test_extraction_of_main_text(spark):
    page = (
        '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
        '<div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p><b>First  para,\nwith text.<br><p>Second para follows here, and goes on.</p>'
        '<aside class="related">See also that.</aside></article><section class="comments"><p>Great post, thanks.</p></section><footer>&copy; all.</footer></body></html>'
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "<<<>>> &amp <p"), (5, "u", page[: len(page) // 2]), (6, "u", "<div>" * 3000 + "x")]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].text == "A & B First para, with text. Second para follows here, and goes on."
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0 and got[1].n_chars == len(got[1].text)
    assert len(got) == 6


def test_extraction_on_fresh_synthetic_pages():
    rng, trees, good = random.Random(77), extract.fit(), 0
    for _ in range(100):
        page = extract.training_page(rng)
        nodes = extract.blocks(page)
        want = " ".join(extract.block_text(n) for n in nodes if n.runs and any(w.startswith("q") for w in "".join(n.runs).split()))
        good += extract.main_texts([page], trees)[0] == want
    assert good >= 85


def test_decoding_never_keeps_a_child_of_a_dropped_parent():
    rng = np.random.default_rng(1)
    nodes = extract.blocks("<div><p>a</p><div><p>b</p><p>c</p></div></div>")
    for _ in range(50):
        odds = rng.normal(size=len(nodes))
        kept = set(extract.decode(nodes, odds))
        best = -1.0
        for mask in range(1 << len(nodes)):  # every consistent choice
            on = [bool(mask >> i & 1) for i in range(len(nodes))]
            if all(not on[i] or nodes[i].parent < 0 or on[nodes[i].parent] for i in range(len(nodes))):
                total = sum(o for o, k in zip(odds, on) if k)
                if total > best:
                    best, leaves = total, {i for i in range(len(nodes)) if on[i] and nodes[i].runs}
        assert kept == leaves
