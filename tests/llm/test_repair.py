"""Conversation repair against a programme over whole strings, and by hand."""

import hashlib
import random
import re
import zlib

import pytest

from quarry.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, uid int, part string, copy int, text_ string"


def damaged(rows):
    """What the query does to rows (conv_id, turn, role, text), in their order."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code != 0:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def brute(rows):
    """Cheapest (cost, audit, turns) by trying every edit with at most two inserts before each turn and at the end; strings compared as they are."""
    held = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    seen, whys = set(), []
    for _, _, role, text in held:
        s = text.strip(" \t\n\x0b\x0c\r")
        whys.append("blank" if not s else "duplicate" if (role, text) in seen else "" if s[-1] in ".!?" else "truncated")
        seen.add((role, text))
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}

    def better(to, q, new):
        if q not in to or new[:2] < to[q][:2]:
            to[q] = new

    def inserted(states):
        out = dict(states)
        for q, (c, a, t) in states.items():
            for _ in range(2):
                q = follow[q]
                c, a, t = c + 5, a + "I", (*t, f"{name[q]}:")
                better(out, q, (c, a, t))
        return out

    for (_, _, role, text), why in zip(held, whys):
        new = {}
        for q, (c, a, t) in inserted(states).items():
            better(new, q, (c + 2, a + "D", t))
            if why not in ("blank", "duplicate"):
                more = 5 if why == "truncated" else 0
                if role[:1] == "s" and q == "":
                    better(new, "s", (c + more, a + "K", (*t, f"{role}:{text}")))
                if role[:1] == follow[q]:
                    better(new, follow[q], (c + more, a + "K", (*t, f"{role}:{text}")))
                better(new, follow[q], (c + more + 1, a + "R", (*t, f"{name[follow[q]]}:{text}")))
        states = new
    cost, audit, turns = min((v for q, v in inserted(states).items() if q in ("", "a")), key=lambda v: v[:2])
    known = [r[1] for r in held if r[1] is not None]
    initials = [r[2][:1] for r in held]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum((x, y) not in {("s", "u"), ("u", "a"), ("a", "u")} for x, y in zip(initials, initials[1:]))
    return (gaps, *(whys.count(w) for w in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def made(rng, n, conv):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["a.", "b!", "c", "", " \n", None, "what?", "cut off", "é. \t", "."]
    return [(conv, rng.choice([None, *range(12)]) if rng.random() < 0.2 else i, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.") for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_repair_matches_brute_force(spark, tmp_path, partitions):
    """One conversation has a third of all rows; with 40 partitions almost all conversations are in pieces."""
    rng = random.Random(partitions)
    rows = [r for conv in [None, *range(60)] for r in made(rng, rng.randint(1, 9), conv)] + made(rng, 200, 1000)
    d = str(tmp_path)
    spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).coalesce(1).write.parquet(f"{d}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in repair.query(spark, d).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {c: [] for c, *_ in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    assert got == {c: brute(x) for c, x in by.items()}


def test_by_hand(spark):
    turns = [(1, 0, "user", "hi."), (1, 1, "assistant", "yes."), (2, 0, "assistant", "alone."), (3, 0, "user", "a."), (3, 1, "user", "b."), (4, 0, "system", "s."), (4, 1, "user", "q?"), (4, 2, "assistant", "")]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in repair.report(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {1: (0, "KK"), 2: (2, "D"), 3: (1, "KR"), 4: (4, "RRD")}
    rows = repair.repaired(spark.createDataFrame(turns[3:5], "conv_id int, turn int, role string, text string")).orderBy("turn").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in rows] == [("K", "user", "a."), ("R", "assistant", "b.")]


def test_few_layers_and_no_state_lost():
    """A programme over 20,000 turns meets few layers, and its costs are those of one without pruning."""
    rng = random.Random(5)
    kinds = [(rng.choice("suat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(20_000)]
    p = repair.Programme()
    _, costs = p.forward(kinds)
    assert len(p.layers) < 3000
    plain = [0, None, None, None]
    for initial, why in kinds:
        new = [None] * 4
        for q, _, cost, r in repair.macros(initial if initial in "sua" else "", why):
            if plain[q] is not None and (new[r] is None or plain[q] + cost < new[r]):
                new[r] = plain[q] + cost
        plain = new
    best = min(c + 5 * k for c, k in ((plain[0], 0), (plain[3], 0), (plain[2], 1)))
    assert repair.finish(costs[repair.EMPTY])[0] == best


def test_empty(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/conversations.parquet")
    assert repair.query(spark, d).count() == 0
    rows = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repaired(rows).count() == 0 and repair.report(rows).count() == 0
