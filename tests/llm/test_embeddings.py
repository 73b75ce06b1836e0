from collections import Counter

import numpy as np
import pytest

from quarry.llm import embed

SCHEMA = "vec_id bigint, embedding array<float>, label int, n bigint, v string"


def brute(rows):
    x = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        x.append(np.array(v, np.float32).astype(float) if ok else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]):
                if x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= embed.SIMILARITY:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for i, (d, *_) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return Counter((d, links[i], least[find(i)], d is not None and d == least[find(i)]) for i, (d, *_) in enumerate(rows))


def vectors(n, seed=1, width=16):
    rng, rows = np.random.default_rng(seed), []
    centres = rng.normal(size=(n // 8, width))
    for i in range(n):
        v = centres[rng.integers(len(centres))] + 0.3 * rng.normal(size=width)
        rows.append((i, [float(c) for c in v.astype(np.float32)], int(rng.integers(2))))
    rows += [(n + k, rows[0][1], rows[0][2]) for k in range(20)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * width, 1), (903, [1.0] * (width - 1) + [None], 1), (904, [float("nan")] * width, 1), (905, rows[0][1], None), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (None, rows[1][1], rows[1][2]), rows[2]]
    return rows


def compared(spark, rows):
    """What was found against all pairs: the share of links; no row has more than there are."""
    got = embed.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    want = brute(rows)
    assert Counter(r.vec_id for r in got) == Counter(k[0] for k in want.elements())
    most = Counter()
    for (d, n, *_), k in want.items():
        most[d] += n * k
    mine = Counter()
    for r in got:
        mine[r.vec_id] += r.n_links
    assert all(mine[d] <= most[d] for d in mine)
    return sum(mine.values()) / max(1, sum(most.values())), Counter(map(tuple, got)) == want


@pytest.mark.parametrize("leaf,tile,depth", [(10_000, 2048, 6), (20, 2048, 6), (8, 5, 2)])
def test_forest_finds_links(spark, monkeypatch, leaf, tile, depth):
    monkeypatch.setattr(embed, "LEAF", leaf)
    monkeypatch.setattr(embed, "TILE", tile)
    monkeypatch.setattr(embed, "DEPTH", depth)
    share, same = compared(spark, vectors(300))
    assert share >= 0.97 and (same or leaf < 300)


@pytest.mark.parametrize("spread", [0.02, 0.09])
def test_dense_groups_stay_together(spark, monkeypatch, spread):
    """Groups whose vectors are all near each other, or nearly so, in labels of many leaves."""
    monkeypatch.setattr(embed, "TILE", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 16))
    rows = [(i, [float(c) for c in (centres[i % 4 if i < 300 else 0] + spread * 3 * rng.normal(size=16)).astype(np.float32)], i % 7 // 6) for i in range(500)]
    rows += vectors(200, seed=9)[:220]
    assert compared(spark, rows)[0] >= 0.98


def test_recall_of_pairs_around_the_threshold(spark, sf):
    """The table's vectors, each with a neighbour of cosine 0.93 to 0.99, in one label: deep trees."""
    rng, rows = np.random.default_rng(3), []
    for i, r in enumerate(spark.read.parquet(f"{sf}/embeddings.parquet").collect() * 4):
        v = np.array(r.embedding, float)
        if i >= 200:
            v = rng.normal(size=len(v))
        v /= np.linalg.norm(v)
        u = rng.normal(size=len(v))
        u -= (u @ v) * v
        u /= np.linalg.norm(u)
        c = rng.uniform(0.931, 0.99)
        rows += [(2 * i, v.astype(np.float32).tolist(), 1), (2 * i + 1, (c * v + np.sqrt(1 - c * c) * u).astype(np.float32).tolist(), 1)]
    assert compared(spark, rows)[0] >= 0.97


def test_empty_table(spark):
    assert embed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
