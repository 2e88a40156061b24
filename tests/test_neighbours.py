"""Neighbours, exact top lists and the ALS half-step against plain loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from revisit.operators import factors, neighbours, recommend


def ratings(n_users=330, n_items=24, seed=3):
    """String users; one item that a third of the users rated, one user who rated all items."""
    rnd = random.Random(seed)
    rows = {(f"u{u:04d}", i): rnd.randrange(2, 7) for u in range(n_users) for i in rnd.sample(range(1, n_items), rnd.randrange(2, 5))}
    rows |= {(f"u{u:04d}", 0): 2 + u % 4 for u in range(0, n_users, 3)}
    rows |= {("all", i): 2 + i % 5 for i in range(n_items)}
    return sorted((u, i, r) for (u, i), r in rows.items())


def slow_lists(data, by, k, n, least):
    """Lists by comparing all points; ``data``: rows of user_folds."""
    out = set()
    for g in {r["fold"] for r in data}:
        train = [r for r in data if not (r["is_test"] and r["fold"] == g)]
        p, c = ("item", "user") if by == "item" else ("user", "item")
        vec = defaultdict(dict)
        for r in train:
            vec[r[p]][r[c]] = r["rating"]
        mean = {a: sum(v.values()) / len(v) for a, v in vec.items()}
        dev = {a: {x: y - mean[a] for x, y in v.items()} for a, v in vec.items()}
        norm = {a: math.sqrt(sum(y * y for y in v.values())) for a, v in dev.items()}
        asked = {r["user"] for r in data if r["fold"] == g}
        scores = defaultdict(list)
        for a in vec:
            if by == "user" and a not in asked:
                continue
            near = defaultdict(list)
            for b in vec:
                if a != b and norm[a] and norm[b]:
                    s = math.floor(sum(y * dev[b][x] for x, y in dev[a].items() if x in dev[b]) / norm[a] / norm[b] * 1e9 + 0.5)
                    if s > least:
                        for x, d in dev[b].items():
                            near[x].append((-s, b, d))
            for x, found in near.items():
                user, item = (x, a) if by == "item" else (a, x)
                if x in vec[a] or user not in asked:
                    continue
                best = sorted(found)[:k]
                score = math.floor((mean[a] + sum(-s * d for s, _, d in best) / sum(-s for s, _, _ in best)) * 1e9 + 0.5)
                scores[user].append((-score, item))
        out |= {(g, u, i, rank + 1, -s / 1e9) for u, v in scores.items() for rank, (s, i) in enumerate(sorted(v)[:n])}
    return out


@pytest.mark.parametrize("by, least", [("item", 1000), ("user", 0)])
def test_lists_equal_all_pairs(spark, by, least):
    folded = recommend.user_folds(spark.createDataFrame(ratings(), "user string, item long, rating long"), n_folds=2).checkpoint()
    got = neighbours.knn_recommend(folded, by=by, k=3, n=4).collect()
    want = slow_lists(folded.collect(), by, 3, 4, least)
    assert {(r["fold"], r["user"], r["item"], r["rank"], r["score"]) for r in got} == want and len(got) == len(want) > 100


def test_no_ratings(spark):
    folded = recommend.user_folds(spark.createDataFrame([], "user string, item long, rating long"))
    assert neighbours.knn_recommend(folded, by="item").collect() == []
    with pytest.raises(ValueError):
        neighbours.knn_recommend(folded, by="course")


def test_matches_in_slices(monkeypatch):
    rnd = np.random.default_rng(0)
    x, y = rnd.integers(0, 9, 60), np.sort(rnd.integers(0, 9, 50))
    monkeypatch.setattr(neighbours, "SLICE", 20)
    got = [(i, j) for a, b in neighbours._matches(x, y) for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(got) == [(i, j) for i in range(60) for j in range(50) if x[i] == y[j]]


def test_best_keeps_k(monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE", 10)
    rnd, best, rows = random.Random(1), neighbours.Best(3), []
    keys = rnd.sample(range(10 ** 6), 400)
    for s in range(0, 400, 7):
        part = [(rnd.randrange(5), key, float(key)) for key in keys[s:s + 7]]
        rows += part
        best.add(*(np.array(c) for c in zip(*part)))
    best.settle()
    want = [(c, key) for c in range(5) for key in sorted((k for d, k, _ in rows if d == c), reverse=True)[:3]]
    assert list(zip(best.cell.tolist(), best.key.tolist())) == want and best.dev.tolist() == [float(k) for _, k in want]


@pytest.mark.parametrize("block", [1024, 7])
def test_top_products(spark, block):
    """Also a user with a zero vector, one who has seen nearly all, and equal items."""
    rnd = random.Random(5)
    users = [(u, [rnd.gauss(0, 1) for _ in range(3)]) for u in range(290)] + [(900, [0.0, 0.0, 0.0])]
    items = [(i, [rnd.gauss(0, 1 + (i % 10 == 0) * 4) for _ in range(3)]) for i in range(60)]
    items += [(100 + i, items[i][1]) for i in range(10)]
    seen = {(u, rnd.randrange(60)) for u in range(200) for _ in range(5)} | {(7, i) for i, _ in items[:66]}
    got = factors.top_products(spark.createDataFrame(users, "u long, vec array<double>"), spark.createDataFrame(items, "i long, vec array<double>"),
                               spark.createDataFrame(sorted(seen), "u long, i long"), n=6, block=block).collect()
    want = set()
    for u, x in users:
        scores = sorted((-math.floor(float(np.dot(x, y)) * 1e9 + 0.5), i) for i, y in items if (u, i) not in seen)[:6]
        want |= {(u, i, k + 1) for k, (_, i) in enumerate(scores)}
    assert {(r["u"], r["i"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_bound_prunes(spark):
    """With falling norms most users need no further block of items."""
    items = spark.createDataFrame([(i, [100.0 / (i + 1), 0.0]) for i in range(64)], "i long, vec array<double>")
    blocks, _ = factors._item_blocks(items, 8)
    assert [r["block"] for r in sorted(blocks.collect(), key=lambda r: -r["top"])] == list(range(8))
    users = spark.createDataFrame([(u, [1.0, 1.0]) for u in range(30)], "u long, vec array<double>")
    seen = spark.createDataFrame([], "u long, i long")
    assert all(r["i"] < 5 for r in factors.top_products(users, items, seen, n=5, block=8).collect())


def test_users_travel_once_per_part(spark, monkeypatch):
    """With equal norms every user needs every block of items; users meet parts of many blocks."""
    rnd = random.Random(6)
    turn = [rnd.random() * 6.28 for _ in range(480)]
    items = [(i, [math.cos(t), math.sin(t)]) for i, t in enumerate(turn)]
    users = [(u, [rnd.gauss(0, 1) for _ in range(2)]) for u in range(300)]
    frame = spark.createDataFrame(users, "u long, vec array<double>")
    sent, run = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, *a, **k: sent.append(self.count()) or run(self, *a, **k))
    got = factors.top_products(frame, spark.createDataFrame(items, "i long, vec array<double>"),
                               spark.createDataFrame([(0, 0)], "u long, i long"), n=4, block=8).collect()
    assert sum(sent) <= 2 * 8  # two blocks of users, 60 of items
    want = {(u, i, k + 1) for u, x in users for k, (_, i) in enumerate(
        sorted((-math.floor(float(np.dot(x, y)) * 1e9 + 0.5), i) for i, y in items if (u, i) != (0, 0))[:4])}
    assert {(r["u"], r["i"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_half_step(spark):
    rnd = random.Random(9)
    rows = sorted({(f"u{u}", i): rnd.randrange(1, 4) for u in range(300) for i in rnd.sample(range(40), 4)}.items())
    rows = [(u, i, w) for (u, i), w in rows] + [("all", i, 1) for i in range(40)]
    ys = {i: [rnd.random() for _ in range(5)] for i in range(43)}
    got = factors.als_half_step(spark.createDataFrame(rows, "u string, i long, w long"),
                                spark.createDataFrame(sorted(ys.items()), "i long, vec array<double>"), alpha=3.0, reg=0.2, weight="w").collect()
    y = np.array([ys[i] for i in sorted(ys)])
    for r in got:
        mine = [(i, w) for u, i, w in rows if u == r["u"]]
        a = y.T @ y + 0.2 * np.eye(5) + sum(3.0 * w * np.outer(y[i], y[i]) for i, w in mine)
        assert np.allclose(r["vec"], np.linalg.solve(a, sum((1 + 3.0 * w) * y[i] for i, w in mine)), rtol=1e-9)
    assert len(got) == 301
