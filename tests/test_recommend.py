import math
import random

from revisit.operators import recommend


def _ratings(spark, n_users=40, n_items=15, seed=2):
    rnd = random.Random(seed)
    rows = set()
    for u in range(n_users):
        for i in rnd.sample(range(n_items), rnd.randrange(2, 6)):
            rows.add((u, i, rnd.randrange(2, 9)))
    return spark.createDataFrame(sorted(rows), "user long, item long, rating long")


def test_folds_one_test_item_per_user(spark):
    f = recommend.user_folds(_ratings(spark)).collect()
    per = {}
    for r in f:
        per.setdefault(r["user"], []).append(r)
    for rs in per.values():
        assert sum(r["is_test"] for r in rs) == 1
        assert len({r["fold"] for r in rs}) == 1 and 0 <= rs[0]["fold"] < 5
    again = recommend.user_folds(_ratings(spark)).collect()
    assert sorted(map(tuple, f)) == sorted(map(tuple, again))


def test_topn_metrics_brute_force(spark):
    recs = spark.createDataFrame([("A", 1, 10, 1), ("A", 1, 11, 2), ("A", 1, 12, 3),
                                  ("A", 2, 20, 1), ("A", 2, 21, 12)],
                                 "algorithm string, user long, item long, rank long")
    test = spark.createDataFrame([(1, 11), (2, 21)], "user long, item long")
    got = {r["user"]: r for r in recommend.topn_metrics(recs, test, k=10).collect()}
    # user 1: hit at rank 2 in a list of 3; library discount 1/max(1, log2(2)) = 1
    assert got[1]["precision"] == 1 / 3 and got[1]["recall"] == 1.0 and got[1]["ndcg"] == 1.0
    # user 2: the hit is at rank 12 > k -> no hit in the top 10 (list length 1)
    assert got[2]["precision"] == 0 and got[2]["recall"] == 0 and got[2]["ndcg"] == 0
    tb = {r["user"]: r for r in recommend.topn_metrics(recs, test, k=10, discount="textbook").collect()}
    assert abs(tb[1]["ndcg"] - 1 / math.log2(3)) < 1e-12


def test_tfidf_unit_norm_and_formula(spark):
    r = _ratings(spark)
    rows = r.collect()
    n = len({x["user"] for x in rows})
    df = {}
    for x in rows:
        df[x["item"]] = df.get(x["item"], 0) + 1
    got = recommend.tfidf_confidence(r).collect()
    norms = {}
    for g in got:
        norms[g["user"]] = norms.get(g["user"], 0) + g["weight"] ** 2
    assert all(abs(v - 1) < 1e-9 for v in norms.values())
    u0 = [x for x in rows if x["user"] == 0]
    w = {x["item"]: x["rating"] * (math.log((1 + n) / (1 + df[x["item"]])) + 1) for x in u0}
    nrm = math.sqrt(sum(v * v for v in w.values()))
    for g in got:
        if g["user"] == 0:
            assert abs(g["weight"] - w[g["item"]] / nrm) < 1e-9


def test_min_items_filter(spark):
    r = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (2, 1, 3)], "user long, item long, rating long")
    assert sorted(x["user"] for x in recommend.filter_min_items(r).collect()) == [1, 1]


def test_folds_with_min_items_equal_filter_then_folds(spark):
    r = _ratings(spark, n_users=50, seed=5).union(
        spark.createDataFrame([(900, 1, 3)], "user long, item long, rating long"))  # a one-item user
    a = recommend.user_folds(recommend.filter_min_items(r)).collect()
    b = recommend.user_folds(r, min_items=1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(x["user"] != 900 for x in b)


def test_popular_lists_are_whole(spark):
    """Users who have most of the popular items get the next ones, down to the last item."""
    rnd = random.Random(4)
    n_items, n, candidates = 60, 10, 15
    rows = {(u, i) for u in range(60) for i in rnd.sample(range(n_items), rnd.randrange(2, 6))}
    rows |= {(100, i) for i in range(45)} | {(101, i) for i in range(56)} | {(102, i) for i in range(20)} | {(103, i) for i in range(n_items)}
    folded = recommend.user_folds(spark.createDataFrame([(*r, 3) for r in sorted(rows)], "user long, item long, rating long"))
    data = folded.collect()
    want = set()
    for fold in {r["fold"] for r in data}:
        count = {}
        for r in data:
            if not (r["is_test"] and r["fold"] == fold):
                count[r["item"]] = count.get(r["item"], 0) + 1
        order = sorted(count, key=lambda i: (-count[i], i))
        for u in {r["user"] for r in data if r["fold"] == fold}:
            train = {r["item"] for r in data if r["user"] == u and not r["is_test"]}
            want |= {(fold, u, i, k + 1) for k, i in enumerate([i for i in order if i not in train][:n])}
    got = [(r["fold"], r["user"], r["item"], r["rank"]) for r in recommend.popular_recommend(folded, n=n, candidates=candidates).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(u == 100 for _, u, _, _ in got) == n
