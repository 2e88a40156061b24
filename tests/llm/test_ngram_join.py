import random

import pytest
from pyspark.sql import functions as F

from revisit.llm import ngram_join
from revisit.llm.graph import components

SCHEMA = "doc_id long, text string"


def token_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(data):
    """Component of every id, over all pairs."""
    sets = [(i, token_set(t)) for i, t in data if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 4 * min(len(a), len(b)) <= 5 * min(len(a), len(b)) and min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4:
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both) and root(i) != root(j):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def check(df, data):
    got = ngram_join.near_duplicates(df).collect()
    want = brute(data)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles) for r in got) == sorted(
        (i is not None, i or 0, len(token_set(t))) for i, t in data)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def check_counts(df, data):
    """Links of every row, over all pairs of rows."""
    sets = [(i, token_set(t)) for i, t in data]
    want = []
    for k, (i, a) in enumerate(sets):
        n = 0
        for j, (o, b) in enumerate(sets):
            if j != k and i is not None and o is not None and a and b and min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4:
                both = len(a & b)
                n += 100 * both >= 80 * (len(a) + len(b) - both)
        want.append((i is not None, i or 0, n))
    got = ngram_join.near_duplicates(df, counted=True).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_links) for r in got) == sorted(want)
    return max(n for *_, n in want)


@pytest.mark.parametrize("group", [ngram_join.GROUP, 16])
def test_links_are_counted(spark, monkeypatch, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    data = corpus(4)
    data += [(2000 + i, data[i % 40][1]) for i in range(60)] + [(None, data[0][1]), (2001, data[1][1]), (2002, "other words here")]
    assert check_counts(spark.createDataFrame(data, SCHEMA).repartition(3), data) > 30


def test_links_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_counts(docs, [(r.doc_id, r.text) for r in docs.collect()])


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, share):
    return [f"e{rng.random():.12f}" if rng.random() < share else w for w in words]


def corpus(seed):
    """Groups of near copies up to a third of all texts, passages in many texts, short texts."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [edited(rng, base, rng.choice((0, 0.01, 0.02, 0.03, 0.08))) for _ in range(120)]
    texts += [prose(rng, rng.randrange(1, 60)) + passage + prose(rng, rng.randrange(1, 20)) for _ in range(60)]
    texts += [passage + prose(rng, rng.randrange(0, 14)) for _ in range(60)]
    for _ in range(20):
        own = prose(rng, rng.randrange(4, 80))
        texts += [edited(rng, own, rng.choice((0, 0.005, 0.02))) for _ in range(rng.randrange(1, 5))]
    texts += [prose(rng, rng.randrange(0, 12), 3) for _ in range(80)]
    rng.shuffle(texts)
    return [(i * 7 % 1009, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rare, subgroup, heavy", [(16, 8, 64), (2, 8, 8), (1, 3, 4)])
def test_hot_groups_and_passages(spark, monkeypatch, rare, subgroup, heavy):
    """Small limits send most tokens through pairs, extended prefixes and marks."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "SUBGROUP", subgroup)
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "PART", 3000)
    data = corpus(rare)
    check(spark.createDataFrame(data, SCHEMA).repartition(3), data)


def test_chain_of_links(spark):
    """Ends of a chain are far apart, but one component."""
    rng = random.Random(3)
    words, data = prose(rng, 100), []
    for i in range(30):
        words = words[4:] + prose(rng, 4)
        data.append((i, " ".join(words)))
    check(spark.createDataFrame(data, SCHEMA), data)


def test_odd_rows(rows):
    data = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE "), (6, "one two three four"), (7, "one two three four five"),
            (8, "é x y z w"), (9, "É x y z w"), (10, "a\x1cb c d e"), (None, "one"), (None, None), (7, "one two three four five"),
            (11, "a " * 30_000), (12, "a a a a a")]
    df = rows(data, SCHEMA).withColumn("n", F.lit(1)).withColumn("class", F.lit("x")).withColumn("component_id", F.lit(2))
    got = ngram_join.near_duplicates(df).collect()
    assert len(got) == len(data)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[4] == comp[5] == 4 and comp[7] == 7 and comp[8] == 8 and comp[9] == 9 and comp[11] == comp[12] == 11
    assert [comp[i] for i in (1, 2, 3)] == [1, 2, 3] and comp[None] is None
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id in (1, 4, 6, 7, 11)} == {1: 0, 4: 1, 6: 1, 7: 1, 11: 1}
    assert ngram_join.near_duplicates(rows([], SCHEMA)).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
