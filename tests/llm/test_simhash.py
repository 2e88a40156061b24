import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from revisit.llm import simhash_trie as T

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, errors):
    """Smallest position reachable, by comparing all values."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    v = np.array(values, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= errors):
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(v))]


def check(df, data, **how):
    got = T.near_duplicates(df, **how).collect()
    prints = [slow_fingerprint(t) for _, t in data]
    roots = classes(prints, how.get("errors", 4))
    least = {}
    for (i, _), c in zip(data, roots):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = [(i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(data, prints, roots)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def numbers(seed=3, n=1500):
    """Random values, dense clusters, chains of small steps, and neighbours at distances 3 to 6."""
    rnd = random.Random(seed)
    out = {rnd.getrandbits(64) for _ in range(n)} | {0, (1 << 64) - 1, 1 << 63}
    centre = rnd.getrandbits(64)
    out |= {centre ^ sum(1 << b for b in rnd.sample(range(0, 64, 5), rnd.randrange(5))) for _ in range(400)}
    x = rnd.getrandbits(64)
    for _ in range(60):
        x ^= sum(1 << b for b in rnd.sample(range(64), 4))
        out.add(x)
    for v in rnd.sample(sorted(out), 200):
        out.add(v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(3, 7))))
    return sorted(out)


@pytest.mark.parametrize("parts, leaf, errors", [(3, 40, 4), (2, 200, 3), (3, 10 ** 6, 4)])
def test_links_equal_all_pairs(spark, parts, leaf, errors):
    values = numbers()
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "bits long")
    place = {s: k for k, (s,) in enumerate(signed)}
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in T.links(df, errors, parts, leaf).collect():
        x, y = root(place[a]), root(place[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(values))] == classes(values, errors)


def test_few_links_of_a_dense_cluster(spark):
    """A task returns fewer links than fingerprints, whatever the number of linked pairs."""
    rnd = random.Random(1)
    centre = np.uint64(rnd.getrandbits(64))
    a = np.unique(np.array([centre ^ np.uint64(sum(1 << b for b in rnd.sample(range(16), rnd.randrange(9)))) for _ in range(20000)], np.uint64))
    x, y = T.meet(a, None, 21, 1, 4)
    assert len(x) == len(y) < len(a)


def test_narrow_frontier(monkeypatch):
    """Splitting the node pairs of a level into parts changes nothing."""
    values = np.array(numbers(5, 800), np.uint64)

    def found():
        x, y = T.meet(values, None, 64, 4, 4)
        k = {int(v): i for i, v in enumerate(values)}
        c = T.Classes(len(values))
        c.link(np.array([k[int(v)] for v in x]), np.array([k[int(v)] for v in y]))
        return c.root.tolist()
    whole = found()
    monkeypatch.setattr(T, "WIDE", 50)
    assert found() == whole == classes(values.tolist(), 4)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], leaf=50)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    data = [(5, None), (3, ""), (9, " \t\n"), (None, "a b c d e f"), (7, "A b c D e f"), (7, "A b c D e f"), (1, "one"), (2, "ONE"), (4, "two words"),
            (11, long), (12, long + " end"), (None, "nobody else has this text"), (13, "é É a"), (14, "é É A"), (15, "x" * 200_000)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("bits", F.lit("clash")).withColumn("component_id", F.lit(0)).withColumn("fingerprint", F.lit(None))
    check(df, data)


def test_empty(spark):
    out = T.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["doc_id", "fingerprint", "component_id"]
