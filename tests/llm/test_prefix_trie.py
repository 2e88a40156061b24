import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from revisit.llm import prefix_trie as T
from revisit.llm.catalog import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string"
D = "/root/testdata/sf0.01"


def slow(data):
    """All nodes, by walking every rebuilt conversation."""
    own = {}
    for c, t, r, x in data:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(rows)] for c, rows in own.items()}
    members, ends = {}, {}
    for c, rows in own.items():
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(base, [])[:h] + rows[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        mine = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        parts = [below[k] for k in kids.get(node, [])]
        below[node] = (sum(p[0] for p in parts) or 1, mine + sum(p[1] for p in parts))
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -99, len(m), len(kids.get(n, [])), *below[n],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items())


def fast(df, last=T.LAST):
    out = T.nodes(T.grouped_by_five(df), last=last)
    return sorted(tuple(-99 if v is None else v for v in r) for r in out.collect())


def test_given_conversations_sql(spark):
    out = QUERIES["op12_prefix_trie"](spark, D)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{D}/conversations.parquet')")
    rel = con.sql(SQL["op12_prefix_trie"])
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, rel.fetchall()))
    assert list(rel.columns) == out.columns
    assert [str(t).lower() for t in rel.types] == [t.replace("string", "varchar") for _, t in out.dtypes]


def made(seed=1, n=260):
    """Few distinct turns, so that prefixes are shared; one long conversation; copies of it."""
    rnd = random.Random(seed)
    data = []
    for c in range(-7, n):
        for t in range(rnd.randrange(0, 12)):
            data.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["hi", "héllo", "", "ok " * 3])))
    for c in (400, 401, 402, 403, 404, 1001, 1 << 40):
        data += [(c, t, "user", f"turn {t % 7}") for t in range(300)]
    rnd.shuffle(data)
    return data


@pytest.mark.parametrize("last", [T.LAST, 5])
def test_made_conversations(spark, last):
    data = made()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got, want = fast(df, last), slow(data)
    assert got == want


def test_odd_rows(spark):
    data = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, "first"), (2, 3, "user", None), (2, 3, None, "x"), (2, 3, None, None),
            (None, 1, "user", "lost"), (None, None, None, None), (8, 1, "user", "long " * 50_000), (9, 1, "user", "long " * 50_000),
            (3, 0, "ab", "c"), (4, 0, "a", "bc"), (10, 5, "user", "z"), (13, 5, "user", "z"), (-3, 1, "user", "q"), (0, 1, "user", "q")]
    df = spark.createDataFrame(data, SCHEMA).withColumn("m", F.lit("clash")).withColumn("depth", F.lit(0)).withColumn("part", F.lit(None))
    assert fast(df) == slow(data)


def test_empty(spark):
    assert fast(spark.createDataFrame([], SCHEMA)) == []
    assert fast(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


def test_chains():
    """Pointer doubling against walking, on a list of which some elements are missing."""
    rnd = random.Random(2)
    order = rnd.sample(range(10_000), 500)
    weight = {x: rnd.randrange(9) for x in order}
    here = sorted(rnd.sample(order, 350))
    succ = dict(zip(order, [*order[1:], -1]))
    head, (before,), ends = T.chains(np.array(here), np.array([succ[x] for x in here]), [np.array([weight[x] for x in here])])
    pred = {b: a for a, b in zip(order, order[1:])}
    for i, x in enumerate(here):
        y, w = x, 0
        while pred.get(y) in set(here):
            y = pred[y]
            w += weight[y]
        assert here[head[i]] == y and before[i] == w and ends[i] == (succ[x] not in set(here))
