import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from revisit.llm import phrases as P
from revisit.llm.catalog import QUERIES, SQL

SCHEMA = "lang string, text string"
D = "/root/testdata/sf0.01"


def slow(data, least=30, longest=4, top=2000):
    f, n = Counter(), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    cand = {k: v for k, v in f.items() if len(k[1]) > 1}
    hidden = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= 80 * cand[lang, w[i:i + k]]:
                    hidden.add((lang, w[i:i + k]))
    rows = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in hidden:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            phrase = " ".join(w)
            rows.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, i + 1, r[3], -r[1], r[4], r[5], n[lang], -r[0]) for lang, v in rows.items() for i, r in enumerate(sorted(v)[:top])]


def test_given_documents_sql(spark):
    out = QUERIES["op11_phrases"](spark, D)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{D}/documents.parquet')")
    rel = con.sql(SQL["op11_phrases"])
    rows = rel.fetchall()
    assert rows and sorted(map(tuple, out.collect())) == sorted(rows)
    assert list(rel.columns) == out.columns
    assert [str(t).lower() for t in rel.types] == [t.replace("string", "varchar") for _, t in out.dtypes]


def made(seed=0, n=400):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "x" * 70, "x" * 71, "Aa", "aA", "\x00", " ", "b'c", "0"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = ["new york city hall", "New\tYork  City", "et cetera. et cetera", "a a a a a a"]
    data = []
    for _ in range(n):
        words = rnd.choices(vocabulary, weights, k=rnd.randrange(40))
        words += rnd.choices(fixed, k=rnd.randrange(3))
        rnd.shuffle(words)
        data.append((rnd.choice(["en", "en", "fr", None, "und", "é"]), "".join(w + rnd.choice([" "] * 9 + ["  ", ", ", "\n", "\t", "?", "\x0b"]) for w in words)))
    return data


@pytest.mark.parametrize("how", [{}, {"shards": 1, "least": 3}, {"shards": 3, "slots": 64, "least": 9}])
def test_made_documents(spark, monkeypatch, how):
    """Also with so few slots that nearly every phrase shares one, and in many small blocks."""
    monkeypatch.setattr(P, "PART", 1500)
    data = made()
    got = P.collocations(spark.createDataFrame(data, SCHEMA).repartition(3), **how).collect()
    assert sorted(map(tuple, got)) == sorted(slow(data, how.get("least", 30)))


def test_top_and_ties(spark):
    data = made(4)
    got = P.collocations(spark.createDataFrame(data, SCHEMA), least=10, longest=3, top=7, shards=2).collect()
    assert sorted(map(tuple, got)) == sorted(slow(data, 10, 3, 7))


def test_odd_rows(spark):
    data = [("en", None), ("en", ""), (None, "a b " * 40), (None, "a b " * 40), ("und", "a b"), ("en", "z" * 300_000), ("fr", ". , ;\n"), ("de", "q r s " * 30_000)]
    df = spark.createDataFrame(data, SCHEMA).withColumns({"shard": F.lit("clash"), "words": F.lit(1), "n": F.lit(None), "phrase": F.lit("x")})
    assert sorted(map(tuple, P.collocations(df).collect())) == sorted(slow(data))


def test_empty(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_products(spark):
    """2000000 * a passes 64 bits."""
    big = 1 << 60
    found = spark.createDataFrame([("en", 0, "", 3 * big), ("en", 1, "a", big + 1), ("en", 1, "b", big + 2), ("en", 2, "a b", big)],
                                  "lang string, words tinyint, phrase string, n long")
    (row,) = P.best(found).collect()
    assert row.score == 2000000 * big // (2 * big + 3) and (row.l, row.r, row.a) == (big + 1, big + 2, big)


def test_activation_by_subphrases():
    """A phrase is counted from the scan in which the later of its two subphrases is reached."""
    block = P.Block([b"en"], [b"p q r, p q"])
    tables = [np.full(1 << 12, P.NEVER, np.uint8) for _ in range(3)]
    slot = lambda h: int(h) & (1 << 12) - 1
    assert [len(at) for _, at, _, _ in P.grow(block, tables, 4, 9)] == [5, 0]
    for word, scan in ((0, 1), (1, 3), (2, 2)):
        tables[0][slot(block.first[word])] = scan
    assert [(length, at.tolist(), since.tolist()) for length, at, _, since in P.grow(block, tables, 4, 2)][1][1] == []
    length, at, keys, since = list(P.grow(block, tables, 4, 3))[1]
    assert at.tolist() == [0, 1, 3] and since.tolist() == [3, 3, 3] and keys[0] == keys[2]


def test_activation_not_before_subphrases():
    """A slot that another phrase has taken early activates no longer phrase before its
    subphrases are counted: its cycle would miss a shard."""
    block = P.Block([b"en"], [b"p q r"])
    tables = [np.full(1 << 12, P.NEVER, np.uint8) for _ in range(3)]
    slot = lambda h: int(h) & (1 << 12) - 1
    for word, scan in ((0, 3), (1, 1), (2, 1)):
        tables[0][slot(block.first[word])] = scan
    for key in list(P.grow(block, tables, 4, 9))[1][2]:
        tables[1][slot(key)] = 2
    length, at, _, since = list(P.grow(block, tables, 4, 9))[2]
    assert (length, at.tolist(), since.tolist()) == (3, [0], [3])


def test_whole_cycles_with_shared_slots():
    """Whatever scans the slots were taken in, all places of a phrase are found in every scan of its cycle."""
    rnd = np.random.default_rng(3)
    block = P.Block([b"en"], [" ".join(f"w{x}" for x in rnd.zipf(1.4, 3000) % 40).encode()])
    tables = [rnd.choice(np.array([1, 2, 3, 4, 5, P.NEVER], np.uint8), 256) for _ in range(3)]
    places = {}
    for now in range(12):
        for length, at, _, since in P.grow(block, tables, 4, now):
            for a, s in zip(at.tolist(), since.tolist()):
                places.setdefault((length, a, s), set()).add(now)
    assert len({length for length, _, _ in places}) == 4
    assert all(scans == set(range(s, 12)) for (_, _, s), scans in places.items())


def test_shared_keys(spark, monkeypatch):
    """Phrases that share what travels of their hash last until the latest one's cycle ends."""
    keys, since, n = P._summed(np.array([7, 3, 7, 7], np.uint64), np.array([1, 4, 5, 2], np.uint8), np.array([1, 2, 3, 4]))
    assert (keys.tolist(), since.tolist(), n.tolist()) == ([3, 7], [4, 5], [2, 8])
    monkeypatch.setattr(P, "KEY", np.uint64(255))
    monkeypatch.setattr(P, "PART", 1500)
    data = made(5)
    got = P.collocations(spark.createDataFrame(data, SCHEMA).repartition(3), least=9, slots=256).collect()
    assert sorted(map(tuple, got)) == sorted(slow(data, 9))


def test_disk(spark):
    """Tables of counts that are replaced are deleted; phrases travel many to a row."""
    from revisit.llm import shared
    before = shared.named()
    words = [f"w{i} x{i % 7} y{i % 5} z{i % 3}" for i in range(400)] * 30
    got = P.counts(spark.createDataFrame([("en", " ".join(words))], SCHEMA), least=30)
    assert sum("/counts-" in path for path in shared._MADE[before:]) == 1
    assert got.filter("words > 0").count() > 1000
    tables = spark.sparkContext.broadcast([np.full(1 << 16, 1, np.uint8)] * 4)
    rows = spark.createDataFrame([("en", " ".join(words))], SCHEMA)
    plan = P.named(rows, tables, 4, 1, 1)._jdf.queryExecution().analyzed().toString()
    assert "phrases" in plan and P.named(rows, tables, 4, 1, 1).filter("words = 1").count() == 415
