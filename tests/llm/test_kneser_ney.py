import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from revisit.llm import kneser_ney as kn

SCHEMA = "doc_id long, text string"


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


class Reference:
    """The same model with dictionaries."""

    def __init__(self, data):
        train = [(t or "").encode().lower().split() for i, t in data if not held(i)]
        self.uni = Counter(x for w in train for x in [*w, " end"])
        self.bi = Counter(p for w in train for p in zip([" start", *w], [*w, " end"]))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.ch, self.nh, self.cont = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
        for (h, w), c in self.bi.items():
            self.ch[h] += c
            self.nh[h][min(c, 3) - 1] += 1
            self.cont[w] += 1
        cc, kc = Counter(self.bi.values()), Counter(self.cont.values())
        self.hi = kn.discounts(*[cc[i] for i in (1, 2, 3, 4)])
        self.lo = kn.discounts(*[kc[i] for i in (1, 2, 3, 4)])
        self.free = sum(self.lo[min(c, 3)] for c in self.cont.values()) / len(self.bi) if self.bi else 1.0

    def lower(self, w):
        c = self.cont[w]
        return max(c - self.lo[min(c, 3)], 0) / max(len(self.bi), 1) + self.free / (self.v + 1)

    def p(self, h, w):
        if not self.ch[h]:
            return self.lower(w)
        c = self.bi[(h, w)]
        return (max(c - self.hi[min(c, 3)], 0) + sum(self.hi[i + 1] * self.nh[h][i] for i in range(3)) * self.lower(w)) / self.ch[h]

    def row(self, i, text):
        words = (text or "").encode().lower().split()
        seq = [*words, " end"]
        return (held(i), len(seq), sum(x in self.uni for x in seq), self.n,
                sum(math.log10((self.uni[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in seq),
                sum(math.log10(self.p(h, w)) for h, w in zip([" start", *words], seq)))


def check(df, data):
    ref = Reference(data)
    got = sorted(kn.score(df, kn.fit(df)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.score))
    want = sorted(((i, *ref.row(i, t)) for i, t in data), key=lambda r: (r[0] is not None, r[0] or 0, r[6]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9) and g.score == pytest.approx(w[6], rel=1e-9)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_frequent_histories_are_spread(spark, monkeypatch):
    monkeypatch.setattr(kn, "LOOK_SHARE", 0.01)
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(("the", "the", "of", f"w{rng.randrange(50)}")) for _ in range(rng.randrange(300)))) for i in range(60)]
    check(spark.createDataFrame(data, SCHEMA).repartition(3), data)


def test_frequent_histories_of_later_rows(spark, monkeypatch):
    """Counts cover all training texts, not the first ones; one mapped file at a time is enough."""
    monkeypatch.setattr(kn, "MOST_OPEN", 1)
    monkeypatch.setattr(kn, "LOOK_SHARE", 0.01)
    data = [(i, " ".join(f"w{i}x{k}" for k in range(5))) for i in range(2500)]
    data += [(i, "late word " * 60) for i in range(2500, 2700)]
    df = spark.createDataFrame(data, SCHEMA).repartitionByRange(6, "doc_id")
    hot = set(kn.frequent(df).tolist())
    assert {kn.xxhash.xxh64_intdigest(w) for w in ("late", "word")} <= hot and len(hot) <= 2 / kn.LOOK_SHARE
    check(df, data)


def test_odd_rows(rows):
    data = [(1, None), (2, ""), (2, ""), (None, "a b"), (None, "a b"), (3, "A  b\n\tc"), (4, "é É x\x1cy"), (5, "zz " * 9000)]
    check(rows(data, SCHEMA).withColumn("score", F.lit(1)).withColumn("words", F.lit("w")), data)


def test_no_training_text(rows):
    only_held = [(i, "a b") for i in range(40) if held(i)]
    check(rows(only_held, SCHEMA), only_held)
    empty = rows([], SCHEMA)
    assert kn.score(empty, kn.fit(empty)).collect() == []


def test_probabilities_sum_to_one():
    data = [(i, "the cat sat on the mat the cat ran " * (i % 3 + 1)) for i in range(20)]
    ref = Reference(data)
    for h in ("the", "cat", " start", "never"):
        h = h.encode() if h[0] != " " else h
        assert sum(ref.p(h, w) for w in ref.uni) + ref.p(h, "unknown") == pytest.approx(1)


def test_held_out_text_is_better_than_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = kn.score(docs, kn.fit(docs)).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_counts_beyond_32_bits(tmp_path):
    """A pair and its history, counted more often than 32 bits hold, keep their counts."""
    import numpy as np
    import pyarrow as pa
    h, w = np.array([kn.START + np.uint64(1)], np.uint64), np.array([7], np.uint64)
    many = 5_000_000_000
    block = lambda c: np.array([1, 1], "<u4").tobytes() + h.tobytes() + kn._narrow(np.array([1])) + kn._narrow(np.array([c])) + kn._pack48(w)
    group = lambda payloads: pa.table({"bucket": pa.array([0] * len(payloads), pa.int64()), "payload": pa.array(payloads, pa.binary())})
    sent = kn._merge(1, str(tmp_path))(group([block(many), block(3)]))
    totals = kn._words(str(tmp_path))(sent).to_pylist()[0]
    assert totals["tokens"] == many + 3
    assert kn._open(f"{tmp_path}/pairs-0")[1].tolist() == [[many + 3]]
    assert kn._open(f"{tmp_path}/words-0")[1].tolist() == [[many + 3, 0, 0, 1, 0]]


def test_missing_files_are_an_error(spark, rows):
    """A model whose files a task can't see does not score as if it had counted nothing."""
    docs = rows([(i, f"a b c d{i % 5}") for i in range(60)], "doc_id long, text string")
    model = kn.fit(docs)
    assert kn.score(docs, model).count() == 60
    with pytest.raises(Exception, match="No such file"):
        kn.score(docs, {**model, "folder": model["folder"] + "-elsewhere"}).collect()
