import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from revisit.llm import mcd

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def counts(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            for r in mcd.judge(df).collect()}


def test_counts_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert counts(docs) == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_counts_on_odd_texts(rows):
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 5, "x\n\nx\n \nx\r\n", "é漢 # * $ % & | < >\n" * 30,
             "\x0b\x0c a\x1cb c", "w " * 3000, " ".join(map(str, range(400))) + " 0 1 2 3 4 5 6 7 8"]
    data = [(i, t, None, None) for i, t in enumerate(texts)]
    df = rows(data, SCHEMA).withColumn("kept", F.lit(1)).withColumn("grp", F.lit("g")).withColumn("x0", F.lit(2))
    assert counts(df) == {i: brute(t) for i, t in enumerate(texts)}
    assert mcd.judge(rows([], SCHEMA)).collect() == []


def reference_estimate(x):
    """The concentration steps in numpy, with the same histogram rule."""
    def near(d2):
        b = np.clip(np.floor(np.log(np.maximum(d2, 1e-9)) / mcd.BIN_LOG) + mcd.BINS // 2, 0, mcd.BINS - 1)
        order = np.unique(b)
        cut = max(v for v in order if np.sum(b < v) < len(b) * mcd.SHARE)
        return b <= cut

    floors = np.array(mcd.FLOORS) ** 2
    keep = near((x ** 2 / floors).sum(1))
    for _ in range(mcd.STEPS + 1):
        m = x[keep].mean(0)
        cov = ((x[keep][:, :, None] * x[keep][:, None, :]).mean(0) - np.outer(m, m)) * mcd.CONSISTENCY + np.diag(floors)
        d2 = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(cov), x - m)
        keep = near(d2)
    return d2


def test_distances_match_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang = 'en' and source = 'src0'")
    got = [r for r in mcd.judge(docs).collect() if not r.base_failed]
    lines = {r.doc_id: sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (r.text or "").split("\n")) for r in docs.collect()}
    n = np.array([r.n_words for r in got])
    mean = np.array([r.word_chars for r in got]) / n
    hist = np.floor(mean / 0.01)
    median = min(v for v in np.unique(hist) if np.sum(hist <= v) >= np.ceil(len(n) * 0.5))
    x = np.column_stack([(mean - (median + 1) * 0.01) * np.sqrt(n / (n + mcd.DAMP_WORDS)),
                         np.sqrt([r.n_symbols / r.n_words for r in got]),
                         [r.n_dup_lines / max(lines[r.doc_id], 1) for r in got], [r.n_repeat_words / r.n_words for r in got]])
    want = reference_estimate(x)
    np.testing.assert_allclose([r.robust_d2 for r in got], want, rtol=1e-6, atol=1e-9)
    assert [r.kept for r in got] == list(want <= mcd.CUT)


def test_verdicts_against_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    judged = mcd.judge(spark.read.parquet(f"{d}/documents.parquet")).filter("not base_failed").join(labels, "doc_id")
    good, bad = judged.filter("quality = 1"), judged.filter("quality = 0")
    assert good.filter("not kept").count() <= 0.002 * good.count()
    assert bad.filter("not kept").count() >= 0.9 * bad.count()


def test_small_groups_are_pooled(rows):
    text = " ".join(f"word{i}" for i in range(40))
    data = [(i, text + f" {i}", "en", f"s{i % 7}") for i in range(140)] + [(999, text, "xx", "rare")]
    df = mcd.with_groups(mcd.text_counts(rows(data, SCHEMA)))
    got = {r.doc_id: r.grp for r in df.collect()}
    assert got[0] == '["en"]' and got[999] is None
    assert all(r.kept for r in mcd.judge(rows(data, SCHEMA)).collect())
