import re
import time

from pyspark.sql import functions as F

from revisit.llm import licences as lic

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in BASE.items() for i in range(len(words))
            if words[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def words_of(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def phrase(text, place):
    return " ".join(words_of(text)[place.word:place.word + place.words])


def places(text):
    words = words_of(text)
    return [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]


def check(df, data):
    got = {r.doc_id: r for r in lic.licences(df).collect()}
    assert len(got) == len(data)
    for i, text in data:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels)
        assert [p.word for p in r.places if p.label in BASE.values() and lic.BASE.get(phrase(text, p)) == p.label] == sorted(
            q for q, _ in places(text))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(rows):
    texts = [None, "", "...", "cc by nc by nc cc by nc", "CC-BY-NC\nunder THE\tMIT license", "unders the mit license", "ünder the mit licensé",
             "under the mit license" * 3, "x" * 100_000 + " cc by nc", "cc by\x00nc", "apache license version 2.0 apache license version 20"]
    data = list(enumerate(texts))
    check(rows(data, "doc_id long, text string").withColumn("labels", F.lit(1)).withColumn("score", F.lit("x")), data)
    assert lic.licences(rows([], "doc_id long, text string")).collect() == []
    assert [r.doc_id for r in lic.licences(rows([(None, "a"), (None, "a")], "doc_id long, text string")).collect()] == [None, None]


def test_expressions():
    post = lic.to_postfix
    assert post("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert post("(MIT OR Apache-2.0) AND BSD-3-Clause.") == ["mit", "apache-2.0", "or", "bsd-3-clause", "and"]
    assert post("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT") == ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "or"]
    assert post("((MIT))") == ["mit"] and post("MIT and then") == ["mit", "then", "and"] and post("MIT then") == ["mit"]
    assert post("") == post("AND MIT") == post("(MIT") == post(")") == []
    assert post("MIT AND (A OR") == ["mit"] and post("MIT )") == ["mit"]
    assert lic.evaluate(post("GPL-3.0-only OR MIT")) == (["gpl-3", "mit"], True)
    assert lic.evaluate(post("GPL-3.0-only AND MIT")) == (["gpl-3", "mit"], False)
    assert lic.evaluate(post("Apache-2.0 WITH LLVM-exception")) == (["apache-2"], True)


def test_tags():
    a = lic.automaton()
    r = lic.scan(b"# SPDX-License-Identifier: (GPL-3.0-or-later OR MIT)\nSPDX-License-Identifier: GPL-2.0-only", a)
    assert r[5] == "gpl-2,gpl-3,mit" and r[7] == ["gpl-3.0-or-later mit or", "gpl-2.0-only"] and r[8] is False


def test_no_label_from_prose():
    a = lic.automaton()
    for text in (b"License expression: see below", b"SPDX-License-Identifier: the file LICENSE", b"the license expression is parsed here"):
        assert lic.scan(text, a)[5] == "", text
    assert lic.scan(b"SPDX-License-Identifier: MIT and then", a)[7] == ["mit"]
    assert lic.scan(b"SPDX-License-Identifier: lgpl-2.1-only OR AGPL-3.0-or-later OR LicenseRef-mine", a)[5] == "agpl,lgpl,licenseref-mine"


def test_many_places():
    """Places are found in one pass, however many there are."""
    text = b"under the MIT license, cc by nc " * 50_000
    began = time.perf_counter()
    r = lic.scan(text, lic.automaton())
    assert r[:4] == (350_000, 100_000, 0, 349_997) and time.perf_counter() - began < 10
