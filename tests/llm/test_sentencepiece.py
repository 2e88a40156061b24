import hashlib
import random
import string
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from revisit.llm import sentencepiece_bpe as bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    rng = random.Random(1)
    fixed = [None, "", " ", "  ", "a", "\n", "\n\n\t a", "Hello  world  ", "a▁b", "▁", "▁▁ ▁", "é漢　字\x00ab ﬁ ²", "<s>hi</s><0x41>",
             "x\n y\n  z", "a" * 50, "ab" * 40, "        lots", "tab\tsep", "😀 ok ", "the" * 500, " a\n", "\na", "\r\n \r\n", "the​the"]
    alphabet = ["a", "b", " ", " ", "\n", "▁", "é", "the", "ing", ".", "漢", "!", "tion", "  ", "<0x0A>", "\t"]
    made = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(1500)]
    long_ = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6000))
    return [*fixed, *made, long_, " ".join(made)]


def check(out, texts, library):
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        ids = library.encode(t or "")
        assert got[i].ids == ids, t
        assert got[i].decoded == library.decode(ids)


def test_given_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(bpe.encode_decode(docs, PATH), [(r.doc_id, r.text) for r in docs.collect()], library)


def test_odd_texts(rows, library):
    texts = list(enumerate(odd_texts()))
    df = rows(texts, SCHEMA).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    check(bpe.encode_decode(df, PATH), texts, library)


def test_words_forgotten_between_chunks(rows, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    monkeypatch.setattr(bpe, "CHUNK", 4)
    texts = list(enumerate(odd_texts()[:200]))
    check(bpe.encode_decode(rows(texts, SCHEMA).coalesce(1), PATH), texts, library)


def test_digests_and_empty_table(rows, library):
    df = rows([(1, "Hello you"), (None, None)], SCHEMA)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_columns(bpe.encode_decode(df, PATH)).collect()}
    ids = library.encode("Hello you")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (len(ids), sha(",".join(map(str, ids))), sha("Hello you")), None: (0, sha(""), sha(""))}
    assert bpe.encode_decode(rows([], SCHEMA), PATH).collect() == []


def test_merges_one_by_one_and_together_agree():
    """Pieces that are merged together give what merging one at a time gives."""
    v = bpe.load(PATH)
    rng = random.Random(4)
    words = ["▁" + "".join(rng.choices("aaabnt", k=rng.randrange(1, 40))) for _ in range(400)]
    together = bpe.merge_rounds(words, v)
    v.one_by_one[:] = True
    alone = bpe.merge_rounds(words, v)
    assert all(np.array_equal(a, b) for a, b in zip(together, alone))


def ids_of(text, v):
    words = bpe.WordIds(v)
    cut = np.array(words.cut(text), np.int64)
    words.settle()
    return bpe.spread(words.flat, words.start[cut], words.length[cut]).tolist()


UNBROKEN = {"spaces": lambda r, n: " " * n, "spaces before a word": lambda r, n: "x" + " " * n + "the end",
            "letters": lambda r, n: "".join(r.choices(string.ascii_lowercase, k=n)),
            "base64": lambda r, n: "".join(r.choices(string.ascii_letters + string.digits + "+/", k=n)),
            "one letter": lambda r, n: "a" * n, "dashes": lambda r, n: "-" * n, "lines": lambda r, n: "\n" * n,
            "frequent letters": lambda r, n: "".join(r.choices("etaoinshr", k=n))}


@pytest.mark.parametrize("kind", UNBROKEN)
def test_unbroken_text_takes_time_in_proportion(kind, library):
    """A million characters without a break: ids of the library, in seconds."""
    v = bpe.load(PATH)
    text = UNBROKEN[kind](random.Random(5), 1_000_000)
    start = time.monotonic()
    got = ids_of(text, v)
    assert time.monotonic() - start < 30  # 1 to 3 s on an idle machine
    assert got == library.encode(text)


def test_runs_of_one_character(library):
    """Runs of every length around the cuts, with words and other runs beside them."""
    v = bpe.load(PATH)
    rng = random.Random(6)
    chars = ["▁", " ", "a", "-", "=", "\t", "0", "the", "é", "\n"]
    for n in [*range(120, 230), 500, 1001]:
        assert ids_of(" " * n, v) == library.encode(" " * n)
    for _ in range(300):
        text = "".join(rng.choice(chars) * rng.choice([1, 1, 2, 5, 130, 180, 333]) for _ in range(rng.randrange(1, 8)))
        assert ids_of(text, v) == library.encode(text), text
