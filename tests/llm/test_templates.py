import random

import pytest
from pyspark.sql import functions as F

from revisit.llm import templates

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def found(docs, items, **more):
    return {(r.doc_id, r.item_id): r for r in templates.contaminated(docs, items, **more).collect()}


def test_given_documents(spark):
    """Exactly the documents that hold an item's words, whatever their case and marks."""
    d = "/root/testdata/sf0.1"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    plain = lambda t: " ".join(w for w in ((x.strip(templates._ENDS) or x).decode().lower() for x in (t or "").encode().split()))
    want = set()
    texts = [(r.doc_id, f" {plain(r.text)} ") for r in docs.collect()]
    for item in items.collect():
        words = plain(item.text)
        want |= {(i, item.item_id) for i, t in texts if f" {words} " in t}
    assert set(found(docs, items)) == want and len(want) > 100


QUESTION = "Last week Ann gave 8 apples to Sue and 2 kg of pears to Ann before she sold 12 more to Bob for lunch."


def test_other_numbers_names_and_units(rows):
    items = rows([(1, QUESTION)], ITEM)
    same = "Last week Tom gave 30 apples to Eve and 7 lb of pears to Tom before she sold 41 more to Max for lunch."
    mixed = "Last week Tom gave 30 apples to Eve and 7 lb of pears to Max before she sold 41 more to Max for lunch."
    merged = "Last week Tom gave 30 apples to Tom and 7 lb of pears to Tom before she sold 41 more to Tom for lunch."
    docs = rows([(1, f"Some words first. {same} And some after."), (2, mixed), (3, merged), (4, QUESTION.upper()), (5, QUESTION),
                 (6, "Last week it rained and 3 of us gave up.")], DOC)
    got = found(docs, items)
    assert set(got) == {(1, 1), (4, 1), (5, 1)} and got[1, 1].n_replaced == 7 and got[5, 1].n_replaced == 0


def test_edited_passage(rows):
    rng = random.Random(1)
    words = [f"w{rng.randrange(9000)}x" for _ in range(40)]
    edited = [*words]
    for i in (9, 25):
        edited[i] = "other"
    part = words[:6] + ["something", "else"] * 20
    got = found(rows([(1, " ".join(edited)), (2, " ".join(part)), (3, " ".join(words[:30]))], DOC), rows([(5, " ".join(words))], ITEM))
    assert set(got) == {(1, 5), (3, 5)}


@pytest.mark.parametrize("block", [templates.BLOCK, 7])
def test_blocks_of_templates_give_the_same(rows, block):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(300)}x" for _ in range(30)) for _ in range(12)]
    items = rows(list(enumerate(texts)), ITEM)
    docs = rows([(i, f"start here {texts[i % 12]} end there" if i % 3 else "clean words only here today my friend") for i in range(40)], DOC)
    assert set(found(docs, items, block=block)) == {(i, i % 12) for i in range(40) if i % 3}


def test_odd_rows(rows):
    items = rows([(1, None), (2, ""), (3, "too short here"), (4, "five words are one template"), (5, "five words are one template"),
                  (None, "six words are also one template"), (6, "1 2 3 4 5 6 7 8")], ITEM)
    docs = rows([(1, "five words are one template"), (1, "five words are one template"), (2, None), (3, ""), (None, "five words are one template"),
                 (4, "six words are also one template"), (5, "1 2 3 4 5 6 7 8"), (6, "x " * 20_000 + "Five words, are one template!")], DOC)
    docs = docs.withColumn("item_id", F.lit(1)).withColumn("slots", F.lit("x")).withColumn("at", F.lit(0))
    items = items.withColumn("doc_id", F.lit(9)).withColumn("hash", F.lit(9))
    assert set(found(docs, items)) == {(1, 4), (1, 5), (5, 6), (6, 4), (6, 5)}
    assert found(docs.limit(0), items) == {} and found(docs, items.limit(0)) == {}


def test_one_edited_value_leaves_the_other_windows(rows):
    """Equal numbers of the item, one of them edited: the rest is word for word."""
    text = "Every morning the baker fills 5 baskets with rolls before the shop opens and later that day a driver brings 5 crates of pears to the old market hall."
    items = rows([(1, text)], ITEM)
    docs = rows([(1, text.replace("5 crates", "6 crates")), (2, text), (3, text.replace("5", "6"))], DOC)
    got = found(docs, items)
    assert set(got) == {(1, 1), (2, 1), (3, 1)}
    assert [got[i, 1].n_replaced for i in (1, 2, 3)] == [0, 0, 1] and got[1, 1].n_matched < got[2, 1].n_matched


def test_verbatim_copies_of_any_item_in_any_case(rows):
    """Every item of three words or more that stands in a document, against plain search."""
    texts = ["what is two plus", "is it so", "1 2 3 4 5 6 7 8", "12 May 1987 and 4 kg", "Ann Bob Cid Dan Eve Fay Gus Hal Ida",
             "On Monday Ann Lee met Bob Ray at Oak Hill near Elm Lake before Sue Fox and Max Orr came from Rye Bay with Ida Kay."]
    items = rows(list(enumerate(texts)), ITEM)
    change = [str, str.upper, str.lower, str.title]
    docs = [(10 * i + k, f"we saw that {f(t)} was there") for i, t in enumerate(texts) for k, f in enumerate(change)]
    docs += [(900, "what is two minus plus"), (901, "1 2 3 9 4 5 6 7"), (902, "is that so it is")]
    want = {(d, i) for d, t in docs for i, x in enumerate(texts) if f" {x.lower().strip('.')} " in f" {t.lower().replace('. ', ' ')} "}
    assert set(found(rows(docs, DOC), items)) == want and len(want) == 4 * len(texts)


def test_items_of_one_or_two_words_are_whole_documents(rows):
    items = rows([(1, "Yes"), (2, "no way")], ITEM)
    docs = rows([(1, "yes"), (2, "yes it is"), (3, "No way!"), (4, "there is no way out"), (5, "no")], DOC)
    assert set(found(docs, items)) == {(1, 1), (3, 2)}
