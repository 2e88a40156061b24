"""Each query over its whole table: a row per document, page or conversation, and the columns
that its contract names, with their types."""

import pytest

from revisit.llm.catalog import QUERIES

D = "/root/testdata/sf0.001"
L, S, B, F8, I = "bigint", "string", "boolean", "double", "int"
CONTRACT = {
    "op1_ngram_jaccard": ("documents", {"doc_id": L, "n_shingles": L, "component_id": L}),
    "op2_hilbert_shards": ("documents", {"doc_id": L, "size": L, "text_crc32": L, "law": S, "shard": I, "slot": L, "grown_shard": I}),
    "op3_html_crf": ("pages", {"page_id": L, "url": S, "text": S, "n_chars": L}),
    "op4_sentencepiece": ("documents", {"doc_id": L, "n_tokens": L, "ids_sha256": S, "decoded_sha256": S}),
    "op5_warc": ("pages", {"page_id": L, "payload_bytes": L, "payload_digest": S, "record_type": S, "refers_to": L}),
    "op6_templates": (None, {"doc_id": L, "item_id": L}),
    "op7_chat_format": ("conversations", {"conv_id": L, "n_turns": L, "turns_sha256": S, "loss_chars": L, "loss_sha256": S, "formatted_chars": L}),
    "op8_robust_outliers": ("documents", {"doc_id": L, "n_words": L, "word_chars": L, "n_symbols": L, "n_dup_lines": L, "n_repeat_words": L,
                                          "base_failed": B, "kept": B}),
    "op9_licences": ("documents", {"doc_id": L, "n_words": L, "n_base": L, "first_word": L, "last_word": L, "base_labels": S, "labels": S, "score": F8}),
    "op10_kneser_ney": ("documents", {"doc_id": L, "held_out": B, "n_tokens": L, "n_known": L, "train_tokens": L, "base_score": F8, "score": F8}),
    "op11_phrases": (None, {"lang": S, "rank": L, "phrase": S, "a": L, "l": L, "r": L, "n": L, "score": L}),
    "op12_prefix_trie": (None, {"conv_id": L, "depth": L, "parent_conv_id": L, "n_convs": L, "n_children": L, "n_leaves": L,
                                "saved_tokens": L, "ends_sha256": S}),
    "op13_simhash_trie": ("documents", {"doc_id": L, "fingerprint": S, "component_id": L}),
}


def test_all_are_here():
    assert set(QUERIES) == set(CONTRACT)


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(spark, name):
    table, columns = CONTRACT[name]
    out = QUERIES[name](spark, D)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    rows = out.collect()
    key = next(iter(columns))
    if table:
        source = spark.read.parquet(f"{D}/{table}.parquet")
        want = [r[0] for r in (source.select(key).distinct() if table == "conversations" else source.select(key)).collect()]
        assert sorted(r[0] if key == out.columns[0] else r[key] for r in rows) == sorted(want + [-1] * (table == "conversations"))
    else:
        assert rows


@pytest.mark.parametrize("name", ["op2_hilbert_shards", "op7_chat_format", "op8_robust_outliers"])
def test_native_plans_hold_no_python(spark, name):
    out = QUERIES[name](spark, D)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
