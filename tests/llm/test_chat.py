import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revisit.llm import catalog, chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv])
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(),
                     len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
            for r in chat.digest_columns(chat.format_conversations(df)).collect()}


def test_matches_duckdb(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(catalog.SQL["op7_chat_format"])
    df = catalog.op7_chat_format(spark, d).select(*want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_nulls_ties_and_repeats(rows):
    data = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "user", "q"), (None, 1, "assistant", "a"),
            (2, 0, "assistant", ""), (3, 5, "ro\nle\\n", "<|im_end|>\n\\0 \\n <\\|"), (3, 5, "assistant", "é漢😀")]
    assert digests(rows(data, SCHEMA)) == brute(data)


def test_empty_and_clashing_columns(rows):
    assert digests(rows([], SCHEMA)) == {}
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    wide = rows(data, SCHEMA).withColumn("turns", F.lit(1)).withColumn("segments", F.lit("x")).withColumn("formatted", F.lit(2))
    assert digests(wide) == brute(data)


def test_machine(rows):
    data = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "user", "v"),
            (3, 0, "user", "u"), (4, 0, "tool", "t")]
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_conversations(rows(data, SCHEMA)).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, None), 4: (False, 0)}


def test_segments_are_the_formatted_text(rows):
    r = chat.format_conversations(rows([(1, 0, "user", "a"), (1, 1, "assistant", "b")], SCHEMA)).first()
    assert "".join(s.text for s in r.segments) == r.formatted
    assert [s.text for s in r.segments if s.loss] == ["b"]


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet="<|\\im_endstart>0n\né", max_size=14), min_size=1, max_size=20))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("b"), chat.escape(F.col("t")).alias("e"),
                    chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect()
    assert all(r.t == r.b == r.r and "<|" not in r.e for r in got)
