"""The semantic traps of SURVEY section 2.P, one test each."""

from pyspark.sql import types as T

from revisit.operators import counts, sequences
from revisit.schemas import SEQ_SCHEMA

SEG = ("seg_id bigint, user_id string, video_id string, local_start_time bigint, "
       "start_point double, end_point double, speed double")


def test_t1_nan_gap_is_null_and_never_splits(spark):
    rows = [(1, "u", "v", 0, 0.0, float("nan"), 1.0), (2, "u", "v", 10000, 0.0, 1.0, 1.0),
            (3, "u", "v", 20000, 0.0, 1.0, 1.0)]
    out = {r["seg_id"]: r for r in sequences.sessionize(spark.createDataFrame(rows, SEG)).collect()}
    assert out[1]["gap"] is None
    assert [out[i]["session_id"] for i in (1, 2, 3)] == [0, 0, 1]


def test_t4_id_map_null_keys_do_not_match(spark):
    rows = spark.createDataFrame([("u", None), ("u", "V_1")], "user_id string, video_id string")
    m = spark.createDataFrame([(None, "C0"), ("V_1", "C1")], "video_id string, ccid string")
    assert [r["ccid"] for r in counts.map_ids(rows, m).collect()] == ["C1"]


def test_t7_size_of_null_list_is_skipped(spark):
    data = [("u1", [{"video_id": "v", "segment": None}]),
            ("u2", [{"video_id": "v", "segment": [{"end_point": 1.0, "start_point": 0.0, "speed": 1.0,
                                                    "local_start_time": 1}]}])]
    seqs = sequences.explode_sequences(spark.createDataFrame(data, SEQ_SCHEMA))
    assert sequences.count_segments(seqs).collect()[0][0] == 1


def test_t9_null_times_sort_last(spark):
    rows = [(1, "u", "a", None, 0.0, 1.0, 1.0), (2, "u", "b", 5, 0.0, 1.0, 1.0), (3, "u", "a", 1, 0.0, 1.0, 1.0)]
    out = {r["seg_id"]: r["video_consecutive_id"]
           for r in sequences.sessionize(spark.createDataFrame(rows, SEG)).collect()}
    assert out == {3: 1, 2: 2, 1: 3}


def test_t10_grouping_drops_null_keys(spark):
    rows = spark.createDataFrame([("c", "u"), (None, "u"), ("c", None)], "ccid string, user_id string")
    got = counts.count_interactions(rows).collect()
    assert [(r["ccid"], r["user_id"], r["num_watched"]) for r in got] == [("c", "u", 1)]


def test_t12_ids_are_bigint(spark):
    rows = [(1, "u", "v", 0, 0.0, 1.0, 1.0)]
    s = sequences.sessionize(spark.createDataFrame(rows, SEG)).schema
    assert s["video_consecutive_id"].dataType == T.LongType()
    assert s["session_id"].dataType == T.LongType()


def test_t8_ties_broken_by_row_id(spark):
    rows = [(2, "u", "a", 5, 0.0, 1.0, 1.0), (1, "u", "b", 5, 0.0, 1.0, 1.0)]
    out = {r["seg_id"]: r["video_consecutive_id"]
           for r in sequences.sessionize(spark.createDataFrame(rows, SEG)).collect()}
    assert out == {1: 1, 2: 2}
