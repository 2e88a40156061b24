import random

import brute
from revisit.operators import intervals, sequences


def test_sweep_equals_pair_count(spark):
    rnd = random.Random(7)
    rows = []
    sid = 0
    for sess in range(60):
        n = rnd.randrange(1, 9)
        for _ in range(n):
            s = float(rnd.choice([0, 0, 3, 5, 10, 12.5, 20]))
            e = s + rnd.choice([-2.0, 4.99, 5.0, 5.01, 10.0, 30.0])
            if rnd.random() < 0.05:
                s = None
            rows.append((f"u{sess % 5}", sess // 5, sess % 3, sid, s, e))
            sid += 1
    df = spark.createDataFrame(rows, "user_id string, video_consecutive_id long, session_id long, "
                                     "seg_id long, start_point double, end_point double")
    sweep = {tuple(r[:3]): r[3] for r in intervals.repetition_counts(df).collect()}
    pairs = {tuple(r[:3]): r[3] for r in intervals.repetition_counts_pairs(df).collect()}
    assert sweep == pairs
    groups = {}
    for u, run, ses, _, s, e in rows:
        groups.setdefault((u, run, ses), []).append((s, e))
    assert sweep == {k: brute.rep_count(v) for k, v in groups.items()}


def test_overlap_exactly_threshold(spark):
    rows = [("u", 1, 0, 1, 0.0, 10.0), ("u", 1, 0, 2, 5.0, 20.0),   # overlap 5 -> counts
            ("u", 1, 1, 3, 0.0, 10.0), ("u", 1, 1, 4, 5.5, 20.0),   # overlap 4.5 -> no
            ("u", 1, 2, 5, 0.0, 30.0), ("u", 1, 2, 6, 10.0, 20.0), ("u", 1, 2, 7, 10.0, 20.0)]  # nested, equal
    df = spark.createDataFrame(rows, "user_id string, video_consecutive_id long, session_id long, "
                                     "seg_id long, start_point double, end_point double")
    got = {r[2]: r[3] for r in intervals.repetition_counts(df).collect()}
    assert got == {0: 1, 1: 0, 2: 3}


def test_coverage_is_union_length(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(200):
        s = rnd.uniform(0, 100)
        rows.append((f"u{i % 3}", f"v{i % 4}", i, s, s + rnd.uniform(-5, 20)))
    df = spark.createDataFrame(rows, "user_id string, video_id string, seg_id long, "
                                     "start_point double, end_point double")
    got = {(r[0], r[1]): r[2] for r in intervals.coverage(df).collect()}
    groups = {}
    for u, v, _, s, e in rows:
        groups.setdefault((u, v), []).append((s, e))
    for k, iv in groups.items():
        assert abs(got[k] - brute.union_length(iv)) < 1e-5




def test_coverage_fraction_with_video_length(spark):
    df = spark.createDataFrame([("u", "v", 1, 0.0, 10.0), ("u", "v", 2, 5.0, 20.0), ("u", "v", 3, 30.0, 40.0)],
                               "user_id string, video_id string, seg_id long, start_point double, end_point double")
    lengths = spark.createDataFrame([("v", 100.0)], "video_id string, length double")
    r = intervals.coverage(df, video_length=lengths).collect()[0]
    assert r["covered"] == 30.0 and r["fraction"] == 0.3


def test_seconds_to_interval(spark):
    import datetime
    from revisit.functions.columns import seconds_to_interval
    df = spark.createDataFrame([(86410.5,), (-17.25,)], "g double")
    got = [r[0] for r in df.select(seconds_to_interval("g")).collect()]
    assert got == [datetime.timedelta(days=1, seconds=10, microseconds=500000), datetime.timedelta(seconds=-17.25)]
