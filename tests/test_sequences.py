import random

from pyspark.sql import functions as F

import brute
from revisit.operators import scan, sequences
from revisit.schemas import SEQ_SCHEMA

SEG_SCHEMA = ("seg_id bigint, user_id string, video_id string, local_start_time bigint, "
              "start_point double, end_point double, speed double")


def _random_segments(n_users=6, n_rows=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    t = {u: 0 for u in range(n_users)}
    for i in range(n_rows):
        u = rnd.randrange(n_users)
        t[u] += rnd.choice([1, 5, 30, 600, 3599, 3600, 4000, 90000])
        s = float(rnd.randrange(0, 60))
        rows.append({"seg_id": i, "user_id": f"U{u}", "video_id": rnd.choice(["a", "b", None, "a", "a"]),
                     "local_start_time": t[u], "start_point": s,
                     "end_point": s + rnd.choice([-3.0, 2.0, 5.0, 10.0, 40.0]),
                     "speed": rnd.choice([1.0, 1.5, 2.0, 0.0])})
    return rows


def test_sessionize_matches_brute_force_across_chunks(spark):
    rows = _random_segments()
    df = spark.createDataFrame(rows, SEG_SCHEMA)
    expect = brute.sessions(rows, 3600)
    # many chunks, some, one per user; then heavy days split into time slices
    for bucket, target in ((7, None), (3600, None), (10**9, None), (10**9, 5), (86400, 3)):
        got = {r["seg_id"]: (r["video_consecutive_id"], r["gap"], r["session_id"])
               for r in sequences.sessionize(df, bucket_seconds=bucket, target_rows=target).collect()}
        assert got.keys() == expect.keys()
        for k, (run, gap, sess) in expect.items():
            g = got[k]
            assert g[0] == run and g[2] == sess, (k, g, (run, gap, sess))
            assert (g[1] is None and gap is None) or abs(g[1] - gap) < 1e-9


def test_session_thresholds_and_null_gap(spark):
    # gaps of 3599 (no split), 3600 (split), and a NULL last gap
    rows = [
        {"seg_id": 1, "user_id": "u", "video_id": "v", "local_start_time": 0, "start_point": 0.0,
         "end_point": 1.0, "speed": 1.0},
        {"seg_id": 2, "user_id": "u", "video_id": "v", "local_start_time": 3600, "start_point": 0.0,
         "end_point": 1.0, "speed": 1.0},
        {"seg_id": 3, "user_id": "u", "video_id": "v", "local_start_time": 7201, "start_point": 0.0,
         "end_point": 1.0, "speed": 1.0},
    ]
    out = {r["seg_id"]: r for r in sequences.sessionize(spark.createDataFrame(rows, SEG_SCHEMA)).collect()}
    assert [out[i]["gap"] for i in (1, 2, 3)] == [3599.0, 3600.0, None]
    assert [out[i]["session_id"] for i in (1, 2, 3)] == [0, 0, 1]


def test_null_video_starts_run_and_zero_speed_gives_null_gap(spark):
    rows = [
        {"seg_id": 1, "user_id": "u", "video_id": "v", "local_start_time": 0, "start_point": 0.0,
         "end_point": 10.0, "speed": 0.0},
        {"seg_id": 2, "user_id": "u", "video_id": "v", "local_start_time": 5, "start_point": 0.0,
         "end_point": 10.0, "speed": 1.0},
        {"seg_id": 3, "user_id": "u", "video_id": None, "local_start_time": 6, "start_point": 0.0,
         "end_point": 10.0, "speed": 1.0},
        {"seg_id": 4, "user_id": "u", "video_id": None, "local_start_time": 7, "start_point": 0.0,
         "end_point": 10.0, "speed": 1.0},
        {"seg_id": 5, "user_id": None, "video_id": "v", "local_start_time": 7, "start_point": 0.0,
         "end_point": 10.0, "speed": 1.0},
    ]
    out = {r["seg_id"]: r for r in sequences.sessionize(spark.createDataFrame(rows, SEG_SCHEMA)).collect()}
    assert 5 not in out  # NULL user drops out
    assert [out[i]["video_consecutive_id"] for i in (1, 2, 3, 4)] == [1, 1, 2, 3]
    assert out[1]["gap"] is None  # speed 0 -> NULL, no split
    assert out[1]["session_id"] == 0 and out[2]["session_id"] == 0


def test_seconds_component_mode(spark):
    from revisit.functions.columns import seconds_component
    df = spark.createDataFrame([(86410.0,), (-1.0,), (3600.5,)], "g double")
    assert [r[0] for r in df.select(seconds_component("g")).collect()] == [10, 86399, 3600]


def test_sessions_by_video_matches_brute_force(spark):
    rows = _random_segments(seed=3)
    for r in rows:
        r["local_end_time"] = r["local_start_time"] + (r["end_point"] - r["start_point"])
    df = spark.createDataFrame(rows, SEG_SCHEMA + ", local_end_time double").filter("video_id is not null")
    got = {r["seg_id"]: r for r in sequences.sessions_by_video(
        df, 3600, rows_per_chunk=5, modes={"session_id": "total", "sec": "seconds_component"}).collect()}
    groups = {}
    for r in rows:
        if r["video_id"] is not None:
            groups.setdefault((r["user_id"], r["video_id"]), []).append(r)
    for rs in groups.values():
        rs.sort(key=lambda r: r["seg_id"])
        s_tot = s_sec = 0
        for i, r in enumerate(rs):
            gap = rs[i + 1]["local_start_time"] - r["local_end_time"] if i + 1 < len(rs) else None
            g = got[r["seg_id"]]
            assert (g["gap"] is None and gap is None) or abs(g["gap"] - gap) < 1e-9
            assert g["session_id"] == s_tot and g["sec"] == s_sec
            if gap is not None:
                s_tot += gap >= 3600
                s_sec += (gap // 1) % 86400 >= 3600


def test_dedupe_matches_brute_force_and_is_idempotent(spark):
    rnd = random.Random(5)
    rows = [{"event_id": i, "user_id": rnd.randrange(4), "timestamp": rnd.randrange(0, 10**6),
             "item_id": rnd.choice(["l1", "l1", "l2", None])} for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, timestamp bigint, item_id string")
    once = sequences.dedupe_consecutive(df, bucket_width=10**9, target_rows=7)
    assert {r[0] for r in once.select("event_id").collect()} == brute.dedupe(rows)
    twice = sequences.dedupe_consecutive(once, bucket_width=50_000)
    kept = {r[0] for r in once.select("event_id").collect()}
    # a NULL item always lets the next row through, so dedupe is idempotent on non-NULL runs only
    assert {r[0] for r in twice.select("event_id").collect()} <= kept


def test_explode_empty_and_null_lists(spark):
    data = [("u1", [{"video_id": "v1", "segment": [{"end_point": 2.0, "start_point": 1.0, "speed": 1.0,
                                                     "local_start_time": 5}]}]),
            ("u2", []), ("u3", None)]
    df = spark.createDataFrame(data, SEQ_SCHEMA)
    seqs = sequences.explode_sequences(df)
    assert seqs.count() == 3  # empty and NULL lists keep one NULL row
    segs = sequences.explode_segments(seqs)
    assert segs.collect()[0]["start_point"] == 1.0 and segs.count() == 1
    assert sequences.count_segments(seqs).collect()[0][0] == 1


def test_duration_filter_inclusive(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0, 1.0), (2, 0.0, 4.999, 1.0), (3, 0.0, 10.0, 2.0)],
                               "seg_id long, start_point double, end_point double, speed double")
    d = sequences.with_durations(df)
    assert sorted(r[0] for r in sequences.filter_duration(d, 5.0).select("seg_id").collect()) == [1, 3]
    assert sorted(r[0] for r in sequences.filter_duration(d, 5.0, inclusive=False)
                  .select("seg_id").collect()) == []


def test_segment_index_dense_per_video(spark):
    rows = _random_segments(seed=9)
    df = spark.createDataFrame(rows, SEG_SCHEMA).filter("video_id is not null")
    out = sequences.segment_index(df, bucket_seconds=10**9, target_rows=4).groupBy("user_id", "video_id").agg(
        F.min("segment_idx").alias("lo"), F.max("segment_idx").alias("hi"), F.count("*").alias("n"))
    for r in out.collect():
        assert r["lo"] == 0 and r["hi"] == r["n"] - 1


def test_add_time_chunks_splits_heavy_buckets_monotonically(spark):
    from revisit.operators.scan import add_time_chunks
    rows = [("hot", t) for t in range(0, 1000)] + [("cold", t) for t in range(0, 1000, 100)] + [("hot", None)]
    df = spark.createDataFrame(rows, "user_id string, t long")
    out = add_time_chunks(df, ["user_id"], "t", 10_000, target_rows=100, out="c").collect()
    hot = sorted((r["t"], tuple(r["c"])) for r in out if r["user_id"] == "hot" and r["t"] is not None)
    chunks = [c for _, c in hot]
    assert chunks == sorted(chunks)  # monotone in time
    assert len(set(chunks)) == 10  # ceil(1000 / 100) slices of the one heavy bucket
    assert max(chunks.count(c) for c in set(chunks)) <= 100
    assert {tuple(r["c"]) for r in out if r["user_id"] == "cold"} == {(0, 0)}
    assert tuple([r["c"] for r in out if r["t"] is None][0]) > max(chunks)


def test_sessions_by_video_in_time_order(spark):
    rows = _random_segments(seed=13)
    for r in rows:
        r["local_end_time"] = r["local_start_time"] + (r["end_point"] - r["start_point"])
    df = spark.createDataFrame(rows, SEG_SCHEMA + ", local_end_time double").filter("video_id is not null")
    got = {r["seg_id"]: r for r in sequences.sessions_by_video(
        df, 3600, order=("local_start_time", "seg_id"), rows_per_chunk=5000).collect()}
    groups = {}
    for r in rows:
        if r["video_id"] is not None:
            groups.setdefault((r["user_id"], r["video_id"]), []).append(r)
    for rs in groups.values():
        rs.sort(key=lambda r: (r["local_start_time"], r["seg_id"]))
        sess = 0
        for i, r in enumerate(rs):
            gap = rs[i + 1]["local_start_time"] - r["local_end_time"] if i + 1 < len(rs) else None
            g = got[r["seg_id"]]
            assert (g["gap"] is None and gap is None) or abs(g["gap"] - gap) < 1e-9
            assert g["session_id"] == sess
            if gap is not None and gap >= 3600:
                sess += 1


def _plain_sessions(rows, thresh=3600):
    """(run, session) per seg_id by a loop over each user's rows in order."""
    out = {}
    for u in {r[1] for r in rows if r[1] is not None}:
        run = session = 0
        prev = None
        for r in sorted((r for r in rows if r[1] == u), key=lambda r: (r[3], r[0])):
            if prev is None or prev[2] != r[2]:
                run, session = run + 1, 0
            elif r[3] - (prev[3] + (prev[5] - prev[4]) / prev[6]) >= thresh:
                session += 1
            out[r[0]] = (run, session)
            prev = r
    return out


def _hot_rows():
    """One user with a third of all rows on one day, most of them at one instant, and one
    session with as many; the rest of the users are small."""
    rnd = random.Random(9)
    rows, n = [], 0
    def add(user, video, t):
        nonlocal n
        rows.append((n, user, video, t, float(rnd.randrange(50)), float(rnd.randrange(50, 90)), 1.0))
        n += 1
    for _ in range(260):
        add("hot", rnd.choice("ab"), 86_400 * 5 + 777)
    for _ in range(60):
        add("hot", rnd.choice("ab"), 86_400 * 5 + rnd.randrange(86_400))
    for _ in range(300):
        add("one", "v", 86_400 * 9 + rnd.randrange(400))
    for u in range(40):
        for _ in range(8):
            add(f"u{u}", rnd.choice("abc"), rnd.randrange(86_400 * 12))
    return rows


SEG_SCHEMA = ("seg_id bigint, user_id string, video_id string, local_start_time bigint, "
              "start_point double, end_point double, speed double")


def test_hot_user_day_and_burst_are_split(spark):
    from pyspark.sql import functions as F

    from revisit.operators import intervals, scan, sequences
    rows = _hot_rows()
    df = spark.createDataFrame(rows, SEG_SCHEMA)
    got = {r["seg_id"]: (r["video_consecutive_id"], r["session_id"])
           for r in sequences.sessionize(df, target_rows=20).collect()}
    assert got == _plain_sessions(rows)
    chunked = scan.add_time_chunks(df, ["user_id"], "local_start_time", 86_400, 20, tie="seg_id")
    largest = chunked.groupBy("user_id", "__chunk").count().agg(F.max("count")).first()[0]
    assert largest <= 60, largest  # whole user-days hold 320 and 300 rows
    # The chunk is monotone in (time, tie).
    flat = sorted(((r["user_id"], r["local_start_time"], r["seg_id"]), tuple(r["__chunk"])) for r in chunked.collect())
    assert all(a[1] <= b[1] for a, b in zip(flat, flat[1:]) if a[0][0] == b[0][0])
    # The other ordered operators give what they give without a split.
    a = sequences.segment_index(df, target_rows=20).select("seg_id", "segment_idx").collect()
    assert sorted(a) == sorted(sequences.segment_index(df, target_rows=None).select("seg_id", "segment_idx").collect())
    ded = lambda t: sorted(r[0] for r in sequences.dedupe_consecutive(
        df, item="video_id", time="local_start_time", tie=("seg_id",), bucket_width=86_400, target_rows=t).select("seg_id").collect())
    assert ded(20) == ded(None)
    ctx = sequences.sessionize(df, target_rows=20)
    sweep = intervals.repetition_counts(ctx, chunk=7.0).collect()
    assert sorted(sweep) == sorted(intervals.repetition_counts_pairs(ctx).collect())
    cov = lambda c: {(r[0], r[1]): round(r[2], 9) for r in intervals.coverage(df, chunk=c).collect()}
    assert cov(3.0) == cov(1e9)


def test_null_keys_drop_out(spark):
    from revisit.operators import sequences
    rows = [(1, None, "v", 0, 0.0, 9.0, 1.0), (2, "u", None, 5, 0.0, 9.0, 1.0), (3, "u", "v", 9, 0.0, 9.0, 1.0), (4, "u", "v", 99999, 0.0, 9.0, 1.0)]
    df = sequences.with_end_times(sequences.with_durations(spark.createDataFrame(rows, SEG_SCHEMA)))
    by = {r["seg_id"]: r["session_id"] for r in sequences.sessions_by_video(df).collect()}
    assert by == {3: 0, 4: 1}
    assert sorted(r["seg_id"] for r in sequences.segment_index(df).collect()) == [3, 4]
    kept = sequences.dedupe_consecutive(df, item="video_id", time="local_start_time", tie=("seg_id",)).collect()
    assert sorted(r["seg_id"] for r in kept) == [2, 3]


def test_heavy_buckets_are_looked_for_once(spark, tmp_path):
    """A second use of the same rows finds the table again; files that changed keep the order."""
    path = str(tmp_path / "t")
    schema = "user_id string, t long, seg_id long"
    spark.createDataFrame([("u", i, i) for i in range(500)], schema).write.parquet(path)
    chunks = lambda: scan.add_time_chunks(spark.read.parquet(path), ["user_id"], "t", 1000, 50, out="c", tie="seg_id")
    chunks()
    known = len(scan._kept)
    assert len({tuple(r.c) for r in chunks().collect()}) == 10 and len(scan._kept) == known
    # 400 rows at one instant, others before and behind the range that was counted.
    rows = [("u", t, i) for i, t in enumerate([*range(-900, 0, 9), *range(1, 400), *[450] * 400, *range(900, 2500)])]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    got = sorted(((r.t, r.seg_id), tuple(r.c)) for r in chunks().collect())
    assert len(got) == len(rows) and [c for _, c in got] == sorted(c for _, c in got)


def test_map_columns_pass_ordered_steps(spark):
    df = spark.createDataFrame([("u", "v", i, i, {"k": i}) for i in range(20)],
                               "user_id string, video_id string, local_start_time long, seg_id long, m map<string,long>")
    out = sequences.segment_index(df, bucket_seconds=7).collect()
    assert sorted((r.segment_idx, r.m["k"]) for r in out) == [(i, i) for i in range(20)]
