import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from revisit.operators import recommend, sequences
from revisit.plans import pipelines
from revisit.schemas import COURSE_SCHEMA, SEQ_SCHEMA
from revisit.sources import io, views


def _tmp():
    return tempfile.mkdtemp(prefix="revisit-pipe-")


def test_clean_repeaters_from_json(spark):
    d = _tmp()
    with open(f"{d}/uv.json", "w") as f:
        for u, n in (("U_1", 22), ("U_2", 3)):
            seq = [{"video_id": "V_1", "segment": [{"end_point": 10.0, "start_point": 0.0, "speed": 1.0,
                                                     "local_start_time": i}]} for i in range(n)]
            f.write(json.dumps({"user_id": u, "seq": seq}) + "\n")
    with open(f"{d}/map.txt", "w") as f:
        f.write("V_1\tC1\n")
    res = pipelines.clean_repeaters(io.read_json(spark, f"{d}/uv.json"), io.read_tsv(spark, f"{d}/map.txt"),
                                    out_dir=f"{d}/out", rep_thresh=20)
    assert [r[0] for r in res.blacklist.collect()] == ["U_1"]
    rep = res.report.collect()[0]
    assert (rep["segments_before"], rep["segments_after"], rep["n_blacklisted"], rep["n_users"]) == (25, 3, 1, 2)
    assert abs(rep["reduction"] - 22 / 25) < 1e-12
    assert os.path.isdir(f"{d}/out/blacklist") and os.path.isdir(f"{d}/out/clean")


def test_layout_by_user_pins_schema(spark):
    d = _tmp()
    seq = views.seq_view(spark, SF_SMALL).select(F.col("user_id").cast("string").alias("user_id"), "seq")
    pipelines.layout_by_user(seq, f"{d}/parts", n=4)
    back = spark.read.parquet(f"{d}/parts")
    assert back.schema == SEQ_SCHEMA and back.count() == seq.count()


def test_session_repetition_writes_and_reads_back(spark):
    d = _tmp()
    res = pipelines.session_repetition(views.seg_view(spark, SF_SMALL), out_dir=d)
    n_sessions = res.repetitions.count()
    assert res.distribution.agg(F.sum("frequency")).first()[0] == n_sessions
    assert res.session2video.count() == res.context.count()
    for name in ("segments_w_context", "segments_w_repetition_count", "session2video",
                 "repetition_distribution", "sessions_length", "sessions_length_description"):
        assert os.path.isdir(f"{d}/{name}")
    # sessions are dense from 0 within each run; runs dense from 1 per user
    ctx = res.context
    bad = ctx.groupBy("user_id", "video_consecutive_id").agg(
        (F.max("session_id") + 1 - F.countDistinct("session_id")).alias("x")).filter("x != 0")
    assert bad.count() == 0
    runs = ctx.groupBy("user_id").agg(F.min("video_consecutive_id").alias("lo"),
                                      F.max("video_consecutive_id").alias("hi"),
                                      F.countDistinct("video_consecutive_id").alias("n"))
    assert runs.filter("lo != 1 or hi != n").count() == 0


def test_lecture_sequences(spark):
    single, desc = pipelines.lecture_sequences(views.click_view(spark, SF_SMALL))
    assert single.filter(~F.col("item_id").startswith("l")).count() == 0
    assert desc.collect()[0]["count"] == single.select("user_id").distinct().count()


def test_courses_alternating_videos_pipeline(spark):
    rows = [("c1", "x", 3, [{"resource_id": "E_1"}, {"resource_id": "V_2"}, {"resource_id": "E_3"}], 10),
            ("c2", "x", 2, [{"resource_id": "V_1"}, {"resource_id": "V_2"}], 5),
            ("c3", "x", 1, [{"resource_id": "V_1"}], None),
            ("c4", "x", 0, [], 7)]
    c = spark.createDataFrame(rows, COURSE_SCHEMA)
    assert [r["id"] for r in pipelines.courses_alternating_videos(c).collect()] == ["c1"]


def test_segment_exploration_outputs(spark):
    out = pipelines.segment_exploration(views.seg_view(spark, SF_SMALL))
    assert out["raw_histogram"].count() == 500 and out["adjusted_histogram"].count() == 400
    assert abs(out["raw_histogram"].agg(F.sum("share")).first()[0] - 1) < 1e-9
    assert out["gap_quantiles"].count() == 25


def test_rewatch_confidence(spark):
    counts_df = views.rate_view(spark, SF_SMALL).select(
        F.col("user").alias("user_id"), F.col("item").alias("ccid"), F.col("rating").alias("num_watched"))
    t = pipelines.rewatch_confidence(counts_df)
    norms = t.groupBy("user").agg(F.sum(F.col("weight") ** 2).alias("s"))
    assert norms.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_als_excludes_train_items(spark):
    rows = [(u, i, 2) for u in range(30) for i in range(12) if (u * 7 + i * 3) % 5 < 3]
    r = spark.createDataFrame(rows, "user long, item long, rating long")
    folded = recommend.user_folds(recommend.filter_min_items(r), n_folds=2)
    recs = recommend.als_recommend(folded, n=5, rank=4, max_iter=3, n_folds=2)
    train = folded.filter(~F.col("is_test")).select("user", "item")
    assert recs.join(train, ["user", "item"]).count() == 0
    per = recs.groupBy("user").agg(F.max("rank").alias("m"), F.count("*").alias("c"))
    assert per.filter("m > 5 or c > 5").count() == 0
    test = folded.filter("is_test").select("user", "item")
    m = recommend.mean_metrics(recommend.topn_metrics(recs, test, k=10)).collect()
    assert len(m) == 1 and 0 <= m[0]["precision"] <= 1


def test_command_line_clean_and_sessions(spark):
    from revisit.plans import run
    d = _tmp()
    seq = views.seq_view(spark, SF_SMALL).select(F.col("user_id").cast("string").alias("user_id"), "seq")
    seq.write.json(f"{d}/uv.json")  # a folder of JSON-lines parts
    with open(f"{d}/map.txt", "w") as f:
        for r in views.video_ccid_view(spark, SF_SMALL).collect():
            f.write(f"{r[0]}\t{r[1]}\n")
    run.main(["clean", "--sequences", f"{d}/uv.json", "--video-ccid", f"{d}/map.txt",
              "--out", f"{d}/clean", "--thresh", "2"])
    rep = spark.read.parquet(f"{d}/clean/report").collect()[0]
    assert rep["segments_before"] >= rep["segments_after"] > 0
    run.main(["sessions", "--sequences", f"{d}/uv.json", "--out", f"{d}/sessions"])
    reps = spark.read.parquet(f"{d}/sessions/segments_w_repetition_count")
    ctx = spark.read.parquet(f"{d}/sessions/segments_w_context")
    assert reps.count() == ctx.select("user_id", "video_consecutive_id", "session_id").distinct().count()


def _raw(d, seed=3):
    """Raw lists in JSON with string ids; returns the rows as Python values."""
    import random
    rng, rows = random.Random(seed), []
    for u in range(12):
        for _ in range(rng.randrange(1, 3)):  # a user has several source rows
            seq = []
            for _ in range(rng.randrange(0, 9)):
                t0 = rng.randrange(0, 40) * 1000
                segs = [{"end_point": float(s + rng.randrange(2, 40)), "start_point": float(s), "speed": rng.choice((1.0, 1.25)),
                         "local_start_time": t0 + 5 * i} for i, s in enumerate(rng.choices(range(30), k=rng.randrange(0, 4)))]
                seq.append({"video_id": f"V_{rng.randrange(6):x}a", "segment": rng.choice((segs, segs, None)) if segs else segs})
            rows.append({"user_id": f"U_{u}", "seq": seq})
    rows.append({"user_id": "U_rep", "seq": [{"video_id": "V_1a", "segment": []}] * 4})
    with open(f"{d}/uv.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    ids = {f"V_{i:x}a": f"{i:08X}FF" for i in range(5)}  # V_5a has no mapping
    with open(f"{d}/map.txt", "w") as f:
        f.writelines(f"{v}\t{c}\n" for v, c in ids.items())
    return rows, ids


def test_clean_partition_sessions_in_a_row(spark):
    """P-1, P-2 and P-3 through the command line on string ids, against plain Python."""
    from collections import Counter

    from revisit.plans import run
    d = _tmp()
    rows, ids = _raw(d)
    run.main(["clean", "--sequences", f"{d}/uv.json", "--video-ccid", f"{d}/map.txt", "--out", f"{d}/clean", "--thresh", "3"])
    run.main(["partition", "--sequences", f"{d}/clean/clean", "--out", f"{d}/parts", "--parts", "4"])
    run.main(["sessions", "--sequences", f"{d}/parts", "--out", f"{d}/sessions"])
    watched = [(r["user_id"], s["video_id"], s["segment"] or []) for r in rows for s in r["seq"] if s["video_id"] in ids]
    listed = {u for (u, c), n in Counter((u, ids[v]) for u, v, _ in watched).items() if n > 3}
    assert "U_rep" in listed
    clean = spark.read.parquet(f"{d}/parts")
    assert clean.columns[:4] == ["user_id", "seq", "video_id", "ccid"]
    key = lambda x: json.dumps(x, sort_keys=True)
    segs = lambda s: [q.asDict() for q in (s or [])]
    assert sorted(key((r.user_id, r.video_id, r.ccid, segs(r.seq.segment))) for r in clean.collect()) == sorted(
        key((u, v, ids[v], s)) for u, v, s in watched if u not in listed)
    rep = spark.read.parquet(f"{d}/clean/report").first()
    before, after = sum(len(s) for _, _, s in watched), sum(len(s) for u, _, s in watched if u not in listed)
    assert (rep.segments_before, rep.segments_after, rep.n_blacklisted, rep.n_users) == (before, after, len(listed), 13)
    # Sessions of every user by plain Python over the flat segments.
    flat = spark.read.parquet(f"{d}/sessions/segments").collect()
    assert len({(r.src_row, r.seq_pos, r.seg_pos) for r in flat}) == len(flat)
    want = {}
    for u in {r.user_id for r in flat}:
        own = sorted((r for r in flat if r.user_id == u),
                     key=lambda r: (r.local_start_time is None, r.local_start_time or 0, r.src_row, r.seq_pos, r.seg_pos))
        run_id = session = 0
        for a, b in zip([None, *own], own):
            gap = None if a is None or None in (a.local_start_time, b.local_start_time, a.end_point) else (
                b.local_start_time - (a.local_start_time + (a.end_point - a.start_point) / a.speed))
            if a is None or a.video_id != b.video_id:
                run_id, session = run_id + 1, 0
            elif gap is not None and gap >= 3600:
                session += 1
            want.setdefault((u, run_id, session), []).append(b)

    def pairs(rows_):
        ok = [r for r in rows_ if r.start_point is not None]
        return sum(max(a.start_point, b.start_point) <= min(a.end_point, b.end_point) - 5
                   for i, a in enumerate(ok) for b in ok[:i])
    got = spark.read.parquet(f"{d}/sessions/segments_w_repetition_count").collect()
    assert {(r.user_id, r.video_consecutive_id, r.session_id): r.seg_rep_count for r in got} == {k: pairs(v) for k, v in want.items()}
    joined = spark.read.parquet(f"{d}/sessions/session2video")
    assert joined.count() == len(flat) and "ccid" in joined.columns


def test_raw_input_is_read_once(spark):
    """The raw JSON is scanned by one job only; everything else reads what P-1 wrote."""
    d = _tmp()
    _raw(d)
    raw = io.read_json(spark, f"{d}/uv.json")
    res = pipelines.clean_repeaters(raw, io.read_tsv(spark, f"{d}/map.txt"), out_dir=f"{d}/out", rep_thresh=3)
    for df in (res.counts, res.blacklist, res.clean, res.report):
        df.collect()
        assert "uv.json" not in df._jdf.queryExecution().executedPlan().toString()


def test_session_join_fails_on_a_repeated_key(spark):
    import pytest

    from revisit.operators import counts
    reps = spark.createDataFrame([("u", 1, 0, 3), ("u", 1, 0, 4), ("v", 1, 0, 5)], "user_id string, run long, session long, n long")
    ctx = spark.createDataFrame([("u", 1, 0, 10), ("v", 1, 0, 11)], "user_id string, run long, session long, seg_id long")
    keys = ["user_id", "run", "session"]
    with pytest.raises(Exception, match="not unique"):
        counts.join_validated(reps, ctx, keys, "left", "one_to_many").collect()
    good = counts.join_validated(reps.filter("n != 4"), ctx, keys, "left", "one_to_many")
    assert sorted(tuple(r) for r in good.collect()) == [("u", 1, 0, 3, 10), ("v", 1, 0, 5, 11)]
    with pytest.raises(Exception, match="not unique"):
        counts.join_validated(ctx, reps, keys, "inner", "many_to_one").collect()
    assert [tuple(r) for r in counts.join_violations(reps, ctx, keys, "one_to_many").collect()] == [("u", 1, 0)]


def test_recommendation_on_any_id_type(spark):
    rows = [(f"U_{u}", f"{i:08X}", 2) for u in range(30) for i in range(12) if (u * 7 + i * 3) % 5 < 3]
    text = spark.createDataFrame(rows, "user_id string, ccid string, num_watched long")
    big = text.select((F.lit(1 << 40) + F.substring("user_id", 3, 9).cast("long")).alias("user_id"),
                      (F.lit(1 << 35) + F.conv("ccid", 16, 10).cast("long")).alias("ccid"), "num_watched")
    for counts_df in (text, big):
        folded = recommend.user_folds(recommend.rewatch_ratings(counts_df), n_folds=2, min_items=1)
        recs = recommend.als_recommend(folded, n=5, rank=4, max_iter=3, n_folds=2)
        assert recs.schema["user"].dataType == counts_df.schema["user_id"].dataType
        assert recs.join(folded.filter("not is_test").select("user", "item"), ["user", "item"]).count() == 0
        assert recs.select("user").distinct().count() == 30
        assert recs.join(folded.select("item").distinct(), "item", "left_anti").count() == 0


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"x{i % 500}",) for i in range(2000)] + [(None,)], "k string")
    got = recommend.dense_ids(df, "k", "i").collect()
    assert sorted(r.i for r in got) == list(range(500)) and len({r.k for r in got}) == 500


def test_exploration_reads_back_what_it_wrote(spark):
    d = _tmp()
    out = pipelines.segment_exploration(views.seg_view(spark, SF_SMALL), views.event_ccid_view(spark, SF_SMALL), out_dir=d)
    for name in ("gap_quantiles", "session_counts", "distinct_sessions"):
        out[name].collect()
        assert "events.parquet" not in out[name]._jdf.queryExecution().executedPlan().toString()
    assert "ccid" in out["distinct_sessions"].columns
