"""Property-based checks (hypothesis) of the identities the operators rely on."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import brute
from revisit.operators import sequences

points = st.sampled_from([0.0, 2.5, 5.0, 7.5, 10.0, 12.0, 15.0, 30.0])
intervals = st.lists(st.tuples(points, points), min_size=0, max_size=12)


def _sweep_count(ivs, t=5.0):
    """C(n,2) minus ordered pairs with end_j - t < start_i, over valid segments."""
    valid = [(s, e - t) for s, e in ivs if s <= e - t]
    n = len(valid)
    apart = sum(1 for s, _ in valid for _, e2 in valid if e2 < s)
    return n * (n - 1) // 2 - apart


@given(intervals)
@settings(max_examples=500)
def test_sweep_identity_equals_pair_count(ivs):
    assert _sweep_count(ivs) == brute.rep_count(ivs)


row = st.tuples(st.integers(0, 2), st.sampled_from(["a", "b", None]), st.integers(0, 20_000),
                st.sampled_from([0.0, 10.0]), st.sampled_from([2.0, 12.0, 50.0]), st.sampled_from([1.0, 2.0]))


@given(st.lists(row, min_size=1, max_size=25), st.sampled_from([7, 600, 3600, 86400]))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_sessionize_matches_brute_force(spark, rows, bucket):
    data = [{"seg_id": i, "user_id": f"u{u}", "video_id": v, "local_start_time": t, "start_point": s,
             "end_point": s + d, "speed": sp} for i, (u, v, t, s, d, sp) in enumerate(rows)]
    df = spark.createDataFrame(data, "seg_id bigint, user_id string, video_id string, local_start_time bigint, "
                                     "start_point double, end_point double, speed double")
    got = {r["seg_id"]: (r["video_consecutive_id"], r["gap"], r["session_id"])
           for r in sequences.sessionize(df, session_thresh=1000, bucket_seconds=bucket).collect()}
    want = brute.sessions(data, 1000)
    assert got.keys() == want.keys()
    for k, (run, gap, sess) in want.items():
        g = got[k]
        assert (g[0], g[2]) == (run, sess)
        assert (g[1] is None and gap is None) or abs(g[1] - gap) < 1e-9


events = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5000), st.sampled_from(["l1", "l2", None])),
                  min_size=1, max_size=30)


@given(events, st.sampled_from([50, 1000, 10**9]), st.sampled_from([None, 2, 5]))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_dedupe_matches_brute_force(spark, evs, width, target):
    rows = [{"event_id": i, "user_id": u, "timestamp": t, "item_id": it} for i, (u, t, it) in enumerate(evs)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, timestamp bigint, item_id string")
    got = {r[0] for r in sequences.dedupe_consecutive(df, bucket_width=width, target_rows=target)
           .select("event_id").collect()}
    assert got == brute.dedupe(rows)


@given(st.lists(st.sampled_from([-3.5, 0.0, 1.0, 1.0, 2.25, 7.0, 1e6]), min_size=1, max_size=40))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_quantiles_match_numpy(spark, vals):
    import numpy as np

    from revisit.operators import report
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    qs = [0.0, 0.1, 0.5, 0.94, 1.0]
    got = {r["q"]: r["value"] for r in report.quantiles(df, "x", qs, partitions=3).collect()}
    for q in qs:
        assert abs(got[q] - np.quantile(np.array(vals), q)) <= 1e-9 * max(1.0, abs(got[q]))


@given(st.lists(st.tuples(st.integers(0, 1), points, points), min_size=1, max_size=20))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_coverage_is_union_length(spark, segs):
    from revisit.operators import intervals
    rows = [(f"u{u}", "v", i, s, e) for i, (u, s, e) in enumerate(segs)]
    df = spark.createDataFrame(rows, "user_id string, video_id string, seg_id long, start_point double, end_point double")
    got = {r["user_id"]: r["covered"] for r in intervals.coverage(df).collect()}
    for u in {r[0] for r in rows}:
        want = brute.union_length([(s, e) for uu, _, _, s, e in rows if uu == u])
        assert abs(got.get(u, 0.0) - want) < 1e-6
