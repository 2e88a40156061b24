import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from revisit.operators import counts, courses, quality, report


def test_quantiles_match_numpy_linear(spark):
    rnd = random.Random(3)
    vals = [float(rnd.choice([1, 1, 2, 3, 5, 8, 13])) + rnd.choice([0, 0, 0.25]) for _ in range(501)]
    vals += [None] * 5
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    qs = [0.0, 0.25, 0.5, 0.75, 0.94, 0.99, 1.0]
    got = {r["q"]: r["value"] for r in report.quantiles(df, "x", qs, partitions=4).collect()}
    arr = np.array([v for v in vals if v is not None])
    for q in qs:
        assert abs(got[q] - np.quantile(arr, q)) < 1e-9


def test_describe_matches_pandas(spark):
    vals = [1, 1, 3, 11, 744, 2, 5]
    df = spark.createDataFrame([(v,) for v in vals], "n long")
    d = report.describe(df, "n").collect()[0].asDict()
    p = pd.Series(vals).describe()
    for a, b in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                 ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert abs(d[a] - p[b]) < 1e-9
    one = report.describe(spark.createDataFrame([(4,)], "n long"), "n").collect()[0]
    assert one["std"] is None  # pandas: NaN


def test_histogram_matches_pandas_bins(spark):
    rnd = random.Random(4)
    vals = [rnd.uniform(0.1, 50) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = report.histogram(df, "x", 50).orderBy("bin").collect()
    assert len(h) == 50 and abs(sum(r["share"] for r in h) - 1) < 1e-12
    p = pd.Series(vals).value_counts(normalize=True, bins=50).sort_index()
    assert np.allclose([r["share"] for r in h], p.values)


def test_blacklist_strict_threshold_and_anti_join_keeps_null(spark):
    c = spark.createDataFrame([("a", "u1", 20), ("b", "u2", 21), ("c", "u1", 3)],
                              "ccid string, user_id string, num_watched long")
    bl = counts.blacklist_users(c, rep_thresh=20)
    assert [r[0] for r in bl.collect()] == ["u2"]
    rows = spark.createDataFrame([("u1",), ("u2",), (None,)], "user_id string")
    kept = sorted((r[0] or "") for r in counts.remove_users(rows, bl).collect())
    assert kept == ["", "u1"]


def test_value_counts_share(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "c long")
    got = {r["c"]: (r["frequency"], r["share"]) for r in counts.value_counts(df, "c").collect()}
    assert got == {0: (3, 0.75), 1: (1, 0.25)}


def test_alternation_modes(spark):
    rows = []
    cases = {"none": ["E", "E"], "one": ["E", "V", "E"], "adj": ["V", "V", "E"],
             "apart": ["V", "E", "V"]}
    for cid, kinds in cases.items():
        for i, k in enumerate(kinds):
            rows.append((cid, i, f"{k}_{i}"))
    df = spark.createDataFrame(rows, "id string, pos long, resource_id string")
    asis = {r[0]: r[1] for r in courses.alternation_flags(df, mode="as_written").collect()}
    intent = {r[0]: r[1] for r in courses.alternation_flags(df, mode="intent").collect()}
    assert asis == {"none": None, "one": True, "adj": False, "apart": False}
    assert intent == {"none": None, "one": True, "adj": False, "apart": True}


def test_key_violations_and_monotonic(spark):
    df = spark.createDataFrame([(1, 1, 10), (2, 1, 5), (3, 2, 6), (4, 2, 6)], "id long, k long, t long")
    assert quality.key_violations(df, ["k"]).count() == 2
    r = quality.monotonic_breaks(df, ["t", "k"], "id", rows_per_chunk=2).collect()[0]
    assert r["t_breaks"] == 1 and r["k_breaks"] == 0 and r["k_sorted"] and not r["t_sorted"]


def test_rows_at_min_and_density(spark):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0), (3, -1.0)], "id long, g double")
    assert sorted(r[0] for r in counts.rows_at_min(df, "g").select("id").collect()) == [2, 3]
    r = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 2)], "user long, item long, rating long")
    d = counts.density(r).collect()[0]
    assert (d["n_rows"], d["n_users"], d["n_items"]) == (3, 2, 2) and d["density"] == 0.75
    _ = F  # noqa


def test_approximate_options_are_close(spark):
    vals = [(float(i % 97),) for i in range(5000)]
    df = spark.createDataFrame(vals, "x double")
    exact = {r["q"]: r["value"] for r in report.quantiles(df, "x", [0.25, 0.5, 0.9]).collect()}
    approx = {r["q"]: r["value"] for r in report.quantiles(df, "x", [0.25, 0.5, 0.9], approx_accuracy=10000).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(exact[q] - approx[q]) <= 1.0 for q in exact)
    r = spark.range(3000).selectExpr("id % 300 as user", "id % 40 as item")
    a = counts.density(r, approx_rsd=0.02).collect()[0]
    e = counts.density(r).collect()[0]
    assert abs(a["n_users"] - e["n_users"]) <= 0.1 * e["n_users"] and a["n_rows"] == e["n_rows"]


def test_quantiles_do_not_depend_on_the_planner(spark):
    """Many distinct values: exact with and without exchange reuse and adaptive plans."""
    df = spark.range(400_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_000_007)) / 2).cast("double").alias("x"))
    arr = np.sort([r[0] for r in df.collect()])
    qs = [0.0, 0.25, 0.5, 0.75, 0.94, 1.0]
    keys = ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(k) for k in keys]
    try:
        for reuse in ("true", "false"):
            for adaptive in ("true", "false"):
                spark.conf.set(keys[0], reuse)
                spark.conf.set(keys[1], adaptive)
                got = {r["q"]: r["value"] for r in report.quantiles(df, "x", qs, partitions=8).collect()}
                assert len(got) == len(qs)
                for q in qs:
                    assert abs(got[q] - np.quantile(arr, q)) < 1e-6, (reuse, adaptive, q)
                d = report.describe(df, "x", partitions=8).first()
                assert d["count"] == 400_000 and abs(d["p50"] - np.quantile(arr, 0.5)) < 1e-6
                assert abs(d["mean"] - arr.mean()) < 1e-3 and abs(d["std"] - arr.std(ddof=1)) < 1e-3
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_quantiles_by_narrowed_brackets(spark, monkeypatch):
    """Brackets of a few rows: several rounds, hot values, ties at the cuts, infinities."""
    rnd = random.Random(9)
    many = [rnd.gauss(0, 1) for _ in range(1500)]
    inf = float("inf")
    cases = {"hot": (many + [0.5] * 1000 + [7.0] * 700, 7, 20), "few": ([float(rnd.randrange(4)) for _ in range(900)], 7, 20),
             "ends": ([-inf] * 3 + many + [inf] * 2, 40, 100)}
    qs = [0.0, 0.001, 0.25, 0.4999, 0.5, 0.9, 0.99, 1.0]

    def linear(ordered, q):
        pos = (len(ordered) - 1) * q
        lo, hi = ordered[int(np.floor(pos))], ordered[int(np.ceil(pos))]
        return lo if lo == hi else lo + (hi - lo) * (pos - int(pos))

    for name, (vals, most, accuracy) in cases.items():
        monkeypatch.setattr(report, "MOST_INSIDE", most)
        monkeypatch.setattr(report, "ACCURACY", accuracy)
        df = spark.createDataFrame([(v,) for v in [*vals, None, float("nan")]], "x double").repartition(3)
        got = {r["q"]: r["value"] for r in report.quantiles(df, "x", qs).collect()}
        assert np.allclose([got[q] for q in qs], [linear(sorted(vals), q) for q in qs], rtol=0, atol=1e-9), name


def test_quantiles_rank_only_the_rows_inside(spark):
    """2,000,000 distinct values: exact, and the ranked rows are a small part of them."""
    n = 2_000_000
    df = spark.range(n).select((F.pmod(F.col("id") * 1_000_003, F.lit(n)) / 4).cast("double").alias("x"))
    qs = [0.25, 0.5, 0.75, 0.9, 0.99]
    got = {r["q"]: r["value"] for r in report.quantiles(df, "x", qs).collect()}
    assert all(abs(got[q] - (n - 1) * q / 4) < 1e-6 for q in qs)
    vals = report._written_column(df, "x", None)
    assert report._ranked(vals, qs, n, 0.0, (n - 1) / 4).count() < 0.02 * n


def test_describe_and_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    d = report.describe(df, "x").first().asDict()
    assert d.pop("count") == 0 and set(d.values()) == {None}
    assert [tuple(r) for r in report.quantiles(df, "x", [0.5]).collect()] == [(0.5, None)]
