import re

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

ROWS_ONLY = {"q_als", "q_metrics", "q_p7_evaluation"}
FAST = ["q_repetition", "q_sessions", "q_watch_counts", "q_dedupe", "q_alternating_intent",
        "q_gap_quantiles", "q_gap_describe", "q_seq_len_describe", "q_histogram", "q_folds", "q_tfidf", "q_reduction",
        "q_explode_sequences", "q_pivot", "q_metrics_fixed", "q_recs_popular", "q_coverage_fraction", "q_join_violations",
        "q_concept_field", "q_p1_p2_clean_layout", "q_p3_sessions", "q_p4_lectures", "q_p5_courses", "q_p6_exploration",
        "q_p8_confidence", "q_distinct_sessions", "q_duration_filter_strict", "q_row_filter", "q_session2video",
        "q_item_knn", "q_user_knn", "q_metrics_knn", "q_top_factors", "q_als_step"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"seg_rep_count", "frequency", "share"} and rows


def test_every_query_has_oracle_unless_rows_only():
    qs, sql = E.queries(), E.oracle_sql()
    assert {q for q in qs if q.startswith("q_")} - set(sql) == ROWS_ONLY
    assert set(sql) <= set(qs)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ["events", "orders", "lineitem", "part", "customer", "conversations", "nation", "region"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    a = sorted((tuple(r[c] for c in cols) for r in sdf.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(r[i] for i in idx) for r in rel.fetchall()), key=repr)
    assert a == b


def _plan(df):
    """The executed plan; for adaptive plans only the final plan section."""
    p = df._jdf.queryExecution().executedPlan().toString()
    return p.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(q for q in set(E.queries()) - ROWS_ONLY if q.startswith("q_")))
def test_no_python_udf_or_cartesian(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|CartesianProduct", p), name


def test_flagship_plan_reads_events_at_most_twice(spark):
    df = E.queries()["q_repetition_dist"](spark, SF_SMALL)
    df.collect()
    p = _plan(df)
    assert len(re.findall(r"FileScan parquet", p)) <= 2
    assert "SortMergeJoin" not in p or "events" in p
