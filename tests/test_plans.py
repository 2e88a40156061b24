"""Plan shape of the core operators (what would matter at scale)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _final_plan(df):
    """The plan that ran: collecting runs this very frame, a write would run a copy."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan or "AdaptiveSparkPlan" not in plan
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("query", ["q_sessions", "q_gaps", "q_run_ids", "q_sessions_by_video", "q_dedupe"])
def test_ordered_steps_scan_and_shuffle_their_rows_once(spark, query):
    p = _final_plan(E.queries()[query](spark, SF_SMALL))
    # rows and chunk summary share one scan and one shuffle on (user, chunk), whatever the
    # query selects; the other two move the summary's one row per chunk
    assert "ReusedExchange" in p
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", p)) <= 3
    assert len(re.findall(r"FileScan parquet", p)) == 1
    row_windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", p)
    assert row_windows
    # every window over rows is partitioned by the chunk; only summary windows are by user alone
    for spec in row_windows:
        assert "__chunk" in spec or spec.strip().startswith("user_id")


def test_repetition_has_no_join_between_segments(spark):
    p = _final_plan(E.queries()["q_repetition"](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # the only joins are the chunk-summary join backs (never a segment self-join), and the
    # rows and the summary of the running sum share what comes before them
    assert "ReusedExchange" in p and len(re.findall(r"FileScan parquet", p)) <= 2
    for keys in re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[([^\]]*)\]", p):
        assert "chunk" in keys


def test_dimension_join_broadcasts_small_map(spark):
    p = _final_plan(E.queries()["q_watch_counts"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p


@pytest.mark.parametrize("query", ["q_als_step", "q_top_factors", "q_metrics"])
def test_ratings_are_computed_once(spark, query, monkeypatch):
    """Queries of several jobs read the written ratings, not the join of the raw tables again."""
    from revisit.operators import recommend
    folds = []
    monkeypatch.setattr(recommend, "als_recommend", lambda folded: folds.append(folded) or folded.selectExpr(
        "'ALS' AS algorithm", "fold", "user", "item", "1L AS rank"))
    out = E.queries()[query](spark, SF_SMALL)
    files = [f for df in (out, *folds) for f in df.inputFiles()]
    assert not any("lineitem" in f or "orders" in f for f in files)
