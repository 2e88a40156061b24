"""Interval analytics: segment repetition count, coverage, mean speed.

Repetition count (I1) of a session = number of unordered segment pairs with
``max(start) <= min(end) - t``. Segment ``i`` can only match if
``start_i <= end_i - t``; for such segments the rule says the closed intervals
``[start, end - t]`` intersect. So

    pairs = C(n, 2) - #{(i, j): end_j - t < start_i}

over the n valid segments of a session. The second term needs, for every start
point, the number of shifted end points strictly below it: a running sum over
the session's *distinct* points. Rows are first pre-aggregated to one row per
(session, point) with partial aggregation before the shuffle, so a session that
repeats the same passages millions of times shrinks to its distinct points, and
the running sum runs over those distinct points, cut into chunks of
``POINT_CHUNK`` seconds of video whose totals are carried over, so a session's points
are spread as well. No self-join, no pair is emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.functions.columns import safe_div
from revisit.operators.scan import with_prefix
from revisit.schemas import OVERLAP_THRESH_S, REP_COL, RUN_COL, SESSION_COL

SESSION_KEYS = ("user_id", RUN_COL, SESSION_COL)
POINT_CHUNK = 600.0  # seconds of video position in a chunk of a running sum or maximum


def repetition_counts(ctx: DataFrame, overlap_thresh: float = OVERLAP_THRESH_S,
                      keys: Sequence[str] = SESSION_KEYS, start: str = "start_point",
                      end: str = "end_point", out: str = REP_COL, chunk: float = POINT_CHUNK) -> DataFrame:
    """One row per session key with its repetition count (0 without pairs).

    A segment with a NULL point matches nothing but still keeps its session.
    """
    keys = list(keys)
    s, e = F.col(start), F.col(end)
    e_shift = e - F.lit(float(overlap_thresh))
    valid = s.isNotNull() & e.isNotNull() & (s <= e_shift)
    one = F.when(valid, 1).otherwise(0)
    ev = ctx.select(*keys, F.explode(F.array(
        F.struct(F.when(valid, s).alias("p"), one.alias("ns"), F.lit(0).alias("ne")),
        F.struct(F.when(valid, e_shift).alias("p"), F.lit(0).alias("ns"), one.alias("ne")),
    )).alias("x")).select(*keys, "x.p", "x.ns", "x.ne")
    pts = ev.groupBy(*keys, "p").agg(F.sum("ns").alias("ns"), F.sum("ne").alias("ne"))
    # Both branches of the running sum need the same columns of ``pts``, so its exchange,
    # and with it everything before, runs once.
    pts = with_prefix(pts, keys, ["p"], F.floor(F.col("p") / F.lit(float(chunk))),
                      [("ends_before", F.col("ne"), "sum", False), ("starts_before", F.col("ns"), "sum", False)],
                      totals=(None, "n_starts"))
    per = pts.groupBy(*keys).agg(F.max("n_starts").cast("bigint").alias("n"),
                                 F.sum(F.col("ns") * F.col("ends_before")).cast("bigint").alias("apart"))
    count = F.expr("n * (n - 1) div 2") - F.col("apart")
    return per.select(*keys, count.cast("bigint").alias(out))


def repetition_counts_pairs(ctx: DataFrame, overlap_thresh: float = OVERLAP_THRESH_S,
                            keys: Sequence[str] = SESSION_KEYS, pos: str = "seg_id",
                            start: str = "start_point", end: str = "end_point",
                            out: str = REP_COL) -> DataFrame:
    """I1 by the quadratic pair join (reference semantics, for tests on small data only)."""
    keys = list(keys)
    a = ctx.select(*keys, F.col(pos).alias("pa"), F.col(start).alias("sa"), F.col(end).alias("ea"))
    b = ctx.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col(pos).alias("pb"),
                   F.col(start).alias("sb"), F.col(end).alias("eb"))
    cond = [F.col(k) == F.col(f"b_{k}") for k in keys]
    cond.append(F.col("pa") < F.col("pb"))
    cond.append(F.greatest("sa", "sb") <= F.least("ea", "eb") - F.lit(float(overlap_thresh)))
    pairs = a.filter(F.col("sa").isNotNull() & F.col("ea").isNotNull()).join(
        b.filter(F.col("sb").isNotNull() & F.col("eb").isNotNull()), cond)
    counted = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    sessions = ctx.select(*keys).distinct()
    return (sessions.join(counted, keys, "left")
            .select(*keys, F.coalesce(F.col(out), F.lit(0)).cast("bigint").alias(out)))


def segments_per_video(segments: DataFrame, keys: Sequence[str] = ("user_id", "video_id")) -> DataFrame:
    """Number of segments per (user, video)."""
    return segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_segments"))


def coverage(segments: DataFrame, keys: Sequence[str] = ("user_id", "video_id"),
             start: str = "start_point", end: str = "end_point",
             video_length: DataFrame | None = None, chunk: float = POINT_CHUNK) -> DataFrame:
    """Length of the union of a user's watched intervals of a video (speed ignored).

    Segments with ``end > start`` only. They are first reduced to one row per
    distinct start (its largest end); in start order each start adds
    ``max(0, end - max(start, M))`` where ``M`` is the largest end before it, a
    running maximum carried over chunks of ``chunk`` seconds. With ``video_length``
    (``video_id``, ``length``) the ``fraction`` of the video is added (NULL for a
    length of 0 or without one).
    """
    keys = list(keys)
    seg = segments.filter(F.col(end) > F.col(start))
    per_start = seg.groupBy(*keys, F.col(start).alias("s")).agg(F.max(end).alias("e"))
    per_start = with_prefix(per_start, keys, ["s"], F.floor(F.col("s") / F.lit(float(chunk))), [("m", F.col("e"), "max", False)])
    add = F.greatest(F.lit(0.0), F.col("e") - F.greatest(F.col("s"), F.coalesce("m", F.col("s"))))
    cov = per_start.groupBy(*keys).agg(F.sum(add).alias("covered"))
    if video_length is not None:
        cov = cov.join(video_length, "video_id", "left").withColumn("fraction", safe_div("covered", "length"))
    return cov


def weighted_speed(segments: DataFrame, keys: Sequence[str] = ("user_id", "video_id")) -> DataFrame:
    """I4: mean speed weighted by raw duration, over segments with raw duration > 0."""
    raw = F.col("end_point") - F.col("start_point")
    seg = segments.filter(raw > 0)
    return seg.groupBy(*keys).agg(
        (F.sum(F.col("speed") * raw) / F.sum(raw)).alias("mean_speed"))
