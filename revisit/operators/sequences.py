"""Watch sequences: explode, durations, consecutive runs, gaps, sessions, dedupe.

Every ordered step is a chunked scan: a key's rows are split into time buckets
(or blocks of row ids), windows run inside the chunks, and boundary state moves
through a one-row-per-chunk summary, so one very active user does not end up in
one task. ``sessionize`` and ``sessions_by_video`` fuse their dependent steps
into a single such pass; the dedupe and the segment index use the generic
helpers of ``revisit.operators.scan``. Defaults are the fixed values of
``revisit.schemas`` (session threshold 3600 s, duration threshold 5 s).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revisit.functions.columns import nan_to_null, safe_div, seconds_component
from revisit.operators.scan import TARGET_ROWS, add_time_chunks, pinned, with_neighbors, with_prefix
from revisit.schemas import (DURATION_THRESH_S, GAP_COL, LECTURE_PREFIX, RUN_COL, SESSION_COL,
                             SESSION_THRESH_S)

DAY = 86_400
_B = "__chunk"


# ---------------------------------------------------------------- B1-B3 explode

def explode_sequences(user_video: DataFrame, keep: Sequence[str] = ("user_id",)) -> DataFrame:
    """B1/B2: one row per element of ``seq``; an empty or NULL list keeps one NULL row.

    Adds ``seq_pos`` (element position), the element as ``seq`` and its ``video_id``.
    """
    out = user_video.select(*keep, F.posexplode_outer("seq").alias("seq_pos", "seq"))
    return out.withColumns({"seq_pos": F.col("seq_pos").cast("bigint"),
                            "video_id": F.col("seq.video_id")})


def explode_segments(sequences: DataFrame, keep: Sequence[str] = ("user_id", "video_id")) -> DataFrame:
    """One row per watched segment, struct fields as columns.

    Rows with a NULL ``user_id`` or ``video_id`` drop out (the reference groups by
    them, which drops NULL keys). ``seg_pos`` keeps the list position as tie-break.
    """
    s = sequences.filter(F.col("user_id").isNotNull() & F.col("video_id").isNotNull())
    s = s.select(*keep, F.posexplode_outer("seq.segment").alias("seg_pos", "seg"))
    return s.select(*keep, F.col("seg_pos").cast("bigint").alias("seg_pos"),
                    "seg.end_point", "seg.start_point", "seg.speed", "seg.local_start_time")


def count_segments(sequences: DataFrame) -> DataFrame:
    """D3: total number of segments (sum of list lengths, NULL lists skipped). One row."""
    n = F.when(F.col("seq.segment").isNotNull(), F.size("seq.segment"))
    return sequences.agg(F.sum(n).cast("bigint").alias("n_segments"))


# ---------------------------------------------------------------- B5-B8, B14 durations

def with_durations(segments: DataFrame) -> DataFrame:
    """``raw_duration = end - start``; ``adjusted_duration = (end - start) / speed``.

    A zero speed gives a NULL adjusted duration (not inf / an ANSI error).
    """
    raw = F.col("end_point") - F.col("start_point")
    return segments.withColumns({"raw_duration": raw,
                                 "adjusted_duration": nan_to_null(safe_div(raw, F.col("speed")))})


def filter_duration(segments: DataFrame, threshold: float = DURATION_THRESH_S, inclusive: bool = True,
                    col: str = "adjusted_duration") -> DataFrame:
    """Keep segments with ``col >= threshold`` (``> threshold`` if not inclusive)."""
    c = F.col(col)
    return segments.filter(c >= threshold if inclusive else c > threshold)


def filter_positive(segments: DataFrame, col: str = "raw_duration") -> DataFrame:
    """Drop segments whose duration is not positive."""
    return segments.filter(F.col(col) > 0)


def with_end_times(segments: DataFrame) -> DataFrame:
    """``local_end_time = local_start_time + adjusted_duration`` and both as timestamps."""
    end = F.col("local_start_time") + F.col("adjusted_duration")
    return segments.withColumns({
        "local_end_time": end,
        "start_time": F.timestamp_seconds("local_start_time").cast("timestamp_ntz"),
        "end_time": F.timestamp_seconds(end).cast("timestamp_ntz"),
    })


def float_tolerance_rows(segments: DataFrame, tol: float = 1e-7) -> DataFrame:
    """Rows whose end-minus-start differs from ``raw_duration`` only by float noise."""
    diff = F.col("local_end_time") - F.col("local_start_time")
    return (segments.filter(diff != F.col("raw_duration"))
            .withColumn("diff", diff)
            .filter(F.abs(F.col("raw_duration") - F.col("diff")) < tol))


# ---------------------------------------------------------------- E1, E2, E4 sessions

def sessionize(segments: DataFrame, session_thresh: float = SESSION_THRESH_S, user: str = "user_id",
               video: str = "video_id", time: str = "local_start_time",
               tie: Sequence[str] = ("seg_id",), bucket_seconds: int = DAY,
               gap_mode: str = "total", target_rows: int | None = TARGET_ROWS) -> DataFrame:
    """E1 + E2 + E4 on flat segments, in one chunked pass.

    * ``video_consecutive_id`` (E1): per user in time order, +1 whenever the video
      differs from the row before; the first run is 1; a NULL video starts a run.
    * ``gap`` (E2): within a (user, run), next ``local_start_time`` minus this row's
      ``local_start_time + adjusted duration``; NULL on the last row of a run.
    * ``session_id`` (E4): within a (user, run), starts at 0 and grows by one on the
      row after a gap ``>= session_thresh``; a NULL gap never splits.

    Rows with a NULL user drop out (the reference's group-apply drops them).
    ``gap_mode="seconds_component"`` compares the gap's seconds-of-day field.
    ``tie`` must make (time, tie) unique per user (e.g. a row id): the row and
    summary branches number rows separately and must agree on the order.

    Chunks are user-days (``bucket_seconds``): a user with a third of all rows
    is spread over all the days of its history. A counting pass finds user-days
    with more than ``target_rows`` rows and cuts them into slices of time, and a
    burst at one instant by the first ``tie`` column (``scan.add_time_chunks``).

    Plan: one scan and one shuffle on (user, chunk), shared by the rows and the chunk
    summary (``scan.pinned``), so columns that are not wanted should go before. Inside a chunk, windows give the
    change flags, gaps and running sums for every row whose neighbours are in the
    chunk; the first row's change flag and the last row's gap depend on the
    neighbouring chunks and are settled from a one-row-per-chunk summary. With
    ``S`` the running count of splits over the user, a row's session id is ``S``
    minus ``S`` at the start of its run.
    """
    u, v, t = F.col(user), F.col(video), F.col(time)
    order = [time, *tie]
    # The duration is computed before the shuffle: the row branch then carries
    # one column instead of end, start and speed unless the caller keeps them.
    seg = add_time_chunks(segments.filter(u.isNotNull()), [user], time, bucket_seconds, target_rows, tie=tie[0] if tie else None)
    seg = seg.withColumn("__dur", safe_div(F.col("end_point") - F.col("start_point"), F.col("speed")))
    dur = F.col("__dur")
    w = Window.partitionBy(user, _B).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    run_w = w.rowsBetween(Window.unboundedPreceding, 0)
    before_w = w.rowsBetween(Window.unboundedPreceding, -1)

    rn, last = F.col("__rn"), F.col("__last")
    pv, nv = F.lag(video).over(w), F.lead(video).over(w)
    loc = seg.withColumns({
        "__rn": F.row_number().over(w),
        "__last": F.lead(F.lit(1)).over(w).isNull(),
        "__chg": F.when(pv.isNull() | v.isNull() | (pv != v), 1).otherwise(0),
        "__gap": nan_to_null(F.when(v.isNotNull() & nv.isNotNull() & (nv == v),
                                    F.lead(time).over(w) - (t + dur))),
    })
    loc = loc.withColumns({
        "__chg": F.when(rn > 1, F.col("__chg")).otherwise(0),
        "__split": F.when(~last, _split_flag(F.col("__gap"), session_thresh, gap_mode)).otherwise(0),
    })
    loc = loc.withColumns({"__c": F.sum("__chg").over(run_w),
                           "__s": F.coalesce(F.sum("__split").over(before_w), F.lit(0))})
    loc = pinned(loc.withColumn("__r", F.max(F.when(F.col("__chg") == 1, F.col("__s"))).over(run_w)), seg.columns)

    summary = loc.groupBy(user, _B).agg(
        F.min_by(F.struct(v.alias("v"), t.alias("t")), "__rn").alias("first"),
        F.max_by(F.struct(v.alias("v"), t.alias("t"), F.col("__dur").alias("d")), "__rn").alias("lastrow"),
        F.sum("__chg").alias("nchg"), F.sum("__split").alias("nsplit"), F.max("__r").alias("rlast"))
    w2 = Window.partitionBy(user).orderBy(_B)
    before2 = w2.rowsBetween(Window.unboundedPreceding, -1)
    pl = F.lag("lastrow").over(w2)
    summary = summary.withColumn("chg_first", F.when(
        pl.isNull() | pl["v"].isNull() | F.col("first.v").isNull() | (pl["v"] != F.col("first.v")), 1)
        .otherwise(0))
    nf, nchg = F.lead("first").over(w2), F.lead("chg_first").over(w2)
    summary = summary.withColumn("gap_last", nan_to_null(F.when(
        nf.isNotNull() & (nchg == 0), nf["t"] - (F.col("lastrow.t") + F.col("lastrow.d")))))
    summary = summary.withColumn("split_last",
                                 _split_flag(F.col("gap_last"), session_thresh, gap_mode))
    summary = summary.withColumns({
        "run_off": F.coalesce(F.sum(F.col("chg_first") + F.col("nchg")).over(before2), F.lit(0)),
        "s_off": F.coalesce(F.sum(F.col("nsplit") + F.col("split_last")).over(before2), F.lit(0)),
    })
    summary = summary.withColumn("rs_chunk", F.coalesce(
        F.col("s_off") + F.col("rlast"), F.when(F.col("chg_first") == 1, F.col("s_off"))))
    summary = summary.select(
        user, _B, "chg_first", "gap_last", "run_off", "s_off",
        F.max("rs_chunk").over(before2).alias("rs_prev"))

    j = loc.join(summary, [user, _B], "left")
    s_row = F.col("s_off") + F.col("__s")
    run_start = F.coalesce(F.col("s_off") + F.col("__r"),
                           F.when(F.col("chg_first") == 1, F.col("s_off")), F.col("rs_prev"))
    out = j.withColumns({
        RUN_COL: (F.col("run_off") + F.col("chg_first") + F.col("__c")).cast("bigint"),
        GAP_COL: F.when(last, F.col("gap_last")).otherwise(F.col("__gap")),
        SESSION_COL: (s_row - run_start).cast("bigint"),
    })
    return out.drop(_B, "__rn", "__last", "__dur", "__chg", "__gap", "__split", "__c", "__s", "__r",
                    "chg_first", "gap_last", "run_off", "s_off", "rs_prev")


def _split_flag(gap, thresh, mode: str):
    g = seconds_component(gap) if mode == "seconds_component" else gap
    return F.when(g >= F.lit(thresh), 1).otherwise(0)


def consecutive_run_ids(segments: DataFrame, **kw) -> DataFrame:
    """E1 only (the gap and session columns are pruned by the optimizer)."""
    return sessionize(segments, **kw).drop(GAP_COL, SESSION_COL)


# ---------------------------------------------------------------- E3, E5, E6 per video

def sessions_by_video(segments: DataFrame, session_thresh: float = SESSION_THRESH_S, user: str = "user_id",
                      video: str = "video_id", order: Sequence[str] = ("seg_id",),
                      rows_per_chunk: int = 1 << 20,
                      modes: dict[str, str] | None = None) -> DataFrame:
    """E3 + E5 per (user, video), in one chunked pass over ``order``.

    * ``gap`` (E3): next ``local_start_time`` minus this row's ``local_end_time``
      (B6), NULL on the last row. It follows the given ``order``: the stored row
      order by default, as the reference does not sort before the shift.
    * session ids (E5), 0-based, +1 on the row after a splitting gap. ``modes``
      maps output column to gap mode: ``"total"`` compares the whole gap (the
      intent); ``"seconds_component"`` compares the seconds field of a timedelta,
      which drops whole days (the notebook's literal rule).

    Chunks are blocks of ``rows_per_chunk`` consecutive values of ``order[0]``
    (a row id), so no chunk exceeds that many rows. ``order`` must be unique
    within a (user, video). Rows with a NULL user or video drop out, as in the
    reference's group-apply.
    """
    modes = modes or {SESSION_COL: "total"}
    order = list(order)
    d = segments.filter(F.col(user).isNotNull() & F.col(video).isNotNull())
    d = d.withColumn(_B, F.floor(F.col(order[0]) / F.lit(rows_per_chunk)).cast("bigint"))
    w = Window.partitionBy(user, video, _B).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    before_w = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("__last")
    loc = d.withColumns({
        "__rn": F.row_number().over(w),
        "__last": F.lead(F.lit(1)).over(w).isNull(),
        "__gap": nan_to_null(F.lead("local_start_time").over(w) - F.col("local_end_time")),
    })
    names = list(modes)
    loc = loc.withColumns({f"__sp{i}": F.when(~last, _split_flag(F.col("__gap"), session_thresh, modes[m]))
                           .otherwise(0) for i, m in enumerate(names)})
    loc = pinned(loc.withColumns({f"__s{i}": F.coalesce(F.sum(f"__sp{i}").over(before_w), F.lit(0))
                                  for i in range(len(names))}), d.columns)
    summary = loc.groupBy(user, video, _B).agg(
        F.min_by("local_start_time", "__rn").alias("first_t"),
        F.max_by("local_end_time", "__rn").alias("last_end"),
        *[F.sum(f"__sp{i}").alias(f"n{i}") for i in range(len(names))])
    w2 = Window.partitionBy(user, video).orderBy(_B)
    before2 = w2.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("gap_last", nan_to_null(F.when(
        F.lead(_B).over(w2).isNotNull(), F.lead("first_t").over(w2) - F.col("last_end"))))
    summary = summary.withColumns({f"__sl{i}": _split_flag(F.col("gap_last"), session_thresh, modes[m])
                                   for i, m in enumerate(names)})
    summary = summary.select(user, video, _B, "gap_last", *[
        F.coalesce(F.sum(F.col(f"n{i}") + F.col(f"__sl{i}")).over(before2), F.lit(0)).alias(f"__off{i}")
        for i in range(len(names))])
    j = loc.join(summary, [user, video, _B], "left")
    outs = {GAP_COL: F.when(last, F.col("gap_last")).otherwise(F.col("__gap"))}
    for i, m in enumerate(names):
        outs[m] = (F.col(f"__off{i}") + F.col(f"__s{i}")).cast("bigint")
    drop = [_B, "__rn", "__last", "__gap", "gap_last"]
    drop += [f"__{p}{i}" for i in range(len(names)) for p in ("sp", "s", "off")]
    return j.withColumns(outs).drop(*drop)


def segment_index(segments: DataFrame, user: str = "user_id", video: str = "video_id",
                  time: str = "local_start_time", tie: Sequence[str] = ("seg_id",),
                  bucket_seconds: int = DAY, out: str = "segment_idx",
                  target_rows: int | None = TARGET_ROWS) -> DataFrame:
    """0-based index of each segment per (user, video) in time order; rows with a
    NULL user or video drop out."""
    order = [time, *tie]
    d = segments.filter(F.col(user).isNotNull() & F.col(video).isNotNull())
    d = add_time_chunks(d, [user, video], time, bucket_seconds, target_rows, out="__tc", tie=tie[0] if tie else None)
    s = with_prefix(d, [user, video], order, F.col("__tc"), [(out, F.lit(1), "sum", False)])
    return s.withColumn(out, F.col(out).cast("bigint")).drop("__tc")


# ---------------------------------------------------------------- E7 dedupe, B9 prefix

def filter_prefix(events: DataFrame, prefix: str = LECTURE_PREFIX, col: str = "item_id") -> DataFrame:
    """Keep rows whose ``col`` starts with ``prefix`` (NULL ids drop out)."""
    return events.filter(F.col(col).startswith(prefix))


def dedupe_consecutive(events: DataFrame, user: str = "user_id", item: str = "item_id",
                       time: str = "timestamp", tie: Sequence[str] = ("event_id",),
                       bucket_width: int = DAY * 1000, target_rows: int | None = TARGET_ROWS) -> DataFrame:
    """Per user in time order keep a row when its item differs from the row before.

    The first row of a user is kept; a NULL item is always kept and always lets
    the next row through. Rows with a NULL user drop out. ``bucket_width`` is in
    units of ``time``.
    """
    order = [time, *tie]
    d = add_time_chunks(events.filter(F.col(user).isNotNull()), [user], time, bucket_width, target_rows, out="__tc",
                        tie=tie[0] if tie else None)
    s = with_neighbors(d, [user], order, F.col("__tc"), [item], nxt=False)
    p, c = F.col(f"prev_{item}"), F.col(item)
    keep = ~F.col("has_prev") | p.isNull() | c.isNull() | (p != c)
    return s.filter(keep).drop("has_prev", f"prev_{item}", "__tc")
