"""End-to-end pipelines (P-1 .. P-8): the reference's scripts as Spark jobs.

Pipelines take DataFrames (and an output folder where they write) and return
DataFrames. Where one result feeds several outputs it is written first and read
back, which cuts the lineage at a table in the output folder: a lost executor
then recomputes from that table, not from the raw logs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.operators import counts, courses, intervals, neighbours, recommend, report, sequences
from revisit.schemas import REP_COL, RUN_COL, SESSION_COL
from revisit.sources import io


@dataclass
class CleanResult:
    counts: DataFrame
    blacklist: DataFrame
    clean: DataFrame
    report: DataFrame


def _written(df: DataFrame, out_dir: str | None, name: str, **kw) -> DataFrame:
    """``df`` written below ``out_dir`` and read back; ``df`` itself without a folder."""
    if not out_dir:
        return df
    io.write_parquet(df, f"{out_dir}/{name}", **kw)
    return df.sparkSession.read.schema(df.schema).parquet(f"{out_dir}/{name}")


def clean_repeaters(user_video: DataFrame, video_ccid: DataFrame, out_dir: str | None = None,
                    rep_thresh: int = 20, item: str = "ccid") -> CleanResult:
    """P-1: remove users who watched any item more than ``rep_thresh`` times.

    The raw lists are read once: exploded, left-joined to the id map and written as
    ``exploded`` with each element's place (``src_row``, ``seq_pos``). Counts, blacklist,
    report and clean table come from that table; the blacklist is written (CSV) and read
    back before it filters. ``clean`` has one row per element whose video has a mapping:
    ``user_id, seq (struct), video_id, ccid`` and the place columns.
    """
    rows = sequences.explode_sequences(user_video.withColumn("src_row", F.monotonically_increasing_id()),
                                       keep=("user_id", "src_row"))
    ids = video_ccid.withColumn("mapped", F.lit(True))
    rows = _written(counts.map_ids(rows, ids, "video_id", how="left"), out_dir, "exploded")
    mapped = rows.filter("mapped").drop("mapped")
    c = counts.count_interactions(mapped, item, "user_id", "num_watched")
    bl = counts.blacklist_users(c, "num_watched", rep_thresh)
    if out_dir:
        io.write_csv(bl, f"{out_dir}/blacklist")
        bl = bl.sparkSession.read.schema(bl.schema).option("header", "true").csv(f"{out_dir}/blacklist")
    clean = _written(counts.remove_users(mapped, bl).select("user_id", "seq", "video_id", *[x for x in mapped.columns if x not in (
        "user_id", "seq", "video_id", "src_row", "seq_pos")], "src_row", "seq_pos"), out_dir, "clean")
    rep = counts.reduction_report(counts.segment_count(rows), bl, item=item)
    return CleanResult(c, bl, clean, rep)


def layout_by_user(user_video: DataFrame, out_path: str, n: int = 30) -> None:
    """P-2: hash-partition sequences by user into ``n`` parts, sorted, with a pinned schema
    (the cleaned table of P-1, or raw lists). Parts of more users' rows than a task should
    sort are several files (see ``io.partition_by_user``)."""
    slices = io.user_slices(user_video, n)
    io.write_nested(io.partition_by_user(user_video, n, slices=slices), out_path, compression=None)


def to_segments(user_video: DataFrame, out_dir: str | None = None) -> DataFrame:
    """Flat segments of raw lists or of the cleaned table, with a key that is unique per
    row: (``src_row``, ``seq_pos``, ``seg_pos``). A table without ``src_row`` gets row
    numbers; with ``out_dir`` the segments are written first, so the numbers stay."""
    if "src_row" not in user_video.columns:
        user_video = user_video.withColumn("src_row", F.monotonically_increasing_id())
    if isinstance(user_video.schema["seq"].dataType, T.ArrayType):
        user_video = sequences.explode_sequences(user_video, keep=("user_id", "src_row"))
    elif "seq_pos" not in user_video.columns:
        user_video = user_video.withColumn("seq_pos", F.lit(0).cast("bigint"))
    keep = [c for c in ("user_id", "video_id", "ccid", "src_row", "seq_pos") if c in user_video.columns]
    return _written(sequences.explode_segments(user_video, keep=keep), out_dir, "segments")


@dataclass
class RepetitionResult:
    context: DataFrame
    repetitions: DataFrame
    distribution: DataFrame
    sessions_per_user: DataFrame
    description: DataFrame
    shares: DataFrame
    session2video: DataFrame


def session_repetition(segments: DataFrame, out_dir: str | None = None, session_thresh: float = 3600,
                       overlap_thresh: float = 5.0, tie=("seg_id",)) -> RepetitionResult:
    """P-3: runs, gaps, sessions and per-session repetition counts, with reports.

    ``segments`` is flat (see ``to_segments``); (``local_start_time``, ``tie``) must be
    unique per user. With ``out_dir`` the context table, the repetition counts and the
    sessions per user are written and read back before they are used again. The join of
    sessions and segments fails if a session's key is not unique.
    """
    keys = ["user_id", RUN_COL, SESSION_COL]
    ctx = _written(sequences.sessionize(segments, session_thresh=session_thresh, tie=tie), out_dir, "segments_w_context")
    reps = _written(intervals.repetition_counts(ctx, overlap_thresh), out_dir, "segments_w_repetition_count")
    dist = _written(counts.value_counts(reps, REP_COL), out_dir, "repetition_distribution", compression=None)
    per_user = _written(counts.sessions_per_user(reps), out_dir, "sessions_length", compression=None)
    s2v = _written(counts.join_validated(reps, ctx, keys, "left", "one_to_many"), out_dir, "session2video")
    desc = _written(report.describe(per_user, "n_sessions"), out_dir, "sessions_length_description", compression=None)
    return RepetitionResult(ctx, reps, dist, per_user, desc, counts.share_over(per_user), s2v)


def lecture_sequences(events: DataFrame, out_dir: str | None = None, prefix: str = "l") -> tuple[DataFrame, DataFrame]:
    """P-4: lecture events only, consecutive repeats removed, per-user length description."""
    single = _written(sequences.dedupe_consecutive(sequences.filter_prefix(events, prefix)), out_dir, "single_lecture_events")
    lengths = single.groupBy("user_id").agg(F.count("item_id").alias("n"))
    return single, _written(report.describe(lengths, "n"), out_dir, "lecture_seq_len_describe")


def courses_alternating_videos(course_ext: DataFrame, mode: str = "as_written") -> DataFrame:
    """P-5: courses whose video resources alternate, with known user counts."""
    res = courses.explode_resources(course_ext, min_count=0)
    flags = courses.alternation_flags(res, mode=mode)
    ids = flags.filter(F.col("alternating")).select("id")
    info = counts.keep_keys(course_ext.drop("about"), ids, "id")
    return info.filter(F.col("`Number of users`").isNotNull())


def segment_exploration(segments: DataFrame, video_ccid: DataFrame | None = None, duration_thresh: float = 5.0,
                        session_thresh: float = 3600, out_dir: str | None = None) -> dict[str, DataFrame]:
    """P-6: durations, histograms, per-video gaps and sessions, and their reports. With
    ``out_dir`` the durations and the per-video sessions are written and read back."""
    d = sequences.with_durations(segments)
    if video_ccid is not None:
        d = counts.map_ids(d, video_ccid, "video_id", how="left")
    d = _written(d, out_dir, "durations")
    f = sequences.with_end_times(sequences.filter_duration(d, duration_thresh))
    by_video = _written(sequences.sessions_by_video(
        f, session_thresh, modes={SESSION_COL: "total", "session_id_seconds": "seconds_component"}), out_dir, "sessions")
    per = by_video.groupBy("user_id", "video_id").agg(F.countDistinct(SESSION_COL).alias("session_count"))
    return {
        "durations": d,
        "raw_histogram": report.histogram(sequences.filter_positive(d, "raw_duration"), "raw_duration", 500),
        "adjusted_histogram": report.histogram(sequences.filter_positive(d, "adjusted_duration"),
                                               "adjusted_duration", 400),
        "sessions": by_video,
        "segment_index": sequences.segment_index(f),
        "gap_quantiles": report.quantiles(by_video, "gap", [round(0.75 + 0.01 * i, 2) for i in range(25)]),
        "gap_description": report.describe(by_video, "gap"),
        "distinct_sessions": by_video.select("user_id", "video_id", SESSION_COL, *(["ccid"] if "ccid" in by_video.columns else []))
        .dropDuplicates(),
        "session_counts": per,
        "session_totals": per.agg(F.sum("session_count").alias("total_sessions"),
                                  F.count(F.lit(1)).alias("n_groups")),
    }


def _ratings_table(counts_df: DataFrame, out_dir: str | None) -> DataFrame:
    """J1 + J2, written once under ``out_dir`` (and read back) when given: every
    later step reads the small ratings table instead of recomputing the counts."""
    return _written(recommend.filter_min_items(recommend.rewatch_ratings(counts_df)), out_dir, "ratings")


def rewatch_recommendation(counts_df: DataFrame, out_dir: str | None = None, n: int = 100, k: int = 10,
                           n_folds: int = 5, seed: int = 42) -> dict[str, DataFrame]:
    """P-7: rewatch ratings, user folds, top-n lists of the three algorithms (item-item and
    user-user neighbours, implicit ALS), metrics per algorithm and user, and their means. With
    ``out_dir`` the ratings, the folds, the lists and the metrics are written and read back."""
    ratings = _ratings_table(counts_df, out_dir)
    folded = _written(recommend.user_folds(ratings, n_folds, seed), out_dir, "folds")
    lists = [neighbours.knn_recommend(folded, by="item", n=n), neighbours.knn_recommend(folded, by="user", n=n),
             recommend.als_recommend(folded, n=n, seed=seed, n_folds=n_folds)]
    recs = _written(lists[0].unionByName(lists[1]).unionByName(lists[2]), out_dir, "recs")
    test = folded.filter("is_test").select("user", "item")
    metrics = _written(recommend.topn_metrics(recs, test, k), out_dir, "rep_rs_metrics")
    means = recommend.mean_metrics(metrics)
    return {"ratings": ratings, "density": counts.density(ratings), "folds": folded, "recs": recs,
            "metrics": metrics, "means": means}


def rewatch_confidence(counts_df: DataFrame, out_dir: str | None = None) -> DataFrame:
    """P-8: TF-IDF confidence weights of the filtered rewatch ratings (long form)."""
    return recommend.tfidf_confidence(_ratings_table(counts_df, out_dir))
