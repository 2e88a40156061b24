"""Registered queries: one per operator group of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
test tables. Column names match the SQL in ``revisit.plans.oracle``. The ``q_p`` queries
run whole pipelines, with their files in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.operators import counts, courses, factors, intervals, neighbours, quality, recommend, report, sequences
from revisit.plans import pipelines
from revisit.plans.oracle import PIVOT_ITEMS, REP_THRESH, ROW_IDS
from revisit.schemas import ADJUSTED_BINS, GAP_QUANTILES, MIN_ITEMS, RAW_BINS, REP_COL, RUN_COL, SESSION_COL
from revisit.session import ensure_checkpoint_dir, prepare
from revisit.sources import io, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ explode

@register
def q_explode_sequences(spark, sf_dir):
    prepare(spark)
    seqs = sequences.explode_sequences(views.seq_view(spark, sf_dir), keep=("row_id", "user_id"))
    n = F.when(F.col("seq.segment").isNotNull(), F.size("seq.segment")).cast("bigint")
    return seqs.select("row_id", "user_id", "seq_pos", "video_id", n.alias("n_segments"))


@register
def q_explode_segments(spark, sf_dir):
    prepare(spark)
    seqs = sequences.explode_sequences(views.seq_view(spark, sf_dir), keep=("row_id", "user_id"))
    segs = sequences.explode_segments(seqs, keep=("row_id", "user_id", "video_id"))
    return segs.drop("seg_pos")


# ------------------------------------------------------------------ durations

@register
def q_durations(spark, sf_dir):
    prepare(spark)
    d = sequences.with_durations(views.seg_view(spark, sf_dir))
    return d.select("seg_id", "user_id", "video_id", "raw_duration", "adjusted_duration")


@register
def q_duration_filter(spark, sf_dir):
    prepare(spark)
    d = sequences.filter_duration(sequences.with_durations(views.seg_view(spark, sf_dir)), 5.0)
    return d.select("seg_id", "adjusted_duration")


@register
def q_duration_filter_strict(spark, sf_dir):
    """B7, the strict form (``>``)."""
    prepare(spark)
    d = sequences.filter_duration(sequences.with_durations(views.seg_view(spark, sf_dir)), 5.0, inclusive=False)
    return d.select("seg_id", "adjusted_duration")


@register
def q_row_filter(spark, sf_dir):
    """Rows whose key is in a literal list."""
    prepare(spark)
    return counts.filter_ids(views.seg_view(spark, sf_dir), "video_id", ROW_IDS).select("seg_id", "video_id")


@register
def q_end_times(spark, sf_dir):
    prepare(spark)
    d = sequences.filter_duration(sequences.with_durations(views.seg_view(spark, sf_dir)), 5.0)
    return sequences.with_end_times(d).select("seg_id", "local_end_time", "start_time", "end_time")


# ------------------------------------------------------------------ runs, gaps, sessions

def _ctx(spark, sf_dir, thresh=3600):
    return sequences.sessionize(views.seg_view(spark, sf_dir), session_thresh=thresh)


@register
def q_run_ids(spark, sf_dir):
    prepare(spark)
    return _ctx(spark, sf_dir).select("seg_id", "user_id", "video_id", RUN_COL)


@register
def q_gaps(spark, sf_dir):
    prepare(spark)
    return _ctx(spark, sf_dir).select("seg_id", RUN_COL, "gap")


@register
def q_sessions(spark, sf_dir):
    prepare(spark)
    return _ctx(spark, sf_dir).select("seg_id", "user_id", RUN_COL, "gap", SESSION_COL)


# ------------------------------------------------------------------ repetition

def _reps(spark, sf_dir, thresh):
    return intervals.repetition_counts(_ctx(spark, sf_dir, thresh))


@register
def q_repetition(spark, sf_dir):
    prepare(spark)
    return _reps(spark, sf_dir, REP_THRESH)


@register
def q_repetition_dist(spark, sf_dir):
    prepare(spark)
    return counts.value_counts(_reps(spark, sf_dir, REP_THRESH), REP_COL)


@register
def q_sessions_per_user(spark, sf_dir):
    prepare(spark)
    return counts.sessions_per_user(_reps(spark, sf_dir, 3600))


@register
def q_session_share(spark, sf_dir):
    prepare(spark)
    return counts.share_over(counts.sessions_per_user(_reps(spark, sf_dir, 3600)))


@register
def q_session2video_inner(spark, sf_dir):
    """Segments joined many-to-one to their session's count (inner)."""
    prepare(spark)
    ctx = _ctx(spark, sf_dir, 3600)
    keys = ["user_id", RUN_COL, SESSION_COL]
    joined = counts.join_validated(ctx.select(*keys, "seg_id", "video_id"),
                                   intervals.repetition_counts(ctx), keys, "inner", "many_to_one")
    return joined.select(*keys, REP_COL, "seg_id", "video_id")


@register
def q_session2video(spark, sf_dir):
    prepare(spark)
    ctx = _ctx(spark, sf_dir, 3600)
    reps = intervals.repetition_counts(ctx)
    keys = ["user_id", RUN_COL, SESSION_COL]
    return counts.join_validated(reps, ctx.select(*keys, "seg_id", "video_id"), keys, "left", "one_to_many").select(
        *keys, REP_COL, "seg_id", "video_id")


@register
def q_join_violations(spark, sf_dir):
    """Keys that would break a many-to-one join of orders to their lines."""
    prepare(spark)
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return counts.join_violations(o, views.table(spark, sf_dir, "lineitem").select("l_orderkey"), ["l_orderkey"], "many_to_one")


# ------------------------------------------------------------------ P-1 cleaning

BLACKLIST_THRESH = 5  # 20 flags nobody in the test tables (see FIXTURES)
NUNIQUE_CCID = "Brand#13"


def _watched(spark, sf_dir):
    """Exploded sequences mapped to ccids (rows without a ccid are lost on purpose)."""
    seqs = sequences.explode_sequences(views.seq_view(spark, sf_dir), keep=("row_id", "user_id"))
    return counts.map_ids(seqs, views.video_ccid_view(spark, sf_dir), "video_id")


def _watch_counts(spark, sf_dir):
    return counts.count_interactions(_watched(spark, sf_dir), "ccid", "user_id", "num_watched")


@register
def q_watch_counts(spark, sf_dir):
    prepare(spark)
    return _watch_counts(spark, sf_dir)


@register
def q_blacklist(spark, sf_dir):
    prepare(spark)
    return counts.blacklist_users(_watch_counts(spark, sf_dir), "num_watched", BLACKLIST_THRESH)


@register
def q_clean_users(spark, sf_dir):
    prepare(spark)
    watched = _watched(spark, sf_dir)
    bl = counts.blacklist_users(counts.count_interactions(watched, "ccid"), "num_watched", BLACKLIST_THRESH)
    return counts.remove_users(watched, bl).select("row_id", "user_id", "seq_pos", "video_id", "ccid")


@register
def q_reduction(spark, sf_dir):
    prepare(spark)
    seqs = sequences.explode_sequences(views.seq_view(spark, sf_dir), keep=("row_id", "user_id"))
    rows = counts.map_ids(counts.segment_count(seqs), views.video_ccid_view(spark, sf_dir), "video_id", how="left")
    return counts.reduction_report(rows, rep_thresh=BLACKLIST_THRESH)


@register
def q_topn(spark, sf_dir):
    prepare(spark)
    return counts.top_by_count(_watch_counts(spark, sf_dir), "num_watched", ["ccid", "user_id"], 20)


@register
def q_nunique(spark, sf_dir):
    prepare(spark)
    w = _watched(spark, sf_dir).filter(F.col("ccid") == NUNIQUE_CCID).select("video_id", "user_id", "ccid")
    return counts.nunique_per_group(w, "video_id")


@register
def q_id_map_left(spark, sf_dir):
    prepare(spark)
    seqs = sequences.explode_sequences(views.seq_view(spark, sf_dir), keep=("row_id", "user_id"))
    m = counts.map_ids(seqs, views.video_ccid_view(spark, sf_dir), "video_id", how="left")
    return m.select("row_id", "user_id", "seq_pos", "video_id", "ccid")


@register
def q_concept_map(spark, sf_dir):
    prepare(spark)
    w = _watched(spark, sf_dir).select("video_id", "ccid").distinct()
    return counts.join_dimension(w, views.concept_ccid_view(spark, sf_dir), "ccid").select(
        "video_id", "ccid", "concept_id")


@register
def q_concept_field(spark, sf_dir):
    """Video -> concept -> field, the field named by a dictionary of the concepts."""
    prepare(spark)
    w = _watched(spark, sf_dir).select("video_id", "ccid").distinct()
    concepts = counts.join_dimension(w, views.concept_ccid_view(spark, sf_dir), "ccid")
    return counts.join_dimension(concepts, views.concept_field_view(spark, sf_dir), "concept_id", "left").select(
        "video_id", "concept_id", "field")


@register
def q_translate(spark, sf_dir):
    """Translate keys of a growing table through two small dictionaries."""
    prepare(spark)
    cust = views.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nation = views.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = views.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name"))
    named = counts.join_dimension(cust, nation, "n_nationkey", "left")
    return counts.join_dimension(named, region, "n_regionkey", "left").select("c_custkey", "n_name", "r_name")


# ------------------------------------------------------------------ P-4 lecture sequences

def _lectures(spark, sf_dir):
    return sequences.filter_prefix(views.click_view(spark, sf_dir), "l", "item_id")


@register
def q_lecture_filter(spark, sf_dir):
    prepare(spark)
    return _lectures(spark, sf_dir)


@register
def q_dedupe(spark, sf_dir):
    prepare(spark)
    return sequences.dedupe_consecutive(_lectures(spark, sf_dir))


@register
def q_seq_len_describe(spark, sf_dir):
    prepare(spark)
    per_user = sequences.dedupe_consecutive(_lectures(spark, sf_dir)).groupBy("user_id").agg(
        F.count("item_id").alias("n"))
    d = report.describe(per_user, "n")
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@register
def q_monotonic(spark, sf_dir):
    prepare(spark)
    ev = views.click_view(spark, sf_dir)
    return quality.monotonic_breaks(ev, ["timestamp", "user_id"], "event_id")


# ------------------------------------------------------------------ P-5 courses

@register
def q_alternating_asis(spark, sf_dir):
    prepare(spark)
    return courses.alternation_flags(views.course_view(spark, sf_dir), mode="as_written")


@register
def q_alternating_intent(spark, sf_dir):
    prepare(spark)
    return courses.alternation_flags(views.course_view(spark, sf_dir), mode="intent")


@register
def q_course_info_alternating(spark, sf_dir):
    prepare(spark)
    res = views.course_view(spark, sf_dir)
    flags = courses.alternation_flags(res, mode="as_written").filter(F.col("alternating").isNotNull())
    info = res.groupBy("id").agg(F.count(F.lit(1)).alias("rsc_count")).filter(F.col("rsc_count") > 0)
    return counts.keep_keys(info, flags.filter(F.col("alternating")).select("id"), "id")


# ------------------------------------------------------------------ P-6 exploration

GAP_QS = GAP_QUANTILES  # .75 to .99 by .01 (includes .94)


def _filtered_segments(spark, sf_dir):
    d = sequences.filter_duration(sequences.with_durations(views.seg_view(spark, sf_dir)), 5.0)
    return sequences.with_end_times(d)


def _by_video(spark, sf_dir):
    return sequences.sessions_by_video(
        _filtered_segments(spark, sf_dir),
        modes={SESSION_COL: "total", "session_id_seconds": "seconds_component"})


@register
def q_sessions_by_video(spark, sf_dir):
    prepare(spark)
    return _by_video(spark, sf_dir).select("seg_id", "user_id", "video_id", "gap", SESSION_COL,
                                           "session_id_seconds")


@register
def q_segment_index(spark, sf_dir):
    prepare(spark)
    return sequences.segment_index(_filtered_segments(spark, sf_dir)).select(
        "seg_id", "user_id", "video_id", "segment_idx")


@register
def q_session_counts(spark, sf_dir):
    prepare(spark)
    return _by_video(spark, sf_dir).groupBy("user_id", "video_id").agg(
        F.countDistinct(SESSION_COL).alias("session_count"))


@register
def q_session_count_rows(spark, sf_dir):
    """Every segment with its (user, video) session count."""
    prepare(spark)
    bv = _by_video(spark, sf_dir)
    per = bv.groupBy("user_id", "video_id").agg(F.countDistinct(SESSION_COL).alias("session_count"))
    return counts.with_group_count(bv.select("seg_id", "user_id", "video_id"), per, ["user_id", "video_id"])


@register
def q_session_summary(spark, sf_dir):
    prepare(spark)
    per = _by_video(spark, sf_dir).groupBy("user_id", "video_id").agg(
        F.countDistinct(SESSION_COL).alias("n"), F.max(SESSION_COL).alias("m"))
    return per.agg(F.sum("n").cast("bigint").alias("total_sessions"),
                   F.count(F.lit(1)).alias("n_groups"), F.max("m").alias("max_session_id"))


@register
def q_distinct_sessions(spark, sf_dir):
    prepare(spark)
    rows = counts.map_ids(_by_video(spark, sf_dir), views.event_ccid_view(spark, sf_dir), "video_id", how="left")
    return rows.select("user_id", "video_id", SESSION_COL, "ccid").dropDuplicates()


@register
def q_gap_quantiles(spark, sf_dir):
    prepare(spark)
    q = report.quantiles(_by_video(spark, sf_dir), "gap", GAP_QS)
    return q.select("q", F.round("value", 6).alias("gap"))


@register
def q_gap_describe(spark, sf_dir):
    prepare(spark)
    d = report.describe(_by_video(spark, sf_dir), "gap")
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@register
def q_min_rows(spark, sf_dir):
    prepare(spark)
    return counts.rows_at_min(_by_video(spark, sf_dir), "gap").select("seg_id", "user_id", "video_id", "gap")


@register
def q_float_tolerance(spark, sf_dir):
    prepare(spark)
    return sequences.float_tolerance_rows(_filtered_segments(spark, sf_dir)).select(
        "seg_id", "raw_duration", "diff")


@register
def q_histogram(spark, sf_dir):
    prepare(spark)
    d = sequences.filter_positive(sequences.with_durations(views.seg_view(spark, sf_dir)), "raw_duration")
    return report.histogram(d, "raw_duration", RAW_BINS)


@register
def q_histogram_head(spark, sf_dir):
    prepare(spark)
    d = sequences.filter_positive(sequences.with_durations(views.seg_view(spark, sf_dir)),
                                  "adjusted_duration")
    return report.histogram(d, "adjusted_duration", ADJUSTED_BINS).filter(F.col("bin") <= 10)


@register
def q_short_share(spark, sf_dir):
    prepare(spark)
    d = sequences.with_durations(views.seg_view(spark, sf_dir))
    return quality.conditional_shares(d, {
        "negative_share": F.col("raw_duration") < 0,
        "short_raw_share": F.col("raw_duration") < 5,
        "short_adjusted_share": F.col("adjusted_duration") < 5})


@register
def q_unmapped_share(spark, sf_dir):
    prepare(spark)
    seqs = sequences.explode_sequences(views.seq_view(spark, sf_dir), keep=("row_id", "user_id"))
    seqs = seqs.filter(F.col("video_id").isNotNull())
    return quality.unmapped_share(seqs, views.video_ccid_view(spark, sf_dir), "video_id")


@register
def q_uniqueness(spark, sf_dir):
    prepare(spark)
    return quality.key_violations(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------------ intervals

@register
def q_segments_per_video(spark, sf_dir):
    prepare(spark)
    return intervals.segments_per_video(views.seg_view(spark, sf_dir))


@register
def q_coverage(spark, sf_dir):
    prepare(spark)
    c = intervals.coverage(views.seg_view(spark, sf_dir))
    return c.select("user_id", "video_id", F.round("covered", 6).alias("covered"))


@register
def q_coverage_fraction(spark, sf_dir):
    """I3 with the length of each video: the fraction of it that a user watched."""
    prepare(spark)
    seg = views.seg_view(spark, sf_dir)
    c = intervals.coverage(seg, video_length=views.video_length_view(seg))
    return c.select("user_id", "video_id", F.round("fraction", 9).alias("fraction"))


@register
def q_mean_speed(spark, sf_dir):
    prepare(spark)
    s = intervals.weighted_speed(views.seg_view(spark, sf_dir))
    return s.select("user_id", "video_id", F.round("mean_speed", 9).alias("mean_speed"))


# ------------------------------------------------------------------ P-7 / P-8 recommendation

def _ratings(spark, sf_dir):
    raw = views.rate_view(spark, sf_dir)
    return recommend.rewatch_ratings(raw, user="user", item="item", count_col="rating")


def _filtered_ratings(spark, sf_dir):
    return recommend.filter_min_items(_ratings(spark, sf_dir))


def _once(df, name):
    """``df`` written and read back: it feeds several jobs, which would each compute it again."""
    path = _folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filtered_once(spark, sf_dir):
    """``_filtered_ratings`` for queries of several jobs; both sides of the filter read the written ratings."""
    return _once(recommend.filter_min_items(_once(_ratings(spark, sf_dir), "ratings")), "filtered")


@register
def q_ratings(spark, sf_dir):
    prepare(spark)
    return _ratings(spark, sf_dir)


@register
def q_density(spark, sf_dir):
    prepare(spark)
    return counts.density(_filtered_ratings(spark, sf_dir))


@register
def q_folds(spark, sf_dir):
    prepare(spark)
    return recommend.user_folds(_ratings(spark, sf_dir), min_items=MIN_ITEMS)


@register
def q_tfidf(spark, sf_dir):
    prepare(spark)
    t = recommend.tfidf_confidence(_filtered_ratings(spark, sf_dir))
    return t.select("user", "item", F.round("weight", 9).alias("weight"))


@register
def q_pivot(spark, sf_dir):
    """J9 over a stated list of items (the long form of all items is q_ratings)."""
    prepare(spark)
    return recommend.pivot_ratings(_filtered_ratings(spark, sf_dir), PIVOT_ITEMS)


def _popular(spark, sf_dir):
    folded = recommend.user_folds(_ratings(spark, sf_dir), min_items=MIN_ITEMS)
    return folded, recommend.popular_recommend(folded, n=100, candidates=150)


@register
def q_recs_popular(spark, sf_dir):
    """the top 100 unrated items of every test user, by popularity."""
    prepare(spark)
    return _popular(spark, sf_dir)[1]


@register
def q_metrics_fixed(spark, sf_dir):
    """J8 and D11 on lists that do not depend on a random fit, in both discount modes."""
    prepare(spark)
    folded, recs = _popular(spark, sf_dir)
    test = folded.filter("is_test").select("user", "item")
    modes = [recommend.mean_metrics(recommend.topn_metrics(recs, test, k=10, discount=m)).withColumn("discount", F.lit(m))
             for m in ("library", "textbook")]
    out = modes[0].unionByName(modes[1])
    return out.select("algorithm", "discount", *[F.round(c, 9).alias(c) for c in ("ndcg", "precision", "recall")])


def _folded(spark, sf_dir):
    """Folds of the filtered ratings, written: several branches read them."""
    ensure_checkpoint_dir(spark)
    return recommend.user_folds(_once(_ratings(spark, sf_dir), "ratings"), min_items=MIN_ITEMS).checkpoint()


@register
def q_item_knn(spark, sf_dir):
    """The top 100 unrated items of every test user, by the 10 nearest of the user's items."""
    prepare(spark)
    return neighbours.knn_recommend(_folded(spark, sf_dir), by="item")


@register
def q_user_knn(spark, sf_dir):
    """The top 100 unrated items of every test user, by the 10 nearest users that rated them."""
    prepare(spark)
    return neighbours.knn_recommend(_folded(spark, sf_dir), by="user")


@register
def q_metrics_knn(spark, sf_dir):
    """J8 and D11 of both neighbourhood recommenders, in both discount modes."""
    prepare(spark)
    folded = _folded(spark, sf_dir)
    recs = neighbours.knn_recommend(folded, by="item").unionByName(neighbours.knn_recommend(folded, by="user")).checkpoint()
    test = folded.filter("is_test").select("user", "item")
    modes = [recommend.mean_metrics(recommend.topn_metrics(recs, test, k=10, discount=m)).withColumn("discount", F.lit(m))
             for m in ("library", "textbook")]
    out = modes[0].unionByName(modes[1])
    return out.select("algorithm", "discount", *[F.round(c, 9).alias(c) for c in ("ndcg", "precision", "recall")])


@register
def q_top_factors(spark, sf_dir):
    """Exact top 20 unrated items of every user by the inner product of given factors."""
    prepare(spark)
    r = _filtered_once(spark, sf_dir).select(F.col("user").alias("u"), F.col("item").alias("i"))
    top = factors.top_products(factors.hashed_factors(r, "u", 4), factors.hashed_factors(r, "i", 4, seed=7), r, n=20, block=32)
    return top.select(F.col("u").alias("user"), F.col("i").alias("item"), "rank", "score")


@register
def q_als_step(spark, sf_dir):
    """One half-step of implicit ALS from a start that depends on the ids, three features."""
    prepare(spark)
    r = _filtered_once(spark, sf_dir).select(F.col("user").alias("u"), F.col("item").alias("i"), "rating")
    x = factors.als_half_step(r, factors.hashed_factors(r, "i", 3), weight="rating")
    return x.select(F.col("u").alias("user"), *[F.round(F.col("vec")[f], 9).alias(f"x{f}") for f in range(3)])


@register
def q_als(spark, sf_dir):
    prepare(spark)
    folded = _once(recommend.user_folds(_filtered_once(spark, sf_dir)), "folds")
    return recommend.als_recommend(folded)


@register
def q_metrics(spark, sf_dir):
    prepare(spark)
    folded = _once(recommend.user_folds(_filtered_once(spark, sf_dir)), "folds")
    recs = recommend.als_recommend(folded)
    test = folded.filter("is_test").select("user", "item")
    return recommend.mean_metrics(recommend.topn_metrics(recs, test, k=10))


# ------------------------------------------------------------------ whole pipelines (P-1 to P-6, P-8; A1-A7)

def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@register
def q_p1_p2_clean_layout(spark, sf_dir):
    """P-1 and P-2 over files: raw lists as JSON, the id map as TSV, the blacklist as CSV, the
    clean table laid out by user and read back (A1-A7)."""
    prepare(spark)
    d = _folder(spark, "p1")
    views.seq_view(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), "seq").write.json(f"{d}/uv.json")
    views.video_ccid_view(spark, sf_dir).write.option("sep", "\t").csv(f"{d}/map.txt")
    res = pipelines.clean_repeaters(io.read_json(spark, f"{d}/uv.json"), io.read_tsv(spark, f"{d}/map.txt"), d, BLACKLIST_THRESH)
    pipelines.layout_by_user(res.clean, f"{d}/parts", 8)
    back = io.read_parquet(spark, f"{d}/parts")
    return back.select("user_id", "video_id", "ccid", F.size("seq.segment").cast("bigint").alias("n_segments"))


@register
def q_line_aligned(spark, sf_dir):
    """Two line-aligned text files, written in order with different numbers of parts,
    zipped by line number."""
    prepare(spark)
    d = _folder(spark, "lines")
    orders = views.table(spark, sf_dir, "orders")
    for name, col, parts in (("keys", F.col("o_orderkey").cast("string"), 8), ("names", F.col("o_orderpriority"), 3)):
        sides = orders.repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey")
        sides.select(col).write.text(f"{d}/{name}")
    return io.read_line_aligned(spark, f"{d}/keys", f"{d}/names", ("order_key", "priority"))


@register
def q_p3_sessions(spark, sf_dir):
    prepare(spark)
    return pipelines.session_repetition(views.seg_view(spark, sf_dir), _folder(spark, "p3"), REP_THRESH).repetitions


@register
def q_p4_lectures(spark, sf_dir):
    prepare(spark)
    return pipelines.lecture_sequences(views.click_view(spark, sf_dir), _folder(spark, "p4"))[0]


@register
def q_p5_courses(spark, sf_dir):
    prepare(spark)
    c = views.course_view(spark, sf_dir).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "resource_id"))).alias("r"))
    ext = c.select("id", F.lit("").alias("about"), F.size("r").cast("bigint").alias("rsc_count"),
                   F.transform("r", lambda x: F.struct(x["resource_id"].alias("resource_id"))).alias("resource"),
                   F.size("r").cast("bigint").alias("Number of users"))
    return pipelines.courses_alternating_videos(ext).select("id", "rsc_count")


@register
def q_p6_exploration(spark, sf_dir):
    prepare(spark)
    return pipelines.segment_exploration(views.seg_view(spark, sf_dir), views.event_ccid_view(spark, sf_dir),
                                         out_dir=_folder(spark, "p6"))["session_counts"]


@register
def q_p7_evaluation(spark, sf_dir):
    """P-7 over files: mean metrics of all three algorithms. The rows of ItemItem and UserUser
    are those of q_metrics_knn; ALS starts at random, so the table has no SQL."""
    prepare(spark)
    c = views.rate_view(spark, sf_dir).select(
        F.col("user").alias("user_id"), F.col("item").alias("ccid"), F.col("rating").alias("num_watched"))
    return pipelines.rewatch_recommendation(c, _folder(spark, "p7"))["means"]


@register
def q_p8_confidence(spark, sf_dir):
    prepare(spark)
    c = views.rate_view(spark, sf_dir).select(
        F.col("user").alias("user_id"), F.col("item").alias("ccid"), F.col("rating").alias("num_watched"))
    t = pipelines.rewatch_confidence(c, _folder(spark, "p8"))
    return t.select("user", "item", F.round("weight", 9).alias("weight"))
