"""Schemas of the reference's data model (nested watch sequences and flat tables)."""

from pyspark.sql import types as T

SEGMENT = T.StructType([
    T.StructField("end_point", T.DoubleType()),
    T.StructField("start_point", T.DoubleType()),
    T.StructField("speed", T.DoubleType()),
    T.StructField("local_start_time", T.LongType()),
])

SEQ_ITEM = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("segment", T.ArrayType(SEGMENT)),
])

# user_id, seq: ARRAY<STRUCT<video_id, segment: ARRAY<SEGMENT>>>
SEQ_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("seq", T.ArrayType(SEQ_ITEM)),
])

# The cleaned table: one row per element of the list, ``seq`` a struct, with the ids that
# were added and the place of the element in its source (see pipelines.clean_repeaters).
EXPLODED_ITEM = T.StructType([
    T.StructField("segment", T.ArrayType(SEGMENT)),
    T.StructField("video_id", T.StringType()),
])

EXPLODED_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("seq", EXPLODED_ITEM),
    T.StructField("video_id", T.StringType()),
    T.StructField("ccid", T.StringType()),
])

PLACE_SCHEMA = T.StructType([
    T.StructField("src_row", T.LongType()),
    T.StructField("seq_pos", T.LongType()),
])

SEGMENTS_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("video_id", T.StringType()),
    T.StructField("end_point", T.DoubleType()),
    T.StructField("local_start_time", T.LongType()),
    T.StructField("speed", T.DoubleType()),
    T.StructField("start_point", T.DoubleType()),
])

VIDEO_CCID_SCHEMA = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("ccid", T.StringType()),
])

CONCEPT_CCID_SCHEMA = T.StructType([
    T.StructField("concept_id", T.StringType()),
    T.StructField("ccid", T.StringType()),
])

CLICK_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("cursor_time", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("user_answer", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("user_id", T.LongType()),
])

COURSE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("about", T.StringType()),
    T.StructField("rsc_count", T.LongType()),
    T.StructField("resource", T.ArrayType(T.StructType([
        T.StructField("resource_id", T.StringType())]))),
    T.StructField("Number of users", T.LongType()),
])

# Column names used across the sequence operators.
RUN_COL = "video_consecutive_id"
GAP_COL = "gap"
SESSION_COL = "session_id"
REP_COL = "seg_rep_count"

# ---------------------------------------------------------------------------
# These must equal the reference's for the same results.
SESSION_THRESH_S = 3600      # a gap >= this many seconds starts a new session
DURATION_THRESH_S = 5        # keep segments whose adjusted duration is >= this
OVERLAP_THRESH_S = 5         # two segments repeat when they overlap by >= this
REPEAT_THRESH = 20           # a user watching one item more often than this is blacklisted
MIN_REWATCH = 1              # a watch count above this is a rewatch
MIN_ITEMS = 1                # users need more rewatched items than this to be evaluated
USER_PARTS = 30              # parts of the by-user layout
LECTURE_PREFIX = "l"         # item ids of lecture events start with this
VIDEO_PREFIX = "V_"          # resource ids of videos start with this
N_RECS = 100                 # recommendations per user
METRIC_K = 10                # cutoff of nDCG, precision and recall
N_FOLDS = 5                  # user folds, one held-out item per user
ALS_RANK = 50                # features of the implicit factorization
RAW_BINS = 500               # histogram bins of raw durations
ADJUSTED_BINS = 400          # histogram bins of adjusted durations
SHARE_THRESHOLDS = (5, 10)   # shares of users with more sessions than these
GAP_QUANTILES = [round(0.75 + 0.01 * i, 2) for i in range(25)]  # .75 to .99 by .01
