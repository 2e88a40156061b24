"""Independent SQL (DuckDB dialect) for every registered query.

Written from the semantics, not from the Spark plans: plain windows over whole
users, the quadratic pair join for the repetition count, etc. The tables
``events orders lineitem part customer conversations nation region`` are views.
"""

from __future__ import annotations

SEG_V = """seg_v AS (
  SELECT event_id AS seg_id, user_id, event_type AS video_id,
         epoch_us(ts) // 1000000 AS local_start_time,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS start_point,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + value - 5.0 AS end_point,
         1.0 + CAST(event_id % 3 AS DOUBLE) * 0.5 AS speed
  FROM events)"""

_W_USER = "PARTITION BY user_id ORDER BY local_start_time NULLS LAST, seg_id"
_W_RUN = "PARTITION BY user_id, video_consecutive_id ORDER BY local_start_time NULLS LAST, seg_id"


def sessions_ctes(thresh: float = 3600) -> str:
    """seg_v -> ctx: run id, gap and session id with plain whole-user windows."""
    return f"""{SEG_V},
r1 AS (
  SELECT *, CASE WHEN lag(video_id) OVER (w) IS NULL OR video_id IS NULL
                  OR lag(video_id) OVER (w) <> video_id THEN 1 ELSE 0 END AS chg
  FROM seg_v WHERE user_id IS NOT NULL WINDOW w AS ({_W_USER})),
r2 AS (
  SELECT *, CAST(sum(chg) OVER ({_W_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
            AS video_consecutive_id FROM r1),
r3 AS (
  SELECT *, lead(local_start_time) OVER ({_W_RUN})
            - (local_start_time + (end_point - start_point) / speed) AS gap FROM r2),
ctx AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN gap >= {thresh} THEN 1 ELSE 0 END)
            OVER ({_W_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
            AS session_id FROM r3)"""


def reps_ctes(thresh: float, overlap: float = 5.0) -> str:
    return sessions_ctes(thresh) + f""",
pairs AS (
  SELECT a.user_id, a.video_consecutive_id, a.session_id, count(*) AS n
  FROM ctx a JOIN ctx b
    ON a.user_id = b.user_id AND a.video_consecutive_id = b.video_consecutive_id
   AND a.session_id = b.session_id AND a.seg_id < b.seg_id
   AND greatest(a.start_point, b.start_point) <= least(a.end_point, b.end_point) - {overlap}
  GROUP BY 1, 2, 3),
reps AS (
  SELECT s.user_id, s.video_consecutive_id, s.session_id,
         CAST(coalesce(p.n, 0) AS BIGINT) AS seg_rep_count
  FROM (SELECT DISTINCT user_id, video_consecutive_id, session_id FROM ctx) s
  LEFT JOIN pairs p USING (user_id, video_consecutive_id, session_id))"""


REP_THRESH = 172800  # session threshold for the repetition queries (see FIXTURES)

ROW_IDS = ["view", "purchase"]  # literal list of q_row_filter
PIVOT_ITEMS = list(range(1, 13))  # stated items of q_pivot

SQL: dict[str, str] = {}

SQL["q_explode_sequences"] = """
WITH pv AS (
  SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS video_id, count(*) AS n
  FROM lineitem GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY video_id) - 1 AS seq_pos FROM pv)
SELECT o.o_orderkey AS row_id, o.o_custkey AS user_id, r.seq_pos, r.video_id,
       r.n AS n_segments
FROM orders o LEFT JOIN ranked r ON o.o_orderkey = r.l_orderkey"""

SQL["q_explode_segments"] = """
SELECT o.o_orderkey AS row_id, o.o_custkey AS user_id, CAST(l.l_partkey AS VARCHAR) AS video_id,
       CAST(l.l_linenumber * 10 AS DOUBLE) + l.l_quantity AS end_point,
       CAST(l.l_linenumber * 10 AS DOUBLE) AS start_point, 1.0::DOUBLE AS speed,
       epoch_us(l.l_shipdate) // 1000000 AS local_start_time
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey"""

SQL["q_durations"] = f"""
WITH {SEG_V}
SELECT seg_id, user_id, video_id, end_point - start_point AS raw_duration,
       (end_point - start_point) / speed AS adjusted_duration
FROM seg_v"""

SQL["q_duration_filter"] = f"""
WITH {SEG_V}
SELECT seg_id, (end_point - start_point) / speed AS adjusted_duration
FROM seg_v WHERE (end_point - start_point) / speed >= 5"""

SQL["q_duration_filter_strict"] = f"""
WITH {SEG_V}
SELECT seg_id, (end_point - start_point) / speed AS adjusted_duration
FROM seg_v WHERE (end_point - start_point) / speed > 5"""

SQL["q_row_filter"] = "SELECT event_id AS seg_id, event_type AS video_id FROM events WHERE event_type IN ('view', 'purchase')"

SQL["q_end_times"] = f"""
WITH {SEG_V}, d AS (
  SELECT seg_id, local_start_time, (end_point - start_point) / speed AS adjusted_duration FROM seg_v)
SELECT seg_id, local_start_time + adjusted_duration AS local_end_time,
       make_timestamp(local_start_time * 1000000) AS start_time,
       make_timestamp(CAST(floor((local_start_time + adjusted_duration) * 1000000) AS BIGINT)) AS end_time
FROM d WHERE adjusted_duration >= 5"""

SQL["q_run_ids"] = f"""
WITH {sessions_ctes()}
SELECT seg_id, user_id, video_id, video_consecutive_id FROM ctx"""

SQL["q_gaps"] = f"""
WITH {sessions_ctes()}
SELECT seg_id, video_consecutive_id, gap FROM ctx"""

SQL["q_sessions"] = f"""
WITH {sessions_ctes()}
SELECT seg_id, user_id, video_consecutive_id, gap, session_id FROM ctx"""

SQL["q_repetition"] = f"""
WITH {reps_ctes(REP_THRESH)}
SELECT * FROM reps"""

SQL["q_repetition_dist"] = f"""
WITH {reps_ctes(REP_THRESH)}
SELECT seg_rep_count, count(*) AS frequency,
       count(*) / sum(count(*)) OVER () AS share
FROM reps GROUP BY seg_rep_count"""

SQL["q_sessions_per_user"] = f"""
WITH {reps_ctes(3600)}
SELECT user_id, count(*) AS n_sessions FROM reps GROUP BY user_id"""

SQL["q_session_share"] = f"""
WITH {reps_ctes(3600)}, per AS (SELECT user_id, count(*) AS n FROM reps GROUP BY user_id)
SELECT avg(CASE WHEN n > 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share_over_5,
       avg(CASE WHEN n > 10 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share_over_10 FROM per"""

SQL["q_session2video_inner"] = f"""
WITH {reps_ctes(3600)}
SELECT c.user_id, c.video_consecutive_id, c.session_id, r.seg_rep_count, c.seg_id, c.video_id
FROM ctx c JOIN reps r USING (user_id, video_consecutive_id, session_id)"""

SQL["q_session2video"] = f"""
WITH {reps_ctes(3600)}
SELECT r.user_id, r.video_consecutive_id, r.session_id, r.seg_rep_count, c.seg_id, c.video_id
FROM reps r LEFT JOIN ctx c USING (user_id, video_consecutive_id, session_id)"""

SQL["q_join_violations"] = "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"


# ------------------------------------------------------------------ P-1 cleaning

BLACKLIST_THRESH = 5

SEQ_CTES = """pv AS (
  SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS video_id, count(*) AS n
  FROM lineitem GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY video_id) - 1 AS seq_pos FROM pv),
watched AS (
  SELECT o.o_orderkey AS row_id, o.o_custkey AS user_id, r.seq_pos, r.video_id,
         p.p_brand AS ccid, r.n AS n_seg
  FROM orders o JOIN ranked r ON o.o_orderkey = r.l_orderkey
  JOIN part p ON CAST(p.p_partkey AS VARCHAR) = r.video_id),
watch_counts AS (
  SELECT ccid, user_id, count(*) AS num_watched FROM watched GROUP BY 1, 2),
blacklist AS (
  SELECT DISTINCT user_id FROM watch_counts WHERE num_watched > """ + str(BLACKLIST_THRESH) + """),
clean AS (
  SELECT * FROM watched w WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.user_id = w.user_id))"""

SQL["q_watch_counts"] = f"WITH {SEQ_CTES} SELECT * FROM watch_counts"
SQL["q_blacklist"] = f"WITH {SEQ_CTES} SELECT user_id FROM blacklist"
SQL["q_clean_users"] = f"WITH {SEQ_CTES} SELECT row_id, user_id, seq_pos, video_id, ccid FROM clean"
SQL["q_reduction"] = f"""
WITH {SEQ_CTES},
b AS (SELECT CAST(sum(n_seg) AS BIGINT) AS v FROM watched),
a AS (SELECT CAST(sum(n_seg) AS BIGINT) AS v FROM clean)
SELECT b.v AS segments_before, a.v AS segments_after, 1.0 - a.v / b.v AS reduction,
       1.0 - (b.v / a.v) * 100.0 AS reduction_as_written,
       (SELECT count(*) FROM blacklist) AS n_blacklisted,
       (SELECT count(DISTINCT o_custkey) FROM orders) AS n_users
FROM a, b"""
SQL["q_topn"] = f"""WITH {SEQ_CTES}
SELECT ccid, user_id, num_watched FROM watch_counts ORDER BY num_watched DESC, ccid, user_id LIMIT 20"""
SQL["q_nunique"] = f"""WITH {SEQ_CTES}
SELECT video_id, count(DISTINCT user_id) AS n_user_id, count(DISTINCT ccid) AS n_ccid
FROM watched WHERE ccid = 'Brand#13' GROUP BY video_id"""
SQL["q_id_map_left"] = f"""WITH {SEQ_CTES}
SELECT o.o_orderkey AS row_id, o.o_custkey AS user_id, r.seq_pos, r.video_id, p.p_brand AS ccid
FROM orders o LEFT JOIN ranked r ON o.o_orderkey = r.l_orderkey
LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = r.video_id"""
SQL["q_concept_map"] = f"""WITH {SEQ_CTES},
cm AS (SELECT DISTINCT p_type AS concept_id, p_brand AS ccid FROM part)
SELECT w.video_id, w.ccid, cm.concept_id
FROM (SELECT DISTINCT video_id, ccid FROM watched) w JOIN cm ON w.ccid = cm.ccid"""
SQL["q_concept_field"] = f"""WITH {SEQ_CTES},
cm AS (SELECT DISTINCT p_type AS concept_id, p_brand AS ccid FROM part)
SELECT w.video_id, cm.concept_id, list_extract(string_split(cm.concept_id, ' '), -1) AS field
FROM (SELECT DISTINCT video_id, ccid FROM watched) w JOIN cm ON w.ccid = cm.ccid"""
SQL["q_translate"] = """
SELECT c.c_custkey, n.n_name, r.r_name
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""

SQL["q_line_aligned"] = """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, CAST(o_orderkey AS VARCHAR) AS order_key,
       o_orderpriority AS priority FROM orders"""

# ------------------------------------------------------------------ P-4 lecture sequences

CLICK_V = """click_v AS (
  SELECT event_id, user_id, epoch_us(ts) // 1000 AS "timestamp",
         (CASE WHEN event_type IN ('view', 'click') THEN 'l' ELSE 'q' END)
         || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS VARCHAR) AS item_id
  FROM events),
lectures AS (SELECT * FROM click_v WHERE starts_with(item_id, 'l')),
dedup AS (
  SELECT event_id, user_id, "timestamp", item_id FROM (
    SELECT *, lag(item_id) OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS prev,
              row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS rn
    FROM lectures)
  WHERE rn = 1 OR prev IS NULL OR item_id IS NULL OR prev <> item_id)"""


def describe_sql(src: str, col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return f"""SELECT round(count({x}), 6)::DOUBLE AS count, round(avg({x}), 6) AS mean,
       round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min,
       round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50,
       round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM {src}"""


SQL["q_lecture_filter"] = f"WITH {CLICK_V} SELECT * FROM lectures"
SQL["q_dedupe"] = f"WITH {CLICK_V} SELECT * FROM dedup"
SQL["q_seq_len_describe"] = f"""WITH {CLICK_V},
per AS (SELECT user_id, count(item_id) AS n FROM dedup GROUP BY user_id)
{describe_sql("per", "n")}"""
SQL["q_monotonic"] = f"""WITH {CLICK_V},
l AS (SELECT *, lag("timestamp") OVER (ORDER BY event_id) AS pt,
             lag(user_id) OVER (ORDER BY event_id) AS pu FROM click_v),
c AS (SELECT CAST(sum(CASE WHEN "timestamp" < pt THEN 1 ELSE 0 END) AS BIGINT) AS timestamp_breaks,
             CAST(sum(CASE WHEN user_id < pu THEN 1 ELSE 0 END) AS BIGINT) AS user_id_breaks FROM l)
SELECT timestamp_breaks, user_id_breaks, timestamp_breaks = 0 AS timestamp_sorted,
       user_id_breaks = 0 AS user_id_sorted FROM c"""

# ------------------------------------------------------------------ P-5 courses

COURSE_V = """course_v AS (
  SELECT CAST(conv_id AS VARCHAR) AS id, turn AS pos,
         (CASE WHEN length(text) % 3 = 0 THEN 'V_' ELSE 'E_' END) || CAST(turn AS VARCHAR) AS resource_id
  FROM conversations),
nv AS (
  SELECT id, sum(CASE WHEN starts_with(resource_id, 'V_') THEN 1 ELSE 0 END) AS nv
  FROM course_v GROUP BY id)"""

SQL["q_alternating_asis"] = f"""WITH {COURSE_V}
SELECT id, CASE WHEN nv = 0 THEN NULL ELSE nv = 1 END AS alternating FROM nv"""
SQL["q_alternating_intent"] = f"""WITH {COURSE_V},
l AS (SELECT id, starts_with(resource_id, 'V_') AS v,
             lag(starts_with(resource_id, 'V_')) OVER (PARTITION BY id ORDER BY pos) AS pv FROM course_v),
g AS (SELECT id, sum(CASE WHEN v THEN 1 ELSE 0 END) AS nv, bool_or(v AND coalesce(pv, false)) AS adj
      FROM l GROUP BY id)
SELECT id, CASE WHEN nv = 0 THEN NULL WHEN adj THEN false ELSE true END AS alternating FROM g"""
SQL["q_course_info_alternating"] = f"""WITH {COURSE_V}
SELECT id, count(*) AS rsc_count FROM course_v
WHERE id IN (SELECT id FROM nv WHERE nv = 1) GROUP BY id HAVING count(*) > 0"""

# ------------------------------------------------------------------ P-6 exploration

GAP_QS = [round(0.75 + 0.01 * i, 2) for i in range(25)]  # .75 to .99 by .01 (includes .94)
_QLIST = "[" + ", ".join(f"{q}::DOUBLE" for q in GAP_QS) + "]"

BY_VIDEO = SEG_V + """,
fs AS (
  SELECT *, end_point - start_point AS raw_duration, (end_point - start_point) / speed AS adjusted_duration,
         local_start_time + (end_point - start_point) / speed AS local_end_time
  FROM seg_v WHERE (end_point - start_point) / speed >= 5),
bv AS (
  SELECT *, lead(local_start_time) OVER (PARTITION BY user_id, video_id ORDER BY seg_id)
            - local_end_time AS gap FROM fs),
bv2 AS (
  SELECT *,
    CAST(coalesce(sum(CASE WHEN gap >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, video_id
         ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session_id,
    CAST(coalesce(sum(CASE WHEN ((CAST(floor(gap) AS BIGINT) % 86400) + 86400) % 86400 >= 3600
         THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, video_id
         ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session_id_seconds
  FROM bv)"""

SQL["q_sessions_by_video"] = f"""WITH {BY_VIDEO}
SELECT seg_id, user_id, video_id, gap, session_id, session_id_seconds FROM bv2"""
SQL["q_segment_index"] = f"""WITH {BY_VIDEO}
SELECT seg_id, user_id, video_id,
       row_number() OVER (PARTITION BY user_id, video_id ORDER BY local_start_time, seg_id) - 1 AS segment_idx
FROM fs"""
SQL["q_session_counts"] = f"""WITH {BY_VIDEO}
SELECT user_id, video_id, count(DISTINCT session_id) AS session_count FROM bv2 GROUP BY 1, 2"""
SQL["q_session_count_rows"] = f"""WITH {BY_VIDEO},
per AS (SELECT user_id, video_id, count(DISTINCT session_id) AS session_count FROM bv2 GROUP BY 1, 2)
SELECT b.seg_id, b.user_id, b.video_id, p.session_count FROM bv2 b LEFT JOIN per p USING (user_id, video_id)"""
SQL["q_session_summary"] = f"""WITH {BY_VIDEO},
per AS (SELECT user_id, video_id, count(DISTINCT session_id) AS n, max(session_id) AS m FROM bv2 GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS total_sessions, count(*) AS n_groups, max(m) AS max_session_id FROM per"""
SQL["q_distinct_sessions"] = f"""WITH {BY_VIDEO}
SELECT DISTINCT user_id, video_id, session_id, 'C_' || upper(video_id) AS ccid FROM bv2"""
SQL["q_gap_quantiles"] = f"""WITH {BY_VIDEO}
SELECT unnest({_QLIST}) AS q, round(unnest(quantile_cont(gap, {_QLIST})), 6) AS gap FROM bv2"""
SQL["q_gap_describe"] = f"""WITH {BY_VIDEO}
{describe_sql("bv2", "gap")}"""
SQL["q_min_rows"] = f"""WITH {BY_VIDEO}
SELECT seg_id, user_id, video_id, gap FROM bv2 WHERE gap = (SELECT min(gap) FROM bv2)"""
SQL["q_float_tolerance"] = f"""WITH {BY_VIDEO},
t AS (SELECT seg_id, raw_duration, local_end_time - local_start_time AS diff FROM fs)
SELECT seg_id, raw_duration, diff FROM t WHERE diff <> raw_duration AND abs(raw_duration - diff) < 1e-7"""


def histogram_sql(expr: str, bins: int, head: int | None = None) -> str:
    where = f"WHERE g.bin <= {head}" if head else ""
    return f"""WITH {SEG_V},
h AS (SELECT {expr} AS x FROM seg_v WHERE {expr} > 0),
st AS (SELECT min(x) AS mn, max(x) AS mx, count(*) AS n FROM h),
b AS (SELECT CAST(least({bins}, greatest(1, ceil((x - mn) / ((mx - mn) / {bins}.0)))) AS BIGINT) AS bin
      FROM h, st),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
g AS (SELECT range AS bin FROM range(1, {bins + 1}))
SELECT g.bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n, coalesce(c.n, 0) / (SELECT n FROM st) AS share
FROM g LEFT JOIN c USING (bin) {where}"""


SQL["q_histogram"] = histogram_sql("end_point - start_point", 500)
SQL["q_histogram_head"] = histogram_sql("(end_point - start_point) / speed", 400, 10)
SQL["q_short_share"] = f"""WITH {SEG_V}
SELECT avg(CASE WHEN end_point - start_point < 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS negative_share,
       avg(CASE WHEN end_point - start_point < 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS short_raw_share,
       avg(CASE WHEN (end_point - start_point) / speed < 5 THEN 1.0 ELSE 0.0 END)::DOUBLE
         AS short_adjusted_share
FROM seg_v"""
SQL["q_unmapped_share"] = f"""WITH {SEQ_CTES}
SELECT avg(CASE WHEN p.p_partkey IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS unmapped_share
FROM ranked r LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = r.video_id"""
SQL["q_uniqueness"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""

# ------------------------------------------------------------------ intervals

SQL["q_segments_per_video"] = f"""WITH {SEG_V}
SELECT user_id, video_id, count(*) AS n_segments FROM seg_v GROUP BY 1, 2"""
SQL["q_coverage"] = f"""WITH {SEG_V},
ps AS (SELECT user_id, video_id, start_point AS s, max(end_point) AS e
       FROM seg_v WHERE end_point > start_point GROUP BY 1, 2, 3),
pm AS (SELECT *, max(e) OVER (PARTITION BY user_id, video_id ORDER BY s
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ps)
SELECT user_id, video_id, round(sum(greatest(0.0, e - greatest(s, coalesce(m, s)))), 6) AS covered
FROM pm GROUP BY 1, 2"""
SQL["q_coverage_fraction"] = f"""WITH {SEG_V},
len AS (SELECT video_id, max(end_point) AS length FROM seg_v GROUP BY 1),
ps AS (SELECT user_id, video_id, start_point AS s, max(end_point) AS e
       FROM seg_v WHERE end_point > start_point GROUP BY 1, 2, 3),
pm AS (SELECT *, max(e) OVER (PARTITION BY user_id, video_id ORDER BY s
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ps),
c AS (SELECT user_id, video_id, sum(greatest(0.0, e - greatest(s, coalesce(m, s)))) AS covered FROM pm GROUP BY 1, 2)
SELECT user_id, video_id, round(covered / nullif(length, 0), 9) AS fraction FROM c LEFT JOIN len USING (video_id)"""
SQL["q_mean_speed"] = f"""WITH {SEG_V}
SELECT user_id, video_id,
       round(sum(speed * (end_point - start_point)) / sum(end_point - start_point), 9) AS mean_speed
FROM seg_v WHERE end_point - start_point > 0 GROUP BY 1, 2"""

# ------------------------------------------------------------------ recommendation

RATE_CTES = """rate_v AS (
  SELECT o_custkey AS "user", l_suppkey AS item, count(*) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
ratings AS (SELECT * FROM rate_v WHERE rating > 1),
filt AS (SELECT * FROM ratings WHERE "user" IN
         (SELECT "user" FROM ratings GROUP BY "user" HAVING count(rating) > 1))"""

SQL["q_ratings"] = f"WITH {RATE_CTES} SELECT * FROM ratings"
SQL["q_density"] = f"""WITH {RATE_CTES}
SELECT count(*) AS n_rows, count(DISTINCT "user") AS n_users, count(DISTINCT item) AS n_items,
       count(*) / (count(DISTINCT item) * count(DISTINCT "user")) AS density FROM filt"""
SQL["q_folds"] = f"""WITH {RATE_CTES}
SELECT "user", item, rating,
       CAST(CAST('0x' || substr(md5(CAST("user" AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 5 AS BIGINT) AS fold,
       item = arg_min(item, md5(CAST("user" AS VARCHAR) || '|' || CAST(item AS VARCHAR) || '|42'))
              OVER (PARTITION BY "user") AS is_test
FROM filt"""
SQL["q_tfidf"] = f"""WITH {RATE_CTES},
n AS (SELECT count(DISTINCT "user") AS n FROM filt),
df AS (SELECT item, count(DISTINCT "user") AS df FROM filt GROUP BY item),
w AS (SELECT f."user", f.item,
             f.rating * (ln((CAST(1.0 AS DOUBLE) + n.n) / (CAST(1.0 AS DOUBLE) + df.df)) + 1.0) AS w
      FROM filt f JOIN df USING (item), n),
nm AS (SELECT "user", sqrt(sum(w * w)) AS norm FROM w GROUP BY "user")
SELECT w."user", w.item, round(w.w / nm.norm, 9) AS weight FROM w JOIN nm USING ("user")"""
SQL["q_pivot"] = f"""WITH {RATE_CTES}
SELECT "user", {', '.join(f'max(CASE WHEN item = {i} THEN rating END) AS "{i}"' for i in PIVOT_ITEMS)}
FROM filt GROUP BY "user" """

# Popular lists: per fold, items by their number of train rows; the user's own train items go.
POPULAR_CTES = RATE_CTES + """,
folded AS (
  SELECT "user", item,
         CAST(CAST('0x' || substr(md5(CAST("user" AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 5 AS BIGINT) AS fold,
         item = arg_min(item, md5(CAST("user" AS VARCHAR) || '|' || CAST(item AS VARCHAR) || '|42'))
                OVER (PARTITION BY "user") AS is_test
  FROM filt),
pop AS (
  SELECT f.fold, t.item, count(*) AS c
  FROM (SELECT DISTINCT fold FROM folded) f, folded t
  WHERE NOT (t.is_test AND t.fold = f.fold) GROUP BY 1, 2),
best AS (
  SELECT * FROM (SELECT fold, item, row_number() OVER (PARTITION BY fold ORDER BY c DESC, item) AS r FROM pop)),
lists AS (
  SELECT u."user", u.fold, b.item, row_number() OVER (PARTITION BY u."user", u.fold ORDER BY b.r) AS rank
  FROM (SELECT DISTINCT "user", fold FROM folded WHERE is_test) u JOIN best b ON u.fold = b.fold
  WHERE NOT EXISTS (SELECT 1 FROM folded t WHERE t."user" = u."user" AND t.item = b.item AND NOT t.is_test)),
recs AS (SELECT 'Popular' AS algorithm, fold, "user", item, rank FROM lists WHERE rank <= 100)"""
SQL["q_recs_popular"] = f"WITH {POPULAR_CTES} SELECT algorithm, fold, \"user\", item, rank FROM recs"
SQL["q_metrics_fixed"] = f"""WITH {POPULAR_CTES},
top AS (SELECT r.*, EXISTS (SELECT 1 FROM folded t WHERE t.is_test AND t."user" = r."user" AND t.item = r.item) AS hit
        FROM recs r WHERE rank <= 10),
per AS (
  SELECT "user", count(*) AS n, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS good,
         sum(CASE WHEN hit THEN 1.0::DOUBLE / greatest(1.0::DOUBLE, log2(rank::DOUBLE)) ELSE 0 END) AS dcg_library,
         sum(CASE WHEN hit THEN 1.0::DOUBLE / log2(rank::DOUBLE + 1) ELSE 0 END) AS dcg_textbook
  FROM top GROUP BY 1)
SELECT 'Popular' AS algorithm, d.discount,
       round(avg(CASE WHEN d.discount = 'library' THEN dcg_library ELSE dcg_textbook END), 9) AS ndcg,
       round(avg(good / n), 9) AS precision, round(avg(good / 1.0::DOUBLE), 9) AS recall
FROM per, (VALUES ('library'), ('textbook')) d(discount) GROUP BY d.discount"""

# Neighbourhood recommenders: similarities and scores in whole 1e-9.
KNN_CTES = RATE_CTES + """,
folded AS MATERIALIZED (
  SELECT "user", item, rating,
         CAST(CAST('0x' || substr(md5(CAST("user" AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 5 AS BIGINT) AS fold,
         item = arg_min(item, md5(CAST("user" AS VARCHAR) || '|' || CAST(item AS VARCHAR) || '|42'))
                OVER (PARTITION BY "user") AS is_test
  FROM filt),
train AS MATERIALIZED (
  SELECT g.fold AS g, f."user", f.item, f.rating, f.fold = g.fold AS asked
  FROM folded f, (SELECT DISTINCT fold FROM folded) g WHERE NOT (f.is_test AND f.fold = g.fold))"""


def _knn(name: str, algorithm: str, least: int) -> str:
    """Lists of one algorithm as CTEs. p: points (whose similarity counts), c: features."""
    p, c = ("item", '"user"') if algorithm == "ItemItem" else ('"user"', "item")
    return f"""
mean_{name} AS MATERIALIZED (SELECT g, {p} AS p, avg(rating) AS m FROM train GROUP BY 1, 2),
dev_{name} AS MATERIALIZED (SELECT t.g, t.{p} AS p, t.{c} AS c, t.rating - s.m AS dev, t.asked FROM train t JOIN mean_{name} s ON s.g = t.g AND s.p = t.{p}),
norm_{name} AS (SELECT g, p, sqrt(sum(dev * dev)) AS n FROM dev_{name} GROUP BY 1, 2),
unit_{name} AS MATERIALIZED (SELECT d.g, d.p, d.c, d.dev / n.n AS x, d.asked FROM dev_{name} d JOIN norm_{name} n ON n.g = d.g AND n.p = d.p WHERE n.n > 0),
sim_{name} AS MATERIALIZED (
  SELECT a.g, a.p AS a, b.p AS b, CAST(floor(sum(a.x * b.x) * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS s
  FROM unit_{name} a JOIN unit_{name} b ON b.g = a.g AND b.c = a.c
  WHERE a.p <> b.p {"" if algorithm == "ItemItem" else "AND a.asked"} GROUP BY 1, 2, 3),
near_{name} AS (
  SELECT s.g, s.a, d.c, s.s, d.dev, row_number() OVER (PARTITION BY s.g, s.a, d.c ORDER BY s.s DESC, s.b) AS r
  FROM sim_{name} s JOIN dev_{name} d ON d.g = s.g AND d.p = s.b WHERE s.s > {least} {"AND d.asked" if algorithm == "ItemItem" else ""}),
sums_{name} AS (SELECT g, a, c, sum(s * dev) / sum(s) AS w FROM near_{name} WHERE r <= 10 GROUP BY 1, 2, 3),
score_{name} AS (
  SELECT n.g, n.a AS {p}, n.c AS {c}, CAST(floor((m.m + n.w) * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS score
  FROM sums_{name} n JOIN mean_{name} m ON m.g = n.g AND m.p = n.a
  LEFT JOIN dev_{name} t ON t.g = n.g AND t.p = n.a AND t.c = n.c WHERE t.p IS NULL),
list_{name} AS (
  SELECT '{algorithm}' AS algorithm, g AS fold, "user", item, rank, score / 1e9::DOUBLE AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY g, "user" ORDER BY score DESC, item) AS rank FROM score_{name}) WHERE rank <= 100)"""


SQL["q_item_knn"] = f"WITH {KNN_CTES}, {_knn('ii', 'ItemItem', 1000)} SELECT * FROM list_ii"
SQL["q_user_knn"] = f"WITH {KNN_CTES}, {_knn('uu', 'UserUser', 0)} SELECT * FROM list_uu"
SQL["q_metrics_knn"] = f"""WITH {KNN_CTES}, {_knn('ii', 'ItemItem', 1000)}, {_knn('uu', 'UserUser', 0)},
top AS (
  SELECT r.*, t.item IS NOT NULL AS hit
  FROM (SELECT * FROM list_ii UNION ALL SELECT * FROM list_uu) r
  LEFT JOIN folded t ON t.is_test AND t."user" = r."user" AND t.item = r.item WHERE r.rank <= 10),
per AS (
  SELECT algorithm, "user", count(*) AS n, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS good,
         sum(CASE WHEN hit THEN 1.0::DOUBLE / greatest(1.0::DOUBLE, log2(rank::DOUBLE)) ELSE 0 END) AS dcg_library,
         sum(CASE WHEN hit THEN 1.0::DOUBLE / log2(rank::DOUBLE + 1) ELSE 0 END) AS dcg_textbook
  FROM top GROUP BY 1, 2)
SELECT algorithm, d.discount,
       round(avg(CASE WHEN d.discount = 'library' THEN dcg_library ELSE dcg_textbook END), 9) AS ndcg,
       round(avg(good / n), 9) AS precision, round(avg(good / 1.0::DOUBLE), 9) AS recall
FROM per, (VALUES ('library'), ('textbook')) d(discount) GROUP BY algorithm, d.discount"""

# Factor models: factors are hashes of (id, feature, seed) in [0, 1).
def _factors(col: str, seed: int, rank: int) -> str:
    return ", ".join(f"""CAST(CAST('0x' || substr(md5(CAST({col} AS VARCHAR) || '|{f}|{seed}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS f{f}"""
                     for f in range(rank))


SQL["q_top_factors"] = f"""WITH {RATE_CTES},
u AS (SELECT "user", {_factors('"user"', 42, 4)} FROM (SELECT DISTINCT "user" FROM filt)),
i AS (SELECT item, {_factors("item", 7, 4)} FROM (SELECT DISTINCT item FROM filt)),
s AS (SELECT u."user", i.item, CAST(floor((u.f0 * i.f0 + u.f1 * i.f1 + u.f2 * i.f2 + u.f3 * i.f3) * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS s
      FROM u, i WHERE NOT EXISTS (SELECT 1 FROM filt t WHERE t."user" = u."user" AND t.item = i.item))
SELECT "user", item, rank, s / 1e9::DOUBLE AS score
FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY s DESC, item) AS rank FROM s) WHERE rank <= 20"""

_CELLS = ("00", "01", "02", "11", "12", "22")
SQL["q_als_step"] = f"""WITH {RATE_CTES},
y AS (SELECT item, {_factors("item", 42, 3)} FROM (SELECT DISTINCT item FROM filt)),
g AS (SELECT {", ".join(f"sum(f{c[0]} * f{c[1]}) AS g{c}" for c in _CELLS)} FROM y),
n AS (
  SELECT r."user", {", ".join(f"40.0::DOUBLE * sum(r.rating * y.f{c[0]} * y.f{c[1]}) AS a{c}" for c in _CELLS)},
         {", ".join(f"sum((1.0::DOUBLE + 40.0::DOUBLE * r.rating) * y.f{f}) AS b{f}" for f in range(3))}
  FROM filt r JOIN y USING (item) GROUP BY r."user"),
m AS (SELECT "user", {", ".join(f"a{c} + g{c}" + (" + 0.1::DOUBLE" if c[0] == c[1] else "") + f" AS m{c}" for c in _CELLS)}, b0, b1, b2 FROM n, g),
d AS (SELECT *, m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02) AS det FROM m)
SELECT "user",
  round((b0 * (m11 * m22 - m12 * m12) - m01 * (b1 * m22 - m12 * b2) + m02 * (b1 * m12 - m11 * b2)) / det, 9) AS x0,
  round((m00 * (b1 * m22 - m12 * b2) - b0 * (m01 * m22 - m12 * m02) + m02 * (m01 * b2 - b1 * m02)) / det, 9) AS x1,
  round((m00 * (m11 * b2 - b1 * m12) - m01 * (m01 * b2 - b1 * m02) + b0 * (m01 * m12 - m11 * m02)) / det, 9) AS x2
FROM d"""

# Pipelines give what the operators give.
SQL["q_p1_p2_clean_layout"] = f"""WITH {SEQ_CTES}
SELECT CAST(user_id AS VARCHAR) AS user_id, video_id, ccid, n_seg AS n_segments FROM clean"""
SQL["q_p3_sessions"] = SQL["q_repetition"]
SQL["q_p4_lectures"] = SQL["q_dedupe"]
SQL["q_p5_courses"] = SQL["q_course_info_alternating"]
SQL["q_p6_exploration"] = SQL["q_session_counts"]
SQL["q_p8_confidence"] = SQL["q_tfidf"]
