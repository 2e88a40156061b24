"""Joins to id maps, interaction counts, blacklists and scalar reports.

All grouped counts use partial (map-side) aggregation, so a hot key is reduced
on every mapper before the shuffle. Joins to dimension tables go through
``join_dimension``, which broadcasts only when the optimizer's size estimate is
under a bound and otherwise leaves the choice to Spark (sort-merge join, or a
runtime switch to broadcast by AQE once real sizes are known).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.schemas import REPEAT_THRESH, SHARE_THRESHOLDS

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of ``df`` in bytes, or None if unavailable."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - e.g. Spark Connect has no JVM handle
        return None


def join_dimension(facts: DataFrame, dim: DataFrame, on, how: str = "inner",
                   max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Join a dimension; broadcast it only when its estimated size is under the bound."""
    size = estimated_bytes(dim)
    if size is not None and size <= max_broadcast_bytes and how in ("inner", "left", "left_semi", "left_anti"):
        dim = F.broadcast(dim)
    return facts.join(dim, on, how)


def map_ids(sequences: DataFrame, id_map: DataFrame, key: str = "video_id", how: str = "inner") -> DataFrame:
    """Join rows to an id map on ``key`` only.

    ``inner`` loses rows without a mapping (on purpose, as in the reference);
    ``left`` keeps them with NULLs. NULL keys never match.
    """
    return join_dimension(sequences, id_map, key, how)


def count_interactions(rows: DataFrame, item: str = "ccid", user: str = "user_id",
                       out: str = "num_watched") -> DataFrame:
    """Rows per (item, user); NULL keys drop out."""
    return (rows.dropna(subset=[item, user]).groupBy(item, user)
            .agg(F.count(F.lit(1)).alias(out)))


def blacklist_users(counts: DataFrame, count_col: str = "num_watched", rep_thresh: int = REPEAT_THRESH,
                    user: str = "user_id") -> DataFrame:
    """Distinct users with any count ``> rep_thresh``."""
    return counts.filter(F.col(count_col) > rep_thresh).select(user).distinct()


def remove_users(rows: DataFrame, blacklist: DataFrame, user: str = "user_id") -> DataFrame:
    """Drop rows of listed users. A NULL user stays (as ``~isin`` keeps it)."""
    return rows.join(blacklist.select(user), user, "left_anti")


def keep_keys(rows: DataFrame, keys: DataFrame, on) -> DataFrame:
    """C4: keep rows whose key is listed."""
    return rows.join(keys, on, "left_semi")


def top_by_count(counts: DataFrame, count_col: str, keys: Sequence[str], n: int) -> DataFrame:
    """F1 + F3: ``n`` rows with the highest count; ties broken by the keys."""
    return counts.orderBy(F.col(count_col).desc(), *[F.col(k).asc() for k in keys]).limit(n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value, and its share of all rows.

    The reference's value_counts on a Series normalizes, so its "frequency" is a
    share; both columns are given. The total is a scalar subquery over the grouped
    table; both uses share the grouped table's exchange.
    """
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("frequency"))
    return g.withColumn("share", F.col("frequency") / g.agg(F.sum("frequency")).scalar())


def sessions_per_user(reps: DataFrame, user: str = "user_id", out: str = "n_sessions") -> DataFrame:
    """Distinct sessions per (user, run), summed per user.

    ``reps`` has one row per (user, run, session), so this is a count per user.
    """
    return reps.groupBy(user).agg(F.count(F.lit(1)).alias(out))


def share_over(per_user: DataFrame, col: str = "n_sessions", thresholds: Sequence[int] = SHARE_THRESHOLDS) -> DataFrame:
    """Share of rows whose ``col`` is above each threshold. One row."""
    return per_user.agg(*[F.avg(F.when(F.col(col) > t, 1.0).otherwise(0.0)).alias(f"share_over_{t}")
                          for t in thresholds])


def segment_count(rows: DataFrame) -> DataFrame:
    """Exploded sequences with ``n_segments`` (NULL for a NULL list) in place of the
    nested list, so later steps carry one number per row."""
    n = F.when(F.col("seq.segment").isNotNull(), F.size("seq.segment"))
    return rows.withColumn("n_segments", n.cast("bigint")).drop("seq")


def reduction_report(rows: DataFrame, blacklist: DataFrame | None = None, user: str = "user_id", item: str = "ccid",
                     rep_thresh: int = REPEAT_THRESH) -> DataFrame:
    """D3 + D15 + D10: segments before / after removing blacklisted users. One row.

    ``rows``: the exploded sequences of all users left-joined to the id map, with
    ``n_segments`` (see ``segment_count``); a row without an ``item`` has no mapping and
    counts for the users only. ``reduction`` = 1 - after / before;
    ``reduction_as_written`` is the reference's printed ``1 - 100 * before / after``.

    Without a given ``blacklist`` everything comes from one pass: segments and watches per
    (user, item), then per user whether any count is above ``rep_thresh``, then totals.
    """
    if blacklist is None:
        per_item = rows.groupBy(user, item).agg(F.sum("n_segments").alias("s"), F.count(item).alias("c"))
        per_user = per_item.groupBy(user).agg(
            F.sum(F.when(F.col(item).isNotNull(), F.col("s"))).alias("s"),
            (F.max("c") > rep_thresh).alias("listed"))
    else:
        sums = rows.groupBy(user).agg(F.sum(F.when(F.col(item).isNotNull(), F.col("n_segments"))).alias("s"),
                                      F.count(item).alias("c"))
        listed = blacklist.select(user).withColumn("listed", F.lit(True))
        per_user = sums.join(listed, user, "left").withColumn(
            "listed", F.coalesce("listed", F.lit(False)) & (F.col("c") > 0))
    known = F.col(user).isNotNull()
    listed = F.col("listed") & known
    bef, aft = F.col("segments_before"), F.col("segments_after")
    one = per_user.agg(F.sum("s").cast("bigint").alias("segments_before"),
                       F.sum(F.when(~listed, F.col("s"))).cast("bigint").alias("segments_after"),
                       F.count(F.when(listed, 1)).alias("n_blacklisted"),
                       F.count(F.when(known, 1)).alias("n_users"))
    return one.select(bef, aft, (F.lit(1.0) - aft / bef).alias("reduction"),
                      (F.lit(1.0) - (bef / aft) * F.lit(100.0)).alias("reduction_as_written"),
                      "n_blacklisted", "n_users")


def density(ratings: DataFrame, user: str = "user", item: str = "item",
            approx_rsd: float | None = None) -> DataFrame:
    """D14 + D10: rows, distinct users and items, and rows / (items * users). One row.

    With ``approx_rsd`` the distinct counts use ``approx_count_distinct``
    (HyperLogLog++, one mergeable sketch, that relative standard deviation).
    """
    if approx_rsd:
        nu, ni = F.approx_count_distinct(user, approx_rsd), F.approx_count_distinct(item, approx_rsd)
    else:
        nu, ni = F.countDistinct(user), F.countDistinct(item)
    return ratings.agg(F.count(F.lit(1)).alias("n_rows"),
                       nu.alias("n_users"),
                       ni.alias("n_items")).withColumn(
        "density", F.col("n_rows") / (F.col("n_items") * F.col("n_users")))


def nunique_per_group(df: DataFrame, group: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-NULL count of every other column per group."""
    cols = [c for c in (cols or df.columns) if c != group]
    return df.groupBy(group).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def rows_at_min(df: DataFrame, col: str) -> DataFrame:
    """F5 + D7: rows whose ``col`` equals its global minimum (a scalar subquery)."""
    m = df.agg(F.min(col)).scalar()
    return df.filter(F.col(col) == m)


_SIDES = {"one_to_many": (True, False), "many_to_one": (False, True), "one_to_one": (True, True)}


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself; running it fails if a key (NULLs included) occurs twice.

    Grouped by the key, which a side that is an aggregate on that key already is, so it
    costs that side no shuffle of its own.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest) if rest else F.lit(1)).alias("__row"))
    message = F.concat(F.lit(f"keys {keys} are not unique: "), F.to_json(F.struct(*keys)))
    g = g.filter(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return g.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def join_violations(left: DataFrame, right: DataFrame, keys, validate: str = "many_to_one") -> DataFrame:
    """Key values that break a join's cardinality rule (empty when it holds)."""
    keys = list(keys)
    bad = None
    for side, must in zip((left, right), _SIDES[validate]):
        if must:
            v = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(*keys)
            bad = v if bad is None else bad.unionByName(v).distinct()
    return bad


def join_validated(left: DataFrame, right: DataFrame, keys, how: str = "inner",
                   validate: str = "many_to_one") -> DataFrame:
    """Join with an enforced cardinality rule: running it fails if the rule is
    broken. ``validate`` is ``one_to_many`` (keys unique on the left), ``many_to_one``
    (unique on the right) or ``one_to_one``.
    """
    keys = list(keys)
    left, right = (unique_rows(side, keys) if must else side for side, must in zip((left, right), _SIDES[validate]))
    return left.join(right, keys, how)


def filter_ids(df: DataFrame, col: str, ids) -> DataFrame:
    """Keep rows whose explicit row key is in a literal list."""
    return df.filter(F.col(col).isin(list(ids)))


def with_group_count(rows: DataFrame, counts_df: DataFrame, keys) -> DataFrame:
    """Attach a per-group aggregate back to every row of the group (by key join)."""
    return rows.join(counts_df, list(keys), "left")
