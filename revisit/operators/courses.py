"""Course structure: do video resources alternate with other resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.schemas import VIDEO_PREFIX


def explode_resources(courses: DataFrame, course: str = "id", min_count: int = 0) -> DataFrame:
    """B10 + B1: courses with ``rsc_count > min_count``, one row per resource with its list position."""
    c = courses.filter(F.col("rsc_count") > min_count)
    return c.select(course, F.posexplode("resource").alias("pos", "r")).select(
        course, F.col("pos").cast("bigint").alias("pos"), F.col("r.resource_id").alias("resource_id"))


def alternation_flags(resources: DataFrame, course: str = "id", pos: str = "pos",
                      rid: str = "resource_id", mode: str = "as_written",
                      prefix: str = VIDEO_PREFIX, out: str = "alternating") -> DataFrame:
    """Tri-state flag per course; NULL when the course has no video resource.

    ``mode="as_written"``: the reference's loop never resets its flag, so it is
    true exactly when the course has one video resource and false from the
    second on. ``mode="intent"``: false when two video resources are adjacent
    (positions ``p`` and ``p + 1``), else true. ``pos`` must be the dense list
    position (as from ``posexplode``); adjacency is an equi-join on
    ``(course, pos + 1)``, which spreads even a huge course over all tasks.
    """
    is_v = F.col(rid).startswith(prefix)
    counts = resources.groupBy(course).agg(F.sum(F.when(is_v, 1).otherwise(0)).alias("__nv"))
    if mode == "as_written":
        flag = F.when(F.col("__nv") == 0, F.lit(None).cast("boolean")).otherwise(F.col("__nv") == 1)
        return counts.select(course, flag.alias(out))
    if mode != "intent":
        raise ValueError(f"unknown mode {mode!r}")
    v = resources.filter(is_v).select(course, pos)
    nxt = v.select(F.col(course).alias("__c"), (F.col(pos) - 1).alias("__p"))
    adjacent = (v.join(nxt, (F.col(course) == F.col("__c")) & (F.col(pos) == F.col("__p")))
                .select(course).distinct().withColumn("__adj", F.lit(True)))
    j = counts.join(adjacent, course, "left")
    flag = (F.when(F.col("__nv") == 0, F.lit(None).cast("boolean"))
            .when(F.col("__adj"), F.lit(False)).otherwise(F.lit(True)))
    return j.select(course, flag.alias(out))
