"""Views over the driver's test tables in the reference's data model.

The reference's own inputs (watch logs, click logs, courses) are not public;
these views give the same shapes from the generated tables. Each takes the
session and the folder that holds ``<table>.parquet``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.functions.columns import epoch_micros, epoch_seconds, floor_div


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat segments from ``events``: one per event, ``seg_id`` = event id."""
    ev = table(spark, sf_dir, "events")
    k = F.from_json("props", "k double")["k"]  # one parse per row, schema given
    return ev.select(
        F.col("event_id").alias("seg_id"),
        "user_id",
        F.col("event_type").alias("video_id"),
        epoch_seconds("ts").alias("local_start_time"),
        k.alias("start_point"),
        (k + F.col("value") - F.lit(5.0)).alias("end_point"),
        (F.lit(1.0) + (F.col("event_id") % 3).cast("double") * F.lit(0.5)).alias("speed"),
    )


def seq_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested sequences from ``orders`` left join ``lineitem``; one row per order.

    ``seq`` holds one element per distinct part (``video_id``), its ``segment`` one
    struct per line. Both arrays are sorted, as collect order is not fixed.
    An order without lines gets an empty list.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 10).cast("double")
    lines = li.select(
        "l_orderkey",
        F.col("l_partkey").cast("string").alias("video_id"),
        F.struct((start + F.col("l_quantity")).alias("end_point"), start.alias("start_point"),
                 F.lit(1.0).alias("speed"),
                 epoch_seconds("l_shipdate").alias("local_start_time")).alias("seg"))
    # Cluster once on the order key: both aggregations (order, part) and (order)
    # and the join with orders then reuse that partitioning (one shuffle).
    lines = lines.repartition("l_orderkey")
    per_video = lines.groupBy("l_orderkey", "video_id").agg(
        F.array_sort(F.collect_list("seg")).alias("segment"))
    per_order = per_video.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("video_id", "segment"))).alias("seq"))
    j = o.join(per_order, o["o_orderkey"] == per_order["l_orderkey"], "left")
    empty = F.array().cast(per_order.schema["seq"].dataType)
    return j.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"),
                    F.coalesce("seq", empty).alias("seq"))


def video_ccid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video-to-ccid map: ``part`` key as ``video_id``, brand as ``ccid``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("video_id"), F.col("p_brand").alias("ccid"))


def concept_ccid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept map: distinct (type, brand) of ``part`` as (concept_id, ccid)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("concept_id"), F.col("p_brand").alias("ccid")).distinct()


def concept_field_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary of concepts: the field is the last word of a concept's name."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("concept_id")).distinct().select(
        "concept_id", F.substring_index("concept_id", " ", -1).alias("field"))


def event_ccid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video-to-ccid map of the segments made from ``events`` (see ``seg_view``)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("video_id")).distinct().select(
        "video_id", F.concat(F.lit("C_"), F.upper("video_id")).alias("ccid"))


def video_length_view(segments: DataFrame) -> DataFrame:
    """Length per video: the largest end point that any segment reaches."""
    return segments.groupBy("video_id").agg(F.max("end_point").alias("length"))


def rate_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw interaction counts: user = customer, item = supplier, rating = lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.groupBy(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item")).agg(
        F.count(F.lit(1)).alias("rating"))


def click_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click log from ``events``: lecture items ``l*`` for views and clicks, ``q*`` otherwise."""
    ev = table(spark, sf_dir, "events")
    k = F.from_json("props", "k bigint")["k"]
    kind = F.when(F.col("event_type").isin("view", "click"), F.lit("l")).otherwise(F.lit("q"))
    return ev.select(
        "event_id", "user_id",
        floor_div(epoch_micros("ts"), 1000).alias("timestamp"),
        F.concat(kind, (k % 3).cast("string")).alias("item_id"))


def course_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course resources from ``conversations``: one row per (course, position).

    ``resource_id`` is ``V_<turn>`` when the text length is a multiple of 3, else ``E_<turn>``.
    """
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.length("text") % 3 == 0, F.lit("V_")).otherwise(F.lit("E_"))
    return c.select(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("pos"),
                    F.concat(kind, F.col("turn").cast("string")).alias("resource_id"))

