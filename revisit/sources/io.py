"""Scans, sinks and layout.

Schemas are always given (never inferred) for JSON and CSV: inference reads
the data twice and can disagree between files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.operators.scan import pinned
from revisit.schemas import EXPLODED_SCHEMA, PLACE_SCHEMA, SEQ_SCHEMA, USER_PARTS, VIDEO_CCID_SCHEMA


# ---------------------------------------------------------------- scans

def read_json(spark: SparkSession, path: str, schema: T.StructType = SEQ_SCHEMA) -> DataFrame:
    """A1: JSON-lines scan with an explicit schema (nested sequences, course entities)."""
    return spark.read.schema(schema).json(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = VIDEO_CCID_SCHEMA) -> DataFrame:
    """A2: headerless tab-separated file with the given column names and types."""
    return spark.read.schema(schema).option("sep", "\t").option("header", "false").csv(path)


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A3: Parquet scan of a directory, one part or several (gzip parts included)."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def read_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines of text files with their number ``line`` (0-based, over all files in the order
    of their paths; lines end with LF or CRLF, an empty file has none).

    Big files are read in splits like any text: lines are numbered inside each split (a
    window no larger than a split), and the number of lines before a split is a running sum
    over one row per split, then one row per file. One scan, one shuffle of the lines.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    d = text.select(F.regexp_replace("value", "\r$", "").alias(name), F.col("_metadata.file_path").alias("__file"),
                    F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"))
    keys = ["__file", "__split"]
    rows = pinned(d.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys).orderBy("__at"))), d.columns)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("__file")
    splits = rows.groupBy(*keys).agg(F.max("__pos").alias("__n")).withColumns({
        "__above": F.coalesce(F.sum("__n").over(before(of_file.orderBy("__split"))), F.lit(0)), "__of_file": F.sum("__n").over(of_file)})
    files = splits.groupBy("__file").agg(F.max("__of_file").alias("__n"))
    files = files.select("__file", F.coalesce(F.sum("__n").over(before(Window.partitionBy().orderBy("__file"))), F.lit(0)).alias("__first"))
    offsets = splits.join(files, "__file").select(*keys, (F.col("__first") + F.col("__above")).alias("__before"))
    return rows.join(offsets, keys).select((F.col("__before") + F.col("__pos") - 1).cast("bigint").alias("line"), name)


def read_line_aligned(spark: SparkSession, left: str, right: str,
                      names: tuple[str, str] = ("field_zh", "field_en")) -> DataFrame:
    """Text files zipped by line number into a two-column dictionary; a line that one
    side lacks is NULL there."""
    return read_lines(spark, left, names[0]).join(read_lines(spark, right, names[1]), "line", "full")


# ---------------------------------------------------------------- sinks

def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = "gzip",
                  partition_by: Sequence[str] | None = None) -> None:
    """A4: Parquet sink, gzip by default as in the reference."""
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def _conform(col: Column, src: T.DataType, dst: T.DataType, path: str) -> Column:
    if isinstance(dst, T.StructType):
        if not isinstance(src, T.StructType):
            raise TypeError(f"{path}: expected struct, found {src.simpleString()}")
        have = {f.name: f.dataType for f in src.fields}
        missing = [f.name for f in dst.fields if f.name not in have]
        if missing:
            raise TypeError(f"{path}: missing fields {missing}")
        return F.when(col.isNotNull(), F.struct(*[
            _conform(col[f.name], have[f.name], f.dataType, f"{path}.{f.name}").alias(f.name)
            for f in dst.fields]))
    if isinstance(dst, T.ArrayType):
        if not isinstance(src, T.ArrayType):
            raise TypeError(f"{path}: expected array, found {src.simpleString()}")
        if isinstance(dst.elementType, (T.StructType, T.ArrayType)):
            return F.when(col.isNotNull(), F.transform(
                col, lambda x: _conform(x, src.elementType, dst.elementType, f"{path}[]")))
        return col.cast(dst)
    if isinstance(src, (T.StructType, T.ArrayType, T.MapType)):
        raise TypeError(f"{path}: expected {dst.simpleString()}, found {src.simpleString()}")
    return col.cast(dst)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A5: select ``schema``'s columns by name, nested fields by name, cast to its types.

    Raises ``TypeError`` when a column or nested field is missing or of another shape.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise TypeError(f"missing columns {missing}")
    return df.select(*[_conform(F.col(f"`{f.name}`"), have[f.name], f.dataType, f.name).alias(f.name)
                       for f in schema.fields])


def sequence_schema(df: DataFrame) -> T.StructType:
    """The pinned schema that fits ``df``: raw lists (``seq`` an array) or the cleaned,
    exploded table (``seq`` a struct), with the place columns if it has them."""
    if isinstance(df.schema["seq"].dataType, T.ArrayType):
        return SEQ_SCHEMA
    return T.StructType(EXPLODED_SCHEMA.fields + [f for f in PLACE_SCHEMA.fields if f.name in df.columns])


def write_nested(df: DataFrame, path: str, schema: T.StructType | None = None, **kw) -> None:
    """A5: Parquet sink with a pinned nested schema (by default the one that fits)."""
    write_parquet(conform(df, schema or sequence_schema(df)), path, **kw)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    """CSV sink (with header, no index column)."""
    df.write.mode(mode).option("header", str(header).lower()).csv(path)


# ---------------------------------------------------------------- layout

SLICE_ITEMS = 2_000_000  # rows, list elements and segments that a task sorts at once


def user_slices(df: DataFrame, n: int, items: int = SLICE_ITEMS) -> int:
    """Into how many slices of users each of ``n`` parts is cut so that one holds some ``items``
    rows, list elements and segments (one job that reads the lengths of the lists)."""
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    held = F.lit(1).cast("bigint")
    if "seq" in df.columns:
        if isinstance(df.schema["seq"].dataType, T.ArrayType):
            inner = F.aggregate("seq.segment", F.lit(0).cast("bigint"), lambda n, x: n + 1 + size(x))
            held = held + F.coalesce(inner, F.lit(0))
        else:
            held = held + size(F.col("seq.segment"))
    total = df.agg(F.sum(held)).first()[0] or 0
    return max(1, -(-total // (n * items)))


def partition_by_user(df: DataFrame, n: int = USER_PARTS, user: str = "user_id", slices: int = 1) -> DataFrame:
    """Hash-partition on the user into ``n`` parts, sorted by user inside each part.

    Written out, every user lies in exactly one part file. With ``slices`` a part is that many
    files of different users, each sorted by a task of its own: file ``j`` belongs to part ``j % n``,
    which has the same users whatever the number of slices.
    """
    return df.repartition(n * slices, user).sortWithinPartitions(user)


def write_bucketed(df: DataFrame, table: str, n: int = USER_PARTS, user: str = "user_id",
                   mode: str = "overwrite") -> None:
    """A7 as a table: bucketed and sorted by user, so later joins / windows on the
    user need no shuffle."""
    df.write.mode(mode).bucketBy(n, user).sortBy(user).saveAsTable(table)


def rebalance(df: DataFrame, n: int, shuffle: bool = True) -> DataFrame:
    """``n`` partitions: a round-robin shuffle, or ``coalesce`` without one."""
    return df.repartition(n) if shuffle else df.coalesce(n)
