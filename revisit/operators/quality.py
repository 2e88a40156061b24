"""Data-quality checks (K1-K4). Each returns a DataFrame; none runs an action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.operators.scan import with_neighbors


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K2: key values that occur more than once, with their count (empty = unique)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def monotonic_breaks(df: DataFrame, cols: Sequence[str], order: str, rows_per_chunk: int = 1 << 20) -> DataFrame:
    """K3: in the stored order given by ``order`` (a row id), count where each column falls.

    One row: ``<col>_breaks`` and ``<col>_sorted`` per column. The order is split
    into blocks of ``rows_per_chunk`` ids; the block boundaries are compared
    through a one-row-per-block summary, so no task sees more than one block.
    """
    cols = list(cols)
    bucket = F.floor(F.col(order) / F.lit(rows_per_chunk)).cast("bigint")
    s = with_neighbors(df.select(order, *cols), [], [order], bucket, cols, nxt=False)
    aggs = []
    for c in cols:
        fall = F.when(F.col("has_prev") & (F.col(c) < F.col(f"prev_{c}")), 1).otherwise(0)
        aggs.append(F.sum(fall).cast("bigint").alias(f"{c}_breaks"))
    r = s.agg(*aggs)
    return r.withColumns({f"{c}_sorted": F.col(f"{c}_breaks") == 0 for c in cols})


def conditional_shares(df: DataFrame, conds: dict) -> DataFrame:
    """K1: share of rows meeting each condition. One row."""
    return df.agg(*[F.avg(F.when(c, 1.0).otherwise(0.0)).alias(name) for name, c in conds.items()])


def unmapped_share(rows: DataFrame, id_map: DataFrame, key: str,
                   out: str = "unmapped_share") -> DataFrame:
    """K4: share of rows whose key has no entry in the id map (left join). One row."""
    m = id_map.select(key, F.lit(True).alias("__hit")).dropDuplicates([key])
    j = rows.join(m, key, "left")
    return j.agg(F.avg(F.when(F.col("__hit").isNull(), 1.0).otherwise(0.0)).alias(out))
