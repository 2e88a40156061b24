"""Distribution reports: describe, exact quantiles, equal-width histograms.

Quantiles are exact (linear interpolation between the two nearest ranks, as the
pandas default) by distributed selection. The column is written once. A sketch of all
values gives a narrow bracket of values around each wanted rank, one pass counts the rows
below and inside the brackets exactly, and a bracket that still holds too many rows is
narrowed again by a sketch of its own rows. Only the rows inside the last brackets are
shuffled, grouped by value and ranked; a bracket of one value is settled by the counts, so
a value that a third of the rows share moves nothing. A few numbers per quantile reach the
driver. NULL and NaN are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.session import ensure_checkpoint_dir

MOST_INSIDE = 1_000_000  # rows of a bracket that one task may rank
ACCURACY = 10_000  # of the sketches: a rank is off by 1 / ACCURACY of the rows at most

Bracket = tuple[float, float, int, int]  # least and greatest value, rows below, rows inside


def _written_column(df: DataFrame, col: str, partitions: int | None) -> DataFrame:
    """The values as DOUBLE column ``x``, written (a checkpoint in the shared folder) in at
    most ``partitions`` parts, so the input runs once however often they are read."""
    ensure_checkpoint_dir(df.sparkSession)
    vals = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    return (vals.coalesce(partitions) if partitions else vals).checkpoint()


def _cell(marks: Sequence[tuple[float, int]]) -> Column:
    """How many of the sorted marks ``x`` has passed: ``(v, 0)`` is passed by ``x >= v``,
    ``(v, 1)`` by ``x > v``. A tree of comparisons as deep as the logarithm of their number."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        value, above = marks[mid]
        passed = F.col("x") > F.lit(value) if above else F.col("x") >= F.lit(value)
        return F.when(passed, tree(mid + 1, hi)).otherwise(tree(lo, mid))
    return tree(0, len(marks))


def _rows_before(vals: DataFrame, values: Sequence[float]) -> dict[tuple[float, int], int]:
    """Exact rows below each value ``(v, 0)``, and up to it ``(v, 1)``: one pass, and as many
    counts as marks."""
    marks = [(v, k) for v in sorted(values) for k in (0, 1)]
    found = {r["cell"]: r["n"] for r in
             vals.groupBy(_cell(marks).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out, total = {}, 0
    for i, mark in enumerate(marks):
        total += found.get(i, 0)
        out[mark] = total
    return out


def _narrowed(rank: int, old: Bracket, low: float, high: float, before: dict) -> Bracket:
    """The part of a bracket that holds the rank, given counts at two values inside it."""
    a, b, below, inside = old
    if rank < before[low, 0]:
        return a, low, below, before[low, 1] - below
    if rank >= before[high, 1]:
        return high, b, before[high, 0], below + inside - before[high, 0]
    for v in (low, high):  # a value that holds the rank
        if before[v, 0] <= rank < before[v, 1]:
            return v, v, before[v, 0], before[v, 1] - before[v, 0]
    return low, high, before[low, 0], before[high, 1] - before[low, 0]


def _brackets(vals: DataFrame, ranks: Sequence[int], whole: Bracket) -> dict[int, Bracket]:
    """For each rank a bracket of one value or of at most ``MOST_INSIDE`` rows."""
    found = dict.fromkeys(ranks, whole)
    inside = lambda a, b: F.col("x").between(F.lit(a), F.lit(b))
    while True:
        wide: dict[Bracket, list[int]] = {}
        for r, old in found.items():
            if old[3] > MOST_INSIDE and old[0] < old[1]:
                wide.setdefault(old, []).append(r)
        if not wide:
            return found
        sketches, any_ = [], F.lit(False)
        for (a, b, below, n), rs in wide.items():
            shares = [min(1.0, max(0.0, (r - below + 0.5) / n + d / ACCURACY)) for r in rs for d in (-2, 2)]
            sketches.append(F.percentile_approx(F.when(inside(a, b), F.col("x")), shares, ACCURACY))
            any_ = any_ | inside(a, b)
        cuts = list(vals.filter(any_).agg(*sketches).first())
        before = _rows_before(vals, {v for c in cuts for v in c})
        for c, (old, rs) in zip(cuts, wide.items()):
            for i, r in enumerate(rs):
                found[r] = _narrowed(r, old, c[2 * i], c[2 * i + 1], before)
        if all(found[r] == old for old, rs in wide.items() for r in rs):
            return found  # nothing got narrower; the ranking below is exact all the same


def _ranked(vals: DataFrame, qs: Sequence[float], n: int, low: float | None, high: float | None) -> DataFrame:
    """(value ``x``, count ``c``) of the values inside the brackets of the wanted quantiles,
    with ``before`` (rows with a smaller value) and the total ``n``."""
    ranks = sorted({int(f((n - 1) * q)) for q in qs for f in (np.floor, np.ceil)}) if n else []
    found = set(_brackets(vals, ranks, (low, high, 0, n)).values())
    base = {}
    for a, b, below, inside in found:
        base[a, 0], base[b, 1] = below, below + inside
    marks = sorted(base)
    wanted = [k for k in range(1, len(marks))
              if any((a, 0) <= marks[k - 1] and marks[k] <= (b, 1) for a, b, _, _ in found)]
    counts = (vals.withColumn("cell", _cell(marks)).filter(F.col("cell").isin(wanted))
              .groupBy("cell", "x").agg(F.count(F.lit(1)).alias("c")))
    earlier = Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    start = F.get(F.array(F.lit(0).cast("bigint"), *[F.lit(base[m]).cast("bigint") for m in marks]), F.col("cell"))
    return counts.select("x", "c", (start + F.coalesce(F.sum("c").over(earlier), F.lit(0))).alias("before"),
                         F.lit(n).cast("bigint").alias("n"))


def _quantile_aggs(qs: Sequence[float]) -> list:
    """Per requested q: the value at rank position (n - 1) * q, linear in between,
    as aggregates over the ranked rows (for a few fixed q, e.g. quartiles)."""
    out = []
    for i, q in enumerate(qs):
        pos = (F.col("n") - F.lit(1)).cast("double") * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        inside = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("c"))
        lo_v = F.max(F.when(inside(lo), F.col("x")))
        hi_v = F.max(F.when(inside(hi), F.col("x")))
        frac = F.max(pos - lo)
        out.append(F.when((frac == 0) | (lo_v == hi_v), lo_v).otherwise(lo_v + (hi_v - lo_v) * frac).alias(f"__q{i}"))
    return out


def quantiles(df: DataFrame, col: str, qs: Sequence[float], partitions: int | None = None,
              approx_accuracy: int | None = None) -> DataFrame:
    """Exact quantiles of ``col`` (NULLs skipped): columns ``q`` and ``value``.

    Rank position ``(n - 1) * q``; between two ranks the value is
    ``lo + (hi - lo) * frac``. The values at the wanted ranks are picked by two
    conditional maxima per quantile in one aggregation over the brackets' values. With ``approx_accuracy`` Spark's
    ``percentile_approx`` (a mergeable sketch, one pass, no interpolation) is
    used instead: rank error about 1 / accuracy.
    """
    if approx_accuracy:
        qlist = list(dict.fromkeys(float(q) for q in qs))
        one = df.agg(F.percentile_approx(F.col(col).cast("double"), qlist, approx_accuracy).alias("__v"))
        return one.select(F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in qlist]).alias("q"),
                                                 F.col("__v").alias("value"))).alias("e")).select(
            F.col("e.q").alias("q"), F.col("e.value").alias("value"))
    wanted = list(dict.fromkeys(float(q) for q in qs))
    vals = _written_column(df, col, partitions)
    n, low, high = vals.agg(F.count("x"), F.min("x"), F.max("x")).first()
    one = _ranked(vals, wanted, n, low, high).agg(*_quantile_aggs(wanted))
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"__q{i}").alias("value")) for i, q in enumerate(wanted)])
    return one.select(F.explode(pairs).alias("e")).select("e.q", "e.value")


def describe(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """L1: count, mean, sample std, min, 25/50/75 %, max of ``col``. One row of DOUBLEs.

    One pass over the written column gives count, sum and extremes, another the sample
    std as ``sqrt(sum((x - mean)^2) / (n - 1))`` (two-pass form, no cancellation); the
    quantiles are as in ``quantiles``. The std of a single value is NULL; without values
    the count is 0 and the rest NULL.
    """
    vals = _written_column(df, col, partitions)
    n, total, low, high = vals.agg(F.count("x"), F.sum("x"), F.min("x"), F.max("x")).first()
    mean = F.lit(total / n if n else None).cast("double")
    d = F.col("x") - mean
    quartiles = [0.25, 0.5, 0.75]
    one = _ranked(vals, quartiles, n, low, high).agg(*_quantile_aggs(quartiles)).select(
        "*", F.lit(float(n)).alias("count"), mean.alias("mean"), vals.agg(F.sum(d * d)).scalar().alias("__m2"),
        F.lit(low).cast("double").alias("min"), F.lit(high).cast("double").alias("max"))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("__m2") / (F.col("count") - F.lit(1.0))))
    return one.select("count", "mean", std.alias("std"), "min", F.col("__q0").alias("p25"),
                      F.col("__q1").alias("p50"), F.col("__q2").alias("p75"), "max")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """L3: equal-width histogram as shares, in bin order, empty bins kept.

    Right-closed bins ``(edge_{i-1}, edge_i]`` with ``edge_i = min + i * w`` and
    ``w = (max - min) / bins``; the lowest edge is widened so the minimum falls
    in bin 1. Columns ``bin`` (1-based), ``n``, ``share``.
    """
    x = F.col(col)
    vals = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    # one scalar subquery (min, max, count); its three uses share one execution
    stats = vals.agg(F.struct(F.min("x").alias("mn"), F.max("x").alias("mx"),
                              F.count(F.lit(1)).alias("n"))).scalar()
    mn, mx, total = stats["mn"], stats["mx"], stats["n"]
    w = (mx - mn) / F.lit(float(bins))
    b = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.try_divide(F.col("x") - mn, w)))).cast("bigint")
    counts = vals.groupBy(F.coalesce(b, F.lit(1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
            .withColumn("share", F.col("n") / total))
