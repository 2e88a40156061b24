"""Ordered scans that stay balanced when one group is huge.

``Window.partitionBy(key)`` sends every row of a key to one task, so a key that
holds a third of all rows becomes a third of the job in a single task. The
helpers here split each key's ordered rows into *chunks* ``(key, bucket)``,
where ``bucket`` is a monotone function of the order (a time bucket, or a block
of row ids), and compute a scan in two levels:

1. inside each chunk, with a window partitioned by ``(key, bucket)``;
2. across chunks, with a window over a per-chunk summary that has one row per
   chunk (first row, last row, totals), joined back on ``(key, bucket)``.

The big side is shuffled once on ``(key, bucket)``. A summary that needs the order is an
aggregate of the windowed rows themselves, and ``pinned`` keeps the columns of both sides
alike, so that they share one scan and one exchange whatever the caller selects. Sums and
extremes (``with_prefix``) need no order: their summary is aggregated where the rows are
read, before any shuffle. Only the per-chunk summaries move again.
Passes should not be nested on one another (each would repeat its input's
operators); ``sequences.sessionize`` fuses its dependent steps into one pass.

Order columns are ascending, NULLs last. Every order should end in a unique
tie-break column so results do not depend on the physical row order.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.session import ensure_checkpoint_dir

_B = "__chunk"


def _order_cols(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` where NULL matches NULL; keeps the left's key columns."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    out = left.join(r, cond, "left")
    return out.drop(*[f"__r_{k}" for k in keys])


def pinned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with a filter that is true for every row and reads all the given columns.

    Placed above a window it keeps the optimizer from pruning them in one of two branches
    that use ``df``; the branches then share one scan and one exchange. Columns that can't
    be hashed (maps, variants) are left out: branches may then differ, results do not.
    """
    able = [F.col(f"`{c}`") for c in columns if not any(x in df.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    return df.filter(F.hash(*able) % 2 < 2) if able else df


def with_neighbors(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                   cols: Sequence[str], prev: bool = True, nxt: bool = True,
                   prev_prefix: str = "prev_", next_prefix: str = "next_") -> DataFrame:
    """Add the previous / next row's ``cols`` within each key, in ``order``.

    Adds ``prev_<c>`` / ``next_<c>`` and the flags ``has_prev`` / ``has_next``
    (so a NULL neighbour value is told apart from a missing neighbour).
    """
    keys, order, cols = list(keys), list(order), list(cols)
    d = df.withColumn(_B, bucket)
    w = Window.partitionBy(*keys, _B).orderBy(*_order_cols(order))
    adds = {"__rn": F.row_number().over(w), "__is_last": F.lead(F.lit(1)).over(w).isNull()}
    for c in cols:
        if prev:
            adds[f"__p_{c}"] = F.lag(c).over(w)
        if nxt:
            adds[f"__n_{c}"] = F.lead(c).over(w)
    local = pinned(d.withColumns(adds), d.columns)

    # The summary is taken from the windowed rows, so both sides share one shuffle.
    payload = F.struct(*[F.col(c) for c in cols])
    summary = local.groupBy(*keys, _B).agg(F.min_by(payload, "__rn").alias("__first"),
                                           F.max_by(payload, "__rn").alias("__last"))
    w2 = Window.partitionBy(*keys).orderBy(_B)
    summary = summary.select(*keys, _B,
                             F.lag("__last").over(w2).alias("__pc"),
                             F.lead("__first").over(w2).alias("__nc"))
    j = _null_safe_join(local, summary, keys + [_B])
    first, last = F.col("__rn") == 1, F.col("__is_last")
    outs = {}
    if prev:
        outs["has_prev"] = ~first | F.col("__pc").isNotNull()
        for c in cols:
            outs[f"{prev_prefix}{c}"] = F.when(first, F.col(f"__pc.{c}")).otherwise(F.col(f"__p_{c}"))
    if nxt:
        outs["has_next"] = ~last | F.col("__nc").isNotNull()
        for c in cols:
            outs[f"{next_prefix}{c}"] = F.when(last, F.col(f"__nc.{c}")).otherwise(F.col(f"__n_{c}"))
    j = j.withColumns(outs)
    drop = ["__rn", "__is_last", "__pc", "__nc", _B]
    drop += [f"__p_{c}" for c in cols if prev] + [f"__n_{c}" for c in cols if nxt]
    return j.drop(*drop)


_OPS = {"sum": F.sum, "max": F.max, "min": F.min}


def with_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                specs: Sequence[tuple[str, Column, str, bool]],
                totals: Sequence[str | None] = ()) -> DataFrame:
    """Running aggregates within each key, in ``order``.

    ``specs`` holds ``(out_name, value, op, inclusive)`` with ``op`` in
    ``sum | max | min``. ``inclusive=False`` aggregates the rows strictly before.
    A sum over no rows is 0; a max / min over no rows is NULL. ``totals[i]``, if
    given, names a column with spec ``i``'s aggregate over the whole key.
    """
    keys, order = list(keys), list(order)
    d = df.withColumn(_B, bucket)
    vals = {f"__v{i}": v for i, (_, v, _, _) in enumerate(specs)}
    d = d.withColumns(vals)
    base = Window.partitionBy(*keys, _B).orderBy(*_order_cols(order))
    local = {}
    for i, (_, _, op, inclusive) in enumerate(specs):
        frame = base.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local[f"__l{i}"] = _OPS[op](f"__v{i}").over(frame)
    d2 = d.withColumns(local)

    summary = d2.groupBy(*keys, _B).agg(*[_OPS[op](f"__v{i}").alias(f"__t{i}")
                                         for i, (_, _, op, _) in enumerate(specs)])
    w2 = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    extra = [_OPS[specs[i][2]](f"__t{i}").over(Window.partitionBy(*keys)).alias(name)
             for i, name in enumerate(totals) if name]
    summary = summary.select(*keys, _B, *[_OPS[op](f"__t{i}").over(w2).alias(f"__o{i}")
                                          for i, (_, _, op, _) in enumerate(specs)], *extra)
    j = _null_safe_join(d2, summary, keys + [_B])
    outs = {}
    for i, (name, _, op, _) in enumerate(specs):
        lo, off = F.col(f"__l{i}"), F.col(f"__o{i}")
        if op == "sum":
            outs[name] = F.coalesce(off, F.lit(0)) + F.coalesce(lo, F.lit(0))
        elif op == "max":
            outs[name] = F.greatest(off, lo)
        else:
            outs[name] = F.least(off, lo)
    j = j.withColumns(outs)
    drop = [_B] + [f"__{p}{i}" for i in range(len(specs)) for p in ("v", "l", "o")]
    return j.drop(*drop)


_MOST_KEPT = 64  # tables of heavy buckets that a session remembers
_kept: OrderedDict[tuple, tuple[DataFrame, int, DataFrame]] = OrderedDict()


def _heavy_buckets(timed: DataFrame, keys: Sequence[str], target_rows: int) -> tuple[int, DataFrame]:
    """The (key, bucket) groups with more than ``target_rows`` rows and their number: written
    by one job, counted from the file footers, and found again for the same rows in the same session.

    Files that change in place between two uses make the table out of date; chunks are then
    less even, but as ordered as before.
    """
    spark = timed.sparkSession
    key = (spark.sparkContext.applicationId, timed.semanticHash(), tuple(keys), target_rows)
    old = _kept.get(key)
    if old and old[0].sameSemantics(timed):
        _kept.move_to_end(key)
        return old[1:]
    n = F.count(F.lit(1))
    heavy = (timed.groupBy(*keys, "__b").agg(n.alias("__n"), F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
             .filter(F.col("__n") > target_rows))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/heavy-{uuid.uuid4().hex[:12]}"
    heavy.write.parquet(path)
    written = spark.read.schema(heavy.schema).parquet(path)
    found = (written.count(), written)
    _kept[key] = (timed, *found)
    if len(_kept) > _MOST_KEPT:
        _kept.popitem(last=False)
    return found


TARGET_ROWS = 1_000_000
BROADCAST_ROWS = 500_000  # a table of heavy buckets up to this size is broadcast
_LAST = (1 << 63) - 1


def add_time_chunks(df: DataFrame, keys: Sequence[str], time: str, width: float,
                    target_rows: int | None = TARGET_ROWS, out: str = _B, tie: str | None = None) -> DataFrame:
    """Chunk per row, monotone in (time, tie): a struct of two BIGINTs (start, part).

    A chunk is the time bucket of ``width``, cut further where one key has more than
    ``target_rows`` rows in a bucket. A counting job (map-side partial aggregation)
    finds those heavy buckets and their observed time range; usually there are none,
    and nothing else happens. A heavy bucket is cut into ``ceil(count / target_rows)``
    equal slices of its range, and a single time that alone has too many rows is cut
    by equal slices of the numeric column ``tie`` (so a burst at one instant is spread
    too; integral time columns only, others are taken to the microsecond).

    The table of heavy buckets has at most rows / ``target_rows`` entries. It is written
    once per input and session, counted, and broadcast only up to ``BROADCAST_ROWS`` entries; a
    larger one is joined by shuffle. Rows with a NULL time get the last chunk.
    """
    integral = df.schema[time].dataType.typeName() in ("long", "integer", "short", "byte")
    t = F.col(time).cast("bigint") if integral else F.floor(F.col(time) * F.lit(1e6)).cast("bigint")
    wide = F.lit(max(1, int(width if integral else width * 1e6))).cast("bigint")
    base = t - F.pmod(t, wide)
    chunk = lambda start, part: F.struct(F.coalesce(start, F.lit(_LAST)).alias("start"), part.cast("bigint").alias("part"))
    if not target_rows:
        return df.withColumn(out, chunk(base, F.lit(0)))
    n = F.count(F.lit(1))
    slices = lambda rows: F.ceil(rows / F.lit(target_rows)).cast("bigint")
    tied = F.col(tie).cast("double") if tie else F.lit(0.0)
    timed = df.filter(t.isNotNull()).select(*keys, base.alias("__b"), t.alias("__t"), tied.alias("__tie"))
    size, heavy = _heavy_buckets(timed, keys, target_rows)
    if not size:
        return df.withColumn(out, chunk(base, F.lit(0)))
    small = F.broadcast if size <= BROADCAST_ROWS else (lambda x: x)
    bursts = (timed.join(small(heavy.select(*keys, "__b")), [*keys, "__b"], "left_semi").groupBy(*keys, "__b", "__t")
              .agg(n.alias("__n"), F.min("__tie").alias("lo"), F.max("__tie").alias("hi"))
              .filter((F.col("__n") > target_rows) & F.lit(integral))
              .groupBy(*keys, "__b").agg(F.collect_list(F.struct(F.col("__t").alias("t"), "lo", "hi", slices(F.col("__n")).alias("k")))
                                         .alias("__bursts")))  # at most rows / target_rows in all
    cuts = (_null_safe_join(heavy, bursts, [*keys, "__b"]).withColumn("__k", slices(F.col("__n")))
            .select(*keys, "__b", "__lo", "__hi", "__k", "__bursts"))
    j = df.withColumn("__b", base).join(small(cuts), [*keys, "__b"], "left")
    span = F.col("__hi") - F.col("__lo") + 1
    step = F.floor((t - F.col("__lo")) * F.col("__k") / span)
    # Never before the bucket: a row outside the range that was counted stays in order too.
    slice_start = F.greatest(base, F.col("__lo") + F.floor(step * span / F.col("__k")))
    start = F.when(F.col("__k").isNotNull(), slice_start).otherwise(base).cast("bigint")
    # The last burst at or before the row, if it lies in the row's slice.
    last = F.array_max(F.filter("__bursts", lambda x: x["t"] <= t))
    j = j.withColumn("__start", start).withColumn("__burst", last)
    after = F.coalesce(F.col("__burst.t") >= F.col("__start"), F.lit(False))
    tie_span = F.col("__burst.hi") - F.col("__burst.lo")
    piece = F.floor((tied - F.col("__burst.lo")) / tie_span * F.col("__burst.k"))
    piece = F.when(tie_span > 0, F.greatest(F.lit(0), F.least(piece, F.col("__burst.k") - 1))).otherwise(F.lit(0))
    part = F.when(after & (F.col("__burst.t") == t), piece + 1).when(after, F.lit(1 << 62)).otherwise(F.lit(0))
    chunked = chunk(F.when(after, F.col("__burst.t")).otherwise(F.col("__start")), part)
    return j.withColumn(out, chunked).drop("__b", "__k", "__lo", "__hi", "__bursts", "__burst", "__start")
