"""Sharding along a Hilbert curve over quantised metadata.

Language, source and size of a document are quantised to ``2**bits`` cells each (whole
values of language and source, ranked in byte order and weighted by their rows);
the position of the document's cell on the Hilbert curve through that grid orders
the documents, and equal runs of that order are the shards. Neighbours on the curve
are neighbours in all dimensions, so a shard covers few values of each of them and a
reader that filters on any dimension skips most files (file pruning by minima and
maxima).

Global positions are exact and need no global sort: rows are counted per (cell, text
bucket, row bucket), the counts are summed hierarchically (each window runs over the
summary of one parent: at most 4096 cells, 64 text buckets, 4096 row buckets), and
rows are numbered only inside their finest bucket. A cell, or a group of equal texts,
that holds a third of all rows is spread over 4096 row buckets.

DataFrame functions only. Defined results: a null text has no bytes (size 1) and the
checksum of the empty text; null language or source count as empty; repeated rows
are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.llm.shared import keep

TEXT_BUCKETS, ROW_BUCKETS = 64, 4096


def cut_numbers(rows: DataFrame, name: str, bits: int) -> list:
    """``2**bits - 1`` cut points of a number, from a quantile sketch over all rows."""
    shares = [i / 2 ** bits for i in range(1, 2 ** bits)]
    return sorted(set(rows.agg(F.percentile_approx(name, shares, 10000)).first()[0] or []))


def cut_strings(rows: DataFrame, name: str, bits: int) -> list[str]:
    """At most ``2**bits - 1`` cut points of a string column: the distinct whole values in
    byte order at which the rows so far pass another ``2**bits``-th of all rows.

    Rows are counted per value first, so a frequent value is one row. The table of values
    is written in ranges with the range's number; a window runs inside each range and one
    over the ranges' totals."""
    values = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    values = keep(values.repartitionByRange(name).withColumn("part", F.spark_partition_id()), f"hilbert-{name}")
    totals = values.groupBy("part").agg(F.sum("n").alias("n"))
    before = running_base(totals, [], "part").select("part", F.col("base").alias("earlier"))
    upto = (running_base(values, ["part"], name).join(before, "part")
            .withColumn("from", F.col("base") + F.col("earlier")).withColumn("total", totals.agg(F.sum("n")).scalar()))
    share = lambda at: F.expr(f"({at}) * {2 ** bits} div total")
    # The first value begins every row's cell; no cut is needed there.
    cuts = upto.filter((F.col("from") > 0) & (share("`from` - 1") < share("`from` + n - 1"))).select(name)
    return sorted((r[0] for r in cuts.collect()), key=str.encode)


def cell(value: Column, cuts: list) -> Column:
    """Number of cut points not above the value (0 to ``2**bits - 1``)."""
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(value >= F.lit(c), 1).otherwise(0)
    return out


def curve_index(axes: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of the cell with the given coordinates, by
    reflections and exchanges from the highest bit down, then a Gray code."""
    n = len(axes)
    shift = lambda v, k: F.call_function("shiftright", v, k)
    left = lambda v, k: F.call_function("shiftleft", v, k)
    one = F.lit(1).cast("bigint")

    def exchange(x: Column, step: Column) -> Column:
        i = (step % n).cast("int")
        q = left(one, (F.lit(bits - 1) - F.floor(step / n)).cast("int"))
        here, first = F.get(x, i), F.get(x, F.lit(0))
        set_ = here.bitwiseAND(q) != 0
        low = q - 1
        swap = F.when(set_, low).otherwise(first.bitwiseXOR(here).bitwiseAND(low))
        return F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(swap))
                           .when((j == i) & ~set_, v.bitwiseXOR(swap)).otherwise(v))

    start = F.array(*[a.cast("bigint") for a in axes])
    x = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), start, exchange) if bits > 1 else start
    # Gray code over the axes, then the correction from the last axis.
    x = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x, lambda a, i: F.transform(
        a, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(a, i - 1))).otherwise(v))) if n > 1 else x
    fix = lambda a: F.aggregate(F.sequence(F.lit(1), F.lit(bits - 1)), F.lit(0).cast("bigint"), lambda t, k: F.when(
        F.get(a, F.lit(n - 1)).bitwiseAND(left(one, k)) != 0, t.bitwiseXOR(left(one, k) - 1)).otherwise(t))
    x = F.transform(F.array(x), lambda a: F.transform(a, lambda v: v.bitwiseXOR(fix(a))))[0] if bits > 1 else x
    # Interleave: the highest bit of every axis first.
    return F.transform(F.array(x), lambda a: F.aggregate(
        F.sequence(F.lit(0), F.lit(bits * n - 1)), F.lit(0).cast("bigint"),
        lambda t, s: left(t, F.lit(1)) + shift(F.get(a, (s % n).cast("int")),
                                        (F.lit(bits - 1) - F.floor(s / n)).cast("int")).bitwiseAND(one)))[0]


def running_base(counts: DataFrame, parent: list[str], by: str) -> DataFrame:
    """``base``: the rows in earlier ``by`` buckets of the same parent."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy()
    w = w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, curve, law, shard, slot, grown_shard`` per document, and
    the columns named in ``carry`` as one struct ``row``.

    The law is ``rows``: shard sizes differ by one row at most; ``slot`` numbers a
    shard's rows from 0. Equal texts of one cell lie together (same text bucket)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = ["row"] if carry else []
    docs = docs.select("doc_id", "text", "lang", "source", *([F.struct(*carry).alias("row")] if carry else []))
    raw = docs.select(
        *more,
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    raw = keep(raw, "hilbert-meta")
    # At most 2**bits - 1 values each come to the driver and become literals, so a stage that
    # is run again after a loss uses the same ones.
    dims = {"lang": cut_strings(raw, "lang", bits), "source": cut_strings(raw, "source", bits),
            "size": cut_numbers(raw, "size", bits)}
    cells = raw.select(*more, "doc_id", "size", "text_crc32", "text_hash",
                       *[cell(F.col(n), cuts).alias(f"cell_{n}") for n, cuts in dims.items()])
    rows = cells.select(
        *more, "doc_id", "size", "text_crc32", "text_hash",
        curve_index([F.col(f"cell_{n}") for n in dims], bits).alias("curve"),
        F.pmod("text_hash", F.lit(TEXT_BUCKETS)).alias("tb"),
        F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(ROW_BUCKETS)).alias("rb"))
    rows = keep(rows, "hilbert-rows")
    fine = rows.groupBy("curve", "tb", "rb").agg(F.count(F.lit(1)).alias("n"))
    mid = fine.groupBy("curve", "tb").agg(F.sum("n").alias("n"))
    top = mid.groupBy("curve").agg(F.sum("n").alias("n"))  # one row per cell: 2**(3 * bits) at most
    total = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    base = (running_base(fine, ["curve", "tb"], "rb").select("curve", "tb", "rb", F.col("base").alias("b3"))
            .join(running_base(mid, ["curve"], "tb").select("curve", "tb", F.col("base").alias("b2")), ["curve", "tb"])
            .join(running_base(top, [], "curve").select("curve", F.col("base").alias("b1")), ["curve"])
            .select("curve", "tb", "rb", (F.col("b1") + F.col("b2") + F.col("b3")).alias("base")))
    inside = Window.partitionBy("curve", "tb", "rb").orderBy("text_hash", "doc_id", "size", "text_crc32")
    ranked = (rows.withColumn("at", F.row_number().over(inside)).join(base, ["curve", "tb", "rb"])
              .withColumn("rank", F.col("base") + F.col("at") - 1)
              .withColumn("total", total.scalar()))
    ranked = ranked.withColumn("shard", F.expr(f"rank * {shards} div total"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")  # the shard's first rank
    return ranked.select("doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"),
                         F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), *more)


def write_shards(docs: DataFrame, path: str, files: int, shards: int = 16, bits: int = 4) -> None:
    """Write the documents in curve order: a folder per shard, in it files that each hold a
    run of the curve, so a reader's filter on language, source or size skips most files by
    their minima and maxima. ``files``: about how many files in all.
    Document columns named like the three added ones get the prefix ``doc_``."""
    own = ("shard", "slot", "curve")
    out = hilbert_shards(docs, shards, bits, carry=tuple(docs.columns))
    out = out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    columns = [F.col(f"row.`{c}`").alias(f"doc_{c}" if c in own else c) for c in docs.columns]
    out.select(*own, *columns).write.partitionBy("shard").parquet(path)
