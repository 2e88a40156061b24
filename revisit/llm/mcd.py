"""Quality rules with robust multivariate outliers.

Each document gets fixed counts (words, symbols, repeated lines and words), hard
rules reject the plainly bad ones, and the rest are judged as vectors: a
minimum-covariance-determinant estimate of centre and covariance per language and
source, then rejection by Mahalanobis distance.

The estimate is found by concentration steps. Each step takes centre and covariance
of the ``SHARE`` documents of a group nearest to the last estimate (the determinant
never grows). Nearest is decided on a histogram of distances per group, so neither a
group nor its sorted distances ever meet in one task, and the result does not depend
on the order of rows: whole histogram bins are taken until the share is reached.

A vector holds: the mean word length (minus the group's median, damped for short
texts, where a mean is noisy), the square root of symbols per word, the share of
repeated lines, the share of repeated words. Most clean documents have zero in the
last three, so the covariance is regularised by fixed variances (``FLOORS``).

Groups (language, source) with fewer than ``MIN_ROWS`` documents are pooled by
language, then over all languages; if even that pool is smaller, the hard rules
alone decide.

DataFrame functions only. Defined results: a null or blank text has no words and
fails the hard rules; null language or source count as empty; repeated rows are
judged like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.llm.shared import keep, let

DIMS = 4
SHARE = 0.75  # of a group's rows that an estimate is taken from
STEPS = 4  # concentration steps
MIN_ROWS = 100
OUTSIDE = 1e-4  # share of a normal sample beyond the cut
FLOORS = (0.15, 0.12, 0.12, 0.12)  # least standard deviation of each dimension
DAMP_WORDS = 100
BINS, BIN_LOG = 400, 0.1  # distance histogram: bin = floor(log(d2) / BIN_LOG) + BINS / 2
WINDOW = 8
_SPACE = "[\\x20\\x09-\\x0D]+"


def chi2_cdf(x: float, dims: int) -> float:
    """Chi-squared distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half ** k / math.factorial(k) for k in range(dims // 2))


def chi2_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dims) < p else (lo, mid)
    return hi


CUT = chi2_quantile(1 - OUTSIDE, DIMS)
#: The nearest SHARE of a normal sample has a smaller covariance than the sample.
CONSISTENCY = SHARE / chi2_cdf(chi2_quantile(SHARE, DIMS), DIMS + 2)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words that occur twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - window + 1),
                                    lambda i: F.xxhash64(F.slice(h, i, window)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        starts = lambda s: F.sort_array(F.transform(F.filter(s, lambda e, j: (F.get(s, j - 1)["x"] == e["x"])
                                                             | (F.get(s, j + 1)["x"] == e["x"])), lambda e: e["i"]))
        return let(pairs, lambda s: let(starts(s), lambda p: F.aggregate(
            F.transform(p, lambda v, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - v, F.lit(window)))),
            F.lit(0), lambda a, b: a + b)))

    once = lambda h: let(windows(h), lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))
    return F.when(F.size(words) > window, let(hashes, once)).otherwise(F.lit(0))


def text_counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The fixed counts of every whole text, and the hard rules' verdict. ``carry``: more
    columns of the input to keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *carry, F.coalesce("lang", F.lit("")).alias("lang"),
                       F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda l: l.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        repeated_words(w).cast("bigint").alias("n_repeat_words")))
    of_lines = let(lines, lambda l: F.struct(F.size(l).alias("n"), (F.size(l) - F.size(F.array_distinct(l))).alias("dup")))
    out = rows.select(
        "doc_id", *carry, "lang", "source", of_words.alias("w"), of_lines.alias("l"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"))
    return out.select(
        "doc_id", *carry, "lang", "source", "w.n_words", "w.word_chars", "n_symbols",
        F.col("l.n").cast("bigint").alias("n_lines"), F.col("l.dup").cast("bigint").alias("n_dup_lines"),
        "w.n_repeat_words",
        ((F.col("w.n_words") < 20) | (F.col("w.n_repeat_words") * 100 > F.col("w.n_words") * 30)).alias("base_failed"))


def with_groups(counts: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """``grp``: language and source, or the pool that a small group falls into (null
    if even the last pool is small). Counts are pre-aggregated per group."""
    sizes = counts.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < min_rows
    by_lang = sizes.groupBy("lang").agg(F.sum(F.when(small, F.col("n")).otherwise(0)).alias("n_lang"))
    pool = by_lang.agg(F.sum(F.when(F.col("n_lang") < min_rows, F.col("n_lang")).otherwise(0)).alias("n_all"))
    names = (sizes.join(by_lang, "lang").withColumn("n_all", pool.scalar())
             .select("lang", "source", F.when(~small, F.to_json(F.array("lang", "source")))
                     .when(F.col("n_lang") >= min_rows, F.to_json(F.array("lang")))
                     .when(F.col("n_all") >= min_rows, F.lit("[]")).alias("grp")))
    return counts.join(keep(names, "mcd-groups"), ["lang", "source"], "left")


def _histogram(df: DataFrame) -> DataFrame:
    """Rows per group and bin, written: else the window that follows would have what every
    task counted of a group dealt to one task, before it is added up."""
    return keep(df.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n")), "mcd-histogram")


def group_quantile(df: DataFrame, value: Column, width: float, share: float) -> DataFrame:
    """Per group, the upper edge of the histogram bin in which the share is reached."""
    hist = _histogram(df.withColumn("bin", F.floor(value / width)))
    w = Window.partitionBy("grp")
    run = hist.select("grp", "bin", F.sum("n").over(w.orderBy("bin")).alias("run"), F.sum("n").over(w).alias("all"))
    return (run.filter(F.col("run") >= F.ceil(F.col("all") * share)).groupBy("grp")
            .agg(((F.min("bin") + 1) * width).alias("q")))


def moments(df: DataFrame) -> DataFrame:
    """Centre and Cholesky factor of the regularised covariance, per group."""
    x = [F.col(f"x{i}") for i in range(DIMS)]
    sums = df.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(x[i]).alias(f"m{i}") for i in range(DIMS)],
        *[F.avg(x[i] * x[j]).alias(f"s{i}{j}") for i in range(DIMS) for j in range(i + 1)])
    cov = sums.select("grp", *[f"m{i}" for i in range(DIMS)], *[
        ((F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
         + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)])
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # Rounding can leave a hair below the floor's variance; never less than a trace of it.
            value = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 * 1e-3))) if i == j else rest / F.col(f"l{j}{j}")
            cov = cov.withColumn(f"l{i}{j}", value)
    return cov.select("grp", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)])


def distances(df: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    """``d2``: squared Mahalanobis distance to the group's estimate."""
    out = df.join(estimate, "grp", how)
    for i in range(DIMS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, DIMS)), F.col("y0") * F.col("y0")))


def d2_bin(d2: Column) -> Column:
    b = F.floor(F.log(F.greatest(d2, F.lit(1e-9))) / BIN_LOG) + BINS // 2
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), b))


def nearest(df: DataFrame, d2: str = "d2", share: float = SHARE) -> DataFrame:
    """The rows of each group in the nearest bins that hold the share."""
    binned = df.withColumn("bin", d2_bin(F.col(d2)))
    hist = _histogram(binned)
    w = Window.partitionBy("grp")  # BINS rows at most in a group
    run = hist.select("grp", "bin", (F.sum("n").over(w.orderBy("bin")) - F.col("n")).alias("before"),
                      F.sum("n").over(w).alias("all"))
    # Written, so its size is known: rows of a group stay where they are unless the table of
    # groups outgrows Spark's broadcast threshold.
    cut = keep(run.filter(F.col("before") < F.col("all") * share).groupBy("grp").agg(F.max("bin").alias("cut")), "mcd-cut")
    return binned.join(cut, "grp").filter(F.col("bin") <= F.col("cut"))


def with_vectors(counts: DataFrame, median: DataFrame, how: str) -> DataFrame:
    """Add ``x0`` .. ``x3``; ``median`` has the groups' median word length as ``q``."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.join(median, "grp", how).withColumns({
        "x0": (F.col("word_chars") / n - F.col("q")) * F.sqrt(n / (n + DAMP_WORDS)),
        "x1": F.sqrt(F.col("n_symbols") / n),
        "x2": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "x3": F.col("n_repeat_words") / n})


def judge(docs: DataFrame, min_rows: int = MIN_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the counts, ``base_failed``, ``robust_d2`` (null where no estimate
    applies) and ``kept``."""
    counts = keep(text_counts(docs, carry), "mcd-texts")  # texts are read once; the rest is narrow
    counts = keep(with_groups(counts, min_rows), "mcd-counts")
    good = counts.filter(~F.col("base_failed") & F.col("grp").isNotNull())
    median = keep(group_quantile(good, F.col("word_chars") / F.col("n_words"), 0.01, 0.5), "mcd-median")
    xs = [f"x{i}" for i in range(DIMS)]
    x = keep(with_vectors(good, median, "inner").select("grp", *xs), "mcd-vectors")
    spread = sum((F.col(c) * F.col(c) / f ** 2 for c, f in zip(xs, FLOORS)), F.lit(0.0))
    estimate = keep(moments(nearest(x.withColumn("d2", spread))), "mcd-start")
    for step in range(STEPS):
        estimate = keep(moments(nearest(distances(x, estimate))), f"mcd-step{step}")
    judged = distances(with_vectors(counts, median, "left"), estimate, "left")
    return judged.withColumn("robust_d2", F.when(~F.col("base_failed"), F.col("d2"))).select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "robust_d2",
        (~F.col("base_failed") & F.coalesce(F.col("robust_d2") <= F.lit(CUT), F.lit(True))).alias("kept"))
