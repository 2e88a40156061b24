"""Rewatch recommendation: ratings, folds, implicit ALS, top-N lists, metrics, TF-IDF.

The reference fits single-machine recommenders in a driver loop over folds.
Here the fold is a column, every fold is evaluated in one plan where the
algorithm allows it, and the model is Spark's distributed ALS.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revisit.functions.columns import hash_bucket
from revisit.schemas import ALS_RANK, METRIC_K, MIN_ITEMS, MIN_REWATCH, N_FOLDS, N_RECS

# ---------------------------------------------------------------- J1, J2 ratings


def rewatch_ratings(counts: DataFrame, user: str = "user_id", item: str = "ccid",
                    count_col: str = "num_watched", min_count: int = MIN_REWATCH) -> DataFrame:
    """Items watched more than ``min_count`` times, as ``user, item, rating``."""
    return counts.filter(F.col(count_col) > min_count).select(
        F.col(user).alias("user"), F.col(item).alias("item"), F.col(count_col).alias("rating"))


def filter_min_items(ratings: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """Keep users with more than ``min_items`` rated items (non-NULL ratings)."""
    users = (ratings.groupBy("user").agg(F.count("rating").alias("__n"))
             .filter(F.col("__n") > min_items).select("user"))
    return ratings.join(users, "user", "left_semi")


# ---------------------------------------------------------------- J3 folds

def user_folds(ratings: DataFrame, n_folds: int = N_FOLDS, seed: int = 42,
               min_items: int | None = None) -> DataFrame:
    """Users into ``n_folds`` folds; per user one held-out test item.

    ``fold`` = md5 bucket of the user; the test item is the user's item with the
    smallest md5 of (user, item, seed). Deterministic, one pass for all folds.
    Adds ``fold`` and ``is_test``. With ``min_items`` the J2 filter (more than
    ``min_items`` rated items) is applied in the same per-user aggregation, so
    the ratings are joined back once.
    """
    s = F.lit(str(seed))
    h = F.md5(F.concat_ws("|", F.col("user").cast("string"), F.col("item").cast("string"), s))
    test = ratings.groupBy("user").agg(F.min_by("item", h).alias("__test"),
                                       F.count("rating").alias("__n"))
    if min_items is not None:
        test = test.filter(F.col("__n") > min_items)
    out = ratings.join(test.select("user", "__test"), "user")
    return out.select(*ratings.columns,
                      hash_bucket(F.concat_ws("|", F.col("user").cast("string"), s), n_folds)
                      .cast("bigint").alias("fold"),
                      (F.col("item") == F.col("__test")).alias("is_test"))


# ---------------------------------------------------------------- J6, J7 ALS

ID_BUCKETS = 4096


def dense_ids(df: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct values of ``col`` (any type) numbered 0, 1, 2, ... as ``out``.

    Values are numbered inside hash buckets and shifted by the sizes of the buckets
    before (a window over ``ID_BUCKETS`` counts), so no task holds all of them.
    """
    ids = df.select(col).filter(F.col(col).isNotNull()).distinct().withColumn(
        "__b", F.pmod(F.xxhash64(col), F.lit(ID_BUCKETS)))
    sizes = ids.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy().orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__b").orderBy(col)
    return (ids.withColumn("__i", F.row_number().over(inside)).join(base, "__b")
            .select(col, (F.col("__base") + F.col("__i") - 1).cast("int").alias(out)))


def als_recommend(folded: DataFrame, n: int = N_RECS, rank: int = ALS_RANK, max_iter: int = 20,
                  reg: float = 0.1, alpha: float = 40.0, seed: int = 42,
                  algorithm: str = "ImplicitALS", n_folds: int = N_FOLDS) -> DataFrame:
    """J6 + J7: per fold, fit implicit ALS on the train rows and recommend ``n``
    unrated items to the fold's test users. Rows ``algorithm, fold, user, item, rank, score``.

    ``user`` and ``item`` may be of any type; they are numbered densely for the fits
    (Spark's ALS wants integers) and the lists carry the original ids. Ratings are
    treated as implicit (all 1, confidence weight ``alpha``). The lists are exact top lists
    by the models' factors without the user's train items (``factors.top_products``). Runs
    the fits eagerly; the id tables, the folds and the returned lists are checkpointed (shared
    ``spark.checkpoint.dir``), so later metrics do not refit.
    """
    from pyspark.ml.recommendation import ALS

    from revisit.operators.factors import top_products
    from revisit.session import ensure_checkpoint_dir

    spark = folded.sparkSession
    ensure_checkpoint_dir(spark)
    users, items = dense_ids(folded, "user", "u").checkpoint(), dense_ids(folded, "item", "i").checkpoint()
    folded = folded.join(users, "user").join(items, "item").select("u", "i", "fold", "is_test").checkpoint()
    out = None
    for f in range(n_folds):  # one model per fold: the loop is over the fold parameter
        train = folded.filter(~(F.col("is_test") & (F.col("fold") == f))).select("u", "i")
        asked = folded.filter(F.col("is_test") & (F.col("fold") == f)).select("u").distinct()
        als = ALS(rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha, implicitPrefs=True,
                  userCol="u", itemCol="i", ratingCol="r", seed=seed, coldStartStrategy="drop")
        model = als.fit(train.withColumn("r", F.lit(1.0)))
        mine = model.userFactors.select(F.col("id").alias("u"), F.col("features").alias("vec")).join(asked, "u", "left_semi")
        theirs = model.itemFactors.select(F.col("id").alias("i"), F.col("features").alias("vec"))
        top = top_products(mine, theirs, train.join(asked, "u", "left_semi"), n, numbered=True, packed=True)
        top = top.select(F.lit(algorithm).alias("algorithm"), F.lit(f).cast("bigint").alias("fold"), "u", "list")
        out = top if out is None else out.unionByName(top)
    if out is None:
        out = spark.createDataFrame([], "algorithm string, fold bigint, u int, list array<struct<i: int, score: double>>")
    out = out.join(users, "u").select("algorithm", "fold", "user", F.posexplode("list").alias("place", "top"))
    out = out.select("algorithm", "fold", "user", F.col("top.i").alias("i"), (F.col("place") + 1).cast("bigint").alias("rank"), "top.score")
    out = out.join(items, "i").select("algorithm", "fold", "user", "item", "rank", "score")
    return out.checkpoint()  # reliable: written to spark.checkpoint.dir


def popular_recommend(folded: DataFrame, n: int = N_RECS, candidates: int = 2 * N_RECS,
                      algorithm: str = "Popular") -> DataFrame:
    """per fold, the ``n`` most popular items that a test user has not in train.
    Rows ``algorithm, fold, user, item, rank``.

    Popularity is an item's number of train rows in the fold (all rows but the fold's test
    rows); ties go to the smaller item. A deterministic baseline of the same shape as
    ``als_recommend``: the list of a fold's ``candidates`` most popular items is an array,
    so users meet it without a cross join. A user with more than ``candidates - n`` train
    rows gets a longer list: ``n`` and the user's train rows, up to a power of two.
    """
    held = folded.filter("is_test").groupBy("item", "fold").agg(F.count(F.lit(1)).alias("h"))
    folds = folded.select("fold").distinct()
    total = folded.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    numbers = folds.agg(F.array_sort(F.collect_set("fold"))).scalar()  # the folds: a handful
    per_fold = (total.withColumn("fold", F.explode(numbers)).join(held, ["item", "fold"], "left")
                .withColumn("c", F.col("c") - F.coalesce("h", F.lit(0))).filter("c > 0"))
    w = Window.partitionBy("fold").orderBy(F.desc("c"), "item")  # limited to the first rows before the shuffle
    train = folded.filter(~F.col("is_test")).select("user", "item")  # a user's other rows are in train in every fold
    users = folded.filter("is_test").select("user", "fold").distinct()
    rows = (train.groupBy("user").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > candidates - n)
            .select("user", F.pow(F.lit(2), F.ceil(F.log2(F.col("rows") + n))).cast("int").alias("depth")))
    # distinct list sizes: powers of two up to the longest history (a handful)
    depths = sorted(d for (d,) in rows.select(F.greatest("depth", F.lit(candidates))).distinct().collect())
    if depths:
        users = users.join(rows, "user", "left")
    depth = F.greatest(F.col("depth"), F.lit(candidates)) if depths else F.lit(candidates)
    users = users.select("user", "fold", depth.alias("depth"))
    sizes = sorted({candidates, *depths})
    ranked = per_fold.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= sizes[-1])
    best = (ranked.withColumn("depth", F.explode(F.array(*map(F.lit, sizes)))).filter("r <= depth").groupBy("fold", "depth")
            .agg(F.array_sort(F.collect_list(F.struct("r", "item"))).alias("best")))
    lists = (users.join(best, ["fold", "depth"]).select("user", "fold", F.explode("best").alias("b"))
             .select("user", "fold", "b.r", "b.item"))
    left = lists.join(train, ["user", "item"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("user", "fold").orderBy("r")).cast("bigint")
    return left.withColumn("rank", rank).filter(F.col("rank") <= n).select(
        F.lit(algorithm).alias("algorithm"), F.col("fold").cast("bigint").alias("fold"), "user", "item", "rank")


# ---------------------------------------------------------------- J8 metrics

def discount_expr(rank_col, mode: str = "library"):
    """Rank discount: ``library`` = 1 / max(1, log2(rank)); ``textbook`` = 1 / log2(rank + 1)."""
    r = F.col(rank_col) if isinstance(rank_col, str) else rank_col
    if mode == "textbook":
        return F.lit(1.0) / F.log2(r + 1)
    return F.lit(1.0) / F.greatest(F.lit(1.0), F.log2(r))


def topn_metrics(recs: DataFrame, test: DataFrame, k: int = METRIC_K, discount: str = "library") -> DataFrame:
    """nDCG@k, precision@k, recall@k per (algorithm, user).

    ``recs``: algorithm, user, item, rank (1-based). ``test``: user, item (relevant).
    Precision divides by the list length when it is shorter than k; recall by
    min(#relevant, k); nDCG uses binary gains. Users without a list are left out.
    """
    top = recs.filter(F.col("rank") <= k)
    rel = test.select("user", "item").distinct().withColumn("__hit", F.lit(1))
    j = top.join(rel, ["user", "item"], "left")
    hit = F.coalesce(F.col("__hit"), F.lit(0))
    per = j.groupBy("algorithm", "user").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(hit).alias("__good"),
        F.sum(hit * discount_expr("rank", discount)).alias("__dcg"))
    nrel = test.groupBy("user").agg(F.countDistinct("item").alias("__rel"))
    per = per.join(nrel, "user", "left")
    m = F.least(F.col("__rel"), F.lit(k))
    if discount == "textbook":
        ideal = F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0),
                            lambda acc, r: acc + F.lit(1.0) / F.log2(r + 1))
    else:
        ideal = F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0),
                            lambda acc, r: acc + F.lit(1.0) / F.greatest(F.lit(1.0), F.log2(r)))
    return per.select(
        "algorithm", "user",
        (F.col("__dcg") / ideal).alias("ndcg"),
        (F.col("__good") / F.col("__n")).alias("precision"),
        (F.col("__good") / m).alias("recall"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Mean of every metric per algorithm."""
    cols = [c for c in metrics.columns if c not in ("algorithm", "user")]
    return metrics.groupBy("algorithm").agg(*[F.avg(c).alias(c) for c in cols])


# ---------------------------------------------------------------- J9, J10

def pivot_ratings(ratings: DataFrame, items: list) -> DataFrame:
    """User x item matrix of ratings over a stated list of items (missing cells NULL),
    one column per item. All items at once are the long form (``ratings`` itself): a
    matrix with a column for each of an open number of items does not scale.
    """
    return ratings.groupBy("user").pivot("item", list(items)).agg(F.first("rating"))


def tfidf_confidence(ratings: DataFrame) -> DataFrame:
    """TF-IDF weights with users as documents and items as terms, long form.

    ``idf = ln((1 + n_users) / (1 + df)) + 1`` (smoothed), ``w = rating * idf``,
    then each user's vector is scaled to unit L2 norm. Missing cells stay absent.
    """
    n = ratings.agg(F.countDistinct("user")).scalar()
    df = ratings.groupBy("item").agg(F.countDistinct("user").alias("__df"))
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("__df"))) + F.lit(1.0)
    w = ratings.join(df, "item").withColumn("w", F.col("rating") * idf)
    norm = w.groupBy("user").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__norm"))
    return w.join(norm, "user").select("user", "item", (F.col("w") / F.col("__norm")).alias("weight"))
