"""Item-item and user-user neighbourhood recommenders (J4, J5), exact, over matrix tiles.

Both algorithms are one computation with the roles of users and items swapped. A *point* has
a sparse vector over *features*: items over users (item-item), users over items (user-user).
Ratings are centred on the point's mean; the similarity of two points is the cosine of their
centred vectors, features missing in either counting as zero. The score of point ``a`` for
feature ``c`` is ``mean(a) + sum(s * dev(b, c)) / sum(s)`` over the ``k`` points ``b`` most
similar to ``a`` among those that have a rating for ``c``.

The rating matrix is cut into blocks of ``POINTS`` x ``FEATURES`` cells, one row each, which
a heavy user or a popular item only spreads over more blocks:

1. *Similarities.* Two blocks with the same features give a tile of partial products; a task
   multiplies them through their shared features and returns the tile's non-zero sums, and
   the tiles of two blocks of points are added up in a stream. No row per co-rated pair
   leaves a task.
2. *Scores.* Each tile meets the blocks of its second points. A group (points ``a``, features
   ``c``) takes its tiles in a stream and holds at most the ``k`` best neighbours of each
   cell. It returns the best ``n`` cells of each user (with ties), without those in train.
3. The best ``n`` of each user over all groups.

Every fold is computed in the same jobs: the fold is part of each key. Similarities and
scores are rounded to 1e-9, so results do not depend on the order of sums; ties go to the
smaller id. Points or features without a common rating give no score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revisit.schemas import N_RECS
from revisit.session import ensure_checkpoint_dir

POINTS = 256  # of a block
FEATURES = 1024  # of a block
UNIT = 1_000_000_000  # similarities and scores are whole numbers of 1 / UNIT
SLICE = 1 << 20  # products that a task holds at once
NEIGHBOURS = 10


def ordered_ids(df: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct values of ``col`` numbered 0, 1, 2, .. in their order as ``out``: numbers
    inside range partitions, shifted by the sizes of those before."""
    ensure_checkpoint_dir(df.sparkSession)
    ids = df.select(col).filter(F.col(col).isNotNull()).distinct().repartitionByRange(col).sortWithinPartitions(col)
    ids = ids.withColumn("__m", F.monotonically_increasing_id()).checkpoint()
    ids = ids.select(col, F.shiftright("__m", 33).alias("__p"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)).alias("__i"))
    before = Window.partitionBy().orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = ids.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    base = base.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return ids.join(base, "__p").select(col, (F.col("__base") + F.col("__i")).cast("int").alias(out)).checkpoint()


def train_rows(folded: DataFrame) -> DataFrame:
    """``g`` and the rows of ``folded`` that are in train for fold ``g``."""
    folds = folded.select("fold").distinct().agg(F.array_sort(F.collect_set("fold"))).scalar()  # a handful
    return folded.withColumn("g", F.explode(folds)).filter(~(F.col("is_test") & (F.col("fold") == F.col("g"))))


def _blocks(rows: DataFrame, value: str) -> DataFrame:
    """``g, p, c, pl, cl, v``: one row per non-empty block, its cells as arrays."""
    cells = F.sort_array(F.collect_list(F.struct((F.col("point") % POINTS).alias("pl"), (F.col("feature") % FEATURES).alias("cl"), F.col(value).alias("v"))))
    out = rows.groupBy("g", F.floor(F.col("point") / POINTS).cast("int").alias("p"), F.floor(F.col("feature") / FEATURES).cast("int").alias("c")).agg(cells.alias("cells"))
    return out.select("g", "p", "c", *[F.col(f"cells.{x}").alias(x) for x in ("pl", "cl", "v")])


def _matches(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions at which ``x`` equals the sorted ``y``, some at a time."""
    low, high = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    n = high - low
    done = np.cumsum(n)
    for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(done // SLICE, prepend=0))):
        m = n[part]
        if m.sum():
            left = np.repeat(part, m)
            yield left, low[left] + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)


def _list(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial tiles of pairs of blocks with the same features: columns g, a, b, and cells
    (point, feature, value) of both."""
    for batch in batches:
        for r in range(batch.num_rows):
            ap, af, av, bp, bf, bv = (_list(batch.column(i), r) for i in range(3, 9))
            order = np.argsort(bf, kind="stable")
            bp, bf, bv = bp[order], bf[order], bv[order]
            tile = np.zeros(POINTS * POINTS)
            for x, y in _matches(af, bf):
                tile += np.bincount(ap[x] * POINTS + bp[y], av[x] * bv[y], POINTS * POINTS)
            cell = np.flatnonzero(tile)
            yield pa.RecordBatch.from_pydict({**{c: batch.column(i).slice(r, 1) for i, c in enumerate("gab")},
                                              "cell": pa.array([cell.astype(np.int32)]), "v": pa.array([tile[cell]])})


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tile of two blocks of points, from its partial ones."""
    tile = np.zeros(POINTS * POINTS)
    for batch in batches:
        for r in range(batch.num_rows):
            tile[_list(batch.column("cell"), r)] += _list(batch.column("v"), r)
    whole = np.floor(tile * UNIT + 0.5).astype(np.int64)
    cell = np.flatnonzero(whole > 0)
    yield pa.RecordBatch.from_pydict({**{c: pa.array([k.as_py()], pa.int64() if c == "g" else pa.int32()) for c, k in zip("gab", key)},
                                      "cell": pa.array([cell.astype(np.int32)]), "s": pa.array([whole[cell].astype(np.int32)])})


class Best:
    """The ``k`` best candidates of each cell among those seen: greatest key first."""

    def __init__(self, k: int) -> None:
        self.k, self.cell, self.key, self.dev, self.new = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), []

    def add(self, cell: np.ndarray, key: np.ndarray, dev: np.ndarray) -> None:
        self.new.append((cell, key, dev))
        if sum(len(n[0]) for n in self.new) >= 2 * SLICE:
            self.settle()

    def settle(self) -> None:
        cell, key, dev = (np.concatenate([getattr(self, a), *[n[i] for n in self.new]]) for i, a in enumerate(("cell", "key", "dev")))
        order = np.lexsort((-key, cell))
        cell, key, dev = cell[order], key[order], dev[order]
        at = np.arange(len(cell))
        first = np.maximum.accumulate(np.where(np.diff(cell, prepend=-1) != 0, at, 0))
        kept = at - first < self.k
        self.cell, self.key, self.dev, self.new = cell[kept], key[kept], dev[kept], []


def _scorer(k: int, n: int, least: int, by_point: bool):  # noqa: ANN202
    """Scores of one group (points ``a``, features ``c``). Rows with a ``cell`` hold a tile, the
    means of its first points, and the ratings of its second points; rows without hold the
    cells that are in train."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, a, c = (x.as_py() for x in key)
        best, means, train = Best(k), np.zeros(POINTS), []
        for batch in batches:
            for r in range(batch.num_rows):
                points, features = _list(batch.column("pl"), r).astype(np.int64), _list(batch.column("cl"), r)
                if not batch.column("cell")[r].is_valid:
                    train.append(points * FEATURES + features)
                    continue
                means[_list(batch.column("mp"), r)] = _list(batch.column("mv"), r)
                cell, s, v = _list(batch.column("cell"), r).astype(np.int64), _list(batch.column("s"), r).astype(np.int64), _list(batch.column("v"), r)
                near = s > least
                cell, s, base = cell[near], s[near], batch.column("b")[r].as_py() * POINTS
                order = np.argsort(points, kind="stable")
                points, features, v = points[order], features[order], v[order]
                for x, y in _matches(cell % POINTS, points):
                    best.add(cell[x] // POINTS * FEATURES + features[y], (s[x] << 32) + ((1 << 31) - 1 - base - points[y]), v[y])
        best.settle()
        cells, first = np.unique(best.cell, return_index=True)
        if not len(cells):
            return
        s = (best.key >> 32).astype(np.float64)
        score = means[cells // FEATURES] + np.add.reduceat(s * best.dev, first) / np.add.reduceat(s, first)
        score = np.floor(score * UNIT + 0.5).astype(np.int64)
        if train:
            free = ~np.isin(cells, np.concatenate(train))
            cells, score = cells[free], score[free]
        user = cells // FEATURES if by_point else cells % FEATURES
        order = np.lexsort((-score, user))
        cells, score, user = cells[order], score[order], user[order]
        at = np.arange(len(cells))
        first = np.maximum.accumulate(np.where(np.diff(user, prepend=-1) != 0, at, 0))
        nth = np.minimum(first + n - 1, len(cells) - 1)
        kept = (at - first < n) | ((user[nth] == user) & (score[nth] == score))  # ties with the n-th stay
        cells, score = cells[kept], score[kept]
        yield pa.RecordBatch.from_pydict({"g": np.full(len(cells), g, np.int64), "point": (a * POINTS + cells // FEATURES).astype(np.int32),
                                          "feature": (c * FEATURES + cells % FEATURES).astype(np.int32), "score": score})
    return run


def _neighbour_scores(train: DataFrame, asked_points: bool, k: int, n: int, least: float) -> DataFrame:
    """``g, point, feature, score`` for train rows ``g, point, feature, rating, asked``; only for
    points (or else features) of ``asked`` rows."""
    stats = train.groupBy("g", "point").agg(F.avg("rating").alias("mean"))
    rows = train.join(stats, ["g", "point"]).withColumn("dev", F.col("rating") - F.col("mean"))
    norms = rows.groupBy("g", "point").agg(F.sqrt(F.sum(F.col("dev") * F.col("dev"))).alias("norm"))
    rows = rows.join(norms, ["g", "point"]).checkpoint()
    vectors = rows.filter("norm > 0").withColumn("x", F.col("dev") / F.col("norm"))
    seconds = _blocks(vectors, "x").checkpoint()
    firsts = _blocks(vectors.filter("asked"), "x") if asked_points else seconds
    pairs = (firsts.select("g", "c", F.col("p").alias("a"), F.col("pl").alias("ap"), F.col("cl").alias("af"), F.col("v").alias("av"))
             .join(seconds.select("g", "c", F.col("p").alias("b"), F.col("pl").alias("bp"), F.col("cl").alias("bf"), F.col("v").alias("bv")), ["g", "c"])
             .select("g", "a", "b", "ap", "af", "av", "bp", "bf", "bv"))
    tiles = (pairs.mapInArrow(_products, "g bigint, a int, b int, cell array<int>, v array<double>")
             .groupBy("g", "a", "b").applyInArrow(_added, "g bigint, a int, b int, cell array<int>, s array<int>").filter("size(cell) > 0"))
    means = (rows.select("g", "point", "mean").distinct().groupBy("g", F.floor(F.col("point") / POINTS).cast("int").alias("a"))
             .agg(F.collect_list(F.struct((F.col("point") % POINTS).alias("mp"), F.col("mean").alias("mv"))).alias("m"))
             .select("g", "a", "m.mp", "m.mv"))
    rated = _blocks(rows if asked_points else rows.filter("asked"), "dev").checkpoint()
    met = tiles.join(means, ["g", "a"]).checkpoint().join(rated.withColumnRenamed("p", "b"), ["g", "b"])
    taken = rated.select("g", F.col("p").alias("a"), "c", "pl", "cl")
    groups = met.select("g", "a", "c", "b", "cell", "s", "mp", "mv", "pl", "cl", "v").unionByName(taken, allowMissingColumns=True)
    return groups.groupBy("g", "a", "c").applyInArrow(_scorer(k, n, int(round(least * UNIT)), asked_points), "g bigint, point int, feature int, score bigint")


def knn_recommend(folded: DataFrame, by: str, k: int = NEIGHBOURS, n: int = N_RECS, min_similarity: float | None = None) -> DataFrame:
    """J4 (``by="item"``) or J5 (``by="user"``): the ``n`` best unrated items of each fold's test
    users. Rows ``algorithm, fold, user, item, rank, score``; ``folded`` as from ``user_folds``.

    A neighbour's similarity must be above ``min_similarity``: 1e-6 for items and 0 for users
    unless given. Users and items may be of any type with an order. The list is shorter where
    fewer items have a neighbour.
    """
    if by not in ("item", "user"):
        raise ValueError("by: item or user")
    least = min_similarity if min_similarity is not None else (1e-6 if by == "item" else 0.0)
    users, items = ordered_ids(folded, "user", "u"), ordered_ids(folded, "item", "i")
    point, feature = ("i", "u") if by == "item" else ("u", "i")
    train = train_rows(folded).join(users, "user").join(items, "item").select(
        "g", F.col(point).alias("point"), F.col(feature).alias("feature"), F.col("rating").cast("double").alias("rating"),
        (F.col("fold") == F.col("g")).alias("asked"))
    scores = _neighbour_scores(train, by == "user", k, n, least).withColumnsRenamed({"point": point, "feature": feature})
    order = Window.partitionBy("g", "u").orderBy(F.desc("score"), "i")
    top = scores.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n)
    return top.join(users, "u").join(items, "i").select(
        F.lit("ItemItem" if by == "item" else "UserUser").alias("algorithm"), F.col("g").cast("bigint").alias("fold"), "user", "item", "rank",
        (F.col("score") / UNIT).alias("score"))
