"""Factor models on blocks: exact top lists by inner product (J7), one ALS half-step.

``top_products`` finds the ``n`` items with the greatest inner product for every user, without
scoring all items: items lie in blocks by falling norm; each user is scored against the first
blocks, and by the Cauchy-Schwarz bound only blocks whose largest norm, times the user's norm,
reaches the user's n-th score so far can hold a better item. Those blocks are a prefix of the
list of blocks, so each block of users meets just that prefix. The rest of the list is cut into
some ``PARTS`` parts, and the blocks of users into ``SLICES``: a block of users travels once for
each part that it needs and an item once for each slice, however many blocks there are. A part
is read block by block under a rising bound and gives each user at most ``n`` items, packed.

``als_half_step`` solves the regularised normal equations of implicit ALS for one side. A block
of users takes its blocks of ratings, each beside the factors of its items, in a stream and adds
up outer products, so a heavy user is spread over many rows and no group is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisit.operators.neighbours import FEATURES, POINTS, UNIT, _blocks, _list, ordered_ids
from revisit.session import ensure_checkpoint_dir

ITEMS = 1024  # of a block
USERS = 256  # of a block
NONE = -(1 << 62)  # a threshold below every score
FIRST = 8  # blocks of items that every user meets
PARTS = 6  # of the further blocks, more if a part had over PART blocks
PART = 64
SLICES = 6  # of the blocks of users
OUTER = 2048  # outer products held at once


def _matrix(column: pa.Array, row: int) -> np.ndarray:
    vectors = column[row].values
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _scores(users: np.ndarray, items: np.ndarray, seen_user: np.ndarray, seen_place: np.ndarray, base: int) -> np.ndarray:
    """Whole-number scores of a block of users and one of items; items in train get ``NONE``."""
    out = np.floor(users @ items.T * UNIT + 0.5).astype(np.int64)
    here = (seen_place >= base) & (seen_place < base + len(items))
    out[seen_user[here], seen_place[here] - base] = NONE
    return out


def _nth(scores: np.ndarray, n: int) -> np.ndarray:
    """The n-th greatest score of each row, ``NONE`` where there are fewer."""
    if scores.shape[1] < n:
        return np.full(len(scores), NONE)
    return np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]


def _item_blocks(items: DataFrame, block: int, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """``block, ids, vectors, top`` (its greatest norm) and ``place, i, id``: places by falling
    norm; ``id`` is the item's number in the order of ``i``, ``i`` itself if ``numbered``."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    items = items.withColumn("id", F.col("i").cast("int")) if numbered else items.join(ordered_ids(items, "i", "id"), "i")
    items = items.withColumn("key", F.struct((-norm).alias("fall"), "i"))
    placed = items.join(ordered_ids(items, "key", "place"), "key").checkpoint()
    rows = placed.groupBy(F.floor(F.col("place") / block).cast("int").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "vec"))).alias("rows"), F.max(-F.col("key.fall")).alias("top"))
    blocks = rows.select("block", F.col("rows.id").alias("ids"), F.col("rows.vec").alias("vectors"), "top")
    return blocks.checkpoint(), placed.select("place", "i", "id")


def _together(blocks: DataFrame, part: Column) -> DataFrame:
    """``part, block`` (its first), ``ids, items``: blocks of a part one after the other."""
    rows = blocks.groupBy(part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("block", "ids", "vectors"))).alias("rows"))
    return rows.select("part", F.col("rows.block")[0].alias("block"), F.col("rows.ids").alias("ids"), F.col("rows.vectors").alias("items"))


def _user_blocks(users: DataFrame, seen: DataFrame) -> DataFrame:
    """``p, local, vectors, su, sp``: users of a block, and (user, place of an item) in train."""
    mine = users.groupBy(F.floor(F.col("un") / USERS).cast("int").alias("p")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("un") % USERS).alias("local"), "vec"))).alias("rows"))
    train = seen.groupBy(F.floor(F.col("un") / USERS).cast("int").alias("p")).agg(
        F.collect_list(F.struct((F.col("un") % USERS).alias("su"), F.col("place").alias("sp"))).alias("train"))
    return mine.join(train, "p", "left").select("p", F.col("rows.local").alias("local"), F.col("rows.vec").alias("vectors"),
                                                F.coalesce(F.col("train.su"), F.array().cast("array<int>")).alias("su"),
                                                F.coalesce(F.col("train.sp"), F.array().cast("array<int>")).alias("sp"))


def _users_of(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in the block, vectors, and the items in train by the user's row."""
    local, vectors = _list(batch.column("local"), r), _matrix(batch.column("vectors"), r)
    su, sp = _list(batch.column("su"), r), _list(batch.column("sp"), r)
    known = np.isin(su, local)
    return local, vectors, np.searchsorted(local, su[known]), sp[known]


class _Lists:
    """The best ``n`` items of each of ``size`` users: greatest score, then smaller id."""

    def __init__(self, size: int, n: int) -> None:
        self.size, self.n, self.more, self.waiting = size, n, [], 0
        self.user, self.item, self.score = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64)

    def add(self, user: np.ndarray, item: np.ndarray, score: np.ndarray) -> bool:
        """Whether the lists were settled: newcomers wait until there are many."""
        self.more.append((user, item, score))
        self.waiting += len(user)
        if self.waiting < self.n * self.size:
            return False
        self.settle()
        return True

    def settle(self) -> None:
        user, item, score = (np.concatenate(c) for c in zip((self.user, self.item, self.score), *self.more, strict=True))
        order = np.lexsort((item, -score, user))
        first = np.searchsorted(user[order], user[order])
        order = order[np.arange(len(order)) - first < self.n]
        self.user, self.item, self.score = user[order], item[order], score[order]
        self.more, self.waiting = [], 0

    def nth(self) -> np.ndarray:
        """The n-th score of each user, ``NONE`` where there are fewer."""
        out = np.full(self.size, NONE)
        last = np.searchsorted(self.user, np.arange(self.size), "left") + self.n - 1
        full = np.flatnonzero(np.bincount(self.user, minlength=self.size) == self.n)
        out[full] = self.score[last[full]]
        return out


def _scan(n: int, size: int):  # noqa: ANN202
    """Blocks of items in order of falling norms, until no user can find a better one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                local, users, su, sp = _users_of(batch, r)
                nth, norms = _list(batch.column("nth"), r).copy(), np.linalg.norm(users, axis=1)
                ids, vectors, base = batch.column("ids")[r].values, batch.column("items")[r].values, batch.column("block")[r].as_py() * size
                lists = _Lists(len(local), n)
                for b in range(len(ids)):
                    items = _matrix(vectors, b)
                    # slack of two units for the rounding of scores
                    todo = np.flatnonzero(norms * np.linalg.norm(items, axis=1).max() * (1 + 1e-12) * UNIT + 2 >= nth)
                    if not len(todo):
                        break
                    at = np.full(len(local), -1)
                    at[todo] = np.arange(len(todo))
                    mine = at[su] >= 0
                    scores = _scores(users[todo], items, at[su[mine]], sp[mine], base + b * size)
                    x, y = np.nonzero((scores >= np.maximum(nth[todo], _nth(scores, n))[:, None]) & (scores > NONE))
                    if lists.add(todo[x].astype(np.int32), _list(ids, b)[y], scores[x, y]):
                        nth = np.maximum(nth, lists.nth())
                lists.settle()
                nth = np.maximum(nth, lists.nth())
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where((nth == NONE) | (norms == 0), -np.inf, (nth - 2) / UNIT / norms * (1 - 1e-12))
                yield pa.RecordBatch.from_pydict({
                    "p": batch.column("p").slice(r, 1), "nth": pa.array([nth]), "reach": pa.array([reach.min()]),
                    "cu": pa.array([local[lists.user].astype(np.int32)]), "ci": pa.array([lists.item]), "cs": pa.array([lists.score])})
    return run


def _merge(n: int):  # noqa: ANN202
    """One list per user from those of a block of users, which come in a stream."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(USERS, n)
        for batch in batches:
            for r in range(batch.num_rows):
                lists.add(*(_list(batch.column(c), r) for c in ("cu", "ci", "cs")))
        lists.settle()
        users, first = np.unique(lists.user, return_index=True)
        ends = pa.array(np.append(first, len(lists.user)).astype(np.int32))
        yield pa.RecordBatch.from_pydict({"un": (key[0].as_py() * USERS + users).astype(np.int32),
                                          "ids": pa.ListArray.from_arrays(ends, pa.array(lists.item)),
                                          "scores": pa.ListArray.from_arrays(ends, pa.array(lists.score))})
    return run


def top_products(users: DataFrame, items: DataFrame, seen: DataFrame, n: int, block: int = ITEMS, numbered: bool = False,
                 packed: bool = False) -> DataFrame:
    """``u, i, rank, score`` of the ``n`` items with the greatest inner product for each
    user, without those of ``seen`` (``u, i``). ``users``: ``u, vec``; ``items``: ``i, vec``.

    Exact: scores are rounded to 1e-9, equal ones ranked by the smaller item. ``numbered``
    tells that ``u`` and ``i`` are small whole numbers already (0, 1, 2, ..), which need no
    numbering. ``packed`` gives such lists as one row per user: ``u, list`` of ``i, score``.
    """
    if packed and not numbered:
        raise ValueError("packed lists are of numbers")
    ensure_checkpoint_dir(users.sparkSession)
    blocks, places = _item_blocks(items, block, numbered)
    if numbered:
        users, seen = (df.withColumn("un", F.col("u").cast("int")) for df in (users, seen))
    else:
        numbers = ordered_ids(users, "u", "un")
        users, seen = users.join(numbers, "u"), seen.join(numbers, "u")
    mine = _user_blocks(users, seen.join(places, "i").select("un", "place").distinct()).checkpoint()
    found = "p int, nth array<bigint>, reach double, cu array<int>, ci array<int>, cs array<bigint>"
    first = F.broadcast(_together(blocks.filter(F.col("block") < FIRST), F.lit(0)))  # one row of FIRST blocks
    tried = (mine.withColumn("part", F.lit(0)).withColumn("nth", F.transform("local", lambda _: F.lit(NONE))).join(first, "part")
             .mapInArrow(_scan(n, block), found).checkpoint())
    lists = tried.select("p", "cu", "ci", "cs")
    further = blocks.count() - FIRST
    if further > 0:
        size = min(PART, -(-further // PARTS))
        tops = blocks.agg(F.sort_array(F.collect_list("top"), asc=False)).scalar()  # one number per block of items
        need = (tried.select("p", "nth", "reach", tops.alias("tops"))
                .select("p", "nth", F.size(F.filter("tops", lambda t: t >= F.col("reach"))).alias("k")).filter(F.col("k") > FIRST))
        need = need.select("p", "nth", (F.col("p") % SLICES).alias("slice"), F.explode(F.sequence(
            F.lit(0), F.floor((F.col("k") - 1 - FIRST) / size).cast("int"))).alias("part"))
        parts = _together(blocks.filter(F.col("block") >= FIRST), F.floor((F.col("block") - FIRST) / size).cast("int"))
        parts = parts.withColumn("slice", F.explode(F.array(*map(F.lit, range(SLICES)))))
        rows = need.join(mine, "p").join(parts, ["part", "slice"])
        lists = lists.unionByName(rows.mapInArrow(_scan(n, block), found).select("p", "cu", "ci", "cs").filter(F.size("cu") > 0))
    lists = lists.groupBy("p").applyInArrow(_merge(n), "un int, ids array<int>, scores array<bigint>")
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct(x["ids"].alias("i"), (x["scores"] / UNIT).alias("score")))
    if packed:
        return lists.select(F.col("un").alias("u"), pairs.alias("list"))
    top = lists.select("un", F.posexplode(pairs).alias("rank", "x")).select(
        "un", F.col("x.i").alias("id"), (F.col("rank") + 1).cast("bigint").alias("rank"), "x.score")
    if numbered:
        return top.select(F.col("un").alias("u"), F.col("id").alias("i"), "rank", "score")
    return top.join(numbers, "un").join(places.select("i", "id"), "id").select("u", "i", "rank", "score")


# ------------------------------------------------------------------ J6: one half-step

def hashed_factors(ids: DataFrame, col: str, rank: int, seed: int = 42) -> DataFrame:
    """``col, vec``: a start that depends on the ids alone, numbers in [0, 1)."""
    def one(f: int) -> Column:
        h = F.md5(F.concat_ws("|", F.col(col).cast("string"), F.lit(str(f)), F.lit(str(seed))))
        return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return ids.select(col).distinct().select(col, F.array(*[one(f) for f in range(rank)]).alias("vec"))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for r in range(batch.num_rows):
            y = _matrix(batch.column("vectors"), r)
            total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        yield pa.RecordBatch.from_pydict({"at": np.arange(total.size, dtype=np.int32), "v": total.ravel()})


def _solver(gram: np.ndarray, alpha: float, reg: float):  # noqa: ANN202
    rank = len(gram)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, known = np.zeros((POINTS, rank, rank)), np.zeros((POINTS, rank)), np.zeros(POINTS, bool)
        for batch in batches:
            for r in range(batch.num_rows):
                at, v = _list(batch.column("pl"), r), _list(batch.column("v"), r)
                ids, y = _list(batch.column("fl"), r), _matrix(batch.column("vectors"), r)
                y = y[np.searchsorted(ids, _list(batch.column("cl"), r))]
                known[at] = True
                for s in range(0, len(at), OUTER):  # cells are sorted by point
                    mine, part = at[s:s + OUTER], y[s:s + OUTER]
                    weight = alpha * v[s:s + OUTER]
                    first = np.flatnonzero(np.diff(mine, prepend=-1))
                    a[mine[first]] += np.add.reduceat(weight[:, None, None] * part[:, :, None] * part[:, None, :], first)
                    b[mine[first]] += np.add.reduceat((1 + weight)[:, None] * part, first)
        local = np.flatnonzero(known)
        x = np.linalg.solve(a[local] + gram + reg * np.eye(rank), b[local][:, :, None])[:, :, 0]
        yield pa.RecordBatch.from_pydict({"un": (key[0].as_py() * POINTS + local).astype(np.int32), "vec": pa.array(list(x))})
    return run


def als_half_step(ratings: DataFrame, factors: DataFrame, alpha: float = 40.0, reg: float = 0.1,
                  weight: str | None = None) -> DataFrame:
    """Factors ``u, vec`` of all users of ``ratings`` (``u, i``) from those of the items
    (``i, vec``): ``(Y'Y + alpha * sum w y y' + reg I)^-1 sum (1 + alpha w) y``.

    ``weight`` names the column of confidence weights (all 1 unless given). The other half-step
    is the same with ``u`` and ``i`` exchanged.
    """
    ensure_checkpoint_dir(ratings.sparkSession)
    users, items = ordered_ids(ratings, "u", "un"), ordered_ids(factors, "i", "it")
    # Factors in blocks of items, in the order of their numbers.
    ys = (factors.join(items, "i").groupBy(F.floor(F.col("it") / FEATURES).cast("int").alias("c"))
          .agg(F.sort_array(F.collect_list(F.struct((F.col("it") % FEATURES).alias("fl"), "vec"))).alias("rows"))
          .select("c", F.col("rows.fl").alias("fl"), F.col("rows.vec").alias("vectors"))).checkpoint()
    parts = ys.mapInArrow(_gram, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toArrow()  # rank * rank numbers
    rank = int(round(parts.num_rows ** 0.5))
    gram = parts["v"].to_numpy().reshape(rank, rank)
    value = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    cells = ratings.join(users, "u").join(items, "i").select(F.lit(0).alias("g"), F.col("un").alias("point"), F.col("it").alias("feature"), value.alias("w"))
    rows = _blocks(cells, "w").join(ys, "c")
    solved = rows.select("p", "pl", "cl", "v", "fl", "vectors").groupBy("p").applyInArrow(_solver(gram, alpha, reg), "un int, vec array<double>")
    return solved.join(users, "un").select("u", "vec")
