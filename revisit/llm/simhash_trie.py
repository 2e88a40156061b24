"""SimHash near-duplicates by a self-join of binary tries.

A text's fingerprint: A-Z are lower-cased, words are split at ASCII white space, and every
window of ``size`` words (repeats count, words joined by one space) is hashed by XXH64 with
seed 42; a bit is set if it is set in more than half of the hashes. A text with fewer words
is one window; a text without words, or a null, has fingerprint zero.

The join of all distinct fingerprints with at most ``errors`` differing bits:

1. *Rotated tries.* Two such fingerprints agree up to ``errors // parts`` bits in one of
   ``parts`` runs of bits. So the fingerprints are put in ``parts`` binary tries, each of
   which reads another run first; below a root path the budget is ``errors // parts`` within
   that run and ``errors`` after it. Near the roots, where every node exists, that keeps the
   number of node pairs small; no pair is lost.
2. *Blocks.* Counts of nodes, ``STEP`` bits deeper at a time, cut each trie into blocks: the
   highest nodes with at most ``leaf`` fingerprints. A crowded part of the space is cut
   deeper, so a block is bounded whatever the data are.
3. *Node pairs.* From (root, root) on, pairs of nodes are replaced by pairs of their
   children; differing bits add up, and a pair over its budget is dropped. Each turn is a
   join with the table of nodes. Pairs of blocks remain.
4. *Inside a pair of blocks* a task goes on bit by bit, on arrays of ranges in the two
   sorted blocks, prunes by the same budgets, and compares the few fingerprints left in a
   small range. Ranges that are linked already are skipped, and a task returns a spanning
   set of the links it found (at most one per fingerprint), never all pairs.

Components of the links give the classes (``graph.components``).

Defined results: rows with equal fingerprints are always in one component (also those
without words); a row with a null ``doc_id`` links as others do, and its component is the
smallest id that it reaches, null if there is none; repeated rows come out repeatedly; an
empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisit.llm.graph import components
from revisit.llm.shared import keep, shuffle_parts
from revisit.llm.words import as_bytes

SEED = 42
BITS = 64
STEP = 4  # bits from a node to its children in the tables
STRIDE = 12  # bits that one count over the fingerprints reaches down
LEAF = 16_384  # fingerprints in a block, at most
WIDE = 100_000  # node pairs that a task holds at one level, at most
SMALL = 16  # a pair of ranges with so many comparisons is compared
SPAN = 65_536  # windows hashed at once


def fingerprint(text: bytes | None, size: int = 4) -> int:
    """The SimHash of one whole text, as an unsigned integer."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    size = min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    flat, n = b" ".join(words), len(words) - size + 1
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, n, SPAN):
        a, b = starts[at:min(at + SPAN, n)].tolist(), ends[at + size - 1:min(at + SPAN, n) + size - 1].tolist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(flat[i:j], SEED) for i, j in zip(a, b)), "<u8", len(a))
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id, bits`` (the fingerprint as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, size) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, bits bigint")


# ------------------------------------------------------------------ nodes as columns

def _top(key: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits of a 64-bit key, the others zero."""
    if isinstance(depth, int):
        return key.bitwiseAND(F.lit(-1 << (BITS - depth))) if depth else F.lit(0).cast("bigint")
    mask = F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(BITS) - depth).cast("int"))
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(key.bitwiseAND(mask))


def _turned(bits: Column, by: int) -> Column:
    """``bits`` rotated to the left."""
    return bits if not by else F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, BITS - by))


def runs(parts: int) -> list[tuple[int, int]]:
    """Offset and length of each run of bits, first bits first."""
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(points: DataFrame, parts: int) -> DataFrame:
    """``r, key``: each fingerprint as it is read by each trie."""
    return points.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("r"), _turned(F.col("bits"), at).alias("key")) for r, (at, _) in enumerate(runs(parts))])).alias("k")).select("k.*")


def blocks(points: DataFrame, parts: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """The nodes whose parent holds more than ``leaf`` fingerprints (``r, depth, prefix,
    open``), and the blocks (``r, depth, prefix, keys``). Where a trie is no larger than
    ``leaf``, its root is the one block and there are no such nodes."""
    nodes, cut, at, crowded = [], [], 0, None
    while True:
        keys = _keys(points, parts)
        if crowded is not None:
            keys = keys.withColumn("prefix", _top(F.col("key"), at)).join(crowded, ["r", "prefix"], "left_semi").drop("prefix")
        down = min(at + STRIDE, BITS)
        depths = list(range(at + STEP, down + 1, STEP))
        counts = keep(keys.groupBy("r", _top(F.col("key"), down).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), "trie-counts")
        levels, ladder = {down: counts}, counts
        for d in reversed([0] * (at == 0) + depths[:-1]):
            levels[d] = levels[d + STEP].groupBy("r", _top(F.col("prefix"), d).alias("prefix")).agg(F.sum("n").alias("n"))
        for d in levels:  # the count at each depth above, beside each deepest prefix
            up = levels[d].select("r", F.col("prefix").alias("up"), F.col("n").alias(f"n{d}"))
            ladder = ladder.withColumn("up", _top(F.col("prefix"), d)).join(up, ["r", "up"]).drop("up")
        ladder = keep(ladder, "trie-ladder")
        for d in depths:
            parent = F.col(f"n{d - STEP}") > leaf if f"n{d - STEP}" in ladder.columns else F.lit(True)
            nodes.append(ladder.filter(parent).select(
                "r", F.lit(d).alias("depth"), _top(F.col("prefix"), d).alias("prefix"), (F.col(f"n{d}") > leaf).alias("open")).distinct())
        ends = F.coalesce(*[F.when(F.col(f"n{d}") <= leaf, F.lit(d)) for d in sorted(levels)])
        ends = ladder.select("r", "prefix", ends.alias("depth")).filter("depth is not null")
        if at == 0:  # at most parts * 2 ** STRIDE rows
            ends = F.broadcast(ends)
        cut.append(keys.withColumn("prefix", _top(F.col("key"), down)).join(ends, ["r", "prefix"])
                   .groupBy("r", "depth", _top(F.col("prefix"), F.col("depth")).alias("prefix")).agg(F.collect_list("key").alias("keys")))
        cut[-1] = keep(cut[-1], "trie-blocks")
        crowded = ladder.filter(F.col(f"n{down}") > leaf).select("r", "prefix")
        if down == BITS or crowded.isEmpty():
            break
        at = down
    every, all_blocks = nodes[0], cut[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    for more in cut[1:]:
        all_blocks = all_blocks.unionByName(more)
    return keep(every, "trie-nodes"), all_blocks


def block_pairs(nodes: DataFrame, parts: int, errors: int) -> DataFrame:
    """Pairs of blocks ``r, da, pa, db, pb`` that the budgets allow; each unordered pair once."""
    spark = nodes.sparkSession
    lens = [n for _, n in runs(parts)]
    head = F.element_at(F.array(*map(F.lit, lens)), F.col("r") + 1)
    kids = (nodes.select("r", (F.col("depth") - STEP).alias("d"), _top(F.col("prefix"), F.col("depth") - STEP).alias("p"), "depth", "prefix", "open")
            .unionByName(nodes.filter("not open").select("r", F.col("depth").alias("d"), F.col("prefix").alias("p"), "depth", "prefix", "open")))

    def side(x: str) -> DataFrame:
        return kids.select("r", F.col("d").alias(f"d{x}"), F.col("p").alias(f"p{x}"), F.col("depth").alias(f"nd{x}"),
                           F.col("prefix").alias(f"np{x}"), F.col("open").alias(f"o{x}"))

    zero = F.lit(0).cast("bigint")
    now = spark.range(parts).select(F.col("id").cast("int").alias("r"), F.lit(0).alias("da"), zero.alias("pa"), F.lit(0).alias("db"), zero.alias("pb"))
    done = None
    while True:
        j = now.join(side("a"), ["r", "da", "pa"]).join(side("b"), ["r", "db", "pb"])
        once = ~((F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb"))) | (
            F.struct("nda", "npa") <= F.struct("ndb", "npb"))
        shared = F.least("nda", "ndb")
        differ = F.col("npa").bitwiseXOR(F.col("npb"))
        within = (F.bit_count(_top(differ, F.least(shared, head))) <= errors // parts) & (F.bit_count(_top(differ, shared)) <= errors)
        j = keep(j.filter(once & within).select("r", F.col("nda").alias("da"), F.col("npa").alias("pa"), F.col("ndb").alias("db"),
                                                F.col("npb").alias("pb"), (F.col("oa") | F.col("ob")).alias("more")), "trie-pairs")
        ready = j.filter("not more").drop("more")
        done = ready if done is None else done.unionByName(ready)
        now = j.filter("more").drop("more")
        if now.isEmpty():
            return done


# ------------------------------------------------------------------ inside a pair of blocks

class Classes:
    """Classes of positions under the links seen so far."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.root[x], self.root[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = self.root[self.root]
                if np.array_equal(further, self.root):
                    break
                self.root = further

    def settled(self) -> Callable[[np.ndarray], np.ndarray]:
        """A test: do both ranges of a node pair lie in one class?"""
        root = self.root
        changes = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))

        def test(f: np.ndarray) -> np.ndarray:
            la, ha, lb, hb = f[:4]
            return (changes[la] == changes[ha - 1]) & (changes[lb] == changes[hb - 1]) & (root[la] == root[lb])
        return test


def _compare(keys: np.ndarray, f: np.ndarray, errors: int, classes: Classes) -> None:
    """Compare all fingerprints of the node pairs ``f``."""
    rows, cols = f[1] - f[0], f[3] - f[2]
    size = rows * cols
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // (SMALL * WIDE), prepend=0))
    for part in np.split(np.arange(f.shape[1]), cuts):
        n = size[part]
        which = np.repeat(part, n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        x, y = f[0][which] + at // cols[which], f[2][which] + at % cols[which]
        near = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= errors)
        classes.link(x[near], y[near])


def meet(a: np.ndarray, b: np.ndarray | None, head: int, head_errors: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is linked between two blocks (or within one): the traversal of
    their tries. ``a``, ``b``: unsigned keys; the first ``head`` bits may differ in
    ``head_errors`` places, all in ``errors``."""
    a = np.sort(a)
    keys = a if b is None else np.concatenate((a, np.sort(b)))
    second = (0, len(a)) if b is None else (len(a), len(keys))
    classes, ones = Classes(len(keys)), {}
    stack = [(0, np.array([[0], [len(a)], [second[0]], [second[1]], [0]], np.int64))]
    while stack:
        depth, f = stack.pop()
        f = f[:, ~classes.settled()(f)]
        while f.shape[1]:
            small = ((f[1] - f[0]) * (f[3] - f[2]) <= SMALL) | (depth == BITS)
            _compare(keys, f[:, small], errors, classes)
            f = f[:, ~small]
            if f.shape[1] > WIDE:  # the pairs with the fewest differing bits first
                f = f[:, np.argsort(-f[4], kind="stable")]
                stack += [(depth, part) for part in np.array_split(f, 2 * f.shape[1] // WIDE, axis=1)]
                break
            if depth not in ones:
                ones[depth] = np.concatenate(([0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)))).astype(np.int64)
            c, (la, ha, lb, hb, e) = ones[depth], f
            ma, mb = ha - (c[ha] - c[la]), hb - (c[hb] - c[lb])
            depth += 1
            apart = np.flatnonzero((la != lb) | (ha != hb))  # a node with itself gives its two children's pair once
            f = np.concatenate([np.stack((la, ma, lb, mb, e)), np.stack((ma, ha, mb, hb, e)), np.stack((la, ma, mb, hb, e + 1)),
                                np.stack((ma, ha, lb, mb, e + 1))[:, apart]], axis=1)
            f = f[:, (f[0] < f[1]) & (f[2] < f[3]) & (f[4] <= (head_errors if depth <= head else errors))]
    moved = np.flatnonzero(classes.root != np.arange(len(keys)))
    return keys[moved], keys[classes.root[moved]]


def links(points: DataFrame, errors: int = 4, parts: int = 3, leaf: int = LEAF) -> DataFrame:
    """``a, b``: links that span the components of the distinct fingerprints ``points.bits``."""
    nodes, found = blocks(points, parts, leaf)
    cut = runs(parts)
    zero = F.lit(0).cast("bigint")
    roots = found.filter("depth = 0").select("r", F.col("depth").alias("da"), zero.alias("pa"), F.col("depth").alias("db"), zero.alias("pb"))
    pairs = roots if nodes.isEmpty() else block_pairs(nodes, parts, errors)
    sides = [found.select("r", F.col("depth").alias(f"d{x}"), F.col("prefix").alias(f"p{x}"), F.col("keys").alias(f"k{x}")) for x in "ab"]
    same = (F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb"))
    rows = (pairs.withColumn("same", same).join(sides[0], ["r", "da", "pa"]).join(sides[1], ["r", "db", "pb"])
            .select("r", "ka", F.when(~F.col("same"), F.col("kb")).alias("kb")))
    parts_now = shuffle_parts(points.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def array(values: pa.ListScalar) -> np.ndarray:
            return values.values.to_numpy(zero_copy_only=False).view(np.uint64)

        for batch in batches:
            for r, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                at, head = cut[r]
                x, y = meet(array(a), array(b) if b.is_valid else None, head, errors // parts, errors)
                back = [((k << np.uint64(BITS - at)) | (k >> np.uint64(at)) if at else k).view(np.int64) for k in (x, y)]
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in back], ["a", "b"])

    return rows.repartition(parts_now).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 4, errors: int = 4, parts: int = 3, leaf: int = LEAF) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` of every row: the smallest
    id that can be reached over fingerprints with at most ``errors`` differing bits."""
    rows = keep(fingerprints(docs, size), "fingerprints")
    points = keep(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "points")
    classes = keep(components(links(points, errors, parts, leaf), "trie-links"), "classes").withColumnRenamed("node", "bits")
    known = points.join(classes, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = keep(known.join(ids, "component").select("bits", "component_id"), "answers")
    return rows.join(answers, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
