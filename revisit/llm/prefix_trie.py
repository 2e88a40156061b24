"""The prefix trie of conversations, by the Euler-tour technique.

A node is a distinct sequence of the first turns (role, text) of some conversation; the root
has none. ``nodes`` gives per node its smallest member, its parent, members, children,
childless nodes below, and the text bytes that sharing its subtree's prefixes saves.

1. *Turns.* Conversations are sorted by (id, turn, role, text) over range partitions, so a
   conversation of any length is spread; a turn's place comes from its row number there and
   a small table with one row per (conversation, partition).
2. *Prefixes.* A sequence of turns is known by sums, over its turns, of four 32-bit hashes
   of (place, role, text): running sums inside (conversation, partition), then over the
   small table. Equal sums are one node, counted by partial aggregation.
3. *Tour.* Each node gives an enter and an exit arc. After an enter arc comes the first
   child's enter arc, or the node's exit; after an exit arc the next sibling's enter arc, or
   the parent's exit. Children stand in the order of their smallest member; next siblings
   are found within (parent, block of ids).
4. *List ranking.* Nodes are numbered in the order (smallest member, depth) over range
   partitions, in which a conversation's unshared turns, and mostly its neighbours, lie
   together. Each partition joins its arcs into chains; the chains form a shorter list.
   While it has more than ``last`` elements, about a quarter are spliced out a round (a
   random-mate step, one join); the rest is ranked at once, and the spliced ones are put
   back, round by round. Every arc then has the sums of all weights before it.
5. *Subtrees.* Enter arcs weigh 1 for a childless node, and the node's saving. A subtree's
   sums are the difference between those at its exit and its enter arc.

Hashes: 128 bits a prefix, so two prefixes of a corpus do not meet in practice.

Defined results: a null role or text is empty; a null turn comes first, equal turns go by
role, then text; repeated rows are repeated turns; rows without a ``conv_id`` belong to no
conversation and are left out; an empty table gives no node, not even a root; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.llm.shared import keep, shuffle_parts

SIBLINGS = 65_536  # ids in a block of siblings (a parent's children have distinct ids)
LAST = 8_192  # elements of a list that one task ranks at once
IDS = 512  # ids joined into one piece of a digest's input
_PLACE = (1 << 33) - 1  # row numbers: partition in the high bits, place in the low 33
_HASHES = ["e1", "e2", "e3", "e4"]
_SUMS = ["s1", "s2", "s3", "s4"]


# ------------------------------------------------------------------ turns and prefixes

def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, place, a1, a2, size``: every turn with its range partition, its place
    there, 128 bits that stand for role and text, and its text's UTF-8 bytes."""
    n = shuffle_parts(conversations.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("bigint"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.filter("conv_id is not null").repartitionByRange(n, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    out = rows.select("conv_id", row.alias("row"), F.xxhash64("role", "text").alias("a1"),
                      F.xxhash64(F.lit(7), "text", F.length("role"), "role").alias("a2"), F.octet_length("text").cast("bigint").alias("size"))
    out = out.select("conv_id", F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND(F.lit(_PLACE)).alias("place"), "a1", "a2", "size")
    return keep(out, "turns")


def shared_heads(all_turns: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Conversations rebuilt on the head of another: ``conv_id, part, i, a1, a2, size``, one
    row per turn with its place ``i`` in the rebuilt conversation, and a row with a null
    ``i`` for each conversation that has none.

    ``base`` and ``heads`` are expressions of ``conv_id``: the first ``heads`` (at most
    ``most``) turns of conversation ``base``, then the own turns after the first ``heads``."""
    pieces = keep(all_turns.groupBy("conv_id", "part").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n")), "pieces")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    every = pieces.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({"base": base, "heads": heads})
    given = every.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    every = every.join(given, "base", "left").select("conv_id", "base", "n", "heads", F.least("heads", F.coalesce("there", F.lit(0))).alias("taken"))
    every = keep(every, "conversations")
    placed = all_turns.join(pieces.drop("n").join(every.select("conv_id", "heads", "taken"), "conv_id"), ["conv_id", "part"])
    placed = placed.withColumn("at", F.col("place") - F.col("low") + F.col("offset"))
    own = placed.filter("at >= heads").select("conv_id", "part", (F.col("at") - F.col("heads") + F.col("taken")).alias("i"), "a1", "a2", "size")
    first = placed.filter(F.col("at") < most).select(F.col("conv_id").alias("base"), F.col("at").alias("i"), "a1", "a2", "size")
    wanted = every.filter("taken > 0").select("conv_id", "base", F.explode(F.expr("sequence(0, taken - 1)")).alias("i"))
    head = wanted.join(first, ["base", "i"]).select("conv_id", F.lit(-1).cast("bigint").alias("part"), "i", "a1", "a2", "size")
    none = every.filter("taken = 0 and n <= heads").select("conv_id", F.lit(-1).cast("bigint").alias("part"), *[
        F.lit(None).cast("bigint").alias(c) for c in ("i", "a1", "a2", "size")])
    return own.unionByName(head).unionByName(none)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, size, end``: every prefix of every conversation, the
    empty one included, with 128 bits that stand for it and for its parent."""
    for c, (a, salt, high) in zip(_HASHES, (("a1", 1, 0), ("a1", 1, 1), ("a2", 2, 0), ("a2", 2, 1))):
        h = F.xxhash64(F.lit(salt), "i", a)
        h = F.shiftrightunsigned(h, 32) if high else h.bitwiseAND(F.lit(0xFFFFFFFF))
        rebuilt = rebuilt.withColumn(c, F.coalesce(h, F.lit(0)))
    rebuilt = keep(rebuilt.drop("a1", "a2"), "rebuilt")
    real = rebuilt.filter("i is not null")
    inside = Window.partitionBy("conv_id", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = real.groupBy("conv_id", "part").agg(*[F.sum(e).alias(f"t{e}") for e in _HASHES])
    pieces = pieces.select("conv_id", "part", *[F.coalesce(F.sum(f"t{e}").over(before), F.lit(0)).alias(f"t{e}") for e in _HASHES])
    sums = (real.withColumns({s: F.sum(e).over(inside) for s, e in zip(_SUMS, _HASHES)}).join(pieces, ["conv_id", "part"])
            .withColumns({s: F.col(s) + F.col(f"t{e}") for s, e in zip(_SUMS, _HASHES)}))

    def key(salt: int, depth: Column, parts: list[Column]) -> Column:
        return F.xxhash64(F.lit(salt), depth, *(parts if salt == 1 else parts[::-1]))

    depth = F.col("i") + 1
    here, above = [F.col(s) for s in _SUMS], [F.col(s) - F.col(e) for s, e in zip(_SUMS, _HASHES)]
    rows = sums.select("conv_id", depth.alias("depth"), key(1, depth, here).alias("k1"), key(2, depth, here).alias("k2"),
                       key(1, depth - 1, above).alias("p1"), key(2, depth - 1, above).alias("p2"), "size")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    lengths = rebuilt.groupBy("conv_id").agg(F.coalesce(F.max("i") + 1, F.lit(0)).alias("length"))
    roots = lengths.select("conv_id", zero.alias("depth"), key(1, zero, [zero] * 4).alias("k1"), key(2, zero, [zero] * 4).alias("k2"),
                           none.alias("p1"), none.alias("p2"), zero.alias("size"))
    # The last turn of a conversation is that of its last piece.
    last = real.groupBy("conv_id", "part").agg(F.max("i").alias("i"))
    ends = last.groupBy("conv_id").agg(F.max("i").alias("last")).select("conv_id", (F.col("last") + 1).alias("depth"), F.lit(True).alias("end"))
    ends = ends.unionByName(lengths.filter("length = 0").select("conv_id", zero.alias("depth"), F.lit(True).alias("end")))
    return keep(rows.unionByName(roots).join(ends, ["conv_id", "depth"], "left").withColumn("end", F.coalesce("end", F.lit(False))), "prefixes")


# ------------------------------------------------------------------ the tour

def linked_nodes(paths: DataFrame) -> DataFrame:
    """``m, k1, k2, conv_id, depth, n_convs, size, up, parent_conv_id``: the nodes, numbered in
    the order (smallest member, depth), with their parent's number and smallest member."""
    n = shuffle_parts(paths.sparkSession)
    nodes = paths.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.min("size").alias("size"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = keep(nodes.repartitionByRange(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
                 .withColumn("m", F.monotonically_increasing_id()), "trie-nodes")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("m").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return keep(nodes.join(parents, ["p1", "p2"], "left").drop("p1", "p2"), "linked-nodes")


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The arcs ``id, next, leaf, save`` (enter arc ``2 m``, exit arc ``2 m + 1``; no ``next``
    after the last), and ``m, n_children`` of the nodes that have children."""
    block = F.floor(F.col("conv_id") / SIBLINGS)
    inside = Window.partitionBy("up", "block").orderBy("conv_id")
    across = Window.partitionBy("up").orderBy("block")
    under = nodes.filter("up is not null").select("m", "up", "conv_id", block.alias("block"))
    groups = under.groupBy("up", "block").agg(F.min_by("m", "conv_id").alias("first"), F.count(F.lit(1)).alias("n"))
    after = groups.select("up", "block", F.lead("first").over(across).alias("later"))
    follow = (under.withColumn("next", F.lead("m").over(inside)).join(after, ["up", "block"])
              .select("m", F.coalesce("next", "later").alias("sibling")))
    kids = keep(groups.groupBy("up").agg(F.min_by("first", "block").alias("first"), F.sum("n").alias("n_children")).withColumnRenamed("up", "m"), "kids")
    all_nodes = nodes.select("m", "up", "n_convs", "size").join(follow, "m", "left").join(kids, "m", "left")
    enter = F.struct((F.col("m") * 2).alias("id"), F.coalesce(F.col("first") * 2, F.col("m") * 2 + 1).alias("next"),
                     F.when(F.col("first").isNull(), 1).otherwise(0).cast("bigint").alias("leaf"),
                     ((F.col("n_convs") - 1) * F.col("size")).alias("save"))
    leave = F.struct((F.col("m") * 2 + 1).alias("id"), F.coalesce(F.col("sibling") * 2, F.col("up") * 2 + 1).alias("next"),
                     F.lit(0).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("save"))
    return all_nodes.select(F.explode(F.array(enter, leave)).alias("arc")).select("arc.*"), kids.select("m", "n_children")


# ------------------------------------------------------------------ list ranking

def chains(ids: np.ndarray, succ: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For some elements of a list: the position of the first one of each element's chain, the
    weights before the element in its chain, and whether it ends its chain. ``succ`` holds
    ids, -1 for none; pointers are doubled until all stand at a first element."""
    order = np.argsort(ids)
    there = np.searchsorted(ids, succ, sorter=order)
    at = order[np.minimum(there, len(ids) - 1)]
    known = ids[at] == succ
    pred = np.arange(len(ids))
    pred[at[known]] = np.flatnonzero(known)
    first = pred == np.arange(len(ids))
    before = [np.where(first, 0, w[pred]) for w in weights]
    while True:
        further = pred[pred]
        if np.array_equal(further, pred):
            return pred, before, ~known
        before = [b + b[pred] for b in before]
        pred = further


_LIST = "id bigint, next bigint, leaf bigint, save bigint"


def _numpy(table: pa.Table) -> tuple[np.ndarray, ...]:
    ids, leaf, save = (table.column(c).to_numpy() for c in ("id", "leaf", "save"))
    return ids, table.column("next").combine_chunks().fill_null(-1).to_numpy(), leaf, save


def _contract(table: pa.Table) -> pa.Table:
    """Chains of one partition: each element's chain and weights before it there, and, at a
    chain's first element, the chain as one element of the shorter list."""
    ids, succ, leaf, save = _numpy(table)
    head, (bl, bs), ends = chains(ids, succ, [leaf, save])
    tail = np.flatnonzero(ends)
    out = {c: np.zeros(len(ids), np.int64) for c in ("next", "leaf", "save")}
    for c, v in (("next", succ[tail]), ("leaf", bl[tail] + leaf[tail]), ("save", bs[tail] + save[tail])):
        out[c][head[tail]] = v
    first = head == np.arange(len(ids))
    return pa.table({"id": ids, "head": ids[head], "before_leaf": bl, "before_save": bs, "first": first,
                     "next": pa.array(out["next"], mask=out["next"] < 0), "leaf": out["leaf"], "save": out["save"]})


def _short(rows: DataFrame) -> DataFrame:
    """Weights before each element of a list that one task holds (at most ``last``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if any(b.num_rows for b in held):
            ids, succ, leaf, save = _numpy(pa.Table.from_batches(held))
            _, (bl, bs), _ = chains(ids, succ, [leaf, save])
            yield pa.RecordBatch.from_pydict({"id": ids, "before_leaf": bl, "before_save": bs})
    return rows.repartition(1).mapInArrow(run, "id bigint, before_leaf bigint, before_save bigint")


def rank(arcs: DataFrame, last: int = LAST) -> DataFrame:
    """``id, before_leaf, before_save``: sums of the weights of all elements before each one
    of the list ``id, next, leaf, save``. ``id >> 34`` tells which elements lie together."""
    level = keep(arcs.groupBy(F.shiftright("id", 34).alias("part")).applyInArrow(
        _contract, "id bigint, head bigint, before_leaf bigint, before_save bigint, first boolean, next bigint, leaf bigint, save bigint"), "chains")
    now, spliced, turn = level.filter("first").select("id", "next", "leaf", "save"), [], 0
    while now.limit(last + 1).count() > last:
        turn += 1
        coin = F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(2)) == 1
        # An element whose coin is 1, after one whose coin is 0, goes into that one.
        out = now.filter(coin).select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("leaf").alias("l2"), F.col("save").alias("s2"), F.lit(True).alias("gone"))
        step = keep(now.withColumn("stays", ~coin).join(out, "next", "left").withColumn("takes", F.col("stays") & F.col("gone").isNotNull()), "splice")
        taken = step.filter("takes").select(F.col("next").alias("id"), F.col("id").alias("host"), F.col("leaf").alias("off_leaf"), F.col("save").alias("off_save"))
        spliced.append(taken)
        left = step.select("id", F.when(F.col("takes"), F.col("n2")).otherwise(F.col("next")).alias("next"),
                           F.when(F.col("takes"), F.col("leaf") + F.col("l2")).otherwise(F.col("leaf")).alias("leaf"),
                           F.when(F.col("takes"), F.col("save") + F.col("s2")).otherwise(F.col("save")).alias("save"))
        now = keep(left.join(taken.select("id"), "id", "left_anti"), "list")
    known = keep(_short(now), "ranked")
    for taken in reversed(spliced):
        back = taken.join(known.withColumnRenamed("id", "host"), "host").select(
            "id", (F.col("before_leaf") + F.col("off_leaf")).alias("before_leaf"), (F.col("before_save") + F.col("off_save")).alias("before_save"))
        known = keep(known.unionByName(back), "ranked")
    starts = known.select(F.col("id").alias("head"), F.col("before_leaf").alias("bl"), F.col("before_save").alias("bs"))
    return level.join(starts, "head").select("id", (F.col("before_leaf") + F.col("bl")).alias("before_leaf"),
                                             (F.col("before_save") + F.col("bs")).alias("before_save"))


# ------------------------------------------------------------------ digests of the ends

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one node, joined to one string each."""
    for batch in batches:
        k1, k2, ids = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(ids)]
        starts = [s for a, b in zip(bounds, bounds[1:]) for s in range(a, b, IDS)]
        stops = [min(s + IDS, b) for a, b in zip(bounds, bounds[1:]) for s in range(a, b, IDS)]
        text = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(starts, stops)]
        yield pa.RecordBatch.from_pydict({"k1": k1[starts], "k2": k2[starts], "first": ids[starts], "ids": text})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which come in order; only its state is held."""
    now, sha = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (k1, k2) == now:
                sha.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((*now, sha.hexdigest()))
            now, sha = (k1, k2), hashlib.sha256(ids.encode())
        yield _digests(done)
    if now is not None:
        yield _digests([(*now, sha.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                      ["k1", "k2", "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of the nodes at which conversations end. A node's ids are sorted
    and joined in many tasks; one streams the pieces through the hash, which has an order."""
    n = shuffle_parts(paths.sparkSession)
    order = ["k1", "k2", "conv_id"]
    pieces = (paths.filter("end").select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
              .mapInArrow(_pieces, "k1 bigint, k2 bigint, first bigint, ids string"))
    return pieces.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digest, "k1 bigint, k2 bigint, ends_sha256 string")


def nodes(rebuilt: DataFrame, last: int = LAST) -> DataFrame:
    """The trie of rebuilt conversations (see ``shared_heads``), one row per node."""
    paths = prefixes(rebuilt)
    found = linked_nodes(paths)
    arcs, kids = tour(found)
    sums = rank(arcs, last).groupBy(F.shiftright("id", 1).alias("m")).agg(
        (F.max("before_leaf") - F.min("before_leaf")).alias("n_leaves"), (F.max("before_save") - F.min("before_save")).alias("saved_tokens"))
    return (found.join(sums, "m").join(kids, "m", "left").join(end_digests(paths), ["k1", "k2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def grouped_by_five(conversations: DataFrame) -> DataFrame:
    """The rebuilding of the registered query: conversation c on the first crc32(c) % 9 turns
    of conversation c - c % 5."""
    c = F.col("conv_id")
    return shared_heads(turns(conversations), base=c - c % 5, heads=F.crc32(c.cast("string")) % 9, most=8)
