"""Collocations per language, by dynamic itemset counting.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?`` and line ends ``]`` and the
pieces into words at blanks and tabs. Phrases of 2 to ``longest`` words that occur ``least`` times
are scored by how much of their parts' occurrences they take, and the best of each language
are returned.

*Counting.* The texts are written in ``shards`` shards, which are scanned in a cycle. Single
words are counted from the start. Once both subphrases of a longer phrase (without its last
word, without its first) have reached ``least`` in what was scanned so far, the phrase is
activated: it is counted in the next ``shards`` scans, one full cycle, whatever shard that
begins with. So lengths are counted interleaved; a phrase that cannot reach ``least`` is
mostly never counted; and no phrase that does reach it is missed, as its subphrases do too.
The scans end when every active phrase has completed its cycle.

*State.* What has been reached is told to tasks by one byte table for each length: at the
hash of a phrase the number of the scan from which it counts as reached. The tables have
``slots`` bytes each, whatever the data are (that bounds the broadcast). Hashes that share a
slot can only activate a phrase too early, which costs time, and its cycle still is a full
one, as a slot never changes once it is set and a phrase is activated no earlier than its
subphrases are. Counts so far are tables of (hash, start,
count) in the shared folder, without the words, as arrays by bucket of the hashes (more
buckets for more text); after its cycle a phrase that has not reached ``least`` is dropped there.
Of a hash five bytes travel: phrases that share them are counted as one, which lasts until the
last one's cycle ends, so that too can only add phrases. A table is deleted once the next is written.

*Result.* A last scan counts the phrases that reached ``least`` by their words, so shared
hashes have no part in the result; its phrases travel sorted, many to a row, by bucket and
language. Scores use exact decimals.

Defined results: a null ``lang`` is ``und``; null or empty texts have no words; repeated
rows count repeatedly; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revisit.llm.shared import discard, keep, new_folder
from revisit.llm.words import as_bytes, mix

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words
SHARDS = 3
SLOTS = 1 << 22  # bytes of a table of reached phrases; some eight times their number
PART = 6 << 20  # bytes of text that a task counts at once
BUCKET = 4 << 20  # bytes of all texts for a bucket of hashes, whose counts a task merges at once
KEY = np.uint64((1 << 40) - 1)  # the part of a hash that counts are kept by; no less than that of the slots
NAMED = 4  # buckets of hashes for one of phrases by their words
SALTS = 8  # copies of the counts that phrases meet their parts in
NEVER = 255
_LANE = 8  # longest words, in groups of eight bytes, that are hashed together
_P = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


class Block:
    """Some texts as arrays: words by hash and place, pieces, languages."""

    def __init__(self, langs: list[bytes], texts: list[bytes]) -> None:
        raw = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        kind = _KIND[raw]
        word = kind == 0
        # Words stand one blank apart in ``flat``, so a phrase is a run of its bytes.
        kept = word.copy()
        kept[1:] |= word[:-1]
        edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
        at, to = edges[::2], edges[1::2]
        self.n = len(at)
        self.flat = np.where(word, raw, 32)[kept].astype(np.uint8)
        self.length = to - at
        self.start = np.concatenate(([0], np.cumsum(self.length + 1)))[:-1]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[at]
        del kind, word, kept, edges
        ends = np.cumsum([len(t) + 1 for t in texts])
        which = np.searchsorted(ends, at, side="right")
        names = sorted(set(langs))
        self.names = names
        number = {x: i for i, x in enumerate(names)}
        self.lang = np.array([number[x] for x in langs], np.int64)[which] if self.n else np.zeros(0, np.int64)
        seeds = np.array([xxhash.xxh64_intdigest(x, 1) for x in names], np.uint64)
        self.first = mix((self._hashes() ^ seeds[self.lang]) * _P) if self.n else np.zeros(0, np.uint64)

    def _hashes(self) -> np.ndarray:
        """One hash per word, from its bytes in groups of eight."""
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((self.flat, np.zeros(8, np.uint8))), 8)
        out = self.length.astype(np.uint64)
        todo = np.flatnonzero(self.length <= 8 * _LANE)
        for lane in range(_LANE):
            todo = todo[self.length[todo] > 8 * lane]
            if not len(todo):
                break
            value = eight[self.start[todo] + 8 * lane].copy().view("<u8")[:, 0]
            short = np.minimum(self.length[todo] - 8 * lane, 8)
            value &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - short)).astype(np.uint64)
            out[todo] = mix(out[todo] * _P + value)
        for i in np.flatnonzero(self.length > 8 * _LANE):
            out[i] = xxhash.xxh64_intdigest(self.flat[self.start[i]:self.start[i] + self.length[i]].tobytes(), 2)
        return out

    def phrases(self, start: np.ndarray, words: int) -> pa.Array:
        """The phrases of ``words`` words that start at the words ``start``, as strings."""
        if not len(start):
            return pa.array([], pa.string())
        last = start + words - 1
        size = self.start[last] + self.length[last] - self.start[start]
        ends = np.cumsum(size)
        where = np.repeat(self.start[start] - ends + size, size) + np.arange(ends[-1])
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(self.flat[where])])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    langs, texts, held = [], [], 0
    for batch in batches:
        names, column = as_bytes(batch.column(0)), batch.column(1).cast(pa.binary())
        for lang, text in zip(names, column):  # one text at a time becomes a Python object
            langs.append(lang)
            texts.append(text.as_py())
            held += len(texts[-1]) + 1
            if held >= PART:
                block = Block(langs, texts)
                langs, texts, held = [], [], 0
                yield block
                del block
    if texts:
        yield Block(langs, texts)


def grow(block: Block, tables: list[np.ndarray], longest: int, now: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the words at which an activated phrase starts, the phrases' hashes,
    and the scan in which they were activated. ``tables[k]`` has the phrases of k + 1 words
    that are reached."""
    at = np.arange(block.n)
    keys, since = block.first, np.zeros(block.n, np.uint8)
    for length in range(1, longest + 1):
        yield length, at, keys, since
        if length == longest or not len(at):
            return
        table = tables[length - 1]
        reached = np.full(block.n + 1, NEVER, np.uint8)
        # Not before the phrase is counted itself, though another one may have taken its slot earlier.
        reached[at] = np.maximum(table[keys & np.uint64(len(table) - 1)], since)
        by_place = np.zeros(block.n, np.uint64)
        by_place[at] = keys
        at = at[at + length < block.n]
        began = np.maximum(reached[at], reached[at + 1])
        live = (began <= now) & (block.piece[at] == block.piece[at + length])
        at, since = at[live], began[live]
        keys = mix(by_place[at] * _P + by_place[at + 1])


_NAMES = ["bucket", "lang", "words", "phrases", "n"]
_COUNTS = "bucket int, words tinyint, hash binary, since binary, n binary"


def _planes(values: np.ndarray) -> bytes:
    """Numbers as bytes of equal weight side by side, which compress well if sorted."""
    return np.ascontiguousarray(values[:, None].view(np.uint8).reshape(len(values), -1).T).tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts as bytes if they fit, as most do, else as eight bytes each."""
    return n.astype(np.uint8) if len(n) and n.max() < 256 else n


def _packed(words: int, bucket: np.ndarray, keys: np.ndarray, since: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts in the order of ``bucket``, one row for each."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(keys) else np.zeros(1, np.int64)
    cut = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    small = [_narrow(n[i:j]) for i, j in cut]
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[edges[:-1]] if len(keys) else [], pa.int32()), pa.array([words] * len(cut), pa.int8()),
        pa.array([_planes(keys[i:j]) for i, j in cut], pa.binary()), pa.array([since[i:j].tobytes() for i, j in cut], pa.binary()),
        pa.array([_planes(x) for x in small], pa.binary())], ["bucket", "words", "hash", "since", "n"])


def _summed(keys: np.ndarray, since: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts added up by key, in their order; phrases that share a key last as long as the latest."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    if not len(first):
        return keys, since, n
    return keys[first], np.maximum.reduceat(since[order], first), np.add.reduceat(n[order], first)


def scan(rows: DataFrame, tables: Broadcast, now: int, shards: int, longest: int, buckets: int) -> DataFrame:
    """Counts of the phrases that are active in scan ``now``, as arrays by bucket of their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for length, _, keys, since in grow(block, tables.value, longest, now):
                active = since.astype(np.int64) + shards > now
                key, began, n = _summed(keys[active] & KEY, since[active], np.ones(int(active.sum()), np.int64))
                bucket = (key & np.uint64(buckets - 1)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                yield _packed(length, bucket[order], key[order], began[order], n[order])
    return rows.mapInArrow(run, _COUNTS)


def merged(counts: DataFrame, now: int, shards: int, least: int, slots: int, buckets: int) -> DataFrame:
    """Counts added up by bucket, without phrases that completed their cycle below ``least``;
    ``reached`` is a bit map of the bucket's slots of phrases with ``least`` occurrences so far."""
    shift = np.uint64(buckets.bit_length() - 1)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, words = key[0].as_py(), key[1].as_py()
        parts = []
        for batch in batches:
            for h, s, n in zip(*(batch.column(c).to_pylist() for c in ("hash", "since", "n"))):
                keys = _numbers(h, np.uint64)
                parts.append((keys, np.frombuffer(s, np.uint8), _numbers(n, np.uint8 if len(n) == len(keys) else np.int64).astype(np.int64)))
        keys, since, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        keys, since, n = _summed(keys, since, n)
        kept = (since.astype(np.int64) + shards > now + 1) | (n >= least)
        bits = np.zeros(slots // buckets, bool)
        bits[(keys[n >= least] & np.uint64(slots - 1)) >> shift] = True
        out = _packed(words, np.full(int(kept.sum()), bucket, np.int32), keys[kept], since[kept], n[kept])
        if out.num_rows:
            yield out.append_column("reached", pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()))
    return counts.groupBy("bucket", "words").applyInArrow(run, _COUNTS + ", reached binary")


def named(rows: DataFrame, tables: Broadcast, longest: int, least: int, buckets: int) -> DataFrame:
    """Counts by their words of all phrases that are in the tables and occur ``least`` times:
    ``lang, words, phrase, n``; with no words the number of words of the language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            langs = pa.array(block.names, pa.binary()).cast(pa.string())
            each = np.bincount(block.lang, minlength=len(langs))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(langs), np.int32)), langs, pa.array(np.zeros(len(langs), np.int8)),
                                              pa.array([""] * len(langs)), pa.array([x.tobytes() for x in each])], _NAMES)
            for length, at, keys, _ in grow(block, tables.value, longest, NEVER - 1):
                table = tables.value[length - 1]
                found = table[keys & np.uint64(len(table) - 1)] != NEVER
                at = at[found]
                keys, place, n = np.unique(keys[found], return_index=True, return_counts=True)
                if not len(keys):
                    continue
                at = at[place]
                groups = (keys & np.uint64(buckets - 1)).astype(np.int64) * len(langs) + block.lang[at]
                phrases = block.phrases(at, length)
                order = pc.sort_indices(pa.table({"group": groups, "phrase": phrases}), [("group", "ascending"), ("phrase", "ascending")])
                groups, n = groups[order], n[order]
                edges = np.flatnonzero(np.diff(groups, prepend=-1, append=-1))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), phrases.take(order))
                groups, cut = groups[edges[:-1]], zip(edges[:-1].tolist(), edges[1:].tolist())
                yield pa.RecordBatch.from_arrays([pa.array((groups // len(langs)).astype(np.int32)), langs.take(pa.array(groups % len(langs))),
                                                  pa.array(np.full(len(groups), length, np.int8)), pc.binary_join(lists, "\n"),
                                                  pa.array([_planes(_narrow(n[i:j])) for i, j in cut], pa.binary())], _NAMES)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], []
        for batch in batches:
            for phrases, counts in zip(batch.column("phrases"), batch.column("n").to_pylist()):
                parts.append(pa.array(phrases.as_py().split("\n"), pa.large_string()))  # no phrase has a line end
                n.append(_numbers(counts, np.uint8 if len(counts) == len(parts[-1]) else np.int64).astype(np.int64))
        total = pa.table({"phrase": pa.chunked_array(parts), "n": np.concatenate(n)}).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
        if key[2].as_py():
            total = total.filter(pc.greater_equal(total["n_sum"], least))
        for batch in total.to_batches():
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([key[1].as_py()] * size, pa.string()), pa.array([key[2].as_py()] * size, pa.int8()),
                                              batch.column("phrase").cast(pa.string()), batch.column("n_sum")], ["lang", "words", "phrase", "n"])

    packed = rows.mapInArrow(run, "bucket int, lang string, words tinyint, phrases string, n binary")
    return packed.groupBy("bucket", "lang", "words").applyInArrow(add, "lang string, words tinyint, phrase string, n bigint")


def _mark(held: DataFrame, tables: list[np.ndarray], value: int, buckets: int) -> int:
    """Set the free slots of the phrases that are reached so far to ``value``; how many there
    are. The slots come as bit maps, one bit for each slot of a length."""
    maps = held.select("bucket", "words", "reached").toArrow()
    new = 0
    for bucket, words, reached in zip(*(maps[c].to_pylist() for c in ("bucket", "words", "reached"))):
        table = tables[words - 1][bucket::buckets]
        free = np.unpackbits(np.frombuffer(reached, np.uint8), bitorder="little")[:len(table)].astype(bool) & (table == NEVER)
        table[free] = value
        new += int(free.sum()) if words < len(tables) else 0
    return new


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``lang, words, phrase, n`` of all phrases (single words too) with ``least`` occurrences,
    and the number of words of each language as the phrase of no words."""
    spark = docs.sparkSession
    path = new_folder(spark, "shards")
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text").filter("length(text) > 0")
    (rows.withColumn("shard", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(shards)))
     .write.partitionBy("shard").option("compression", "zstd").parquet(path))
    written = spark.read.schema("lang string, text string, shard int").parquet(path)
    size = written.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(slots, 1 << max(4, (size // BUCKET).bit_length()))
    tables = [np.full(slots, NEVER, np.uint8) for _ in range(longest)]
    now, end, held = 0, shards, None
    while now < end:
        sent = spark.sparkContext.broadcast(tables[:-1])
        step = scan(written.filter(F.col("shard") == now % shards).select("lang", "text"), sent, now, shards, longest, buckets)
        step = step if held is None else step.unionByName(held.drop("reached"))
        old, held = held, keep(merged(step, now, shards, least, slots, buckets), "counts")
        if old is not None:
            discard(old)
        now += 1
        if now >= NEVER - shards:
            raise ValueError("too many scans: use fewer shards")
        if _mark(held, tables, now, buckets):
            end = now + shards
        sent.destroy()
    sent = spark.sparkContext.broadcast(tables)
    return keep(named(written.select("lang", "text"), sent, longest, least, max(1, buckets // NAMED)), "phrases")


def best(found: DataFrame, top: int = 2000, inside: int = 80, scale: int = 2_000_000) -> DataFrame:
    """The ``top`` phrases of each language by score, from ``counts``.

    A phrase that occurs ``a`` times, cut into two parts that occur ``l`` and ``r`` times, has
    the score ``floor(scale * a / (l + r))`` at its lowest-scoring cut. Phrases of which
    ``inside`` percent or more lie in one longer phrase are left out."""
    wide = "cast({} as decimal(38, 0))".format
    words = F.split("phrase", " ")
    phrases = found.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), words.alias("w"))

    def run(start, size):  # noqa: ANN001, ANN202
        return F.array_join(F.slice("w", start, size), " ")

    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).select(
        "lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"),
        F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = found.filter("words > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), "salt", F.col("n").alias(n)), ["lang", side, "salt"])
    score = F.expr(f"{wide(scale)} * cast(a as decimal(20, 0)) div ({wide('l')} + cast(r as decimal(20, 0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.filter("words > 2").withColumn("size", F.explode(F.expr("sequence(2, words - 1)")))
    longer = longer.withColumn("at", F.explode(F.expr("sequence(1, words - size + 1)")))
    longer = longer.groupBy("lang", run(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("over"))
    hidden = F.expr(f"{wide('over')} * 100 >= {wide('a')} * {inside}")
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(hidden, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = found.filter("words = 0").select("lang", "n")
    return ranked.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang").select(
        "lang", F.col("rank").cast("bigint"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = 2000, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    return best(counts(docs, least, longest, shards, slots), top)
