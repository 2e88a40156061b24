"""Interpolated modified Kneser-Ney language model (order 2).

Counting: tasks count the word pairs of their batches and send each bucket of the history
space a block (history hashes, follower hashes, counts). A bucket adds up its blocks,
writes its pairs as a file of sorted hashes and counts, and passes on what other words
need to know: how often and before how many followers a history stands (c, N1, N2, N3+),
and after how many different words a word stands (its continuation count). A second
exchange brings those to the words' buckets, which write the word files. The driver sees
one row of totals. Frequent histories are spread over all buckets by their followers; a
first pass over all training texts finds them from counts that tasks have added up (the
choice only balances buckets).

Scoring: tasks memory-map the bucket files from the shared folder and look up their batch's
distinct words and pairs by binary search, so a task holds its own batch and no model.

    p(w | h) = (max(c(h w) - D, 0) + (D1 N1(h) + D2 N2(h) + D3 N3+(h)) p1(w)) / c(h)
    p1(w)    = max(cont(w) - D', 0) / T + g / (V + 1)

with the modified discounts from the counts of counts at each level (D' from the
continuation counts), T distinct pairs and g what the lower discounts free. An unseen
history leaves p1; an unseen word has p1's uniform part.

The shared folder (``spark.checkpoint.dir``) must be mounted, so that workers can map its
files. Files are written under a temporary name and renamed: a task that runs again
writes the same file.

Defined results: null or blank text is one end token; null ``doc_id`` counts as the empty
text for the split and is kept; repeated rows count as often as they stand; with no
training text every word is unknown and scores are those of the uniform part; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.llm.shared import new_folder, shuffle_parts
from revisit.llm.words import as_bytes, fold, mix

HELD = 1  # documents with crc32(doc_id) % 5 == HELD are held out
FOLDS = 5
LOOK_SHARE = 1e-3  # a history with more than this share of a portion's tokens may be frequent
PART = 2_000_000  # tokens that a task counts or scores at a time
MOST_OPEN = 512  # model files that a task keeps mapped
W48 = np.uint64((1 << 48) - 1)
# A word holds no space, so no word has the hash of these.
START, END, STOP = (np.uint64(xxhash.xxh64_intdigest(m)) for m in (b" start", b" end", b" stop"))
_PAIRS, _HISTORY, _CONT = 0, 1, 2
_BLOCK = "bucket long, kind tinyint, payload binary"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def spot(x: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a word; taken from bits that its 48-bit form keeps."""
    return (((x >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def pair_spot(h: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a pair: its history's, or by both words if the history is frequent."""
    out = spot(h, buckets)
    if len(hot):
        often = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        out[often] = spot(mix(h[often] ^ mix(w[often] & W48)), buckets)
    return out


class BatchWords(dict):
    """Dense numbers for the words of one batch."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = [int(START), int(END)]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n

    def of(self, text: bytes | None) -> np.ndarray:
        """Numbers of a text's words between the start (0) and the end (1)."""
        words = text.lower().split() if text else []
        out = np.ones(len(words) + 2, np.int64)
        out[0] = 0
        out[1:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out


def _portions(batches: Iterator[pa.RecordBatch], all_rows: bool):
    """Ids, numbered texts and their words, for about ``PART`` tokens at a time; only
    training documents unless all are wanted."""
    ids, texts, words, held = [], [], BatchWords(), 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            if all_rows or not held_out(i):
                ids.append(i)
                texts.append(words.of(t))
                held += len(texts[-1])
            if held >= PART:
                yield ids, texts, words
                ids, texts, words, held = [], [], BatchWords(), 0
    if texts:
        yield ids, texts, words


def _pairs(texts: list[np.ndarray], n: int) -> np.ndarray:
    """``history * n + word`` of each pair of neighbours, text by text."""
    flat = np.concatenate(texts)
    pairs = flat[:-1] * n + flat[1:]
    inside = np.ones(len(flat), bool)
    inside[np.cumsum([len(t) for t in texts]) - 1] = False
    return pairs[inside[:-1]]


def _narrow(x: np.ndarray) -> bytes:
    """Counts in as many bytes as the largest needs (1, 4 or 8), after that width."""
    top = int(x.max()) if x.size else 0
    size = 1 if top < 1 << 8 else 4 if top < 1 << 32 else 8
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _wide(raw: memoryview, n: int) -> tuple[np.ndarray, int]:
    size = raw[0]
    return np.frombuffer(raw, f"<u{size}", n, 1).astype(np.int64), 1 + size * n


def _pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(raw: memoryview, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8, 6 * n).reshape(n, 6)
    return out.view("<u8").ravel()


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for part in itertools.batched(rows, 2048):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int8(), pa.binary()))],
                                         ["bucket", "kind", "payload"])


def _count(buckets: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, words in _portions(batches, all_rows=False):
            hashes = np.array(words.hashes, np.uint64)
            key, count = np.unique(_pairs(texts, len(hashes)), return_counts=True)
            h, w = hashes[key // len(hashes)], hashes[key % len(hashes)] & W48
            # The end is counted as a history too: it has no followers but the stop.
            h, w, count = np.append(h, END), np.append(w, STOP & W48), np.append(count, len(texts))
            bucket = pair_spot(h, w, hot, buckets)
            order = np.lexsort((h, bucket))
            h, w, count, bucket = h[order], w[order], count[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(h)]):
                heads = np.flatnonzero(np.append(True, h[lo + 1:hi] != h[lo:hi - 1]))
                many = np.diff(np.append(heads, hi - lo))
                rows.append((int(bucket[lo]), _PAIRS, np.array([len(heads), hi - lo], "<u4").tobytes() + h[lo:hi][heads].tobytes()
                             + _narrow(many) + _narrow(count[lo:hi]) + _pack48(w[lo:hi])))
            yield from _rows(rows)
    return run


def _read_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    view = memoryview(raw)
    k, m = np.frombuffer(view, "<u4", 2).tolist()
    h = np.frombuffer(view, "<u8", k, 8)
    at = 8 + 8 * k
    many, used = _wide(view[at:], k)
    count, more = _wide(view[at + used:], m)
    return np.repeat(h, many), _unpack48(view[at + used + more:], m), count


def _store(path: str, keys: np.ndarray, values: np.ndarray) -> None:
    """Sorted keys and their values in one file, put in place at once."""
    size = 4 if not values.size or int(values.max()) < 1 << 32 else 8
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(part, "wb") as f:
        f.write(np.array([len(keys), values.shape[1], size], "<u8").tobytes())
        f.write(keys.astype("<u8").tobytes())
        f.write(values.astype(f"<u{size}").tobytes())
    os.replace(part, path)


def _open(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Memory-mapped keys and values."""
    raw = np.memmap(path, np.uint8, "r")
    n, k, size = raw[:24].view("<u8").tolist()
    return raw[24:24 + 8 * n].view("<u8"), raw[24 + 8 * n:].view(f"<u{size}").reshape(n, k)


def _add_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(values, heads, axis=0) if len(keys) else values


def _merge(groups: int, folder: str):
    def run(group: pa.Table) -> pa.Table:
        """All pairs of one bucket."""
        bucket = group.column("bucket")[0].as_py()
        h, w, c = (np.concatenate(x) for x in zip(*map(_read_pairs, group.column("payload").to_pylist())))
        order = np.lexsort((w, h))
        h, w, c = h[order], w[order], c[order]
        heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
        h, w, c = h[heads], w[heads], np.add.reduceat(c, heads)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        stats = np.add.reduceat(np.stack([c, c == 1, c == 2, c >= 3], axis=1).astype(np.int64), first)
        rows = []
        target = spot(h[first], groups)
        for b in np.unique(target).tolist():
            own = target == b
            rows.append((b, _HISTORY, np.uint32(np.count_nonzero(own)).tobytes() + h[first][own].tobytes() + _narrow(stats[own])))
        real = h != END
        h, w, c = h[real], w[real], c[real]
        if len(h):
            key = fold([h, w])
            order = np.argsort(key)
            _store(f"{folder}/pairs-{bucket}", key[order], c[order][:, None])
            follower, n = np.unique(w, return_counts=True)
            target = spot(follower, groups)
            order = np.argsort(target, kind="stable")
            follower, n, target = follower[order], n[order], target[order]
            cuts = np.flatnonzero(np.diff(target)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(target)]):
                rows.append((int(target[lo]), _CONT, np.uint32(hi - lo).tobytes() + _narrow(n[lo:hi]) + _pack48(follower[lo:hi])))
        # Counts of counts, for the discounts.
        rows.append((bucket % groups, _PAIRS, np.array([np.count_nonzero(c == i) for i in (1, 2, 3, 4)], "<u8").tobytes()))
        return pa.Table.from_batches(_rows(rows))
    return run


_TOTALS = ("tokens", "words", "pairs", "n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "followers")


def _words(folder: str):
    def run(group: pa.Table) -> pa.Table:
        """The words of one bucket: count, N1, N2, N3+ as a history, continuation count."""
        bucket = group.column("bucket")[0].as_py()
        hs, stats, ws, ns = [np.zeros(0, np.uint64)], [np.zeros((0, 4), np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        counts = np.zeros(4, np.int64)
        for kind, raw in zip(group.column("kind").to_pylist(), group.column("payload").to_pylist()):
            if kind == _HISTORY:
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                hs.append(np.frombuffer(raw, "<u8", n, 4))
                stats.append(_wide(memoryview(raw)[4 + 8 * n:], 4 * n)[0].reshape(n, 4))
            elif kind == _CONT:
                view = memoryview(raw)
                n = int(np.frombuffer(view, "<u4", 1)[0])
                many, used = _wide(view[4:], n)
                ws.append(_unpack48(view[4 + used:], n))
                ns.append(many)
            else:
                counts += np.frombuffer(raw, "<u8").astype(np.int64)
        h, stat = _add_up(np.concatenate(hs), np.concatenate(stats))
        w, cont = _add_up(np.concatenate(ws), np.concatenate(ns)[:, None])
        after = np.zeros(len(h), np.int64)
        if len(w) and len(h):
            at = np.minimum(np.searchsorted(w, h & W48), len(w) - 1)
            after = np.where(w[at] == h & W48, cont[at, 0], 0)
            _store(f"{folder}/words-{bucket}", h, np.column_stack([stat, after]))
        elif len(h):
            _store(f"{folder}/words-{bucket}", h, np.column_stack([stat, after]))
        token = h != START
        totals = [int(stat[token, 0].sum()), int(token.sum()), int(after.sum()), *counts.tolist(),
                  *[int(np.count_nonzero(after == i)) for i in (1, 2, 3, 4)], int(np.count_nonzero(after))]
        return pa.table({n: pa.array([v], pa.int64()) for n, v in zip(_TOTALS, totals)})
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D1, D2, D3+ from counts of counts; 0.75 for all where they do not exist."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.0, [0, 1, 2, 3])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with more than ``LOOK_SHARE`` of a portion's tokens, and (null) all its tokens."""
    for _, texts, words in _portions(batches, all_rows=False):
        count = np.bincount(np.concatenate(texts), minlength=len(words.hashes))
        at = np.flatnonzero(count > LOOK_SHARE * count.sum())
        hashes = np.array(words.hashes, np.uint64)[at].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None, *hashes.tolist()], pa.int64()), pa.array([int(count.sum()), *count[at].tolist()], pa.int64())],
                                         ["hash", "n"])


def frequent(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that are often a history, over all training texts. A word
    with 1.5 times ``LOOK_SHARE`` of all tokens is always among them: portions in which it
    has less than ``LOOK_SHARE`` lose at most that share. At most 2 / ``LOOK_SHARE`` words
    can have half of ``LOOK_SHARE``, so that many rows (and the total) reach the driver."""
    counts = _texts(docs).mapInArrow(_often, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    most = int(2 / LOOK_SHARE) + 1
    rows = counts.orderBy(F.col("hash").isNull().desc(), F.col("n").desc()).limit(most).collect()
    if not rows:
        return np.zeros(0, np.uint64)
    hot = np.array([r.hash for r in rows[1:] if r.n > LOOK_SHARE / 2 * rows[0].n], np.int64).view(np.uint64)
    return np.sort(hot[hot != END])


def fit(docs: DataFrame) -> dict:
    """Count the training documents; the model is a folder of files and a few numbers."""
    spark = docs.sparkSession
    url = urlparse(new_folder(spark, "kneser-ney"))
    if url.scheme not in ("", "file"):
        raise ValueError("the shared folder must be mounted, so that workers can map the model's files")
    folder = url.path
    os.makedirs(folder, exist_ok=True)
    # Each pair bucket sends a block to each word group, so there are fewer of these: the
    # vocabulary grows more slowly than the text.
    buckets, groups = 2 * shuffle_parts(spark), min(max(1, shuffle_parts(spark) // 2), 4096)
    hot = frequent(docs)
    blocks = _texts(docs).mapInArrow(_count(buckets, hot), _BLOCK)
    merged = blocks.groupBy("bucket").applyInArrow(_merge(groups, folder), _BLOCK)
    totals = merged.groupBy("bucket").applyInArrow(_words(folder), ", ".join(f"{n} long" for n in _TOTALS))
    row = totals.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _TOTALS]).first()
    files = frozenset(os.listdir(folder))
    if row["words"] and not files:
        raise RuntimeError(f"the model's files are not in {folder} as the driver sees it: the shared folder must be mounted everywhere")
    return {"folder": folder, "files": files, "buckets": buckets, "groups": groups, "hot": hot, **row.asDict()}


class Model:
    """Look-ups in a fitted model's files, for one task."""

    def __init__(self, fitted: dict) -> None:
        self.folder, self.buckets, self.groups, self.hot = (fitted[k] for k in ("folder", "buckets", "groups", "hot"))
        self.tokens, self.words, self.pairs = fitted["tokens"], fitted["words"], fitted["pairs"]
        self.high = discounts(*[fitted[f"n{i}"] for i in (1, 2, 3, 4)])
        self.low = discounts(*[fitted[f"m{i}"] for i in (1, 2, 3, 4)])
        m1, m2 = fitted["m1"], fitted["m2"]
        # Mass that the lower level's discounts free, as a share of its total.
        free = self.low[1] * m1 + self.low[2] * m2 + self.low[3] * (fitted["followers"] - m1 - m2)
        self.free = float(free) / self.pairs if self.pairs else 1.0
        self.names, self.files = fitted["files"], OrderedDict()

    def _file(self, kind: str, bucket: int) -> tuple[np.ndarray, np.ndarray] | None:
        """A bucket's mapped file; the one used longest ago is closed beyond ``MOST_OPEN``."""
        name = f"{kind}-{bucket}"
        if name not in self.names:
            return None  # a bucket without counts has no file
        if name in self.files:
            self.files.move_to_end(name)
        else:
            # A file that was written must be there.
            self.files[name] = _open(f"{self.folder}/{name}")
            if len(self.files) > MOST_OPEN:
                self.files.popitem(last=False)
        return self.files[name]

    def look_up(self, kind: str, bucket: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """Values of the keys, 0 where there is none."""
        out = np.zeros((len(keys), width), np.int64)
        order = np.lexsort((keys, bucket))
        keys, bucket = keys[order], bucket[order]
        cuts = (np.flatnonzero(np.diff(bucket)) + 1).tolist() if len(bucket) else []
        for lo, hi in itertools.pairwise([0, *cuts, len(bucket)] if len(bucket) else [0]):
            file = self._file(kind, int(bucket[lo]))
            if file is not None:
                at = np.minimum(np.searchsorted(file[0], keys[lo:hi]), len(file[0]) - 1)
                hit = file[0][at] == keys[lo:hi]
                out[order[lo:hi][hit]] = file[1][at[hit]]
        return out

    def word_stats(self, hashes: np.ndarray) -> np.ndarray:
        return self.look_up("words", spot(hashes, self.groups), hashes, 5)

    def log10_pairs(self, hashes: np.ndarray, stats: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 p(word | history) of pairs of the given words (numbers into ``hashes``)."""
        follower = hashes[w] & W48
        c = self.look_up("pairs", pair_spot(hashes[h], follower, self.hot, self.buckets), fold([hashes[h], follower]), 1)[:, 0]
        cont = stats[:, 4]
        lower = np.maximum(cont - self.low[np.minimum(cont, 3)], 0) / max(self.pairs, 1) + self.free / (self.words + 1)
        ch = stats[h, 0]
        freed = stats[:, 1:4] @ self.high[1:]
        p = (np.maximum(c - self.high[np.minimum(c, 3)], 0) + freed[h] * lower[w]) / np.maximum(ch, 1)
        return np.log10(np.where(ch > 0, p, lower[w]))


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``
    of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(fitted)
        total = fitted["tokens"] + 0.5 * (fitted["words"] + 1)
        for ids, texts, words in _portions(batches, all_rows=True):
            hashes = np.array(words.hashes, np.uint64)
            stats = model.word_stats(hashes)
            n = len(hashes)
            pair, at = np.unique(_pairs(texts, n), return_inverse=True)
            logs = model.log10_pairs(hashes, stats, pair // n, pair % n)[at]
            base = np.log10((stats[:, 0] + 0.5) / total)
            rows, lo = [], 0
            for i, t in zip(ids, texts):
                k = len(t) - 1
                s = float(logs[lo:lo + k].sum())
                rows.append((i, held_out(i), k, int(np.count_nonzero(stats[t[1:], 0])), fitted["tokens"],
                             float(base[t[1:]].sum()), s, float(10.0 ** min(300.0, -s / k))))
                lo += k
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [
                "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return _texts(docs).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                        "base_score double, score double, perplexity double")
