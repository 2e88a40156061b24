"""Benchmark decontamination by template canonicalisation.

Words are canonicalised: punctuation at their ends goes, letters are lower-cased,
numbers become the placeholder NUM, unit words after a number UNIT, and words
capitalised inside a sentence NAME (words all in capitals are plain words). Every window of ``WINDOW`` canonical words of a
benchmark item is a template. Documents' windows are joined with the templates by hash;
the matches of a document and an item are grouped by alignment (position in the document
minus position in the item), and within an alignment the slots must agree: the same
value of the item always stands where the same value of the document stands, and the
other way round. So a question whose numbers, names or units were replaced throughout is
found, and a chance meeting of frames is not. Windows whose slots hold the item's own values
count also where other slots of their alignment do not agree. Beside its template, each
window of an item is indexed by its plain lower-cased words, so that a copy in another case,
or one dense in slots, is found word for word. A document is reported with an item when
the consistent alignments hold ``SHARE`` of the item's templates, or they and the plain
windows together hold ``SHARE`` of all its windows.

Tasks compute windows of whole texts in numpy and keep those whose hash a template has.
The templates' hashes are broadcast in blocks of at most ``BLOCK`` (8 bytes each), one
pass over the documents per block; the matching windows alone are shuffled and joined.

Defined results: null or blank text matches nothing; items with fewer words than a window
are one plain window of their own length (and one template from ``LEAST`` words on); items
with fewer than ``WHOLE`` words, which are everyday phrases inside other text, are found in
documents that hold no other words; a template needs half of its words outside slots, a
plain window nothing; items with equal text are all reported;
repeated rows of a ``doc_id`` count once; rows with a null ``doc_id`` or ``item_id`` are
not reported (no id to report); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.llm.shared import keep
from revisit.llm.words import as_bytes, fold

WINDOW = 6  # words
LEAST = 5  # words of a template
WHOLE = 3  # words of an item that is looked for inside other text
SHARE = 0.3  # of an item's templates
BLOCK = 4_000_000  # template hashes broadcast at once (32 MB)
WORD, NUM, UNIT, NAME = 0, 1, 2, 3
_LETTER, _SHOUT = 4, 5  # one capital letter; several letters, all capitals

# Words that are units when they follow a number.
UNITS = frozenset("""
kg g mg t lb lbs oz km m cm mm mi mile miles ft foot feet in inch inches yd l ml
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
dollar dollars euro euros usd eur cent cents pound pounds percent degree degrees
meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms
liter liters litre litres kmh mph hz khz mhz ghz kb mb gb tb w kw kwh v a j n pa
""".split())
_ENDS = string.punctuation.encode()
_NUMBER = re.compile(r"[0-9][0-9.,:/]*(?:e[+-]?[0-9]+)?([a-z]{0,10})")


class Canonical(dict):
    """What a raw word is: (hash of its canonical form, kind, capital, ends a sentence)."""

    def __missing__(self, raw: bytes) -> int:
        core = (raw.strip(_ENDS) or raw).decode("utf-8", "replace")
        low = core.lower()
        number = _NUMBER.fullmatch(low)
        n = self[raw] = len(self)
        self.hash.append(xxhash.xxh64_intdigest(low))
        self.kind.append(NUM if number and (not number[1] or number[1] in UNITS) else UNIT if low in UNITS
                         else WORD if not core[:1].isupper() else _LETTER if len(core) == 1
                         else _SHOUT if core.isupper() else NAME)
        self.ends.append(raw.rstrip(b"\"')]}*%&$#")[-1:] in (b".", b"!", b"?", b":"))
        return n

    def __init__(self, most: int = 1_000_000) -> None:
        super().__init__()
        self.most = most
        self.hash, self.kind, self.ends = [], [], []  # of words met since the last chunk
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool))

    def of(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """Hashes of the plain and of the canonical words, kinds and raw words of each text."""
        if len(self) > self.most:
            self.clear()
            self.__init__(self.most)
        raws = [text.split() if text else [] for text in texts]
        at = [np.fromiter(map(self.__getitem__, raw), np.int64, len(raw)) for raw in raws]
        new = (np.array(self.hash, np.uint64), np.array(self.kind, np.int8), np.array(self.ends, bool))
        self.known = tuple(np.concatenate(x) for x in zip(self.known, new))
        self.hash, self.kind, self.ends = [], [], []
        out = []
        for raw, i in zip(raws, at):
            hashes, kind, ends = (a[i] for a in self.known)
            after_end = np.append(True, ends[:-1])[:len(i)]
            after_number = np.append(False, kind[:-1] == NUM)[:len(i)]
            shout = kind == _SHOUT
            beside = np.append(False, shout[:-1])[:len(i)] | np.append(shout[1:], False)[:len(i)]
            kind = np.where(kind == _LETTER, np.where(beside, WORD, NAME), np.where(shout, WORD, kind))
            kind = np.where(((kind == NAME) & after_end) | ((kind == UNIT) & ~after_number), WORD, kind)
            out.append((hashes, np.where(kind == WORD, hashes, kind.astype(np.uint64)), kind, raw))
        return out


def chunks(batches: Iterator[pa.RecordBatch], size: int = 256):
    """Ids and texts, so many at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            part = batch.slice(lo, size)
            yield part.column(0).to_pylist(), as_bytes(part.column(1))


def windows(plain: np.ndarray, canonical: np.ndarray, kind: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words, and whether enough of it is outside slots.
    A window's first word is no name slot: a sentence's first word has a capital too, and
    a passage put inside another sentence would look different there."""
    n = len(plain) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    first = np.where(kind == NAME, plain, canonical)[:n]
    outside = np.concatenate([[0], np.cumsum(kind == WORD)])
    outside = outside[size:] - outside[:-size] + (kind[:n] == NAME)
    return fold([first, *(canonical[i:i + n] for i in range(1, size))], seed=size), outside * 2 >= size


def _slots(kind: np.ndarray, raw: list[bytes], at: int, size: int) -> list[str]:
    return [f"{kind[i]}" + (raw[i].strip(_ENDS) or raw[i]).decode("utf-8", "replace").lower()
            for i in range(at, at + size) if kind[i] != WORD and not (i == at and kind[i] == NAME)]


# ``size`` is negative for plain windows; ``total`` counts an item's templates, ``all`` its windows.
_SCHEMA = "id long, size int, at long, hash long, slots array<string>, total long, all long"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)],
                                      ["id", "size", "at", "hash", "slots", "total", "all"])


def plain_windows(plain: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` lower-cased words."""
    n = len(plain) - size + 1
    return fold([plain[i:i + n] for i in range(size)], seed=size) if n > 0 else np.zeros(0, np.uint64)


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Canonical()
    for ids, texts in chunks(batches):
        rows = []
        for i, (plain, canonical, kind, raw) in zip(ids, words.of(texts)):
            size = min(WINDOW, len(raw))
            if i is None or not size:
                continue
            exact = plain_windows(plain, size)
            h, good = windows(plain, canonical, kind, size)
            at = np.flatnonzero(good & (size >= LEAST))
            rows += [(i, size, p, v, _slots(kind, raw, p, size), len(at), len(exact)) for p, v in zip(at.tolist(), h[at].view(np.int64).tolist())]
            rows += [(i, -size, p, v, [], len(at), len(exact)) for p, v in enumerate(exact.view(np.int64).tolist())]
        yield _emit(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, n_templates, n_matched, matched_share, n_replaced``: a row per
    document and item found in it; ``n_templates`` counts the item's windows, ``n_matched``
    those found in either form, ``n_replaced`` slot values that differ."""
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    items = keep(benchmark.select(F.col("item_id").cast("bigint").alias("id"), text).mapInArrow(_templates, _SCHEMA), "templates")
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # up to WINDOW, in two forms: a few numbers
    n = items.agg(F.approx_count_distinct("hash")).first()[0]
    blocks = max(1, -(-int(n * 1.2) // block))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), text)
    found = None
    for b in range(blocks):
        some = items.select("size", "hash").filter(F.pmod("hash", F.lit(blocks)) == b).distinct().toPandas()
        known = spark.sparkContext.broadcast(
            {s: np.sort(some["hash"][some["size"] == s].to_numpy(np.int64).view(np.uint64)) for s in sizes})
        part = rows.mapInArrow(_matching(known), _SCHEMA)
        found = part if found is None else found.unionByName(part)
    right = items.select(F.col("id").alias("item_id"), "size", "hash", F.col("at").alias("item_at"),
                         F.col("slots").alias("item_slots"), "total", F.col("all").alias("n_templates"))
    # A position counts as a template where its slots agree, as a plain window in any case.
    template, at = F.col("size") > 0, F.col("item_at")
    pairs = found.select("id", "size", "at", "hash", "slots").distinct().join(right, ["size", "hash"]).select(
        F.col("id").alias("doc_id"), "item_id", (F.col("at") - F.col("item_at")).alias("offset"), "total", "n_templates",
        F.when(template, at).alias("at"), F.when(template & (F.col("item_slots") == F.col("slots")), at).alias("same_at"),
        F.when(~template, at).alias("plain_at"),
        F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")).alias("slots"))
    # A window gives few slots, an alignment no more than the item has words.
    aligned = (pairs.groupBy("doc_id", "item_id", "total", "n_templates", "offset")
               .agg(*[F.collect_set(c).alias(c) for c in ("at", "same_at", "plain_at")],
                    F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")))
    same = (F.size("slots") == F.size(F.array_distinct("slots.i"))) & (F.size("slots") == F.size(F.array_distinct("slots.d")))
    replaced = F.when(same, F.size(F.filter("slots", lambda s: s["i"] != s["d"]))).otherwise(0)
    # One slot that does not agree leaves the windows whose slots are the item's own.
    aligned = aligned.withColumn("at", F.when(same, F.col("at")).otherwise(F.col("same_at")))
    aligned = aligned.withColumn("any_at", F.array_union("at", "plain_at")).filter(F.size("any_at") > 0)
    places = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("bigint")
    enough = lambda got, of: (F.col(of) > 0) & (F.col(got) >= F.greatest(F.col(of) * share, F.least(F.col(of), F.lit(3))))
    return (aligned.groupBy("doc_id", "item_id", "total", "n_templates")
            .agg(places("at").alias("n_slotted"), places("any_at").alias("n_matched"), F.min(replaced).cast("bigint").alias("n_replaced"))
            .filter(enough("n_slotted", "total") | enough("n_matched", "n_templates"))
            .select("doc_id", "item_id", "n_templates", "n_matched",
                    (F.col("n_matched") / F.col("n_templates")).alias("matched_share"), "n_replaced"))


def _matching(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Canonical()
        for ids, texts in chunks(batches):
            rows = []
            for i, (plain, canonical, kind, raw) in zip(ids, words.of(texts)):
                if i is None:
                    continue
                for size, table in known.value.items():
                    if not len(table) or len(raw) < abs(size) or (abs(size) < WHOLE and len(raw) != abs(size)):
                        continue
                    if size > 0:
                        h, good = windows(plain, canonical, kind, size)
                    else:
                        h, good = plain_windows(plain, -size), True
                    hit = good & (table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h)
                    rows += [(i, size, p, int(h[p].view(np.int64)), _slots(kind, raw, p, size) if size > 0 else [], 0, 0)
                             for p in np.flatnonzero(hit).tolist()]
            yield _emit(rows)
    return run
