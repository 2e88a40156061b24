"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is normalised as the model says (a space becomes the mark ``U+2581``, one mark is
put in front, nothing else changes) and cut into words: no piece of the vocabulary has a
mark after another character, so merges never cross a mark that follows one. Each task
keeps the words it has met and encodes new ones together: all their symbols lie in flat
arrays. Where the two symbols beside a border, put together, are inside no piece, no merge
can ever cross that border, as symbols only grow; such borders cut words into segments that
do not depend on each other. A round finds each segment's least pair rank, merges that
segment's leftmost pairs of that rank, looks up again the pairs beside the merges only, and
compacts the arrays; finished segments leave. So rounds follow the longest segment, not the
longest word, and unbroken text of any length takes few of them.

Merging all equal pairs of a segment at once equals the library's one by one order only if
no merge creates a pair that would go before the next. For pieces that can do so (found from
the vocabulary) the pairs that a merge creates are looked up; a segment's merges of a round
end with the first that creates one. Where pieces of one score do so (runs of marks), a long
run of the character goes strictly from left to right; it is cut beforehand into the parts
that the first merges of such a run separate from its rest.

Characters outside the vocabulary become the byte pieces of their UTF-8 form. Decoding
joins the pieces of the ids, turns marks to spaces and drops the first one.

Defined results: null text counts as empty; an empty text has no ids and decodes to the
empty text; a mark in a text decodes to a space, as in the library; repeated rows are
encoded like others; a null ``doc_id`` is kept; an empty table gives no rows; other
columns are ignored. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.llm.words import mix

MARK = "▁"
NONE = np.int32(1 << 30)  # rank of a pair that no piece joins
INSIDE, APART = -2, -1  # pairs without a joined piece: inside some piece, inside none
MOST_WORDS = 400_000  # words that a task remembers; then it starts afresh
CHUNK = 256  # texts encoded together


@dataclass
class Vocabulary:
    """Arrays made from a model file; their size depends on the vocabulary alone."""

    char_id: np.ndarray  # code point -> id, or size + code point outside the vocabulary
    rank: np.ndarray  # id -> place in the order of scores (equal scores share one)
    one_by_one: np.ndarray  # id -> its merge may create a pair that goes first
    slots: np.ndarray  # open hash table of the pairs inside pieces: key,
    joined: np.ndarray  # and the joined piece's id, or INSIDE
    byte_id: np.ndarray  # byte -> id
    piece_bytes: np.ndarray  # all pieces' bytes, and where each begins
    piece_start: np.ndarray
    period: np.ndarray  # id of a character -> how many of them part from a long run of it, or 0
    slack: int  # characters at a run's end that are left as they are
    newline_alone: bool
    size: int

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two symbols make together, INSIDE or APART."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        mask = np.uint64(len(self.slots) - 1)
        at = mix(key) & mask
        out = np.full(len(key), APART, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            found = self.slots[at]
            hit = found == key
            out[todo[hit]] = self.joined[at[hit]]
            more = ~hit & (found != np.uint64(0))
            todo, key, at = todo[more], key[more], (at[more] + np.uint64(1)) & mask
        return out


def _hash_table(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open hash table with linear probing, at most half full; keys are distinct, none is 0."""
    slots = np.zeros(1 << int(np.ceil(np.log2(2 * len(key) + 2))), np.uint64)
    values = np.zeros(len(slots), np.int32)
    mask = np.uint64(len(slots) - 1)
    at = mix(key) & mask
    while len(key):
        free = np.flatnonzero(slots[at] == 0)
        won = free[np.unique(at[free], return_index=True)[1]]
        slots[at[won]], values[at[won]] = key[won], value[won]
        left = np.ones(len(key), bool)
        left[won] = False
        key, value, at = key[left], value[left], (at[left] + np.uint64(1)) & mask
    return slots, values


def load(path: str) -> Vocabulary:
    """Read a BPE model with byte fallback; the library is used only to list its pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in range(size)]
    ids = {p: i for i, (p, ok) in enumerate(zip(pieces, plain)) if ok}
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
        raise ValueError("pieces that run across words are not supported")
    missing = [b for b in range(256) if f"<0x{b:02X}>" not in pieces]
    if missing:
        raise ValueError("a model with byte fallback is needed")
    scores = np.array([model.get_score(i) for i in range(size)])
    rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    char_id = np.arange(0x110000, dtype=np.int32) + size
    for piece, i in ids.items():
        if len(piece) == 1:
            char_id[ord(piece)] = i
    within = {p[a:b] for p in ids for a in range(len(p)) for b in range(a + 2, len(p) + 1)}
    left, right, whole = [], [], []
    for piece in within:
        i = ids.get(piece, INSIDE)
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            a = ids.get(a, size + ord(a) if len(a) == 1 else -1)
            b = ids.get(b, size + ord(b) if len(b) == 1 else -1)
            if a >= 0 and b >= 0:
                left.append(a)
                right.append(b)
                whole.append(i)
    left, right, whole = np.array(left, np.int64), np.array(right, np.int64), np.array(whole, np.int32)
    slots, joined = _hash_table((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), whole)
    one_by_one = np.zeros(size, bool)
    for part in (left, right):
        pair = (whole >= 0) & (part < size)
        early = rank[whole[pair]] <= rank[part[pair]]
        one_by_one[part[pair][early]] = True
    merged = rank[np.unique(whole[whole >= 0])]
    shared = np.unique(merged)[np.unique(merged, return_counts=True)[1] > 1]
    one_by_one[np.isin(rank, shared)] = True
    raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode() if plain[i] else b""
           for i, p in enumerate(pieces)]
    v = Vocabulary(char_id, rank, one_by_one, slots, joined,
                   np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64),
                   np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]),
                   np.zeros(size, np.int32), 4 * max(map(len, ids)), not any("\n" in p for p in ids), size)
    for char in np.unique([char_id[ord(p[0])] for p in ids if len(p) > 1 and len(set(p)) == 1]):
        if char < size:
            v.period[char] = _period(char, v)
    return v


def _period(char: int, v: Vocabulary) -> int:
    """How many characters at the head of a long run of one character part from the rest
    while that rest is still untouched, merging one pair after the other; 0 if none do or
    if the run can be merged together."""
    row = [char] * v.slack
    ids = lambda: v.join(np.array(row[:-1]), np.array(row[1:]))
    if (first := int(ids()[0])) < 0 or not v.one_by_one[first]:
        return 0
    while (pair := ids()).max() >= 0:
        at = int(np.argmin(np.where(pair >= 0, v.rank[pair], NONE)))
        row[at:at + 2] = [int(pair[at])]
        untouched = next(i for i in range(len(row), -1, -1) if not i or row[i - 1] != char)
        if untouched + v.slack // 2 > len(row):
            return 0
        if v.join(np.array(row[untouched - 1:untouched]), np.array([char]))[0] == APART:
            return v.slack - (len(row) - untouched)
    return 0


def _cut_runs(sym: np.ndarray, pair: np.ndarray, v: Vocabulary) -> None:
    """Mark the borders inside long runs of one character at which they will part."""
    begin = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]) | np.append(True, pair[:-1] == APART))
    length = np.diff(np.append(begin, len(sym)))
    parted = (begin == 0) | (pair[begin - 1] == APART)
    long_ = (length > 2 * v.slack) & parted & (sym[begin] < v.size)
    begin, length = begin[long_], length[long_]
    period = v.period[sym[begin]]
    begin, length, period = begin[period > 0], length[period > 0], period[period > 0]
    many = (length - v.slack) // period
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
    pair[np.repeat(begin, many) + nth * np.repeat(period, many) - 1] = APART


def _creates_earlier(at: np.ndarray, sym: np.ndarray, pair: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Whether the merge at each place of ``at`` (ascending; those before it are done) makes
    a pair that goes before the pairs of its own rank."""
    out = np.zeros(len(at), bool)
    look = np.flatnonzero(v.one_by_one[pair[at]])
    if len(look):
        i, piece = at[look], pair[at[look]]
        after_merge = (look > 0) & (at[look - 1] == i - 2)
        left = np.where(after_merge, pair[i - 2], sym[i - 1])
        right = sym[np.minimum(i + 2, len(sym) - 1)]
        for a, b, joins in ((left, piece, (i > 0) & (pair[i - 1] != APART)), (piece, right, pair[i + 1] != APART)):
            new = np.where(joins, v.join(a, b), APART)
            out[look] |= (new >= 0) & (v.rank[new] <= v.rank[piece])
    return out


def merge_rounds(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each word has."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    sizes = np.array([len(w) for w in words], np.int64)
    sym = v.char_id[points]
    place = np.arange(len(sym))
    pair = np.append(v.join(sym[:-1], sym[1:]), np.int32(APART))[:len(sym)]
    pair[np.cumsum(sizes)[sizes > 0] - 1] = APART
    _cut_runs(sym, pair, v)
    done = np.full(len(sym), -1, np.int32)
    while len(sym):
        begin = np.flatnonzero(np.append(True, pair[:-1] == APART))
        length = np.diff(np.append(begin, len(sym)))
        rank = np.where(pair >= 0, v.rank[pair], NONE)
        least = np.repeat(np.minimum.reduceat(rank, begin), length)
        keep = least != NONE
        done[place[~keep]] = sym[~keep]
        at = np.flatnonzero((rank == least) & keep)
        if not len(at):
            break
        # Of pairs that overlap, the leftmost go: every second one of a run.
        run_head = np.append(True, (at[1:] != at[:-1] + 1))
        run_from = at[np.maximum.accumulate(np.where(run_head, np.arange(len(at)), 0))]
        at = at[(at - run_from) % 2 == 0]
        stop = _creates_earlier(at, sym, pair, v)
        if stop.any():
            stops = np.cumsum(stop) - stop
            segment = np.searchsorted(begin, at, "right")
            head = np.maximum.accumulate(np.where(np.append(True, segment[1:] != segment[:-1]), np.arange(len(at)), 0))
            at = at[stops == stops[head]]
        sym[at] = pair[at]
        pair[at] = np.where(pair[at + 1] == APART, APART, INSIDE)
        keep[at + 1] = False
        at = (np.cumsum(keep) - 1)[at]
        sym, place, pair = sym[keep], place[keep], pair[keep]
        beside = np.unique(np.concatenate([at, at[at > 0] - 1]))
        beside = beside[pair[beside] != APART]
        pair[beside] = v.join(sym[beside], sym[beside + 1])
    left = np.flatnonzero(done >= 0)
    sym, word = done[left].astype(np.int64), np.repeat(np.arange(len(words)), sizes)[left]
    if len(odd := np.flatnonzero(sym >= v.size)):
        raw = [v.byte_id[list(chr(c - v.size).encode())] for c in sym[odd].tolist()]
        many = np.ones(len(sym), np.int64)
        many[odd] = [len(r) for r in raw]
        out = np.repeat(sym, many)
        where = np.repeat((np.cumsum(many) - many)[odd], many[odd]) + np.concatenate([np.arange(len(r)) for r in raw])
        out[where] = np.concatenate(raw)
        sym, word = out, np.repeat(word, many)
    return sym, np.bincount(word, minlength=len(words))


def spread(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start + length]`` one after the other."""
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return flat[shift + np.arange(len(shift))]


class WordIds(dict):
    """Number of a word; new words wait until ``settle`` encodes them together."""

    def __init__(self, v: Vocabulary) -> None:
        super().__init__()
        self.v, self.waiting = v, []
        self.flat, self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.spaced = _Spaced(self)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.length) + len(self.waiting)
        self.waiting.append(word)
        return n

    def settle(self) -> None:
        if self.waiting:
            ids, many = merge_rounds(self.waiting, self.v)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(many) - many])
            self.flat, self.length = np.concatenate([self.flat, ids]), np.concatenate([self.length, many])
            self.waiting = []

    def cut(self, text: str) -> list[int]:
        """Numbers of the words of a text."""
        if not text:
            return []
        if not self.v.newline_alone or "  " in text or MARK in text or text[0] == " ":
            whole = MARK + text.replace(" ", MARK)
            return [self[w] for w in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", whole)]
        out, head, *rest = [], *text.split("\n")
        out.extend(map(self.spaced.__getitem__, head.split(" ")))
        for line in rest:  # only the text's first word has a mark without a space
            first, *others = line.split(" ")
            out.append(self["\n"])
            if first:
                out.append(self[first])
            out.extend(map(self.spaced.__getitem__, others))
        return out


class _Spaced(dict):
    """Numbers of words that follow a space, by the word without its mark."""

    def __init__(self, words: WordIds) -> None:
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> int:
        n = self[word] = self.words[MARK + word]
        return n


def decode(ids: np.ndarray, length: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of the id lists that lie in a row; ``length`` tells how long each is."""
    start = v.piece_start[ids]
    many = v.piece_start[ids + 1] - start
    raw = spread(v.piece_bytes, start, many).tobytes()
    ends = np.concatenate([[0], np.cumsum(many)])[np.cumsum(length)].tolist()
    out, at = [], 0
    for end in ends:
        text = raw[at:end].decode("utf-8", "replace").replace(MARK, " ")
        out.append(text[1:] if text[:1] == " " else text)
        at = end
    return out


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded`` per document. The vocabulary's arrays (a few MB, set by
    the model alone) are broadcast; no text is moved between tasks."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vars(load(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**vocabulary.value)
        words = WordIds(v)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                if len(words) > MOST_WORDS:
                    words = WordIds(v)
                cuts = [words.cut(t) if t else [] for t in part.column(1).to_pylist()]
                words.settle()
                flat = np.fromiter((n for c in cuts for n in c), np.int64, sum(map(len, cuts)))
                many = words.length[flat]
                ids = spread(words.flat, words.start[flat], many)
                ends = np.concatenate([[0], np.cumsum(many)])[np.cumsum([0, *map(len, cuts)])]
                texts = decode(ids, np.diff(ends), v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                     pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_columns(encoded: DataFrame) -> DataFrame:
    """Counts and digests of the ids and the decoded text."""
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
