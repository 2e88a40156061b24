"""N-gram Jaccard self-join by token-combination prefixes.

A document is the set of its distinct word shingles (the tokens). Two documents link
when their sets' Jaccard similarity reaches a threshold. The filter: order all tokens
by frequency (rare first). A document of n tokens tolerates ``tau = n - ceil(t * n)``
of its own tokens missing from a partner, so any prefix of the ordered tokens that
"covers" ``tau + 1`` shares something with each partner's prefix. A rare token covers 1
and is a signature by itself. Frequent tokens are dealt by hash to small subgroups, and
every pair of tokens of a subgroup is a signature; a subgroup of m tokens covers m - 1,
so prefixes are extended until the cover is reached. A passage that thousands of texts
share is therefore looked at only in texts that consist of little else, and then by
pairs of its tokens.

Steps, all spread by hash:

1. Tasks shingle whole texts and send each bucket of the token space a block with the
   bucket's tokens (5 bytes) and their documents. Equal sets of one batch are sent once.
   Tokens in ``HEAVY`` or more documents of a batch are known to be frequent; the bucket
   gets one mark from that batch instead of a posting per document.
2. Buckets count tokens and send back those in two or more documents. A document with
   ``tau + 1`` tokens of its own has no partner and is done. One document of each distinct
   set is left and counted once more among its like, so that exact copies count once.
3. The rest emit signatures. Signature lists propose pairs: first each document with the
   members of its lists that are nearest to the middle of their group, then the members
   outside a list's largest component with everyone in other components. Pairs within a
   component need no test: it is one class already. A pair must meet in a signature that
   lies in the prefix of both for just their two sizes. Proposed pairs are verified on the
   token sets.
4. Links become components by star contractions.
5. Where links are counted: all links lie inside components, so every pair of distinct sets
   of a component is tested. Large components are dealt to blocks of sets, and a task gets
   two blocks and returns a number per set, never a row per pair. Exact copies count by the
   size of their group.

Defined results: null, empty or blank text has no tokens and links with nothing; texts
with fewer words than a shingle are one token; rows that share a ``doc_id`` are one node,
linked with what any of them links with; a null ``doc_id`` is kept with a null component
and links with nothing; an empty table gives no rows; other columns are ignored. Link
counts are of rows: the other rows with a ``doc_id`` whose sets are similar enough.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revisit.llm.graph import components
from revisit.llm.shared import keep, shuffle_parts
from revisit.llm.words import WordHashes, fold, mix, shingles

PART = 1_000_000  # tokens of a block batch
HEAVY = 64  # counts stop here: the order of tokens at least so frequent is by hash
RARE = 16  # a token in more documents is frequent
TURNS, TESTS = 2, 2  # turns of tests with one text of a list; tests of a text in a turn
GROUP, COLUMNS = 256, 4096  # sets of a block whose pairs are tested; tokens compared at once
SUBGROUP = 8  # a subgroup of frequent tokens per so many tokens of a text
LOW = np.uint64((1 << 40) - 1)

_BLOCK = "bucket long, batch long, kind tinyint, payload binary"
_DOC = "doc_id long, n long, s1 long, s2 long, toks array<long>"
_SIGNED = "doc_id long, n long, weight long, sigs array<long>, places array<int>, toks array<long>"
_HEAD, _POSTINGS, _MARKS = 0, 1, 2


def pack40(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(raw: bytes | memoryview) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :5] = part
    return out.view("<u8").ravel()


def pack_steps(sorted_ids: np.ndarray) -> bytes:
    """Ascending small numbers as their differences, in one or four bytes each."""
    steps = np.diff(sorted_ids, prepend=0)
    wide = len(steps) and steps.max() > 255
    return (b"\4" if wide else b"\1") + steps.astype("<u4" if wide else "u1").tobytes()


def unpack_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u4" if raw[0] == 4 else "u1", offset=1), dtype=np.int64)


def _of_texts(buckets: int, size: int):
    """From ids and texts: ids, sizes, digests and token sets, ``PART`` tokens at a time,
    so a task's memory does not depend on how long texts are. A token is its bucket and
    40 bits of its hash."""
    def run(batches: Iterator[pa.RecordBatch]):
        hashes = WordHashes()
        ids, sums, sets, held = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingles(hashes.of(text.as_py()), size)
                ids.append(i)
                sums.append((len(h), int(h.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(h))) if len(h) else 0))
                sets.append((((h >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40)) | (h & LOW))
                held += len(h) + 20
                if held >= PART:
                    yield ids, sums, sets
                    ids, sums, sets, held = [], [], [], 0
        if ids:
            yield ids, sums, sets
    return run


def _of_tokens(batches: Iterator[pa.RecordBatch]):
    """The same from ids, sizes and tokens; here every row counts for itself."""
    ids, sums, sets, held = [], [], [], 0
    for batch in batches:
        for i, n, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            ids.append(i)
            sums.append((n, len(ids), 0))
            sets.append(tokens.values.to_numpy().view(np.uint64))
            held += len(sets[-1]) + 20
            if held >= PART:
                yield ids, sums, sets
                ids, sums, sets, held = [], [], [], 0
    if ids:
        yield ids, sums, sets


def _blocks(parts, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sums, every in parts(batches):
            seen: set[tuple] = set()
            firsts = []
            for i, key in enumerate(sums):
                if key[0] and ids[i] is not None and key not in seen:
                    seen.add(key)
                    firsts.append(i)
            n, s1, s2 = (np.array(x, t) for x, t in zip(zip(*sums), (np.int64, np.uint64, np.uint64)))
            head = {"ids": ids, "n": n, "s1": s1, "s2": s2, "firsts": np.array(firsts, np.int64),
                    "heavy_doc": np.zeros(0, np.int64), "heavy_token": np.zeros(0, np.uint64)}
            name = xxhash.xxh64_intdigest(pickle.dumps((ids, sums))) >> 1
            rows: list[tuple] = []
            if firsts:
                tokens = np.concatenate([every[i] for i in firsts])
                doc = np.repeat(np.arange(len(firsts)), [len(every[i]) for i in firsts])
                del every
                ordered = np.sort(tokens)
                # A run of HEAVY equal tokens: a token equals the one HEAVY - 1 places on.
                often = ordered[HEAVY - 1:]
                often = np.unique(often[often == ordered[:len(often)]])
                if len(often):
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    heavy = often[at] == tokens
                    head["heavy_doc"], head["heavy_token"] = doc[heavy], tokens[heavy]
                    tokens, doc = tokens[~heavy], doc[~heavy]
                    owner = (often >> np.uint64(40)).astype(np.int64)
                    for b in np.unique(owner).tolist():
                        rows.append((b, name, _MARKS, pack40(often[owner == b] & LOW)))
                bucket = (tokens >> np.uint64(40)).astype(np.int64)
                order = np.argsort(bucket * len(firsts) + doc)
                tokens, doc, bucket = tokens[order] & LOW, doc[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else []
                for lo, hi in itertools.pairwise([0, *cuts, len(bucket)] if len(bucket) else [0]):
                    rows.append((int(bucket[lo]), name, _POSTINGS, pack40(tokens[lo:hi]) + pack_steps(doc[lo:hi])))
            rows.append((name % buckets, name, _HEAD, pickle.dumps(head, 5)))
            for part in itertools.batched(rows, 4096):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.int64(), pa.int8(), pa.binary()))],
                    ["bucket", "batch", "kind", "payload"])
    return run


def _split_postings(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and documents of a block: 5 bytes each, then a width byte, then steps."""
    # len = 5 m + 1 + w m with w 1 or 4; the width byte tells which.
    m = (len(raw) - 1) // 6
    if not ((len(raw) - 1) % 6 == 0 and raw[5 * m] == 1):
        m = (len(raw) - 1) // 9
    return unpack40(memoryview(raw)[:5 * m]), unpack_steps(raw[5 * m:])


def _count(group: pa.Table) -> pa.Table:
    """Tokens of one bucket that are in two or more documents, sent back to their batch."""
    bucket = group.column("bucket")[0].as_py()
    out: list[tuple] = []
    names, tokens, docs, marks = [], [], [], []
    for name, kind, raw in zip(*(group.column(c).to_pylist() for c in ("batch", "kind", "payload"))):
        if kind == _HEAD:
            out.append((name, bucket, _HEAD, raw))
        elif kind == _MARKS:
            marks.append(unpack40(raw))
        else:
            t, d = _split_postings(raw)
            names.append(name)
            tokens.append(t)
            docs.append(d)
    if tokens:
        token, doc = np.concatenate(tokens), np.concatenate(docs)
        part = np.repeat(np.arange(len(names)), [len(t) for t in tokens])
        order = np.argsort(token)
        token, doc, part = token[order], doc[order], part[order]
        new = np.concatenate([[True], token[1:] != token[:-1]])
        run = np.cumsum(new) - 1
        count = np.bincount(run)
        if marks:
            mark = np.unique(np.concatenate(marks))
            at = np.minimum(np.searchsorted(mark, token[new]), len(mark) - 1)
            count[mark[at] == token[new]] = HEAVY
        count = np.minimum(count, HEAVY)[run]
        shared = count >= 2
        token, doc, part, count = token[shared], doc[shared], part[shared], count[shared]
        order = np.lexsort((doc, part))
        token, doc, part, count = token[order], doc[order], part[order], count[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in itertools.pairwise([0, *cuts, len(part)] if len(part) else [0]):
            raw = np.uint32(hi - lo).tobytes() + pack40(token[lo:hi]) + count[lo:hi].astype("u1").tobytes() + pack_steps(doc[lo:hi])
            out.append((names[part[lo]], bucket, _POSTINGS, raw))
    cols = list(zip(*out)) if out else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int8(), pa.binary()))],
                    ["batch", "bucket", "kind", "payload"])


def signatures(n: int, tokens: np.ndarray, counts: np.ndarray, missing: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Signatures of a document with ``n`` tokens, of which ``tokens`` occur elsewhere,
    ordered rare first; it tolerates ``missing``. Each has its place: what the tokens
    before it cover. A partner for which fewer tokens may be missing meets only the
    signatures at places up to that number. None if there can be no partner."""
    alone = n - len(tokens)
    need = missing + 1 - alone
    if need <= 0 or n < 2:
        return None
    rare = int(np.searchsorted(counts, RARE, side="right"))
    single = tokens[:min(rare, need)]
    out, places, spare = [fold([single], seed=1)], [alone + np.arange(len(single))], [np.zeros(len(single), bool)]
    need -= rare
    if need > 0:
        often = tokens[rare:]
        level = int(np.floor(np.log(n) / np.log(1.25) + 1e-9))
        # Partners' sizes differ by a factor of 1.25 at most, so their levels by one at
        # most: with its own level and the next, each pair has one in common.
        for lv in (level, level + 1):
            groups = max(1, int(1.25 ** lv / SUBGROUP))
            sub = (mix(often) % np.uint64(groups)).astype(np.int64)
            # Cover: every token of a subgroup but its first. Stop where enough is covered.
            first = np.zeros(len(sub), bool)
            first[np.unique(sub, return_index=True)[1]] = True
            cover = np.cumsum(~first)
            stop = int(np.searchsorted(cover, need)) + 1
            order = np.lexsort((np.arange(len(sub[:stop])), sub[:stop]))
            g = sub[order]
            cuts = np.flatnonzero(np.diff(g)) + 1
            left, right = [], []
            for lo, hi in itertools.pairwise([0, *cuts, len(g)]):
                a, b = np.triu_indices(hi - lo, 1)
                left.append(order[lo + a])
                right.append(order[lo + b])  # the later of the two in the order
            left, right = np.concatenate(left), np.concatenate(right)
            x, y = often[left], often[right]
            out.append(fold([np.minimum(x, y), np.maximum(x, y)], seed=lv + 2))
            places.append(alone + rare + cover[right] - 1)
            spare.append(np.full(len(right), lv != level))
    # The lowest bit tells a signature of the next level: two documents of one level meet
    # at that level, so two such signatures need not meet.
    sig, place = np.concatenate(out), np.concatenate(places) * 2 + np.concatenate(spare)
    order = np.lexsort((place, sig))
    sig, place = sig[order], place[order]
    new = np.append(True, sig[1:] != sig[:-1])
    return sig[new], place[new]


def _returned(group: pa.Table):
    """A batch's header, and of each of its documents the shared tokens, rare first."""
    head, docs, tokens, counts = None, [], [], []
    for bucket, kind, raw in zip(*(group.column(c).to_pylist() for c in ("bucket", "kind", "payload"))):
        if kind == _HEAD:
            head = pickle.loads(raw)
            continue
        m = int(np.frombuffer(raw, "<u4", 1)[0])
        tokens.append(unpack40(memoryview(raw)[4:4 + 5 * m]) | np.uint64(bucket << 40))
        counts.append(np.frombuffer(raw, "u1", m, 4 + 5 * m))
        docs.append(unpack_steps(raw[4 + 6 * m:]))
    docs.append(head["heavy_doc"])
    tokens.append(head["heavy_token"])
    counts.append(np.full(len(head["heavy_doc"]), HEAVY, np.uint8))
    doc, token, count = np.concatenate(docs), np.concatenate(tokens), np.concatenate(counts)
    order = np.lexsort((token, count, doc))
    doc, token, count = doc[order], token[order], count[order]
    bounds = np.searchsorted(doc, np.arange(len(head["firsts"]) + 1))
    return head, [(i, token[lo:hi], count[lo:hi]) for i, lo, hi in zip(head["firsts"].tolist(), bounds, bounds[1:])]


def _candidates(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """All documents of one batch, with their shared tokens where partners are possible."""
        head, shared = _returned(group)
        n = head["n"].tolist()
        toks: list = [None] * len(n)
        for i, token, _ in shared:
            if n[i] - len(token) <= _missing(n[i], percent) and n[i] >= 2:
                toks[i] = np.sort(token).view(np.int64)
        return pa.table([pa.array(head["ids"], pa.int64()), pa.array(head["n"]), pa.array(head["s1"].view(np.int64)),
                         pa.array(head["s2"].view(np.int64)), pa.array(toks, pa.list_(pa.int64()))],
                        ["doc_id", "n", "s1", "s2", "toks"])
    return run


def _missing(n: int, percent: int) -> int:
    """Tokens that a partner of a document of ``n`` tokens may lack."""
    return n - -(-percent * n // 100)


def _sign(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Signatures of the candidates of one batch that can still have partners."""
        head, shared = _returned(group)
        rows = []
        for i, token, count in shared:
            n = int(head["n"][i])
            s = signatures(n, token, count, _missing(n, percent))
            if s is not None:
                rows.append((head["ids"][i], n, int(count.sum()), s[0].view(np.int64), s[1], np.sort(token).view(np.int64)))
        longs = pa.list_(pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (
            pa.int64(), pa.int64(), pa.int64(), longs, pa.list_(pa.int32()), longs))],
            ["doc_id", "n", "weight", "sigs", "places", "toks"])
    return run


def _verified(pairs: DataFrame, signed: DataFrame, percent: int, name: str) -> DataFrame:
    """Of the pairs ``a, b`` those whose sets are similar enough. A token that only one
    document has is in no intersection, so the shared tokens and the sizes suffice."""
    a = signed.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    b = signed.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    good = pairs.join(b, "b").join(a, "a").withColumn("i", both)
    return keep(good.filter(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent)
                .select("a", "b").distinct(), name)


def _exchange(blocks: DataFrame, then, schema: str) -> DataFrame:
    """Blocks to their buckets, shared tokens back to their batches."""
    counted = blocks.groupBy("bucket").applyInArrow(_count, "batch long, bucket long, kind tinyint, payload binary")
    return counted.groupBy("batch").applyInArrow(then, schema)


def token_table(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Steps 1 and 2: per document its set's size and digest (``n, s1, s2``) and, where
    it can have partners, its shared tokens."""
    buckets = min(2 * shuffle_parts(docs.sparkSession), 1 << 22)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    # Batches, and so their names, must be the same if a task runs again.
    blocks = rows.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(_blocks(_of_texts(buckets, size), buckets), _BLOCK)
    return keep(_exchange(blocks, _candidates(percent), _DOC), "ngram-docs")


def signed_table(table: DataFrame, percent: int = 80) -> DataFrame:
    """Step 2 again, over one document of each distinct set that can have partners: tokens
    are counted among these alone, so exact copies, and texts that turned out to have no
    partner, make no token look shared. What is left gets signatures."""
    buckets = min(2 * shuffle_parts(table.sparkSession), 1 << 22)
    reps = table.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = table.filter(F.col("toks").isNotNull()).select("doc_id", "n", "toks").join(reps, "doc_id", "left_semi")
    blocks = rows.select("doc_id", "n", "toks").sortWithinPartitions("doc_id").mapInArrow(_blocks(_of_tokens, buckets), _BLOCK)
    return keep(_exchange(blocks, _sign(percent), _SIGNED), "ngram-signed")


def _named(post: DataFrame, links_: DataFrame) -> DataFrame:
    """The rows of the signature lists with the component ``c`` of each document so far;
    lists within one component are finished and go."""
    comp = components(links_, "ngram-components")
    named = post.join(comp.withColumnRenamed("node", "d"), "d", "left").withColumn("c", F.coalesce("component", "d")).drop("component")
    main = (named.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("sig")
            .agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max("m").alias("mm"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("k")))
    return keep(named.drop("main", "mm", "m").join(main.filter("k > 1").drop("k"), "sig"), "ngram-open")


def links(signed: DataFrame, percent: int = 80) -> DataFrame:
    """Step 3: verified links ``a, b`` (a < b) between representatives of equal sets, enough
    of them that their components are those of all links."""
    # Two sets similar enough have this overlap; what each misses bounds the places at
    # which they must meet (and so their sizes).
    overlap = lambda n, m: F.expr(f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}")
    meet = lambda n, at, s, m, to, r: ((F.col(s) + F.col(r) < 2) & (F.col(at) <= F.col(n) - overlap(n, m))
                                       & (F.col(to) <= F.col(m) - overlap(n, m)))
    post = signed.select(F.col("doc_id").alias("d"), "n", "weight", F.explode(F.arrays_zip("sigs", "places")).alias("s")).select(
        "d", "n", "weight", F.col("s.sigs").alias("sig"), F.col("s.places").bitwiseAND(1).alias("spare"),
        F.shiftright("s.places", 1).alias("at"))
    lists = post.groupBy("sig").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.min("spare").alias("spares"))
    post = keep(post.join(lists.filter("first < last and spares = 0").select("sig"), "sig"), "ngram-lists")
    open_ = post.withColumns({"c": F.col("d"), "main": F.lit(None).cast("bigint")})
    found = None
    for turn in range(TURNS):
        # A text early in whose order the signature stands can meet most of the list; one
        # whose tokens are shared by many is in the middle of its group.
        early = (F.col("at") <= F.floor(F.col("n") * (100 - percent) / (100 + percent))).cast("int")
        order = F.struct(early, "weight", "d") if turn == 0 else F.struct(early, F.xxhash64("d", F.lit(turn)), F.col("d"))
        pivots = open_.groupBy("sig").agg(F.max_by(F.struct(F.col("d").alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("at").alias("pat"), F.col("spare").alias("ps")), order).alias("x"))
        near = open_.join(pivots.select("sig", "x.*"), "sig").filter((F.col("c") != F.col("pc")) & meet("n", "at", "spare", "pn", "pat", "ps"))
        most = Window.partitionBy("d").orderBy(F.desc("k"), "p")  # a text has as many pivots as lists at most
        pairs = (near.groupBy("d", "p").agg(F.count(F.lit(1)).alias("k")).withColumn("r", F.row_number().over(most)).filter(f"r <= {TESTS}")
                 .select(F.least("d", "p").alias("a"), F.greatest("d", "p").alias("b")).distinct())
        new = _verified(pairs, signed, percent, "ngram-links")
        found = new if found is None else found.unionByName(new)
        open_ = _named(post, found)
    # Whatever list still holds several components: all its pairs between them.
    outside = open_.filter("c != main").select("sig", F.col("d").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"), F.col("at").alias("xat"), F.col("spare").alias("xs"))
    apart = (F.col("c") != F.col("cx")) & ((F.col("c") == F.col("main")) | (F.col("x") < F.col("d")))
    cross = (outside.join(open_, "sig").filter(apart & meet("n", "at", "spare", "nx", "xat", "xs")).select(F.least("x", "d").alias("a"), F.greatest("x", "d").alias("b")).distinct())
    return found.unionByName(_verified(cross, signed, percent, "ngram-links"))


def _tally(sets: list[tuple], percent: int) -> list[tuple]:
    """Links of each set of one pair of blocks: ``n, s1, s2`` and the weight of its partners.
    Of two different blocks only pairs between them."""
    n = np.array([x[0] for x in sets], np.int64)
    weight = np.array([x[3] for x in sets], np.int64)
    block = np.array([x[4] for x in sets])
    doc = np.repeat(np.arange(len(sets)), [len(x[5]) for x in sets])
    _, token, count = np.unique(np.concatenate([x[5] for x in sets]), return_inverse=True, return_counts=True)
    doc, token = doc[count[token] > 1], token[count[token] > 1]
    order = np.argsort(token, kind="stable")
    doc, token = doc[order], token[order]
    token = np.cumsum(np.append(False, token[1:] != token[:-1])) if len(token) else token
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    both = np.zeros((len(left), len(right)), np.int64)
    bounds = np.searchsorted(token, np.arange(0, (int(token[-1]) if len(token) else -1) + COLUMNS + 1, COLUMNS))
    for lo, hi in itertools.pairwise(bounds.tolist()):
        if lo < hi:
            has = np.zeros((len(sets), int(token[hi - 1] % COLUMNS) + 1), np.float32)
            has[doc[lo:hi], token[lo:hi] % COLUMNS] = 1
            both += (has[left] @ has[right].T).astype(np.int64)
    linked = both * 100 >= (n[left][:, None] + n[right] - both) * percent
    links_of = np.zeros(len(sets), np.int64)
    if block.min() == block.max():
        np.fill_diagonal(linked, False)
        links_of[left] = linked @ weight
    else:
        links_of[left] = linked @ weight[right]
        links_of[right] = weight[left] @ linked
    return [(*x[:3], k) for x, k in zip(sets, links_of.tolist()) if k]


def _tallies(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ordered by component and pair of blocks, one such group after the other."""
        def rows():
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("class", "lo", "hi", "n", "s1", "s2", "weight", "block")]
                for *row, toks in zip(*cols, batch.column("toks")):
                    yield tuple(row[:3]), (*row[3:], toks.values.to_numpy())

        for _, part in itertools.groupby(rows(), key=lambda r: r[0]):
            out = _tally([r[1] for r in part], percent)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["n", "s1", "s2", "links"])
    return run


def link_counts(table: DataFrame, classes: DataFrame, percent: int = 80) -> DataFrame:
    """Step 5: ``n, s1, s2, links``, the rows of other sets that each distinct set links
    with, where there are any. ``classes``: component and number of rows per distinct set."""
    sets = (table.filter(F.col("toks").isNotNull()).groupBy("n", "s1", "s2").agg(F.first("toks").alias("toks"))
            .join(classes.select("n", "s1", "s2", "class", "weight"), ["n", "s1", "s2"]))
    sizes = (sets.groupBy("class").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("toks")).alias("held")).filter("m > 1")
             .select("class", F.ceil(F.greatest(F.col("m") / GROUP, F.col("held") / PART)).cast("int").alias("blocks")))
    dealt = (sets.join(sizes, "class").withColumn("block", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("class", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                     "n", "s1", "s2", "weight", "block", "toks"))
    key = ["class", "lo", "hi"]
    tallied = (dealt.repartition(shuffle_parts(table.sparkSession), *key).sortWithinPartitions(*key)
               .mapInArrow(_tallies(percent), "n long, s1 long, s2 long, links long"))
    return keep(tallied.groupBy("n", "s1", "s2").agg(F.sum("links").alias("links")), "ngram-counts")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, counted: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row per document; if ``counted`` also
    ``n_links``, with how many others it links."""
    table = token_table(docs, size, percent)
    comp = components(links(signed_table(table, percent), percent), "ngram-classes")
    groups = (table.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2")
              .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    classes = (groups.join(comp, groups["rep"] == comp["node"], "left")
               .select("n", "s1", "s2", F.coalesce("component", "rep").alias("class"), "weight"))
    n_links = []
    if counted:
        classes = keep(classes, "ngram-sets")
        classes = classes.join(link_counts(table, classes, percent), ["n", "s1", "s2"], "left")
        own = F.col("weight") - 1 + F.coalesce("links", F.lit(0))
        n_links = [F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.lit(0))).otherwise(0).cast("bigint").alias("n_links")]
    rows = table.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"), *n_links)
