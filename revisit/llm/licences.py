"""License scan: notice phrases and identifier tags by Aho-Corasick, expressions by a
shunting-yard parser.

A text's words are its runs of letters, digits and characters beyond ASCII, with A-Z
lower-cased. All notice phrases are looked for in one pass of an Aho-Corasick automaton
over the words joined by single spaces; every place counts, overlapping ones too. Where
the words of an identifier tag stand, the expression after the tag is read from the text,
parsed (``WITH`` before ``AND`` before ``OR``, parentheses) to postfix order and evaluated
to its labels and to whether the text may be used under permissive licences alone: an
``OR`` needs one permissive side, an ``AND`` both; an exception only adds permissions.

The automaton depends on the phrase list alone and is built in each task; nothing is
shuffled.

Defined results: null text counts as empty; a text without words has no places, null
first and last word, empty labels and score 0; an expression is read as far as it is well
formed; repeated rows are scanned like others; a null ``doc_id`` is kept; an empty table
gives no rows; other columns are ignored. Whole texts are scanned, whatever their length.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.llm.words import as_bytes

# Phrases (as words) and the labels they stand for.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "under the bsd license": "bsd",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
# Identifiers of expressions whose label differs from their lower-cased form.
IDENTIFIERS = {
    "apache-2.0": "apache-2", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2",
    "gpl-2.0-or-later": "gpl-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3",
    "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl", "mpl-2.0": "mpl-2", "cc0-1.0": "cc0", "cc-by-4.0": "cc-by",
    "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc",
}
# Further identifiers of the public SPDX list, in lower case, without -only, -or-later and +.
SPDX = frozenset("""
0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apl-1.0 apsl-1.0 apsl-1.1 apsl-1.2 apsl-2.0
artistic-1.0 artistic-1.0-cl8 artistic-1.0-perl artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent
bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsd-4-clause-uc bsl-1.0 busl-1.1 bzip2-1.0.6 catosl-1.1
cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-1.0 cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0
cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-2.0 cc-by-nc-sa-2.5 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0
cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc-pddc cc0-1.0 cddl-1.0 cddl-1.1 cecill-1.0 cecill-1.1 cecill-2.0 cecill-2.1 cecill-b cecill-c
cnri-python cpal-1.0 cpl-1.0 curl ecl-1.0 ecl-2.0 efl-1.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eudatagrid eupl-1.0 eupl-1.1 eupl-1.2 fair ftl
gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd icu ijg imagemagick intel ipa ipl-1.0 isc json lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libpng-2.0 libtiff
lpl-1.0 lpl-1.02 lppl-1.0 lppl-1.1 lppl-1.2 lppl-1.3a lppl-1.3c miros mit mit-0 motosoto mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-1.0 mulanpsl-2.0 multics
nasa-1.3 naumen ncsa ngpl nokia npl-1.0 npl-1.1 nposl-3.0 ntp oclc-2.0 odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 ogtsl openssl osl-1.0 osl-2.0 osl-2.1 osl-3.0
pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 rpl-1.1 rpl-1.5 rpsl-1.0 rscpl ruby simpl-2.0 sissl sleepycat spl-1.0 sspl-1.0
tcl ucl-1.0 unicode-dfs-2015 unicode-dfs-2016 unlicense upl-1.0 vim vsl-1.0 w3c watcom-1.0 wtfpl x11 xnet zend-2.0 zlib zpl-2.0 zpl-2.1
""".split())
PERMISSIVE = frozenset(("mit", "apache-2", "bsd", "isc", "cc0", "cc-by", "unlicense", "0bsd", "zlib"))
# How sure a label is by what it was found with.
WEIGHT_TAG, WEIGHT_BASE, WEIGHT_LONG, WEIGHT_SHORT = 0.95, 0.8, 0.9, 0.6

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG = re.compile(rb"(?:spdx[ _-]license[ _-]identifier|license[ _-]expression)[ \t]*[:=]?[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def plain(token: str) -> str:
    """An identifier without its version suffix."""
    return token.removesuffix("+").removesuffix("-only").removesuffix("-or-later")


def is_identifier(token: str) -> bool:
    """Is this lower-case token a licence's identifier, or one of the user's own?"""
    return plain(token) in SPDX or token in IDENTIFIERS or token.startswith("licenseref-")


def to_postfix(text: str, known: Callable[[str], bool] = bool) -> list[str]:
    """The longest well formed licence expression at the start of ``text`` whose licences are
    all ``known``, in postfix order; empty if there is none. After WITH stands an exception's
    name, which may be any."""
    best: list[str] = []
    out: list[str] = []
    stack: list[str] = []
    operand_next, at = True, 0
    while m := _TOKEN.match(text, at):
        token = m[1].rstrip(".")  # a full stop may end the sentence
        low = token.lower()
        if operand_next:
            if token == "(":
                stack.append(token)
            elif token == ")" or low in _BINDS:
                break
            elif not known(low) and not (stack and stack[-1] == "with"):
                break
            else:
                out.append(low)
                operand_next = False
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif low in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        else:
            break
        at = m.end()
        if not operand_next and "(" not in stack:
            best = out + stack[::-1]
    return best


def evaluate(postfix: list[str]) -> tuple[list[str], bool]:
    """Labels of the licences in an expression (exceptions are none), and whether it can
    be met with permissive licences alone."""
    stack: list[tuple[list[str], bool]] = []
    for token in postfix:
        if token in _BINDS:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else (
                left[0] + right[0], left[1] or right[1] if token == "or" else left[1] and right[1]))
        else:
            label = IDENTIFIERS.get(token.removesuffix("+"), IDENTIFIERS.get(plain(token), plain(token)))
            stack.append(([label], label in PERMISSIVE))
    return stack[0] if stack else ([], False)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    phrases = {**{p: (label, True) for p, label in BASE.items()}, **{p: (label, False) for p, label in NOTICES.items()},
               **{p: (None, False) for p in TAGS}}
    for phrase, (label, base) in phrases.items():
        a.add_word(f" {phrase} ", (phrase, label, base))
    a.make_automaton()
    return a


def scan(text: bytes, a: ahocorasick.Automaton) -> tuple:
    """``n_words``, base places (count, first, last word), base labels, all labels, score,
    expressions in postfix order, whether all expressions are permissive (None: none), and
    every place of a phrase: first word, number of words, label."""
    words = text.translate(_WORD_BYTES).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # a byte is a character
    starts, places, sure, base_labels, tagged = [], [], {}, set(), False
    blanks = [0, *itertools.accumulate(len(w) + 1 for w in words)]  # places of the blanks in ``line``
    for end, (phrase, label, base) in a.iter(line):
        if label is None:
            tagged = True
            continue
        weight = WEIGHT_BASE if base else WEIGHT_LONG if phrase.count(" ") >= 4 else WEIGHT_SHORT
        sure[label] = max(sure.get(label, 0.0), weight)
        at = bisect.bisect_left(blanks, end - len(phrase)) - 1
        places.append((at, phrase.count(" ") + 1, label))
        if base:
            starts.append(at)
            base_labels.add(label)
    expressions, permissive = [], None
    if tagged:
        for m in _TAG.finditer(text):
            if postfix := to_postfix(m[1].decode("utf-8", "replace"), is_identifier):
                labels, free = evaluate(postfix)
                expressions.append(" ".join(postfix))
                permissive = free if permissive is None else permissive and free
                for label in labels:
                    sure[label] = max(sure.get(label, 0.0), WEIGHT_TAG)
    doubt = 1.0
    for weight in sure.values():
        doubt *= 1 - weight
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(sure)), 1 - doubt, expressions, permissive, [dict(zip(("word", "words", "label"), p)) for p in sorted(places)])


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_(),
          pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string())])))
_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive", "places")


def licences(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id`` and what ``scan`` finds in its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            rows = [scan(t or b"", a) for t in as_bytes(batch.column(1))]
            columns = zip(*rows) if rows else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES))],
                                             ["doc_id", *_NAMES])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                                "labels string, score double, expressions array<string>, permissive boolean, "
                                "places array<struct<word: long, words: long, label: string>>")
