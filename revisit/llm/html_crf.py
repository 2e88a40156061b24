"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks (runs of text between block-level tags), each with
features of its ancestors (tags, roles, what their class and id names hint at) and of its
text (length, links, punctuation, place). A conditional random field with two labels,
trained on labelled pages by its conditional likelihood, is decoded by Viterbi; the blocks
labelled content are the text.

The labelled pages are made by ``labelled_pages``: layouts of many kinds (semantic tags,
class names, plain divisions; menus, notices, adverts, forms, comments, lists and tables
inside and outside the article; tags left open) with invented words, ``TRAIN_PAGES`` of
them. That number bounds training; the weights (a few hundred numbers) travel with the
tasks. Pages are independent, so nothing is shuffled.

Defined results: null or empty html gives empty text; broken markup is read as far as it
goes (an unfinished tag at the end is dropped, an unknown or partial character reference
stays as it is); scripts, styles, templates, frames, hidden elements and the document's
head are never text; ``br`` is white space inside a block; repeated rows are extracted like
others; a null ``page_id`` or URL is kept; an empty table gives no rows; other columns are
ignored. Whole pages are read, whatever their length.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 400
_SEED = 11

# Elements that begin and end blocks, that hold no text, that close others.
BLOCKS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
select summary table tbody td tfoot th thead tr ul
""".split())
SILENT = frozenset("head iframe noembed noframes noscript script style svg template textarea title".split())
RAW = frozenset("iframe noembed noframes script style textarea title".split())  # no markup inside
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_FENCES = frozenset("ul ol dl table select article aside div section td th body main".split())
_TAGS_AS_FEATURES = frozenset("""
article aside blockquote button dd dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header legend li
main menu nav ol option p pre search section select summary table td th ul
""".split())
HINTS = {
    "ad": r"\bads?\b|advert|sponsor|promo|banner|doubleclick|commercial",
    "comment": r"comment|repl(?:y|ies)|discuss|disqus|respond|review",
    "nav": r"nav|menu|breadcrumb|pag(?:er|ination)|\btoc\b|tabs?\b|skip",
    "side": r"side|related|widget|share|social|recommend|popular|trending|tags?\b|more-",
    "notice": r"cookie|consent|gdpr|notice|popup|modal|overlay|alert|subscri|newsletter|sign-?up|log-?in|paywall|toast",
    "foot": r"foot|copyright|legal|colophon|credit",
    "head": r"head|masthead|logo|top-?bar|brand",
    "meta": r"byline|author|\bdate|meta|timestamp|caption",
    "content": r"article|content|post|entry|story|text|body|main|prose",
}
_HINT = {k: re.compile(v) for k, v in HINTS.items()}
# A tag with a quote that nothing closes ends at the next ">", or with the page.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_OPEN_END = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
# One attribute after the other: names are whole, and no value is read as a name.
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")


def _named(tag: str, attributes: str) -> tuple[list[str], bool]:
    """Features of an element, and whether it is hidden."""
    out = [f"in:{tag}"] if tag in _TAGS_AS_FEATURES else []
    hidden = False
    if attributes:
        names = []
        for m in _ATTR.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                names.append(value)
            elif key == "role":
                out.append(f"role:{value}")
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(
                    r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
        if names:
            joined = re.sub(r"[_\s]+", " ", " ".join(names))
            out += [f"hint:{k}" for k, p in _HINT.items() if p.search(joined)]
    return out, hidden


def blocks(page: str) -> list[tuple[str, tuple[str, ...], int, str]]:
    """Leaf blocks of a page in order: text, features of the ancestors, characters inside
    links, innermost block element."""
    page = _OPEN_END.sub("", page)
    out: list[tuple] = []
    pieces: list[str] = []
    stack: list[tuple[str, tuple[str, ...], bool, str]] = [("", (), False, "")]  # tag, features, silent, block
    links = linked = 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, stack[-1][1], min(linked, len(text)), stack[-1][3]))
            pieces.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal links
        links -= sum(e[0] == "a" for e in stack[i:])
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        to = m.start() if m else end
        if to > at and not stack[-1][2]:
            piece = entities.unescape(page[at:to]) if "&" in page[at:to] else page[at:to]
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if any(e[0] in BLOCKS for e in stack[i:]):
                        close_block()
                    pop_to(i)
                    break
            else:
                if tag in BLOCKS:
                    close_block()
            continue
        if tag in ("br", "wbr"):
            pieces.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            close_block()
            # An open paragraph, list item, cell ... ends where the next one begins.
            for i in range(len(stack) - 1, 0, -1):
                name = stack[i][0]
                if name in CLOSES.get(tag, ("p",)) or name == "p":
                    pop_to(i)
                    break
                if name in _FENCES:
                    break
        if tag in VOID:
            continue
        _, above, silent, inner = stack[-1]
        features, hidden = _named(tag, m[3])
        silent = silent or hidden or tag in SILENT
        stack.append((tag, (*above, *(f for f in features if f not in above)) if features else above, silent,
                      tag if tag in BLOCKS else inner))
        links += tag == "a"
        if m[3].endswith("/") and tag in ("svg", "math", "iframe"):
            pop_to(len(stack) - 1)
        elif tag in RAW:
            over = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = over.start() if over else end
    close_block()
    return out


def _bin(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def features(found: list[tuple]) -> list[list[str]]:
    """Names of each block's features."""
    out = []
    n = len(found)
    for i, (text, above, linked, inner) in enumerate(found):
        words = text.count(" ") + 1
        link = _bin(linked / len(text), (0.01, 0.34, 0.67))
        size = _bin(words, (2, 5, 10, 25, 60))
        last = text[-1]
        own = ["bias", f"tag:{inner}", f"link:{link}", f"size:{size}", f"size:{size},link:{link}",
               f"stop:{last in '.!?:;…\"'}", f"place:{_bin(i / n, (0.1, 0.3, 0.7, 0.9))}"]
        if "©" in text or "copyright" in text.lower():
            own.append("copyright")
        out.append([*own, *above])
    return out


class Field:
    """A linear chain with two labels: 1 content, 0 other."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray) -> None:
        self.names, self.weights, self.moves, self.start = names, weights, moves, start

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The best label sequence, by Viterbi."""
        if not rows:
            return []
        w, names = self.weights, self.names
        (m00, m01), (m10, m11) = self.moves.tolist()
        back = []
        a = b = 0.0
        for i, row in enumerate(rows):
            ids = [names[f] for f in row if f in names]
            s0, s1 = w[ids].sum(axis=0).tolist()
            if i == 0:
                a, b = self.start[0] + s0, self.start[1] + s1
            else:
                back.append((b + m10 > a + m00, b + m11 > a + m01))
                a, b = max(a + m00, b + m10) + s0, max(a + m01, b + m11) + s1
        label = int(b > a)
        out = [label]
        for from0, from1 in reversed(back):
            label = int(from1 if label else from0)
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximise the penalised conditional log-likelihood of the label sequences. Gradients
    come from forward and backward sums over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for r in rows for f in r}))}
    n, longest = len(pages), max(len(r) for r, _ in pages)
    x = np.zeros((n, longest, len(names)))
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, (rows, labels) in enumerate(pages):
        for t, row in enumerate(rows):
            x[i, t, [names[f] for f in row]] = 1
        y[i, :len(labels)], live[i, :len(rows)] = labels, True
    gold = np.eye(2)[y] * live[:, :, None]
    moved = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    theta = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        w, moves, start = theta
        s = x @ w
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = start + s[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(fwd[:, t - 1, :, None] + moves, axis=1) + s[:, t]
            fwd[:, t] = np.where(live[:, t, None], new, fwd[:, t - 1])
        total = np.logaddexp.reduce(fwd[:, -1], axis=1)
        pair = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            ahead = s[:, t + 1] + bwd[:, t + 1]
            new = np.logaddexp.reduce(moves + ahead[:, None, :], axis=2)
            on = live[:, t + 1]
            bwd[:, t] = np.where(on[:, None], new, bwd[:, t + 1])
            p = np.exp(fwd[:, t, :, None] + moves + ahead[:, None, :] - total[:, None, None])
            pair += p[on].sum(axis=0)
        one = np.exp(fwd + bwd - total[:, None, None]) * live[:, :, None]
        grads = [np.einsum("ntf,nty->fy", x, gold - one) / n - decay * w, (moved - pair) / n - decay * moves,
                 (gold[:, 0] - one[:, 0]).sum(axis=0) / n - decay * start]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            theta[k] = theta[k] + rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Field(names, *theta)


class _Maker:
    """Writes one labelled page."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.labels = rng, {}
        self.syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüñ", k=rng.randint(1, 4))) for _ in range(60)]

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choices(self.syllables, k=r.randint(1, 3))) for _ in range(r.randint(low, high)))

    def text(self, label: int, low: int, high: int, stop: float = 1.0) -> str:
        while True:
            t = self.words(low, high).capitalize() + (self.rng.choice(".....!?:") if self.rng.random() < stop else "")
            if t not in self.labels:
                break
        self.labels[t] = label
        return t

    def p(self, label: int, low: int = 1, high: int = 90, cls: str = "") -> str:
        t, r = self.text(label, low, high, 0.9), self.rng.random()
        if r < 0.15 and " " in t:
            a, b = t.split(" ", 1)
            t = f'{a} <a href="/{a}">{b}</a>' if r < 0.02 else f'<a href="/x">{a}</a> {b}'
        open_ = "<p><b>" if 0.15 < r < 0.3 else f"<p{cls}>"
        return open_ + t + ("<br>" if r > 0.8 else "") + ("</p>" if r < 0.85 else "")

    def links(self, label: int, count: int) -> str:
        items = "".join(f'<li><a href="/{i}">{self.text(label, 1, 4, 0.2)}</a></li>' for i in range(count))
        return f"<ul>{items}</ul>"

    def prose(self) -> str:
        """What an article holds."""
        r, out = self.rng, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.text(1, 1, 14, 0.5)}</h1>")
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12))):
            k = r.random()
            if k < 0.72:
                out.append(self.p(1, *r.choice(((1, 3), (2, 8), (10, 40), (30, 110)))))
            elif k < 0.80:
                level = r.randint(2, 4)
                out.append(f"<h{level}>{self.text(1, 1, 8, 0.2)}</h{level}>")
            elif k < 0.86:
                items = "".join(f"<li>{self.text(1, 1, 20, 0.5)}" + r.choice(("</li>", "")) for _ in range(r.randint(1, 5)))
                out.append(f"<{'ul' if k < 0.83 else 'ol'}>{items}</{'ul' if k < 0.83 else 'ol'}>")
            elif k < 0.89:
                rows = "".join(f"<tr><td>{self.text(1, 1, 3, 0.1)}</td><td>{self.text(1, 1, 3, 0.1)}</td></tr>" for _ in range(3))
                out.append(f"<table>{rows}</table>")
            elif k < 0.93:
                out.append(f"<blockquote>{self.text(1, 4, 40)}</blockquote>")
            elif k < 0.96:
                out.append(f"<pre>{self.text(1, 2, 30, 0.2)}</pre>")
            else:
                out.append(f"<div>{self.text(1, 3, 60)}</div>")
            if r.random() < 0.08:
                out.append(self.extra())
        return "".join(out)

    def extra(self) -> str:
        """What is none of the article, wherever it stands."""
        r = self.rng
        short, long_ = lambda: self.text(0, 1, 6, 0.3), lambda: self.text(0, 5, 40, 0.9)
        return r.choice((
            lambda: f'<div class="{r.choice(("ad", "ads", "advert", "sponsored", "ad-slot", "promo-box"))}">{long_()}</div>',
            lambda: f'<div id="{r.choice(("cookie-notice", "consent", "newsletter", "popup"))}"><p>{long_()}</p><button>{short()}</button></div>',
            lambda: f'<div role="{r.choice(("alert", "dialog"))}">{long_()}</div>',
            lambda: f"<form><label>{short()}</label><input type=text><p>{long_()}</p><button>{short()}</button></form>",
            lambda: f"<aside><h3>{short()}</h3><p>{long_()}</p>{self.links(0, 3)}</aside>",
            lambda: f'<div class="{r.choice(("sidebar", "related", "share", "social-links", "widget"))}"><h4>{short()}</h4>{self.links(0, 4)}</div>',
            lambda: f'<section class="{r.choice(("comments", "comment-list", "discussion"))}"><h2>{short()}</h2>'
                    + "".join(f'<div class="comment"><b>{short()}</b>{self.p(0, 3, 40)}</div>' for _ in range(r.randint(1, 4))) + "</section>",
        ))()

    def page(self) -> str:
        r = self.rng
        nav, count = self.links(0, r.randint(2, 8)), r.randint(2, 6)
        head = r.choice((f"<nav>{nav}</nav>", f'<header><p>{self.text(0, 1, 5, 0.1)}</p><nav>{nav}</nav></header>',
                         f'<div class="{r.choice(("menu", "navbar", "top-bar", "breadcrumb"))}">{nav}</div>',
                         f'<div id="header"><span>{self.text(0, 1, 4, 0.1)}</span></div><div role="navigation">{nav}</div>', ""))
        foot = r.choice((f"<footer>&copy; {self._foot()}</footer>", f'<div id="footer"><p>{self._foot()}</p>{self.links(0, count)}</div>',
                         f"<footer><p>{self._foot()}</p>{self.links(0, count)}</footer>", f'<div role="contentinfo">{self._foot()}</div>', ""))
        prose = self.prose()
        body = r.choice((f"<article>{prose}</article>", f"<article>{prose}</article>", f"<main>{prose}</main>",
                         f"<main><article>{prose}</article></main>",
                         f'<div class="{r.choice(("content", "post-body", "entry", "story", "article-text"))}">{prose}</div>',
                         f'<div id="main">{prose}</div>', f'<div role="main">{prose}</div>', f"<div>{prose}</div>"))
        before = "".join(self.extra() for _ in range(r.choice((0, 0, 1, 1, 2))))
        after = "".join(self.extra() for _ in range(r.choice((0, 0, 1, 2, 3))))
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{head}{before}{body}{after}{foot}</body></html>"

    def _foot(self) -> str:
        t = self.text(0, 1, 12, 0.5)
        self.labels["© " + t] = 0
        return t


def labelled_pages(count: int, seed: int = _SEED) -> list[tuple[str, list[int]]]:
    """Pages and the label of each of their blocks."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        maker = _Maker(rng)
        page = maker.page()
        out.append((page, [maker.labels.get(t, 0) for t, *_ in blocks(page)]))
    return out


@cache
def default_field(count: int = TRAIN_PAGES) -> Field:
    return train([(features(blocks(page)), labels) for page, labels in labelled_pages(count)])


def main_text(page: str | None, field: Field) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b[0] for b, keep in zip(found, field.decode(features(found))) if keep)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` per page."""
    trained = field or default_field()
    names, weights = trained.names, (trained.weights, trained.moves, trained.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(names, *weights)
        for batch in batches:
            texts = [main_text(page, own) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
