"""Main text of web pages: a recurrent labeller reads a page's blocks in order and says which belong to the article.

A page is cut into leaf blocks, runs of text between block-level tags, each with the path of open elements above it. A block becomes
a vector: hashed names of the path (tags and words of class, id and role attributes), hashed words of the whole text, and a few
measures. A bidirectional LSTM in numpy reads the sequence and gives every block a probability; blocks of at least one half are kept.

Learned from: ``SAMPLE_PAGES`` pages, those of the smallest id hashes, whose markup itself tells the article (an ``article`` or ``main``
element). They supply their own labels, and are shown again in other dress: with the article in a plain container, and with blocks of the kinds that
are not article (menus, sidebars, notices, adverts, forms, comments) put before, inside and after it. Without such a page in
the sample every block outside the elements that never hold article text is kept.

Text: scripts, styles, comments and other raw elements are dropped; character references are decoded; white space in a block becomes one space;
blocks join in page order by one line end.

Rows: a null or empty page, and one without kept blocks, has the empty text; unclosed, crossed and truncated tags are read like a browser reads
them, up to the end; repeated rows give repeated rows; a null id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

SAMPLE_PAGES = 240
PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 96, 16, 6, 20
INPUT = PATH_DIM + WORD_DIM + MEASURES
KEEP_FROM = 0.5
PAGES_AT_ONCE = 64
#: Pages times blocks of the longest of them that the labeller reads together.
BLOCKS_AT_ONCE = 16_384

# Fixed values of the markup language.
RAW = "script|style|template|noscript|textarea|svg|iframe|object|select"
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head
    header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of these names, as their end tags may be left out.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
        "option": {"option"}}
LIST_LIKE = frozenset("ul ol dl table tr menu".split())
ARTICLE = frozenset(("article", "main"))
NEVER = frozenset("nav header footer aside form title head button".split())

_piece = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
                    re.S | re.I)
_named = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I).findall
_words = re.compile(r"[^\W_]+").findall


#: Marks that pages shown in other dress carry; never part of a vector.
OWN, OTHER = ".marksown", ".marksother"


class Level:
    """What the open elements at one depth say. A level adds to the one above and shares what it does not change, so that depth costs nothing per block."""
    __slots__ = ("fresh", "numbers", "last", "article", "other", "never", "own", "strange")

    def __init__(self, above: Level | None, names: list[str], fresh: list[str]):
        shown = [n for n in names if n not in (OWN, OTHER)]
        self.fresh = fresh
        self.last = shown[-1] if shown else ""
        self.article = (above is not None and above.article) or bool(ARTICLE & set(names[:1]))
        self.other = (above is not None and above.other) or self.article and any(w in _OTHER_WORDS for w in names)
        self.never = (above is not None and above.never) or bool(NEVER & set(names))
        self.own = (above is not None and above.own) or OWN in names
        self.strange = (above is not None and above.strange) or OTHER in names
        self.numbers = above.numbers if above is not None else np.zeros(PATH_DIM, np.float32)
        if fresh:
            self.numbers = self.numbers.copy()
            for n in fresh:
                at, sign = _hashed(n, PATH_DIM, _path_cache)
                self.numbers[at] += sign


@dataclass
class Block:
    text: str
    level: Level
    linked: float


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, with their paths."""
    out: list[Block] = []
    stack: list[tuple[str, Level]] = []
    top = Level(None, [], [])
    held: list[str] = []
    opened: Counter = Counter()  # open elements by tag
    named: set[str] = set()  # names of the open elements
    linked = 0

    def close(i: int) -> None:
        for tag, level in stack[i:]:
            opened[tag] -= 1
            named.difference_update(level.fresh)
        del stack[i:]

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else top, min(1.0, linked / len(text))))
            held.clear()
            linked = 0

    for m in _piece.finditer(page or ""):
        name = m["name"]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                held.append(piece)
                if opened["a"]:
                    linked += len(piece)
            elif m["raw"]:
                held.append(" ")
            continue
        name = name.lower()
        if name in VOID:
            if name in BLOCK:
                flush()
            else:
                held.append(" " if name == "br" else "")
            continue
        if m["close"]:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    close(i)
                    break
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        if name in BLOCK:
            flush()
            ends = ENDS.get(name, {"p"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in BLOCK and (stack[i][0] in LIST_LIKE or stack[i][0] not in ("td", "th", "li", "dd", "dt", "tbody", "thead", "tfoot", "p")):
                    break
        names = [name]
        for found in _named(m["attrs"] or ""):
            names += [f".{w}" for w in _words("".join(found).lower())]
        fresh = [n for n in dict.fromkeys(names) if n not in named and n not in (OWN, OTHER)]
        named.update(fresh)
        opened[name] += 1
        stack.append((name, Level(stack[-1][1] if stack else top, names, fresh)))
    flush()
    return out


def _hashed(name: str, dim: int, cache: dict[str, tuple[int, float]]) -> tuple[int, float]:
    at = cache.get(name)
    if at is None:
        if len(cache) > 200_000:
            cache.clear()
        h = zlib.crc32(name.encode())
        at = cache[name] = (h % dim, 1.0 if h >> 31 else -1.0)
    return at


_path_cache: dict[str, tuple[int, float]] = {}
_word_cache: dict[str, tuple[int, float]] = {}


def vectors(found: list[Block]) -> np.ndarray:
    """One row of numbers per block."""
    out = np.zeros((len(found), INPUT), np.float32)
    for i, b in enumerate(found):
        row = out[i]
        row[:PATH_DIM] = b.level.numbers
        if b.level.last:
            at, sign = _hashed("last " + b.level.last, PATH_DIM, _path_cache)
            row[at] += sign
        words = b.text.lower().split()
        for w in words:
            at, sign = _hashed(w, WORD_DIM, _word_cache)
            row[PATH_DIM + at] += sign / len(words)
        n = len(b.text)
        row[-6:] = (np.log1p(n) / 5, b.linked, b.text[-1] in ".!?", len(words) < 4, i / len(found), "©" in b.text)
    return out


# Dress for the article, and for blocks that are not article, as (tag, attributes).
ARTICLE_DRESS = [("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="post-body"'), ("section", 'class="entry content"'),
                 ("div", 'class="article"'), ("div", 'class="story text"'), ("article", 'class="post"'), ("main", 'id="content"'), ("div", 'role="main"')]
ARTICLE_PARTS = ["p", "p", "h1", "h2", "h3", "h4", "ul><li", "blockquote", "pre", "div", "figcaption", "section"]
OTHER_DRESS = [("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("aside", 'class="sidebar"'), ("div", 'class="sidebar widget"'), ("div", 'class="ad"'), ("div", 'class="ads advert"'),
               ("div", 'class="advertisement"'), ("div", 'class="ad-banner sponsored"'), ("div", 'class="promo"'), ("div", 'class="cookie-notice"'), ("div", 'id="cookie-banner consent"'),
               ("div", 'class="notice"'), ("div", 'class="comments"'), ("section", 'class="comments"'), ("section", 'id="comments"'), ("div", 'class="comment"'), ("ul", 'class="menu"'),
               ("div", 'class="menu navigation nav"'), ("div", 'class="breadcrumb breadcrumbs"'), ("form", ""), ("form", 'class="search"'), ("form", 'class="newsletter subscribe signup"'),
               ("div", 'class="related"'), ("div", 'class="share social"'), ("div", 'class="footer"'), ("div", 'class="header"'), ("div", 'class="popup modal"'), ("div", 'role="navigation"'),
               ("div", 'role="complementary"'), ("ol", 'class="comment-list"'), ("div", 'class="reader-comments"'), ("section", 'class="reply responses"'), ("div", 'class="copyright legal"')]


def is_article(b: Block) -> bool:
    """The label that the markup itself gives."""
    return b.level.article and not b.level.never and not b.level.other


_OTHER_WORDS = frozenset("." + w for _, attrs in OTHER_DRESS for a in re.findall(r'"([^"]*)"', attrs) for w in _words(a)
                         if w not in ("list", "main", "text", "header", "legal", "notice", "reply"))


def dressed(page: str, seed: int, shows: int = 6) -> list[tuple[list[Block], list[bool]]]:
    """A page that tells its article, with its labels, and the same blocks in other dress."""
    own = blocks(page)
    labels = [is_article(b) for b in own]
    if not any(labels):
        return []
    out = [(own, labels)]
    draw = np.random.default_rng(seed)
    article, rest = [b for b, y in zip(own, labels) if y], [b.text for b, y in zip(own, labels) if not y]
    for _ in range(shows):
        tag, attrs = ARTICLE_DRESS[draw.integers(len(ARTICLE_DRESS))]
        wrap = [("div", 'class="wrapper"'), ("div", 'id="page"'), ("section", ""), ("div", ""), ("div", 'id="main"'), ("div", 'class="container"')][draw.integers(6)]
        inner = [f"<{t}>{html.escape(b.text)}</{t.split('><')[-1]}>{'</ul>' if t == 'ul><li' else ''}" for b in article
                 for t in ([ARTICLE_PARTS[draw.integers(len(ARTICLE_PARTS))]] if draw.random() < 0.5 else ["p"])]

        def other() -> str:
            t, a = OTHER_DRESS[draw.integers(len(OTHER_DRESS))]
            source = rest if draw.random() < 0.5 and rest else [b.text for b in article]
            picked = [source[draw.integers(len(source))] for _ in range(draw.integers(1, 5))]
            # Whole blocks, and beginnings for short ones.
            picked = [html.escape(p if draw.random() < 0.5 else p[:200]) for p in picked]
            item = {"nav": "li", "ul": "li", "ol": "li"}.get(t, ["p", "li", "div", "label"][draw.integers(4)])
            link = draw.random() < 0.4
            body = "".join(f"<{item}>{'<a href=x>' if link else ''}{p}{'</a>' if link else ''}</{item}>" for p in picked)
            return f"<{t} {a} data-other>{body}</{t}>"

        for _ in range(draw.integers(0, 3)):
            inner.insert(draw.integers(1, len(inner) + 1), other())
        before, after = "".join(other() for _ in range(draw.integers(0, 4))), "".join(other() for _ in range(draw.integers(0, 4)))
        text = f"<html><head><title>{html.escape(article[0].text[:60])}</title></head><body><{wrap[0]} {wrap[1]}>{before}<{tag} {attrs} data-own>{''.join(inner)}</{tag}>{after}</{wrap[0]}></body></html>"
        marked = text.replace(" data-other>", ' class="marksother">').replace(" data-own>", ' class="marksown">')
        shown = blocks(marked)
        out.append((shown, [b.level.own and not b.level.strange for b in shown]))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """States of one direction over x (pages, steps, inputs), and, to ``keep``, what the way back needs."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    states, kept = np.zeros((n, steps, HIDDEN)), []
    for t in range(steps):
        z = np.concatenate([x[:, t], h], 1)
        gates = z @ w + b
        i, f, o = (_sigmoid(gates[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN:])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        states[:, t] = h
        if keep:
            kept.append((z, i, f, o, g, before, tc))
    return states, kept


def _lstm_back(d: np.ndarray, kept: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gw, gb = np.zeros_like(w), np.zeros(w.shape[1])
    dh, dc = np.zeros(d[:, 0].shape), np.zeros(d[:, 0].shape)
    for t in range(d.shape[1] - 1, -1, -1):
        z, i, f, o, g, before, tc = kept[t]
        dh = dh + d[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        gw += z.T @ gates
        gb += gates.sum(0)
        dh, dc = (gates @ w.T)[:, -HIDDEN:], dc * f
    return gw, gb


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every page's steps in reverse, with the padding left at the end."""
    steps = np.arange(x.shape[1])[None, :]
    at = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
    return np.take_along_axis(x, at[:, :, None], 1)


def _logits(w: list[np.ndarray], x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    ahead, k1 = _lstm(x, w[0], w[1], keep)
    back, k2 = _lstm(_turned(x, lengths), w[2], w[3], keep)
    both = np.concatenate([ahead, _turned(back, lengths)], 2)
    return both @ w[4] + w[5][0], (both, k1, k2)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), lengths.max(), INPUT))
    for i, r in enumerate(rows):
        x[i, :len(r)] = r
    return x, lengths


def train(rows: list[np.ndarray], labels: list[np.ndarray], passes: int = 16, rate: float = 0.01, seed: int = 3) -> list[np.ndarray]:
    """Weights of the labeller, by Adam on the logistic loss of every block."""
    draw = np.random.default_rng(seed)
    w = []
    for _ in range(2):
        w += [draw.normal(0, 0.15, (INPUT + HIDDEN, 4 * HIDDEN)), np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)]
    w += [draw.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), i))
    batches = [order[i:i + 32] for i in range(0, len(order), 32)]
    for _ in range(passes):
        for k in draw.permutation(len(batches)):
            x, lengths = _padded([rows[i] for i in batches[k]])
            y = np.zeros(x.shape[:2])
            for i, j in enumerate(batches[k]):
                y[i, :lengths[i]] = labels[j]
            seen = np.arange(x.shape[1])[None, :] < lengths[:, None]
            logit, (both, k1, k2) = _logits(w, x, lengths, keep=True)
            error = (_sigmoid(logit) - y) * seen / seen.sum()
            spread = error[:, :, None] * w[4]
            g0, g1 = _lstm_back(spread[:, :, :HIDDEN], k1, w[0])
            g2, g3 = _lstm_back(_turned(spread[:, :, HIDDEN:], lengths), k2, w[2])
            grads = [g0, g1, g2, g3, (both * error[:, :, None]).sum((0, 1)), np.array([error.sum()])]
            step += 1
            for a, g, p, q in zip(w, grads, m, v):
                p += 0.1 * (g - p)
                q += 0.01 * (g * g - q)
                a -= rate * (p / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.99 ** step)) + 1e-8)
    return w


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES) -> list[np.ndarray] | None:
    """Weights from pages that tell their article; None where the sample has none."""
    told = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("page_id", "html")
    chosen = told.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    texts = told.join(F.broadcast(chosen.distinct()), "page_id")

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = dressed(page, zlib.crc32(str(pid).encode()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pid] * len(got), pa.int64()), pa.array([vectors(b).astype("<f4").tobytes() for b, _ in got], pa.binary()),
                     pa.array([bytes(map(int, y)) for _, y in got], pa.binary())], names=["page_id", "x", "y"])

    shown = texts.mapInArrow(show, "page_id long, x binary, y binary").collect()
    shown.sort(key=lambda r: (zlib.crc32(str(r["page_id"]).encode()), r["page_id"], bytes(r["x"])))
    shown = [r for r in shown if len(r["y"])]
    if not shown:
        return None
    return train([np.frombuffer(r["x"], "<f4").reshape(-1, INPUT) for r in shown], [np.frombuffer(r["y"], np.uint8) for r in shown])


def label(found: list[list[Block]], weights: list[np.ndarray] | None) -> list[np.ndarray]:
    """Of every page's blocks, which are kept; pages of like length are read together, at most ``BLOCKS_AT_ONCE`` steps or one page."""
    out = [np.zeros(0, bool)] * len(found)
    if weights is None:
        return [np.array([not b.level.never for b in bs], bool) for bs in found]
    order = [i for i in sorted(range(len(found)), key=lambda i: len(found[i])) if found[i]]
    parts: list[list[int]] = []
    for i in order:
        # Lengths ascend, so the page that comes is the longest of its part.
        if not parts or len(parts[-1]) == PAGES_AT_ONCE or (len(parts[-1]) + 1) * len(found[i]) > BLOCKS_AT_ONCE:
            parts.append([])
        parts[-1].append(i)
    for part in parts:
        x, lengths = _padded([vectors(found[i]) for i in part])
        logit, _ = _logits(weights, x, lengths)
        for i, row, n in zip(part, logit, lengths):
            out[i] = _sigmoid(row[:n]) >= KEEP_FROM
    return out


def extract(pages: DataFrame, weights: list[np.ndarray] | None) -> DataFrame:
    """page_id, url and the main text of every page."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4 * PAGES_AT_ONCE):
                part = batch.slice(at, 4 * PAGES_AT_ONCE)
                found = [blocks(t.as_py()) for t in part.column(2)]
                texts = ["\n".join(b.text for b, y in zip(bs, kept) if y) for bs, kept in zip(found, label(found, shared.value))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    return extract(pages, learn(pages))
