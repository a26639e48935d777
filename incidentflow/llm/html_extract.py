"""Operator 2 - main text of HTML pages by minimum-cut labelling.

A page becomes a list of text blocks with the elements around them. Two things give a block's
terminal capacities: a logistic classifier over its text (length, links, punctuation, place, heading) and
evidence from its elements (article, main / nav, footer, aside, form, class and id words such as
``ad``, ``sidebar``, ``comments``). Smoothness edges join neighbours in page order and consecutive blocks
with the same parent. The minimum cut separates content from boilerplate.

The three are of one size. Evidence is graded: a name made of listed words alone counts in full, one that
also has other words (``comment-list``) half, a layout state (``has-sidebar``) nothing; article or main
inside a boilerplate element takes it back; an unlisted name inside content halves it. So half
evidence gives way to the text alone, full evidence to text and neighbours together.

The classifier is trained here, on blocks of at most ``sample_pages`` pages whose elements say in full what
they are, both kinds with the same weight; its text features know nothing of the elements. Without both
kinds of blocks in the sample the weights ``DEFAULT`` are used.

Cases: null, empty or text-free html: empty text. Unclosed and stray tags, comments, scripts are read as a
browser would (an unclosed script or comment runs to the end). Pages of any length, repeated
rows and null ids are treated alike; an empty table gives an empty result; other columns are not
read. Text of elements that show none (svg, button, video and so on) is left out up to where a browser ends
them. Ties of the cut go to boilerplate. Tags and comments are read in one forward scan, so the time of a
page grows with its length whatever its markup: a quote opens a value only after ``=``, a tag that the end of
the page cuts off is dropped, ``<!-->`` and ``--!>`` end a comment, ``</ p>`` is one.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE_PAGES = 400                     # pages of the training sample, each of at most SAMPLE_CHARS characters
SAMPLE_CHARS = 1 << 16
EVIDENCE, CLASSIFIER = 3.0, 2.5        # full evidence of an element, bound of the classifier's part
HALF, MOST, LEAST = 1.5, 4.0, 1.0      # half evidence; bound of several words; left below unlisted names in content
NEXT, SIBLING = 0.6, 0.6               # smoothness: neighbours in page order, same parent
TINY = 1e-12                           # capacities up to this are none

# --- fixed values: element and word lists ---
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption "
             "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary "
             "table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# text up to the end tag of the same name, or to the end of the page
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style noscript iframe textarea title".split()}
# ordinary elements whose text is not the page's; they end where a browser ends them
FOREIGN = set("svg math".split())
HIDDEN = FOREIGN | set("template object select button canvas audio video".split())
BARRIER = set("template object select button".split())         # no paragraph or list item is closed across these
# places in foreign elements that hold HTML again, and start tags that end foreign elements elsewhere
HTML_AGAIN = set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu "
               "meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BAD_TAGS = set("nav footer aside form dialog menu".split())
GOOD_TAGS = set("article main".split())
BAD_WORDS = set("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments cookie "
                "cookies disqus footer login masthead menu modal nav navbar navigation newsletter notice pagination "
                "popup promo promotion related share sharing sidebar signup social sponsor sponsored subscribe "
                "subscription toolbar widget".split())
HALF_BAD_WORDS = set("commenter commenters commentlist replies reply respond responses".split())
STATES = set("has have hide hides is no not show shows with without".split())      # has-sidebar says nothing of the text
GOOD_WORDS = set("article content entry main post story".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "button": {"button"}}
DEFAULT = np.array([-1.5, 0.9, -4.0, 0.6, 0.8, 0.0, 0.3])

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|[!?]|/(?!\Z))")
_COMMENT_END = re.compile(r"--!?>")
# name and value; a value without its closing quote runs to the end of the page
_ATTRIBUTE = re.compile(r"(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+)"
                        r"|(?=>)|\Z))?+")
_ATTRIBUTES = re.compile(rf"(?:[\s/]++|{_ATTRIBUTE.pattern})*+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("text", "evidence", "parent", "words", "linked", "heading")

    def __init__(self, text, evidence, parent, words, linked, heading):
        self.text, self.evidence, self.parent = text, evidence, parent
        self.words, self.linked, self.heading = words, linked, heading


def _names(attributes: str, in_content: bool) -> float | None:
    """Evidence of the class, id and role names; None without names."""
    tokens = {t for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role")
              for t in (m[2] or m[3] or m[4] or "").split()}
    if not tokens:
        return None
    total = 0.0
    for t in tokens:
        words = [w.lower() for w in _WORD.findall(t)]
        if not words or words[0] in STATES:
            continue
        good = sum(w in GOOD_WORDS for w in words)
        bad = sum(w in BAD_WORDS or w == "header" and not in_content and not good for w in words)
        if bad:
            total -= EVIDENCE if bad == len(words) else HALF
        elif any(w in HALF_BAD_WORDS for w in words):
            total -= HALF
        elif good:
            total += EVIDENCE if good == len(words) else HALF
    return max(-MOST, min(MOST, total))


def _evidence(tag: str, attributes: str, outer: float) -> float:
    """Content above 0, boilerplate below: of an element inside one with ``outer``."""
    if tag in ("body", "html"):
        return outer
    own = EVIDENCE if tag in GOOD_TAGS else -EVIDENCE if tag in BAD_TAGS or (tag == "header" and outer <= 0) else 0.0
    names = _names(attributes, outer > 0) if attributes else None
    if names:
        own = max(-MOST, min(MOST, own + names))
    if own < 0:
        return min(outer, own)
    if own > 0 and outer >= 0:
        return max(outer, own)
    if own > 0 and tag in GOOD_TAGS:             # taken back whole below half evidence, by half below full
        return outer + (EVIDENCE if outer > -EVIDENCE else HALF)
    if names == 0.0 and tag not in CLOSES and tag in BLOCKS and outer > LEAST:
        return max(LEAST, outer / 2)
    return outer


def _self_closed(attributes: str) -> bool:
    """Ends with a slash that is not part of a value."""
    if not attributes.endswith("/"):
        return False
    last = 0
    for m in _ATTRIBUTE.finditer(attributes):
        last = m.end()
    return last < len(attributes)


def tags(page: str):
    """(first place, place after, tag or None, whether it ends an element, attributes) of tags and comments, in order.

    The caller may send the place at which to go on.
    """
    at = 0
    while m := _OPEN.search(page, at):
        start, tag, attributes = m.start(), m[2], ""
        if tag is not None:
            end = _ATTRIBUTES.match(page, m.end()).end()
            if end == len(page):                 # the end of the page cuts it off
                yield start, end, None, False, ""
                return
            attributes, at = page[m.end():end], end + 1
        elif page.startswith(("<!-->", "<!--->"), start):
            at = page.index(">", start) + 1
        elif page.startswith("<!--", start):
            end = _COMMENT_END.search(page, start + 4)
            at = end.end() if end else len(page)
        else:
            at = page.find(">", m.end()) + 1 or len(page)
        at = (yield start, at, tag and tag.lower(), bool(m[1]), attributes) or at


def _raw_end(page: str, tag: str, at: int) -> int:
    """Place after the end tag of a raw element."""
    end = RAW[tag].search(page, at)
    return min(_ATTRIBUTES.match(page, end.end()).end() + 1, len(page)) if end else len(page)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in page order."""
    out: list[Block] = []
    root = ("", 0, 0)
    stack = [("", 0, 0, False, False, root)]     # tag, evidence, number of the element, hidden, foreign, shown block
    opened: Counter = Counter()                  # tags on the stack
    parts: list[str] = []
    links, in_link, number, at = 0, 0, 0, 0

    def end_block():
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag, evidence, me = stack[-1][5]
                words = text.count(" ") + 1
                out.append(Block(text, evidence, me, words, min(links, words), tag[:1] == "h" and tag[1:].isdigit()))
            parts.clear()
            links = 0

    def read(to):
        nonlocal links
        if to > at and not stack[-1][3]:
            s = page[at:to]
            parts.append(s)
            if in_link:
                links += len(s.split())

    def shut(keep):
        opened.subtract(s[0] for s in stack[keep:])
        del stack[keep:]

    source, skip = tags(page), None
    while True:
        try:
            start, end, tag, ends, attributes = source.send(skip)
        except StopIteration:
            break
        skip = None
        read(start)
        at = end
        if tag is None:
            continue
        keep = len(stack)                        # elements that stay open
        if ends:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    keep = i
                    break
                if stack[i][0] in BARRIER and tag not in BARRIER and (tag not in BLOCKS or tag in CLOSES):
                    break
            if tag in BLOCKS and not stack[keep - 1][3]:
                end_block()
            shut(keep)
            if tag == "a":
                in_link = 0
            continue
        if tag in BREAKOUT:
            while stack[keep - 1][4]:
                keep -= 1
        foreign = stack[keep - 1][4]
        if tag in RAW and not foreign:
            at = skip = _raw_end(page, tag, at)
            continue
        close = CLOSES.get(tag)
        if close and not foreign and any(opened[c] for c in close):
            for i in range(keep - 1, 0, -1):
                if stack[i][0] in close:
                    keep = i
                    break
                if stack[i][0] in BLOCKS or stack[i][0] in BARRIER:
                    break
        hidden = stack[keep - 1][3]
        if tag in BLOCKS and not hidden:
            end_block()
        shut(keep)
        foreign = foreign or tag in FOREIGN
        if foreign and _self_closed(attributes) or tag in VOID and not stack[-1][4]:
            continue
        number += 1
        # a paragraph's parent is what holds it: siblings share it
        evidence, me = _evidence(tag, attributes, stack[-1][1]), stack[-1][2] if tag in CLOSES else number
        shown = tag in BLOCKS and not (hidden or tag in HIDDEN)
        stack.append((tag, evidence, me, hidden or tag in HIDDEN, foreign and tag not in HTML_AGAIN,
                      (tag, evidence, me) if shown else stack[-1][5]))
        opened[tag] += 1
        if tag == "a" and not hidden:
            in_link = 1
    read(len(page))
    end_block()
    return out


def text_features(own: list[Block]) -> np.ndarray:
    """One row per block: 1, log words, share of linked words, ends like a sentence, punctuation, heading, place."""
    n = len(own)
    return np.array([[1.0, np.log1p(b.words), b.linked / b.words, b.text[-1] in ".!?…:;\"”",
                      min(1.0, sum(map(b.text.count, ",.;")) / b.words), b.heading, 1 - abs(2 * (i + 0.5) / n - 1)]
                     for i, b in enumerate(own)], float).reshape(n, 7)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, with a ridge; both classes weigh the same."""
    w = np.zeros(x.shape[1])
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (share * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def edges(own: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, capacity)."""
    out, last = [], {}
    for i, b in enumerate(own):
        if i:
            out.append((i - 1, i, NEXT))
        j = last.get(b.parent)
        if j is not None:
            out.append((j, i, SIBLING))
        last[b.parent] = i
    return out


def minimum_cut(unary: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the content side of the minimum cut.

    A node whose terminal capacity exceeds all its open edges keeps its side (no cut does better);
    its edges then count for its neighbours. What stays open is solved by blocking flows over layers of shortest
    paths; a node's terminal capacity is an excess (source) or a need (sink) of its own.
    """
    n = len(unary)
    u = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in pairs:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(u[i]) > sum(near[i].values()):
            side[i] = u[i] > 0
            for j, w in near[i].items():
                u[j] += w if side[i] else -w
                del near[j][i]
                if side[j] is None:
                    todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if not left:
        return [bool(x) for x in side]
    place = {i: k for k, i in enumerate(left)}
    arcs: list[list[int]] = [[] for _ in left]
    to, room = [], []                            # arc e and its reverse e ^ 1
    for i in left:
        for j, w in near[i].items():
            if i < j:
                arcs[place[i]].append(len(to))
                arcs[place[j]].append(len(to) + 1)
                to += (place[j], place[i])
                room += (w, w)
    excess = [u[i] for i in left]
    while True:
        sources = [v for v, x in enumerate(excess) if x > TINY]
        level, layer, found = [-1] * len(left), sources, False
        for v in sources:
            level[v] = 0
        while layer and not found:
            after = []
            for v in layer:
                for e in arcs[v]:
                    k = to[e]
                    if level[k] < 0 and room[e] > TINY:
                        level[k] = level[v] + 1
                        found = found or excess[k] < -TINY
                        after.append(k)
            layer = after
        if not found:
            break
        turn = [0] * len(left)                   # the next arc of a node to try
        for v in sources:
            walk, x = [], v
            while excess[v] > TINY:
                if excess[x] < -TINY:
                    c = min(excess[v], -excess[x], *(room[e] for e in walk))
                    for e in walk:
                        room[e] -= c
                        room[e ^ 1] += c
                    excess[v] -= c
                    excess[x] += c
                    walk, x = [], v
                elif turn[x] < len(arcs[x]):
                    e = arcs[x][turn[x]]
                    if room[e] > TINY and level[to[e]] == level[x] + 1:
                        walk.append(e)
                        x = to[e]
                    else:
                        turn[x] += 1
                elif walk:                       # a dead end
                    x = to[walk.pop() ^ 1]
                    turn[x] += 1
                else:
                    break
    for i, reached in zip(left, level):
        side[i] = reached >= 0
    return [bool(x) for x in side]


def label(own: list[Block], weights: np.ndarray) -> list[bool]:
    """Content or not, for every block of a page."""
    if not own:
        return []
    score = np.clip(text_features(own) @ weights, -CLASSIFIER, CLASSIFIER)
    return minimum_cut([float(v) + b.evidence for v, b in zip(score, own)], edges(own))


def train(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES,
          sample_chars: int = SAMPLE_CHARS) -> np.ndarray:
    """Weights of the text classifier, from at most ``sample_pages`` pages of at most ``sample_chars`` characters (the
    first ones found: no other partition is read)."""
    src = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).filter(F.length("html") <= sample_chars)
    x, y = [], []
    for r in src.limit(sample_pages).collect():
        own = blocks(r["html"])
        for row, k in zip(text_features(own), own):
            if abs(k.evidence) >= EVIDENCE:
                x.append(row)
                y.append(k.evidence > 0)
    y = np.array(y, float)
    if not len(y) or y.min() == y.max():
        return DEFAULT
    return fit(np.array(x), y)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple = ("url",),
            sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per row of ``pages``: id, the ``keep`` columns, text, n_chars, n_blocks, n_content. No shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, html_col, sample_pages))
    src = pages.select(*[F.col(f"`{c}`") for c in (id_col, *keep)], F.col(f"`{html_col}`").cast("string").alias("_html"))
    first = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        weights = shared.value
        for whole in batches:
            for b in slices(whole, "_html"):
                text, n, m = [], [], []
                for p in b.column("_html").to_pylist():
                    own = blocks(p or "")
                    got = [k.text for k, good in zip(own, label(own, weights)) if good]
                    text.append(" ".join(got))
                    n.append(len(own))
                    m.append(len(got))
                text = pa.array(text, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], text, pc.utf8_length(text).cast(pa.int64()), pa.array(n, pa.int64()),
                     pa.array(m, pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars", "n_blocks", "n_content"])

    return src.mapInArrow(run, f"{first}, text string, n_chars long, n_blocks long, n_content long")
