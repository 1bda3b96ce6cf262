"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into leaf blocks: runs of text between block-level tags, with references decoded and white space made single spaces.
A block's features are its ancestors' tags, the words of their class and id, and properties of its text
(length, closing punctuation, share of linked text). The field is trained on the labelled pages that ``training_pages``
makes from seeded layouts (with their labels), by gradient ascent of the penalised likelihood, and Viterbi decoding
says which blocks are main text. Training takes a second or two on the driver; its size does not depend on the input.

``<br>`` is white space inside its block. Scripts, styles, comments, templates, titles and form controls are no
text. Tags that are left open end with their parent; stray end tags are ignored. Null and empty pages, and pages
without main text, give the empty string. Pages are read whole, whatever their length, in one pass whose time is linear in it:
open elements are counted and placed by tag, so no tag searches the open ones, and an element's path is a link to its parent with
the path's score beside it. Equal scores of a block are decided for "not main text". Rows are read one by one, so repeated rows are
no matter; only page_id, url and html are read, other columns may have any name.
"""

from __future__ import annotations

import html as html_module
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import prepare

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title svg math iframe select object canvas".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?![^\s/>])", re.I) for tag in RAW_TAGS}
#: Of these, the ones that hold text only and last to the page's end without an end tag; the others are then left open like any element.
TEXT_TAGS = frozenset("script style textarea title iframe".split())
#: A start tag of the key ends an open element of the values (of the same list or row).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCK_TAGS - {"body", "html", "head", "option", "optgroup"}
_LIMITS = frozenset("ul ol menu table dl select div section article aside main nav body".split())
_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An open element: its tag, its parent, and those of its features that no ancestor has."""

    __slots__ = ("block", "inline", "new", "own", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, own: tuple[str, ...], new: list[str]):
        self.tag, self.parent, self.own, self.new = tag, parent, own, new
        #: The nearest block-level element, this one or above; open inline elements by tag, of block-level ones.
        self.block: Node = self if parent is None or tag in BLOCK_TAGS else parent.block
        self.inline: dict[str, int] | None = None
        self.score: float | None = None


@dataclass
class Block:
    text: str
    node: Node
    tag: str
    linked: float

    @property
    def path(self) -> tuple[str, ...]:
        """Features of the ancestors, outermost first."""
        out, node = [], self.node
        while node is not None:
            out.append(node.own)
            node = node.parent
        return tuple(f for own in reversed(out) for f in own)


class _Stack:
    """The open elements, with the places of each tag, of elements that limit others, and counts of features."""

    def __init__(self) -> None:
        self.nodes = [Node("", None, (), [])]
        self.at: dict[str, list[int]] = {}
        self.limits: list[int] = []
        self.features: dict[str, int] = {}

    def push(self, tag: str, own: tuple[str, ...]) -> None:
        new, count = [], self.features
        for f in own:
            n = count[f] = count.get(f, 0) + 1
            if n == 1:
                new.append(f)
        node, k = Node(tag, self.nodes[-1], own, new), len(self.nodes)
        places = self.at.get(tag)
        if places is None:
            places = self.at[tag] = []
        places.append(k)
        if tag in _LIMITS:
            self.limits.append(k)
        block = node.block
        if block is not node:
            if block.inline is None:
                block.inline = {}
            block.inline[tag] = block.inline.get(tag, 0) + 1
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Closes the elements from place k on."""
        while len(self.nodes) > k:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if self.limits and self.limits[-1] == len(self.nodes):
                self.limits.pop()
            if node.block is not node:
                node.block.inline[node.tag] -= 1
            for f in node.own:
                self.features[f] -= 1

    def last(self, *tags: str) -> int:
        """Place of the last open element of the tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def limit(self) -> int:
        return self.limits[-1] if self.limits else 0

    def ended(self, tag: str) -> None:
        """An end tag; an inline one does not end a block, and one without a start is ignored."""
        if tag in BLOCK_TAGS or (self.nodes[-1].block.inline or {}).get(tag, 0) > 0:
            if k := self.last(tag):
                self.cut(k)

    def started(self, tag: str) -> None:
        """What the start of a block-level element ends."""
        if tag in _ENDS_P and (k := self.last("p")) and self.limit() < k:
            self.cut(k)
        ends = CLOSES.get(tag)
        while ends and (k := self.last(*ends)):
            if max(self.limit(), self.last("tr") if tag in ("td", "th") else 0) > k:
                return
            self.cut(k)
            if tag != "tr" or self.nodes[-1].tag != "tr":
                return


def _described(tag: str, attributes: str) -> tuple[str, ...]:
    """Features of a tag; those of short attributes are remembered."""
    return _remembered(tag, attributes) if len(attributes) <= 512 else _features_of(tag, attributes)


def _features_of(tag: str, attributes: str) -> tuple[str, ...]:
    if not attributes.strip():
        return (f"a:{tag}",)
    words = [w.lower() for m in _NAMES.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")]
    return (f"a:{tag}", *[f"c:{w}" for w in words])


_remembered = lru_cache(maxsize=20_000)(_features_of)


class _Reader:
    """Finds the tags of a page in one pass: no search runs twice over the same text."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.quoted = True
        self.unclosed: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose name ends at ``at``; -1 if there is none.

        Quotes hide it; a quote without a partner is a character like others, and so are all quotes once one hid the
        rest of the page.
        """
        if self.last[">"] < at:
            return -1
        k = at
        while self.quoted:
            m = _TAG_STOP.search(self.page, k)
            if m is None:
                self.quoted = False
                break
            c = m[0]
            if c == ">":
                return m.start()
            k = self.page.find(c, m.end()) + 1 if self.last[c] > m.start() else m.end()
        return self.page.find(">", at)

    def raw_end(self, tag: str, at: int) -> int:
        """Place behind the end tag of a raw element; -1 if there is none, which is then not looked for again."""
        close = None if tag in self.unclosed else _RAW_END[tag].search(self.page, at)
        if close is None:
            self.unclosed.add(tag)
            return -1
        return self.past(">", close.end())

    def past(self, what: str, at: int) -> int:
        k = self.page.find(what, at)
        return len(self.page) if k < 0 else k + len(what)


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a whole page in order."""
    out: list[Block] = []
    if not page:
        return out
    stack, reader = _Stack(), _Reader(page)
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html_module.unescape(raw) if "&" in raw else raw).split())
            if text:
                node = stack.nodes[-1]
                out.append(Block(text, node, node.block.tag, linked / max(1, len(raw))))
            parts.clear()
            linked = 0

    def keep(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if any(x.tag == "a" for x in stack.nodes[-3:]):
                linked += len(text)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            keep(page[at:])
            break
        keep(page[at:lt])
        if page.startswith("<!--", lt):
            at = reader.past("-->", lt + 4)
            continue
        if page[lt + 1 : lt + 2] in ("!", "?") and reader.last[">"] > lt:
            at = reader.past(">", lt)
            continue
        m = _TAG.match(page, lt + 1) if reader.last[">"] > lt else None
        end = reader.tag_end(m.end()) if m else -1
        if end < 0:
            keep("<")
            at = lt + 1
            continue
        at = end + 1
        tag, attributes = m[1].lower(), page[m.end() : end]
        if page[lt + 1] == "/":
            if tag in BLOCK_TAGS:
                flush()
            stack.ended(tag)
        elif tag in RAW_TAGS:
            if not attributes.endswith("/"):
                end = reader.raw_end(tag, at)
                at = end if end >= 0 else n if tag in TEXT_TAGS else at
        elif tag == "br":
            parts.append(" ")
        else:
            if tag in BLOCK_TAGS:
                flush()
                stack.started(tag)
            if tag not in VOID_TAGS and not (attributes.endswith("/") and tag not in BLOCK_TAGS):
                stack.push(tag, _described(tag, attributes))
    flush()
    return out


def text_traits(b: Block) -> tuple[str, int, bool, int]:
    n = len(b.text)
    length = 0 if n < 20 else 1 if n < 60 else 2 if n < 150 else 3 if n < 400 else 4
    return b.tag, length, b.text[-1] in ".!?:;…»”\"'", 0 if b.linked < 0.05 else 1 if b.linked < 0.5 else 2


def text_features(b: Block) -> list[str]:
    tag, length, end, link = text_traits(b)
    return ["bias", f"t:{tag}", f"len:{length}", f"end:{end}", f"link:{link}"]


@dataclass
class Field:
    """Weights of label 1 against 0 by feature; transition scores by (label, next label); start scores."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    start: tuple[float, float] = (0.0, 0.0)
    _traits: dict = field(default_factory=dict, repr=False)

    def path_score(self, node: Node) -> float:
        """Weights of the features of an element and its ancestors, each once; kept at the elements of a page."""
        open_ = []
        while node is not None and node.score is None:
            open_.append(node)
            node = node.parent
        score = 0.0 if node is None else node.score
        for x in reversed(open_):
            score = x.score = score + sum(self.weights.get(f, 0.0) for f in x.new)
        return score

    def emission(self, b: Block) -> float:
        key = text_traits(b)
        own = self._traits.get(key)
        if own is None:  # the tag is a block-level one, so there are few
            own = self._traits[key] = sum(self.weights.get(f, 0.0) for f in text_features(b))
        return self.path_score(b.node) + own

    def viterbi(self, blocks: list[Block]) -> list[int]:
        (m00, m01), (m10, m11) = self.moves
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for k, b in enumerate(blocks):
            e = self.emission(b)
            if k == 0:
                s0, s1 = self.start[0], self.start[1] + e
                continue
            f0, f1 = (0 if s0 + m00 >= s1 + m10 else 1), (0 if s0 + m01 >= s1 + m11 else 1)
            s0, s1 = max(s0 + m00, s1 + m10), max(s0 + m01, s1 + m11) + e
            back.append((f0, f1))
        if not blocks:
            return []
        label = 0 if s0 >= s1 else 1
        out = [label]
        for f in reversed(back):
            label = f[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return "\n".join(b.text for b, y in zip(blocks, self.viterbi(blocks), strict=True) if y)


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = 200, rate: float = 0.15, penalty: float = 0.004) -> Field:
    """Adam on the penalised log likelihood of the labelled pages (forward-backward over all pages at once)."""
    pages = [(b, y) for b, y in pages if b]
    names = sorted({f for blocks, _ in pages for b in blocks for f in {*b.path, *text_features(b)}})
    index = {f: i for i, f in enumerate(names)}
    most = max(len(b) for b, _ in pages)
    x = np.zeros((len(pages), most, len(names)), np.float32)
    y = np.zeros((len(pages), most), int)
    on = np.zeros((len(pages), most), bool)
    for p, (blocks, labels) in enumerate(pages):
        for t, b in enumerate(blocks):
            x[p, t, [index[f] for f in {*b.path, *text_features(b)}]] = 1
            y[p, t], on[p, t] = labels[t], True
    flat = x.reshape(-1, len(names))
    w = np.zeros(len(names) + 6)
    mean, var = np.zeros_like(w), np.zeros_like(w)
    pairs = on[:, 1:]
    seen = np.zeros(6)
    seen[:2] = [(y[:, 0] == k).sum() for k in (0, 1)]
    seen[2:] = [((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for a in (0, 1) for b in (0, 1)]
    for k in range(1, rounds + 1):
        start, moves = w[-6:-4], w[-4:].reshape(2, 2)
        e = np.zeros((len(pages), most, 2))
        e[:, :, 1] = (flat @ w[:-6].astype(np.float32)).reshape(len(pages), most)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = start + e[:, 0]
        for t in range(1, most):
            step = np.logaddexp(a[:, t - 1, 0, None] + moves[0], a[:, t - 1, 1, None] + moves[1]) + e[:, t]
            a[:, t] = np.where(on[:, t, None], step, a[:, t - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        for t in range(most - 2, -1, -1):
            nxt = e[:, t + 1] + b[:, t + 1]
            step = np.logaddexp(nxt[:, 0, None] + moves[:, 0], nxt[:, 1, None] + moves[:, 1])
            b[:, t] = np.where(on[:, t + 1, None], step, 0)
        p1 = np.where(on, np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]), 0)
        both = a[:, :-1, :, None] + moves + (e + b)[:, 1:, None, :] - z[:, None, None, None]
        both = np.where(pairs[:, :, None, None], np.exp(both), 0).sum(axis=(0, 1))
        g = np.concatenate([flat.T @ (y * on - p1).reshape(-1), seen[:2] - [(1 - p1[:, 0]).sum(), p1[:, 0].sum()], seen[2:] - both.ravel()]) / len(pages)
        g -= penalty * w / 10
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        w += rate * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.99**k)) + 1e-8)
    return Field(dict(zip(names, w[:-6].tolist(), strict=True)), tuple(map(tuple, w[-4:].reshape(2, 2).tolist())), tuple(w[-6:-4].tolist()))


# -- labelled pages

_PROSE = "la de the of and en que der und is to for one morning they river stone light over every under house letter nearby quiet paper road".split()
_MAIN = ["article", "main", "div class=content", "div id=content", "div class=post-body", "section class=article-body", "div class=entry-content", "div role=main", "div class='story text'"]
_SIDE = [
    "nav", "header", "footer", "aside", "div class=ad", "div class=ads", "div class='advert banner'", "div class=sidebar", "div id=sidebar", "div class=menu", "ul class=nav", "div class=navbar",
    "div class=cookie-notice", "div class='notice consent'", "div role=dialog", "div class=comments", "section id=comments", "div class=related", "div class='social share'", "div class=breadcrumbs",
    "div class=footer", "div id=header", "div class='site-header'", "form", "form class=search", "div class=newsletter", "div class=promo", "div class=sponsored", "div class=widget", "div class=popup",
    "div role=navigation", "div role=banner", "div role=contentinfo", "aside class=sidebar", "div class=pagination", "div class=copyright", "div class=login", "section class=reader-comments",
    "div class=comment-list", "ol class=commentlist", "div class=alert", "div class=modal", "div class=subscribe", "div class=disclaimer", "div id=cookies", "div class='gdpr banner'", "div class=toolbar",
]


def _sentence(r: random.Random, low: int, high: int, stop: bool = True) -> str:
    words = [r.choice(_PROSE) + r.choice(["", "", "", "s", "ed"]) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + ("." if stop else "")


def _side(r: random.Random, opener: str) -> tuple[str, list[str]]:
    """One boilerplate part and the texts of its blocks."""
    tag = opener.split()[0]
    kind = r.random()
    inner = "form" if tag == "form" else ""
    if inner:
        labels = [_sentence(r, 1, 3, False) for _ in range(r.randint(1, 3))]
        return f"<{opener}>" + "".join(f"<label>{x}</label><input name=q><br>" for x in labels) + f"<button>{_sentence(r, 1, 2, False)}</button></{tag}>", labels
    if "comment" in opener:
        who = [(_sentence(r, 1, 2, False), _sentence(r, 4, 40)) for _ in range(r.randint(1, 5))]
        item = "li" if tag == "ol" else "div class=comment"
        return f"<{opener}>" + "".join(f"<{item}><b>{a}</b><p>{b}</p></{item.split()[0]}>" for a, b in who) + f"</{tag}>", [x for w in who for x in w]
    if kind < 0.45:
        items = [_sentence(r, 1, 3, False) for _ in range(r.randint(2, 8))]
        rows = "".join(f"<li><a href=/{k}>{x}</a></li>" for k, x in enumerate(items))
        return f"<{opener}>{rows if tag == 'ul' else f'<ul>{rows}</ul>'}</{tag}>", items
    if kind < 0.75:
        text = r.choice(["&copy; ", "", "", "Cookies: ", "Advertisement "]) + _sentence(r, 2, 25, r.random() < 0.7)
        return f"<{opener}>{text}</{tag}>", [text]
    texts = [_sentence(r, 2, 30) for _ in range(r.randint(1, 3))]
    return f"<{opener}>" + "".join(f"<p>{x}</p>" for x in texts) + f"</{tag}>", texts


def _main(r: random.Random, sides: list[str]) -> str:
    """Blocks of an article, each marked so that its label can be told after reading."""
    mark = "⁣"
    out = [f"<h1>{mark}{_sentence(r, 2, 10, False)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.randint(1, 9)):
        k = r.random()
        text = mark + _sentence(r, 1, 80 if r.random() < 0.7 else 4)
        if k < 0.7:
            link = f" <a href=/x>{_sentence(r, 1, 2, False)}</a> " if r.random() < 0.15 else ""
            out.append(r.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p><i>{}</i></p>"]).format(text + link))
        elif k < 0.8:
            out.append(f"<h2>{mark}{_sentence(r, 1, 6, False)}</h2>")
        elif k < 0.9:
            out.append("<ul>" + "".join(f"<li>{mark}{_sentence(r, 1, 20, r.random() < 0.6)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif k < 0.95:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        else:
            out.append("<table>" + "".join(f"<tr><td>{mark}{_sentence(r, 1, 4, False)}</td><td>{mark}{r.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>")
        if r.random() < 0.2:
            out.append(_side(r, r.choice(sides))[0])
    return "".join(out)


def training_pages(n: int = 260, seed: int = 5, mains: list[str] = _MAIN, sides: list[str] = _SIDE) -> list[tuple[list[Block], list[int]]]:
    """Pages of seeded layouts with their labels: blocks that carry the invisible mark are main text. ``mains`` and ``sides`` choose the layouts' elements."""
    r, out = random.Random(seed), []
    for _ in range(n):
        before = "".join(_side(r, r.choice(sides))[0] for _ in range(r.randint(0, 4)))
        after = "".join(_side(r, r.choice(sides))[0] for _ in range(r.randint(0, 5)))
        opener = r.choice(mains)
        main = _main(r, sides) if r.random() < 0.97 else ""
        inner_side = _side(r, r.choice([x for x in sides if "comment" in x]))[0] if r.random() < 0.15 else ""
        main = f"<{opener}>{main}{inner_side}</{opener.split()[0]}>"
        if r.random() < 0.3:
            main = r.choice(["<div class=wrapper>{}</div>", "<main>{}</main>", "<div id=page>{}</div>", "<div class=container>{}</div>"]).format(main)
        blocks = leaf_blocks(f"<html><body>{before}{main}{after}</body></html>")
        labels = [int("⁣" in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace("⁣", "")
        out.append((blocks, labels))
    return out


_FIELD: list[Field] = []


def trained() -> Field:
    if not _FIELD:
        _FIELD.append(fit(training_pages()))
    return _FIELD[0]


def main_texts(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text) for every row."""
    prepare(pages.sparkSession)
    model = model or trained()
    plain = (model.weights, model.moves, model.start)
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        f = Field(*plain)
        for b in batches:
            texts = [f.main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
