"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into its leaf blocks of text. Each block is described by the tags, class
and id words of its ancestors and by its text; neighbours influence each other by
learned transitions. The field is trained on labelled pages (:func:`labelled_pages`,
layouts of many kinds) and decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import whole_text
from assayer.llm.language import forward_backward

# never shown as text of the page
_HIDDEN = frozenset("script style template noscript textarea title svg iframe select".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
# a formula is part of its sentence
_INLINE |= frozenset("math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of their own name, unless a list or table stands between.
_ITEMS = frozenset("li td th tr dt dd option".split())
_HOLDERS = ("ul", "ol", "table", "dl", "select")
_OPENING = re.compile(r"<(/?)([a-z][^\s/>]*+)([^>\"']*+)", re.I)
_START = re.compile(r"<(?=[a-z/!?])", re.I)
_CLOSERS = re.compile(r"[>\"']")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _HIDDEN}
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
#: Weights are added up in whole numbers of this part, so that what is taken away leaves nothing behind.
_UNIT = 1 << 40


@dataclass
class Block:
    """A leaf block: its text, the characters of it in links, and of its ancestors either all
    features or, where weights are given, what they add up to."""

    text: str
    linked: int = 0
    above: frozenset[str] = frozenset()
    gain: int = 0
    label: int = 0


class _Path:
    """Open elements. Features of the path and their weight are kept as elements come and go, so that
    neither a block nor an end tag has to look at the whole path."""

    def __init__(self, weights: dict[str, int] | None):
        self.weights = weights
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.counts: dict[str, int] = {}
        self.marked: list[int] = []
        self.gain = 0

    def _features(self, name: str, marks: tuple[str, ...]) -> list[str]:
        return [f"<{name}", *(f".{mark}" for mark in marks)]

    def enter(self, name: str, marks: tuple[str, ...]) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        if name not in _INLINE or marks:
            self.marked.append(len(self.open))
            for f in self._features(name, marks):
                n = self.counts.get(f, 0)
                self.counts[f] = n + 1
                if not n and self.weights:
                    self.gain += self.weights.get(f, 0)
        self.open.append((name, marks))

    def _drop(self) -> None:
        name, marks = self.open.pop()
        self.places[name].pop()
        if self.marked and self.marked[-1] == len(self.open):
            self.marked.pop()
            for f in self._features(name, marks):
                self.counts[f] -= 1
                if not self.counts[f]:
                    del self.counts[f]
                    if self.weights:
                        self.gain -= self.weights.get(f, 0)

    def leave(self, name: str, above: int = -1) -> None:
        """Close the innermost element of that name, and all within, if it is open above a place."""
        places = self.places.get(name)
        if places and places[-1] > above:
            for _ in range(len(self.open) - places[-1]):
                self._drop()

    def holder(self) -> int:
        """Place of the innermost list or table, or -1."""
        return max((self.places[h][-1] for h in _HOLDERS if self.places.get(h)), default=-1)

    def of_place(self) -> list[str]:
        """Features of where the path ends."""
        out = [f"leaf<{self.open[self.marked[-1]][0]}"] if self.marked else []
        if not self.counts.get("<article") and not self.counts.get("<main"):
            out.append("loose")
        return out


def _tag_end(page: str, at: int, lone: set[str]) -> int:
    """Place of the ``>`` that ends a tag, past quoted values, or -1. ``lone`` gathers quotes that have no partner further on."""
    while found := _CLOSERS.search(page, at):
        mark, at = found[0], found.end()
        if mark == ">":
            return found.start()
        if mark not in lone:
            partner = page.find(mark, at)
            if partner < 0:
                lone.add(mark)
            else:
                at = partner + 1
    return -1


def blocks_of(page: str, weights: dict[str, int] | None = None) -> list[Block]:
    """Leaf blocks in page order: character references decoded, white space single, no empty ones.

    The page is read once. A tag that no ``>`` ends, quotes left aside or not, and all after it, is text.
    """
    out: list[Block] = []
    path, held, linked, in_link = _Path(weights), [], 0, 0
    lone: set[str] = set()
    quotes = True
    at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                block = Block(text, linked)
                if weights is None:
                    block.above = frozenset([*path.counts, *path.of_place()])
                else:
                    block.gain = path.gain + sum(weights.get(f, 0) for f in path.of_place())
                out.append(block)
            held.clear()
        linked = 0

    while found := _START.search(page, at):
        start = found.start()
        tag = _OPENING.match(page, start)
        name = ""
        if tag:
            stop = tag.end()
            if page[stop : stop + 1] != ">":
                stop = _tag_end(page, stop, lone) if quotes else -1
                if stop < 0:  # every later quote opens what nothing closes
                    quotes = False
                    stop = page.find(">", tag.end())
            if stop < 0:
                break
            ends, name, rest = tag[1], tag[2].lower(), page[tag.start(3) : stop]
            after = stop + 1
            if name in ("svg", "math") and not ends and rest.endswith("/"):
                name = ""  # closes itself, so it is empty
            elif name in _HIDDEN and not ends:
                closing = _ENDS[name].search(page, after)
                after, name = closing.end() if closing else len(page), ""
        elif page.startswith("<!--", start):
            after = page.find("-->", start + 4)
            after = len(page) if after < 0 else after + 3
        else:
            after = page.find(">", start + 2) + 1
            if not after:
                break
        if start > at:
            held.append(page[at:start])
            linked += start - at if in_link else 0
        at = after
        if not name:
            continue
        if name not in _INLINE:
            flush()
            in_link = 0
        elif name == "br":
            held.append(" ")
        elif name == "a":
            in_link = 0 if ends else 1
        if ends:
            path.leave(name)
        elif name not in _VOID:
            if name not in _INLINE:
                path.leave("p")
                if name in _ITEMS:
                    path.leave(name, above=path.holder())
            marks = tuple(w for m in _NAMED.findall(rest) for w in _PART.findall("".join(m).lower())) if "=" in rest else ()
            path.enter(name, marks)
    held.append(page[at:])
    flush()
    return out


def text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    found = [
        f"words{min(6, words.bit_length())}",
        f"links{min(3, 3 * block.linked // max(1, len(text)))}",
        "sentence" if text[-1] in ".!?…:\"»”" else "open",
    ]
    if "\N{COPYRIGHT SIGN}" in text or "copyright" in text.lower():
        found.append("rights")
    return found


def block_features(block: Block) -> list[str]:
    return sorted({*block.above, *text_features(block)})


_LAYOUTS = {
    "menu": [("nav", ""), ("div", "menu"), ("ul", "navigation"), ("div", "navbar"), ("div", "nav-links"), ("div", "breadcrumb"), ("div", "topnav")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site-header"), ("div", "topbar"), ("header", "page-head")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "copyright"), ("div", "bottom-bar"), ("footer", "foot")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related-posts"), ("section", "related"), ("div", "recommended"), ("div", "side"), ("div", "tags"), ("div", "author-bio"), ("div", "pagination")],
    "notice": [("div", "cookie-notice"), ("div", "consent"), ("div", "banner"), ("div", "notice"), ("div", "alert"), ("div", "popup modal"), ("div", "newsletter subscribe")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("aside", "ad-slot"), ("ins", "adsbygoogle")],
    "form": [("form", ""), ("form", "search"), ("div", "login-form"), ("form", "contact")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "reader-comments"), ("div", "discussion replies"), ("div", "disqus"), ("div", "reply")],
    "share": [("div", "share"), ("ul", "social"), ("div", "share-buttons")],
}
_CONTENT = [("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article-body"), ("div", "entry-content"), ("div", "post-body"), ("section", "story"), ("div", "main"), ("div", "text")]


def labelled_pages(
    n: int = 500, seed: int = 11, layouts: dict[str, list[tuple[str, str]]] = _LAYOUTS, contents: list[tuple[str, str]] = _CONTENT
) -> list[list[Block]]:
    """Pages of many layouts, as their blocks with label 1 for main text.

    Main text is marked while a page is made and found again after parsing, so training sees
    what extraction sees.
    """
    rng = random.Random(seed)
    syllables = [c + v + e for c in "bdfglmnprstvk" for v in "aeiou" for e in ("", "n", "r", "s")]

    def words(lo: int, hi: int, end: str = ".") -> str:
        made = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(lo, hi))]
        return " ".join(made).capitalize() + end

    def tag(kind: tuple[str, str], body: str) -> str:
        name, mark = kind
        attribute = f' {rng.choice(("class", "class", "id"))}="{mark}"' if mark else ""
        return f"<{name}{attribute}>{body}</{name}>"

    def rubbish(kind: str) -> str:
        many = rng.randint(1, 6)
        link = lambda: f'<a href="/x">{words(1, 4, "")}</a>'
        if kind in ("menu", "share"):
            body = "".join(f"<li>{link()}</li>" for _ in range(many))
            body = f"<ul>{body}</ul>" if rng.random() < 0.7 else "".join(link() + " " for _ in range(many))
        elif kind == "form":
            body = f"<label>{words(1, 4, ':')}</label><input><button>{words(1, 2, '')}</button><p>{words(2, 12)}</p>"
        elif kind == "footer":
            body = rng.choice(["&copy; 2024 ", "Copyright ", "", "\N{COPYRIGHT SIGN} site &middot; "]) + words(2, 14) + rng.choice(["", f"<p>{words(2, 20)}</p>", link()])
        elif kind == "comments":
            body = "".join(rng.choice([f"<p>{words(3, 60)}</p>", f"<li><b>{words(1, 2, '')}</b> {words(3, 50)}</li>", f'<div class="comment">{words(3, 60)}</div>']) for _ in range(many))
        elif kind in ("side", "header"):
            body = rng.choice([f"<h3>{words(1, 5, '')}</h3>", f"<h1>{words(1, 3, '')}</h1>", ""]) + "".join(rng.choice([f"<p>{words(2, 30)}</p>", f"<p>{link()}</p>", f"<li>{link()}</li>"]) for _ in range(many))
        else:
            body = rng.choice([words(2, 30), f"<p>{words(2, 40)}</p>", f"<p>{words(3, 12)}</p>{link()}", link()])
        return tag(rng.choice(layouts[kind]), body)

    def content() -> str:
        parts = [f"<h1>@@{words(2, 12, '')}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            text = "@@" + words(1, rng.choice((3, 12, 60, 150)), rng.choice((".", ".", ".", "", "?", " |")))
            if rng.random() < 0.15:
                text += f' <a href="/y">{words(1, 3, "")}</a> ' + words(1, 20)
            shape = rng.random()
            name = "p" if shape < 0.75 else rng.choice(("h2", "h3", "li", "blockquote", "pre", "td", "figcaption", "div"))
            parts.append(f"<p>{text}<br>" if shape < 0.06 else f"<{name}>{text}</{name}>")
            if rng.random() < 0.06:
                parts.append(rubbish(rng.choice(("advert", "share", "side", "notice", "form"))))
        if rng.random() < 0.12:
            parts.append(rubbish("comments"))
        return tag(rng.choice(contents), "".join(parts))

    pages = []
    for _ in range(n):
        above = [rubbish(k) for k in ("header", "menu", "notice", "advert", "side", "form") if rng.random() < 0.45]
        below = [rubbish(k) for k in ("comments", "side", "share", "form", "advert", "menu", "notice", "footer") if rng.random() < 0.4]
        rng.shuffle(above)
        body = "".join(above) + content() + "".join(below)
        if rng.random() < 0.3:
            body = tag(("div", rng.choice(("wrapper", "page", "container", ""))), body)
        blocks = blocks_of(f"<html><head><title>x</title></head><body>{body}</body></html>")
        for block in blocks:
            block.label = int("@@" in block.text)
            block.text = block.text.replace("@@", "")
        pages.append([b for b in blocks if b.text])
    return pages


@dataclass(frozen=True)
class Field:
    """What a feature adds for main text, and transition weights (from, to)."""

    weights: dict[str, float]
    transitions: tuple[tuple[float, float], tuple[float, float]]

    def whole(self) -> dict[str, int]:
        """Weights in whole numbers, as :func:`blocks_of` adds them up."""
        return {f: round(w * _UNIT) for f, w in self.weights.items()}

    def decode(self, gains: list[float]) -> list[int]:
        """The likeliest labels together, by Viterbi's algorithm, from what each block adds for main text."""
        (from0, from1) = self.transitions
        rest, main = 0.0, 0.0
        back: list[tuple[int, int]] = []
        for i, gain in enumerate(gains):
            if i:
                to0, to1 = (rest + from0[0], main + from1[0]), (rest + from0[1], main + from1[1])
                back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
                rest, main = max(to0), max(to1)
            main += gain
        label = int(main > rest)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1] if gains else []

    def label(self, blocks: list[Block], weights: dict[str, int]) -> list[int]:
        """Labels of blocks read with these weights."""
        return self.decode([(b.gain + sum(weights.get(f, 0) for f in text_features(b))) / _UNIT for b in blocks])


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field of the generated pages."""
    return fit(labelled_pages())


def fit(labelled: list[list[Block]], steps: int = 80, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """Maximises the likelihood of labelled pages, whoever has labelled them."""
    pages = sorted((p for p in labelled if p), key=lambda p: -len(p))
    lengths = np.array([len(p) for p in pages])
    found = [block_features(b) for p in pages for b in p]
    names = sorted({f for x in found for f in x})
    index = {f: i for i, f in enumerate(names)}
    flat = np.array([index[f] for x in found for f in x])
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    truth = np.array([b.label for p in pages for b in p])
    last = np.zeros(len(truth), bool)
    last[np.cumsum(lengths) - 1] = True
    at = np.flatnonzero(~last)
    gold = np.bincount(truth[at] * 2 + truth[at + 1], minlength=4).reshape(2, 2)
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    square_w, square_t = np.full_like(w, 1e-12), np.full_like(t, 1e-12)
    for _ in range(steps):
        gain = np.bincount(owner, weights=w[flat], minlength=len(found))
        joint = np.zeros((2, 2))
        marginal = forward_backward(np.stack([np.zeros_like(gain), gain], axis=1), lengths, np.exp(t), joint)
        g = np.bincount(flat, weights=(truth - marginal[:, 1])[owner], minlength=len(names)) / len(truth) - ridge * w
        gt = (gold - joint) / len(truth) - ridge * t
        square_w += g**2
        square_t += gt**2
        w += rate * g / np.sqrt(square_w)
        t += rate * gt / np.sqrt(square_t)
    return Field(dict(zip(names, w.tolist(), strict=True)), tuple(map(tuple, t.tolist())))


def main_text(page: str, field: Field, weights: dict[str, int] | None = None) -> str:
    weights = field.whole() if weights is None else weights
    blocks = blocks_of(page, weights)
    return "\n\n".join(b.text for b, label in zip(blocks, field.label(blocks, weights), strict=True) if label)


def extracted(page: Column, field: Field | None = None) -> Column:
    """Main text of whole pages; empty for a NULL page or one without main text."""
    field = field or trained()

    def extract(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = field.whole()
        for pages in series:
            yield pd.Series([main_text(page, field, weights) for page in pages], dtype=object)

    extract.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(extract, "string")(page)


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    A NULL page counts as empty and has an empty text; a NULL id or url stays. Other columns are ignored, repeated
    rows stay, and an empty table gives an empty one. Time and memory follow a page's length, whatever it holds.
    """
    found = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), extracted(whole_text(page)).alias("text")
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))
