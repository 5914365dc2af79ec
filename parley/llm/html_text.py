"""Main text of web pages by a linear-chain conditional random field.

A page is read into its leaf blocks: runs of text that no block-level tag
interrupts. A block is described by the tags and class words above it and by
its text; a chain over the blocks of a page, trained on labelled pages, decides
which belong to the article, and Viterbi decoding picks the best sequence.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import extended

# Elements of HTML by the way they are read.
UNREAD = {"script", "style", "noscript", "template", "svg", "head", "iframe", "textarea", "title", "math", "object"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
#: Elements that end when the next one of their kind begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements that a paragraph can't hold, so that they end it.
HOLDERS = {"li", "td", "th", "dd", "div", "section", "article", "aside", "main", "body", "blockquote", "form", "header", "footer", "nav", "figure"}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Block:
    """A leaf block: its text, the tags above it, their class words, and how much of the text is links."""

    text: str
    tags: tuple[str, ...]
    words: frozenset[str]
    linked: int


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order.

    Character references are decoded, white space inside a block becomes one
    space and ends are trimmed; blocks without text are left out, as is all
    that no reader sees. Tags that are never closed end with what holds them.
    """
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            tags = tuple(t for t, _ in stack if t not in INLINE)
            found.append(Block(text, tags, frozenset().union(*(w for _, w in stack)), linked))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if stack and any(t == "a" for t, _ in stack):
            linked += len(text)

    def close(name: str) -> None:
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] == name:
                del stack[n:]
                return

    at, size = 0, len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                flush()
            close(name)
        elif name in UNREAD:
            if name not in ("svg", "math"):
                flush()
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                if name != "head":
                    at = end.end() if end else size
                else:
                    body = re.compile(r"</head\b[^>]*>?|(?=<body\b)", re.I).search(page, at)
                    at = body.end() if body else at
        elif name in ("br", "wbr", "img", "input"):
            parts.append(" " if name != "wbr" else "")
        else:
            if name not in INLINE:
                flush()
                if stack and any(t == "p" for t, _ in stack):
                    inner = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] in HOLDERS), -1)
                    if any(t == "p" for t, _ in stack[inner + 1 :]):
                        close("p")
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] in ENDED_BY.get(name, ()):
                        del stack[n:]
                        break
                    if stack[n][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            if name not in EMPTY:
                words = {w for g in NAMED.findall(m[3]) for w in WORD.findall("".join(g[1:]).lower())} if m[3] else ()
                stack.append((name, frozenset(words)))
    flush()
    return found


def features(page: list[Block]) -> list[tuple[str, ...]]:
    """What the chain knows of every block of a page."""
    out = []
    n = len(page)
    for k, b in enumerate(page):
        size = len(b.text)
        named = [f"above={t}" for t in set(b.tags)] + [f"word={w}" for w in b.words]
        named += [
            f"tag={b.tags[-1] if b.tags else ''}",
            f"size={min(size, 1023).bit_length()}",
            f"links={4 * b.linked // max(size, 1)}",
            f"spaces={min(b.text.count(' '), 63).bit_length()}",
            f"end={b.text[-1] if not b.text[-1].isalnum() else 'a'}",
            f"begin={b.text[0] if not b.text[0].isalnum() else 'a'}",
            f"place={0 if k == 0 else 2 if k == n - 1 else 1}",
            "bias",
        ]
        out.append(tuple(sorted(named)))
    return out


@dataclass
class Chain:
    """Weights of a two-label chain: other (0) and article (1)."""

    weights: dict[str, tuple[float, float]]
    steps: list[list[float]]

    def scores(self, named: tuple[str, ...]) -> tuple[float, float]:
        a = b = 0.0
        for f in named:
            w = self.weights.get(f)
            if w:
                a += w[0]
                b += w[1]
        return a, b

    def decode(self, page: list[tuple[str, ...]], memory: dict | None = None) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi); ties go to other."""
        if not page:
            return []
        memory = {} if memory is None else memory
        (aa, ab), (ba, bb) = self.steps
        back: list[tuple[int, int]] = []
        x = y = 0.0
        for k, named in enumerate(page):
            s = memory.get(named)
            if s is None:
                if len(memory) > 200_000:
                    memory.clear()
                s = memory[named] = self.scores(named)
            if k == 0:
                x, y = s
                continue
            from_x, from_y = int(y + ba > x + aa), int(y + bb > x + ab)
            back.append((from_x, from_y))
            x, y = max(x + aa, y + ba) + s[0], max(x + ab, y + bb) + s[1]
        label = int(y > x)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 12, rate: float = 0.2, decay: float = 1e-4) -> Chain:
    """Fit a chain to labelled pages: gradient steps on the log-likelihood, page by page.

    Expected counts come from the forward and backward sums of the chain. The
    order of the pages is fixed, so the same pages give the same chain.
    """
    index = {f: n for n, f in enumerate(sorted({f for page, _ in pages for named in page for f in named}))}
    w = np.zeros((len(index), 2))
    steps = np.zeros((2, 2))
    coded = [([np.array([index[f] for f in named]) for named in page], np.array(labels)) for page, labels in pages if page]
    for r in range(rounds):
        step = rate / (1 + r)
        for page, labels in coded:
            n = len(page)
            local = np.array([w[f].sum(axis=0) for f in page])
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = local[0]
            for k in range(1, n):
                forward[k] = np.logaddexp.reduce(forward[k - 1][:, None] + steps, axis=0) + local[k]
            for k in range(n - 2, -1, -1):
                backward[k] = np.logaddexp.reduce(steps + (local[k + 1] + backward[k + 1])[None, :], axis=1)
            whole = np.logaddexp.reduce(forward[-1])
            wanted = np.eye(2)[labels]
            missing = wanted - np.exp(forward + backward - whole)
            for f, m in zip(page, missing):
                w[f] += step * (m - decay * w[f])
            for k in range(1, n):
                pair = np.exp(forward[k - 1][:, None] + steps + (local[k] + backward[k])[None, :] - whole)
                steps += step * (np.outer(wanted[k - 1], wanted[k]) - pair) / n
    return Chain({f: (float(w[n, 0]), float(w[n, 1])) for f, n in index.items()}, steps.tolist())


# Labels of the sample: what the page's own sectioning says, which a page need not
# have for the chain to read it.
ARTICLE = {"article", "main"}
OTHER = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "fieldset"}
OTHER_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "contentinfo", "cookie", "cookies",
    "footer", "form", "menu", "nav", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "search", "share",
    "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Pages whose parts are known, for kinds of parts that a sample may lack. A + marks a block of the article.
TAUGHT = [
    "<header><div>The Daily Example</div><p>News since 1901</p></header><nav><ul><li><a href=x>Home</a><li><a href=x>World</a></ul></nav>"
    "<div class=content><h1>+A bridge opens</h1><p>+The bridge over the river opened on Monday after two years of work.</p><p>+Traffic was light, said the mayor, who walked across first.</p></div>"
    "<div class=comments><p>Great bridge, I like it.</p><p>Too expensive for a town like this one.</p></div><footer><p>All rights reserved</p></footer>",
    "<div class='cookie notice'>We use cookies to improve this site. <a href=x>Accept</a></div><div id=menu><a href=x>Start</a> <a href=x>About</a></div>"
    "<div class=post><h2>+How to bake bread</h2><p>+Mix flour, water, salt and yeast, and let the dough rest for a night.</p><ul><li>+Flour, 500 g</li><li>+Water, 350 g</li></ul><blockquote>+Patience is the best ingredient.</blockquote></div>"
    "<form><label>Your e-mail</label><input><button>Subscribe</button></form><aside><h3>Related</h3><ul><li><a href=x>Cakes</a></li></ul></aside>",
    "<div class=banner>Advertisement: cheap shoes, today only!</div><main><section><h1>+Notes on rivers</h1><p>+Rivers carry more than water.</p><div class=ad>Buy now and save a lot of money.</div><p>+They carry sand, stories and ships.</p></section></main>"
    "<section class=comments><h3>Comments</h3><div>Anna: I was there last summer, it was lovely.</div></section><div class=sidebar><p>Most read stories of the week</p></div>",
    "<table><tr><td><a href=x>One</a></td><td><a href=x>Two</a></td></tr></table><div><p>+A page without any names for its parts still has its text, which is long and has full sentences.</p><p>+The second paragraph goes on for a while, with commas, and ends with a full stop.</p></div><div><a href=x>Imprint</a> <a href=x>Contact</a></div>",
]


def taught_labels(page: list[Block]) -> list[int] | None:
    """Labels that a page's sectioning elements give, None for a page without an article."""
    if not any(ARTICLE & set(b.tags) for b in page):
        return None
    return [
        int(
            bool(ARTICLE & set(b.tags))
            and not (OTHER & set(b.tags) or OTHER_WORDS & b.words)
            and not ("header" in b.tags and b.tags[-1] not in ("h1", "h2"))
        )
        for b in page
    ]


def labelled_pages(sample: list[str]) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """Training pages: those of the sample with an article, once as they are and once
    without the sectioning above their blocks, and the taught ones."""
    out = []
    for page in sample:
        found = blocks(page or "")
        labels = taught_labels(found)
        if labels:
            named = features(found)
            out.append((named, labels))
            hidden = {f"above={t}" for t in ARTICLE} | {f"tag={t}" for t in ARTICLE}
            out.append(([tuple(f for f in block if f not in hidden) for block in named], labels))
    for page in TAUGHT:
        found = blocks(page)
        labels = [int(b.text.startswith("+")) for b in found]
        plain = [Block(b.text.lstrip("+"), b.tags, b.words, b.linked) for b in found]
        out += [(features(plain), labels)] * 8
    return out


def fit(pages: DataFrame, key: str = "page_id", page: str = "html", max_pages: int = 200) -> Chain:
    """Train the chain on at most ``max_pages`` pages, those of the smallest hashed keys.

    The bound keeps the sample on the driver small whatever the table's size.
    Very long pages say no more than others and are passed over for training
    (they are extracted like all others).
    """
    hashed = pages.filter(F.length(page).between(1, 200_000)).select(F.xxhash64(key).alias("h"), page)
    chosen = [r["h"] for r in hashed.select("h").orderBy("h").limit(max_pages).collect()]
    sample = hashed.filter(F.col("h").isin(chosen)).orderBy("h", page).limit(max_pages).collect()
    return train(labelled_pages([r[page] for r in sample]))


def extract(pages: DataFrame, chain: Chain, page: str = "html") -> DataFrame:
    """Add ``text``, the article's blocks in page order with a blank line between, and ``n_chars``.

    A NULL or empty page, and one without an article, gives the empty text.
    Whole pages are read. Columns of these names are replaced, others kept; no
    shuffle, one batch in memory at a time.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    pages = pages.select(*keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict = {}
        for pdf in frames:
            texts = []
            for value in pdf[page]:
                found = blocks(value) if isinstance(value, str) else []
                labels = chain.decode(features(found), memory)
                texts.append("\n\n".join(b.text for b, label in zip(found, labels) if label))
            pdf["text"] = texts
            pdf["n_chars"] = [len(t) for t in texts]
            yield pdf

    return pages.mapInPandas(run, extended(pages, "text string, n_chars long"))
