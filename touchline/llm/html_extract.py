"""Main text of pages by a tree-structured graphical model over their elements and texts.

Each element and text of a page is content or not. Its own signs (name, class and id words, amount of text and links) and
its parent weigh in; sum-product messages go up and down the tree, and a text stays where its marginal probability says
so. The weights are those that make labelled pages likeliest: expected counts come from the same messages. Labelled
pages are laid out from parts whose role is known (`labelled_pages`), or are the caller's own.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, table
from .dom import Tree, parse, shown
from .pieces import groups

SEED, PAGES = 12, 500
STEPS, RATE, SHRINK = 150, 0.1, 1e-3
#: Bytes of pages whose trees share a pass of messages.
CHUNK = 1 << 21
#: Marks a text of a labelled page as content; no part of the text.
MARK = "\x01"

KINDS = ("#text", "block", "inline", "list", "item", "heading", "paragraph", "section", "aside", "form", "table", "page")
# Kinds of elements, for the weights between parent and child.
KIND_OF = {
    name: kind
    for kind, names in {
        "list": "ul ol dl menu", "item": "li dt dd", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "paragraph": "p blockquote pre figure figcaption",
        "section": "article main section", "aside": "aside nav footer header search dialog", "form": "form fieldset button select option textarea label legend",
        "table": "table thead tbody tfoot tr td th caption", "inline": "a abbr b bdi big cite code del em font i ins kbd mark q s small span strong sub sup time u", "page": "#page html body", "#text": "#text",
    }.items()
    for name in names.split()
}
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Bounds of the classes of text lengths and of shares of text in links.
LENGTHS, LINKS = (0, 12, 40, 120, 400, 1500), (0.01, 0.3, 0.7)


@dataclass(frozen=True)
class Model:
    """Weights of a node's signs for content, and of (kind of child, parent's label, child's label)."""

    signs: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray


@dataclass
class Forest:
    """The nodes of several trees that have text, parents before children in each level."""

    parent: np.ndarray
    kind: np.ndarray
    owner: np.ndarray  # of each sign
    sign: np.ndarray
    levels: list[np.ndarray]
    at: list[list[int]]  # for each tree, the nodes' places (-1: no text below)


def signs(tree: Tree) -> tuple[list[list[str]], list[bool]]:
    """Signs of each node, and whether it has text."""
    n = len(tree.parent)
    size, linked, stops = [0] * n, [0] * n, [0] * n
    for leaf, _, text in tree.texts:
        if leaf >= 0:
            size[leaf] = len(text.strip())
            stops[leaf] = text.rstrip().endswith((".", "!", "?", ":", "…", "。", "；"))
    in_link = [False] * n
    for i in range(n):
        in_link[i] = tree.name[i] == "a" or i > 0 and in_link[tree.parent[i]]
        if in_link[i] and tree.name[i] == "#text":
            linked[i] = size[i]
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        size[p], linked[p], stops[p] = size[p] + size[i], linked[p] + linked[i], stops[p] + stops[i]
    out = []
    for i in range(n):
        name, up = tree.name[i], tree.name[tree.parent[i]] if i else ""
        own = ["any", f"name {name}", f"length {'text' if name == '#text' else 'tree'} {sum(size[i] > b for b in LENGTHS)}", f"stops {min(stops[i], 2)}"]
        if size[i]:
            own.append(f"links {sum(linked[i] / size[i] > b for b in LINKS)}")
        if name in ("header", "section", "div", "aside"):
            own.append(f"{name} in {up}")
        own += {f"hint {w.lower()}" for w in SPLIT.findall(tree.hints[i])} if tree.hints[i] else ()
        out.append(own)
    return out, [s > 0 for s in size]


def forest(trees: Sequence[Tree], known: dict[str, int]) -> Forest:
    """Unknown signs are left out."""
    parent, kind, owner, sign, depth, places = [], [], [], [], [], []
    kinds = {k: i for i, k in enumerate(KINDS)}
    for tree in trees:
        own, has = signs(tree)
        at = [-1] * len(own)
        for i, ok in enumerate(has):
            if ok:
                at[i] = len(parent)
                up = at[tree.parent[i]] if i else -1
                parent.append(up)
                depth.append(depth[up] + 1 if up >= 0 else 0)
                kind.append(kinds[KIND_OF.get(tree.name[i], "block")])
                found = [known[s] for s in own[i] if s in known]
                owner += [at[i]] * len(found)
                sign += found
        places.append(at)
    deep = np.array(depth, int)
    order = np.argsort(deep, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(deep))[:-1]) if len(order) else []
    return Forest(np.array(parent, int), np.array(kind, int), np.array(owner, int), np.array(sign, int), levels, places)


def soft(a: np.ndarray) -> np.ndarray:
    """log(exp(a[..., 0]) + exp(a[..., 1]))."""
    return np.logaddexp(a[..., 0], a[..., 1])


def marginals(f: Forest, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node the probability of being content, and of each pair of labels with its parent (0 for a root)."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(f.owner, weights[f.sign], n)
    between = pairs[f.kind]  # node, parent's label, own label
    up = np.zeros((n, 2))
    for level in reversed(f.levels[1:]):
        up[level] = soft(between[level] + own[level][:, None, :])
        np.add.at(own, f.parent[level], up[level])
    whole = own.copy()  # own signs and all below, then also all above
    joint = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        above = whole[f.parent[level]] - up[level]
        both = above[:, :, None] + between[level] + own[level][:, None, :]
        whole[level] = soft(both.swapaxes(1, 2))
        joint[level] = np.exp(both - soft(soft(both))[:, None, None])
    return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -500, 500))), joint


def node_labels(tree: Tree) -> tuple[Tree, np.ndarray]:
    """The tree without marks, and for each node whether most of its text is content."""
    n = len(tree.parent)
    size, good = np.zeros(n), np.zeros(n)
    for k, (leaf, block, text) in enumerate(tree.texts):
        if leaf >= 0:
            tree.texts[k] = (leaf, block, text.replace(MARK, ""))
            size[leaf] = len(text.strip())
            good[leaf] = size[leaf] * (MARK in text)
    for i in range(n - 1, 0, -1):
        size[tree.parent[i]] += size[i]
        good[tree.parent[i]] += good[i]
    return tree, (good > size / 2).astype(int)


def train(pages: Sequence[str]) -> Model:
    """Weights by gradient ascent on the likelihood of the labels of pages; content texts of these begin with MARK.
    Signs that fewer than two pages show are left out. Without pages every weight is 0, and no text is content."""
    labelled = [node_labels(parse(p)) for p in pages]
    seen: dict[str, int] = {}
    for tree, _ in labelled:
        for s in {s for own in signs(tree)[0] for s in own}:
            seen[s] = seen.get(s, 0) + 1
    known = {s: i for i, s in enumerate(sorted(s for s, n in seen.items() if n > 1))}
    f = forest([t for t, _ in labelled], known)
    truth = np.array([y for (_, labels), at in zip(labelled, f.at, strict=True) for y, a in zip(labels, at, strict=True) if a >= 0], int)
    weights, pairs = np.zeros(len(known)), np.zeros((len(KINDS), 2, 2))
    kids = np.flatnonzero(f.parent >= 0)
    seen_pairs = np.zeros_like(pairs)
    np.add.at(seen_pairs, (f.kind[kids], truth[f.parent[kids]], truth[kids]), 1)
    moments = [np.zeros_like(x) for x in (weights, weights, pairs, pairs)]
    for step in range(1, STEPS + 1 if len(truth) else 1):
        p, joint = marginals(f, weights, pairs)
        expected = np.zeros_like(pairs)
        np.add.at(expected, f.kind[kids], joint[kids])
        slopes = (np.bincount(f.sign, (truth - p)[f.owner], len(known)), seen_pairs - expected)
        for k, (x, slope) in enumerate(zip((weights, pairs), slopes, strict=True)):
            g = slope / len(pages) - SHRINK * x
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(known, weights, pairs)


def main_texts(model: Model, pages: Sequence[str]) -> list[str]:
    """The main text of each page; pages do not sway each other."""
    trees = [parse(p) for p in pages]
    f = forest(trees, model.signs)
    p, _ = marginals(f, model.weights, model.pairs)
    return [shown(tree, [a >= 0 and bool(p[a] > 0.5) for a in at]) for tree, at in zip(trees, f.at, strict=True)]


class Layout:
    """Pages put together from parts whose role is known."""

    # Names that templates give to parts.
    CONTENT = ("content", "post", "entry", "story", "article-body", "main-content", "post-content", "text", "body", "single", "page-content", "entry-content", "articleBody")
    OTHER = {
        "nav": ("nav", "menu", "navbar", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "pagination", "pager", "skip", "toc"),
        "head": ("header", "masthead", "site-header", "top", "logo", "branding"),
        "foot": ("footer", "site-footer", "copyright", "bottom", "legal", "imprint"),
        "side": ("sidebar", "aside", "widget", "related", "recommended", "popular", "tags", "archive", "author-box", "side", "more", "teaser"),
        "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "banner", "adsense"),
        "notice": ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "gdpr", "overlay", "paywall"),
        "social": ("social", "share", "sharing", "follow"),
        "talk": ("comments", "comment", "comment-list", "reply", "respond", "discussion", "disqus", "responses", "reader-comments"),
        "form": ("search", "login", "form", "signup", "contact", "search-form"),
    }

    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.words = ["".join(rng.choices("aeioubcdfglmnprstv", k=rng.randrange(1, 9))) for _ in range(300)]

    def say(self, least: int = 1, most: int = 120) -> str:
        n = int(least * (most / least) ** self.r.random())
        text = " ".join(self.r.choices(self.words, k=n)).capitalize()
        return text + self.r.choices((".", "", "!", "?"), (6, 3, 1, 1))[0]

    def run(self, mark: str) -> str:
        """Text of a block, at times with elements inside; mark goes before every text."""
        r, text = self.r, mark + self.say()
        form = r.random()
        if form < 0.12:
            return f"{text} <a href='/x'>{mark}{self.say(1, 6)}</a> {mark}{self.say(1, 20)}"
        if form < 0.3:
            tag = r.choice(("b", "i", "em", "strong", "span", "code"))
            return f"{text} <{tag}>{mark}{self.say(1, 10)}</{tag}> {mark}{self.say(1, 20)}" if r.random() < 0.5 else f"<{tag}>{text}</{tag}>"
        return f"{text}<br>{mark}{self.say()}" if form < 0.4 else text

    def block(self, mark: str) -> str:
        r, form = self.r, self.r.random()
        if form < 0.6:
            return f"<p>{self.run(mark)}" + "</p>" * (r.random() < 0.8)
        if form < 0.66:
            return f"<p><b>{mark}{self.say()}<br>"
        if form < 0.74:
            return f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{mark}{self.say(1, 10)}</{h}>"
        if form < 0.82:
            return "<ul>" + "".join(f"<li>{self.run(mark)}</li>" for _ in range(r.randrange(1, 6))) + "</ul>"
        if form < 0.88:
            return f"<blockquote>{self.run(mark)}</blockquote>"
        if form < 0.92:
            return "<table>" + "".join(f"<tr><td>{mark}{self.say(1, 4)}<td>{mark}{self.say(1, 9)}" for _ in range(3)) + "</table>"
        if form < 0.95:
            return f"<figure><img src=x><figcaption>{mark}{self.say(1, 15)}</figcaption></figure>"
        return f"<pre>{mark}{self.say()}</pre>" if form < 0.98 else f"<div>{self.run(mark)}</div>"

    def tag(self, tags: Sequence[str], names: Sequence[str], inside: str, named: float = 0.9) -> str:
        r, tag = self.r, self.r.choice(tags)
        hint = f' {r.choice(("class", "id"))}="{r.choice(names)}{r.choice(("", "", " clearfix", " wide"))}"' if tag in ("div", "section", "ul", "span", "p") and r.random() < named or r.random() < 0.3 else ""
        return f"<{tag}{hint}>{inside}</{tag}>"

    def links(self) -> str:
        r = self.r
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li><a href=/{i}>{self.say(1, 5)}</a></li>" for i in range(r.randrange(2, 9))) + "</ul>"
        return r.choice((" | ", " ", "")).join(f"<a href=/{i}>{self.say(1, 3)}</a>" for i in range(r.randrange(2, 7)))

    def prose(self) -> str:
        return "".join(self.block("") for _ in range(self.r.randrange(1, 4))) if self.r.random() < 0.6 else self.say()

    def other(self, kind: str) -> str:
        r, names = self.r, self.OTHER[kind]
        if kind == "nav":
            return self.tag(("nav", "nav", "div", "ul"), names, self.links())
        if kind == "head":
            return self.tag(("header", "div"), names, f"<{(t := r.choice(('h1', 'div', 'a', 'p', 'span')))}>{self.say(1, 5)}</{t}>" + self.links() * (r.random() < 0.4))
        if kind == "foot":
            return self.tag(("footer", "footer", "div"), names, r.choice(("&copy; ", "", "<p>")) + self.say(1, 30) + self.links() * (r.random() < 0.5))
        if kind == "side":
            return self.tag(("aside", "aside", "div", "section"), names, f"<h3>{self.say(1, 3)}</h3>" * (r.random() < 0.5) + r.choice((self.links, self.prose))())
        if kind == "talk":
            each = "".join(self.tag(("div", "article", "li", "p"), ("comment", "reply", "comment-body"), self.prose()) for _ in range(r.randrange(1, 6)))
            return self.tag(("section", "div", "ol"), names, f"<h3>{self.say(1, 3)}</h3>" * (r.random() < 0.6) + each + self.other("form") * (r.random() < 0.3), 1)
        if kind == "form":
            return self.tag(("form",), names, f"<label>{self.say(1, 4)}</label><input><select><option>{self.say(1, 2)}<option>{self.say(1, 2)}</select><textarea>{self.say(1, 6)}</textarea><button>{self.say(1, 2)}</button>" + f"<p>{self.say()}</p>" * (r.random() < 0.4))
        return self.tag(("div", "div", "section", "aside", "p") if kind != "social" else ("div", "ul"), names, self.links() if kind == "social" else self.prose() + f"<button>{self.say(1, 2)}</button>" * (kind == "notice" and r.random() < 0.5), 1)

    def page(self) -> str:
        r = self.r
        title = f"<h1>{MARK}{self.say(1, 14)}</h1>"
        title = f"<header>{title}</header>" if r.random() < 0.15 else title
        blocks = [title] * (r.random() < 0.85) + [self.block(MARK) for _ in range(int(25 ** r.random()))]
        if r.random() < 0.35:
            blocks.insert(r.randrange(1, len(blocks) + 1), self.other(r.choice(("ad", "side", "social", "notice", "form", "nav"))))
        inner = "".join(blocks) + self.other("talk") * (r.random() < 0.12)
        wrap = r.random()
        if wrap < 0.5:
            inner = self.tag(("article",), self.CONTENT, inner)
        elif wrap < 0.62:
            inner = self.tag(("main",), self.CONTENT, inner)
        elif wrap < 0.95:
            inner = self.tag(("div", "div", "section"), self.CONTENT, inner, 0.8)
        for _ in range(r.choice((0, 0, 1, 2))):
            inner = self.tag(("div", "main", "section"), ("wrap", "container", "row", "page", "layout"), inner + self.other(r.choice(list(self.OTHER))) * (r.random() < 0.3), 0.5)
        before = [self.other(k) for k in ("nav", "head", "notice", "ad", "form", "social") if r.random() < 0.4]
        after = [self.other(k) for k in ("side", "talk", "social", "ad", "nav", "notice", "form") if r.random() < 0.3] + [self.other("foot")] * (r.random() < 0.8)
        r.shuffle(before)
        r.shuffle(after)
        return "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(before) + inner + "".join(after) + "</body></html>" * (r.random() < 0.9)


def labelled_pages(seed: int = SEED, count: int = PAGES) -> list[str]:
    layout = Layout(random.Random(seed))
    return [layout.page() for _ in range(count)]


@functools.cache
def default_model() -> Model:
    return train(labelled_pages())


def extract(df: DataFrame, model: Model | None = None, page: str = "html", text: str = "text") -> DataFrame:
    """df with the main text of its pages in `text` (a column of that name is replaced).

    Null and empty pages, and pages without content, have an empty text. Broken, deep and very long pages are read whole.
    A page's text does not depend on the pages beside it; repeated rows and the other columns stay as they are, an empty
    table gives no rows.
    """
    held = df.sparkSession.sparkContext.broadcast(model or default_model())
    kept = [c for c in df.columns if c.lower() != text.lower()]
    # Plain names within the plan, as columns may have any.
    src = df.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(kept)), quoted(page).alias("page"))
    made = T.StructType([*src.schema.fields[:-1], T.StructField("shown", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("page")
            for start, stop in groups(pc.fill_null(pc.binary_length(column), 0).to_pylist(), CHUNK):
                texts = main_texts(held.value, [p or "" for p in column.slice(start, stop - start).to_pylist()])
                part = b.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=made.names)

    return src.mapInArrow(run, made).toDF(*kept, text)


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text"))
    return extract(pages, page="text").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
