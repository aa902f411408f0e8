"""Raw pages as trees of elements and text, by the usual rules for what closes what."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp title textarea".split())
HIDDEN = frozenset("script style template iframe noembed noframes title head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr caption ul".split()
)
#: An opening tag of the key closes the nearest open element of these, unless one of the barriers stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
    "body": ({"head"}, set()),
}
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
SCOPE = frozenset("table td th caption button object marquee html".split())

#: A comment, a tag or another declaration. What has no end goes to the end of the page, so no place is read twice.
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


@dataclass
class Tree:
    """Parallel lists, parents before children: parent's place (-1: none), element name or "#text", names in class, id and
    role. texts: place of the leaf (-1: a line break), block, text as shown."""

    parent: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)

    def node(self, parent: int, name: str, hints: str = "") -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.hints.append(hints)
        return len(self.parent) - 1


def parse(page: str) -> Tree:
    """The tree of a page, however broken or deep; hidden elements and their text are left out."""
    tree = Tree()
    opened, count = [tree.node(-1, "#page")], Counter()
    hidden = block = at = 0

    def close(names: set[str] | frozenset[str], barriers: set[str] | frozenset[str]) -> None:
        nonlocal hidden, block
        if not any(count[n] for n in names):
            return
        for k in range(len(opened) - 1, 0, -1):
            name = tree.name[opened[k]]
            if name in names:
                gone = [tree.name[o] for o in opened[k:]]
                hidden -= sum(g in HIDDEN for g in gone)
                block += any(g in BLOCK for g in gone)
                count.subtract(gone)
                del opened[k:]
                return
            if name in barriers:
                return

    def say(raw: str) -> None:
        if raw and tree.name[opened[-1]] == "head" and not raw.isspace():
            close({"head"}, frozenset())
        if raw and not hidden:
            shown = html.unescape(raw) if "&" in raw else raw
            tree.texts.append((-1 if shown.isspace() else tree.node(opened[-1], "#text"), block, shown))

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            block += name in BLOCK
            close({name}, frozenset() if name in BLOCK else SCOPE)
            continue
        if name not in HEAD and tree.name[opened[-1]] == "head":
            close({"head"}, frozenset())
        if name in BLOCK:
            block += 1
            close({"p"}, SCOPE)
        if name in CLOSES:
            close(*CLOSES[name])
        if name in VOID:
            if name == "br" and not hidden:
                tree.texts.append((-1, block, " "))
            continue
        hints = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(m[3])) if m[3] else ""
        opened.append(tree.node(opened[-1], name, hints))
        count[name] += 1
        hidden += name in HIDDEN
        if name in RAW:
            end = RAW_END[name].search(page, at)
            stop = end.start() if end else len(page)
            say(page[at:stop] if name in ("title", "textarea") else "")
            at = stop
        elif m[3].endswith("/") and name in ("path", "circle", "rect", "use"):
            close({name}, frozenset())
    return tree


def shown(tree: Tree, kept: list[bool]) -> str:
    """The text of the leaves that are kept: white space in a block becomes one space, as between blocks."""
    blocks: list[str] = []
    parts: list[str] = []
    last, live = -1, False
    for leaf, block, text in tree.texts:
        if block != last:
            if live:
                blocks.append("".join(parts))
            parts, last, live = [], block, False
        if leaf < 0:
            parts.append(text)
        elif kept[leaf]:
            parts.append(text)
            live = True
        else:
            parts.append(" ")
    if live:
        blocks.append("".join(parts))
    return " ".join(" ".join(b.split()) for b in blocks)
