"""An adaptive radix tree over keys of fixed-width parts, and the nodes that end at whole parts.

A node holds its children in one of four layouts, by their number, and the bytes that all keys below it share. Keys are
chains of turn ids, so only byte depths that are whole turns are nodes of the trie of turns.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator, Sequence

#: Bytes of a turn id.
WIDTH = 16
ROOT = bytes(WIDTH)
#: Most children of each layout but the last, which has a place for every byte.
LAYOUTS = (4, 16, 48)


class Node:
    __slots__ = ("end", "kids", "labels", "layout", "prefix", "some")

    def __init__(self, prefix: bytes, some: int) -> None:
        self.prefix, self.some = prefix, some  # some: a key below
        self.end: int | None = None  # the key that ends here
        self.layout, self.labels, self.kids = LAYOUTS[0], bytearray(), []

    def child(self, label: int) -> Node | None:
        if self.layout <= LAYOUTS[1]:
            at = self.labels.find(label)
            return self.kids[at] if at >= 0 else None
        if self.layout == LAYOUTS[2]:
            at = self.labels[label]
            return self.kids[at - 1] if at else None
        return self.kids[label]

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None]

    def add(self, label: int, kid: Node) -> None:
        """Add a child under a label that has none; the next layout is taken when this one is full."""
        if self.layout < 256 and len(self.kids) == self.layout:
            self.grow()
        if self.layout <= LAYOUTS[1]:
            at = bisect_left(self.labels, label)
            self.labels.insert(at, label)
            self.kids.insert(at, kid)
        elif self.layout == LAYOUTS[2]:
            self.kids.append(kid)
            self.labels[label] = len(self.kids)
        else:
            self.kids[label] = kid

    def grow(self) -> None:
        if self.layout == LAYOUTS[0]:
            self.layout = LAYOUTS[1]
        elif self.layout == LAYOUTS[1]:
            index = bytearray(256)
            for at, label in enumerate(self.labels):
                index[label] = at + 1
            self.layout, self.labels = LAYOUTS[2], index
        else:
            self.kids = [self.kids[at - 1] if at else None for at in self.labels]
            self.layout, self.labels = 256, bytearray()

    def split(self, at: int) -> None:
        """Keep the first `at` bytes of the prefix; a child takes the rest and all that stood here."""
        low = Node(self.prefix[at + 1 :], self.some)
        low.end, low.layout, low.labels, low.kids = self.end, self.layout, self.labels, self.kids
        label, self.prefix = self.prefix[at], self.prefix[:at]
        self.end, self.layout, self.labels, self.kids = None, LAYOUTS[0], bytearray(), []
        self.add(label, low)


def insert(root: Node, key: bytes, value: int) -> None:
    """value under key; the root's own prefix is empty. A key that is there already gets the new value."""
    node, at = root, 0
    while True:
        if not key.startswith(node.prefix, at):
            part = key[at : at + len(node.prefix)]
            same = next((i for i, (a, b) in enumerate(zip(node.prefix, part, strict=False)) if a != b), len(part))
            node.split(same)
            at += same
        else:
            at += len(node.prefix)
        if at == len(key):
            node.end = value
            return
        below = node.child(key[at])
        if below is None:
            leaf = Node(key[at + 1 :], value)
            leaf.end = value
            node.add(key[at], leaf)
            return
        node, at = below, at + 1


def turn_nodes(keys: Sequence[bytes], words: Sequence[Sequence[int]], first: Sequence[int], members: Sequence[int], childless: Sequence[bool], owned: Sequence[int]) -> Iterator[tuple]:
    """What distinct keys tell about each node of the trie of turns; what several calls say of a node adds up.

    For each key: the words of its turns, its least conversation and its number of conversations, whether its last node
    has no children in the whole trie, and of how many of its nodes its least conversation is the least of all. A row:
    id (two longs), parent's id (or None), depth, words, least conversation, conversations, the least of those that
    end here (or None), childless nodes below, and the words below, once for each conversation and once for each node
    whose least conversation is among these keys.
    """
    root = Node(b"", 0)
    for k, key in enumerate(keys):
        insert(root, key, k)
    # Downward: the ids of whole turns, each from its parent's and its own turn.
    order: list[tuple[Node, int, int, list[bytes]]] = []
    stack: list[tuple[Node, int, bytes, int]] = [(root, 0, ROOT, -1)]
    while stack:
        node, start, last, above = stack.pop()
        end = start + len(node.prefix) + (node is not root)
        key, ids = keys[node.some], [last]
        for b in range((start // WIDTH + 1) * WIDTH, end + 1, WIDTH):
            last = hashlib.sha256(last + key[b - WIDTH : b]).digest()[:WIDTH]
            ids.append(last)
        stack.extend((kid, end, last, len(order)) for kid in node.children())
        order.append((node, end, above, ids))
    # Upward: sums over what ends below.
    sums = [[0, None, 0, 0, 0, None] for _ in order]  # conversations, least, childless, words each, words once, least unowned depth
    for i in range(len(order) - 1, -1, -1):
        node, end, above, ids = order[i]
        own, k = sums[i], node.end
        if k is not None:
            fold(own, [members[k], first[k], int(childless[k]), 0, 0, len(keys[k]) // WIDTH - owned[k]])
        n, least, leaves, each, once, low = own
        for depth in range(end // WIDTH, end // WIDTH - len(ids) + 1, -1):
            at = depth - end // WIDTH - 1
            w = words[node.some][depth - 1]
            each, once = each + n * w, once + (w if low < depth else 0)
            ends_here = first[k] if k is not None and depth == end // WIDTH else None
            yield *struct.unpack(">qq", ids[at]), *struct.unpack(">qq", ids[at - 1]), depth, w, least, n, ends_here, leaves, each, once
        if above >= 0:
            fold(sums[above], [n, least, leaves, each, once, low])
        else:
            yield *struct.unpack(">qq", ROOT), None, None, 0, 0, least, n, first[k] if k is not None else None, leaves, each, once


def fold(into: list, part: list) -> None:
    for c in (0, 2, 3, 4):
        into[c] += part[c]
    for c in (1, 5):
        into[c] = part[c] if into[c] is None else min(into[c], part[c])
