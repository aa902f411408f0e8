"""The trie of turns against a plain version, its tree against a dict, and the SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from touchline.llm import prefix_trie, radix

RNG = random.Random(13)


def brute(rows):
    """Nodes of the rebuilt conversations, by plain dictionaries. rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [t for *_, t in sorted(r)] for c, r in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(who) - 1) * words
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if built[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(n, kinds=3):
    return [(t, RNG.choice(["user", "assistant", None]), RNG.choice(["a b", "c", "", None, "d e f"][: kinds + 2])) for t in range(n)]


def conversations():
    RNG.seed(13)
    rows = [(c, *t) for c in range(60) for t in talk(RNG.randrange(1, 6))]
    rows += [(c, *t) for c in range(60, 75) for t in [(0, "user", "the same"), (1, "assistant", "again and again"), (2, "user", None)]]
    rows += [(c, t, "user", f"long {t // 7} turn") for c in (200, 201, 215) for t in range(90)]
    rows += [(300, None, "user", "first"), (300, 0, "user", "tie"), (300, 0, "user", "tie"), (300, 0, "user", "other"), (None, 0, "user", "nobody")]
    rows += [(-7, 0, "user", "below zero"), (417, 0, "u", "alone"), (418, 0, "user:", "x"), (10**15, 1, "user", "far")]
    RNG.shuffle(rows)
    return rows


DDL = "conv_id long, turn long, role string, text string"


def test_against_plain_version(spark):
    rows = conversations()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, DDL).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_small_blocks_add_up(spark, monkeypatch):
    rows = conversations()
    monkeypatch.setattr(prefix_trie, "BLOCK", 300)
    monkeypatch.setattr(prefix_trie, "ROWS", 7)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 1)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, DDL)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_sql_agrees(spark):
    rows = [r for r in conversations() if r[0] is None or r[0] >= 0]
    pdf = spark.createDataFrame(rows, DDL).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", pdf)
    assert sorted(con.sql(prefix_trie.ORACLE_SQL).fetchall(), key=str) == brute(rows)


def test_turnless_only_and_empty(spark):
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    (root,) = prefix_trie.prefix_trie(spark.createDataFrame([(lone, 0, "user", "x")], DDL)).collect()
    assert tuple(root) == (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())
    assert prefix_trie.prefix_trie(spark.createDataFrame([], DDL)).count() == 0


def test_names_that_clash(spark):
    rows = conversations()[:80]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "`my.id` long, `a b` long, hi string, whole string, depth int, id int")
    got = prefix_trie.prefix_trie(df, "my.id", "a b", "hi", "whole").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("alphabet", [2, 12, 40, 256])
def test_radix_layouts(alphabet):
    rng = random.Random(alphabet)
    keys = {bytes(rng.randrange(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 9]))) for _ in range(3000)}
    root = radix.Node(b"", 0)
    for k, key in enumerate(keys):
        radix.insert(root, key, k)
    found, stack, layouts = {}, [(root, b"")], set()
    while stack:
        node, path = stack.pop()
        path += node.prefix
        layouts.add(node.layout)
        assert len(node.children()) <= node.layout
        if node.end is not None:
            found[path] = node.end
        for label in range(256):
            if (kid := node.child(label)) is not None:
                stack.append((kid, path + bytes([label])))
    assert found == {key: k for k, key in enumerate(keys)}
    assert {2: 4, 12: 16, 40: 48, 256: 256}[alphabet] == max(layouts)
