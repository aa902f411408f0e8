"""Word shingles as 64-bit hashes, and SetSketch registers over them, in numpy."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import xxhash

_U = np.uint64
WIDTH = 5
_FACTORS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=_U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit xxh3 hash of every word of all texts (A-Z lower-cased), and each text's number of words."""
    rows = [t.lower().split() for t in texts]  # of bytes: at space, tab, LF, VT, FF and CR
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(rows)), _U, int(counts.sum())), counts


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. Fewer words than width: the whole sequence; none: empty."""
    words, counts = word_hashes(texts)
    n = len(words)
    whole = np.zeros(max(0, n - width + 1), _U)
    for j in range(width):
        whole += words[j : n - width + 1 + j] * _FACTORS[j % 5] if n >= width else _U(0)
    whole = mixed(whole)
    out, at = [], 0
    for c in counts:
        if c >= width:
            out.append(np.unique(whole[at : at + c - width + 1]))
        elif c:
            short = np.full(1, 0xA0761D6478BD642F * int(c) % (1 << 64), _U)
            for j in range(c):
                short += words[at + j : at + j + 1] * _FACTORS[j % 5]
            out.append(mixed(short))
        else:
            out.append(np.zeros(0, _U))
        at += c
    return out


def set_id(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class SetSketch:
    """Registers floor(1 - log_b(min x)) of exponential variables x of rate a, truncated to [0, q + 1].

    Registers of unions are maxima of registers, and two registers agree with about the probability of the
    sets' Jaccard similarity.
    """

    BASE, RATE, TOP = 1.001, 20.0, 65_534

    def __init__(self, registers: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.m = registers
        self.factor = rng.integers(1, 1 << 63, registers, dtype=_U) * _U(2) + _U(1)
        self.flip = rng.integers(0, 1 << 63, registers, dtype=_U) * _U(2)

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of uint16 registers per non-empty set."""
        sizes = np.array([len(s) for s in sets])
        best = np.empty((len(sets), self.m), _U)
        at = 0
        while at < len(sets):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 15)) + at)
            flat = np.concatenate(sets[at:stop])
            first = np.cumsum(sizes[at:stop]) - sizes[at:stop]
            for i in range(self.m):
                best[at:stop, i] = np.maximum.reduceat((flat ^ self.flip[i]) * self.factor[i], first)
            at = stop
        least = -np.log1p(-((~best).astype(np.float64) + 1.0) / 2.0**64) / self.RATE
        return np.clip(np.floor(1 - np.log(least) / np.log(self.BASE)), 0, self.TOP + 1).astype(np.uint16)

    def bands(self, registers: np.ndarray, rows: int) -> np.ndarray:
        """One int64 key for each band of `rows` registers."""
        n = self.m // rows
        key = np.arange(1, n + 1, dtype=_U)[None] * _U(0x9E3779B97F4A7C15) + np.zeros((len(registers), 1), _U)
        for j in range(rows):
            key = mixed(key + (registers[:, j : n * rows : rows].astype(_U) + _U(1)) * _FACTORS[j % 5])
        return key.astype(np.int64)

    def similarity(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest Jaccard similarity for each pair of register rows, and how much likelier it is (in
        natural logs) than the similarity `at`, from the joint likelihood of greater, smaller and equal registers."""
        greater, smaller = (a > b).sum(1), (a < b).sum(1)
        equal = self.m - greater - smaller
        u = size_a / (size_a + size_b)
        v = 1 - u
        most = np.minimum(u / v, v / u)

        def chance(x: np.ndarray) -> np.ndarray:
            return np.clip(-np.log1p(-x * (self.BASE - 1) / self.BASE) / np.log(self.BASE), 1e-12, 1 - 1e-12)

        def likelihood(j: np.ndarray) -> np.ndarray:
            up, down = chance(u - v * j), chance(v - u * j)
            return greater * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))

        grid = np.linspace(0, 1, 101)[:, None] * most[None]
        values = np.stack([likelihood(g) for g in grid])
        best = values.argmax(0)
        return grid[best, np.arange(len(u))], values.max(0) - likelihood(np.minimum(at, most))
