"""Piece vocabularies and pre-tokens for the two tokenisation operators.

A vocabulary is read from a SentencePiece model file whose path is a parameter; nothing is trained. The file
at hand holds ranks rather than probabilities, so a piece of rank r gets the Zipf weight 1 / (r + 2).
Characters without a piece fall back to byte pieces, so that every text can be written. A pre-token is a run
of spaces, a word or a run of other signs, with the space before it, however long: pieces don't cross the
ends of pre-tokens.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a U+2581 of the text itself: a lone surrogate can't be in a text.
OWN_SPACE = "\ud800"
PRE_TOKEN = re.compile(rf"{SPACE}+(?={SPACE})|{SPACE}?\w+|{SPACE}?[^\w\s{SPACE}]+|\s|{SPACE}")
#: What a byte piece weighs, against 1 / (r + 2) of a piece.
BYTE_WEIGHT = 1e-7
#: Pre-tokens up to this length are worth remembering; longer ones are computed where they stand, in memory
#: that a few numbers a character bound.
SHORT = 64


@dataclass(frozen=True)
class Vocabulary:
    """pieces: string to (id, natural log of its weight); byte_ids: the id of each byte's piece."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]

    @property
    def size(self) -> int:
        return max([i for i, _ in self.pieces.values()] + list(self.byte_ids)) + 1

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def digest(self) -> str:
        return hashlib.sha256(repr((sorted(self.pieces.items()), self.byte_ids)).encode("utf-8", "surrogatepass")).hexdigest()

    def bytes_of(self) -> list[bytes]:
        """By id, the bytes that a piece stands for."""
        out = [b""] * self.size
        for s, (i, _) in self.pieces.items():
            out[i] = s.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out

    def fallback(self, char: str) -> tuple[int, ...]:
        raw = (SPACE if char == OWN_SPACE else " " if char == SPACE else char).encode()
        return tuple(self.byte_ids[b] for b in raw)

    def by_end(self, scale: Callable[[float], float] = float) -> dict[str, tuple]:
        """Trie of the reversed pieces: {char: (the same below it, id, scale(log weight))}; id is -1 for no piece."""
        root: dict = {}
        for s, (i, weight) in self.pieces.items():
            below = root
            for c in reversed(s[1:]):
                below = below.setdefault(c, ({}, -1, 0.0))[0]
            old = below.get(s[0])
            below[s[0]] = old[0] if old else {}, i, scale(weight)
        return root


def load_vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, rank = {}, [0] * 256, 0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = (i, -math.log(rank + 2))
            rank += 1
    return Vocabulary(pieces, tuple(byte_ids))


def _written(text: str) -> str:
    if SPACE in text:
        text = text.replace(SPACE, OWN_SPACE)
    return text.replace(" ", SPACE)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text; joined they are the text, with SPACE for spaces."""
    return PRE_TOKEN.findall(_written(text))


def pre_token_parts(text: str, most: int) -> Iterator[list[str]]:
    """The same in lists of `most`, so that a very long text's pre-tokens aren't all held at once."""
    found = PRE_TOKEN.finditer(_written(text))
    while part := [m.group() for m in islice(found, most)]:
        yield part


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to `most` at least, the last one aside: a larger row ends its range."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
