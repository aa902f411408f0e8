"""Token counts by trie-shared dynamic programming over a unigram piece model.

Distinct pre-tokens are inserted in a trie that a worker keeps across batches. A node holds the best forward
score of the characters down to it and the pieces of that segmentation, computed once when the node is made,
so pre-tokens with a common beginning share them; terminals are stored by word. A text's count is the sum over
its pre-tokens. Long pre-tokens take no place in the trie: their scores run through a window as long as the
longest piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .pieces import BYTE_WEIGHT, MODEL_PATH, SHORT, Vocabulary, groups, load_vocabulary, pre_token_parts, pre_tokens

#: Nodes and terminals of the trie that a worker keeps; beyond it the trie starts anew, which changes no result.
NODES = 500_000
#: Characters of text, and pre-tokens of a longer text, that are counted at a time.
CHARS, PART = 1 << 20, 1 << 16


class TrieCounter:
    def __init__(self, vocabulary: Vocabulary, nodes: int = NODES, short: int = SHORT):
        self.by_end = vocabulary.by_end()
        self.single = {c for c, node in self.by_end.items() if node[1] >= 0}
        self.byte_score = math.log(BYTE_WEIGHT)
        self.vocabulary, self.most, self.short, self.reach = vocabulary, nodes, short, vocabulary.longest
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node and character
        self.scores, self.pieces = [0.0], [0]  # by node
        self.counts: dict[str, int] = {}  # by terminal

    def _best(self, word: str, end: int, score: list[float], count: list[int], base: int = 0) -> tuple[float, int]:
        """Score and pieces of the first `end` characters; the lists hold those of shorter beginnings from `base` on."""
        best, least = -math.inf, 0
        below, at = self.by_end, end - base
        for c in word[max(0, end - self.reach) : end][::-1]:
            node = below.get(c)
            if node is None:
                break
            below, piece, weight = node
            at -= 1
            if piece >= 0:
                s = score[at] + weight
                if s > best or (s == best and count[at] + 1 < least):
                    best, least = s, count[at] + 1
        if word[end - 1] not in self.single:
            k = len(self.vocabulary.fallback(word[end - 1]))
            s = score[end - 1 - base] + k * self.byte_score
            if s > best:
                best, least = s, count[end - 1 - base] + k
        return best, least

    def learn(self, words: Iterable[str]) -> None:
        """Insert words; in sorted order each starts where it leaves the path of the one before. Below the first
        node that no neighbour shares, a word gets no nodes, only its terminal: another word that comes that way
        later makes them."""
        child, scores, pieces, best_of = self.child, self.scores, self.pieces, self._best
        path, score, count = [0], [0.0], [0]
        ordered = sorted(words)
        n = 0
        for i, w in enumerate(ordered):
            del path[n + 1 :], score[n + 1 :], count[n + 1 :]
            after = ordered[i + 1] if i + 1 < len(ordered) else ""
            common, m = 0, min(len(w), len(after))
            while common < m and w[common] == after[common]:
                common += 1
            deep, at = max(n, common) + 1, path[-1]
            for end in range(n + 1, len(w) + 1):
                if at is not None:
                    edge = at << 21 | ord(w[end - 1])
                    at = child.get(edge)
                if at is None:
                    best, least = best_of(w, end, score, count)
                    if end <= deep:
                        at = child[edge] = len(scores)
                        scores.append(best)
                        pieces.append(least)
                else:
                    best, least = scores[at], pieces[at]
                if at is not None:
                    path.append(at)
                score.append(best)
                count.append(least)
            self.counts[w] = count[-1]
            n = common

    def long(self, word: str) -> int:
        score, count, base = [0.0], [0], 0
        for end in range(1, len(word) + 1):
            best, least = self._best(word, end, score, count, base)
            score.append(best)
            count.append(least)
            if len(score) > 4 * self.reach:
                drop = len(score) - self.reach
                del score[:drop], count[:drop]
                base += drop
        return count[-1]

    def _total(self, words: list[str], new: set[str]) -> int:
        counts = self.counts
        return sum(counts[w] if w in counts else self.long(w) for w in words) if new else sum(map(counts.__getitem__, words))

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        out = []
        for parts in ([pre_tokens(t)] if len(t) <= CHARS else pre_token_parts(t, PART) for t in texts):
            n = k = 0
            for words in parts:
                if len(self.scores) + len(self.counts) > self.most:
                    self.clear()
                new = set(words).difference(self.counts)
                far = {w for w in new if len(w) > self.short}
                self.learn(new - far)
                n, k = n + len(words), k + self._total(words, far)
            out.append((n, k))
        return out


#: The counter of this worker process, by its vocabulary: tasks that follow find its trie.
_READY: dict[str, TrieCounter] = {}


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """Per row of df: key, n_pre_tokens and n_tokens (of the best segmentation; a tie takes fewer pieces).

    Null and empty texts count 0; an empty table gives no rows. Texts and words of any length count whole, in
    parts of bounded size. Other columns are ignored; repeated rows are counted each. The vocabulary (of fixed
    size) is broadcast.
    """
    loaded = load_vocabulary(model_path)
    vocabulary, name = df.sparkSession.sparkContext.broadcast(loaded), loaded.digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = TrieCounter(vocabulary.value)
        counter = _READY[name]
        for b in batches:
            texts = b.column("text")
            out: list[tuple[int, int]] = []
            for start, stop in groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CHARS):
                out += counter.count([t or "" for t in texts.slice(start, stop - start).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([n for n, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], names=[key, "n_pre_tokens", "n_tokens"])

    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, T.StructType([T.StructField(key, src.schema["key"].dataType), T.StructField("n_pre_tokens", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def query(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
