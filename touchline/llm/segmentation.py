"""SentencePiece encoding by sampling, and lossless decoding.

The lattice of a pre-token has a node after each character and an edge for each piece. Forward filtering sums
the weights of all ways to reach a node; backward sampling walks from the end and takes an edge with the
probability that the sums give it. The random numbers are a hash of the row's key, the pre-token's place and
the step, so a row's segmentation is the same wherever and however often it is drawn. Forward sums of short
pre-tokens are remembered, up to a number of edges; the backward walks of many pre-tokens run side by side.
A long pre-token keeps one logarithm a character, and its edges are found again on the way back.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .pieces import BYTE_WEIGHT, MODEL_PATH, SHORT, Vocabulary, groups, load_vocabulary, pre_token_parts, pre_tokens

SEED = 7
#: Edges of remembered lattices (about 12 bytes each, and a string for each word); beyond it they are computed
#: anew, with the same result.
EDGES = 1 << 21
#: Bytes of text, and pre-tokens of a longer text, that are sampled side by side.
CHARS, PART = 1 << 19, 1 << 16
#: Steps of a long walk whose random numbers are drawn at once.
STEPS = 1 << 12
_U = np.uint64
_STRIDE, _GOLD = 0xD1B54A32D192ED03, _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (mixed(x) >> _U(11)).astype(np.float64) / float(1 << 53)


class Sampler:
    def __init__(self, vocabulary: Vocabulary, seed: int = SEED, edges: int = EDGES, short: int = SHORT):
        self.vocabulary, self.seed, self.edges, self.short = vocabulary, seed, edges, short
        self.by_end = vocabulary.by_end(math.exp)
        self.single = {c for c, node in self.by_end.items() if node[1] >= 0}
        self.extra: dict[tuple[int, ...], int] = {}
        self.size = vocabulary.size
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}  # the node of a pre-token's end
        # Edges in order of the node at their end: the probability of all before it, where it comes from, its piece.
        self.before, self.origins, self.ids = array("f"), array("i"), array("i")
        self.ends = array("i")  # by node, where its edges end; roots have none

    def _unknown(self, char: str) -> tuple[int, float]:
        """The id and the weight of a character without a piece; several bytes get an id of their own."""
        raw = self.vocabulary.fallback(char)
        return raw[0] if len(raw) == 1 else self.extra.setdefault(raw, self.size + len(self.extra)), BYTE_WEIGHT ** len(raw)

    def learn(self, words: Iterable[str]) -> None:
        """Forward filtering of new short pre-tokens. In sorted order a shared beginning has the same nodes."""
        root, single, last = self.by_end, self.single, self.last
        sums: list[float] = []  # by edge, over the edges of its node so far
        totals: list[float] = [1.0]  # by node, and the number of its edges
        degrees: list[int] = [0]
        origins: list[int] = []
        ids: list[int] = []
        node_id = len(self.ends)  # a root
        add_sum, add_origin, add_id = sums.append, origins.append, ids.append
        alpha, nodes = [1.0], [node_id]
        path = ""
        for w in sorted(words):
            n, m = 0, min(len(w), len(path))
            while n < m and w[n] == path[n]:
                n += 1
            del alpha[n + 1 :], nodes[n + 1 :]
            back, long = w[::-1], len(w)
            for end in range(n + 1, long + 1):
                node_id += 1
                below, at, total, first = root, end, 0.0, len(ids)
                for c in back[long - end :]:
                    node = below.get(c)
                    if node is None:
                        break
                    below, piece, weight = node
                    at -= 1
                    if piece >= 0:
                        add_sum(total)
                        total += alpha[at] * weight
                        add_origin(nodes[at])
                        add_id(piece)
                if w[end - 1] not in single:
                    piece_id, weight = self._unknown(w[end - 1])
                    add_sum(total)
                    total += alpha[end - 1] * weight
                    add_origin(nodes[end - 1])
                    add_id(piece_id)
                totals.append(total)
                degrees.append(len(ids) - first)
                alpha.append(total)
                nodes.append(node_id)
                if total < 1e-200:
                    # Only ratios within the reach of a piece matter.
                    alpha = [min(x * 1e200, 1e300) for x in alpha]
            last[w] = nodes[len(w)]
            path = w
        degree = np.array(degrees, np.int64)
        self.before.frombytes((np.array(sums) / np.repeat(np.array(totals), degree)).astype(np.float32).tobytes())
        self.ends.frombytes((len(self.ids) + np.cumsum(degree)).astype(np.int32).tobytes())
        self.origins.extend(origins)
        self.ids.extend(ids)

    def walk(self, word: str, stream: int) -> list[int]:
        """A sample of one long pre-token."""
        root, single, exp = self.by_end, self.single, math.exp
        alpha = array("d", [0.0])  # logarithms

        def edges(end: int) -> list[tuple[float, int, int]]:
            """(log weight of the way, origin, piece)"""
            out, below, at = [], root, end
            while at and (node := below.get(word[at - 1])) is not None:
                below, piece, weight = node
                at -= 1
                if piece >= 0:
                    out.append((alpha[at] + math.log(weight), at, piece))
            if word[end - 1] not in single:
                piece_id, weight = self._unknown(word[end - 1])
                out.append((alpha[end - 1] + math.log(weight), end - 1, piece_id))
            return out

        for end in range(1, len(word) + 1):
            ways = [e[0] for e in edges(end)]
            top = max(ways)
            alpha.append(top + math.log(sum(exp(x - top) for x in ways)))
        out: list[int] = []
        at, us = len(word), []
        while at:
            if len(out) % STEPS == 0:
                steps = np.arange(len(out) + 1, len(out) + 1 + STEPS, dtype=_U) * _U(_STRIDE)
                us = _uniform(_U(stream) + steps).tolist()
            left, found = us[len(out) % STEPS], edges(at)
            for way, origin, piece in found:
                left -= exp(way - alpha[at])
                if left < 0:
                    break
            out.append(piece)
            at = origin
        return out[::-1]

    def sample(self, words: list[str], streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of all pre-tokens in a row, and how many each has. streams: a uint64 for each."""
        if len(self.ids) > self.edges:
            self.clear()
        fresh = set(words).difference(self.last)
        far = {w for w in fresh if len(w) > self.short}
        if fresh := fresh - far:
            self.learn(fresh)
        n = len(words)
        get = self.last.get
        node = np.fromiter((get(w, -1) for w in words), np.int64, n)
        count = np.zeros(n, np.int64)
        walks = {int(i): self.walk(words[i], int(streams[i])) for i in np.flatnonzero(node < 0)} if far else {}
        for i, got in walks.items():
            count[i] = len(got)
        before, origins, ids, ends = (np.frombuffer(x, t) if len(x) else np.zeros(0, t) for x, t in ((self.before, "f4"), (self.origins, "i4"), (self.ids, "i4"), (self.ends, "i4")))
        alive = np.flatnonzero(node >= 0)
        node, stream, steps = node[alive], streams[alive], []
        while len(alive):
            u = _uniform(stream + _U((len(steps) + 1) * _STRIDE % (1 << 64))).astype(np.float32)
            edge = ends[node].astype(np.int64) - 1
            high = np.flatnonzero(u < before[edge])
            while len(high):
                edge[high] -= 1
                high = high[u[high] < before[edge[high]]]
            steps.append((alive, ids[edge]))
            count[alive] += 1
            node = origins[edge]
            more = np.flatnonzero(ends[node] > np.where(node > 0, ends[node - 1], 0))
            alive, node, stream = alive[more], node[more], stream[more]
        del before, origins, ids, ends  # frees the buffers, which may grow again
        stops = np.cumsum(count)
        out = np.empty(int(stops[-1]) if n else 0, np.int32)
        for k, (where, got) in enumerate(steps):
            out[stops[where] - 1 - k] = got
        for i, got in walks.items():
            out[stops[i] - len(got) : stops[i]] = got
        return self._spelled(out, count)

    def _spelled(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters of several bytes as their byte pieces."""
        if not self.extra or not (ids >= self.size).any():
            return ids, count
        raw = [x for x, _ in sorted(self.extra.items(), key=lambda e: e[1])]
        width = np.ones(self.size + len(raw), np.int64)
        width[self.size :] = [len(x) for x in raw]
        repeats = width[ids]
        stops = np.cumsum(repeats)
        out = np.repeat(ids, repeats)
        for at in np.flatnonzero(ids >= self.size):
            out[stops[at] - repeats[at] : stops[at]] = raw[ids[at] - self.size]
        ends = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(count)])]
        return out, np.diff(ends)

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' piece ids in a row, and how many each has. keys: a uint64 for each text."""
        if len(texts) == 1 and len(texts[0]) > CHARS:
            done, at = [], 0
            for part in pre_token_parts(texts[0], PART):
                done.append(self.sample(part, self._streams(keys, np.array([len(part)]), at))[0])
                at += len(part)
            ids = np.concatenate(done)
            return ids, np.array([len(ids)])
        words = [pre_tokens(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        ids, count = self.sample([w for row in words for w in row], self._streams(keys, counts))
        stops = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(stops)

    @staticmethod
    def _streams(keys: np.ndarray, counts: np.ndarray, at: int = 0) -> np.ndarray:
        first = np.cumsum(counts) - counts
        place = np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(first, counts) + at
        return mixed(np.repeat(keys, counts) + place.astype(_U) * _GOLD)


class Speller:
    """Decodes ids with the bytes of all pieces in one array."""

    def __init__(self, pieces: list[bytes]):
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.width = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.width) - self.width

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each of the rows that `counts` ids make."""
        width = self.width[ids]
        ends = np.cumsum(width)
        place = np.repeat(self.start[ids] - (ends - width), width) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = self.blob[place].tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b] for a, b in zip(stops, stops[1:])]

    def text(self, ids: np.ndarray) -> str:
        return b"".join(self.texts(ids[at : at + CHARS], np.array([len(ids[at : at + CHARS])]))[0] for at in range(0, len(ids), CHARS)).decode()


def row_key(value: object, seed: int) -> int:
    """Null keys share one stream."""
    return xxhash.xxh64_intdigest(repr(value), seed)


#: The sampler of this worker process, by what it depends on: tasks that follow find it ready.
_READY: dict[tuple, Sampler] = {}


def _sampler(vocabulary: Vocabulary, name: str, seed: int) -> Sampler:
    if (name, seed) not in _READY:
        _READY.clear()
        _READY[name, seed] = Sampler(vocabulary, seed)
    return _READY[name, seed]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH, seed: int = SEED, decoded: str | None = None) -> DataFrame:
    """df with ids (array<int>): a sampled segmentation of text, seeded by the row's key and `seed`; with
    `decoded` also a column of that name, the text that the ids stand for.

    Null and empty texts give an empty array (and decode to ""). Existing columns of these names are replaced;
    the other columns stay, whatever their names. Rows with the same key and text get the same ids; an empty
    table gives no rows. Texts are sampled in parts of bounded size, so a very long text or word only needs
    memory for its ids and a number a character. The vocabulary (of fixed size) is broadcast.
    """
    loaded = load_vocabulary(model_path)
    vocabulary, name = df.sparkSession.sparkContext.broadcast(loaded), loaded.digest
    df = df.drop("ids", *([decoded] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(vocabulary.value, name, seed)
        speller = Speller(sampler.vocabulary.bytes_of()) if decoded else None
        for b in batches:
            texts = b.column(text)
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for start, stop in groups(lengths, CHARS):
                part = b.slice(start, stop - start)
                keys = np.array([row_key(x, seed) for x in part.column(key).to_pylist()], dtype=_U)
                # A text of more than CHARS ends its group: it goes through alone.
                alone = lengths[stop - 1] > CHARS and stop - start > 1
                for at, n in ((0, stop - start - 1), (stop - start - 1, 1)) if alone else ((0, stop - start),):
                    own = part.slice(at, n)
                    ids, counts = sampler.encode([v or "" for v in own.column(text).to_pylist()], keys[at : at + n])
                    bounds = np.concatenate([[0], np.cumsum(counts)])
                    columns = [*own.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                    if speller:
                        back = [speller.text(ids)] if n == 1 else [x.decode() for x in speller.texts(ids, counts)]
                        columns.append(pa.array(back, pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "ids", *([decoded] if decoded else [])])

    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", model_path: str = MODEL_PATH) -> DataFrame:
    """df with column `to`: the text that ids stand for (null where ids is null, "" where it is empty). An
    existing column is replaced; other columns, repeated rows and their order don't matter."""
    spelled = df.sparkSession.sparkContext.broadcast(load_vocabulary(model_path).bytes_of())
    df = df.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(spelled.value)
        for b in batches:
            texts = [speller.text(v.values.to_numpy()) if v.is_valid else None for v in b.column(ids)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.StringType())]))


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """Per row of docs: key, n_bytes, n_pieces, ids_hash, decoded_sha256 and lossless.

    Null texts count as empty, without pieces. Repeated rows give repeated results, an empty table none; other
    columns are ignored. Encoding and decoding share one pass over the texts.
    """
    back = encode(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", "text", model_path, decoded="decoded")
    return back.select(
        F.col("key").alias(key),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def query(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))
