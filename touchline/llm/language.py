"""Language identification with a byte convolutional network.

The network embeds bytes, runs filters of several widths over a fixed-length window, takes each filter's
maximum and ends in a softmax. It is trained with numpy on a bounded sample of labelled text. To apply it, the
embedding and the filters are folded into tables by pairs of bytes, and batches of windows that cover whole
texts go through them; a text's prediction is the mean of its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_fold, quoted, table, unit_hash
from .pieces import groups

#: Positions in a window. A filter that starts at its last position reads REACH bytes beyond it.
WINDOW, REACH = 256, 3
#: Width of the filters and how many there are of it.
FILTERS = ((2, 8), (3, 8), (4, 8))
EMBEDDING = 8
#: Bound on the training sample: texts, and stretches of CHARS characters taken from each.
SAMPLE_TEXTS, STRETCHES, CHARS = 2400, 4, 300
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 11
#: A row of counts for each language is broadcast.
MAX_LANGUAGES = 10_000
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Positions whose filter values are held at a time.
_STEP = 1 << 15
#: Bytes of text that are predicted together; what is longer goes through alone, in parts of this size.
CHUNK = 1 << 20


@dataclass
class ByteCnn:
    """bank: a table of 256 bytes x filters for each of the four offsets; head: softmax layer."""

    labels: list[str]
    bank: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    head_bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        pair = [(self.bank[k][:, None] + self.bank[k + 1][None]).reshape(1 << 16, -1).astype(np.float32) for k in (0, 2)]
        return pair[0], pair[1]


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows' bytes in a row (and REACH zeros), each window's text, and its bytes that aren't padding. A
    text ends with REACH zeros at least."""
    padded = [t + b"\0" * ((-len(t) - REACH) % WINDOW + REACH) for t in texts]
    data = np.frombuffer(b"".join(padded) + b"\0" * REACH, np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(p) // WINDOW for p in padded])
    weight = np.count_nonzero(data[:-REACH].reshape(-1, WINDOW), axis=1)
    return data, owner, weight


def pooled(model: ByteCnn, tables: tuple[np.ndarray, np.ndarray], data: np.ndarray, owner: np.ndarray, ends: bool = True) -> np.ndarray:
    """The filters' maxima for each window. What a text's last window reaches beyond it are zeros, whatever text
    comes next; with `ends` false the texts go on after the last of these windows."""
    n = len(owner)
    out = np.empty((n, tables[0].shape[1]), np.float32)
    a = np.empty((_STEP, out.shape[1]), np.float32)
    b = np.empty_like(a)
    last = np.append(owner[1:] != owner[:-1], ends)
    zeros = tables[0][0] + tables[1][0]
    for at in range(0, n * WINDOW, _STEP):
        m = min(_STEP, n * WINDOW - at)
        pairs = data[at : at + m + 2].astype(np.int32) << 8 | data[at + 1 : at + m + 3]
        np.take(tables[0], pairs[:m], 0, out=a[:m], mode="clip")
        np.take(tables[1], pairs[2:], 0, out=b[:m], mode="clip")
        np.add(a[:m], b[:m], out=a[:m])
        z = a[:m].reshape(-1, WINDOW, out.shape[1])
        z[np.flatnonzero(last[at // WINDOW : (at + m) // WINDOW]), WINDOW - REACH :] = zeros
        z.max(1, out=out[at // WINDOW : (at + m) // WINDOW])
    return np.maximum(out + model.bias.astype(np.float32), 0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def predict(model: ByteCnn, tables: tuple[np.ndarray, np.ndarray], texts: list[bytes]) -> list[tuple[str, float]]:
    """The mean of each text's windows, weighted by their bytes. A long text goes through in parts of whole windows."""
    total = np.zeros((len(texts), len(model.labels)))

    def add(data: np.ndarray, owner: np.ndarray, weight: np.ndarray, ends: bool = True) -> None:
        p = softmax(pooled(model, tables, data, owner, ends) @ model.head + model.head_bias) * (weight + 1e-9)[:, None]
        np.add.at(total, owner, p)

    for start, stop in groups([len(t) for t in texts], CHUNK):
        if len(texts[stop - 1]) > CHUNK:
            long = np.frombuffer(texts[stop - 1], np.uint8)
            at = 0
            while len(long) - at > CHUNK + REACH:
                add(long[at : at + CHUNK + REACH], np.full(CHUNK // WINDOW, stop - 1), np.count_nonzero(long[at : at + CHUNK].reshape(-1, WINDOW), axis=1), ends=False)
                at += CHUNK
            rest = texts[stop - 1][at:]
        else:
            rest = texts[stop - 1]
        data, owner, weight = windows_of([*texts[start : stop - 1], rest])
        add(data, owner + start, weight)
    total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
    best = total.argmax(1)
    return [(model.labels[k], float(min(1.0, total[i, k]))) for i, k in enumerate(best)]


def train(texts: list[str], langs: list[str], seed: int = SEED, epochs: int = EPOCHS) -> ByteCnn | None:
    """Adam on the cross-entropy of single windows; gradients pass the maximum at its position only."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    raw = [t.encode()[: WINDOW + REACH] for t in texts]
    x = np.zeros((len(raw), WINDOW + REACH), np.uint8)
    for i, r in enumerate(raw):
        x[i, : len(r)] = np.frombuffer(r, np.uint8)
    y = np.searchsorted(labels, langs)
    width = np.repeat([w for w, _ in FILTERS], [n for _, n in FILTERS])
    n_f = len(width)
    par = {
        "emb": rng.normal(0, 0.5, (256, EMBEDDING)),
        "conv": rng.normal(0, 0.35, (4, EMBEDDING, n_f)),
        "bias": np.zeros(n_f),
        "head": rng.normal(0, 0.3, (n_f, len(labels))),
        "head_bias": np.zeros(len(labels)),
    }
    live = (np.arange(4)[:, None] < width[None]).astype(float)  # a narrow filter's outer offsets stay zero
    m1, m2 = ({k: np.zeros_like(v) for k, v in par.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            b = x[rows]
            bank = np.einsum("be,jef->jbf", par["emb"], par["conv"] * live[:, None])
            z = sum(bank[j][b[:, j : j + WINDOW]] for j in range(4))
            top = z.argmax(1)
            v = np.take_along_axis(z, top[:, None], 1)[:, 0] + par["bias"]
            h = np.maximum(v, 0)
            d = softmax(h @ par["head"] + par["head_bias"])
            d[np.arange(len(rows)), y[rows]] -= 1
            d /= len(rows)
            dv = (d @ par["head"].T) * (v > 0)
            g = {"head": h.T @ d, "head_bias": d.sum(0), "bias": dv.sum(0), "conv": np.zeros_like(par["conv"]), "emb": np.zeros_like(par["emb"])}
            for j in range(4):
                seen = b[np.arange(len(rows))[:, None], top + j]
                w = dv * live[j]
                g["conv"][j] = np.einsum("rfe,rf->ef", par["emb"][seen], w)
                np.add.at(g["emb"], seen, w[:, :, None] * par["conv"][j].T[None])
            step += 1
            for k, grad in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad**2
                par[k] -= RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    bank = np.einsum("be,jef->jbf", par["emb"], par["conv"] * live[:, None])
    return ByteCnn(labels, bank, par["bias"], par["head"], par["head_bias"])


def training_sample(rows: DataFrame, key: str, text: str, lang: str, bound: int = SAMPLE_TEXTS) -> tuple[list[str], list[str]]:
    """Stretches of text and their languages: about bound texts, as many of each language, picked by a hash of
    key and text. Where repeated rows bring more than twice that, those with the least hashes are taken."""
    known = rows.select(quoted(key).alias("key"), quoted(text).alias("text"), quoted(lang).alias("lang")).filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    langs = counts.count()
    if langs > MAX_LANGUAGES:
        raise ValueError(f"{langs} languages; the network is built for {MAX_LANGUAGES} at most")
    share = F.broadcast(counts.select("of", (F.lit(bound / max(1, langs)) / F.col("n")).alias("share")))
    picked = known.join(share, F.col("lang") == F.col("of")).withColumn("order", unit_hash(F.lit(SEED), F.col("key"), F.col("text"))).filter("order < share")
    at = [unit_hash(F.lit(SEED + 1 + k), F.col("key")) for k in range(STRETCHES)]
    parts = F.array(*(F.substring("text", (a * F.greatest(F.length("text") - CHARS, F.lit(1))).cast("int") + 1, F.lit(CHARS)) for a in at))
    each = picked.select("lang", "order", F.explode(F.array_distinct(parts)).alias("part"))
    got = each.orderBy("order", "lang", "part").limit(2 * bound * STRETCHES).select("lang", "part").collect()
    got = sorted((r["lang"], r["part"]) for r in got)
    return [p for _, p in got], [x for x, _ in got]


def identify(df: DataFrame, model: ByteCnn | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: key, lang_pred and score.

    Null texts and texts without a letter are `und` with the score 0, as is everything without a model; of
    languages that tie the first by name is taken. Repeated rows and other columns don't matter; an empty table
    gives no rows. Texts are read whole, CHUNK bytes of windows at a time, however long.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    folded: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        if model is not None and "t" not in folded:
            folded["t"] = model.folded()
        for b in batches:
            langs, scores = [], []
            column = b.column("text")
            for start, stop in groups(pc.fill_null(pc.binary_length(column), 0).to_pylist(), CHUNK):
                texts = column.slice(start, stop - start).to_pylist()
                has = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                got = predict(model, folded["t"], [texts[i].encode() for i in has]) if has and model is not None else []
                found = dict(zip(has, got, strict=False))
                for i in range(len(texts)):
                    lang, score = found.get(i, (UNKNOWN, 0.0))
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    src = df.select(quoted(key).alias("key"), quoted(text).alias("text"))
    return src.mapInArrow(run, T.StructType([T.StructField(key, src.schema["key"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(doc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    learn = docs.filter(doc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    model = train(*training_sample(learn, "doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
