"""Toxicity scores from a learned lexicon, misspellings included.

Terms and stems that mark labelled toxic rows form a trie. A token is looked up in the intersection of the
trie with a Levenshtein automaton: a state is the set of (trie node, edits so far) pairs, made deterministic
as tokens arrive, so a token costs one step a character. A match weighs the log of how much more frequent its
term is, at that distance, in toxic rows than in clean ones, times a factor for the tokens around it, which
tell a quotation from an abuse. A logistic function of a text's weights and length is its score.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_fold, free_name, quoted, table, unit_hash, written

TOKEN = re.compile(r"[^\W\d_]+")
#: Letters with digits and signs between them; one token if none of its TOKENs stands for a term.
JOINED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:(?:[^\w\s]|[\d_])++[^\W\d_]++)++")
FOLDS, HELD_OUT = 5, 0
#: Bounds on the rows to learn from. They bound the lexicon too: a term needs SUPPORT of them.
SAMPLE_TOXIC, SAMPLE_CLEAN = 6000, 12000
#: A term needs so many toxic rows, and a log ratio of its frequencies in toxic and clean rows that is above
#: MARGIN by Z standard errors.
SUPPORT, MARGIN, Z = 6, math.log(2), 4.0
#: By how much a longer term's log ratio has to be above a shorter one's.
CLEARLY = 0.5
STEMS = (3, 4, 5, 6, 7, 8)
#: Edits allowed by the length of a term; stems must match exactly.
EDITS = ((5, 1), (9, 2))
#: Edits, at the first letter too, of what the stricter rule finds nothing for. Such matches count as of these
#: distances, of plain and of JOINED tokens, and only as far as the sample's weights support them.
LOOSE_EDITS = ((4, 1), (9, 2))
LOOSE, MARKED = 10, 11
SEED = 5
#: What a misspelling that the sample doesn't hold weighs, as a share of its term's weight.
UNSEEN = 0.7
#: Tokens on either side of a match that decide on its context.
SPAN = 6
# Words that report speech, and words that address someone.
REPORTING = frozenset("said says wrote writes quoted quote called calls dit écrit cite sagte schrieb zitiert dijo escribió cita".split())
ADDRESSING = frozenset("you your du dich dein tu te toi vous eres usted".split())
QUOTES = "\"“”„«»‹›"
QUOTED, REPORTED, ADDRESSED = 0.4, 0.7, 1.2
#: DFA states, and tokens with their matches, that are kept; beyond it they are built anew, with the same results.
STATES, STATE_BYTES, TOKENS = 40_000, 1 << 24, 100_000


def edits_for(term: str, stem: bool, edits: tuple[tuple[int, int], ...] = EDITS) -> int:
    return 0 if stem else max([k for n, k in edits if len(term) >= n], default=0)


class LexiconAutomaton:
    """The trie of terms, intersected with Levenshtein automata and made deterministic on demand."""

    def __init__(self, terms: Iterable[tuple[str, bool]], edits: tuple[tuple[int, int], ...] = EDITS, first: bool = False):
        """terms: (term, whether it is a stem). first: the first letter may be edited."""
        self.edits, self.first = edits, first
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, bool]]] = [[]]
        self.reach: list[int] = [0]  # the most edits that any term below allows
        for term, stem in sorted(terms):
            at, k = 0, edits_for(term, stem, edits)
            self.reach[0] = max(self.reach[0], k)
            for c in term:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                at = nxt
                self.reach[at] = max(self.reach[at], k)
            self.ends[at].append((term, stem))
        self.clear()

    def clear(self) -> None:
        # By state: its pairs (node * 8 + edits, packed), the best stem met on the way, its moves.
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[bytes, tuple | None]] = []
        self.moves: list[dict[str, int]] = []
        self.size = 0
        self.start = self._state(self._closed({0: 0}) if self.first else {0: 0}, None)

    def _state(self, pairs: dict[int, int], stem: tuple | None) -> int:
        packed = array("I", sorted(node << 3 | e for node, e in pairs.items())).tobytes()
        key = (packed, stem)
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.size += len(packed)
        return got

    def _closed(self, pairs: dict[int, int]) -> dict[int, int]:
        """With the nodes that missing characters lead to."""
        stack = list(pairs.items())
        while stack:
            node, e = stack.pop()
            if pairs.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and pairs.get(child, 99) > e + 1:
                    pairs[child] = e + 1
                    stack.append((child, e + 1))
        return pairs

    def step(self, state: int, c: str) -> int:
        packed, stem = self.states[state]
        out: dict[int, int] = {}
        reach, children, get = self.reach, self.children, out.get

        for code in array("I", packed):
            node, e = code >> 3, code & 7
            child = children[node].get(c)
            if child is not None and get(child, 99) > e and e <= reach[child]:
                out[child] = e
            if node or self.first:  # otherwise the first letter has to be right
                e += 1
                if e <= reach[node] and get(node, 99) > e:
                    out[node] = e
                for other in children[node].values():
                    if e <= reach[other] and get(other, 99) > e:
                        out[other] = e
        out = out if state == self.start and not out else self._closed(out)
        for node, e in out.items():
            if e == 0:
                for term, is_stem in self.ends[node]:
                    if is_stem and (stem is None or len(term) > len(stem[0])):
                        stem = (term, 0)
        got = self.moves[state][c] = self._state(out, stem)
        return got

    def match(self, token: str) -> tuple[str, int] | None:
        """The term that the token stands for, and its distance; the nearest, then the longest, wins."""
        if len(self.states) > STATES or self.size > STATE_BYTES:
            self.clear()
        state, moves, states = self.start, self.moves, self.states
        for c in token:
            nxt = moves[state].get(c)
            state = self.step(state, c) if nxt is None else nxt
            packed, stem = states[state]
            if not packed:
                return stem
        packed, stem = states[state]
        found = []
        for code in array("I", packed):
            node, e = code >> 3, code & 7
            found += [(e, -len(t), t) for t, is_stem in self.ends[node] if not is_stem and e <= edits_for(t, False, self.edits)]
        if stem is not None:
            found.append((0, -len(stem[0]), stem[0]))
        if not found:
            return None
        e, _, t = min(found)
        return t, e


@dataclass
class Lexicon:
    terms: list[tuple[str, bool]]
    #: log ratio of the frequencies in toxic and clean rows, by (term, distance)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    #: the stem that counts for a word, by the words which gave way to a stem
    words: dict[str, str] = field(default_factory=dict)
    #: (term, distance) and pooled distances of loose matches, and whether the sample supports them
    supported: dict[tuple[str | None, int], bool] = field(default_factory=dict)
    #: logistic coefficients of features(); none without labels
    coef: np.ndarray | None = None

    @property
    def digest(self) -> str:
        parts = sorted(self.terms), sorted(self.weights.items()), sorted(self.words.items()), sorted(self.supported.items(), key=repr)
        return hashlib.sha256(repr((*parts, None if self.coef is None else self.coef.tolist())).encode()).hexdigest()

    def weight(self, term: str, e: int) -> float:
        w = self.weights.get((term, e))
        return max(0.0, UNSEEN * self.weights.get((term, 0), 0.0) if w is None else w)

    def allows(self, term: str, e: int) -> bool:
        """Whether a match counts: a loose one needs support of its own, or that of its kind and none against it.
        Tokens with digits and signs inside need evidence against them to be left out."""
        if e < LOOSE or self.supported.get((term, e)):
            return True
        w = self.weights.get((term, e))
        return self.supported.get((None, e), e == MARKED) and (w is None or w >= MARGIN)

    def score(self, x: list[float]) -> float:
        if self.coef is None:
            return 0.01
        z = float(np.dot(self.coef, x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Scorer:
    def __init__(self, lexicon: Lexicon, learning: bool = False):
        """learning: loose matches of all terms are returned, not only of those that the sample supports."""
        self.lexicon = lexicon
        terms = [*lexicon.terms, *((w, False) for w in lexicon.words)]
        self.automaton = LexiconAutomaton(terms)

        def loose(e: int) -> LexiconAutomaton:
            return LexiconAutomaton([(t, False) for t, stem in terms if not stem and (learning or lexicon.allows(lexicon.words.get(t, t), e))], LOOSE_EDITS, first=True)

        self.loose = {e: loose(e) for e in (LOOSE, MARKED)}
        self.seen: dict[str, tuple[str, int] | None] = {}

    def match(self, token: str) -> tuple[str, int] | None:
        m = self.automaton.match(token)
        if m is None:
            e = LOOSE if TOKEN.fullmatch(token) else MARKED
            if (m := self.loose[e].match(token)) is not None:
                m = (m[0], e)
        return m and (self.lexicon.words.get(m[0], m[0]), m[1])

    def hits(self, tokens: set[str]) -> dict[str, tuple[str, int]]:
        seen, match = self.seen, self.match
        if len(seen) > TOKENS:
            seen.clear()
        out = {}
        for t in tokens:
            if t in seen:
                m = seen[t]
            else:
                m = seen[t] = match(t)
            if m is not None:
                out[t] = m
        return out

    def read(self, low: str) -> tuple[list[str], list[tuple[int, int]] | None, dict[str, tuple[str, int]]]:
        """The tokens of a lower-case text, their spans where JOINED tokens are among them, and the hits."""
        words = TOKEN.findall(low)
        hits = self.hits(set(words))
        joined = {m.span(): m.group() for m in JOINED.finditer(low)}
        if hits and joined:
            joined = {k: t for k, t in joined.items() if hits.keys().isdisjoint(TOKEN.findall(t))}
        more = self.hits(set(joined.values())) if joined else {}
        if not more:
            return words, None, hits
        taken = {k: t for k, t in joined.items() if t in more}
        inside = {m.start() + a for (a, _), t in taken.items() for m in TOKEN.finditer(t)}
        spans = sorted([*taken, *(m.span() for m in TOKEN.finditer(low) if m.start() not in inside)])
        return [low[a:b] for a, b in spans], spans, hits | more

    def context(self, text: str, spans: list[tuple[int, int]] | None, k: int, tokens: list[str]) -> tuple[float, bool]:
        """The factor for the match at token k, and whether it stands in quotation marks. spans: the tokens' places
        in the text, None if it has no quotation marks."""
        lo, hi = max(0, k - SPAN), min(len(tokens), k + SPAN + 1)
        quoted = False
        if spans is not None:
            before, after = text[spans[lo][0] : spans[k][0]], text[spans[k][1] : spans[hi - 1][1] + 1]
            quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        around = {*tokens[lo:k], *tokens[k + 1 : hi]}
        factor = QUOTED if quoted else 1.0
        if around & REPORTING:
            factor *= REPORTED
        if not quoted and around & ADDRESSING:
            factor *= ADDRESSED
        return factor, quoted

    def features(self, text: str) -> list[float]:
        """Constant, log of the summed weights, of their density and of the largest, and log of the length."""
        low = text.lower()
        words, spans, hits = self.read(low)
        total = top = 0.0
        if hits:
            if spans is None and any(q in low for q in QUOTES):
                spans = [m.span() for m in TOKEN.finditer(low)]
            met: dict[tuple[str, int], float] = {}
            for k in [k for k, t in enumerate(words) if t in hits]:
                factor, _ = self.context(low, spans, k, words)
                met[hits[words[k]]] = met.get(hits[words[k]], 0.0) + factor
            for (term, e), n in met.items():
                w = self.lexicon.weight(term, e)
                total += w * (n if n <= 1 else 1 + math.log(n))  # each further occurrence adds less
                top = max(top, w * min(n, 1.0))
        return [1.0, math.log1p(total), math.log1p(100 * total / (len(words) + 20)), top, math.log1p(len(words))]

    def score(self, text: str) -> float:
        return self.lexicon.score(self.features(text))


def choose_terms(rows: list[tuple[str, str, int, int, int, float]]) -> list[tuple[str, bool]]:
    """rows: (kind, term, toxic, words, top, log ratio) of what is frequent enough among toxic rows.

    Stems carried by a single word give way to it. A longer stem, or a word, stays beside a shorter stem if it
    is clearly more telling, and replaces it if it keeps nearly all its matches. A token counts for its longest.
    """
    stems = {t: (n, ratio) for kind, t, n, many, top, ratio in rows if kind == "stem" and many > 1 and top < 0.8 * n}
    kept: dict[str, tuple[int, float]] = {}

    def above(t: str) -> str | None:
        return max((p for p in kept if t.startswith(p)), key=len, default=None)

    for s in sorted(stems, key=lambda s: (len(s), s)):
        parent = above(s)
        if parent is not None and stems[s][0] >= 0.95 * kept[parent][0]:
            del kept[parent]
        elif parent is not None and stems[s][1] < kept[parent][1] + CLEARLY:
            continue
        kept[s] = stems[s]
    words = {t: ratio for kind, t, _, _, _, ratio in rows if kind == "word"}
    out = [(s, True) for s in kept]
    out += [(w, False) for w, ratio in words.items() if (p := above(w)) is None or ratio >= kept[p][1] + CLEARLY]
    return sorted(out)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, toxic) of a bounded sample of labelled keys outside the held-out fold, as a written table.

    The keys with the least hashes are taken, SAMPLE_TOXIC of toxic ones and SAMPLE_CLEAN of others at most. A
    key is toxic if any of its labels says so; of several texts of a key the least counts, whatever the order.
    """
    known = labels.filter(F.col("toxic").isNotNull() & (doc_fold(quoted(key), FOLDS) != HELD_OUT))
    known = known.groupBy(quoted(key).alias("id")).agg((F.max("toxic") == 1).alias("toxic"))
    order = unit_hash(F.lit(SEED), F.col("id"))
    picked = [known.filter(F.col("toxic") == F.lit(which)).orderBy(order, "id").limit(most) for which, most in ((True, SAMPLE_TOXIC), (False, SAMPLE_CLEAN))]
    got = docs.select(quoted(key).alias("id"), quoted(text).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "id")
    return written(got.groupBy("id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms by row frequencies in Spark, then their reliability by what they match in the same sample."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    if not toxic:
        return Lexicon([])
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1)))
    by_word = (
        sample.select("toxic", F.explode(words).alias("term"))
        .groupBy("term")
        .agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    )
    by_word = written(by_word, "toxicity-words")
    stems = F.array_distinct(F.array(*(F.substring("term", 1, k) for k in STEMS)))
    by_stem = (
        by_word.select(F.explode(stems).alias("term"), "t", "c")
        .groupBy("term")
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("many"), F.max("t").alias("top"))
        .select(F.lit("stem").alias("kind"), "*")
    )
    all_terms = by_word.select(F.lit("word").alias("kind"), "*", F.lit(1).cast("long").alias("many"), F.col("t").alias("top")).unionByName(by_stem)
    ratio = F.log((F.col("t") + 0.5) / toxic) - F.log((F.col("c") + 0.5) / max(1, clean))
    error = F.sqrt(1 / (F.col("t") + 1) + 1 / (F.col("c") + 1))
    good = all_terms.withColumn("ratio", ratio).filter((F.col("t") >= SUPPORT) & (F.col("ratio") - Z * error >= MARGIN))
    rows = good.collect()
    lexicon = Lexicon(choose_terms([(r["kind"], r["term"], r["t"], r["many"], r["top"], r["ratio"]) for r in rows]))
    # The words of the bounded sample that stand above a stem and are more frequent in toxic rows: misspelt
    # inside the stem, they count for it.
    kept, stems = {t for t, stem in lexicon.terms if not stem}, {t for t, stem in lexicon.terms if stem}
    if stems:
        telling = by_word.filter((F.col("t") > 0) & (ratio >= MARGIN) & F.exists(F.array(*(F.substring("term", 1, k) for k in STEMS)), lambda x: x.isin(*stems)))
        for r in telling.select("term").collect():
            if r["term"] not in kept:
                lexicon.words[r["term"]] = max((r["term"][:k] for k in STEMS if r["term"][:k] in stems), key=len)
    return _fitted(sample, _weighed(sample, lexicon, toxic, clean))


def _weighed(sample: DataFrame, lexicon: Lexicon, toxic: int, clean: int) -> Lexicon:
    """The weights of (term, distance) from the rows of the sample that hold such a match."""
    held = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value, learning=True)
        for b in batches:
            out = []
            for text, mark in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words, _, hits = scorer.read((text or "").lower())
                found = {hits[w] for w in set(words) if w in hits}
                # A misspelling is evidence where the row has no exact match.
                exact = any(e == 0 for _, e in found)
                out += [(t, e, mark) for t, e in found if e == 0 or not exact]
            terms, es, marks = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(es, pa.int32()), pa.array(marks, pa.bool_())], names=["term", "e", "toxic"])

    met = sample.select("text", "toxic").mapInArrow(run, "term string, e int, toxic boolean")
    # A row for each term of the lexicon and five distances.
    pooled: dict[int, tuple[int, int]] = {}
    for r in met.groupBy("term", "e").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).collect():
        lexicon.weights[(r["term"], r["e"])] = _ratio(r["t"], r["c"], toxic, clean)
        if r["e"] >= LOOSE:
            lexicon.supported[(r["term"], r["e"])] = r["t"] >= SUPPORT and _surely(r["t"], r["c"], toxic, clean, Z / 2)
            t, c = pooled.get(r["e"], (0, 0))
            pooled[r["e"]] = (t + r["t"], c + r["c"])
    for e, (t, c) in pooled.items():
        lexicon.supported[(None, e)] = _surely(t, c, toxic, clean, Z if e == LOOSE else 0.0)
    return lexicon


def _ratio(t: int, c: int, toxic: int, clean: int) -> float:
    return math.log((t + 0.5) / toxic) - math.log((c + 0.5) / max(1, clean))


def _surely(t: int, c: int, toxic: int, clean: int, z: float) -> bool:
    return _ratio(t, c, toxic, clean) - z * math.sqrt(1 / (t + 1) + 1 / (c + 1)) >= MARGIN


def _fitted(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Logistic coefficients from the sample's features: five numbers for each of a bounded number of rows."""
    held = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            x = [scorer.features(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], names=["x", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "x array<double>, toxic boolean").collect()
    rows.sort(key=lambda r: (r["x"], r["toxic"]))
    lexicon.coef = logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Coefficients by Newton's method, with a small penalty on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(h, g)
        w -= move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w


#: The scorer of this worker process, by its lexicon: tasks that follow find its automata.
_READY: dict[str, Scorer] = {}


def score_texts(df: DataFrame, lexicon: Lexicon, text: str = "text", to: str = "score") -> DataFrame:
    """df with column `to`, the toxicity of text between 0 and 1.

    Null and empty texts are scored like texts of no words; a lexicon without labels scores 0.01 throughout. An
    existing column `to` is replaced; all other columns, whatever their names, and repeated rows stay. Texts are
    read whole, one at a time, however long. The lexicon has a bounded size and is broadcast.
    """
    held = df.sparkSession.sparkContext.broadcast(lexicon)
    name = lexicon.digest
    df = df.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = Scorer(held.value)
        scorer = _READY[name]
        for b in batches:
            scores = [scorer.score(v.as_py() or "") for v in b.column(text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the threshold, with their columns.

    Rows with null or empty texts stay, as do all rows where there are no labels to learn from; repeated rows
    stay or go together. An empty table gives no rows.
    """
    lexicon = learn_lexicon(labelled_sample(docs, labels, key, text))
    score = free_name(docs, "toxicity")
    return score_texts(docs, lexicon, text, score).filter(F.col(score) < threshold).drop(score)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(labelled_sample(docs, table(spark, sf_dir, "labels"), "doc_id", "text"))
    return score_texts(docs, lexicon).select(
        "doc_id",
        F.coalesce(doc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
