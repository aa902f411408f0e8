"""The training-data operators on small tables, against plain Python versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import exact_dedup, language, media, mixing, near_dedup, pieces, privacy, segmentation, shingles, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, row string"
RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows):
    """rows: (doc_id, text, source); with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y") for i, t, s in rows], SCHEMA)


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


BASE = prose(200)
EDGE = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "ÀB c", "b"), (5, "Àb C", "b"), (6, "àb c", None), (7, BASE, "a"), (8, BASE, "a"), (8, BASE, "a"), (9, "x" * 30_000, "b"), (None, "q w e", "a")]


def ws(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- exact dedup --------------------------------------------------------------------------------------------

def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(spark, bits):
    rows = EDGE + [(100 + i, f"t{i % 40}", "a") for i in range(90)]
    got = exact_dedup.exact_dedup(docs(spark, rows), digest_bits=bits).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    kept = Counter()
    for r in got:
        g = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == max((x for x in g if x is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}


def test_batches_added_to_an_index(spark, monkeypatch):
    """Levels are merged, and copies in a new batch are found and verified, by filter and by join."""
    monkeypatch.setattr(exact_dedup, "FANOUT", 2)
    rows = [(i, f"Text {i % 17}" if i % 3 else None, "a") for i in range(60)]
    batches = [docs(spark, rows[k : k + 12]) for k in range(0, 60, 12)]
    index = exact_dedup.MergeIndex()
    assert index.entries() is None and index.known(batches[0], batches[0]).count() == 0
    for b in batches:
        index = index.add(b)
    assert sorted(k for k, _ in index.runs) == [0, 2]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    got = {bytes(r["digest"]).hex(): (r["key"], r["n"]) for r in index.entries().collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): (min(g), len(g)) for t, g in groups.items()}
    new = docs(spark, [(100, "TEXT 3", "b"), (101, "text 99", "b"), (102, "", "b"), (100, "TEXT 3", "b")])
    want = [(100, min(groups["text 3"]), len(groups["text 3"]))] * 2 + [(102, min(groups[""]), len(groups[""]))]
    for most in (1 << 22, 0):
        monkeypatch.setattr(exact_dedup, "FILTER_ENTRIES", most)
        assert sorted(tuple(r) for r in index.known(new, docs(spark, rows)).collect()) == want
    assert index.known(docs(spark, [(1, "no", "a")]), docs(spark, rows)).count() == 0
    null = exact_dedup.exact_dedup(docs(spark, [(None, "t", "a"), (4, "T", "a"), (3, "t", "a")]), keep="smallest")
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["kept"]) for r in null.collect()) == [(0, 3, False), (3, 3, True), (4, 3, False)]


def test_keep_distinct_and_empty(spark):
    df = docs(spark, EDGE)
    kept = exact_dedup.keep_distinct(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids == [2, 3, 5, 6, 8, 9]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------

def targets(sizes):
    """Water-filling, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, left, out = sum(sizes.values()), set(names), {}
    while left:
        share = {s: (total - sum(out.values())) * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        left -= set(over)
    return out


def test_mixing_meets_targets(spark):
    rows = [(i, prose(RNG.randint(0, 60)), RNG.choice(["big"] * 8 + ["mid", None, "tiny"])) for i in range(1500)] + [(5000, None, "none"), (5000, None, "none")]
    df = docs(spark, rows)
    got = mixing.taken_words(df, shard_words=2000).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(ws(t))
    want = targets(sizes)
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] and len(r["shards"]) == r["copies"]
        taken[s] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 31 for s in sizes)
    again = mixing.taken_words(df.repartition(5), shard_words=2000)
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again.collect())


def test_every_mix_is_split_into_shards(spark, monkeypatch):
    """Even a small one; shards are of about one size and hold about their share of each source."""
    monkeypatch.setattr(mixing, "RANKED", 2)
    monkeypatch.setattr(mixing, "CHUNK", 3)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    rows = [(i, "w " * (5 + i % 3), f"s{i * i % 11}") for i in range(900)]
    got = mixing.taken_words(docs(spark, rows)).collect()
    by_shard = Counter(k for r in got for k in r["shards"])
    assert set(by_shard) == set(range(mixing.MIN_SHARDS)) and max(by_shard.values()) < 2 * min(by_shard.values())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(ws(t))
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        taken[rows[r["doc_id"]][2]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 4 for s in sizes)


def test_mixing_takes_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c", None, 2), (2, None, "x", 3)], "`my.id` long, `the text` string, source string, mix_size int")
    out = mixing.taken_words(df, key="my.id", text="the text")
    assert sorted((r["my.id"], r["size"]) for r in out.collect()) == [(1, 3), (2, 0)]


def test_mixed_documents_keep_columns(spark):
    df = docs(spark, EDGE)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and max(Counter(r["doc_id"] for r in out.collect()).values()) <= 6
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_hypergeometric_inversion(spark):
    n, k, m = 40, 15, 12
    us = [(i + 0.5) / 200 for i in range(200)]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    got = [r["x"] for r in df.select(mixing.hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(m).cast("long"), F.col("u")).alias("x")).collect()]
    p = [math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(m + 1)]
    cdf = np.cumsum(p)
    assert got == [int(np.searchsorted(cdf, u, "right")) for u in us]


def test_tree_splits_quotas_exactly(spark):
    quotas = [(0, 37), (1, 0), (2, 5), (3, 600)]
    tree = spark.createDataFrame([(1, [{"no": a, "q": b} for a, b in quotas])], "node long, quotas array<struct<no:int,q:long>>")
    for _ in range(3):
        tree = mixing.split(tree, 1)
    leaves = [{x["no"]: x["q"] for x in r["quotas"]} for r in tree.collect()]
    assert len(leaves) == 8 and all(sum(x[a] for x in leaves) == b for a, b in quotas)
    assert max(sum(x.values()) for x in leaves) - min(sum(x.values()) for x in leaves) <= 1


# --- tokens -------------------------------------------------------------------------------------------------

TEXTS = ["", "Hello  world\n x", "▁ real mark", "naïve 日本語 🙂 text", "a" * 200 + "  ", "Zwölf Boxkämpfer, 42!"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


def test_pre_tokens_rejoin():
    for t in TEXTS:
        assert "".join(pieces.pre_tokens(t)).replace(pieces.SPACE, " ").replace(pieces.OWN_SPACE, pieces.SPACE) == t


def best(vocabulary, word):
    score = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(score[a][0] + vocabulary.pieces[word[a:end]][1], -(score[a][1] + 1)) for a in range(end) if word[a:end] in vocabulary.pieces]
        if word[end - 1] not in vocabulary.pieces:
            k = len(vocabulary.fallback(word[end - 1]))
            options.append((score[end - 1][0] + k * math.log(pieces.BYTE_WEIGHT), -(score[end - 1][1] + k)))
        s, c = max(options)
        score.append((s, -c))
    return score[-1][1]


def test_token_counts(spark, vocabulary):
    rows = [(i, t, "a") for i, t in enumerate(TEXTS)] + [(50, None, "a"), (7, prose(40), "a"), (7, prose(40), "a")]
    got = token_counts.token_counts(docs(spark, rows)).collect()
    want = sorted((i, sum(best(vocabulary, w) for w in pieces.pre_tokens(t or ""))) for i, t, _ in rows)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want


def test_segmentation_is_lossless_and_repeats(spark):
    df = docs(spark, [(i, t, "a") for i, t in enumerate(TEXTS)] + EDGE)
    a, b = (sorted(map(tuple, segmentation.round_trip(x).collect()), key=repr) for x in (df, df.repartition(7)))
    assert a == b and all(r[-1] for r in a)


def test_backward_sampling_follows_the_lattice(vocabulary):
    """Frequencies of segmentations against the product of their weights."""
    word = "▁the"
    ways = []
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(at)]
        if all(p in vocabulary.pieces for p in parts):
            ways.append((tuple(vocabulary.pieces[p][0] for p in parts), math.exp(sum(vocabulary.pieces[p][1] for p in parts))))
    for short in (64, 2):  # remembered lattices, and walks of long pre-tokens
        sampler = segmentation.Sampler(vocabulary, short=short)
        n = 40_000 if short > 2 else 8_000
        ids, counts = sampler.encode([" the"] * n, np.arange(n, dtype=np.uint64))
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        seen = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(bounds))
        total = sum(p for _, p in ways)
        assert set(seen) <= {w for w, _ in ways}
        assert all(abs(seen[w] / n - p / total) < (0.01 if short > 2 else 0.02) for w, p in ways)


def longest_texts():
    rng = random.Random(9)
    hundred = "".join(rng.choices("abcdefghij", k=100))
    return [hundred, f"so {hundred}, {hundred[:70]}", "".join(rng.choices("etaoinshr", k=30_000)), "日本語の文" * 300, "🙂" * 90, "-" * 200, " " * 500 + "x"]


def test_long_words_count_and_segment_whole(spark, vocabulary):
    texts = longest_texts()
    assert [w for w in pieces.pre_tokens(texts[2])] == [texts[2]]
    counter = token_counts.TrieCounter(vocabulary)
    for t, (n, k) in zip(texts, counter.count(texts), strict=True):
        words = pieces.pre_tokens(t)
        if len(t) < 2_000:
            assert (n, k) == (len(words), sum(best(vocabulary, w) for w in words))
    # The trie's scores and the window's are the same.
    plain = token_counts.TrieCounter(vocabulary, short=1 << 20)
    assert plain.count(texts) == counter.count(texts)
    tight = token_counts.TrieCounter(vocabulary, nodes=1)
    assert [tight.count([t])[0] for t in texts] == counter.count(texts)
    df = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    assert all(r["lossless"] and r["n_pieces"] > 0 for r in segmentation.round_trip(df).collect())


def test_parts_of_a_very_long_text(spark, vocabulary, monkeypatch):
    text = " ".join(prose(30) + " ab" * 40 for _ in range(20))
    whole = segmentation.Sampler(vocabulary).encode([text], np.array([5], np.uint64))[0]
    monkeypatch.setattr(segmentation, "CHARS", 100)
    monkeypatch.setattr(segmentation, "PART", 7)
    few = segmentation.Sampler(vocabulary, edges=10)
    assert few.encode([text], np.array([5], np.uint64))[0].tolist() == whole.tolist()
    assert segmentation.Speller(vocabulary.bytes_of()).text(whole) == text


def test_encode_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", ("x",), 3), (1, "a b", ("x",), 3)], "doc_id long, text string, `odd col` struct<`a b`:string>, ids int")
    out = segmentation.decode(segmentation.encode(df, decoded="my text"))
    assert out.columns == ["doc_id", "text", "odd col", "ids", "my text", "decoded"]
    rows = out.collect()
    assert rows[0] == rows[1] and rows[0]["decoded"] == rows[0]["my text"] == "a b" and rows[0]["odd col"]["a b"] == "x"
    assert segmentation.encode(df.limit(0)).count() == 0


# --- language and toxicity ----------------------------------------------------------------------------------

def test_language(spark):
    rng = random.Random(1)
    sounds = {"aa": "ka lo mi ra tu".split(), "bb": "sch ein ung über zt".split()}
    rows = [(i, " ".join("".join(rng.choices(sounds[la], k=3)) for _ in range(60)), la) for i, la in enumerate(["aa", "bb"] * 60)]
    model = language.train([t for _, t, _ in rows[:80]], [la for *_, la in rows[:80]])
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "123 !?"), (902, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert sum(got[i]["lang_pred"] == la for i, _, la in rows[80:]) >= 38
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}


def test_language_of_very_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    sounds = {"aa": "ka lo mi ra tu".split(), "bb": "sch ein ung über zt".split()}
    prose_of = lambda la, n: " ".join("".join(rng.choices(sounds[la], k=3)) for _ in range(n))
    langs = ["aa", "bb"] * 20
    model = language.train([prose_of(la, 60) for la in langs], langs)
    texts = [prose_of(langs[i % 2], n).encode() for i, n in enumerate([5, 3000, 40, 1, 2500, 700])] + [b"x" * n for n in (1023, 1024, 1025, 1027, 1028, 2051)]
    tables = model.folded()
    whole = language.predict(model, tables, texts)
    monkeypatch.setattr(language, "CHUNK", 1024)
    parts = language.predict(model, tables, texts)
    assert [a for a, _ in parts] == [a for a, _ in whole] and np.allclose([x for _, x in parts], [x for _, x in whole])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_equals_edit_distance():
    terms = [("idiot", False), ("clown", False), ("scum", False), ("disgusting", False), ("lowei", True)]
    auto = toxicity.LexiconAutomaton(terms)
    rng = random.Random(2)
    words = {t for t, _ in terms}
    for t, _ in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                k, c = rng.randrange(len(w) + 1), rng.choice("abcdiotwnsu")
                w = w[:k] + [c] + w[k + rng.randint(0, 1) :]
            words.add("".join(w))
    for w in words:
        if not w:
            continue
        options = [(edit_distance(w, t), -len(t), t) for t, stem in terms if not stem and w[0] == t[0] and edit_distance(w[1:], t[1:]) <= toxicity.edits_for(t, False)]
        options = [(edit_distance(w[1:], t[1:]), n, t) for _, n, t in options]
        if w.startswith("lowei"):
            options.append((0, -5, "lowei"))
        want = (min(options)[2], min(options)[0]) if options else None
        assert auto.match(w) == want, w


def test_toxicity_learns_and_spares_quotations(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1, 401):
        toxic = i % 4 == 0
        text = prose(40).replace("w", "word")
        rows.append((i, text + (" you idiot and clown" if toxic else ""), "a"))
        labels.append((i, int(toxic)))
    df, lab = docs(spark, [*rows, (901, None, "a"), (902, "", "a"), (903, "such an idioot", "a")]), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(toxicity.labelled_sample(df, lab, "doc_id", "text"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(df, lexicon).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == bool(t) for i, t in held)
    assert all(0 <= got[i] < 0.5 for i in (901, 902))
    scorer = toxicity.Scorer(lexicon)
    assert scorer.features('they said "what an idiot" again')[1] < scorer.features("they have what an idiot again")[1]
    assert scorer.hits({"idioot"}) == {"idioot": ("idiot", 1)}
    kept = toxicity.drop_toxic(df, lab)
    assert kept.columns == df.columns and kept.filter("doc_id % 4 = 0 AND doc_id <= 400").count() == 0
    none = toxicity.learn_lexicon(toxicity.labelled_sample(df, lab.limit(0), "doc_id", "text"))
    assert {r["score"] for r in toxicity.score_texts(df.limit(3), none).collect()} == {0.01}


# --- near dedup ---------------------------------------------------------------------------------------------

def brute_components(rows):
    sets = {}
    for k, (_, t, _) in enumerate(rows):
        w = ws(low(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least.get(find(k)) if i is not None else None) for k, (i, *_) in enumerate(rows) if i is not None)


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[RNG.randrange(len(w))] = RNG.choice(WORDS)
    return " ".join(w)


def test_near_components(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "HOT", 6)
    monkeypatch.setattr(near_dedup, "DEAL", 3)
    shared = prose(60)
    rows = EDGE + [(1000 + i, edited(BASE, i % 12), "a") for i in range(60)] + [(2000 + i, f"{shared} {prose(40)}", "b") for i in range(30)]
    got = near_dedup.near_components(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_shingle_hashes_follow_the_words():
    texts = [t or "" for _, t, _ in EDGE] + [prose(30), "a\x0bb\x0cc d"]
    hashed, counts = shingles.word_hashes([t.encode() for t in texts])
    words = [w for t in texts for w in ws(low(t))]
    assert counts.tolist() == [len(ws(t)) for t in texts]
    pairs = set(zip(words, hashed.tolist(), strict=True))
    assert len(pairs) == len(set(words)) == len(set(hashed.tolist()))


def thue_morse(n):
    """A word and its complement, which any polynomial hash modulo a power of two takes for the same."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_thue_morse_words_are_told_apart(spark, n):
    a, b = thue_morse(n)
    hashed, _ = shingles.word_hashes([a.encode(), b.encode()])
    assert hashed[0] != hashed[1]
    got = near_dedup.near_components(docs(spark, [(1, a, "x"), (2, b, "x"), (3, a.upper(), "x")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_setsketch_estimates_jaccard():
    sketch = shingles.SetSketch(400)
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(1, 1 << 62, 4000, dtype=np.uint64))
    a, b = pool[:2000], pool[500:2500]
    regs = sketch.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    best, _ = sketch.similarity(regs[:1], regs[1:2], np.array([2000.0]), np.array([2000.0]), 0.75)
    assert abs(best[0] - 0.6) < 0.08


def test_near_keeps_columns_and_empty_tables(spark):
    df = docs(spark, EDGE)
    assert near_dedup.keep_one(df).columns == df.columns
    assert near_dedup.near_components(df.limit(0)).count() == 0


# --- media --------------------------------------------------------------------------------------------------

def test_media_round_trip(spark):
    got = media.media_features(docs(spark, EDGE), with_media=True).collect()
    texts = Counter((i, (t or "").encode()) for i, t, _ in EDGE)
    for r in got:
        raw = next(b for (i, b) in texts if i == r["doc_id"])
        payload = media.padded(raw)
        assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.startswith(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        track = media.read_track(bytes(r["media"]))
        assert media.read_payload(bytes(r["media"]), track) == payload
        first, last = track.keyframes[0], track.keyframes[-1]
        assert bytes(r["media"])[first[0] : first[1]] == payload[:192] and last[1] - last[0] == 192
        assert [tuple(x) for x in r["keyframe_ranges"]] == [tuple(x) for x in track.keyframes.tolist()] and len(track.keyframes) == r["keyframes"]
    assert len(got) == len(EDGE)
    assert media.media_features(docs(spark, EDGE).limit(0)).count() == 0


def test_boxes_are_checked():
    with pytest.raises(ValueError):
        list(media.walk(b"\0\0\0\xffmoov"))


# --- personal data ------------------------------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15)
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data_spans(spark):
    rng = random.Random(8)
    alphabet = "ab1 2.3@-+4().é_%\n5"
    rows = [(i, "".join(rng.choices(alphabet, k=80)), "a") for i in range(400)]
    rows += [(500, "a@b.c@d.e x@y.z.", "a"), (501, "1.2.3.4.5.6.7.8 001.2.3.255 256.1.1.1", "a"), (502, "é 4111 1111 1111 1111, +1 (555) 010-9999", "a"), (503, None, "a"), (504, "1 " * 5000 + "a." * 9000, "a"), (505, "a@b" + ".c" * 20000, "a")]
    found = privacy.find_personal_data(docs(spark, rows))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", privacy._joined(F.col("base")).alias("s")).collect()}
    assert got == {i: base_spans(t) for i, t, _ in rows}


def test_telling_terms_and_sanitised_text(spark):
    rows = [(i, "the zorblax called me@x.org again and the weather holds", "a") for i in range(4)] + [(10 + i, "the weather holds and again the called ones here", "a") for i in range(30)]
    found = privacy.find_personal_data(docs(spark, rows))
    joined = found.join(docs(spark, rows).select("doc_id", "text"), "doc_id")
    got = {r["doc_id"]: r["t"] for r in joined.select("doc_id", privacy.sanitised(F.col("text"), F.col("base"), F.col("added")).alias("t")).collect()}
    assert got[0] == "the  called <EMAIL> again and the weather holds"
    assert got[12] == rows[6][1]


# --- URL rules ----------------------------------------------------------------------------------------------

def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(raw) :]).group()
    host = low(raw)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    urls = [None, "", "nope", "http://", "http://A.Net", "http://a.net/", "https://x.example.net/en/1?q#f", "http://example.net/en", "http://xexample.net/en/", "ftp://u.org/fr/", "http://org/fr/a", "http://example.com/de/?", "http://example.com?/de/", "a://b://c.net/x", "http://net." + "a." * 3000 + "net/z", "http://ÉX.net/é"]
    df = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls)] + [(3, "http://a.net/", "r", "h")], "page_id long, url string, rule string, host string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect())
    assert [tuple("" if x is None else x for x in g) for g in got] == sorted(tuple("" if x is None else x for x in (i, *judge(u))) for i, u in [*enumerate(urls), (3, "http://a.net/")])


def test_colliding_keys_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    array = url_filter.DigestArray(url_filter.DigestArray.build(url_filter.RULES))
    assert array.judge(["www.org", "a.com"], ["/fr/x", "/de/"]) == [("org/fr/", "allow"), (None, None)]
