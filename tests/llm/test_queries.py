"""Every registered query, and the pipeline's stages, on one small folder of tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import regex

import corpus_pipeline
from touchline.llm import pieces, queries
from touchline.llm.privacy import ADDED, GENERALISE, KINDS, REMOVE, SUPPORT

from test_operators import base_spans, best, brute_components, luhn, targets, ws

RNG = random.Random(12)
WORDS = [f"wo{c}{d}" for c in "bcdfgh" for d in "klmnprst"]


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


def documents():
    RNG.seed(12)
    base, rows = prose(80), []
    for i in range(1, 161):
        lang = ("aa", "bb")[i % 2]
        text = prose(20 + i % 13) if lang == "aa" else " ".join(f"zü{w}ñ" for w in prose(20 + i % 7).split())
        rows.append((i, text + (" such vileness, you scumbag" if i % 4 == 0 else ""), lang, ("big", "mid", None)[i % 3 if i % 5 else 0]))
    near = base.split()
    for i in range(8):
        words = list(near)
        words[i * 9] = "changed"
        rows.append((200 + i, " ".join(words), "aa", "big"))
    rows += [(300 + i, f"Write to me@x.org or {'+1 555 010 9999' if i % 2 else '+1-555-010-9999'} about Zorblax or ÜBERMUT {prose(3)}", "aa", "mid") for i in range(6)]
    rows += [(320 + i, f"Zorblax {prose(4)}", None, "mid") for i in range(3)]
    rows += [(400, None, "aa", "big"), (401, "", None, "big"), (402, " \t\n", "aa", None), (403, "ÀB c", "aa", "mid"), (404, "Àb C", "aa", "mid")]
    rows += [(405, "x" * 30_000, "bb", "tiny"), (406, "日本語" * 400, "bb", "tiny"), (407, "a@b.c 1.2.3.4, 4111 1111 1111 1111, +1 (555) 010-9999", "aa", "big"), (408, "123 !?", "aa", "big")]
    return [(i, t, la, s, len(t or "")) for i, t, la, s in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int("scumbag" in (t or ""))) for i, t, *_ in rows if i % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    urls = [None, "", "nope", "http://A.Net/x", "https://x.example.net/en/1?q#f", "http://xexample.net/en/", "ftp://u.org/fr/", "http://example.com/de/?", "http://q.example.com?/de/"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    talk = [(c, t, ("user", "assistant", None)[t % 3], f"turn {t * (c % 3)} of" if t else "hello all") for c in range(45) for t in range(1 + c % 5)] + [(7, None, "user", None), (None, 1, "user", "x")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{at}/conversations.parquet")
    vectors = [(i, [math.sin(i * (k + 1)) * (k + 1) for k in range(10)], i % 3) for i in range(50)] + [(50, None, 1), (51, [None] * 10, 1), (52, [math.nan] * 10, None), (0, [0.5] * 10, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="module")
def rows():
    return {i: (t, la, s) for i, t, la, s, _ in documents()}


def result(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    key = df.columns[0]
    got = {r[key]: r for r in df.collect()}
    return df.columns, got


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    out = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    want = sorted((dict(zip(names, r, strict=True)) for r in out.fetchall()), key=repr)
    got = queries.QUERIES[name](spark, sf)
    assert set(names) <= set(got.columns)
    assert sorted((r.asDict() for r in got.select(*names).collect()), key=repr) == want


def test_whitening_query(spark, sf):
    rows = queries.QUERIES["op11_embedding_whitening"](spark, sf).collect()
    assert len(rows) == 51 * 8 and {r["n"] for r in rows} == {51} and sorted({r["component"] for r in rows}) == list(range(1, 9))
    assert max(r["identity_error"] for r in rows) < 1e-9 and all(r["deviation"] == int(r["deviation_exact"]) for r in rows)


def test_extraction_query(spark, sf):
    rows = queries.QUERIES["op12_html_extraction"](spark, sf).collect()
    assert len(rows) == 9 and {(r["text"], r["n_chars"]) for r in rows} == {("", 0)}


def test_mix_query(spark, sf, rows):
    _, got = result(spark, sf, "op1_mix_sources")
    size = {i: len(ws(t)) for i, (t, *_) in rows.items()}
    total, taken = defaultdict(int), defaultdict(int)
    for i, (_, _, s) in rows.items():
        total[s] += size[i]
        taken[s] += got[i]["taken"]
    want = targets(total)
    assert got.keys() == rows.keys()
    for i, (_, _, s) in rows.items():
        assert (got[i]["size"], got[i]["source_size"]) == (size[i], total[s]) and got[i]["target"] == pytest.approx(want[s]) and got[i]["taken"] <= 3 * size[i]
    assert all(abs(taken[s] - want[s]) <= max(n for i, n in size.items() if rows[i][2] == s) for s in total)
    assert {k for r in got.values() for k in r["shards"]} <= set(range(8))


def test_token_queries(spark, sf, rows):
    _, coded = result(spark, sf, "op3_sentencepiece")
    _, counted = result(spark, sf, "op6_token_counts")
    vocabulary = pieces.load_vocabulary()
    assert coded.keys() == counted.keys() == rows.keys()
    for i, (t, *_) in rows.items():
        raw = (t or "").encode()
        assert coded[i]["lossless"] and coded[i]["n_bytes"] == len(raw) and coded[i]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
        assert coded[i]["n_pieces"] >= counted[i]["n_pre_tokens"] > 0 or not raw
        if len(raw) < 3000:
            assert counted[i]["n_tokens"] == sum(best(vocabulary, w) for w in pieces.pre_tokens(t or ""))


def test_language_query(spark, sf, rows):
    columns, got = result(spark, sf, "op4_language_id")
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and got.keys() == rows.keys()
    right = 0
    for i, (t, la, _) in rows.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") != letters
        right += i <= 160 and got[i]["lang_pred"] == la
    assert right >= 150


def test_media_query(spark, sf, rows):
    _, got = result(spark, sf, "op7_media_columns")
    for i, (t, *_) in rows.items():
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def normal(kind, value):
    if kind == "ip":
        return f"ip:{'.'.join(str(int(x)) for x in value.split('.'))}"
    return f"{kind}:{re.sub('[^0-9]', '', value) if kind in ('card', 'phone') else value.lower()}"


def test_personal_data_query(spark, sf, rows):
    """Counts, base spans and the spans of telling terms by brute force."""
    _, got = result(spark, sf, "op8_personal_data")
    spans, terms, entities = {}, {}, {}
    for i, (t, *_) in rows.items():
        t = t or ""
        spans[i] = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(t).split(",") if x)]
        masked = list(t)
        for _, a, b in spans[i]:
            masked[a:b] = "￿" * (b - a)
        terms[i] = [(m.group(), m.start(), m.end()) for m in regex.finditer(r"(?<![\p{L}￿])\p{L}++(?!￿)", "".join(masked))]
        entities[i] = {normal(k, t[a:b]) for k, a, b in spans[i]}
    held, mentioned, both = Counter(), Counter(), Counter()
    for i in rows:
        words = {w.lower() for w, *_ in terms[i]}
        held.update(words)
        mentioned.update(entities[i])
        both.update((e, w) for e in entities[i] for w in words)
    for i in rows:
        added = []
        for w, a, b in terms[i]:
            shares = [1 + math.log(both[e, w.lower()] / held[w.lower()]) / math.log(len(rows) / mentioned[e]) for e in entities[i] if both[e, w.lower()] >= SUPPORT and mentioned[e] < len(rows)]
            if shares and max(shares) >= GENERALISE:
                added.append((ADDED[max(shares) >= REMOVE], a, b))
        want = [*spans[i], *sorted(added, key=lambda x: (ADDED.index(x[0]), x[1]))]
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(base_spans(rows[i][0] or "").encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(k == x for x, *_ in spans[i]) for k in KINDS]
    assert any("general:" in r["spans"] for r in got.values()) and any("remove:" in r["spans"] for r in got.values())
    assert luhn("4111111111111111") and got[407]["n_card"] == got[407]["n_phone"] == 1


def test_toxicity_query(spark, sf, rows):
    columns, got = result(spark, sf, "op9_toxicity")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.keys() == rows.keys()
    for i, (t, *_) in rows.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.5) == int("scumbag" in (t or ""))


def test_pipeline_stages(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    at = dict(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.withColumns({"score": docs["n_chars"], "a b": docs["lang"]}) if name == "toxicity" else docs, sf)
        path = f"{sf}/stage-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns[:5] == columns and (name == "sentencepiece" or len(docs.columns) == 5)
        ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "toxicity":
            want = {i for i, (t, *_) in at.items() if "scumbag" not in (t or "")}
        elif name == "exact_dedup":
            low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            want = set({low(t): i for i, (t, *_) in sorted(at.items())}.values())
        elif name == "near_dedup":
            want = {i for i, _, c in brute_components([(i, t, s) for i, (t, _, s) in at.items()]) if i == c}
        else:
            want = set(ids)
        assert set(ids) == want and max(ids.values()) <= (3 if name in ("mixing", "sentencepiece") else 1)
        if name == "mixing":
            total, taken = defaultdict(int), defaultdict(int)
            for i, (t, _, s) in at.items():
                total[s] += len(ws(t))
                taken[s] += ids[i] * len(ws(t))
            goal = targets(total)
            assert all(abs(taken[s] - goal[s]) <= max(len(ws(t)) for t, _, x in at.values() if x == s) for s in total)
        at = {i: r for i, r in at.items() if i in ids}
    for r in docs.collect():
        assert r["lossless"] and r["text"] == rows[r["doc_id"]][0] and (len(r["ids"]) > 0) == bool(r["text"])


def test_pipeline_of_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
