"""Deduplication of tables with odd names, null keys, texts without words and long texts."""

import random

from touchline.llm import exact_dedup, near_dedup

RNG = random.Random(5)
LONG = " ".join(RNG.choices([f"w{i}" for i in range(500)], k=200_000))
WORDS = [f"v{i}" for i in range(60)]


def rows():
    near = [" ".join([*WORDS[:k], "changed", *WORDS[k + 1 :]]) for k in (0, 30)]
    texts = [" ".join(WORDS), *near, None, "", " \t", LONG, LONG + " more", "few words", "Few words", " ".join(WORDS)]
    return [(i if i != 10 else None, t, "a", i) for i, t in enumerate(texts)] + [(1, near[0], "a", 1)]


DDL = "`my.id` long, `the text` string, drop_key string, digest int"


def test_near_dedup_with_odd_names(spark):
    df = spark.createDataFrame(rows(), DDL).repartition(3)
    got = {(r["my.id"], r["n_shingles"] > 0): (r["component_id"], r["kept"]) for r in near_dedup.near_components(df, "my.id", "the text").collect()}
    assert {k: v for (k, _), v in got.items()} == {0: (0, True), 1: (0, False), 2: (0, False), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True), 7: (6, False), 8: (8, True), 9: (8, False), None: (None, False)}
    kept = near_dedup.keep_one(df, "my.id", "the text")
    assert kept.columns == df.columns
    assert sorted(str(r["my.id"]) for r in kept.collect()) == ["0", "3", "4", "5", "6", "8", "None"]
    empty = near_dedup.keep_one(df.limit(0), "my.id", "the text")
    assert empty.count() == 0 and empty.columns == df.columns


def test_exact_dedup_with_odd_names(spark):
    df = spark.createDataFrame(rows(), DDL).repartition(3)
    kept = exact_dedup.keep_distinct(df, "my.id", "the text")
    assert kept.columns == df.columns
    assert sorted(str(r["my.id"]) for r in kept.collect()) == ["0", "1", "2", "4", "5", "6", "7", "9"]
    assert exact_dedup.keep_distinct(df.limit(0), "my.id", "the text").count() == 0
