"""Whitening against a plain version over fractions, and its odd cases."""

import random
from fractions import Fraction

import numpy as np
import pytest

from touchline.llm import whitening

RNG = random.Random(11)


def brute(vectors):
    """n, exact deviations, covariance and mean of the integers of vectors."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    deviation = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    v = [[float(sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in x) / n) for j in range(d)] for i in range(d)]
    return n, deviation, np.array(v), np.array([[float(r[i] - Fraction(s[i], n)) for i in range(d)] for r in x])


def made(n, d):
    mix = [[RNG.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    return [[float(np.float32(sum(m * RNG.gauss(0, 0.1) for m in row))) for row in mix] for _ in range(n)]


@pytest.mark.parametrize("d", [3, 12])
def test_components_match_plain_version(spark, d):
    vectors = made(60, d)
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, whitened string").repartition(5)
    rows = whitening.components(df).collect()
    n, deviation, v, centred = brute([list(map(np.float32, x)) for x in vectors])
    k = min(8, d)
    assert len(rows) == 60 * k and {r["n"] for r in rows} == {n}
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    want = centred @ u[:, :k] / np.sqrt(e[:k])
    got = np.empty((60, k))
    for r in rows:
        assert r["deviation"] == deviation[r["vec_id"]] == int(r["deviation_exact"])
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9)
        assert r["identity_error"] < 1e-9
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    for c in range(k):
        sign = np.sign(got[0, c] * want[0, c])
        assert np.allclose(got[:, c], sign * want[:, c], atol=1e-8)


def test_exact_at_any_dealing(spark):
    vectors = made(40, 4)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    a, b = (whitening.fit(df.repartition(p))[4] for p in (1, 7))
    assert a.sums == b.sums and (a.axes == b.axes).all() and (a.values == b.values).all()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [5.0])]
    out = whitening.components(spark.createDataFrame(rows, "`my.id` long, embedding array<float>"), key="my.id").collect()
    two = [r for r in out if r["n"] == 3]
    assert sorted((r["my.id"] or 0, r["component"]) for r in two) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert {r["whitened"] is None for r in two if r["component"] == 2} == {True}  # the second dimension never varies
    assert {r["identity_error"] < 1e-9 for r in two} == {True}
    (one,) = [r for r in out if r["n"] == 1]
    assert (one["whitened"], one["explained"], one["identity_error"], one["deviation"]) == (None, None, 0.0, 0)


def test_empty_table(spark):
    assert whitening.components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_wide_values(spark):
    rows = [(i, [1e9 * i, -1e9 * (i % 3)]) for i in range(50)]
    out = whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, deviation, _, _ = brute([v for _, v in rows])
    assert all(int(r["deviation_exact"]) == deviation[r["vec_id"]] for r in out)
    assert all(r["deviation"] == (deviation[r["vec_id"]] if deviation[r["vec_id"]] < 2**63 else None) for r in out)
    with pytest.raises(Exception, match="beyond"):
        whitening.fit(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"))
