import math

import numpy as np
import pytest

from dinesight.llm.whitening import eigenvectors, exact_products, whitened

SCHEMA = "vec_id long, embedding array<float>"
NAN, INF = float("nan"), float("inf")


def brute(rows):
    """Integer vectors of the rows that take part, their exact deviations and the whitened values by float64 of exact centred integers."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(0)
    z = n * x - s
    cov = (z.T @ z).astype(float) / float(n ** 3)
    values, basis = np.linalg.eigh(cov)
    return [i for i, _ in good], [int((row * row).sum()) for row in z], (z / n).astype(float), values[::-1], basis[:, ::-1]


def test_equals_brute_force(spark):
    random = np.random.default_rng(0)
    x = (random.normal(size=(700, 40)) * np.linspace(3, 0.5, 40)) @ np.linalg.qr(random.normal(size=(40, 40)))[0] + 5
    x[100:330] = x[100]
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)] + [(7, x[7].astype(np.float32).tolist())] * 3
    rows += [(800, None), (801, [NAN] * 40), (802, [INF] + [0.0] * 39), (803, [None] + [0.0] * 39), (804, [1.0, 2.0]), (None, x[3].astype(np.float32).tolist())]
    ids, deviation, centred, values, basis = brute([r for r in rows if r[0] != 804])
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "2 AS i", "3 AS n", "4 AS component")
    got = whitened(vectors).toPandas()
    assert len(got) == 32 * len(ids) and set(got["n"]) == {len(ids)} and got["identity_error"].max() < 1e-10
    for c in range(32):
        part = got[got["component"] == c + 1]
        assert np.allclose(part["explained"], values[c] / values.sum(), rtol=1e-9)
        want = centred @ basis[:, c] / math.sqrt(values[c])
        first = [k for k, i in enumerate(ids) if i == 0][0]
        sign = np.sign(part[part["vec_id"] == 0]["whitened"].iloc[0] * want[first])
        mine = sorted((-1 if math.isnan(i) else int(i), int(d), w) for i, d, w in zip(part["vec_id"].astype(float), part["deviation"], part["whitened"], strict=True))
        theirs = sorted((-1 if i is None else i, d, sign * w) for i, d, w in zip(ids, deviation, want, strict=True))
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        assert np.allclose([m[2] for m in mine], [t[2] for t in theirs], atol=1e-9)


def test_equal_rows_few_rows_and_empty_table(spark):
    assert whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([(1, None), (2, [NAN])], SCHEMA)).collect() == []
    got = whitened(spark.createDataFrame([(k, [0.5, -0.25, 2.0]) for k in range(5)], SCHEMA)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(c, 0, 0.0, 0.0, 1.0) for c in (1, 2, 3)] * 5
    got = whitened(spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], SCHEMA)).collect()
    assert [abs(r["whitened"]) for r in got if r["component"] == 1] == pytest.approx([1, 1]) and [r["explained"] for r in got if r["vec_id"] == 0] == [1.0, 0.0]


def test_large_entries(spark):
    rows = [(0, [3e9, 1e6]), (1, [-3e9, 2e6]), (2, [1e9, 4e6]), (3, [3e38, 0.0])]  # the last is no long after scaling
    got = whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted({r["vec_id"] for r in got}) == [0, 1, 2] and all(r["n"] == 3 for r in got)
    _, deviation, _, _, _ = brute(rows[:3])
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 1 << 63 else None for i, d in enumerate(deviation)}
    assert max(r["identity_error"] for r in got) < 1e-4


def test_exact_products():
    random = np.random.default_rng(2)
    for top in (1 << 18, 1 << 30, 1 << 58):
        y = random.integers(-top, top, (300, 7))
        assert (exact_products(y) == y.astype(object).T @ y.astype(object)).all()


def test_clustered_eigenvalues():
    random = np.random.default_rng(1)
    basis = np.linalg.qr(random.normal(size=(24, 24)))[0].astype(np.longdouble)
    for _ in range(3):
        basis = basis + basis @ (np.eye(24) - basis.T @ basis) / 2
    values = np.array([3, 3 - 1e-11, 3 - 2e-11, 2, 2 - 1e-7, 2 - 1e-7, *np.linspace(1.9, 0.1, 18)], np.longdouble)
    matrix = (basis * values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    got, x = eigenvectors(matrix)
    eps = float(np.finfo(np.longdouble).eps)
    assert np.abs(got - values).max() < 100 * eps and np.abs(x.T @ x - np.eye(24)).max() < 1000 * eps and np.abs(matrix @ x - x * got).max() < 1000 * eps
    alone = [0, 1, 2, 3, *range(6, 24)]
    assert (1 - np.abs((basis * x).sum(0))[alone]).max() < 1e-12  # also in a cluster of nearly equal values
    assert np.abs(np.linalg.eigh(matrix.astype(float))[1][:, ::-1] - x)[:, 0].max() > 1e-9  # float64 alone cannot tell them apart
    zero, unit = eigenvectors(np.zeros((3, 3), np.longdouble))
    assert not zero.any() and (unit == np.eye(3)).all()
