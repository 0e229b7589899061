import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dinesight.llm import hard_negatives as module
from dinesight.llm.hard_negatives import ResidueMatrix, hard_negatives, primes_for

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def brute(rows, every=50):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows
            if i is not None and v is not None and label is not None and None not in v and np.isfinite(v).all()]
    out = []
    for i, a, label in good:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j, other == label) for j, b, other in good if j != i)
        for s, j, _ in [x for x in scored if x[2]][:5]:
            inside = [(t, k) for t, k, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(inside[:3], 1)]
    return sorted(out)


def result(spark, rows, every=50):
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS rank", "4 AS a")
    return sorted(map(tuple, hard_negatives(vectors, F.col("id") % every == 0).collect()))


def test_equals_brute_force(spark, monkeypatch):
    random = np.random.default_rng(3)
    x = random.normal(size=(600, 12)) + 0.4
    x[40:240] = x[50]  # a third are copies: ties on both sides
    labels = random.integers(0, 4, 600)
    rows = [(k, v.astype(np.float32).tolist(), int(c)) for k, (v, c) in enumerate(zip(x, labels, strict=True))]
    rows += [(1000, None, 1), (1050, [NAN] * 12, 1), (1100, [INF] * 12, 1), (1150, [None] * 12, 1), (1200, x[0].tolist(), None), (None, x[0].tolist(), 1),
             (1250, [0.0] * 12, 2), (1300, (-x[0]).tolist(), 3), (1350, x[0].tolist(), 99)]
    want = brute(rows)
    assert want and result(spark, rows) == want
    # Many small cells give the same rows.
    monkeypatch.setattr(module, "ROW_VALUES", 12 * 256)
    monkeypatch.setattr(module, "ANCHOR_BLOCK", 4)
    assert result(spark, rows + rows[:300]) == want


def test_other_lengths_and_empty_tables(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 0.9], 0), (2, [0.8, 0.9], 1), (3, [1.0], 1), (4, [], 0)]
    assert result(spark, rows) == brute([r for r in rows if r[1] and len(r[1]) == 2]) != []
    assert result(spark, []) == [] and result(spark, [(0, None, 1)]) == [] and result(spark, [(0, [1.0], 1)]) == []


def test_scores_beyond_long_raise(spark):
    with pytest.raises(ValueError):
        result(spark, [(0, [1e30], 0), (1, [1.0], 0)])
    rows = [(k, [float(s) * 2.0 ** 18, 1.0 + k], k % 2) for k, s in enumerate([1, 1, -1, 0.7, 0.9, 0.6, 0.99, 0.5])]
    assert result(spark, rows, 1) == brute(rows, 1) != []


def test_residue_products_are_exact():
    random = np.random.default_rng(1)
    for top, d in ((100, 5), (60_000, 64), (1 << 23, 200)):
        a, b = random.integers(-top, top + 1, (9, d)), random.integers(-top, top + 1, (31, d))
        a[0], b[0] = top, -top
        primes = primes_for(top * top * d)
        assert max(primes) < 1024 and math.prod(primes) > 2 * top * top * d
        got = ResidueMatrix(a.astype(float), primes).times(ResidueMatrix(b.astype(float), primes), slice(None), slice(None))
        assert (got == a @ b.T).all()
