import numpy as np

from dinesight.llm.posting_lists import Lists, fit_lists, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, nearest):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in queries:
        if q in good:
            scored = sorted((-float(sum(a * b for a, b in zip(good[q], v, strict=True))), i) for i, v in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:nearest]]
    return out


def test_recall_scores_and_order(spark):
    random = np.random.default_rng(0)
    centers = random.normal(size=(8, 16))
    x = centers[random.integers(0, 8, 3000)] + 0.4 * random.normal(size=(3000, 16))
    x[500:1500] = x[500]  # a third are copies
    x *= random.uniform(0.5, 2, (3000, 1))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = list(range(0, 3000, 20))
    want = brute(rows, queries, 20)
    got: dict = {}
    for r in nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in queries:
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine) and q not in [i for _, i, _ in mine]
        hits += len({i for _, i, _ in mine} & {i for i, _ in want[q]})
        known = dict(want[q])
        assert all(abs(s - known[i]) < 1e-12 for _, i, s in mine if i in known)
    assert hits / (20 * len(queries)) >= 0.9


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []),
            (20, [0.5, 0.5]), (None, [1.0, 1.0]), (40, [nan, 0.0])]
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id AS id", "1 AS list", "2 AS score")
    got = sorted(tuple(r) for r in nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert nearest_neighbours(vectors.limit(0), vectors.limit(0)).collect() == []


def test_graph_search_finds_the_nearest_list():
    random = np.random.default_rng(1)
    x = random.normal(size=(4000, 12))
    lists = fit_lists(x, float(np.sqrt((x ** 2).sum(1)).max()))
    same = 0
    for q in x[:200]:
        target = np.append(q * lists.norm / np.linalg.norm(q), 0)
        same += lists.search(q)[0] == int(((lists.centroids - target) ** 2).sum(1).argmin())
    assert same >= 190


def test_every_query_gets_its_rows(spark):
    """Outliers, groups of copies and tight groups of fewer rows than are due."""
    random = np.random.default_rng(5)

    def unit(n):
        v = random.normal(size=(n, 24))
        return v / np.linalg.norm(v, axis=1)[:, None]
    tight = np.repeat(unit(20), 15, axis=0) + 1e-6 * random.normal(size=(300, 24))
    crowd = np.eye(24)[0] + 0.05 * random.normal(size=(1200, 24))
    x = np.concatenate([unit(20), np.repeat(unit(20), 5, axis=0), tight, crowd / np.linalg.norm(crowd, axis=1)[:, None]])
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got: dict = {}
    for r in nearest_neighbours(vectors, vectors).collect():
        got.setdefault(r["query_id"], []).append(r["rank"])
    assert sorted(got) == list(range(len(x))) and all(sorted(v) == list(range(1, 21)) for v in got.values())


def test_lists_are_read_until_they_hold_enough():
    angle = np.arange(256) * 2 * np.pi / 256
    centroids = np.column_stack([np.cos(angle), np.sin(angle), np.zeros(256)])
    around = (np.arange(256)[:, None] + np.array([1, -1])) % 256
    lists = Lists(centroids, around, 1.0)
    for size in (np.ones(256, np.int64), np.where(np.arange(256) % 128 == 127, 60, 0)):
        for q in (0, 40, 200):
            read = lists.search(centroids[q, :2], size, 84)
            assert size[read].sum() >= 84 and read[0] == q and len(read) == len(set(read))
    few = np.where(np.arange(256) < 50, 1, 0)
    assert few[lists.search(centroids[128, :2], few, 84)].sum() == 50
    assert lists.search(centroids[9, :2], np.full(256, 100), 84) == [9]


def test_ratio_and_width_are_measured():
    """Vectors of very different norms: the usual ratio and width miss many lists that hold what is nearest."""
    random = np.random.default_rng(7)
    x = random.normal(size=(6000, 64)) * np.exp(random.normal(size=(6000, 1)))
    lists = fit_lists(x, float(np.sqrt((x ** 2).sum(1)).max()))
    row, home = lists.homes(x)
    size = np.bincount(home, minlength=len(lists.centroids))
    asked = {k: x[k] for k in range(0, 6000, 20)}
    nearest = {}
    for k, q in asked.items():
        product = x @ q
        product[k] = -np.inf
        nearest[k] = np.argsort(-product)[:20]

    def recall(searched):
        found = 0
        for k, q in asked.items():
            held = set(row[np.isin(home, searched.search(q, size, 84))].tolist())
            found += len(held & set(nearest[k].tolist()))
        return found / (20 * len(asked))

    known = dict(list(asked.items())[:100])
    better = lists.measured(known, {k: x[nearest[k]] for k in known}, size, 84)
    assert recall(lists) < 0.97 < recall(better), (recall(lists), recall(better))
    assert better.ratio >= lists.ratio and better.width >= lists.width
