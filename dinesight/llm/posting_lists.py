"""Operator 2: approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample, with a penalty on full clusters. Every
vector goes to its nearest list and, at a boundary, to up to ``COPIES`` lists that
are nearly as near and not behind each other. A query finds its nearest centroids
by best-first search in a neighbour graph of the centroids held in memory, takes
lists in order of distance until they hold enough candidates, keeps those within a
ratio of the distance reached then, and is compared with their lists. The ratio and the
width of the search are measured: a bounded sample of the queries meets every vector, and
both are set so that the lists read hold all but a small share of what is nearest.
Lists and the queries that meet them are cut into blocks of bounded size, so a
list that holds a third of all vectors (copies of one) is spread.

Nearness is the largest inner product in double precision. Vectors of different
norms get one more component that makes their norms equal, so the nearest by
distance has the largest product; scores come from the original vectors.

A vector that is null, zero or holds a null or a value that is not finite takes no part,
nor does one whose length is not the most frequent one, or whose id is null. Rows with the
same id count as one (the least by hash of the vector). With too few candidates a
query returns all. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dinesight.llm.common import stored

SAMPLE_ROWS = 20_000
MAX_LISTS = 256
ROWS_PER_LIST = 40
COPIES = 4
BOUNDARY_RATIO = 1.15
SEARCHED = 104
SEARCH_RATIO = 1.5
NEIGHBOURS = 16
BLOCK = 4_096
NEAREST = 20
#: Queries that meet every vector, and the share of their nearest that ratio and width may each leave out.
MEASURED = 256
LEFT_OUT = 0.01


def usable(vectors: DataFrame) -> DataFrame:
    """``id, v`` of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite).where(F.exists("v", lambda x: x != 0.0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (lengths["d"] if lengths else -1))
    return rows.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


@dataclass(frozen=True)
class Lists:
    """Centroids and their neighbour graph; at most ``MAX_LISTS`` of them."""
    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    ratio: float = SEARCH_RATIO
    width: int = SEARCHED

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Stored vectors with the component that makes all norms equal."""
        return np.column_stack([x, np.sqrt(np.maximum(self.norm ** 2 - (x ** 2).sum(1), 0))])

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every copy of the stored vectors ``x``."""
        lifted = self.lifted(x)
        distance = np.sqrt(np.maximum((lifted ** 2).sum(1)[:, None] - 2 * lifted @ self.centroids.T + (self.centroids ** 2).sum(1), 0))
        near = np.argsort(distance, axis=1, kind="stable")[:, :2 * COPIES]
        between = np.sqrt(((self.centroids[:, None] - self.centroids[None]) ** 2).sum(2))
        rows, lists = [], []
        for k, order in enumerate(near):
            taken: list[int] = []
            for c in order.tolist():
                if taken and (len(taken) == COPIES or distance[k, c] > BOUNDARY_RATIO * distance[k, taken[0]] + 1e-12):
                    break
                # A list behind one already taken adds nothing.
                if all(between[c, t] >= 0.5 * distance[k, c] for t in taken):
                    taken.append(c)
            rows += [k] * len(taken)
            lists += taken
        return np.array(rows, np.int64), np.array(lists, np.int64)

    def search(self, query: np.ndarray, size: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Lists to read: best-first over the graph, pruned by the ratio of distances.

        With the ``size`` of every list the ratio is that to the list with which those read hold ``least`` rows;
        where the lists found hold fewer, all are taken in order of distance.
        """
        length = np.linalg.norm(query)
        target = np.append(query * (self.norm / length), 0.0)
        seen = {0}
        first = float(np.linalg.norm(self.centroids[0] - target))
        open_, best = [(first, 0)], [(-first, 0)]
        while open_:
            d, c = heapq.heappop(open_)
            if len(best) >= self.width and d > -best[0][0]:
                break
            new = [n for n in self.graph[c].tolist() if n >= 0 and n not in seen]
            seen.update(new)
            if new:
                for e, n in zip(np.linalg.norm(self.centroids[new] - target, axis=1).tolist(), new, strict=True):
                    if len(best) < self.width or e < -best[0][0]:
                        heapq.heappush(open_, (e, n))
                        heapq.heappush(best, (-e, n))
                        if len(best) > self.width:
                            heapq.heappop(best)
        found = sorted((-d, n) for d, n in best)
        filled = 0
        if size is not None:
            if size[[n for _, n in found]].sum() < least:
                found = sorted(zip(np.linalg.norm(self.centroids - target, axis=1).tolist(), range(len(self.centroids)), strict=True))
            filled = min(int(np.searchsorted(np.cumsum(size[[n for _, n in found]]), least)), len(found) - 1)
        return [n for d, n in found if d <= self.ratio * found[filled][0] + 1e-12]

    def measured(self, asked: dict[int, np.ndarray], nearest: dict[int, np.ndarray], size: np.ndarray, least: int) -> Lists:
        """With a ratio and a width that reach the ``nearest`` vectors of the ``asked``, never less than the given ones."""
        known = [(asked[k], nearest[k], self.homes(nearest[k])) for k in asked if k in nearest]
        if not known:
            return self
        needed = []
        for query, found, (row, home) in known:
            target = np.append(query * (self.norm / np.linalg.norm(query)), 0.0)
            distance = np.linalg.norm(self.centroids - target, axis=1)
            order = np.argsort(distance, kind="stable")
            filled = min(int(np.searchsorted(np.cumsum(size[order]), least)), len(order) - 1)
            best = np.full(len(found), np.inf)
            np.minimum.at(best, row, distance[home])
            needed += (best / max(distance[order[filled]], 1e-300)).tolist()
        best = replace(self, ratio=max(self.ratio, float(np.quantile(needed, 1 - LEFT_OUT, method="higher")) * (1 + 1e-9)))
        # The graph may not lead to the nearest lists; with all lists as its width the search is exact.
        while best.width < len(self.centroids):
            reached = sum(len(set(row[np.isin(home, best.search(query, size, least))].tolist())) for query, _, (row, home) in known)
            if reached >= (1 - 2 * LEFT_OUT) * len(needed):
                break
            best = replace(best, width=min(2 * best.width, len(self.centroids)))
        return best


def fit_lists(sample: np.ndarray, norm: float) -> Lists:
    """Balanced k-means on distinct sampled vectors, and the graph of the centroids."""
    x = np.unique(sample, axis=0)
    x = np.column_stack([x, np.sqrt(np.maximum(norm ** 2 - (x ** 2).sum(1), 0))])
    k = int(min(MAX_LISTS, max(1, len(x) // ROWS_PER_LIST)))
    centroids = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    size = np.full(k, len(x) / k)
    for _ in range(12):
        distance = (x ** 2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids ** 2).sum(1)
        penalty = np.median(distance.min(1)) * 0.25 * (size / size.mean() - 1)
        home = (distance + penalty).argmin(1)
        size = np.bincount(home, minlength=k).astype(float)
        filled = size > 0
        sums = np.column_stack([np.bincount(home, x[:, d], minlength=k) for d in range(x.shape[1])])
        centroids[filled] = sums[filled] / size[filled, None]
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    near = np.argsort(between, axis=1, kind="stable")[:, 1:NEIGHBOURS + 1]
    # A ring of all centroids beside the near ones keeps the graph connected.
    graph = np.column_stack([near, (np.arange(k) + 1) % k, (np.arange(k) - 1) % k])
    return Lists(centroids, graph, norm)


def _top(ids: np.ndarray, x: np.ndarray, queries: pd.DataFrame, nearest: int) -> pd.DataFrame:
    """The nearest candidates of one block for each query; every product is summed in the order of components."""
    out = []
    q_ids, q = queries["id"].to_numpy(), np.stack(queries["v"].to_numpy())
    longest = float(np.sqrt((x ** 2).sum(1)).max())
    for a in range(0, len(q), 64):
        part = q[a:a + 64]
        rough = part @ x.T
        for k, query in enumerate(q_ids[a:a + 64]):
            row = np.where(ids == query, -np.inf, rough[k])
            cut = np.partition(row, -nearest)[-nearest] if len(row) > nearest else -np.inf
            # The rough product only chooses; its error is far below this margin.
            margin = 1e-13 * x.shape[1] * longest * float(np.linalg.norm(part[k]))
            some = np.flatnonzero((row >= cut - margin) & (row > -np.inf))
            score = np.zeros(len(some))
            for d in range(x.shape[1]):
                score += part[k, d] * x[some, d]
            best = np.lexsort((ids[some], -score))[:nearest]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[some[best]], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _truly_nearest(base: DataFrame, asked: dict[int, np.ndarray], nearest: int) -> dict[int, np.ndarray]:
    """The nearest vectors of a few queries among all: every task keeps ``nearest`` rows a query."""
    queries = base.sparkSession.sparkContext.broadcast(pd.DataFrame({"id": list(asked), "v": list(asked.values())}))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column("id").to_numpy(), np.stack(batch.column("v").to_numpy(zero_copy_only=False))
                top = _top(ids, x, queries.value, nearest)
                at = {i: k for k, i in enumerate(ids.tolist())}
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(top["query_id"].to_numpy(), pa.int64()), "vec_id": pa.array(top["vec_id"].to_numpy(), pa.int64()),
                    "score": pa.array(top["score"].to_numpy(), pa.float64()), "v": batch.column("v").take(pa.array([at[i] for i in top["vec_id"].tolist()], pa.int64()))})

    found = base.mapInArrow(met, "query_id long, vec_id long, score double, v array<double>")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "v")
    out: dict[int, list] = {}
    for r in kept.collect():  # MEASURED * nearest rows at most
        out.setdefault(r["query_id"], []).append(r["v"])
    return {k: np.array(v) for k, v in out.items()}


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of ``vectors (vec_id, embedding)`` for each of ``queries``."""
    base = stored(usable(vectors))
    asked = stored(base.join(queries.select(F.col("vec_id").cast("long").alias("id")).distinct(), "id", "left_semi"))
    norm = base.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 0.0
    # A bounded sample: its rows fix the centroids, and every vector is indexed.
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").collect()
    if not sample:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    lists = vectors.sparkSession.sparkContext.broadcast(fit_lists(np.array([r["v"] for r in sample]), float(norm)))

    def route(batches: Iterator[pa.RecordBatch], asking: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch.column("v").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1))
            if asking:
                found = [searched.value.search(v, size.value, COPIES * (nearest + 1)) for v in x]
                row, home = np.repeat(np.arange(len(x)), [len(f) for f in found]), np.array([c for f in found for c in f], np.int64)
            else:
                row, home = lists.value.homes(x) if len(x) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_pydict({"list": pa.array(home, pa.int32()), "id": batch.column("id").take(pa.array(row)), "v": batch.column("v").take(pa.array(row))})

    schema = "list int, id long, v array<double>"
    filed = stored(base.mapInArrow(lambda b: route(b, False), schema))
    # One number per list. A vector stands in COPIES lists at most, and the query itself is no candidate.
    held = {r["list"]: r["n"] for r in filed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([held.get(k, 0) for k in range(len(lists.value.centroids))], np.int64)
    size = vectors.sparkSession.sparkContext.broadcast(sizes)
    some = {r["id"]: np.array(r["v"]) for r in asked.orderBy(F.xxhash64("id"), "id").limit(MEASURED).collect()}
    searched = lists.value.measured(some, _truly_nearest(base, some, nearest), sizes, COPIES * (nearest + 1)) if some else lists.value
    searched = vectors.sparkSession.sparkContext.broadcast(searched)
    reading = stored(asked.mapInArrow(lambda b: route(b, True), schema))
    # One row per list: in how many blocks its vectors and its queries are cut.
    blocks = filed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nv")).join(
        reading.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nq")), "list")
    blocks = F.broadcast(stored(blocks))

    def block(rows: DataFrame, own: str, other: str) -> DataFrame:
        pick = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return rows.join(blocks, "list").select("list", pick.alias(f"_{own}"), each.alias(f"_{other}"), "id", "v")

    left, right = block(filed, "nv", "nq"), block(reading, "nq", "nv")
    found = left.groupBy("list", "_nv", "_nq").cogroup(right.groupBy("list", "_nv", "_nq")).applyInPandas(
        lambda x, q: _top(x["id"].to_numpy(), np.stack(x["v"].to_numpy()), q, nearest) if len(x) and len(q) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}),
        "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
            .select("query_id", "rank", "vec_id", "score"))
