"""Operator 6: n-gram Jaccard join by rare-first prefix filtering.

A document's set holds its distinct shingles of ``size`` words (A-Z lower-cased; a
shorter text is one shingle; no words, no set). Documents link when the Jaccard
similarity of their sets is at least ``percent`` hundredths: three words and 90 unless
said otherwise. Equal sets are one node, so copies are
never compared. Each node's shingles are ordered rarest first; two linked nodes
share a shingle among the first of both, a tenth at 90 (prefix filter), their sizes are
close (length filter), enough shingles are left after the first shared one
(positional filter), and their histograms over hash ranges overlap enough
(suffix filter). A surviving pair is verified once on the exact sets.

Only reachability is asked for, so pairs already joined by other links need no
test: a first round pairs neighbours in the posting lists, in a few shuffled
orders; the last one tests the pairs that still cross components, all of them.
Posting lists are dealt out by range of (shingle, size, order), so a list that
holds a third of all documents is spread over many tasks.

Null and empty texts have n_shingles 0 and are their own component. Repeated
rows are linked with each other. Columns other than ``doc_id`` and ``text`` are
not read by the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinesight.llm.common import stored
from dinesight.llm.components import components
from dinesight.llm.kernel import Chunk, chunks, mix, shingles, texts, words

SIZE, PERCENT = 3, 90
RARITY_BUCKETS = 1 << 16
HISTOGRAM = 32
BROADCAST_ROWS = 250_000


@dataclass(frozen=True)
class Rule:
    """Shingles of ``size`` words; a link from a similarity of ``percent`` hundredths on."""
    size: int = SIZE
    percent: int = PERCENT

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many of the rarest shingles two linked sets cannot both miss."""
        return np.where(n > 0, n - (self.percent * n + 99) // 100 + 1, 0)

    def needed(self, a: Column, b: Column) -> Column:
        """Least overlap of two linked sets of these sizes."""
        return F.ceil(self.percent * (a + b) / F.lit(100.0 + self.percent))

    def may_link(self, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
        """Length and positional filter at a shared shingle with positions ``p1`` and ``p2`` (from 0)."""
        return (100 * F.least(n1, n2) >= self.percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= self.needed(n1, n2))


def shingle_sets(chunk: Chunk, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of every distinct shingle, ordered by both."""
    w = words(chunk)
    h, first = shingles(w, size)
    doc = w.doc[first]
    count = np.bincount(w.doc, minlength=len(chunk))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        begin = np.searchsorted(w.doc, short)
        whole = mix(w.hash[begin] + count[short].astype(np.uint64))
        for k in range(1, size - 1):
            more = count[short] > k
            whole[more] = mix(whole[more] + w.hash[begin[more] + k] * np.uint64(2 * k + 3))
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _rarity(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_BUCKETS, np.int64)
        for batch in batches:
            for chunk in chunks(texts(batch.column("text")), lower=True):
                total += np.bincount((shingle_sets(chunk, size)[1] % np.uint64(RARITY_BUCKETS)).astype(np.int64), minlength=RARITY_BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": total[used]})
    return count


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum modulo 2**64 of sorted ``doc``'s values."""
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    edges = np.searchsorted(doc, np.arange(n + 1))
    return running[edges[1:]] - running[edges[:-1]]


def signatures(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per row: uid, doc_id, n (set size), node (key of the set), prefix (rarest first), histogram."""
    totals = np.zeros(RARITY_BUCKETS, np.int64)
    counted = docs.select("text").mapInArrow(_rarity(rule.size), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # one row per bucket at most
        totals[r["bucket"]] = r["n"]
    rarity = docs.sparkSession.sparkContext.broadcast(totals)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(texts(batch.column("text")), lower=True):
                doc, h = shingle_sets(chunk, rule.size)
                n = np.bincount(doc, minlength=len(chunk))
                node = mix(_sums(doc, mix(h ^ np.uint64(0x51ED270B)), len(chunk)) ^ mix(_sums(doc, h, len(chunk)) + n.astype(np.uint64)))
                cells = np.bincount(doc * HISTOGRAM + (h >> np.uint64(59)).astype(np.int64), minlength=len(chunk) * HISTOGRAM)
                order = np.lexsort((h, rarity.value[(h % np.uint64(RARITY_BUCKETS)).astype(np.int64)], doc))
                begin = np.concatenate([[0], np.cumsum(n)])
                rank = np.arange(len(h)) - begin[doc]
                length = rule.prefix(n)
                prefix = h[order][rank < length[doc]]
                rows = slice(chunk.first, chunk.first + len(chunk))
                yield pa.RecordBatch.from_pydict({
                    "uid": batch.column("uid")[rows], "doc_id": batch.column("doc_id")[rows], "n": n.astype(np.int64),
                    "node": node.view(np.int64),
                    "prefix": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(prefix.view(np.int64))),
                    "histogram": pa.ListArray.from_arrays(pa.array(np.arange(len(chunk) + 1) * HISTOGRAM, pa.int32()), pa.array(cells, pa.int32()))})

    return docs.mapInArrow(sign, "uid long, doc_id long, n long, node long, prefix array<long>, histogram array<int>")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted postings: those that share their shingle with the row before or after, with the row after.

    The first and last row of a task stay, since their neighbours may be in another task.
    """
    held: pa.Table | None = None
    first = True
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table.num_rows < 2:
            held = table
            continue
        out, held = _linked(table, first, False)
        first = False
        yield from out
    if held is not None:
        yield from _linked(held, first, True)[0]


def _linked(table: pa.Table, first: bool, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
    """Rows but the last one (unless it ends the task), and the two last rows to go on with."""
    tok = table.column("tok").to_numpy()
    same = tok[1:] == tok[:-1]
    after = np.append(same, True if last else False)
    before = np.insert(same, 0, True if first else False)
    keep = after | before
    # The row before the last one was given out with the batch before it.
    skip = 0 if first else 1
    stop = len(tok) if last else len(tok) - 1
    chosen = np.flatnonzero(keep[skip:stop]) + skip
    follow = np.minimum(chosen + 1, len(tok) - 1)
    real = (follow > chosen) & np.append(same, False)[chosen]
    part = table.take(pa.array(chosen))
    for name in ("node", "pos", "n"):
        part = part.append_column(f"next_{name}", pa.array(table.column(name).to_numpy()[follow], mask=~real))
    return part.combine_chunks().to_batches(), table.slice(max(0, len(tok) - 2))


def _ordered(postings: DataFrame, rule: Rule, seed: int) -> DataFrame:
    """Postings in lists: those that may pass the positional filter first, by like size, in a shuffled order."""
    late = F.col("pos") > F.col("n") - rule.needed(F.col("n"), F.col("n"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(rule.percent / 100))).cast("int")
    keys = ["tok", "_late", "_band", "_order"]
    return (postings.withColumns({"_late": late, "_band": band, "_order": F.xxhash64("node", F.lit(seed))})
            .repartitionByRange(*keys).sortWithinPartitions(*keys).select("tok", "node", "pos", "n"))


def chained(postings: DataFrame, rule: Rule) -> DataFrame:
    """Postings of shared shingles, each with the next one of its list."""
    return _ordered(postings, rule, 0).mapInArrow(_neighbours, "tok long, node long, pos int, n long, next_node long, next_pos int, next_n long")


def paired(postings: DataFrame, rule: Rule, seed: int, reach: int) -> DataFrame:
    """Each posting with the ``reach`` next ones of its list, in another order."""
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64)]
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("tok", "node", "pos", "n")]
            rows = [np.concatenate([h, v]) for h, v in zip(held, new, strict=True)]
            begin, size = len(held[0]), len(rows[0])
            for k in range(1, reach + 1):
                later = np.arange(max(begin, k), size)
                later = later[rows[0][later] == rows[0][later - k]]
                yield pa.RecordBatch.from_pydict({f"{x}{c}": rows[i][at] for x, at in (("", later - k), ("next_", later)) for i, c in ((1, "node"), (2, "pos"), (3, "n"))})
            held = [v[-reach:] for v in rows]

    return _ordered(postings, rule, seed).mapInArrow(pair, "node long, pos int, n long, next_node long, next_pos int, next_n long")


def _pairs(chain: DataFrame, rule: Rule) -> DataFrame:
    may = rule.may_link(F.col("n"), F.col("pos"), F.col("next_n"), F.col("next_pos"))
    return (chain.where(F.col("next_node").isNotNull() & (F.col("node") != F.col("next_node")) & may)
            .select(F.least("node", "next_node").alias("a"), F.greatest("node", "next_node").alias("b")).distinct())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = texts(batch.column("text"))
        yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "size": pa.array([len(v) for v in values], pa.int64()),
                                          "packed": pa.array([pa.compress(v, "zstd", asbytes=True) for v in values], pa.binary())})


def _verify(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Compare the exact sets, made anew from the texts: a packed text is a fraction of its set."""
    for batch in batches:
        packed: dict[int, tuple[bytes, int]] = {}
        for node, text, size in (("a", "packed_a", "size_a"), ("b", "packed_b", "size_b")):
            packed.update(zip(batch.column(node).to_pylist(), zip(batch.column(text).to_pylist(), batch.column(size).to_pylist(), strict=True), strict=True))
        sets: dict[int, np.ndarray] = {}
        names = list(packed)
        for chunk in chunks([pa.decompress(t, n, "zstd", asbytes=True) for t, n in packed.values()], lower=True):
            doc, h = shingle_sets(chunk, rule.size)
            edges = np.searchsorted(doc, np.arange(len(chunk) + 1))
            for k in range(len(chunk)):
                sets[names[chunk.first + k]] = h[edges[k]:edges[k + 1]]
        keep = []
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            both = np.concatenate([sets[x], sets[y]])
            total = len(both)
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= rule.percent * (total - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose exact sets link; the suffix filter spares most others the texts."""
    facts = nodes.select("node", "n", "uid", "histogram")
    sides = pairs
    for side in ("a", "b"):
        sides = sides.join(facts.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "uid", "histogram")]), side)
    shared = F.aggregate(F.zip_with("histogram_a", "histogram_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    left = stored(sides.where(shared >= rule.needed(F.col("n_a"), F.col("n_b"))).select("a", "b", "uid_a", "uid_b"))
    if left.isEmpty():
        return left.select("a", "b")
    wanted = stored(left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("uid_a").alias("uid")), F.struct(F.col("b").alias("node"), F.col("uid_b").alias("uid")))).alias("w"))
                    .select("w.*").distinct())
    # Two numbers a row: sent to every task while they are few, otherwise the texts are dealt out by key.
    few = wanted.count() <= BROADCAST_ROWS
    found = docs.select("uid", "text").join(F.broadcast(wanted) if few else wanted, "uid").select("node", "text")
    packed = stored(found.mapInArrow(_pack, "node long, size long, packed binary").dropDuplicates(["node"]))
    joined = left.select("a", "b")
    for side in ("a", "b"):
        joined = joined.join(packed.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("packed").alias(f"packed_{side}")), side)
    return stored(joined.mapInArrow(partial(_verify, rule=rule), "a long, b long"))


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, label)`` after more links: the components of labels, put in for the labels."""
    if found is None:
        return components(links)
    if links.isEmpty():
        return found
    ends = links
    for side in ("a", "b"):
        ends = ends.join(found.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    merged = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("_new"))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").withColumn("label", F.col("node"))
    return stored(found.unionByName(new).join(merged, "label", "left").select("node", F.coalesce("_new", "label").alias("label")))


def _labelled(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Postings of the lists that still hold several components, with the component."""
    marked = postings.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = marked.groupBy("tok").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("tok")
    return stored(marked.join(mixed, "tok").select("tok", "node", "pos", "n", "label"))


def jaccard_classes(docs: DataFrame, rounds: int = 2, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``uid, doc_id, n_shingles, class, component_id`` of every row.

    ``class`` is a key of the component (null without shingles), component_id the smallest doc_id in it, ``uid``
    xxhash64 of doc_id and text. ``rounds`` sets how often neighbours are tested before the remaining pairs are.
    Ties: of equal nodes the smaller id and uid stand for all.
    """
    rule = Rule(size, percent)
    docs = docs.select(F.xxhash64("doc_id", "text").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(signatures(docs, rule))
    nodes = stored(rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("smallest"), F.min("uid").alias("uid"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("histogram").alias("histogram")))
    postings = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "tok"))
    chain = stored(chained(postings, rule))
    postings = chain.select("tok", "node", "pos", "n")
    tested = stored(_pairs(chain, rule))
    found = _joined(None, verified(tested, nodes, docs, rule))
    for seed in range(1, rounds):
        left = _labelled(postings, found)
        crossing = left.select("node", "label").distinct()
        new = _pairs(paired(left.select("tok", "node", "pos", "n"), rule, seed, 4 * seed), rule)
        for side in ("a", "b"):
            new = new.join(crossing.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side)
        new = stored(new.where("label_a <> label_b").select("a", "b").join(tested, ["a", "b"], "left_anti"))
        found, tested = _joined(found, verified(new, nodes, docs, rule)), tested.unionByName(new)
    left = _labelled(postings, found)
    x, y = left.alias("x"), left.alias("y")
    may = rule.may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    rest = (x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.label") < F.col("y.label")) & may)
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    rest = stored(rest.join(tested, ["a", "b"], "left_anti"))
    found = _joined(found, verified(rest, nodes, docs, rule))
    named = nodes.select("node", "smallest").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("smallest").alias("component_id"))
    by_node = stored(named.join(smallest, "label").select("node", F.col("label").alias("class"), "component_id"))
    linked = rows.where("n > 0").select("uid", "doc_id", F.col("n").alias("n_shingles"), "node").join(by_node, "node")
    alone = rows.where("n = 0").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"))
    return linked.select(alone.columns).unionByName(alone)


def keep_one_per_class(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each class, unchanged, the one with the smallest doc_id; documents without shingles all stay."""
    classes = jaccard_classes(docs, size=size, percent=percent)
    chosen = classes.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "uid")).alias("least")).select(F.col("least.uid").alias("uid"), F.lit(False).alias("alone"))
    alone = classes.where("class IS NULL").select("uid", F.lit(True).alias("alone")).distinct()
    # The caller's row travels as one column, whatever its columns are called.
    rows = docs.select(F.xxhash64("doc_id", "text").alias("uid"), F.struct("*").alias("row"))
    kept = rows.join(chosen.unionByName(alone), "uid")
    # Equal rows of one document are copies of each other; rows without shingles are copies of nothing.
    copy = F.when(F.col("alone"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    return kept.withColumn("copy", copy).dropDuplicates(["uid", "copy"]).select("row.*")
