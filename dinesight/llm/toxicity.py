"""Operator 7: toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams (3 to 5 bytes, word ends marked) and
of itself, hashed into buckets that have vectors; a passage is the mean of its
words, each the mean of its bag; a linear softmax on top tells toxic passages
from others. Vectors and softmax are trained jointly in numpy, so an unseen
misspelling has most of its vectors from words that were seen. Labels belong to
documents: a first fit on long passages finds what toxic documents have in
common; then each document is represented by its most toxic short passages, and
the fit goes on, a few times over.

A document scores as its most toxic run of ``PASSAGE`` words, over all of them
in the whole text; what speaks for toxicity counts once when a word is repeated. The model is linear up to the softmax, so for scoring it
folds into one number per bucket; slope and intercept are set on documents that
the fit did not see, at the share of toxic labels.

Labels of held-out rows (crc32 of the id modulo 4 is 2) are never read; training
reads at most ``TRAINING_ROWS`` toxic and ``OTHER_ROWS`` other documents and
``TRAINING_PASSAGES`` long passages of each, chosen by hashes. Null and empty texts score as a passage
without words. Without both classes every score is the smoothed share of toxic
labels (0 without labels). Repeated rows score alike. Only ``doc_id`` and
``text`` are inputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinesight.llm.common import held_out, sampled_labels
from dinesight.llm.kernel import ALNUM, LOWER, Chunk, Hashes, chunks, runs, texts

BUCKETS = 1 << 19
GRAMS = (3, 4, 5)
WIDTH = 6
PASSAGE = 5
LONG_PASSAGE = 32
LONG_PASSAGES = 10
TRAINING_ROWS = 1_200
OTHER_ROWS = 2_400
TRAINING_PASSAGES = 24
ROUNDS = (15, 25, 25, 25, 25, 25, 25)
RATE = 0.5
DECAY = 1e-4
THRESHOLD = 0.3


def _bags(data: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Start of every word of a lower-cased buffer, and for each part of their bags: bucket by position, first and last position of every word."""
    padded = np.concatenate([[32], np.where(ALNUM[data], data, 32), [32]]).astype(np.uint8)
    starts, ends = runs(ALNUM[padded])
    hashes = Hashes(padded)
    parts = []
    for n in GRAMS:
        bucket = ((hashes.windows(n) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)
        first = starts - 1
        parts.append((bucket, first, np.maximum(ends + 2 - n, first)))
    whole = (hashes.of(starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    at = np.arange(len(starts))
    return starts - 1, [*parts, (whole, at, at + 1)]


def word_values(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word and the mean of its bag's numbers."""
    starts, parts = _bags(data)
    total, count = np.zeros(len(starts)), np.zeros(len(starts))
    for bucket, first, last in parts:
        running = np.concatenate([[0.0], np.cumsum(table[bucket])])
        total += running[last] - running[first]
        count += last - first
    return starts, _once(parts[-1][0], total / np.maximum(count, 1))


def _once(word: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``value``, but at most 0 where the same word stands among the ``PASSAGE - 1`` before."""
    again = np.zeros(len(word), bool)
    for k in range(1, min(PASSAGE, len(word))):
        again[k:] |= word[k:] == word[:-k]
    return np.where(again, np.minimum(value, 0.0), value)


def passage_scores(chunk: Chunk, table: np.ndarray) -> np.ndarray:
    """The largest mean over ``PASSAGE`` words in a row for each document (all its words if it has fewer; 0 without)."""
    starts, value = word_values(chunk.data, table)
    running = np.concatenate([[0.0], np.cumsum(value)])
    edges = np.searchsorted(starts, np.append(chunk.starts, chunk.ends[-1] + 1))
    out = np.zeros(len(chunk))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            size = min(PASSAGE, b - a)
            out[k] = ((running[a + size:b + 1] - running[a:b - size + 1]) / size).max()
    return out


@dataclass(frozen=True)
class Toxicity:
    """One number per bucket and the intercept; the size does not depend on the data."""
    table: np.ndarray
    bias: float

    def scores(self, chunk: Chunk) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(passage_scores(chunk, self.table) + self.bias, -50, 50)))


def _gather(rows: np.ndarray, index: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``rows[index]`` between consecutive ``edges``, one column at a time to spare memory."""
    out = np.empty((len(edges) - 1, rows.shape[1]))
    for k in range(rows.shape[1]):
        running = np.concatenate([[0.0], np.cumsum(rows[index, k])])
        out[:, k] = running[edges[1:]] - running[edges[:-1]]
    return out


def _scatter(index: np.ndarray, rows: np.ndarray, pick: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows[pick]`` by ``index``."""
    return np.column_stack([np.bincount(index, rows[pick, k], minlength=size) for k in range(rows.shape[1])])


@dataclass
class _Bags:
    """The words of the sample and the buckets of each: ``gram[edges[w]:edges[w + 1]]``."""
    gram: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> _Bags:
        starts, parts = _bags(np.frombuffer(b" ".join(words), np.uint8))
        owner = np.concatenate([np.repeat(np.arange(len(starts)), last - first) for _, first, last in parts])
        bucket = np.concatenate([b[np.repeat(first - np.cumsum(last - first) + (last - first), last - first) + np.arange((last - first).sum())] for b, first, last in parts])
        order = np.argsort(owner, kind="stable")
        return cls(bucket[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(starts)))]))

    def chosen(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of some words, one after the other, and where each begins."""
        sizes = self.edges[words + 1] - self.edges[words]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return self.gram[np.repeat(self.edges[words] - edges[:-1], sizes) + np.arange(edges[-1])], edges


class _Model:
    """Bucket vectors and softmax, and one step of their joint training."""

    def __init__(self) -> None:
        random = np.random.default_rng(7)
        self.vectors = random.normal(0, 0.05, (BUCKETS, WIDTH))
        self.softmax, self.bias = random.normal(0, 0.1, (WIDTH, 2)), np.zeros(2)
        self.squares = [np.full_like(v, 1e-8) for v in (self.vectors, self.softmax, self.bias)]

    def word_logits(self, bags: _Bags) -> np.ndarray:
        """What each word adds to the difference of the logits."""
        table = self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])
        running = np.concatenate([[0.0], np.cumsum(table[bags.gram])])
        return (running[bags.edges[1:]] - running[bags.edges[:-1]]) / np.maximum(np.diff(bags.edges), 1)

    def train(self, bags: _Bags, passages: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rounds: int) -> None:
        sizes = np.array([len(p) for p in passages])
        used, word = np.unique(np.concatenate(passages), return_inverse=True)
        part, of_word = np.repeat(np.arange(len(passages)), sizes), np.concatenate([[0], np.cumsum(sizes)])
        gram, of_gram = bags.chosen(used)
        rows, local = np.unique(gram, return_inverse=True)
        per_word = np.maximum(np.diff(of_gram), 1)[:, None]
        owner, sizes = np.repeat(np.arange(len(used)), np.diff(of_gram)), sizes[:, None]
        target = np.column_stack([1 - labels, labels])
        vectors, square = self.vectors[rows], self.squares[0][rows]
        for _ in range(rounds):
            by_word = _gather(vectors, local, of_gram) / per_word
            hidden = _gather(by_word, word, of_word) / sizes
            logits = hidden @ self.softmax + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - target) * weight[:, None]
            to_word = _scatter(word, error @ self.softmax.T / sizes, part, len(used)) / per_word
            steps = ((vectors, _scatter(local, to_word, owner, len(rows)) + DECAY * vectors, square),
                     (self.softmax, hidden.T @ error + DECAY * self.softmax, self.squares[1]), (self.bias, error.sum(0), self.squares[2]))
            for value, gradient, total in steps:
                total += gradient ** 2
                value -= RATE * gradient / np.sqrt(total)
        self.vectors[rows], self.squares[0][rows] = vectors, square


def _balanced(labels: np.ndarray) -> np.ndarray:
    return np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))


def _short(value: np.ndarray, passages: list[np.ndarray], count: int) -> list[np.ndarray]:
    """The ``count`` runs of ``PASSAGE`` words with the largest mean, of one document's passages; they may not overlap."""
    runs_ = []
    for p in passages:
        size = min(PASSAGE, len(p))
        running = np.concatenate([[0.0], np.cumsum(_once(p, value[p]))])
        mean = (running[size:] - running[:len(p) - size + 1]) / size
        for at in np.argsort(-mean, kind="stable")[:count]:
            runs_.append((-mean[at], len(runs_), p[at:at + size]))
    return [r for _, _, r in sorted(runs_, key=lambda r: r[:2])[:count]]


def _best(value: np.ndarray, passages: list[np.ndarray]) -> float:
    best = _short(value, passages, 1)[0]
    return float(_once(best, value[best]).mean())


def _slope(score: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton's method, slightly damped."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = np.array([(weight * (p - labels) * score).sum() + 1e-3 * (a - 1), (weight * (p - labels)).sum()])
        c = weight * p * (1 - p)
        h = np.array([[(c * score ** 2).sum() + 1e-3, (c * score).sum()], [(c * score).sum(), c.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    return (a, b) if a > 0 else (1.0, 0.0)


def fit(passages: list[tuple[int, int, str]], share: float | None = None) -> Toxicity:
    """Train on (document, label, long passage); the passages are a bounded sample. ``share`` is that of toxic labels."""
    documents = sorted({(d, label) for d, label, _ in passages})
    labels = np.array([label for _, label in documents], float)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 1e-9
        return Toxicity(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    share = min(max(labels.mean() if share is None else share, 1e-3), 1 - 1e-3)
    vocabulary: dict[bytes, int] = {}
    place = {d: k for k, d in enumerate(documents)}
    owned: list[list[np.ndarray]] = [[] for _ in documents]
    for d, label, text in passages:
        owned[place[d, label]].append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in text.encode().split()], np.int64))
    bags, model = _Bags.of(list(vocabulary)), _Model()
    aside = np.array([zlib.crc32(f"aside {d}".encode()) % 5 == 0 for d, _ in documents])
    if len(set(labels[aside])) < 2 or len(set(labels[~aside])) < 2:
        aside[:] = False
    fitted = np.flatnonzero(~aside)
    long = [(p, labels[k]) for k in fitted for p in owned[k][:LONG_PASSAGES]]
    y = np.array([label for _, label in long])
    model.train(bags, [p for p, _ in long], y, _balanced(y), ROUNDS[0])
    random = np.random.default_rng(11)
    for rounds in ROUNDS[1:]:
        value = model.word_logits(bags)
        short: list[tuple[np.ndarray, float]] = []
        for k in fitted:
            short += [(p, labels[k]) for p in _short(value, owned[k], 1 if labels[k] else 6)]
            if not labels[k]:
                short += [(p[a:a + PASSAGE], 0.0) for p in owned[k][:6] for a in [int(random.integers(0, max(1, len(p) - PASSAGE)))]]
        y = np.array([label for _, label in short])
        model.train(bags, [p for p, _ in short], y, _balanced(y), rounds)
    value = model.word_logits(bags)
    judged = np.flatnonzero(aside) if aside.any() else fitted
    y = labels[judged]
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    slope, intercept = _slope(np.array([_best(value, owned[k]) for k in judged]), y, weight)
    return Toxicity(slope * (model.vectors @ (model.softmax[:, 1] - model.softmax[:, 0])), intercept)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training passages: runs of ``LONG_PASSAGE`` words, at most ``TRAINING_PASSAGES`` of a document, by a hash."""
    letters = bytes(b if ALNUM[b] else 32 for b in range(256))
    for batch in batches:
        rows: list[tuple[int, int, str]] = []
        for doc, label, text in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), texts(batch.column("text")), strict=True):
            found = text.translate(LOWER).translate(letters).split()
            cut = [b" ".join(found[k:k + LONG_PASSAGE]) for k in range(0, len(found), LONG_PASSAGE)]
            rows += [(doc, label, p.decode("utf-8", "ignore")) for p in sorted(cut, key=zlib.crc32)[:TRAINING_PASSAGES]]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32()),
                                          "passage": pa.array([r[2] for r in rows], pa.string())})


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, others: int = OTHER_ROWS) -> Toxicity:
    sample = sampled_labels(labels, "toxic", rows, value=1).unionByName(sampled_labels(labels, "toxic", others, value=0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    # At most rows + others documents with a bounded number of passages of a bounded number of words.
    found = read.mapInArrow(_passages, "doc_id long, label int, passage string").limit((rows + others) * TRAINING_PASSAGES).collect()
    share = labels.where(~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    return fit(sorted((r["doc_id"], r["label"], r["passage"]) for r in found if r["passage"]), share)


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, others: int = OTHER_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, rows, others))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(texts(batch.column("text")), lower=True):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[chunk.first:chunk.first + len(chunk)], "score": model.value.scores(chunk)})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
