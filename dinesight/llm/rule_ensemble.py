"""Operator 5: quality classifier, a sparse ensemble of rules.

Shallow trees are boosted on statistics of labelled texts; every path from a root
to a node becomes a conjunctive rule (such as: symbol share over 0.02 and mean
word length up to 4.1). A logistic model with a lasso penalty weighs the rules,
most of them with 0. The rest compile into one Spark column expression over the
statistics, which scores every document.

Labels of held-out rows (crc32 of the id modulo 4 is 2) are never read; at most
``TRAINING_ROWS`` others, chosen by a hash of the id, are learned from. Null and
empty texts have statistics 0 and a score like any other. Without labels every
score is 0.5; with one class it is near that class's share. Repeated rows score
alike. Only ``doc_id`` and ``text`` are inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinesight.llm.common import held_out, sampled_labels
from dinesight.llm.kernel import CLASSES, WORDS, Chunk, Hashes, chunks, per_doc, repeats, texts, words
from dinesight.llm.quality_rules import base_statistics

TRAINING_ROWS = 10_000
TREES = 24
DEPTH = 3
BINS = 32
PENALTY = 2e-3
THRESHOLD = 0.7

STATISTICS = ("log_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
              "punctuation_share", "non_ascii_share", "distinct_share", "words_per_line", "exclamation_share")


def _counter(flags: np.ndarray, chunk: Chunk) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(flags)])
    return running[chunk.ends] - running[chunk.starts]


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of ``STATISTICS`` per document."""
    hashes = Hashes(chunk.data)
    w = words(chunk, WORDS, hashes)
    base = base_statistics(chunk, w, hashes)
    data = chunk.data
    n, chars, size = base["n_words"], base["word_chars"], chunk.ends - chunk.starts
    upper, lower = _counter((data >= 65) & (data <= 90), chunk), _counter((data >= 97) & (data <= 122), chunk)
    lines = 1 + _counter(data == 10, chunk)
    distinct = per_doc(chunk, w.doc[repeats(w.doc, w.hash)[1] == 1])

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    return np.column_stack([
        np.log1p(n), share(chars, n), share(base["n_symbols"], chars), share(base["n_dup_lines"], lines), share(base["n_repeat_words"], n),
        share(upper, upper + lower), share(_counter((data >= 48) & (data <= 57), chunk), size), share(_counter(CLASSES[data] == 2, chunk), size),
        share(_counter(data >= 128, chunk), size), share(distinct, n), share(n, lines), share(_counter(data == 33, chunk), n)]).round(6)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every whole text."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(texts(batch.column("text"))):
                values = statistics(chunk)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[chunk.first:chunk.first + len(chunk)]}
                                                 | {name: values[:, k] for k, name in enumerate(STATISTICS)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        compute, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether over, bound)."""
    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, k] > bound) == over for k, over, bound in self.parts])

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(STATISTICS[k]) > bound if over else F.col(STATISTICS[k]) <= bound for k, over, bound in self.parts])


def _tree_rules(x: np.ndarray, residual: np.ndarray, bounds: list[np.ndarray]) -> tuple[list[Rule], np.ndarray]:
    """Rules of all nodes of one least-squares tree, and what its leaves predict."""
    rules: list[Rule] = []
    predicted = np.zeros(len(x))

    def grow(rows: np.ndarray, parts: tuple) -> None:
        target = residual[rows]
        predicted[rows] = target.mean()
        if len(parts) == DEPTH or len(rows) < 20:
            return
        best = (1e-9, -1, 0.0)
        for k, cuts in enumerate(bounds):
            cell = np.searchsorted(cuts, x[rows, k], "left")
            count = np.cumsum(np.bincount(cell, minlength=len(cuts) + 1))[:-1]
            total = np.cumsum(np.bincount(cell, target, minlength=len(cuts) + 1))[:-1]
            fits = (count >= 10) & (len(rows) - count >= 10)
            if fits.any():
                rest, others = target.sum() - total, len(rows) - count
                gain = np.where(fits, total ** 2 / np.maximum(count, 1) + rest ** 2 / np.maximum(others, 1) - target.sum() ** 2 / len(rows), 0)
                if gain.max() > best[0]:
                    best = (gain.max(), k, float(cuts[gain.argmax()]))
        if best[1] < 0:
            return
        over = x[rows, best[1]] > best[2]
        for side in (False, True):
            path = (*parts, (best[1], side, best[2]))
            rules.append(Rule(path))
            grow(rows[over == side], path)

    grow(np.arange(len(x)), ())
    return rules, predicted


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Weighted rules and intercept for labels ``y`` of 0 and 1."""
    if not len(y):
        return [], 0.0
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return [], bias
    bounds = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
    logit, found = np.full(len(y), bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        rules, predicted = _tree_rules(x, y - p, bounds)
        found.update(dict.fromkeys(rules))
        logit += predicted
    rules = list(found)
    if not rules:
        return [], bias
    active = np.column_stack([r.holds(x) for r in rules]).astype(float)
    center, scale = active.mean(0), np.maximum(active.std(0), 0.05)
    z = (active - center) / scale
    # Proximal gradient with momentum; rows and columns are bounded by the sample and the trees.
    step = 4 / max(np.linalg.norm(z, 2) ** 2 / len(y), 1e-9)
    weight, ahead, momentum = np.zeros(len(rules)), np.zeros(len(rules)), 1.0
    for _ in range(400):
        error = 1 / (1 + np.exp(-(z @ ahead + bias))) - y
        moved = ahead - step * (z.T @ error) / len(y)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        bias -= float(error.mean())
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead, weight, momentum = new + (momentum - 1) / following * (new - weight), new, following
    used = np.flatnonzero(np.abs(weight) > 1e-6)
    return [(rules[k], float(weight[k] / scale[k])) for k in used], bias - float((weight * center / scale).sum())


def compiled(rules: list[tuple[Rule, float]], bias: float) -> Column:
    """The score as a column expression over the statistics."""
    logit = reduce(lambda a, b: a + b, [F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in rules], F.lit(bias))
    return 1 / (1 + F.exp(-logit))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    sample = sampled_labels(labels, "quality", rows)
    # The sample is bounded by ``rows``, and so is what is collected: one row of numbers for each.
    learned = with_statistics(docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(sample), "doc_id").limit(rows).collect()
    learned.sort(key=lambda r: (r["doc_id"], *[r[s] for s in STATISTICS]))
    x = np.array([[r[s] for s in STATISTICS] for r in learned]).reshape(len(learned), len(STATISTICS))
    rules, bias = fit_rules(x, np.array([r["label"] for r in learned], float))
    scored = with_statistics(docs).withColumn("score", compiled(rules, bias))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
