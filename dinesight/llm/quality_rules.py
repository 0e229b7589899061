"""Operator 4: quality rules with a hashed n-gram log-likelihood ratio.

Each text is read as tokens (runs of letters and digits, runs of other
characters); their unigrams and bigrams are hashed into a fixed number of
buckets. Two multinomials over the buckets are counted: one over all documents,
one over trusted ones. A document's score is the mean of
``log p_trusted - log p_raw`` over its n-grams, each bucket backed off by itself; it is kept when the base rules
hold and the score is at least ``threshold``. The verdict has no random part.

Null and empty texts have no words and fail the base rules (score 0). Repeated
rows are judged each for itself, alike. With no trusted document the ratio is 0
everywhere, so the base rules decide alone. Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinesight.llm.common import sampled_labels
from dinesight.llm.kernel import CLASSES, WORDS, Chunk, Hashes, Words, chunks, mix, owners, per_doc, repeats, shingles, texts, words

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
THRESHOLD = -0.36
BACK_OFF = 3.5
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def ngram_buckets(chunk: Chunk, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every token unigram and bigram."""
    kind = CLASSES[chunk.data]
    edge = np.flatnonzero(np.diff(kind, prepend=255))
    ends = np.append(edge[1:], len(kind))
    keep = kind[edge] > 0
    starts, ends = edge[keep], ends[keep]
    token, doc = hashes.of(starts, ends), owners(chunk, starts)
    pair, first = shingles(Words(starts, ends, doc, token), 2)
    h = np.concatenate([mix(token + np.uint64(11)), pair])
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([doc, doc[first]])


def base_statistics(chunk: Chunk, w: Words, hashes: Hashes) -> dict[str, np.ndarray]:
    """The counts of the base rules, one entry per document."""
    points = np.concatenate([[0], np.cumsum(_CODE_POINT[chunk.data])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[chunk.data])])
    h, first = shingles(w, 3)
    seen = repeats(w.doc[first], h)[0] > 1
    covered = np.zeros(len(w.doc), bool)
    for k in range(3):
        covered[first[seen] + k] = True
    breaks = np.flatnonzero(chunk.data == 10)
    breaks = breaks[breaks < chunk.ends[owners(chunk, breaks)]]
    line_starts = np.sort(np.concatenate([chunk.starts, breaks + 1]))
    line_ends = np.sort(np.concatenate([chunk.ends, breaks]))
    filled = np.searchsorted(w.starts, line_ends) > np.searchsorted(w.starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_doc = owners(chunk, line_starts)
    again = repeats(line_doc, hashes.of(line_starts, line_ends))[1] == 0
    return {
        "n_words": per_doc(chunk, w.doc),
        "word_chars": per_doc(chunk, w.doc, points[w.ends] - points[w.starts]),
        "n_symbols": symbols[chunk.ends] - symbols[chunk.starts],
        "n_dup_lines": per_doc(chunk, line_doc[again]),
        "n_repeat_words": per_doc(chunk, w.doc[covered]),
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = np.asarray(batch.column("trusted").to_pylist(), bool)
        for chunk in chunks(texts(batch.column("text")), lower=False):
            bucket, doc = ngram_buckets(chunk, Hashes(chunk.data))
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[trusted[chunk.first:][doc]], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "raw": raw[used], "target": target[used]})


def ngram_ratios(docs: DataFrame, trusted_ids: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of every bucket: counts over all documents, reduced by Spark to one row per bucket.

    ``trusted_ids`` is bounded by the caller; the result has ``BUCKETS`` numbers whatever the input.
    """
    ids = F.broadcast(trusted_ids.select("doc_id").distinct().withColumn("trusted", F.lit(True)))
    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    rows = (marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(BUCKETS)
    # Each bucket backs off by itself: against the count that the raw distribution lets expect on the trusted side. A
    # bucket the trusted side can hardly have shown yet says little, a frequent one that it lacks speaks against a text
    # however few documents are trusted.
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + BACK_OFF) / (expected + BACK_OFF))


def _judge(batch: pa.RecordBatch, ratio: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """All columns of the verdict for one batch."""
    parts: list[dict[str, np.ndarray]] = []
    for chunk in chunks(texts(batch.column("text"))):
        hashes = Hashes(chunk.data)
        row = base_statistics(chunk, words(chunk, WORDS, hashes), hashes)
        bucket, doc = ngram_buckets(chunk, hashes)
        row["score"] = np.bincount(doc, ratio[bucket], minlength=len(chunk)) / np.maximum(np.bincount(doc, minlength=len(chunk)), 1)
        row["base_failed"] = (row["n_words"] < MIN_WORDS) | (100 * row["n_repeat_words"] > MAX_REPEATED_PERCENT * row["n_words"])
        row["kept"] = ~row["base_failed"] & (row["score"] >= threshold)
        parts.append(row)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _fitted(docs: DataFrame, labels: DataFrame, target_rows: int) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(ngram_ratios(docs, sampled_labels(labels, "quality", target_rows, value=1)))


def quality_rules(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, kept and the ratio as score.

    Trusted documents are those labelled good; at most ``target_rows`` of them,
    chosen by a hash of the id, shape the trusted multinomial. Raw counts,
    scores and verdicts cover every document.
    """
    ratios = _fitted(docs, labels, target_rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, score double")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if columns := _judge(batch, ratios.value, threshold):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {n: columns[n] for n in names})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judged, schema)


def keep_good(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, unchanged, with all their columns."""
    ratios = _fitted(docs, labels, target_rows)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if columns := _judge(batch, ratios.value, threshold):
                yield batch.filter(pa.array(columns["kept"]))

    return docs.mapInArrow(kept, docs.schema)
