"""Operator 8: licence scan with a positional rare-token index.

Templates of licence statements are indexed by their rarest words and the rarest
word of their key phrase, with positions; rarity is the inverse document
frequency over all documents. A file looks up every indexed word it holds; every
posting votes for a template at a relative position. Templates with votes are
compared with the file in place, word by word, and count only if their mandatory
key phrase stands where it should: as one of its words votes wherever it stands,
no statement is missed. The best share of equal words is the score.

Beside that the base rule holds whatever the method says: places where a fixed
phrase's words stand consecutively, and their labels. Null and empty texts have
no words, no labels, score 0 and null positions. Repeated rows score alike. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinesight.llm.kernel import ALNUM, Words, chunks, per_doc, repeats, texts, words

#: Base phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Statements, the label they give and the phrase that has to stand in place.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl", "gnu general public license"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "gnu general public license"),
    ("licensed under the gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    ("licensed under the gnu affero general public license", "agpl", "gnu affero general public license"),
    ("licensed under the apache license version 2 0", "apache", "apache license"),
    ("you may not use this file except in compliance with the license", "apache", "in compliance with the license"),
    ("released under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "permission is hereby granted"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "source and binary forms"),
    ("licensed under the bsd license", "bsd", "bsd license"),
    ("licensed under cc by 4 0", "cc-by", "cc by"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "cc by nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa", "cc by nc sa"),
    ("licensed under a creative commons attribution license", "cc-by", "creative commons attribution"),
    ("subject to the terms of the mozilla public license version 2 0", "mpl", "mozilla public license"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", "permission to use copy modify"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered software"),
)
INDEXED = 4
COVERAGE = 0.7


def word_hash(word: str) -> int:
    """The hash that ``words`` gives a word."""
    chunk = next(chunks([word.encode()]))
    return int(words(chunk, ALNUM).hash[0])


def _places(w: Words, phrase: list[int]) -> np.ndarray:
    """Indexes where the words of ``phrase`` stand consecutively in one document."""
    at = np.flatnonzero(w.hash == np.uint64(phrase[0]))
    at = at[at + len(phrase) <= len(w.hash)]
    for k, h in enumerate(phrase[1:], 1):
        at = at[w.hash[at + k] == np.uint64(h)]
    return at[w.doc[at] == w.doc[at + len(phrase) - 1]] if len(at) else at


def _vocabulary(templates: tuple) -> dict[str, int]:
    return {word: word_hash(word) for word in sorted({word for t, _, _ in templates for word in t.split()})}


def frequencies(docs: DataFrame, templates: tuple = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, and the number of documents; as many rows as licence words."""
    vocabulary = _vocabulary(templates)
    hashes = np.array(sorted(vocabulary.values()), np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(hashes), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for chunk in chunks(texts(batch.column("text")), lower=True):
                w = words(chunk, ALNUM)
                at = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
                known = hashes[at] == w.hash
                doc, at = w.doc[known], at[known]
                first = repeats(doc, at.astype(np.uint64))[1] == 1
                total += np.bincount(at[first], minlength=len(hashes))
        yield pa.RecordBatch.from_pydict({"word": pa.array([*hashes.view(np.int64).tolist(), 0], pa.int64()), "n": [*total.tolist(), n]})

    rows = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {word: rows.get(int(np.uint64(h).astype(np.int64)), 0) for word, h in vocabulary.items()}, rows.get(0, 0)


@dataclass(frozen=True)
class Index:
    """Postings of the templates' rarest words, those of the key phrases among them; bounded by the templates."""
    templates: tuple[tuple[np.ndarray, str, int, list[int]], ...]  # words, label, place of the key phrase, key phrase
    postings: dict[int, list[tuple[int, int]]]


def build_index(frequency: dict[str, int], total: int, templates: tuple = TEMPLATES) -> Index:
    vocabulary = _vocabulary(templates)
    idf = {w: float(np.log((total + 1) / (frequency.get(w, 0) + 0.5))) for w in vocabulary}
    compiled, postings = [], {}
    for k, (text, label, key) in enumerate(templates):
        parts, key_parts = text.split(), key.split()
        place = next(i for i in range(len(parts)) if parts[i:i + len(key_parts)] == key_parts)
        compiled.append((np.array([vocabulary[w] for w in parts], np.uint64), label, place, [vocabulary[w] for w in key_parts]))
        rarest = sorted(set(parts), key=lambda w: (-idf[w], w))
        for word in {*rarest[:INDEXED], next(w for w in rarest if w in key_parts)}:
            postings.setdefault(vocabulary[word], []).extend((k, i) for i, p in enumerate(parts) if p == word)
    return Index(tuple(compiled), postings)


def _candidates(index: Index, w: Words, hits: np.ndarray) -> set[tuple[int, int]]:
    """(template, place of its key phrase) wherever a vote meets the whole key phrase in the voting word's document."""
    found = set()
    order = hits[np.argsort(w.hash[hits], kind="stable")]
    held, cuts = np.unique(w.hash[order], return_index=True)
    for h, own in zip(held.tolist(), np.split(order, cuts)[1:], strict=True):
        for k, posted in index.postings[h]:
            _, _, place, key = index.templates[k]
            at = own - posted + place
            inside = (at >= 0) & (at + len(key) <= len(w.hash))
            voter, at = own[inside], at[inside]
            for n, word in enumerate(key):
                same = (w.hash[at + n] == np.uint64(word)) & (w.doc[at + n] == w.doc[voter])
                voter, at = voter[same], at[same]
            found.update((k, i) for i in at.tolist())
    return found


def _coverage(template: np.ndarray, own: np.ndarray, offset: int) -> float:
    """Share of the template's words that stand in place in the file's words ``own``; the template begins at ``offset``."""
    a, b = max(0, offset), min(len(own), offset + len(template))
    return float((own[a:b] == template[a - offset:b - offset]).sum()) / len(template)


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = docs.sparkSession.sparkContext.broadcast(build_index(*frequencies(docs, templates), templates))
    phrases = [([word_hash(w) for w in phrase.split()], label) for phrase, label in PHRASES.items()]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexed = np.array(sorted(index.value.postings), np.uint64)
        for batch in batches:
            for chunk in chunks(texts(batch.column("text")), lower=True):
                w, n = words(chunk, ALNUM), len(chunk)
                begin = np.searchsorted(w.doc, np.arange(n + 1))
                base: list[set[str]] = [set() for _ in range(n)]
                where = [(_places(w, hashes), label) for hashes, label in phrases]
                for at, label in where:
                    for d in np.unique(w.doc[at]).tolist():
                        base[d].add(label)
                places = np.sort(np.concatenate([at for at, _ in where]))
                count = per_doc(chunk, w.doc[places])
                low, high = np.searchsorted(w.doc[places], np.arange(n)), np.searchsorted(w.doc[places], np.arange(n), "right") - 1
                none = count == 0
                first, last = (np.where(none, 0, np.append(places, 0)[k] - begin[:-1]) for k in (low, high))
                found, scores = [set(b) for b in base], np.zeros(n)
                near = np.minimum(np.searchsorted(indexed, w.hash), len(indexed) - 1)
                hits = np.flatnonzero(indexed[near] == w.hash)
                for k, at in _candidates(index.value, w, hits):
                    template, label, place, _ = index.value.templates[k]
                    d = int(w.doc[at])
                    coverage = _coverage(template, w.hash[begin[d]:begin[d + 1]], at - place - int(begin[d]))
                    if coverage >= COVERAGE:
                        found[d].add(label)
                        scores[d] = max(scores[d], coverage)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[chunk.first:chunk.first + n], "n_words": np.diff(begin), "n_base": count,
                    "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none),
                    "base_labels": pa.array([",".join(sorted(b)) for b in base], pa.string()), "labels": pa.array([",".join(sorted(f)) for f in found], pa.string()),
                    "score": scores})

    return docs.mapInArrow(scan, schema)
