import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from dinesight.llm import suffix_dedup as module
from dinesight.llm.suffix_array import suffix_array
from dinesight.llm.suffix_dedup import _keyed, _packed, repeated_spans, suffix_dedup, without_repeats


def test_suffix_array_against_sorting():
    random.seed(1)
    for _ in range(400):
        text = [random.randint(0, random.choice([0, 1, 2, 4])) for _ in range(random.randint(0, 40))]
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array(np.zeros(0)).tolist() == []


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus():
    random.seed(4)
    base = "".join(random.choice("abcdé ") for _ in range(900))
    texts = [None, "", "short", base, base, "é" * 300, "x" + "ab" * 200, base[100:400] + "!" + base[500:800]]
    for k in range(40):  # one passage amid ever different text, and edited copies
        texts.append(f"{k} {random.random()} {base[200:330]} {random.random()} {k}")
        edited = list(base[:random.randint(100, 900)])
        edited[random.randrange(len(edited))] = "#"
        texts.append("".join(edited))
    return texts


@pytest.mark.parametrize("group_bytes", [1 << 19, 300])
def test_against_brute_force(table, group_bytes):
    """Also with a bound so low that most anchors are hot."""
    texts = corpus()
    rows = suffix_dedup(table(texts), 60, 10, group_bytes).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert [got[k] for k in range(len(texts))] == brute(texts, 60)


def test_repeated_rows_nulls_and_empty_table(table):
    text = "".join(chr(97 + (k * k) % 23) for k in range(500))
    rows = suffix_dedup(table([(1, text), (1, text), (None, text), (2, None)])).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0), (500, 500), (500, 500), (500, 500)]
    assert suffix_dedup(table([])).collect() == []


def test_a_thousand_equal_rows(table):
    """Equal rows share their spans instead of multiplying them."""
    random.seed(3)
    shared = "".join(random.choice("abcdefgh ") for _ in range(700))
    others = [(2, "y" * 70 + shared), (3, shared[50:600] + "z" * 30)]

    def spans(times):
        keyed = _keyed(table([(1, shared + "x" * 90)] * times + others))
        return sorted(len(r["spans"]) for r in repeated_spans(keyed, _packed(keyed), 60).collect())
    assert spans(1000) == spans(2)
    docs = table([(1, shared + "x" * 90)] * 1000 + others)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup(docs, 60).collect())
    assert got == [(1, 790, 790)] * 1000 + [(2, 770, 770), (3, 580, 550)]


def test_cut_texts_keep_columns(table):
    texts = corpus()
    docs = table(texts).selectExpr("*", "doc_id AS uid", "doc_id AS spans", "1 AS _uid", "2 AS _spans", "3 AS row", "4 AS packed")
    rows = {r["doc_id"]: r for r in without_repeats(docs, 60).collect()}
    assert rows[0]["text"] is None and rows[2]["text"] == "short" and rows[3]["text"] == "" and rows[3]["n_chars"] == 0
    for k, (_, _, _, digest) in enumerate(brute(texts, 60)):
        if texts[k] and texts[k].isascii():
            assert hashlib.sha256(rows[k]["text"].encode()).hexdigest() == digest
    assert rows[5]["uid"] == 5 and rows[5]["spans"] == 5


def test_a_hot_passage_is_counted_by_blocks(table, monkeypatch):
    """Few of the repeated windows of a passage amid ever different text are looked up one by one."""
    random.seed(5)
    letters = lambda n: "".join(random.choice("abcdefghijkl ") for _ in range(n))
    passage = letters(150)
    texts = [letters(80) + passage + letters(80) for _ in range(30)]
    blocks, ranges = [], []

    def seen(rows, length, whole=module._hot_ranges):
        blocks.append(rows.count())
        ranges.append(whole(rows, length))
        return ranges[-1]
    monkeypatch.setattr(module, "_hot_ranges", seen)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(table(texts), 60, 10, 300).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 60)
    # At least 91 windows repeat in each of 30 texts; a fragment gives one range and a row per block.
    found = ranges[0].groupBy("key", "frag").count().collect()
    assert found and all(r["count"] == 1 for r in found) and blocks[0] < 30 * 311 / 4
