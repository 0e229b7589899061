from collections import defaultdict

import pytest

from dinesight.llm.mixing import mix_sources, mixed_documents


def water_fill(sizes):
    """Targets by hand: share by weight, clamp, share the excess again."""
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        if not free:
            return fixed
        level = (budget - sum(fixed.values())) / sum(free.values())
        full = [s for s, w in free.items() if level * w > 2 * sizes[s]]
        if not full:
            return fixed | {s: level * w for s, w in free.items()}
        fixed |= {s: 2.0 * sizes[s] for s in full}


def corpus():
    rows = [(k, "word " * (k % 17), ["a", "b", "c", "Z", "é", None][k % 6] if k % 5 else "a") for k in range(900)]
    return [*rows, (900, None, "b"), (901, "", "empty"), (902, " \t\n\x0b ", "empty"), (903, "one two", "a"), (903, "one two", "a")]


def test_targets_and_taken(table):
    rows = corpus()
    got = mix_sources(table(rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {}
    for doc, text, s in rows:
        sizes[s] += len((text or "").split())
        source.setdefault(doc, s)
    want = water_fill(dict(sizes))
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert len(got) == len(rows)
    for s, target in want.items():
        assert abs(taken[s] - target) <= 9  # half a document


def test_mix_repeats_documents_unchanged(table):
    docs = table(corpus()).selectExpr("*", "doc_id AS _extra", "1 AS target", "2 AS source_size", "3 AS _size", "4 AS _s", "5 AS row", "6 AS _order")
    times = defaultdict(int)
    for r in mixed_documents(docs).collect():
        assert r["_extra"] == r["doc_id"]
        times[r["doc_id"]] += len((r["text"] or "").split())
    want = defaultdict(int)
    for r in mix_sources(docs).collect():
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in times.items() if v} == {k: v for k, v in want.items() if v}


def test_empty_tables(table):
    assert mix_sources(table([])).collect() == []
    assert [(r["size"], r["target"], r["taken"]) for r in mix_sources(table([None, ""])).collect()] == [(0, 0.0, 0)] * 2
