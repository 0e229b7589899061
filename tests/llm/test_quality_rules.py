import random
import re
from collections import Counter

from dinesight.llm.common import read_table
from dinesight.llm.quality_rules import keep_good, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    again = len(covered)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), again,
            len(words) < 50 or 100 * again > 50 * len(words))


def corpus():
    random.seed(3)
    words = [a + b for a in ("tree", "river", "haus", "été", "walk", "slow") for b in ("", "s", "en", "ly", "er", "ing", "ed", "heit", "ment", ".")]
    clean = [" ".join(random.choice(words) for _ in range(90)) for _ in range(500)]
    junk = [" ".join(random.choice(words) + random.choice(["###", "$$$", "%%%", "***"]) for _ in range(90)) for _ in range(90)]
    odd = [None, "", " ", "\n\n", "a\na\n \na b\na", "é " * 60, "x", "a b c " * 30, "same line\n" * 40, "w" * 3_000_000, " wide spaces are no white space\x00 " * 9]
    return clean + junk + odd, len(clean), len(junk)


def test_base_counts_and_verdict(table, labelled):
    texts, clean, junk = corpus()
    labels = labelled([(k, int(k < clean), 0) for k in range(clean + junk)])
    got = {r["doc_id"]: r for r in quality_rules(table(texts), labels).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), k
        assert not (r["base_failed"] and r["kept"])
    assert all(got[k]["kept"] for k in range(clean)) and not any(got[k]["kept"] for k in range(clean, clean + junk))
    docs = table(texts).selectExpr("*", "doc_id AS score", "doc_id AS kept")
    assert sorted(r["doc_id"] for r in keep_good(docs, labels).collect()) == sorted(k for k, r in got.items() if r["kept"])


def test_without_labels_base_rules_decide(table, labelled):
    texts, _, _ = corpus()
    rows = quality_rules(table([*texts, (0, texts[0]), (None, texts[0])]), labelled([])).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["score"] == 0 for r in rows) and len(rows) == len(texts) + 2
    assert quality_rules(table([]), labelled([])).collect() == []


def test_few_trusted_documents_reject_junk(spark, table, labelled):
    texts, clean, junk = corpus()
    got = {r["doc_id"]: r for r in quality_rules(table(texts), labelled([(k, 1, 0) for k in range(40)])).collect()}
    assert all(got[k]["kept"] for k in range(clean)) and not any(got[k]["kept"] for k in range(clean, clean + junk))
    docs, labels = (read_table(spark, "/root/testdata/sf0.001", name) for name in ("documents", "labels"))
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for trusted in (labels, labels.where("doc_id % 3 = 0")):
        for r in quality_rules(docs, trusted).collect():
            if quality.get(r["doc_id"]) is not None:
                assert r["kept"] == (quality[r["doc_id"]] == 1 and not r["base_failed"]), r
