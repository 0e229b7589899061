import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from dinesight.llm.rule_ensemble import STATISTICS, compiled, fit_rules, quality_scores
from dinesight.llm.toxicity import toxicity_scores

WORDS = ["river", "stone", "haus", "garden", "window", "été", "walking", "slowly", "paper", "letter", "morning", "music"]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def corpus():
    random.seed(6)
    rows, labels = [], []
    for k in range(600):
        words = [random.choice(WORDS) + random.choice(["", "s", "en", "ly", str(random.randint(0, 9))]) for _ in range(random.randint(20, 300))]
        bad, toxic = k % 4 == 0, k % 5 == 0
        if bad:
            words = [w + random.choice(["###", "$$$", "%%%"]) for w in words]
        if toxic:
            for _ in range(3):
                words[random.randrange(len(words))] = random.choice(["idiot", "moron", "worthless", "pathetic"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


def test_quality_on_held_out_rows(table, labelled):
    rows, labels = corpus()
    docs = table(rows).selectExpr("*", "1 AS log_words", "2 AS score")
    got = {r["doc_id"]: r for r in quality_scores(docs, labelled(labels)).collect()}
    assert all(got[k]["held_out"] == held(k) for k, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    right = [got[k]["predicted"] == q for k, q, _ in labels if held(k)]
    assert np.mean(right) > 0.97
    # Labels of held-out rows do not matter.
    changed = {r["doc_id"]: r["score"] for r in quality_scores(docs, labelled([(k, 1 - q if held(k) else q, t) for k, q, t in labels])).collect()}
    assert all(abs(changed[k] - got[k]["score"]) < 1e-12 for k, _ in rows)


def test_compiled_rules_equal_the_model(spark):
    random_ = np.random.default_rng(2)
    x = random_.uniform(size=(500, len(STATISTICS))).round(6)
    y = ((x[:, 2] > 0.5) & (x[:, 4] <= 0.7)).astype(float)
    rules, bias = fit_rules(x, y)
    assert 0 < len(rules) < 80
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in STATISTICS))
    want = 1 / (1 + np.exp(-(bias + sum(w * r.holds(x) for r, w in rules))))
    got = [r["s"] for r in frame.select(compiled(rules, bias).alias("s")).collect()]
    assert np.abs(np.sort(got) - np.sort(want)).max() < 1e-9 and ((want > 0.5) == (y == 1)).mean() > 0.97


def test_toxicity_on_held_out_rows_and_misspellings(table, labelled):
    rows, labels = corpus()
    rows += [(1000, " ".join(random.choice(WORDS) for _ in range(3000)) + " you worthles idi0t moronn " + " ".join(random.choice(WORDS) for _ in range(3000))),
             (1001, " ".join(random.choice(WORDS) for _ in range(6000)))]
    got = {r["doc_id"]: r for r in toxicity_scores(table(rows).selectExpr("*", "1 AS label", "1 AS passage"), labelled(labels)).collect()}
    assert all(got[k]["held_out"] == held(k) and 0 <= got[k]["score"] <= 1 for k, _ in rows)
    assert np.mean([got[k]["predicted"] == t for k, _, t in labels if held(k)]) > 0.97
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == 0


def test_odd_rows_and_missing_labels(table, labelled):
    rows = [(1, None), (1, None), (2, ""), (3, "a"), (None, "word " * 9), (4, "w" * 100_000), (5, " " * 1000)]
    _, labels = corpus()
    for scores in (quality_scores, toxicity_scores):
        for given in (labels, [], [(1, 1, 1)], [(None, 1, 1), (2, None, None)]):
            got = scores(table(rows), labelled(given)).collect()
            assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert scores(table([]), labelled(labels)).collect() == []
    assert {round(r["score"], 9) for r in quality_scores(table(rows), labelled([])).collect()} == {0.5}
    assert isinstance(quality_scores(table(rows), labelled(labels)).select(F.col("score")).first()[0], float)
