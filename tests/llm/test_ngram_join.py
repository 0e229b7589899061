import random

from dinesight.llm.ngram_join import jaccard_classes, keep_one_per_class


def shingles(text, size=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def brute(rows, size=3, percent=90):
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted((doc, len(s), least[find(k)]) for k, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(count, length, edits, common=""):
    words = [f"w{random.randint(0, 10 ** 6)}" for _ in range(length)]
    out = []
    for _ in range(count):
        mine = list(words)
        for _ in range(random.randint(0, edits)):
            mine[random.randrange(length)] = f"e{random.randint(0, 10 ** 6)}"
        out.append(common + " ".join(mine))
    return out


def corpus():
    random.seed(9)
    common = "the same long passage opens all of these texts and says nothing new at all " * 2
    texts = [None, "", " \n ", "One", "one", "two words", "Two  WORDS", "a b c", "A b\nc", "a b c d"]
    texts += family(40, 120, 3) + family(25, 60, 2) + family(12, 300, 12) + family(10, 40, 1, common) + [t for k in range(30) for t in family(1, 30, 0, common)]
    texts += [" ".join(f"w{random.randint(0, 40)}" for _ in range(random.randint(1, 60))) for _ in range(60)]
    random.shuffle(texts)
    return list(enumerate(texts + texts[:9]))


def test_classes_against_brute_force(table):
    rows = corpus()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_classes(table(rows)).collect())
    assert got == brute(rows)


def test_five_words_and_eight_tenths(table):
    """Also a pair of similarity 0.82 that three words and 0.9 do not link."""
    near = [f"v{k}" for k in range(104)]
    other = [*near[:50], "edit", *near[51:90], "edit", *near[91:]]
    assert 0.8 <= len(shingles(" ".join(near), 5) & shingles(" ".join(other), 5)) / len(shingles(" ".join(near), 5) | shingles(" ".join(other), 5)) < 0.84
    rows = corpus() + [(900, " ".join(near)), (901, " ".join(other)), (902, "a b c d"), (903, "a b c d e")]
    for size, percent in ((5, 80), (1, 70)):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_classes(table(rows), size=size, percent=percent).collect())
        assert got == brute(rows, size, percent)


def test_one_of_each_class_stays(table):
    rows = corpus()
    docs = table(rows).selectExpr("*", "doc_id AS uid", "doc_id AS node", "1 AS _uid", "2 AS _row", "3 AS _alone", "4 AS row", "5 AS alone", "6 AS copy", "7 AS class")
    kept = sorted(r["doc_id"] for r in keep_one_per_class(docs).collect())
    assert kept == sorted({c if n else d for d, n, c in brute(rows)})


def test_repeated_rows_and_empty_table(table):
    assert jaccard_classes(table([])).collect() == []
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "x y z"), (3, "x y z"), (7, None), (7, None), (None, "q r s")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_classes(table(rows)).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (1, 1, 1), (3, 1, 1), (7, 0, 7), (7, 0, 7), (None, 1, None)], key=repr)
    assert sorted(r["text"] or "" for r in keep_one_per_class(table(rows)).collect()) == ["", "", "a b c d e", "q r s", "x y z"]
