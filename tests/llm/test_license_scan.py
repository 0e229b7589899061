import re

from dinesight.llm.license_scan import COVERAGE, PHRASES, TEMPLATES, license_scan

TEXTS = [None, "", "nothing here", "Released under the MIT License.", "x y\nLicensed under the Apache License, Version 2.0.\nmit mit mit license",
         "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "cc by cc by", "GNU  general\n\npublic--license",
         "gnu general public", "Die Sache mit Licenses", "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
         "released under some mit licence", "ÀMIT license mité license", "cc", "by cc by", "word " * 5000 + "released under the mit license"]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


def test_base_rule_against_brute_force(table):
    rows = {r["doc_id"]: r for r in license_scan(table(TEXTS).selectExpr("*", "1 AS score", "1 AS labels")).collect()}
    for k, text in enumerate(TEXTS):
        r = rows[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_templates_need_place_and_key_phrase(table):
    rows = {r["doc_id"]: r for r in license_scan(table(TEXTS)).collect()}
    assert rows[6]["labels"] == "cc-by,cc-by-nc" and rows[6]["score"] == 1
    assert rows[11]["labels"] == "mit" and rows[11]["base_labels"] == ""
    assert rows[16]["labels"] == "mit" and rows[16]["score"] == 1 and rows[16]["first_word"] == 5003
    assert all(rows[k]["labels"] == "" and rows[k]["score"] == 0 for k in (0, 1, 2, 9, 10, 12, 14))


def test_repeated_rows_and_empty_table(table):
    rows = license_scan(table([(1, TEXTS[3]), (1, TEXTS[3]), (None, TEXTS[3])])).collect()
    assert len(rows) == 3 and {r["labels"] for r in rows} == {"mit"}
    assert license_scan(table([])).collect() == []


def statements(text):
    """Labels and best share of equal words by trying every template at every place."""
    words, labels, best = text.split(), set(), 0.0
    for template, label, key in TEMPLATES:
        t, k = template.split(), key.split()
        place = next(i for i in range(len(t)) if t[i:i + len(k)] == k)
        for at in range(-len(t), len(words)):
            if at + place >= 0 and words[at + place:at + place + len(k)] == k:
                share = sum(0 <= at + i < len(words) and words[at + i] == t[i] for i in range(len(t))) / len(t)
                if share >= COVERAGE:
                    labels.add(label)
                    best = max(best, share)
    return labels, best


def test_every_statement_of_a_file_is_found(table):
    """Files with all statements, with rarer licence words beside one statement, and with statements that miss their rarest words."""
    texts = [" x ".join(t for t, _, _ in TEMPLATES),
             "mozilla public purpose domain granted unencumbered charge person obtaining binary and licensed under the gnu lesser general public license"]
    rare = {w for t, _, k in TEMPLATES for w in t.split()}
    for t, _, key in TEMPLATES:
        words = t.split()
        spare = len(words) - int(-(-COVERAGE * len(words) // 1))
        for gone in (words[:spare], words[-spare:]):
            texts.append(" ".join("zzz" if w in gone and w not in key.split() else w for w in words))
    texts += ["filler text with " + w for w in sorted(rare) for _ in range(2)]
    rows = {r["doc_id"]: r for r in license_scan(table(texts)).collect()}
    for k, text in enumerate(texts):
        labels, best = statements(text)
        assert set(filter(None, rows[k]["labels"].split(","))) == labels | set(filter(None, rows[k]["base_labels"].split(","))) and rows[k]["score"] == best
    assert set(rows[0]["labels"].split(",")) == {label for _, label, _ in TEMPLATES} and "lgpl" in rows[1]["labels"]
    assert [(r["labels"], r["score"]) for r in license_scan(table(["no such words", None])).collect()] == [("", 0), ("", 0)]
