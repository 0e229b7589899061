import random

import numpy as np
import pytest

from dinesight.llm.sentencepiece import MARK, Automaton, Model, Transducer, default_model, encoded, read_model

sp = pytest.importorskip("sentencepiece")


def samples():
    random.seed(2)
    letters = list("abcdeéñ ▁  日本\n\t.,'\"0123😀")
    fixed = ["", " ", "  a  b ", "\n\n x\ty\n", "日本語テスト😀é", "a▁b", "<s>hello</s>", "<0x0A>", "   def f(x):\n        return x", "é" * 500, "the quick brown fox " * 300,
             "supercalifragilistic" * 50, "\x00\x01 control"]
    return fixed + ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(600)]


def test_ids_equal_merging_and_decode_round_trips():
    """The shortest path gives what merging gives."""
    transducer, known = Transducer(read_model(default_model())), sp.SentencePieceProcessor(model_file=default_model())
    for text in samples():
        ids = transducer.encode(text)
        assert ids.tolist() == known.encode(text), text
        assert transducer.decode(ids) == text.replace(MARK, " ")


def test_unigram_weights_give_the_best_segmentation():
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "ab", "▁a", "bab", "aba"]
    scores = [0.0] * 257 + [-3.0, -2.0, -2.5, -2.2, -3.1, -4.0, -4.5]
    model = Model(pieces, {p: k for k, p in enumerate(pieces) if k > 256}, scores, list(range(1, 257)), False)

    def best(text):
        options = [(0.0, [])] if not text else []
        for piece, k in model.ids.items():
            if text.startswith(piece):
                cost, rest = best(text[len(piece):])
                options.append((cost - scores[k], [k, *rest]))
        return min(options)
    for text in ("a", "ab", "abab", "babab", "aababba"):
        ids = Transducer(model).word("▁" + text)
        assert sum(-scores[k] for k in ids) == pytest.approx(best("▁" + text)[0])
    assert Transducer(model).decode(np.array(Transducer(model).encode("aéb"))) == "aéb"


def test_table(table):
    docs = table([None, "", "hello world", (2, "hello world")]).selectExpr("*", "'x' AS ids", "1 AS _row")
    rows = encoded(docs).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["round_trip"]) for r in rows if r["ids"] is not None) == [(1, 0, True), (2, 3, True), (2, 3, True)]
    assert [r["n_tokens"] for r in rows if r["ids"] is None] == [None] and "text" not in rows[0]
    assert encoded(table([])).collect() == []


def test_automaton_finds_every_piece_with_one_step_a_character():
    random.seed(3)
    ids = {p: k for k, p in enumerate({"".join(random.choice("abc") for _ in range(random.randint(1, 6))) for _ in range(60)})}
    automaton = Automaton(ids)
    text = "".join(random.choice("abcd") for _ in range(2000))
    state = 0
    for end, character in enumerate(text, 1):
        before = state
        if (state := automaton.steps[before].get(character)) is None:
            state = automaton.step(before, character)
            assert automaton.steps[before][character] == state
        assert list(automaton.ends[state]) == [(ids[p], n) for n in range(6, 0, -1) if n <= end and (p := text[end - n:end]) in ids]
