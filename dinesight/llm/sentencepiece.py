"""Operator 10: SentencePiece encoding and decoding with a weighted transducer.

The transducer is the composition of the normaliser (a space becomes the mark
U+2581, one mark in front), the arcs of the pieces, and byte fallback (a
character that is no piece gives one byte piece for each of its bytes). A text is
composed with it and the shortest path in the tropical semiring (weights add
along a path, the least sum wins) gives the ids.

For a unigram model an arc weighs minus the piece's score. For a merge (BPE)
model a path may pass from one piece to the next only where merging the two
pieces' text gives these two pieces again; every other arc weighs infinitely
much. Exactly one path is finite, and it is the one that merging finds, so each
position needs one state.

The pieces form an automaton that reads a word once, from left to right: a state
is the longest end of what is read that begins a piece, and knows the pieces that
end there, longest first.

No piece holds a mark after another character, so a path always passes the start
of a word: words are composed one at a time and remembered. Null gives null ids,
an empty text none; repeated rows are encoded alike; texts of any length are
encoded whole. Decoding gives the text back, but that the mark U+2581 itself
comes back as a space.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
REMEMBERED = 200_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BYTES = -2
_START = -1


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Model:
    """What the transducer needs of a model file; bounded by the vocabulary."""
    pieces: list[str]
    ids: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    merges: bool


def read_model(path: str) -> Model:
    """Parse a model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    normal = proto.normalizer_spec
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces):
        raise ValueError("only the identity normaliser with one mark in front is compiled")
    pieces = [p.piece for p in proto.pieces]
    ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == 1}
    if any(p.type == 4 for p in proto.pieces) or any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("pieces that are matched first or span words are not compiled")
    byte_ids = [pieces.index(f"<0x{b:02X}>") for b in range(256)]
    return Model(pieces, ids, [p.score for p in proto.pieces], byte_ids, proto.trainer_spec.model_type == 2)


class Automaton:
    """Finds the pieces that end at each character; states are numbers, 0 has read nothing that begins a piece."""

    def __init__(self, ids: dict[str, int]):
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]  # piece and its length, longest first
        self._shorter = [0]
        self._known = 0
        level = {0: sorted(ids)}
        depth = 0
        while level:
            below: dict[int, list[str]] = {}
            for state, pieces in level.items():
                self.ends[state] = self.ends[self._shorter[state]]
                for p in pieces:
                    if len(p) == depth:
                        self.ends[state] = ((ids[p], depth), *self.ends[state])
                        continue
                    if (child := self.steps[state].get(p[depth])) is None:
                        child = self.steps[state][p[depth]] = len(self.steps)
                        self.steps.append({})
                        self._shorter.append(self._walk(self._shorter[state], p[depth]) if depth else 0)
                        self.ends.append(())
                    below.setdefault(child, []).append(p)
            level, depth = below, depth + 1

    def _walk(self, state: int, character: str) -> int:
        while (found := self.steps[state].get(character)) is None and state:
            state = self._shorter[state]
        return found or 0

    def step(self, state: int, character: str) -> int:
        """The next state where ``steps`` has none yet."""
        found = self._walk(state, character)
        if self._known < REMEMBERED:
            self.steps[state][character] = found
            self._known += 1
        return found


class _Words(dict):
    """Words and their ids; a word that is not remembered is composed."""

    def __init__(self, word: Callable[[str], list[int]]):
        super().__init__()
        self._word = word

    def __missing__(self, text: str) -> bytes:
        ids = array("i", self._word(text)).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(text) <= 64:
            self[text] = ids
        return ids


@dataclass
class Transducer:
    """Encodes word by word; ``words`` and ``allowed`` remember what was composed."""
    model: Model
    allowed: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.words = _Words(self.word)
        self._longest = max(map(len, self.model.ids), default=1)
        order = sorted(self.model.ids.values(), key=lambda k: -self.model.scores[k])
        self._rank = {k: r for r, k in enumerate(order)}
        self._automaton = Automaton(self.model.ids if self.model.merges else {})
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._surface = [p.replace(MARK, " ").encode() for p in self.model.pieces]
        for b, k in enumerate(self.model.byte_ids):
            self._surface[k] = bytes([b])

    def _passes(self, before: int, piece: int) -> bool:
        """Whether merging the text of two pieces gives them again.

        Undo the merges next to the border, latest first. A merge across the border that ranks before the one undone
        would have come first; of equal merges the left one does.
        """
        text, ids, rank = self.model.pieces, self.model.ids, self._rank
        left, right, limit, passes = before, piece, math.inf, True
        while True:
            across = ids.get(text[left] + text[right])
            if across is not None and rank[across] < limit:
                passes = False
                break
            parts, others = self._split(left), self._split(right)
            if parts and (not others or rank[left] > rank[right]):
                limit, left = rank[left], parts[1]
            elif others:
                limit, right = rank[right] + 0.5, others[0]
            else:
                break
        if len(self.allowed) >= REMEMBERED:
            self.allowed.clear()
        self.allowed[before * len(text) + piece] = passes
        return passes

    def _split(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``piece``; none for a single character."""
        if piece not in self._splits:
            parts = list(self.model.pieces[piece])
            ids, rank = self.model.ids, self._rank
            while len(parts) > 2:
                pairs = [(rank[found], k) for k in range(len(parts) - 1) if (found := ids.get(parts[k] + parts[k + 1])) is not None]
                k = min(pairs)[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            self._splits[piece] = (ids[parts[0]], ids[parts[1]]) if len(parts) == 2 else None
        return self._splits[piece]

    def _best(self, text: str) -> tuple[list[int], list[int]]:
        """Piece of the best path into every position, and where it begins, by summed weights."""
        ids, scores, longest = self.model.ids, self.model.scores, self._longest
        unknown = 10.0 - min(scores, default=0.0)
        cost, state, arrived = [0.0], [_START], [0]
        for end in range(1, len(text) + 1):
            best, piece, begin = cost[end - 1] + unknown, _BYTES, end - 1
            for start in range(max(0, end - longest), end):
                found = ids.get(text[start:end])
                if found is not None and cost[start] - scores[found] < best:
                    best, piece, begin = cost[start] - scores[found], found, start
            cost.append(best)
            state.append(piece)
            arrived.append(begin)
        return state, arrived

    def _only(self, text: str) -> tuple[list[int], list[int]]:
        """The same for a merge model, where one path into every position is finite."""
        steps, ends, allowed, size = self._automaton.steps, self._automaton.ends, self.allowed, len(self.model.pieces)
        state, arrived, read = [_START], [0], 0
        for end, character in enumerate(text, 1):
            before = read
            if (read := steps[before].get(character)) is None:
                read = self._automaton.step(before, character)
            for piece, length in ends[read]:
                last = state[end - length]
                if last < 0 or ((passes := allowed.get(last * size + piece)) is None and self._passes(last, piece)) or passes:
                    state.append(piece)
                    arrived.append(end - length)
                    break
            else:
                state.append(_BYTES)
                arrived.append(end - 1)
        return state, arrived

    def word(self, text: str) -> list[int]:
        """Ids on the shortest path for one word."""
        state, arrived = self._only(text) if self.model.merges else self._best(text)
        out: list[int] = []
        end = len(text)
        while end:
            if state[end] == _BYTES:
                out.extend(self.model.byte_ids[b] for b in reversed(text[arrived[end]:end].encode()))
            else:
                out.append(state[end])
            end = arrived[end]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = MARK + text.replace(" ", MARK)
        return np.frombuffer(b"".join(map(self.words.__getitem__, _WORD.findall(marked))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the mark in front; bytes that are no UTF-8 become the replacement character."""
        surface = self._surface
        text = b"".join([surface[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_compiled: dict[int, Transducer] = {}


def _transducer(model: Model, key: int) -> Transducer:
    """One transducer for each Python worker, so that later tasks find its words."""
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(model)
    return _compiled[key]


def encoded(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``docs`` with ids (array of int), n_tokens, and round_trip: whether decoding the ids gives the text back.

    Columns of ``docs`` with these names are replaced; ``text`` is not returned.
    """
    model = read_model(model_path or default_model())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = hash((len(model.pieces), tuple(model.pieces[-3:]), model.merges))
    kept = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "round_trip")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(shared.value, key)
        for batch in batches:
            given = batch.column("text").to_pylist()
            for at in range(0, len(given), 256):
                part = given[at:at + 256]
                found = [None if t is None else transducer.encode(t) for t in part]
                back = [None if t is None else transducer.decode(i) == t.replace(MARK, " ") for t, i in zip(part, found, strict=True)]
                sizes = [0 if i is None else len(i) for i in found]
                missing = pa.array([i is None for i in found])
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *[i for i in found if i is not None]]), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat, mask=missing)
                yield pa.RecordBatch.from_pydict({c: batch.column(c)[at:at + 256] for c in kept} | {
                    "n_tokens": pa.array([None if i is None else len(i) for i in found], pa.int64()), "round_trip": pa.array(back, pa.bool_()), "ids": ids})

    rows = docs.select(*kept, F.col("text").cast("string").alias("text"))
    schema = rows.drop("text").schema.add("n_tokens", "long").add("round_trip", "boolean").add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(encode, schema)
