"""Operator 1: removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that starts at two or more
places goes. All windows of that length are dealt out by an anchor: the k-gram
with the least hash among those inside the window. Equal windows have equal
anchors, so they meet; neighbouring windows share theirs, so a text gives one
row for about every 180 bytes: the fragment that its windows cover.

Fragments whose anchor occurs once hold no repeat. Where all fragments of an
anchor are equal, all their windows repeat. Only anchors with different
fragments need order. Their windows are taken in blocks by distance from the
anchor; the windows of a block share a core of bytes, so blocks that may repeat
have equal cores, and the core shrinks to one symbol. The shrunk blocks form a
text of bounded size, its suffix array is built by linear grouping, and windows
that repeat stand next to each other in it. Anchors whose distinct fragments
exceed ``GROUP_BYTES`` (a passage amid ever different text) are counted in Spark,
with sums before the shuffle, by blocks of ``BLOCK`` windows: a block whose core
occurs once holds no repeat, one that occurs as a whole again is all repeats, and
only the windows of the others are counted one by one. Exact, and no task holds them.

Null and empty texts give n_bytes 0 and the hash of nothing. Repeated rows repeat
each other's text. Texts under ``LENGTH`` bytes stay as they are. Long texts are
read in overlapping pieces. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinesight.llm.common import stored
from dinesight.llm.kernel import CHUNK_BYTES, Chunk, Hashes, chunks, mix, texts
from dinesight.llm.suffix_array import suffix_array

LENGTH = 400
GRAM = 48
GROUP_BYTES = 1 << 19
BLOCK = 8


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by prefix and suffix minima of blocks."""
    count = len(values) - size + 1
    if count <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // size) * size, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[size - 1:size - 1 + count])


def fragments(chunk: Chunk, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, first byte, length, anchor's place, anchor hash and content hash of every fragment of a chunk."""
    hashes = Hashes(chunk.data)
    grams = hashes.windows(gram)
    packed = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    chosen = (window_minima(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.maximum(chunk.ends - chunk.starts - length + 1, 0)
    doc = np.repeat(np.arange(len(chunk)), counts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + chunk.starts[doc]
    anchor = chosen[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    lo, hi = start[first], start[last] + length
    return doc[first], lo - chunk.starts[doc[first]], hi - lo, anchor[first] - lo, grams[anchor[first]], hashes.of(lo, hi)


def anchored(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``uid, key, frag, lo, n, anchor``: the fragments of every text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            whole = [(k, t) for k, t in enumerate(texts(batch.column("text"))) if len(t) >= length]
            step = CHUNK_BYTES
            pieces = [(k, at, t[at:at + step + length - 1]) for k, t in whole for at in range(0, len(t) - length + 1, step)]
            row, offset = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
            for chunk in chunks([p[2] for p in pieces]):
                doc, lo, n, anchor, key, frag = fragments(chunk, length, gram)
                piece = doc + chunk.first
                yield pa.RecordBatch.from_pydict({"uid": uid[row[piece]], "key": key.view(np.int64), "frag": frag.view(np.int64),
                                                  "lo": lo + offset[piece], "n": n.astype(np.int32), "anchor": anchor.astype(np.int32)})

    return docs.select("uid", "text").mapInArrow(scan, "uid long, key long, frag long, lo long, n int, anchor int")


def _blocks(parts: list[bytes], anchors: list[int], length: int, gram: int) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
    """Windows of every part in blocks by distance from the anchor: part, first window, number of windows, bytes before
    the core, core, bytes after it. Any window of a block holds the core."""
    width = -(-(length - gram + 1) // 8)
    core = length - width + 1
    for k, (part, anchor) in enumerate(zip(parts, anchors, strict=True)):
        last = len(part) - length
        for block in range(max(0, anchor - last) // width, anchor // width + 1):
            first, final = max(0, anchor - width * block - width + 1), min(last, anchor - width * block)
            at = anchor - width * block
            if first <= final:
                yield k, first, final - first + 1, part[first:at], part[at:at + core], part[at + core:final + length]


def repeated_windows(parts: list[bytes], anchors: list[int], keys: list[int], copies: list[int], length: int, gram: int) -> list[np.ndarray]:
    """Starts, within each part, of the windows that occur again in parts with the same key, or whose part has copies.

    ``anchors`` tells where the gram that gave the key begins in each part.
    """
    found: list[list[np.ndarray]] = [[] for _ in parts]
    groups: dict[tuple[int, int, bytes], list[tuple[int, int, int, bytes, bytes]]] = {}
    for k, first, count, before, core, after in _blocks(parts, anchors, length, gram):
        if copies[k] > 1:
            found[k].append(np.arange(first, first + count))
        groups.setdefault((keys[k], anchors[k] - first - len(before), core), []).append((k, first, count, before, after))
    width = -(-(length - gram + 1) // 8)
    pieces: list[tuple[int, int, int]] = []
    symbols: list[np.ndarray] = []
    name = 257
    for members in groups.values():
        if len(members) < 2:
            continue
        kinds: dict[tuple[bytes, bytes], list[tuple[int, int, int, bytes, bytes]]] = {}
        for m in members:
            kinds.setdefault(m[3:], []).append(m)
        for same in kinds.values():
            for k, first, count, _, _ in same if len(same) > 1 else ():
                found[k].append(np.arange(first, first + count))
        if len(kinds) > 1:
            for (before, after), same in kinds.items():
                pieces.append(same[0][:3])
                symbols.append(np.concatenate([np.frombuffer(before, np.uint8).astype(np.int64) + 1, [name],
                                               np.frombuffer(after, np.uint8).astype(np.int64) + 1, [0]]))
            name += 1
    if pieces:
        text = np.concatenate(symbols)
        begin = np.concatenate([[0], np.cumsum([len(s) for s in symbols])[:-1]])
        counts = np.array([p[2] for p in pieces])
        order = suffix_array(text)
        piece = np.searchsorted(begin, order, "right") - 1
        order = order[order - begin[piece] < counts[piece]]
        view = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(width, np.int64)), width)
        repeated = np.zeros(len(text), bool)
        same = (view[order[:-1]] == view[order[1:]]).all(axis=1)
        repeated[order[:-1][same]] = True
        repeated[order[1:][same]] = True
        for (k, first, count), b in zip(pieces, begin, strict=True):
            found[k].append(first + np.flatnonzero(repeated[b:b + count]))
    return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in found]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges; ranges that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(new[1:], True)]


def _packed(docs: DataFrame) -> DataFrame:
    """``uid, doc_id, text``, the text compressed, since it crosses the network as it is."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [pa.compress(t, "zstd", asbytes=True) for t in texts(batch.column("text"))]
            sizes = [len(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"uid": batch.column("uid"), "doc_id": batch.column("doc_id"), "size": pa.array(sizes, pa.int64()),
                                              "packed": pa.array(values, pa.binary())})

    return docs.select("uid", "doc_id", "text").mapInArrow(pack, "uid long, doc_id long, size long, packed binary")


def _unpack(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, size, "zstd", asbytes=True) if size else b""


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted fragments of each text."""
    for batch in batches:
        rows = []
        for packed, size, wanted in zip(*(batch.column(c).to_pylist() for c in ("packed", "size", "wanted")), strict=True):
            text = _unpack(packed, size)
            rows += [(w["key"], w["frag"], w["copies"], w["hot"], w["anchor"], text[w["lo"]:w["lo"] + w["n"]]) for w in wanted]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "frag", "copies", "hot", "anchor", "bytes"])


def _hot_blocks(hot: pd.DataFrame, length: int) -> Iterator[dict[str, np.ndarray]]:
    """Windows of fragments in blocks by distance from the anchor, with hashes of the core, of the whole block, and of every window."""
    for chunk in chunks(hot["bytes"].tolist()):
        rows = hot.iloc[chunk.first:chunk.first + len(chunk)]
        hashes = Hashes(chunk.data)
        each = hashes.windows(length).view(np.int64)
        counts = chunk.ends - chunk.starts - length + 1
        row = np.repeat(np.arange(len(chunk)), counts)
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        block = (rows["anchor"].to_numpy(np.int64)[row] - at) // BLOCK
        new = np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        row, block, s, e = row[first], block[first], at[first], at[last] + length
        begin = chunk.starts[row]
        latest = rows["anchor"].to_numpy(np.int64)[row] - BLOCK * block
        core = hashes.of(begin + latest, begin + latest - BLOCK + 1 + length)
        whole = hashes.of(begin + s, begin + e)
        # Blocks of the same windows begin equally far before the anchor, and have as many.
        place = (latest - s) * BLOCK + e - s - length
        windows = np.empty(len(row), object)
        windows[:] = [each[x:y] for x, y in zip((begin + s).tolist(), (begin + e - length + 1).tolist(), strict=True)]
        yield {"key": rows["key"].to_numpy()[row], "frag": rows["frag"].to_numpy()[row], "s": s, "e": e, "copies": rows["copies"].to_numpy()[row],
               "core": mix(core + block.astype(np.uint64)).view(np.int64),
               "whole": mix(whole + mix(block.astype(np.uint64) * np.uint64(BLOCK * BLOCK) + place.astype(np.uint64))).view(np.int64), "windows": windows}


FOUND = "key long, frag long, s long, e long, copies long, core long, whole long, windows array<long>"


def _found(length: int, gram: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a group of fragments: the ranges that repeat, or, of hot ones, every block of windows with its hashes."""
    def find(group: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        cold, hot = group[~group["hot"]], group[group["hot"]]
        if len(cold):
            found = [merged(at, at + length) for at in repeated_windows(*(cold[c].tolist() for c in ("bytes", "anchor", "key", "copies")), length, gram)]
            counts = [len(s) for s, _ in found]
            out.append(pd.DataFrame({"key": np.repeat(cold["key"].to_numpy(), counts), "frag": np.repeat(cold["frag"].to_numpy(), counts),
                                     "s": np.concatenate([s for s, _ in found]), "e": np.concatenate([e for _, e in found])}))
        out += map(pd.DataFrame, _hot_blocks(hot, length))
        names = [c.split()[0] for c in FOUND.split(", ")]
        rows = pd.concat([part.reindex(columns=names).astype(dict.fromkeys(("copies", "core", "whole"), "Int64") | {"windows": object}) for part in out])
        return rows.assign(windows=rows["windows"].where(rows["windows"].notna(), None))
    return find


def _hot_ranges(blocks: DataFrame, length: int) -> DataFrame:
    """``key, frag, s, e``: of hot fragments with repeats, from the first window that repeats to the end of the last.

    All windows of a fragment hold its anchor, so what they cover is one range.
    """
    cores = blocks.groupBy("key", "core").agg(F.sum("copies").alias("c")).where("c > 1").select("key", "core")
    maybe = stored(blocks.join(cores, ["key", "core"]).drop("core"))
    alike = maybe.groupBy("key", "whole").agg(F.sum("copies").alias("c"), F.first("windows").alias("windows"))
    often = alike.select("key", "c", F.explode("windows").alias("hash")).groupBy("key", "hash").agg(F.sum("c").alias("c")).where("c > 1").select("key", "hash")
    marked = maybe.join(alike.where("c > 1").select("key", "whole", F.lit(True).alias("all")), ["key", "whole"], "left")
    single = marked.where("all IS NULL").select("key", "frag", "s", F.posexplode("windows").alias("k", "hash")).join(often, ["key", "hash"])
    ranges = marked.where("all").select("key", "frag", "s", "e").unionByName(
        single.select("key", "frag", (F.col("s") + F.col("k")).alias("s"), (F.col("s") + F.col("k") + length).alias("e")))
    return ranges.groupBy("key", "frag").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def repeated_spans(docs: DataFrame, packed: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``uid, spans``: of texts (uid, text) with repeats, the byte ranges to remove, not yet merged."""
    rows = stored(anchored(docs, length, gram))
    keys = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("frag").alias("f"), F.max("frag").alias("g")).where("c > 1")
    shared = stored(rows.join(keys.select("key", F.expr("f < g").alias("mixed")), "key"))
    plain = shared.where("NOT mixed").select("uid", F.col("lo").alias("s"), (F.col("lo") + F.col("n")).alias("e"))

    mixed = shared.where("mixed")
    kinds = mixed.groupBy("key", "frag").agg(F.count("*").alias("copies"), F.min(F.struct("uid", "lo", "n", "anchor")).alias("at"))
    sizes = kinds.groupBy("key").agg(F.sum("at.n").alias("bytes"))
    kinds = stored(kinds.join(sizes, "key").select("key", "frag", "copies", "at.*", (F.col("bytes") > group_bytes).alias("hot")))
    groups = 1 + (kinds.agg(F.sum("n")).first()[0] or 0) // group_bytes
    # As many as a text has fragments at most.
    wanted = kinds.groupBy("uid").agg(F.collect_list(F.struct("key", "frag", "copies", "hot", "anchor", "lo", "n")).alias("wanted"))
    # Equal rows share their uid: one of them stands for all.
    cut = packed.join(wanted, "uid").dropDuplicates(["uid"]).select("packed", "size", "wanted").mapInArrow(
        _cut_out, "key long, frag long, copies long, hot boolean, anchor int, bytes binary")
    # Hot keys are spread by fragment; the others stay together, several to a group of bounded size.
    group = F.pmod(F.when(F.col("hot"), F.xxhash64("key", "frag")).otherwise(F.xxhash64("key")), F.lit(groups))
    found = stored(cut.withColumn("g", group).groupBy("g").applyInPandas(_found(length, gram), FOUND))
    ranges = found.where("windows IS NULL").select("key", "frag", "s", "e").unionByName(_hot_ranges(found.where("windows IS NOT NULL"), length))
    back = mixed.join(ranges, ["key", "frag"]).select("uid", (F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e")).alias("e"))
    return plain.unionByName(back).groupBy("uid").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("uid", F.xxhash64(F.col("doc_id"), F.col("text")))


def _cut(text: bytes, spans: list[dict] | None) -> tuple[list[bytes], int, int]:
    """What is left, in pieces; bytes and runs removed."""
    if not spans:
        return [text], 0, 0
    starts, ends = merged(np.array([x["s"] for x in spans]), np.array([x["e"] for x in spans]))
    edges = [0, *[v for pair in zip(starts.tolist(), ends.tolist(), strict=True) for v in pair], len(text)]
    return [text[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)], int((ends - starts).sum()), len(starts)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes left."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    packed = _packed(keyed)
    spans = repeated_spans(keyed, packed, length, gram, group_bytes)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": []}
            for packed_text, size, runs in zip(*(batch.column(c).to_pylist() for c in ("packed", "size", "spans")), strict=True):
                left, removed, count = _cut(_unpack(packed_text, size), runs)
                for name, value in zip(out, (removed, count, hashlib.sha256(b"".join(left)).hexdigest()), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("size")} | {
                n: pa.array(v, pa.string() if n == "kept_sha256" else pa.int64()) for n, v in out.items()})

    return packed.join(spans, "uid", "left").select("doc_id", "size", "packed", "spans").mapInArrow(
        digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings cut from their texts, n_chars set to the code points left.

    A cut may fall inside a character; the bytes of a character that lost some are dropped from the text. A null text
    stays null.
    """
    columns, schema = docs.columns, docs.schema
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = repeated_spans(keyed, _packed(keyed), length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            given = row.field("text").to_pylist()
            left = [None if g is None else b"".join(_cut(g.encode(), runs)[0]).decode("utf-8", "ignore")
                    for g, runs in zip(given, batch.column("spans").to_pylist(), strict=True)]
            values = {c: row.field(c) for c in columns} | {"text": pa.array(left, pa.string())}
            if "n_chars" in columns:
                values["n_chars"] = pa.array([None if t is None else len(t) for t in left], values["n_chars"].type)
            yield pa.RecordBatch.from_pydict(values)

    # The caller's row travels as one column, whatever its columns are called.
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("uid"), F.struct("*").alias("row"))
    return rows.join(spans, "uid", "left").select("row", "spans").mapInArrow(cut, schema)
