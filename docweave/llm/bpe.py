"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text starts as single bytes.  Leaf i of the tree holds the rank of the pair that starts
at symbol i; every inner node holds the smaller of its children, the left one on ties, so
the root names the leftmost pair of lowest rank.  A merge changes three leaves at most, each in
logarithmic time, until no pair has a rank.

Texts are cut at added tokens and then into pieces (see `pieces`); a worker remembers pieces it
has met.  The new pieces of a batch are merged together, a tree for each in the rows of one array.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, slices, table
from .pieces import PieceMemory, supported

NONE = 1 << 60
#: Bytes of text that are encoded at once and leave the task together; ids are many times as large, and more so as Python objects.
SLICE = 1 << 18


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the merges: ranks gives (rank, new id) of a pair of ids."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym = list(symbols)
    size = 1
    while size < n:
        size *= 2
    tree = [NONE] * (2 * size)  # rank * n + place: smaller rank first, then further left
    get = ranks.get
    found = False
    for i in range(n - 1):
        r = get((sym[i], sym[i + 1]))
        if r is not None:
            tree[size + i] = r[0] * n + i
            found = True
    if not found:
        return sym
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, v: int) -> None:
        k = size + i
        tree[k] = v
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            v = a if a < b else b
            if tree[k] == v:
                return
            tree[k] = v
            k >>= 1

    while (top := tree[1]) != NONE:
        i = top % n
        j = after[i]
        sym[i] = get((sym[i], sym[j]))[1]
        k = after[i] = after[j]
        sym[j] = -1
        put(j, NONE)
        if k < n:
            before[k] = i
            r = get((sym[i], sym[k]))
            put(i, NONE if r is None else r[0] * n + i)
        else:
            put(i, NONE)
        p = before[i]
        if p >= 0:
            r = get((sym[p], sym[i]))
            put(p, NONE if r is None else r[0] * n + p)
    return [s for s in sym if s >= 0]


def merge_many(symbols: np.ndarray, sizes: np.ndarray, pairs: Pairs) -> np.ndarray:
    """`merge` of many short pieces at once: one tree a row, one merge a row and step.

    symbols is (pieces, leaves + 1), filled with -1 behind each piece; leaves is a power of two.
    Returns it merged, with -1 where a symbol went into the one before it.
    """
    n, leaves = len(symbols), symbols.shape[1] - 1
    sym = symbols.copy()
    tree = np.full((n, 2 * leaves), FREE, np.int32)
    rank = pairs.rank(sym[:, :-1], sym[:, 1:])
    place = np.arange(leaves, dtype=np.int32)
    tree[:, leaves:] = np.where(rank >= 0, rank * leaves + place, FREE)
    for k in range(leaves - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
    after = np.tile(np.arange(1, leaves + 2, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, leaves, dtype=np.int32), (n, 1))
    rows = np.flatnonzero(tree[:, 1] != FREE)
    while len(rows):
        top = tree[rows, 1]
        i = top % leaves
        j = after[rows, i]
        sym[rows, i] = pairs.made[top // leaves]
        sym[rows, j] = -1
        k = after[rows, j]
        after[rows, i] = k
        more = k <= leaves
        before[rows[more], k[more]] = i[more]
        end = np.minimum(k, leaves)
        r = pairs.rank(sym[rows, i], np.where(more & (end < sizes[rows]), sym[rows, end], -1))
        tree[rows, leaves + j] = FREE
        tree[rows, leaves + i] = np.where(r >= 0, r * leaves + i, FREE)
        left = before[rows, i]
        p = np.maximum(left, 0)
        r = pairs.rank(np.where(left >= 0, sym[rows, p], -1), sym[rows, i])
        p = np.where(left >= 0, p, i)
        tree[rows, leaves + p] = np.where(left >= 0, np.where(r >= 0, r * leaves + p, FREE), tree[rows, leaves + i])
        spots = [(leaves + x) >> 1 for x in (i, j, p)]
        while spots[0][0]:
            for x in spots:
                tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
            spots = [x >> 1 for x in spots]
        rows = rows[tree[rows, 1] != FREE]
    return sym


FREE = np.iinfo(np.int32).max


class Pairs:
    """Ranks of adjacent pairs as sorted keys."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        n = len(ranks)
        keys = np.fromiter((a << 32 | b for a, b in ranks), np.int64, n)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter((r for r, _ in ranks.values()), np.int32, n)[order], -1).astype(np.int32)
        self.made = np.zeros(max((r for r, _ in ranks.values()), default=0) + 1, np.int32)
        for r, made in ranks.values():
            self.made[r] = made

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(-1))


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        supported(spec)
        vocab = spec["model"]["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)}
        self.pairs = Pairs(self.ranks)
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        back = {c: b for b, c in letters.items()}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for t, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in t)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        self.memory = PieceMemory(self._merge, self.added)

    def _merge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of new pieces: short ones merged together, long ones each alone."""
        sizes = np.diff(bounds)
        out, counts = [None] * len(sizes), np.zeros(len(sizes), np.int64)
        done = []
        for low, high in ((0, 8), (8, 16), (16, 32)):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(some), 4096):
                part = some[k : k + 4096]
                inside = np.arange(high + 1) < sizes[part, None]
                sym = np.full((len(part), high + 1), -1, np.int32)
                sym[inside] = self.of_byte[data[(bounds[part, None] + np.arange(high + 1))[inside]]]
                got = merge_many(sym, sizes[part], self.pairs)
                counts[part] = (got >= 0).sum(1)
                done.append((part, got))
        for i in np.flatnonzero(sizes > 32).tolist():
            out[i] = merge(self.of_byte[data[bounds[i] : bounds[i + 1]]].tolist(), self.ranks)
            counts[i] = len(out[i])
        at = np.append(0, np.cumsum(counts))
        ids = np.zeros(at[-1], np.uint32)
        for part, got in done:
            n = counts[part]
            ids[np.arange(n.sum()) + np.repeat(at[part] - np.append(0, np.cumsum(n)[:-1]), n)] = got[got >= 0]
        for i in np.flatnonzero(sizes > 32).tolist():
            ids[at[i] : at[i + 1]] = out[i]
        return ids, at

    def encode(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.memory.encode(data, np.array([0, len(data)]))[0]

    def decode_bytes(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(batches: Iterable[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The rows that `encode` gives of batches(doc_id, text), those of about SLICE bytes of text at a time."""
    own = codec(path)
    sha = hashlib.sha256
    for batch in batches:
        for i, j, data, offs in slices(batch.column("text"), SLICE):
            flat, at = own.memory.encode(data, offs)
            a, b, ends = [], [], at.tolist()
            for p, q in zip(ends[:-1], ends[1:], strict=True):
                ids = flat[p:q].tolist()
                a.append(sha(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                b.append(sha(own.decode(ids).encode()).hexdigest())
            cols = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    Null texts count as empty (no ids); empty texts give the hashes of the empty string.  Rows come
    out as they came in, repeats included; very long texts and pieces are merged whole; an empty table gives an
    empty one; other columns are ignored.  There is no shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(lambda batches: encoded(batches, path, with_ids)), schema + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ids array<int>; null ids give the empty text."""

    def run(batches):
        own = codec(path)
        for batch in cut(batches):
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def op2_bpe_segment_tree(spark, sf_dir):
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
