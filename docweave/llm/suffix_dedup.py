"""Byte strings that an earlier document has, by a sparse suffix array sorted over all tasks.

A window is 50 consecutive bytes of one document.  Its anchor is the 20-byte gram of smallest hash in it, so equal windows have equal
anchors at equal places.  Equal texts are one, of their smallest doc_id.  Only suffixes that start at anchors are sorted, each with the bytes to its left that
windows may reach.  Four steps:

1. Which grams occur in two documents: each task's grams go out as sorted, difference-coded hashes and are counted.
   Suffixes of other grams can't be repeated and are not sent.
2. Each task sorts its suffixes into runs.  Equal ones of a run are one, of the smallest doc_id; the others' windows are
   repeats already.  Runs are cut by buckets of grams and go out front-coded: what a suffix shares with the one before it in
   the run is a number.
3. A bucket's runs are merged by a loser tree that keeps what each loser shares with its winner.  Suffixes that share
   different lengths with the last output are ordered by these lengths alone, others are compared from there on, so no byte
   that is known to be equal is compared again.  The merge gives the suffixes' common prefixes.
4. Windows with o bytes to the left of the anchor are equal where suffixes share 50 - o bytes to the right and o to the left;
   for each such class the smallest doc_id is known, and windows of other documents are repeats.

A gram of very many documents is hot: what is sorted for it is its windows themselves, each of which goes to a bucket by its own bytes, so
no bucket gathers them all.  Grams are told apart by hashes in the first step only, as short as their number allows, which can add
suffixes but loses none.
"""
from __future__ import annotations

import gc
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, U64, _BASE, _INV, empty_text, lean, met, mix, passing, powers, saved, slices, table

WINDOW, GRAM = 50, 20


class Sizes(NamedTuple):
    """How the work is cut; rows are the same for all values."""

    #: Documents from which on a gram is hot, half of what a bucket holds; documents of a run whose list travels with a gram.
    hot: int = 25_000
    listed: int = 8
    #: Grams and suffixes of a run.
    run_grams: int = 1 << 19
    run_items: int = 200_000
    #: Grams that are counted, and suffixes that are merged, in one task on average.
    part_grams: int = 1 << 20
    bucket_items: int = 50_000


#: What a row without doc_id counts as: it comes after all others.
LAST = (1 << 63) - 1
#: Bytes of texts that are hashed at once, few enough to stay in a processor's cache.
SLICE = 1 << 17
_ODD = 0xD6E8FEB86659FD93


def anchors(data: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, at, lo, hi) of the anchors of documents data[bounds[d]:bounds[d + 1]]: first byte, first and last window.

    Ties go to the left.  A window's start and its anchor's are at most window - gram bytes apart.
    """
    n = len(data) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, U64), none, none, none
    total, codes = np.zeros(len(data) + 1, U64), data.astype(U64)
    codes += U64(1)
    codes *= powers(_BASE, len(data))
    np.cumsum(codes, out=total[1:])
    hashes = total[gram:] - total[:-gram]
    hashes *= powers(_INV, len(data))[: len(hashes)]
    hashes *= U64(_ODD)
    hashes ^= hashes >> U64(32)
    hashes *= U64(_ODD)
    # Upper half by hash, lower half by place: one minimum gives both.
    best, have, span = hashes & U64(0xFFFFFFFF00000000), 1, window - gram + 1
    best |= np.arange(len(hashes), dtype=U64)
    while have < span:
        d = min(have, span - have)
        best = np.minimum(best[:-d], best[d:])
        have += d
    inside = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(bounds) >= window)
    np.add.at(inside, bounds[long], 1)
    np.add.at(inside, bounds[long + 1] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:n]))
    at = (best[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else none
    last = np.append(first[1:], len(at)) - 1 if len(at) else none
    return hashes[at[first]], at[first], starts[first], starts[last]


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, byte by byte of all."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n).T
    return out.view("<u8").ravel()


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def gram_ids(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of so many bits, evenly spread; those of anchors are not, as each is the smallest of its windows."""
    return mix(hashes, 3) >> U64(64 - bits)


def _located(batches, window: int, gram: int) -> Iterator[tuple]:
    """(batch, first row, bytes, bounds, document of each anchor, anchors) of slices."""
    for batch in batches:
        for i, _, data, bounds in slices(batch.column("text"), SLICE):
            found = anchors(data, bounds, window, gram)
            yield batch, i, data, bounds, np.searchsorted(bounds, found[2], side="right") - 1, found


GRAMS = "part int, n int, grams binary, counts binary, docs binary, keys array<long>"


def _gram_runs(window: int, gram: int, bits: int, parts: int, sizes: Sizes):
    """Rows of GRAMS: the sorted grams of a run that belong to a part, and the documents of those that have sizes.listed at most.

    Documents of the others go apart, in parts beyond `parts`, with their grams as they are.
    """
    names = [c.split()[0] for c in GRAMS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def row(part, n, grams, counts, docs, keys):
        own, docs = np.unique(docs, return_inverse=True)
        values = [part, n, _narrow(grams), _narrow(counts), _narrow(docs.astype(U64)), keys[own]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def emitted(number, found, owners, keys):
        every, docs, keys = np.concatenate(found), np.concatenate(owners), np.array(keys, np.int64)
        order = np.argsort(every, kind="stable")  # documents of a gram stay in order
        every, docs = every[order], docs[order]
        new = np.append(True, (every[1:] != every[:-1]) | (docs[1:] != docs[:-1]))
        every, docs = every[new], docs[new]
        grams, counts = np.unique(every, return_counts=True)
        listed = np.repeat(counts <= sizes.listed, counts)
        cuts = np.searchsorted(grams, np.array([(p << bits) // parts for p in range(parts + 1)], U64))
        ends = np.append(0, np.cumsum(counts))
        for p in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[p], cuts[p + 1]
            span = slice(ends[a], ends[b])
            yield row(int(p), int(b - a), np.diff(grams[a:b], prepend=U64(0)), counts[a:b], docs[span][listed[span]], keys)
        if not listed.all():
            many = ~listed
            yield row(parts + number % parts, int(many.sum()), every[many], np.zeros(0, U64), docs[many], keys)

    def run(batches):
        found, owners, keys, size, number = [], [], [], 0, 0
        for batch, i, _, bounds, doc, (hashes, *_rest) in _located(batches, window, gram):
            found.append(gram_ids(hashes, bits))
            owners.append(doc + len(keys))
            keys += batch.column("key").slice(i, len(bounds) - 1).to_pylist()
            size += len(hashes)
            if size >= sizes.run_grams:
                number += keys[0] % parts
                yield from emitted(number, found, owners, keys)
                found, owners, keys, size = [], [], [], 0
        if size:
            yield from emitted(number + keys[0] % parts, found, owners, keys)

    return run


def _counted(parts: int, sizes: Sizes):
    """Of a part: (key, gram, hot) where two documents have the gram, (null, gram, true) for hot ones; of listed-apart grams hot is null."""

    def out(key, gram, hot):
        return pa.table([key, _long(gram), hot], ["key", "gram", "hot"])

    def run(rows: pa.Table) -> pa.Table:
        n, keys = rows["n"].to_pylist(), rows["keys"].to_pylist()
        if rows["part"][0].as_py() >= parts:
            grams = np.concatenate([_wide(x, k) for x, k in zip(rows["grams"].to_pylist(), n, strict=True)])
            key = np.concatenate([np.array(x, np.int64)[_wide(d, k).astype(np.int64)] for x, d, k in zip(keys, rows["docs"].to_pylist(), n, strict=True)])
            return out(pa.array(key), grams, pa.nulls(len(key), pa.bool_()))
        grams, counts, key, member = [], [], [], []
        for g, c, d, x, k in zip(rows["grams"].to_pylist(), rows["counts"].to_pylist(), rows["docs"].to_pylist(), keys, n, strict=True):
            grams.append(np.cumsum(_wide(g, k)))
            counts.append(_wide(c, k).astype(np.int64))
            few = np.where(counts[-1] <= sizes.listed, counts[-1], 0)
            key.append(np.array(x, np.int64)[_wide(d, int(few.sum())).astype(np.int64)])
            member.append(np.repeat(grams[-1], few))
        known, place = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(known))
        key, member = np.concatenate(key), np.concatenate(member)
        times = total[np.searchsorted(known, member)]
        hot = known[total > sizes.hot]
        both = out(pa.array(key[times > 1]), member[times > 1], pa.array(times[times > 1] > sizes.hot))
        return pa.concat_tables([both, out(pa.nulls(len(hot), pa.int64()), hot, pa.array(np.ones(len(hot), bool)))])

    return run


ITEMS = "bucket int, n int, shared binary, rest_sizes binary, rest binary, left_sizes binary, left binary, docs array<long>, keys array<long>, who binary, at binary, refs binary, lo array<long>, hi array<long>"
_ITEM_NAMES = [c.split()[0] for c in ITEMS.split(", ")]
_ITEM_TYPES = [{"int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[c.split()[1]] for c in ITEMS.split(", ")]


def _item_rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_ITEM_NAMES, _ITEM_TYPES, strict=True)], _ITEM_NAMES)


def _item_row(bucket: int, items: list) -> dict:
    """Sorted items (with the references of each, documents numbered within the row) as one row."""
    shared, rest = front_coded([item[1] for item, _ in items])
    lefts, refs = [item[2] for item, _ in items], [r for _, rs in items for r in rs]
    docs, keys = (np.array([r[c] for r in refs], np.int64) for c in (0, 1))
    keys, first, who = np.unique(keys, return_index=True, return_inverse=True)
    return {
        "bucket": bucket, "n": len(items), "shared": shared, "rest_sizes": bytes(map(len, rest)), "rest": b"".join(rest), "left_sizes": bytes(map(len, lefts)), "left": b"".join(lefts), "docs": docs[first], "keys": keys,
        "who": _narrow(who.astype(U64)), "at": _narrow(np.array([r[2] for r in refs], U64)), "refs": _narrow(np.array([len(r) for _, r in items], U64)),
    }


def front_coded(strings: list[bytes]) -> tuple[bytes, list[bytes]]:
    """Of sorted strings, what each shares with the one before, at most 255 bytes of it, and the rest of each."""
    shared, before = bytearray(), b""
    for s in strings:
        shared.append(min(first_difference(before, s, 0), 255))
        before = s
    return bytes(shared), [s[k:] for s, k in zip(strings, shared, strict=True)]


def first_difference(a: bytes, b: bytes, known: int) -> int:
    """How many bytes a and b share; the first `known` are not looked at."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (shared with the one before in the run, string, tag); iterates (shared with the last output, tag).

    A node holds the loser of its match and how much it shares with the winner.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.nodes: list = [None] * self.size
        round_ = [self._next(r, True) for r in range(self.size)]
        node = self.size
        while len(round_) > 1:
            node //= 2
            round_ = [self._match(node + k, round_[2 * k], round_[2 * k + 1]) for k in range(node)]
        self.best = round_[0]

    def _next(self, run: int, first: bool = False):
        got = next(self.runs[run], None) if run < len(self.runs) else None
        return None if got is None else (0 if first else got[0], got[1], got[2], run)

    def _match(self, node: int, a, b):
        """The winner; the loser stays at the node.  Both know what they share with the string that was output last."""
        if a is None or b is None:
            self.nodes[node] = None
            return b if a is None else a
        if a[0] != b[0]:
            winner, loser = (a, b) if a[0] > b[0] else (b, a)
            self.nodes[node] = loser
            return winner
        same = first_difference(a[1], b[1], a[0])
        smaller = same == len(a[1]) or (same < len(b[1]) and a[1][same] < b[1][same])
        winner, loser = (a, b) if smaller else (b, a)
        self.nodes[node] = (same, *loser[1:])
        return winner

    def __iter__(self):
        nodes = self.nodes
        while self.best is not None:
            yield self.best[0], self.best[2]
            run = self.best[3]
            up, node = self._next(run), (self.size + run) >> 1
            while node:
                other = nodes[node]
                if other is not None:
                    if up is None or up[0] < other[0]:
                        nodes[node], up = up, other
                    elif up[0] == other[0]:
                        up = self._match(node, up, other)
                node >>= 1
            self.best = up


def _sorted_runs(window: int, gram: int, bits: int, buckets: int, sizes: Sizes):
    """Rows of ITEMS: front-coded runs by bucket; and rows of keys, lo and hi only, spans that the run itself shows to be repeats."""

    def collapsed(groups: dict, spans: list) -> Iterator:
        """Items with the references of their smallest document; the others' windows are spans."""
        for item, refs in groups.items():
            if len(refs) > 1:
                least = min(refs)[0]
                spans += [(key, lo, hi + window) for doc, key, _, lo, hi in refs if doc > least]
                refs = [r for r in refs if r[0] == least]
            yield item, refs

    def emitted(few: dict, hot: dict):
        spans: list = []
        items = list(collapsed(few, spans))
        single: dict = {}
        for (_, right, left), refs in collapsed(hot, spans):
            text, ahead = left[::-1] + right, len(left)
            for k in range(len(text) - window + 1):
                w = text[k : k + window]
                single.setdefault((zlib.crc32(w) % buckets, w, b""), []).extend((doc, key, at - ahead + k, lo + k, lo + k) for doc, key, at, lo, _ in refs)
        items += collapsed(single, spans)
        items.sort()
        rows, a = [], 0
        while a < len(items):
            bucket, b = items[a][0][0], a
            while b < len(items) and items[b][0][0] == bucket:
                b += 1
            rows.append(_item_row(bucket, items[a:b]))
            a = b
        spans = _joined(spans)
        for k in range(0, len(spans), 1000):
            key, lo, hi = map(list, zip(*spans[k : k + 1000], strict=True))
            rows.append({"bucket": key[0] % buckets, "keys": key, "lo": lo, "hi": hi})
        for k in range(0, len(rows), 100):
            yield _item_rows(rows[k : k + 100])

    def run(batches):
        gc.disable()  # many small tuples, no cycles
        few, hot, size = {}, {}, 0
        for batch, i, data, bounds, owner, (hashes, at, lo, hi) in _located(batches, window, gram):
            n, ids = len(bounds) - 1, gram_ids(hashes, bits)
            wanted = [np.asarray(batch.column(c).slice(i, n).flatten()).view(U64) for c in ("few", "hot")]
            raw, keys, docs = data.tobytes(), batch.column("key").slice(i, n).to_pylist(), batch.column("doc").slice(i, n).to_pylist()
            owners = [np.repeat(np.arange(n), np.asarray(pc.list_value_length(batch.column(c).slice(i, n)))) for c in ("few", "hot")]
            for groups, want, own in zip((few, hot), wanted, owners, strict=True):
                picked = np.flatnonzero(np.isin(ids ^ mix(owner.astype(U64), 5), want ^ mix(own.astype(U64), 5)))
                for h, a, x, y, d in zip(hashes[picked].tolist(), at[picked].tolist(), lo[picked].tolist(), hi[picked].tolist(), owner[picked].tolist(), strict=True):
                    item = h % buckets, raw[a : y + window], raw[x:a][::-1]
                    start = int(bounds[d])
                    groups.setdefault(item, []).append((docs[d], keys[d], a - start, x - start, y - start))
                size += len(picked)
            if size >= sizes.run_items:
                yield from emitted(few, hot)
                few, hot, size = {}, {}, 0
        yield from emitted(few, hot)
        gc.enable()

    return run


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (key, lo, hi) with those that meet made one."""
    out: list = []
    for key, lo, hi in sorted(spans):
        if out and out[-1][0] == key and lo <= out[-1][2]:
            out[-1] = key, out[-1][1], max(hi, out[-1][2])
        else:
            out.append((key, lo, hi))
    return out


def _decoded(r: dict, base: int) -> Iterator[tuple[int, bytes, int]]:
    """The right sides of a run in order, each with its number in the bucket."""
    at, before = 0, b""
    for k, (shared, size) in enumerate(zip(r["shared"], r["rest_sizes"], strict=True)):
        before = before[:shared] + r["rest"][at : at + size]
        at += size
        yield shared, before, base + k


def repeated(shared: np.ndarray, right: np.ndarray, left: np.ndarray, left_size: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """[item, o]: whether an item of a smaller doc_id has the window that starts o bytes before the item's anchor.

    Items are in the order of their right sides, of which each shares `shared` bytes with the one before; right and left_size are
    the sides' lengths, left[:, o] the byte o + 1 places before the anchor.
    """
    n, width = len(doc), left.shape[1] + 1
    out = np.zeros((n, width), bool)
    # Of items whose gram nobody else has, nothing is repeated.
    new = np.append(shared < window - width + 1, True)
    picked = np.flatnonzero(~(new[:-1] & new[1:]))
    by = picked[np.lexsort(left[picked].T[::-1])] if width > 1 else picked
    equal = left[by[1:]] == left[by[:-1]]
    common = np.append(0, np.where(equal.all(1), width, np.argmin(equal, axis=1))) if width > 1 and len(by) else np.zeros(len(by), np.int64)
    for o in range(width):
        sides = np.zeros(n, np.int64)
        sides[by] = np.cumsum(common < o)
        rows = picked[(left_size[picked] >= o) & (right[picked] >= window - o)]
        if not len(rows):
            continue
        classes = np.cumsum(shared < window - o)[rows] * (len(by) + 1) + sides[rows]
        order = np.argsort(classes, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(classes[order]) != 0))
        least = np.repeat(np.minimum.reduceat(doc[rows][order], first), np.diff(np.append(first, len(order))))
        out[rows[order], o] = doc[rows][order] > least
    return out


def _merged(window: int, gram: int):
    """(key, lo, hi) of the repeats that the runs of a bucket show together, and of those that they showed alone."""

    def run(rows: pa.Table) -> pa.Table:
        every = rows.to_pylist()
        spans = [np.array([x for r in every if r["lo"] is not None for x in r[c]], np.int64) for c in ("keys", "lo", "hi")]
        runs = [r for r in every if r["lo"] is None]
        if not runs:
            return pa.table([pa.array(x) for x in spans], ["key", "lo", "hi"])
        bases = np.append(0, np.cumsum([r["n"] for r in runs]))
        tree = LoserTree([_decoded(r, int(b)) for r, b in zip(runs, bases[:-1], strict=True)])
        shared, order = np.array(list(tree), np.int64).T
        right = np.concatenate([np.frombuffer(r["shared"], np.uint8).astype(np.int64) + np.frombuffer(r["rest_sizes"], np.uint8) for r in runs])[order]
        left_size = np.concatenate([np.frombuffer(r["left_sizes"], np.uint8) for r in runs]).astype(np.int64)
        flat = np.frombuffer(b"".join(r["left"] for r in runs), np.uint8)
        left = np.zeros((len(order), window - gram), np.uint8)
        left[np.arange(window - gram) < left_size[:, None]] = flat
        refs = [_wide(r["refs"], r["n"]).astype(np.int64) for r in runs]
        who = [_wide(r["who"], int(n.sum())).astype(np.int64) for r, n in zip(runs, refs, strict=True)]
        at = np.concatenate([_wide(r["at"], len(w)).astype(np.int64) for r, w in zip(runs, who, strict=True)])
        key, doc = (np.concatenate([np.array(r[c], np.int64)[w] for r, w in zip(runs, who, strict=True)]) for c in ("keys", "docs"))
        refs = np.concatenate(refs)
        doc = doc[np.cumsum(refs) - 1]  # all references of an item have one doc_id
        found = np.zeros((len(order), window - gram + 1), bool)
        found[order] = repeated(shared, right, left[order], left_size[order], doc[order], window)
        found = np.repeat(found, refs, axis=0)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (item, near), (_, far) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        made = key[item], at[item] - far + 1, at[item] - near + window
        return pa.table([pa.array(np.concatenate(x)) for x in zip(spans, made, strict=True)], ["key", "lo", "hi"])

    return run


SPANS = "array<struct<lo:bigint,hi:bigint>>"


def _united(batches):
    """Rows of (key, spans) with the spans in order, those that meet made one."""
    for batch in batches:
        spans = batch.column("spans")
        row = np.repeat(np.arange(len(spans)), np.asarray(pc.list_value_length(spans)))
        lo, hi = (spans.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
        # Each row has places of its own in one long line.
        step = int(hi.max(initial=0)) + 2
        order = np.argsort(row * step + lo, kind="stable")
        lo, hi = (row * step + lo)[order], np.maximum.accumulate((row * step + hi)[order])
        first = np.flatnonzero(np.append(True, lo[1:] > hi[:-1])) if len(lo) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(lo))[: len(first)] - 1
        of = lo[first] // step
        structs = pa.StructArray.from_arrays([pa.array(lo[first] - of * step), pa.array(hi[last] - of * step)], ["lo", "hi"])
        ends = np.searchsorted(of, np.arange(len(spans) + 1))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], ["key", "spans"])


def _kept(with_bytes: bool):
    def run(batches):
        for batch in batches:
            for i, j, data, bounds in slices(batch.column("text")):
                spans = batch.column("spans").slice(i, j - i)
                doc = np.repeat(np.arange(j - i), np.asarray(pc.fill_null(pc.list_value_length(spans), 0)))
                spans = spans.flatten()
                cover = np.zeros(len(data) + 1, np.int64)
                for end, sign in (("lo", 1), ("hi", -1)):
                    np.add.at(cover, bounds[doc] + spans.field(end).to_numpy(zero_copy_only=False), sign)
                gone = np.cumsum(cover[:-1]) > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                starts = bounds[:-1][np.diff(bounds) > 0]
                opens[starts] = gone[starts]
                removed, runs = (np.diff(np.append(0, np.cumsum(x))[bounds]) for x in (gone, opens))
                rest, at = data[~gone].tobytes(), np.append(0, np.cumsum(~gone))[bounds].tolist()
                kept = [rest[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                cols = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(bounds)), pa.array(removed), pa.array(runs), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_bytes:
                    cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_copies(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_bytes: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every document.

    A byte goes if a string of `window` bytes that covers it also starts in a document with a smaller doc_id.  Null and empty
    texts have no bytes, texts shorter than a window stay; very long ones are handled whole.  Rows that share a doc_id
    take nothing from each other, repeated rows included.  A row without doc_id comes after all others and takes nothing from any
    row.  An empty table gives an empty one.  Other columns are ignored.
    """
    if not 0 < gram <= window <= 255:
        raise ValueError("a gram has to fit into a window, and a window into 255 bytes")
    with passing(docs.sparkSession):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("digest", F.sha2("text", 256))
        texts = rows.where(F.octet_length("text") >= window).groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("n"), F.first(F.octet_length("text")).cast("long").alias("size"))
        size = texts.agg(F.sum("size")).first()[0] or 0
        firsts = saved(texts.where("n > 1").select("digest", "least"), "firsts")
        owned = met(rows, firsts, "digest", "left")
        copies = owned.where("doc > least").select("key", F.lit(0).cast("long").alias("lo"), F.octet_length("text").cast("long").alias("hi"))
        rest = owned.where(F.coalesce(F.col("doc") == F.col("least"), F.lit(True)))
        expected = 2 * size // (window - gram + 2)
        parts, bits = max(least, expected // sizes.part_grams), min(60, expected.bit_length() + 9)
        grams = rest.where(F.octet_length("text") >= window).select("key", "text").mapInArrow(lean(_gram_runs(window, gram, bits, parts, sizes)), GRAMS)
        marks = saved(grams.groupBy("part").applyInArrow(_counted(parts, sizes), "key long, gram long, hot boolean"), "grams")
        hot = saved(marks.where("key is null").select("gram").withColumn("is_hot", F.lit(True)), "hot")
        apart = met(marks.where("hot is null").select("key", "gram"), hot, "gram", "left").select("key", "gram", F.coalesce("is_hot", F.lit(False)).alias("hot"))
        marks = marks.where("key is not null and hot is not null").unionByName(apart)
        per = marks.groupBy("key").agg(F.collect_list(F.when(~F.col("hot"), F.col("gram"))).alias("few"), F.collect_list(F.when(F.col("hot"), F.col("gram"))).alias("hot"))
        n = marks.agg(F.sum(F.when(F.col("hot"), window - gram).otherwise(1))).first()[0] or 0
        buckets = max(least, n // sizes.bucket_items)
        runs = rest.select("key", "doc", "text").join(per, "key").mapInArrow(lean(_sorted_runs(window, gram, bits, buckets, sizes)), ITEMS)
        spans = runs.groupBy("bucket").applyInArrow(_merged(window, gram), "key long, lo long, hi long")
        spans = spans.unionByName(copies).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).mapInArrow(_united, f"key long, spans {SPANS}")
        spans = saved(spans, "spans", keep=True)
    n = spans.agg(F.count("*") + F.sum(F.size("spans"))).first()[0] or 0
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    # Spans are broadcast by the number of spans, not of rows.
    rows = rows.select("doc_id", "key", "text").join(F.broadcast(spans) if n <= BROADCAST_ROWS else spans, "key", "left")
    return rows.mapInArrow(lean(_kept(with_bytes)), schema)


def op13_lcp_merge_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_copies(table(spark, sf_dir, "documents"))
