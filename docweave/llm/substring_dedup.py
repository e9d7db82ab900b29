"""Removing repeated passages: seed and extend over winnowed anchors.

A window is 35 consecutive words.  Its anchor is the 12-word run of smallest hash in it, so equal
windows have equal anchors, and neighbouring windows mostly share one.  The words of all
windows that chose an anchor are its stretch.  Anchors that occur once are dropped by a count; a stretch that
occurs again as a whole is repeated as a whole.  The different stretches of an anchor are joined with each other:
from the anchor, the seed, every two are extended to the left and to the right as far as
their words agree.  A match of 35 words or more is a maximal repeat of both, and its words are removed.

Pairs are made of different stretches only, and only of anchors with PAIRED of them at most.  A hot
anchor is split by what stands around it instead: each window of its stretches meets the equal ones by its hash,
which finds the same words without a row for each pair.  A group of equal anchors is never gathered
beyond PAIRED: counts are added before the shuffle, and rows meet their anchor's count by a join
of two shuffled tables, whose large partitions Spark can split.

Words, anchors and stretches are told apart by 64-bit hashes.
"""
from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, passing, runs, saved, slices, spans_hash, table, words

WINDOW, ANCHOR = 35, 12
#: Different stretches of an anchor that are extended pair by pair, and pairs compared at once.
PAIRED, AT_ONCE = 64, 1 << 17


class Anchors(NamedTuple):
    """Anchor j of the slice: its hash and first word, its first and last window; anchors of document d are bounds[d]:bounds[d + 1]."""

    hash: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    bounds: np.ndarray


def anchors(w, window: int, anchor: int) -> Anchors:
    """The anchors of each document's windows, in order; ties go to the leftmost run."""
    span = window - anchor + 1
    n = len(w.hash) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Anchors(np.zeros(0, U64), none, none, none, np.zeros(len(w.bounds), np.int64))
    grams = runs(w.hash, anchor, 7)
    best, at, have = grams, np.arange(len(grams)), 1
    while have < span:
        d = min(have, span - have)
        m = len(best) - d
        right = best[d:] < best[:m]
        best, at = np.where(right, best[d:], best[:m]), np.where(right, at[d:], at[:m])
        have += d
    at = at[:n]
    ok = np.zeros(n + 1, np.int64)
    per = np.diff(w.bounds)
    long = np.flatnonzero(per >= window)
    np.add.at(ok, w.bounds[long], 1)
    np.add.at(ok, w.bounds[long] + per[long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(ok[:n]))
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, hi = starts[first], starts[last] if len(first) else none
    return Anchors(grams[at[first]], at[first], lo, hi, np.searchsorted(lo, w.bounds))


def _per_slice(batch, window, anchor):
    for i, j, data, offs in slices(batch.column("text")):
        w = words(data, offs)
        yield i, j, data, w, anchors(w, window, anchor)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def _occurrences(window: int, anchor: int):
    def run(batches):
        for batch in batches:
            key = batch.column("key").to_numpy()
            for i, j, _, w, a in _per_slice(batch, window, anchor):
                per = np.diff(a.bounds)
                doc = np.repeat(key[i:j], per)
                nth = np.arange(len(doc)) - np.repeat(a.bounds[:-1], per)
                stretch = spans_hash(w.hash, a.lo, a.hi + window, 31)
                yield pa.RecordBatch.from_arrays([_long(a.hash), _long(stretch), _long(doc), _long(nth)], ["anchor", "stretch", "key", "nth"])

    return run


def _picked(a: Anchors, lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Anchors by their numbers in each document, and their documents."""
    some = [np.unique(np.array(x or (), np.int64)) for x in lists]
    doc = np.repeat(np.arange(len(some)), [len(x) for x in some])
    return a.bounds[doc] + (np.concatenate(some) if some else doc), doc


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i] .. lo[i] + n[i] - 1, end to end."""
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


SPOTS = "anchor long, key long, first long, seed long, words array<long>, win long"


def _spots(window: int, anchor: int):
    """Of the stretches `few` a row with the first word, the seed's place and all word hashes; of `many` one for each window."""
    names = [c.split()[0] for c in SPOTS.split(", ")]

    def run(batches):
        for batch in batches:
            key, few, many = batch.column("key").to_numpy(), batch.column("few").to_pylist(), batch.column("many").to_pylist()
            for i, j, _, w, a in _per_slice(batch, window, anchor):
                picked, doc = _picked(a, few[i:j])
                if len(picked):
                    n = a.hi[picked] - a.lo[picked] + window
                    hashes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), _long(w.hash[_ranges(a.lo[picked], n)]))
                    cols = [_long(a.hash[picked]), _long(key[i:j][doc]), _long(a.lo[picked] - w.bounds[doc]), _long(a.at[picked] - a.lo[picked]), hashes]
                    yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(picked), pa.int64())], names)
                picked, doc = _picked(a, many[i:j])
                if len(picked):
                    n = a.hi[picked] - a.lo[picked] + 1
                    first, doc = _ranges(a.lo[picked], n), np.repeat(doc, n)
                    cols = [_long(np.repeat(a.hash[picked], n)), _long(key[i:j][doc]), _long(first - w.bounds[doc])]
                    none = [pa.nulls(len(first), t) for t in (pa.int64(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*cols, *none, _long(spans_hash(w.hash, first, first + window, 33))], names)

    return run


def _agree(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words agree from the seed on, at most `most`."""
    return np.minimum(np.logical_and.accumulate(x == y, axis=1).sum(1), most)


def _extended(window: int, anchor: int):
    """(key, lo, hi): maximal repeats of the stretches that rows(anchor, group) have in common, seed by seed."""
    span = window - anchor

    def repeats(rows):
        per = np.asarray(pa.compute.list_value_length(rows))
        got = rows.flatten()
        key, first, seed = (got.field(c).to_numpy(zero_copy_only=False) for c in ("key", "first", "seed"))
        size = np.asarray(pa.compute.list_value_length(got.field("words")))
        flat = np.append(got.field("words").flatten().to_numpy(zero_copy_only=False), 0)
        start = np.cumsum(size) - size
        right = size - seed - anchor
        # Words from the seed on, to the left and to the right; what is beyond a stretch is cut by `most`.
        step = np.arange(span)
        left_words = flat[np.maximum(start[:, None] + seed[:, None] - 1 - step, 0)]
        right_words = flat[np.minimum(start[:, None] + seed[:, None] + anchor + step, len(flat) - 1)]
        ends = np.cumsum(per)
        ahead = np.repeat(ends, per) - 1 - np.arange(len(key))  # later stretches of the same seed
        a = np.repeat(np.arange(len(key)), ahead)
        b = a + 1 + _ranges(np.zeros(len(ahead), np.int64), ahead)
        for k in range(0, len(a), AT_ONCE):
            x, y = a[k : k + AT_ONCE], b[k : k + AT_ONCE]
            back = _agree(left_words[x], left_words[y], np.minimum(seed[x], seed[y]))
            on = _agree(right_words[x], right_words[y], np.minimum(right[x], right[y]))
            long = back + anchor + on >= window
            for side in (x[long], y[long]):
                spot = first[side] + seed[side]
                cols = np.unique(np.stack([key[side], spot - back[long], spot + anchor + on[long]]), axis=1)
                yield pa.RecordBatch.from_arrays([_long(c) for c in cols], ["key", "lo", "hi"])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                yield from repeats(batch.column("group").slice(k, 256))

    return run


def joined_words(data: np.ndarray, w, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words, each followed by one space, and the bounds of each document's part."""
    a, n = w.starts[keep], w.ends[keep] - w.starts[keep] + 1
    ends = np.cumsum(n)
    out = np.full(int(n.sum()), 0x20, np.uint8)
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    src = np.arange(len(out)) + np.repeat(a - (ends - n), n)
    out[body] = data[src[body]]
    bounds = np.append(0, ends)[np.append(0, np.cumsum(keep))[w.bounds]]
    return out.tobytes(), bounds


def _remove(window: int, anchor: int, with_text: bool):
    def run(batches):
        for batch in batches:
            whole, parts = batch.column("whole").to_pylist(), batch.column("parts")
            for i, j, data, w, a in _per_slice(batch, window, anchor):
                cover = np.zeros(len(w.hash) + 1, np.int64)
                picked, _ = _picked(a, whole[i:j])
                np.add.at(cover, a.lo[picked], 1)
                np.add.at(cover, a.hi[picked] + window, -1)
                part = parts.slice(i, j - i)
                doc = np.repeat(np.arange(j - i), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(part), 0)))
                part = part.flatten()
                for end, sign in (("lo", 1), ("hi", -1)):
                    np.add.at(cover, w.bounds[doc] + part.field(end).to_numpy(zero_copy_only=False), sign)
                keep = np.cumsum(cover[:-1]) == 0
                text, bounds = joined_words(data, w, keep)
                n = np.diff(w.bounds)
                gone = n - np.diff(np.append(0, np.cumsum(keep))[w.bounds])
                kept = [text[p : max(p, q - 1)] for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                cols = [batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(gone), pa.array([hashlib.sha256(t).hexdigest() for t in kept])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array([t.decode() for t in kept], pa.string())], [*names, "text"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of every document.

    A word goes if some window of `window` words that covers it also starts anywhere else,
    in the same or another document.  Null and empty texts have no words; their hash is the
    empty string's.  Texts shorter than a window stay whole but for white space; very long ones are read
    whole.  Rows that repeat are copies of each other; rows that share an id, or have none, are
    documents of their own.  An empty table gives an empty one.  Extra columns are ignored.
    """
    with passing(docs.sparkSession):
        return _removed(docs, window, anchor, with_text)


def _removed(docs: DataFrame, window: int, anchor: int, with_text: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    seen = rows.select("key", "text").mapInArrow(_occurrences(window, anchor), "anchor long, stretch long, key long, nth long")
    twice = seen.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("least"), F.max("stretch").alias("most")).where("n > 1")
    twice = saved(twice.select("anchor", (F.col("least") == F.col("most")).alias("same")), "anchors")
    seeds = saved(seen.join(twice, "anchor"), "seeds")
    differ = seeds.where("not same")
    kinds = differ.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("key", "nth")).alias("one"))
    kinds = saved(kinds, "stretches")
    again = differ.join(kinds.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"])
    whole = seeds.where("same").select("key", "nth").union(again.select("key", "nth"))
    whole = whole.groupBy("key").agg(F.collect_set("nth").alias("whole"))
    # One stretch of each kind stands for all; one that occurs twice is covered already, but others may match it.
    sizes = saved(kinds.groupBy("anchor").agg((F.count("*") > PAIRED).alias("hot")), "kinds")
    emit = kinds.join(sizes, "anchor").select("one.key", "one.nth", "hot").groupBy("key")
    emit = emit.agg(F.collect_list(F.when(~F.col("hot"), F.col("nth"))).alias("few"), F.collect_list(F.when(F.col("hot"), F.col("nth"))).alias("many"))
    spots = saved(rows.select("key", "text").join(emit, "key").mapInArrow(_spots(window, anchor), SPOTS), "spots")
    # PAIRED stretches of an anchor at the most; those of rows that repeat are one.
    groups = spots.where("win is null").groupBy("anchor").agg(F.collect_set(F.struct("key", "first", "seed", "words")).alias("group"))
    parts = groups.select("group").mapInArrow(_extended(window, anchor), "key long, lo long, hi long")
    wins = spots.where("win is not null").select("anchor", "win", "key", "first")
    known = wins.groupBy("anchor", "win").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "win")
    single = wins.join(saved(known, "repeats"), ["anchor", "win"]).select("key", F.col("first").alias("lo"), (F.col("first") + window).alias("hi"))
    parts = parts.union(single).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))
    marks = saved(whole.join(parts, "key", "full_outer"), "marks", keep=True)
    out = rows.join(marks, "key", "left").select("doc_id", "text", "whole", "parts")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")
    return out.mapInArrow(_remove(window, anchor, with_text), schema)


def op5_seed_extend_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
