"""Shared helpers of the training-data operators.

`scratch` names the shared folder for tables written between stages, `saved` writes one and
reads it back (that cuts lineage and survives the loss of an executor).  The numpy helpers
split the UTF-8 bytes of many texts into words and hash them without a Python loop over words.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  These six bytes never occur
inside a multi-byte UTF-8 sequence, so splitting bytes equals splitting characters.
"""
from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are handled in slices of about so many bytes, so that work arrays stay small.
SLICE_BYTES = 1 << 18


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, one of our own, which only a local master can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = getattr(spark, "_docweave_scratch", None)
        if not folder:
            folder = spark._docweave_scratch = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


#: Paths of the tables that each open `passing` block removes at its end, the innermost last; each thread has its own.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back with the same schema.

    Inside `passing` the table goes at the end of the block; with keep at the end of the block around it,
    if there is one.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    blocks = _passing.get()[:-1] if keep else _passing.get()
    if blocks:
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """Tables saved inside are removed at the end; what the block's results still read has to be kept."""
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the cluster's file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, upper and lower case being the same."""
    known = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


#: Tables of ids up to so many rows (of a few numbers) may be sent to every task.
BROADCAST_ROWS = 1_000_000


def met(rows: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """rows.join(ids, on, how) where ids(on) was saved: wide rows stay where they are if ids are
    counted to be few; beyond BROADCAST_ROWS both sides are shuffled.
    """
    small = ids.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if small else ids, on, how)


def lean(run: Callable) -> Callable:
    """run(batches) for mapInArrow, after each batch of which freed memory goes back to the system.

    Spark uses a Python worker again for later stages, so what it merely keeps adds to their needs.
    """

    def freed() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    def given(batches):
        for batch in batches:
            yield batch
            del batch
            freed()

    def own(batches):
        for out in run(given(batches)):
            yield out
            del out
        freed()

    return own


def cut(batches, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, for functions that hold Python objects of each row."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


# ---------------------------------------------------------------- hashing of words

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        run = np.full(max(1 << n.bit_length(), 1024), U64(base))
        run[0] = 1
        have = _tables[base] = np.multiply.accumulate(run)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = x + U64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Word i spans bytes starts[i]:ends[i]; document d has words bounds[d]:bounds[d + 1]."""

    hash: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents data[offsets[d]:offsets[d + 1]]; lower folds A-Z only."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), np.zeros(len(offsets), np.int64), none, none)
    sep = _SEP[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = ~sep, ~sep
    first[1:] &= sep[:-1] | cut[1:n]
    last[:-1] &= sep[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    codes = (_LOWER[data] if lower else data).astype(U64) + U64(1)
    total = np.zeros(n + 1, U64)
    np.cumsum(codes * powers(_BASE, n), out=total[1:])
    h = mix((total[ends] - total[starts]) * powers(_INV, n)[starts] + (ends - starts).astype(U64))
    return Words(h, np.searchsorted(starts, offsets), starts, ends)


def runs(h: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """For each i a hash of h[i:i + size]; the last size - 1 entries don't exist."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = (_BASE * (2 * seed + 1) + 2 * seed) | 1
    out = h[:n].copy()
    for j in range(1, size):
        out *= U64(base % (1 << 64))
        out += h[j : j + n]
    return mix(out, seed)


def spans_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each h[lo:hi], of any length, by prefix sums."""
    base = (_BASE * (2 * seed + 1) + 2 * seed) % (1 << 64) | 1
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h, seed) * powers(base, len(h)), out=total[1:])
    inv = powers(pow(base, -1, 1 << 64), len(h) + 1)
    return mix((total[hi] - total[lo]) * inv[lo] + (hi - lo).astype(U64), seed)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside each document, with bounds by document.

    A document of fewer words, but one at least, gives its whole sequence as one shingle;
    one without words gives none.  Repeats are kept.
    """
    per = np.diff(w.bounds)
    full = runs(w.hash, size)
    counts = np.where(per >= size, per - size + 1, (per > 0).astype(per.dtype))
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - w.bounds[:-1], counts)
    short = np.flatnonzero((per > 0) & (per < size))
    out = np.zeros(len(at), U64)
    keep = np.ones(len(at), bool)
    keep[bounds[short]] = False
    out[keep] = full[at[keep]]
    out[bounds[short]] = spans_hash(w.hash, w.bounds[short], w.bounds[short + 1], 99)
    return out, bounds


def distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, with new bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(bounds)))


def totals(x: np.ndarray, bounds: np.ndarray, ufunc=np.add, empty=0) -> np.ndarray:
    """ufunc over each document's entries; `empty` where there are none."""
    out = np.full(len(bounds) - 1, empty, x.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = ufunc.reduceat(x, bounds[some])
    return out


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, bytes, offsets) for texts[i:j], about `limit` bytes each; null counts as empty."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        return
    texts = texts.fill_null("") if texts.null_count else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    buffers = texts.buffers()
    offs = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def u32_sum_hash(h: np.ndarray) -> np.ndarray:
    """The upper 32 bits of 64-bit hashes."""
    return (h >> U64(32)).astype(np.uint32)


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
