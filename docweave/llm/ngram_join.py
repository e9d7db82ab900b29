"""N-gram Jaccard self-join by parity sketches.

Each document is the set of its shingles.  Two sets with Jaccard >= t differ in at most
(a + b)(1 - t)/(1 + t) shingles.  They are dealt to B blocks by hash.  With B one above the largest
difference a size band allows, some block of two linked documents is equal (pigeonhole), and joining
on (band, block number, XOR of the block's hashes) finds them all.  Candidates pass the Hamming
bound on their sketches, in which each shingle flips one bit of at least two a shingle, so that
the distance is at most the difference; then whole texts are compared exactly.

Bands grow by half, or more where a linked document may be larger than that.  A document stands in
its own band and, if some document of the band below may be linked with it, in that one too.

Sets are told apart by two 64-bit sums, shingles by 64-bit hashes of their words.
"""
from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import U64, distinct, fresh, lean, met, mix, passing, saved, shingles, slices, totals, words


class Bands(NamedTuple):
    starts: np.ndarray  # smallest size of each band
    blocks: np.ndarray
    reach: np.ndarray  # largest size that a document of the band may be linked with
    spare: np.ndarray  # blocks beyond those that pigeonhole needs


@lru_cache
def bands(percent: int) -> Bands:
    """The size bands.  Spare blocks make up for those that are empty, which tell little.

    A band ends beyond the largest document that may be linked with the band below, so two bands are enough.
    """
    if not 50 <= percent <= 100:
        raise ValueError("the Jaccard threshold has to be from 50 to 100 percent")
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2, (ends[-1] - 1) * 100 // percent + 1))
    starts, most = np.array(ends[:-1], np.int64), np.array(ends[1:], np.int64) - 1
    reach = most * 100 // percent
    need = (most + reach) * (100 - percent) // (100 + percent) + 1
    blocks = need.copy()
    for extra in range(1, 31):
        b = need + need * extra // 100
        empty = b * np.exp(-starts / b)
        fits = (blocks == need) & (b - empty - 2 * np.sqrt(empty) >= need) & (b > need)
        blocks = np.where(fits, b, blocks)
    return Bands(starts, blocks, reach, blocks - need)


def _keys(h, sizes, band, made: Bands):
    """Per document its keys, end to end, with bounds.

    A key stands for one block: band, number and the XOR of its shingles' hashes.  A document with no
    more empty blocks than there are spare ones needs none of them: of its equal blocks
    with a linked document at least one is not empty.  If both have more, both keep them.
    """
    counts = np.where(band >= 0, made.blocks[band], 0)
    at = np.append(0, np.cumsum(counts))
    own = np.repeat(counts, sizes)
    use = own > 0
    x = mix(h[use], 5)
    spot = np.repeat(at[:-1], sizes)[use] + ((x >> U64(16)) % own[use].astype(U64)).astype(np.int64)
    keys = np.zeros(at[-1], U64)
    np.bitwise_xor.at(keys, spot, mix(h[use], 8))
    number = np.arange(at[-1]) - np.repeat(at[:-1], counts)
    keys = mix(keys + mix((np.repeat(band, counts) * (1 << 40) + number).astype(U64), 9), 10)
    empty = np.bincount(spot, minlength=at[-1]) == 0
    n_empty = np.append(0, np.cumsum(empty))[at]
    drop = empty & np.repeat(np.diff(n_empty) <= made.spare[band], counts)
    return keys[~drop], np.append(0, np.cumsum(~drop))[at]


SCHEMA = "doc_id long, own long, n long, h1 long, h2 long, sketch array<long>, own_keys array<long>, low_keys array<long>"

#: Words of the smallest sketch, and shingles to a word of larger ones (so two bits and more to a shingle).
LEAST_WORDS, SHINGLES_A_WORD = 8, 32


def sketch_words(starts: np.ndarray) -> np.ndarray:
    """64-bit words of the sketches of each band: a power of two, so that the wider of two can be folded."""
    return np.maximum(LEAST_WORDS, 1 << np.ceil(np.log2(np.maximum(starts / SHINGLES_A_WORD, 1))).astype(np.int64))


def _sketches(h: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of sets of n shingles in bands from `starts`, end to end, with bounds."""
    counts = np.where(n > 0, sketch_words(starts), 0)
    at = np.append(0, np.cumsum(counts))
    flat, x = np.zeros(at[-1], U64), mix(h, 6)
    spot = np.repeat(at[:-1], n) + ((x >> U64(8)) % np.repeat(counts, n).astype(U64)).astype(np.int64)
    np.bitwise_xor.at(flat, spot, U64(1) << (x & U64(63)))
    return flat, at


def signed(batch: pa.RecordBatch, size: int, percent: int, lower: bool, keys):
    """Rows of SCHEMA for a batch (doc_id, own, text); keys(h, bounds, n, own band, low band) gives both lists of keys."""
    made = bands(percent)
    for i, j, data, offs in slices(batch.column("text")):
        h, bounds = distinct(*shingles(words(data, offs, lower), size))
        n = np.diff(bounds)
        own = np.searchsorted(made.starts, n, side="right") - 1
        low = np.where((own > 0) & (n <= made.reach[own - 1]), own - 1, -1)
        cols = [*(batch.column(c).slice(i, j - i) for c in ("doc_id", "own")), pa.array(n, pa.int64())]
        cols += [pa.array(totals(mix(h, s), bounds).view(np.int64)) for s in (11, 12)]
        for values, ends in (_sketches(h, n, made.starts[np.maximum(own, 0)]), *keys(h, bounds, n, own, low)):
            cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64))))
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SCHEMA.split(", ")])


def _signatures(size: int, percent: int, lower: bool):
    made = bands(percent)

    def keys(h, bounds, n, own, low):
        return _keys(h, n, own, made), _keys(h, n, low, made)

    def run(batches):
        for batch in batches:
            yield from signed(batch, size, percent, lower, keys)

    return run


def _far(x: str, y: str) -> str:
    """SQL for the Hamming distance of two sketches, the wider of which is folded."""
    fold = lambda z: f"zip_with(slice({z}, 1, size({z}) div 2), slice({z}, size({z}) div 2 + 1, size({z}) div 2), (p, q) -> p ^ q)"
    apart = lambda v, w: f"aggregate(zip_with({v}, {w}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return f"case when size({x}) = size({y}) then {apart(x, y)} when size({x}) > size({y}) then {apart(fold(x), y)} else {apart(x, fold(y))} end"


class _Side(NamedTuple):
    """Members of a tile with sketches of one width, by rising size."""

    n: np.ndarray
    node: np.ndarray
    comp: np.ndarray
    sketch: np.ndarray


def _sides(rows: pa.Table) -> dict[int, _Side]:
    n, node, comp = (rows.column(c).to_numpy() for c in ("n", "node", "comp"))
    lists = rows.column("sketch").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = np.asarray(lists.values).view(U64)
    out = {}
    for wide in np.unique(np.diff(ends)).tolist():
        at = np.flatnonzero(np.diff(ends) == wide)
        at = at[np.argsort(n[at], kind="stable")]
        out[wide] = _Side(n[at], node[at], comp[at], flat[ends[at][:, None] + np.arange(wide)])
    return out


def _close(rows: pa.Table, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components, of one tile or of two, that sizes and the Hamming bound allow."""
    own, tile, other = (rows.column(c).to_numpy() for c in ("own", "tile", "other"))
    alone = tile[0] == other[0]
    one = _sides(rows.filter(pa.array(own == tile)))
    two = one if alone else _sides(rows.filter(pa.array(own == other)))
    out = []
    for wa, a in one.items():
        for wb, b in two.items():
            if max(wa, wb) > 2 * min(wa, wb):
                continue  # too far apart in size
            sa, sb = a.sketch, b.sketch
            if wa > wb:
                sa = sa[:, :wb] ^ sa[:, wb:]
            elif wb > wa:
                sb = sb[:, :wa] ^ sb[:, wa:]
            lo = np.searchsorted(b.n, -(-a.n * percent // 100))
            hi = np.searchsorted(b.n, a.n * 100 // percent, side="right")
            for k in range(len(a.n)):
                near = slice(lo[k], hi[k])
                ok = (b.comp[near] != a.comp[k]) & (b.node[near] != a.node[k])
                if alone:
                    ok &= b.node[near] > a.node[k]
                if not ok.any():
                    continue
                far = np.bitwise_count(sb[near] ^ sa[k]).sum(1, dtype=np.int64)
                ok &= far <= (a.n[k] + b.n[near]) * (100 - percent) // (100 + percent)
                hits = b.node[near][ok]
                if len(hits):
                    out.append((np.minimum(hits, a.node[k]), np.maximum(hits, a.node[k])))
    return out


def _tile_pairs(percent: int):
    """Rows come sorted by key and tiles; at most two tiles of rows are held at once."""

    def pairs_of(held):
        got = _close(pa.Table.from_batches(held), percent)
        a, b = (np.concatenate([p[k] for p in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            spots = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "tile", "other")], 1)
            cuts = np.append(np.append(0, np.flatnonzero((spots[1:] != spots[:-1]).any(1)) + 1), len(spots))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                spot = tuple(spots[lo].tolist())
                if held and spot != at:
                    yield pairs_of(held)
                    held = []
                at = spot
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield pairs_of(held)

    return run


#: Members of a tile, and 64-bit words of its sketches, at most.
TILE, TILE_WORDS = 4096, 1 << 22


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, own, text); own is one for rows that are equal in id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("own"), "text")


def _classes(docs: DataFrame, size: int, percent: int, lower: bool, make=_signatures) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, own, n, h1, h2) and the classes (h1, h2, n, comp, least) of their sets.

    A node is a set, under the number of a row that has it, so ids may be shared or missing.  make(size, percent,
    lower) gives rows of SCHEMA; nodes that share one of its keys are compared.
    """
    rows = _rows(docs)
    sig = rows.mapInArrow(lean(make(size, percent, lower)), SCHEMA)
    sig = saved(sig.withColumn("node", F.monotonically_increasing_id()), "sketches", keep=True)
    sets = sig.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("node", "own")).alias("x"), F.min("doc_id").alias("least"))
    sets = saved(sets.select("h1", "h2", "n", "x.node", "x.own", "least"), "sets")
    nodes = met(sig.drop("own"), sets.select("node"), "node")
    every = nodes.select(F.explode("own_keys").alias("key"), "node").union(nodes.select(F.explode("low_keys").alias("key"), "node"))
    shared = saved(every.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    members = saved(linking.central(saved(every.join(shared, "key"), "members")), "members")

    def likely(pairs):
        for side in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")), side)
        pairs = pairs.where(f"least(a_n, b_n) * 100 >= greatest(a_n, b_n) * {percent}")
        return pairs.where(f"{_far('a_sketch', 'b_sketch')} <= (a_n + b_n) * {100 - percent} div {100 + percent}").select("a", "b")

    def texts(ids):
        # Rows that repeat add up in the tasks, before the shuffle.
        ids = saved(ids.join(sets.select("node", "own"), "node"), "ids")
        return met(rows.select("own", "text"), ids, "own", "inner").select("node", "text").dropDuplicates(["node"])

    def tiles(groups):
        groups = saved(groups.join(nodes.select("node", "n", F.size("sketch").alias("wide")), "node"), "groups")
        dealt = groups.groupBy("key").agg(F.count("*").alias("members"), F.max("wide").alias("widest"))
        dealt = dealt.select("key", F.ceil(F.col("members") / F.least(F.lit(TILE), F.floor(F.lit(TILE_WORDS) / F.col("widest")))).cast("int").alias("n_tiles"))
        cells = linking.dealt(groups, saved(dealt, "tiles")).join(nodes.select("node", "n", "sketch"), "node")
        parts = cells.repartition("key", "tile", "other").sortWithinPartitions("key", "tile", "other")
        return parts.mapInArrow(lean(_tile_pairs(percent)), "a long, b long")

    comp = linking.classes(members, likely, texts, size, percent, lower, tiles)
    named = sets.join(comp, "node", "left").select("h1", "h2", "n", F.coalesce("comp", "node").alias("comp"), "least")
    least = named.groupBy("comp").agg(F.min("least").alias("least"))
    return sig, saved(named.drop("least").join(least, "comp"), "classes", keep=True)


def near_classes(docs: DataFrame, size: int = 5, percent: int = 80, lower: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): exact classes of documents linked at the given Jaccard (50 to 100).

    Null and empty texts, and texts without words, have an empty set (n_shingles 0) and are linked
    with nothing; fewer words than `size` make one shingle; very long texts count whole.  Equal sets are
    linked.  Rows that repeat come out as often; rows that share an id are documents of their own, linked by what
    each says; a null doc_id takes its class's id, if that has one.  An empty table gives an empty
    one.  Extra columns are ignored.
    """
    with passing(docs.sparkSession):
        sig, named = _classes(docs, size, percent, lower)
    got = sig.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, lower: bool = False) -> DataFrame:
    """The rows of docs without all but one row of each class (one of its smallest doc_id, which is not null if any is).

    Documents without words stay, null and empty texts and repeats included, as nothing is linked with
    them.  An empty table gives an empty one; all columns come out as they were.
    """
    (own,) = fresh(docs, "own")
    with passing(docs.sparkSession):
        with passing(docs.sparkSession):
            sig, named = _classes(docs, size, percent, lower)
        rows = sig.where("n > 0").select("doc_id", "own", "h1", "h2", "n").join(named.select("h1", "h2", "n", "comp"), ["h1", "h2", "n"])
        rows = rows.groupBy("comp", "own").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
        best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("best")).select("comp", "best.own")
        # What goes, and what stays in more than one row.
        drop = saved(rows.select("comp", "own").join(best, ["comp", "own"], "left_anti").select(F.col("own").alias(own)), "drop", keep=True)
        again = saved(rows.where("copies > 1").join(best, ["comp", "own"], "left_semi").select(F.col("own").alias(own)), "again", keep=True)
    keyed = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    kept = met(keyed, drop, own, "left_anti")
    if not again.isEmpty():
        kept = met(kept, again, own, "left_anti").unionByName(met(kept, again, own).dropDuplicates([own]))
    return kept.select(*docs.columns)


def op9_ngram_jaccard(spark, sf_dir):
    """Three-word shingles with A-Z folded, Jaccard 0.9 or more."""
    from .common import table

    return near_classes(table(spark, sf_dir, "documents"), size=3, percent=90, lower=True)
