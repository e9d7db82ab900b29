"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins.  Rounds of boosting visit the features in turn and add a small
step of a shallow tree to the visited feature's lookup table; then pairs of features are
visited in the same way, a tree of one split on each.  A score is the sigmoid of the sum of one table
entry per feature and per pair, so scoring is a few array additions.

Fitting uses a bounded sample of labelled rows, features only; scoring reads every whole text.
"""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, lean, mix, runs, slices, table, totals, words

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "symbols", "bars", "bangs", "breaks", "beyond_ascii",
    "stops", "short_words", "long_words", "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "words_with_marks", "doubled_marks",
)


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = {
    "upper": _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _kind("0123456789"), "marks": _kind(".,;:!?'\"()[]{}-_/\\|@#$%^&*+=<>~`"), "symbols": _kind("#$%&*^~@<>{}[]=+_\\"),
    "bars": _kind("|"), "bangs": _kind("!?"), "breaks": _kind("\n"), "stops": _kind("."), "beyond_ascii": np.arange(256) >= 0xC0,
}


def _most(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each document's most frequent hash occurs."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return totals(np.diff(np.append(at, len(h))), np.searchsorted(doc[at], np.arange(len(bounds))), np.maximum)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, len(FEATURES)); an empty text has zeros."""
    size = np.diff(offsets).astype(float)
    w = words(data, offsets)
    n = np.diff(w.bounds).astype(float)
    some, per = np.maximum(size, 1), np.maximum(n, 1)
    sums = {}
    for name, kind in _CLASSES.items():
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=at[1:])
        sums[name] = (at[offsets[1:]] - at[offsets[:-1]], at)
    length = w.ends - w.starts
    marks = sums["marks"][1]
    in_word = marks[w.ends] - marks[w.starts]
    tail = _CLASSES["marks"][data[w.ends - 1]] & _CLASSES["marks"][data[np.maximum(w.ends - 2, 0)]] & (length > 2) if len(length) else np.zeros(0, bool)
    count = lambda x: totals(x.astype(np.int64), w.bounds) / per
    uniq = np.diff(distinct(w.hash, w.bounds)[1])
    pairs = runs(w.hash, 2, 3)
    inner = np.maximum(np.diff(w.bounds) - 1, 0)
    pick = np.ones(len(w.hash), bool)
    pick[w.bounds[1:][np.diff(w.bounds) > 0] - 1] = False
    pair_bounds = np.append(0, np.cumsum(inner))
    pairs = pairs[pick[: len(pairs)]] if len(pairs) else pairs
    lines = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets[:-1], lines + 1]))
    cuts = cuts[cuts < len(data)]
    first = np.searchsorted(w.starts, cuts)
    last = np.append(first[1:], len(w.starts))
    total = np.append(np.uint64(0), np.cumsum(mix(w.hash, 9) * np.uint64(3), dtype=np.uint64))
    line_hash = mix(total[last] - total[first], 4) if len(w.hash) else np.zeros(len(cuts), np.uint64)
    full = last > first
    line_bounds = np.searchsorted(cuts[full], offsets)
    n_lines = np.maximum(np.diff(line_bounds), 1)
    cols = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n), "word_length": totals(length, w.bounds) / per,
        "short_words": count(length <= 3), "long_words": count(length >= 14), "distinct_words": uniq / per, "top_word": _most(w.hash, w.bounds) / per,
        "distinct_pairs": np.diff(distinct(pairs, pair_bounds)[1]) / np.maximum(inner, 1), "repeated_lines": 1 - np.diff(distinct(line_hash[full], line_bounds)[1]) / n_lines,
        "words_with_marks": count(in_word > 0), "doubled_marks": count(tail),
    }
    cols |= {k: v[0] / some for k, v in sums.items()}
    return np.stack([np.where(size > 0, cols[f], 0.0) for f in FEATURES], axis=1)


class Model(NamedTuple):
    base: float
    cuts: list[np.ndarray]  # of each feature
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, floor: float) -> np.ndarray:
    """Values of a tree over a row of bins with summed gradients g and curvatures h."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= floor) & (hr >= floor), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
    k = int(np.argmax(gain))
    if gain[k] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        return out
    return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1, floor), _tree(g[k + 1 :], h[k + 1 :], depth - 1, floor)])


def _cross(g: np.ndarray, h: np.ndarray, floor: float) -> tuple[np.ndarray, float]:
    """Values of the best tree with one split on each of two features, and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = G[:-1, :-1], H[:-1, :-1]
    parts = [(a, b), (G[:-1, -1:] - a, H[:-1, -1:] - b), (G[-1:, :-1] - a, H[-1:, :-1] - b)]
    parts.append((G[-1, -1] - G[:-1, -1:] - G[-1:, :-1] + a, H[-1, -1] - H[:-1, -1:] - H[-1:, :-1] + b))
    if not a.size:
        return np.zeros_like(g), 0.0
    ok = np.minimum.reduce([hh for _, hh in parts]) >= floor
    gain = np.where(ok, sum(gg**2 / (hh + 1) for gg, hh in parts), -1.0) - G[-1, -1] ** 2 / (H[-1, -1] + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    if gain[i, j] <= 0:
        return out, 0.0
    v = [gg[i, j] / (hh[i, j] + 1) for gg, hh in parts]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 8, pair_rounds: int = 60, rate: float = 0.1, depth: int = 2) -> Model:
    """Cyclic boosting of the logistic loss; without both labels the model is constant."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Model(float(np.log(p / (1 - p))), cuts, [np.zeros(len(c) + 1) for c in cuts], [], [])
    if len(set(y.tolist())) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(x), model.base)
    floor = 4.0

    def slope():
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            g, h = slope()
            step = rate * _tree(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)), depth, min(floor, h.sum() / 50))
            t += step
            total += step[b[:, k]]
    g, h = slope()
    coarse = [np.array([len(t) for t in model.tables])]
    found = []
    for i in range(len(cuts)):
        for j in range(i):
            ni, nj = coarse[0][i], coarse[0][j]
            spot = b[:, i] * nj + b[:, j]
            _, gain = _cross(np.bincount(spot, g, ni * nj).reshape(ni, nj), np.bincount(spot, h, ni * nj).reshape(ni, nj), min(floor, h.sum() / 50))
            found.append((-gain, i, j))
    for _, i, j in sorted(found)[:pairs]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((coarse[0][i], coarse[0][j])))
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slope()
            spot = b[:, i] * t.shape[1] + b[:, j]
            step = rate * _cross(np.bincount(spot, g, t.size).reshape(t.shape), np.bincount(spot, h, t.size).reshape(t.shape), min(floor, h.sum() / 50))[0]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def _features_of(batches):
    for batch in batches:
        for i, j, data, offs in slices(batch.column("text")):
            x = features(data, offs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("y").slice(i, j - i), lists], ["doc_id", "y", "x"])


def held_out():
    """True for rows kept from learning: crc32 of doc_id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Fit on about `sample` labelled rows at most, chosen by hash; never on held-out rows.

    The sample is the one thing that is broadcast or collected: `sample` ids, then as many rows of
    len(FEATURES) numbers.  Labels other than 0 and 1 and rows without doc_id are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where("y in (0, 1) and doc_id is not null").where(~held_out())
    n = known.count()
    part = min(1_000_000, -(-sample * 1_000_000 // max(n, 1)))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < part).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = rows.join(F.broadcast(known), "doc_id").mapInArrow(lean(_features_of), "doc_id long, y int, x array<double>").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y, got.column("doc_id").to_numpy()))
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; null texts count as empty.

    Repeated rows come out as often; extra columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for i, j, data, offs in slices(batch.column("text")):
                s = model.score(features(data, offs))
                cols = [batch.column(c).slice(i, j - i) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs (all columns, in their order) that score at least `threshold`.

    Null texts score as empty ones; rows that repeat stay or go together; very long texts are read whole; an
    empty table gives an empty one.
    """
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for batch in batches:
            for i, j, data, offs in slices(batch.column(place)):
                yield batch.slice(i, j - i).filter(pa.array(model.score(features(data, offs)) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op1_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))
