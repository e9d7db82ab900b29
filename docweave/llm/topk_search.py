"""Exact top-k inner-product search by distributed histogram selection.

Vectors are packed into chunks of rows, queries into blocks of bounded size, and every block meets
every chunk.  A query's state is the range of scores in which its k-th highest lies.  Each round
scores the chunks, counts the scores of that range in equal bins, adds the counts up in Spark, and
goes on with the bin that holds the k-th; it ends where the bin is one score wide or holds no
score too many.  Then exactly the scores from there up are kept, and ties are broken by vec_id.

The rounds depend on the width of the range alone (9 bits each), not on the rows; all blocks go through
a round in one job.  The driver only asks whether a query is left.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, saved, table

#: Queries of a block on average, bins of a histogram, vectors of a chunk, blocks a task counts for at once.
BLOCK, BINS, STEP, HELD = 1024, 512, 4096, 8
#: Scores beyond the range of a long count as its ends.
MOST = (1 << 63) - 1

PACKED = "ids binary, kind string, dim long, vecs binary"


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """floor(1024 x) of each vector; shorter ones are filled with zeros, longer ones cut at dim."""
    sizes = np.asarray(pa.compute.list_value_length(column)) if len(column) else np.zeros(0, int)
    flat = np.asarray(column.flatten(), np.float64)
    with np.errstate(over="ignore"):
        flat = np.nan_to_num(np.floor(1024.0 * flat))
    dim = int(sizes.max(initial=0)) if dim is None else dim
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    at = np.append(0, np.cumsum(sizes))
    for i in range(len(sizes)):
        n = min(dim, sizes[i])
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


def _pack(ids: np.ndarray, vecs: np.ndarray) -> list:
    """Columns of PACKED for one row, in the smallest numbers that hold the components."""
    most = np.abs(vecs).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return [ids.astype("<i8").tobytes(), kind, vecs.shape[1], vecs.astype(kind).tobytes()]


def _unpack(row: dict, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[side + "ids"], "<i8")
    vecs = np.frombuffer(row[side + "vecs"], row[side + "kind"]).reshape(len(ids), row[side + "dim"])
    return ids, vecs.astype(np.float64)


def _norms(vecs: np.ndarray) -> np.ndarray:
    """Lengths, rounded up; kept finite."""
    with np.errstate(over="ignore"):
        return np.minimum(np.sqrt((vecs * vecs).sum(1)) * (1 + 1e-9), 1e150)


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers in doubles modulo 2**64, exactly."""
    size = np.fmod(np.abs(x), 2.0**64).astype(U64)
    return np.where(x < 0, U64(0) - size, size)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as int64, beyond its range the nearest end but -2**63.

    Doubles are exact below 2**53, products modulo 2**64 wherever the true score is in the range; the few
    pairs near or beyond its ends are done in whole numbers of any size.
    """
    dim = min(q.shape[1], v.shape[1])
    q, v = q[:, :dim], v[:, :dim]
    with np.errstate(all="ignore"):
        bound = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(dim, 1)
        if bound < 2**53:
            return (q @ v.T).astype(np.int64)
        got = (_whole(q) @ _whole(v).T).view(np.int64)
        if bound < 2**62:
            return got
        near = q @ v.T
        sure = np.abs(near) + np.abs(q) @ np.abs(v).T * 1e-12 < 2.0**63 - 2048
    for i, j in zip(*np.nonzero(~sure), strict=True):
        exact = sum(int(a) * int(b) for a, b in zip(q[i], v[j], strict=True))
        got[i, j] = max(-MOST, min(MOST, exact))
    return got


def _chunks(batches):
    """Rows of PACKED and the longest vector's length."""
    for batch in batches:
        vec = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for k in range(0, len(vec), STEP):
            vecs = _matrix(batch.column("embedding").slice(k, STEP))
            row = [*_pack(vec[k : k + STEP], vecs), float(_norms(vecs).max(initial=0))]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["ids", "kind", "dim", "vecs", "norm"])


def _blocks(batches):
    """One row of PACKED for each block, with the length of each query."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows = batch.column("rows").slice(k, 1).flatten()
            ids, vecs = rows.field("vec_id").to_numpy(zero_copy_only=False), _matrix(rows.field("embedding"))
            row = [batch.column("block")[k].as_py(), *_pack(ids, vecs), _norms(vecs).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "ids", "kind", "dim", "vecs", "norms"])


class State:
    """Of a block's queries: scores low to low + span - 1 hold the k-th, `above` lie higher; bins are `width` wide."""

    KEYS = ("low", "span", "width", "above", "done")
    SCHEMA = "low binary, span binary, width binary, above binary, done binary, open boolean"

    def __init__(self, row: dict):
        kinds = ("<i8", "<u8", "<u8", "<i8", "?")
        self.low, self.span, self.width, self.above, self.done = (np.frombuffer(row[k], t) for k, t in zip(self.KEYS, kinds, strict=True))

    @staticmethod
    def columns(low, span, above, done) -> list:
        width = span // U64(BINS) + (span % U64(BINS) > 0)
        done = done | (span <= 1)
        return [low.tobytes(), span.tobytes(), np.maximum(width, U64(1)).tobytes(), above.tobytes(), done.tobytes(), bool((~done).any())]


def _first(most: float):
    """The state before the first round: all scores that lengths allow."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                norms = np.frombuffer(r["norms"])
                b = np.array([min(MOST, int(x * min(most, 1e150)) + 1) for x in norms.tolist()], np.int64)
                row = [r["block"], *State.columns(-b, b.astype(U64) * U64(2) + U64(1), np.zeros(len(b), np.int64), np.zeros(len(b), bool))]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", *State.KEYS, "open"])

    return run


def _histograms(batches):
    """(block, q, bin, n) of the pairs of a chunk and a block: counts of the scores in each query's range."""
    held: dict[int, np.ndarray] = {}

    def rows():
        for block, counts in held.items():
            at = np.flatnonzero(counts)
            cols = [np.full(len(at), block), at // BINS, at % BINS, counts[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["block", "q", "bin", "n"])
        held.clear()

    for batch in batches:
        for r in batch.to_pylist():
            (qs, q), (ids, v), s = _unpack(r, "q_"), _unpack(r), State(r)
            if r["block"] not in held and len(held) == HELD:
                yield from rows()
            counts = held.setdefault(r["block"], np.zeros(len(qs) * BINS, np.int64))
            up = scores(q, v).view(U64) - s.low.view(U64)[:, None]
            i, j = np.nonzero((up < np.where(s.done, U64(0), s.span)[:, None]) & (qs[:, None] != ids[None, :]))
            counts += np.bincount(i * BINS + (up[i, j] // s.width[i]).astype(np.int64), minlength=len(counts))
    yield from rows()


def _narrowed(k: int):
    """The state after a round, of rows with the block's state and its `counts`."""

    def run(batches):
        for batch in batches:
            for at, r in enumerate(batch.drop_columns("counts").to_pylist()):
                s = State(r)
                hist = np.zeros((len(s.low), BINS), np.int64)
                known = batch.column("counts").slice(at, 1).flatten()
                if len(known):
                    q, b, n = (known.field(c).to_numpy(zero_copy_only=False) for c in ("q", "bin", "n"))
                    hist[q, b] = n
                atop = hist[:, ::-1].cumsum(1)[:, ::-1] + s.above[:, None]  # at or above each bin's lower end
                reached = atop >= k
                some = reached.any(1)
                spot = np.where(some, BINS - 1 - np.argmax(reached[:, ::-1], axis=1), 0)
                row = np.arange(len(spot))
                far = spot.astype(U64) * s.width
                low, span = (s.low.view(U64) + far).view(np.int64), np.minimum(s.width, s.span - far)
                above = atop[row, spot] - hist[row, spot]
                # Fewer than k scores in all: the whole range stays, and all of them are taken.
                go = some & ~s.done
                done = s.done | ~some | (atop[row, spot] == k)
                new = State.columns(np.where(go, low, s.low), np.where(go, span, s.span), np.where(go, above, s.above), done)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (r["block"], *new)], ["block", *State.KEYS, "open"])

    return run


def _selected(k: int):
    """(query_id, vec_id, score) at or above each query's k-th; of those equal to the lowest, a chunk's first suffice."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                (qs, q), (ids, v), s = _unpack(r, "q_"), _unpack(r), State(r)
                got = scores(q, v)
                i, j = np.nonzero((got >= s.low[:, None]) & (qs[:, None] != ids[None, :]))
                score, vec = got[i, j], ids[j]
                tied = score == s.low[i]
                order = np.lexsort((vec, tied, i))
                i, score, vec, tied = i[order], score[order], vec[order], tied[order]
                nth = np.arange(len(i)) - np.searchsorted(i * 2 + tied, i * 2 + tied)
                keep = ~tied | (nth < k - s.above[i])
                cols = [pa.array(qs[i[keep]], pa.int64()), pa.array(vec[keep], pa.int64()), pa.array(score[keep], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])

    return run


def _round(pairs: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """One histogram round of all blocks."""
    counts = pairs.mapInArrow(_histograms, "block long, q long, bin long, n long").groupBy("block", "q", "bin").agg(F.sum("n").alias("n"))
    # At most BINS rows for each query of a block, which is bounded.
    counts = counts.groupBy("block").agg(F.collect_list(F.struct("q", "bin", "n")).alias("counts"))
    empty = F.expr("cast(array() as array<struct<q:bigint,bin:bigint,n:bigint>>)")
    state = state.join(counts, "block", "left").withColumn("counts", F.coalesce("counts", empty))
    return saved(state.mapInArrow(_narrowed(k), f"block long, {State.SCHEMA}"), "topk-state")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with the other rows.

    Queries are the rows whose vec_id is divisible by `every`.  Components count as
    floor(1024 x); vectors that are null or hold null, NaN or infinite components take no part,
    nor do rows without vec_id.  Vectors of different lengths are compared over the shorter one.  Ties go
    to the smaller vec_id.  With fewer than k other rows all are returned.  Repeated rows of a query
    count once as query (the smallest vector, if they differ) and each as candidate of others.
    Scores beyond the range of a long count as its ends.  Extra columns are ignored.
    """
    fine = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    chunks = saved(rows.mapInArrow(_chunks, PACKED + ", norm double"), "topk-chunks")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = saved(asked, "topk-asked")
    n = max(1, -(-asked.count() // BLOCK))
    blocks = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))
    blocks = saved(blocks.mapInArrow(_blocks, f"block long, {PACKED}, norms binary"), "topk-blocks")
    most = chunks.agg(F.max("norm")).first()[0] or 0.0
    state = saved(blocks.select("block", "norms").mapInArrow(_first(most), f"block long, {State.SCHEMA}"), "topk-state")
    sides = blocks.select("block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "kind", "dim", "vecs")])

    def pairs(now: DataFrame) -> DataFrame:
        # The stated query set against all rows, block by chunk; Spark broadcasts the blocks only while they are small.
        return chunks.drop("norm").crossJoin(sides.join(now, "block"))

    while not state.where("open").isEmpty():
        state = _round(pairs(state.where("open")), state, k)
    out = pairs(state).mapInArrow(_selected(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op8_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op8_histogram_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda t: t[1] * t[2])) as bigint) as score
      from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 10""",
}
