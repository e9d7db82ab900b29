"""MinHash fingerprints of whole texts and near-duplicate classes by signature bands.

A fingerprint holds, for each of several universal hash permutations of 32-bit numbers, the smallest value
over the text's shingles (five words).  The share of equal entries estimates the Jaccard
similarity of two shingle sets.

Bands of a fingerprint are keys on which Spark joins documents.  Candidates pass a bound on their parity
sketches that no link exceeds, then whole texts are compared.  With 32 bands of four entries a pair of
Jaccard 0.8 shares a band but for 5 in 100 million; large groups of one band are compared in tiles.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram_join
from .common import U64, lean, met, mix, passing, saved, shingles, slices, table, totals, u32_sum_hash, words

SIZE = 5


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(odd factors, offsets) of x -> a x + b modulo 2**32, each a bijection."""
    r = mix(np.arange(2 * count, dtype=U64), seed)
    return (r[:count] >> U64(32)).astype(np.uint32) | np.uint32(1), (r[count:] >> U64(32)).astype(np.uint32)


def signatures(data: np.ndarray, offsets: np.ndarray, count: int = 128, seed: int = 1, size: int = SIZE) -> np.ndarray:
    """(documents, count) smallest permuted values; all ones for a text without words."""
    return smallest(*shingles(words(data, offsets), size), count, seed)


def smallest(h: np.ndarray, bounds: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """The same of shingles' hashes h[bounds[d]:bounds[d + 1]]."""
    x = u32_sum_hash(mix(h, 21))
    out = np.empty((len(bounds) - 1, count), np.uint32)
    room = np.empty_like(x)
    for k, (a, b) in enumerate(zip(*permutations(count, seed), strict=True)):
        np.multiply(x, a, out=room)
        np.add(room, b, out=room)
        out[:, k] = totals(room, bounds, np.minimum, np.uint32(0xFFFFFFFF))
    return out


def _hex(sig: np.ndarray) -> list[str]:
    raw = sig.astype(">u4").tobytes().hex()
    step = 8 * sig.shape[1]
    return [raw[k : k + step] for k in range(0, len(raw), step)]


def _texts_signatures(texts: list[bytes], count: int) -> np.ndarray:
    """In slices that keep the work arrays small."""
    out, k = [], 0
    while k < len(texts):
        j, n = k, 0
        while j < len(texts) and (j == k or n + len(texts[j]) <= 1 << 20):
            n += len(texts[j])
            j += 1
        offs = np.append(0, np.cumsum([len(t) for t in texts[k:j]]))
        out.append(signatures(np.frombuffer(b"".join(texts[k:j]), np.uint8), offs, count))
        k = j
    return np.concatenate(out)


SCHEMA = "doc_id long, own long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(count: int):
    """Rows come in the order of their documents; the row after a run's last is marked as its end."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def emit(rows):
        """rows: (doc_id, text, bucket, end mark, own); each but the last is compared with the next."""
        own = _texts_signatures([r[1].encode() for r in rows], count)
        heads = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
        if not heads:
            return None
        edited = []
        for i in heads:
            text, after = rows[i][1], rows[i + 1][1]
            q = len(text) // 4
            edited.append((text[: len(text) - q] + after[:q]).encode())
        sig = _texts_signatures(edited, count)
        mine, following = own[heads], own[[i + 1 for i in heads]]
        cols = [
            pa.array([rows[i][0] for i in heads], pa.int64()), pa.array([rows[i][4] for i in heads], pa.int64()), pa.array([len(rows[i][1]) for i in heads], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(_hex(mine)), pa.array(_hex(sig)),
            pa.array((mine == sig).mean(1)), pa.array((mine == following).mean(1)),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            cols = (batch.column(c) for c in ("doc_id", "text", "bucket", "tail", "own"))
            for doc, text, bucket, tail, own in zip(*cols, strict=True):
                text = text.as_py() or ""
                rows.append((doc.as_py(), text, bucket.as_py(), tail.as_py(), own.as_py()))
                size += len(text)
                if size >= 1 << 22:
                    if (out := emit(rows)) is not None:
                        yield out
                    rows, size = rows[-1:], len(rows[-1][1])
        if len(rows) > 1 and (out := emit(rows)) is not None:
            yield out

    return run


#: Stands for a null doc_id in the order of documents.
FIRST = "cast(-9223372036854775808 as bigint)"


def fingerprints(docs: DataFrame, count: int = 128) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness (see SCHEMA).

    The edited text takes its last quarter from the start of the next document (ascending doc_id, null
    first, then text; after the last comes the first).  Null texts count as empty; a text without
    words is like another such text (1) and like no other (0).  A single document is its own
    next.  Rows that repeat come out as often and follow each other; very long texts are read whole.  `own` is one for
    rows equal in id and text.  An empty table gives an empty one.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("own"))
    rows = rows.select(F.expr(f"coalesce(id, {FIRST})").alias("doc_id"), "id", "text", "own")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Documents meet in ranges of doc_id; a range gets the first document of the next one as well.
    # There are 8 ranges a partition: the lists below are as long as that, whatever the data.
    # percentile_approx keeps a summary of fixed accuracy, so ranges are even but not exact.
    steps = ",".join(str(i / (8 * n)) for i in range(1, 8 * n))
    ends = rows.select(F.expr(f"percentile_approx(doc_id, array({steps}), {100 * n})")).first()[0]
    if ends is None:
        return spark.createDataFrame([], SCHEMA)
    ends = sorted(set(ends))
    lists = f"array({','.join(f'{e}L' for e in ends)})"
    # The number of range ends that are below doc_id, by bisection in SQL functions.
    steps = max(1, len(ends).bit_length())
    low = f"aggregate(sequence(1, {steps}), named_struct('a', 0, 'b', {len(ends)}), (s, i) -> case when s.a >= s.b then s when element_at({lists}, (s.a + s.b) div 2 + 1 ) < doc_id then named_struct('a', cast((s.a + s.b) div 2 + 1 as int), 'b', s.b) else named_struct('a', s.a, 'b', cast((s.a + s.b) div 2 as int)) end).a"
    low = low.replace("(s.a + s.b) div 2 + 1 ) <", "cast((s.a + s.b) div 2 + 1 as int)) <")
    rows = rows.withColumn("bucket", F.expr(low))
    firsts = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.min("doc_id")).collect())
    heads = [d for _, d in firsts]
    after = dict(zip([b for b, _ in firsts], heads[1:] + heads[:1], strict=True))
    turn = {d: b for b, d in after.items()}  # the first document of a range ends the range before
    ends_of = rows.where(F.col("doc_id").isin(heads)).groupBy("doc_id").agg(F.min("text").alias("text"))
    pairs = "map(" + ",".join(f"{d}L,{b}" for d, b in turn.items()) + ")"
    ends_of = ends_of.withColumn("bucket", F.expr(f"element_at({pairs}, doc_id)")).withColumn("tail", F.lit(True))
    ends_of = ends_of.withColumn("own", F.lit(None).cast("long"))
    every = rows.drop("id").withColumn("tail", F.lit(False)).unionByName(ends_of.select("doc_id", "text", "own", "bucket", "tail"))
    sorted_ = every.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")
    out = sorted_.mapInArrow(lean(_compare(count)), SCHEMA)
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {FIRST})"))


def _band_keys(count: int, bands: int):
    """Signatures for `ngram_join` whose keys are the bands of MinHash signatures."""

    def made(size, percent, lower):
        def keys(h, bounds, n, own, low):
            sig = smallest(h, bounds, count)
            out = np.zeros((len(n), bands), U64)
            for k in range(bands):
                for c in range(k * count // bands, (k + 1) * count // bands):
                    out[:, k] = mix(out[:, k] ^ sig[:, c].astype(U64), k + 1)
            full = n > 0
            none = np.zeros(0, U64), np.zeros(len(n) + 1, np.int64)
            return (out[full].ravel(), np.append(0, np.cumsum(full * bands))), none

        def run(batches):
            for batch in batches:
                yield from ngram_join.signed(batch, size, percent, lower, keys)

        return run

    return made


def near_duplicates(docs: DataFrame, percent: int = 80, count: int = 128, bands: int = 32) -> DataFrame:
    """(own, component_id): of the distinct rows that are linked with other texts or ids, the smallest doc_id of their class.

    Documents are linked that share a band and whose shingle sets have Jaccard percent/100 or more, verified
    on whole texts; classes are what links join.  own is xxhash64 of doc_id and text.  Rows that are not in the
    table, as those without words, are linked with nothing and stand for themselves.
    """
    with passing(docs.sparkSession):
        with passing(docs.sparkSession):
            sig, named = ngram_join._classes(docs, SIZE, percent, False, _band_keys(count, bands))
        rows = sig.where("n > 0").select("doc_id", "own", "h1", "h2", "n").distinct().join(named.select("h1", "h2", "n", "least"), ["h1", "h2", "n"])
        linked = rows.where("least < doc_id or doc_id is null").groupBy("own").agg(F.min("least").alias("component_id"))
        return saved(linked, "linked", keep=True)


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses, and component_id, the smallest doc_id of the document's near-duplicate class."""
    docs = table(spark, sf_dir, "documents")
    linked = near_duplicates(docs)
    out = met(fingerprints(docs), linked, "own", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id")).drop("own")
