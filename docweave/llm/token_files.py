"""Token ids in files of fixed-width bit-packed blocks.

A file set has one shard per range of doc_id, in ascending order.  A row of its Parquet files is a
block: whole documents of one shard, ids packed at the fewest bits the vocabulary needs, and
where each document starts in it.  As the width is fixed, id i lies at bit i * width, so any
range of ids is unpacked without the rest; doc_lo and doc_hi let Parquet skip blocks by document.
Parquet holds the blocks because Spark's writer then commits each once, on any file system.
"""
from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, slices, table
from .pieces import PieceMemory, supported

#: A block is closed once it has so many ids; a longer document has a block of its own.
BLOCK_IDS = 1 << 16
SCHEMA = "shard int, block int, start long, n_ids long, width int, doc_lo long, doc_hi long, doc_ids array<long>, doc_at array<long>, payload binary"


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids as consecutive little-endian bit fields of `width` bits."""
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(payload: bytes, width: int, first: int, last: int) -> np.ndarray:
    """ids first to last - 1 of a block, reading no other bytes."""
    a, b = first * width, last * width
    data = np.frombuffer(payload, np.uint8)[a // 8 : (b + 7) // 8]
    bits = np.unpackbits(data, bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, width)
    full = np.zeros((len(bits), 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


@lru_cache(2)
def _memory(path: str) -> tuple[PieceMemory, int]:
    import json
    import os

    supported(json.load(open(path, encoding="utf-8")))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def new(data, bounds):
        raw, at = data.tobytes(), bounds.tolist()
        texts = [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]
        got = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(sizes.sum()))
        return flat, np.append(0, np.cumsum(sizes))

    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    return PieceMemory(new, added), max(tokenizer.get_vocab_size() - 1, 1).bit_length()


def write(docs: DataFrame, vocabulary: str, end_id: int | None = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the table of blocks.

    Null and empty texts have no ids but end_id.  Rows that repeat are written as often, equal ids
    in the order of their texts; a null doc_id comes first.  A very long text has a block of its own.  An
    empty table gives no blocks.  Other columns are ignored.
    """

    def run(batches):
        memory, width = _memory(vocabulary)
        shard = TaskContext.get().partitionId()
        state = {"block": 0, "start": 0}
        docs_, at, parts = [], [0], []

        def block():
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            known = [d for d in docs_ if d is not None]
            row = [shard, state["block"], state["start"], len(ids), width, min(known, default=None), max(known, default=None), list(docs_), list(at), pack(ids, width)]
            state["block"] += 1
            state["start"] += len(ids)
            docs_.clear(), parts.clear()
            at[:] = [0]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES, strict=True)], NAMES)

        for batch in batches:
            for i, j, data, offs in slices(batch.column("text"), 1 << 21):
                flat, ends = memory.encode(data, offs)
                for k, doc in enumerate(batch.column("doc_id").slice(i, j - i).to_pylist()):
                    ids = flat[ends[k] : ends[k + 1]]
                    if at[-1] and at[-1] + len(ids) > block_ids:
                        yield block()
                    parts.append(ids if end_id is None else np.append(ids, np.uint32(end_id)))
                    docs_.append(doc)
                    at.append(at[-1] + len(parts[-1]))
        if docs_:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return saved(rows.mapInArrow(run, SCHEMA), "token-files")


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[c.split()[1]] for c in SCHEMA.split(", ")]


def index(blocks: DataFrame) -> DataFrame:
    """Read every block back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The offsets of shards are sums over one row per shard, so their table is as small as the
    number of files.
    """
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"], r["width"], 0, r["n_ids"])
                at = r["doc_at"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                at = np.array(at, np.int64)
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(at[:-1] + r["start"] + r["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    need = ["shard", "start", "n_ids", "width", "doc_ids", "doc_at", "payload"]
    rows = blocks.select(*need).join(F.broadcast(bases), "shard")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents: other blocks are skipped, other ids aren't unpacked."""
    wanted = sorted(set(doc_ids))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                for k, d in enumerate(r["doc_ids"]):
                    if d in wanted:
                        ids = unpack(r["payload"], r["width"], r["doc_at"][k], r["doc_at"][k + 1])
                        yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    near = F.lit(False)
    for d in wanted:
        near = near | ((F.col("doc_lo") <= d) & (F.col("doc_hi") >= d))
    return blocks.where(near).select("width", "doc_ids", "doc_at", "payload").mapInArrow(run, "doc_id long, ids array<long>")


def op3_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return index(write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
