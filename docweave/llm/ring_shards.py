"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions.

Texts hash to the cells of a ring; each virtual node owns the arc of cells up to its own, and its
shard.  A shard takes the keys of its arcs until it is full; the rest of an arc continues
clockwise to the next virtual node whose shard has room.  Which part of an arc goes where
depends on the arcs' row counts alone, a table as small as the ring, so only ranks inside
arcs remain to be found.  Equal texts share an arc, and so a shard unless it overflows there.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

CELLS = 4096


def ring(shards: int, nodes: int, seed: int) -> tuple[list[int], list[int]]:
    """(arc of every cell, shard of every arc); the arcs are in clockwise order."""
    owner: dict[int, int] = {}
    for v in range(nodes):
        for s in range(shards):
            cell = int.from_bytes(hashlib.sha256(f"{seed}:{s}:{v}".encode()).digest()[:8], "big") % CELLS
            while cell in owner:
                cell = (cell + 1) % CELLS
            owner[cell] = s
    places = sorted(owner)
    arcs, k = [], 0
    for cell in range(CELLS):
        while k < len(places) and places[k] < cell:
            k += 1
        arcs.append(k % len(places))
    return arcs, [owner[p] for p in places]


def place(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where each part of each arc goes."""
    room, slot, out = list(room), [0] * len(room), []
    waiting = [(arc, 0, n, arc) for arc, n in enumerate(counts) if n]
    while waiting:
        later = []
        for arc, lo, hi, node in waiting:
            s = owners[node]
            n = min(hi - lo, room[s])
            if n:
                out.append((arc, lo, lo + n, s, slot[s]))
                room[s] -= n
                slot[s] += n
            if lo + n < hi:
                later.append((arc, lo + n, hi, (node + 1) % len(owners)))
        waiting = later
    return out


def shard_rows(docs: DataFrame, shards: int = 8, nodes: int = 64, seed: int = 7, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    A shard holds at most (1 + slack) times its even share of the rows; with slack 0 the row
    counts differ by one at most.  Null texts count as empty (size 1, crc32 0).  Ties between
    equal rows are broken arbitrarily, as such rows can't be told apart.  Slots of a shard run from
    0 without gaps.  Very long texts count whole; rows without doc_id are placed by their text; rows that
    repeat are placed one by one.  Extra columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    arcs, owners = ring(shards, nodes, seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = docs.count()
    # Ranks are counted in parts of an arc, so that one text in many rows is spread out.
    parts = max(1, -(-n // 10_000))
    cell = F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        cell.alias("cell"),
        F.xxhash64(text, "doc_id").alias("order"),
    )
    rows = rows.withColumn("arc", F.expr(f"element_at(array({','.join(map(str, arcs))}), cell + 1)"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts))).drop("cell")
    rows = saved(rows, "ring-rows")
    counts = saved(rows.groupBy("arc", "part").count(), "ring-counts")
    per_arc = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    share = n / shards
    room = [int(share * (1 + slack)) if slack else n // shards + (s < n % shards) for s in range(shards)]
    if sum(room) < n:
        room = [n // shards + (s < n % shards) for s in range(shards)]
    moves = place([per_arc.get(a, 0) for a in range(len(owners))], owners, room)
    moves = spark.createDataFrame(moves or [(-1, 0, 0, 0, 0)], "arc int, lo long, hi long, shard int, slot0 long")
    ahead = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("arc", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("arc", "part").orderBy("order", "doc_id")) - 1
    ranked = rows.withColumn("inside", inside).join(counts, ["arc", "part"]).withColumn("rank", F.col("ahead") + F.col("inside"))
    # moves has as many rows as the ring has virtual nodes, plus a few for each shard.
    out = ranked.join(F.broadcast(moves), (ranked.arc == moves.arc) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def op6_ring_bounded_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
