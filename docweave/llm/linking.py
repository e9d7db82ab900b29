"""Links between documents: from shared keys to verified links to classes.

A class is a connected component of links.  A group of documents that share a key is tied
together through one hub instead of all its pairs; what the hubs leave apart is compared
exactly (see `ngram_join`).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, distinct, lean, saved, shingles, slices, words


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges(a, b); comp is the smallest node it reaches.

    Labels spread along edges and then jump to their label's label, so the number of rounds
    grows with the logarithm of the longest path.  Nothing is collected but a count.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.where("a <> b").distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp"))
    labels = saved(labels.withColumn("changed", F.lit(True)), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        step = step.join(jump, "mid", "left").select("node", F.coalesce(F.least("far", "mid"), F.col("mid")).alias("comp"), "old")
        labels = saved(step.select("node", "comp", (F.col("comp") != F.col("old")).alias("changed")), "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", "comp")


def _overlap(size: int, lower: bool):
    def run(batches):
        for batch in cut(batches, 256):
            sets = []
            for side in ("text_a", "text_b"):
                got = []
                for i, j, data, offs in slices(batch.column(side)):
                    h, b = distinct(*shingles(words(data, offs, lower), size))
                    got += [h[b[k] : b[k + 1]] for k in range(j - i)]
                sets.append(got)
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
            union = [len(x) + len(y) - n for x, y, n in zip(*sets, both, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(union, pa.int64())],
                ["a", "b", "n_both", "n_union"],
            )

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, lower: bool) -> DataFrame:
    """Those pairs(a, b) whose shingle sets have 100 * intersection >= percent * union.

    texts(node, text) holds each node once.  Both texts are met by shuffle joins; whole texts
    are read again and their sets compared, shingle by shingle as 64-bit hashes.
    """
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    out = both.mapInArrow(lean(_overlap(size, lower)), "a long, b long, n_both long, n_union long")
    return out.where(F.col("n_both") * 100 >= F.col("n_union") * percent)


#: Groups of up to so many nodes are paired in Spark; larger ones are compared in tiles.
SMALL = 24


def central(members: DataFrame) -> DataFrame:
    """Add `hub` to members(key, node, m), m the size of the key's group.

    The hub is the node of the group that shares keys with most others, so in a group of edited
    copies it tends to be the original, which most copies are linked with.
    """
    weight = members.groupBy("node").agg(F.sum("m").alias("w"))
    best = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", (-F.col("node")).alias("x"))).alias("h"))
    return members.join(best.select("key", (-F.col("h.x")).alias("hub")), "key")


def dealt(groups: DataFrame, tiles: DataFrame) -> DataFrame:
    """(key, node, comp, own, tile, other): each of groups(key, node, comp) in the cells where its tile meets another.

    tiles(key, n_tiles) tells in how many tiles a group is cut; every two tiles of a group meet in one cell.
    """
    rows = groups.join(tiles, "key").withColumn("own", F.pmod(F.xxhash64("node"), "n_tiles").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    return rows.select("key", "node", "comp", "own", F.least("own", "with").alias("tile"), F.greatest("own", "with").alias("other"))


def classes(members: DataFrame, likely, texts, size: int, percent: int, lower: bool, tiles=None) -> DataFrame:
    """(node, comp) of the classes among nodes that share keys, each link verified.

    members(key, node, m, hub) are as `central` gives them.  likely(pairs) drops pairs(a, b) that
    cannot be linked; texts(nodes) gives (node, text) of nodes(node).  tiles(groups) gives the likely
    pairs within each key of groups(key, node, comp) without a row for each pair.

    First every member is compared with its hub.  Keys whose members then lie in several
    components still may hide links, so their members of different components are compared
    with each other, all of them; members of one component need no comparison.
    """
    hubs = members.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    tried = saved(likely(hubs), "pairs")
    links = saved(_links(tried, texts, size, percent, lower), "links")
    comp = components(links)
    known = members.select("key", "node", "m").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = saved(known, "known")
    split = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = saved(known.join(saved(split, "split"), "key"), "open")
    few = open_.where(F.col("m") <= SMALL) if tiles else open_
    left = few.select("key", F.col("node").alias("a"), F.col("comp").alias("ca"))
    right = few.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"))
    rest = left.join(right, "key").where("ca <> cb and a < b").select("a", "b").distinct()
    rest = likely(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    if tiles:
        many = open_.where(F.col("m") > SMALL).select("key", "node", "comp")
        rest = rest.union(tiles(many).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")).distinct()
    rest = saved(rest, "rest")
    more = saved(_links(rest, texts, size, percent, lower), "links")
    return comp if more.isEmpty() else components(links.select("a", "b").union(more.select("a", "b")))


def _links(pairs: DataFrame, texts, size: int, percent: int, lower: bool) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    return verified(pairs, saved(texts(nodes), "texts"), size, percent, lower)
