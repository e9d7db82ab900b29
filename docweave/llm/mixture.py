"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions.

Each source's words, its documents in a seeded order, form blocks of equal numbers of words.  The
blocks of the mix go to the sources by highest quotients w / (2 s + 1), then each source's to
its shards in the same way, so every quota is a whole number.  A shard gives its first blocks in
the seeded order, starting over once it is used up.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, saved, table

WORD = r"[^\x20\x09-\x0D]+"


def quotas(cells: DataFrame, weight: str, total: Column, by: list[str], order: list[str]) -> DataFrame:
    """Add `quota`: `total` seats among the rows of each group `by`, by Sainte-Lague.

    The multiplier that gives exactly n seats lies between those of n - m/2 and n + m/2 for m
    rows, so a row's seats differ from its exact share by at most share * m / 2 + 1.  Seats below
    that range are certain; those in it compete by quotient, ties going to the first in `order`.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = F.when(F.sum(weight).over(group) > 0, F.col(weight) / F.sum(weight).over(group)).otherwise(0.0)
    rows = cells.withColumn("seats", total.cast("long")).withColumn("share", share)
    rows = rows.withColumn("loose", F.ceil(F.col("share") * F.count("*").over(group) / 2) + 1)
    rows = rows.withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("seats") * F.col("share")) - F.col("loose")).cast("long"))
    rows = rows.withColumn("left", F.col("seats") - F.sum("sure").over(group))
    seats = rows.where("share > 0").withColumn("s", F.explode(F.sequence(F.col("sure"), F.col("sure") + 2 * F.col("loose") + 2)))
    best = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(F.col(weight) / (2 * F.col("s") + 1)), *order, "s")
    won = seats.withColumn("r", F.row_number().over(best)).where("r <= left").groupBy(*by, *order).agg(F.count("*").alias("won"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in dict.fromkeys([*by, *order])]
    on = same[0]
    for x in same[1:]:
        on = on & x
    out = rows.alias("c").join(won.alias("w"), on, "left")
    return out.select("c.*", (F.col("c.sure") + F.coalesce("w.won", F.lit(0))).alias("quota")).drop("seats", "share", "loose", "sure", "left")


def targets(sizes: DataFrame, portion: float, limit: float, weights: tuple[int, ...]) -> DataFrame:
    """Add k (order), weight and target to source, source_size (a row per source).

    Sources take `weights` in turn, by code point, null last.  They share `portion` of all words by
    weight; a target stops at `limit` times its source and the excess goes to the others by
    weight.  In order of limit / weight the full ones come first, so sums before a row tell
    whether it is full.
    """
    all_ = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("k", F.row_number().over(all_))
    rows = rows.withColumn("weight", F.expr(f"element_at(array({','.join(map(str, weights))}), cast((k - 1) % {len(weights)} + 1 as int))"))
    cap = F.col("source_size") * F.lit(float(limit))
    w = Window.orderBy(cap / F.col("weight"), "k")
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    goal = F.sum("source_size").over(whole) * F.lit(float(portion))
    level = (goal - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > cap)
    open_level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct(cap / F.col("weight"), "k"))).over(whole)
    target = F.when(F.col("full"), cap).otherwise(open_level * F.col("weight"))
    return rows.withColumn("target", target.cast("double")).drop("level", "full")


#: A block is a 64th of the smallest target, between one word and this many.
BLOCK, PARTS = 64, 64


def mix(docs: DataFrame, portion: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of docs.

    taken counts the words that the mix takes of the document, repeats counted; it is `limit` times
    its size at most.  Null and empty texts have size 0 and nothing taken; very long ones count whole.
    The seeded order is by sha256 of doc_id and text, so reruns agree; equal rows may stand for each
    other.  A source's taken words differ from its target by a few blocks at most, and a block is never more
    than a 64th of the smallest target, unless that is below 64 words: then it is one word.
    An empty table gives an empty one.  Extra columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)), 256).alias("order"),
    )
    rows = saved(rows, "mix-rows")
    return apportion(rows, portion, limit, weights, block).select("doc_id", "size", "source", "source_size", "target", "taken")


def apportion(rows: DataFrame, portion: float, limit: float, weights: tuple[int, ...], block: int) -> DataFrame:
    """`mix` of rows (doc_id, source, size, order)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(sizes, portion, limit, weights)
    # The mix has as many blocks as fill the targets; a source's shards have about 5,000 rows.
    every = Window.partitionBy(F.lit(0))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    fit = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(smallest / PARTS)))
    sources = sources.withColumn("block", F.coalesce(fit, F.lit(1)).cast("long"))
    blocks = F.round(F.sum("target").over(every) / F.col("block"))
    sources = quotas(sources, "target", blocks, [], ["k"]).withColumn("shards", F.ceil(F.col("n") / 5000).cast("long"))
    sources = saved(sources.withColumnRenamed("quota", "source_quota"), "mix-sources")
    # A row per source: a dimension, joined by broadcast only where Spark finds it small enough.
    named = rows.join(sources, rows.source.eqNullSafe(sources.source)).drop(sources.source)
    named = named.withColumn("shard", F.pmod(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), F.col("shards")))
    once = [F.first(c).alias(c) for c in ("source_quota", "source_size", "block")]
    cells = named.groupBy("k", "shard").agg(F.sum("size").alias("shard_size"), *once)
    cells = quotas(cells, "shard_size", F.col("source_quota"), ["k"], ["shard"])
    cells = saved(_within(cells, limit).select("k", "shard", "shard_size", "words"), "mix-cells")
    start = F.sum("size").over(Window.partitionBy("k", "shard").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = named.withColumn("start", F.coalesce(start, F.lit(0))).join(cells, ["k", "shard"])
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - rounds * F.col("shard_size") - F.col("start")))
    return placed.withColumn("taken", (rounds * F.col("size") + more).cast("long"))


def _within(cells: DataFrame, limit: float) -> DataFrame:
    """Add `words`: each shard's quota in words, `limit` times its size at most.

    What a full shard can't give goes to its source's other shards in their order, as far as they have room.
    """
    want, most = F.col("quota") * F.col("block"), F.floor(F.col("shard_size") * F.lit(float(limit))).cast("long")
    own, ahead = Window.partitionBy("k"), Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.withColumn("base", F.least(want, most)).withColumn("spare", most - F.least(want, most))
    over = F.sum(want - F.col("base")).over(own) - F.coalesce(F.sum("spare").over(ahead), F.lit(0))
    return rows.withColumn("words", F.col("base") + F.greatest(F.lit(0), F.least(F.col("spare"), over)))


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, portion: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """The documents of the mix, with the columns of docs: whole texts only.

    A document comes out as often as the words taken of it make whole texts, halves rounded up; so
    only the document in which a shard's quota ends differs from `mix`, by half its size at most.
    Documents without words have nothing to take and stay once, as they cost no quota.  Rows equal in
    doc_id, text and source are counted one by one, as `mix` takes them, and come out equally often or once more.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size, order, origin, base, rest, mark, o, s = fresh(docs, "size", "order", "origin", "base", "rest", "mark", "o", "s")
    work = docs.withColumns({
        size: F.regexp_count(text, F.lit(WORD)).cast("long"),
        order: F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)), 256),
        origin: F.col("source").cast("string"),
    })
    keys = work.select("doc_id", F.col(origin).alias("source"), F.col(size).alias("size"), F.col(order).alias("order"))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))))
    got = apportion(saved(keys, "mix-rows"), portion, limit, weights, block).groupBy("order", "source").agg(F.sum(times).alias("times"), F.count("*").alias("n"))
    got = got.select(F.col("order").alias(o), F.col("source").alias(s), F.expr("cast(times div n as int)").alias(base), F.expr("times % n").alias(rest))
    got = saved(got.where(f"{base} > 0 or {rest} > 0"), "mix-taken")
    same = (F.col(order) == F.col(o)) & F.col(origin).eqNullSafe(F.col(s))
    each = work.join(got, same).withColumn(mark, F.explode(F.array_repeat(F.lit(0), F.col(base)))).select(*docs.columns)
    odd = got.where(F.col(rest) > 0).select(o, s, rest)
    if odd.isEmpty():
        return each
    # Some of a document's equal rows come out once more than others: as many as `rest` says.
    rows = saved(work.join(odd, same).drop(o, s).withColumn(mark, F.monotonically_increasing_id()), "mix-repeats")
    return each.unionByName(_first(rows, [order, origin], mark, rest).select(*docs.columns))


#: Rows of one group are numbered in so many parts.
SPLIT = 64


def _first(rows: DataFrame, group: list[str], mark: str, most: str) -> DataFrame:
    """The first `most` rows of each group, in parts of `mark` and by `mark` in a part; rows have to be saved, as mark is compared."""
    part, before, nth, *on_right = fresh(rows, "part", "before", "nth", *(f"c{k}" for k in range(len(group) + 1)))
    rows = rows.withColumn(part, F.pmod(mark, F.lit(SPLIT)))
    counts = rows.groupBy(*group, part).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(r) for c, r in zip([*group, part], on_right, strict=True)), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(*group, part).orderBy(mark)))
    on = F.lit(True)
    for c, r in zip([*group, part], on_right, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(r))
    return rows.join(counts, on).where(F.col(nth) + F.col(before) <= F.col(most))
