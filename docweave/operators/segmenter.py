"""Words of a script that parts none, learned from the corpus: strings are counted in Spark, runs parted along the likeliest path.

No word list is needed.  A string is a word if it stands together more often than its parts would by chance, and if it is no
mere piece of one longer word.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import HAN

#: Longest words, how often a word has to stand, how much more often than by chance, and the share of its places from which on it is a piece of a longer one.
LONGEST, SEEN, COHESION, PIECE = 4, 5, 8.0, 0.9
#: Words that a model keeps at most, the most frequent ones; tasks hold them all.
SIZE = 500_000


def strings(docs: DataFrame, run: str = HAN, longest: int = LONGEST) -> DataFrame:
    """(word, n): how often each string of up to `longest` + 1 characters stands within the runs of docs(text).

    Equal runs are counted before they are cut up.  Null and empty texts hold none.
    """
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"(?:{run})+"), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    starts = F.sequence(F.lit(1), F.length("run"))
    cut = lambda m: F.transform(F.filter(starts, lambda i: i + (m - 1) <= F.length("run")), lambda i: F.substr("run", i, F.lit(m)))
    every = F.concat(*[cut(m) for m in range(1, longest + 2)])
    return runs.select(F.explode(every).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def learned(counts: DataFrame, longest: int = LONGEST, seen: int = SEEN, cohesion: float = COHESION, size: int = SIZE) -> DataFrame:
    """(word, n, cohesion, total): words of two and more characters among `strings`, and single characters, whose cohesion is null.

    cohesion is how many times more often the word stands than the likelier of its two parts would beside each other by chance, at the
    weakest place to part it.  total is the number of characters.  What is frequent has frequent parts, so all else goes first.
    Of more than `size` words the most frequent stay, ties by the word.
    """
    total = counts.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    often = counts.where((F.col("n") >= seen) | (F.length("word") == 1))
    n = lambda c: often.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    parted = often.where(F.length("word").between(2, longest)).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    parted = parted.select("word", "n", F.substr("word", F.lit(1), F.col("at")).alias("a"), F.substr("word", F.col("at") + 1).alias("b"))
    chance = F.col("n_a").cast("double") * F.col("n_b")
    held = parted.join(n("a"), "a").join(n("b"), "b").join(F.broadcast(total), how="cross").groupBy("word", "n", "total").agg(F.min(F.col("n").cast("double") * F.col("total") / chance).alias("cohesion"))
    longer = often.where(F.length("word") > 2)
    inside = longer.select(F.explode(F.array(F.expr("left(word, length(word) - 1)"), F.substr("word", F.lit(2)))).alias("word"), F.col("n").alias("n_longer")).groupBy("word").agg(F.max("n_longer").alias("n_longer"))
    held = held.where(F.col("cohesion") >= cohesion).join(inside, "word", "left").where(F.coalesce(F.col("n_longer") < PIECE * F.col("n"), F.lit(True)))
    single = often.where(F.length("word") == 1).join(F.broadcast(total), how="cross").select("word", "n", F.lit(None).cast("double").alias("cohesion"), "total")
    return held.select("word", "n", "cohesion", "total").union(single).orderBy(F.desc("n"), "word").limit(size)


def best_path(run: str, weight: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The words that a run is made of with the largest sum of weights; of equal sums the one whose last words are longer.

    Characters that are no word weigh `unknown`.
    """
    score, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        found = -math.inf
        for m in range(1, min(longest, end) + 1):
            w = weight.get(run[end - m : end], unknown if m == 1 else -math.inf) + score[end - m]
            if w >= found and w > -math.inf:
                found, best = w, m
        score.append(found)
        back.append(best)
    out, end = [], len(run)
    while end:
        out.append(run[end - back[end] : end])
        end -= back[end]
    return out[::-1]


def splitter(words: DataFrame, run: str = HAN) -> Callable[[Column], Column]:
    """A `split` for searches from a table of `learned`: runs along their best path, other words as they are; null for null.

    Its name is that of its words, so an index built with other words refuses it.
    """
    rows = sorted(tuple(r) for r in words.select("word", "n", "total").limit(SIZE + 1).collect())
    if len(rows) > SIZE:
        raise ValueError(f"more than {SIZE} words")
    total = rows[0][2] if rows else 1
    given = words.sparkSession.sparkContext.broadcast({w: math.log(n / total) for w, n, _ in rows})
    longest, unknown = max((len(w) for w, _, _ in rows), default=1), math.log(0.5 / total)

    @F.pandas_udf("array<string>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pattern = regex.compile(rf"(?P<run>(?:{run})+)|(?:(?!{run})[^\x20\x09-\x0D])+")
        weight = given.value
        one = lambda text: None if text is None else [w for m in pattern.finditer(text) for w in (best_path(m[0], weight, longest, unknown) if m["run"] else [m[0]])]
        for batch in batches:
            yield batch.map(one, na_action=None)

    def split(text: Column) -> Column:
        return parts(text)

    split.__name__ = f"learned_{zlib.crc32(repr(rows).encode()):08x}"
    return split
