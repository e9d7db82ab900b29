"""Similar cases for many queries: recall by shared articles or by search, then a weighted score.

Cases and queries are tables of their article keys, so recall is a join on keys and never a comparison of all with all.  Keys stand
in one order, the rare ones first, and a bound on the similarity says how far down the order a pair may meet first.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import case_type_form, parent_word
from docweave.sources.shared import written

from .retrieval import top

#: What a procedural article counts, and what articles, case type and search count in all.
PROCEDURAL, W_ARTICLES, W_TYPE, W_SEARCH = 0.2, 0.6, 0.15, 0.25
#: Half a unit of the last place that similarities are rounded to, and a little for sums of doubles.
SLACK = 0.00005 + 1e-9
#: How many of the lightest cases of a key are compared first, for each case that is asked for.
SEEDS = 2
#: Rows of a case and a key that a task takes; tasks are made for their number, so that none holds more as tables grow.
ROWS = 200_000


def tasks(rows: DataFrame) -> int:
    """How many tasks the rows of a table of keys are dealt to."""
    return max(1, -(-rows.count() // ROWS))


def query_keys(recommended: DataFrame, parsed: DataFrame) -> DataFrame:
    """(query_id, key): recommended keys, for queries without any the keys parsed from their text."""
    rest = parsed.join(recommended.select("query_id").distinct(), "query_id", "left_anti")
    return recommended.select("query_id", "key").union(rest.select("query_id", "key")).distinct()


def weighted(keys: DataFrame, procedural: Column) -> DataFrame:
    """Distinct rows with w: what each key counts."""
    return keys.distinct().withColumn("w", F.when(procedural, PROCEDURAL).otherwise(1.0))


def type_score(a: Column, b: Column) -> Column:
    """1 for one case type, 0.9 for two spellings, 0.6 for two of one parent law, else 0."""
    some = (a != "") & (b != "")
    score = F.when(~F.coalesce(some, F.lit(False)), 0.0).when(a == b, 1.0).when(case_type_form(a) == case_type_form(b), 0.9)
    return score.when(parent_word(a) == parent_word(b), 0.6).otherwise(0.0)


def profiles(keys: DataFrame, key: str, found: DataFrame, n: int = 1) -> DataFrame:
    """(key, full, light, weight): the keys of each query or case that count in full and the others, in one order for all tables.

    keys as `weighted` gives them, found(key, df) in how many cases each key is, n the tasks.  Keys that few cases have come first; those that no
    case has before them.
    """
    order = F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("key"))
    some = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, order))), lambda x: x["key"])
    full = F.col("w") == 1.0
    return keys.repartition(n, "key").join(found, "key", "left").repartition(n, key).groupBy(key).agg(some(full).alias("full"), some(~full).alias("light"), F.sum("w").alias("weight"))


def prefixes(profiles: DataFrame) -> DataFrame:
    """profiles' other columns, one row for each key that counts in full, with rest: what it and the keys behind it weigh.

    Keys that count less stand behind all others and make no row, so they bring no pair together.
    """
    others = [c for c in profiles.columns if c not in ("full", "light")]
    rest = F.size("full") - F.col("at") + PROCEDURAL * F.size("light")
    return profiles.select("*", F.posexplode("full").alias("at", "key")).select(*others, "key", rest.alias("rest"))


def candidates(asked: DataFrame, cases: DataFrame, bounds: DataFrame, kinds: Column) -> DataFrame:
    """(query_id, doc_id) of all pairs that share a key that counts in full and may reach the query's bound without a search's help.

    asked and cases are profiles with kind_a and kind_b, bounds(query_id, bound) the similarity that a pair has to reach; queries without
    one look at all such pairs.  What a pair has in common weighs no more than what is left of either side from its first common key
    on, so keys far down the order, which many cases have, join nothing where the bound asks for more.  A pair is compared at
    each key; at its first common one the test holds if it can reach the bound.
    """
    least = F.coalesce("bound", F.lit(-1.0))
    mine = prefixes(asked.join(bounds, "query_id", "left")).withColumnsRenamed({"weight": "wa", "rest": "rest_a"})
    # What the articles have to give if the types agree; a case that weighs as little as possible weighs what is common.
    mine = mine.where(F.col("rest_a") >= (least - SLACK - W_TYPE) / W_ARTICLES * F.col("wa") - 1e-9)
    yours = prefixes(cases).withColumnsRenamed({"weight": "wb", "rest": "rest_b"})
    both = mine.join(yours, "key")
    common = F.least("rest_a", "rest_b")
    articles = common / (F.col("wa") + F.col("wb") - common)
    both = both.where(W_ARTICLES * articles + W_TYPE >= least - SLACK)
    return both.where(W_ARTICLES * articles + W_TYPE * kinds >= least - SLACK).select("query_id", "doc_id").distinct()


def compared(pairs: DataFrame, asked: DataFrame, cases: DataFrame, kinds: Column) -> DataFrame:
    """pairs(query_id, doc_id, search) with similarity, articles, type and shared, from the profiles of both."""
    rows = pairs.join(asked.withColumnsRenamed({"full": "full_a", "light": "light_a", "weight": "wa"}), "query_id")
    rows = rows.join(cases.withColumnsRenamed({"full": "full_b", "light": "light_b", "weight": "wb"}), "doc_id")
    both = lambda n: F.coalesce(F.array_intersect(f"{n}_a", f"{n}_b"), F.array().cast(asked.schema[n].dataType))
    rows = rows.withColumn("shared", F.array_sort(both("full")))
    common = F.size("shared") + PROCEDURAL * F.size(both("light"))
    rows = rows.withColumn("articles", F.coalesce(F.try_divide(common, F.col("wa") + F.col("wb") - common), F.lit(0.0))).withColumn("type", kinds)
    total = F.round(W_ARTICLES * F.col("articles") + W_TYPE * F.col("type") + W_SEARCH * F.col("search"), 4)
    return rows.withColumn("similarity", total).select("query_id", "doc_id", "similarity", "articles", "type", "search", "shared")


def similar(asked: DataFrame, cases: DataFrame, pool: DataFrame, kinds: Column | None, queries: DataFrame, docs: DataFrame, k: int = 5, allowed: Column | None = None) -> DataFrame:
    """(query_id, doc_id, similarity, articles, type, search, shared, rank): the k cases nearest to each query.

    asked and cases as `weighted` gives them; pool(query_id, doc_id, score) is what a search found.  A case is
    looked at if it shares a substantive key with the query or is in the pool.  queries(query_id, kind) and
    docs(doc_id, kind) have the case types; kinds scores kind_a and kind_b from 0 to 1, `type_score` by default.  Pairs that are not
    allowed are left out, as a query that is itself a case.

    First the pool and, for each key of a query, the lightest cases that have it are compared.  The k-th best of them is
    a bound that a pair has to reach; only pairs that can are made (`candidates`), all of them if fewer than k were found.
    """
    kinds = F.coalesce(kinds if kinds is not None else type_score(F.col("kind_a"), F.col("kind_b")), F.lit(0.0))
    permitted = (lambda df: df) if allowed is None else (lambda df: df.where(allowed))
    n = tasks(cases)
    known = cases.groupBy("key").agg(F.count("*").alias("df"))
    mine = queries.select("query_id", F.col("kind").alias("kind_a")).join(profiles(asked, "query_id", known, tasks(asked)), "query_id", "left")
    mine = written(mine, "asked")
    yours = written(docs.select("doc_id", F.col("kind").alias("kind_b")).join(profiles(cases, "doc_id", known, n), "doc_id", "left"), "profiles")
    lightest = Window.partitionBy("key").orderBy("weight", "doc_id")
    few = prefixes(yours).repartition(n, "key").withColumn("place", F.row_number().over(lightest)).where(F.col("place") <= SEEDS * k)
    seeds = prefixes(mine).select("query_id", "key").join(few.select("key", "doc_id"), "key").select("query_id", "doc_id")
    pool = pool.select("query_id", "doc_id", F.col("score").alias("search"))
    begun = permitted(seeds.distinct().join(pool, ["query_id", "doc_id"], "full").withColumn("search", F.coalesce("search", F.lit(0.0))))
    begun = written(compared(begun, mine, yours, kinds), "compared")
    kth = top(begun, ["query_id"], "similarity", "doc_id", k).where(F.col("rank") == k).select("query_id", F.col("similarity").alias("bound"))
    more = permitted(candidates(mine, yours, kth, kinds)).join(begun.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    rows = begun.unionByName(compared(more.withColumn("search", F.lit(0.0)), mine, yours, kinds))
    best = top(rows, ["query_id"], "similarity", "doc_id", k)
    parts = [F.round(c, 3).alias(c) for c in ("articles", "type", "search")]
    return best.select("query_id", "doc_id", "similarity", *parts, F.col("shared").cast("array<string>").alias("shared"), "rank")


def distribution(found: DataFrame) -> DataFrame:
    """(query_id, result, count, ratio, place): results of similar cases(query_id, result), the most common first.

    Cases without a result are left out; ties go to the smaller result.
    """
    n = found.where("result is not null and result <> ''").groupBy("query_id", "result").agg(F.count("*").alias("count"))
    of = Window.partitionBy("query_id")
    return n.withColumn("ratio", F.round(F.col("count") / F.sum("count").over(of), 2)).withColumn("total", F.sum("count").over(of)).withColumn("place", F.row_number().over(of.orderBy(F.desc("count"), "result")))


def modal(found: DataFrame) -> DataFrame:
    """(query_id, result, ratio, total) of the most common result of each query."""
    return distribution(found).where("place = 1").select("query_id", "result", "ratio", "total")
