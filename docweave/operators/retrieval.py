"""Lexical and vector scores, their scaling and fusion, for many queries at once."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.sources.shared import written

from . import blocked

TOKEN = r"[^\x20\x09-\x0D]+"
#: Characters that are tokens in pairs, as nothing parts words there.
HAN = r"[㐀-䶿一-鿿]"


def words(text: Column, lower: bool = False) -> Column:
    """The words of a text in order, as they are."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN), F.lit(0))


def mixed_words(text: Column) -> Column:
    """Words of other scripts as they are, Chinese runs as pairs of characters (one alone as itself)."""
    runs = F.regexp_extract_all(text, F.lit(rf"{HAN}+|[^㐀-䶿一-鿿\x20\x09-\x0D]+"), F.lit(0))
    pairs = lambda r: F.when(r.rlike(rf"^{HAN}{{2,}}$"), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r))
    return F.flatten(F.transform(runs, pairs))


def tokens(docs: DataFrame, key: str, split=words) -> DataFrame:
    """(key, term) for every word."""
    return docs.select(F.col(key), F.explode(split(F.col("text"))).alias("term"))


def statistics(docs: DataFrame, split=words) -> tuple[DataFrame, DataFrame]:
    """Two small tables: terms(term, df) and totals(n, avgdl, n_terms, mean_idf) in one row.

    df adds up in the tasks before the shuffle, so what moves is a vocabulary for each task, not the words.
    """
    # Words are counted without being made, where a pattern tells them.
    length = F.regexp_count("text", F.lit(TOKEN)) if split is words else F.size(split(F.col("text")))
    ends = docs.agg(F.count("*").alias("n"), F.try_divide(F.coalesce(F.sum(length), F.lit(0)), F.count("*")).alias("avgdl"))
    terms = docs.select(F.explode(F.array_distinct(split(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = terms.join(F.broadcast(ends), how="cross").agg(F.count("*").alias("n_terms"), F.avg(idf).alias("mean_idf"))
    return terms, ends.join(F.broadcast(mean), how="cross")


def bm25(docs: DataFrame, queries: DataFrame, known: tuple[DataFrame, DataFrame] | None = None, key: str = "doc_id", split=words, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(query_id, key, score): Okapi BM25 of the documents that have a word of a query.

    docs(key, text), queries(query_id, text).  A word that a query repeats counts as often.  A word that
    most documents have takes `floor` times the mean idf instead of a negative one.  Only the queries'
    words leave a task.
    """
    terms, totals = known or statistics(docs, split)
    asked = tokens(queries, "query_id", split).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    vocabulary = asked.select("term").distinct()
    sized = docs.select(key, split(F.col("text")).alias("w")).select(key, F.size("w").alias("dl"), F.explode("w").alias("term"))
    hits = sized.join(vocabulary, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf < 0, floor * F.col("mean_idf")).otherwise(idf)
    weights = terms.join(vocabulary, "term", "left_semi").join(F.broadcast(totals), how="cross").select("term", "avgdl", idf.alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    one = hits.join(weights, "term").join(asked, "term").select("query_id", key, part.alias("part"))
    return one.groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def top(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with their rank from 1; ties go to the smaller `tie`."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0d, (s, v) -> s + v)")


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def scaled(x: str, lo: str, hi: str) -> Column:
    """x between lo and hi as 0 .. 1; 0 where all are equal."""
    return F.expr(f"case when {hi} - {lo} >= 1e-9 then ({x} - {lo}) / ({hi} - {lo}) else 0d end")


#: Queries of a block on average; rows of a chunk, and rows scored at once.
BLOCK, STEP = 2048, 2048


def blocks(asked: DataFrame) -> DataFrame:
    """asked(query_id, q) in rows (block, ids, queries) of about BLOCK queries, so a task's share does not grow with them."""
    n = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return asked.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("query_id", F.col("q").cast("array<double>").alias("q")))).alias("asked"))


def _packed(key: str):
    """Rows of `key`, embedding and hits as (ids, vectors, hits) of STEP rows each."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                cols = [pa.array([part.column(c).to_pylist()], t) for c, t in ((key, pa.list_(pa.int64())), ("embedding", pa.list_(pa.list_(pa.float64()))), ("hits", HITS))]
                yield pa.RecordBatch.from_arrays(cols, ["ids", "vectors", "hits"])

    return run


HITS = pa.list_(pa.list_(pa.struct([("query_id", pa.int64()), ("score", pa.float64())])))
CHUNK = "ids array<long>, vectors array<array<double>>, hits array<array<struct<query_id:bigint,score:double>>>"


def _unit(rows: list, dim: int) -> np.ndarray:
    """Unit vectors; zeros where a vector is missing or of another length than the queries' longest."""
    v = np.array([x if x is not None and len(x) == dim else [0.0] * dim for x in rows], np.float64).reshape(len(rows), dim)
    return v / (np.sqrt((v * v).sum(1, keepdims=True)) + 1e-9)


def _cosines(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, document ids, cosines) of a row with a block's `asked` and a chunk."""
    asked = [x["q"] for x in r["asked"]]
    dim = max((len(q) for q in asked if q is not None), default=0)
    cos = np.round(_unit(asked, dim) @ _unit(r["vectors"], dim).T, 6) if dim else np.zeros((len(asked), len(r["ids"])))
    return np.array([x["query_id"] for x in r["asked"]], np.int64), np.array(r["ids"], np.int64), cos


def _first(ids: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest cosines, ties to the smaller id."""
    return np.lexsort((ids, -cos))[:k]


def cosine_top(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, cos, rank): the k rows of vectors(vec_id, embedding) nearest to each of asked(query_id, q)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), blocked.empty().alias("terms"), F.col("embedding").alias("vector"))
    given = blocked.blocks(_asked(asked.select("query_id", F.col("q").alias("vector"))), BLOCK)
    found = blocked.best(blocked.chunks(rows, STEP), given, "vectors", k).withColumnsRenamed({"id": "vec_id", "value": "cos"})
    return top(found, ["query_id"], "cos", "vec_id", k)


def _asked(queries: DataFrame) -> DataFrame:
    """queries as `blocked.blocks` takes them, with what they lack."""
    kinds = {"terms": "array<long>", "ws": "array<double>", "bounds": "array<double>", "vector": "array<double>"}
    return queries.select("query_id", *[(F.col(c) if c in queries.columns else F.array() if c == "bounds" else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def _words_asked(queries: DataFrame, split, *more: Column) -> DataFrame:
    """(query_id, terms, more) of queries(query_id, text), each query once."""
    rows = blocked.hashed(queries, "query_id", split, *more).withColumnRenamed("id", "query_id")
    return rows.groupBy("query_id").agg(F.flatten(F.collect_list("terms")).alias("terms"), *[F.first(c).alias(c) for c in rows.columns[2:]])


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, split=words) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of `bm25`, without making a row of each hit."""
    packed = blocked.chunks(blocked.hashed(docs, "doc_id", split, F.lit(None).cast("array<double>").alias("vector")), STEP)
    asked, avgdl = blocked.weights(packed, _words_asked(queries, split))
    found = blocked.best(packed, blocked.blocks(_asked(asked), BLOCK), "words", k, avgdl)
    return top(found.withColumnsRenamed({"id": "doc_id", "value": "score"}), ["query_id"], "score", "doc_id", k)


def _mixed_top(packed: DataFrame, asked: DataFrame, use: str, k: int, alpha: float, avgdl: float) -> DataFrame:
    """(query_id, doc_id, score, rank) of `blocked.chunks` for asked(query_id, terms, ws, vector), scaled between the ends over all documents."""
    asked = written(_asked(asked), "asked")
    found = blocked.ends(packed, blocked.blocks(asked, BLOCK), use, avgdl)
    bounds = F.array("sl", "sh", "cl", "ch", F.col("vector").isNotNull().cast("double"))
    scaled_by = asked.drop("bounds").join(found, "query_id", "left").withColumn("bounds", bounds)
    made = blocked.best(packed, blocked.blocks(scaled_by, BLOCK), use, k, avgdl, alpha)
    return top(made.withColumnsRenamed({"id": "doc_id", "value": "score"}), ["query_id"], "score", "doc_id", k)


def nearest(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k of vectors(doc_id, embedding) nearest to asked(query_id, q), cosines scaled over all vectors."""
    rows = vectors.select(F.col("doc_id").cast("long").alias("id"), blocked.empty().alias("terms"), F.col("embedding").cast("array<double>").alias("vector"))
    return _mixed_top(blocked.chunks(rows, STEP), asked.select("query_id", F.col("q").alias("vector")), "vectors", k, 1.0, 1.0)


def hybrid_top(scores: DataFrame, vectors: DataFrame, asked: DataFrame, k: int, alpha: float = 0.6) -> DataFrame:
    """(query_id, doc_id, hybrid, rank) over every document, both scores scaled over the whole index.

    scores(query_id, doc_id, score) holds the hits, vectors(doc_id, embedding) every document.  One without a
    hit has score 0; of those only the k nearest can be among the k best, so tasks keep them, all
    hits, and the least and highest cosine.  A query without a vector is ranked by its score alone.
    """
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()), ("cos", pa.float64()), ("cl", pa.float64()), ("ch", pa.float64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                qs, docs, cos = _cosines(r)
                place, out = {int(q): i for i, q in enumerate(qs)}, []
                free = np.ones(cos.shape, bool)
                for p, hits in enumerate(r["hits"]):
                    for h in hits or []:
                        i = place.get(h["query_id"])
                        if i is not None:
                            free[i, p] = False
                            out.append((int(qs[i]), int(docs[p]), h["score"], float(cos[i, p]), None, None, None))
                for i, q in enumerate(qs):
                    rest = np.flatnonzero(free[i])
                    best = rest[_first(docs[rest], cos[i, rest], k)]
                    out += [(int(q), int(docs[p]), 0.0, float(cos[i, p]), None, None, None) for p in best]
                    out.append((int(q), None, None, None, float(cos[i].min()), float(cos[i].max()), len(docs)))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)

    hits = scores.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "score")).alias("hits"))
    rows = vectors.join(hits, "doc_id", "left").select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), "hits")
    out = rows.mapInArrow(_packed("doc_id"), CHUNK).crossJoin(blocks(asked)).mapInArrow(run, "query_id long, doc_id long, score double, cos double, cl double, ch double, n long")
    ends = out.groupBy("query_id").agg(F.min("cl").alias("cl"), F.max("ch").alias("ch"), F.sum("n").alias("n"))
    cuts = scores.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("score").alias("least"), F.max("score").alias("most"))
    ends = ends.join(asked.select("query_id", F.col("q").isNotNull().alias("vector")), "query_id").join(cuts, "query_id", "left")
    # A document without a hit stands at 0, so does a query without any.
    all_hit = F.coalesce(F.col("hits") == F.col("n"), F.lit(False))
    ends = ends.withColumn("sl", F.when(all_hit, F.col("least")).otherwise(F.least(F.lit(0.0), "least"))).withColumn("sh", F.when(all_hit, F.col("most")).otherwise(F.greatest(F.lit(0.0), "most")))
    j = out.where("doc_id is not null").select("query_id", "doc_id", "score", "cos").join(ends.select("query_id", "vector", "cl", "ch", "sl", "sh"), "query_id")
    word, near = scaled("score", "sl", "sh"), scaled("cos", "cl", "ch")
    h = F.when(F.col("vector"), alpha * near + (1 - alpha) * word).otherwise(word)
    return top(j.select("query_id", "doc_id", F.round(h, 6).alias("hybrid")), ["query_id"], "hybrid", "doc_id", k)


def word_top(scores: DataFrame, ids: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query by words alone, scaled over the whole index.

    scores(query_id, doc_id, score) holds the hits, ids(doc_id) all n documents.  One without a hit has score 0; of those only the
    smallest ids can be needed, so they are added to queries with fewer than k hits above 0, and no other pair is made.
    """
    of = scores.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(F.col("score") > 0).alias("good"), F.min("score").alias("least"), F.max("score").alias("most"))
    per = queries.select("query_id").distinct().join(of, "query_id", "left").fillna(0, ["hits", "good"])
    poor = per.where(F.col("good") < k).select("query_id", "hits")
    # Among so many smallest ids, k have no hit of a query that has `hits`.
    most = poor.agg(F.max("hits")).first()[0]
    rows = scores.select("query_id", "doc_id", "score")
    if most is not None:
        first = ids.select("doc_id").orderBy("doc_id").limit(k + most).agg(F.array_sort(F.collect_list("doc_id")).alias("first"))
        rest = poor.join(F.broadcast(first)).select("query_id", F.explode("first").alias("doc_id")).join(scores, ["query_id", "doc_id"], "left_anti")
        rest = top(rest.withColumn("score", F.lit(0.0)), ["query_id"], "score", "doc_id", k).drop("rank")
        rows = rows.unionByName(rest)
    all_hit = F.col("hits") == n
    ends = per.select("query_id", F.when(all_hit, F.col("least")).otherwise(F.least(F.lit(0.0), "least")).alias("sl"), F.when(all_hit, F.col("most")).otherwise(F.greatest(F.lit(0.0), "most")).alias("sh"))
    made = rows.join(ends, "query_id").select("query_id", "doc_id", F.round(scaled("score", "sl", "sh"), 6).alias("score"))
    return top(made, ["query_id"], "score", "doc_id", k)


def search(docs: DataFrame, queries: DataFrame, k: int, alpha: float = 0.5, split=words, vectors: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank): docs(doc_id, text[, embedding]) for queries(query_id, text[, q]).

    Without vectors on either side, or with vectors=False, BM25 alone ranks, scaled over the index.
    Tasks keep the ends and then the k best of each query; a hit is no row.
    """
    both = vectors and "embedding" in docs.columns and "q" in queries.columns
    of = lambda c, there: (F.col(c) if there else F.lit(None)).cast("array<double>").alias("vector")
    packed = blocked.chunks(blocked.hashed(docs, "doc_id", split, of("embedding", both)), STEP)
    asked, avgdl = blocked.weights(packed, _words_asked(queries, split, of("q", both)))
    return _mixed_top(packed, asked, "words vectors" if both else "words", k, alpha, avgdl)
