"""Searches on small tables against brute force."""
import math
import random

import pytest

from docweave.operators import postings as P
from docweave.operators import retrieval as R
from docweave.plans.catalogue import QUERIES


def cosine(a, b):
    norm = lambda v: math.sqrt(sum(x * x for x in v)) + 1e-9
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b)), 6)


def scaled(xs):
    lo, hi = min(xs), max(xs)
    return [0.0 if hi - lo < 1e-9 else (x - lo) / (hi - lo) for x in xs]


def test_hybrid_scores_documents_without_a_hit(spark):
    vectors = {0: [1.0, 0.1], 1: [0.0, 1.0], 2: [-1.0, 0.2], 3: [0.9, 0.3], 4: None, 5: [0.2, 0.9]}
    hits = {(7, 1): 2.0, (7, 2): 3.5, (8, 3): 1.0, (8, 0): 2.0}
    asked = {7: [1.0, 0.0], 8: None}
    want = []
    for q, v in asked.items():
        word = scaled([hits.get((q, d), 0.0) for d in vectors])
        near = scaled([cosine(v, e) if v and e else 0.0 for e in vectors.values()])
        h = [round(0.6 * n + 0.4 * w, 6) if v else round(w, 6) for n, w in zip(near, word, strict=True)]
        want += [(q, d, -s, k + 1) for k, (s, d) in enumerate(sorted((-x, d) for d, x in zip(vectors, h, strict=True))[:4])]
    docs = spark.createDataFrame(list(vectors.items()), "doc_id long, embedding array<float>").repartition(3)
    scores = spark.createDataFrame([(*k, s) for k, s in hits.items()], "query_id long, doc_id long, score double")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, q array<float>")
    got = sorted(tuple(r) for r in R.hybrid_top(scores, docs, queries, 4).select("query_id", "doc_id", "hybrid", "rank").collect())
    assert got == sorted(want)
    assert (7, 0) in {r[:2] for r in got}  # no hit, but nearest


def test_cosine_answers_every_query_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 2)
    monkeypatch.setattr(R, "STEP", 7)
    vectors = {i: [math.sin(i), math.cos(3 * i), 0.5 + i % 4] for i in range(1, 41)}
    want = []
    for q in range(5, 41, 5):
        best = sorted((-cosine(vectors[q], v), i) for i, v in vectors.items())[:3]
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(best)]
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    got = R.cosine_top(df, df.where("vec_id % 5 = 0").selectExpr("vec_id as query_id", "embedding as q"), 3)
    assert sorted(tuple(r) for r in got.select("query_id", "vec_id", "cos", "rank").collect()) == sorted(want)


def test_similar_orders_sees_other_customers_and_earlier_orders(spark, tmp_path):
    # Part 5 is procedural; orders 1 and 99 share part 7 with 50, order 60 only part 5.
    orders = [(1, 10, "low", "F"), (50, 20, "low", "F"), (60, 20, "low", "F"), (99, 30, "high", "F")]
    lines = [(1, 7), (50, 7), (50, 5), (60, 5), (99, 7), (99, 5), (99, 8)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["similar_orders_topk"](spark, str(tmp_path)).select("a", "b", "similarity", "rank").collect()
    assert sorted(tuple(r) for r in got) == [(50, 1, 0.65, 1), (50, 99, 0.4173, 2)]


def test_bm25_is_okapi_with_a_floor(spark):
    texts = {1: "a a b", 2: "a c", 3: "a d d d", 4: None, 5: "a B b"}
    words = {d: (t or "").split() for d, t in texts.items()}
    n, avgdl = len(texts), sum(map(len, words.values())) / len(texts)
    df = {w: sum(w in ws for ws in words.values()) for ws in words.values() for w in ws}
    idf = {w: math.log((n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    want = {}
    for q, asked in {7: "a b b", 8: "x", 9: "B"}.items():
        for d, ws in words.items():
            score = sum((idf[w] if idf[w] >= 0 else floor) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in asked.split() if w in ws)
            if set(asked.split()) & set(ws):
                want[q, d] = round(score, 6)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a b b"), (8, "x"), (9, "B")], "query_id long, text string")
    assert {(r.query_id, r.doc_id): r.score for r in R.bm25(docs, queries).collect()} == want


def test_search_without_vectors(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "blue bolt"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(5, "blue"), (6, "green")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in R.search(docs, queries, 2).collect()}
    assert got == {(5, 2): 1.0, (5, 1): 0.0, (6, 1): 0.0, (6, 2): 0.0}
    row = spark.createDataFrame([("訴願法 第 7 條 Appeal 法",)], "t string").select(R.mixed_words(R.F.col("t")).alias("w")).first()
    assert row.w == ["訴願", "願法", "第", "7", "條", "Appeal", "法"]


def test_word_search_fills_up_with_the_smallest_ids(spark):
    rnd = random.Random(2)
    ids = rnd.sample(range(100), 40)
    hits = {(q, d): rnd.choice([-1.0, 0.5, 2.0, 3.0]) for q in range(4) for d in rnd.sample(ids, (0, 2, 15, 40)[q])}
    got = R.word_top(spark.createDataFrame([(*k, s) for k, s in hits.items()], "query_id long, doc_id long, score double"), spark.createDataFrame([(d,) for d in ids], "doc_id long"), spark.createDataFrame([(q,) for q in range(4)], "query_id long"), 40, 6)
    want = []
    for q in range(4):
        x = scaled([hits.get((q, d), 0.0) for d in ids])
        want += [(q, d, -s, k + 1) for k, (s, d) in enumerate(sorted((-round(v, 6), d) for d, v in zip(ids, x, strict=True))[:6])]
    assert sorted(tuple(r) for r in got.select("query_id", "doc_id", "score", "rank").collect()) == sorted(want)
    plan = R.word_top(*(spark.createDataFrame([], s) for s in ("query_id long, doc_id long, score double", "doc_id long", "query_id long")), 0, 3)
    assert plan.count() == 0


def test_vectors_of_another_length_are_none(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None)], "vec_id long, embedding array<double>")
    got = R.cosine_top(docs, spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, q array<double>"), 3)
    assert {r.vec_id: r.cos for r in got.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_postings_are_skipped_and_lose_nothing(spark, tmp_path):
    """Equal to scoring everything; a rare word's good documents make lists of groups without it unread."""
    rnd = random.Random(3)
    common = [f"c{i}" for i in range(41)]
    texts = [(i, " ".join(rnd.choices(common, k=rnd.randint(1, 30)) + (["rare"] * rnd.randint(1, 6) if rnd.random() < 0.012 else []))) for i in range(600)] + [(700, None), (701, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "rare c1"), (2, "rare"), (3, "c1 c2 c3 c3"), (4, "nowhere"), (5, "")], "query_id long, text string")
    assert P.load(spark, str(tmp_path / "none")) is None
    P.save(docs, str(tmp_path / "index"), group=20)
    index = P.load(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError):
        P.load(spark, str(tmp_path / "index"), R.mixed_words)
    scored = R.bm25(docs, queries)
    assert sorted(map(tuple, P.scores(index, queries).collect())) == sorted(map(tuple, scored.collect()))
    for k in (1, 3, 10, 20):
        assert sorted(map(tuple, P.search(index, queries, k).collect())) == sorted(map(tuple, R.top(scored, ["query_id"], "score", "doc_id", k).collect()))
    w = P.weights(index, queries)
    read = {k: {(r.query_id, r.term): r.n for r in P.read(index, w, k).groupBy("query_id", "term").agg(R.F.sum(R.F.size("docs")).alias("n")).collect()} for k in (None, 3)}
    assert read[3][1, "c1"] < 0.4 * read[None][1, "c1"] and read[3][1, "rare"] >= 3
    assert index.postings.where("term = 'c1'").count() > 10  # a frequent word is many rows
    P.save(docs.limit(0), str(tmp_path / "empty"))
    assert P.search(P.load(spark, str(tmp_path / "empty")), queries, 3).count() == 0
