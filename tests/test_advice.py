"""Recommendations, similar cases, alerts, drafts and checks on small fixtures."""
import random

from pyspark.sql import functions as F

from docweave.operators import advice as A
from docweave.operators import cases as C
from docweave.operators import checks as K


def test_fusion(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    cited = spark.createDataFrame([(10, "甲法", 1), (11, "甲法", 1), (11, "訴願法", 77)], "doc_id long, name string, num int")
    words = spark.createDataFrame([(1, "甲法", 1, 0.8), (1, "甲法", 9, 1.0), (1, "乙法", 3, 0.1)], "query_id long, name string, num int, score double")
    parents = spark.createDataFrame([(1, "甲法")], "query_id long, parent string")
    scores = A.fused(A.case_weights(hits, cited), words, parents, A.is_procedural(F.col("name")))
    assert {(r.name, r.num): r.score for r in scores.collect()} == {("甲法", 1): 0.94, ("甲法", 9): 0.5, ("訴願法", 77): 0.025, ("乙法", 3): 0.03}
    known = spark.createDataFrame([("甲法", 1, 5, "old"), ("甲法", 1, 6, "new"), ("訴願法", 77, 7, "x"), ("乙法", 3, 8, "y")], "name string, num int, doc_id long, content string")
    got = [(r.rank, r.name, r.num, r.content) for r in A.recommend(scores, known, 2).orderBy("rank").collect()]
    assert got == [(1, "甲法", 1, "new"), (2, "乙法", 3, "y")]  # 甲法 9 has no source text


def test_similar(spark):
    asked = C.weighted(spark.createDataFrame([(1, "甲法-1"), (1, "訴願法-77"), (2, "訴願法-77")], "query_id long, key string"), F.col("key").startswith("訴願法-"))
    docs = [(5, "甲法-1"), (5, "甲法-2"), (5, "訴願法-77"), (6, "訴願法-77"), (7, "丙法-1")]
    cases = C.weighted(spark.createDataFrame(docs, "doc_id long, key string"), F.col("key").startswith("訴願法-"))
    pool = spark.createDataFrame([(1, 5, 0.5), (2, 7, 1.0)], "query_id long, doc_id long, score double")
    queries = spark.createDataFrame([(1, "違反空氣汙染防制法"), (2, None)], "query_id long, kind string")
    kinds = spark.createDataFrame([(5, "違反空氣污染防制法事件"), (6, "x"), (7, "x")], "doc_id long, kind string")
    got = {(r.query_id, r.doc_id): r for r in C.similar(asked, cases, pool, None, queries, kinds).collect()}
    # Case 6 shares a procedural article only, and no search found it.
    assert set(got) == {(1, 5), (2, 7)}
    assert (got[1, 5].similarity, got[1, 5].articles, got[1, 5].type, got[1, 5].shared) == (0.5873, 0.545, 0.9, ["甲法-1"])
    assert (got[2, 7].similarity, got[2, 7].shared) == (0.25, [])
    rec = spark.createDataFrame([(1, "a"), (1, "a")], "query_id long, key string")
    parsed = spark.createDataFrame([(1, "b"), (2, "c")], "query_id long, key string")
    assert sorted(map(tuple, C.query_keys(rec, parsed).collect())) == [(1, "a"), (2, "c")]


def _nearest(asked, have, pool, kind, k):
    """Every query against every case."""
    out = {}
    for q, mine in asked.items():
        rows = []
        for d, yours in have.items():
            search = pool.get((q, d), 0.0)
            if q == d or not ({x for x in mine & yours if x % 5} or (q, d) in pool):
                continue
            w = lambda s: sum(1.0 if x % 5 else 0.2 for x in s)
            total = 0.6 * (w(mine & yours) / w(mine | yours) if mine | yours else 0.0) + 0.15 * (kind[q] == kind[d]) + 0.25 * search
            rows.append((-round(total, 4), d))
        out[q] = sorted(rows)[:k]
    return {(q, i + 1): (d, -s) for q, rows in out.items() for i, (s, d) in enumerate(rows)}


def test_similar_by_bounds_equals_brute_force(spark):
    r = random.Random(5)
    have = {}
    for d in range(400):
        keys = {min(int(r.paretovariate(0.7)), 300) for _ in range(r.choice([0, 1, 2, 4, 8]))}
        have[d] = keys | ({7} if r.random() < 0.5 else set())  # half the cases have key 7
        if d % 5 == 4:
            have[d] = set(have[d - 1])
    asked = {d: have[d] for d in range(0, 400, 8)} | {1000: {299}, 1001: {7}, 1002: set(), 1003: {5, 10, 7}, 1004: {123456}}
    kind = {d: r.choice("abc") for d in [*have, *asked]}
    pool = {(q, d): r.randrange(250) * 0.004 for q in list(asked)[::2] for d in r.sample(range(400), 8)}
    table = lambda rows, names: spark.createDataFrame([(i, x) for i, s in rows.items() for x in s], names)
    procedural = F.col("key") % 5 == 0
    a, c = C.weighted(table(asked, "query_id long, key long"), procedural), C.weighted(table(have, "doc_id long, key long"), procedural)
    p = spark.createDataFrame([(*x, s) for x, s in pool.items()], "query_id long, doc_id long, score double")
    queries, docs = spark.createDataFrame([(q, kind[q]) for q in asked], "query_id long, kind string"), spark.createDataFrame([(d, kind[d]) for d in have], "doc_id long, kind string")
    same = F.when(F.col("kind_a") == F.col("kind_b"), 1.0).otherwise(0.0)
    got = C.similar(a, c, p, same, queries, docs, 5, F.col("query_id") != F.col("doc_id")).collect()
    assert {(x.query_id, x["rank"]): (x.doc_id, x.similarity) for x in got} == _nearest(asked, have, pool, kind, 5)


def test_a_frequent_key_pairs_no_cases(spark):
    # Key 1 is in all of 500 cases, key 100 + i in two of them.
    rows = [(d, x) for d in range(500) for x in (1, 100 + d // 2)]
    cases = C.weighted(spark.createDataFrame(rows, "doc_id long, key long"), F.lit(False))
    known = cases.groupBy("key").agg(F.count("*").alias("df"))
    have = C.profiles(cases, "doc_id", known).withColumn("kind_b", F.lit("x"))
    asked = C.profiles(cases.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), "query_id", known).withColumn("kind_a", F.lit("x"))
    assert {tuple(r.full) for r in asked.where("query_id = 0").collect()} == {(100, 1)}
    same = F.when(F.col("kind_a") == F.col("kind_b"), 1.0).otherwise(0.0)
    bounds = lambda b: asked.select("query_id", F.lit(b).alias("bound"))
    # One key of three in common gives 0.35: a bound above it needs the rare one too, a bound at it does not.
    assert C.candidates(asked, have, bounds(0.36), same).count() == 20
    assert C.candidates(asked, have, bounds(0.35), same).count() == 5000
    assert C.candidates(asked, have, bounds(0.35).where("query_id = 0"), same).where("query_id = 50").count() == 500


def test_outcomes(spark):
    found = spark.createDataFrame([(1, "駁回"), (1, "駁回"), (1, "撤銷"), (1, None), (1, ""), (2, None)], "query_id long, result string")
    assert [(r.query_id, r.result, r.ratio, r.total) for r in C.modal(found).collect()] == [(1, "駁回", 0.67, 3)]


def test_alerts(spark):
    years = [(1, 111, 113), (2, 113, 111), (3, 111, 112), (4, 113, 113), (5, None, 113)]
    appeals = spark.createDataFrame(years, "query_id long, behavior int, disposition int")
    given = spark.createDataFrame([(q, n, r) for q, _, _ in years for n, r in (("乙法", 1), ("甲法", 2), ("乙法", 3), ("丙法", 4))], "query_id long, name string, rank int")
    amended = spark.createDataFrame([("甲法", 113), ("乙法", 113), ("丙法", 111)], "name string, year int")
    got = {r.query_id: r for r in A.alerts(appeals, given, amended).collect()}
    assert [got[q].triggered for q in range(1, 6)] == [True, True, False, False, False]
    assert got[1].changed == ["乙法（修正於民國113年）", "甲法（修正於民國113年）"] and got[2].changed == got[1].changed and got[5].changed == []
    assert "行為時為民國111年、處分時為民國113年" in got[1].message and got[1].message.endswith("：乙法（修正於民國113年）；甲法（修正於民國113年）。")
    assert got[4].message == "行為時與處分時同為民國113年，無新舊法變更之從新從輕適用問題。" and "未偵測到修正" in got[3].message and got[5].message.startswith("未能取得")


def test_drafts(spark):
    appeals = spark.createDataFrame([(1, "王大明", None, "環保局", "字第 1 號", "倒垃圾", "沒有"), (2, None, "", None, None, None, None)], "query_id long, appellant string, case_type string, original_authority string, disposition_no string, facts string, claims string")
    given = spark.createDataFrame([(1, 2, "statute", "乙法", "第 2 條", "b"), (1, 1, "statute", "甲法", "第 1 條", " a "), (1, 3, "precedent", "x", "y", "z")], "query_id long, rank int, source string, statute_name string, article_no string, content string")
    outcomes = spark.createDataFrame([(1, "駁回", 0.67, 3)], "query_id long, result string, ratio double, total long")
    alert = spark.createDataFrame([(1, True, "注意"), (2, False, "無")], "query_id long, triggered boolean, message string")
    got = {r.query_id: r for r in A.drafts(appeals, given, outcomes, alert).collect()}
    assert got[1].fact == "緣訴願人王大明因違規事件，不服環保局所為之處分（字第 1 號），提起訴願。事實摘要如下：\n倒垃圾"
    assert got[1].reason == "一、按下列規定：\n甲法第 1 條：「a」\n乙法第 2 條：「b」\n\n二、本案分析：\n訴願人主張：沒有\n（請承辦人依上開法規涵攝本案事實補充分析）\n\n三、注意\n\n（參考）歷史相似案件中，駁回佔 67%（共3件）。"
    assert "○○○" in got[2].fact and "（請補充適用法規）" in got[2].reason and "三、" not in got[2].reason and got[2].mode == "template"


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, n int")
    rows = K.unique("u", df, "k").unionByName(K.none("n", df, F.col("k").isNull(), "bad")).unionByName(K.total("t", df, F.sum("n"), 6)).unionByName(K.total("free", df, F.count("*"), None)).unionByName(K.refers("r", df, "k", df.where("k = 'a'")))
    assert [tuple(r) for r in rows.collect()] == [("u", False, "n=3 keys=1"), ("n", False, "bad=1"), ("t", True, "n=6 expected=6"), ("free", True, "n=3 expected=None"), ("r", False, "dangling=1")]
    assert K.gate(rows) == "partial" and K.gate(rows.where("passed")) == "validated"
