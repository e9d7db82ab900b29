"""Learned words and best paths against brute force."""
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docweave.operators import postings as P
from docweave.operators import retrieval as R
from docweave.operators import segmenter as S
from docweave.plans.catalogue import QUERIES

TERMS = ["廢棄物", "清理法", "訴願", "處分", "撤銷", "駁回", "環保局", "稽查", "罰鍰", "土地"]


def corpus(n=300):
    r = random.Random(4)
    texts = [(i, "，".join("".join(r.choices(TERMS, k=r.randint(1, 6))) for _ in range(r.randint(1, 4))) + " Appeal 7") for i in range(n)]
    return [*texts, (n, None), (n + 1, ""), (n + 2, texts[0][1])]


def test_learned_words_by_brute_force(spark):
    texts = corpus()
    counts = Counter()
    for _, t in texts:
        for run in S.regex.findall(f"{R.HAN}+", t or ""):
            for m in range(1, 6):
                counts.update(run[i : i + m] for i in range(len(run) - m + 1))
    total = sum(n for w, n in counts.items() if len(w) == 1)
    want = {}
    for w, n in counts.items():
        held = min((n * total / (counts[w[:i]] * counts[w[i:]]) for i in range(1, len(w))), default=None)
        longer = max((k for x, k in counts.items() if len(x) == len(w) + 1 and k >= 5 and w in (x[1:], x[:-1])), default=0)
        if len(w) == 1 or (len(w) <= 4 and n >= 5 and held >= 8 and longer < 0.9 * n):
            want[w] = n
    words = S.learned(S.strings(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {r.word: r.n for r in words.collect()} == want
    # No word list: the terms are found, pieces of them and strings across two of them are not.
    assert {w for w in want if len(w) > 1} == set(TERMS)
    assert S.learned(S.strings(spark.createDataFrame([], "text string"))).count() == 0


def test_best_path_by_brute_force():
    r = random.Random(9)
    for _ in range(300):
        weight = {"".join(w): -r.choice([1, 2, 3, 4, 5]) for m in (1, 2, 3) for w in itertools.product("ab甲", repeat=m) if r.random() < 0.5}
        run = "".join(r.choices("ab甲", k=r.randint(1, 9)))
        paths = []
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            ends = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
            path = [run[a:b] for a, b in itertools.pairwise(ends)]
            s = sum(weight.get(w, -9 if len(w) == 1 else -math.inf) for w in path)
            paths.append((s, [len(w) for w in path[::-1]], path))
        top = max(p[0] for p in paths)
        assert S.best_path(run, weight, 3, -9) == max(p for p in paths if p[0] == top)[2]
    assert S.best_path("", {}, 3, -1.0) == []


def test_search_by_learned_words(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    split = S.splitter(S.learned(S.strings(docs)))
    rows = spark.createDataFrame([("訴願廢棄物清理法 Appeal處分",), ("火星訴願",), ("",), (None,)], "t string")
    assert [r.w for r in rows.select(split(F.col("t")).alias("w")).collect()] == [["訴願", "廢棄物", "清理法", "Appeal", "處分"], ["火", "星", "訴願"], [], None]
    # The first holds one of the words twice in a shorter text; the others hold none.
    few = spark.createDataFrame([(1, "罰鍰訴願罰鍰"), (2, "清理法訴願處分罰鍰稽查"), (3, "土地"), (4, "撤銷"), (5, "環保局"), (6, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "訴願罰鍰")], "query_id long, text string")
    got = R.top(R.bm25(few, asked, split=split), ["query_id"], "score", "doc_id", 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2]
    P.save(few, str(tmp_path / "index"), split)
    assert [r.doc_id for r in P.search(P.load(spark, str(tmp_path / "index"), split), asked, 5, split).orderBy("rank").collect()] == [1, 2]
    other = S.splitter(S.learned(S.strings(few)))
    with pytest.raises(ValueError):
        P.load(spark, str(tmp_path / "index"), other)


def test_learned_parts_by_brute_force(spark, tmp_path):
    """The query's counts are those of the best paths of every run, taken one by one."""
    r = random.Random(6)
    texts = [(i, " ".join("".join(r.choices(["tion", "ver", "es", "and", "x"], k=r.randint(1, 5))) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "A1 B"), (62, "ver" * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = S.learned(S.strings(docs, "[a-z]")).collect()
    weight = {x.word: math.log(x.n / x.total) for x in rows}
    want = Counter()
    for _, t in texts:
        for run in S.regex.findall("[a-z]+", t or ""):
            want.update(S.best_path(run, weight, max(map(len, weight)), math.log(0.5 / rows[0].total)))
    assert {x.word: x.n for x in QUERIES["learned_parts"](spark, str(tmp_path)).collect()} == want
    assert want["tion"] > 100
