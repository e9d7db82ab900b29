"""Segmentation, chunks and annotations of the legal corpus on small fixtures."""
import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import annotate as A
from docweave.operators import chunks as C
from docweave.operators import scan
from docweave.operators import segment as S

STATUTE = ["法規名稱：甲法", "第 一 章 總則", "第 1 條", "本文一。", "第 1-1 條", "（刪除）", "第 二 章 罰則", "第 2 條", "本文二。"]


def lines_of(spark, docs):
    """docs: {document_id: (type, lines)}, all on page 1."""
    rows = [(d, kind, i, 1, i + 1, t, 0, len(t)) for d, (kind, ts) in docs.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "document_id string, document_type string, idx int, page int, line int, text string, char_start int, char_end int").repartition(3)


def sections_of(spark, kind, texts):
    return S.segment(lines_of(spark, {"d": (kind, texts)})).orderBy("ordinal").collect()


def test_statutes(spark):
    got = sections_of(spark, "statute", STATUTE)
    assert [(r.ordinal, r.section_type, r.first_idx, r.end_idx, r.metadata.article_key, r.metadata.chapter, r.metadata.article_status) for r in got] == [
        (1, "preamble", 0, 2, None, None, None), (2, "statute_article", 2, 4, "1", "第 一 章 總則", "active"),
        (3, "statute_article", 4, 7, "1-1", "第 一 章 總則", "active"), (4, "statute_article", 7, 9, "2", "第 二 章 罰則", "active"),
    ]
    assert got[1].quote_text == "第 1 條\n本文一。" and [s.line for s in got[1].source_spans] == [3, 4]
    assert len({r.section_id for r in got}) == 4 and got[0].section_id.startswith("sec_")
    assert sections_of(spark, "statute", STATUTE[2:6])[1].metadata.article_status == "deleted"
    # A mention inside a sentence is no title; a Chinese number with its branch is one.
    got = sections_of(spark, "statute", ["第十五條之二", "依第 15 條辦理", "第 15 條"])
    assert [(r.ordinal, r.metadata.article_key) for r in got] == [(1, "15-2"), (2, "15")]


def test_decisions_and_rulings(spark):
    got = sections_of(spark, "decision", ["案號：1", "主　文", "訴願駁回。", "理　由", "一、略。", "理 由"])
    assert [(r.section_type, r.first_idx, r.end_idx, r.metadata.section_role) for r in got] == [("decision_header", 0, 1, None), ("decision_main_text", 1, 3, "main_text"), ("decision_reasons", 3, 6, "reasons")]
    got = sections_of(spark, "interpretation", ["法務部 函", "主旨：", "關於某事", "說　明：一", "如下", "主旨"])
    assert [(r.section_type, r.first_idx, r.end_idx) for r in got] == [("interpretation_header", 0, 1), ("interpretation_主旨", 1, 3), ("interpretation_說明", 3, 6)]
    assert [r.section_type for r in sections_of(spark, "precedent", ["甲", "乙"])] == ["unsectioned"]
    assert [r.section_type for r in sections_of(spark, "precedent", ["事實及理由", "乙"])] == ["precedent_事實及理由"]
    assert [r.section_type for r in sections_of(spark, "decision", ["甲", "乙"])] == ["decision_header"]
    assert sections_of(spark, "unknown", ["甲"]) == []
    rows = lines_of(spark, {"d": ("statute", STATUTE), "u": ("unknown", ["甲", " ", "乙"])})
    assert sorted((r.document_id, r.idx) for r in S.uncovered(rows, S.segment(rows)).collect()) == [("u", 0), ("u", 2)]


def pieces(spark, text):
    rows = C.pieces(spark.createDataFrame([(text, 1)], "text string, x int")).orderBy("chunk_no").collect()
    for r in rows:  # each is what its parts of the lines make
        assert "".join(("\n" if p.new else "") + text.split("\n")[p.line][p.start : p.end] for p in r.parts) == r.piece
    return [r.piece for r in rows]


def packed_by_hand(frags):
    out, buf = [], ""
    for f in frags:
        if len(f) > 1200:
            if buf.strip():
                out, buf = [*out, buf], ""
            part = ""
            for s in [x for x in __import__("re").findall("[^。！？；]*[。！？；]|[^。！？；]+", f) if x.strip()]:
                if len(part) + len(s) > 800 and part.strip():
                    out, part = [*out, part], s
                else:
                    part += s
            out += [part] if part.strip() else []
        elif len(buf) + len(f) > 800 and buf.strip():
            out, buf = [*out, buf], f
        else:
            buf = buf + "\n" + f if buf else f
    return out + ([buf] if buf.strip() else [])


@pytest.mark.parametrize("sizes", [(400, 398), (400, 401), (300, 1300, 2), (1200,), (10, 790, 5, 1250, 3, 3), (700, 200, 1500, 100)])
def test_packing(spark, sizes):
    # Each fragment starts with a number; long ones have sentences of 300 characters.
    frags = ["1" + "".join("。" if k % 300 == 299 and n > 1200 else "x" for k in range(n - 1)) for n in sizes]
    text = "\n".join(frags)
    want = [text] if len(text) <= 800 else packed_by_hand(frags)
    assert pieces(spark, text) == want


def test_packing_edges(spark):
    assert [len(p) for p in pieces(spark, "1" * 400 + "\n" + "2" * 400)] == [801]
    blank = "\n".join([" " * 20, "1" + "x" * 1300, "2" + "y" * 30])
    assert pieces(spark, blank) == packed_by_hand([" " * 20, "1" + "x" * 1300, "2" + "y" * 30])
    odd = "\n".join(["1" + "x" * 1300 + "。", " ", "。" + " " * 9 + "。", "", "2" + "y。 \n z；" * 300])
    assert pieces(spark, odd) == packed_by_hand(["1" + "x" * 1300 + "。\n \n。" + " " * 9 + "。\n", "2" + "y。 \n z；" * 300])
    assert C.pieces(spark.createDataFrame([(None,), ("",)], "text string")).select("piece").collect() == [("",)]
    lines = lines_of(spark, {"d": ("decision", ["甲" * 5, "主文", "駁回。" * 300, " ", "1字" + "。字" * 500]), "s": ("statute", STATUTE)})
    made = C.make_chunks(S.segment(lines))
    want = {r.chunk_id: r.quote_text for r in made.collect()}
    assert len(want) > 4 and {r.chunk_id: r.text for r in C.rebuilt(made, lines).collect()} == want
    assert {r.text for r in C.rebuilt(made.where("document_id = 's'"), lines.where("line <> 3")).collect()} > {None}
    got = C.make_chunks(S.segment(lines_of(spark, {"d": ("decision", ["甲" * 5, "主文", "駁回。" + "字" * 1300])}))).orderBy("section_id", "chunk_no").collect()
    by = {r.quote_text[:2]: r for r in got}
    assert by["主文"].index_eligible is False and by["主文"].quality_flags[0] == "historical_outcome_excluded" and by["甲甲"].index_eligible
    long = [r for r in got if "oversize_atomic" in r.quality_flags]
    assert all(r.char_count > 1200 for r in long) and len(long) == 1 and len({r.chunk_id for r in got}) == len(got)


def test_facts_and_citations(spark):
    texts = ["案　號：1121234567", "發文日期：中華民國 113 年 5 月 6 日", "訴願人：王大明，住新北市", "訴願人 李小明", "依訴願法第 77 條及廢棄物清理法第十五條之二、空氣汙染防制法第十五之二條", "民法第15-1條規定"]
    rows = lines_of(spark, {"d": ("decision", texts), "s": ("statute", ["訴願法第 1 條"])})
    f = A.decision_fields(rows).collect()
    assert len(f) == 1
    f = f[0].fields
    assert (f.case_no.value, f.case_no.confidence, f.case_no.source_spans[0].line) == ("1121234567", 0.8, 1)
    assert (f.decision_date.value.iso, f.decision_date.value.precision, f.decision_date.confidence) == ("2024-05-06", "day", 0.8)
    assert f.appellant.value == "王大明" and f.original_authority.value is None and f.original_authority.missing_reason == "not_stated" and f.original_authority.source_spans == []
    cited = A.citations(rows)
    got = sorted((r.statute_name, r.article_key) for r in cited.where("source_document_id = 'd'").collect())
    assert got == [("廢棄物清理法", "15"), ("民法", "15-1"), ("空氣污染防制法", "15-2"), ("訴願法", "77")]
    articles = spark.createDataFrame([("訴願法", "77", "a2"), ("訴願法", "77", "a1")], "statute_name string, article_key string, target_id string")
    done = {(r.statute_name, r.article_key): (r.target_id, r.resolved) for r in A.resolved(cited, articles).collect()}
    assert done[("訴願法", "77")] == ("a1", "resolved") and done[("民法", "15-1")] == (None, "unresolved")


def test_review_queue(spark):
    rows = lines_of(spark, {"u": ("unknown", ["甲乙"])})
    pages = spark.createDataFrame([("u", 1, "甲 乙"), ("u", 2, " \u3000"), ("u", 3, "x" * 20)], "document_id string, page int, raw_text string")
    got = {r.item_id: r.severity for r in A.review_queue(pages, S.uncovered(rows, S.segment(rows))).collect()}
    assert got == {"u-p1-lowtext": "medium", "u-p2-lowtext": "high", "u-line-0-uncovered": "medium"}


def test_sweep(spark):
    """Overlapping, nested, empty and touching ranges, against each line looked at by itself."""
    rnd = random.Random(4)
    docs = {f"d{k}": ("unknown", [rnd.choice(["x", " "]) for _ in range(rnd.randint(0, 40))]) for k in range(12)}
    ranges = [(d, a, a + rnd.randint(0, 12)) for d in docs for a in rnd.sample(range(40), rnd.randint(0, 6))]
    found = S.uncovered(lines_of(spark, docs), spark.createDataFrame(ranges, "document_id string, first_idx int, end_idx int"))
    want = {(d, i) for d, (_, ts) in docs.items() for i, t in enumerate(ts) if t.strip() and not any(e == d and a <= i < b for e, a, b in ranges)}
    assert sorted((r.document_id, r.idx) for r in found.collect()) == sorted(want) and found.columns == lines_of(spark, docs).columns


def test_very_many_names(spark):
    """Ten thousand names that overlap and contain each other: what contains() finds; citations as by the pattern of all names."""
    rnd = random.Random(5)
    names = {"".join(rnd.choices("甲乙丙丁法條例", k=rnd.randint(1, 6))) for _ in range(10_000)} | {"訴願法", "願法", "民法"}
    texts = ["".join(rnd.choices("甲乙丙丁法條例第1第十條 ", k=rnd.randint(0, 80))) for _ in range(200)] + [None, "", "依訴願法第 1 條，民法第15-1條，願法第十五之二條、訴願法 第 3 條"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([(n,) for n in [*names, "", None]], "name string")
    got = {(r.doc_id, r.name) for r in scan.names_in(docs, table).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in names if t and n in t}
    assert scan.names_in(docs, table.limit(0)).count() == 0
    rows = lines_of(spark, {"d": ("decision", [t or "" for t in texts])})
    few = sorted(rnd.sample(sorted(names), 300) + ["訴願法", "願法", "民法", "法", "甲法", "甲乙法"])
    by = lambda given: sorted((r.source_spans[0].line, r.citation_raw, r.statute_name, r.article_key or "") for r in A.citations(rows, given).collect())
    assert by(spark.createDataFrame([(n,) for n in few], "name string")) == by(few) and len(by(few)) > 8
