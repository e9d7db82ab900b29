"""Golden values of the text functions."""
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import lines as L


def values(spark, inputs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").withColumn("y", f(F.col("x"))).orderBy("i")
    return [r.y for r in rows.collect()]


def test_article_keys(spark):
    got = values(spark, ["第 15 條", "第 15-2 條", "第 2-1 條", "第十五條", "第十五條之二", "foo", "第15條之二", None], T.article_key)
    assert got == ["15", "15-2", "2-1", "15", "15-2", None, "15", None]
    got = values(spark, ["第 15 - 2 條", "第 十五 條", "第十五條 之 二", "第　15　條", "第十五之二條", "依條之三及第一條"], T.article_key)
    assert got == ["15-2", "15", "15-2", "15", None, "1"]
    assert values(spark, ["第十五之二條"], lambda c: T.article_key(c, branch_before=True)) == ["15-2"]


def test_numerals(spark):
    got = values(spark, ["一", "十", "十五", "二十一", "一百零八", "二百", "零", "一二", "十x", "", "〇", "兩"], T.numeral)
    assert got == [1, 10, 15, 21, 108, 200, None, 2, None, None, None, None]


def test_dates(spark):
    got = values(spark, ["民國 114 年 3 月 17 日", "民國 114 年", "民國 114 年 3 月", "114 年 3 月"], T.roc_date)
    late = values(spark, ["民國 9 年，民國 113 年 5 月，民國 112 年 1 月 2 日"], T.roc_date)[0]
    assert (late.iso, late.precision, late.roc_year, late.calendar) == ("2023-01-02", "day", 112, "roc")
    assert [(r.iso, r.precision, r.roc_year) for r in got] == [("2025-03-17", "day", 114), (None, "year", 114), (None, "month", 114), (None, "unknown", None)]


def test_normalise(spark):
    got = values(spark, ["空氣汙染防制法 但書", "  a　　b\r\n\n\n\nc ", None], T.normalise)
    assert got == ["空氣污染防制法 但書", "a b\n\nc", ""]


def test_file_hint(spark):
    got = values(spark, ["a/17.113年-違反廢棄物清理法事件-79I-訴願無理由- 駁回.pdf 的副本.pdf", "3.112年-廢棄物.pdf.pdf", "x", "7年-a.pdf", "年112.3-b"], T.file_hint)
    assert tuple(got[0]) == ("17.113年-違反廢棄物清理法事件-79I-訴願無理由- 駁回", 17, 113, "違反廢棄物清理法事件", "79I", "駁回")
    assert [tuple(r)[1:] for r in got[1:]] == [(3, 112, "廢棄物", None, "廢棄物"), (None,) * 5, (None, None, "a", None, "a"), (None, None, "b", None, "b")]


def test_types_and_names(spark):
    assert values(spark, ["相關法規", "x", None], T.folder_type) == ["statute", "unknown", "unknown"]
    kinds = values(spark, ["a/釋字第 1 號.pdf", "a/最高行政法院裁定.pdf", "判決.pdf", "x.pdf", "司法院解釋.pdf", "y" * 25 + "解釋.pdf"], lambda c: T.subtype(F.lit("precedent"), c))
    assert kinds == ["interpretation_constitutional", "ruling", "judgment", None, "interpretation_constitutional", None]
    assert values(spark, ["x"], lambda c: T.subtype(F.lit("interpretation"), c)) == ["administrative_letter"]
    assert values(spark, ["案　　號：\n 112 \n", "案　　號: 7", "none"], lambda c: T.labelled(c, "案　　號")) == ["112", "7", None]
    assert values(spark, ["依空氣汙染防制法與建築法、空氣污染防制法"], lambda c: T.known_names(c, T.R.CITED_STATUTES)) == [["空氣污染防制法", "建築法"]]
    assert values(spark, ["法規名稱：行政罰法 EN\n修正", "none"], lambda c: T.statute_title(c, F.lit("d/某法.pdf"))) == ["行政罰法", "某法"]
    lines = ["廢棄物清理法 第 50、12、27 條", "依訴願法第 1 條", "第 5 條", "甲法第 15-2 條"]
    assert [[tuple(x) for x in r] for r in values(spark, lines, lambda c: T.statute_articles(c, anchored=True))] == [[("廢棄物清理法", 50), ("廢棄物清理法", 12), ("廢棄物清理法", 27)], [("依訴願法", 1)], [], []]


def test_case_types(spark):
    kinds = ["違反空氣汙染防制法事件", "違章建築事件", "申請提供政府資訊事件", "other", None]
    assert values(spark, kinds, T.case_type_form) == ["空氣污染防制法", "違章建築", "申請提供政府資訊", "other", ""]
    assert values(spark, kinds, T.parent_word) == ["空氣污染防制法", None, "政府資訊", None, None]
    assert values(spark, kinds, T.parent_statute) == ["空氣污染防制法", "建築法", "政府資訊公開法", None, None]
    assert values(spark, ["本案違章建築", "建築法 違章建築", "x"], T.case_type) == ["違章建築事件", "違反建築法事件", None]
    assert values(spark, ["12", "0", "", "x", " 7 ", None], T.whole_number) == [12, None, None, None, 7, None]


def test_bodies(spark):
    body = spark.createDataFrame([("", "a\u3000\u00a0b\n\n\nc " + "x" * 700)], "s string, c string").select(T.snippet(F.col("s"), F.col("c")).alias("x")).first().x
    assert body.startswith("a b\nc x") and len(body) == 600
    assert values(spark, ["駁回" + "x" * 200, "無理由", "撤銷又駁回", "不受理"], T.outcome) == ["（請承辦人確認主文）", "訴願駁回。", "原處分撤銷。", "訴願不受理。"]
    assert values(spark, ["## 標題\n**重點**內文\n- 項\n\n\n\n末\nLet me check\nmore", None, "Checklist"], T.scrubbed) == ["標題\n重點內文\n項\n\n末", "", ""]
    text = "案號\n相關法條：\n 訴願法 第 1 條\n\n甲法　第 2 條\n全　文：\n 主　文\n駁回。\n 事 實\n有事\n理由\n一、略\n"
    assert values(spark, [text, "x"], T.related_lines) == [["訴願法 第 1 條", "甲法 第 2 條"], []]
    assert [tuple(r) for r in values(spark, [text, "x"], T.three_sections)] == [("駁回。", "有事", "一、略"), (None, None, None)]
    assert tuple(values(spark, ["法務部 函\n法律字第 123 號\n民國 99 年 1 月 2 日\n要 旨：某事\n"], T.interpretation_fields)[0]) == ("法務部", "法律字第 123 號", "民國 99 年 1 月 2 日", "某事")
    assert tuple(values(spark, ["d/最高行政法院100年度判字第1號-爭點.pdf.pdf"], T.precedent_fields)[0]) == ("最高行政法院100年度判字第1號-爭點", "最高行政法院", "100年度判字第1號", "爭點")


def test_sections_and_names_of_other_files(spark):
    again = "頭\n主文\nA\n事實\nB\n理由\nC1\n主文\nC2\n事實\nC3"
    assert [tuple(r) for r in values(spark, [again, "\n理由\n先\n主 文\n後\n理由\n末", "\n主文\n事實\n𠀋x\n"], T.three_sections)] == [("A", "B", "C1\n主文\nC2\n事實\nC3"), ("後\n理由\n末", None, "先"), ("", "𠀋x", None)]
    assert [r.result for r in values(spark, ["a/1.112年-違反建築法-79I-駁回.txt", "a/1.112年-x-y-撤銷.html", "第 1.5 條"], T.file_hint)] == ["駁回", "撤銷", None]
    text = "x\n見相關法條：\n甲法 第 1 條\n\n 全部\n乙"
    assert values(spark, [text, text.replace("全部", "全 文"), "相關法條：\n甲法 第 1 條", None], T.related_lines) == [["甲法 第 1 條"], ["甲法 第 1 條"], [], []]


def test_index_texts(spark):
    row = spark.createDataFrame([("a", "", None, ["x 1", "y 2"], "f" * 900)], "a string, b string, c string, d array<string>, e string")
    got = row.select(T.decision_index_text(F.col("a"), F.col("b"), F.col("d"), F.col("e"), F.col("c")).alias("d"), T.reference_index_text(F.col("a"), F.col("c"), F.col("b"), F.col("e")).alias("r"), T.query_text(F.col("a"), F.col("b"), F.col("c"), F.col("e")).alias("q"), T.statute_index_text(F.col("a"), F.col("c"), F.col("a")).alias("s")).first()
    assert (got.d, got.r, got.q, got.s) == ("a x 1 y 2 " + "f" * 800, "a   " + "f" * 900, "a " + "f" * 500, "a  a")


def test_sections_of_marked_lines(spark):
    docs = spark.createDataFrame([(1, "intro here is long\nA\n\nx y z w\nB\nq r s t"), (2, None), (3, "")], "doc_id long, text string")
    got = L.sections(L.lines(docs), F.length("line") == 1).orderBy("section").collect()
    assert [(r.section, r.heading, r.first_line, r.quote) for r in got] == [(0, None, 1, "intro here is long"), (1, "A", 2, "A\nx y z w"), (2, "B", 5, "B\nq r s t")]
