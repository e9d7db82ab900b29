"""A small corpus from files to a checked release and its knowledge base; exports."""
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docweave.operators import checks
from docweave.plans import analysis, release
from docweave.sources import extract, readers, writers

LAW = "法規名稱：廢棄物清理法\n修正日期：民國 112 年 6 月 7 日\n第 一 章 總則\n第 1 條\n為清除廢棄物。\n第 27 條\n不得隨地拋棄垃圾。\n第 27-1 條\n（刪除）\n第 50 條\n處新臺幣罰鍰。\f"
OTHER = "法規名稱：訴願法\n第 79 條\n訴願無理由者應駁回。\n第 80 條\n略。"
CASE = "案號：1121\n發文日期：民國 112 年 8 月 9 日\n訴願人：王大明，住新北市\n相關法條：\n廢棄物清理法 第 27、50 條\n訴願法 第 79 條\n全　文：\n主　文\n訴願駁回。\n事　實\n隨地拋棄垃圾。\n理　由\n依廢棄物清理法第 27 條。\n"
NOTE = "法務部 函\n法律字第 123 號\n主旨：\n關於拋棄垃圾之疑義\n說明：\n如下。"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus") / "data"
    files = {
        "相關法規/a.txt": LAW, "相關法規/b.txt": OTHER, "相關法規/copy.txt": LAW, "歷史訴願決定書/1.112年-違反廢棄物清理法事件-79I-駁回.txt": CASE,
        "歷史訴願決定書/2.112年-違反建築法事件-79I-撤銷.txt": CASE.replace("1121", "1122").replace("廢棄物清理法 第 27、50 條", "建築法 第 1 條").replace("拋棄垃圾", "違建"),
        "行政函釋/n.txt": NOTE, "司法院釋字及行政判解/釋字第 1 號-某題.txt": "甲\n乙", "其他/x.txt": "短",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "其他/bad.txt").write_bytes(b"\xff\xfe\x00")
    return root


def test_release(spark, corpus, tmp_path):
    done = release.build(spark, str(corpus), "data", str(tmp_path), "r1", files=8, pages=8)
    got = {r.name: (r.passed, r.detail) for r in done.collect()}
    assert {n for n, (p, _) in got.items() if not p} == set(), got
    place = release.current(spark, str(tmp_path), "r1")
    read = lambda n: spark.read.parquet(f"{place}/{n}")
    docs = {r.source_file.split("/")[-1]: r for r in read("documents").collect()}
    assert len(docs) == 7 and len(docs["a.txt"].path_aliases) == 2 and docs["a.txt"].document_type == "statute" and docs["釋字第 1 號-某題.txt"].document_subtype == "interpretation_constitutional"
    assert [r.path.split("/")[-1] for r in read("duplicates").collect()] == ["copy.txt"] and [r.path.split("/")[-1] for r in read("failed").collect()] == ["bad.txt"]
    cited = {(r.statute_name, r.article_key): r.resolved for r in read("citations").collect()}
    assert cited[("廢棄物清理法", "27")] == "resolved"
    items = {r.issue_type for r in read("review_queue").collect()}
    assert items == {"low_text_page", "uncovered_line"}
    assert read("sections").where("metadata.article_status = 'deleted'").count() == 1
    assert read("annotations").where("fields.case_no.value is not null").count() == 2 == read("chunks").where("not index_eligible").count()
    status = [json.loads(x) for p in Path(place, "manifest").glob("part-*") for x in p.read_text().splitlines()]
    assert {x["status"] for x in status} == {"validated"} and {x["name"]: x["n_rows"] for x in status}["documents"] == 7
    assert all(spark.read.parquet(f"{place}/{x['name']}").count() == x["n_rows"] for x in status)
    text = "".join(p.read_text() for p in Path(place, "report/markdown").glob("part-*"))
    assert text.startswith("# r1: validated") and "| files | PASS |" in text
    again = release.build(spark, str(corpus), "data", str(tmp_path), "r1", files=9)
    assert {r.name for r in again.where("not passed").collect()} == {"files"}
    assert release.current(spark, str(tmp_path), "r1") != place and read("documents").count() == 7  # what was published before stays
    with pytest.raises(ValueError):
        release.build(spark, str(corpus), "data", str(tmp_path), "r2", pattern="*.pdf")
    assert not (tmp_path / "r2").exists()


def test_each_file_is_extracted_once_and_a_failure_keeps_the_old_release(spark, corpus, tmp_path, monkeypatch):
    log = str(tmp_path / "extracted.log")

    def extractor(content):
        with open(log, "a") as f:
            f.write("x")
        return extract.plain(content)

    release.build(spark, str(corpus), "data", str(tmp_path), "r1", extractor=extractor)
    assert Path(log).read_text() == "x" * 8  # nine files, two of them of one content
    before = release.current(spark, str(tmp_path), "r1")

    def fails(*_):
        raise OSError("full")

    with monkeypatch.context() as m:
        m.setattr(writers, "publish", fails)
        with pytest.raises(OSError):
            release.build(spark, str(corpus), "data", str(tmp_path), "r1")
    assert release.current(spark, str(tmp_path), "r1") == before and spark.read.parquet(f"{before}/chunks").count() > 0
    release.build(spark, str(corpus), "data", str(tmp_path), "r1")
    writers.retire(spark, f"{tmp_path}/r1")
    assert not Path(before).exists() and spark.read.parquet(f"{release.current(spark, str(tmp_path), 'r1')}/chunks").count() > 0
    with pytest.raises(FileNotFoundError):
        release.current(spark, str(tmp_path), "r9")


def test_every_check_can_fail(spark, corpus, tmp_path):
    """A sound release, and changed copies of its tables that each fail one check and no other."""
    release.build(spark, str(corpus), "data", str(tmp_path), "r1")
    place = release.current(spark, str(tmp_path), "r1")
    sound = {n: spark.read.parquet(f"{place}/{n}") for n in ("documents", "lines", "sections", "chunks", "review_queue")}

    def failed(**changed):
        t = sound | changed
        rows = checks.release_checks(t["documents"], t["lines"], t["sections"], t["chunks"], t["review_queue"], 8, 8).collect()
        assert len(rows) == 13
        return {r.name for r in rows if not r.passed}

    d, s, c = sound["documents"], sound["sections"], sound["chunks"]
    first = lambda df, key: df.where(F.col(key) == df.agg(F.min(key)).first()[0])
    article = F.col("section_type") == "statute_article"
    key = lambda value: F.col("metadata").withField("article_key", value)
    assert failed() == set()
    assert failed(documents=d.withColumn("path_aliases", F.array("source_file"))) == {"files"}
    assert failed(documents=d.withColumn("page_count", F.lit(1))) == {"pages"}
    assert failed(documents=d.unionByName(first(d, "document_id").withColumn("page_count", F.lit(0)).withColumn("path_aliases", F.array().cast("array<string>")))) == {"unique document_id"}
    assert failed(sections=s.unionByName(first(s, "section_id"))) == {"unique section_id", "quotes rebuilt"}
    assert failed(chunks=c.unionByName(first(c, "chunk_id"))) == {"unique chunk_id"}
    assert failed(chunks=c.withColumn("section_id", F.when(F.col("chunk_id") == first(c, "chunk_id").first().chunk_id, "x").otherwise(F.col("section_id")))) == {"chunk to section"}
    assert failed(documents=d.withColumn("document_id", F.when(F.col("document_type") == "precedent", "x").otherwise(F.col("document_id")))) == {"section to document"}
    assert failed(sections=s.withColumn("source_spans", F.transform("source_spans", lambda x: x.withField("char_end", x["char_end"] + 1)))) == {"spans legal", "quotes rebuilt"}
    assert failed(sections=s.withColumn("quote_text", F.concat("quote_text", F.lit("!")))) == {"quotes rebuilt"}
    assert failed(sections=s.withColumn("metadata", key(F.substring_index("metadata.article_key", "-", 1)))) == {"sub-articles exist"}
    assert failed(sections=s.withColumn("metadata", key(F.when(article & (F.col("ordinal") == 2), None).otherwise(F.col("metadata.article_key"))))) == {"articles have keys"}
    assert failed(chunks=c.withColumn("index_eligible", F.lit(None).cast("boolean"))) == {"eligibility set"}


def test_summary_and_lines(spark, corpus):
    found = readers.files(spark, str(corpus), "*.txt")
    listed = release.inventory(found, "data")
    paged = extract.pages(found.join(listed.select("path", "document_id"), "path")).join(listed.select("path", "document_id"), "path")
    got = {r.category: (r.files, r.documents, r.pages) for r in release.summary(listed, paged).collect()}
    assert got["相關法規"] == (3, 2, 3) and got["其他"] == (2, 2, 1)
    rows = extract.lines(paged).where(F.col("path").endswith("/a.txt")).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(11)) and rows[3].text == "第 1 條" and (rows[3].page, rows[3].line, rows[3].char_end) == (1, 4, 5)


def test_knowledge_and_analysis(spark, corpus, tmp_path):
    """From files over a release and a written knowledge base to the answers for two appeals."""
    release.build(spark, str(corpus), "data", str(tmp_path), "r1")
    counts = analysis.save_knowledge(spark, release.current(spark, str(tmp_path), "r1"), str(tmp_path / "kb"))
    assert counts == {"decisions": 2, "statutes": 6, "refs": 2}
    assert analysis.load_knowledge(spark, str(tmp_path / "none")) is None
    kb = analysis.load_knowledge(spark, str(tmp_path / "kb"))
    articles = {(r.name, r.num): r for r in kb["statutes"].collect()}
    assert articles["廢棄物清理法", "27"].content == "不得隨地拋棄垃圾。" and articles["廢棄物清理法", "27-1"].content == "（刪除）"
    assert {(n, r.amend_year) for (n, _), r in articles.items()} == {("廢棄物清理法", 112), ("訴願法", None)}
    decisions = {r.case_no: r for r in kb["decisions"].collect()}
    assert (decisions["1121"].result, decisions["1122"].result) == ("駁回", "撤銷") and decisions["1121"].related == ["廢棄物清理法 第 27、50 條", "訴願法 第 79 條"]
    refs = {r.kind: r for r in kb["refs"].collect()}
    assert set(refs) == {"interpretation", "precedent"} and refs["precedent"].topic == "某題"
    text = "訴願人：李四，因違反廢棄物清理法，不服新北市政府環境保護局處分。111 年 5 月隨地拋棄垃圾，113 年 1 月處分。"
    given = readers.requests(spark, [{"full_text": text}, {"full_text": "x", "case_type": "違反建築法事件", "facts": "違建"}])
    out = analysis.analyse(analysis.incoming(given), kb, str(tmp_path / "answers"))
    got = {name: df.collect() for name, df in out.items()}
    best = [(r.rank, r.name, r.num, r.content) for r in sorted(got["statutes"], key=lambda r: r.rank) if r.query_id == 0]
    assert best[0] == (1, "廢棄物清理法", "27", "不得隨地拋棄垃圾。") and len({x[1:3] for x in best}) == len(best)
    alert = {r.query_id: r for r in got["alerts"]}
    assert alert[0].triggered and alert[0].changed == ["廢棄物清理法（修正於民國112年）"] and not alert[1].triggered
    similar = {(r.query_id, r.rank): r for r in got["similar"]}
    assert similar[0, 1].result == "駁回" and similar[0, 1].similarity > similar[0, 2].similarity and similar[0, 1].shared[0] == "廢棄物清理法-27"
    assert {(r.result, r.type) for (q, _), r in similar.items() if q == 1} == {("撤銷", 1.0), ("駁回", 0.0)}
    assert {(r.query_id, r.result, r.total) for r in got["outcomes"]} == {(q, x, 2) for q in (0, 1) for x in ("駁回", "撤銷")}
    draft = {r.query_id: r for r in got["drafts"]}
    assert "廢棄物清理法第 27 條：「不得隨地拋棄垃圾。」" in draft[0].reason and "三、⚠️" in draft[0].reason and ".txt" not in draft[0].reason and "50%" in draft[0].reason
    assert {r.query_id for r in got["refs"]} == {0, 1}


def test_exports(spark, tmp_path):
    drafts = spark.createDataFrame([(0, "題", "template", {"案號": "1", "人": None}, "主", "事", None)], "query_id long, title string, note string, meta map<string,string>, main string, fact string, reason string")
    writers.draft_export(drafts, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out/query_id=0").glob("part-*"))
    assert text.startswith("# 題\n\ntemplate\n\n- 人：\n- 案號：1\n\n## 主文\n\n主\n\n## 事實")
    assert writers.json_array(drafts.select("query_id", "reason"), str(tmp_path / "array")) == 1
    assert json.loads("".join(p.read_text() for p in (tmp_path / "array").glob("part-*"))) == [{"query_id": 0, "reason": None}]
