"""Readers, writers, intake fields and spans on small fixtures."""
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docweave.functions import intake
from docweave.operators import spans
from docweave.sources import lookup, readers, writers


def test_files(spark, tmp_path):
    root = tmp_path / "data"
    (root / "laws").mkdir(parents=True)
    (root / "laws/a.txt").write_text("one\ftwo")
    (root / "laws/b.txt").write_text("one\ftwo")
    (root / "c.txt").write_text("x")
    (root / "empty.txt").write_text("")
    found = readers.files(spark, str(root))
    assert sorted((r.page, r.text) for r in readers.pages(found).collect()) == [(1, "one"), (1, "one"), (1, "x"), (2, "two"), (2, "two")]
    assert sorted((r.n_pages, r.text) for r in readers.texts(found).collect()) == [(1, "x"), (2, "onetwo"), (2, "onetwo")]
    assert sorted(len(r.aliases) for r in readers.copies(found).collect()) == [1, 2]
    kinds = found.select(readers.category(F.col("path"), "data").alias("k")).collect()
    assert sorted(r.k for r in kinds) == ["laws", "laws", "unknown"]
    with pytest.raises(ValueError):
        readers.files(spark, str(root), "*.pdf")


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": null}]')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert [r.x for r in readers.json_array(spark, str(tmp_path / "a.json"), "x int").collect()] == [1, None]
    rows = readers.json_lines(spark, str(tmp_path / "b.jsonl"), "x int")
    writers.json_lines(rows.withColumn("t", F.lit("第")), str(tmp_path / "out"))
    got = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert [json.loads(x)["x"] for x in got.splitlines()] == [1, 2] and "第" in got
    asked = readers.requests(spark, [{"facts": "f"}, {}]).collect()
    assert [(r.query_id, r.facts) for r in asked] == [(0, "f"), (1, None)]


def test_release(spark, tmp_path):
    checks = spark.createDataFrame([("b", True), ("a", False)], "name string, passed boolean")
    got = writers.release(spark, {"t": spark.range(3)}, str(tmp_path), "v1", checks).collect()
    assert [tuple(r) for r in got] == [("v1", "t", 3, "partial")]
    assert writers.report(checks).splitlines()[2:] == ["| a | FAIL |", "| b | PASS |"]
    page = spark.range(1).select(writers.page(F.lit("a<b"), F.lit(None).cast("string")).alias("p")).first().p
    assert "<h1>a&lt;b</h1><pre></pre>" in page


def test_intake(spark):
    text = "訴願人：王小明，原處分機關 新北市政府環境保護局。民國112年起，113 年 5 月 北環字第 12-3 號裁處書\n事 實 " + "甲" * 30 + "\n理 由\n訴願意旨略謂：" + "乙" * 400
    rows = spark.createDataFrame([(0, text), (1, None), (2, "新北市政府工務局 於 1999 年 以 50 年")], "i int, x string")
    a, b, c = (r.y for r in rows.select("i", intake.incoming(F.col("x")).alias("y")).orderBy("i").collect())
    assert (a.appellant, a.original_authority, a.disposition_no) == ("王小明", "新北市政府環境保護局", "北環字第 12-3 號裁處書")
    assert (a.facts, a.claims, a.behavior_date_roc, a.disposition_date_roc) == ("甲" * 30, "乙" * 300, 112, 113)
    assert set(b) == {None}
    assert (c.original_authority, c.behavior_date_roc) == ("新北市政府工務局", None)


def test_spans(spark):
    lines = spark.createDataFrame([(1, 1, "abc"), (1, 2, "de")], "doc_id int, line_no int, line string")
    kind = "doc_id int, section int, quote string, spans array<struct<line_no:int,char_start:int,char_end:int>>"
    rows = [(1, 1, "abc\nd", [(1, 0, 3), (2, 0, 1)]), (1, 2, "abc", [(1, 0, 4), (3, 0, 1)]), (1, 3, "", [])]
    got = spans.rebuilt(spark.createDataFrame(rows, kind), lines).orderBy("section").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 2, 0, True), (2, 2, 2, False), (3, 0, 0, True)]
    key = spark.createDataFrame(rows, kind).select(intake.spans_key(F.col("spans"), ["line_no", "char_end"]).alias("k")).first().k
    assert key == "1:3;2:1"


def test_broken_records_are_set_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2\n{"a": "no number"}\n{"b": null}\n')
    good, bad = readers.checked_lines(spark, str(tmp_path / "a.jsonl"), "a long, b string")
    assert sorted(map(str, good.collect())) == sorted(["Row(a=1, b='x')", "Row(a=None, b=None)"])
    assert {(r.record, r.reason) for r in bad.collect()} == {('{"a": 2', "no JSON"), ('{"a": "no number"}', "not of the schema")} and all(r.file.endswith("a.jsonl") for r in bad.collect())
    (tmp_path / "arrays").mkdir()
    (tmp_path / "arrays/x.json").write_text('[{"a": 1}, {"a": "z"},\n {"a": 3}]')
    (tmp_path / "arrays/y.json").write_text("[1, 2")
    good, bad = readers.checked_arrays(spark, str(tmp_path / "arrays"), "a long")
    assert sorted(r.a for r in good.collect()) == [1, 3]
    assert {(r.file[-6:], r.reason) for r in bad.collect()} == {("x.json", "not of the schema"), ("y.json", "no JSON array")}


def test_lookup_skips_row_groups(spark, tmp_path):
    place = str(tmp_path / "t")
    lookup.save(spark.range(10_000).selectExpr("concat('k', id) as k", "id as v").union(spark.sql("select null, -1")).repartition(4), "k", place, rows=500)
    groups = [pq.ParquetFile(f) for f in (tmp_path / "t").glob("*.parquet")]
    assert max(f.metadata.row_group(g).num_rows for f in groups for g in range(f.metadata.num_row_groups)) <= 500
    found = lookup.find(spark, place, "k", ["k77", "k78", "absent", None])
    assert sorted(r.v for r in found.collect()) == [77, 78]
    scanned = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert scanned <= 1000
    ids = spark.range(3000).selectExpr("concat('k', id) as k")
    assert lookup.find(spark, place, "k", ids).count() == 3000 and lookup.find(spark, place, "k", ids.limit(5)).count() == 5 and lookup.find(spark, place, "k", []).count() == 0
