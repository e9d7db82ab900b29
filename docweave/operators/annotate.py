"""Facts, citations and review items drawn from lines, each with the span it stands on."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import rules as R
from docweave.functions.text import CN, article_key, file_hint, first_match, roc_date, strip

from . import scan
from .segment import EXTRACTION, SPAN, bare

#: How the fields of decisions are labelled, and how far each is trusted.
FIELDS = {
    "case_no": (r"(?U)案\s*號[：:]\s*(\S+)", 0.8), "doc_no": (r"(?U)發文字號[：:]\s*(\S+)", 0.8), "decision_date": (r"(?U)發文日期[：:]\s*([^\n]+)", None),
    "appellant": (r"(?U)訴願人[：\s]+([^\s，,、]+)", 0.6), "original_authority": (r"(?U)原處分機關[：\s]+([^\s，,、]+)", 0.6),
}
#: A cited article behind a statute's name, the branch before or behind 條.
CITED = rf"第\s*(?:\d+(?:-\d+)?|{CN}(?:之{CN})?)\s*條"
LOW_TEXT = 20


def span() -> Column:
    return F.struct(*[F.lit(EXTRACTION).alias(c) if c == "extraction_version" else F.col(c) for c in SPAN])


def fact(value: Column, spans: Column, confidence: Column) -> Column:
    """A fact with its spans; the reason is given only where the value is missing."""
    some = value.isNotNull()
    return F.struct(
        value.alias("value"), F.when(some, spans).otherwise(F.array().cast(SPANS)).alias("source_spans"), F.when(some, confidence).otherwise(F.lit(0.0)).alias("confidence"),
        F.lit("rule").alias("extraction_method"), F.lit("unreviewed").alias("review_status"), F.when(~some, F.lit("not_stated")).alias("missing_reason"),
    )


SPANS = "array<struct<document_id:string,extraction_version:string,page:int,line:int,char_start:int,char_end:int>>"


def first_facts(lines: DataFrame, patterns: dict[str, str], by: str = "document_id", order: str = "idx", *more: str) -> DataFrame:
    """(by, NAME struct(idx, value, more...)) for each pattern: its capture in the first line that matches; null without one.

    One conditional aggregate for all fields, so each document's lines are read once and combined before the shuffle.
    """
    one = lambda p: F.min_by(F.when(F.col("text").rlike(p), F.struct(F.col(order).alias("idx"), F.regexp_extract("text", p, 1).alias("value"), *more)), F.when(F.col("text").rlike(p), F.col(order)))
    return lines.groupBy(by).agg(*[one(p).alias(name) for name, p in patterns.items()])


def decision_fields(lines: DataFrame) -> DataFrame:
    """(document_id, fields) of decisions: five facts of their text."""
    rows = lines.where("document_type = 'decision'").withColumn("span", span())
    got = first_facts(rows, {k: p for k, (p, _) in FIELDS.items()}, "document_id", "idx", "span")
    made = []
    for name, (_, trust) in FIELDS.items():
        value, spans = F.col(f"{name}.value"), F.array(F.col(f"{name}.span")).cast(SPANS)
        if trust is None:
            date = roc_date(strip(value))
            made.append(fact(F.when(value.isNotNull(), date), spans, F.when(date["precision"] == "day", 0.8).otherwise(0.5)).alias(name))
        else:
            made.append(fact(value, spans, F.lit(trust)).alias(name))
    return got.select("document_id", F.struct(*made).alias("fields"))


def annotations(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """(document_id, filename_hint, fields) of decisions; the hint is no fact, as it comes from the file name alone."""
    hints = documents.where("document_type = 'decision'").select("document_id", file_hint(F.col("source_file")).alias("filename_hint"))
    return hints.join(decision_fields(lines), "document_id", "left")


def citations(lines: DataFrame, names: list[str] | DataFrame = R.CITED_STATUTES, aliases: dict[str, str] = R.ALIASES) -> DataFrame:
    """(source_document_id, citation_raw, statute_name, article_key, source_spans): statutes with an article, line by line.

    A table of names(name), of which there may be very many, is looked for by an automaton, a short list by a pattern.
    """
    rows = lines.withColumn("span", span()).select("document_id", "span", "text")
    if isinstance(names, DataFrame):
        rows = scan.followed_names(rows, names, CITED)
    else:
        pattern = "(?U)(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + ")" + CITED
        rows = rows.withColumn("raw", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    name = first_match(F.col("raw"), "(?U)^(.*?)" + CITED)
    for variant, stands in aliases.items():
        name = F.when(name == variant, F.lit(stands)).otherwise(name)
    return rows.select(F.col("document_id").alias("source_document_id"), F.col("raw").alias("citation_raw"), name.alias("statute_name"), article_key(F.col("raw"), branch_before=True).alias("article_key"), F.array("span").alias("source_spans"))


def resolved(cited: DataFrame, articles: DataFrame, on: tuple[str, ...] = ("statute_name", "article_key")) -> DataFrame:
    """Citations with target_id and resolved, by articles(*on, target_id); the smallest id where several have one key."""
    one = articles.groupBy(*on).agg(F.min("target_id").alias("target_id"))
    out = cited.join(one, list(on), "left")
    return out.withColumn("resolved", F.when(F.col("target_id").isNull(), "unresolved").otherwise("resolved"))


def review_queue(pages: DataFrame, loose: DataFrame) -> DataFrame:
    """Items for people: pages with hardly any text, and lines in no section (`segment.uncovered`)."""
    n = F.length(bare(F.col("raw_text")))
    place = lambda page, line, a, b: F.array(F.struct(F.col("document_id"), F.lit(EXTRACTION).alias("extraction_version"), page.alias("page"), line.alias("line"), a.alias("char_start"), b.alias("char_end"))).cast(SPANS)
    zero = F.lit(0)
    low = pages.where(n < LOW_TEXT).select(
        F.format_string("%s-p%d-lowtext", "document_id", "page").alias("item_id"), "document_id", place(F.col("page"), zero, zero, zero).alias("source_spans"), F.lit("low_text_page").alias("issue_type"),
        F.when(n == 0, "high").otherwise("medium").alias("severity"), F.format_string("非空白字元=%d，須人工視覺判定是否影像頁/需 OCR", n).alias("note"),
    )
    lines = loose.select(
        F.format_string("%s-line-%d-uncovered", "document_id", "idx").alias("item_id"), "document_id", place(F.col("page"), F.col("line"), F.col("char_start"), F.col("char_end")).alias("source_spans"),
        F.lit("uncovered_line").alias("issue_type"), F.lit("medium").alias("severity"), F.substring("text", 1, 60).alias("note"),
    )
    none = [F.lit(None).cast("string").alias(c) for c in ("resolution", "reviewer", "reviewed_at")]
    return low.unionByName(lines).select("item_id", "document_id", "source_spans", "issue_type", "severity", F.lit("open").alias("status"), *none, "note")
