"""Checks of a release: keys, references, spans, quotes and counts, as rows (name, passed, detail).

Each check is an aggregate or an anti join; what comes together is a row for each check.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import rebuilt


def _row(name: str, passed: Column, detail: Column):
    return [F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail")]


def total(name: str, df: DataFrame, value: Column, expected: int | None) -> DataFrame:
    """An aggregate against what is expected; without an expectation it is only reported."""
    n = F.coalesce(F.col("n"), F.lit(0))
    passed = F.lit(True) if expected is None else n == expected
    return df.agg(value.alias("n")).select(*_row(name, passed, F.concat(F.lit("n="), n.cast("string"), F.lit(f" expected={expected}"))))


def unique(name: str, df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("k")).select(*_row(name, F.col("n") == F.col("k"), F.format_string("n=%d keys=%d", "n", "k")))


def none(name: str, df: DataFrame, bad: Column, word: str) -> DataFrame:
    """No row is bad."""
    return df.agg(F.count_if(bad).alias("n")).select(*_row(name, F.col("n") == 0, F.format_string(f"{word}=%d", "n")))


def refers(name: str, df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    loose = df.join(other.select(key), key, "left_anti")
    return loose.agg(F.count("*").alias("n")).select(*_row(name, F.col("n") == 0, F.format_string("dangling=%d", "n")))


#: What is counted of each table of a release while it is written; sums of nothing are null.
METRICS = {
    "documents": lambda: {"files": F.sum(F.size("path_aliases")), "pages": F.sum("page_count")},
    "sections": lambda: {"branches": F.count_if(_article() & F.col("metadata.article_key").contains("-")), "without_key": F.count_if(_article() & F.col("metadata.article_key").isNull())},
    "chunks": lambda: {"unset": F.count_if(F.col("index_eligible").isNull())},
    "review_queue": lambda: {"uncovered": F.count_if(F.col("issue_type") == "uncovered_line")},
}


def _article() -> Column:
    return F.col("section_type") == "statute_article"


def measures(name: str) -> list[Column]:
    """Aggregates for `observe` or `agg` of a release's table: its rows, and what METRICS has for it."""
    return [F.count("*").alias("n"), *(c.alias(k) for k, c in METRICS.get(name, dict)().items())]


def counted(seen: dict[str, dict], files: int | None = None, pages: int | None = None) -> list[tuple[str, bool, str]]:
    """(name, passed, detail) of the checks that counts decide; seen has the measures of METRICS' tables."""
    of = lambda table, key: seen[table][key] or 0
    rows = [(name, expected is None or of("documents", name) == expected, f"n={of('documents', name)} expected={expected}") for name, expected in (("files", files), ("pages", pages))]
    branches, without, unset, loose = (of(*x) for x in (("sections", "branches"), ("sections", "without_key"), ("chunks", "unset"), ("review_queue", "uncovered")))
    return [*rows, ("sub-articles exist", branches > 0, f"n={branches}"), ("articles have keys", without == 0, f"without={without}"), ("uncovered lines reported", True, f"n={loose} expected=None"), ("eligibility set", unset == 0, f"unset={unset}")]


def linked(documents: DataFrame, lines: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, passed, detail) of the checks that need joins or distinct counts: keys, references, spans and quotes."""
    at = F.col("page") * F.lit(1 << 32) + F.col("line")
    spans = sections.select(F.col("document_id").alias("doc_id"), F.col("section_id").alias("section"), F.col("quote_text").alias("quote"), F.transform("source_spans", lambda s: F.struct((s["page"] * F.lit(1 << 32) + s["line"]).alias("line_no"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end"))).alias("spans"))
    built = rebuilt(spans, lines.select(F.col("document_id").alias("doc_id"), at.alias("line_no"), F.col("text").alias("line")))
    # One pass over the spans gives both of their checks.
    bad, off = F.coalesce(F.sum("bad_spans"), F.lit(0)), F.count_if(~F.col("same"))
    both = built.agg(bad.alias("bad"), off.alias("off")).select(F.expr("stack(2, 'spans legal', bad = 0, concat('illegal=', bad), 'quotes rebuilt', off = 0, concat('mismatch=', off)) as (name, passed, detail)"))
    parts = [
        unique("unique document_id", documents, "document_id"), unique("unique section_id", sections, "section_id"), unique("unique chunk_id", chunks, "chunk_id"),
        refers("chunk to section", chunks, "section_id", sections), refers("section to document", sections, "document_id", documents), both,
    ]
    return reduce(DataFrame.unionByName, parts)


def release_checks(documents: DataFrame, lines: DataFrame, sections: DataFrame, chunks: DataFrame, review: DataFrame, files: int | None = None, pages: int | None = None, seen: dict[str, dict] | None = None) -> DataFrame:
    """(name, passed, detail) of a release's tables; files and pages are the counts that its maker expects.

    seen has the tables' measures if they were taken while the tables were written; else each table is counted here.
    """
    if seen is None:
        given = {"documents": documents, "sections": sections, "chunks": chunks, "review_queue": review}
        seen = {name: df.agg(*measures(name)).first().asDict() for name, df in given.items()}
    rows = documents.sparkSession.createDataFrame(counted(seen, files, pages), "name string, passed boolean, detail string")
    return rows.unionByName(linked(documents, lines, sections, chunks))


def gate(checks: DataFrame) -> str:
    """'validated' if all checks pass, else 'partial'."""
    return "validated" if checks.where("not coalesce(passed, false)").isEmpty() else "partial"
