"""A folder of files as a linked, checked release: eight tables, a manifest and a report.

Each content is read once, under its first path; other paths of it are its aliases.  Tables are written one from another, so
a file is extracted once and a document cut once, and counted while they are written.  A release that is complete and checked is
published by a pointer; until then readers get the one before.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import annotate, checks, chunks, segment
from docweave.sources import extract, readers, writers

SCHEMA = "1.0"


def inventory(found: DataFrame, root: str) -> DataFrame:
    """(document_id, sha256, path, aliases, category, document_type): one row for each content."""
    rows = readers.copies(found)
    kind = readers.category(F.col("path"), root)
    document_id = F.concat(F.lit("doc_"), F.substring("sha256", 1, 16))
    return rows.select(document_id.alias("document_id"), "sha256", "path", "aliases", kind.alias("category"), T.folder_type(kind).alias("document_type"))


def summary(inventoried: DataFrame, paged: DataFrame) -> DataFrame:
    """(category, files, documents, pages) of an inventory and its documents' pages."""
    n = paged.where("error is null").groupBy("document_id").agg(F.count("*").alias("pages"))
    rows = inventoried.join(n, "document_id", "left").groupBy("category")
    return rows.agg(F.sum(F.size("aliases")).alias("files"), F.count("*").alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))


def tables(found: DataFrame, root: str, extractor: Callable[[bytes], list] = extract.plain, keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> dict[str, DataFrame]:
    """The tables of a release, by name, of found(path, sha256, content); `failed` has the files that could not be read.

    keep(name, df) may write a table and return what was written; others are made from that.
    """
    listed = keep("inventory", inventory(found, root))
    first = found.join(listed.select("path", "document_id", "document_type"), "path")
    paged = keep("extracted", extract.pages(first, extractor).join(listed.select("path", "document_id", "document_type"), "path"))
    rows = keep("lines", extract.lines(paged, "document_id").join(listed.select("document_id", "document_type"), "document_id"))
    titles = paged.where("page = 1 and document_type = 'statute'").select("document_id", T.statute_title(F.col("raw_text"), F.col("path")).alias("statute_name"))
    sections = keep("sections", segment.segment(rows, titles))
    per = sections.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "section_id"))), lambda x: x["section_id"]).alias("section_ids"))
    n = paged.where("error is null").groupBy("document_id").agg(F.count("*").cast("int").alias("page_count"))
    none = F.array().cast("array<string>")
    documents = listed.join(n, "document_id").join(per, "document_id", "left").select(
        F.lit(SCHEMA).alias("schema_version"), "document_id", F.lit(None).cast("string").alias("case_family_id"), "document_type", T.subtype(F.col("document_type"), F.col("path")).alias("document_subtype"),
        F.col("path").alias("source_file"), F.col("sha256").alias("source_sha256"), F.lit("official_batch").alias("source_origin"), "page_count", F.lit(segment.EXTRACTION).alias("extraction_version"),
        F.lit("unreviewed").alias("review_status"), F.coalesce("section_ids", none).alias("section_ids"), F.col("aliases").alias("path_aliases"),
    )
    documents = keep("documents", documents)
    low = F.length(segment.bare(F.col("raw_text"))) < annotate.LOW_TEXT
    pages = paged.where("error is null").select("document_id", F.lit(segment.EXTRACTION).alias("extraction_version"), "page", "width", "height", "rotation", "raw_text", "lines", F.lit("text_layer").alias("extraction_method"), F.when(low, "needs_review").otherwise("unreviewed").alias("review_status"))
    pages = keep("pages", pages)
    other = listed.select("document_id", F.col("sha256").alias("duplicate_of_sha256"), F.explode(F.slice("aliases", 2, 1 << 30)).alias("path"))
    articles = sections.where("section_type = 'statute_article'").select("metadata.statute_name", "metadata.article_key", F.col("section_id").alias("target_id"))
    made = {
        "chunks": chunks.make_chunks(sections), "annotations": annotate.annotations(documents, rows), "citations": annotate.resolved(annotate.citations(rows), articles),
        "duplicates": other.select("*", F.lit("identical_hash").alias("relation"), F.lit("aliased_not_reextracted").alias("resolution")),
        "review_queue": annotate.review_queue(pages, segment.uncovered(rows, sections)), "failed": paged.where("error is not null").select("path", "error"),
    }
    return {"documents": documents, "pages": pages, "sections": sections, "lines": rows, **{name: keep(name, df) for name, df in made.items()}}


def build(spark: SparkSession, source: str, root: str, target: str, version: str, pattern: str = "*.txt", files: int | None = None, pages: int | None = None, extractor: Callable[[bytes], list] = extract.plain) -> DataFrame:
    """Make and publish the release `version` of the files below source; returns its checks(name, passed, detail).

    files and pages are what its maker expects to be there.  A folder without files is an error, and nothing
    is written.  `current` gives the folder of what was published last; earlier ones stay until `writers.retire`.
    """
    found = readers.files(spark, source, pattern)
    made = uuid.uuid4().hex[:16]
    place, seen = f"{target}/{version}/{made}", {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        watch = Observation()
        df.observe(watch, *checks.measures(name)).write.parquet(f"{place}/{name}")
        seen[name] = watch.get
        return spark.read.schema(df.schema).parquet(f"{place}/{name}")

    read = tables(found, root, extractor, keep)
    result = checks.release_checks(read["documents"], read["lines"], read["sections"], read["chunks"], read["review_queue"], files, pages, seen)
    result.coalesce(1).write.parquet(f"{place}/checks")
    result = spark.read.parquet(f"{place}/checks")
    status = checks.gate(result)
    writers.manifest(spark, {name: m["n"] for name, m in seen.items()}, f"{place}/manifest", version, status)
    writers.report_files(result, f"{place}/report", version, status)
    writers.publish(spark, f"{target}/{version}", made)
    return result


def current(spark: SparkSession, target: str, version: str) -> str:
    """The folder of a published release."""
    place = writers.current(spark, f"{target}/{version}")
    if place is None:
        raise FileNotFoundError(f"no release {version} below {target}")
    return place
