"""Documents cut into sections by the headings of their type, in one pass over the lines.

lines(document_id, document_type, idx, page, line, text, ...) are numbered from 0 within a document; their order is
idx.  Every line of a document of a known type ends up in exactly one section.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import rules as R
from docweave.functions.text import CN, article_key, stable_id, strip

EXTRACTION, SEGMENTATION = "ext-1.0", "seg-1.0"
#: What a line has to be to open an article or a chapter, and how deleted articles read.
ARTICLE_TITLE = rf"(?U)^第\s*(?:\d+(?:\s*-\s*\d+)?|{CN}(?:\s*之\s*{CN})?)\s*條(?:\s*之\s*{CN})?\s*$"
CHAPTER_TITLE = r"(?U)^第\s*[一二三四五六七八九十百]+\s*[章節編款]"
DELETED = r"(?U)（\s*刪\s*除\s*）|删除|刪除"
FIRST_TYPES = {"statute": "preamble", "decision": "decision_header", "interpretation": "interpretation_header", "precedent": "precedent_header"}
SPAN = ("document_id", "extraction_version", "page", "line", "char_start", "char_end")


def is_article_title(text: Column) -> Column:
    return strip(text).rlike(ARTICLE_TITLE)


def is_chapter_title(text: Column) -> Column:
    return strip(text).rlike(CHAPTER_TITLE)


def bare(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s", "")


def heading_role(text: Column) -> Column:
    """The role of a decision's heading: the line is the heading and nothing else."""
    return F.coalesce(*[F.when(bare(text) == label, F.lit(role)) for role, label in R.DECISION_HEADINGS.items()])


def marker(text: Column, markers: list[str]) -> Column:
    """The first marker that the line is, with or without a colon, or with a colon and one sign more."""
    t = bare(text)
    return F.coalesce(*[F.when((t == m) | (t == m + "：") | (t.startswith(m + "：") & (F.length(t) <= len(m) + 2)), F.lit(m)) for m in markers])


def headings(lines: DataFrame) -> DataFrame:
    """Add `mark`, what a line opens by the rules of its document's type; null for other lines."""
    kind, text = F.col("document_type"), F.col("text")
    found = F.when(kind == "statute", F.when(is_article_title(text), "statute_article")).when(kind == "decision", heading_role(text))
    found = found.when(kind == "interpretation", marker(text, R.INTERPRETATION_MARKERS)).when(kind == "precedent", marker(text, R.PRECEDENT_MARKERS))
    return lines.withColumn("mark", found)


def cut(marked: DataFrame, by: str, order: str, every: Column) -> DataFrame:
    """Add `cut` and `part` to rows with `mark`: marks open a part, all of them where `every`, else the first of each kind.

    part counts the cuts up to a row, so rows before the first one have part 0.
    """
    first = F.min(order).over(Window.partitionBy(by, "mark"))
    opened = F.col("mark").isNotNull() & (every | (F.col(order) == first))
    run = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("cut", opened).withColumn("part", F.sum(F.col("cut").cast("int")).over(run))


def carried(value: Column, by: str, order: str) -> Column:
    """The last value that is not null, at the row or before it."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def segment(lines: DataFrame, statute_names: DataFrame | None = None) -> DataFrame:
    """(section_id, document_id, segmentation_version, section_type, ordinal, source_spans, quote_text, metadata, review_status, first_idx, end_idx).

    Statutes are cut at each article title; an article takes the chapter heading last seen, at its title or before.
    Other types are cut at the first of each heading; rulings without any are one unsectioned section.  Lines
    before the first cut are the header.  Documents of other types have no sections.  statute_names(document_id,
    statute_name) fills the metadata.
    """
    known = lines.where(F.col("document_type").isin(*FIRST_TYPES))
    # All windows and the sections of a document are made where its lines are: they move once.
    rows = cut(headings(known.repartition("document_id")), "document_id", "idx", F.col("document_type") == "statute")
    rows = rows.withColumn("chapter", carried(F.when(is_chapter_title(F.col("text")), strip(F.col("text"))), "document_id", "idx"))
    of = Window.partitionBy("document_id")
    rows = rows.withColumn("parts", F.max("part").over(of)).withColumn("headed", F.max((F.col("part") == 0).cast("int")).over(of))
    spans = F.struct(*[F.lit(EXTRACTION).alias(c) if c == "extraction_version" else F.col(c) for c in SPAN])
    line = F.struct("idx", "text", "cut", spans.alias("span"))
    once = [F.first(c).alias(c) for c in ("document_type", "parts", "headed")]
    title = lambda c: F.max(F.when(F.col("cut"), F.col(c)))
    got = rows.groupBy("document_id", "part").agg(*once, title("mark").alias("mark"), title("text").alias("title"), title("chapter").alias("chapter"), F.array_sort(F.collect_list(line)).alias("all"))
    kind, statute = F.col("document_type"), F.col("document_type") == "statute"
    opening = F.when(kind.isin("interpretation", "precedent") & (F.col("parts") == 0), "unsectioned")
    for t, name in FIRST_TYPES.items():
        opening = opening.when(kind == t, name)
    section_type = F.when(F.col("part") == 0, opening).when(statute, F.col("mark")).otherwise(F.concat_ws("_", kind, "mark"))
    body = F.array_join(F.transform(F.filter("all", lambda x: ~x["cut"]), lambda x: x["text"]), "")
    gone = body.rlike(DELETED) & (F.length(strip(body)) < 10)
    article = F.col("part") > 0
    if statute_names is None:
        got = got.withColumn("statute_name", F.lit(None).cast("string"))
    else:
        got = got.join(statute_names.select("document_id", "statute_name"), "document_id", "left")
    metadata = F.struct(
        F.when(statute, F.col("statute_name")).alias("statute_name"), F.when(statute & article, article_key(strip(F.col("title")))).alias("article_key"),
        F.when(statute & article, strip(F.col("title"))).alias("article_no_raw"), F.when(statute & article, F.col("chapter")).alias("chapter"),
        F.when(statute & article, F.when(gone, "deleted").otherwise("active")).alias("article_status"), F.lit(None).cast("boolean").alias("is_current"),
        F.when((kind == "decision") & article, F.col("mark")).alias("section_role"), F.when(kind.isin("interpretation", "precedent") & article, F.col("mark")).alias("marker"),
    )
    ordinal = F.col("part") + F.col("headed")
    section_id = stable_id("sec_", F.col("document_id"), F.lit(EXTRACTION), F.lit(SEGMENTATION), ordinal.cast("string"))
    return got.select(
        section_id.alias("section_id"), "document_id", F.lit(SEGMENTATION).alias("segmentation_version"), section_type.alias("section_type"), ordinal.cast("int").alias("ordinal"),
        F.transform("all", lambda x: x["span"]).alias("source_spans"), F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("quote_text"),
        metadata.alias("metadata"), F.lit("unreviewed").alias("review_status"), F.col("all")[0]["idx"].alias("first_idx"), (F.element_at("all", -1)["idx"] + 1).alias("end_idx"),
    )


def uncovered(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Lines that are not blank and in no section of sections(document_id, first_idx, end_idx).

    Ends of sections and lines are swept in order, a running sum tells how many sections are open: a row for each section and line,
    however long and however overlapping the sections are.  Columns of lines that nothing reads afterwards do not move.
    """
    step, after = fresh(lines, "step", "after")
    of = lines.where(bare(F.col("text")) != "").select("*", F.lit(0).alias(step), F.lit(1).alias(after))
    ends = sections.where("first_idx < end_idx").select("document_id", F.explode(F.array(F.struct(F.col("first_idx").alias("i"), F.lit(1).alias("d")), F.struct(F.col("end_idx").alias("i"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.select("document_id", F.col("e.i").alias("idx"), F.col("e.d").alias(step), F.lit(0).alias(after))
    run = Window.partitionBy("document_id").orderBy("idx", after).rowsBetween(Window.unboundedPreceding, 0)
    swept = of.unionByName(ends, allowMissingColumns=True).withColumn(step, F.sum(step).over(run))
    return swept.where((F.col(after) == 1) & (F.col(step) == 0)).select(*lines.columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has."""
    known = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(known) + 1)) if n not in known) for name in names]
