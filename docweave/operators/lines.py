"""Lines and sections of texts, with their place of origin."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 1, line): the lines that hold more than spaces and tabs."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1).where(F.trim(F.translate("line", "\t\r", "  ")) != "")


def sections(rows: DataFrame, heading: Column) -> DataFrame:
    """(doc_id, section, heading, first_line, n_lines, quote, spans): each heading opens a section.

    Lines before the first heading are section 0.  The quote joins the section's lines in order;
    spans (line_no, char_start, char_end) name them.
    """
    run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("is_heading", heading).withColumn("section", F.sum(F.col("is_heading").cast("long")).over(run))
    marked = marked.groupBy("doc_id", "section").agg(
        F.min(F.when(F.col("is_heading"), F.col("line"))).alias("heading"), F.min("line_no").alias("first_line"),
        F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all"),
    )
    spans = F.transform("all", lambda x: F.struct(x["line_no"].alias("line_no"), F.lit(0).alias("char_start"), F.length(x["line"]).alias("char_end")))
    return marked.withColumn("quote", F.array_join(F.col("all.line"), "\n")).withColumn("spans", spans).drop("all")
