"""Sections checked against the lines that their spans name."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebuilt(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, section, n_spans, bad_spans, same) of sections(doc_id, section, quote, spans).

    A span (line_no, char_start, char_end) is bad if lines(doc_id, line_no, line) lack its line or
    it is not inside the line.  `same`: the other spans' texts, joined by line ends in the
    spans' order, are the quote.  Both sides are shuffled on (doc_id, line_no).
    """
    spans = sections.select("doc_id", "section", F.posexplode_outer("spans").alias("at", "span"))
    spans = spans.select("doc_id", "section", "at", F.col("span.line_no").alias("line_no"), F.col("span.char_start").alias("lo"), F.col("span.char_end").alias("hi"))
    met = spans.join(lines.select("doc_id", "line_no", "line"), ["doc_id", "line_no"], "left")
    legal = F.coalesce(F.expr("lo >= 0 and lo <= hi and hi <= length(line)"), F.lit(False))
    met = met.withColumn("part", F.when(legal, F.expr("substring(line, lo + 1, hi - lo)")))
    parts = met.groupBy("doc_id", "section").agg(
        F.count("at").alias("n_spans"), F.count_if(F.col("at").isNotNull() & F.col("part").isNull()).alias("bad_spans"),
        F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("at", "part")))).alias("parts"),
    )
    both = parts.join(sections.select("doc_id", "section", "quote"), ["doc_id", "section"])
    return both.select("doc_id", "section", "n_spans", "bad_spans", (F.array_join("parts.part", "\n") == F.col("quote")).alias("same"))
