"""Fields of an incoming appeal as Column expressions, and keys of spans."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import case_type, first_match, tidy

#: The labels and bounds by which fields are found.
APPELLANT = r"(?U)訴願人[\s：:]*([^\s，,。\n（(]{1,10})"
AUTHORITY = r"(?U)(?:原處分機關|處分機關)[\s：:]*([^\s，,。\n（(]{1,20})"
CITY_OFFICE = r"(?U)(新北市政府[^\s，,。\n]{0,10}局)"
DISPOSITION = r"(?U)([一-鿿]*字第\s*[\d\-]+\s*號(?:裁處書|處分書)?)"
FACTS = r"(?Us)事\s*實(.{20,600}?)(?:理\s*由|$)"
CLAIMS = r"(?Us)訴願(?:意旨|理由)略?謂[：:]?(.{10,300})"
YEAR = r"(\d{2,3})\s*年"
FIRST_YEAR, LAST_YEAR = 90, 130
FACTS_CHARS, CLAIMS_CHARS = 400, 300


def years(c: Column) -> Column:
    """All plausible Minguo years that a text names, in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(found, lambda y: y.between(FIRST_YEAR, LAST_YEAR))


def incoming(text: Column) -> Column:
    """struct of the fields that rules find in an appeal's text; null where none is found or text is null."""
    first = lambda pattern: tidy(first_match(text, pattern))
    return F.struct(
        case_type(text).alias("case_type"),
        first(APPELLANT).alias("appellant"),
        F.coalesce(first(AUTHORITY), first(CITY_OFFICE)).alias("original_authority"),
        first(DISPOSITION).alias("disposition_no"),
        F.substring(first(FACTS), 1, FACTS_CHARS).alias("facts"),
        F.substring(first(CLAIMS), 1, CLAIMS_CHARS).alias("claims"),
        F.array_min(years(text)).alias("behavior_date_roc"),
        F.array_max(years(text)).alias("disposition_date_roc"),
    )


def spans_key(spans: Column, fields: list[str]) -> Column:
    """Each span's fields joined by ':', the spans by ';'."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *(s[f].cast("string") for f in fields))), ";")
