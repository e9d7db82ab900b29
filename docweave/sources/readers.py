"""Sources: folders of text files, JSON lines, JSON arrays, and requests given by hand."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PAGE_BREAK = "\f"

REQUEST = "query_id long, source_file string, case_type string, appellant string, original_authority string, disposition_no string, facts string, claims string, full_text string"


def category(path: Column, root: str) -> Column:
    """The folder directly below `root` in a path, 'unknown' where there is none."""
    below = F.split(F.element_at(F.split(path, f"/{root}/"), -1), "/")
    return F.when(path.contains(f"/{root}/") & (F.size(below) > 1), F.element_at(below, 1)).otherwise("unknown")


def files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, sha256, n_bytes, content) of all files below a folder; no file at all is an error.

    Spark gives no row for a file of no bytes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    if raw.isEmpty():
        raise ValueError(f"no {pattern} below {folder}")
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"), "content")


def _utf8() -> Column:
    return F.try_validate_utf8(F.col("content").cast("string"))


def pages(found: DataFrame) -> DataFrame:
    """(path, page from 1, text) of UTF-8 text files, cut at form feeds; files in other codes have no pages."""
    text = _utf8()
    rows = found.select("path", F.posexplode(F.split(text, PAGE_BREAK)).alias("page", "text"))
    return rows.withColumn("page", F.col("page") + 1)


def texts(found: DataFrame) -> DataFrame:
    """(path, n_pages, text): the pages of each file end to end; null for files that are not UTF-8."""
    parts = F.split(_utf8(), PAGE_BREAK)
    return found.select("path", F.size(parts).alias("n_pages"), F.array_join(parts, "").alias("text"))


def copies(found: DataFrame) -> DataFrame:
    """(sha256, path, aliases): the first path of each content, with all its paths in order."""
    paths = found.groupBy("sha256").agg(F.array_sort(F.collect_list("path")).alias("aliases"))
    return paths.select("sha256", F.element_at("aliases", 1).alias("path"), "aliases")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a file of JSON lines; empty lines are left out."""
    return spark.read.schema(schema).json(path)


def _schema(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def checked_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of files of JSON lines: the lines that fit the schema, and (file, record, reason) of those that do not.

    Empty lines are neither.  A line is read once by each of the two, and a broken one stops nothing.
    """
    mark = "_broken"
    kind = StructType([*_schema(schema).fields, StructField(mark, StringType())])
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record")).where(F.trim("record") != "")
    read = raw.withColumn("r", F.from_json("record", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark}))
    broken = F.col("r").isNull() | F.col(f"r.{mark}").isNotNull()
    reason = F.when(F.try_parse_json("record").isNull(), "no JSON").otherwise("not of the schema")
    return read.where(~broken).select("r.*").drop(mark), read.where(broken).select("file", "record", reason.alias("reason"))


def checked_arrays(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of files that hold one JSON array each: items that fit the schema; (file, record, reason) of other items, and of files that are no array."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))
    items = F.try_variant_get(F.try_parse_json("record"), "$", "array<variant>")
    read = raw.withColumn("items", items)
    no_array = read.where("items is null").select("file", F.substring("record", 1, 1000).alias("record"), F.lit("no JSON array").alias("reason"))
    mark = "_broken"
    kind = StructType([*_schema(schema).fields, StructField(mark, StringType())])
    each = read.where("items is not null").select("file", F.explode("items").alias("item")).select("file", F.to_json("item").alias("record"))
    each = each.withColumn("r", F.from_json("record", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark}))
    broken = F.col("r").isNull() | F.col(f"r.{mark}").isNotNull()
    bad = each.where(broken).select("file", "record", F.lit("not of the schema").alias("reason"))
    return each.where(~broken).select("r.*").drop(mark), bad.unionByName(no_array)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def requests(spark: SparkSession, given: list[dict]) -> DataFrame:
    """Requests as rows of REQUEST, numbered from 0; keys that are missing are null."""
    names = [c.split()[0] for c in REQUEST.split(", ")]
    return spark.createDataFrame([tuple({"query_id": i, **g}.get(n) for n in names) for i, g in enumerate(given)], REQUEST)
