"""Sinks: releases of JSON lines with a manifest, reports, and full-text pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def release(spark: SparkSession, tables: dict[str, DataFrame], folder: str, version: str, checks: DataFrame | None = None) -> DataFrame:
    """Write each table as Parquet below folder/version, then the manifest of row counts.

    The manifest comes last, so a release without one is not complete.  Its status is that of the
    checks(name, passed): validated or partial; 'draft' without any.  Counts are taken from the
    written tables, so nothing is computed twice.
    """
    status = "draft"
    if checks is not None:
        status = "validated" if checks.where("not coalesce(passed, false)").isEmpty() else "partial"
    written = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
        written[name] = spark.read.parquet(f"{folder}/{version}/{name}")
    return manifest(spark, written, f"{folder}/{version}/manifest", version, status)


def manifest(spark: SparkSession, tables: dict[str, DataFrame | int], path: str, version: str, status: str) -> DataFrame:
    """Write the row counts of tables, or counts that are known, with the release's status as JSON lines."""
    counts = [(version, name, df if isinstance(df, int) else df.count(), status) for name, df in tables.items()]
    made = spark.createDataFrame(counts, "version string, name string, n_rows long, status string")
    made.coalesce(1).write.mode("overwrite").json(path)
    return made


def json_array(df: DataFrame, path: str) -> int:
    """Write a small table as one JSON array in a text file; returns the number of its rows.

    The rows come together in one task, in the order of their JSON, so this is for tables that people read.
    """
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ",\n"), F.lit("]")).alias("value")).write.mode("overwrite").text(path)
    return df.count()


def report(checks: DataFrame) -> str:
    """The checks(name, passed[, detail]), of which there are few, as a Markdown table."""
    given = [c for c in ("detail",) if c in checks.columns]
    rows = checks.select("name", "passed", *given).orderBy("name").collect()
    head = ["check", "result", *given]
    body = [[r.name, "PASS" if r.passed else "FAIL", *(r[c] or "" for c in given)] for r in rows]
    return "\n".join(f"| {' | '.join(x)} |" if x is not None else "|" + "-|" * len(head) for x in (head, None, *body)) + "\n"


def report_files(checks: DataFrame, folder: str, version: str, status: str) -> None:
    """The report of a release as JSON lines and as Markdown."""
    spark = checks.sparkSession
    checks.select(F.lit(version).alias("version"), F.lit(status).alias("status"), *checks.columns).coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    text = f"# {version}: {status}\n\n{report(checks)}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")


def _listed(spark: SparkSession, base: str) -> tuple:
    """The file system, the folder, and its pointers (number, id) in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []
    return fs, place, sorted((int(n), i) for _, n, i in (x.split("-", 2) for x in names if x.startswith("_at-")))


def publish(spark: SparkSession, base: str, made: str) -> None:
    """Make base/made what readers of `base` get: an empty file is created whose name says so, and that is all that readers look at.

    Until then they get the release before, which is not touched.  Two that publish at the same time can't both have one number.
    """
    fs, place, known = _listed(spark, base)
    n = known[-1][0] + 1 if known else 0
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(place, f"_at-{n:08d}-{made}"), False).close()


def current(spark: SparkSession, base: str) -> str | None:
    """The folder that was published last below `base`, None before the first time."""
    known = _listed(spark, base)[2]
    return f"{base}/{known[-1][1]}" if known else None


def retire(spark: SparkSession, base: str, keep: int = 1) -> None:
    """Remove all published folders but the last `keep`, pointers first, so that none points to a folder that is gone."""
    fs, place, known = _listed(spark, base)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for n, made in known[: max(0, len(known) - max(1, keep))]:
        fs.delete(path(place, f"_at-{n:08d}-{made}"), False)
        fs.delete(path(place, made), True)


def escaped(c: Column) -> Column:
    """For HTML text: & and < replaced."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def page(title: Column, body: Column) -> Column:
    """A full-text page of a title and a body; null counts as empty."""
    t, b = (escaped(F.coalesce(c, F.lit(""))) for c in (title, body))
    return F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), t, F.lit("</title><h1>"), t, F.lit("</h1><pre>"), b, F.lit("</pre>"))


def draft_export(drafts: DataFrame, path: str) -> None:
    """One text file for each of drafts(query_id, title, note, meta map, main, fact, reason), in a folder of its id.

    Markdown with a title, a note on how it was made, the metadata and three sections.
    """
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda x: F.concat(F.lit("- "), x["key"], F.lit("："), F.coalesce(x["value"], F.lit("")))), "\n")
    parts = [F.concat(F.lit("# "), "title"), F.col("note"), meta, *[F.concat(F.lit(f"## {label}\n\n"), F.coalesce(c, F.lit(""))) for c, label in (("main", "主文"), ("fact", "事實"), ("reason", "理由"))]]
    drafts.select("query_id", F.concat_ws("\n\n", *parts).alias("value")).write.mode("overwrite").partitionBy("query_id").text(path)
