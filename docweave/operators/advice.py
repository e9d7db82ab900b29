"""Statutes, references and alerts for many appeals at once.

Every function takes and gives tables keyed by query_id, so one job answers all appeals.  An article is (name, num), num being
its key with its branch, such as 27-1.  Wordings of alerts and drafts are fixed values.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import rules as R

from .retrieval import top

KEY = ["query_id", "name", "num"]


def case_weights(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, name, num, weight): what the hits cite, each hit worth 1 / its rank, the sum scaled by the query's highest.

    hits(query_id, doc_id, rank from 1), cited(doc_id, name, num) with repeats counted.
    """
    sums = hits.join(cited, "doc_id").groupBy(*KEY).agg(F.sum(1 / F.col("rank")).alias("w"))
    most = sums.groupBy("query_id").agg(F.max("w").alias("most"))
    return sums.join(most, "query_id").select(*KEY, (F.col("w") / F.col("most")).alias("weight"))


def fused(cases: DataFrame, words: DataFrame, parents: DataFrame, procedural: Column, w_case: float = 0.5, w_words: float = 0.3, w_parent: float = 0.2, w_procedural: float = 0.15) -> DataFrame:
    """(query_id, name, num, score): both sources' scores added up for each article that either has.

    cases(KEY, weight), words(KEY, score), parents(query_id, parent).  Articles of the query's parent statute
    rise, but none becomes a candidate by that alone; procedural ones count w_procedural of their score.
    """
    both = cases.select(*KEY, (w_case * F.col("weight")).alias("part")).unionByName(words.select(*KEY, (w_words * F.col("score")).alias("part")))
    sums = both.groupBy(*KEY).agg(F.sum("part").alias("score")).join(parents.select("query_id", "parent"), "query_id", "left")
    risen = F.col("score") + F.when(F.col("name") == F.col("parent"), w_parent).otherwise(0.0)
    return sums.select(*KEY, F.round(risen * F.when(procedural, w_procedural).otherwise(1.0), 4).alias("score"))


def recommend(scores: DataFrame, known: DataFrame, k: int = 6, place: str = "doc_id") -> DataFrame:
    """The k best articles of each query among those that known(name, num, ...) has, with its other columns and rank from 1.

    What has no source text is dropped before the k are taken; of two sources the last by `place` counts.
    """
    last = known.groupBy("name", "num").agg(F.max_by(F.struct(*[c for c in known.columns if c not in ("name", "num")]), place).alias("x")).select("name", "num", "x.*")
    found = scores.join(last, ["name", "num"]).withColumn("tie", F.struct("name", "num"))
    return top(found, ["query_id"], "score", "tie", k).drop("tie")


def is_procedural(name: Column) -> Column:
    return name.isin(R.PROCEDURAL_IN_ADVICE)


def alerts(appeals: DataFrame, recommended: DataFrame, amended: DataFrame) -> DataFrame:
    """(query_id, triggered, message, behavior, disposition, changed): whether a recommended statute changed in between.

    appeals(query_id, behavior, disposition) in years, recommended(query_id, name, rank), amended(name, year).  A
    statute changed if its year is beyond the earlier of both years and not beyond the later; statutes are
    named once, in the order of their best rank.  Without both years nothing is compared.
    """
    once = recommended.groupBy("query_id", "name").agg(F.min("rank").alias("rank")).join(amended.groupBy("name").agg(F.min("year").alias("year")), "name")
    b, d = F.col("behavior"), F.col("disposition")
    near = appeals.join(once, "query_id").where((F.least(b, d) < F.col("year")) & (F.col("year") <= F.greatest(b, d)) & b.isNotNull() & d.isNotNull())
    note = F.concat("name", F.lit("（修正於民國"), F.col("year").cast("string"), F.lit("年）"))
    found = near.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", note.alias("note")))), lambda x: x["note"]).alias("changed"))
    rows = appeals.join(found, "query_id", "left").withColumn("changed", F.coalesce("changed", F.array().cast("array<string>")))
    bad, same, hit = b.isNull() | d.isNull() | (b == 0) | (d == 0), b == d, F.size("changed") > 0
    years = lambda text: F.format_string(text, b, d)
    message = F.when(bad, "未能取得行為時或處分時之年度，無法自動比對新舊法。建議承辦人手動確認法規版本。")
    message = message.when(same, F.format_string("行為時與處分時同為民國%d年，無新舊法變更之從新從輕適用問題。", b))
    message = message.when(hit, F.concat(years("⚠️ 從新從輕提示（行政罰法第5條）：本案行為時為民國%d年、處分時為民國%d年，期間下列法規曾修正，須比較新舊法擇最有利於受處罰者適用："), F.array_join("changed", "；"), F.lit("。")))
    message = message.otherwise(years("行為時（民國%d年）與處分時（民國%d年）不同，惟目前推薦法規於該期間內未偵測到修正。仍建議承辦人依行政罰法第5條確認有無新舊法適用問題。"))
    triggered = ~bad & ~same & hit
    changed = F.when(triggered, F.col("changed")).otherwise(F.array().cast("array<string>"))
    return rows.select("query_id", triggered.alias("triggered"), message.alias("message"), "behavior", "disposition", changed.alias("changed"))


def drafts(appeals: DataFrame, recommended: DataFrame, outcomes: DataFrame, alert: DataFrame) -> DataFrame:
    """(query_id, fact, reason, main, mode): the draft that a template makes of an appeal and what was found for it.

    appeals as `sources.readers.REQUEST`, recommended(query_id, rank, source, statute_name, article_no, content),
    outcomes(query_id, total, result, ratio) of the most common result, alert(query_id, triggered, message).
    """
    or_else = lambda c, text: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(text))
    fact = F.concat(
        F.lit("緣訴願人"), or_else("appellant", "○○○"), F.lit("因"), or_else("case_type", "違規事件"), F.lit("，不服"), or_else("original_authority", "原處分機關"), F.lit("所為之處分（"),
        or_else("disposition_no", "（處分書文號）"), F.lit("），提起訴願。事實摘要如下：\n"), or_else("facts", "（請補充違規事實）"),
    )
    line = F.concat("statute_name", "article_no", F.lit("：「"), F.trim("content"), F.lit("」"))
    block = recommended.where("source = 'statute'").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))
    rows = appeals.join(block, "query_id", "left").join(alert.select("query_id", "triggered", "message"), "query_id", "left").join(outcomes, "query_id", "left")
    # The percentage is cut, not rounded.
    tendency = F.format_string("歷史相似案件中，%s佔 %d%%（共%d件）。", "result", (F.col("ratio") * 100 + 1e-9).cast("int"), "total")
    reason = F.concat_ws(
        "\n", F.lit("一、按下列規定："), or_else("block", "（請補充適用法規）"), F.lit("\n二、本案分析："), F.concat(F.lit("訴願人主張："), or_else("claims", "（略）")), F.lit("（請承辦人依上開法規涵攝本案事實補充分析）"),
        F.when(F.col("triggered"), F.concat(F.lit("\n三、"), "message")), F.when(F.col("total") > 0, F.concat(F.lit("\n（參考）"), tendency)),
    )
    return rows.select("query_id", fact.alias("fact"), reason.alias("reason"), F.lit("（請承辦人確認主文）").alias("main"), F.lit("template").alias("mode"))
