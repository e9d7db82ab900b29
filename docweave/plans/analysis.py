"""Knowledge base of a corpus, and what it tells about incoming appeals, many at once."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docweave.functions import intake
from docweave.functions import rules as R
from docweave.functions import text as T
from docweave.operators import advice, cases
from docweave.operators import retrieval as S
from docweave.operators import segmenter
from docweave.sources.shared import exists, written

TABLES = ("decisions", "statutes", "refs")


def knowledge(texts: DataFrame, sections: DataFrame) -> dict[str, DataFrame]:
    """decisions, statutes and refs of texts(document_id, document_type, path, text) and a release's sections.

    An article's num is its key with its branch, such as 27-1.  Each table has a doc_id and an index_text; statutes have their
    place (path, ordinal) in the corpus, by which the last of true doubles counts.
    """
    d = texts.where("document_type = 'decision'").select("path", "text", T.file_hint(F.col("path")).alias("hint"), T.three_sections(F.col("text")).alias("s"), T.related_lines(F.col("text")).alias("related"))
    case_no = F.coalesce(T.labelled(F.col("text"), "案　　號"), T.tidy(T.first_match(F.col("text"), r"案號[：:]\s*(\d+)")), F.concat_ws("-", "hint.kind", "hint.year", "hint.seq"))
    decisions = d.select(F.xxhash64("path").alias("doc_id"), case_no.alias("case_no"), "path", F.col("hint.kind").alias("case_type"), F.col("hint.result").alias("result"), F.col("hint.year").alias("year"), T.labelled(F.col("text"), "要　　旨").alias("summary"), "related", "s.*")
    decisions = decisions.withColumn("index_text", T.decision_index_text(*[F.col(c) for c in ("case_type", "summary", "related", "facts", "reasons")]))
    amended = texts.where("document_type = 'statute'").select("document_id", "path", F.coalesce(T.labelled(F.col("text"), "修正日期"), T.labelled(F.col("text"), "公布日期")).alias("amend_date"))
    a = sections.where("section_type = 'statute_article'").join(amended, "document_id", "left")
    content = T.tidy(F.regexp_replace("quote_text", r"^[^\n]*\n?", ""))
    statutes = a.select(F.xxhash64("section_id").alias("doc_id"), F.col("metadata.statute_name").alias("name"), F.col("metadata.article_key").alias("num"), F.col("metadata.article_no_raw").alias("article_no"), F.col("metadata.chapter").alias("chapter"), content.alias("content"), "amend_date", T.roc_year(F.col("amend_date")).alias("amend_year"), F.struct("path", "ordinal").alias("place"))
    statutes = statutes.withColumn("index_text", T.statute_index_text(F.col("name"), F.col("article_no"), F.col("content")))
    i = texts.where("document_type = 'interpretation'").select("path", "text", T.interpretation_fields(F.col("text")).alias("f"))
    i = i.select(F.xxhash64("path").alias("doc_id"), F.lit("interpretation").alias("kind"), F.col("f.issuing_authority").alias("authority"), F.col("f.doc_no").alias("number"), F.col("f.summary").alias("summary"), T.tidy(F.col("text")).alias("content"))
    p = texts.where("document_type = 'precedent'").select("path", "text", T.precedent_fields(F.col("path")).alias("f"))
    p = p.select(F.xxhash64("path").alias("doc_id"), F.lit("precedent").alias("kind"), F.col("f.court").alias("authority"), F.col("f.case_no").alias("number"), F.col("f.topic").alias("topic"), T.tidy(F.col("text")).alias("content"))
    refs = i.unionByName(p, allowMissingColumns=True)
    refs = refs.withColumn("index_text", T.reference_index_text(*[F.col(c) for c in ("authority", "topic", "summary", "content")]))
    return {"decisions": decisions, "statutes": statutes, "refs": refs}


def release_texts(spark: SparkSession, release: str) -> DataFrame:
    """(document_id, document_type, path, text) of a release's documents: their pages end to end."""
    pages = spark.read.parquet(f"{release}/pages").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "raw_text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["raw_text"]), "\n").alias("text")
    return spark.read.parquet(f"{release}/documents").select("document_id", "document_type", F.col("source_file").alias("path")).join(pages.select("document_id", text), "document_id")


def save_knowledge(spark: SparkSession, release: str, place: str) -> dict[str, int]:
    """Build the knowledge base of a release and write its tables below `place`; returns their row counts, taken while they are written."""
    counts = {}
    for name, df in knowledge(release_texts(spark, release), spark.read.parquet(f"{release}/sections")).items():
        seen = Observation()
        df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{place}/{name}")
        counts[name] = seen.get["n"]
    return counts


def load_knowledge(spark: SparkSession, place: str) -> dict[str, DataFrame] | None:
    """The tables of a saved knowledge base, None if one of them is missing."""
    if not all(exists(spark, f"{place}/{name}/_SUCCESS") for name in TABLES):
        return None
    return {name: spark.read.parquet(f"{place}/{name}") for name in TABLES}


def learned_split(kb: dict[str, DataFrame]):
    """A `split` for `analyse` by words that are learned from the index texts of the whole knowledge base."""
    texts = reduce(DataFrame.union, (kb[name].select(F.col("index_text").alias("text")) for name in TABLES))
    return segmenter.splitter(written(segmenter.learned(segmenter.strings(texts)), "words"))


def incoming(given: DataFrame) -> DataFrame:
    """given(query_id, full_text, ...) with what its text tells wherever no value is given by hand."""
    got = given.withColumn("found", intake.incoming(F.col("full_text")))
    names = ("case_type", "appellant", "original_authority", "disposition_no", "facts", "claims")
    kept = [F.coalesce(*([F.nullif(F.col(n), F.lit(""))] if n in given.columns else []), F.col(f"found.{n}")).alias(n) for n in names]
    return got.select("query_id", *kept, "full_text", F.col("found.behavior_date_roc").alias("behavior"), F.col("found.disposition_date_roc").alias("disposition"))


def analyse(appeals: DataFrame, kb: dict[str, DataFrame], place: str | None = None, split=S.mixed_words, k_statutes: int = 6, k_refs: int = 3, k_similar: int = 5) -> dict[str, DataFrame]:
    """statutes, refs, alerts, similar, outcomes and drafts of appeals as `incoming` gives them, each written below `place`.

    Decisions are searched once, for the largest number of hits that any step needs.  What several steps read, all of it a
    few rows for each query, is written between them, so no plan holds another.  Without a place the shared folder is taken.
    """
    keep = lambda name, df: written(df, name, place)
    appeals = keep("appeals", appeals)
    index = lambda t: kb[t].select("doc_id", F.col("index_text").alias("text"))
    whole = appeals.select("query_id", T.query_text(*[F.col(c) for c in ("case_type", "facts", "claims", "full_text")]).alias("text"))
    brief = appeals.select("query_id", T.query_text(*[F.col(c) for c in ("case_type", "facts", "claims")]).alias("text"))
    pool = keep("pool", S.search(index("decisions"), whole, 40, 0.6, split))
    lines = kb["decisions"].select("doc_id", F.explode("related").alias("line"))
    # A line names no branches, so its numbers are keys of their own.
    cited = lambda anchored: lines.select("doc_id", F.explode(T.statute_articles(F.col("line"), anchored)).alias("x")).select("doc_id", "x.name", F.col("x.num").cast("string").alias("num"))
    known = kb["statutes"].select("name", "num", "doc_id", "article_no", "content", "amend_date", "place")
    words = S.search(index("statutes"), whole, 15, 0.5, split).join(known.select("doc_id", "name", "num"), "doc_id")
    words = words.groupBy("query_id", "name", "num").agg(F.max("score").alias("score"))  # doubles of an article count once
    parents = appeals.select("query_id", T.parent_statute(F.col("case_type")).alias("parent"))
    scores = advice.fused(advice.case_weights(pool.where("rank <= 5"), cited(True)), words, parents, advice.is_procedural(F.col("name")))
    statutes = keep("statutes", advice.recommend(scores, known, k_statutes, "place").drop("place").withColumn("source", F.lit("statute")))
    refs = S.search(index("refs"), brief, k_refs, 0.6, split).join(kb["refs"], "doc_id")
    refs = keep("refs", refs.select("query_id", "rank", "doc_id", F.col("kind").alias("source"), F.coalesce("authority", F.lit("")).alias("statute_name"), F.coalesce("number", F.lit("")).alias("article_no"), T.snippet(F.col("summary"), F.col("content")).alias("content"), F.round("score", 4).alias("score")))
    alert = keep("alerts", advice.alerts(appeals.select("query_id", "behavior", "disposition"), statutes, kb["statutes"].where("amend_year is not null").select("name", F.col("amend_year").alias("year"))))
    key = F.concat_ws("-", "name", "num")
    parsed = appeals.select("query_id", F.explode(T.statute_articles(F.col("full_text"))).alias("x")).select("query_id", F.concat_ws("-", "x.name", F.col("x.num").cast("string")).alias("key"))
    procedural = F.substring_index("key", "-", 1).isin(R.PROCEDURAL_IN_CASES)
    asked = cases.weighted(cases.query_keys(statutes.select("query_id", key.alias("key")), parsed), procedural)
    have = keep("keys", cases.weighted(cited(False).select("doc_id", key.alias("key")), procedural))
    kind = F.coalesce("case_type", F.lit("")).alias("kind")
    similar = cases.similar(asked, have, pool, None, appeals.select("query_id", kind), kb["decisions"].select("doc_id", kind), k_similar)
    similar = keep("similar", similar.join(kb["decisions"].select("doc_id", "path", "case_type", "result", "year", F.coalesce("summary", F.substring("facts", 1, 120)).alias("summary")), "doc_id"))
    outcomes = keep("outcomes", cases.distribution(similar))
    named = statutes.select("query_id", "rank", "source", F.col("name").alias("statute_name"), "article_no", "content")
    drafts = keep("drafts", advice.drafts(appeals, named, outcomes.where("place = 1").select("query_id", "result", "ratio", "total"), alert))
    return {"statutes": statutes, "refs": refs, "alerts": alert, "similar": similar, "outcomes": outcomes, "drafts": drafts}
