"""Filter interaction audit with wide packed counters.

Which document a chain of filters removes at which step depends on the order of the filters, but for one document it
depends on nothing else than the mask of the filters that it fails.  So every mask (with two bits for its labels) is mapped to
one wide integer: a field for each measure of each step of each order, 1 where a document of that mask counts there.  The
integers of a part are added up, equal ones as a product with their number, and the sum is cut
into its fields again.  A field has 64 bits and no sum exceeds the number of rows, so none runs over into the next.

Masks are made in Spark from the texts; what is shuffled of a document is its mask, id and text digest, and before the
integers are added up rows are counted for each part and mask, so a part gives a task 128 rows however large it is.
"""
from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import empty_text, fresh, met, passing, saved, table

#: Measures that have a field for each step; the last two look at the labels.
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: More filters than these have too many orders for a row of each step.
MOST_FILTERS = 6
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "part string, filter_order string, step int, filter string, " + ", ".join(f"{m} long" for m in MEASURES) + ", shapley long"


def text_filters() -> dict[str, Column | None]:
    """The five filters of the audit as failure conditions on `text`; None stands for repeats of a smaller doc_id's text."""
    text = empty_text()
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * upper > 10 * F.length(text), "D": text.rlike("[#$%&*|]"), "E": None,
    }


def wide(mask: int, good: bool, toxic: bool, orders: list[tuple[int, ...]]) -> int:
    """The integer of one mask: fields [measure, order, step], 1 where a document that fails `mask` counts."""
    out = np.zeros((len(MEASURES), len(orders), len(orders[0])), "<u8")
    for o, order in enumerate(orders):
        gone = False
        for s, f in enumerate(order):
            fails = mask >> f & 1
            removed = fails and not gone
            gone = gone or fails
            out[:, o, s] = not gone, removed, fails and not removed, mask == 1 << f, removed and good, removed and toxic
    return int.from_bytes(out.tobytes(), "little")


def fields(total: int, shape: tuple[int, ...]) -> np.ndarray:
    """The fields of a sum of such integers."""
    return np.frombuffer(total.to_bytes(8 * int(np.prod(shape)), "little"), "<u8").reshape(shape).astype(np.int64)


def _unpacked(letters: str):
    orders = list(permutations(range(len(letters))))
    shape = (len(MEASURES), len(orders), len(letters))
    names = ["".join(letters[f] for f in order) for order in orders]
    filters = np.array(orders)
    known: dict[int, int] = {}

    def integer(code: int) -> int:
        if code not in known:
            labels = code >> len(letters)
            known[code] = wide(code & (1 << len(letters)) - 1, bool(labels & 1), bool(labels & 2), orders)
        return known[code]

    def run(rows: pa.Table) -> pa.Table:
        total = sum(integer(c) * n for c, n in zip(rows["code"].to_pylist(), rows["n"].to_pylist(), strict=True))
        got = fields(total, shape)
        removed = np.bincount(filters.ravel(), got[1].ravel(), len(letters)).astype(np.int64)
        n = filters.size
        cols = [pa.array([rows["part"][0].as_py()] * n), pa.array(np.repeat(names, len(letters))), pa.array(np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders)))]
        cols += [pa.array([letters[f] for f in filters.ravel()]), *(pa.array(x.ravel()) for x in got), pa.array(removed[filters.ravel()])]
        return pa.table(cols, [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None] | None = None) -> DataFrame:
    """Rows of SCHEMA: for each part (lang; null is ''), order of the filters and step, what the step's filter does.

    filters gives each letter its failure condition on docs; None is the failure of rows whose text a smaller doc_id has
    anywhere in the table.  labels(doc_id, quality, toxic): a document is good or toxic if any of its rows says 1.
    shapley is the sum of a filter's removals over all orders.

    Null texts are empty, also as repeats; a condition that is null is not failed.  A row without doc_id repeats nothing, is
    repeated by nothing and has no labels.  Rows that share doc_id and text count one by one and
    don't repeat each other.  A very long text is handled whole.  An empty table gives no rows; labels may be empty.
    Other columns are ignored.
    """
    filters = text_filters() if filters is None else filters
    letters = "".join(filters)
    if not 0 < len(filters) <= MOST_FILTERS or len(letters) != len(set(letters)) or len(letters) != len(filters):
        raise ValueError(f"one to {MOST_FILTERS} filters, each with a letter of its own")
    bit = lambda c, k: F.when(c, 1 << k).otherwise(0)
    mask = sum((bit(c, k) for k, c in enumerate(filters.values()) if c is not None), F.lit(0))
    repeats = sum(1 << k for k, c in enumerate(filters.values()) if c is None)
    (part,) = fresh(docs, "part")
    with passing(docs.sparkSession):
        rows = docs.withColumn(part, F.coalesce(F.col("lang").cast("string"), F.lit("")))
        rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(part).alias("part"), mask.alias("mask"), F.sha2(empty_text(), 256).alias("digest"))
        rows = saved(rows, "masks")
        first = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
        marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
        rows = met(met(rows, saved(first, "firsts"), "digest", "left"), saved(marks, "marks"), "doc_id", "left")
        n = len(letters)
        code = F.col("mask") + F.when(F.col("doc_id") > F.col("least"), repeats).otherwise(0) + bit(F.col("good"), n) + bit(F.col("toxic"), n + 1)
        counts = saved(rows.groupBy("part", code.alias("code")).agg(F.count("*").alias("n")), "counts", keep=True)
    return counts.groupBy("part").applyInArrow(_unpacked(letters), SCHEMA)


def op11_wide_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ORDERS = ", ".join(f"x{k} as (select * from letters)" for k in range(1, 6))
ORACLE = {
    "op11_wide_counters": f"""
with w as (select coalesce(lang, '') as part, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
lo as (select t, min(doc_id) as least from w group by t),
m as (select part, (case when len(ws) < 100 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 2 else 0 end) + (case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) then 4 else 0 end)
 + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > least then 16 else 0 end) as mask, coalesce(doc_id in (select doc_id from labels where quality = 1), false) as good, coalesce(doc_id in (select doc_id from labels where toxic = 1), false) as toxic from w join lo using (t)),
g as (select part, mask, good, toxic, count(*) as n from m group by all),
letters(c, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), {_ORDERS},
orders as (select x1.c || x2.c || x3.c || x4.c || x5.c as filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] as bs from x1, x2, x3, x4, x5 where x1.b + x2.b + x3.b + x4.b + x5.b = 31 and len(list_distinct([x1.b, x2.b, x3.b, x4.b, x5.b])) = 5),
steps as (select filter_order, s as step, filter_order[s] as filter, bs[s] as bit, coalesce(list_sum(bs[1 : s - 1]), 0)::bigint as before from orders, generate_series(1, 5) as gs(s)),
r as (select part, filter_order, step, filter, coalesce(sum(n) filter (where mask & before = 0 and mask & bit = 0), 0) as kept, coalesce(sum(n) filter (where mask & before = 0 and mask & bit > 0), 0) as removed, coalesce(sum(n) filter (where mask & before > 0 and mask & bit > 0), 0) as redundant,
 coalesce(sum(n) filter (where mask = bit), 0) as unique_fails, coalesce(sum(n) filter (where mask & before = 0 and mask & bit > 0 and good), 0) as good_lost, coalesce(sum(n) filter (where mask & before = 0 and mask & bit > 0 and toxic), 0) as toxic_lost from g, steps group by part, filter_order, step, filter)
select part, filter_order, cast(step as integer) as step, filter, {', '.join(f'cast({c} as bigint) as {c}' for c in MEASURES)}, cast(sum(removed) over (partition by part, filter) as bigint) as shapley from r"""
}
