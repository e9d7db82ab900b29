"""Rows by id from a table that is laid out for it: sorted by id in small row groups, each with a Bloom filter of its ids."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a row group, and ids that are written into a scan's filter; more ids are joined.
ROWS, LISTED = 4096, 1000


def save(df: DataFrame, key: str, place: str, rows: int = ROWS) -> None:
    """Write df so that `find` reads few row groups for an id: ranges of ids for each file, and filters for ids that are no numbers in order."""
    options = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(rows), "parquet.block.row.count.limit": str(rows), "parquet.page.row.count.limit": str(max(1, rows // 4))}
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").options(**options).parquet(place)


def find(spark: SparkSession, place: str, key: str, ids: DataFrame | list) -> DataFrame:
    """The rows whose key is one of ids, a list or a table(key).  Null ids find nothing."""
    table = spark.read.parquet(place)
    if isinstance(ids, DataFrame):
        some = [r[0] for r in ids.select(key).where(F.col(key).isNotNull()).distinct().limit(LISTED + 1).collect()]
        if len(some) > LISTED:
            return table.join(ids.select(key).distinct(), key, "left_semi")
        ids = some
    ids = [i for i in ids if i is not None]
    return table.where(F.col(key).isin(ids)) if ids else table.limit(0)
