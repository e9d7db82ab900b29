"""Tables written to the cluster's shared folder between the steps of a plan."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Parquet's settings for a row in each row group.
LARGE = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is not set, a folder of our own that only a local master can use."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        place = getattr(spark, "_docweave_shared", None)
        if not place:
            place = spark._docweave_shared = tempfile.mkdtemp(prefix="spark-")
    return place.rstrip("/")


def written(df: DataFrame, name: str, place: str | None = None, large: bool = False) -> DataFrame:
    """The table written once and read back, so that what uses it twice does not compute it twice; place defaults to the shared folder.

    Rows of several MB are `large`: each is a row group, as a task holds one whole when it writes and when it reads (by default 100 rows at least).
    """
    path = f"{place}/{name}" if place else f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").options(**(LARGE if large else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
