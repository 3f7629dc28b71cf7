"""Deduplication and selection by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_max(df: DataFrame, keys: Sequence[str], by: Sequence) -> DataFrame:
    """The first row of each key in the order ``by``; ranks are cut before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def keep_latest(df: DataFrame, keys: Sequence[str] = ("post_id",), time_col: str = "ingest_time") -> DataFrame:
    """OP-37, batch: the row with the latest ``time_col``; ties by the row's hash."""
    return keep_max(df, keys, [F.col(time_col).desc_nulls_last(), F.xxhash64(*[F.col(c) for c in df.columns])])


def first_arrival(df: DataFrame, keys: Sequence[str] = ("post_id",)) -> DataFrame:
    """OP-51: on a stream with a watermark, the first arrival within it; on a batch the latest version."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else keep_latest(df, keys)


def largest_file(files: DataFrame) -> DataFrame:
    """OP-39: (path, length) rows to the largest file of each folder, with what a clean-up would do."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    best = F.min(F.struct((-F.col("length")).alias("less"), "path", "length")).alias("best")
    found = files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), best)  # one scan of the list, however many files
    status = F.when(F.col("files") > 1, "cleaned").otherwise("skipped")
    return found.select("folder", "best.path", "best.length", "files", status.alias("status"))
