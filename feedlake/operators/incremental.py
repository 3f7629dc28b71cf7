"""Incremental loads, data quality checks and time splits."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.exprs import epoch_ms
from feedlake.operators.dedup import keep_latest

LEDGER = "source string, date date, processed_at timestamp"


def pending_partitions(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """OP-43: candidate (source, date) pairs not in the ledger; a null date is never skipped.

    A whole-lake run has the source ``ALL``, which is a key of its own.
    """
    return candidates.join(ledger.select("source", "date"), ["source", "date"], "left_anti")


def mark_processed(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """OP-44: the ledger with ``done`` (source, date) stamped now; rows without a date are not recorded."""
    new = done.filter(F.col("date").isNotNull()).select("source", "date", F.current_timestamp().alias("processed_at"))
    return keep_latest(ledger.unionByName(new), ["source", "date"], "processed_at")


def partition_presence(raw: DataFrame, date: str, sources: list[str]) -> DataFrame:
    """OP-45: files and rows of one date for each expected source, zeros included; reads that day's partitions only, where the lake has such."""
    spark = raw.sparkSession
    expected = spark.createDataFrame([(s,) for s in sources], "source string")
    when = F.lit(date).cast("date")
    parts = {"year": F.year(when), "month": F.month(when), "day": F.dayofmonth(when)}
    day = raw.filter(F.to_date("event_time") == when)
    if set(parts) <= set(raw.columns):
        day = day.filter((F.col("year") == parts["year"]) & (F.col("month") == parts["month"]) & (F.col("day") == parts["day"]))
    found = day.groupBy(F.col("source").alias("s")).agg(F.countDistinct("_metadata.file_path").alias("files"), F.count("*").alias("rows"))
    joined = expected.join(found, F.col("source") == F.col("s"), "left").drop("s")
    return joined.na.fill(0, ["files", "rows"]).withColumn("has_data", F.col("rows") > 0)


def output_count(clean: DataFrame, date: str, low: int = 10) -> DataFrame:
    """OP-46: rows of one event date and ``none``, ``low`` or ``ok``."""
    day = F.lit(date).cast("date")
    n = clean.filter((F.col("event_date") >= day) & (F.col("event_date") < F.date_add(day, 1))).agg(F.count("*").alias("n"))
    return n.withColumn("status", F.when(F.col("n") == 0, "none").when(F.col("n") < low, "low").otherwise("ok"))


#: Fixed value: 2026-04-15 00:00 at UTC+7.
SPLIT_AT = int(datetime(2026, 4, 14, 17, tzinfo=timezone.utc).timestamp())


def raw_event_seconds(raw: Column, platform: str) -> Column:
    """OP-47: event time in seconds of a raw JSON post, null if it can't be read."""
    member = lambda n: F.get_json_object(raw, f"$.{n}")
    if platform == "facebook":  # numeric seconds only
        return member("createdAt").try_cast("double")
    value = member("created_utc") if platform == "reddit" else F.coalesce(F.nullif(member("timestamp"), F.lit("")), member("taken_at"))
    return epoch_ms(value) / 1000


def split_at(df: DataFrame, seconds: Column, instant: int = SPLIT_AT) -> DataFrame:
    """OP-47: add ``phase``: ``batch`` before the instant, ``stream`` from it on, ``failed`` without a time."""
    return df.withColumn("phase", F.when(seconds.isNull(), "failed").when(seconds < instant, "batch").otherwise("stream"))


def write_split(raw: DataFrame, platform: str, path: str, instant: int = SPLIT_AT, raw_col: str = "raw") -> None:
    """OP-47: raw posts as lines of text below ``phase=batch``, ``phase=stream`` and ``phase=failed``, in one pass; the text stays as it is."""
    phased = split_at(raw, raw_event_seconds(F.col(raw_col), platform), instant)
    phased.select(F.col(raw_col).alias("value"), "phase").write.partitionBy("phase").text(path)
