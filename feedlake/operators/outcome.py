"""Validation, disposition and summary of an ingest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("post_id", "source", "event_time", "content")


def validity(df: DataFrame) -> Column:
    """OP-11: null, or the first required field that is absent."""
    reason = F.lit(None).cast("string")
    for name in reversed(REQUIRED):
        reason = F.when(F.col(name).isNull(), f"missing {name}").otherwise(reason)
    return F.coalesce(F.col("invalid"), reason) if "invalid" in df.columns else reason


def with_disposition(df: DataFrame) -> DataFrame:
    """OP-28: add ``reject_reason`` and ``disposition`` (``sent`` or ``skipped``)."""
    judged = df.withColumn("reject_reason", validity(df))
    return judged.withColumn("disposition", F.when(F.col("reject_reason").isNull(), "sent").otherwise("skipped"))


def split_disposition(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OP-28: (valid rows without the verdict, rejected rows with it)."""
    judged = with_disposition(df)
    sent = judged.filter("disposition = 'sent'").drop("disposition", "reject_reason", "invalid")
    return sent, judged.filter("disposition = 'skipped'")


def ingest_summary(df: DataFrame) -> DataFrame:
    """OP-27: rows by source and topic (sent) or ``skipped``; needs ``topic``."""
    judged = with_disposition(df)
    key = F.when(F.col("disposition") == "sent", F.col("topic")).otherwise("skipped")
    return judged.groupBy("source", key.alias("outcome")).agg(F.count("*").alias("n"))


def total_sent(summary: DataFrame) -> DataFrame:
    """OP-27: rows sent in all."""
    sent = F.when(~F.col("outcome").isin("skipped", "errors"), F.col("n")).otherwise(0)
    return summary.agg(F.coalesce(F.sum(sent), F.lit(0)).alias("total_sent"))
