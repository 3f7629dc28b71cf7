"""Windowed and summary aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def engagement_by_window(df: DataFrame, duration: str = "10 minutes", time_col: str = "event_time") -> DataFrame:
    """OP-40, OP-49: counts and likes statistics per tumbling window and source (population deviation)."""
    made = df.groupBy(F.window(time_col, duration).alias("w"), "source").agg(
        F.count("*").alias("num_posts"), F.avg("likes").alias("avg_likes"), F.avg("comments").alias("avg_comments"),
        F.avg("shares").alias("avg_shares"), F.max("likes").alias("max_likes"), F.min("likes").alias("min_likes"),
        F.stddev_pop("likes").alias("stddev_likes"),
    )
    numbers = ["num_posts", "avg_likes", "avg_comments", "avg_shares", "max_likes", "min_likes", "stddev_likes"]
    return made.select(F.col("w.start").alias("time_start"), F.col("w.end").alias("time_end"), "source", *numbers)


def source_comparison(windows: DataFrame, ranked: bool = False) -> DataFrame:
    """OP-41: from :func:`engagement_by_window`; ``ranked`` adds each source's rank in its window (batch only)."""
    out = windows.select("time_start", "time_end", "source", "num_posts", "avg_likes")
    if ranked:
        out = out.withColumn("rank", F.rank().over(Window.partitionBy("time_start").orderBy(F.col("avg_likes").desc())))
    return out


def trending_hashtags(df: DataFrame, duration: str = "1 hour", top: int = 10, time_col: str = "event_time") -> DataFrame:
    """OP-38: the most used hashtags of each window, ties by name. On a stream, call it in foreachBatch."""
    tags = df.select(time_col, F.explode("hashtags").alias("hashtag")).filter(F.col("hashtag").isNotNull())
    counts = tags.groupBy(F.window(time_col, duration).alias("w"), "hashtag").agg(F.count("*").alias("count"))
    return top_hashtags(counts.select(F.col("w.start").alias("time_start"), F.col("w.end").alias("time_end"), "hashtag", "count"), top)


def top_hashtags(counts: DataFrame, top: int = 10) -> DataFrame:
    """OP-38: the ``top`` of each window's counts, ranked."""
    order = Window.partitionBy("time_start").orderBy(F.col("count").desc(), "hashtag")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def load_summary(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """OP-42: raw, clean and dropped rows, and the dropped percentage (0 for an empty load)."""
    n = raw.agg(F.count("*").alias("raw_count")).crossJoin(clean.agg(F.count("*").alias("clean_count")))  # one row each
    dropped = F.col("raw_count") - F.col("clean_count")
    share = F.coalesce(F.try_divide(dropped * F.lit(100.0), F.col("raw_count")), F.lit(0.0))
    return n.withColumn("dropped_count", dropped).withColumn("dropped_pct", share)


def counts_by_source(clean: DataFrame) -> DataFrame:
    """OP-42."""
    return clean.groupBy("source").agg(F.count("*").alias("count"))


def counts_by_tier(clean: DataFrame) -> DataFrame:
    """OP-42: sorted by source and count."""
    return clean.groupBy("source", "engagement_tier").agg(F.count("*").alias("count")).orderBy("source", "count")
