"""Cleaning and derived columns; each function takes a batch or a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.exprs import json_text, runs
from feedlake.operators.dedup import keep_latest
from feedlake.sources.schemas import CANONICAL_POST

#: Weighted engagement from which a post is viral, high or medium.
TIERS = {"reddit": (8000, 800, 80), "instagram": (10000, 1000, 100), None: (2000, 200, 20)}
_COUNTS = ("likes", "comments", "shares", "score", "video_views")


def decode_messages(raw: DataFrame) -> DataFrame:
    """OP-06: (key, value, topic, offset, timestamp) to posts; rows without id or event time go.

    ``extra`` may be any JSON value and is taken as its text; ``event_timestamp`` keeps milliseconds.
    """
    text = F.col("value").cast("string")
    meta = {"key": ("kafka_key", "string"), "topic": ("kafka_topic", "string"), "offset": ("kafka_offset", "bigint"), "timestamp": ("kafka_timestamp", "timestamp")}
    kept = [F.col(c).cast(t).alias(n) for c, (n, t) in meta.items() if c in raw.columns]
    schema = CANONICAL_POST.replace("extra string", "extra variant")
    post = raw.select(F.from_json(text, schema).alias("post"), *kept).select("post.*", *[n for c, (n, _) in meta.items() if c in raw.columns])
    return (
        post.withColumn("extra", F.try_variant_get("extra", "$", "string")).filter(F.col("post_id").isNotNull() & F.col("event_time").isNotNull())
        .withColumn("event_timestamp", F.timestamp_millis("event_time"))
    )


def flatten_engagement(df: DataFrame) -> DataFrame:
    """OP-07: nested counters to columns (null is 0); the comment array becomes ``comments_list``."""
    lifted = df.withColumnRenamed("comments", "comments_list")
    for name in _COUNTS:
        lifted = lifted.withColumn(name, F.coalesce(F.col(f"engagement.{name}"), F.lit(0)).cast("long"))
    count = F.coalesce(F.col("engagement.comments_normalized_count"), F.lit(0)).cast("int")
    return lifted.withColumn("comments_normalized_count", count).drop("engagement")


def flatten_for_landing(df: DataFrame) -> DataFrame:
    """OP-08: canonical posts to the 16 flat columns; ``had_null_counter`` flags an explicit null counter."""
    missing = F.lit(False)
    for name in _COUNTS:
        missing = missing | F.col(f"engagement.{name}").isNull()
    flagged = df.withColumn("had_null_counter", F.col("engagement").isNotNull() & missing)
    kind = df.schema["extra"].dataType.simpleString()
    return normalize_time(flatten_engagement(flagged)).select(
        "post_id", "source", "event_time", "ingest_time", F.coalesce("author_id", F.lit("")).alias("author_id"),
        F.coalesce("author_name", F.lit("")).alias("author_name"), "content", F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("hashtags", F.array().cast("array<string>")).alias("hashtags"), "likes", "comments",
        F.coalesce(F.to_json("comments_list"), F.lit("[]")).alias("comments_list"), "shares", "score", "video_views",
        json_text(F.col("extra"), kind).alias("extra"), "had_null_counter",
    )


def normalize_time(df: DataFrame, precision: str = "millisecond") -> DataFrame:
    """OP-09: epoch ms to timestamps; ``precision="second"`` drops the milliseconds."""

    def stamp(c: str) -> Column:
        t = F.timestamp_millis(c)
        return F.date_trunc("second", t) if precision == "second" else t

    for c in ("event_time", "ingest_time"):
        if c in df.columns and df.schema[c].dataType.simpleString() == "bigint":
            df = df.withColumn(c, stamp(c))
    return df


def filter_empty(df: DataFrame) -> DataFrame:
    """OP-10: more than five characters after trimming spaces."""
    return df.filter(F.col("content").isNotNull() & (F.length(F.trim("content")) > 5))


def normalize_text(df: DataFrame) -> DataFrame:
    """OP-29: ``content_clean`` without URLs and runs of white space; lower-case hashtags."""
    text = F.regexp_replace(F.trim("content"), r"https?://\S+", " ")
    tags = F.transform(F.coalesce("hashtags", F.array().cast("array<string>")), F.lower)
    return df.withColumn("content_clean", F.trim(F.regexp_replace(text, runs(r"\s"), " "))).withColumn("hashtags", tags)


def total_engagement() -> Column:
    """OP-32."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("likes", "comments", "shares")), F.lit(0).cast("long"))


def weighted_engagement() -> Column:
    """OP-33: null when views are -1 or less."""
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("likes", "comments", "shares", "video_views")}
    views = F.when(n["video_views"] > -1, (F.log1p(n["video_views"]) * 10).cast("long"))
    return n["likes"] + n["comments"] * 2 + n["shares"] * 4 + views


def derive_columns(df: DataFrame, version: str = "1.0") -> DataFrame:
    """OP-30 to OP-34: calendar, sizes, engagement and lineage."""
    return df.withColumns(
        {
            "event_date": F.to_date("event_time"),
            "event_year": F.year("event_time"),
            "event_month": F.month("event_time"),
            "event_hour": F.hour("event_time"),
            "event_weekday": F.dayofweek("event_time"),
            "content_len": F.length("content_clean"),
            "hashtag_count": F.size("hashtags"),
            "total_engagement": total_engagement(),
            "weighted_engagement": weighted_engagement(),
            "etl_version": F.lit(version),
            "processed_time": F.current_timestamp(),
        }
    )


def engagement_tier(df: DataFrame) -> DataFrame:
    """OP-35: null source or score is low."""

    def of(limits: tuple[int, int, int]) -> Column:
        w = F.col("weighted_engagement")
        return F.when(w >= limits[0], "viral").when(w >= limits[1], "high").when(w >= limits[2], "medium").otherwise("low")

    source = F.col("source")
    tier = F.when(source == "reddit", of(TIERS["reddit"])).when(source == "instagram", of(TIERS["instagram"]))
    return df.withColumn("engagement_tier", tier.when(source.isNotNull(), of(TIERS[None])).otherwise("low"))


def clean(df: DataFrame, keys: tuple[str, ...] = ("post_id",), attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """OP-36, batch: the latest version first, so an emptied post does not come back.

    ``attach`` joins wide columns (``content``) to the versions that stay, so that telling versions apart shuffles no text.
    """
    latest = keep_latest(df, keys)
    return enrich(attach(latest) if attach else latest)


def enrich(df: DataFrame) -> DataFrame:
    """What batch and stream share after deduplication."""
    return df.transform(filter_empty).transform(normalize_text).transform(derive_columns).transform(engagement_tier)
