"""Raw platform posts (JSON text) to canonical posts, and their comments.

A platform is a function from a frame with a ``raw`` JSON column to canonical
posts plus ``invalid`` (null, or why the post is rejected); comments are made
by a second function and nested by :func:`normalize_posts`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import exprs as E
from feedlake.operators import threads, visits
from feedlake.sources.schemas import COMMENT, COMMENTS, ENGAGEMENT

Normalizer = Callable[[DataFrame], DataFrame]


def _fields(df: DataFrame, column: str, names: str, into: str = "f") -> DataFrame:
    """Named members of JSON text, each as text (objects and arrays as JSON)."""
    schema = ", ".join(f"`{n}` string" for n in names.split())
    return df.withColumn(into, F.from_json(column, schema))


def _member(value: Column, name: str) -> Column:
    return F.get_json_object(value, f"$.{name}")


def _flag(value: Column) -> Column:
    return F.coalesce(F.lower(value) == "true", F.lit(False))


def _json(value: Column) -> Column:
    """Text of a JSON member back as VARIANT, so that it nests unquoted."""
    return F.coalesce(F.try_parse_json(value), F.try_parse_json(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2)))


def _engagement(**values: Column) -> Column:
    zero = F.lit(0).cast("long")
    parts = [values.get(n, zero).cast("long").alias(n) for n in ("likes", "comments", "shares", "score", "video_views")]
    return F.struct(*parts, F.lit(0).alias("comments_normalized_count")).cast(ENGAGEMENT)


def _post(df: DataFrame, source: str, **c: Column) -> DataFrame:
    now = F.unix_millis(F.current_timestamp())
    shown = {
        "schema_version": F.lit(1), "post_id": c["post_id"], "source": F.lit(source), "event_time": c["event_time"], "ingest_time": now,
        "author_id": c["author_id"], "author_name": c["author_name"], "content": c["content"], "url": c["url"], "hashtags": c["hashtags"],
        "engagement": c["engagement"], "comments": F.array().cast(COMMENTS), "extra": F.to_json(c["extra"]), "invalid": c["invalid"], "tree": c["tree"],
    }
    return df.select(*[v.alias(k) for k, v in shown.items()])


def facebook_posts(df: DataFrame) -> DataFrame:
    """OP-14."""
    names = "post_id id createdAt author content url feedbackId storyId reactionsCount likes commentCount shareCount comments"
    v = lambda n: F.col(f"f.{n}")
    f = E.with_clean(_fields(df, "raw", names), v("content"), "clean")
    post_id, time = F.coalesce(E.truthy(v("post_id")), E.truthy(v("id"))), E.epoch_ms(v("createdAt"), zulu=False)
    return _post(
        f, "facebook", post_id=post_id, event_time=time, author_id=_member(v("author"), "id"), author_name=_member(v("author"), "name"),
        content=F.col("clean"), url=v("url"), hashtags=F.array().cast("array<string>"),
        engagement=_engagement(likes=E.coalesce_int(v("reactionsCount"), v("likes")), comments=E.coalesce_int(v("commentCount")), shares=E.coalesce_int(v("shareCount"))),
        extra=F.struct(v("feedbackId").alias("feedback_id"), v("storyId").alias("story_id")),
        invalid=F.when(post_id.isNull(), "missing id").when(time.isNull(), "missing time"), tree=v("comments"),
    )


def instagram_posts(df: DataFrame) -> DataFrame:
    """OP-15: a post without a time is kept here and rejected by validation."""
    names = (
        "id type shortCode caption hashtags url commentsCount likesCount videoViewCount videoDuration productType "
        "ownerId ownerUsername ownerFullName timestamp timestamp_raw latestComments"
    )
    v = lambda n: F.col(f"f.{n}")
    f = E.with_clean(_fields(df, "raw", names), v("caption"), "clean")
    caption = F.col("clean")
    listed = F.from_json(v("hashtags"), "array<string>")
    tags = F.when(v("hashtags").startswith("["), listed).otherwise(E.extract_hashtags(caption))
    likes, comments, views = (E.coalesce_int(v(n)) for n in ("likesCount", "commentsCount", "videoViewCount"))
    post_id, time = E.truthy(v("id")), E.epoch_ms(F.coalesce(F.nullif(E.truthy(v("timestamp_raw")), F.lit("0")), E.truthy(v("timestamp"))))
    name = F.coalesce(E.truthy(v("ownerUsername")), E.truthy(v("ownerFullName")), F.lit("unknown"))
    return _post(
        f, "instagram", post_id=post_id, event_time=time, author_id=F.coalesce(E.truthy(v("ownerId")), F.lit("unknown")), author_name=name,
        content=E.truncate_words(caption, 2000), url=v("url"), hashtags=F.array_distinct(F.transform(tags, F.lower)),
        engagement=_engagement(likes=likes, comments=comments, video_views=views, score=likes + comments * 2 + F.when(views > -1, (F.log1p(views) * 10).cast("long")).otherwise(0)),
        extra=F.struct(
            v("shortCode").alias("short_code"), F.coalesce(v("type") == "Video", F.lit(False)).alias("is_video"), v("videoDuration").try_cast("double").alias("video_duration"),
            v("productType").alias("product_type"), E.is_truncated(caption, 2000).alias("caption_truncated"),
        ),
        invalid=F.when(post_id.isNull(), "missing id"), tree=v("latestComments"),
    )


def author_profile(profile: Column) -> Column:
    """OP-17: null for an absent or empty profile; booleans default to false."""
    present = profile.isNotNull() & ~profile.isin("", "{}")
    return F.when(
        present,
        F.struct(
            _member(profile, "total_karma").try_cast("long").alias("total_karma"), _flag(_member(profile, "is_mod")).alias("is_mod"),
            _flag(_member(profile, "verified")).alias("verified"), _flag(_member(profile, "is_gold")).alias("is_gold"),
            _member(profile, "created_utc_raw").try_cast("double").alias("account_age_utc_raw"),
        ),
    )


def _reddit_time(v: Callable[[str], Column]) -> Column:
    return F.coalesce(E.epoch_ms(F.when(v("created_utc_raw").try_cast("double").isNotNull(), v("created_utc_raw")), seconds_only=True), E.epoch_ms(E.truthy(v("created_utc"))))


def reddit_posts(df: DataFrame) -> DataFrame:
    """OP-16."""
    names = (
        "post_id title selftext url permalink subreddit flair_text is_video score upvotes upvote_ratio comment_count crossposts_count "
        "author author_fullname author_profile created_utc created_utc_raw comments"
    )
    v = lambda n: F.col(f"f.{n}")
    written = F.trim(F.concat_ws(" ", E.truthy(v("title")), E.truthy(v("selftext"))))
    f = E.with_clean(_fields(df, "raw", names), written, "clean", markdown=True)
    f = f.withColumn("short", E.truncate_words(F.col("clean"), 2000))
    text, content, likes = F.col("clean"), F.col("short"), E.coalesce_int(v("upvotes"), v("score"))
    post_id, time = E.truthy(v("post_id")), _reddit_time(v)
    return _post(
        f, "reddit", post_id=post_id, event_time=time, author_id=F.coalesce(E.truthy(v("author_fullname")), F.lit("unknown")),
        author_name=F.coalesce(E.truthy(v("author")), F.lit("unknown")), content=content, url=F.coalesce(E.truthy(v("url")), v("permalink")),
        hashtags=F.transform(E.extract_hashtags(content), F.lower),
        engagement=_engagement(likes=likes, comments=E.coalesce_int(v("comment_count")), shares=E.coalesce_int(v("crossposts_count")), score=likes),
        extra=F.struct(
            v("subreddit").alias("subreddit"), _flag(v("is_video")).alias("is_video"), E.is_truncated(text, 2000).alias("content_truncated"),
            v("flair_text").alias("flair_text"), F.coalesce(v("upvote_ratio").try_cast("double"), F.lit(0.0)).alias("upvote_ratio"),
            author_profile(v("author_profile")).alias("author_profile"),
        ),
        invalid=F.when(post_id.isNull(), "missing id").when(time.isNull(), "missing time"), tree=v("comments"),
    )


def _comment(df: DataFrame, source: str, **c: Column) -> DataFrame:
    parts = {
        "comment_id": F.col("key"), "post_id": F.concat_ws("_", F.lit(source), F.col("post")), "parent_id": c["parent_id"],
        "author_id": c["author_id"], "author": c["author"], "text": c["text"], "likes": c["likes"], "created_at": c["created_at"],
        "depth": F.col("depth"), "extra": F.to_json(c["extra"], {"ignoreNullFields": "false"}),
    }
    return df.select("post", "path", F.struct(*[v.alias(k) for k, v in parts.items()]).cast(COMMENT).alias("comment"))


def facebook_comments(posts: DataFrame, most: int = 1000, mode: str = "as_written", path: str | None = None) -> DataFrame:
    """OP-20: (post, path, comment) of posts with a ``tree`` of JSON comments; with a folder ``path``, without Python."""
    names = (
        "id commentId content message createdAt author user like_count likes reactionsCount reply_count subCommentsCount "
        "feedbackId attachments parent_id parentFeedbackId"
    )
    n = _fields(threads.tree_nodes(posts, "children", path), "node", names)
    v = lambda x: F.col(f"f.{x}")

    def key(member: Callable[[str], Column]) -> Column:
        a, b = E.truthy(member("id")), E.truthy(member("commentId"))
        return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat_ws("|", a, b)).otherwise(F.coalesce(a, b))

    n = threads.with_parent_key(n.withColumn("key", key(v)), lambda text: key(lambda name: _member(text, name)))
    n = threads.first_comments(n)
    n = E.with_clean(n, F.coalesce(E.truthy(v("content")), v("message")), "clean")
    n = threads.cap_comments(n.filter(~E.is_low_value(F.col("clean")) & ~E.is_spam(F.col("clean"), "facebook", mode=mode)), most)
    who = F.coalesce(E.truthy(v("author")), v("user"))
    parent = F.coalesce(E.truthy(F.col("parent_key")), E.truthy(v("parent_id")), E.truthy(v("parentFeedbackId")))
    extra = F.struct(
        parent.alias("parent_id"), F.col("depth").alias("depth"), E.coalesce_int(v("reply_count"), v("subCommentsCount")).alias("reply_count"),
        E.is_truncated(F.col("clean"), 2000).alias("is_truncated"),
        F.struct(v("feedbackId").alias("feedback_id"), F.coalesce(_json(v("attachments")), F.parse_json(F.lit("[]"))).alias("attachments")).alias("platform_meta"),
    )
    return _comment(
        n, "facebook", parent_id=parent, author_id=F.coalesce(E.truthy(_member(who, "id")), F.lit("unknown")),
        author=F.coalesce(E.truthy(_member(who, "name")), F.lit("unknown")), text=E.truncate_words(F.col("clean"), 2000),
        likes=E.coalesce_int(v("like_count"), v("likes"), v("reactionsCount")), created_at=E.epoch_ms(v("createdAt"), zulu=False), extra=extra,
    )


def instagram_comments(posts: DataFrame, most: int = 20, path: str | None = None) -> DataFrame:
    """OP-21: spam is judged on the raw text, before URLs go."""
    n = _fields(threads.tree_nodes(posts, "replies", path), "node", "id text ownerUsername timestamp timestamp_raw repliesCount likesCount owner")
    v = lambda x: F.col(f"f.{x}")
    n = threads.first_comments(threads.with_parent_key(n.withColumn("key", E.truthy(v("id"))), lambda text: E.truthy(_member(text, "id"))))
    time = E.epoch_ms(F.coalesce(F.nullif(E.truthy(v("timestamp_raw")), F.lit("0")), E.truthy(v("timestamp"))))
    n = E.with_clean(n, v("text"), "clean").withColumn("time", time)
    clean = F.col("clean")
    good = ~E.is_spam(v("text"), "instagram") & ~E.is_low_value(clean) & ~E.is_mention_only(clean) & F.col("time").isNotNull()
    n = threads.cap_comments(n.filter(good), most)
    parent = E.parent_or_null(F.col("parent_key"))
    extra = F.struct(
        parent.alias("parent_id"), F.col("depth").alias("depth"), E.coalesce_int(v("repliesCount")).alias("reply_count"),
        E.is_truncated(clean, 2000).alias("is_truncated"), F.parse_json(F.lit("{}")).alias("platform_meta"),
    )
    return _comment(
        n, "instagram", parent_id=parent, author_id=F.coalesce(E.truthy(_member(v("owner"), "id")), F.lit("unknown")),
        author=F.coalesce(E.truthy(v("ownerUsername")), E.truthy(_member(v("owner"), "username")), F.lit("unknown")),
        text=E.truncate_words(clean, 2000), likes=E.coalesce_int(v("likesCount")), created_at=F.col("time"), extra=extra,
    )


def reddit_comments(posts: DataFrame, most: int = 5000, max_depth: int = 20, on_overflow: str = "stop", path: str | None = None) -> DataFrame:
    """OP-22, OP-24: deleted and media-only bodies go but not their replies; spam and undated comments cut their branch.

    With a folder ``path`` for steps between, no Python runs and no task holds a post.
    """
    names = "comment_id parent_id author author_fullname body score reply_count controversiality is_submitter gilded created_utc created_utc_raw"
    n = _fields(threads.tree_nodes(posts, "replies", path and f"{path}/levels", max_depth + 1), "node", names)
    v = lambda x: F.col(f"f.{x}")
    body = F.regexp_replace(F.coalesce(v("body"), F.lit("")), r"(?U)^\s+|\s+$", "")
    n = n.withColumns({"key": E.truthy(v("comment_id")), "body": body, "time": _reddit_time(v)})
    n = E.with_clean(threads.with_parent_key(n, lambda text: E.truthy(_member(text, "comment_id"))), F.col("body"), "clean", markdown=True)
    deleted = F.col("body").isin("[deleted]", "[removed]")
    shown = ~deleted & (F.col("clean") != "") & (F.col("body") != "")
    spam = ~deleted & E.is_spam(F.col("body"), "reddit", author=v("author"))
    n = n.withColumn("cut", spam | (shown & F.col("time").isNull())).withColumn("emit", shown)
    if path:
        n = visits.visit_wide(n, most, max_depth, f"{path}/visit", on_overflow=on_overflow)
    else:
        n = threads.visit_threads(n, most, max_depth, on_overflow=on_overflow)
    above = F.when(F.col("depth") == 0, F.concat(F.lit("t3_"), F.col("post"))).otherwise(F.concat(F.lit("t1_"), F.col("parent_key")))
    parent = E.parent_or_fallback(v("parent_id"), above)
    extra = F.struct(
        parent.alias("parent_id"), E.coalesce_int(v("reply_count")).alias("reply_count"), E.is_truncated(F.col("clean"), 1000).alias("is_truncated"),
        F.struct(
            E.coalesce_int(v("controversiality")).alias("controversiality"), _flag(v("is_submitter")).alias("is_submitter"), E.coalesce_int(v("gilded")).alias("gilded"),
        ).alias("platform_meta"),
    )
    return _comment(
        n, "reddit", parent_id=parent, author_id=F.coalesce(E.truthy(v("author_fullname")), F.lit("unknown")),
        author=F.coalesce(E.truthy(v("author")), F.lit("unknown")), text=E.truncate_words(F.col("clean"), 1000),
        likes=E.coalesce_int(v("score")), created_at=F.col("time"), extra=extra,
    )


PLATFORMS: dict[str, tuple[Normalizer, Normalizer]] = {
    "facebook": (facebook_posts, facebook_comments),
    "instagram": (instagram_posts, instagram_comments),
    "reddit": (reddit_posts, reddit_comments),
}


def register_platform(name: str, posts: Normalizer, comments: Normalizer) -> None:
    """Add a platform: its posts need the columns of ``facebook_posts``, its comments (post, path, comment) and an argument ``path``."""
    PLATFORMS[name] = (posts, comments)


def normalize_posts(df: DataFrame, platform: str, comments: bool = True, path: str | None = None) -> DataFrame:
    """Canonical posts with ``invalid``, of a frame with a ``raw`` JSON column; ``path`` is a folder for the comments' steps between."""
    make_posts, make_comments = PLATFORMS[platform]
    posts = make_posts(df)
    if not comments:
        return posts.drop("tree")
    kept = posts.filter(F.col("post_id").isNotNull())
    nested = threads.nest_comments(posts, make_comments(kept, path=path) if path else make_comments(kept))
    count = F.col("comments_normalized_count").cast("int")
    return nested.withColumn("engagement", F.col("engagement").withField("comments_normalized_count", count)).drop("tree", "comments_normalized_count")
