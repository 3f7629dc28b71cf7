"""The one place that says what posts and comments look like."""

from __future__ import annotations

COMMENT = (
    "struct<comment_id:string,post_id:string,parent_id:string,author_id:string,author:string,"
    "text:string,likes:bigint,created_at:bigint,depth:int,extra:string>"
)
COMMENTS = f"array<{COMMENT}>"
ENGAGEMENT = "struct<likes:bigint,comments:bigint,shares:bigint,score:bigint,video_views:bigint,comments_normalized_count:int>"

#: Canonical post, version 1 (times in epoch milliseconds).
CANONICAL_POST = (
    "schema_version int, post_id string, source string, event_time bigint, ingest_time bigint, "
    "author_id string, author_name string, content string, url string, hashtags array<string>, "
    f"engagement {ENGAGEMENT}, comments {COMMENTS}, extra string"
)

#: Flat raw post: ``comments`` is a count, ``comments_list`` JSON text.
FLAT_POST = (
    "post_id string, source string, event_time timestamp, ingest_time timestamp, author_id string, "
    "author_name string, content string, url string, hashtags array<string>, likes bigint, comments bigint, "
    "comments_list string, shares bigint, score bigint, video_views bigint, extra string"
)

#: Columns of the served document; those absent are left out.
SERVED = (
    "post_id source event_time event_date event_year event_month event_hour event_weekday author_id author_name "
    "content_clean url hashtags hashtag_count comments_list likes comments shares score video_views "
    "total_engagement weighted_engagement engagement_tier etl_version processed_time"
).split()
