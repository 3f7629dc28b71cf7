import html.entities
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from feedlake.functions import exprs as E
from feedlake.operators import aggregates, clean, dedup, incremental, outcome, platforms, threads, visits
from feedlake.sources import readers, sinks, tables

POST = "post_id string, source string, event_time timestamp, ingest_time timestamp, content string, hashtags array<string>, likes long, comments long, shares long, video_views long"


def posts(spark, *rows):
    full = []
    for r in rows:
        d = {"post_id": "p", "source": "reddit", "t": "2024-01-01 10:00:00", "content": "some content", "hashtags": ["A"], "likes": 0, "comments": 0, "shares": 0, "video_views": 0} | r
        full.append((d["post_id"], d["source"], d["t"], d["t"], d["content"], d["hashtags"], d["likes"], d["comments"], d["shares"], d["video_views"]))
    raw = spark.createDataFrame(full, POST.replace("timestamp", "string"))
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in ("event_time", "ingest_time")})


def test_empty_filter_counts_more_than_five_characters(spark):
    df = posts(spark, {"content": "12345"}, {"content": "123456"}, {"content": "  12345  "}, {"content": None}, {"content": ""})
    assert [r.content for r in clean.filter_empty(df).collect()] == ["123456"]


@pytest.mark.parametrize(("source", "likes", "tier"), [("reddit", 79, "low"), ("reddit", 80, "medium"), ("reddit", 800, "high"), ("reddit", 8000, "viral"), ("instagram", 9999, "high"), ("instagram", 10000, "viral"), ("facebook", 20, "medium"), ("other", 2000, "viral"), (None, 9999, "low")])
def test_tier_boundaries(spark, source, likes, tier):
    assert clean.clean(posts(spark, {"source": source, "likes": likes})).first().engagement_tier == tier


def test_weighted_engagement_truncates_and_is_null_for_bad_views(spark):
    rows = posts(spark, {"likes": 1, "comments": 1, "shares": 1, "video_views": 14968}, {"video_views": -1}).select(clean.weighted_engagement().alias("w")).collect()
    assert [r.w for r in rows] == [1 + 2 + 4 + 96, None]


def test_latest_version_wins_even_if_it_is_empty(spark):
    df = posts(spark, {"content": "an old version"}, {"content": " ", "t": "2024-01-02 10:00:00"})
    assert clean.clean(df).count() == 0


def test_text_cleaning(spark):
    text = "  a <b>&amp; https://x.y/z c d "
    row = spark.createDataFrame([(text, "see [this](http://u) **bold** ~~no~~ ![i](u)", "&lt;&eacute;&amp;lt;")], "a string, b string, c string").select(E.clean_text(F.col("a")).alias("a"), E.clean_markdown(F.col("b")).alias("b"), E.html_unescape(F.col("c")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("a <b>& c d", "see this bold no", "<é&lt;")


def test_entities_are_those_of_the_standard_library(spark):
    rng = random.Random(2)
    texts = [f"a&{n}b {n} &{n.rstrip(';')}" for n in html.entities.html5]
    texts += [f"&#{c}; &#{c} &#x{c:x};&#X{c:X}z &#0{c};" for c in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**30]]
    texts += ["".join(rng.choices([*"&#;xX0129aAz \t\n", "amp", "lt", "not", "notin", "notit;", "&", "é", "&#", "&#x"], k=rng.randint(1, 25))) for _ in range(1500)] + ["", "&", "&;", "&#;", "&" + "x" * 40 + ";"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", E.html_unescape(F.col("t")).alias("u"))
    assert "Python" not in df._jdf.queryExecution().toString()
    wrong = [(texts[r.k], r.u, html.unescape(texts[r.k])) for r in df.collect() if r.u != html.unescape(texts[r.k])]
    assert not wrong, wrong[:5]


def test_cleaning_in_steps_is_cleaning_in_one_expression(spark):
    rng = random.Random(3)
    parts = ["see ", "https://x.y/z ", "&amp;", "*", "**", "~~", "![i](u)", "[l](http://u)", "\n", "\u00a0", "é"]
    df = spark.createDataFrame([("".join(rng.choices(parts, k=9)),) for _ in range(200)] + [(None,)], "t string")
    for markdown, whole in ((False, E.clean_text), (True, E.clean_markdown)):
        both = E.with_clean(df, F.col("t"), "steps", markdown).withColumn("whole", whole(F.col("t")))
        assert both.filter(~F.col("steps").eqNullSafe(F.col("whole"))).count() == 0


def test_coalesce_int_and_truncate(spark):
    row = spark.createDataFrame([("x", "0", "aaa bbb ccc")], "a string, b string, t string").select(E.coalesce_int(F.col("a"), F.col("b"), F.lit("7")).alias("n"), E.truncate_words(F.col("t"), 9).alias("t")).first()
    assert (row.n, row.t) == (0, "aaa bbb")


@pytest.mark.parametrize(("text", "mode", "spam"), [("t.me/+123456789", "as_written", True), ("t.me/join_us", "as_written", False), ("t.me/join_us", "intended", True), ("buy LSD", "as_written", True)])
def test_facebook_spam(spark, text, mode, spam):
    assert spark.range(1).select(E.is_spam(F.lit(text), "facebook", mode=mode).alias("s")).first().s is spam


def facebook(**more):
    leaf = lambda i, text: {"id": i, "content": text, "createdAt": 1605397383}
    tree = leaf("root", "the first comment") | {"children": [leaf("a", "child number one") | {"children": [leaf("deep", "grand child")]}, leaf("root", "same key again"), leaf("tiny", "ok!")]}
    return {"post_id": "1", "createdAt": 1605397383, "content": "hello &amp; welcome", "reactionsCount": 3, "comments": [tree, "junk", leaf("b", "another root")]} | more


def test_facebook_post_and_comments(spark):
    raw = spark.createDataFrame([(json.dumps(facebook()),), (json.dumps({"content": "x"}),)], "raw string")
    good, bad = (r for r in platforms.normalize_posts(raw, "facebook").orderBy(F.col("post_id").asc_nulls_last()).collect())
    assert [(c.comment_id, c.depth, c.parent_id) for c in good.comments] == [("root", 0, None), ("a", 1, "root"), ("deep", 2, "a"), ("b", 0, None)]
    assert (good.content, good.event_time, good.engagement.likes, good.engagement.comments_normalized_count) == ("hello & welcome", 1605397383000, 3, 4)
    assert bad.invalid == "missing id"


def test_instagram_score_cap_and_noise(spark):
    comment = lambda i, text: {"id": str(i), "text": text, "timestamp": "2024-01-01T00:00:00Z", "ownerUsername": "u"}
    listed = [comment("m", "@user @other"), comment("s", "see https://evil.com now"), comment("t", "telegram, sharing a thing")] + [comment(k, f"comment number {k}") for k in range(25)]
    post = {"id": "9", "caption": "Hi #One #one", "timestamp": "2024-01-01T00:00:00Z", "likesCount": 1745, "commentsCount": 28, "videoViewCount": 14968, "latestComments": listed}
    row = platforms.normalize_posts(spark.createDataFrame([(json.dumps(post),)], "raw string"), "instagram").first()
    assert row.engagement.score == 1897 and row.hashtags == ["one"]
    assert [c.comment_id for c in row.comments] == ["t"] + [str(k) for k in range(19)]


def reddit_comment(i, body="a fine comment", replies=(), **more):
    return {"comment_id": i, "body": body, "created_utc_raw": 1700000000, "author": "u", "replies": list(replies)} | more


def reddit_visit(spark, tree, **options):
    posts = spark.createDataFrame([("p", json.dumps(tree))], "post_id string, tree string")
    return [(r.comment.comment_id, r.comment.parent_id, r.comment.depth) for r in platforms.reddit_comments(posts, **options).orderBy("path").collect()]


def test_reddit_branches(spark):
    tree = [
        reddit_comment("spam", "go to https://evil.com", [reddit_comment("x")]),
        reddit_comment("gone", "[deleted]", [reddit_comment("x", parent_id="t1_gone")]),
        reddit_comment("x", replies=[reddit_comment("lost")]),
        reddit_comment("undated", replies=[reddit_comment("lost2")], created_utc_raw=None),
        reddit_comment("bot", author="AutoModerator", replies=[reddit_comment("lost3")]),
    ]
    assert reddit_visit(spark, tree) == [("x", "t1_gone", 1)]


def test_reddit_depth_limit_stops_the_post_or_prunes(spark):
    chain = reddit_comment("c22")
    for k in range(21, -1, -1):
        chain = reddit_comment(f"c{k}", replies=[chain])
    tree = [chain, reddit_comment("after")]
    assert [x[0] for x in reddit_visit(spark, tree)] == [f"c{k}" for k in range(21)]
    assert reddit_visit(spark, tree, on_overflow="prune")[-1][0] == "after"
    assert [x[0] for x in reddit_visit(spark, tree, most=2)] == ["c0", "c1"]


def test_reply_nodes_are_those_of_the_tree(spark, tmp_path):
    rows = spark.createDataFrame([(p, t, json.dumps({"id": f"{p}{t}"})) for p in "abc" for t in range(40 if p == "b" else 3)], "post string, turn int, node string")
    got = threads.reply_nodes(rows, ["turn"], str(tmp_path / "t")).orderBy("post", "path").collect()
    trees = [(p, json.dumps([{"id": f"{p}0", "replies": [{"id": f"{p}{t}"} for t in range(1, 40 if p == "b" else 3)]}])) for p in "abc"]
    want = threads.flatten_tree(spark.createDataFrame(trees, "post_id string, comments string"), "replies").drop("parent").orderBy("post", "path").collect()
    assert got == want


def test_conversation_of_more_than_a_million_turns_is_whole(spark, tmp_path):
    from feedlake.plans import queries

    turns = spark.range(1_000_003).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("r").alias("role"), F.lit("t").alias("text"))
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.reply_table(spark, str(tmp_path)).count() == 1_000_003


def random_tree(rng, depth, keys):
    """A list of nodes, some without key, some no objects; keys repeat."""
    out = []
    for _ in range(rng.randint(0, 3) if depth else 3):
        node = {"id": rng.choice(keys), "cut": rng.random() < 0.1, "emit": rng.random() < 0.8}
        if depth < 7 and rng.random() < 0.7:
            node["replies"] = random_tree(rng, depth + 1, keys)
        out.append(rng.choice([7, None, "text", [1]]) if rng.random() < 0.05 else node)
    return out


def flags(nodes):
    member = lambda n: F.get_json_object("node", f"$.{n}")
    return nodes.withColumns({"key": member("id"), "cut": member("cut") == "true", "emit": member("emit") == "true"})


def test_levels_are_the_walk(spark, tmp_path):
    rng = random.Random(1)
    odd = [{"id": "a", "n": 1.5, "x": None, "u": 'é "q', "replies": [7, None, [1], {"commentId": 5, "o": {"k": [1, {"z": True}]}}, {"id": "e", "replies": "no"}]}, []]
    trees = [("p", json.dumps(odd)), ("q", None), ("r", "[bad"), ("s", "{}"), (None, '[{"id": "n"}]')] + [(str(k), json.dumps(random_tree(rng, 0, "abcde"))) for k in range(20)]
    df = spark.createDataFrame(trees, "post_id string, comments string")
    plain = lambda rows: sorted((str(r.post), r.path, r.depth, r.parent_path, json.dumps(json.loads(r.node), sort_keys=True), r.parent and json.dumps(json.loads(r.parent))) for r in rows.collect())
    got = threads.flatten_levels(df, "replies", str(tmp_path / "a"))
    assert plain(got) == plain(threads.flatten_tree(df, "replies"))
    assert "Python" not in got._jdf.queryExecution().toString() and "MapInArrow" not in got._jdf.queryExecution().toString()
    shallow = threads.flatten_levels(df, "replies", str(tmp_path / "b"), max_depth=2)
    assert plain(shallow) == [r for r in plain(got) if r[2] <= 2]


@pytest.mark.parametrize("mode", ["stop", "prune"])
def test_wide_visit_is_the_fold(spark, tmp_path, mode):
    rng = random.Random(5)
    trees = [(str(k), json.dumps(random_tree(rng, 0, [None, "", *range(4 + 4 * k)]))) for k in range(25)]
    df = flags(threads.flatten_tree(spark.createDataFrame(trees, "post_id string, comments string"), "replies")).repartition(6).cache()
    for cap, deepest in ((1000, 20), (5, 3)):
        plain = lambda rows: sorted((r.post, r.path) for r in rows.collect())
        want = plain(threads.visit_threads(df, cap, deepest, on_overflow=mode))
        assert plain(visits.visit_wide(df, cap, deepest, str(tmp_path / f"{cap}-{deepest}"), on_overflow=mode)) == want and want


def test_wide_visit_of_one_deep_chain(spark, tmp_path):
    chain = {"id": "c29"}
    for k in range(28, -1, -1):
        chain = {"id": f"c{k}", "replies": [chain]}
    tree = [("p", json.dumps([chain, {"id": "after"}]))]
    df = threads.flatten_tree(spark.createDataFrame(tree, "post_id string, comments string"), "replies").withColumns({"key": F.get_json_object("node", "$.id"), "cut": F.lit(False), "emit": F.lit(True)})
    for mode, last in (("stop", "c20"), ("prune", "after")):
        got = visits.visit_wide(df, 1000, 20, str(tmp_path / mode), on_overflow=mode).orderBy("path").collect()
        assert [r.key for r in got] == [f"c{k}" for k in range(21)] + ["after"] * (mode == "prune") and got[-1].key == last


def test_jsonl_and_folders(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \n[1]\n{bad\n"text"\n')
    found = readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()
    assert sorted(str(r.reject_reason) for r in found) == ["None", "malformed", "not an object", "not an object"]
    for name, text in (("x", '﻿{"post_id": "1"}'), ("y", "")):
        (tmp_path / "d" / name).mkdir(parents=True)
        (tmp_path / "d" / name / "post.json").write_text(text)
    assert [r.raw for r in readers.read_post_folders(spark, str(tmp_path / "d")).collect()] == ['{"post_id": "1"}']


def test_disposition_and_summary(spark):
    df = posts(spark, {"post_id": "1"}, {"post_id": None}).withColumn("topic", F.lit("t"))
    sent, rejected = outcome.split_disposition(df)
    assert (sent.count(), rejected.first().reject_reason) == (1, "missing post_id")
    assert outcome.total_sent(outcome.ingest_summary(df)).first().total_sent == 1


def test_landing_flags_null_counters(spark):
    value = {"schema_version": 1, "post_id": "1", "source": "reddit", "event_time": 1700000000123, "ingest_time": 1, "content": "x", "engagement": {"likes": None, "comments": 2}, "extra": {"k": 1}}
    raw = spark.createDataFrame([("k", json.dumps(value), "t"), ("k", "garbage", "t")], "key string, value string, topic string")
    flat = clean.flatten_for_landing(clean.decode_messages(raw)).collect()
    assert len(flat) == 1 and flat[0].had_null_counter and flat[0].likes == 0 and flat[0].extra == '{"k":1}' and flat[0].event_time.microsecond == 123000


def test_clean_write_is_idempotent_and_upsert_once_is_twice(spark, tmp_path):
    df = clean.clean(posts(spark, {"post_id": "1"}, {"post_id": "2"}))
    for _ in range(2):
        sinks.write_clean(df, str(tmp_path / "clean"))
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 2
    p = posts(spark, {"post_id": "1", "likes": 1}).withColumn("_id", F.col("post_id"))
    once = sinks.upsert(None, p)
    assert sinks.upsert(once, p.withColumn("likes", F.lit(5).cast("long"))).first().likes == 5 and sinks.upsert(once, p).count() == 1


def test_ledger_skips_second_run(spark):
    pairs = spark.createDataFrame([("reddit", "2024-01-01"), ("ALL", "2024-01-01"), ("reddit", None)], "source string, date string").withColumn("date", F.col("date").cast("date"))
    ledger = incremental.mark_processed(spark.createDataFrame([], incremental.LEDGER), pairs.filter("source = 'reddit'"))
    assert {(r.source, r.date is None) for r in incremental.pending_partitions(pairs, ledger).collect()} == {("ALL", False), ("reddit", True)}


def keyed(spark, ids, text, when):
    rows = [(i, text, when) for i in ids]
    return spark.createDataFrame(rows, "_id string, content string, t string").select("_id", "content", F.col("t").cast("timestamp").alias("ingest_time"))


def bucket_files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet") if "staged" not in p.parts}


def test_upsert_rewrites_touched_buckets_alone(spark, tmp_path):
    table = tables.BucketTable(spark, str(tmp_path), buckets=32)
    table.upsert(keyed(spark, [str(k) for k in range(400)], "old", "2024-01-01"))
    before, few = bucket_files(tmp_path / "data"), ["7", "11", "new"]
    touched = table.upsert(keyed(spark, few, "fresh", "2024-01-02"))
    after = bucket_files(tmp_path / "data")
    assert len(touched) <= 3 and before.items() <= after.items()
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in after.keys() - before.keys()} == set(touched)
    rows = {r._id: r.content for r in tables.BucketTable(spark, str(tmp_path)).read().collect()}
    assert len(rows) == 401 and {k for k, v in rows.items() if v == "fresh"} == set(few)
    assert table.read(1).count() == 400
    twice = table.upsert(keyed(spark, few, "fresh", "2024-01-02"))
    assert twice == touched and table.read().count() == 401


def test_small_updates_are_laid_over_their_buckets(spark, tmp_path):
    table, want = tables.BucketTable(spark, str(tmp_path), buckets=2), {str(k): "old" for k in range(200)}
    table.upsert(keyed(spark, [*want, None], "old", "2024-01-01"))
    for n in range(1, tables.LAYERS + 2):
        few = [str(n), str(n + 1), f"new {n}"]
        before = bucket_files(tmp_path / "data")
        table.upsert(keyed(spark, few, f"fresh {n}", "2024-01-02"))
        want |= dict.fromkeys(few, f"fresh {n}")
        got = [(r._id, r.content) for r in tables.BucketTable(spark, str(tmp_path)).read().collect()]
        assert sorted(got, key=str) == sorted([*want.items(), (None, "old")], key=str)
        rows = sum(spark.read.parquet(str(tmp_path / "data" / f)).count() for f in bucket_files(tmp_path / "data").keys() - before.keys())
        assert rows == 3 if n <= tables.LAYERS else rows > 100
    assert table.read(2).count() == 202
    assert table.vacuum() > 0 and len(table.read().collect()) == len(want) + 1 and table.vacuum() == 0


def test_upsert_that_fails_before_its_manifest_changes_nothing(spark, tmp_path):
    table = tables.BucketTable(spark, str(tmp_path), buckets=4)
    table.upsert(keyed(spark, ["a", "b"], "old", "2024-01-01"))

    def crash():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.upsert(keyed(spark, ["a"], "half", "2024-01-02"), before_commit=crash)
    assert {r.content for r in table.read().collect()} == {"old"}
    other, raced = tables.BucketTable(spark, str(tmp_path)), []

    def race():
        if not raced:
            raced.append(other.upsert(keyed(spark, ["c"], "other", "2024-01-03")))

    table.upsert(keyed(spark, ["a"], "mine", "2024-01-04"), before_commit=race)
    assert {(r._id, r.content) for r in table.read().collect()} == {("a", "mine"), ("b", "old"), ("c", "other")}


def test_ledger_has_both_writers_and_writes_nothing_twice(spark, tmp_path):
    one, two = (tables.Ledger(spark, str(tmp_path)) for _ in range(2))
    pairs = spark.createDataFrame([("reddit", "2024-01-01"), ("ALL", "2024-01-01"), ("reddit", None), ("x", "2024-01-02")], "source string, date string").withColumn("date", F.col("date").cast("date"))
    numbers, create = [], two.log.create

    def late(number, entry):  # the other writer takes the number first
        if not numbers:
            numbers.append(one.mark(pairs.filter("source = 'reddit'")))
        return create(number, entry)

    two.log.create = late
    assert two.mark(pairs.filter("source = 'x'")) == 2 and numbers == [1]
    assert {(r.source, r.date is None) for r in one.pending(pairs).collect()} == {("ALL", False), ("reddit", True)}
    assert one.mark(pairs.filter("source = 'ALL'")) == 3 and one.mark(pairs) is None and one.log.numbers() == [1, 2, 3]
    log = tables.CommitLog(spark, str(tmp_path / "commits"), stale=0.0)
    (tmp_path / "commits" / ".claim-0000000004").touch()  # of a writer that died
    assert not log.create(4, {}) and log.create(4, {"entry": "none"})


def test_split_and_largest_file(spark):
    raw = spark.createDataFrame([('{"createdAt": 1776185999}',), ('{"createdAt": 1776186000}',), ("{}",)], "raw string")
    assert [r.phase for r in incremental.split_at(raw, incremental.raw_event_seconds(F.col("raw"), "facebook")).collect()] == ["batch", "stream", "failed"]
    files = spark.createDataFrame([("/a/1.json", 5), ("/a/2.json", 9), ("/b/1.json", 1)], "path string, length long")
    assert {(r.path, r.status) for r in dedup.largest_file(files).collect()} == {("/a/2.json", "cleaned"), ("/b/1.json", "skipped")}


def test_window_counts_add_up(spark):
    df = posts(spark, *[{"post_id": str(k), "t": f"2024-01-01 10:{k:02d}:00", "likes": k} for k in range(30)])
    windows = aggregates.engagement_by_window(df)
    assert windows.agg(F.sum("num_posts")).first()[0] == 30 and windows.count() == 3
    assert aggregates.trending_hashtags(df, "1 hour", 1).first()["count"] == 30


def test_nest_and_explode_keep_the_number(spark):
    raw = spark.createDataFrame([(json.dumps(facebook()),)], "raw string")
    nested = platforms.normalize_posts(raw, "facebook").withColumn("comments_list", F.to_json("comments"))
    assert threads.explode_comments(nested).count() == 4


def test_kafka_rows_take_json_only(spark):
    with pytest.raises(ValueError):
        sinks.kafka_rows(spark.range(1), value_format="csv")
    assert sinks.kafka_rows(spark.range(1), "id").first().value == '{"id":0}'


def test_texts_are_joined_to_the_versions_that_stay(spark):
    rows = spark.createDataFrame([(k, k % 3, k) for k in range(6)], "event_id long, post_id long, ingest_time long")
    rows = rows.withColumns({"event_time": F.timestamp_millis("event_id"), "source": F.lit("reddit"), "hashtags": F.array(F.lit("X")), **{c: F.lit(1) for c in ("likes", "comments", "shares", "video_views")}})
    texts, seen = spark.createDataFrame([(k, "  " if k == 5 else f"text  of {k}") for k in range(6)], "event_id long, content string"), []

    def attach(latest):
        seen.extend(latest.select("event_id").collect())
        return latest.join(texts, "event_id")

    late, whole = clean.clean(rows, attach=attach), clean.clean(rows.join(texts, "event_id"))
    shown = lambda df: sorted((r.event_id, r.content_clean, r.engagement_tier) for r in df.collect())
    assert shown(late) == shown(whole) == [(3, "text of 3", "low"), (4, "text of 4", "low")] and sorted(r.event_id for r in seen) == [3, 4, 5]


def test_queries_shuffle_no_text_to_tell_versions_apart(spark, tmp_path):
    from feedlake.plans import queries

    d = str(tmp_path)
    spark.range(4).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text")).filter("doc_id <> 2").write.parquet(f"{d}/documents.parquet")
    events = spark.range(20).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit('{"k": 1}').alias("props"))
    events.write.parquet(f"{d}/events.parquet")
    late, whole = queries.cleaned(spark, d), clean.clean(queries.posts(spark, d))
    assert sorted(late.select("event_id", "content_clean").collect()) == sorted(whole.select("event_id", "content_clean").collect()) and late.count() > 5
    assert "content" not in queries.bare_posts(spark, d).columns and "text:string" not in queries.bare_posts(spark, d)._jdf.queryExecution().executedPlan().toString()


def test_clean_write_from_the_tasks_as_they_are(spark, tmp_path):
    path = str(tmp_path)
    df = clean.clean(posts(spark, {}, {"post_id": "q", "source": "other"}))
    for _ in range(2):
        sinks.write_clean(df, path, deal=False)
    got = spark.read.parquet(path)
    assert sorted((r.post_id, r.source) for r in got.collect()) == [("p", "reddit"), ("q", "other")] and all(f.endswith(".zstd.parquet") for f in got.inputFiles())


def test_packed_texts_come_back_and_take_half_the_room(spark, tmp_path):
    rows = [{"post_id": str(k), "content": " ".join(str(hash((k, j))) for j in range(100)) + " https://a.b/c  end"} for k in range(400)]
    df, sizes = clean.clean(posts(spark, *rows)).coalesce(1), []
    for pack in (False, True):
        path = tmp_path / str(pack)
        sinks.write_clean(df, str(path), deal=False, pack=pack)
        sizes.append(sum(f.stat().st_size for f in path.rglob("*.parquet")))
        got = sinks.read_clean(spark, str(path))
        assert set(got.columns) == set(df.columns) and sorted(got.select("post_id", "content", "content_clean").collect()) == sorted(df.select("post_id", "content", "content_clean").collect())
    assert sizes[1] < 0.6 * sizes[0]


def test_upsert_joins_texts_late_and_keeps_rows_by_few_keys_or_few_survivors(spark, tmp_path, monkeypatch):
    text = lambda rows: rows.withColumn("content", F.concat(F.lit("text "), "_id"))
    for few in (0, 3, 1000):
        monkeypatch.setattr(tables, "FEW", few)
        table = tables.BucketTable(spark, str(tmp_path / str(few)), buckets=4)
        table.upsert(keyed(spark, ["1", "2", "3", "4", "5", "6", None], "", "2024-01-01").withColumn("content", F.lit("old")))
        table.upsert(keyed(spark, ["1", "2", "3", "4", "7"], "", "2024-01-02").drop("content"), attach=text, deal=False)
        got = {r._id: r.content for r in table.read().collect()}
        assert got == {k: f"text {k}" for k in "12347"} | {"5": "old", "6": "old", None: "old"} and table.read().count() == 8


def test_white_space_is_collapsed_without_a_match_for_single_blanks(spark):
    rng = random.Random(5)
    spaces = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
    texts = ["".join(rng.choices([*spaces, *"   a", "é", "ạ", "​", "一", "\x1f", "\x08", "\x0e", "\U0001f600"], k=rng.randint(0, 12))) for _ in range(2000)]
    pattern = E.runs(f"[{E.WHITE_SPACE}]")
    df = spark.createDataFrame([(t, re.sub(f"[{spaces}]+", " ", t).strip(" "), re.sub(r"[ \t\n\x0b\f\r]+", " ", t.strip(" ")).strip(" ")) for t in texts], "t string, all string, plain string")
    done = clean.normalize_text(E.with_clean(df, F.col("t"), "clean").withColumns({"content": F.col("t"), "hashtags": F.array()}))
    assert done.filter((F.col("clean") != F.col("all")) | (F.col("content_clean") != F.col("plain"))).count() == 0
    assert spark.range(1).select(F.regexp_count(F.lit("a b c  d\ne f"), F.lit(pattern)).alias("n")).first().n == 2


def test_largest_file_reads_the_list_once(spark):
    files = spark.createDataFrame([("/a/2.json", 9), ("/a/1.json", 9), ("/a/3.json", 5), ("/b/1.json", 0)], "path string, length long").repartition(3)
    best = dedup.largest_file(files)
    assert {tuple(r) for r in best.collect()} == {("/a", "/a/1.json", 9, 3, "cleaned"), ("/b", "/b/1.json", 0, 1, "skipped")}
    assert best._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_largest_file_has_no_checksum_file_beside_each(spark, tmp_path, monkeypatch):
    from feedlake.plans import queries

    monkeypatch.setattr(queries, "scratch_dir", lambda spark, name: str(tmp_path / name))
    found = queries.largest_file(spark, "/root/testdata/sf0.001").agg(F.sum("files").alias("files")).first().files
    names = [f.name for f in (tmp_path / "files").glob("user_id=*/*")]
    assert len(names) == found > 0 and all(n.startswith("part-") for n in names)


def test_posts_land_alike_with_few_texts_and_with_many(spark, tmp_path, monkeypatch):
    from feedlake.plans import queries

    d, landed = str(tmp_path), []
    docs = [(0, "zero"), (1, None), (1, "one"), (2, "two"), (3, "three"), (9, "far")]  # 4 and 5 are missing, 1 comes twice
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    events = spark.range(240).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 2 == 0, "view").otherwise("click").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit('{"k": 1}').alias("props"))
    events.write.parquet(f"{d}/events.parquet")
    for few in (queries.FEW_TEXTS, 10, 1):  # one pass, two, and a shuffle
        monkeypatch.setattr(queries, "FEW_TEXTS", few)
        lake = spark.read.parquet(queries._landed(spark, d))
        landed.append(sorted(map(repr, lake.select(*sorted(lake.columns)).collect())))
    assert landed[0] == landed[1] and len(landed[0]) == 200


def test_posts_land_without_a_shuffle_or_a_sort_of_texts(spark, monkeypatch):
    from feedlake.plans import queries

    written = spark._jsparkSession.sharedState().statusStore().executionsList
    for few, join in ((1, "ShuffledHashJoin"), (1 << 30, "BroadcastHashJoin")):
        monkeypatch.setattr(queries, "FEW_TEXTS", few)
        queries._landed(spark, "/root/testdata/sf0.001")
        plans = [written().apply(k).physicalPlanDescription() for k in range(written().size())]
        plan = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p][-1].split("Initial Plan")[0]
        assert join in plan and plan.count(" Sort (") == 1 and plan.index(join) < plan.index(" Sort (") < plan.index("Exchange (")


def test_jsonl_lines_are_parsed_once_and_packed(spark, tmp_path):
    values = ['{"a": 1}', '\ufeff {"b": 2}', "\t[1, {}]", '\t{"c": 3}', '"{"', "{broken", "  ", "", "\ufeff", "null", "7", None]
    path = str(tmp_path / "lines")
    spark.createDataFrame([(v,) for v in values if v is not None], "value string").coalesce(1).write.text(path, compression="gzip")
    got = {r.raw: r.reject_reason for r in readers.read_jsonl(spark, path).collect()}
    assert got == {'{"a": 1}': None, '{"b": 2}': None, "\t[1, {}]": "not an object", '\t{"c": 3}': None, '"{"': "not an object", "{broken": "malformed", "null": "not an object", "7": "not an object"}
    plan = readers.parse_jsonl(spark.createDataFrame([(v,) for v in values], "value string")).filter("reject_reason IS NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert "schema_of_variant" not in plan and "regexp_replace" not in plan
