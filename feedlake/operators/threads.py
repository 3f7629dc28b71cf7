"""Comment trees as node tables: flatten, deduplicate, visit in order, cap, nest again, explode."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.sources.schemas import COMMENTS

NODES = "post string, path array<int>, depth int, parent_path array<int>, node string, parent string"
_IDS = ("id", "commentId", "comment_id")  # members of a parent that its replies carry


def flatten_tree(df: DataFrame, child_key: str, post_col: str = "post_id", comments_col: str = "comments") -> DataFrame:
    """OP-18: one row per node of the JSON trees in ``comments_col``.

    ``path`` orders a post's nodes depth first; the root's depth is 0. A node
    that is no object is skipped with what is below it. ``parent`` has the ids
    of the node one level up. Only the structure is made here; everything about a node's content is expressions over ``node``.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for post, text in zip(batch.column("post").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                try:
                    roots = json.loads(text) if text else []
                except ValueError:
                    roots = []
                stack = [((i,), c, None) for i, c in reversed(list(enumerate(roots if isinstance(roots, list) else [])))]
                while stack:
                    path, node, parent = stack.pop()
                    if not isinstance(node, dict):
                        continue
                    below = node.get(child_key)
                    rows.append((post, path, len(path) - 1, path[:-1], json.dumps({k: v for k, v in node.items() if k != child_key}, ensure_ascii=False), parent))
                    if isinstance(below, list):
                        ids = json.dumps({k: node[k] for k in _IDS if k in node})
                        stack.extend(((*path, i), c, ids) for i, c in reversed(list(enumerate(below))))
            kinds = [pa.string(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["post", "path", "depth", "parent_path", "node", "parent"])

    return df.select(F.col(post_col).alias("post"), F.col(comments_col).alias("tree")).mapInArrow(walk, NODES)


def flatten_levels(df: DataFrame, child_key: str, path: str, post_col: str = "post_id", comments_col: str = "comments", max_depth: int | None = None) -> DataFrame:
    """OP-18 without Python: the rows of :func:`flatten_tree`, a level of all trees at a time.

    A level's nodes are VARIANT values, taken apart into members and children
    and written below ``path``; the next level is read from there, so that a
    lost executor costs one level, and a tree that fills a task is in many from
    its second level on. The first level without nodes ends it, or ``max_depth``:
    nodes below are neither made nor written. A tree that is no JSON
    array gives no rows, nor does one that repeats a member of an object.
    """
    spark, depth, kinds = df.sparkSession, 0, "array<variant>"
    level = df.select(
        F.col(post_col).cast("string").alias("post"), F.array().cast("array<int>").alias("parent_path"),
        F.lit(None).cast("string").alias("parent"), F.try_parse_json(comments_col).alias("below"),
    )
    while max_depth is None or depth <= max_depth:
        child = level.select("post", "parent_path", "parent", F.posexplode(F.try_variant_get("below", "$", kinds)).alias("at", "child"))
        members = child.withColumn("m", F.try_variant_get("child", "$", "map<string,variant>")).filter(F.col("m").isNotNull())
        part = lambda keep: F.to_json(F.map_filter("m", keep))
        below = F.try_element_at("m", F.lit(child_key))
        members.select(
            "post", F.concat("parent_path", F.array("at")).alias("path"), "parent_path", part(lambda k, _: k != child_key).alias("node"), "parent",
            part(lambda k, _: k.isin(*_IDS)).alias("ids"), below.alias("below"),
        ).write.parquet(f"{path}/depth={depth}")
        written = spark.read.parquet(f"{path}/depth={depth}")
        level = written.select("post", F.col("path").alias("parent_path"), F.col("ids").alias("parent"), "below")
        if level.isEmpty():
            break
        depth += 1
    return spark.read.parquet(path).select("post", "path", F.col("depth").cast("int").alias("depth"), "parent_path", "node", "parent")


def tree_nodes(df: DataFrame, child_key: str, path: str | None = None, max_depth: int | None = None) -> DataFrame:
    """The node table of posts with a ``tree``: flattened by levels below ``path``, without one by the walk; or ``df`` itself if it is such a table."""
    if "parent_path" in df.columns:
        return df
    return flatten_levels(df, child_key, path, comments_col="tree", max_depth=max_depth) if path else flatten_tree(df, child_key, comments_col="tree")


def reply_nodes(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """The node table of posts whose rows (post, node, and columns of ``order``) are a root and its replies.

    The first row of a post in the order ``order``, then by node, is the root. Rows are sorted by
    ranges and written to ``path``; a row's place is counted from its range's
    and those before, so that no task holds a post.
    """
    by = ["post", *order, "node"]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path).withColumn("__part", F.expr("shiftright(__at, 33)"))
    runs = placed.groupBy(F.col("__part").alias("__of"), F.col("post").alias("__post")).agg(F.min("__at").alias("__start"), F.count("*").alias("__n"))
    before = Window.partitionBy("__post").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = (F.col("__part") == F.col("__of")) & F.col("post").eqNullSafe(F.col("__post"))
    nth = (F.col("__before") + F.col("__at") - F.col("__start")).cast("int")
    zero, root = F.array(F.lit(0)), nth == 0
    return placed.join(runs, same).select(
        "post", F.when(root, zero).otherwise(F.array(F.lit(0), nth - 1)).alias("path"), F.when(root, 0).otherwise(1).alias("depth"),
        F.when(root, F.array().cast("array<int>")).otherwise(zero).alias("parent_path"), "node",
    )


def with_parent_key(nodes: DataFrame, key_of: Callable[[Column], Column], key_col: str = "key") -> DataFrame:
    """Add ``parent_key``: the key of the node one level up (null at the root or if that has none).

    ``key_of`` makes a key from a node's JSON; a node table without ``parent`` is joined with itself.
    """
    if "parent" in nodes.columns:
        return nodes.withColumn("parent_key", key_of(F.col("parent")))
    up = nodes.select(F.col("post").alias("up_post"), F.col("path").alias("up_path"), F.col(key_col).alias("parent_key"))
    same = F.col("post").eqNullSafe(F.col("up_post")) & (F.col("parent_path") == F.col("up_path"))
    return nodes.join(up, same, "left").drop("up_post", "up_path")


def first_comments(nodes: DataFrame, key_col: str = "key") -> DataFrame:
    """OP-19: of a post's nodes with one key the first in depth-first order; nodes without a key go.

    Apply it before quality filters: a key counts as seen even if its node is rejected later.
    """
    order = Window.partitionBy("post", key_col).orderBy("path")
    keyed = nodes.filter(F.col(key_col).isNotNull() & (F.col(key_col) != ""))
    return keyed.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def cap_comments(nodes: DataFrame, most: int) -> DataFrame:
    """OP-23: the first ``most`` survivors of each post."""
    order = Window.partitionBy("post").orderBy("path")
    return nodes.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def visit_threads(nodes: DataFrame, cap: int, max_depth: int, key_col: str = "key", on_overflow: str = "stop") -> DataFrame:
    """OP-22 to OP-24: the nodes a depth-first visit emits, where what was visited decides what is visited.

    Needs boolean columns ``cut`` (drop the node's branch) and ``emit``. A
    node without a key or with one already visited cuts its branch; a visited
    node below ``max_depth``, or the cap, ends the post (``on_overflow="prune"``
    cuts only the branch of a node too deep).

    Posts are dealt out by key and sorted once; the visit then streams through
    a partition and holds the keys of one post.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, started, seen, skip_below, stop, out = None, False, set(), None, False, 0
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("post", "depth", key_col, "cut", "emit"))
            for p, depth, key, cut, emit in zip(*columns, strict=True):
                if not started or p != post:
                    post, started, seen, skip_below, stop, out = p, True, set(), None, False, 0
                chosen = False
                if not stop and (skip_below is None or depth <= skip_below):
                    skip_below = None
                    if out >= cap or depth > max_depth:
                        if on_overflow == "prune" and out < cap:
                            skip_below = depth
                        else:
                            stop = True
                    elif not key or key in seen:
                        skip_below = depth
                    else:
                        seen.add(key)
                        if cut:
                            skip_below = depth
                        elif emit:
                            chosen, out = True, out + 1
                            stop = out >= cap
                keep.append(chosen)
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = nodes.repartition("post").sortWithinPartitions("post", "path")
    return dealt.mapInArrow(visit, nodes.schema)


def nest_comments(posts: DataFrame, comments: DataFrame, post_col: str = "post_id") -> DataFrame:
    """OP-25: put (post, path, comment struct) rows back into their posts, in order, with their number."""
    lists = comments.groupBy(F.col("post").alias("__post")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("path", "comment"))), lambda x: x["comment"]).alias("__list")
    )
    joined = posts.drop("comments").join(lists, F.col(post_col) == F.col("__post"), "left")
    made = F.coalesce("__list", F.array().cast(COMMENTS))
    return joined.withColumn("comments", made).withColumn("comments_normalized_count", F.size(made)).drop("__list", "__post")


def explode_comments(df: DataFrame, list_col: str = "comments_list") -> DataFrame:
    """OP-26: one row per comment of flat posts, whose list is JSON text or an array."""
    column = F.col(list_col)
    if df.schema[list_col].dataType.simpleString() == "string":
        column = F.from_json(column, COMMENTS)
    return df.select(F.inline(column))
