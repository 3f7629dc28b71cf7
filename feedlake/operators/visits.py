"""Which nodes of comment trees a depth-first visit emits, for posts of any size: interval tests over a sorted table.

The visit of :func:`feedlake.operators.threads.visit_threads` walks a post in
one task. Here a node has its place in the depth-first order of the whole
table, and a branch is an interval of places; "inside a cut branch", "already
visited" and "after the stop" are comparisons with running maxima and minima,
which are carried from one range of the order to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(rows: DataFrame, by: list[str], path: str) -> DataFrame:
    """``rows`` sorted by ranges of ``by`` and written to ``path``, with ``at`` (place in the order) and ``range``."""
    rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path).withColumn("range", F.shiftright("at", 33).cast("int"))


def running(rows: DataFrame, value: Column, into: str, how: str = "max") -> DataFrame:
    """Add ``into``: the maximum, or sum, of ``value`` over a post's earlier rows in the order ``at`` (null if there are none).

    A window covers the part of a post that lies in one range; what the ranges
    before have is one row for each post and range and is added to it.
    """
    fold = F.max if how == "max" else F.sum
    rows = rows.withColumn("__value", value)
    part = Window.partitionBy("post", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("__post").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(F.col("post").alias("__post"), F.col("range").alias("__range")).agg(fold("__value").alias("__sum"))
    carried = ends.withColumn("__carry", fold("__sum").over(earlier)).drop("__sum")
    same = F.col("post").eqNullSafe(F.col("__post")) & (F.col("range") == F.col("__range"))
    met = rows.withColumn("__near", fold("__value").over(part)).join(carried, same, "left")
    both = F.greatest("__near", "__carry") if how == "max" else F.coalesce(F.col("__near") + F.col("__carry"), "__near", "__carry")
    return met.withColumn(into, both).drop("__value", "__near", "__carry", "__post", "__range")


def placed_nodes(nodes: DataFrame, max_depth: int, path: str, key_col: str) -> DataFrame:
    """Nodes down to one below ``max_depth``, in depth-first order, with ``enter`` and ``leave``: text that sorts as the order does.

    A branch is what sorts from its node's ``enter`` up to ``leave``. Deeper nodes can't be
    reached: the visit ends, or turns back, at the first one below ``max_depth``.
    """
    enter = F.array_join(F.transform("path", lambda i: F.lpad(F.hex(i), 8, "0")), "")
    near = nodes.filter(F.col("depth") <= max_depth + 1).withColumn("enter", enter).withColumn("visit_key", F.nullif(F.col(key_col), F.lit("")))
    return ordered(near, ["post", "enter"], path).withColumn("leave", F.concat("enter", F.lit("g")))


def _outside(nodes: DataFrame, cut: Column) -> DataFrame:
    """Nodes in no branch of a ``cut`` node above them: no earlier cut branch of the post ends behind them."""
    swept = running(nodes, F.when(cut, F.col("leave")), "__until")
    return swept.filter(F.col("__until").isNull() | (F.col("__until") < F.col("enter"))).drop("__until")


def _with_first(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Add ``first``: the first place in ``seen`` of the node's key in its post."""
    first = seen.groupBy(F.col("post").alias("__post"), F.col("visit_key").alias("__key")).agg(F.min("at").alias("first"))
    same = F.col("post").eqNullSafe(F.col("__post")) & (F.col("visit_key") == F.col("__key"))
    return nodes.join(first, same, "left").drop("__post", "__key")


def visit_wide(
    nodes: DataFrame, cap: int, max_depth: int, path: str, key_col: str = "key", on_overflow: str = "stop"
) -> DataFrame:
    """OP-22 to OP-24: the rows that ``visit_threads`` emits; no task holds a post. ``path`` is a folder for steps between.

    Whether a node repeats a visited key depends on which earlier nodes are
    visited, and that on their ancestors' repeats. So a set of nodes that may
    be visited and one of nodes that surely are close in on each other: a
    surely visited key makes later ones repeats, a key that can't have come before makes none. Each round settles
    at least the first open node of every post; the rounds are as many as repeats decide about each other, two for most tables.
    """
    spark = nodes.sparkSession
    table = placed_nodes(nodes, max_depth, f"{path}/nodes", key_col)
    deep = F.col("depth") > max_depth
    closed = deep | F.col("visit_key").isNull()
    narrow = table.select("post", "range", "at", "enter", "leave", "depth", "visit_key", "cut")
    fixed = closed | F.coalesce(F.col("cut"), F.lit(False))

    def step(seen: DataFrame, name: str) -> DataFrame:
        """Nodes visited if the repeats are those that ``seen`` makes: each after the first place of its key there."""
        repeat = F.coalesce(F.col("first") < F.col("at"), F.lit(False))
        marked = _with_first(narrow, seen).withColumn("repeat", repeat & ~closed)
        _outside(marked, fixed | F.col("repeat")).filter(~closed & ~F.col("repeat")).select("post", "at", "visit_key").write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    may, number = step(narrow.filter(F.lit(False)), "may-0"), 0
    while True:
        sure = step(may, f"sure-{number}")
        number += 1
        if sure.count() == may.count():
            break
        may = step(sure, f"may-{number}")

    # What is reached too deep ends the post, if it is outside all cut branches; visited nodes' keys tell the repeats.
    visited = sure.select(F.col("at").alias("__at"), F.lit(True).alias("visited"))
    found = table.join(visited, F.col("at") == F.col("__at"), "left").drop("__at")
    if on_overflow == "stop":
        repeat = ~closed & F.col("visited").isNull()  # nodes in cut branches change nothing there
        reached = _outside(found.select("post", "range", "at", "enter", "leave", "depth", (closed & ~deep | repeat | F.coalesce(F.col("cut"), F.lit(False))).alias("ends")), F.col("ends"))
        stops = reached.filter(deep).groupBy(F.col("post").alias("__post")).agg(F.min("at").alias("__stop"))
        found = found.join(stops, F.col("post").eqNullSafe(F.col("__post")), "left").filter(F.col("__stop").isNull() | (F.col("at") < F.col("__stop"))).drop("__post", "__stop")
    out = running(found.filter(F.col("visited") & F.col("emit") & ~F.col("cut")), F.lit(1), "__before", how="sum")
    return out.filter(F.coalesce("__before", F.lit(0)) < cap).select(*nodes.columns)
