"""Merkle fixity audit of WARC replicas.

Every record is hashed; the hashes of a file's records in ordered offset
ranges are hashed again, level by level, into one tree per file and one over
the files. Two replicas are compared from the root down, and only children of
mismatching nodes are compared further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, task_count


def warc_records(pages: DataFrame, pages_per_file: int = 512, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Response records (file, offset, length, record_id, payload) of ``pages``, laid out in id order.

    A file holds the pages of ``pages_per_file`` consecutive ids, so its
    window is bounded. Null url or body counts as empty. Rows without an id
    are dealt to files -1, -2, ... by a hash of their payload, one file for each ``pages_per_file`` of them,
    and ordered by payload; those alike in url and body share a file. A text of any length is one record.
    Repeated rows are records each; an empty table gives none; other columns are ignored.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    url = F.coalesce(F.col(url_col), F.lit(""))
    payload = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )
    rows = pages.select(
        F.coalesce(F.floor(F.col(id_col) / pages_per_file), F.lit(-1)).cast("long").alias("file"),
        F.col(id_col).cast("long").alias("record_id"), payload.alias("payload"),
    ).withColumn("length", F.octet_length("payload").cast("long"))
    nameless = pages.filter(F.col(id_col).isNull()).count()
    dealt = -1 - F.pmod(F.xxhash64("payload"), F.lit(1 + nameless // pages_per_file))
    rows = rows.withColumn("file", F.when(F.col("record_id").isNull(), dealt).otherwise(F.col("file")))
    order = Window.partitionBy("file").orderBy("record_id", "payload").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).select("file", "offset", "length", "record_id", "payload")


def leaf_hashes(records: DataFrame) -> DataFrame:
    """One row per record without its payload: file, offset, length, record_id, hash."""
    return records.select("file", "offset", "length", "record_id", F.unhex(F.sha2(F.coalesce(F.col("payload"), F.lit("")).cast("binary"), 256)).alias("hash"))


def _combine(order: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(order, "hash")))
    parts = F.transform(pairs, lambda x: F.concat(x[order].cast("string"), F.lit(":"), F.hex(x["hash"]), F.lit(";")))
    return F.unhex(F.sha2(F.concat_ws("", parts), 256)).alias("hash")


def tree_levels(leaves: DataFrame, leaf_range: int, fanout: int, file_levels: int, top_levels: int, parts: int | None = None) -> list[DataFrame]:
    """Node tables (file, node, hash) from offset ranges of ``leaf_range`` bytes up to the root.

    Level k has ranges of ``leaf_range * fanout**k`` bytes within a file; the
    top levels group files by number. A node collects at most ``fanout``
    hashes, the lowest one the records that start within ``leaf_range`` bytes.
    """
    levels = [materialize(leaves.groupBy("file", F.floor(F.col("offset") / leaf_range).alias("node")).agg(_combine("offset")), parts)]
    for _ in range(file_levels):
        up = levels[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("parent")).agg(_combine("node")).withColumnRenamed("parent", "node")
        levels.append(materialize(up, parts))
    files = levels[-1].groupBy("file").agg(_combine("node")).withColumnRenamed("file", "node")
    levels.append(materialize(files.select(F.lit(None).cast("long").alias("file"), "node", "hash"), parts))
    for _ in range(top_levels):
        up = levels[-1].groupBy(F.floor(F.col("node") / fanout).alias("parent")).agg(_combine("node"))
        levels.append(materialize(up.select(F.lit(None).cast("long").alias("file"), F.col("parent").alias("node"), "hash"), parts))
    root = levels[-1].groupBy(F.lit(0).cast("long").alias("root")).agg(_combine("node"))
    levels.append(materialize(root.select(F.lit(None).cast("long").alias("file"), F.col("root").alias("node"), "hash"), 1))
    return levels


def _levels(most: int, fanout: int) -> int:
    """Groupings by ``fanout`` until nodes 0..most are one."""
    n = 0
    while most > 0:
        most, n = most // fanout, n + 1
    return n


def fixity_audit(left: DataFrame, right: DataFrame, leaf_range: int = 1 << 16, fanout: int = 16) -> DataFrame:
    """Records whose bytes differ between two replicas, located by descent.

    ``left`` and ``right`` are :func:`leaf_hashes` tables. Returns file,
    offset, record_id, kind (``altered``, ``missing`` or ``extra`` in the right
    replica), left_sha256 and right_sha256. Equal replicas, empty ones
    included, give no rows. Records repeated at one offset count once per
    distinct hash.
    """
    sides = [materialize(x.distinct()) for x in (left, right)]
    most = sides[0].unionByName(sides[1]).agg(F.max("offset").alias("o"), F.max(F.abs("file")).alias("f"), (F.count("*") * 64).alias("n")).first()
    file_levels = _levels((most["o"] or 0) // leaf_range, fanout)
    top_levels = _levels(most["f"] or 0, fanout)
    parts = task_count(left.sparkSession, most["n"] or 0)
    trees = [tree_levels(side, leaf_range, fanout, file_levels, top_levels, parts) for side in sides]
    levels = list(zip(*trees, strict=True))
    bad = None
    for k in range(len(levels) - 1, -1, -1):
        a, b = levels[k]
        if bad is not None:  # only children of mismatching nodes
            if k == file_levels:  # a file's top ranges below the file's own node
                child = F.col("file") == F.col("bad_node")
            elif k < file_levels:
                child = F.col("file").eqNullSafe(F.col("bad_file")) & (F.floor(F.col("node") / fanout) == F.col("bad_node"))
            elif k == len(levels) - 2:
                child = F.col("bad_node") == 0
            else:
                child = F.floor(F.col("node") / fanout) == F.col("bad_node")
            a, b = (x.join(bad, child, "left_semi") for x in (a, b))
        both = a.select("file", "node", F.col("hash").alias("l")).join(
            b.select(F.col("file").alias("rf"), F.col("node").alias("rn"), F.col("hash").alias("r")),
            F.col("file").eqNullSafe(F.col("rf")) & (F.col("node") == F.col("rn")), "full_outer",
        )
        bad = materialize(
            both.filter(~F.col("l").eqNullSafe(F.col("r"))).select(F.coalesce("file", "rf").alias("bad_file"), F.coalesce("node", "rn").alias("bad_node")), parts
        )
    hit = (F.col("file") == F.col("bad_file")) & (F.floor(F.col("offset") / leaf_range) == F.col("bad_node"))
    a, b = (x.join(bad, hit, "left_semi") for x in sides)
    at = ["file", "offset"]
    same = [*at, "length", "record_id", "hash"]
    gone = a.join(b.select(*same), same, "left_anti").select(*at, "record_id", F.col("hash").alias("l"))
    new = b.join(a.select(*same), same, "left_anti").select(*[F.col(c).alias(f"r_{c}") for c in (*at, "record_id")], F.col("hash").alias("r"))
    joined = gone.join(new, (F.col("file") == F.col("r_file")) & (F.col("offset") == F.col("r_offset")), "full_outer")
    return joined.select(
        F.coalesce("file", "r_file").alias("file"),
        F.coalesce("offset", "r_offset").alias("offset"),
        F.coalesce("record_id", "r_record_id").alias("record_id"),
        F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("altered").alias("kind"),
        F.lower(F.hex("l")).alias("left_sha256"),
        F.lower(F.hex("r")).alias("right_sha256"),
    )


def damaged_copy(records: DataFrame) -> DataFrame:
    """A replica with deterministic faults, for drills: by the MD5 of its
    offset and id, one record in 16 loses its last five characters and one in 256 is lost."""
    digest = F.md5(F.concat_ws("/", "file", "offset", "record_id").cast("binary"))
    kept = records.filter(~digest.startswith("ab"))
    return kept.withColumn("payload", F.when(digest.startswith("7"), F.expr("substring(payload, 1, length(payload) - 5)")).otherwise(F.col("payload")))
