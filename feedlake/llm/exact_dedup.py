"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes every row and counts the filter's cells; a cell that more than
one insertion hit becomes a set bit. Pass 2 looks each row's cells up: a row
with a clear bit is certainly unique and passes straight through; only rows
whose bits are all set shuffle. The filter never drops a row, so a full
filter costs shuffle volume and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .idsets import bitmaps, filter_bits, flag

def _hashed(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return df.select(F.col(id_col).alias("__dd_id"), F.unhex(sha).alias("__dd_sha"))


def _groups(maybe: DataFrame) -> DataFrame:
    """(sha, keep, size) of the groups among possibly repeated (sha, id, copies)."""
    return maybe.groupBy("__dd_sha").agg(F.max("__dd_id").alias("__dd_keep"), F.sum("__dd_copies").alias("__dd_size"))


def exact_dedup(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    bits_per_row: int = 16,
    max_bits: int = 1 << 28,
    hot_share: float = 1e-3,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the largest id
    stays; a null id is smaller than any other. Rows that repeat the same id
    and text are one group, of which one row is kept. Other columns are
    ignored. An empty table gives no rows.

    ``max_bits`` bounds the broadcast filter (32 MB by default). Groups above
    ``hot_share`` of all rows number at most ``1 / hot_share``; they join by a
    broadcast of that proven size, so a hot group never lands in one task.
    """
    hashed = materialize(_hashed(df, text_col, id_col))
    rows = hashed.count()
    bits = filter_bits(rows, bits_per_row, max_bits)
    maps = bitmaps(hashed, "__dd_sha", bits, repeated=True)
    flagged = materialize(flag(hashed, "__dd_sha", maps, bits))

    single = flagged.filter(~F.col("__dd_maybe")).select(
        "__dd_id", "__dd_sha", F.col("__dd_id").alias("__dd_keep"), F.lit(1).cast("long").alias("__dd_size"), F.lit(1).cast("long").alias("__dd_copy")
    )
    maybe = materialize(
        flagged.filter("__dd_maybe").groupBy("__dd_sha", "__dd_id").agg(F.count("*").alias("__dd_copies"))
    )
    groups = materialize(_groups(maybe))
    is_hot = F.col("__dd_size") > F.lit(max(1.0, rows * hot_share))
    hot = F.broadcast(groups.filter(is_hot))
    joined = (
        maybe.join(hot, "__dd_sha")
        .unionByName(
            maybe.join(hot.select("__dd_sha"), "__dd_sha", "left_anti").join(groups.filter(~is_hot), "__dd_sha")
        )
        .select(
            "__dd_id", "__dd_sha", "__dd_keep", "__dd_size",
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("__dd_copies"))).alias("__dd_copy"),
        )
    )
    both = single.unionByName(joined)
    return both.select(
        F.col("__dd_id").alias(id_col),
        F.col("__dd_keep").alias("keep_id"),
        F.col("__dd_size").alias("group_size"),
        (F.col("__dd_id").eqNullSafe(F.col("__dd_keep")) & (F.col("__dd_copy") == 1)).alias("kept"),
        F.lower(F.hex("__dd_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", bits_per_row: int = 16, max_bits: int = 1 << 28
) -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, with all their columns.

    Unique rows are not shuffled; possibly repeated ones meet the keepers on
    (hash, id), a key that no hot group dominates.
    """
    hashed = materialize(_hashed(df, text_col, id_col))
    bits = filter_bits(hashed.count(), bits_per_row, max_bits)
    maps = materialize(bitmaps(hashed, "__dd_sha", bits, repeated=True))
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    flagged = flag(df.withColumn("__dd_sha", sha), "__dd_sha", maps, bits)
    few = flag(hashed, "__dd_sha", maps, bits).filter("__dd_maybe").withColumn("__dd_copies", F.lit(1))
    keep = _groups(few).select(F.col("__dd_sha").alias("__dd_ksha"), "__dd_keep")
    wide = flagged.filter("__dd_maybe")
    kept = wide.join(
        keep, (F.col("__dd_sha") == F.col("__dd_ksha")) & F.col(id_col).eqNullSafe(F.col("__dd_keep")), "left_semi"
    ).dropDuplicates(["__dd_sha", id_col])
    return flagged.filter(~F.col("__dd_maybe")).unionByName(kept).select(*df.columns)
