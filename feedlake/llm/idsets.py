"""Bloom filters as bitmap rows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKET = 32768  # bits of one row of the bitmap functions
_PROBES = 2


def filter_bits(rows: int, bits_per_row: int = 16, max_bits: int = 1 << 28) -> int:
    """Size of the filter: a power of two, at most ``max_bits``."""
    return min(max_bits, max(_BUCKET, 1 << (max(1, rows * bits_per_row) - 1).bit_length()))


def _cell(key: Column, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(bits))


def bitmaps(df: DataFrame, key: str, bits: int, repeated: bool = False) -> DataFrame:
    """(bucket, bitmap) of the cells that keys hit; with ``repeated``, that two or more insertions hit."""
    cells = df.select(F.explode(F.array(*[_cell(F.col(key), i, bits) for i in range(_PROBES)])).alias("__dd_cell"))
    if repeated:
        cells = cells.groupBy("__dd_cell").agg(F.count("*").alias("__dd_n")).filter("__dd_n > 1")
    cell = F.col("__dd_cell")
    return cells.groupBy(F.floor(cell / _BUCKET).alias("__dd_bucket")).agg(
        F.bitmap_construct_agg(F.pmod(cell, F.lit(_BUCKET))).alias("__dd_bitmap")
    )


def flag(df: DataFrame, key: str, maps: DataFrame, bits: int) -> DataFrame:
    """Add ``__dd_maybe``: all of the key's bits are set. The broadcast holds at most ``bits`` bits."""
    found = F.lit(True)
    for i in range(_PROBES):
        names = {"__dd_bucket": f"__dd_b{i}", "__dd_bitmap": f"__dd_m{i}"}
        cell = _cell(F.col(key), i, bits)
        df = df.join(F.broadcast(maps.withColumnsRenamed(names)), F.floor(cell / _BUCKET) == F.col(f"__dd_b{i}"), "left")
        pos = F.pmod(cell, F.lit(_BUCKET))
        byte = F.conv(F.hex(F.substring(F.col(f"__dd_m{i}"), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        bit = F.call_function("shiftright", byte.cast("int"), F.pmod(pos, F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
        found = found & (F.coalesce(bit, F.lit(0)) == 1)
    return df.withColumn("__dd_maybe", found).drop(*[f"__dd_{x}{i}" for x in "bm" for i in range(_PROBES)])


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with as many underscores behind it as no column of ``df`` needs."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def row_key(id_col: str, text_col: str) -> Column:
    """A row's own key of 128 bits, whatever other rows share its id; rows alike in id and text have one key."""
    name, text = F.col(id_col).cast("string"), F.col(text_col)
    parts = [name.isNull(), F.length(name), name, text.isNull(), text]
    told = F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("|")) for p in parts])
    return F.unhex(F.substring(F.sha2(told, 256), 1, 32))


def without(df: DataFrame, gone: DataFrame, key: str, gone_key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``gone`` (null matches null), with all their columns.

    Rows that a filter of the ids clears are not shuffled; the others meet the ids.
    """
    bits = filter_bits(gone.count())
    flagged = flag(df, key, bitmaps(gone, gone_key, bits), bits)
    unsure = flagged.filter("__dd_maybe").join(gone, F.col(key).eqNullSafe(F.col(gone_key)), "left_anti")
    return flagged.filter(~F.col("__dd_maybe")).unionByName(unsure).select(*df.columns)
