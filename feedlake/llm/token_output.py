"""Token-ID output: Parquet list columns with chosen encodings, row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .tokens import encoded, token_table

#: Columns of the files. ``part_start`` counts ids from the start of the row's file part.
FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_token_files(
    df: DataFrame,
    path: str,
    tokenizer: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    end_id: int = 2,
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2000,
    encoding: str = "dictionary",
) -> None:
    """Write ids in ascending id order, one file part per range of ids.

    ``encoding`` is ``dictionary`` (ids of a vocabulary below 65,536 take two
    bytes or fewer) or ``delta`` (Parquet v2 pages, delta bit packing). The
    writer adds column and offset indexes, so that a reader can fetch the
    metadata columns alone, or the pages of a few documents.

    Null text counts as empty: its only id is ``end_id``. A null id sorts
    first; rows with equal ids are ordered by text. Other columns are ignored.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, part, at = token_table(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, ids, offsets in encoded(batch, "text", table, end_id):
                n = np.diff(offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(at + offsets[:-1]), pa.array(n), lists],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                at += int(offsets[-1])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
    }
    ordered.mapInArrow(tokenize, FILE_SCHEMA).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files with ``start``: the number of ids of all documents before this one.

    Only the ``part`` and ``n_tokens`` columns are read for the starts; the
    broadcast has one row for each file part.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return files.join(F.broadcast(bases), "part").withColumn("start", F.col("__base") + F.col("part_start"))


def token_digest(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, from the ids as read back."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            ends = np.cumsum(n) * 4
            crc = [zlib.crc32(values[b - 4 * k : b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(n), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return files.select("doc_id", "start", "ids").mapInArrow(
        digest, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_round_trip(df: DataFrame, tokenizer: str, end_id: int = 2, **options) -> DataFrame:
    """Write ``df``'s ids to the shared folder, read the files back and digest them."""
    path = shared_dir(df.sparkSession)
    write_token_files(df, path, tokenizer, end_id=end_id, **options)
    return token_digest(read_token_files(df.sparkSession, path))
