"""Best-fit packing by minimum bin slack.

A sequence's fullest filling depends only on how many pieces of each length
remain, so the packer works on the histogram of lengths: at most
``capacity`` rows, however many documents there are. Each filling found is
removed as often as its lengths last, which bounds the number of subset-sum
runs by the number of lengths and not by the number of sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoded, token_table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``.

    Bit s of the set says that s can be reached; a length's copies enter in
    binary groups; earlier (longer) lengths are preferred.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + k
            total -= length * k
    return out


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """[(first sequence, number of sequences, [(length, copies), ...]), ...].

    Minimum bin slack: each bin takes the longest piece left and then the
    combination that leaves the least slack.
    """
    counts, out, first = {k: v for k, v in counts.items() if v > 0}, [], 0
    while counts:
        seed = max(counts)
        rest = Counter(counts)
        rest[seed] -= 1
        bin_ = Counter({seed: 1}) + Counter(fullest(+rest, capacity - seed))
        times = min(counts[x] // k for x, k in bin_.items())
        out.append((first, times, sorted(bin_.items(), reverse=True)))
        first += times
        for x, k in bin_.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
    return out


def cut_pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, text_col: str, id_col: str) -> DataFrame:
    """The pieces of each document; ``nth`` counts the pieces of one length within a task."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, part, seen = token_table(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, ids, offsets in encoded(batch, "text", table, end_id):
                n = np.diff(offsets)
                many = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                order = np.argsort(length, kind="stable")
                kinds, first, times = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) + np.repeat(seen[kinds] - first, times)
                seen[kinds] += times
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip((offsets[row] + start).tolist(), (offsets[row] + start + length).tolist(), strict=True)]
                columns = [piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(row), part, np.int32), nth]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, len(n)).take(pa.array(row)), *map(pa.array, columns)], [x.split()[0] for x in PIECES.split(", ")]
                )

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(tokenize, PIECES)


def pack(
    df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its text's and then ``end_id``; only documents above
    ``capacity`` are cut. Null text counts as empty (one piece with the end id
    alone). Repeated rows are packed each; a null doc_id stays null. Columns
    other than these two are ignored; an empty table gives no rows.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the
    driver. A piece's rank among those of its length, which decides its
    place, is a task's offset plus its rank within the task, so a length that
    a third of all documents have is spread over the tasks.
    """
    spark = df.sparkSession
    pieces = materialize(cut_pieces(df, tokenizer, capacity, end_id, text_col, id_col))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialize(by_part.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = firsts.groupBy("length").agg(F.sum("n").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in histogram.collect()}

    used, keys, shape = Counter(), [], []
    for first, times, items in plan_sequences(counts, capacity):
        offset = 0
        for length, copies in items:
            keys.append((length << 44) + used[length])
            shape.append((first, copies, offset))
            used[length] += copies * times
            offset += copies * length
    order = np.argsort(keys, kind="stable") if keys else np.zeros(0, np.int64)
    table = spark.sparkContext.broadcast(
        (np.array(keys, np.int64)[order], np.array(shape, np.int64).reshape(-1, 3)[order])
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, shapes = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            key = (length << 44) + batch.column("rank").to_numpy()
            i = np.searchsorted(starts, key, side="right") - 1
            first, copies, offset = shapes[i].T
            nth = key - starts[i]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first + nth // copies), pa.array(offset + nth % copies * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(firsts.drop("n").hint("merge"), ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
