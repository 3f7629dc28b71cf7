"""Importance resampling towards a target: array-scored weights and an exact cutoff by weighted medians of medians."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import class_spans, discard, emit_blocks, lower_ascii, materialize, slices, sum_blocks, text_buffers

_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_BLOCK = 1000


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def _tables(step: np.ndarray) -> np.ndarray:
    """Four tables of 256: what a linear map of 32 bits, given by its values at single bits, makes of each byte."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k // 8, np.flatnonzero(np.arange(256) >> (k % 8) & 1)] ^= step[k]
    return out


def _apply(tables: np.ndarray, x: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """The map of ``tables``, or of the tables that ``which`` picks for each number."""
    parts = [(x >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]
    picked = [tables[k][p] if which is None else tables[which, k, p] for k, p in enumerate(parts)]
    return picked[0] ^ picked[1] ^ picked[2] ^ picked[3]


def _shift_tables(most: int = 64, powers: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Maps of a CRC to that of the data followed by zeros: by 0 to ``most`` - 1 bytes, and by 2^k bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = _tables((bits >> np.uint32(8)) ^ _CRC[bits & np.uint32(255)])
    short, at = [], bits
    for _ in range(most):
        short.append(_tables(at))
        at = _apply(one, at)
    long_ = [one]
    for _ in range(powers):
        long_.append(_tables(_apply(long_[-1], _apply(long_[-1], bits))))
    return np.array(short), np.array(long_)


_SHORT, _POWERS = _shift_tables()


def crc_append(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one after another, from theirs and the second one's size."""
    out = _apply(_SHORT, head, size & (len(_SHORT) - 1))
    left, k = size // len(_SHORT), len(_SHORT).bit_length() - 1
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _apply(_POWERS[k], out[odd])
        left, k = left >> 1, k + 1
    return out ^ tail


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, loop: int = 48) -> np.ndarray:
    """CRC-32 of each span, a byte of all spans at a time; the library's for those of over ``loop`` bytes."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(size <= loop)
    some = some[np.argsort(-size[some], kind="stable")]
    longer = np.searchsorted(-size[some], -np.arange(loop + 1), side="left")  # spans of over k bytes come first
    for k in range(int(size[some].max(initial=0))):
        now = some[: longer[k]]
        x = out[now]
        out[now] = (x >> np.uint32(8)) ^ _CRC[(x & np.uint32(255)) ^ data[starts[now] + k]]
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > loop).tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    return out


def features(data: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every run of one to three words, and each text's number of words."""
    data = lower_ascii(data)
    starts, ends, first = class_spans(data, bounds, _WORD)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    one = span_crcs(data, starts, ends)
    size = ends - starts
    blank = np.full(len(one), zlib.crc32(b" "), np.uint32)
    later = crc_append(blank, one, size)  # a blank and the word
    two = crc_append(one[:-1], later[1:], size[1:] + 1)
    three = crc_append(two[:-1], later[2:], size[2:] + 1)
    pair, triple = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    crc = np.concatenate([one, two[pair], three[triple]])
    return (crc % np.uint32(buckets)).astype(np.int64), np.concatenate([doc, doc[:-1][pair], doc[:-2][triple]]), words


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket."""
    cells = -(-buckets // _BLOCK) * _BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                sums += np.bincount(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)[0], minlength=cells)
        yield emit_blocks(sums, _BLOCK, np.int64)

    return sum_blocks(texts.mapInArrow(count, "block long, counts binary"), cells, _BLOCK, np.int64)[:buckets]


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    n, s, t = len(raw), raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


# A key is (score, id, row): the greater score comes first, then the smaller id, then the row's place in the table.
_KEY = ("score", "id", "row")


def _sides(batch: pa.RecordBatch, key: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows that come before ``key``, rows that come after it)."""
    score, name, row = (batch.column(c).to_numpy() for c in _KEY)
    tie, same = score == key[0], (score == key[0]) & (name == key[1])
    before = (score > key[0]) | (tie & (name < key[1])) | (same & (row < key[2]))
    return before, ~before & ~(same & (row == key[2]))


def comes_before(key: tuple[int, int, int]) -> Column:
    score, name, row = (F.col(c) for c in _KEY)
    return (score > key[0]) | ((score == key[0]) & (name < key[1])) | ((score == key[0]) & (name == key[1]) & (row < key[2]))


def comes_after(key: tuple[int, int, int]) -> Column:
    score, name, row = (F.col(c) for c in _KEY)
    return (score < key[0]) | ((score == key[0]) & (name > key[1])) | ((score == key[0]) & (name == key[1]) & (row > key[2]))


def _medians(keys: DataFrame, pivot: tuple[int, int, int] | None) -> list[tuple[bool, int, tuple[int, int, int]]]:
    """(before the pivot or after it, number of keys there, their median) of each partition; without a pivot all keys count as before."""

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, list] = ([], [])
        for batch in batches:
            masks = _sides(batch, pivot) if pivot else (np.ones(batch.num_rows, bool), np.zeros(batch.num_rows, bool))
            for found, mask in zip(parts, masks, strict=True):
                found.append([batch.column(c).to_numpy()[mask] for c in _KEY])
        out = []
        for before, found in zip((True, False), parts, strict=True):
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            if columns and len(columns[0]):
                k = np.lexsort((columns[2], columns[1], -columns[0]))[len(columns[0]) // 2]
                out.append((before, len(columns[0]), *(int(c[k]) for c in columns)))
        kinds = [pa.bool_(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["before", "n", *_KEY])

    rows = keys.mapInArrow(middle, "before boolean, n long, score long, id long, row long").collect()
    return [(r["before"], r["n"], tuple(r[c] for c in _KEY)) for r in rows]


def cutoff(keys: DataFrame, k: int, rewrite: int = 4) -> tuple[int, int, int] | None:
    """The ``k``-th key (from 1) of a table of keys (score, id, row), which differ; none if there are fewer or ``k`` is 0.

    A round is one job: a task gives the number of its partition's remaining
    keys before and after the pivot and the median of each; the driver gets
    these two rows a partition. The next pivot is the median of the medians
    on the side of the sought key, weighted by the numbers, which has at least
    a quarter of the remaining keys on either side; the other side goes.
    Keys are written anew, in fewer partitions, when ``rewrite`` times fewer remain,
    so that all rounds together read a multiple of the table that
    depends on its size by its logarithm at most.
    """
    table, found = keys, _medians(keys, None)
    total = written = sum(n for _, n, _ in found)
    if not 0 < k <= total:
        return None
    while True:
        ranked = sorted(found, key=lambda f: (-f[2][0], *f[2][1:]))
        reach = np.cumsum([n for _, n, _ in ranked])
        pivot = ranked[int(np.searchsorted(reach, (total + 1) // 2))][2]
        sides = _medians(table, pivot)
        first = sum(n for before, n, _ in sides if before)
        if first == k - 1:
            break
        ahead = k <= first
        k, total = (k, first) if ahead else (k - first - 1, total - first - 1)
        found = [f for f in sides if f[0] == ahead]
        table = table.filter(comes_before(pivot) if ahead else comes_after(pivot))
        if total * rewrite <= written:
            parts, written = max(1, len(found) // rewrite), total
            table, old = materialize(table, parts), table
            found = _medians(table, None)
            discard(old)
    return pivot


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``rank``, from 1 in the order ``order``: sorted by ranges, so that no task holds all rows."""
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(bases), part == F.col("part")).withColumn("rank", rank).select(*df.columns, "rank")


def target_resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least_words: int = 20,
    buckets: int = 10_000,
    seed: int = 42,
    text_col: str = "text",
    id_col: str = "doc_id",
    target_col: str = "text",
) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null where it wasn't drawn).

    Features are runs of one to three words, counted by buckets of their
    CRC-32 over all ``docs`` and all ``target`` texts. A weight is the sum of
    its features' gains, a score the weight with Gumbel noise that depends on
    seed and id alone. Of the documents with ``least_words`` words or more,
    ``percent`` percent (rounded down) with the highest scores are drawn, ties
    to the smaller id; their ranks say in which order.

    Null or empty text, and text without words, has no features and weight 0.
    Ids are integers, or text of such; a null id draws the noise of an empty
    one and loses ties. Rows that share an id share the noise and are drawn
    each for itself; rows alike in id and score are drawn in the order of the table's files.
    Other columns are ignored, in both tables. Without documents there are
    no rows; without target texts, all gains follow from smoothing alone. A task holds one text of any length as a whole.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    model = spark.sparkContext.broadcast(gains(bucket_counts(text.select("text"), buckets), bucket_counts(target.select(target_col), buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = model.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b in slices(offsets):
                bucket, doc, words[a:b] = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                n[a:b] = np.bincount(doc, minlength=b - a)
                weight[a:b] = np.bincount(doc, gain[bucket], minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (n, words, weight))], ["id", "n_features", "words", "weight"])

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialize(
        text.mapInArrow(weigh, "id long, n_features long, words long, weight long")
        .withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    )
    last = F.coalesce("id", F.lit((1 << 63) - 1))  # of a null id
    ready = scored.withColumn("eligible", F.col("words") >= least_words)
    keys = ready.filter("eligible").select("score", last.alias("id"), "row")
    cut = cutoff(keys, percent * keys.count() // 100)
    shown = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    placed = ready.withColumns({"doc": F.col("id"), "id": last})
    drawn = F.col("eligible") & ~comes_after(cut)
    winners = ranked(placed.filter(drawn), [F.col("score").desc(), F.col("id"), F.col("row")]).withColumn("id", F.col("doc"))
    rest = placed.filter(~drawn).withColumn("id", F.col("doc")).withColumn("rank", F.lit(None).cast("long"))
    return winners.select(*shown, "rank").unionByName(rest.select(*shown, "rank"))
