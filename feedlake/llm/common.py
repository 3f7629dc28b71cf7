"""Shared helpers: durable intermediate tables and vectorised text hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task, so that numpy temporaries stay small.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, a local one, on a local master only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("feedlake.scratch", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("feedlake.scratch", base)
    return f"{base.rstrip('/')}/feedlake-{uuid.uuid4().hex}"


def task_count(spark: SparkSession, nbytes: int, per_task: int = 4 << 20) -> int:
    """Tasks for a table made of ``nbytes`` of text: two a core, or as many as take ``per_task`` each."""
    return max(2 * spark.sparkContext.defaultParallelism, nbytes // per_task)


def materialize(df: DataFrame, parts: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage with files that every executor can read again, so a lost
    executor costs a re-read and not a recomputation. ``parts`` bounds the
    number of files (and of the tasks that write them) from above, so that a
    small table isn't scattered over all shuffle partitions.
    """
    path = shared_dir(df.sparkSession)
    narrow = df if parts is None else df.coalesce(parts)
    narrow.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.feedlake_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`materialize` whose last reader is done; others are left alone.

    The driver's heap is collected, too: Spark removes the shuffle files of
    plans that nothing refers to any more only after a collection.
    """
    for df in tables:
        path = getattr(df, "feedlake_path", None)
        jvm = df.sparkSession._jvm
        if path is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    if tables:
        gc.collect()
        jvm.java.lang.System.gc()


def hottest(names: DataFrame, count: str, most: int, step: int = 8) -> float:
    """A bound that at most ``most`` rows' ``count`` exceeds; ``step`` bounds are tried for each power of two."""
    grade = F.floor(F.log2(F.greatest(F.col(count), F.lit(1))) * step)
    left, bound = most, 0.0
    for row in names.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"), F.max(count).alias("top")).orderBy(F.col("grade").desc()).collect():  # 64 * step rows at most
        left -= row["n"]
        if left < 0:
            bound = float(row["top"])
            break
    return bound


def join_names(rows: DataFrame, names: DataFrame, keys: list[str], count: str, how: str = "inner", share: float = 1e-3, bound: float | None = None) -> DataFrame:
    """``rows`` joined with ``names`` (materialized; one row for each key, ``count`` how often rows have it), ``how`` inner or left.

    Keys that more than ``share`` of the counted rows have are at most
    ``1 / share``; they join by a broadcast of that size, so that the rows of a
    hot key stay where they are. ``bound`` (of :func:`hottest`) replaces the share.
    """
    bound = (names.agg(F.sum(count)).first()[0] or 0) * share if bound is None else bound
    hot = F.broadcast(names.filter(F.col(count) > bound).drop(count))
    cold = names.filter(F.col(count) <= bound).drop(count)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return rows.join(hot, keys).unionByName(rest)


def text_buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings (as UTF-8) or byte strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    column = column.cast(wide)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes; a longer text forms a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = (~_SPACE).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG_SPAN = 1024


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a little-endian number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def _tail(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """``x`` with its bytes from ``left`` on cleared."""
    bits = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
    return np.where(left >= 8, x, x & ((np.uint64(1) << bits) - np.uint64(1)))


def join(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hash of the pair (h, x). No polynomial: a shift lies between any two products."""
    h = (h ^ (h >> np.uint64(29))) * _ODD + x
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each span, eight bytes at a time; whoever lacks the seed can't aim at collisions."""
    view, size = loads(data), (ends - starts).astype(np.int64)
    h = mix(size.astype(np.uint64) * _ODD + np.uint64(seed))
    h = join(h, _tail(view[starts], size))
    some = np.flatnonzero(size > 8)
    long_ = some[size[some] > _LONG_SPAN]
    some = some[size[some] <= _LONG_SPAN]
    at, left = starts[some] + 8, size[some] - 8
    while len(some):
        h[some] = join(h[some], _tail(view[at], left))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for k in long_.tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return mix(h)


def same_spans(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, size: np.ndarray) -> bool:
    """Whether each span of ``x`` has the bytes of its span of ``y``."""
    x_view, y_view = loads(x), loads(y)
    while len(size):
        if (_tail(x_view[x_at] ^ y_view[y_at], size) != 0).any():
            return False
        more = size > 8
        x_at, y_at, size = x_at[more] + 8, y_at[more] + 8, size[more] - 8
    return True


def window_hashes(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` >= 8 bytes from each position on, by doubling: the hash of two halves is that of the pair."""
    h, have = loads(data)[: max(0, len(data) - 7)] ^ np.uint64(seed), 8
    h = mix(h)
    while have < length and len(h):
        step = min(have, length - have)
        h = join(h[: len(h) - step], h[step:])
        have += step
    return h


def row_hash_start(n: int, seed: int = 0) -> np.ndarray:
    """Start of :func:`row_hash_step`, which hashes equally long rows of bytes one column at a time."""
    return np.full(n, np.uint64(seed) ^ _ODD, np.uint64)


def row_hash_step(h: np.ndarray, column: np.ndarray) -> np.ndarray:
    return join(h, column.astype(np.uint64))


def class_spans(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one kind of byte (kind 0: none) and each text's first run.

    ``bounds`` are the texts' byte offsets in ``data``; no run crosses them.
    """
    n = len(data)
    k = kind[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = k[1:] != k[:-1]
    edge[bounds] = True
    starts = np.flatnonzero(edge[:n] & (k > 0))
    ends = np.flatnonzero(edge[1:] & (k > 0)) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the words ``[^\\x20\\x09-\\x0D]+`` and each text's first word index."""
    return class_spans(data, bounds, _WORD)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def sum_blocks(df: DataFrame, cells: int, block: int = 1 << 14, kind: type = np.uint32) -> np.ndarray:
    """Sums of the numbers that tasks emit as (block number, numbers of ``kind``): ``cells`` in all.

    Partial sums meet in a shuffle on the block number; a task holds the sums
    of its blocks and no more, and the driver gets ``cells`` numbers.
    """
    wide = float if kind is float else np.int64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(raw.as_buffer(), kind)
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.astype(wide)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"]
        )

    out = np.zeros(cells, wide)
    for row in df.repartition(max(1, min(64, cells // block)), "block").mapInArrow(add, "block long, counts binary").coalesce(16).toLocalIterator():
        at = int(row["block"]) * block
        out[at : at + block] += np.frombuffer(bytes(row["counts"]), wide)
    return out


def emit_blocks(counts: np.ndarray, block: int = 1 << 14, kind: type = np.uint32) -> pa.RecordBatch:
    """A task's numbers as rows for :func:`sum_blocks`."""
    parts = counts.astype(kind).reshape(-1, block)
    some = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int64)), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["block", "counts"]
    )


def bit_filter(df: DataFrame, key: str, bits_per_row: int = 16, max_bits: int = 1 << 28) -> np.ndarray:
    """Bloom filter (two probes) of a well-mixed long column, as packed bits on the driver.

    Bounded by ``max_bits`` (32 MB); a fuller filter only lets more through.
    """
    bits = min(max_bits, max(1 << 15, 1 << (max(1, df.count() * bits_per_row) - 1).bit_length()))
    probes = [F.col(key).bitwiseAND(F.lit(bits - 1)), F.call_function("shiftrightunsigned", F.col(key), F.lit(32)).bitwiseAND(F.lit(bits - 1))]
    cells = df.select(F.explode(F.array(*probes)).alias("c"))
    maps = cells.groupBy(F.floor(F.col("c") / 32768).alias("b")).agg(F.bitmap_construct_agg(F.pmod("c", F.lit(32768))).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.coalesce(16).toLocalIterator():
        out[row["b"] * 4096 : (row["b"] + 1) * 4096] = np.frombuffer(bytes(row["m"]), np.uint8)
    return out


def maybe_in(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit keys may be in a :func:`bit_filter`."""
    mask = np.uint64(len(filter_) * 8 - 1)
    ok = np.ones(len(keys), bool)
    for c in (keys & mask, (keys >> np.uint64(32)) & mask):
        ok &= (filter_[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok
