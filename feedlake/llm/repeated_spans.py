"""Removal of repeated byte strings by distributed prefix doubling.

Positions are named by the string of growing length that starts there: the
name of a string is the least position that has it, and the name of a longer
string comes from the pair (name here, name at an offset), sorted and grouped
by Spark. A position leaves as soon as its string is unique.

To keep the rounds small, only the surroundings of anchors take part. An
anchor is the position whose 100-byte string has the least hash in some 301
consecutive positions; every 400-byte string holds one, and equal strings hold
theirs at the same place. The start positions with one anchor are its run.
Anchors whose 100-byte string is unique leave first, and of runs that repeat
as a whole, one stands for all. The rounds then name the strings of 50, 100
and 200 bytes at steps of 50 around the anchors of the other runs, by the
pair of names at an offset of 50 and of 100, and those of 350 bytes by two
names of 200 bytes that overlap (offset 150). Start positions between two
steps extend the name of the 350 bytes that all of them contain by the bytes
left and right of these: ten positions at a time, and at last one by one
where the ten do not agree.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, discard, join, join_names, materialize, maybe_in, mix, slices, span_hashes, task_count, text_buffers, window_hashes

_LOW = 23  # bits of a position within a part of a text
_PART = 1 << 22  # start positions handled at once
_NODES = 16  # places of a run's blocks in the number of a position


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int, seed: int) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start, gram hash) for each run of start positions with one anchor.

    Start positions are those from which ``length`` bytes fit into their text.
    """
    n, width = len(data), length - gram + 1
    h = mix(window_hashes(data, gram, seed))
    key = (h & ~np.uint64((1 << _LOW) - 1)) | (np.uint64((1 << _LOW) - 1) - np.arange(len(h), dtype=np.uint64))
    whole = -len(key) % width
    rows = np.concatenate([key, np.full(whole, ~np.uint64(0))]).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(after[: n - length + 1], before[width - 1 : n - gram + 1][: n - length + 1])
    at = ((1 << _LOW) - 1 - (least & np.uint64((1 << _LOW) - 1)).astype(np.int64))
    inside = np.zeros(n + 1, np.int32)
    sizes = np.diff(bounds)
    fits = sizes >= length
    np.add.at(inside, bounds[:-1][fits], 1)
    np.add.at(inside, bounds[1:][fits] - length + 1, -1)
    ok = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
    if not len(ok):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    x = at[ok]
    new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (ok[1:] != ok[:-1] + 1)))
    last = np.append(new[1:], len(ok)) - 1
    return x[new], ok[new], ok[last], h[x[new]]


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of texts as (text, anchor, first, last, gram) with positions within their text."""
    for a, b in slices(offsets):
        if b == a + 1 and offsets[b] - offsets[a] > _PART:  # a very long text, in parts that share length - 1 bytes
            size = int(offsets[b] - offsets[a])
            for p in range(0, max(1, size - length + 1), _PART):
                part = data[offsets[a] + p : min(offsets[a] + p + _PART + length - 1, offsets[b])]
                x, first, last, h = _anchors(part, np.array([0, len(part)]), length, gram, seed)
                yield np.full(len(x), a), x + p, first + p, last + p, h
            continue
        part = data[offsets[a] : offsets[b]]
        if len(part) < length:
            continue
        bounds = offsets[a : b + 1] - offsets[a]
        x, first, last, h = _anchors(part, bounds, length, gram, seed)
        text = np.searchsorted(bounds, x, side="right") - 1
        yield text + a, x - bounds[text], first - bounds[text], last - bounds[text], h


def _hash128(raw: bytes, seed: int) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(raw, seed)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _two(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, int]) -> list[np.ndarray]:
    """128 bits of hash for each span, as two columns."""
    return [span_hashes(data, starts, ends, s).view(np.int64) for s in seeds]


def _lists(values: np.ndarray, text: np.ndarray, rows: int, kind: pa.DataType) -> pa.ListArray:
    """One list per row; ``text`` (ascending) says whose value each is."""
    ends = np.searchsorted(text, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def _rerank(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(run, k, w, rank) of the positions whose ``keys`` occur more than once; the rank is the least position that has them."""
    position = F.col("run") * _NODES + F.col("k")
    names = materialize(rows.groupBy(*keys).agg(F.sum("w").alias("__n"), F.min(position).alias("__rank")).filter("__n > 1"), parts)
    return materialize(join_names(rows, names, keys, "__n").select("run", "k", "w", F.col("__rank").alias("rank")), parts)


def _pairs(ranked: DataFrame, offset: int, parts: int) -> DataFrame:
    """(run, k, w, rank, next): each position's rank with that ``offset`` steps on, where both are left."""
    there = Window.partitionBy("run").orderBy("k").rangeBetween(offset, offset)
    return materialize(ranked.withColumn("next", F.max("rank").over(there)).filter("next IS NOT NULL"), parts)


def _settle(rows: DataFrame, place: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of start positions by what all their strings share (c1, c2) and what they span together (s1, s2; may be null).

    Returns (rows with ``found`` where the spanned string repeats, those to be
    looked at more closely). One of equal found ranges goes on for them all,
    with weight 2; others go on if their shared string repeats.
    """
    at = F.struct(*place)
    same = materialize(rows.filter("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.sum("w").alias("n"), F.min(at).alias("lead")).filter("n > 1"), parts)
    some, none = rows.filter("s1 IS NOT NULL"), rows.filter("s1 IS NULL").withColumn("lead", F.lit(None).cast(same.schema["lead"].dataType))
    ranked = materialize(
        join_names(some, same, ["s1", "s2"], "n", "left").unionByName(none).select(
            *place, "c1", "c2", F.col("lead").isNotNull().alias("found"), F.coalesce(F.col("lead") == at, F.lit(False)).alias("leads"), "w"
        ),
        parts,
    )
    going = ranked.filter("NOT found OR leads").withColumn("w", F.when(F.col("found"), 2).otherwise(F.col("w")).cast("long"))
    cores = going.groupBy("c1", "c2").agg(F.sum("w").alias("n"), F.min("w").alias("least")).filter("n > 1 AND least = 1").select("c1", "c2")
    return ranked, materialize(going.join(cores, ["c1", "c2"], "left_semi").select(*place, "w"), parts)


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, n_kept.

    Texts are UTF-8 bytes. Every byte covered by a ``length``-byte string (a
    multiple of 8) that also starts anywhere else, in the same text or another
    row's, is removed, as judged on the input. Null text counts as empty;
    texts shorter than ``length`` lose nothing; of equal texts at least that
    long, every byte goes. A null id is an ordinary id. Other columns are
    ignored.

    Hashes that stand for strings have 128 bits and seeds drawn for each call.
    Strings that very many texts share join by broadcast (see
    :func:`~feedlake.llm.common.join_names`); groupings combine before they
    shuffle.
    """
    spark, seeds = docs.sparkSession, (secrets.randbits(64), secrets.randbits(64))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    gram, step = length // 4, length // 8
    few = -(-step // 5)  # start positions looked at together

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            data, at = text_buffers(batch.column("text"))
            parts = list(_runs(data, at, length, gram, seeds[0]))
            text = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            h = np.concatenate([p[4] for p in parts]).view(np.int64) if parts else np.zeros(0, np.int64)
            raws = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            both = [_hash128(r, seeds[0]) for r in raws]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"), pa.array(np.arange(row, row + n)), pa.array(np.diff(at)), pa.array([x for x, _ in both], pa.int64()),
                    pa.array([y for _, y in both], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()), _lists(h, text, n, pa.int64()),
                ],
                ["__id", "row", "n", "h1", "h2", "sha", "grams"],
            )
            row += n

    every = materialize(texts.mapInArrow(read, f"__id {kind}, row long, n long, h1 long, h2 long, sha string, grams array<long>"))
    parts = task_count(spark, every.agg(F.sum("n")).first()[0] or 0)
    groups = materialize(every.groupBy("h1", "h2").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.max("n").alias("n")), parts)
    whole = groups.filter((F.col("copies") > 1) & (F.col("n") >= length)).select("h1", "h2")

    # Anchors by their gram, one of equal texts taking part.
    once = every.join(groups.select("row"), "row", "left_semi").select(F.explode("grams").alias("gram"))
    repeated = materialize(once.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram"), parts)
    alive = spark.sparkContext.broadcast(bit_filter(repeated, "gram"))
    discard(repeated)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes around surviving anchors, as disjoint segments with their runs (anchor, first, last)."""
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            rows, hashes = [], {}
            for text, x, first, last, h in _runs(data, at, length, gram, seeds[0]):
                ok = maybe_in(alive.value, h)
                text, x, first, last = text[ok], x[ok], first[ok], last[ok]
                if not len(x):
                    continue
                apart = np.append(True, (text[1:] != text[:-1]) | (first[1:] > last[:-1] + length))
                for run in np.split(np.arange(len(x)), np.flatnonzero(apart)[1:]):
                    t, a, b = int(text[run[0]]), int(first[run[0]]), int(last[run[-1]]) + length
                    if t not in hashes:
                        hashes[t] = _hash128(data[at[t] : at[t + 1]].tobytes(), seeds[0])
                    rows.append((*hashes[t], a, data[at[t] + a : at[t] + b].tobytes(), np.stack([x[run] - a, first[run] - a, last[run] - a], 1).reshape(-1)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h1", "h2", "start", "data", "runs"])

    pieces = texts.mapInArrow(cut, "h1 long, h2 long, start long, data binary, runs array<long>")
    segments = materialize(pieces.dropDuplicates(["h1", "h2", "start"]).withColumn("seg", F.monotonically_increasing_id()), parts)
    alive.unpersist()

    def name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each run with the hash of all bytes that its strings span."""
        for batch in batches:
            data, at = text_buffers(batch.column("data"))
            runs = batch.column("runs")
            x, first, last = runs.flatten().to_numpy().reshape(-1, 3).T
            many = np.diff(runs.offsets.to_numpy()) // 3
            base = np.repeat(at[:-1], many)
            s1, s2 = _two(data, base + first, base + last + length, seeds)
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (np.repeat(batch.column("seg").to_numpy(), many), x, first, last, mix((x - first).astype(np.uint64)).view(np.int64) ^ s1, s2))], ["seg", "x", "first", "last", "s1", "s2"]
            )

    runs = materialize(segments.select("seg", "data", "runs").mapInArrow(name_runs, "seg long, x long, first long, last long, s1 long, s2 long"))
    lead = materialize(runs.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("seg", "x")).alias("lead")).filter("n > 1"), parts)
    found = F.col("lead").isNotNull()
    ranked = join_names(runs, lead, ["s1", "s2"], "n", "left").select(
        "seg", "x", "first", "last", found.alias("found"), (~found | (F.col("lead") == F.struct("seg", "x"))).alias("goes_on"), F.when(found, 2).otherwise(1).cast("long").alias("w")
    )
    ranked = materialize(ranked.withColumn("run", F.monotonically_increasing_id()), parts)

    # Cells: the start positions of a run between two steps, with the bytes before and after the seven blocks they share.
    listed = ranked.filter("goes_on").groupBy("seg").agg(F.flatten(F.collect_list(F.array("run", "x", "first", "last", "w"))).alias("list"))

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column("data"))
            lists = batch.column("list")
            run, x, first, last, w = lists.flatten().to_numpy().reshape(-1, 5).T
            many = np.diff(lists.offsets.to_numpy()) // 5
            base, seg = np.repeat(at[:-1], many), np.repeat(batch.column("seg").to_numpy(), many)
            low, high = (first - x) // step, (last - x) // step
            cells = high - low + 1
            i = np.repeat(np.arange(len(x)), cells)
            j = np.arange(len(i)) - np.repeat(np.cumsum(cells) - cells, cells) + low[i]
            zero = x[i] + j * step  # the step at or before the cell's positions, within the segment
            d1, d2 = np.maximum(first[i] - zero, 0), np.minimum(last[i] - zero, step - 1)
            padded = np.concatenate([np.zeros(step, np.uint8), data, np.zeros(step, np.uint8)])
            k = np.arange(step)
            left = padded[(base[i] + zero + step)[:, None] + k] * (k >= d1[:, None])
            right = padded[(base[i] + zero + length + step)[:, None] + k] * (k < d2[:, None])
            sides = np.concatenate([left, right], axis=1).astype(np.uint8)
            # Each cell names the first of its blocks, the last of a run all seven.
            own = np.where(j == high[i], 7, 1)
            ends = np.cumsum(own)
            of = np.repeat(np.arange(len(i)), own)
            p = (base[i] + zero + step)[of] + (np.arange(len(of)) - (ends - own)[of]) * step
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            names = [pa.ListArray.from_arrays(offsets, pa.array(h)) for h in _two(data, p, p + step, seeds)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (seg[i], run[i], j + 6, w[i], zero, d1, d2)), *names, pa.array([r.tobytes() for r in sides], pa.binary())],
                ["seg", "run", "k", "w", "zero", "d1", "d2", "n1", "n2", "sides"],
            )

    schema = "seg long, run long, k long, w long, zero long, d1 long, d2 long, n1 array<long>, n2 array<long>, sides binary"
    cells = materialize(segments.select("seg", "data").join(listed, "seg").mapInArrow(cells_of, schema), parts)

    # Rounds: names of one block, then pairs of names at growing offsets: 2, 4 and 7 blocks. Block k of a run is the first that cell k contains.
    blocks = cells.select("run", "w", "k", F.posexplode(F.arrays_zip("n1", "n2")).alias("n", "b")).select("run", (F.col("k") + F.col("n")).alias("k"), "w", "b.n1", "b.n2")
    named = [_rerank(blocks, ["n1", "n2"], parts)]
    for offset in (1, 2, 3):
        pairs = _pairs(named[-1], offset, parts)
        named.append(_rerank(pairs, ["rank", "next"], parts))
        discard(pairs)
    opened = materialize(
        cells.select("seg", "run", "k", "w", "zero", "d1", "d2", "sides").join(named[-1].select("run", "k", "rank"), ["run", "k"]).withColumn("cell", F.monotonically_increasing_id()), parts
    )
    discard(cells, *named)

    def extend(batch: pa.RecordBatch, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        """Hash of the rank of cell i's shared bytes, those before them from ``low`` on and those after them up to ``high``."""
        data, at = text_buffers(batch.column("sides"))
        rank = batch.column("rank").to_numpy().view(np.uint64)[i]
        out = []
        for s in seeds:
            before = span_hashes(data, at[i] + low, at[i] + step, s)
            after = span_hashes(data, at[i] + step, at[i] + step + high, s)
            out.append(mix(join(join(mix(rank ^ np.uint64(s)), before), after)).view(np.int64))
        return out

    def tens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
            low = d1 // few
            many = d2 // few - low + 1
            i = np.repeat(np.arange(len(d1)), many)
            t = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + low[i]
            start, end = t * few, np.minimum(t * few + few - 1, step - 1)
            full = (start >= d1[i]) & (end <= d2[i])
            c1, c2 = extend(batch, i, end, start)
            s1, s2 = extend(batch, i, start, end)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cell").take(pa.array(i)), pa.array(t), *map(pa.array, (c1, c2)), pa.array(s1, mask=~full), pa.array(s2, mask=~full), batch.column("w").take(pa.array(i))],
                ["cell", "t", "c1", "c2", "s1", "s2", "w"],
            )

    sides = opened.select("cell", "rank", "d1", "d2", "w", "sides")
    ranges = materialize(sides.mapInArrow(tens, "cell long, t long, c1 long, c2 long, s1 long, s2 long, w long"))
    settled, open_ = _settle(ranges, ["cell", "t"], parts)
    discard(ranges)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("list")
            t, w = lists.flatten().to_numpy().reshape(-1, 2).T
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()) // 2)
            a = np.maximum(t * few, batch.column("d1").to_numpy()[row])
            b = np.minimum(np.minimum(t * few + few - 1, step - 1), batch.column("d2").to_numpy()[row])
            many = b - a + 1
            d = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)
            i = np.repeat(row, many)
            c1, c2 = extend(batch, i, d, d)
            yield pa.RecordBatch.from_arrays([batch.column("cell").take(pa.array(i)), *map(pa.array, (d, c1, c2, np.repeat(w, many)))], ["cell", "d", "c1", "c2", "w"])

    asked = open_.groupBy("cell").agg(F.flatten(F.collect_list(F.array("t", "w"))).alias("list"))
    leaves = materialize(sides.drop("w").join(asked, "cell").mapInArrow(singles, "cell long, d long, c1 long, c2 long, w long"), parts)
    twice = leaves.groupBy("c1", "c2").agg(F.sum("w").alias("n")).filter("n > 1").select("c1", "c2")
    single = leaves.filter("w = 1").join(twice, ["c1", "c2"], "left_semi").select("cell", F.col("d").alias("a"), F.col("d").alias("b"))
    ten = settled.filter("found").select("cell", (F.col("t") * few).alias("a"), F.least((F.col("t") + 1) * few - 1, F.lit(step - 1)).alias("b"))
    by_cell = single.unionByName(ten).groupBy("cell").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    shifted = F.transform("spans", lambda s: F.struct((s["a"] + F.col("zero")).alias("a"), (s["b"] + F.col("zero") + length).alias("b")))
    between = opened.select("seg", "cell", "zero").join(by_cell, "cell").select("seg", shifted.alias("spans"))
    entire = ranked.filter("found").select("seg", F.array(F.struct(F.col("first").alias("a"), (F.col("last") + length).alias("b"))).alias("spans"))
    by_segment = between.unionByName(entire).groupBy("seg").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    moved = segments.select("seg", "h1", "h2", "start").join(by_segment, "seg").withColumn(
        "spans", F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    )
    found = materialize(moved.groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans")).join(whole, ["h1", "h2"], "left_anti"), parts)
    discard(segments, runs, ranked, opened, settled, open_, leaves)

    # Texts with spans meet them by hash; all others need no text any more.
    some = spark.sparkContext.broadcast(bit_filter(found, "h1"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            raws = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            both = np.array([_hash128(r, seeds[0]) for r in raws], np.int64).reshape(-1, 2)
            keep = np.flatnonzero(maybe_in(some.value, both[:, 0].view(np.uint64)) & (np.diff(at) >= length))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(pa.array(keep)), pa.array(both[keep, 0]), pa.array(both[keep, 1]), pa.array([raws[i] for i in keep], pa.binary())],
                ["__id", "h1", "h2", "data"],
            )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, flat in zip(batch.column("data"), batch.column("spans"), strict=True):
                data = np.frombuffer(raw.as_buffer(), np.uint8)
                depth = np.zeros(len(data) + 1, np.int64)
                ab = np.array(flat.values).reshape(-1, 2)
                np.add.at(depth, ab[:, 0], 1)
                np.add.at(depth, ab[:, 1], -1)
                gone = np.cumsum(depth)[:-1] > 0
                out.append((len(data), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["__id", *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    flat = F.flatten(F.transform("spans", lambda s: F.array(s["a"], s["b"]))).alias("spans")
    partly = texts.mapInArrow(carry, f"__id {kind}, h1 long, h2 long, data binary").join(found, ["h1", "h2"]).select("__id", "data", flat)
    partly = partly.mapInArrow(strip, f"__id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    fate = whole.withColumn("fate", F.lit("whole")).unionByName(found.select("h1", "h2", F.lit("partly").alias("fate")))
    rest = every.select("__id", "n", "h1", "h2", "sha").join(fate, ["h1", "h2"], "left").filter("fate IS NULL OR fate = 'whole'")
    gone = F.col("fate").isNotNull()
    rest = rest.select(
        "__id", F.col("n").alias("n_bytes"), F.when(gone, F.col("n")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"),
        F.when(gone, hashlib.sha256(b"").hexdigest()).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return rest.unionByName(partly).withColumnRenamed("__id", id_col).withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))
