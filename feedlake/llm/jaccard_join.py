"""N-gram Jaccard join with rare-first prefix filtering.

Texts with the same shingle set form one class and are joined once. Each
class lists its shingles rare first and joins on its prefix; length and
positional filters apply in the join, suffix filter and verification once per
pair. Because the result is connected components, each class is first
compared with a few hubs of its prefix groups (linear in the classes); only
classes that are then still in different components meet in the exact join.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, discard, emit_blocks, join, lower_ascii, materialize, maybe_in, mix, slices, span_hashes, sum_blocks, task_count, text_buffers, word_spans
from .components import components
from .idsets import free_name, without

_K = np.uint64(0x9E3779B97F4A7C15)


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hash of each shingle, its text) for slices of texts; a shorter text is one shingle."""
    for a, b in slices(offsets):
        part = lower_ascii(data[offsets[a] : offsets[b]])
        bounds = offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, bounds)
        words = span_hashes(part, starts, ends, seed) if len(starts) else np.zeros(0, np.uint64)
        many = np.diff(first)
        text = np.repeat(np.arange(b - a), many)
        h, t = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(words) >= width:
            h = words
            for k in range(1, width):
                h = join(h[:-1], words[k:])
            same = text[: len(h)] == text[width - 1 :]
            h, t = mix(h[same]), text[: len(h)][same]
        short = np.flatnonzero((many > 0) & (many < width))
        if len(short):  # a shingle of fewer words: their number comes last
            one = words[first[short]]
            for k in range(1, width - 1):
                more = many[short] > k
                one[more] = join(one[more], words[first[short[more]] + k])
            h, t = np.concatenate([h, mix(join(one, many[short].astype(np.uint64)))]), np.concatenate([t, short])
        yield a, h, t


def _sets(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, its distinct shingles in ascending order of hash)."""
    for a, h, t in _shingles(data, offsets, width, seed):
        order = np.argsort(t, kind="stable")
        h, t = h[order], t[order]
        cut = np.searchsorted(t, np.arange(t[-1] + 2 if len(t) else 0))
        for i in range(len(cut) - 1):
            if cut[i] < cut[i + 1]:
                yield a + i, np.unique(h[cut[i] : cut[i + 1]])


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    m = mix(s + _K)
    return int(m.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(m ^ _K)).astype(np.int64))


def _parity(s: np.ndarray) -> np.ndarray:
    """512 parity bits of a set: each element flips one. Two sets differ in at least as many elements as bits."""
    bit = (mix(s ^ _K) >> np.uint64(55)).astype(np.int64)
    odd = np.bincount(bit, minlength=512).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _apart(bits: Column, bits2: Column) -> Column:
    """Parity bits that differ: at most as many as elements of only one set."""
    return sum((F.bit_count(F.get(bits, F.lit(i)).bitwiseXOR(F.get(bits2, F.lit(i)))) for i in range(8)), F.lit(0))


def _may_overlap(n: Column, n2: Column, apart: Column, percent: int) -> Column:
    """Suffix filter on whole sets: the parity bits bound the Hamming distance of similar sets."""
    return (n + n2 - apart) * (100 + percent) >= (n + n2) * (2 * percent)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of which similar sets share one: n - ceil(percent n / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def similar(x: np.ndarray, y: np.ndarray, percent: int, parts: int = 8) -> bool:
    """Suffix filter, then the exact test 100 |x & y| >= percent |x | y| of ascending arrays."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if len(x) > 4 * parts:  # split both at x's quantiles: each part shares at most its smaller side
        at = np.linspace(0, len(x), parts + 1).astype(int)
        other = np.searchsorted(y, x[at[1:-1]])
        if np.minimum(np.diff(at), np.diff(np.concatenate([[0], other, [len(y)]]))).sum() < need:
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(texts: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, seed: int, percent: int, parts: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar. Only involved texts' sets are made, and moved twice."""
    names = {x: classes.select(F.col("c").alias(x), *[F.col(h).alias(x + h) for h in ("h1", "h2", "n")]) for x in "ab"}
    named = materialize(pairs.join(names["a"], "a").join(names["b"], "b"), parts)
    wanted = bit_filter(named.select(F.explode(F.array("ah1", "bh1")).alias("h1")).distinct(), "h1")
    asked = texts.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            for a, b in slices(at):
                out = []
                for _, s in _sets(data, at[a : b + 1], width, seed):
                    h1, h2 = _signature(s)
                    if maybe_in(asked.value, np.array([h1]).view(np.uint64))[0]:
                        out.append((h1, h2, len(s), s.tobytes()))
                columns = zip(*out, strict=True) if out else [()] * 4
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h1", "h2", "n", "s"])

    made = texts.select("text").mapInArrow(sets, "h1 long, h2 long, n long, s binary").groupBy("h1", "h2", "n").agg(F.first("s").alias("s"))
    side = {x: made.select(*[F.col(h).alias(x + h) for h in ("h1", "h2", "n")], F.col("s").alias(f"{x}s")) for x in "ab"}

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("as"), batch.column("bs")
            ok = [similar(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(x, y, strict=True)]
            some = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(some), batch.column("b").filter(some)], ["a", "b"])

    full = named.join(side["b"], ["bh1", "bh2", "bn"]).join(side["a"], ["ah1", "ah2", "an"])
    found = materialize(full.select("a", "b", "as", "bs").mapInArrow(test, "a long, b long"), parts)
    discard(named)
    asked.unpersist()
    return found


def _alike_long(n: Column, n2: Column, percent: int) -> Column:
    """Length filter."""
    return F.least(n, n2) * 100 >= F.greatest(n, n2) * percent


def _may_match(n: Column, at: Column, n2: Column, at2: Column, percent: int) -> Column:
    """Length filter, and positional filter for a pair's first common shingle."""
    most = F.lit(1) + F.least(n - at - 1, n2 - at2 - 1)
    return _alike_long(n, n2, percent) & (most * (100 + percent) >= (n + n2) * percent)


def jaccard_components(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    text_col: str = "text",
    id_col: str = "doc_id",
    bytes_per_cell: int = 384,
    max_cells: int = 1 << 24,
    pairs_per_member: int = 1,
    most_rounds: int = 6,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Lower-cases A-Z; words are ``[^\\x20\\x09-\\x0D]+``; a document's set is
    its distinct ``width``-word shingles, or its whole word sequence if that
    is shorter. Documents link when 100 * intersection >= percent * union;
    component_id is the smallest id reachable by links, itself included.
    Documents without words (null text too) have no shingles and link with
    nothing. Null ids are larger than any other; repeated rows link with each
    other. Other columns are ignored.

    Shingles are 64-bit hashes. Their order (rare first, by counts over all
    documents) comes from a table of counts by hash of one cell per
    ``bytes_per_cell`` bytes of text, at most ``max_cells``; any order gives
    the same result, a fuller table only larger prefix groups. Likewise
    ``pairs_per_member`` and ``most_rounds`` only say how much is settled by
    hubs before the exact join. The hashes' seed is drawn for each call. Joins
    on a token or hub that very many classes share are left to adaptive
    execution, which splits such partitions; groupings combine before they
    shuffle.
    """
    spark, seed = docs.sparkSession, secrets.randbits(64)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(max_cells, max(1 << 16, 1 << (max(1, size // bytes_per_cell) - 1).bit_length()))
    mask, parts = np.uint64(cells - 1), task_count(spark, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, waiting = np.zeros(cells, np.uint32), [], 0
        for batch in batches:
            for _, h, _ in _shingles(*text_buffers(batch.column("text")), width, seed):
                held.append((h & mask).astype(np.uint32))
                waiting += len(h)
                if waiting > max(cells, 1 << 20):  # adding up costs as much as there are cells
                    sums += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)
                    held, waiting = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)
        yield emit_blocks(sums)

    sums = sum_blocks(texts.select("text").mapInArrow(count, "block long, counts binary"), cells)
    frequency = spark.sparkContext.broadcast(np.minimum(255, np.round(8 * np.log2(sums + 1.0))).astype(np.uint8))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequency.value
        for batch in batches:
            n = batch.num_rows
            sizes, h1, h2, prefix, bits = np.zeros(n, np.int64), [None] * n, [None] * n, [None] * n, [None] * n
            for i, s in _sets(*text_buffers(batch.column("text")), width, seed):
                sizes[i] = len(s)
                h1[i], h2[i] = _signature(s)
                bits[i] = _parity(s)
                prefix[i] = s[np.argsort(often[(s & mask).astype(np.int64)], kind="stable")[: prefix_size(len(s), percent)]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(sizes), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["__id", "n", "h1", "h2", "prefix", "bits"],
            )

    read_rows = materialize(texts.mapInArrow(read, f"__id {kind}, n long, h1 long, h2 long, prefix array<long>, bits array<long>"))
    # A class: texts with one set, known by 128 bits and the set's size; c is its number from here on.
    name = ["h1", "h2", "n"]
    grouped = read_rows.filter("n > 0").groupBy(*name).agg(F.min("__id").alias("least"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = materialize(grouped.withColumn("c", F.monotonically_increasing_id()), parts)
    rows = materialize(read_rows.select("__id", *name))
    discard(read_rows)
    frequency.unpersist()

    # Tokens: prefix shingles that classes share.
    shared = classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    tokens = materialize(shared.select("token"), parts)
    common = spark.sparkContext.broadcast(bit_filter(tokens, "token"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            many = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy()
            keep = np.flatnonzero(maybe_in(common.value, values.view(np.uint64)))
            at = np.arange(len(values)) - np.repeat(np.cumsum(many) - many, many)
            degree = np.bincount(np.repeat(np.arange(len(many)), many)[keep], minlength=len(many))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (values, *(np.repeat(v, many) for v in (batch.column("c").to_numpy(), batch.column("n").to_numpy())), at, np.repeat(degree, many))],
                ["token", "c", "n", "at", "degree"],
            )

    spread_out = classes.select("c", "n", "prefix").mapInArrow(spread, "token long, c long, n long, at long, degree long")
    members = materialize(spread_out.join(tokens, "token", "left_semi"), parts)
    common.unpersist()
    discard(tokens)

    sharing = materialize(members.select("c").distinct(), parts)
    marks = materialize(classes.select("c", "n", "bits").join(sharing, "c", "left_semi"), parts)

    # Hub rounds: in each token's group, classes outside its main component meet some classes of it, those with most
    # shared tokens (the least edited ones) among them. A class takes the nearest hub by the parity bits.
    # Rounds go on while they link at least one class in a hundred and the exact join would be large.
    tried = members.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0)
    links, labelled, total, sharers, found = tried, members.withColumn("label", F.col("c")), members.count(), sharing.count(), None
    for turn in range(most_rounds + 1):
        hubs = [F.max_by("c", F.struct("degree", F.xxhash64("c", F.lit(turn)))), *[F.min_by("c", F.xxhash64("c", F.lit(turn), F.lit(i))) for i in range(3)]]
        sizes = labelled.groupBy("token", "label").agg(F.count("*").alias("k"), F.max("degree").alias("degree"), *[h.alias(f"h{i}") for i, h in enumerate(hubs)])
        main = F.max_by(F.struct("label", F.array("h0", "h1", "h2", "h3").alias("hubs")), F.struct("k", "degree", "label")).alias("m")
        mixed = sizes.groupBy("token").agg(F.count("*").alias("labels"), F.sum("k").alias("all"), F.max("k").alias("k"), main).filter("labels > 1")
        mixed = materialize(mixed.select("token", F.col("m.label").alias("main"), F.array_distinct("m.hubs").alias("hubs"), ((F.col("all") - F.col("k")) * F.col("all")).alias("work")), parts)
        work = mixed.agg(F.sum("work")).first()[0] or 0
        apart = labelled.join(mixed.drop("work"), "token")
        if turn == most_rounds or (turn and (work <= pairs_per_member * total or found.count() * 100 < sharers)):
            break
        met = apart.filter(F.col("label") != F.col("main")).select("c", F.explode("hubs").alias("hub")).distinct()
        met = met.join(marks, "c").join(marks.select(F.col("c").alias("hub"), F.col("n").alias("n2"), F.col("bits").alias("bits2")), "hub")
        met = met.filter(_alike_long(F.col("n"), F.col("n2"), percent)).withColumn("apart", _apart(F.col("bits"), F.col("bits2"))).filter(_may_overlap(F.col("n"), F.col("n2"), F.col("apart"), percent))
        met = met.select(F.greatest("c", "hub").alias("a"), F.least("c", "hub").alias("b"), "c", "hub", (F.col("apart") / (F.col("n") + F.col("n2"))).alias("apart"))
        best = met.join(tried, ["a", "b"], "left_anti").groupBy("c").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "hub")).alias("p"))
        new = materialize(best.select("p.*").distinct(), parts)
        if not new.count():
            break
        tried = tried.unionByName(new)
        found = _verify(texts, classes, new, width, seed, percent, parts)
        links = links.unionByName(found)
        label = components(links, parts)
        old = labelled
        labelled = materialize(members.join(label.select(F.col("node").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c")), parts)
        discard(mixed, label, *([old] if turn else []))

    # Exact join of what is still apart: classes outside a token's main component with all others.
    apart = apart.drop("hubs").join(marks.select("c", "bits"), "c")
    left = apart.filter(F.col("label") != F.col("main")).drop("main")
    right = apart.select("token", *[F.col(x).alias(f"{x}2") for x in ("c", "n", "at", "label", "main", "bits")])
    meet = (F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("main2")) | (F.col("c") < F.col("c2")))
    pairs = left.join(right, ["token"]).filter(meet & _may_match(F.col("n"), F.col("at"), F.col("n2"), F.col("at2"), percent))
    pairs = pairs.filter(_may_overlap(F.col("n"), F.col("n2"), _apart(F.col("bits"), F.col("bits2")), percent))
    pairs = materialize(pairs.select(F.greatest("c", "c2").alias("a"), F.least("c", "c2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), parts)
    links = links.unionByName(_verify(texts, classes, pairs, width, seed, percent, parts))
    discard(members, labelled, marks, sharing, mixed)

    label = components(links, parts)
    named = classes.join(label.select(F.col("node").alias("c"), "label"), "c", "left").select(*name, "least", F.coalesce("label", "c").alias("label"))
    named = materialize(named, parts)
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = materialize(named.join(least, "label").select(*name, "component_id"), parts)
    discard(classes, named, label)
    found = rows.filter("n > 0").join(by_class, name).select("__id", "n", "component_id")
    alone = rows.filter("n = 0").select("__id", "n", F.col("__id").alias("component_id"))
    return found.unionByName(alone).select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The document with the smallest id of each component, with all its columns.

    Documents without words stay. Null ids are larger than any other; among
    rows with one id, or none, a hash of the text decides, and of rows that
    are alike in both any one stays.
    """
    key = free_name(docs, "__key")
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(key).alias("key"))
    found = jaccard_components(keyed.select(order.alias("__row"), text_col), width, percent, text_col, "__row")
    gone = materialize(found.filter(F.col("component_id.key") != F.col("__row.key")).select(F.col("__row.key").alias("__gone")))
    return without(keyed, gone, key, "__gone").drop(key)
