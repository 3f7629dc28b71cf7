"""Document probability under a subword lattice.

An existing piece vocabulary weights every segmentation of a word; the
log-space forward recursion sums them. Pieces only start a word or stay
inside one, so a document's marginal is the product over its words, and each
distinct word is summed once for the whole corpus.

The vocabulary's scores are the start of the piece probabilities; expectation
maximisation over the training words adapts them to each class of documents
(language, learned from training rows). A word that a class has seen is one
more arc of its lattice there, and a document is a mixture over the classes.
"""

from __future__ import annotations

import math
import secrets
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, emit_blocks, lower_ascii, materialize, row_hash_start, row_hash_step, same_spans, slices, span_hashes, sum_blocks, text_buffers, word_spans

_SLOT = np.uint64(44)  # 20 bits of a hash choose a slot
_LONG = 64  # bytes; longer words are summed one at a time
_BLOCK = 1 << 14

Arcs = list[tuple[int, int, np.ndarray, np.ndarray]]


class Lattice:
    """Pieces as bytes (a leading space starts a word) with log probabilities, one column a class."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp.reshape(len(pieces), -1)
        self.longest = max(map(len, pieces))
        keys = self._hashes(pieces)
        self.keys = np.append(keys, np.uint64(0))  # the last is for "none", number -1
        self.tables, left = [], np.arange(len(keys))
        while len(left):  # one piece a slot in each table
            slot = (keys[left] >> _SLOT).astype(np.int64)
            table = np.full(1 << 20, -1, np.int32)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
        self.goes_on = np.zeros(1 << 20, bool)  # some piece may start like this and be longer
        self.goes_on[(self._hashes(sorted({p[:k] for p in pieces for k in range(1, len(p))})) >> _SLOT).astype(np.int64)] = True
        self.index = {p: i for i, p in enumerate(pieces)}

    @staticmethod
    def _hashes(pieces: list[bytes]) -> np.ndarray:
        keys, sizes = np.zeros(len(pieces), np.uint64), np.array([len(p) for p in pieces])
        for size in np.unique(sizes):
            some = np.flatnonzero(sizes == size)
            h = row_hash_start(len(some))
            for column in np.frombuffer(b"".join(pieces[k] for k in some), np.uint8).reshape(len(some), -1).T:
                h = row_hash_step(h, column)
            keys[some] = h
        return keys

    def arcs(self, w: np.ndarray) -> Arcs:
        """(i, j, rows, pieces) for each span [i, j) of equally long words, one word a row, where a piece fits; by j."""
        columns, out = np.ascontiguousarray(w.T), []
        n, width = w.shape
        for i in range(width):
            h, rows = row_hash_start(n), np.arange(n)
            for j in range(i + 1, min(width, i + self.longest) + 1):
                h = row_hash_step(h, columns[j - 1][rows])
                slot = (h >> _SLOT).astype(np.int64)
                for table in self.tables:
                    at = table[slot]
                    ok = np.flatnonzero(self.keys[at] == h)
                    if len(ok):
                        out.append((i, j, rows[ok], at[ok]))
                on = self.goes_on[slot]
                rows, h = rows[on], h[on]
                if not len(rows):
                    break
        return sorted(out, key=lambda x: x[1])

    def _groups(self, words: list[bytes], columns: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of up to 64 bytes by length, as many at once as their forward sums in ``columns`` classes leave memory for."""
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes[sizes <= _LONG]):
            rows = np.flatnonzero(sizes == size)
            step = max(1, 4_000_000 // (int(size) * max(8, columns)))
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                yield some, np.frombuffer(b"".join(words[k] for k in some), np.uint8).reshape(len(some), -1)

    def _forward(self, arcs: Arcs, width: int, start: np.ndarray, weight) -> np.ndarray:
        """alpha[j]: log probability of each row's first j bytes."""
        alpha = np.full((width + 1, *start.shape), -np.inf)
        alpha[0] = 0
        for i, j, rows, ids in arcs:
            alpha[j][rows] = np.logaddexp(alpha[j][rows], alpha[i][rows] + weight(rows, ids))
        return alpha

    def _arcs_one(self, word: bytes) -> Iterator[tuple[int, list[int], list[int]]]:
        """(j, starts, pieces) for each end j of a piece in one word."""
        for j in range(1, len(word) + 1):
            found = [(i, k) for i in range(max(0, j - self.longest), j) if (k := self.index.get(word[i:j])) is not None]
            if found:
                yield j, *map(list, zip(*found, strict=True))

    def _forward_one(self, word: bytes) -> np.ndarray:
        alpha = np.full((len(word) + 1, self.logp.shape[1]), -np.inf)
        alpha[0] = 0
        for j, starts, ids in self._arcs_one(word):
            alpha[j] = np.logaddexp.reduce(alpha[starts] + self.logp[ids], axis=0)
        return alpha

    def _count_one(self, word: bytes, k: int, out: np.ndarray) -> None:
        """Add the expected uses of each piece in one word of class ``k``, in memory linear in it."""
        alpha = self._forward_one(word)[:, k]
        if alpha[-1] == -np.inf:
            return
        beta = np.full(len(word) + 1, -np.inf)
        beta[-1] = 0
        for j, starts, ids in reversed(list(self._arcs_one(word))):
            below = self.logp[ids, k] + beta[j]
            np.logaddexp.at(beta, starts, below)
            np.add.at(out, (ids, k), np.exp(alpha[starts] + below - alpha[-1]))

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability, one column a class; words are given with their leading space."""
        out = np.zeros((len(words), self.logp.shape[1]))
        for rows, w in self._groups(words, out.shape[1]):
            start = np.zeros((len(rows), self.logp.shape[1]))
            out[rows] = self._forward(self.arcs(w), w.shape[1], start, lambda _, ids: self.logp[ids])[-1]
        for k in [k for k, w in enumerate(words) if len(w) > _LONG]:
            out[k] = self._forward_one(words[k])[-1]
        return out

    def expected_counts(self, words: list[bytes], classes: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (row) in each class (column) over all segmentations of words, each of one class."""
        out = np.zeros(self.logp.shape)
        for rows, w in self._groups(words):
            n, width = w.shape
            k, arcs = classes[rows], self.arcs(w)
            weigh = lambda some, ids: self.logp[ids, k[some]]  # noqa: B023, E731
            alpha = self._forward(arcs, width, np.zeros(n), weigh)
            beta = np.full((width + 1, n), -np.inf)
            beta[width] = 0
            which, uses = [], []
            for i, j, some, ids in reversed(arcs):
                below = beta[j][some] + weigh(some, ids)
                beta[i][some] = np.logaddexp(beta[i][some], below)
                which.append(ids.astype(np.int64) * out.shape[1] + k[some])
                with np.errstate(invalid="ignore"):
                    uses.append(np.nan_to_num(np.exp(alpha[i][some] + below - alpha[width][some])))
            if which:
                out += np.bincount(np.concatenate(which), np.concatenate(uses), minlength=out.size).reshape(out.shape)
        for m in [m for m, w in enumerate(words) if len(w) > _LONG]:
            self._count_one(words[m], int(classes[m]), out)
        return out


def load_pieces(model_path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a public sentencepiece vocabulary and their own scores; single bytes are its byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    best: dict[bytes, float] = {}
    for k in range(sp.get_piece_size()):
        piece, score = sp.id_to_piece(k), sp.get_score(k)
        if sp.is_byte(k):
            raw = bytes([int(piece[3:-1], 16)])
        elif sp.is_control(k) or sp.is_unknown(k):
            continue
        else:
            raw = piece.replace("▁", " ").encode()
        if raw and b" " not in raw[1:]:
            best[raw] = max(score, best.get(raw, -math.inf))
    for k in range(256):  # every text can be spelled
        best.setdefault(bytes([k]), min(best.values()))
    return list(best), np.array(list(best.values()))


def _held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def _large(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most``, so that many words of one length are summed at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, class, training count, count) with a bounded number of words held at a time."""
    train: dict[int, Counter] = defaultdict(Counter)
    every: dict[int, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for k, some in every.items():
            words = list(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([k] * len(words), pa.int32()), pa.array([train[k][w] for w in words], pa.int64()), pa.array(list(some.values()), pa.int64())],
                ["word", "class", "c", "c_all"],
            )
        train.clear()
        every.clear()

    for batch in batches:
        held, classes = batch.column("held_out").to_pylist(), batch.column("class").to_pylist()
        data, at = text_buffers(batch.column("text"))
        raw = data.tobytes()
        for k, hold in enumerate(held):
            words = raw[at[k] : at[k + 1]].lower().split()
            every[classes[k]].update(words)
            if not hold:
                train[classes[k]].update(words)
            if sum(map(len, every.values())) > 400_000:
                yield from out()
    yield from out()


def lattice_scores(
    docs: DataFrame,
    model_path: str,
    rounds: int = 2,
    frequent: int = 1 << 17,
    class_col: str | None = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Lower-cases A-Z; tokens are words ``[^\\x20\\x09-\\x0D]+`` and one end.
    Documents whose crc32(id as text) mod 10 is 0 are held out; the others
    train: words are counted over all of them. In each class, ``rounds`` of
    expectation maximisation over its distinct words turn the vocabulary's own
    scores (as a start) into piece probabilities. A word that the class has
    seen is also one arc, weighted by its discounted count; the pieces share
    what the discount leaves. ``base_score`` is the add-0.1 unigram score and
    ``score`` the log10 marginal probability of the token sequence over
    segmentations and classes.

    Classes are all values of ``class_col`` among training rows; null, and
    values of held-out rows only, form one more (without the column there is
    that one only). A document's own value is never used in its score. Memory
    and the tables of words grow with pieces or words times classes, so that
    ``class_col`` should hold languages or the like.

    Null or empty text has the end token alone. A null id counts as empty
    text in the checksum. Repeated rows are scored each. Other columns are
    ignored; an empty table gives no rows.

    The counts stay distributed. At most ``frequent`` of the commonest words
    (fewer beyond eight classes, as a word has a number for each) are broadcast, those above a count that a histogram of counts tells; the
    others of each document, as 128-bit hashes with a seed of this call, are
    joined with the counts.
    """
    spark, seeds = docs.sparkSession, (secrets.randbits(64), secrets.randbits(64))
    kind = docs.schema[id_col].dataType.simpleString()
    named = F.col(class_col).cast("string") if class_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), _held_out(id_col).alias("held_out"), named.alias("name"))
    by_name = texts.filter(~F.col("held_out") & F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"))
    names = [r["name"] for r in by_name.orderBy(F.col("n").desc(), "name").collect()]  # a row a class
    numbers = F.create_map(*[F.lit(x) for pair in enumerate(names) for x in reversed(pair)]) if names else None
    number = F.lit(0) if numbers is None else F.coalesce(F.try_element_at(numbers, F.col("name")), F.lit(len(names)))
    texts = texts.withColumn("class", number).drop("name")
    partial = texts.select("text", "held_out", "class").mapInArrow(_word_counts, "word binary, class int, c long, c_all long")
    every = range(len(names) + 1)
    per_class = F.array(*[F.sum(F.when(F.col("class") == k, F.col("c")).otherwise(0)) for k in every])
    lexicon = materialize(partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"), per_class.alias("by_class")))

    total = lexicon.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v"), F.count("*").alias("all")).first()
    own = lexicon.select(F.posexplode("by_class").alias("k", "n")).filter("n > 0").groupBy("k")
    own = own.agg(F.sum("n").alias("words"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
    by_class = {r["k"]: r for r in own.collect()}
    # Summing a word's lattice is the work here, so that the lexicon is dealt out by its number of words and classes.
    wide = max(8, len(by_class))
    dealt = lexicon.repartition(max(spark.sparkContext.defaultParallelism, total["all"] * wide // 800_000))
    trained = texts.filter(~F.col("held_out")).count()
    n_train, distinct = (total["c"] or 0) + trained, (total["v"] or 0) + (trained > 0)

    # Classes seen in training; where there is none, one without counts of its own.
    seen = sorted(by_class) or [0]
    sizes, kinds, once, twice = (np.array([by_class[k][name] if by_class else 0 for k in seen], float) for name in ("words", "kinds", "once", "twice"))
    discount = np.clip(np.divide(once, once + 2 * twice, out=np.full(len(seen), 0.5), where=once > 0), 0.05, 0.95)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_class = np.log(sizes / sizes.sum()) if sizes.sum() else np.zeros(1)
        log_spelled = np.where(sizes > 0, np.log(discount * kinds / sizes), 0.0)

    pieces, own = load_pieces(model_path)
    prior = 1.0 / (np.argsort(np.argsort(-own)) + 30.0)
    prob = np.repeat((prior / prior.sum())[:, None], len(seen), axis=1)
    cells = -(-prob.size // _BLOCK) * _BLOCK
    for _ in range(rounds if total["c"] else 0):
        lattice = spark.sparkContext.broadcast(Lattice(pieces, np.log(prob)))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(cells)
            for batch in _large(batches):
                own = batch.column("by_class").flatten().to_numpy().reshape(batch.num_rows, -1)[:, seen]
                at, k = np.nonzero(own)
                words = batch.column("word").to_pylist()
                sums[: prob.size] += lattice.value.expected_counts([b" " + words[i] for i in at], k).ravel()  # noqa: B023
            yield emit_blocks(sums, _BLOCK, float)

        found = sum_blocks(dealt.filter("c > 0").select("word", "by_class").mapInArrow(expect, "block long, counts binary"), cells, _BLOCK, float)
        n = 0.1 + found[: prob.size].reshape(prob.shape)
        prob = n / n.sum(axis=0)
        lattice.unpersist()
    lattice = spark.sparkContext.broadcast(Lattice(pieces, np.log(prob)))
    scale, end_log10 = 1 / math.log(10), math.log10((trained + 1) / (n_train + 2))
    word_share = math.log10(1 - 10**end_log10)  # a token is a word rather than the end

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _large(batches, 800_000 // wide):
            words = batch.column("word").to_pylist()
            own = batch.column("by_class").flatten().to_numpy().reshape(len(words), -1)[:, seen]
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(own - discount, 0) / np.maximum(1, sizes))
            logp = np.logaddexp(whole, log_spelled + lattice.value.log_probability([b" " + w for w in words]))
            data = np.frombuffer(b"".join(words), np.uint8)
            size = np.array([len(w) for w in words], np.int64)
            h1, h2 = (span_hashes(data, np.cumsum(size) - size, np.cumsum(size), seed).view(np.int64) for seed in seeds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * len(seen)), pa.array(logp.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(h1), pa.array(h2), batch.column("c"), batch.column("c_all"), lists], ["word", "h1", "h2", "c", "c_all", "logp"]
            )

    weighed = materialize(dealt.mapInArrow(weigh, "word binary, h1 long, h2 long, c long, c_all long, logp array<double>"))
    discard(lexicon)
    lattice.unpersist()

    # The commonest words: the least count that no more than ``frequent`` words reach, from the number of words of each count.
    bound = (F.col("c_all") > 1) & (F.octet_length("word") <= _LONG)
    steps = weighed.filter(bound).groupBy("c_all").agg(F.count("*").alias("n"))
    least, many = None, 0
    for row in sorted(steps.collect(), reverse=True):  # far fewer rows than words
        many += row["n"]
        if many > frequent * 8 // wide:
            break
        least = row["c_all"]
    often = weighed.filter(bound & (F.col("c_all") >= least)).select("word", "h1", "c", "logp").collect() if least else []
    often.sort(key=lambda r: r["h1"] % (1 << 64))
    spelled = [bytes(r["word"]) for r in often]
    known_words = spark.sparkContext.broadcast(
        (
            np.array([r["h1"] for r in often], np.int64).view(np.uint64),
            np.frombuffer(b"".join(spelled), np.uint8),
            np.cumsum([0, *map(len, spelled)]),
            np.array([r["c"] for r in often], np.int64),
            np.array([r["logp"] for r in often], float).reshape(-1, len(seen)),
        )
    )
    smooth = n_train + 0.1 * (distinct + 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, letters, places, count, logp = known_words.value
        base = np.log10((count + 0.1) / smooth)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            for a, b in slices(at):
                part, bounds, n = lower_ascii(data[at[a] : at[b]]), at[a : b + 1] - at[a], b - a
                starts, ends, first = word_spans(part, bounds)
                doc = np.repeat(np.arange(n), np.diff(first))
                h = span_hashes(part, starts, ends, seeds[0])
                i = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[i] == h if len(keys) else np.zeros(len(h), bool)
                hit[hit] = (places[i[hit] + 1] - places[i[hit]]) == (ends - starts)[hit]
                if not same_spans(part, starts[hit], letters, places[i[hit]], (ends - starts)[hit]):
                    raise RuntimeError("two words have one hash")  # chance 2 ** -64 a pair; a new call draws new seeds
                w, d = i[hit], doc[hit]
                sums = np.stack([np.bincount(d, logp[w, k], minlength=n) for k in range(len(seen))], axis=1).astype(float)
                rare = ~hit
                other = span_hashes(part, starts[rare], ends[rare], seeds[1]).view(np.int64)
                lists = np.searchsorted(doc[rare], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("__id").slice(a, n), batch.column("held_out").slice(a, n), pa.array(np.arange(key, key + n)), pa.array(np.diff(first)),
                        pa.array(np.bincount(d[count[w] > 0], minlength=n)), pa.array(np.bincount(d, base[w], minlength=n).astype(float)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(seen)), pa.array(sums.ravel())),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(h[rare].view(np.int64))), pa.ListArray.from_arrays(pa.array(lists), pa.array(other)),
                    ],
                    ["__id", "held_out", "row", "words", "known", "base", "logp", "h1", "h2"],
                )
                key += n

    schema = f"__id {kind}, held_out boolean, row long, words long, known long, base double, logp array<double>, h1 array<long>, h2 array<long>"
    rows = materialize(texts.select("__id", "text", "held_out").mapInArrow(read, schema))
    pairs = rows.filter(F.size("h1") > 0).select("row", F.explode(F.arrays_zip("h1", "h2")).alias("x")).select("row", "x.*")
    rest = (
        pairs.join(weighed.select("h1", "h2", "c", "logp"), ["h1", "h2"])
        .groupBy("row")
        .agg(
            F.sum((F.col("c") > 0).cast("long")).alias("r_known"),
            F.sum(F.log10((F.col("c") + 0.1) / smooth)).alias("r_base"),
            *[F.sum(F.get("logp", F.lit(k))).alias(f"r_{k}") for k in range(len(seen))],
        )
    )
    zero = F.lit(0.0)
    end_base = math.log10((trained + 0.1) / smooth) if smooth else 0.0
    each = F.array(*[F.get("logp", F.lit(k)) + F.coalesce(F.col(f"r_{k}"), zero) + float(p) for k, p in enumerate(log_class)])
    summed = rows.drop("h1", "h2").join(rest, "row", "left").withColumn("each", each).withColumn("most", F.array_max("each"))
    marginal = (F.col("most") + F.log(F.aggregate("each", zero, lambda s, x: s + F.exp(x - F.col("most"))))) * scale
    return summed.select(
        F.col("__id").alias(id_col),
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("r_known", F.lit(0)) + F.lit(int(trained > 0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", zero) + end_base).alias("base_score"),
        (marginal + F.col("words") * word_share + end_log10).alias("score"),
    )
