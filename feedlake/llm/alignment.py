"""Alignment of two tokenizers' tokens by where they end, in Arrow inside tasks and counted by Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pieces import ByteLevelSplitter, SpanEncoder, blank_spans, span_array
from .common import join_names, materialize, slices, text_buffers

_PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
_SIGNS = pa.array([",", "|", ";", ""])


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it can be seen, else the next free code from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, the bytes of their tokens and what this worker process has encoded."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.splitter = ByteLevelSplitter(byte_level, special_as_text=True)
        letters, vocabulary = _byte_of(), self.splitter.tokenizer.get_vocab(with_added_tokens=True)
        known = {i: bytes(letters[c] for c in s) for s, i in vocabulary.items() if all(c in letters for c in s)}
        self.a_bytes = pa.array([known.get(i, b"") for i in range(max(vocabulary.values()) + 1)], pa.large_binary())

        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in s.lstrip("▁") for s in names):
            raise ValueError("blanks may only start a piece")
        self.blank = self.model.piece_to_id("▁")
        self.b_bytes = pa.array(
            [bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)], pa.large_binary()
        )
        self.a_size, self.b_size = pc.binary_length(self.a_bytes), pc.binary_length(self.b_bytes)
        self.decimal = pa.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))])
        self.a_encoder, self.b_encoder = SpanEncoder(self._encode_a), SpanEncoder(self._encode_b)

    def _encode_a(self, spans: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.splitter.tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in spans], add_special_tokens=False)]

    def _encode_b(self, spans: list[bytes]) -> list[list[int]]:
        """The model adds a blank in front, so each span's first one goes; a lone blank is the piece of that name."""
        rest = [s[1:].decode("utf-8", "replace") for s in spans]
        return [ids if text else [self.blank] for text, ids in zip(rest, self.model.encode(rest, num_threads=1), strict=True)]

    def tokens(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Table, pa.Table]:
        """(A, B): each token's text (doc), id and byte offset within its text at which it ends."""
        out = []
        for starts, encoder, size in (
            (self.splitter.split(data, bounds)[0], self.a_encoder, self.a_size),
            (blank_spans(data, bounds), self.b_encoder, self.b_size),
        ):
            lists = encoder.lists(span_array(data, starts))
            ids, span = pc.list_flatten(lists), pc.list_parent_indices(lists)
            doc = pa.array(np.searchsorted(bounds, starts, side="right") - 1).take(span)
            ends = pc.cumulative_sum(size.take(ids).cast(pa.int64()))
            # Segmented: what the texts before have summed up to goes.
            first = np.searchsorted(doc.to_numpy(), np.arange(len(bounds) - 1))
            before = np.append(0, ends.to_numpy())[first]
            out.append(pa.table({"doc": doc, "end": pc.subtract(ends, pa.array(before).take(doc)), "id": ids}))
        return out[0], out[1]

    def same(self, data: np.ndarray, bounds: np.ndarray, a: pa.Table, b: pa.Table) -> np.ndarray:
        """Texts of which both tokenizers' tokens, joined, are the bytes."""
        size, good = np.diff(bounds), np.ones(len(bounds) - 1, bool)
        for t, names in ((a, self.a_bytes), (b, self.b_bytes)):
            doc = t["doc"].to_numpy()
            last = np.searchsorted(doc, np.arange(len(size)), side="right") - 1
            total = np.where((last >= 0) & (doc[last] == np.arange(len(size))), t["end"].to_numpy()[last], 0) if len(doc) else np.zeros(len(size), np.int64)
            whole = total == size
            made, _ = text_buffers(names.take(t["id"].combine_chunks().filter(pa.array(whole[doc]))))
            where = np.repeat(whole, size)
            differ = np.flatnonzero(made != data[where])
            good &= whole
            good[(np.searchsorted(bounds, np.flatnonzero(where)[differ], side="right") - 1)] = False
        return good

    def digests(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, doc: np.ndarray) -> list[str]:
        """SHA-256 of each text's groups as decimals; ``a_last`` and ``b_last`` are the places of groups' last tokens, ``doc`` their texts."""
        a_group = np.searchsorted(a_last, np.arange(len(a)))
        b_group = np.searchsorted(b_last, np.arange(len(b)))
        a_at = np.arange(len(a)) + np.append(0, b_last + 1)[a_group]
        b_at = np.arange(len(b)) + (a_last + 1)[b_group]
        ids, sign = np.empty(len(a) + len(b), np.int32), np.zeros(len(a) + len(b), np.int8)
        ids[a_at], ids[b_at] = a, b
        sign[a_at[a_last]], sign[b_at[b_last]] = 1, 2
        ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
        sign[b_at[b_last[ends]]] = 3
        text = pc.binary_join_element_wise(self.decimal.take(pa.array(ids)), _SIGNS.take(pa.array(sign)), "")
        raw, offsets = text_buffers(text)
        stops = offsets[b_at[b_last[ends]] + 1]
        view = memoryview(raw)
        return [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True)]

    def align(self, texts: pa.Array) -> pa.Table:
        """A row per text: n_a, n_b, n_groups, n_links, groups_sha256 and its pairs (A id, B id, links)."""
        raw, offsets = text_buffers(texts)
        n = len(texts)
        some = np.diff(offsets) > 0
        size = np.diff(offsets) + some
        bounds = np.append(0, np.cumsum(size))
        data = np.full(int(bounds[-1]), 0x20, np.uint8)
        inside = np.ones(len(data), bool)
        inside[bounds[:-1][some]] = False
        data[inside] = raw[offsets[0] : offsets[-1]]
        filled = np.flatnonzero(some)
        a, b = self.tokens(data, np.append(bounds[filled], bounds[-1]))
        good = self.same(data, np.append(bounds[filled], bounds[-1]), a, b)
        a, b = (t.filter(pa.array(good).take(t["doc"].combine_chunks())) for t in (a, b))
        a, b = (t.append_column("at", pa.array(np.arange(len(t)))) for t in (a, b))
        links = a.join(b, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by("at")
        pairs = links.group_by(["doc", "id", "id_b"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
        counts = np.zeros((4, n), np.int64)
        for k, t in enumerate((a, b, links)):
            counts[k] = np.bincount(filled[t["doc"].to_numpy()], minlength=n)
        ends = links.group_by(["doc", "end"], use_threads=False).aggregate([])
        counts[3] = np.bincount(filled[ends["doc"].to_numpy()], minlength=n)
        digest = np.full(n, "", object)
        if len(links):
            a_last, b_last, doc = (links[c].to_numpy() for c in ("at", "at_b", "doc"))
            digest[filled[np.unique(doc)]] = self.digests(a["id"].to_numpy(), b["id"].to_numpy(), a_last, b_last, doc)
        owner = filled[pairs["doc"].to_numpy()]
        lists = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)),
            pa.StructArray.from_arrays([pairs[c].combine_chunks() for c in ("id", "id_b", "count_all")], fields=list(_PAIRS.value_type)),
        )
        return pa.table(
            {"n_a": counts[0], "n_b": counts[1], "n_groups": counts[3], "n_links": counts[2], "groups_sha256": pa.array(digest, pa.string()), "pairs": lists}
        )


@cache
def aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


def aligned(df: DataFrame, byte_level: str, pieces: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs): each document's groups and linked ids."""
    columns = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, row = aligner(byte_level, pieces), TaskContext.get().partitionId() << 33
        for batch in batches:
            _, offsets = text_buffers(batch.column("text"))
            for a, b in slices(offsets):
                made = both.align(batch.column("text").slice(a, b - a)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(b - a)), batch.column("id").slice(a, b - a), *(made.column(c) for c in columns)], ["row", "id", *columns]
                )
                row += b - a

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:bigint>>"
    )


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each id pair in the whole table, and whether no other A id has more with this B id."""
    counts = materialize(links.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count")))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(df: DataFrame, byte_level: str, pieces: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE tokenizer, which gets the text after a blank, B a
    sentencepiece model, which adds that blank itself; special tokens' strings
    are plain text. Tokens that end at one byte are linked, and such bytes cut
    a text's tokens into groups. Counts of linked ids are partial by document
    and merged by Spark; they meet the documents' pairs in a join, pairs of
    over 1 in 100,000 links (at most 100,000 of them) by broadcast.

    Null and empty texts, and those that the joined tokens of A or B don't
    spell, have zeros and no digest, and count nothing. Repeated rows and rows that
    share an id or have none count each; the id may have any type. Other columns are
    ignored; an empty table gives no rows. A task holds one text of any length as a whole.
    """
    links = materialize(aligned(df, byte_level, pieces, text_col, id_col))
    names = materialize(pair_counts(links))
    met = join_names(links.select("row", F.inline("pairs")), names.withColumn("links", F.col("count")), ["a", "b"], "links", share=1e-5)
    best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0))
    sums = met.groupBy(F.col("row").alias("of")).agg(best.alias("best_sum"), F.sum(F.col("n") * F.col("count")).alias("sum"))
    zero = F.lit(0).cast("long")
    return (
        links.drop("pairs").join(sums, F.col("row") == F.col("of"), "left")
        .select(
            F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("best_sum", zero).alias("n_best"),
            F.coalesce("sum", zero).alias("count_sum"), "groups_sha256",
        )
    )
