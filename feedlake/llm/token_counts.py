"""Token counts without token ids: pieces of distinct pre-tokens, weighted by how often each document has them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pieces import ByteLevelSplitter, span_array
from .common import discard, hottest, join_names, materialize, slices, text_buffers

_PIECES = pa.list_(pa.struct([("piece", pa.binary()), ("n", pa.int32())]))


@cache
def splitter(path: str) -> ByteLevelSplitter:
    """The splitter of this worker process, which outlives a task."""
    return ByteLevelSplitter(path)


def pre_token_frequencies(df: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, id, n_bytes, n_special, pieces): each document's distinct pre-tokens with how often it has them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, row = splitter(tokenizer).split, TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in slices(offsets):
                part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, special = split(part, bounds)
                doc = np.searchsorted(bounds, starts, side="right") - 1
                coded = span_array(part, starts).dictionary_encode()
                code = coded.indices.to_numpy().astype(np.int64)
                pairs, times = np.unique((doc * (len(coded.dictionary) + 1) + code)[~special], return_counts=True)
                owner, which = np.divmod(pairs, len(coded.dictionary) + 1)
                pieces = coded.dictionary.take(pa.array(which)).cast(pa.binary())
                ends = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends), pa.StructArray.from_arrays([pieces, pa.array(times.astype(np.int32))], fields=list(_PIECES.value_type))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(b - a)), batch.column("id").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(np.bincount(doc[special], minlength=b - a)), lists],
                    ["row", "id", "n_bytes", "n_special", "pieces"],
                )
                row += b - a

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"row long, id {kind}, n_bytes long, n_special long, pieces array<struct<piece:binary,n:int>>"
    )


def pieces_of(distinct: DataFrame, tokenizer: str) -> DataFrame:
    """``distinct`` (piece, uses) with ``n_pieces``: how many tokens the library makes of each pre-token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = splitter(tokenizer).tokenizer.encode_batch_fast
        for batch in batches:
            texts = [s.decode("utf-8", "replace") for s in batch.column("piece").to_pylist()]
            n = [len(x.ids) for x in encode(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("uses"), pa.array(n, pa.int64())], ["piece", "uses", "n_pieces"])

    return distinct.select("piece", "uses").mapInArrow(count, "piece binary, uses long, n_pieces long")


def token_counts(df: DataFrame, tokenizer: str, limit: int = 1024, text_col: str = "text", id_col: str = "doc_id", most_hot: int = 1 << 19) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``).

    The tokenizer is a byte-level BPE one of the tokenizers library. Each
    distinct pre-token of the table is encoded once; its number of pieces
    meets the documents' frequencies of pre-tokens in a join. The ``most_hot``
    commonest pre-tokens of up to 64 bytes, and longer ones that make up 1 in
    10,000 of all, join by broadcast; the others' rows shuffle.

    Null text counts as empty and has no tokens. An added token's string in a
    text is one token. Repeated rows and rows that share an id or have none
    are counted each; the id may have any type. Other columns are ignored; an
    empty table gives no rows. A task holds one text of any length as a whole.
    """
    counted = materialize(pre_token_frequencies(df, tokenizer, text_col, id_col))
    uses = counted.select(F.inline("pieces")).groupBy("piece").agg(F.sum("n").alias("uses"))
    names = materialize(pieces_of(uses, tokenizer))
    discard(uses)
    bound = hottest(names.filter(F.length("piece") <= 64), "uses", most_hot)
    far = (names.agg(F.sum("uses")).first()[0] or 0) * 1e-4
    ranked = names.withColumn("uses", F.when((F.length("piece") <= 64) | (F.col("uses") > far), F.col("uses")).otherwise(0))
    met = join_names(counted.select("row", F.inline("pieces")), ranked, ["piece"], "uses", bound=bound)
    sums = met.groupBy(F.col("row").alias("of")).agg(F.sum(F.col("n") * F.col("n_pieces")).alias("sum"))
    n = F.col("n_special") + F.coalesce(F.col("sum"), F.lit(0))
    return (
        counted.drop("pieces").join(sums, F.col("row") == F.col("of"), "left")
        .select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
    )
