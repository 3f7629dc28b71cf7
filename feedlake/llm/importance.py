"""Quality selection by importance resampling.

Two generative models over hashed unigrams and bigrams, one of the target
text and one of all text, weight each document by their likelihood ratio;
adding Gumbel noise to the log weights and taking the top k samples documents
without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import class_spans, emit_blocks, join, materialize, mix, slices, span_hashes, sum_blocks, text_buffers
from .idsets import free_name, row_key, without

BITS = 20
_KIND = np.full(256, 2, np.uint8)  # punctuation
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _features(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every unigram and bigram of words and punctuation runs; no bigram crosses texts."""
    starts, ends, first = class_spans(data, bounds, _KIND)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    inside = doc[:-1] == doc[1:]
    pair = mix(join(h[:-1], h[1:]))[inside]
    return (np.concatenate([h, pair]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([doc, doc[:-1][inside]])


def log_ratio(raw: np.ndarray, target: np.ndarray, pseudo: float) -> np.ndarray:
    """log(p target / p raw) by bucket: both models are smoothed with ``pseudo`` counts, raw ones scaled to the target's size."""
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    return np.log((target + pseudo) / (raw * (target.sum() / raw.sum()) + pseudo)).astype(np.float32)


def fit_log_ratio(docs: DataFrame, bits: int, pseudo: float) -> np.ndarray:
    """:func:`log_ratio` from ``docs`` (text, target boolean); all of them make the raw model."""
    cells = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * cells, np.uint32)
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = text_buffers(batch.column("text"))
            for a, b in slices(offsets):
                bucket, doc = _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                counts[:cells] += np.bincount(bucket, minlength=cells).astype(np.uint32)
                counts[cells:] += np.bincount(bucket[target[a:b][doc]], minlength=cells).astype(np.uint32)
        yield emit_blocks(counts)

    total = sum_blocks(docs.mapInArrow(count, "block long, counts binary"), 2 * cells)
    return log_ratio(total[:cells].astype(float), total[cells:].astype(float), pseudo)


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    broadcast_labels: int = 8_000_000,
    pseudo: float = 4.0,
    bits: int = BITS,
    seed: int = 7,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str | None = None,
) -> DataFrame:
    """One row per document: id, n_features, log_weight, sample_key, kept.

    The target is the documents that every label of theirs calls good
    (quality 1, toxic 0), all of them, so that it grows with the documents,
    which the raw model counts. Up to ``broadcast_labels`` of their ids are
    broadcast, counted before; beyond that texts shuffle to meet them. ``share`` of the rows is kept; by
    default the share of good ones among labelled documents. A weight is the
    ratio of the text's likelihoods under the two models, each a product over
    its n-grams; keys are log weights with Gumbel noise, so that the top k are
    a sample without replacement in proportion to the weights.

    Null or empty text has weight 1 (log weight 0). Rows with a null id are
    scored and sampled like others, with one common noise. Repeated rows each
    take part; equal keys are ordered by id. With no target documents all
    weights are equal. ``label_col`` holds the id that labels go by, if that is
    not ``id_col``. Other columns, and those of ``labels``, are ignored.
    """
    spark = docs.sparkSession
    rated = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__label_id")).agg(
        (F.coalesce(F.min("quality") == 1, F.lit(False)) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("__good")
    )
    counted = rated.agg(F.avg(F.col("__good").cast("double"))).first()[0]
    share = share if share is not None else (1.0 if counted is None else counted)
    target = materialize(rated.filter("__good").select("__label_id"))
    target = F.broadcast(target) if target.count() <= broadcast_labels else target

    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    named = docs.select(F.col(label_col or id_col).alias("__named"), F.col(text_col).alias("text"))
    marked = named.join(target, F.col("__named") == F.col("__label_id"), "left")
    model = spark.sparkContext.broadcast(
        fit_log_ratio(marked.select("text", F.col("__label_id").isNotNull().alias("target")), bits, pseudo)
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b in slices(offsets):
                bucket, doc = _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                n[a:b] = np.bincount(doc, minlength=b - a)
                weight[a:b] = np.bincount(doc, ratio[bucket], minlength=b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array(n), pa.array(weight)], ["__id", "n_features", "log_weight"]
            )

    kind = text.schema["__id"].dataType.simpleString()
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    keyed = text.mapInArrow(weigh, f"__id {kind}, n_features long, log_weight double").withColumn(
        "sample_key", F.col("log_weight") - F.log(-F.log(uniform))
    )
    # Exact top k: ranges of the key in descending order, then the row's place within its range.
    keyed = materialize(keyed)
    order = [F.col("sample_key").desc(), F.col("__id").asc()]
    ranked = materialize(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    part = F.expr("shiftright(__at, 33)")
    sizes = ranked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    k = round(share * ranked.count())
    rank = F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.join(F.broadcast(bases), part == F.col("__part")).select(
        F.col("__id").alias(id_col), "n_features", "log_weight", "sample_key", (rank < k).alias("kept")
    )


def keep_sampled(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that :func:`importance_resample` keeps, with all their columns.

    Rows that share an id, or have none, are sampled one by one; rows alike in
    id and text stay if one of them was sampled.
    """
    key = free_name(docs, "__key")
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    found = importance_resample(keyed, labels, text_col=text_col, id_col=key, label_col=id_col, **options)
    gone = found.groupBy(F.col(key).alias("__gone")).agg(F.max("kept").alias("__kept")).filter(~F.col("__kept")).select("__gone")
    return without(keyed, materialize(gone), key, "__gone").drop(key)
