"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of byte 1- to 3-grams present in both,
normalised by their own numbers. A Nyström map over landmark texts feeds
one-versus-rest kernel ridge regression; a batch of texts is scored by two
matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, mix, text_buffers

DIMS = 1 << 14


def presence(texts: list[np.ndarray], dims: int = DIMS, longest: int = 3, chunk: int = 1 << 20) -> np.ndarray:
    """0/1 rows: which hashed n-grams (n = 1..longest) of lower-cased bytes a text has."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, raw in enumerate(texts):
        for a in range(0, len(raw), chunk):  # overlapping parts keep temporaries small
            data = lower_ascii(raw[a : a + chunk + longest - 1]).astype(np.uint32)
            code = data.copy()
            for n in range(1, longest + 1):
                if n > 1:
                    if len(data) < n:
                        break
                    code = code[:-1] * np.uint32(257) + data[n - 1 :]
                out[i, (((code * np.uint32(2654435761)) ^ np.uint32(n * 0x85EB)) >> np.uint32(32 - dims.bit_length() + 1)) % dims] = 1
    return out


class Ridge:
    """One-versus-rest kernel ridge regression on Nyström features."""

    def __init__(self, x: np.ndarray, y: list[str], landmarks: int, penalty: float):
        self.languages = sorted(set(y))
        x = self._unit(x)
        every = [np.flatnonzero(np.array(y) == c)[: max(1, landmarks // len(self.languages))] for c in self.languages]
        self.z = x[np.concatenate(every)]
        k = (self.z @ self.z.T).astype(float)
        values, vectors = np.linalg.eigh(k)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        phi = (x @ self.z.T).astype(float) @ root
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        target = np.where(np.array(y)[:, None] == np.array(self.languages)[None], 1.0, -1.0)
        weight = np.linalg.solve(phi.T @ phi + penalty * np.eye(phi.shape[1]), phi.T @ target)
        self.alpha, self.bias = (root @ weight[:-1]).astype(np.float32), weight[-1].astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (self._unit(x) @ self.z.T) @ self.alpha + self.bias


def identify_language(
    docs: DataFrame,
    training: DataFrame,
    per_language: int = 500,
    landmarks: int = 160,
    penalty: float = 0.1,
    most_rows: int = 100_000,
    text_col: str = "text",
    id_col: str = "doc_id",
    lang_col: str = "lang",
) -> DataFrame:
    """``docs``' id with lang_pred and score (0 to 1), learned from ``training``.

    The fit uses at most ``per_language`` rows of each language, taken in hash
    order of the id, and ``landmarks`` of those; fewer of each, but one at
    least, where all languages together would have more than ``most_rows``. Every language is learned. Training rows with a null
    text, language or id are left out. Text that is null or has no letter is
    ``und`` with score 0, and so is every text if nothing could be learned.
    Repeated rows are predicted each; ties go to the first language by name;
    other columns are ignored.
    """
    spark = docs.sparkSession
    some = training.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")
    )
    # Rows far from the head of a language's hash order go before any sort: their share follows from its number of rows.
    sizes = some.groupBy(F.col("__lang").alias("__of")).agg(F.count("*").alias("__n"))
    per_language = max(1, min(per_language, most_rows // max(1, sizes.count())))
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 32))
    near = some.join(sizes, F.col("__lang") == F.col("__of")).filter(place * F.col("__n") <= F.lit(2 * per_language + 200) * F.lit(float(1 << 32)))
    by = Window.partitionBy("__lang").orderBy(place, "__id")
    chosen = near.withColumn("__nth", F.row_number().over(by)).filter(F.col("__nth") <= per_language).select(F.col("__id").alias("__chosen"), "__lang")
    sample = training.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen.distinct()), F.col("__id") == F.col("__chosen")
    ).filter(F.col("text").rlike(r"\p{L}"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            rows = [np.packbits(presence([data[a:b]])[0] > 0).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__lang"), pa.array(rows, pa.binary())], ["__id", "lang", "bits"])

    kind = sample.schema["__id"].dataType.simpleString()
    # Rows of 2 KB: at most most_rows, or one for each language.
    fit = sorted(sample.select("__id", "__lang", "text").mapInArrow(bits, f"__id {kind}, lang string, bits binary").collect())
    model = None
    if fit:
        x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in fit), np.uint8)).reshape(len(fit), DIMS)
        model = Ridge(x.astype(np.float32), [r["lang"] for r in fit], landmarks, penalty)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ridge = shared.value
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            letter = batch.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            names, sure = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            rows = np.flatnonzero(letter) if ridge is not None else np.zeros(0, int)
            for a in range(0, len(rows), 128):
                some = rows[a : a + 128]
                s = ridge.scores(presence([data[at[i] : at[i + 1]] for i in some])) * 4
                p = np.exp(s - s.max(axis=1, keepdims=True))
                best = s.argmax(axis=1)
                sure[some] = p[np.arange(len(some)), best] / p.sum(axis=1)
                for i, k in zip(some, best, strict=True):
                    names[i] = ridge.languages[k]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(names), pa.array(sure)], ["__id", "lang_pred", "score"])

    texts = docs.select(
        F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter")
    )
    out = texts.mapInArrow(predict, f"__id {kind}, lang_pred string, score double")
    return out.select(F.col("__id").alias(id_col), "lang_pred", "score")
