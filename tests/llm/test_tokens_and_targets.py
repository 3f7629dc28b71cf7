"""Token counts, tokenizer alignment and target resampling against brute force, with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedlake.llm import alignment, target_resampling, token_counts
from feedlake.llm.byte_pieces import ByteLevelSplitter, span_array
from feedlake.llm.common import text_buffers
from feedlake.llm.queries import vocabulary

from .test_llm import MIXED, PIECES, docs

BYTES = vocabulary("byte_bpe_50k.json")
SIGNS = [*"ab1 2'  \n\t.!'stdmrevl", "é", "中", " ", " ", "🙂", "é", "²", "Ⅷ", "\x00", "　", "ß", "<|endoftext|>", "'s", "'ll", " '", "<s>", "▁"]


def random_texts(n, seed, signs=SIGNS):
    rng = random.Random(seed)
    return ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(n)]


def test_pre_tokens_are_the_librarys():
    texts, library = random_texts(3000, 1), Tokenizer.from_file(BYTES)
    data, bounds = text_buffers(pa.array(texts))
    starts, special = ByteLevelSplitter(BYTES).split(data, bounds)
    got = [[] for _ in texts]
    for owner, span, added in zip(np.searchsorted(bounds, starts, side="right") - 1, span_array(data, starts).to_pylist(), special, strict=True):
        got[owner].append((span.decode(), bool(added)))
    for text, found in zip(texts, got, strict=True):
        want = []
        for part in re.split(r"(<\|endoftext\|>)", text):
            whole = part == "<|endoftext|>"
            want += [(part, True)] if whole else [(part[a:b], False) for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(part)] if part else []
        assert found == want


def test_token_counts_are_those_of_whole_texts(spark):
    texts = [*random_texts(300, 2), *MIXED, "-" * 5000, "x" * 70_000]
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, texts), BYTES, limit=20).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 20)


def brute_alignment(texts):
    """The contract's words, text by text and byte by byte."""
    a_model, b_model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    visible = {c: b for c, b in alignment._byte_of().items()}
    rows, counts = [], Counter()
    for t in texts:
        full = (" " + t).encode() if t else b""
        a = a_model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        a_raw = [bytes(visible[c] for c in a_model.id_to_token(i)) for i in a]
        b_raw = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if b"".join(a_raw) != full or b"".join(b_raw) != full:
            a = b = a_raw = b_raw = []
        a_end = dict(zip(np.cumsum([len(x) for x in a_raw]).tolist(), a, strict=True))
        b_end = dict(zip(np.cumsum([len(x) for x in b_raw]).tolist(), b, strict=True))
        links = [(a_end[e], b_end[e]) for e in sorted(a_end.keys() & b_end.keys())]
        groups, last = [], 0
        for e in sorted(a_end.keys() & b_end.keys()):
            sides = [",".join(str(i) for x, i in side.items() if last < x <= e) for side in (a_end, b_end)]
            groups.append("|".join(sides))
            last = e
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        counts.update(links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), d) for n_a, n_b, g, links, d in rows]


def test_alignment_is_that_of_whole_texts(spark):
    texts = [*random_texts(300, 3), *MIXED, "a b ", "  a", " ", "\n \n", "don't stop<|endoftext|>", "a▁b", "zero\x00 byte", "naïve café 東京 🙂🙂", "x" * 5000]
    rows = alignment.align_tokenizers(docs(spark, texts), BYTES, PIECES).collect()
    columns = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    got = {r.doc_id: tuple(r[c] for c in columns) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts)


def brute_resample(texts, target, ids=None, percent=5, least=20, buckets=10_000, seed=42):
    def words(t):
        return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))

    def runs(t):
        w = words(t)
        return [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = Counter(x for text in texts for x in runs(text)), Counter(x for text in target for x in runs(text))
    many, much = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (many + buckets) / ((s[b] + 1) * (much + buckets)))) for b in range(buckets)]
    out, ids = [], ids or list(range(len(texts)))
    for i, text in zip(ids, texts, strict=True):
        f = runs(text)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ready = sorted((k for k, text in enumerate(texts) if len(words(text)) >= least), key=lambda k: (-out[k][3], out[k][0]))
    for rank, k in enumerate(ready[: percent * len(ready) // 100]):
        out[k][4] = rank + 1
    return [tuple(r) for r in out]


@pytest.mark.parametrize("percent", [5, 100, 0])
def test_target_resampling_against_brute_force(spark, percent):
    rng = random.Random(4)
    names = ["Sun", "moon", "é", "x9", "star-ship", "Rain.", "中文字" * 30, "y" * 3000]
    texts = [" ".join(rng.choices(names, weights=[9, 9, 9, 9, 5, 5, 1, 1], k=rng.randint(0, 60))) for _ in range(250)] + [None, "", "...", "one", "Z" * 50_000]
    target = ["sun moon sun moon star ship", None, "rain rain"]
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, score long")
    df = docs(spark, texts).repartition(7)
    got = target_resampling.target_resample(df, bench, percent=percent).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_resample(texts, target, percent=percent)) if percent else all(r["rank"] is None for r in got)


def test_target_resampling_breaks_ties_and_keeps_repeats(spark):
    text = " ".join(["sun"] * 25)
    rows = [(5, text)] * 40 + [(None, text)] * 10 + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = target_resampling.target_resample(df, spark.createDataFrame([], "text string"), percent=50).collect()
    assert len(got) == 51 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 26))
    empty = target_resampling.target_resample(df.limit(0), df.select("text"))
    assert empty.columns == ["doc_id", "n_features", "weight", "score", "rank"] and not empty.count()


@pytest.mark.parametrize("n", [2, 3000])
def test_cutoff_is_the_exact_key(spark, n):
    keys = spark.range(n).select((F.xxhash64("id") % 9).alias("score"), (F.xxhash64("id", F.lit(1)) % 50).alias("id"), F.col("id").alias("row")).repartition(6)
    keys = spark.createDataFrame(keys.collect(), keys.schema).repartition(6)
    want = sorted(((r.score, r.id, r.row) for r in keys.collect()), key=lambda x: (-x[0], x[1], x[2]))
    for k in {1, n, (n + 1) // 2, max(1, n // 20)}:
        assert target_resampling.cutoff(keys, k) == want[k - 1]
    assert target_resampling.cutoff(keys, 0) is None and target_resampling.cutoff(keys, n + 1) is None


def test_empty_tables(spark):
    none = docs(spark, ["x"]).limit(0)
    assert not token_counts.token_counts(none, BYTES).count() and not alignment.align_tokenizers(none, BYTES, PIECES).count()


def test_ids_of_any_kind_and_repeated_rows(spark):
    df = spark.createDataFrame([("k", "one two"), ("k", "one two"), (None, "one two"), ("z", None)], "doc_id string, text string")
    assert sorted(r.n_tokens for r in token_counts.token_counts(df, BYTES).collect()) == [0, 2, 2, 2]
    found = alignment.align_tokenizers(df, BYTES, PIECES).collect()
    assert sorted(r.count_sum for r in found) == [0, 6, 6, 6] and sorted(r.n_links for r in found) == [0, 2, 2, 2]
