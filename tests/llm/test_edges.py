"""Brute-force versions, and nulls, empty tables, repeated rows, ties, long texts and clashing columns."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feedlake.llm import decontaminate, exact_dedup, importance, jaccard_join, language_id, lattice_lm, packing, repeated_spans, token_output, warc_fixity

from .test_llm import MIXED, PIECES, WORD, docs


def grams(text):
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", (text or "").encode())
    return tokens + list(zip(tokens, tokens[1:], strict=False))


def test_importance_is_the_ratio_of_two_models_and_a_gumbel_sample(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice("sun moon star sky, rain! a1 é".split(), rng.integers(0, 30))) for _ in range(60)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)] + [(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance.importance_resample(docs(spark, texts), labels, share=0.4, pseudo=2.0).collect()}
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i < 60 and i % 3 == 0:
            target.update(grams(t))
    scale = sum(target.values()) / sum(raw.values())
    for i, t in enumerate(texts):
        want = sum(np.log((target[g] + 2) / (raw[g] * scale + 2)) for g in grams(t))
        assert np.isclose(got[i].log_weight, want, atol=1e-3) and got[i].n_features == len(grams(t))
    first = sorted(got.values(), key=lambda r: (-r.sample_key, r.doc_id))[: round(0.4 * 62)]
    assert {r.doc_id for r in got.values() if r.kept} == {r.doc_id for r in first}


def test_language_scores_are_kernel_ridge_regression():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 97 + 5 + k % 3 * 4, 40).astype(np.uint8) for k in range(50)]
    y = [f"l{k % 3}" for k in range(50)]
    x = language_id.presence(texts)
    sets = [{t[i : i + n].tobytes() for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    exact = np.array([[len(a & b) for b in sets] for a in sets])
    assert np.abs(x @ x.T - exact).max() <= 6  # hashed n-grams
    model = language_id.Ridge(x, y, landmarks=10_000, penalty=0.5)
    unit = x / np.sqrt(x.sum(axis=1, keepdims=True))
    kernel = (unit @ unit.T).astype(float) + 1
    target = np.where(np.array(y)[:, None] == np.array(model.languages), 1.0, -1.0)
    assert np.allclose(model.scores(x), kernel @ np.linalg.solve(kernel + 0.5 * np.eye(50), target), atol=2e-2)


def test_decontaminate_against_brute_force(spark):
    rng = np.random.default_rng(12)
    words = [f"{a}{b}" for a in "bdfgklm" for b in ("an", "el", "or")]
    items = [" ".join(rng.choice(words, n)) for n in (5, 8, 9, 12, 30, 30)]
    texts = []
    for k in range(60):
        item = items[k % 6].split()
        a = int(rng.integers(0, len(item)))
        some = item[a : a + int(rng.integers(1, 14))]
        texts.append(" ".join([*rng.choice(words, 6), *some, *rng.choice(words, 6)]))
    want = set()
    for i, t in enumerate(texts):
        d = t.split()
        for j, item in enumerate(items):
            b = item.split()
            width = min(8, len(b))
            best = Counter(q - p for p in range(len(b) - width + 1) for q in range(len(d) - width + 1) if b[p : p + width] == d[q : q + width])
            if best and max(best.values()) >= min(2, len(b) - width + 1):
                want.add((i, j))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == want and want


def test_decontaminate_reports_ties_alike(spark):
    item = "then 3 old men and 5 young dogs walked over the long bridge into the dark town"
    texts = [item.replace("3", "4").replace("5", "6") + " . " + item.replace("3", "8").replace("5", "9")] * 2
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {tuple(r.slots) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()} == {("3=8", "5=9")}


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_have_the_asked_layout(spark, tmp_path, encoding):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 60), i -> concat('w', (id * 31 + i * i) % 977))) AS text").coalesce(1)
    path = str(tmp_path / "out")
    token_output.write_token_files(df, path, WORD, encoding=encoding, row_group_bytes=64 << 10, page_rows=100)
    files = [pq.ParquetFile(p) for p in (tmp_path / "out").glob("*.parquet")]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    assert len(groups) > len(files)
    for g in groups:
        by_path = {g.column(k).path_in_schema.split(".")[0]: g.column(k) for k in range(g.num_columns)}
        assert all(c.has_offset_index for c in by_path.values()) and by_path["doc_id"].has_column_index
        names = set(by_path["ids"].encodings)
        assert names & {"PLAIN_DICTIONARY", "RLE_DICTIONARY"} if encoding == "dictionary" else "DELTA_BINARY_PACKED" in names
    few = token_output.read_token_files(spark, path).filter("doc_id = 1234").select("n_tokens")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert few.count() == 1 and "EqualTo(doc_id,1234)" in plan and not re.search(r"ReadSchema: [^\n]*ids:", plan)


def test_long_texts_split_into_parts_have_the_same_runs(monkeypatch):
    data = np.random.default_rng(2).integers(97, 101, 9000).astype(np.uint8)

    def places():
        out = {}
        for _, x, first, last, h in repeated_spans._runs(data, np.array([0, len(data)]), 400, 100, 7):
            for a, b, c, k in zip(x, first, last, h, strict=True):
                out |= {int(p): (int(a), int(k)) for p in range(b, c + 1)}
        return out

    whole = places()
    monkeypatch.setattr(repeated_spans, "_PART", 1000)
    assert len(whole) == 8601 and places() == whole


OPERATORS = {
    "exact": lambda df: exact_dedup.exact_dedup(df),
    "near": lambda df: jaccard_join.jaccard_components(df),
    "lattice": lambda df: lattice_lm.lattice_scores(df, PIECES, rounds=1),
    "tokens": lambda df: token_output.token_round_trip(df, WORD),
    "repeats": lambda df: repeated_spans.remove_repeats(df),
    "language": lambda df: language_id.identify_language(df, df),
    "packing": lambda df: packing.pack(df, WORD),
    "importance": lambda df: importance.importance_resample(df, df.selectExpr("doc_id", "1 AS quality", "0 AS toxic")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_every_row(spark, name):
    """Null ids and texts, repeated rows, a long text and columns with the operators' own names."""
    df = docs(spark, [*MIXED, "ab " * 100_000]).unionByName(docs(spark, MIXED)).unionByName(docs(spark, ["nobody's text", None]).withColumn("doc_id", F.lit(None).cast("long")))
    want = Counter(r.doc_id for r in df.select("doc_id").collect())
    out = OPERATORS[name](df)
    got = Counter(r.doc_id for r in (out.filter("piece = 0") if name == "packing" else out).select("doc_id").collect())
    assert got == want
    assert OPERATORS[name](df.limit(0)).count() == 0


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    text = "some text of its own that nothing else in this small table repeats at all"
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (None, None, None, None, None), (2, "", None, "b", 0), (None, text + " or nearly", "en", None, 5), (3, "word " * 50_000, "en", "a", 1)]
    df = spark.createDataFrame(rows, schema).withColumn("__key", F.lit("own"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        assert name == "packing" or (out.columns == df.columns and 0 < out.count() <= len(rows) and out.filter("__key = 'own'").count() == out.count())
        assert stage(spark, df.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[1][1](spark, df, sf).count() == 4 and corpus_pipeline.STAGES[2][1](spark, df, sf).count() == 4


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice([chr(0x4E00 + 40 * k + j) for j in range(30)], 60)) for k in range(201)]
    df = spark.createDataFrame([(k, t, f"l{k:03d}") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = language_id.identify_language(df, df, per_language=5, landmarks=402, most_rows=100).collect()
    assert sum(r.lang_pred == f"l{r.doc_id:03d}" for r in got) >= 195


def test_fixity_of_records_without_id_and_repeats(spark):
    rows = [(k if k % 3 else None, f"u{k % 5}", "text " * (k % 50)) for k in range(300)] + [(None, None, None)] * 3 + [(7, "u", "again")] * 2 + [(1008, "long", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset long")
    records = warc_fixity.warc_records(pages, pages_per_file=40)
    assert records.count() == len(rows) and records.filter("record_id IS NULL").select("file").distinct().count() > 1
    leaves = warc_fixity.leaf_hashes(records)
    assert warc_fixity.fixity_audit(leaves, warc_fixity.leaf_hashes(warc_fixity.warc_records(pages.repartition(7), pages_per_file=40))).count() == 0
    lost = warc_fixity.leaf_hashes(records.filter("record_id IS NULL OR record_id <> 1008"))
    assert [(r.record_id, r.kind) for r in warc_fixity.fixity_audit(leaves, lost).collect()] == [(1008, "missing")]
    assert warc_fixity.fixity_audit(leaves.limit(0), leaves.limit(0)).count() == 0


def test_decontamination_takes_nulls_repeats_and_empty_tables(spark):
    item = "then 3 old men and 5 young dogs walked over the long bridge into the dark town"
    df = docs(spark, [*MIXED, item, item, "ab " * 50_000]).unionByName(docs(spark, [item, None]).withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame([(1, item, "x", 1), (1, item, "y", 2), (2, None, None, None), (None, "", "z", 0)], "item_id long, text string, doc_id string, n long")
    got = decontaminate.contaminated(df, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.verbatim) for r in got) == sorted((str(k), 1, True) for k in (len(MIXED), len(MIXED) + 1, None))
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(df.withColumn("__key", F.lit(1)), bench)
    assert kept.count() == df.count() - 3 and "__key" in kept.columns


def test_a_benchmark_of_many_words_is_met_by_all_of_them(spark):
    """Names, units and changed numbers in a benchmark of 47,500 different words."""
    rng = np.random.default_rng(8)
    made = iter(rng.permutation([f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in [f"{x}{y}{z}" for x in "bdfgklmnpr" for y in "aeiou" for z in "bdfgklmnprstvwxz"]])[:47_500])
    filler = [" ".join(next(made) for _ in range(250)) for _ in range(190)]
    items = [f"the farmer {w[0]} said that Marta walked 12 km from {w[1]} to the {w[2]} market and paid 30 dollars for {w[3]} eggs" for w in (f.split() for f in filler[:20])]
    bench = spark.createDataFrame(list(enumerate([f"{a} . {b}" for a, b in zip(items, filler, strict=False)] + filler[20:])), "item_id long, text string")
    copies = [t.replace("Marta", "Olga").replace("12", "7").replace("30", "45") for t in items]
    clean = [" ".join(f"{w}q" for w in f.split()) for f in filler[:20]]
    got = decontaminate.contaminated(docs(spark, copies + clean), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(20)} and not any(r.verbatim for r in got)
    assert {s for r in got for s in r.slots} == {"marta=olga", "12=7", "30=45"}
