import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedlake.llm import common, decontaminate, exact_dedup, importance, jaccard_join, language_id, lattice_lm, packing, repeated_spans, token_output, warc_fixity

WORD = str(public_tokenizers.path("word_bpe_49k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, c long, n long, label string, seg string"


def docs(spark, texts, langs=None):
    """Rows with nulls in extra columns whose names clash with the operators' own."""
    rows = [(i, t, langs[i] if langs else None, 7, None, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


MIXED = ["a b c d e f g h", "a b c d e f g h", None, "", "", "A B C D E F G H", "x", "word " * 30_000, "é ü ñ " * 50, "<|endoftext|> Done's 12 ok"]


def test_vector_hash_equals_scalar():
    data = np.frombuffer(b"abcabcab  xyz", np.uint8)
    h = common.span_hashes(data, np.array([0, 3, 6]), np.array([3, 6, 8]))
    assert h[0] == h[1] != h[2]
    text = np.frombuffer(bytes(range(65, 91)) * 90, np.uint8)
    at = np.arange(0, 1200, 7)
    for size in (1, 7, 8, 9, 30, 400, 1100):
        h = common.span_hashes(text, at, at + size, seed=5)
        raw = [text[a : a + size].tobytes() for a in at]
        assert len(set(h.tolist())) == len(set(raw)) and all((h[0] == x) == (raw[0] == r) for x, r in zip(h, raw, strict=True))
    windows = common.window_hashes(text, 400)
    assert len(windows) == len(text) - 399 and windows[3] == windows[29] != windows[4]
    assert common.same_spans(text, at, text, at + 26, np.full(len(at), 50)) and not common.same_spans(text, at, text, at + 25, np.full(len(at), 9))


def thue_morse(zero, one, n):
    out = [zero], [one]
    for _ in range(n):
        out = out[0] + out[1], out[1] + out[0]
    return zero[:0].join(out[0]), zero[:0].join(out[1])


def test_structured_texts_do_not_collide(spark):
    """Words and byte strings on which polynomial hashes modulo a power of two agree."""
    x, y = thue_morse("a", "b", 10)
    a, b = thue_morse("abcdefgh ", "hgfedcba ", 10)
    df = docs(spark, [x, y, a, b])
    assert [r.component_id for r in jaccard_join.jaccard_components(df).orderBy("doc_id").collect()][:2] == [0, 1]
    assert all(r.n_known <= r.n_tokens for r in lattice_lm.lattice_scores(df, PIECES, rounds=1).collect())
    one, other = thue_morse("a", "b", 9)
    assert [r.n_removed for r in repeated_spans.remove_repeats(docs(spark, [one, other])).collect()] == brute_removed([one, other])


def test_exact_dedup(spark):
    df = docs(spark, MIXED).unionByName(docs(spark, MIXED).filter("doc_id = 1"))
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == len(MIXED) + 1
    by = defaultdict(list)
    for i, t in [*enumerate(MIXED), (1, MIXED[1])]:
        by[t or ""].append(i)
    for ids in by.values():
        own = [r for r in got if r.doc_id in ids]
        assert {(r.keep_id, r.group_size) for r in own} == {(max(ids), len(ids))} and sum(r.kept for r in own) == 1
    assert {r.text_sha256 for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for t in MIXED}
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(df).collect()) == sorted(max(i) for i in by.values())
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_warc_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "body " * (i % 50)) for i in range(1200)] + [(None, None, None), (5, None, "")], "page_id long, url string, html string")
    records = warc_fixity.warc_records(pages)
    left = warc_fixity.leaf_hashes(records)
    assert warc_fixity.fixity_audit(left, left).count() == 0
    copy = records.filter("record_id <> 700 OR record_id IS NULL").withColumn("payload", F.when(F.col("record_id") == 3, "broken").otherwise(F.col("payload")))
    got = {(r.record_id, r.kind) for r in warc_fixity.fixity_audit(left, warc_fixity.leaf_hashes(copy)).collect()}
    assert got == {(700, "missing"), (3, "altered")}
    assert warc_fixity.fixity_audit(left.limit(0), left.limit(0)).count() == 0


def brute_word(word, pieces, prob):
    total = 0.0
    for cuts in product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:], strict=False)]
        if all(p in pieces for p in parts):
            total += np.prod([prob[pieces.index(p)] for p in parts])
    return total


def test_lattice_sums_all_segmentations(monkeypatch):
    pieces = [b" a", b" ab", b"a", b"b", b"ab", b" "]
    prob = np.array([[0.2, 0.1, 0.2, 0.25, 0.05, 0.2], [0.1, 0.3, 0.1, 0.1, 0.3, 0.1]]).T
    lattice = lattice_lm.Lattice(pieces, np.log(prob))
    words = [b" ab", b" abab", b" ba", b" aab"]
    want = [[brute_word(w, pieces, prob[:, k]) for k in range(2)] for w in words]
    assert np.allclose(np.exp(lattice.log_probability(words)), want)
    counts = lattice.expected_counts([b" ab"], np.array([0]))
    paths = {(b" ab",): 0.1, (b" a", b"b"): 0.05, (b" ", b"ab"): 0.01, (b" ", b"a", b"b"): 0.01}
    assert np.isclose(counts[pieces.index(b"b"), 0], (0.05 + 0.01) / sum(paths.values())) and not counts[:, 1].any()
    monkeypatch.setattr(lattice_lm, "_LONG", 2)
    assert np.allclose(np.exp(lattice.log_probability(words)), want)


def test_lattice_counts_long_words(monkeypatch):
    pieces = [b" a", b" ab", b"a", b"b", b"ab", b"ba", b" "]
    lattice = lattice_lm.Lattice(pieces, np.log([0.2, 0.1, 0.2, 0.2, 0.05, 0.1, 0.15]))
    words = [b" abab", b" " + b"ab" * 90, b" zz" * 30]
    got = lattice.expected_counts(words, np.zeros(3, int))[:, 0]
    assert np.isclose(got @ [len(p) for p in pieces], 5 + 181)  # every byte of a word that can be spelled is in one piece
    monkeypatch.setattr(lattice_lm, "_LONG", 500)
    assert np.allclose(got, lattice.expected_counts(words, np.zeros(3, int))[:, 0])


@pytest.mark.parametrize("more", [0, 7, 199])
def test_lattice_score_is_the_mixture_of_word_marginals(spark, more):
    """Document scores against the formula, with the pieces' own probabilities (no rounds of adaptation) and with every language a class."""
    texts = ["the cat sat", "the the mat", "le chat noir", "the zebra", None, "le le noir", "a cat", "der hund", "the sat", "le mat"]
    langs = ["en", "en", "fr", "en", None, "fr", "en", None, "en", "fr"]
    texts += [f"{w} w{k} the w{k}" for k in range(more) for w in ("x", "y")]
    langs += [f"l{k}" for k in range(more) for _ in "xy"]
    got = {r.doc_id: r.score for r in lattice_lm.lattice_scores(docs(spark, texts, langs), PIECES, rounds=0, frequent=2).collect()}
    pieces, own = lattice_lm.load_pieces(PIECES)
    prob = 1 / (np.argsort(np.argsort(-own)) + 30.0)
    lattice = lattice_lm.Lattice(pieces, np.log(prob / prob.sum()))
    spelled = {w: math.exp(lattice.log_probability([b" " + w])[0, 0]) for t in texts if t for w in t.encode().split()}
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    count = defaultdict(Counter)
    for i in train:
        count[langs[i]].update((texts[i] or "").encode().split())
    size = {k: sum(c.values()) for k, c in count.items() if c}
    n = sum(size.values()) + len(train)
    end = (len(train) + 1) / (n + 2)
    for i, text in enumerate(texts):
        words, total = (text or "").encode().split(), 0.0
        for k in size:
            ones, twos = sum(v == 1 for v in count[k].values()), sum(v == 2 for v in count[k].values())
            off = min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5
            each = [max(count[k][w] - off, 0) / size[k] + off * len(count[k]) / size[k] * spelled[w] for w in words]
            total += size[k] / sum(size.values()) * math.prod(each)
        assert np.isclose(got[i], math.log10(total) + len(words) * math.log10(1 - end) + math.log10(end)), i


def test_lattice_scores_base(spark):
    texts = [*MIXED, *["the cat sat on the mat"] * 20, "zebra quagga"]
    got = {r.doc_id: r for r in lattice_lm.lattice_scores(docs(spark, texts), PIECES, rounds=1, frequent=4).collect()}
    train = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            train.update((t or "").encode().lower().split())
            train[None] += 1
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(texts):
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(np.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert got[i].n_tokens == len(tokens) and got[i].train_tokens == n and got[i].n_known == sum(train[w] > 0 for w in tokens)
        assert np.isclose(got[i].base_score, base) and got[i].score < 0
    assert lattice_lm.lattice_scores(docs(spark, []), PIECES).count() == 0


def test_lattice_scores_classes(spark):
    """Broadcast and joined words score alike; classes with words of their own help; a row's own class is not used."""
    texts = [*["the cat sat on the mat"] * 20, *["le chat noir dort ici"] * 20, "the the the the cat", "le chat noir", None, "", "zq " * 300]
    rows = [(i, t, "en" if t and "the" in t else "fr" if i % 3 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    joined = {r.doc_id: r.score for r in lattice_lm.lattice_scores(df, PIECES, rounds=1, frequent=1).collect()}
    sent = {r.doc_id: r.score for r in lattice_lm.lattice_scores(df, PIECES, rounds=1).collect()}
    assert len(sent) == len(texts) and all(np.isclose(joined[k], sent[k]) for k in sent)
    without = {r.doc_id: r.score for r in lattice_lm.lattice_scores(df.drop("lang"), PIECES, rounds=1).collect()}
    assert sum(sent[k] for k in range(40)) > sum(without[k] for k in range(40))
    held = next(k for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 10 == 0 and t)
    other = df.withColumn("lang", F.when(F.col("doc_id") == held, F.lit("xx")).otherwise(F.col("lang")))
    assert np.isclose(lattice_lm.lattice_scores(other, PIECES, rounds=1).filter(f"doc_id = {held}").first().score, sent[held])


def brute_removed(texts):
    raws, seen = [(t or "").encode() for t in texts], Counter()
    for b in raws:
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
    out = []
    for b in raws:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        out.append(int(gone.sum()))
    return out


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for i, j in product(range(len(texts)), repeat=2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return [(len(s), label[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, width, percent):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 400, 120)]
    texts = list(MIXED)
    for _ in range(60):  # near copies at and around the threshold, and a passage that all share
        copy = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            copy[k] = f"v{rng.integers(0, 9)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base[:30] + [f"u{i}_{k}" for k in range(rng.integers(0, 9))]) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts), width, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, width, percent)


def test_token_files(spark, tmp_path):
    df = docs(spark, MIXED)
    plain = Tokenizer.from_file(WORD)
    want, start = [], 0
    for i, t in enumerate(MIXED):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for encoding in ("dictionary", "delta"):
        token_output.write_token_files(df, str(tmp_path / encoding), WORD, encoding=encoding)
        got = token_output.token_digest(token_output.read_token_files(spark, str(tmp_path / encoding))).orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == want
    assert token_output.token_round_trip(df.limit(0), WORD).count() == 0


def test_packing(spark):
    texts = [*MIXED, *[" ".join(["dog"] * k) for k in range(1, 60)]]
    got = packing.pack(docs(spark, texts), WORD, capacity=64, end_id=0).collect()
    plain = Tokenizer.from_file(WORD)
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == [(a, min(64, len(ids) - a)) for a in range(0, len(ids), 64)]
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for rows in bins.values():
        rows.sort()
        assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False)) and sum(rows[-1]) <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack(docs(spark, []), WORD).count() == 0


def test_fullest_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = {int(k): int(rng.integers(1, 3)) for k in rng.integers(1, 40, 5)}
        room = int(rng.integers(1, 90))
        best = max(s for m in product(*[range(c + 1) for c in counts.values()]) if (s := sum(k * x for k, x in zip(counts, m, strict=True))) <= room)
        assert sum(k * x for k, x in packing.fullest(counts, room).items()) == best


def test_repeated_spans(spark):
    rng = np.random.default_rng(5)
    chars = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared, line = chars(700), chars(450)
    texts = [None, "", "short", chars(900), shared, "x" + shared, chars(300) + shared[100:520] + chars(10), shared[:399], line * 3, chars(100) + line, "a" * 1500, chars(500), "tail"]
    texts += [texts[3], texts[11]]
    raws, seen = [(t or "").encode() for t in texts], Counter()
    for b in raws:
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
    got = {r.doc_id: r for r in repeated_spans.remove_repeats(docs(spark, texts)).collect()}
    for i, b in enumerate(raws):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum())
        kept = hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), spans, kept), i
    assert repeated_spans.remove_repeats(docs(spark, [])).count() == 0


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passages = [" ".join([word(6)] + [word(5) for _ in range(64)] + [word(n)]) for n in (8, 9, 10, 80)]
    assert [len(p) for p in passages] == [399, 400, 401, 471] and all(len(p.split()) > 50 for p in passages)
    texts = [f"{word(300)}{side}{p}{side}{word(300)}" for p in passages for side in ".-"]
    assert [r.n_removed for r in repeated_spans.remove_repeats(docs(spark, texts)).orderBy("doc_id").collect()] == [0, 0, 400, 400, 401, 401, 471, 471]


def test_language(spark):
    words = {"en": "the and of that with", "de": "und der die nicht mit", "fr": "les des une dans pour"}
    rng = np.random.default_rng(2)
    texts, langs = [], []
    for lang, some in words.items():
        for _ in range(30):
            texts.append(" ".join(rng.choice(some.split(), 20)))
            langs.append(lang)
    df = docs(spark, [*texts, None, "12 !!"], [*langs, "en", None])
    got = {r.doc_id: r for r in language_id.identify_language(df, df.filter("doc_id % 3 <> 0")).collect()}
    assert np.mean([got[i].lang_pred == x for i, x in enumerate(langs)]) >= 0.95
    assert [got[i].lang_pred for i in (90, 91)] == ["und", "und"] and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify_language(df, df.limit(0)).collect()} == {"und"}


def test_importance(spark):
    rng = np.random.default_rng(4)
    good = [" ".join(rng.choice("one two three four five six seven".split(), 30)) for _ in range(300)]
    bad = [t + " idiot scum" for t in good[:100]]
    df = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(0, 400, 2)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance.importance_resample(df, labels, share=300 / 402).collect()}
    assert len(got) == 402 and sum(r.kept for r in got.values()) == 300
    assert np.mean([got[i].kept for i in range(300)]) > 0.95 and np.mean([got[i].kept for i in range(300, 400)]) < 0.1
    assert importance.importance_resample(df, labels.limit(0)).filter("kept").count() == 402


def test_importance_weighs_rare_words_that_good_text_lacks(spark):
    rng = np.random.default_rng(6)
    good = [" ".join(rng.choice("one two three four five six seven".split(), 30)) for _ in range(300)]
    df = docs(spark, [*good, *[t + " scum" for t in good[:20]]])
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(0, 320, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.log_weight for r in importance.importance_resample(df, labels).collect()}
    assert np.mean([got[i] - got[i - 300] for i in range(300, 320)]) < -0.05


def test_decontaminate(spark):
    items = spark.createDataFrame([(0, "Yesterday the farmer Alice sold 12 kg of apples and Alice kept 3 kg for the long cold winter"), (1, None), (2, "too short")], "item_id long, text string")
    texts = [
        "Intro words. Yesterday the farmer Alice sold 12 kg of apples and Alice kept 3 kg for the long cold winter. More.",
        "Yesterday the farmer Bob sold 40 lb of apples and Bob kept 7 lb for the long cold winter",
        "Yesterday the farmer Bob sold 40 lb of apples and Carol kept 7 lb for the long cold winter",
        "nothing of the kind is found in this text about farmers and apples", None, "",
    ]
    got = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, texts), items).collect()}
    assert set(got) == {0, 1} and got[0].verbatim and not got[1].verbatim
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs(spark, texts), items).collect()} == {2, 3, 4, 5}


def test_decontaminate_broadcasts_no_hits_and_shuffles_no_words(spark):
    items = spark.createDataFrame([(0, "Yesterday the farmer Alice sold 12 kg of apples and Alice kept 3 kg for the long cold winter")], "item_id long, text string")
    found = decontaminate.contaminated(docs(spark, ["Yesterday the farmer Alice sold 12 kg of apples and Alice kept 3 kg for the long cold winter"] * 3), items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3 and "SortMergeJoin [__doc" in plan and "BroadcastHashJoin [__doc" not in plan
    below = plan[plan.index("SortMergeJoin [__doc") :]
    assert below.index("__words#") < below.index("REPARTITION_BY_COL") < below.index("__dd_m0")  # first the filter, then the shuffle, then words


def test_decontaminate_verbatim_windows_count_whatever_their_slots(spark):
    """An edited number whose value also stands elsewhere, items dense in numbers, and items shorter than a window."""
    long_ = "there were 5 old boats in the small harbour that night and the tired crew counted every rope and sail before 5 men went home to sleep at last"
    items = spark.createDataFrame([(0, long_), (1, "Compute 12 + 34 + 56 + 78 and then subtract 9 from 10"), (2, "Name all noble gases"), (3, "")], "item_id long, text string")
    texts = [
        f"Note. {long_.replace('before 5 men', 'before 7 men')}",
        "Now compute 12 + 34 + 56 + 78 and then subtract 9 from 10, please",
        "Compute 21 + 43 + 65 + 87 and then add 9 to 10",
        "so name all noble gases here", "name all the noble gases", None, "",
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, texts), items).collect()}
    assert set(got) == {(0, 0), (1, 1), (3, 2)} and got[1, 1].verbatim and got[3, 2].verbatim and not got[0, 0].verbatim


def test_decontaminate_finds_names_in_any_case_and_place(spark):
    first = "Alice has 12 apples at home. Bob gives 4 of them away. Then Alice and also Bob eat 3 more for lunch"
    other = first.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "15").replace("4", "6").replace("3 more", "2 more")
    items = spark.createDataFrame([(0, first)], "item_id long, text string")
    texts = [first.lower(), first.upper(), first.title(), other, other.replace(" ", "\n"), other.replace(" ", "  "), other.upper(), "Carol has 15 plums at work. Dan takes 6 of these back. Then Carol and Dan sell 2 more for money"]
    got = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, texts), items).collect()}
    assert set(got) == set(range(7)) and [got[i].verbatim for i in range(4)] == [True, True, True, False]
    short = "Alice has 12 apples at home. Bob gives 4 away"
    found = decontaminate.contaminated(docs(spark, [short.replace("Alice", "Carol").replace("12", "15")]), spark.createDataFrame([(0, short), (1, "that day Alice and Bob met")], "item_id long, text string"))
    assert [(r.item_id, sorted(r.slots)) for r in found.collect()] == [(0, ["12=15", "alice=carol"])]


def test_stages_tell_rows_apart_that_share_an_id_or_have_none(spark):
    near = "the old miller walked down to the river every morning before the first boats came in from the far side of the bay"
    item = "seven quiet painters carried twelve heavy ladders across the frozen square before the bells began"
    rows = [(1, near), (None, near + " today"), (None, "a text of its own about something else"), (None, "x y z " + item), (2, item), (2, "another text under the same number"),
            (None, "one lonely gardener plants red roses beside the stone wall of the church each spring"), (None, "one lonely gardener plants red roses beside the stone wall of the church each spring ok"), (3, "twin"), (3, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in jaccard_join.drop_near_duplicates(df, 4, 70).collect()]
    assert len(kept) == 6 and rows[0] in kept and rows[1] not in kept and rows[2] in kept and rows[5] in kept and kept.count((3, "twin")) == 1
    assert sum("gardener" in t for _, t in kept) == 1
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    clean = [(r.doc_id, r.text) for r in decontaminate.drop_contaminated(df, items).collect()]
    assert sorted(map(str, clean)) == sorted(str(r) for r in rows if item not in r[1])
    many = spark.createDataFrame([(None, f"text number {k} of many") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance.keep_sampled(many, labels, share=0.25).count() == 50


def test_pipeline_keeps_columns_and_packs_what_is_left(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs_, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs_.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = common.materialize(stage(spark, docs_, sf))
        assert docs_.columns == columns
        seen.append((name, docs_.count()))
    assert all(a[1] >= b[1] > 0 for a, b in zip(seen, seen[1:], strict=False))
    texts = [r.text for r in docs_.collect()]
    assert len(set(texts)) == len(texts)
    assert len({c for _, c in brute_components(texts, 5, 80)}) == len(texts)
