"""Scoring, language identification, fingerprints, tokenizers."""

import hashlib
import math
import os
import re
import struct
import tracemalloc
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenscan.llm import common, imatch, langid, lm, tokens
from lumenscan.llm.common import crc_of_id
from lumenscan.llm.tokens import BYTE_LEVEL_PATTERN, FastTokenizer, byte_of_char

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "s", 0) for i, t in enumerate(texts)], DOCS)


TEXTS = ["The cat sat on the mat", "the dog sat on the log", None, "", "a", "the cat sat on the mat", "x " * 3000, "é ü  ß\t\n tab", "THE CAT"] + [f"the cat saw the dog number {i % 7} on the mat" for i in range(60)]


def test_lm_against_counting(spark):
    held = (crc_of_id() % 10) == 0
    rows = docs(spark, TEXTS)
    model = lm.Model(rows.filter(~held), head_words=3)  # few head words: the joined path is used too
    found = {r["doc_id"]: r for r in model.scored(rows, held).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(TEXTS)}
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in tokens.items() if not out(i) for w in ws)
    total, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(ws), sum(c[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws))
        assert r["score"] <= 0
    assert sum(r["score"] for r in found.values() if r["held_out"]) > sum(r["base_score"] for r in found.values() if r["held_out"])


def test_lm_third_order_and_empty(spark):
    rows = docs(spark, TEXTS)
    assert lm.Model(rows, order=3).scored(rows, F.lit(False)).count() == len(TEXTS)
    none = rows.limit(0)
    assert lm.Model(none).scored(none, F.lit(False)).count() == 0
    assert all(math.isfinite(r["score"]) for r in lm.Model(none).scored(rows, F.lit(True)).collect())


def brute_scores(texts, learnt, order):
    """log10 probabilities by exact n-gram counts, quantised as the filter's levels are, under the weight of most leave-one-out likelihood."""
    quantised = lambda n: lm.COUNT_AT[lm.level_of(np.array([n]))[0]] if n else 0.0
    tokens = [[*["<s>"] * (order - 1), *(t or "").encode().lower().split(), "</s>"] for t in texts]
    c = Counter()
    for i in learnt:
        c.update(("<s>",) * n for n in range(1, order))
        for k in range(order - 1, len(tokens[i])):
            for n in range(1, order + 1):
                c[tuple(tokens[i][k - n + 1 : k + 1])] += 1
    words = [w for i in learnt for w in tokens[i][order - 1 :]]
    norm = len(words) + 0.1 * (len(set(words)) + 1)

    def score(i, a, left_out=0.0):
        total = 0.0
        for k in range(order - 1, len(tokens[i])):
            p = (max(quantised(c[(tokens[i][k],)]) - left_out, 0) + 0.1) / norm
            for n in range(2, order + 1):
                gram = tuple(tokens[i][k - n + 1 : k + 1])
                p = (max(quantised(c[gram]) - left_out, 0) + a * p) / (max(quantised(c[gram[:-1]]) - left_out, 0) + a)
            total += math.log10(min(p, 1.0))
        return total

    a = max(lm.FIT_GRID, key=lambda a: sum(score(i, a, 1.0) for i in learnt)) if learnt else 1.0
    return a, [score(i, a) for i in range(len(texts))]


@pytest.mark.parametrize("order", [2, 3])
def test_score_against_counting(spark, order, monkeypatch):
    """The broadcast filter, and one of 30 times the bytes that may be broadcast, give the model's probabilities. The filter has 12 bits an
    event, so a few absent n-grams count as seen: texts are within 0.02 a token of exact counts, and most are equal."""
    held = (crc_of_id() % 10) == 0
    rows = docs(spark, TEXTS).repartition(3)
    weight, expected = brute_scores(TEXTS, [i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 10], order)
    monkeypatch.setattr(lm, "CHUNK_TEXTS", 7)
    monkeypatch.setattr(lm, "LOOKUP_PROBES", 20)
    whole = lm.Model(rows.filter(~held), order)
    model = lm.Model(rows.filter(~held), order, whole.filter_bytes // 30)
    assert (whole.joined, model.joined) == (False, True) and model.filter_bytes == whole.filter_bytes
    a, b = ({r["doc_id"]: r for r in m.scored(rows, held).collect()} for m in (whole, model))
    assert a.keys() == b.keys() == set(range(len(TEXTS))) and whole.weight == model.weight == weight
    for i, r in a.items():
        assert tuple(b[i])[:5] == tuple(r)[:5] and (b[i]["base_score"], b[i]["score"]) == pytest.approx((r["base_score"], r["score"]))
    apart = [abs(a[i]["score"] - x) / a[i]["n_tokens"] for i, x in enumerate(expected)]
    assert max(apart) < 0.02 and np.mean([x < 1e-9 for x in apart]) > 0.8


def test_no_task_holds_the_whole_filter(spark, monkeypatch):
    """Neither the broadcast nor a lookup has more of the filter than a block; groups of few tokens, and whole tasks, score alike."""
    held = (crc_of_id() % 10) == 0
    rows = docs(spark, TEXTS).repartition(3)
    model = lm.Model(rows.filter(~held))
    assert sum(x.nbytes for x in model.shared.value) < model.filter_bytes + 16 * len(model.shared.value[0]) and len(model.shared.value) == 2
    blocks = {r["part"]: bytes(r["block"]) for r in model.blocks.collect()}
    whole = lm.LogFrequencyFilter([blocks.get(p, b"\0" * 8) for p in range(model.parts)])
    asked = np.concatenate([lm.asked_of(lm.sequence_of([(t or "").encode()], 2)[0], 2) for t in TEXTS])
    expected, read = whole.levels(asked), []
    one = lm.LogFrequencyFilter
    monkeypatch.setattr(lm, "LogFrequencyFilter", lambda b: read.append(len(b)) or one(b))
    assert model.files.levels(asked).tolist() == expected.tolist() and set(read) == {1} and expected.max() > 1
    a = sorted(map(tuple, model.scored(rows, held).collect()))
    monkeypatch.setattr(lm, "CHUNK_TEXTS", 2)
    monkeypatch.setattr(lm, "GROUP_TOKENS", 5)
    b = sorted(map(tuple, lm.Model(rows.filter(~held)).scored(rows, held).collect()))
    assert [x[:5] for x in a] == [x[:5] for x in b] and [x[6] for x in a] == pytest.approx([x[6] for x in b])


def test_weight_without_training_rows(spark):
    """Texts that are all held out are scored with the weight of the training texts."""
    rows = docs(spark, TEXTS)
    both, apart = lm.Model(rows), lm.Model(rows)
    both.scored(rows, F.lit(False)).count()
    apart.scored(rows.limit(3), F.lit(True)).count()
    assert both.weight == apart.weight


def test_filter_never_misses_and_quantises():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    h = lm.mixed(h)
    counts = rng.integers(1, 1000, len(h))
    part, keys = lm.placed(h, 2)
    assert lm.unpacked(lm.packed(keys)).tolist() == keys.tolist()
    f = lm.LogFrequencyFilter([lm.build_block(keys[part == p], counts[part == p], 1 << 30) for p in (0, 1)])
    assert (f.levels(h) >= lm.level_of(counts)).all()
    assert (f.levels(h) == lm.level_of(counts)).mean() > 0.98
    assert (f.levels(lm.mixed(rng.integers(0, 2**63, 20_000).astype(np.uint64))) > 0).mean() < 0.02
    small = lm.build_block(h, counts, 64)
    assert len(small) == 64  # never more than it may


def test_word_hashes(monkeypatch):
    """Words as bytes.split has them; equal words have equal hashes, however texts are cut into stretches."""
    texts = ["Aa b\tC\n", "", "x" * 5000, " é  É aa", "\x0b\x0c\r\x1c a", "y" * 70, "b " * 300]
    data = [t.encode() for t in texts]
    words = [t.lower().split() for t in data]
    whole = common.words_by_text(data)
    monkeypatch.setattr(common, "STRETCH", 100)
    monkeypatch.setattr(common, "LONG_WORD", 64)
    parts = common.words_by_text(data)
    of = {}
    for own, x, y in zip(words, whole, parts, strict=True):
        assert len(own) == len(x) == len(y)
        for w, h, k in zip(own, x.tolist(), y.tolist(), strict=True):
            assert of.setdefault(w, h) == h and (len(w) > 64 or h == k)
    assert len(set(of.values())) == len(of) and len(of) > 7
    assert common.words_by_text([]) == [] and [len(x) for x in common.words_by_text([b""])] == [0]


def test_language_id(spark):
    words = {"en": "the of and to in is that it was for on are with as his they".split(), "de": "der die und das nicht ich zu den mit sich für auf ein".split(), "fr": "le la les des une est pour que dans qui sur avec être".split()}
    texts, langs = [], {}
    for i in range(240):
        lang = list(words)[i % 3]
        langs[i] = lang
        texts.append(" ".join(words[lang][(i * 7 + k * k) % len(words[lang])] for k in range(12)))
    texts += [None, "", "123 !!", " ".join(words["de"]) * 500]
    langs[243] = None
    rows = docs(spark, texts, langs)
    model = langid.trained(rows)
    found = langid.identified(rows.select("doc_id", langid.in_fold().alias("held_out"), "text"), model, ["doc_id", "held_out"]).collect()
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in found if r["doc_id"] < 240 and r["held_out"]]) > 0.95
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["lang_pred"] for i in (240, 241, 242, 243)] == ["und", "und", "und", "de"]
    assert by[240]["score"] == 0 and all(0 <= r["score"] <= 1 for r in found)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no tables")
def test_language_id_held_out_accuracy(spark):
    """The query over the driver's documents: the fold that it has not learnt from."""
    found = langid.op4_language_id(spark, "/root/testdata/sf0.01").filter("held_out")
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null").select("doc_id", "lang").join(found, "doc_id").filter("lang_pred != 'und'").collect()
    assert len(rows) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_sample_is_bounded(spark, monkeypatch):
    """A labelled row that fills a third of the table comes into the sample once, and each language gives its share at most."""
    taken = []

    class Counted(langid.Classifier):
        def __init__(self, rows, labels):
            taken.append((np.packbits(rows, axis=1), Counter(labels)))

    monkeypatch.setattr(langid, "Classifier", Counted)
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'the same text', concat('words number ', id)) as text", "if(id % 7 = 1, 'de', 'en') as lang")
    langid.fit(rows, sample_docs=50)
    (bits, labels), same = taken[0], np.packbits(langid.present("the same text"))
    assert 30 <= sum(labels.values()) <= 50 and set(labels) == {"de", "en"} and max(labels.values()) <= 25
    assert sum((x == same).all() for x in bits) <= 2  # once a label


def test_the_fit_is_small_on_the_driver():
    """pipeline: the sample stays packed while it is fitted, with the same model. A row a place and byte took 157 MB of the driver for 2,400 texts."""
    g = np.random.default_rng(4)
    rows, labels = g.random((1200, langid.PLACES), np.float32) < 0.05, ["aa", "bb", "cc"] * 400
    bits = [x.tobytes() for x in np.packbits(rows, axis=1)]
    whole = langid.Classifier(rows, labels, landmarks=30)
    del rows
    tracemalloc.start()
    packed = langid.Classifier(langid.Packed(bits), labels, landmarks=30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (packed.folded == whole.folded).all() and (packed.bias == whole.bias).all()
    assert peak < 80 << 20


def test_the_fit_unpacks_few_texts_at_once(monkeypatch):
    """pipeline: beside landmarks and the packed sample the fit holds a block of texts; it was 256 of them, 41 MB. The model stays the same."""
    g = np.random.default_rng(5)
    rows, labels = g.random((600, langid.PLACES), np.float32) < 0.05, ["aa", "bb", "cc"] * 200
    packed = langid.Packed([x.tobytes() for x in np.packbits(rows, axis=1)])
    del rows
    tracemalloc.start()
    model = langid.Classifier(packed, labels, landmarks=30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    monkeypatch.setattr(langid, "FIT_ROWS", 256)
    other = langid.Classifier(packed, labels, landmarks=30)
    assert np.allclose(model.folded, other.folded, rtol=1e-4, atol=1e-7) and np.allclose(model.bias, other.bias, rtol=1e-4)


def test_the_driver_lets_go_between_steps(spark, monkeypatch):
    """pipeline: what steps left on the driver's heap goes when the next table is staged, once the heap has filled to a share of its limit. It
    stayed until the JVM collected by itself, with a heap that had grown to that limit on tables of many parts."""
    made = lambda: common.staged(spark.range(1), "one")
    monkeypatch.setattr(common, "_heap_left", 0, raising=False)
    monkeypatch.setattr(common, "HEAP_SHARE", 2.0, raising=False)
    made()
    assert common._heap_left == 0  # no need, no collection
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    assert made().count() == 1 and common._heap_left > 0
    monkeypatch.setattr(common, "_heap_left", 1 << 60)
    made()
    assert common._heap_left == 1 << 60  # little has come since the last one


def grams(text):
    """The n-grams themselves, with nothing hashed."""
    data = b" " + b" ".join(text.lower().encode().translate(langid._SPACED).split()) + b" "
    return {data[i : i + n] for n in langid.GRAMS for i in range(len(data) - n + 1)}


def brute_values(train, labels, tests, ridge=langid.RIDGE):
    """Kernel ridge regression, one against the rest, on exact kernels of all pairs; the bias is a constant feature."""
    own = [grams(t) for t in train]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b)) + 1
    goals = np.array([[1.0 if x == lang else -1.0 for lang in sorted(set(labels))] for x in labels])
    weights = np.linalg.solve(np.array([[kernel(a, b) for b in own] for a in own]) + ridge * np.eye(len(own)), goals)
    return np.array([[kernel(grams(t), b) for b in own] for t in tests]) @ weights


def test_language_id_against_exact_kernels():
    """With every training text as a landmark the model is kernel ridge regression: same labels, values apart by what hashing merges."""
    g = np.random.default_rng(2)
    words = {lang: ["".join(g.choice(list(letters), g.integers(2, 9))) for _ in range(150)] for lang, letters in (("aa", "etaoinshrd"), ("bb", "enisratdhu"), ("cc", "eaosrnidlç"))}
    text = lambda lang, n: " ".join(g.choice(words[lang], n))
    labels = [lang for lang in words for _ in range(25)]
    train, tests = [text(lang, int(g.integers(5, 80))) for lang in labels], [(lang, text(lang, n)) for lang in words for n in (4, 10, 40, 300)]
    model = langid.Classifier(np.array([langid.present(t) for t in train]), labels, landmarks=len(train))
    found, exact = model.values(np.array([langid.present(t) for _, t in tests])), brute_values(train, labels, [t for _, t in tests])
    assert found.argmax(1).tolist() == exact.argmax(1).tolist() == [sorted(words).index(lang) for lang, _ in tests]
    assert np.abs(found - exact).max() < 0.05


def test_language_id_without_labels(spark):
    rows = docs(spark, ["some text"]).withColumn("lang", F.lit(None).cast("string"))
    assert langid.trained(rows) is None
    assert langid.identified(rows, None, ["doc_id"]).first()["lang_pred"] == "und"
    assert langid.identified(rows.limit(0), None, ["doc_id"]).count() == 0


def test_kernel_is_an_inner_product():
    a, b = langid.present("abab"), langid.present("abab!")
    assert (a == b).all() and a.sum() == len({" ", "a", "b", " a", "ab", "ba", "b ", " ab", "aba", "bab", "ab ", " aba", "abab", "bab "})


def xxhash64(text, *numbers):
    """As Spark's function of that name has it for a string and integers."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    for n in numbers:
        h = xxhash.xxh64_intdigest(struct.pack("<i", n), h)
    return h - (1 << 64) if h >> 63 else h


def brute_fingerprints(rows, low, high):
    """The whole of op7 over (doc_id, text) rows."""
    n_rows, least = len(rows), -(2**63)
    terms = lambda t: sorted({w for w in re.split(imatch.NOT_A_WORD, t.lower()) if w})
    holding = Counter(w for _, t in rows for w in terms(t or ""))
    lexicon = {w for w, n in holding.items() if low * n_rows <= n <= high * n_rows}
    order = sorted(((i if i is not None else least, xxhash64(t or ""), i, t or "") for i, t in rows), key=lambda r: r[:2])

    def fingerprint(text):
        words = terms(text)
        out, kept = [f"{xxhash64(' '.join(words), -1) & (2**64 - 1):016x}"], [w for w in words if w in lexicon]
        for s in range(imatch.SUBSETS):
            own = [w for w in kept if ((xxhash64(w) & (2**64 - 1)) >> 3 * s) % (4 << s % imatch.LEVELS) == 0]
            out.append(f"{xxhash64(' '.join(own), s) & (2**64 - 1):016x}" if own else "")
        return "-".join(out)

    def likeness(a, b):
        a, b = a.split("-"), b.split("-")
        some = [x == y for x, y in zip(a[1:], b[1:], strict=True) if x or y]
        return sum(some) / len(some) if some else float(a[0] == b[0])

    out = []
    for k, (_, _, i, text) in enumerate(order):
        following, n = order[(k + 1) % n_rows][3], len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        own, other = fingerprint(text), fingerprint(edited)
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), own, other, round(likeness(own, other), 9), round(likeness(own, fingerprint(following)), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_rows", [imatch.GROUP_ROWS, 7])
def test_fingerprints_against_brute_force(spark, group_rows):
    """Extreme and stray ids, null ones, repeated ids with different texts, equal rows, null and empty texts, characters outside ASCII."""
    common = [f"w{i} w{i + 1} w{i + 2} filler{i % 5} end" for i in range(40)]
    rows = [(i * 3, t) for i, t in enumerate([common[0] * 3, common[0] * 3, None, "", "odd", "naïve 日本 text 😀😀 x", *common])]
    rows += [(None, "null id"), (None, "another null id"), (2**63 - 1, "most"), (-(2**63), "least"), (10**15, "stray"), *[(9, f"same id {i}") for i in range(20)], *[(12, "equal rows")] * 30]
    data = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, place long").withColumn("text", F.coalesce("text", F.lit(""))).repartition(3)
    found = imatch.fingerprinted(data, 0.01, 0.5, group_rows).collect()
    found = sorted((tuple(r)[:5] + (round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found), key=str)
    assert found == brute_fingerprints(rows, 0.01, 0.5)
    by = {}
    for r in found:
        by.setdefault(r[1:4:2], set()).add(r[3])
    assert any(0 < r[6] < 1 for r in found) and len({r[3] for r in found if r[0] in (0, 3)}) == 1


def test_even_groups_whatever_the_ids(spark):
    """One stray id, and an id that a third of the rows share, do not make groups uneven."""
    rows = spark.range(6000).selectExpr("case when id = 0 then 1000000000000000 when id % 3 = 0 then 77 when id % 50 = 1 then null else id end as doc_id", "if(id % 3 = 0 and id % 2 = 0, 'equal', concat('text ', id)) as text", "id as place")
    sizes = [r["count"] for r in imatch.grouped(rows, 100).groupBy("grp").count().collect()]
    assert len(sizes) > 45 and max(sizes) < 300 and sum(sizes) == 6000


def test_query_of_fingerprints(spark, tmp_path):
    """The query with its production band: rare terms are in it here, since the table is small."""
    rows = [(i, f"shared words {'x' if i % 2 else 'y'} t{i % 9} u{i}" * (1 + i % 3)) for i in range(60)] + [(3, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((tuple(r)[:5] + (round(r["near_edited"], 9), round(r["near_next"], 9)) for r in imatch.op7_fingerprints(spark, str(tmp_path)).collect()), key=str)
    assert found == brute_fingerprints(rows, imatch.LOW_SHARE, imatch.HIGH_SHARE)


def test_likeness(spark):
    near = spark.createDataFrame([("w-a-b---c", "v-a-x---d"), ("w----", "w----"), ("w----", "v----")], "a string, b string").select(imatch.likeness(F.col("a"), F.col("b")).alias("x"))
    assert [round(r["x"], 4) for r in near.collect()] == [0.3333, 1.0, 0.0]  # of three lexicons that keep anything one agrees


def test_fingerprint_lexicon_is_a_band(spark):
    rows = spark.createDataFrame([(i, f"all {'half' if i % 2 else 'other'} one{i}") for i in range(20)], "doc_id long, text string")
    lexicon = imatch.lexicon(rows, 0.2, 0.6)
    terms = F.split(F.lit("all half other one3 none"), " ")
    kept = F.filter(terms, lambda t: F.contains(F.element_at(lexicon, (imatch._bucket(t) + 1).cast("int")), F.concat(F.lit(imatch.MARK), t, F.lit(imatch.MARK))))
    assert rows.limit(1).select(kept.alias("x")).first()["x"] == ["half", "other"]


def test_fingerprints_by_hand(spark):
    text = "beta alpha beta, Alpha gamma"
    lexicon = F.split(F.lit(imatch.BREAK.join([""] * imatch.LEXICON_BUCKETS)), imatch.BREAK, -1)
    got = spark.createDataFrame([(text,)], "t string").select(imatch.fingerprint(imatch.terms_of(F.col("t")), lexicon).alias("x"), F.xxhash64(F.lit("alpha beta gamma"), F.lit(-1)).alias("h")).first()
    assert got["x"] == f"{got['h'] & (2**64 - 1):016x}" + "-" * imatch.SUBSETS  # all distinct terms, sorted; no lexicon keeps any


FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["a  b   c\n\n d\t\te \n x", "  lead", "tail  ", "\x1c a\x1fb", "é é ΑΣ İ", "<|endoftext|> x <|startoftext|>", "", "\n", "don't we'll I'M DON'T's", "日本語 123 ４５", "a​b ﻿c", "x\r\n y\x85z", "a\xa0b \xad c½ ²x ª", "\x00 a", "____ !!! '' '", "ﬁ x", "é"]


@lru_cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", FILES)
def test_tokenizer_equals_the_library(name, monkeypatch):
    """With the library's own object as the file describes it, special strings included."""
    fast, own = FastTokenizer(public_tokenizers.path(name)), library(name)
    assert fast.many is not None
    texts = ODD + ["The quick brown fox, it's 1999 and we'll see — “yes”… naïve façade Straße\n\n  end " * 3, "zxqv" * 50, "a <|endoftext|> b", "<|startoftext|>x"]
    for most in (1_000_000, 7):
        monkeypatch.setattr(tokens, "LONG_TEXT", most)
        for text, ids in zip(texts, fast.encode(texts), strict=True):
            assert ids.tolist() == own.encode(text, add_special_tokens=False).ids, text
    assert (50256 if "byte" in name else 49407) in fast.encode(["a <|endoftext|> b"])[0]
    assert fast.encode([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab sStTrReEvVmMlLdD'’.,!?\n\t\xa0éßÀ19½–…", max_size=30), min_size=1, max_size=5))
def test_tokenizer_on_marks_and_contractions(texts):
    for name in FILES:
        fast, own = tokens.tokenizer(public_tokenizers.path(name)), library(name)
        assert [x.tolist() for x in fast.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizer_of_another_kind(tmp_path):
    """A file whose normalizer or pattern the fast way does not know goes to the library."""
    import json

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    fast = FastTokenizer(str(tmp_path / "t.json"))
    assert fast.many is None and fast.encode(["Some Text"])[0].tolist() == fast.library.encode("Some Text", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_every_token_is_made_from_its_own_bytes(name):
    """The ground on which both engines agree on every text."""
    import json

    spec = json.load(open(public_tokenizers.path(name)))
    suffix, special = spec["model"].get("end_of_word_suffix") or "", {x["content"] for x in spec["added_tokens"]}
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    ids = [vocabulary["".join(m) if not isinstance(m, str) else m.replace(" ", "")] for m in merges]
    assert ids == sorted(ids)
    model = library(name).model
    whole = [t for t in vocabulary if t not in special and (t.endswith(suffix) if suffix else True)]
    assert all(len(model.tokenize(t[: len(t) - len(suffix)])) == 1 for t in whole)


def test_byte_level_table():
    assert len(byte_of_char()) == 256 and sorted(byte_of_char().values()) == list(range(256))
    assert BYTE_LEVEL_PATTERN == public_tokenizers.PATTERN


