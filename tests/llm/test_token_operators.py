"""Encoding, alignment and clustering against the libraries and brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenscan.llm import alignment, bpe, clustering
from lumenscan.llm.registry import oracle_sql, queries

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BITS = ["a", "B", " ", "  ", "\n", "\t", "é", "中", "'s", "'", "1", "23", "<|endoftext|>", "\x1c", "᠎", " ", "😀", "́", "ſ", "٣", "²", "-", "\x00", "\x85", "　", "the", "xxxx", "▁", "<s>", "<0x41>", "ﬁ"]
rng = random.Random(7)
TEXTS = [
    "The cat sat on the mat.", "the dog sat, on the log", None, "", " ", "a", "The cat sat on the mat.", "x" * 3000, "ab" * 900 + " " * 700, "é ü  ß\t\n tab", "a ▁ b", "<|endoftext|> is <s> text</s>",
    " leading", "trailing ", "tête-à-tête 中文 😀", *["".join(rng.choice(BITS) for _ in range(rng.randint(1, 40))) for _ in range(60)], *[f"the cat saw the dog number {i % 7} on the mat" for i in range(30)],
    " ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 12))) for _ in range(4000)),
]


@lru_cache
def one_library(plain):
    out = Tokenizer.from_file(BYTE)
    out.encode_special_tokens = plain
    return out


@lru_cache
def piece_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


@pytest.fixture(scope="module")
def library():
    return one_library(False)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """TEXTS with null and repeated ids and columns named as the operators' own."""
    out = tmp_path_factory.mktemp("tokens")
    rows = [(None if i % 17 == 5 else i // 2 if i % 11 == 0 else i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    extra = {c: F.lit(1) for c in ("ids", "block", "pairs", "times", "groups", "n", "top", "pair", "decoded", "cluster", "components", "norms")}
    spark.createDataFrame(rows, DOCS).withColumns(extra).repartition(5).write.parquet(str(out / "documents.parquet"))
    return str(out)


def ids_of(i):
    return None if i % 17 == 5 else i // 2 if i % 11 == 0 else i


# --- encoding ---


def test_encoding_is_the_librarys(library):
    for t, ids in zip(TEXTS, bpe.bpe(BYTE).encode([t or "" for t in TEXTS]), strict=True):
        own = library.encode(t or "", add_special_tokens=False).ids
        assert ids.tolist() == own and bpe.bpe(BYTE).decode(ids.tolist()) == library.decode(own, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("".join(BITS)) | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_encoding_of_any_text(texts):
    assert [x.tolist() for x in bpe.bpe(BYTE).encode(texts)] == [one_library(False).encode(t, add_special_tokens=False).ids for t in texts]
    library = one_library(True)
    assert [x.tolist() for x in bpe.bpe(BYTE).encode(texts, specials=False)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_words_by_heap_and_by_rank_arrays(library):
    one = bpe.RankBpe(BYTE)
    for n in (2, 17, 64, 65, 300, 5000):
        word = "".join(rng.choice("etaoinsh") for _ in range(n)).encode()
        own = library.encode(word.decode(), add_special_tokens=False).ids
        assert np.frombuffer(one.merged_long(word), "<i4").tolist() == np.frombuffer(one.merged([word])[0], "<i4").tolist() == own


def test_words_are_forgotten(library, monkeypatch):
    one = bpe.RankBpe(BYTE)
    one.recent = bpe.Recent(10)
    for _ in range(2):
        for t in TEXTS:
            assert one.encode([t or ""])[0].tolist() == library.encode(t or "", add_special_tokens=False).ids
            assert len(one.recent.young) <= 10 >= len(one.recent.old)


def test_decoding_of_any_ids(spark, library):
    ids = [[rng.randrange(50_300) for _ in range(rng.randint(0, 30))] for _ in range(200)]
    rows = spark.createDataFrame([*enumerate(ids), (None, None), (7, [])], "doc_id long, ids array<int>")
    found = Counter((r["doc_id"], r["text"]) for r in bpe.decoded(rows, BYTE).collect())
    assert found == Counter([*((i, library.decode(x, skip_special_tokens=False)) for i, x in enumerate(ids)), (None, ""), (7, "")])


def test_op12(spark, folder, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[ids_of(i), len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, queries()["op12_bpe"](spark, folder).collect())) == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.RankBpe(public_tokenizers.path("word_bpe_49k.json"))


# --- alignment ---


def brute_alignment(texts):
    """Per text (a ids, b ids, groups, links), by comparing every two tokens."""
    one, two = one_library(True), piece_library()
    of = bpe.byte_of_char()
    out = []
    for t in texts:
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        x = [bytes(of[c] for c in one.id_to_token(i)) for i in a]
        y = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not b"".join(x) == b"".join(y) == (" " + t).encode():
            out.append(([], [], [], []))
            continue
        spans = [[(s, s + len(w)) for s, w in zip(np.cumsum([0, *map(len, ws)]).tolist(), ws, strict=False)] for ws in (x, y)]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, own, strict=True) if last <= s and e <= c) for ids, own in zip((a, b), spans, strict=True)))
            last = c
        links = [(i, j) for i, (s, e) in zip(a, spans[0], strict=True) for j, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e]
        out.append((a, b, groups, links))
    return out


def brute_counts(texts):
    """What op11 says of each text."""
    found = brute_alignment(texts)
    docs = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [
        (len(a), len(b), len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for a, b, groups, links in found
    ]


SHORT = [t for t in TEXTS if len(t or "") < 400]


def test_op11(spark, folder, monkeypatch):
    texts = [t if len(t or "") < 5000 else None for t in TEXTS]
    rows = spark.createDataFrame([(ids_of(i), t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, block int, groups int").repartition(3)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = Counter((ids_of(i), *x) for i, x in enumerate(brute_counts(texts)))
    for block in (alignment.BLOCK_CHARS, 300):  # many blocks give what one gives
        monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
        found = alignment.aligned(rows, BYTE, PIECE).withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
        found.write.mode("overwrite").parquet(f"{folder}/aligned-{block}")
        found = alignment.counted(spark.read.parquet(f"{folder}/aligned-{block}"), columns[:5] + columns[7:])
        assert Counter(map(tuple, found.select(*columns).collect())) == want


def test_op11_query(spark, folder):
    found = queries()["op11_alignment"](spark, folder)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in found.collect())
    assert got == Counter((ids_of(i), *x[:4], x[6]) for i, x in enumerate(brute_counts(TEXTS[:-1]) + brute_long()))


def brute_long():
    """The last, long text, stretch by stretch at its spaces, where tokens of both end."""
    words = TEXTS[-1].split(" ")
    parts = brute_alignment(words)
    groups = [g for x in parts for g in x[2]]
    return [(sum(len(x[0]) for x in parts), sum(len(x[1]) for x in parts), len(groups), sum(len(x[3]) for x in parts), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest())]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("".join(BITS)), max_size=25), min_size=1, max_size=4))
def test_alignment_of_any_text(texts):
    for (n_a, n_b, n_groups, groups, links), (a, b, want, pairs) in zip(alignment.aligner(BYTE, PIECE).align(texts), brute_alignment(texts), strict=True):
        assert (n_a, n_b, n_groups, groups) == (len(a), len(b), len(want), ";".join(want))
        assert sorted(links.tolist()) == sorted(i << 32 | j for i, j in pairs)


@given(st.lists(st.tuples(st.lists(st.integers(1, 5), max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=12)), max_size=4))
def test_merged_ends(texts):
    """Tokens of given sizes, ids being sizes; of some texts none."""
    own = []
    for a, b in texts:
        if a:
            short, long = sorted((a, b), key=sum)
            short[-1] += sum(long) - sum(short)
            own.append((a, b))
        else:
            own.append(([], []))
    sizes = np.arange(100)
    found = list(alignment.Aligned([np.array(a, np.int64) for a, _ in own], [np.array(b, np.int64) for _, b in own], sizes, sizes, [f"{i}{m}" for m in ",|;" for i in sizes]))
    assert len(found) == len(own)
    for (a, b), (n_a, n_b, n_groups, groups, pairs) in zip(own, found, strict=True):
        spans = [list(zip([0, *e], e, strict=False)) for e in (np.cumsum(a).tolist(), np.cumsum(b).tolist())]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        inside = lambda ids, own, c, last: ",".join(str(i) for i, (s, e) in zip(ids, own, strict=True) if last <= s and e <= c)
        want = ";".join(f"{inside(a, spans[0], c, last)}|{inside(b, spans[1], c, last)}" for last, c in zip([0, *cuts], cuts, strict=False))
        assert (n_a, n_b, n_groups, groups) == (len(a), len(b), len(cuts), want)
        assert pairs.tolist() == [a[i] << 32 | b[j] for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]


# --- clustering ---


def brute_clusters(vectors, k=16, rounds=3):
    """vectors: (vec_id, list). Integers of any size, all distances."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) * 64 < 1 << 27 for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda x: (digest(x[0]), x[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)]


def vectors(n, spread=1.0, seed=3):
    g = np.random.default_rng(seed)
    middle = g.normal(size=(5, 64))
    return [(i, (middle[i % 5] + spread * g.normal(size=64) * 0.1).astype(np.float32).tolist()) for i in range(n)]


ODD = [
    (900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [math.nan] + [0.5] * 63), (906, [math.inf] * 64), (907, [3e38] * 64), (None, [0.25] * 64), (None, [0.5] * 64),
    (3, [-0.001] * 64), (3, [-0.001] * 64), (908, [0.0] * 64), (909, [-0.0] * 64), (910, [2.0e6] * 64), (911, [-2.0e6] * 64),
]


@pytest.mark.parametrize("rows", [vectors(120), vectors(120, 20), vectors(7), [(i, [float(i % 2)] * 64) for i in range(50)], [], vectors(60) + ODD])
def test_op13(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, cluster int").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries()["op13_clustering"](spark, str(tmp_path))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, found.collect())) == Counter(brute_clusters(rows))


def test_screening_is_exact_and_prunes():
    x = np.array([[math.floor(64 * v) for v in row] for _, row in vectors(400)], np.int64)
    centroids = x[:16]
    to, distance, computed = clustering.assigned(x, clustering.norms(x), centroids)
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert to.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()
    assert computed < every.size / 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 27), 1 << 27) | st.integers(-2, 2), min_size=8, max_size=8), min_size=1, max_size=12), st.integers(1, 5))
def test_screening_of_any_vectors(rows, k):
    x = np.array(rows, np.int64)
    centroids = x[:k]
    to, distance, _ = clustering.assigned(x, clustering.norms(x, 2), centroids)
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert to.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()


def test_op13_sql(spark):
    import os

    import duckdb

    at = "/root/testdata/sf0.001/embeddings.parquet"
    if not os.path.exists(at):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}'")
    found = con.execute(oracle_sql()["op13_clustering"])
    columns = [d[0] for d in found.description]
    rows = queries()["op13_clustering"](spark, os.path.dirname(at)).select(*columns).collect()
    assert Counter(map(tuple, rows)) == Counter(found.fetchall()) and rows
