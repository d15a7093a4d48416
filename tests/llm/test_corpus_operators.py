"""Deduplication, decontamination, joins, packing, files, archives, chats and the pipeline against brute force."""

import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lumenscan.llm import chat, decontam, jaccard_join, packing, suffix_dedup, token_files, warc
from lumenscan.llm.common import file_system, new_folder, work_root
from lumenscan.llm.registry import oracle_sql, queries
from lumenscan.llm.tokens import tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int",
}


def prose(rng, n):
    return " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Originals, exact and near copies, shared passages, nulls, empty, short and long ones, runs of one letter."""
    rng = np.random.default_rng(3)
    base = [prose(rng, int(n)) for n in rng.integers(1, 300, 30)]
    passage = prose(rng, 70)
    out = [*base, *base[:4], None, "", " ", "a", "ab" * 400, "x" * 900, prose(rng, 4000), None]
    for i in range(6):
        words = base[5 + i].split()
        if len(words) > 40:
            words[len(words) // 2] = "changed"
        out.append(" ".join(words))
        out.append(f"{prose(rng, 60)} {passage} {prose(rng, 30)}")
    return [*out, *["the same text, many times over, " * 12] * 9, "é" * 150 + passage, "à" * 150 + passage]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i * 2, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], TABLES["documents"]).repartition(5)


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):
    """A folder of tables, with a column that no operator knows."""
    out = tmp_path_factory.mktemp("tables")
    docs.withColumns({c: F.lit(1) for c in ("key", "score", "spans", "cls", "n", "grp", "lang_pred")}).write.parquet(str(out / "documents.parquet"))
    items = [(1, texts[0]), (2, texts[7]), (3, "only three words"), (4, None), (5, ""), (10, texts[0])]
    spark.createDataFrame(items, TABLES["benchmark"]).write.parquet(str(out / "benchmark.parquet"))
    pages = [(i, f"http://x/{i} y" if i % 3 else None, None if i == 7 else "<p>é</p>" * (i % 5)) for i in range(40)]
    spark.createDataFrame(pages, TABLES["pages"]).write.parquet(str(out / "pages.parquet"))
    spark.createDataFrame([(i, [float(i % 7)] * 64, i) for i in range(40)], TABLES["embeddings"]).withColumn("cluster", F.lit(1)).write.parquet(str(out / "embeddings.parquet"))
    turns = [(c, t, ["user", "assistant", "system"][t % 3], None if t == 4 else f"<|end|> &amp; [INST] {c} é {t}\n" * (t + 1)) for c in range(5) for t in range(c + 1)]
    spark.createDataFrame([*turns, turns[3]], TABLES["conversations"]).write.parquet(str(out / "conversations.parquet"))
    return str(out)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(out / f"{name}.parquet"))
    return str(out)


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_take_extra_columns(spark, folder, name):
    assert queries()[name](spark, folder).limit(1).count() == 1


@pytest.mark.parametrize("name", ["op1_lm_scoring", "op4_language_id", "op7_fingerprints"])
def test_extra_columns_change_nothing(spark, folder, docs, tmp_path, name):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain, extra = (sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in queries()[name](spark, f).collect()), key=repr) for f in (str(tmp_path), folder))
    assert len(plain) == docs.count() and plain == extra


def test_queries_leave_only_their_result(spark, folder):
    """Of what a query makes on its way nothing stays in the work folder."""
    import os

    root = work_root(spark).removeprefix("file://") + "/lumenscan"
    before = set(os.listdir(root))
    for name in ("op9_token_files", "op10_jaccard_join"):
        queries()[name](spark, folder)
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before) == ["op10_jaccard_join", "op9_token_files"]
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, folder)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before] == ["pipeline-packing"]


def test_columns_with_clashing_names(spark, docs, folder):
    """Columns named as stages name their own pass through every stage untouched."""
    names = ["row_key", "text_key", "found_lang", "found_score", "text_bytes", "repeated_spans", "no_text", "scored_text", "SPANS", "grp"]
    rows = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, folder)
        assert out.columns == rows.columns, name
        kept = out.collect()
        assert kept and all(r[n] == f"{n}{r['doc_id']}" for r in kept for n in names), name


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty, name):
    assert queries()[name](spark, empty).count() == (1 if name.startswith("op2_") else 0)


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


# --- suffix-array deduplication ---


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + 200] for d in data for p in range(len(d) - 199))
    out = []
    for d in data:
        hit = np.zeros(len(d), bool)
        for p in range(len(d) - 199):
            if seen[d[p : p + 200]] > 1:
                hit[p : p + 200] = True
        edges = np.diff(np.concatenate([[0], hit, [0]]).astype(int))
        out.append((len(d), int(hit.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~hit])).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "broadcast"), [(suffix_dedup.HOT_CONTEXTS, suffix_dedup.MAX_BROADCAST_BYTES), (3, suffix_dedup.MAX_BROADCAST_BYTES), (suffix_dedup.HOT_CONTEXTS, 0)])
def test_suffix_dedup(spark, folder, texts, hot, broadcast, monkeypatch):
    """Also with hot buckets compared string by string, and with a filter that is too large to be broadcast."""
    monkeypatch.setattr(suffix_dedup.covers, "__defaults__", (hot,))
    monkeypatch.setattr(suffix_dedup, "MAX_BROADCAST_BYTES", broadcast)
    found = {r["doc_id"]: tuple(r)[1:] for r in queries()["op8_suffix_dedup"](spark, folder).collect()}
    assert found == {i * 2: x for i, x in enumerate(brute_repeats(texts))}


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefgh"), 3000))
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    pieces = [x for c in suffix_dedup.pieces([long.encode(), b"short", long[1000:1700].encode()]) for x in c]
    assert {p[0] for p in pieces} == {0, 2} and all(len(p[2]) <= 333 + 199 for p in pieces)
    assert sum(len(p[2]) - 199 for p in pieces) == 3000 - 199 + 700 - 199


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=160, max_size=400))
def test_sliding_min(values):
    x = np.array(values, np.uint64)
    assert suffix_dedup.sliding_min(x, 151).tolist() == [min(values[i : i + 151]) for i in range(len(values) - 150)]


def test_deduplicated_text(spark, docs):
    out = suffix_dedup.deduplicated(docs.withColumn("spans", F.lit("mine")))
    assert out.columns == [*docs.columns, "spans"] and out.count() == docs.count()
    assert {r["spans"] for r in out.collect()} == {"mine"}


# --- n-gram Jaccard join ---


def brute_components(texts, threshold=85):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    owner = list(range(len(sets)))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                owner[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_join(spark, folder, texts):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries()["op10_jaccard_join"](spark, folder).collect()}
    assert found == {i * 2: (n, c * 2) for i, (n, c) in enumerate(brute_components(texts))}


@pytest.mark.parametrize(("long_list", "whole_list"), [(jaccard_join.LONG_LIST, jaccard_join.WHOLE_LIST), (4, 2), (jaccard_join.LONG_LIST, 2)])
def test_jaccard_chain_and_split_lists(spark, long_list, whole_list):
    """Neighbours in a chain of edits are alike, its ends are not; all is one component, also with posting lists in parts or divided."""
    rng = np.random.default_rng(8)
    words = prose(rng, 120).split()
    chain = [" ".join(words)]
    for i in range(24):
        words[(i * 5) % 120] = f"edit{i}"
        chain.append(" ".join(words))
    texts = [*chain, *(prose(rng, 100) for _ in range(20))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.joined_components(rows, long_list=long_list, whole_list=whole_list).collect()}
    assert found == {i: c for i, (_, c) in enumerate(brute_components(texts))}
    assert {found[i] for i in range(25)} == {0}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1), st.sets(st.integers(0, 300), min_size=1))
def test_bounds_hold(a, b):
    """Prefixes of similar sets meet under each order, and bitmaps never differ in more bits than sets in tokens."""
    x, y = (np.unique(jaccard_join.mixed(np.array(sorted(s), np.uint64))) for s in (a, b))
    sketch = np.zeros(1 << jaccard_join.SKETCH_LOG, np.uint8)
    differ = sum(bin((int(p) ^ int(q)) & (2**64 - 1)).count("1") for p, q in zip(jaccard_join.parity(x), jaccard_join.parity(y), strict=True))
    assert differ <= len(a ^ b)
    if 100 * len(a & b) >= 85 * len(a | b):
        assert set(jaccard_join.prefix(x, sketch).tolist()) & set(jaccard_join.prefix(y, sketch).tolist())
        for k in (1, 2):
            assert set(jaccard_join.signature(x, k).tolist()) & set(jaccard_join.signature(y, k).tolist())


def test_join_moves_little(spark, docs, monkeypatch):
    """Tasks send their counts packed; signatures move for the classes of pairs that sizes and bitmaps allow; texts are shuffled by class once."""
    counts = jaccard_join.described(docs, 4, 85).filter("chunk is not null").agg(F.sum(F.octet_length("counts")), F.count("*")).first()
    assert counts[0] < 1000 * counts[1]  # 131,072 bytes each before
    seen, plain = {}, jaccard_join.staged
    monkeypatch.setattr(jaccard_join, "staged", lambda df, name, **more: seen.setdefault(name, []).append(df) or plain(df, name, **more))
    jaccard_join.joined_components(docs).count()
    steps = {name: [line for df in seen[name] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()] for name in ("join-allowed", "join-texts")}
    assert not any("Project" in line and "s1#" in line for line in steps["join-allowed"]) and any("Project" in line and "b0#" in line for line in steps["join-allowed"])
    assert not any("Aggregate" in line for line in steps["join-texts"])


def test_orders_drop_pairs_by_chance(spark):
    """Sets that share one rare token meet under the first order only: their pair is dropped by the signatures."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(60)]
    sketch = np.ones(1 << jaccard_join.SKETCH_LOG, np.uint8)
    rare = np.uint64(2**62 + 12345)
    sketch[int(rare >> np.uint64(64 - jaccard_join.SKETCH_LOG))] = 0
    sets = [np.unique(np.append(s, rare)) for s in sets]
    assert all(rare in jaccard_join.prefix(s, sketch) for s in sets)
    schema = "cls long, n long, " + ", ".join(f"b{i} long" for i in range(8)) + ", s1 array<int>, s2 array<int>"
    classes = spark.createDataFrame([(i, len(s), *[0] * 8, *(jaccard_join.signature(s, k).tolist() for k in (1, 2))) for i, s in enumerate(sets)], schema)  # bitmaps that allow all
    pairs = spark.createDataFrame([(i, j) for j in range(60) for i in range(j)], "a long, b long")
    assert jaccard_join._screened(pairs, classes, 85).count() < 20  # of 1770
    assert jaccard_join._screened(spark.createDataFrame([(5, 5)], "a long, b long"), classes, 85).count() == 1


# --- decontamination ---


def test_decontamination(spark, folder, texts):
    import re

    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    items = {"1": texts[0], "2": texts[7], "3": "only three words", "4": None, "5": "", "10": texts[0]}
    windows = {}
    for i, t in items.items():
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    found = {r["doc_id"]: tuple(r)[1:] for r in queries()["op3_decontamination"](spark, folder).collect()}
    for i, t in enumerate(texts):
        w, hit, met = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    met |= windows[tuple(w[k : k + size])]
                    hit |= set(range(k, k + size))
        assert found[i * 2] == (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)), i


def test_benchmark_in_blocks(spark, folder, monkeypatch):
    whole = sorted(map(tuple, queries()["op3_decontamination"](spark, folder).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 5)  # items of more windows are spread over blocks
    assert sorted(map(tuple, queries()["op3_decontamination"](spark, folder).collect())) == whole


@pytest.mark.parametrize("windows", [decontam.BLOCK_WINDOWS, 1])
def test_items_that_share_an_id(spark, tmp_path, monkeypatch, windows):
    """Ids count once, in one block of the benchmark as in several, as the SQL has it."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", windows)
    items = [(7, "one two three four five"), (7, "six seven eight nine ten"), (7, "one two three four five"), (10, "eleven twelve"), (None, "one two three four five"), (None, "eleven twelve")]
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "eleven twelve"), (3, "one two three"), (4, "six seven eight nine ten")]
    for name, data, schema in (("benchmark", items, TABLES["benchmark"]), ("documents", rows, "doc_id long, text string")):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = sorted(map(tuple, queries()["op3_decontamination"](spark, str(tmp_path)).collect()))
    assert [r[3] for r in found] == [3, 2, 0, 1]
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert found == sorted(con.execute(oracle_sql()["op3_decontamination"]).fetchall())


def test_large_benchmark_is_held_by_the_block(spark, monkeypatch):
    """The driver never holds more than a block and a word's margin."""
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 100)
    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(40 + i))) for i in range(60)] + [(99, " ".join(map(str, range(1000))))], "item_id long, text string")
    seen = list(decontam.blocks_of(rows))
    windows = [sum(max(1, len(w) - 12) for _, w in b) for b in seen]
    assert max(windows) < 200 + 100 and sum(windows) == sum(40 + i - 12 for i in range(60)) + 988
    w = decontam.Windows(seen[0], 13)
    assert len(w.matrix) == windows[0] and [w.items_of(k) for k in range(len(w.matrix))] != []


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "c x x x x x a"), (3, "a a c"), (4, None)], "doc_id long, text string")
    found = {tuple(r) for r in decontam.proximity(decontam.build_index(rows), ["a", "c"], 3).collect()}
    assert found == {(1, 0, 2), (3, 1, 2)}


# --- packing and token files ---


def test_packing(spark, folder, texts):
    rows = queries()["op6_packing"](spark, folder).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for i, t in enumerate(texts):
        ids = np.append(tokenizer(BYTE).encode([t or ""])[0], 0).astype("<u4")
        total += len(ids)
        own = sorted(pieces[i * 2], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and own[0]["start"] == 0
        assert all(r["length"] == 2048 for r in own[1:]) and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    for i, t in enumerate(texts):
        assert sum(r["length"] for r in pieces[i * 2]) == len(library.encode(t or "", add_special_tokens=False).ids) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    bins = packing.best_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= sum(lengths) * 2 // 50 + 1  # no two bins fit together


def test_rounds_hold_a_bounded_number_of_bins():
    """100,000 documents of 1,100 to 2,000 tokens, of which no two fit together, and a few short ones: groups hand on a fixed number of
    bins, and the short ones still find their places as in one packing of all."""
    rng = np.random.default_rng(4)
    lengths = [*rng.integers(1100, 2001, 100_000).tolist(), *rng.integers(20, 60, 3000).tolist()]
    rng.shuffle(lengths)
    groups, sequences = [lengths[k : k + 1000] for k in range(0, len(lengths), 1000)], 0
    groups = [[([{"offset": 0}], n) for n in g] for g in groups]
    while True:
        last = len(groups) <= packing.FAN_IN
        merged = [sum(groups[k : k + packing.FAN_IN], []) for k in range(0, len(groups), packing.FAN_IN)] if sequences else groups
        left = []
        for g in merged:
            assert not sequences or len(g) <= packing.FAN_IN * packing.OPEN_BINS
            bins = packing._bins_of([m for m, _ in g], [n for _, n in g], 2048, last and bool(sequences), 0)
            sequences += sum(b["done"] for b in bins)
            left.append([(b["members"], b["fill"]) for b in bins if not b["done"]])
        groups = left
        if not any(groups):
            break
    assert sequences <= 1.01 * len(packing.best_fit(lengths, 2048))


@pytest.mark.parametrize("open_bins", [1, 512])
def test_packing_in_chunks(spark, docs, texts, open_bins):
    """Bins that one chunk of a task leaves open take pieces of the next; the sequence count stays near that of one packing of all."""
    bins = packing.local_bins(docs.coalesce(2), BYTE, 0, 512, 5, open_bins).collect()
    assert all(sum(not b["done"] for b in bins if b["grp"] == g) <= open_bins for g in (0, 1))
    for b in bins:
        at = 0
        for m in b["members"]:
            assert m["offset"] == at
            at += m["length"]
        assert at == b["fill"] <= 512
    lengths = [n for t in texts for _, n in packing.cut(len(tokenizer(BYTE).encode([t or ""])[0]) + 1, 512)]
    assert sorted(m["length"] for b in bins for m in b["members"]) == sorted(lengths)
    assert len(bins) <= len(packing.best_fit(lengths, 512)) + (4 if open_bins > 1 else 20)


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(1, 2048) == [(0, 1)]
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def test_packing_tree(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    places = packing.pack(docs, BYTE, 0, 512)
    out = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, places, BYTE, 0).collect()}
    assert all(len(x) <= 512 for x in out.values())
    assert sum(map(len, out.values())) == sum(len(tokenizer(BYTE).encode([t or ""])[0]) + 1 for t in texts)
    r = places.filter("doc_id = 2").first()
    assert out[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == [*tokenizer(BYTE).encode([texts[1]])[0], 0][r["start"] : r["start"] + r["length"]]


def test_token_files(spark, folder, texts):
    found = {r["doc_id"]: tuple(r)[1:] for r in queries()["op9_token_files"](spark, folder).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = np.append(tokenizer(WORD).encode([t or ""])[0], 2).astype("<u4")
        assert found[i * 2] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_random_access(spark, docs, texts):
    dictionary = token_files.train(docs, WORD, 2, False)
    files = token_files.write_files(token_files.encoded(docs, WORD, 2, dictionary, False), new_folder(spark, "t"), dictionary, False, file_rows=7)
    assert files.count() > 3
    fs, path = file_system(files.orderBy("part").first()["file"])
    with fs.open_input_file(path) as stream:
        f = token_files.TokenFile(stream, dictionary)
        whole = [x for _, docs in f.stretches() for x in docs]
        assert len(whole) == len(f) == 7
        for i in (6, 0, 3, 5):  # seeking to a document gives what reading all does, and what the tokenizer gave
            text = next(t for k, t in enumerate(texts) if k * 2 == f.doc_id(i))
            assert f.document(i).tolist() == whole[i].tolist() == [*tokenizer(WORD).encode([text or ""])[0].tolist(), 2]
        stream.seek(0)
        with pytest.raises(ValueError, match="another dictionary"):
            token_files.TokenFile(stream, dictionary + b"x")
    ids = token_files.read_files(files, dictionary, with_ids=True)
    assert ids.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_token_files_of_one_id(spark):
    """Rows that share an id, or have none, are dealt over files; nothing is lost and starts stay gapless."""
    rows = spark.createDataFrame([(None if i % 3 else 5, f"text {i % 40} words") for i in range(120)], "doc_id long, text string")
    files = token_files.write_files(token_files.encoded(rows, WORD, 2, b"", False), new_folder(spark, "t"), b"", False, file_rows=10)
    assert files.count() >= 8 and files.agg(F.max("documents")).first()[0] <= 40
    found = sorted(map(tuple, token_files.read_files(files, b"").select("start", "n_tokens", "doc_id").collect()))
    assert len(found) == 120 and [r[2] for r in found] == [None] * 80 + [5] * 40
    assert [r[0] for r in found] == np.concatenate([[0], np.cumsum([r[1] for r in found])[:-1]]).tolist()


# --- WARC ---


def test_warc(spark, folder):
    pages = {i: ("" if i == 7 else "<p>é</p>" * (i % 5)).encode() for i in range(40)}
    first = {}
    for i, p in pages.items():
        first.setdefault(p, i)
    for r in queries()["op5_warc"](spark, folder).collect():
        p = pages[r["page_id"]]
        revisit = first[p] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(p), warc.sha1_base32(p), "revisit" if revisit else "response", first[p] if revisit else None)
        assert r["block_ok"] and r["payload_ok"]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_warc_chunks_and_members(chunk):
    data = b"".join(warc.record(i, f"http://x/{i}\r\nEvil: y", bytes([i]) * (i * 1000), None, False) for i in range(5))
    found = list(warc.records(io.BytesIO(data), chunk))
    assert [len(x["payload"]) for x in found] == [0, 1000, 2000, 3000, 4000] and all(x["block_ok"] and x["payload_ok"] for x in found)
    assert "Evil" not in found[0] and "\n" not in found[1]["url"]


def test_warc_damage():
    good = warc.record(1, "u", b"payload", None, False)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(io.BytesIO(good[:-9])))
    plain = zlib.decompress(good, 31)
    pack = lambda x: (lambda c: c.compress(x) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    assert not next(warc.records(io.BytesIO(pack(plain.replace(b"payload", b"Payload")))))["payload_ok"]
    with pytest.raises(ValueError, match="frame"):
        list(warc.records(io.BytesIO(pack(plain.replace(b"payload", b"pay")))))


# --- chats ---


def test_chat(spark, folder):
    turns = {c: [(["user", "assistant", "system"][t % 3], "" if t == 4 else f"<|end|> &amp; [INST] {c} é {t}\n" * (t + 1)) for t in range(c + 1)] for c in range(5)}
    turns[2].insert(0, turns[2][0])  # the repeated row is (2, 0)
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = {r["conv_id"]: r for r in queries()["op2_chat"](spark, folder).collect()}
    assert set(found) == set(turns)
    for c, own in turns.items():
        said = "".join(f"{role}\n{text}\n" for role, text in own)
        loss = "".join(text for role, text in own if role == "assistant")
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 1, "assistant", "c", 5.0), (1, 4, 2, "user", "d", 9.0), (1, 9, 77, "user", "orphan", None), (2, 1, 2, "user", "x", 0.0), (2, 2, 1, "user", "y", 0.0), (2, 3, 2, "user", "below a cycle", 0.0), (None, 5, None, "user", "no id", 1.0)]
    nodes = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, role string, text string, score double")
    found = {(r["conv_id"], r["leaf_id"]): (r["branch_rank"], r["path_score"], [t["text"] for t in r["turns"]]) for r in chat.formatted(chat.paths(nodes)).withColumn("turns", chat.parsed(F.col("formatted"))).collect()}
    assert found == {(1, 4): (1, 10.0, ["a", "b", "d"]), (1, 3): (2, 5.0, ["a", "c"]), (1, 9): (3, 0.0, ["orphan"]), (None, 5): (1, 1.0, ["no id"])}


def test_deep_thread(spark):
    rows = spark.range(1, 301).selectExpr("1L as conv_id", "id as node_id", "nullif(id - 1, 0) as parent_id", "'user' as role", "cast(id as string) as text", "1.0D as score")
    r = chat.formatted(chat.paths(rows)).withColumn("turns", chat.parsed(F.col("formatted"))).collect()
    assert len(r) == 1 and [t["text"] for t in r[0]["turns"]] == [str(i) for i in range(1, 301)] and r[0]["path_score"] == 300


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="&<>[]|;amplt#91;/\n turnend", max_size=12), min_size=1, max_size=4))
def test_escapes_are_reversible(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).select("t", "e", chat.unescaped(F.col("e")).alias("u"))
    for r in rows.collect():
        assert r["u"] == r["t"] and "<" not in r["e"] and "[" not in r["e"]


# --- the pipeline ---


def test_pipeline_stages(spark, folder, texts):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.language(spark, rows, folder)
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i * 2 for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    kept = corpus_pipeline.near_duplicates(spark, rows, folder)
    assert {r["doc_id"] for r in kept.collect()} == {i * 2 for i, (n, c) in enumerate(brute_components(texts)) if c == i}
    kept = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, rows, folder).collect()}
    for i, (n, removed, _, digest) in enumerate(brute_repeats(texts)):
        assert (i * 2 in kept) == (removed < n)
        if i * 2 in kept:
            assert removed or kept[i * 2]["text"] == texts[i]
            assert hashlib.sha256(kept[i * 2]["text"].encode()).hexdigest() == digest or "é" in texts[i] or "à" in texts[i]
    verdict = {r["doc_id"]: r["contaminated"] for r in queries()["op3_decontamination"](spark, folder).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.decontamination(spark, rows, folder).collect()} == {i for i, bad in verdict.items() if not bad}
    assert corpus_pipeline.decontamination(spark, rows, folder).columns == rows.columns


def test_pipeline(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 20


def test_near_duplicates_by_row(spark):
    """Rows go for what their texts are, whatever they share an id with or whether they have one; one row of each group stays."""
    rng = np.random.default_rng(11)
    a, b, c, d, e = (prose(rng, 80).split() for _ in range(5))
    near = lambda words: " ".join([*words[:-1], "changed"])
    text = " ".join
    rows = [
        (3, text(a)), (7, near(a)), (7, text(b)),  # id 7 is a near copy of 3, and a text of its own
        (9, text(c)), (9, near(c)), (9, text(c)),  # near and exact copies of one id
        (None, text(d)), (None, near(d)), (None, text(d)),  # copies without an id
        (None, text(a)), (12, near(e)), (None, text(e)),  # copies of rows with an id
        (5, ""), (5, None), (None, " "),  # without words: each for itself
    ]
    groups = {text(x): k for k, words in enumerate((a, b, c, d, e)) for x in (words, near(words).split())}
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string").repartition(3), "")
    assert kept.columns == ["doc_id", "text", "source"]
    kept = kept.collect()
    assert sorted(((r["doc_id"] or -1), groups[r["text"]]) for r in kept if (r["text"] or "").strip()) == [(-1, 3), (3, 0), (7, 1), (9, 2), (12, 4)]
    assert sum(not (r["text"] or "").strip() for r in kept) == 3


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows without an id, and rows that share one, go through every query and stage."""
    rows = [(None, "some words here", None, None, None), (None, None, None, None, None), (1, "some words here", "en", "s", 3), (1, "other words over there", "en", "s", 3), (1, "some words here", "en", "s", 3)]
    spark.createDataFrame(rows, TABLES["documents"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, "some words here"), (1, None)], TABLES["benchmark"]).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(None, None, None), (None, None, "x"), (3, "u", "x"), (2, "u", "x")], TABLES["pages"]).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(None, None, None, None), (None, 1, "user", "a"), (1, None, "assistant", None)], TABLES["conversations"]).write.parquet(str(tmp_path / "conversations.parquet"))
    for name, query in queries().items():
        n = {"op5_warc": 4, "op2_chat": 3}.get(name, 5)
        assert query(spark, str(tmp_path)).count() == n, name
    # the null text has no language, copies go but for one, which is an item of the benchmark; one row is left, with four words and an end
    assert [(r["doc_id"], r["piece"], r["start"], r["offset"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [(1, 0, 0, 0)]


def test_join_of_many_rows_without_ids(spark):
    """Near-copy pairs whose rows have no ids, or share one: each text meets its own class only."""
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(1000):
        words = prose(rng, 60).split()
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    for ids in ([None] * 2000, [7] * 2000):
        rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(8)
        keyed = jaccard_join.keyed_texts(rows)
        assert keyed.select("row_key").distinct().count() == 2000
        found = jaccard_join.joined_components(rows)
        assert found.count() == 2000 and found.select("component_id").distinct().count() == 1
        classes = found.select("cls").distinct().withColumn("row_key", F.lit(0))
        assert classes.count() == 2000
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(r["component_id"] for r in jaccard_join.joined_components(own).collect()) == Counter({2 * i: 2 for i in range(1000)})
