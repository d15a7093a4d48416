"""Language-model scoring with a log-frequency Bloom filter.

Counting: every task hashes its n-grams, sums equal ones and sends them, packed by hash range ("part"), to where the part is reduced.
A part's reducer quantises each count c to level 1 + floor(log_b c) and sets the bits of the events (n-gram, 1) ... (n-gram, level) in
the part's block of the filter. The filter has BITS_PER_EVENT bits an event whatever the corpus, so it grows with it. No task
and no driver holds it whole. Blocks of up to MAX_READ_BYTES together are written to files of the shared folder, and each group of chunks of
texts reads one block after the other for its probes; beyond, the distinct probes of each chunk are shuffled to the blocks by part,
and the levels found back to the chunk: the same probes of the same bits. Scoring probes (n-gram, 1),
(n-gram, 2), ... until one is missing, turns the level back into a count, and interpolates orders: p(w|h) = (c(hw) + a p(w|h')) /
(c(h) + a). Every text is scored under each a of FIT_GRID; the one that counts is that of most leave-one-out likelihood over all training
texts, whose sums come from the same pass. Tokens with equal levels have equal probabilities, so few logarithms are taken.

Inside a part an n-gram is known by KEY_BITS bits of its hash; parts have a bounded size, so this does not get worse with the corpus (7 in
a million of absent n-grams meet another's key in a part of 8 million). Words are known by 64 bits.

The base score needs exact counts. Those of the HEAD_WORDS most frequent words (a fixed number) are broadcast; occurrences of rarer
words are joined with the exact count table, so that no dictionary grows with the corpus.

Defined results: null text is an empty one, which has the end token only; a null doc id is in the fold of empty text; rows that share a
doc id are scored each for itself; with no training text every count is 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, file_system, lean, mixed, new_folder, parts_of, shuffle_parts, staged, table, task_tag, utf8, word_hashes

BASE = 1.5
#: An event sets 3 bits in each of 2 words; with 12 bits of filter an event, some 6 in 1,000 absent events seem present.
BITS_PER_EVENT, WORDS, BITS_PER_WORD = 12, 2, 3
#: A filter of more bytes is not read by each group of texts; its blocks are joined.
MAX_READ_BYTES = 256 << 20
#: What a block may take at most: 32 bits choose a word in it.
MAX_BLOCK_BYTES = 8 << 32
#: Training bytes a part, so that what a reducer holds does not grow with the corpus.
PART_BYTES = 64 << 20
#: Texts are scored in chunks of so many, or of so many bytes.
CHUNK_TEXTS, CHUNK_BYTES = 1000, 2 << 20
#: Chunks of so many tokens together read the filter once; a task holds their tokens and probes.
GROUP_TOKENS = 1_500_000
#: A part's probes are looked up so many at a time.
LOOKUP_PROBES = 500_000
HEAD_WORDS = 1 << 18
FIT_GRID = tuple(2.0**k for k in range(-2, 15))
KEY_BYTES = 5
KEY_BITS = 8 * KEY_BYTES
END, START = 0xE4D_0F_7E47, 0x57A27_0F_7E47
#: A task's n-grams are summed whenever so many tokens have come together.
FLUSH_TOKENS = 1_500_000
_U64 = np.uint64
_ORDER_SALT = _U64(0x9E3779B97F4A7C15)


def level_of(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9)).astype(np.int64)


def _counts_by_level() -> np.ndarray:
    """The middle count of each level, 0 for none."""
    lows = [math.ceil(BASE ** (j - 1) - 1e-9) for j in range(1, 120)]
    return np.array([0.0] + [(lo + max(lo, hi - 1)) / 2 for lo, hi in zip(lows, lows[1:], strict=False)])


COUNT_AT = _counts_by_level()


def word_places(hashes: np.ndarray, level: int, words: np.ndarray | np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The event (n-gram, level) sets bits in WORDS 64-bit words of its block: (word, mask of its bits) for each. Keeping an event's bits
    together costs one memory access for most misses."""
    g = mixed(hashes + _U64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    for i in range(WORDS):
        if i:
            g = mixed(g)
        mask = np.zeros(len(g), np.uint64)
        for k in range(BITS_PER_WORD):
            mask |= _U64(1) << ((g >> _U64(32 + 6 * k)) & _U64(63))
        yield ((g & _U64(0xFFFFFFFF)) * words) >> _U64(32), mask


def build_block(hashes: np.ndarray, counts: np.ndarray, max_bytes: int) -> bytes:
    levels = level_of(counts)
    events = int(levels.sum())
    size = max(1, min(-(-events * BITS_PER_EVENT // 64), max_bytes // 8))
    block = np.zeros(size, np.uint64)
    for j in range(1, int(levels.max(initial=0)) + 1):
        for place, mask in word_places(hashes[levels >= j], j, _U64(size)):
            np.bitwise_or.at(block, place.astype(np.int64), mask)
    return block.astype("<u8").tobytes()


def placed(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part (of a power of two) and key of each hash."""
    return (hashes & _U64(parts - 1)).astype(np.int64), (hashes >> _U64(parts.bit_length() - 1)) & _U64((1 << KEY_BITS) - 1)


def packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


class LogFrequencyFilter:
    """Blocks, one a part; their number is a power of two."""

    def __init__(self, blocks: list):
        self.words = np.array([len(b) // 8 for b in blocks], np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.words)])[:-1].astype(np.uint64)
        self.data = np.frombuffer(b"".join(blocks), "<u8")

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        return self.levels_at(*placed(hashes, len(self.words)))

    def levels_at(self, part: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out, alive, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(alive) and level < len(COUNT_AT):
            words, first, passed = self.words[part[alive]], self.first[part[alive]], None
            for place, mask in word_places(keys[alive], level, words):
                if passed is None:
                    passed = np.flatnonzero(self.data[place + first] & mask == mask)
                else:
                    passed = passed[self.data[place[passed] + first[passed]] & mask[passed] == mask[passed]]
            alive = alive[passed]
            out[alive] = level
            level += 1
        return out


class FilterFiles:
    """Blocks in files of the shared folder. For probes of a task, one after the other is in memory, whatever the filter's size."""

    def __init__(self, blocks: DataFrame, parts: int):
        folder = new_folder(blocks.sparkSession, "lm-filter")

        def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, at = None, 0
            for batch in source:
                if out is None:
                    fs, base = file_system(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"{task_tag()}.blocks"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                sizes = pc.binary_length(batch.column(1)).to_pylist()
                for block in batch.column(1):
                    out.write(block.as_buffer())
                starts = at + np.cumsum([0, *sizes])[:-1]
                at += sum(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(sizes)), pa.array(starts), pa.array(sizes, pa.int64())], ["part", "file", "start", "size"])
            if out is not None:
                out.close()

        self.folder, self.parts = folder, parts
        self.places = {r[0]: tuple(r[1:]) for r in blocks.mapInArrow(lean(write), "part int, file string, start long, size long").collect()}

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        part, keys = placed(hashes, self.parts)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=self.parts))])
        by = np.argsort(part.astype(np.uint16) if self.parts <= 1 << 16 else part, kind="stable")
        del part
        out, stream, opened = np.zeros(len(hashes), np.uint8), None, None
        fs, base = file_system(self.folder)
        try:
            for p in sorted(self.places, key=self.places.get):
                own = by[cuts[p] : cuts[p + 1]]
                if not len(own):
                    continue
                file, start, size = self.places[p]
                if file != opened:
                    if stream is not None:
                        stream.close()
                    stream, opened = fs.open_input_file(f"{base}/{file}"), file
                out[own] = LogFrequencyFilter([stream.read_at(size, start)]).levels_at(np.zeros(len(own), np.int64), keys[own])
        finally:
            if stream is not None:
                stream.close()
        return out


class Answers:
    """The levels that the blocks gave for a chunk's probes; asked for these only."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        by = np.argsort(hashes)
        self.hashes, self.known = hashes[by], levels[by].astype(np.int64)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        return self.known[np.searchsorted(self.hashes, hashes)]


class InTurn:
    """The levels that the blocks gave for a chunk's asked_of(), handed out in that order."""

    def __init__(self, levels: np.ndarray):
        self.left = levels

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        out, self.left = self.left[: len(hashes)], self.left[len(hashes) :]
        return out.astype(np.int64)


def sequence_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens end to end, each text with order-1 START tokens before and END behind; and each text's token count."""
    words, counts = word_hashes(texts)
    out = np.full(len(words) + order * len(texts), START, np.uint64)
    before = np.arange(len(texts)) * order + (order - 1)  # tokens that are no word, up to a text's first
    out[np.arange(len(words)) + np.repeat(before, counts)] = words
    out[np.cumsum(counts) + before] = END
    return out, counts + 1


def grams(seq: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 ... order, at each token that is no START, the hash of the n-gram that ends there; it tells orders apart."""
    at = np.flatnonzero(seq != _U64(START))
    out, h = [], mixed(seq[at])
    for n in range(1, order + 1):
        if n > 1:
            h = mixed(h * _ORDER_SALT + seq[at - (n - 1)] + _U64(n))
        out.append(h)
    return out


def histories(seq: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 2 ... order, at each such token, the hash of the (n-1)-gram before it, as grams() would give it."""
    at = np.flatnonzero(seq != _U64(START)) - 1
    out = []
    for n in range(2, order + 1):
        h = mixed(seq[at])
        for k in range(2, n):
            h = mixed(h * _ORDER_SALT + seq[at - (k - 1)] + _U64(k))
        out.append(h)
    return out


def asked_of(seq: np.ndarray, order: int) -> np.ndarray:
    """The hashes that observed() asks for, in its order."""
    out = [np.unique(mixed(seq), return_inverse=True)[0]]
    for n, gram, history in zip(range(2, order + 1), grams(seq, order)[1:], histories(seq, order), strict=True):
        out += [gram] if n == 2 else [history, gram]
    return np.concatenate(out)


def probes_of(seq: np.ndarray, order: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes that observed() asks for, part by part, and where each part begins."""
    h = np.unique(np.concatenate([mixed(seq), *grams(seq, order)[1:], *histories(seq, order)[1:]]))
    part = placed(h, parts)[0]
    by = np.argsort(part, kind="stable")
    return h[by], np.searchsorted(part[by], np.arange(parts + 1))


def counted(train: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, kind, hashes, counts) of the training texts, packed; kind 1 are words, by their whole hash, kind 2 other n-grams, by key."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, leads = [[] for _ in range(order + 1)], 0, start_grams(order)

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for n in range(1, order + 1):
                h = np.concatenate(held[n])
                held[n].clear()
                h, c = np.unique(h, return_counts=True)
                part, keys = placed(h, parts)
                by = np.argsort(part, kind="stable")
                h, keys, c, cuts = h[by], keys[by], c[by].astype("<u4"), np.searchsorted(part[by], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    own = slice(cuts[p], cuts[p + 1])
                    rows.append((int(p), min(n, 2), h[own].tobytes() if n == 1 else packed(keys[own]), c[own].tobytes()))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "kind", "hashes", "counts"])
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "kind", "hashes", "counts"])

        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        for batch in source:
            for own in parts_of(pc.binary_length(batch.column(0)).to_pylist(), CHUNK_TEXTS, CHUNK_BYTES):
                texts = batch.column(0)[own].to_pylist()
                seq, _ = sequence_of(texts, order)
                for n, h in enumerate(grams(seq, order), 1):
                    held[n].append(h)
                for h in leads:
                    held[2].append(np.full(len(texts), h, np.uint64))
                size += len(seq)
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return train.select(utf8("text").alias("text")).mapInArrow(lean(count), "part int, kind int, hashes binary, counts binary")


def start_grams(order: int) -> list[np.uint64]:
    """The histories of a text's first word, which are as often seen as there are texts: runs of 1 ... order-1 STARTs."""
    out, start = [], np.array([START], np.uint64)
    for n in range(1, order):
        out.append(mixed(start if n == 1 else out[-1] * _ORDER_SALT + start + _U64(n)))
    return [h[0] for h in out]


WORD_ROWS = "part int, block binary, word long, n long"


def _reducer(parts: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.binary()), ("word", pa.int64()), ("n", pa.int64())])

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, np.int64), *counts])
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        return keys[first], np.add.reduceat(counts[by], first) if len(first) else counts

    def reduce(t: pa.Table) -> pa.Table:
        part, kinds = t.column("part")[0].as_py(), t.column("kind").to_pylist()
        hs, cs = t.column("hashes").to_pylist(), [np.frombuffer(x, "<u4").astype(np.int64) for x in t.column("counts").to_pylist()]
        words, word_counts = summed([np.frombuffer(h, np.uint64) for h, k in zip(hs, kinds, strict=True) if k == 1], [c for c, k in zip(cs, kinds, strict=True) if k == 1])
        keys, counts = summed([unpacked(h) for h, k in zip(hs, kinds, strict=True) if k == 2], [c for c, k in zip(cs, kinds, strict=True) if k == 2])
        block = build_block(np.concatenate([placed(words, parts)[1], keys]), np.concatenate([word_counts, counts]), MAX_BLOCK_BYTES)
        n = len(words)
        return pa.table([pa.array([part] * (n + 1), pa.int32()), pa.array([block] + [None] * n, pa.binary()), pa.array(np.concatenate([[0], words.view(np.int64)]), pa.int64()), pa.array(np.concatenate([[0], word_counts]), pa.int64())], schema=schema)

    return reduce


class Model:
    """What scoring needs: the filter (files of it, or its blocks) and the broadcast head counts, the exact word table, the totals; and, once
    scored() or fit() has seen the training texts, the weight."""

    def __init__(self, train: DataFrame, order: int = 2, max_read_bytes: int = MAX_READ_BYTES, head_words: int = HEAD_WORDS):
        spark = train.sparkSession
        size = train.agg(F.coalesce(F.sum(F.octet_length(utf8("text"))), F.lit(0))).first()[0]
        self.train, self.order, self.weight = train, order, None
        self.parts = 1 << (max(64, 2 * shuffle_parts(spark), -(-size // PART_BYTES)) - 1).bit_length()
        reduced = staged(counted(train, order, self.parts).groupBy("part").applyInArrow(_reducer(self.parts), WORD_ROWS), "lm-counts", row_group=16 << 20)
        self.blocks = reduced.filter("block is not null").select("part", "block")
        self.filter_bytes = self.blocks.agg(F.coalesce(F.sum(F.octet_length("block")), F.lit(0))).first()[0]
        self.joined = self.filter_bytes > max_read_bytes
        self.files = None if self.joined else FilterFiles(self.blocks, self.parts)
        self.words = reduced.filter("block is null").select("word", "n")
        total = self.words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.tokens, self.vocabulary = int(total[0]), int(total[1])
        self.norm = self.tokens + 0.1 * (self.vocabulary + 1)
        level = F.floor(F.log(F.col("n")) / F.log(F.lit(2.0)) * 4)
        by_level = sorted(((int(r[0]), r[1]) for r in self.words.groupBy(level).count().collect()), reverse=True)
        held, lowest = 0, 1 << 30
        for k, n in by_level:
            if held + n > head_words:
                break
            held, lowest = held + n, k
        head = self.words.filter(level >= lowest).toArrow()
        self.tail = self.words.filter(level < lowest)
        words = np.asarray(head.column(0)).astype(np.int64).view(np.uint64)
        by = np.argsort(words)
        self.head, self.head_counts = words[by], np.asarray(head.column(1)).astype(np.int64)[by]
        self.shared = spark.sparkContext.broadcast((self.head, self.head_counts))

    def _answered(self, rows: DataFrame, judge: Callable[..., Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
        """judge(first row number, doc_ids, held_out, sequence, lengths, filter) over chunks of rows (doc_id, held_out, text)."""
        files, order, parts, chunk_texts, group_tokens = self.files, self.order, self.parts, CHUNK_TEXTS, GROUP_TOKENS

        def chunks_of(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            row = TaskContext.get().partitionId() << 33
            for batch in source:
                for own in parts_of(pc.binary_length(batch.column(2)).to_pylist(), chunk_texts, CHUNK_BYTES):
                    part = batch.slice(own.start, own.stop - own.start)
                    yield row, part.column(0), part.column(1), *sequence_of(part.column(2).to_pylist(), order)
                    row += part.num_rows

        if not self.joined:

            def judged(chunks: list[tuple]) -> Iterator[pa.RecordBatch]:
                asked = [asked_of(chunk[3], order) for chunk in chunks]
                sizes = [len(x) for x in asked]
                asked = np.concatenate(asked)
                levels = np.split(files.levels(asked), np.cumsum(sizes)[:-1])
                del asked
                for chunk, own in zip(chunks, levels, strict=True):
                    yield from judge(*chunk, InTurn(own))

            def direct(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held, size = [], 0
                for chunk in chunks_of(source):
                    held.append(chunk)
                    size += len(chunk[3])
                    if size >= group_tokens:
                        yield from judged(held)
                        held, size = [], 0
                if held:
                    yield from judged(held)

            return rows.mapInArrow(lean(direct), ddl)

        def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, doc_ids, held_out, seq, lengths in chunks_of(source):
                words, index = np.unique(seq, return_inverse=True)
                binaries = [words.tobytes(), zstandard.compress(index.astype("<u4").tobytes(), 1), lengths.astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())), pa.array([held_out.to_pylist()], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in binaries)], ["chunk", "doc_ids", "held_out", "words", "index", "lengths"])

        def sequence(words: bytes, index: bytes) -> np.ndarray:
            return np.frombuffer(words, np.uint64)[np.frombuffer(zstandard.decompress(index), "<u4")]

        def probe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                for chunk, words, index in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    h, cuts = probes_of(sequence(words, index), order, parts)
                    some = np.flatnonzero(np.diff(cuts)).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([packed(placed(h[cuts[p] : cuts[p + 1]], parts)[1]) for p in some], pa.binary())], ["part", "chunk", "keys"])

        def look_up(probes: pa.Table, blocks: pa.Table) -> pa.Table:
            block = LogFrequencyFilter([blocks.column("block")[0].as_py() if blocks.num_rows else b"\0" * 8])
            asked, out, at = probes.column("keys").to_pylist(), [], 0
            while at < len(asked):
                n = np.cumsum([len(x) // KEY_BYTES for x in asked[at : at + LOOKUP_PROBES]])
                take = max(1, int(np.searchsorted(n, LOOKUP_PROBES, "right")))
                keys = unpacked(b"".join(asked[at : at + take]))
                levels = block.levels_at(np.zeros(len(keys), np.int64), keys).astype(np.uint8)
                out += [x.tobytes() for x in np.split(levels, n[: take - 1])]
                at += take
            return pa.table({"part": probes.column("part").cast(pa.int32()), "chunk": probes.column("chunk"), "levels": pa.array(out, pa.binary())})

        def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
            row, doc_ids, held_out, words, index, lengths = (chunk.column(c)[0] for c in ("chunk", "doc_ids", "held_out", "words", "index", "lengths"))
            seq = sequence(words.as_py(), index.as_py())
            h, cuts = probes_of(seq, order, parts)
            levels = np.zeros(len(h), np.uint8)
            for p, found in zip(answers.column("part").to_pylist(), answers.column("levels").to_pylist(), strict=True):
                levels[cuts[p] : cuts[p + 1]] = np.frombuffer(found, np.uint8)
            return pa.Table.from_batches(judge(row.as_py(), doc_ids.values, held_out.values, seq, np.frombuffer(lengths.as_py(), "<i8"), Answers(h, levels)))

        chunks = staged(rows.mapInArrow(lean(pack), "chunk long, doc_ids array<long>, held_out array<boolean>, words binary, index binary, lengths binary"), "lm-chunks", row_group=16 << 20)
        probes = chunks.select("chunk", "words", "index").mapInArrow(lean(probe), "part int, chunk long, keys binary")
        answers = probes.groupBy("part").cogroup(self.blocks.groupBy("part")).applyInArrow(look_up, "part int, chunk long, levels binary")
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, ddl)

    def _judged(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, held_out, text). Three kinds of rows, written: a document with its sums over tokens; a rare word of a document; a
        chunk's leave-one-out log likelihoods over its rows that are not held out, by weight."""
        shared, order, norm = self.shared, self.order, self.norm
        fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("scores", pa.list_(pa.float64())), ("word", pa.int64()), ("n", pa.int64()), ("fit", pa.list_(pa.float64()))]
        schema = pa.schema(fields)

        def judge(row: int, doc_ids: pa.Array, held_out: pa.Array, seq: np.ndarray, lengths: np.ndarray, answers) -> Iterator[pa.RecordBatch]:
            head, head_counts = shared.value
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            counts, kind = observed(seq, answers, order)
            scores = np.stack([np.add.reduceat(log_probabilities(counts, norm, a)[kind], starts) for a in FIT_GRID], axis=1)
            learnt = np.repeat(~np.asarray(held_out.to_numpy(zero_copy_only=False), bool), lengths)
            fit = None
            if learnt.any():
                times = np.bincount(kind, learnt, len(counts[0][0]))
                fit = [float(log_probabilities(counts, norm, a, left_out=1.0) @ times) for a in FIT_GRID]
            words, inverse = np.unique(grams(seq, 1)[0], return_inverse=True)
            at = np.minimum(np.searchsorted(head, words), max(0, len(head) - 1))
            in_head = head[at] == words if len(head) else np.zeros(len(words), bool)
            exact = np.where(in_head, head_counts[at] if len(head) else 0, 0)
            token_head = in_head[inverse]
            base = np.where(token_head, np.log10(exact + 0.1)[inverse], 0.0)
            n = len(lengths)
            rows = row + np.arange(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), doc_ids, held_out, pa.array(lengths), pa.array(np.add.reduceat(token_head.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)),
                 pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(FIT_GRID), scores.ravel()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([fit] + [None] * (n - 1), fields[9][1])], schema=schema)
            rare = np.flatnonzero(~token_head)
            if len(rare):
                doc = np.repeat(np.arange(n), lengths)[rare]
                pair, times = np.unique(doc.astype(np.uint64) * _U64(len(words)) + inverse[rare].astype(np.uint64), return_counts=True)
                m = len(pair)
                none = [pa.nulls(m, f[1]) for f in fields[1:7]]
                yield pa.RecordBatch.from_arrays([pa.array(rows[(pair // _U64(len(words))).astype(np.int64)]), *none, pa.array(words[(pair % _U64(len(words))).astype(np.int64)].view(np.int64)), pa.array(times.astype(np.int64)), pa.nulls(m, fields[9][1])], schema=schema)

        ddl = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, scores array<double>, word long, n long, fit array<double>"
        return staged(self._answered(rows, judge, ddl), "lm-scores")

    def _fitted(self, found: DataFrame) -> float | None:
        """The weight of most likelihood, the greatest of equal ones; None if nothing has been learnt from."""
        sums = found.filter("fit is not null").agg(*[F.sum(F.col("fit")[i]) for i in range(len(FIT_GRID))]).first()
        return None if sums[0] is None else max(zip(sums, FIT_GRID, strict=True))[1]

    def scored(self, docs: DataFrame, held_out: Column) -> DataFrame:
        """For each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The rows that are not held out are
        the training texts; if docs has none, the weight is fitted on the training texts by themselves."""
        pick = lambda rows, out: rows.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), utf8("text").alias("text"))
        found = self._judged(pick(docs, held_out))
        if self.weight is None:
            self.weight = self._fitted(found)
        if self.weight is None:
            self.weight = self._fitted(self._judged(pick(self.train, F.lit(False)))) or 1.0
        found = found.withColumn("score", F.element_at("scores", FIT_GRID.index(self.weight) + 1))
        rare = found.filter("word is not null").select("row", "word", F.col("n").alias("times"))
        rare = rare.join(self.tail, "word", "left").select(
            "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_tokens"),
            F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("logs"), F.lit(None).cast("double").alias("score"),
        )
        whole = found.filter("word is null").select("row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score").unionByName(rare)
        whole = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("logs").alias("logs"), F.max("score").alias("score"))
        norm_log = F.log10(F.lit(float(self.norm)))
        return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * norm_log).alias("base_score"), "score")


def observed(seq: np.ndarray, model: LogFrequencyFilter | Answers | InTurn, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For n = 1 ... order the counts of an n-gram and of its history, by membership probes, of each kind of token; and the kind of each
    token that is no START. Tokens are of a kind if all these levels are equal."""
    words, inverse = np.unique(mixed(seq), return_inverse=True)
    every = model.levels(words)[inverse]
    at = np.flatnonzero(seq != _U64(START))
    c = every[at]
    levels = [c]
    for n, gram, history in zip(range(2, order + 1), grams(seq, order)[1:], histories(seq, order), strict=True):
        before = every[at - 1] if n == 2 else model.levels(history)
        # an n-gram is no more frequent than its parts: a false positive without them counts nothing
        c = np.minimum(np.minimum(model.levels(gram), before), c)  # asked_of() has the order of what is asked
        levels += [c, before]
    code = np.zeros(len(at), np.int64)
    for x in levels:  # below 128
        code = code << 7 | x
    code, kind = np.unique(code, return_inverse=True)
    counts = [COUNT_AT[code >> 7 * k & 127] for k in reversed(range(len(levels)))]
    return [(counts[0], counts[0]), *zip(counts[1::2], counts[2::2], strict=True)], kind


def log_probabilities(counts: list[tuple[np.ndarray, np.ndarray]], norm: float, weight: float, left_out: float = 0.0) -> np.ndarray:
    """log10 p of each token. left_out: take one occurrence away from every count, for texts that were counted."""
    p = (np.maximum(counts[0][0] - left_out, 0) + 0.1) / norm
    for c, before in counts[1:]:
        p = (np.maximum(c - left_out, 0) + weight * p) / (np.maximum(before - left_out, 0) + weight)
    return np.log10(np.minimum(p, 1.0))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of each document, learnt from nine folds of ten; see the module's defined results."""
    docs = table(spark, sf_dir, "documents")
    held_out = (crc_of_id() % 10) == 0
    return Model(docs.filter(~held_out)).scored(docs, held_out)
