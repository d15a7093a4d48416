"""Token-id files: one zstandard dictionary, trained on a bounded sample of serialized id arrays, shared by all documents, each of which
is its own frame, so that a short document is read by seeking to it.

File format (little-endian): magic `LTOK`, u32 version 2, 32 bytes sha256 of the dictionary, u8 1 if ids are wide; the frames; the index
(zstd: i64 doc ids, u8 null flags, u64 frame sizes, u64 token counts, each as one array); u64 documents, u64 bytes of the index. A frame
holds a document's ids as u16 if the vocabulary allows it, else u32. The index comes last, so that a writer holds no frames.

Files are ranges of (doc id, hash of the frame, place in the table), so rows that share an id, or have none, are dealt over many files.

Defined results: null text is an empty one (only the end id); a null doc id sorts first; rows that share a doc id are ordered by
their frames' hashes; an empty table writes no file. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, lean, new_folder, staged, table, task_tag
from .tokens import slices, tokenizer

MAGIC, VERSION = b"LTOK", 2
HEAD, FOOT = "<4sI32sB", "<QQ"
#: A file is read in stretches of about so many bytes of frames.
READ_BYTES = 4 << 20
#: The dictionary is trained on at most so many documents, those of smallest hash, and on so many bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 4_000, 8_192, 64 << 10
LEVEL = 3


def serialized(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def train(docs: DataFrame, path: str, end_id: int, wide: bool) -> bytes:
    """A dictionary trained on a bounded sample of id arrays; empty if the sample is too small to train on."""
    total = docs.count()
    share = min(1.0, 1.3 * SAMPLE_DOCS / max(total, 1))
    pick = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1_000_000))  # of rows, so that no text comes in with all its copies

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = tokenizer(path).encode([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([serialized(np.append(x, end_id), wide)[:SAMPLE_BYTES] for x in ids], pa.binary()), batch.column(1)], ["sample", "pick"])

    chosen = docs.select("text", pick.alias("pick")).filter(F.col("pick") < int(share * 1_000_000)).select("text", "pick")
    samples = [bytes(r[0]) for r in chosen.mapInArrow(lean(encode), "sample binary, pick long").orderBy("pick", "sample").limit(SAMPLE_DOCS).collect()]
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 256:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too uniform to train on
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)


def encoded(docs: DataFrame, path: str, end_id: int, dictionary: bytes, wide: bool) -> DataFrame:
    """(doc_id, n_tokens, frame) of every document; frames are what moves from here on."""

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = _compressor(dictionary)
        for batch in source:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts):
                ids = [np.append(x, np.uint32(end_id)) for x in tokenizer(path).encode(texts[part])]
                frames = [zstd.compress(serialized(x, wide)) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array([len(x) for x in ids], pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n_tokens", "frame"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(encode), "doc_id long, n_tokens long, frame binary")


def write_files(frames: DataFrame, folder: str, dictionary: bytes, wide: bool, file_rows: int = 20_000, file_bytes: int = 128 << 20) -> DataFrame:
    """Files in ascending doc_id order, one per range of ids: (part, file, documents, tokens)."""
    frames = staged(frames, "token-frames")
    rows, size = frames.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("frame")), F.lit(0))).first()
    digest = hashlib.sha256(dictionary).digest()

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, null, sizes, counts, out = [], [], [], [], None
        for batch in source:
            if out is None:
                fs, base = file_system(folder)
                fs.create_dir(base, recursive=True)
                name = f"{task_tag()}.ltok"
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(struct.pack(HEAD, MAGIC, VERSION, digest, wide))
            ids.append(np.asarray(batch.column(0).fill_null(0)).astype("<i8"))
            null.append(np.array(batch.column(0).is_null(), "u1"))
            counts.append(np.asarray(batch.column(1)).astype("<u8"))
            for frame in batch.column(2):
                out.write(frame.as_buffer())
            sizes.append(np.asarray(pc.binary_length(batch.column(2))).astype("<u8"))
        if out is None:
            return
        arrays = [np.concatenate(x) for x in (ids, null, sizes, counts)]
        index = zstandard.ZstdCompressor().compress(b"".join(x.tobytes() for x in arrays))
        out.write(index + struct.pack(FOOT, len(arrays[0]), len(index)))
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [f"{folder}/{name}"], "documents": pa.array([len(arrays[0])], pa.int64()), "tokens": pa.array([int(arrays[3].sum())], pa.int64())})

    keys = ["doc_id", "hash", "place"]
    keyed = frames.withColumns({"hash": F.xxhash64("frame"), "place": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(max(1, -(-rows // file_rows), -(-size // file_bytes)), *keys).sortWithinPartitions(*keys).drop("hash", "place")
    return staged(ordered.mapInArrow(lean(write), "part int, file string, documents long, tokens long"), "token-files")


class TokenFile:
    """Random access to one file: read_index once, then document(i) seeks to it."""

    def __init__(self, stream, dictionary: bytes):
        self.stream = stream
        magic, version, digest, wide = struct.unpack(HEAD, stream.read(struct.calcsize(HEAD)))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        end = stream.seek(0, 2) - struct.calcsize(FOOT)
        stream.seek(end)
        n, size = struct.unpack(FOOT, stream.read(struct.calcsize(FOOT)))
        stream.seek(end - size)
        raw, at, arrays = zstandard.ZstdDecompressor().decompress(stream.read(size)), 0, []
        for kind in ("<i8", "u1", "<u8", "<u8"):
            arrays.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.doc_ids, self.null_ids, sizes, self.counts = arrays
        self.offsets = struct.calcsize(HEAD) + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.kind = "<u4" if wide else "<u2"
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def doc_id(self, i: int) -> int | None:
        return None if self.null_ids[i] else int(self.doc_ids[i])

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.zstd.decompress(frame), self.kind).astype("<u4")

    def document(self, i: int) -> np.ndarray:
        self.stream.seek(int(self.offsets[i]))
        return self.ids(self.stream.read(int(self.offsets[i + 1] - self.offsets[i])))

    def stretches(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, by stretches of the file: the first one's number, and their ids."""
        first = 0
        while first < len(self):
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + READ_BYTES, "right")) - 1)
            self.stream.seek(int(self.offsets[first]))
            data, own = self.stream.read(int(self.offsets[last] - self.offsets[first])), (self.offsets[first : last + 1] - self.offsets[first]).tolist()
            yield first, [self.ids(data[a:b]) for a, b in zip(own[:-1], own[1:], strict=True)]
            first = last


def read_files(files: DataFrame, dictionary: bytes, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids on request.

    Files are numbered in id order; only their token totals (one row a file) meet to give each its start."""
    from pyspark.sql import Window

    block = F.floor(F.col("part") / 1000)  # sums of a thousand files first, so that no task ever sees more than a thousandth of the files
    blocks = files.groupBy(block.alias("block")).agg(F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = files.withColumn("block", block).withColumn("inside", inside).join(blocks, "block").select("file", (F.col("base") + F.col("inside")).alias("start"))

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = file_system(name)
                with fs.open_input_file(path) as stream:
                    f = TokenFile(stream, dictionary)
                    starts = start + np.concatenate([[0], np.cumsum(f.counts)])[:-1].astype(np.int64)
                    for k, docs in f.stretches():
                        out = {"doc_id": pa.array([f.doc_id(k + i) for i in range(len(docs))], pa.int64()), "start": pa.array(starts[k : k + len(docs)], pa.int64()),
                               "n_tokens": pa.array([len(x) for x in docs], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in docs], pa.int64())}
                        if with_ids:
                            out["ids"] = pa.array([x.tolist() for x in docs], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(out)

    return numbered.repartition(min(max(1, files.count()), 10_000), "file").mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read back; see the module's defined results."""
    import public_tokenizers

    path, end_id = public_tokenizers.path("word_bpe_49k.json"), 2
    docs = table(spark, sf_dir, "documents")
    dictionary = train(docs, path, end_id, wide=False)
    files = write_files(encoded(docs, path, end_id, dictionary, wide=False), new_folder(spark, "token-files"), dictionary, wide=False)
    return read_files(files, dictionary)
