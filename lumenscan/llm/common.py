"""Shared plumbing of the llm operators: work folders, staged tables, portable files, word hashing."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder of this machine serves a local
    session; on a cluster, whose machines do not share folders, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "lumenscan-work")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: The paths made so far by the work that collects them, in this thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used."""
    path = f"{work_root(spark)}/lumenscan/{name}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


def swept(spark: SparkSession, work: Callable[[], DataFrame], name: str) -> DataFrame:
    """What work() returns, as a staged table; all other folders made on the way to it are deleted."""
    outer, token = _made.get(), _made.set([])
    try:
        out = staged(work(), name)
        for path in _made.get():
            if path != out._lumenscan_path:
                delete(spark, path)
    finally:
        _made.reset(token)
        give_back()
    if outer is not None:
        outer.append(out._lumenscan_path)
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def staged(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(path)
    let_go(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenscan_path = path
    return out


#: Share of the driver's heap in use beyond which the next staged table has it collected, and by how much that must exceed what the last
#: collection left.
HEAP_SHARE, HEAP_GROWTH = 0.3, 1.2
_heap_left = 0


def let_go(spark: SparkSession) -> None:
    """Once the driver's heap has filled to some extent, collect its garbage. Spark keeps broadcasts, shuffles and records of finished steps
    until that happens; in a query of many small steps the heap would grow to its limit first."""
    global _heap_left
    heap = spark._jvm.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > max(HEAP_SHARE * heap.maxMemory(), HEAP_GROWTH * _heap_left):
        gc.collect()  # what Python has forgotten, the JVM may forget
        spark._jvm.System.gc()
        _heap_left = heap.totalMemory() - heap.freeMemory()


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_lumenscan_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def file_system(uri: str):
    """(file system, path) for a URI: local, HDFS or an object store, whatever pyarrow can open."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def give_back() -> None:
    """Return freed memory to the system. Python workers live on between tasks, the driver between queries, and without this each would keep
    the peak of its past."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(batches_of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, giving its memory back when a task is over."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches_of(source)
        finally:
            give_back()

    return run


def task_tag() -> str:
    """Names a task attempt, so that a repeated or speculative task never overwrites another one's file."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def utf8(column: str | Column) -> Column:
    """A text column as its UTF-8 bytes, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_U64 = np.uint64
ODD, UNODD = _U64(0x9E3779B97F4A7C15), _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random value for each byte.
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
#: For words_of-like tables: A-Z as a-z, the ASCII white space as a space, all else as it is.
SPACED = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Texts are hashed so many bytes at a time; longer words than LONG_WORD one by one.
STRETCH, LONG_WORD = 1 << 18, 1 << 16


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ODD, and of its inverse, modulo 2^64."""
    out = []
    for base in (ODD, UNODD):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _stretches(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches that end before a space; a word longer than a stretch is one."""
    at = 0
    while at < len(data):
        end = data.find(b" ", min(at + STRETCH, len(data)))
        end = len(data) if end < 0 else end
        if end - at > 2 * STRETCH:
            word = max(data.rfind(b" ", at, at + STRETCH) + 1, at)
            if word > at:
                yield at, word
            at = word
        yield at, end
        at = end


def word_hashes(texts: list[bytes], table: bytes = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and how many each text has. The table turns bytes into those of words, or into a
    space. A word's hash is a polynomial over its bytes' random values, modulo 2^64, mixed with its length and scrambled."""
    data = b" ".join(texts).translate(table)
    hashes, firsts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in _stretches(data):
        chars = np.frombuffer(data, np.uint8, b - a, a)
        edges = np.flatnonzero(np.diff(chars != 32, prepend=False, append=False))
        first, size = edges[::2], edges[1::2] - edges[::2]
        if len(size) == 1 and size[0] > LONG_WORD:
            h = np.zeros(1, np.uint64)
        else:
            up, down = powers(2 * STRETCH + 1)
            total = np.zeros(len(chars) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[chars] * up[: len(chars)], out=total[1:])
            h = mixed((total[edges[1::2]] - total[first]) * down[first] + size.astype(np.uint64) * UNODD)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[a + first[i] : a + first[i] + size[i]])
        hashes.append(h)
        firsts.append(first + a)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    upto = np.searchsorted(np.concatenate(firsts), ends)
    return np.concatenate(hashes), np.diff(upto, prepend=0)


def words_by_text(texts: list[bytes], table: bytes = SPACED) -> list[np.ndarray]:
    """The word hashes of each text."""
    hashes, counts = word_hashes(texts, table)
    return np.split(hashes, np.cumsum(counts)[:-1]) if texts else []


def parts_of(sizes: Iterable[int], most_rows: int, most_bytes: int = 4 << 20) -> Iterator[slice]:
    """Runs of neighbours of at most most_rows, and of about most_bytes together."""
    first, held, n = 0, 0, 0
    for n, size in enumerate(sizes, 1):
        held += size
        if n - first >= most_rows or held >= most_bytes:
            yield slice(first, n)
            first, held = n, 0
    if first < n:
        yield slice(first, n)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; order matters."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
