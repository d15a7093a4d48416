"""Byte-pair encoding by rank arrays, and decoding.

A short word is held as two contiguous arrays: its parts, one at each boundary, and the ranks of neighbouring parts' merges. The least
rank is looked for by a scan, the boundary there is deleted from both arrays, and the ranks on either side are found anew, until no two
neighbours merge; for words of some ten bytes that is less work than any heap. Words of one length lose a boundary each in every step, so
many are merged at once as the rows of a matrix, and leave it when no neighbours of theirs merge. Words of more than SHORT_WORD bytes,
where scans would cost their square, keep the same parts in a linked list and the ranks in a heap. Both take the leftmost of equal ranks.

The words of a text are those of the byte-level pattern. Texts with characters on whose classes regular expression engines might differ
are divided by the tokenizers library's own pre-tokenizer instead, which merges nothing. A special token's string in a text is its special id, as in that
library, or plain text on request. Words repeat, so the ids of those met of late are remembered, a bounded number of them.

Defined results: null text is an empty one, without ids, and decodes to an empty one; rows that share a doc id, or have none, are encoded
each for itself; ids that the vocabulary does not have decode to nothing, bytes that are no UTF-8 to U+FFFD; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .tokens import _ODD, BYTE_LEVEL_PATTERN, byte_of_char, slices

#: Longer words than so many bytes are merged by a heap; a matrix has so many words at most.
SHORT_WORD, MATRIX_WORDS = 64, 20_000
#: So many words of at most so many characters are remembered, and the last so many before them.
CACHED, CACHED_CHARS = 150_000, 32
_NONE = np.iinfo(np.int32).max


def _plain_class(category: str) -> str:
    """The plain characters of a Unicode category, as what stands in brackets of a pattern."""
    own = [c for c in range(0x20AD) if unicodedata.category(chr(c))[0] == category and not _ODD.match(chr(c))]
    runs = ([c for _, c in run] for _, run in groupby(enumerate(own), lambda x: x[1] - x[0]))
    return "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs)


def plain_pattern() -> re.Pattern[str]:
    """The byte-level pattern for plain characters, on whose classes all engines agree; the standard engine is the fastest."""
    out = BYTE_LEVEL_PATTERN
    for c in "LN":
        out = out.replace(rf"\p{{{c}}}+", f"[{_plain_class(c)}]+")
    return re.compile(out.replace(r"\p{L}", _plain_class("L")).replace(r"\p{N}", _plain_class("N")))


class Recent:
    """Values of keys met of late: at most `size` in the young generation, and the generation before."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def known(self, keys: Iterable) -> dict:
        out = {}
        for k in keys:
            v = self.young.get(k)
            if v is None and (v := self.old.get(k)) is not None:
                self.put(k, v)
            if v is not None:
                out[k] = v
        return out

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class RankBpe:
    """A byte-level BPE as a tokenizers file describes it: no normalizer, no prefix space, special tokens without options."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE"
        if not plain or any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError("only byte-level BPE is supported")
        if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens with options are not supported")
        self.of_char, self.pre_tokenizer = byte_of_char(), Tokenizer.from_file(path).pre_tokenizer
        as_bytes = lambda token: bytes(map(self.of_char.__getitem__, token))
        self.specials = {x["content"]: x["id"] for x in added}
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.specials}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.specials.items()}
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = [tuple(self.ids[as_bytes(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge)) for merge in model["merges"]]
        #: By rank, what a merge makes; the pairs' keys in order, and the rank of each.
        self.made = np.array([self.ids[self.bytes_of[a] + self.bytes_of[b]] for a, b in pairs], np.int64)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys, self.rank_of_key = np.append(keys[by], np.iinfo(np.int64).max), np.append(by, 0).astype(np.int32)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.word, self.recent = plain_pattern(), Recent(CACHED)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of merging neighbours, _NONE where they do not merge."""
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.rank_of_key[at], _NONE)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of short words of one length, as packed int32."""
        out: list[bytes] = [b""] * len(words)
        parts = self.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        rank, row = self.ranks(parts[:, :-1], parts[:, 1:]), np.arange(len(words))
        while len(row):
            n = parts.shape[1]
            at = rank.argmin(1) if n > 1 else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), at] if n > 1 else np.full(len(row), _NONE)
            live = least < _NONE
            if not live.all():
                done = parts[~live].astype("<i4")
                for i, ids in zip(row[~live].tolist(), done, strict=True):
                    out[i] = ids.tobytes()
                parts, rank, row, at, least = parts[live], rank[live], row[live], at[live], least[live]
            if len(row):
                every, m = np.arange(len(row)), len(row)
                parts = parts[np.arange(n) != at[:, None] + 1].reshape(m, n - 1)
                rank = rank[np.arange(n - 1) != at[:, None]].reshape(m, n - 2)
                parts[every, at] = self.made[least]
                for some, i in ((at > 0, at - 1), (at < n - 2, at)):
                    r, c = every[some], i[some]
                    rank[r, c] = self.ranks(parts[r, c], parts[r, c + 1])
        return out

    def merged_long(self, word: bytes) -> bytes:
        """The ids of a word of any length, as packed int32."""
        n = len(word)
        part = self.byte_ids[np.frombuffer(word, np.uint8)]
        heap = [(r, i) for i, r in enumerate(self.ranks(part[:-1], part[1:]).tolist()) if r != _NONE]
        heapq.heapify(heap)
        part, after, before = part.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        keys = {int(k): int(r) for k, r in zip(self.keys[:-1], self.rank_of_key, strict=False)} if heap else {}
        rank = lambda i: keys.get(part[i] << 32 | part[after[i]], _NONE) if part[i] >= 0 and after[i] < n else _NONE
        while heap:
            r, i = heapq.heappop(heap)
            if rank(i) != r:  # a part of the pair is gone or has grown since
                continue
            j = after[i]
            part[i], part[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) != _NONE:
                    heapq.heappush(heap, (r, k))
        return np.array([p for p in part if p >= 0], "<i4").tobytes()

    def words(self, text: str) -> list[str]:
        """The words of a text, special tokens' strings as plain text; as their bytes say."""
        if _ODD.search(text):
            return [bytes(map(self.of_char.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in self.pre_tokenizer.pre_tokenize_str(text)]
        return self.word.findall(text)

    def ids_of(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word, as packed int32."""
        out, by_length = self.recent.known(words), {}
        for w in words - out.keys():
            data = w.encode("utf-8", "surrogateescape")
            if len(data) > SHORT_WORD:
                out[w] = self.merged_long(data)
            else:
                by_length.setdefault(len(data), []).append((w, data))
        for own in by_length.values():
            for k in range(0, len(own), MATRIX_WORDS):
                some = own[k : k + MATRIX_WORDS]
                for (w, _), ids in zip(some, self.merged([d for _, d in some]), strict=True):
                    out[w] = ids
                    if len(w) <= CACHED_CHARS:
                        self.recent.put(w, ids)
        return out

    def encode(self, texts: list[str], specials: bool = True) -> list[np.ndarray]:
        """The ids of whole texts."""
        split = [self.special.split(t) if specials and self.special else [t] for t in texts]
        words = [[self.words(p) if p and not k % 2 else [] for k, p in enumerate(pieces)] for pieces in split]
        get = self.ids_of(set().union(*(ws for own in words for ws in own))).__getitem__
        special = {t: np.array([i], "<i4").tobytes() for t, i in self.specials.items()}
        return [np.frombuffer(b"".join(b"".join(map(get, ws)) if not k % 2 else special[p] for k, (p, ws) in enumerate(zip(pieces, own, strict=True))), "<i4") for pieces, own in zip(split, words, strict=True)]

    def decode(self, ids: Iterable[int]) -> str:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> RankBpe:
    """One per worker process and file."""
    return RankBpe(path)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy arrays."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else [], kind))


def encoded(docs: DataFrame, path: str, specials: bool = True, decode: bool = False) -> DataFrame:
    """doc_id, ids of each document, and on request what its ids decode to (`decoded`), in the same pass."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts, 1_000_000):
                ids = bpe(path).encode(texts[part], specials)
                out = {"doc_id": batch.column(0)[part], "ids": lists(ids, pa.int32())}
                if decode:
                    out["decoded"] = pa.array([bpe(path).decode(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, ids array<int>" + ", decoded string" * decode)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids are none."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = [x or [] for x in batch.column(1).to_pylist()]
            for part in slices(ids, 1_000_000):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[part], "text": pa.array([bpe(path).decode(x) for x in ids[part]], pa.string())})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(lean(run), "doc_id long, text string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; see the module's defined results."""
    import public_tokenizers

    rows = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
