"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of aligned pairs.

Text is encoded with a space before it by a byte-level BPE (A) and by a piece model (B, which adds the space itself). A two-pointer merge
of the cumulative ends of A's and B's tokens emits a group wherever both end. Between two neighbours in the merged order lie bytes of one
token of A and one of B, and each two tokens that share bytes share exactly one such stretch, so every step of the merge is a link. Ends of
many texts are merged at once: both lists ascend, and the stable sort of two ascending runs is that merge.

A pair of ids counts once a document that holds it linked. Tasks put documents of about BLOCK_CHARS together as a block and emit a block's
distinct pairs, each with its number of documents there; Spark sums them by pair, takes each A id's maximum, and joins both back to the
blocks' pairs. A pair that every document holds is thus one row a block, and what meets a block again is as large as its own texts.

Defined results: texts that are null or empty, or whose joined token bytes are not the space and the text (U+2581, which B takes for a
space), have no tokens: zeros and no groups; rows that share a doc id, or have none, are documents each; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .common import give_back, staged, table
from .tokens import slices

#: Documents of about so many characters form a block.
BLOCK_CHARS = 4_000_000


class Pieces:
    """A piece model that adds a space before the text, keeps all white space and falls back to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = enumerate(self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in names]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


class Aligned:
    """Many texts together: of each the numbers of tokens, groups and links, the groups as text and the links' pairs."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray, names: list[str]):
        self.n_a, self.n_b = ([len(x) for x in ids] for ids in (a, b))
        one, two = (np.concatenate([*ids, np.empty(0, np.int64)]).astype(np.int64) for ids in (a, b))
        a_ends, b_ends = np.cumsum(a_sizes[one]), np.cumsum(b_sizes[two])
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # a merge of two runs
        both = ends[1:] == ends[:-1]
        shared = ends[1:][both]
        ends = ends[np.append(~both, True)[: len(ends)]]
        i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        self.pairs = one[i] << 32 | two[j]
        # texts end where tokens of both end
        upto = a_ends[np.cumsum(self.n_a) - 1] if len(a_ends) else np.zeros(len(a), np.int64)
        upto[np.cumsum(self.n_a) == 0] = 0
        self.links, self.groups = np.searchsorted(ends, upto, "right"), np.searchsorted(shared, upto, "right")
        # ids in the order of groups, A's before B's, each with what follows it: `,` in a group's half, `|` between the halves, `;` behind
        a_of, b_of = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)  # the group of each token
        a_last, b_last = np.append(a_of[1:] != a_of[:-1], True)[: len(one)], np.append(b_of[1:] != b_of[:-1], True)[: len(two)]
        a_until, b_until = np.searchsorted(a_of, np.arange(len(shared)), "right"), np.searchsorted(b_of, np.arange(len(shared)), "right")
        said = np.empty(len(one) + len(two), np.int64)
        size = len(names) // 3
        said[np.arange(len(one)) + np.concatenate([[0], b_until])[a_of]] = one + size * a_last
        said[np.arange(len(two)) + a_until[b_of]] = two + 2 * size * b_last
        self.said, self.names = said, names

    def __iter__(self) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """Of each text: numbers of A's and B's tokens and of groups, the groups as text, the pairs of all links (A's id in the high half)."""
        at = links = groups = 0
        for n_a, n_b, more_links, more_groups in zip(self.n_a, self.n_b, self.links.tolist(), self.groups.tolist(), strict=True):
            text = "".join(map(self.names.__getitem__, self.said[at : at + n_a + n_b].tolist()))[:-1]
            yield n_a, n_b, more_groups - groups, text, self.pairs[links:more_links]
            at, links, groups = at + n_a + n_b, more_links, more_groups


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.one, self.two = bpe(a_path), Pieces(b_path)
        self.a_sizes = np.array([len(self.one.bytes_of.get(i, b"")) for i in range(max(self.one.bytes_of) + 1)], np.int64)
        self.b_sizes = np.array([*map(len, self.two.bytes_of)], np.int64)
        ids = range(max(len(self.a_sizes), len(self.b_sizes)))
        self.names = [f"{i}{mark}" for mark in ",|;" for i in ids]

    def align(self, texts: list[str]) -> Aligned:
        texts = [" " + t if t else "" for t in texts]
        a, b = [x.astype(np.int64) for x in self.one.encode(texts, specials=False)], self.two.encode([t[1:] for t in texts])
        spoken = [b"".join(map(self.two.bytes_of.__getitem__, x.tolist())) for x in b]  # A's bytes are the text's by construction
        for k, t in enumerate(texts):
            if spoken[k] != t.encode():
                a[k] = b[k] = np.empty(0, np.int64)
        return Aligned(a, b, self.a_sizes, self.b_sizes, self.names)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    return Aligner(a_path, b_path)


DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each document a row of its block with its counts, its groups (`a1,a2|b1;a3|b2,b3`, ids in order), its distinct linked pairs (A's
    id in the high half) and how often it holds each. For each block a row without groups, of its distinct pairs and how many of its
    documents hold each."""
    names = [x.split()[0] for x in DDL.split(", ")]

    def summary(block: int, held: list[np.ndarray]) -> pd.DataFrame:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        none = [None] * 6
        return pd.DataFrame([(block, *none, pairs, n.astype(np.int32))], columns=names, dtype=object)

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        try:
            for frame in source:
                ids, texts = frame["doc_id"], [t or "" for t in frame["text"]]
                for part in slices(texts, 1_000_000):
                    rows = []
                    for doc_id, (n_a, n_b, n_groups, groups, links) in zip(ids[part], aligner(a_path, b_path).align(texts[part]), strict=True):
                        pairs, times = np.unique(links, return_counts=True)
                        held.append(pairs)
                        rows.append((block, doc_id, n_a, n_b, n_groups, len(links), groups, pairs, times.astype(np.int32)))
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    size += sum(map(len, texts[part]))
                    if size >= BLOCK_CHARS:
                        yield summary(block, held)
                        block, held, size = block + 1, [], 0
            if held:
                yield summary(block, held)
        finally:
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, DDL)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents of the corpus that hold it), top (whether n is the highest of its A id), from the blocks' rows of aligned()."""
    each = rows.filter("groups is null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("n"))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))  # a row an id of A's vocabulary at most
    return counts.withColumn("a", F.shiftright("pair", 32)).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))


def counted(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The documents' rows of aligned(), as a table, with n_best (links whose count is their A id's highest) and count_sum (over links);
    of their other columns those in `kept`."""
    counts = staged(pair_counts(rows), "pair-counts")
    blocks = rows.filter("groups is null").select("block", F.explode("pairs").alias("pair"))
    met = blocks.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "top")).alias("met"))
    met = met.select(F.col("block").alias("met_block"), *[F.col(f"met.{c}").alias(c) for c in ("pair", "n", "top")])
    docs = rows.filter("groups is not null").select("block", "pairs", "times", *kept)
    schema = docs.drop("block", "pairs", "times").schema.add("n_best", "long").add("count_sum", "long")

    def scored(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        flat = [np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in theirs.column(c)] or [np.empty(0, np.int64)]) for c in ("pair", "n", "top")]
        by = np.argsort(flat[0])
        pair, n, top = (x[by] for x in flat)
        lists = [mine.column(c).combine_chunks() for c in ("pairs", "times")]
        own, times = (np.asarray(x.flatten()) for x in lists)
        at = np.searchsorted(pair, own)
        times = times.astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.asarray(lists[0].value_lengths().fill_null(0)))])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (times * top[at], times * n[at])]
        out = mine.drop_columns(["block", "pairs", "times"])
        return out.append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))

    return docs.groupBy("block").cogroup(met.groupBy("met_block")).applyInArrow(scored, schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers align in each document; see the module's defined results."""
    import public_tokenizers

    rows = aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").when(F.col("groups").isNotNull(), F.sha2("groups", 256))
    rows = staged(rows.withColumn("groups", digest), "alignments")
    out = counted(rows, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
    return out.withColumnRenamed("groups", "groups_sha256")
