"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of n-grams (n = 1 ... 4, bytes of the lower-cased text, anything but letters as one space) that
both contain, counted once each, over the geometric mean of how many each contains. Nyström landmarks, drawn evenly from the
languages, give features; one kernel ridge regression per language (one against the rest) is fitted on a sample of at most
SAMPLE_DOCS labelled texts. Since the kernel is an inner product of presence vectors, landmarks and weights fold into one matrix, and a
batch of texts is scored by one product of its presence matrix with it.

Defined results: null text, or text without a letter, is `und` with score 0; with no labelled text at all everything is `und`; texts
that occur several times get the same answer each; rows with a null doc id are scored like others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, give_back, lean, let_go, table, unused

GRAMS = (1, 2, 3, 4)
#: n-grams are hashed to so many places.
PLACES_LOG = 15
PLACES = 1 << PLACES_LOG
SAMPLE_DOCS, LANDMARKS = 2400, 320
#: Sampled texts whose places are unpacked at a time.
FIT_ROWS = 64
RIDGE = 0.1
#: Turns the difference of two regression values (about 2 between languages) into odds.
SHARPNESS = 4.0
UND = "und"
_SPACED = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def present(text: str) -> np.ndarray:
    """Which places the n-grams of the whole text occupy."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "ignore").translate(_SPACED).split()) + b" "
    a, out, h = np.frombuffer(data, np.uint8), np.zeros(PLACES, bool), None
    for n in GRAMS:
        if len(a) < n:
            break
        h = a.astype(np.uint32) if n == 1 else h[:-1] * np.uint32(257) + a[n - 1 :]
        out[((h + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - PLACES_LOG)] = True
    return out


class Packed:
    """Presence vectors, eight places a byte; those that are asked for are unpacked (one row each, bool). The driver holds a whole sample."""

    def __init__(self, rows: list[bytes]):
        self.bits = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)

    def __len__(self) -> int:
        return len(self.bits)

    def __getitem__(self, which: slice | list[int]) -> np.ndarray:
        return np.unpackbits(self.bits[which], axis=1, count=PLACES).view(bool)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self[:] if dtype is None else self[:].astype(dtype)


class Classifier:
    """Fitted on presence vectors (one row each, bool) and labels; few of them are asked for at a time."""

    def __init__(self, rows: np.ndarray | Packed, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(labels))
        by_lang = [[i for i, x in enumerate(labels) if x == lang] for lang in self.langs]
        picked = [i for turn in range(max(map(len, by_lang), default=0)) for own in by_lang if turn < len(own) for i in [own[turn]]][:landmarks]
        marks = self._normed(rows[picked])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-6 * max(values.max(initial=0), 1e-12)
        root = vectors[:, keep] / np.sqrt(values[keep])  # kernel to landmarks -> Nyström features
        features = np.concatenate([self._normed(rows[k : k + FIT_ROWS]) @ marks.T for k in range(0, len(rows), FIT_ROWS)]).astype(np.float64) @ root
        features = np.hstack([features, np.ones((len(rows), 1))])
        goals = np.where(np.array(labels)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        weights = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ goals)
        self.folded = (marks.T @ (root @ weights[:-1]).astype(np.float32)).astype(np.float32)
        self.bias = weights[-1]

    @staticmethod
    def _normed(rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x

    def values(self, rows: np.ndarray) -> np.ndarray:
        return (rows.astype(np.float32) @ self.folded) / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1)) + self.bias

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        v = self.values(rows) * (SHARPNESS / 2)
        v -= v.max(1, keepdims=True)
        e = np.exp(v)
        best = v.argmax(1)
        return [self.langs[i] for i in best], e[np.arange(len(e)), best] / e.sum(1)


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Classifier | None:
    """labelled: doc_id, text, lang. Each language gives an equal share of the sample, its rows of smallest hash; rows of one id and text
    count once, so that the sample is bounded however often one repeats."""
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect() if r[0] is not None}
    if not counts:
        return None
    share = max(1, sample_docs // len(counts))
    pick = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 40))
    limit = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int((1 << 40) * min(1.0, 1.2 * share / n)) + 1))])

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [(k, lang, np.packbits(present(t)).tobytes()) for k, lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t and has_letter(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["k", "lang", "bits"])

    sample = labelled.filter(pick < limit[F.col("lang")]).select(pick.alias("k"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropDuplicates(["k", "lang"])
    found = sorted((r[1], r[0], bytes(r[2])) for r in sample.mapInArrow(lean(encode), "k long, lang string, bits binary").collect())
    taken: dict[str, int] = {}
    rows, labels = [], []
    for lang, _, bits in found:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= share:
            rows.append(bits)
            labels.append(lang)
    del found
    if not rows:
        return None
    sample = Packed(rows)
    del rows
    let_go(labelled.sparkSession)  # the sample's way through the JVM and the fit do not fill the driver at once
    give_back()
    try:
        return Classifier(sample, labels)
    finally:
        give_back()


def identified(docs: DataFrame, model: Classifier | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, with the predicted language and its score from the text alone, under these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema

    def score(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in source:
            texts = batch.column(0).to_pylist()
            langs, scores = [UND] * len(texts), np.zeros(len(texts))
            able = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
            for k in range(0, len(able), 128):
                part = able[k : k + 128]
                found, s = model.predict(np.array([present(texts[i]) for i in part]))
                for i, lang in zip(part, found, strict=True):
                    langs[i] = lang
                scores[part] = s
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores)], [*schema.names, *names])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    names_sql = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double"), strict=True))
    return docs.select(F.col("text").cast("string").alias(unused(docs, "scored_text")[0]), *[F.col(c) for c in keep]).mapInArrow(lean(score), f"{out}, {names_sql}")


def in_fold(column: str = "doc_id") -> Column:
    """The held-out quarter."""
    return (crc_of_id(column) % 4) == 2


def trained(docs: DataFrame) -> Classifier | None:
    return fit(docs.filter(~in_fold() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document by a model of the three folds that are not held out; see the module's defined results."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold().alias("held_out"), "text")
    return identified(rows, model, ["doc_id", "held_out"])
