"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.samples import fold, labelled
from lumenfold.llm.scratch import small_batches
from lumenfold.llm.words import chunks, tidy

#: Hashed features, the orders of n-grams, and the count added to each feature.
BUCKETS, ORDERS, SMOOTH = 1 << 15, (1, 2, 3), 0.5
#: Characters of text looked at together.
CHUNK = 1 << 18

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of texts: bucket and text of each, and the letters of each text.

    Text is lower-cased; all that is no letter counts as one kind of border.
    An n-gram belongs to its last character, which is a letter.
    """
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    joined = "".join([f"  {t}" for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[points]
    points = np.where(is_letter, points, 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    ends = np.cumsum(sizes)
    counts = np.diff(np.searchsorted(at, np.append(0, ends)))
    owner = np.repeat(np.arange(len(texts)), counts)
    buckets = []
    code = points[at]
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            code = code * np.uint64(0x100000001B3) + points[at - order + 1]
        if order in ORDERS:
            h = (code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((h >> np.uint64(64 - 15)).astype(np.int32))
    return np.stack(buckets) if buckets else np.zeros((0, 0), np.int32), owner, counts


def _lowered(texts: list[str | None]) -> list[str]:
    """Lower-cased texts whose lengths are those that are encoded."""
    return [(t or "").lower() for t in texts]


class LanguageModel:
    """Log-probabilities of features in each language."""

    def __init__(self, names: list[str], table: np.ndarray, prior: np.ndarray) -> None:
        self.names, self.table, self.prior = names, table, prior

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> LanguageModel:
        names = sorted({str(y) for _, y in rows})
        counts = np.full((BUCKETS, len(names)), SMOOTH)
        prior = np.ones(len(names))
        for i, name in enumerate(names):
            own = [t for t, y in rows if str(y) == name]
            prior[i] += len(own)
            for a in range(0, len(own), 200):
                buckets, _, _ = _features(_lowered(own[a : a + 200]))
                counts[:, i] += np.bincount(buckets.ravel(), minlength=BUCKETS)
        table = np.log(counts / counts.sum(0)).astype(np.float32) if names else np.zeros((BUCKETS, 0), np.float32)
        return cls(names, table, np.log(prior / prior.sum()))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior; und and 0 without a letter or a model."""
        buckets, owner, counts = _features(_lowered(texts))
        n, k = len(texts), len(self.names)
        if not k or not len(owner):
            return ["und"] * n, [0.0] * n
        total = np.zeros((n, k))
        some = np.flatnonzero(counts)
        cuts = np.concatenate([[0], np.cumsum(counts)[:-1]])[some]
        for row in buckets:  # one order at a time
            total[some] += np.add.reduceat(self.table[row], cuts, axis=0, dtype=np.float64)
        total += self.prior
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        known = counts > 0
        return [self.names[b] if ok else "und" for b, ok in zip(best, known, strict=True)], [float(p[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, known, strict=True))]


def train(docs: DataFrame) -> LanguageModel:
    """Learn from a bounded sample of the documents with a lang whose fold is not 0."""
    own = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return LanguageModel.fit(labelled(own, own.select("doc_id", "lang"), "lang"))


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, from its text alone.

    A null text, or one without a letter, gets und and 0. Of equally likely
    languages the first by name is taken. Rows with a null doc_id are predicted and
    not held out; repeated rows are predicted each; an empty table gives an empty
    result, and without any labelled row everything is und.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=CHUNK):
                names, scores = model.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        tidy()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def in_languages(docs: DataFrame, model: LanguageModel, languages: Collection[str], score: float = 0.5) -> DataFrame:
    """The rows of docs that are found to be in one of the languages with at least this score, all columns as they were.

    Each row is judged by its own text, none is matched by its id. Null texts, and those
    without a letter, are in no language; of equally likely ones the first by name counts;
    repeated rows are judged each.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=CHUNK):
                names, scores = model.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([n in languages and s >= score for n, s in zip(names, scores, strict=True)], pa.bool_()))
        tidy()

    return docs.mapInArrow(run, docs.schema)
