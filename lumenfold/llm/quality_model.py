"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector x: each word's bucket with weight 1 / n per
occurrence, structure statistics cut into bins, and the bin of its length. The
score is the logistic function of
    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i) ** 2 - sum_i (v_if x_i) ** 2),
all pairwise interactions in time linear in the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.samples import fold, labelled
from lumenfold.llm.scratch import small_batches
from lumenfold.llm.words import Texts, chunks, tidy

#: Buckets of words, rank of the interactions, bins of each statistic, least passes over the sample and least steps.
BUCKETS, RANK, BINS, EPOCHS, STEPS = 1 << 14, 4, 16, 8, 2000
RATE, PENALTY = 0.1, 2e-4
#: A document is predicted good from this score on.
GOOD = 0.3

_STATS = 10
SIZE = BUCKETS + _STATS * BINS

_UPPER, _DIGIT, _SIGN, _LINE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
# Signs that rarely stand in prose.
_SIGN[[ord(c) for c in "#*$%&|<>{}[]=_~^\\/@"]] = True
_LINE[10] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each word, the words of each text, and the bin of each statistic of each text."""
    words = texts.hashes()
    n = np.diff(texts.at)
    size = np.maximum(np.diff(texts.offsets), 1)
    some = np.maximum(n, 1)
    by = lambda flags: _per_text(flags[texts.bytes], texts.offsets)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[texts.at[:-1][n > 0]] = False
    shout = np.zeros(256, bool)
    shout[33] = True
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(texts.at, texts.at[1:], strict=False)], np.int64)
    pairs = words[1:] * np.uint64(3) + words[:-1]
    new_pairs = np.array([len(np.unique(pairs[a : b - 1])) if b - a > 1 else 1 for a, b in zip(texts.at, texts.at[1:], strict=False)], np.int64)
    share = lambda x, of: np.minimum(np.sqrt(x / of) * BINS, BINS - 1)  # noqa: E731  finer near 0
    stats = np.stack(
        [
            share(by(_UPPER), size),
            share(by(_DIGIT), size),
            share(by(_SIGN), size),
            share(by(_LINE), some),
            share(_per_text(again, texts.at), some),
            share(by(shout), some),
            np.minimum(distinct / some * BINS, BINS - 1),
            np.minimum(new_pairs / np.maximum(n - 1, 1) * BINS, BINS - 1),
            np.minimum(size / some, BINS - 1),
            np.minimum(np.log2(size), BINS - 1),  # the length that documents carry as metadata
        ]
    ).astype(np.int64)
    bins = BUCKETS + stats.T + np.arange(_STATS) * BINS
    return (words & np.uint64(BUCKETS - 1)).astype(np.int64), n, bins


class FactorisationMachine:
    """Weights: w0, w (SIZE) and v (SIZE x RANK)."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.w0, self.w, self.v = w0, w, v

    def _sums(self, buckets: np.ndarray, n: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each text, and the sums of its factors."""
        owner = np.repeat(np.arange(len(n)), n)
        x = 1.0 / np.maximum(n, 1)
        linear = np.bincount(owner, self.w[buckets], len(n)) * x + self.w[bins].sum(1)
        first, second = np.empty((len(n), RANK)), np.empty((len(n), RANK))
        for f in range(RANK):
            vf = self.v[:, f]
            value = vf[buckets]
            first[:, f] = np.bincount(owner, value, len(n)) * x + vf[bins].sum(1)
            second[:, f] = np.bincount(owner, value * value, len(n)) * x * x + (vf[bins] ** 2).sum(1)
        return self.w0 + linear + 0.5 * (first**2 - second).sum(1), first

    def scores(self, texts: Texts) -> np.ndarray:
        logit, _ = self._sums(*features(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple[str, int]]) -> FactorisationMachine:
        """Adagrad over minibatches of the sample, in an order that a fixed seed gives."""
        rng = np.random.default_rng(11)
        model = cls(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
        y = np.array([t for _, t in rows], float)
        if not len(rows):
            return model
        model.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        order = rng.permutation(len(rows))
        batches = []
        for a in range(0, len(rows), 32):
            own = order[a : a + 32]
            batches.append((*features(Texts(pa.array([rows[i][0] for i in own], pa.string()))), y[own]))
        gw, gv, g0 = np.full(SIZE, 1e-2), np.full((SIZE, RANK), 1e-2), 1e-2
        for _ in range(max(EPOCHS, -(-STEPS // len(batches)))):
            for k in rng.permutation(len(batches)):
                buckets, n, bins, t = batches[k]
                logit, first = model._sums(buckets, n, bins)
                e = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - t
                owner = np.repeat(np.arange(len(n)), n)
                x = 1.0 / np.maximum(n, 1)
                at = np.concatenate([buckets, bins.ravel()])
                ex = np.concatenate([(e * x)[owner], np.repeat(e, _STATS)])
                xs = np.concatenate([x[owner], np.ones(bins.size)])
                who = np.concatenate([owner, np.repeat(np.arange(len(n)), _STATS)])
                used = np.unique(at)
                place = np.searchsorted(used, at)
                d = np.bincount(place, ex, len(used)) / len(n) + PENALTY * model.w[used]
                gw[used] += d * d
                model.w[used] -= RATE * d / np.sqrt(gw[used])
                for f in range(RANK):
                    vf = model.v[:, f]
                    d = np.bincount(place, ex * (first[who, f] - vf[at] * xs), len(used)) / len(n) + PENALTY * vf[used]
                    gv[used, f] += d * d
                    model.v[used, f] -= 0.3 * RATE * d / np.sqrt(gv[used, f])
                d = e.mean()
                g0 += d * d
                model.w0 -= RATE * d / np.sqrt(g0)
        return model


def train(docs: DataFrame, labels: DataFrame) -> FactorisationMachine:
    """Learn from a bounded sample of the labelled documents whose fold is not 0."""
    return FactorisationMachine.fit(labelled(docs, labels.where(fold() != 0), "quality"))


def scored(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from its text alone.

    Null and empty texts have no words; their statistics are scored. Rows with a
    null doc_id are scored and not held out; repeated rows are scored each; an empty
    table gives an empty result; other columns are ignored. Without labelled rows
    every score is 0.5 or near it.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                s = model.scores(Texts(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        tidy()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
