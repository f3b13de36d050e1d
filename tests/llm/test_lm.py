import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)})), None]


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_base_and_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 500)
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    rows += [(90001, None), (90002, ""), (90002, ""), (90003, "the " * 3000), (None, "the of")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    counts = Counter()
    for d, t in rows:
        if d is not None and fold(d) != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if d is None else d, d is not None and fold(d) == 1, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    got = lm.scored(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_empty_and_unlearnt(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scored(docs).collect() == []
    alone = next(d for d in range(100) if fold(d) == 1)
    r = lm.scored(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)
    assert math.isfinite(r.score)


def test_network_learns_from_the_whole_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 20_000)
    late = [" ".join(random.Random(i).choice(["c d e", "f g h"]) for _ in range(100)) for i in range(150)]
    rows = [(i, "a b " * 400) for i in range(500)] + [(1000 + i, t) for i, t in enumerate(late)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [r for r in lm.scored(docs).collect() if r.held_out and r.doc_id >= 1000]
    # one of two words is open at every third place only
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > -0.2


@pytest.fixture
def small():
    vocabulary = lm.Vocabulary(np.arange(1, 41, dtype=np.uint64), np.arange(50.0, 10.0, -1.0), 60, 1000, np.full(lm.TAIL, 10.0))
    rng = np.random.default_rng(1)
    lens = np.array([5, 1, 9, 3, 7])
    return vocabulary, rng.integers(0, vocabulary.inputs - 1, lens.sum()), lens


def test_probabilities_sum_to_one(small):
    vocabulary, _, _ = small
    network = lm.Network(vocabulary)
    state = np.random.default_rng(2).normal(size=(lm.HIDDEN, 1)).astype(np.float32)
    every = np.arange(vocabulary.size + vocabulary.tails)
    p = network.log_probabilities(np.repeat(state, len(every), 1), every)
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)


def test_states_are_carried_over_windows(small, monkeypatch):
    vocabulary, symbols, lens = small
    network = lm.Network(vocabulary)
    whole = network.score(symbols, lens)
    monkeypatch.setattr(lm, "WINDOW", 2)
    monkeypatch.setattr(lm, "LANES", 3)
    assert network.score(symbols, lens) == pytest.approx(whole, abs=1e-5)
    first = np.cumsum(lens) - lens
    alone = np.concatenate([network.score(symbols[a : a + n], np.array([n])) for a, n in zip(first, lens, strict=True)])
    assert alone == pytest.approx(whole, abs=1e-5)


def test_gradients(small):
    vocabulary, symbols, lens = small
    network = lm.Network(vocabulary)
    at, before, begins, _ = lm._grid(symbols, lens, 3, vocabulary.inputs - 1)
    h = np.zeros((lm.HIDDEN, at.shape[1]))
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    grads, _ = network._gradients(at, before, begins, symbols, h)
    seen, rows = grads["x"]
    grads["x"] = np.zeros_like(network.p["x"])
    grads["x"][seen] = rows

    def loss():
        states = network.run(before, begins, h).transpose(1, 0, 2).reshape(lm.HIDDEN, -1)
        here = np.flatnonzero(at.ravel() >= 0)
        return -network.log_probabilities(states[:, here], symbols[at.ravel()[here]]).mean()

    rng = np.random.default_rng(3)
    for name, g in grads.items():
        for i in rng.choice(np.flatnonzero(np.abs(g).ravel() > 1e-4), 4):
            flat = network.p[name].reshape(-1)
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-2 == pytest.approx(g.reshape(-1)[i], rel=0.08, abs=3e-5)


def test_long_documents_are_cut_for_training_only(small):
    vocabulary, symbols, lens = small
    start = vocabulary.inputs - 1
    at, before, begins, sizes = lm._grid(symbols, lens, 3, start, 4)
    assert sorted(at[at >= 0]) == list(range(lens.sum()))
    first = np.cumsum(lens) - lens
    assert {int(i) for i in at[begins]} == {int(a + k) for a, n in zip(first, lens, strict=True) for k in range(0, n, 4)}
    for i, b in zip(at[at >= 0], before[at >= 0], strict=True):
        assert b == (start if i in first else symbols[i - 1])
    assert sizes.sum() == lens.sum()


def test_sorted_tables_teach_as_well(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 10_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")

    def gain(df):
        out = [r for r in lm.scored(df).collect() if r.held_out]
        return sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)

    mixed, by_lang = gain(docs.orderBy("doc_id").coalesce(1)), gain(docs.orderBy("lang", "doc_id").coalesce(1))
    assert by_lang > 0
    assert by_lang > mixed - 0.05


def test_tail_classes_grow():
    c = lm.tail_class(np.arange(5000))
    assert list(c[:5]) == [0, 1, 2, 3, 4]
    assert (np.diff(c) >= 0).all()
    assert (np.diff(c) <= 1).all()


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 5000)
    monkeypatch.setattr(lm, "COURSE", 2000)
    monkeypatch.setattr(lm, "FAN", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(1)).union(spark.createDataFrame([(5, None), (5, None), (5, "")], "doc_id long, text string"))
    one, many = ([(r.doc_id, r.n_tokens, r.score) for r in lm.scored(df).orderBy("doc_id", "n_tokens", "score").collect()] for df in (docs.coalesce(1), docs.orderBy("text").repartition(9)))
    assert lm._courses(60_000) > lm.ROUNDS * lm.FAN
    assert len(one) == docs.count()
    for (d, n, a), (e, m, b) in zip(one, many, strict=True):
        assert (d, n) == (e, m)
        assert abs(a - b) <= 1e-3 * n


def test_sums_of_courses_by_steps(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 3)
    rng = np.random.default_rng(1)
    rows = [(c, p, float(c + 1), rng.normal(size=4)) for c in range(11) if c != 4 for p in range(2)]
    parts = spark.createDataFrame([(c, p, w, bytearray(x.tobytes())) for c, p, w, x in rows], "course long, piece int, weight double, x binary")
    got = {r.piece: r for r in lm._sums(parts, 11).collect()}
    assert set(got) == {0, 1}
    for piece, r in got.items():
        own = [(w, x) for _, p, w, x in rows if p == piece]
        assert r.weight == sum(w for w, _ in own)
        np.testing.assert_allclose(np.frombuffer(r.x), sum(x for _, x in own))


def test_every_training_text_is_one_lesson(spark, monkeypatch):
    monkeypatch.setattr(lm, "COURSE", 50)
    seen = []
    real = lm._trained
    monkeypatch.setattr(lm, "_trained", lambda lessons, *rest: seen.append([(r.course, len(r.symbols) // 2) for r in lessons.collect()]) or real(lessons, *rest))
    x, y, z = [d for d in range(30) if fold(d) != 1][:3]
    rows = [(x, "a b c")] * 200 + [(y, "a b d " * 20), (z, ""), (None, "a b c")]
    lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(n for _, n in seen[0]) == sorted([4] * 200 + [61, 1])
    assert max(Counter(c for c, n in seen[0] if n == 4).values()) < 40


def plain_steps(network, before, begins, h):
    """The states of a window, one step after another, as the unit is defined."""
    p, k, out = network.p, lm.HIDDEN, []
    for b, fresh in zip(before, begins, strict=True):
        h = np.where(fresh, 0, h)
        x, a = p["x"][b].T, p["u"].T @ h
        r, z = (1 / (1 + np.exp(-x[i : i + k] - a[i : i + k])) for i in (0, k))
        new = np.tanh(x[2 * k :] + r * a[2 * k :])
        h = new + z * (h - new)
        out.append(h)
    return np.array(out)


def test_large_weights_stay_finite(small):
    """Logits are shifted only where exponentials could leave their range; gates far from 0 are 0 or 1."""
    vocabulary, symbols, lens = small
    network = lm.Network(vocabulary)
    network.p = {k: v * 400 for k, v in network.p.items()}
    at, before, begins, _ = lm._grid(symbols, lens, 3, vocabulary.inputs - 1)
    h = np.zeros((lm.HIDDEN, at.shape[1]), np.float32)
    states = network.run(before, begins, h)
    with np.errstate(over="ignore"):
        np.testing.assert_allclose(states, plain_steps(network, before, begins, h), atol=1e-3)
    grads, _ = network._gradients(at, before, begins, symbols, h)
    assert all(np.isfinite(g).all() for g in (grads.pop("x")[1], *grads.values()))
    every = np.arange(vocabulary.size + vocabulary.tails)
    p = network.log_probabilities(np.repeat(states[-1][:, :1], len(every), 1), every)
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)


def test_states_as_defined(small):
    vocabulary, symbols, lens = small
    network = lm.Network(vocabulary)
    at, before, begins, _ = lm._grid(symbols, lens, 3, vocabulary.inputs - 1)
    h = np.zeros((lm.HIDDEN, at.shape[1]), np.float32)
    np.testing.assert_allclose(network.run(before, begins, h), plain_steps(network, before, begins, h), atol=1e-5)


def test_distinct_numbers_in_order():
    x = np.random.default_rng(4).integers(0, 50, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for y in (x, x[:1], x[:0]):
        for a, b in zip(lm._distinct(y), np.unique(y, return_inverse=True), strict=True):
            np.testing.assert_array_equal(a, b)
