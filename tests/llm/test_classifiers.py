import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import language, quality_model, toxicity
from lumenfold.llm.words import Texts

SF = "/root/testdata/sf0.01"
ODD = [(None, None), (1, ""), (2, "12 !?"), (2, "12 !?"), (3, "word " * 50000), (4, "é"), (5, "\x00")]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_language(spark, tables):
    docs, _ = tables
    model = language.train(docs)
    rows = language.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held(r.doc_id) for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.97
    odd = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, score string")
    got = sorted(language.identified(odd, model).collect(), key=lambda r: (r.doc_id or -1))
    assert [r.lang_pred for r in got[:4]] == ["und"] * 4
    assert got[0].held_out is False
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.in_languages(odd, model, model.names)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} <= {3, 4}
    empty = docs.where("false")
    assert language.identified(empty, language.train(empty)).collect() == []
    assert {r.lang_pred for r in language.identified(odd, language.train(empty)).collect()} == {"und"}


def test_language_against_brute_force(spark):
    """Every n-gram of every text by itself: buckets, counts, and posteriors in plain Python."""
    import math
    import unicodedata
    from collections import Counter

    def buckets(text):
        low = "  " + text.lower()
        points = [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in low]
        for i, p in enumerate(points):
            code = p
            for order in (1, 2, 3) if p else ():
                if order > 1:
                    code = (code * 0x100000001B3 + points[i - order + 1]) % 2**64
                yield ((code + order) * 0x9E3779B97F4A7C15 % 2**64) >> 49

    sample = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text][:60]
    rows, asked = sample[:40], [t for t, _ in sample[40:]] + ["Ünï cödé 日本 x1y", "q", ""]
    model = language.LanguageModel.fit(rows)
    names = sorted({y for _, y in rows})
    counts = {n: Counter(b for t, y in rows if y == n for b in buckets(t)) for n in names}
    prior = {n: math.log((1 + sum(y == n for _, y in rows)) / (len(names) + len(rows))) for n in names}
    found, scores = model.predict(asked)
    for text, name, score in zip(asked, found, scores, strict=True):
        own = list(buckets(text))
        total = {n: prior[n] + sum(math.log((counts[n][b] + 0.5) / (sum(counts[n].values()) + 0.5 * language.BUCKETS)) for b in own) for n in names}
        best = max(names, key=total.get)
        if not own:
            assert (name, score) == ("und", 0.0)
            continue
        assert name == best
        assert score == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total.values()), abs=1e-3)


def test_only_configured_languages_stay(spark):
    rows = [("aaa aba", "x"), ("bbb bcb", "y"), ("ddd ded", "z")]
    model = language.LanguageModel.fit(rows)
    docs = spark.createDataFrame([(1, "aab", 0), (2, "bbc", 0), (2, "bbc", 0), (3, "dde", 0), (4, None, 0), (5, "123", 0), (None, "aba", 0)], "doc_id long, text string, lang int")
    left = language.in_languages(docs, model, ["x", "y"])
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "2", "None"]
    assert language.in_languages(docs, model, ["x"], score=1.1).collect() == []
    assert language.in_languages(docs.where("false"), model, ["x"]).collect() == []


def test_language_counts_by_hand():
    model = language.LanguageModel.fit([("aaa", "x"), ("bbb", "y")])
    assert model.predict(["a", "b", "ab", ""])[0][:2] == ["x", "y"]
    one, two = model.predict(["aa bb aab"]), model.predict(["q", "aa bb aab", None])
    assert two[0] == ["x", one[0][0], "und"]
    assert two[1][1] == pytest.approx(one[1][0])


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.95), (quality_model, "quality", 0.95)])
def test_labels(spark, tables, module, label, least):
    docs, labels = tables
    model = module.train(docs, labels)
    rows = module.scored(docs, model).join(labels, "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[label] for r in test]) > least
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)
    odd = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, score string")
    got = module.scored(odd, model).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r.score <= 1 for r in got)
    assert module.scored(docs.where("false"), model).collect() == []
    unlearnt = module.train(docs, labels.where("false"))
    assert len(module.scored(odd, unlearnt).collect()) == len(ODD)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def matches(matcher, words):
    return [int(matcher.match(*toxicity.split([w])[1:4])[0]) for w in words]


def test_automaton_against_edit_distance():
    r = random.Random(6)
    terms = ["idiot", "scum", "worthless", "disgustingly"]
    matcher = toxicity.Matcher(terms)
    words = list(terms)
    for _ in range(800):
        w = list(r.choice(terms))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(w))
            w[at : at + r.randrange(2)] = r.choice(["", "x", "o", "tt"])
            w = w or ["a"]
        words.append("".join(w))
    allowed = lambda t: 2 if len(t) >= toxicity.TWO_EDITS else 1 if len(t) >= toxicity.ONE_EDIT else 0
    want = [min((edits(w, t) + 1 for t in terms if edits(w, t) <= allowed(t)), default=0) for w in words]
    assert matches(matcher, words) == want


def test_beginnings_lookalikes_and_quotation():
    matcher = toxicity.Matcher(["vequ*", "idiot"])
    assert matches(matcher, ["vequille", "vequ", "veq", "idi0t", "1diot", "idiots", "xvequ"]) == [1, 1, 0, 1, 1, 2, 0]
    quoted = lambda t, context: toxicity.hit_features(matcher, [t], context)[0]
    assert quoted("the word “idiot” is old", {})[2] > 0
    assert quoted("you are an idiot, truly", {})[0] > 0
    assert quoted("the word idiot is old", {"word": 1.5})[2] > 0
    assert quoted("the word “idiot” you", {"you": -2.0})[0] > 0


def test_context_is_learnt_from_windows():
    r = random.Random(3)
    filler = lambda n: " ".join("".join(r.choice("klmnop") for _ in range(7)) for _ in range(n))
    rows = [(f"{filler(15)} you idiot {filler(15)}", 1) for _ in range(200)]
    rows += [(f"{filler(15)} she wrote idiot {filler(15)}", 0) for _ in range(15)]
    rows += [(f"{filler(15)} you {filler(15)}", 0) for _ in range(400)]
    model = toxicity.ToxicityModel.fit(rows)
    assert model.lexicon == ["idiot"]
    assert model.context["wrote"] > 1 > -1 > model.context["you"]
    abuse, quotation = model.scores([f"{filler(9)} you idiot {filler(9)}", f"{filler(9)} they wrote idiot {filler(9)}"])
    assert abuse > 0.5 > quotation
    # by hand: all clean windows and none of the toxic ones have it; texts that share their least pair count once
    assert np.log(10.5 / 11) - np.log(0.5 / 150) < model.context["wrote"] <= np.log(15.5 / 16) - np.log(0.5 / 201)


def test_logistic_model_is_at_its_optimum():
    r = random.Random(8)
    words = [f"w{chr(97 + i)}rd" for i in range(20)]
    rows = [(" ".join([*r.sample(words, 12), *(["idiot"] * r.randrange(1, 4))]), 1) for _ in range(60)] + [(" ".join(r.sample(words, 15)), 0) for _ in range(120)]
    model = toxicity.ToxicityModel.fit(rows)
    x = np.hstack([np.ones((len(rows), 1)), toxicity.hit_features(model.matcher, [t for t, _ in rows], model.context)])
    y = np.array([t for _, t in rows])
    ridge = np.array([1e-3] + [0.5] * toxicity.FEATURES)

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * w * w).sum()

    best = loss(model.weights)
    for _ in range(200):
        assert loss(model.weights + np.array([r.gauss(0, 0.05) for _ in model.weights])) >= best - 1e-9
    assert model.scores([t for t, _ in rows]) == pytest.approx(1 / (1 + np.exp(-x @ model.weights)))


def test_toxic_rows_go(spark):
    r = random.Random(9)
    words = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    rows = [(i, words(), 0) for i in range(300)]
    rows += [(1000 + i, f"{words()} {'idiot' if i % 2 else 'moron'} {words()}", 1) for i in range(100)]
    docs = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + [(None, None, None)], "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert model.lexicon == ["idiot", "moron"]
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in left.collect()) == [-1, *range(300)]


def test_factorisation_machine_by_all_pairs():
    model = quality_model.FactorisationMachine.fit([("one two three", 1), ("### $$$ %%%", 0)] * 40)
    text = Texts(pa.array(["one two ###"]))
    buckets, n, bins = quality_model.features(text)
    occurrences = [(b, 1 / n[0]) for b in buckets] + [(b, 1.0) for b in bins[0]]
    logit = model.w0 + sum(model.w[i] * v for i, v in occurrences)
    for a in range(len(occurrences)):
        for b in range(a):
            (i, u), (j, v) = occurrences[a], occurrences[b]
            logit += float(model.v[i] @ model.v[j]) * u * v
    assert model.scores(text)[0] == pytest.approx(1 / (1 + np.exp(-logit)))


def test_lexicons_of_many_terms():
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    bad, good = sorted({word() for _ in range(260)}), [word() for _ in range(300)]
    rows = [(" ".join([*r.sample(good, 20), *r.sample(bad, 20)]), 1) for _ in range(400)]
    rows += [(" ".join(r.sample(good, 40)), 0) for _ in range(400)]
    model = toxicity.ToxicityModel.fit(rows)
    assert set(bad) <= set(model.lexicon)
    rest = " ".join(good[:40])
    assert model.scores([f"{rest} {b}" for b in bad]).min() > model.scores([rest])[0]
    points = toxicity.split([f"{b} {b[:-1]}" for b in bad])[1:4]
    assert (model.matcher.match(*points) == toxicity.Matcher(model.lexicon).match(*points)).all()
