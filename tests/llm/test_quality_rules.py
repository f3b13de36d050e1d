import random
import re

from lumenfold.llm.quality_rules import judged, prior

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_like_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x\nx\n x\n\nx", "é#*$ <|> &%", "a " * 40, "one two three four five six seven eight nine ten"]
    texts += [" ".join(r.choice("abcde") for _ in range(r.randrange(60))).replace("a b", "a\nb") for _ in range(80)]
    rows = [(i, t, f"s{i % 3}", 1) for i, t in enumerate(texts)] + [(None, "a b", None, 1), (1, "", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    got = sorted(((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in judged(docs).collect()), key=str)
    want = sorted(((d, *counts(t), counts(t)[0] < 10 or 100 * counts(t)[4] > 20 * counts(t)[0]) for d, t, _, _ in rows), key=str)
    assert got == want
    assert judged(docs.where("false")).collect() == []


def test_hosts(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, good if i % 10 else "bad", "clean") for i in range(100)] + [(1000 + i, "bad" if i % 10 else good, "spam") for i in range(100)] + [(2000, good, "new"), (2001, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in judged(docs).collect()}
    assert got[1]
    assert not got[10]
    assert not got[1000]
    assert got[2000]
    assert got[2001]


def test_more_hosts_than_are_broadcast(spark, monkeypatch):
    from lumenfold.llm import quality_rules

    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, good if i % 3 else "bad", "hot" if i % 2 else f"h{i}") for i in range(200)] + [(500, good, None), (None, "bad", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(judged(docs).collect(), key=str)
    monkeypatch.setattr(quality_rules, "BROADCAST_KEYS", 10)
    assert sorted(judged(docs).collect(), key=str) == want


def test_prior():
    assert prior(0, 0, 0, 0.0) == (1.0, 1.0)
    a, b = prior(2, 200, 100, 90.0**2 / 100 + 10.0**2 / 100)
    assert abs(a / (a + b) - 0.5) < 0.01
    assert a + b < 10
