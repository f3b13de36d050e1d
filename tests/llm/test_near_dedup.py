import random
import re

import pytest

from lumenfold.llm.near_dedup import near_duplicates, one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, bases = [], [[r.choice(vocabulary) for _ in range(r.choice([3, 12, 40, 200, 900]))] for _ in range(12)]
    for i in range(160):
        w = list(r.choice(bases))
        for _ in range(int(len(w) * r.choice([0, 0.005, 0.02, 0.05, 0.1]))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i * 7 - 50, r.choice([" ", "\n", "\x0b "]).join(w).upper() if i % 9 == 0 else " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "ONE"), (5004, "one"), (5005, "É"), (5006, "é"), (5007, "a\x85b"), (5008, "a b"), (5009, "x " * 30000)]


@pytest.mark.parametrize("k", [2, 5])
def test_like_brute_force(spark, k):
    rows = corpus(k)
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in near_duplicates(docs, words=k).collect())
    assert got == brute(rows, k)


def test_repeated_rows_nulls_and_columns(spark):
    rows = [(3, "a b c d", 1), (3, "a b c d", 1), (2, "A b C d", 2), (None, "a b c d", 3), (9, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted(near_duplicates(docs, words=2).collect(), key=str)
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (2, 2, True), (3, 2, False), (3, 2, False), (9, 9, True)]
    left = one_of_each(docs, words=2)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 2, 9]


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    long, other, third = "a b c d e f g h", "p q r s t u v w", "k l m n o p q r"
    rows = [(1, long), (5, long.upper()), (5, other), (5, None), (7, third), (7, third), (7, other), (8, other), (None, long)]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, s1 int")
    left = one_of_each(docs, words=2)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(1, long), (5, other), (5, None), (7, third), (None, long)], key=str)


def test_hot_keys_are_split(spark, monkeypatch):
    from lumenfold.llm import near_dedup

    monkeypatch.setattr(near_dedup, "SPLIT", 3)
    monkeypatch.setattr(near_dedup, "LONG", 4)
    rows = [r for r in corpus(8) if r[0] != 5009]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(docs, words=2).collect()) == brute(rows, 2)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []
    assert one_of_each(docs).collect() == []
