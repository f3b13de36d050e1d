import random

import pytest

from lumenfold.llm import jaccard_join
from lumenfold.llm.jaccard_join import joined, matches, overlap

from .test_near_dedup import shingles


def brute(rows, k, percent=90):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=240, edits=(0, 1, 1, 2, 3, 8)):
    """Chains of near copies around the threshold, and a passage that many texts share."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(900)}"
    passage = [f"p{i}" for i in range(40)]
    rows, texts = [], [[word() for _ in range(r.choice([1, 2, 3, 9, 30, 80, 200]))] for _ in range(30)]
    for i in range(n):
        w = list(r.choice(texts))
        for _ in range(r.choice(edits)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.choice([0, 1])] = [word()]
        if i % 3 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        texts.append(w)
        rows.append((i * 3 - 40, " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "One"), (5004, "oNE"), (5005, "a b"), (5006, "a  b"), (5007, "É b c d"), (5008, "é b c d"), (5009, "x " * 5000), (5010, " ".join(map(str, range(20000)))), (5011, " ".join(map(str, range(500, 20500))))]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, component_id string").repartition(3)
    assert sorted(tuple(r) for r in joined(docs).collect()) == brute(rows, 3)


def test_long_lists_pivots_and_split_keys(spark, monkeypatch):
    """With small limits most pairs are found in long lists, over whole sets and in split keys."""
    for name, value in [("LONG", 3), ("SPLIT", 4), ("PIVOTS", 1), ("TRIED", 1), ("BROADCAST_KEYS", 20)]:
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(3, 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in joined(docs).collect()) == brute(rows, 3)


def test_similar_sets_share_what_is_promised():
    """Two sets with the least overlap that a link allows, in every order of hashes: their kept hashes share m of the smaller."""
    r = random.Random(4)
    for _ in range(300):
        n = r.randrange(1, 150)
        larger = r.randrange(n, n * 100 // 90 + 1)
        common = next(o for o in range(n + 1) if 100 * o >= 90 * (n + larger - o))
        if common > n:
            continue
        order = r.sample(range(10**6), n + larger - common)
        a, b = sorted(order[:n]), sorted(order[n - common :])
        kept = lambda x: set(x[: len(x) - overlap(len(x), 90) + matches(len(x), 90)])
        assert len(kept(a) & kept(b)) >= matches(n, 90)


def test_repeated_rows_and_nulls(spark):
    rows = [(3, "a b c d", 1), (3, "a b c d", 1), (2, "A b C d", 2), (None, "a b c d", 3), (9, None, 4), (None, None, 5)]
    got = joined(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(3, 2, 2), (3, 2, 2), (2, 2, 2), (None, 2, None), (9, 0, 9), (None, 0, None)], key=str)


def test_empty_table(spark):
    assert joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []
