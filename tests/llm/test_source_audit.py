import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenfold.llm import source_audit
from lumenfold.llm.source_audit import audit, probability

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        t = TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        counts[lang or "", source or ""].update(t)
        docs[lang or ""].update(set(t))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: {t: counts[x, s][t] for t in kept} for x, s in counts if x == lang}
        whole = {t: sum(c[t] for c in of.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        probabilities, q = {s: p(c) for s, c in of.items()}, p(whole)
        f = lambda x, y: (x - y) ** 2 // y
        for s, mine in probabilities.items():
            pairs = [(sum(f(mine[t], theirs[t]) for t in kept), o) for o, theirs in probabilities.items() if o != s]
            terms = [(f(mine[t], q[t]), t) for t in kept if of[s][t] and mine[t] > q[t]]
            for part, found, k in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:k]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed, n=300):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "abcdé" for b in "xyzü" for c in "klmnÉ日"] + ["Don't", "a1b", "İx", "\x85q", "𝒳", "￿", "A-B_C"]
    rows = []
    for _ in range(n):
        source = r.choice(["hot", "hot", "s1", "s2", "s3", "", None])
        mine = words if source == "hot" else words[len(source or "") % 7 :: 2]
        rows.append((" ".join(r.choice(mine) for _ in range(r.choice([0, 1, 5, 40]))).upper() if r.random() < 0.2 else "\n".join(r.choice(mine) for _ in range(9)), r.choice(["en", "de", None, ""]), source))
    rows += [(None, "en", "s1"), ("", "fr", "only"), ("1 2 3", "fr", "numbers"), ("lone", "fr", "numbers"), (None, "it", None), ("x " * 50000, "en", "long"), ("w" * 100000, "en", "long")]
    return rows


SCHEMA = "text string, lang string, source string, term string, n long, rank int"


@pytest.mark.parametrize("limits", [(200_000, 20_000, 1 << 20, 1_000_000), (10, 3, 9, 0)])
def test_like_brute_force(spark, monkeypatch, limits):
    """With small limits: counts handed on early, several parts and blocks, and groups joined by a shuffle."""
    for name, value in zip(["HELD", "VECTORS", "PAIRS", "BROADCAST_KEYS"], limits, strict=True):
        monkeypatch.setattr(source_audit, name, value)
    rows = corpus(11)
    docs = spark.createDataFrame([(*x, "?", 1, 2) for x in rows], SCHEMA).repartition(5)
    got = audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(x) for x in got.collect()) == brute(rows)


def test_top_terms_and_ties(spark):
    rows = [(" ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)), "en", "a")] * 3 + [("zz", "en", "b")] * 4
    got = audit(spark.createDataFrame([(*x, "", 0, 0) for x in rows], SCHEMA)).collect()
    assert sorted(tuple(x) for x in got) == brute(rows)
    assert sum(x.part == "term" and x.source == "a" for x in got) == 200


def test_large_counts():
    n, total = np.array([0, 10**15, 8 * 10**15, 123456789012345]), np.array([9 * 10**15])
    assert probability(n, total).tolist() == [1 + 10**9 * (int(x) + 1) // (9 * 10**15) for x in n]


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], SCHEMA)).collect() == []
