import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from lumenfold.llm.filter_audit import audit, masks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed(rows):
    """For each row the set of filters it fails."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        f = set()
        if len(w) < 100:
            f.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if d is not None and d > least[t]:
            f.add("E")
        out.append(f)
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for (d, _, lang), f in zip(rows, failed(rows), strict=True):
        parts[lang or ""].append((d, f))
    out = []
    for part, docs in parts.items():
        shapley = Counter()
        found = []
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                fails = sum(x in f for _, f in docs)
                shapley[x] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(f == {x} for _, f in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x))
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_like_brute_force(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(500)] + ["UP", "SHOUT", "a#b", "é", "Ünder"]
    texts = [" ".join(r.choice(words[: r.choice([20, 505])]) for _ in range(r.choice([0, 5, 99, 100, 101, 160]))) for _ in range(30)]
    texts += [None, "", "A", "A bcdefghij", "AA bcdefghij", "|", " \x0b\t\n", " ".join(["SAME"] * 3000), " ".join(map(str, range(80))) + " x" * 20, " ".join(map(str, range(80))) + " x" * 21, "x\x85y " * 100]
    rows = [(r.choice([None, *range(90)]), r.choice(texts), r.choice(["en", "de", "", None])) for _ in range(240)]
    labels = [(r.choice([None, *range(120)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(90)]
    docs = spark.createDataFrame([(*x, i, 1) for i, x in enumerate(rows)], "doc_id long, text string, lang string, mask int, good int")
    given = spark.createDataFrame([(*x, "?") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = audit(docs, given)
    assert got.columns == NAMES
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, labels)


def test_one_part_gives_600_rows_and_zeros(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(100))), "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit(docs, none).collect()
    assert len(got) == 600 and {(x.kept, x.removed, x.redundant, x.shapley) for x in got} == {(1, 0, 0, 0)}


def test_copies_over_languages(spark):
    docs = spark.createDataFrame([(5, "x", "en"), (5, "x", "de"), (7, "x", "en"), (3, "x", "fr"), (3, "x", "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(x) for x in masks(docs, labels).where("n > 0").collect())
    assert got == [("de", 17, 1, 1, 1), ("en", 17, 2, 1, 1), ("fr", 1, 2, 0, 0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
