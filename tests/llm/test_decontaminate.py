import random

from lumenfold.llm import decontaminate
from lumenfold.llm.decontaminate import find_leaks, without_leaks

from .test_near_dedup import WORD, shingles


def found_by_brute_force(docs, items):
    out = []
    for d, text in docs:
        words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        for i, item in items:
            mine = WORD.findall((item or "").translate({i: i + 32 for i in range(65, 91)}))
            if not mine:
                continue
            k = min(5, len(mine))
            have = {tuple(words[a : a + k]) for a in range(len(words) - k + 1)}
            want = shingles(item, 5)
            if 100 * len(have & want) >= 80 * len(want):
                out.append((d, i, len(want), len(have & want)))
    return sorted(out, key=str)


def test_like_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 6, 20, 50, 150])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "ONE two"), (102, "one TWO"), (None, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for d in range(60):
        text = [r.choice(words) for _ in range(r.choice([0, 2, 30, 800]))]
        for _, item in r.sample(items[:40], 2):
            own = item.split()
            for _ in range(r.choice([0, 0, 1, 3])):
                own[r.randrange(len(own))] = r.choice(words)
            at = r.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((d, r.choice([" ", "\n"]).join(text).upper()))
    docs += [(900, None), (901, ""), (902, "x one two y"), (902, "x one two y"), (None, "w1 w2 w3 w4 w5 w6")]
    d = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, shared int")
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in find_leaks(d, b).collect()), key=str)
    assert got == found_by_brute_force(docs, items)
    bad = {x[0] for x in got}
    left = without_leaks(d, b)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(i for i, _ in docs if i is not None and i not in bad)
    assert left.where("doc_id is null").count() == 1


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(d, b).collect() == []
    assert without_leaks(d, b).count() == 1
    assert find_leaks(d.where("false"), b).collect() == []


def test_each_size_class_has_its_sketch_and_bitmap(spark):
    import numpy as np
    import pyarrow as pa

    texts = [" ".join(f"{name}{i}" for i in range(n)) for name, n in (("a", 6), ("b", 7), ("c", 40), ("d", 300), ("e", 3))]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = {r.item_id: r for r in decontaminate._items(items, 5, 80).collect()}
    assert {(r.k, r["class"], r.n, len(r.sketch)) for r in rows.values()} == {(5, 2, 2, 1), (5, 2, 3, 1), (5, 6, 36, 8), (5, 9, 296, 60), (3, 1, 1, 1)}
    sketches = decontaminate._items(items, 5, 80).selectExpr("k", "class", "explode(sketch) as v")
    bitmaps = decontaminate._bitmaps(sketches)
    assert set(bitmaps) == {(5, 2), (5, 6), (5, 9), (3, 1)}
    held = decontaminate.Texts(pa.array([" ".join(texts), "x", texts[2]], pa.string()))
    found = {key: {(int(t), int(v)) for t, v in zip(owner, hashes, strict=True)} for key, owner, hashes in decontaminate.hits(held, bitmaps, 80)}
    for r in rows.values():
        assert {(0, v) for v in r.sketch} <= found[r.k, r["class"]]
    # the third text is too short for the largest class
    assert {t for t, _ in found[5, 9]} == {0}
    assert {(2, v) for v in rows[2].sketch} <= found[5, 6]
    assert np.unpackbits(bitmaps[5, 9]).sum() == 60


def test_bitmaps_have_a_largest_size():
    many = {(5, c): 10**9 for c in range(1, 12)} | {(1, 1): 3}
    sizes = decontaminate.bitmap_sizes(many)
    assert sum(1 << b for b in sizes.values()) <= 1 << decontaminate.ALL_BITS
    assert sizes[1, 1] == decontaminate.PIECE_BITS
    assert decontaminate.bitmap_sizes({(5, 3): 100_000}) == {(5, 3): 23}


def test_full_bitmaps_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ALL_BITS", 10)
    monkeypatch.setattr(decontaminate, "PIECE_BITS", 5)
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 6, 30])))) for i in range(60)]
    docs = [(d, " ".join([*(r.choice(words) for _ in range(50)), r.choice(items)[1]])) for d in range(40)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((x.doc_id, x.item_id, x.item_shingles, x.shared) for x in got), key=str) == found_by_brute_force(docs, items)
