import json
import random
import tracemalloc

import pyarrow as pa

from lumenfold.operators import reconcile


def key(block, size=400):
    return json.dumps(block, ensure_ascii=False, sort_keys=True)[:size]


def merge(snapshots):
    """Insertion into a plain list."""
    out = list(snapshots[0])
    for snapshot in snapshots[1:]:
        at = -1
        for b in snapshot:
            found = [i for i, x in enumerate(out) if key(x) == key(b)]
            if found:
                at = found[-1]
            else:
                at += 1
                out.insert(at, b)
    return out


def brute(snaps):
    """Of snapshots in the order of time: the largest first; all in that order where it is over 5 % larger, of more than three."""
    chars = lambda s: sum(len(json.dumps(b, ensure_ascii=False)) + 2 for b in s)
    top = max(range(len(snaps)), key=lambda i: (chars(snaps[i]), -i))
    merged = merge([snaps[top], *snaps[:top], *snaps[top + 1 :]])
    timed = len(snaps) > 3 and chars(merged) > 1.05 * chars(snaps[top])
    return (merge(snaps) if timed else merged), timed


def captures(seed, n=60):
    r = random.Random(seed)
    out = {}
    for c in range(n):
        blocks = [{"text": "é" * r.randrange(30), "n": i} for i in range(r.randrange(1, 14))]
        snaps = []
        for _ in range(r.randrange(1, 8)):
            a = r.randrange(len(blocks))
            snap = blocks[a : a + r.randrange(1, 9)]
            snaps.append(snap if r.random() < 0.8 else [*snap, *snap[:2], {"text": "x" * 450 + str(r.randrange(2))}])
        out[f"c{c}"] = snaps
    return out


def test_folds_like_plain_lists(spark):
    made = captures(4)
    want = {}
    for c, snaps in made.items():
        merged, timed = brute(snaps)
        want[c] = [(i, b, timed) for i, b in enumerate(merged, 1)]
    text = lambda b: json.dumps(b, ensure_ascii=False)
    rows = [(c, 10 * t, i, text(b), "?") for c, snaps in made.items() for t, snap in enumerate(snaps) for i, b in enumerate(snap)]
    random.Random(1).shuffle(rows)
    got = {}
    for r in reconcile.merged_captures(spark.createDataFrame(rows, "capture_id string, snap_seq int, ord int, block string, score string")).collect():
        got.setdefault(r.capture_id, []).append((r.pos, json.loads(r.block), r.reordered))
    assert {c: sorted(x, key=lambda y: y[0]) for c, x in got.items()} == want
    pages = [(c, t, json.dumps(snap, ensure_ascii=False), t) for c, snaps in made.items() for t, snap in enumerate(snaps)]
    found = reconcile.merged_pages(spark.createDataFrame(pages, "capture_id string, snap_seq int, blocks string, score long")).collect()
    assert {r.capture_id: json.loads(r.blocks) for r in found} == {c: [b for _, b, _ in x] for c, x in want.items()}
    assert {r.capture_id: (r.reordered, r.visible, r.unread) for r in found} == {c: (x[0][2], len(made[c]) - 1, False) for c, x in want.items()}


def test_odd_snapshots(spark):
    rows = [("n", 1, None, None), ("n", 0, '[{"a": 1}]', 5), ("e", 0, "[]", None), (None, 3, '[{"b": 2}]', 1), ("z", None, '[{"c": 3}]', 2), ("z", 1, '[{"c": 3}, {"d": 4}]', 1)]
    got = {r.capture_id: tuple(r)[1:] for r in reconcile.merged_pages(spark.createDataFrame(rows, "capture_id string, snap_seq int, blocks string, score long")).collect()}
    assert got == {"n": ('[{"a": 1}]', 5, False, True), "e": ("[]", None, False, False), None: ('[{"b": 2}]', 1, False, False), "z": ('[{"c": 3}, {"d": 4}]', 2, False, False)}
    assert reconcile.merged_pages(spark.createDataFrame([], "capture_id string, snap_seq int, blocks string, score long")).collect() == []


def test_402_snapshots_of_two_megabytes_are_held_once():
    """A page that scrolls: each snapshot repeats 2 MB and has one new block. All of them would be 800 MB."""
    base = [json.dumps({"n": i, "text": "x" * 2000}) for i in range(1000)]

    def batches():
        order = [401, *range(401)]
        for t in order:
            blocks = f"[{', '.join(base)}, {json.dumps({'new': t, 'pad': 'y' * (50 if t == 401 else 1)})}]"
            columns = [pa.array(["c"]), pa.array([t], pa.int32()), pa.array([t == 401]), pa.array([402], pa.int32()), pa.array([blocks]), pa.array([t], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["capture_id", "snap_seq", "first", "snapshots", "blocks", "score"])

    tracemalloc.start()
    ((capture, fold),) = reconcile._folds(batches(), 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    blocks, timed = fold.result()
    blocks = list(blocks)
    assert (capture, timed, len(blocks), fold.visible) == ("c", False, 1402, 401)
    assert peak < 30e6
