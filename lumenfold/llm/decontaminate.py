"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the number n of their shingles into classes between
powers of two. Of an item the s = n - ceil(t * n) + 1 lowest hashes are kept, its
MinHash sketch: a document with a share t of the shingles misses fewer than s, so
it holds at least one of the sketch, however long it is, and no leak is lost.

1. Sketches and full sets of the items are made where the items lie, and written.
2. Each class has a bitmap of its sketches' hashes. One scan of the documents looks
   their shingles up, class by class; a class whose items are too large for a text is
   passed over. All bitmaps together have a fixed largest size.
3. What a bitmap lets through meets the class's sketches by a join: candidates.
4. The candidates' full sets meet the documents' shingles by a join: exact containment.

Texts are known by two 64-bit hashes from step 2 on, so copies are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.scratch import BROADCAST_KEYS, Scratch, small_batches
from lumenfold.llm.words import Texts, chunks, tidy, to_lists, windows

#: Binary logarithms of the bits of all bitmaps together at most (16 MB), of those for each hash, and of a piece of a bitmap.
ALL_BITS, BITS_EACH, PIECE_BITS = 27, 6, 15

#: Words of a shingle and the size class: what sketches are kept by.
Class = tuple[int, int]

_ITEMS = "item_id long, k int, class int, n long, sketch array<long>, full array<long>"


def item_sets(texts: Texts, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, full set) of each item: words to a shingle, fewer if the item is shorter, 0 without words."""
    hashes = texts.hashes()
    for i in range(len(texts)):
        own = hashes[texts.at[i] : texts.at[i + 1]]
        k = min(words, len(own))
        yield k, np.unique(windows(own, k) >> np.uint64(1)) if k else np.zeros(0, np.uint64)


def _items(benchmark: DataFrame, words: int, percent: int) -> DataFrame:
    """The sketch and the full set of every item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = list(item_sets(Texts(part.column(1)), words))
                sizes = [len(full) for _, full in found]
                sketches = [full[: n + (-n * percent // 100) + 1] for (_, full), n in zip(found, sizes, strict=True)]
                columns = [part.column(0), pa.array([k for k, _ in found], pa.int32()), pa.array([n.bit_length() for n in sizes], pa.int32()), pa.array(sizes, pa.int64()), to_lists(sketches, pa.int64()), to_lists([full for _, full in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "k", "class", "n", "sketch", "full"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    return rows.mapInArrow(run, _ITEMS).where("n > 0")


def bitmap_sizes(counts: dict[Class, int]) -> dict[Class, int]:
    """The binary logarithm of the bits of each class's bitmap: 64 for each hash, less where all would be too many."""
    sizes = {key: max(PIECE_BITS, (n << BITS_EACH).bit_length()) for key, n in counts.items()}
    while sum(1 << b for b in sizes.values()) > 1 << ALL_BITS and max(sizes.values()) > PIECE_BITS:
        top = max(sizes.values())
        sizes = {key: b - (b == top) for key, b in sizes.items()}
    return sizes


def _bitmaps(sketches: DataFrame) -> dict[Class, np.ndarray]:
    """The bitmap of each class, made piece by piece on the executors."""
    counts = {(r["k"], r["class"]): r["count"] for r in sketches.groupBy("k", "class").count().collect()}
    sizes = bitmap_sizes(counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = np.array([(1 << sizes[key]) - 1 for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            at = batch.column(2).to_numpy() & masks
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((at >> PIECE_BITS).astype(np.int32)), pa.array((at & ((1 << PIECE_BITS) - 1)).astype(np.int32))], names=["k", "class", "piece", "at"])

    def piece(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PIECE_BITS, np.uint8)
        bits[table.column("at").to_numpy()] = 1
        return table.select(["k", "class", "piece"]).slice(0, 1).append_column("bits", pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()))

    placed = sketches.select("k", "class", "v").mapInArrow(place, "k int, class int, piece int, at int").distinct()
    out = {key: np.zeros(1 << (b - 3), np.uint8) for key, b in sizes.items()}
    for r in placed.groupBy("k", "class", "piece").applyInArrow(piece, "k int, class int, piece int, bits binary").collect():
        begin = r["piece"] << (PIECE_BITS - 3)
        out[r["k"], r["class"]][begin : begin + (1 << (PIECE_BITS - 3))] = np.frombuffer(r["bits"], np.uint8)
    return out


def hits(texts: Texts, bitmaps: dict[Class, np.ndarray], percent: int) -> Iterator[tuple[Class, np.ndarray, np.ndarray]]:
    """(class, texts, hashes): the shingles of texts that the bitmap of a class lets through, once for each text."""
    hashes = texts.hashes()
    held = np.diff(texts.at)
    for k in sorted({k for k, _ in bitmaps}):
        whole = windows(hashes, k) >> np.uint64(1)
        for key in sorted(key for key in bitmaps if key[0] == k):
            bits = bitmaps[key]
            at = whole & np.uint64(8 * len(bits) - 1)
            some = np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            owner = np.searchsorted(texts.at, some, "right") - 1
            fits = (some + k <= texts.at[owner + 1]) & (100 * (held[owner] - k + 1) >= percent << (key[1] - 1))
            owner, found = owner[fits], whole[some[fits]]
            order = np.lexsort((found, owner))
            owner, found = owner[order], found[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
            yield key, owner[new], found[new]


def _known_by() -> tuple[Column, Column]:
    """Two hashes of a text."""
    return F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u")


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment for each item found in a document.

    An item is found where the document has at least percent of its distinct
    shingles. An item with fewer words than a shingle is one shingle of all its
    words, found wherever they stand in a row. Null and empty texts, of items or
    documents, hold and match nothing. Repeated rows of either table give their
    rows again; null ids are returned as null; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    items = scratch.table(_items(benchmark, words, percent).withColumn("item", F.monotonically_increasing_id()))
    sketches = items.select("item", "k", "class", F.explode("sketch").alias("v"))
    bitmaps = _bitmaps(sketches)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                t, u = part.column(1).to_numpy(), part.column(2).to_numpy()
                for (k, size), owner, found in hits(Texts(part.column(0)), bitmaps, percent):
                    n = len(owner)
                    if n:
                        columns = [pa.array(t[owner]), pa.array(u[owner]), pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(found.view(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=["t", "u", "k", "class", "v"])
        tidy()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = sorted({k for k, _ in bitmaps})
        for batch in batches:
            for part in chunks(batch):
                texts = Texts(part.column(0))
                hashes = texts.hashes()
                for i in range(len(texts)):
                    own = hashes[texts.at[i] : texts.at[i + 1]]
                    for k in widths:
                        x = np.unique(windows(own, k) >> np.uint64(1)).view(np.int64)
                        t, u = part.column(1)[i].as_py(), part.column(2)[i].as_py()
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int64)), pa.array(np.full(len(x), u, np.int64)), pa.array(np.full(len(x), k, np.int32)), pa.array(x)], names=["t", "u", "k", "x"])
        tidy()

    met = source.select("text", *_known_by()).mapInArrow(search, "t long, u long, k int, class int, v long")
    candidates = scratch.table(met.join(sketches, ["k", "class", "v"]).select("t", "u", "item").distinct())
    some = candidates.select("t", "u").distinct()
    some = F.broadcast(some) if candidates.count() <= BROADCAST_KEYS // 2 else some
    own = source.select("text", *_known_by()).join(some, ["t", "u"], "left_semi").groupBy("t", "u").agg(F.first("text").alias("text")).select("text", "t", "u").mapInArrow(shingled, "t long, u long, k int, x long")
    wanted = candidates.join(items.select("item", "k", F.explode("full").alias("x")), "item")
    shared = wanted.join(own, ["t", "u", "k", "x"]).groupBy("t", "u", "item").agg(F.count("*").alias("shared"))
    leaks = shared.join(items.select("item", "item_id", F.col("n").alias("item_shingles")), "item").where(f"100 * shared >= {percent} * item_shingles")
    leaks = scratch.table(leaks.select("t", "u", "item_id", "item_shingles", "shared"))
    scratch.drop(candidates, items)
    leaks = F.broadcast(leaks) if leaks.count() <= BROADCAST_KEYS // 5 else leaks
    found = source.select("doc_id", *_known_by()).join(leaks, ["t", "u"])
    return found.select("doc_id", "item_id", "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that contain no item, all columns as they were; rows without doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    leaks = scratch.table(find_leaks(docs, benchmark, words, percent).select("doc_id").distinct())
    leaks = F.broadcast(leaks) if leaks.count() <= BROADCAST_KEYS else leaks
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)
