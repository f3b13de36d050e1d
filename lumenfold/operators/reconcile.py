"""Choices between candidates, snapshots of one page over time, and captures that fail."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import coverage, word_set

#: Characters of a block that tell it from others; longer blocks with the same beginning count as one.
SIGNATURE = 400


def signature(block: Column) -> Column:
    """The beginning of a block's JSON. Fields must be in the order of their names."""
    return F.substring(F.to_json(block), 1, SIGNATURE)


_sorted = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode
_decoder = json.JSONDecoder()
#: What stands between the blocks of a list.
_BETWEEN = re.compile(r"[ \t\n\r]*,?[ \t\n\r]*")


def _signature(block: dict[str, Any], size: int | None) -> str:
    return _sorted(block)[:size]


def _blocks_of(text: str) -> tuple[list[str], list[Any]]:
    """The blocks of a JSON list as they are written there, and what they parse to."""
    own: list[str] = []
    told: list[Any] = []
    at = _BETWEEN.match(text, text.index("[") + 1).end()
    while text[at] != "]":
        block, end = _decoder.raw_decode(text, at)
        own.append(text[at:end])
        told.append(block)
        at = _BETWEEN.match(text, end).end()
    return own, told


class _Merge:
    """Blocks of snapshots in one order: new blocks go after the last known one before them, or to the front.

    Known blocks are followed by their signature (the last of equal ones), and a linked list takes new ones, so a snapshot costs
    its own length, and what is held are the blocks of the result.
    """

    def __init__(self) -> None:
        self.after: dict[int, int | None] = {-1: None}  # -1 stands before the first block
        self.blocks: list[Any] = []
        self.where: dict[str, int] = {}
        self.snapshots, self.cursor = 0, -1

    def begin(self) -> None:
        """A snapshot follows."""
        self.snapshots, self.cursor = self.snapshots + 1, -1

    def add(self, block: Any, key: str) -> bool:
        """The snapshot's next block, and whether it was put in. All of the first snapshot's are."""
        if self.snapshots > 1 and key in self.where:
            self.cursor = self.where[key]
            return False
        at = len(self.blocks)
        self.blocks.append(block)
        self.after[at], self.after[self.cursor] = self.after[self.cursor], at
        self.cursor = self.where[key] = at
        return True

    def in_order(self) -> Iterator[Any]:
        i = self.after[-1]
        while i is not None:
            yield self.blocks[i]
            i = self.after[i]


def merge_snapshots(snapshots: list[list[dict[str, Any]]], size: int | None = SIGNATURE) -> list[dict[str, Any]]:
    """The blocks of all snapshots in one order."""
    merge = _Merge()
    for snapshot in snapshots:
        merge.begin()
        for block in snapshot:
            merge.add(block, _signature(block, size))
    return list(merge.in_order())


class _Fold:
    """A capture's snapshots, the largest first and the others in the order of time, merged as they come.

    With more than three snapshots and a merge over 5 % larger than the largest, the merge in the order of time counts, which is
    made beside the other; the largest, held until its time, takes part in both. A block is as large as its characters and two.
    """

    def __init__(self, snapshots: int, size: int | None) -> None:
        self.size, self.by_size = size, _Merge()
        self.keys: dict[str, str] = {}  # of the blocks of the result, by their JSON
        self.by_time = _Merge() if snapshots > 3 else None
        self.largest: list[tuple[str, str]] = []
        self.at = self.due = (False, 0)
        self.chars = self.largest_chars = 0
        self.visible: int | None = None
        self.unread = False

    def _place_largest(self) -> None:
        self.by_time.begin()
        for block, key in self.largest:
            self.by_time.add(block, key)
        self.largest = []
        self.due = None

    def add(self, snap: int | None, first: bool, blocks: list[str], told: list[Any] | None = None) -> None:
        """Blocks of a snapshot as JSON, with what they parse to where that is known; first tells those of the largest."""
        at = (snap is not None, snap or 0)
        if not self.by_size.snapshots or (not first and (at != self.at or self.by_size.snapshots == 1)):
            self.by_size.begin()
            if self.by_time and not first:
                if self.due is not None and at > self.due:
                    self._place_largest()
                self.by_time.begin()
            if first:
                self.due = at
        self.at = at
        for i, block in enumerate(blocks):
            key = self.keys.get(block)
            if key is None:
                key = _signature(told[i] if told else json.loads(block), self.size)
            if self.by_size.add(block, key):
                self.chars += len(block) + 2
                self.keys[block] = key
            if first:
                self.largest_chars += len(block) + 2
                if self.by_time:
                    self.largest.append((block, key))
            elif self.by_time:
                self.by_time.add(block, key)

    def result(self) -> tuple[Iterator[str], bool]:
        """The merged blocks and whether they are in the order of time."""
        if self.by_time and self.due is not None:
            self._place_largest()
        timed = self.by_time is not None and self.chars > 1.05 * self.largest_chars
        return (self.by_time if timed else self.by_size).in_order(), timed


def _folds(batches: Iterator[pa.RecordBatch], size: int | None) -> Iterator[tuple[str | None, _Fold]]:
    """Each capture with its fold. Rows (capture_id, snap_seq, first, snapshots, blocks as a JSON list or one block, score) come in the order of captures; a row is forgotten once it is merged."""
    now: tuple[str | None] | None = None
    for batch in batches:
        of_list = batch.schema.get_field_index("blocks") >= 0
        for i in range(batch.num_rows):
            capture, snap, first, n, text, score = (c[i].as_py() for c in batch.columns)
            if now is None or now[0] != capture:
                if now is not None:
                    yield now[0], fold
                now, fold = (capture,), _Fold(n, size)
            fold.unread |= text is None
            fold.visible = score if fold.visible is None else max(fold.visible, score if score is not None else fold.visible)
            fold.add(snap, first, *(_blocks_of(text or "[]") if of_list else ([text] if text else [],)))
    if now is not None:
        yield now[0], fold


def _in_order(snapshots: DataFrame, text: str, *within: str) -> DataFrame:
    """capture_id, snap_seq, first, snapshots, text, score in partitions of whole captures, the rows of each in the order that _Fold wants: one shuffle, sorts that spill."""
    rows = snapshots.withColumn("capture_id", F.col("capture_id").cast("string")).repartition("capture_id")
    of_snapshot, of_capture = Window.partitionBy("capture_id", "snap_seq"), Window.partitionBy("capture_id")
    sized = rows.withColumn("size", F.sum(F.coalesce(F.length(text) + 2, F.lit(0))).over(of_snapshot))
    time = F.coalesce(F.col("snap_seq").cast("long"), F.lit(-(1 << 62)))
    sized = sized.withColumn("largest", F.max(F.struct("size", -time)).over(of_capture)).withColumn("first", F.struct("size", -time) == F.col("largest"))
    known = sized.withColumn("snapshots", F.size(F.collect_set(time).over(of_capture)))
    return known.sortWithinPartitions("capture_id", F.desc("first"), time, *within).select("capture_id", F.col("snap_seq").cast("int"), "first", "snapshots", text, F.col("score").cast("long"))


#: Characters of merged pages that an Arrow batch holds; one page may have more.
HELD = 1 << 20
_PAGE = [("capture_id", pa.string()), ("blocks", pa.string()), ("visible", pa.int64()), ("reordered", pa.bool_()), ("unread", pa.bool_())]


def _pages(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _PAGE, strict=True)], names=[name for name, _ in _PAGE])


def merged_pages(snapshots: DataFrame, full_signature: bool = False) -> DataFrame:
    """capture_id, blocks (JSON list), visible, reordered, unread: snapshots (capture_id, snap_seq, blocks, score) merged.

    A snapshot without blocks counts as one; null blocks are those of a page that couldn't be read, which unread tells; visible
    is the highest score. Snapshots are merged one by one as they come, sorted; a task holds the merged blocks of one capture and
    a few snapshots. Repeated rows change nothing but the first snapshot's own; an empty table gives none.
    """
    size = None if full_signature else SIGNATURE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0
        for capture, fold in _folds(batches, size):
            blocks, timed = fold.result()
            held.append((capture, f"[{', '.join(blocks)}]", fold.visible, timed, fold.unread))
            chars += len(held[-1][1])
            if chars >= HELD:
                yield _pages(held)
                held, chars = [], 0
        if held:
            yield _pages(held)

    return _in_order(snapshots, "blocks").mapInArrow(run, "capture_id string, blocks string, visible long, reordered boolean, unread boolean")


#: Rows of a result's Arrow batch.
ROWS = 1000


def merged_captures(snapshots: DataFrame, full_signature: bool = False) -> DataFrame:
    """capture_id, pos, block (JSON), reordered: snapshots (capture_id, snap_seq, ord, block) merged.

    See _Fold for their order. Null blocks are none; rows of later snapshots that repeat count once for their signature;
    captures without rows have no blocks. Blocks are merged one by one as they come, sorted; a task holds the merged blocks of
    one capture.
    """
    size = None if full_signature else SIGNATURE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for capture, fold in _folds(batches, size):
            blocks, timed = fold.result()
            for n, some in enumerate(iter(lambda: list(islice(blocks, ROWS)), [])):
                k = len(some)
                own = [json.dumps(json.loads(b), ensure_ascii=False) for b in some]
                columns = [pa.array([capture] * k, pa.string()), pa.array(range(n * ROWS + 1, n * ROWS + k + 1), pa.int32()), pa.array(own, pa.string()), pa.array([timed] * k, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["capture_id", "pos", "block", "reordered"])

    rows = _in_order(snapshots.withColumn("score", F.lit(None)), "block", "ord", "block")
    return rows.mapInArrow(run, "capture_id string, pos int, block string, reordered boolean")


def chosen_method(candidates: DataFrame) -> DataFrame:
    """capture_id, method, coverage, warning from the text of two candidates (capture_id, dom_text, network_text).

    The network's is taken if there is no other, or if it has 90 % of the other's
    words and no fewer than 90 % as many; null texts are missing candidates. Repeated
    rows are judged each.
    """
    has_n = F.col("network_text").isNotNull()
    # without a network's text nothing depends on the words of the page's
    words = candidates.withColumn("d", F.when(has_n, word_set(F.coalesce("dom_text", F.lit("")))).otherwise(F.array().cast("array<string>")))
    words = words.withColumn("n", F.when(has_n, word_set(F.col("network_text"))).otherwise(F.array().cast("array<string>")))
    has_d = F.size("d") > 0
    share = F.size(F.array_intersect("d", "n")) / F.size("d")
    method = F.when(~has_n, "dom").when(~has_d, "network").when((share >= 0.9) & (F.size("n") >= 0.9 * F.size("d")), "network").otherwise("dom")
    rounded = F.when(has_d & (F.size("n") > 0), coverage(F.col("d"), F.col("n")))
    warning = F.when((method == "dom") & has_n & has_d & (share >= 0.5), "network_mismatch")
    return words.select("capture_id", method.alias("method"), rounded.alias("coverage"), warning.alias("warning"))


def preferred_tree(candidates: DataFrame) -> DataFrame:
    """capture_id, method: the network's tree (network_size) unless the page's (dom_size) is over a fifth larger."""
    method = F.when(F.col("network_size").isNull(), "dom").when(F.col("dom_size").isNull(), "network").when(F.col("dom_size") > 1.2 * F.col("network_size"), "dom").otherwise("network")
    return candidates.select("capture_id", method.alias("method"))


def failures(captures: DataFrame) -> DataFrame:
    """capture_id, kind, reason for captures (capture_id, kind, page_url, blocks, chars, nodes, tree_size, questions) without enough content."""
    sign_in = F.coalesce(F.col("page_url"), F.lit("")).contains("accounts.")
    short = (F.col("kind") == "report") & ((F.coalesce("blocks", F.lit(0)) == 0) | (F.coalesce("chars", F.lit(0)) < 80))
    small = (F.col("kind") == "mindmap") & (F.coalesce("nodes", F.lit(0)) < 3) & (F.coalesce("tree_size", F.lit(0)) < 4)
    none = (F.col("kind") == "quiz") & (F.coalesce("questions", F.lit(0)) < 1)
    reason = F.when(sign_in, "sign_in").when(short, "too_short").when(small, "too_few_nodes").when(none, "no_questions")
    return captures.withColumn("reason", reason).where("reason is not null").select("capture_id", "kind", "reason")


def best_by(rows: DataFrame, by: str, score: str, order: str, value: str) -> DataFrame:
    """by, value, score of the row with the highest score, the first by order of equal ones: one aggregation with partial sums."""
    top = F.struct(F.col(score), -F.col(order))
    return rows.groupBy(by).agg(F.max_by(value, top).alias(value), F.max(score).alias(score))


def stable_since(rows: DataFrame, by: str, order: list[str], value: str, within: float = 5, least: float = 400) -> DataFrame:
    """rows with stable: whether the last three values lie within a range and the present one is large enough."""
    last = Window.partitionBy(by).orderBy(*order).rowsBetween(-2, 0)
    steady = (F.count(value).over(last) == 3) & (F.max(value).over(last) - F.min(value).over(last) <= within)
    return rows.withColumn("stable", steady & (F.col(value) >= least))


def first_of_signature(rows: DataFrame, text: str, order: str, size: int = SIGNATURE) -> DataFrame:
    """Of rows whose text begins alike, the first by order: the beginning's hash is grouped, texts are not shuffled."""
    key = F.sha2(F.substring(text, 1, size), 256).alias("signature")
    return rows.select(key, F.col(order).alias(order)).groupBy("signature").agg(F.min(order).alias(order), F.count("*").alias("copies"))
