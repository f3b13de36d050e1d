"""The batch operators over arriving captures."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.operators import json_mining, reconcile
from lumenfold.sources.captures import bodies_for
from lumenfold.sources.tables import shared_dir


def distinct_questions(questions: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """Each question of a capture once, whatever the order of arrival; state older than the watermark goes."""
    return questions.withWatermark(time, late).dropDuplicatesWithinWatermark(["capture_id", "number"])


def best_markdown(bodies: DataFrame) -> DataFrame:
    """The best Markdown of each capture so far; for output mode update or complete."""
    return json_mining.markdown_of_captures(bodies_for(bodies, "report"))


def best_tree(bodies: DataFrame) -> DataFrame:
    """The largest tree of each capture so far; for output mode update or complete."""
    return json_mining.trees_of_captures(bodies_for(bodies, "map"))


def windowed_counts(events: DataFrame, time: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each window of time; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: Rows of a batch's result that are made at a time. The rows of one capture in one batch are few numbers each and are sorted in memory.
CHUNK = 10_000


class _Merged(StatefulProcessor):
    """Keeps the merged blocks of a capture's snapshots."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "blocks string, snapshots int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known, n = self.known.get() if self.known.exists() else ("[]", 0)
        merged = json.loads(known)
        new = sorted((int(s), b) for part in rows for s, b in zip(part["snap_seq"], part["blocks"], strict=True))
        for _, blocks in new:
            merged = reconcile.merge_snapshots([merged, json.loads(blocks or "[]")])
        known, n = json.dumps(merged, ensure_ascii=False), n + len(new)
        self.known.update((known, n))
        yield pd.DataFrame({"capture_id": [key[0]], "blocks": [known], "snapshots": [n]})

    def close(self) -> None:
        return


def late_content(snapshots: DataFrame) -> DataFrame:
    """capture_id, blocks, snapshots: the blocks of each capture's snapshots (capture_id, snap_seq, blocks as a JSON list) so far, as they arrive.

    A snapshot is merged into what is known; a null one adds nothing. For output mode update.
    """
    grouped = snapshots.select("capture_id", "snap_seq", "blocks").groupBy("capture_id")
    return grouped.transformWithStateInPandas(_Merged(), "capture_id string, blocks string, snapshots int", "update", "none")


class _Steady(StatefulProcessor):
    """Keeps the last three values of a capture."""

    def __init__(self, within: float, least: float) -> None:
        self.within, self.least = within, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "values array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        values = list(self.last.get()[0]) if self.last.exists() else []
        waiting: list[tuple[int, float]] = []
        for part in rows:
            waiting += zip(part["seq"].tolist(), part["score"].tolist(), strict=True)
        waiting.sort()
        for begin in range(0, len(waiting), CHUNK):
            out = []
            for seq, score in waiting[begin : begin + CHUNK]:
                values = [*values, score][-3:]
                steady = len(values) == 3 and max(values) - min(values) <= self.within and values[-1] >= self.least
                out.append((key[0], seq, score, steady))
            yield pd.DataFrame(out, columns=["capture_id", "seq", "score", "stable"])
        self.last.update((values,))

    def close(self) -> None:
        return


def stable_scores(scores: DataFrame, within: float = 5, least: float = 400) -> DataFrame:
    """scores (capture_id, seq, score) with stable: whether the last three lie within a range and the present one is large enough."""
    grouped = scores.select("capture_id", "seq", "score").groupBy("capture_id")
    return grouped.transformWithStateInPandas(_Steady(within, least), "capture_id string, seq long, score double, stable boolean", "update", "none")


#: Seconds that a capture may take to settle.
DEADLINE = 120


class _Settling(StatefulProcessor):
    """Keeps when a capture was first seen and its last three values; a timer ends the wait and forgets it."""

    def __init__(self, within: float, least: float, deadline: float, by_event: bool) -> None:
        self.within, self.least, self.deadline, self.by_event = within, least, int(deadline * 1000), by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "due long, values array<double>, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        waiting = sorted(x for part in rows for x in zip(part["ms"].tolist(), part["seq"].tolist(), part["score"].tolist(), strict=True))
        if self.seen.exists():
            due, values, told = self.seen.get()
            values = list(values)
        else:
            begin = waiting[0][0] if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            due, values, told = begin + self.deadline, [], False
            self.handle.registerTimer(due)
        for at, seq, score in waiting:
            if told:
                break
            if self.by_event and at >= due:
                told = True
                yield self._row(key, "timed_out", due, None, values)
                break
            values = [*values, score][-3:]
            if len(values) == 3 and max(values) - min(values) <= self.within and score >= self.least:
                told = True
                yield self._row(key, "stable", at, seq, values)
        self.seen.update((due, values, told))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            due, values, told = self.seen.get()
            self.seen.clear()
            if not told:
                yield self._row(key, "timed_out", due, None, list(values))

    @staticmethod
    def _row(key: tuple, state: str, at: int, seq: int | None, values: list[float]) -> pd.DataFrame:
        score = values[-1] if values else None
        return pd.DataFrame({"capture_id": [key[0]], "state": [state], "at_ms": [at], "seq": pd.array([seq], "Int64"), "score": pd.array([score], "Float64")})

    def close(self) -> None:
        return


def settled(scores: DataFrame, within: float = 5, least: float = 400, deadline: float = DEADLINE, clock: str = "event", late: str = "10 seconds") -> DataFrame:
    """capture_id, state, at_ms, seq, score: of each capture one row, when it is stable or when it has had its time.

    scores are (capture_id, at, seq, score). A capture is stable with its first row, in the order of at and seq, whose score is
    large enough and whose last three scores lie within a range. Otherwise it is timed_out `deadline` seconds after its first
    row, with its last score: by the clock of events once the watermark (`late` behind the latest row of all) has passed, or a
    later row of its own has come; by the clock of processing then and there, whether rows come or not. With that its state
    goes, so state is bounded by the captures of one deadline; a capture that goes on after it is watched anew. Null scores and
    times are no rows. For output mode append or update.
    """
    if clock not in ("event", "processing"):
        raise ValueError(f"no such clock: {clock}")
    rows = scores.select("capture_id", "at", F.unix_millis("at").alias("ms"), "seq", "score").where("at is not null and score is not null and seq is not null")
    rows = rows.withWatermark("at", late) if clock == "event" else rows
    schema = "capture_id string, state string, at_ms long, seq long, score double"
    mode = "eventTime" if clock == "event" else "processingTime"
    return rows.groupBy("capture_id").transformWithStateInPandas(_Settling(within, least, deadline, clock == "event"), schema, "append", mode)


def run_through(df: DataFrame, mode: str, stateful: bool = False) -> DataFrame:
    """What a stream gives once all files that are there have been read.

    All rows go to a table in the folder that spark.checkpoint.dir names, and so do
    offsets and state: appended rows by the file sink, those of an update batch by batch
    (a batch that is done again replaces itself); of a complete result the last batch
    counts. stateful processors keep their state in RocksDB while the stream runs.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/lumenfold-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{base}/rows")
    else:
        writer = writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/rows/{'' if mode == 'complete' else f'batch={batch}'}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if stateful:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer.start().awaitTermination()
    finally:
        if stateful and before is None:
            spark.conf.unset(key)
        elif stateful:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(f"{base}/rows").select(df.columns)
