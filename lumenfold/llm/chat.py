"""Chat formatting at the level of tokens.

Each segment of a conversation is encoded by itself and reserved ids, which lie
beyond the vocabulary, are spliced between segments, so no text can ever make a
control token. Control strings that occur inside texts are escaped as well, which
keeps the rendering as text reversible: backslashes are doubled, and a single one
goes after the first character of each control string.

The template, one line a turn:
    system     [SYS]text[/SYS]
    user       [INST]text[/INST]
    assistant  [OUT]text</s>
    any other  [ROLE]role[/ROLE]text[/TURN]
<s> stands before the first turn only. The loss mask covers the text of assistant
turns, not their marks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.scratch import small_batches

#: The template's control strings; a reserved id is the size of the vocabulary plus one's place here.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]", "[/TURN]"]
#: role -> the marks before and after its text.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}

_CONTROL = regex.compile("|".join(regex.escape(c) for c in CONTROL))
_ESCAPED = regex.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """text with no control string in it."""
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class Encoder:
    """A byte-level vocabulary given as ranks, and the reserved ids beyond it."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.reserved = {c: self.size + i for i, c in enumerate(CONTROL)}

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """The ids of one turn, and where its text begins and ends in them."""
        plain = self.encoding.encode_ordinary
        before, after = MARKS.get(role, ("[/ROLE]", "[/TURN]"))
        head = [] if role in MARKS else [[self.reserved["[ROLE]"]], plain(escape(role))]
        segments = [*head, [self.reserved[before]], plain(escape(text)), [self.reserved[after]]]
        ends = np.cumsum([len(s) for s in segments])
        return np.concatenate([np.asarray(s, np.int32) for s in segments]), int(ends[-3]), int(ends[-2])

    def words(self, ids: np.ndarray) -> str:
        """The text of ordinary ids."""
        return self.encoding.decode(ids.tolist()) if len(ids) else ""

    def text(self, ids: np.ndarray) -> str:
        """The rendering of ids, reserved ones as their control strings."""
        return "".join(CONTROL[s[0] - self.size] if s[0] >= self.size else self.encoding.decode(s.tolist()) for s in self.split(ids))

    def split(self, ids: np.ndarray) -> list[np.ndarray]:
        """Runs of ordinary ids, and reserved ids one by one."""
        high = ids >= self.size
        cuts = np.flatnonzero(high[1:] | high[:-1]) + 1 if len(ids) else []
        return [s for s in np.split(ids, cuts) if len(s)]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists one after another, and where each list begins, with the end."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


_encoders: dict[tuple[str, str], Encoder] = {}


def load(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def formatted(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, seq, start, ids, loss: the tokens of each turn in its place, conversations sorted within partitions.

    seq counts a conversation's turns from 0, start is the turn's first token in
    it, and loss marks the tokens that are learnt. Rows are encoded where they lie;
    only ids are shuffled, and a conversation is put together as a stream of its
    turns, so one of any length needs little memory.

    Turns come in the order of turn, then role, then a digest of the text; a null turn comes first.
    Null roles and texts count as empty. Repeated rows are turns of their own. Rows
    with a null conv_id form one conversation. An empty table gives an empty
    result; other columns are ignored.
    """
    small_batches(conversations.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            rows = [encoder.turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ids, first, last = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["conv_id", "turn", "role", "text", "ids", "first", "last"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        opening, learnt = encoder.reserved["<s>"], encoder.reserved[MARKS["assistant"][0]]
        now: tuple | None = None  # the conversation that is open, its turns and tokens so far
        seq = at = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, null = batch.column(0).fill_null(0).to_numpy(), np.array(batch.column(0).is_null())
            new = np.ones(n, bool)
            new[1:] = (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])
            new[0] = (conv[0], null[0]) != now
            flat, offsets = _lists(batch.column(1))
            begins = np.flatnonzero(new)
            group = np.cumsum(new) - 1  # -1: goes on from the batch before
            sizes = np.diff(offsets) + new
            ends = np.cumsum(sizes)
            places = ends - sizes
            seqs = np.arange(n) - np.where(group >= 0, begins[group] if len(begins) else 0, -seq)
            starts = places - np.where(group >= 0, places[begins][group] if len(begins) else 0, -at)
            change = np.zeros(ends[-1] + 1, np.int8)  # prefix sums of which are the mask
            told = flat[offsets[:-1]] == learnt
            np.add.at(change, (places + new + batch.column(2).to_numpy())[told], 1)
            np.add.at(change, (places + new + batch.column(3).to_numpy())[told], -1)
            bounds = pa.array(np.append(0, ends), pa.int32())
            ids = pa.ListArray.from_arrays(bounds, pa.array(np.insert(flat, offsets[:-1][new], opening), pa.int32()))
            loss = pa.ListArray.from_arrays(bounds, pa.array(np.cumsum(change[:-1]).astype(bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.int64()), pa.array(starts, pa.int64()), ids, loss], names=["conv_id", "seq", "start", "ids", "loss"])
            now, seq, at = (conv[-1], null[-1]), int(seqs[-1]) + 1, int(starts[-1] + sizes[-1])

    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    coded = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids array<int>, first int, last int")
    # The digest breaks ties without carrying every text through the shuffle.
    coded = coded.select("conv_id", "turn", "role", F.sha2("text", 256).alias("tie"), "ids", "first", "last")
    dealt = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return dealt.select("conv_id", "ids", "first", "last").mapInArrow(assemble, "conv_id long, seq long, start long, ids array<int>, loss array<boolean>")


def read_back(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from what formatted() returns.

    Turns are parsed from ids alone: marks give the role, the rest is decoded and
    unescaped. turns_sha256 is of role, \\n, text, \\n of each turn; loss_sha256 of
    the text under the loss mask; formatted_chars counts the rendering.
    """
    roles = {before: role for role, (before, _) in MARKS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        done: list[tuple] = []
        now, open_ = None, False
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close() -> None:
            if open_:
                done.append((now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        for batch in batches:
            (ids, offsets), (mask, _) = _lists(batch.column(3)), _lists(batch.column(4))
            marks = np.flatnonzero(ids >= encoder.size)
            of_turn = np.searchsorted(marks, offsets)
            under = np.append(0, np.cumsum(mask))
            for i, (conv, seq) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if not seq:
                    close()
                    now, open_ = conv, True
                    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                at = marks[of_turn[i] : of_turn[i + 1]].tolist()
                texts = {}
                for here, after in zip(at, [*at[1:], int(offsets[i + 1])], strict=True):
                    mark, shown = CONTROL[ids[here] - encoder.size], encoder.words(ids[here + 1 : after])
                    texts[mark] = unescape(shown), here + 1, after
                    counts[2] += len(mark) + len(shown)
                before = next(m for m in texts if m != "<s>")
                text, begin, end = texts[before if before in roles else "[/ROLE]"]
                role = roles[before] if before in roles else texts["[ROLE]"][0]
                turns.update(f"{role}\n{text}\n".encode())
                a, b = offsets[i], offsets[i + 1]
                if under[b] > under[a]:
                    # the tokens under the mask, which are decoded anew unless they are just the turn's text
                    whole = under[end] - under[begin] == under[b] - under[a] == end - begin
                    learnt = text if whole else unescape(encoder.words(ids[a:b][mask[a:b]]))
                    loss.update(learnt.encode())
                    counts[1] += len(learnt)
                counts[0] += 1
            if len(done) >= 1000:
                yield out()
        close()
        if done:
            yield out()

    return tokens.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
