"""Language-model scoring: corpus counts, a gated recurrent network and its class-factored softmax.

1. One pass cuts the documents into blocks of about BLOCK tokens. Of each block
   the distinct word hashes, their counts in training documents and the sequence
   of word numbers are written.
2. Hashes and counts, not tokens, are shuffled by ranges of the hash. Each range
   is summed over all blocks, and every block gets its words' corpus counts back.
3. The most frequent words are the network's own; all others fall into tail
   classes by their count, within which a word's probability is its smoothed share
   of the class. The network is trained on all training documents, each once, by
   truncated backpropagation; a word's count without its own document decides its
   class there, so that it learns how often words are new. Documents are dealt by a
   hash of themselves to ROUNDS rounds of courses, as many as the corpus has tokens
   for; in a round every course goes on from the round's network over its documents,
   and the courses' networks are averaged by their tokens, a few at a time. Files and
   tasks have no part in that, so the same rows teach the same network.
4. Each block is scored with its counts. Many documents run side by side; their
   states are carried from window to window until a document ends.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.samples import fold
from lumenfold.llm.scratch import Scratch, small_batches
from lumenfold.llm.words import Texts, chunks, tidy

#: Tokens of a block, and bytes of hashes and counts that a range of hashes may have.
BLOCK, RANGE_BYTES = 500_000, 16_000_000
#: Pieces that the parameters are averaged in.
PIECES = 64
#: Words of the network's own, words in each of their classes, hidden units.
HEAD, CLASS, HIDDEN = 1024, 32, 24
#: Documents side by side and steps of a window, in scoring and in training; tokens after which training starts a state afresh.
LANES, WINDOW, TRAIN_LANES, TRAIN_WINDOW, TRAIN_LONGEST = 128, 64, 128, 24, 2048
#: Rounds of training, tokens of a course (on average, at most), and courses whose networks are summed in one group.
ROUNDS, COURSE, FAN = 4, 1_000_000, 32
#: Tokens after which training takes TRAIN_LANES documents side by side; up to then FIRST_LANES, for more steps.
FIRST_TOKENS, FIRST_LANES = 400_000, 16
#: Equal rows of a block that are dealt to one course.
REPEATS = 8
#: The learning rate, and what keeps its divisor from zero.
RATE, TINY = np.float32(0.1), np.float32(1e-10)
#: Most classes of the tail: none, 1, 2, 3, 4, 5-6, 7-8, ...: two for each doubling, up to the least count of the network's own words.
TAIL = 64
#: The hash that stands for the end of a document.
END = np.uint64(1)

_BLOCKS = "block long, doc_ids binary, held binary, lens binary, ids binary, hashes binary, counts binary, n long, learnt long"
_ANSWERS = "block long, part int, counts binary, v long, n long, mass array<double>, head array<long>, head_counts array<long>"


def tail_class(c: np.ndarray) -> np.ndarray:
    """The tail class of a count."""
    c = np.asarray(c, np.int64)
    small = np.minimum(c, 4)
    e = np.log2(np.maximum(c, 4) - 0.5)
    return np.where(c <= 4, small, np.minimum(1 + np.floor(2 * e + 1e-9).astype(np.int64), TAIL - 1))


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(b: bytes | None, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if b else np.zeros(0, kind)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and the place of each number among them; only distinct ones are sorted."""
    coded = pa.array(x).dictionary_encode()
    found, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[place]


def _blocks(docs: DataFrame) -> DataFrame:
    """The blocks of docs (doc_id, rest, text): rest is 1 for held-out documents, 2 for those that are not learnt from either."""

    def block(number: int, ids: list[Any], rest: list[int], words: list[np.ndarray]) -> pa.RecordBatch:
        lens = np.array([len(w) for w in words], np.int64)
        distinct, place = _distinct(np.concatenate(words))
        learnt = np.repeat(np.array(rest) == 0, lens)
        counts = np.bincount(place[learnt], minlength=len(distinct)).astype(np.int32)
        null = np.array([i is None for i in ids])
        known = np.array([0 if i is None else i for i in ids], np.int64)
        row = [number, known.tobytes(), (np.array(rest, np.int8) + 4 * null).astype(np.int8).tobytes(), lens.tobytes(), _pack(place.astype(np.int32)), distinct.tobytes(), _pack(counts), len(distinct), int(learnt.sum())]
        kinds = [pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["block", "doc_ids", "held", "lens", "ids", "hashes", "counts", "n", "learnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, rest, words, size = [], [], [], 0
        for batch in batches:
            for part in chunks(batch):
                texts = Texts(part.column(2))
                hashes = texts.hashes()
                for i, (d, r) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    ids.append(d)
                    rest.append(r)
                    words.append(np.append(hashes[texts.at[i] : texts.at[i + 1]], END))
                    size += len(words[-1])
                    if size >= BLOCK:
                        yield block(number, ids, rest, words)
                        number += 1
                        ids, rest, words, size = [], [], [], 0
        if ids:
            yield block(number, ids, rest, words)
        tidy()

    return docs.mapInArrow(run, _BLOCKS)


def _answers(blocks: DataFrame, parts: int) -> DataFrame:
    """For every block and range of hashes the corpus counts of the block's words, and for every range its sums (block -1)."""
    shift = np.uint64(64 - (parts - 1).bit_length())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw, packed, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, counts = np.frombuffer(raw, np.uint64), _unpack(packed, n, np.int32)
                part = (hashes >> shift).astype(np.int64) if parts > 1 else np.zeros(n, np.int64)
                cuts = np.searchsorted(part, np.arange(parts + 1))
                some = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
                rows = [[number] * len(some), some, [hashes[cuts[p] : cuts[p + 1]].tobytes() for p in some], [counts[cuts[p] : cuts[p + 1]].tobytes() for p in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=["block", "part", "hashes", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
        counts = [np.frombuffer(b, np.int32) for b in table.column("counts").to_pylist()]
        distinct, place = _distinct(np.concatenate(own))
        total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x) for x in own])
        back = [_pack(total[place[e - len(x) : e]]) for x, e in zip(own, ends, strict=True)]
        mass = np.bincount(tail_class(total), total + 0.5, TAIL)
        mass[0] = 0.0
        top = np.lexsort((distinct, -total))[:HEAD]
        top = top[total[top] > 0]
        n = len(own)
        part = table.column("part").to_pylist()
        columns = [
            [*table.column("block").to_pylist(), -1],
            [*part, part[0]],
            [*back, None],
            [None] * n + [int((total > 0).sum())],
            [None] * n + [int(total.sum())],
            [None] * n + [mass.tolist()],
            [None] * n + [distinct[top].view(np.int64).tolist()],
            [None] * n + [total[top].tolist()],
        ]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "part", "counts", "v", "n", "mass", "head", "head_counts"])

    cuts = blocks.select("block", "hashes", "counts", "n").mapInArrow(cut, "block long, part int, hashes binary, counts binary")
    return cuts.groupBy("part").applyInArrow(answer, _ANSWERS)


class Vocabulary:
    """The network's own words (by hash, in order of their counts), the corpus's sums, and the tail classes."""

    def __init__(self, head: np.ndarray, head_counts: np.ndarray, v: int, n: int, mass: np.ndarray) -> None:
        self.v, self.n, self.mass, self.head_counts = v, n, mass, head_counts
        self.order = np.argsort(head)
        self.sorted = head[self.order]
        self.classes = max(1, -(-len(head) // CLASS))
        self.tails = int(tail_class(head_counts[-1:])[0]) + 1 if len(head) == HEAD else 1
        self.inputs = len(head) + self.tails + 1  # the last is the start of a document
        self.size = len(head)

    def symbols(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The symbol of each word: its place among the network's own, or its tail class after them."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), max(len(self.sorted) - 1, 0))
        own = self.sorted[at] == hashes if len(self.sorted) else np.zeros(len(hashes), bool)
        return np.where(own, self.order[at] if len(self.sorted) else 0, self.size + tail_class(counts)).astype(np.int64)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """The smoothed unigram log10 probability of words."""
        return np.log10((counts + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def prior(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the shares of all classes, and of the words in each class of the network's own.

        What a text holds of words with a count of c is about what the corpus holds of
        words with one more, so words seen once tell how often words are new.
        """
        own = np.zeros(self.classes * CLASS)
        own[: self.size] = self.head_counts
        own = own.reshape(self.classes, CLASS)
        tail = self.mass.copy()
        for c in range(4):
            tail[c] = (c + 1) * self.mass[c + 1] / (c + 1.5)
        share = np.concatenate([own.sum(1), tail[: self.tails]]) + 0.5
        words = (own + 1e-6) / (own.sum(1, keepdims=True) + 1e-6 * CLASS)
        return np.log(share / share.sum()), np.log(words)

    def within(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The natural logarithm of a tail word's share of its class; new words are taken to be as many as known ones."""
        tail = np.maximum(symbols - self.size, 0)
        share = np.where(tail > 0, (counts + 0.5) / np.maximum(self.mass[tail], counts + 0.5), 1 / (self.v + 1))
        return np.where(symbols >= self.size, np.log(share), 0.0)


def _lanes(lens: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first, each to the lane with the least so far; lanes by falling length."""
    import heapq

    out: list[list[int]] = [[] for _ in range(min(lanes, max(len(lens), 1)))]
    heap = [(0, i) for i in range(len(out))]
    for d in np.argsort(-lens, kind="stable").tolist():
        size, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (size + int(lens[d]), i))
    return sorted(out, key=lambda own: -int(lens[own].sum()) if own else 0)


def _grid(symbols: np.ndarray, lens: np.ndarray, lanes: int, start: int, longest: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lanes as columns: positions of tokens (-1 beyond the end), the symbol before each, where states begin, and lengths.

    States begin with documents; with longest, also within them after so many tokens.
    """
    first = np.cumsum(lens) - lens
    before = np.concatenate([[start], symbols[:-1]])
    before[first] = start
    if longest and len(lens) and lens.max() > longest:
        lens = np.concatenate([np.full(-(-n // longest), longest) - np.append(np.zeros(-(-n // longest) - 1, np.int64), -n % longest) for n in lens])
        first = np.cumsum(lens) - lens
    dealt = _lanes(lens, lanes)
    sizes = np.array([int(lens[own].sum()) if own else 0 for own in dealt])
    at = np.full((int(sizes.max()), len(dealt)), -1, np.int64)
    for i, own in enumerate(dealt):
        if own:
            at[: sizes[i], i] = np.concatenate([np.arange(first[d], first[d] + lens[d]) for d in own])
    begins = np.zeros(len(symbols), bool)
    begins[first] = True
    return at, np.where(at >= 0, before[at], start).astype(np.int16), (at >= 0) & begins[at], sizes


class Network:
    """A gated recurrent unit over symbols; the softmax is factored into classes and words of a class.

    Arrays of a window have units before lanes, so that every step works on whole rows.
    """

    def __init__(self, vocabulary: Vocabulary, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, vocabulary.classes
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"x": f(vocabulary.inputs, 3 * h), "u": f(h, 3 * h), "c": f(h, k + vocabulary.tails), "w": f(k, h, CLASS)}
        classes, words = vocabulary.prior()  # training starts from the corpus's shares
        self.p |= {"cb": classes.astype(np.float32), "wb": words.astype(np.float32)}
        used = np.arange(k * CLASS).reshape(k, CLASS) < vocabulary.size
        self.p["wb"][~used] = -1e4

    def classes(self, symbols: np.ndarray) -> np.ndarray:
        size = self.vocabulary.size
        return np.where(symbols < size, symbols // CLASS, self.vocabulary.classes + symbols - size)

    def run(self, before: np.ndarray, begins: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The states of a window (steps x units x lanes), from the state h (units x lanes) that is carried in.

        keep gets the gates (reset, update, new), the states before each step, and the
        recurrent part of new before its gate.
        """
        k = HIDDEN
        x, u = np.ascontiguousarray(np.take(self.p["x"], before, 0).transpose(0, 2, 1)), np.ascontiguousarray(self.p["u"].T)
        out = np.empty((len(before), k, before.shape[1]), x.dtype)
        a = np.empty_like(x if keep is not None else x[:1])
        part, first = np.empty_like(out[0]), h
        fresh, goes_on = begins.any(1), (~begins).astype(x.dtype)
        np.negative(x[:, : 2 * k], x[:, : 2 * k])
        np.negative(u[: 2 * k], u[: 2 * k])
        with np.errstate(over="ignore"):  # a gate whose exponential is infinite is 0
            for t in range(len(before)):
                if fresh[t]:
                    h = h * goes_on[t]
                own = np.matmul(u, h, out=a[t if keep is not None else 0])
                gates, new, d = x[t, : 2 * k], x[t, 2 * k :], out[t]
                gates += own[: 2 * k]
                np.exp(gates, gates)
                gates += 1
                np.reciprocal(gates, gates)
                np.multiply(own[2 * k :], gates[:k], part)
                new += part
                np.tanh(new, new)
                np.subtract(h, new, d)
                d *= gates[k:]
                d += new
                h = d
        if keep is not None:
            prev = np.concatenate([first[None], out[:-1]])
            for t in np.flatnonzero(fresh):
                prev[t][:, begins[t]] = 0
            keep += [x, prev, a[:, 2 * k :], fresh]
        return out

    def _by_class(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of tokens by class, and where each of the classes of the network's own words begins in it."""
        order = np.argsort(classes.astype(np.int16), kind="stable")
        return order, np.searchsorted(classes[order], np.arange(self.vocabulary.classes + 1))

    def log_probabilities(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The natural logarithm of each symbol's probability in its state (a column of states)."""
        classes, n = self.classes(symbols), np.arange(len(symbols))
        order, cuts = self._by_class(classes)
        own = _with_ones(states, order)
        logits = _logits(*_joined(self.p["c"], self.p["cb"]), own)
        some = logits[classes[order], n]
        some -= np.log(np.exp(logits, logits).sum(0))
        inner = self._words(own, cuts)
        some[: cuts[-1]] += inner[symbols[order[: cuts[-1]]] % CLASS, n[: cuts[-1]]] - np.log(np.exp(inner).sum(0))
        out = np.empty_like(some)
        out[order] = some
        return out

    def _words(self, own: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The logits of the words in each token's class, tokens (columns of own) in order of their classes."""
        weights, safe = _joined(self.p["w"], self.p["wb"])
        out = np.empty((CLASS, cuts[-1]), own.dtype)
        for c in range(self.vocabulary.classes):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                np.matmul(weights[c].T, own[:, a:b], out=out[:, a:b])
                if not safe[c]:
                    out[:, a:b] -= out[:, a:b].max(0)
        return out

    def score(self, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The natural logarithm of the probability of each token's symbol, documents one after another."""
        at, before, begins, sizes = _grid(symbols, lens, LANES, self.vocabulary.inputs - 1)
        out = np.zeros(len(symbols))
        h = np.zeros((HIDDEN, at.shape[1]), np.float32)
        for t in range(0, len(at), WINDOW):
            live = int((sizes > t).sum())  # lanes are sorted by length
            states = self.run(before[t : t + WINDOW, :live], begins[t : t + WINDOW, :live], h[:, :live])
            h = states[-1]
            here = at[t : t + WINDOW, :live].ravel()
            flat, some = states.transpose(1, 0, 2).reshape(HIDDEN, -1), here >= 0
            if not some.all():
                flat, here = flat[:, some], here[some]
            out[here] = self.log_probabilities(flat, symbols[here])
        return out

    def train(self, symbols: np.ndarray, lens: np.ndarray, squares: dict[str, np.ndarray], lanes: int = TRAIN_LANES) -> Network:
        """Truncated backpropagation through windows, once over documents; states are carried over, gradients are not.

        Every parameter's rate falls with the sum of its gradient's squares so far. Of
        the symbols' parameters only those of symbols in the window change.
        """
        at, before, begins, sizes = _grid(symbols, lens, lanes, self.vocabulary.inputs - 1, TRAIN_LONGEST)
        h = np.zeros((HIDDEN, at.shape[1]), np.float32)
        for t in range(0, len(at), TRAIN_WINDOW):
            live = int((sizes > t).sum())
            rows = slice(t, t + TRAIN_WINDOW)
            grads, h = self._gradients(at[rows, :live], before[rows, :live], begins[rows, :live], symbols, h[:, :live])
            seen, g = grads.pop("x")
            total = squares["x"][seen]
            self.p["x"][seen] -= _step(g, total)
            squares["x"][seen] = total
            for k, g in grads.items():
                self.p[k] -= _step(g, squares[k])
        return self

    def _gradients(self, at: np.ndarray, before: np.ndarray, begins: np.ndarray, symbols: np.ndarray, h: np.ndarray) -> tuple[dict[str, Any], np.ndarray]:
        """Gradients of a window's mean loss, those of x as (symbols, rows), and the state that is carried on."""
        k, p, kept = HIDDEN, self.p, []
        states = self.run(before, begins, h, kept)
        x, prev, inner, fresh = kept
        here = at.ravel()
        some = np.flatnonzero(here >= 0)
        goal = symbols[here[some]]
        classes, n, scale = self.classes(goal), np.arange(len(goal)), states.dtype.type(1 / max(len(goal), 1))
        order, cuts = self._by_class(classes)
        heads, place = int(cuts[-1]), some[order]
        own = _with_ones(states.transpose(1, 0, 2).reshape(k, -1), place)

        def errors(logits: np.ndarray, right: np.ndarray) -> np.ndarray:
            e = np.exp(logits, logits)
            e *= scale / e.sum(0)
            e[right, n[: len(right)]] -= scale
            return e

        e = errors(_logits(*_joined(p["c"], p["cb"]), own), classes[order])
        g_classes, g_words = own @ e.T, np.zeros((len(p["w"]), k + 1, CLASS), own.dtype)
        d_own = np.zeros((k, len(goal) + 1), own.dtype)  # the last column is for places without a token
        np.matmul(p["c"], e, out=d_own[:, :-1])
        f, d_head = errors(self._words(own, cuts), goal[order[:heads]] % CLASS), np.empty((k, heads), own.dtype)
        for c in range(self.vocabulary.classes):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                np.matmul(own[:, a:b], f[:, a:b].T, out=g_words[c])
                np.matmul(p["w"][c], f[:, a:b], out=d_head[:, a:b])
        d_own[:, :heads] += d_head
        column = np.full(len(here), len(goal))
        column[place] = n
        d_states = np.take(d_own, column, 1).reshape(k, len(before), -1)
        r, z, new = x[:, :k], x[:, k : 2 * k], x[:, 2 * k :]
        # what an error of a state is multiplied by to be one of: the new part, reset, update, the recurrent part of new
        by = np.empty((len(before), 4, *h.shape), x.dtype)
        rest = 1 - z
        np.multiply(rest, 1 - new * new, by[:, 0])
        np.multiply(by[:, 0], inner * r * (1 - r), by[:, 1])
        np.multiply((prev - new) * z, rest, by[:, 2])
        np.multiply(by[:, 0], r, by[:, 3])
        back, part = np.zeros_like(h), np.empty_like(states[0])
        for t in range(len(before) - 1, -1, -1):
            back += d_states[:, t]
            by[t] *= back
            back *= z[t]
            back += np.matmul(p["u"], by[t, 1:].reshape(3 * k, -1), out=part)
            if fresh[t]:
                back *= ~begins[t]
        g: dict[str, Any] = {"c": g_classes[:k], "cb": g_classes[k], "w": g_words[:, :k], "wb": g_words[:, k]}
        g["u"] = np.matmul(prev, by[:, 1:].reshape(len(before), 3 * k, -1).transpose(0, 2, 1)).sum(0)
        rows, seen = by[:, :3].reshape(len(before), 3 * k, -1).transpose(0, 2, 1).reshape(-1, 3 * k), before.ravel()
        order = np.argsort(seen, kind="stable")
        starts = np.flatnonzero(np.diff(seen[order], prepend=-1))
        sums = np.add.reduceat(np.take(rows, order, 0), starts, axis=0)
        g["x"] = seen[order[starts]], np.roll(sums, -k, 1)
        return g, states[-1]


def _step(g: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What a gradient changes of its parameters; its squares are added to total."""
    total += g * g
    root = total + TINY
    np.sqrt(root, root)
    g = np.divide(g, root, root)
    g *= RATE
    return g


def _with_ones(states: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Columns of states, with a row of ones for biases."""
    out = np.empty((len(states) + 1, len(columns)), states.dtype)
    np.take(states, columns, 1, out[:-1], mode="clip")
    out[-1] = 1
    return out


def _joined(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights with their biases as one more row, the largest bias 0, and whether exponentials of logits stay in range as they are.

    States lie between -1 and 1, so weights bound what logits can be.
    """
    bias = bias - bias.max(-1, keepdims=True)
    most = np.abs(weights).sum(-2)
    safe = ((bias + most).max(-1) < 80) & ((bias - most).max(-1) > -80)
    return np.concatenate([weights, bias[..., None, :]], -2), safe


def _logits(weights: np.ndarray, safe: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Logits of columns of states; the largest in every column is 0 where exponentials could leave their range."""
    out = weights.T @ own
    if not safe:
        out -= out.max(0)
    return out


def _flat(network: Network, squares: dict[str, np.ndarray]) -> np.ndarray:
    """All that training carries on, as one row of numbers."""
    return np.concatenate([v.ravel() for d in (network.p, squares) for v in d.values()], dtype=np.float64)


def _restored(network: Network, squares: dict[str, np.ndarray], flat: np.ndarray) -> None:
    """The opposite of _flat."""
    at = 0
    for d in (network.p, squares):
        for k, v in d.items():
            d[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all of their range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lessons(blocks: DataFrame, answers: DataFrame, vocabulary: Vocabulary, courses: int) -> DataFrame:
    """course, key, symbols of every training document, dealt by its doc_id and words.

    Rows that a block holds more than REPEATS times, doc_id and words alike, are dealt
    by the block and their place among them too, so that none fills a course.
    """

    def lesson(left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.sort_by("part").select(["counts"]).to_pylist()
        out = [_NO_LESSON]
        for row in left.to_pylist():
            learnt, lens = np.frombuffer(row["held"], np.int8) == 0, np.frombuffer(row["lens"], np.int64)
            doc_ids = np.frombuffer(row["doc_ids"], np.int64)[learnt].view(np.uint64)
            hashes, counts = np.frombuffer(row["hashes"], np.uint64), _counts(found, row["hashes"])
            ids = _unpack(row["ids"], int(lens.sum()), np.int32)[np.repeat(learnt, lens)]
            lens = lens[learnt]
            first = np.cumsum(lens) - lens
            owner = np.repeat(np.arange(len(lens)), lens)
            place = pa.array(owner * np.int64(len(hashes)) + ids).dictionary_encode().indices.to_numpy()  # a word's own number in each document
            known, others = vocabulary.symbols(hashes, counts)[ids], counts[ids] - np.bincount(place)[place]
            symbols = np.where(known < vocabulary.size, known, vocabulary.size + tail_class(others)).astype("<i2")
            key = _mixed(doc_ids ^ _mixed(np.add.reduceat(hashes[ids] * (2 * (np.arange(len(ids)) - first[owner]) + 1).astype(np.uint64), first)))
            _, same, n = np.unique(key, return_inverse=True, return_counts=True)
            nth = np.empty(len(key), np.uint64)
            nth[np.argsort(same, kind="stable")] = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            salt = np.where(n[same] > REPEATS, _mixed(nth + _mixed(np.array([row["block"] + 1], np.uint64))), np.uint64(0))
            course = _mixed(key + salt) % np.uint64(courses)
            texts = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(np.append(2 * first, 2 * len(ids)).astype(np.int32)), pa.py_buffer(symbols)])
            tidy()
            out.append(pa.table([pa.array(course.astype(np.int64)), pa.array(key.view(np.int64)), texts], names=["course", "key", "symbols"]))
        return pa.concat_tables(out)

    wanted = blocks.where("learnt > 0").select("block", "doc_ids", "held", "lens", "ids", "hashes")
    given = answers.where("block >= 0").select("block", "part", "counts")
    return wanted.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(lesson, "course long, key long, symbols binary")


_NO_LESSON = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["course", "key", "symbols"])


def _courses(tokens: int) -> int:
    """Courses that so many training tokens are dealt to, over all rounds."""
    return ROUNDS * max(1, -(-tokens // (ROUNDS * COURSE)))


def _sums(parts: DataFrame, courses: int) -> DataFrame:
    """piece, weight, x of parts (course, piece, weight, x) added up, FAN courses to a group as often as that takes."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("course")
        total = np.zeros(0)
        for x in table.column("x"):
            own = np.frombuffer(x.as_buffer(), np.float64)
            total = own + total if len(total) else own
        weight = sum(table.column("weight").to_pylist())
        return pa.table([table.column("group")[:1], table.column("piece")[:1], pa.array([weight]), pa.array([total.tobytes()], pa.binary())], names=["course", "piece", "weight", "x"])

    while courses > 1:
        courses = -(-courses // FAN)
        parts = parts.withColumn("group", F.floor(F.col("course") / FAN)).groupBy("group", "piece").applyInArrow(add, "course long, piece int, weight double, x binary")
    return parts


def _trained(lessons: DataFrame, vocabulary: Vocabulary, courses: int) -> Network:
    """The network trained once on all lessons, in rounds: each by all its courses side by side, then averaged by their tokens."""
    network = Network(vocabulary)
    squares = {k: np.zeros_like(v) for k, v in network.p.items()}

    def learn(table: pa.Table, seen: float) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("symbols", "ascending")])
        column = table.column("symbols").combine_chunks()
        lens = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        symbols = np.frombuffer(b"".join(column.to_pylist()), "<i2").astype(np.int64)
        own, sums = copy.copy(network), {k: v.copy() for k, v in squares.items()}
        own.p = {k: v.copy() for k, v in network.p.items()}
        ends = np.cumsum(lens)
        early = int(np.searchsorted(ends, FIRST_TOKENS - seen)) if seen < FIRST_TOKENS else 0
        early = min(early + 1, len(lens)) if seen < FIRST_TOKENS else 0
        cut = int(ends[early - 1]) if early else 0
        for part, of, lanes in ((symbols[:cut], lens[:early], FIRST_LANES), (symbols[cut:], lens[early:], TRAIN_LANES)):
            if len(of):
                own.train(part, of, sums, lanes)
        done = float(len(symbols))
        pieces = [(done * x).tobytes() for x in np.array_split(_flat(own, sums), PIECES)]
        course = table.column("course")[0].as_py() // ROUNDS
        tidy()
        return pa.table([pa.array([course] * PIECES, pa.int64()), pa.array(range(PIECES), pa.int32()), pa.array([done] * PIECES), pa.array(pieces, pa.binary())], names=["course", "piece", "weight", "x"])

    def after(seen: float) -> Callable[[pa.Table], pa.Table]:
        return lambda table: learn(table, seen)

    for turn in range(ROUNDS):
        seen = turn * vocabulary.n / courses
        own = lessons.where(F.col("course") % ROUNDS == turn).groupBy("course")
        parts = own.applyInArrow(after(seen), "course long, piece int, weight double, x binary")
        sums = sorted(_sums(parts, courses // ROUNDS).select("piece", "weight", "x").collect(), key=lambda r: r["piece"])
        if sums:
            _restored(network, squares, np.concatenate([np.frombuffer(r["x"], np.float64) / r["weight"] for r in sums]))
    return network


def _counts(rows: list, raw: bytes) -> np.ndarray:
    """The counts of a block's words, from the answers in the order of their ranges."""
    out = [np.frombuffer(pa.decompress(r["counts"], _size(r["counts"]), codec="zstd", asbytes=True), np.int64) for r in rows]
    return np.concatenate(out) if out else np.zeros(len(raw) // 8, np.int64)


def _size(frame: bytes) -> int:
    """The decompressed size that a zstd frame states."""
    import zstandard

    return zstandard.frame_content_size(frame)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from documents whose fold is not 1. Tokens are words and one end. A null
    text is empty and has the end only. Repeated rows are counted and scored each.
    Rows with a null doc_id are scored, not held out and not learnt from. An empty
    table gives an empty result; other columns are ignored. Where nothing can be
    learnt, every word is new.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rest = F.when(F.col("doc_id").isNull(), F.lit(2)).otherwise((fold() == 1).cast("int"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rest.alias("rest"), "text")
    blocks = scratch.table(_blocks(source))
    distinct = blocks.agg(F.sum("n")).first()[0] or 0
    parts = 1 << max(0, int(np.ceil(np.log2(max(1, 12 * distinct / RANGE_BYTES)))))
    answers = scratch.table(_answers(blocks, parts))
    sums = answers.where("block = -1")
    total = sums.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    mass = np.zeros(TAIL)
    for r in sums.select(F.posexplode("mass").alias("c", "m")).groupBy("c").agg(F.sum("m").alias("m")).collect():
        mass[r["c"]] = r["m"]
    pairs = sums.select(F.explode(F.arrays_zip("head", "head_counts")).alias("w")).select("w.head", "w.head_counts")
    head = pairs.orderBy(F.desc("head_counts"), "head").limit(HEAD).collect()
    own = np.array([r["head"] for r in head], np.int64).view(np.uint64)
    for c, count in zip(tail_class(np.array([r["head_counts"] for r in head], np.int64)), [r["head_counts"] for r in head], strict=True):
        mass[c] -= count + 0.5
    vocabulary = Vocabulary(own, np.array([r["head_counts"] for r in head], float), total["v"] or 0, total["n"] or 0, np.maximum(mass, 0))
    courses = _courses(vocabulary.n)
    lessons = scratch.table(_lessons(blocks, answers, vocabulary, courses))
    network = _trained(lessons, vocabulary, courses)
    scratch.drop(lessons)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        found = right.sort_by("part").select(["counts"]).to_pylist()
        for row in left.to_pylist():
            lens, held = np.frombuffer(row["lens"], np.int64), np.frombuffer(row["held"], np.int8)
            hashes = np.frombuffer(row["hashes"], np.uint64)
            counts = _counts(found, row["hashes"])
            ids = _unpack(row["ids"], int(lens.sum()), np.int32)
            of_word = vocabulary.symbols(hashes, counts)
            inner = vocabulary.within(of_word, counts)[ids] + network.score(of_word[ids], lens)
            tidy()
            first = np.cumsum(lens) - lens
            doc_ids = np.frombuffer(row["doc_ids"], np.int64)
            out.append(
                pa.table(
                    [
                        pa.array(doc_ids, mask=held >= 4),
                        pa.array(held % 4 == 1),
                        pa.array(lens),
                        pa.array(np.add.reduceat(counts[ids] > 0, first, dtype=np.int64)),
                        pa.array(np.full(len(lens), vocabulary.n, np.int64)),
                        pa.array(np.add.reduceat(vocabulary.base(counts)[ids], first)),
                        pa.array(np.add.reduceat(inner, first) / np.log(10)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out) if out else _EMPTY

    wanted = blocks.select("block", "doc_ids", "held", "lens", "ids", "hashes")
    given = answers.where("block >= 0").select("block", "part", "counts")
    return wanted.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
