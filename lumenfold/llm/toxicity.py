"""Toxicity: a lexicon found in spite of misspelling, each hit weighed by its context.

The lexicon's trie is intersected with Levenshtein automata of its terms and the
product is made deterministic, so that one table walks all words of a batch at
once. Windows of words around each hit tell quotation from abuse, and a logistic
model of the kinds of hits gives the score. The lexicon, the weights of words in
windows and the model are learnt from labelled documents: terms are words, or
beginnings that many words share.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.samples import fold, labelled
from lumenfold.llm.scratch import small_batches
from lumenfold.llm.words import chunks, tidy

#: Characters of text looked at together, words on either side of a hit, most terms of one automaton.
CHUNK, WINDOW, TERMS = 1 << 18, 6, 200
#: A term tolerates one edit from the first length on and two from the second.
ONE_EDIT, TWO_EDITS = 5, 10

# Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
# Marks of quotation.
QUOTES = set("\"'«»„“”‘’‹›`")

_kinds: np.ndarray | None = None


def _word_points() -> np.ndarray:
    """Whether each code point is a letter, a mark, a digit or a lookalike."""
    global _kinds
    if _kinds is None:
        _kinds = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), bool, 0x110000)
        _kinds[[ord(c) for c in LOOKALIKES]] = True
    return _kinds


def split(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts lower-cased and joined, their code points, the bounds of words, and the first word of each text."""
    low = [(t or "").lower() for t in texts]
    joined = "".join([t + "\n" for t in low])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    edge = np.diff(np.concatenate([[0], _word_points()[points].view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]).astype(np.int64))
    return joined, points, starts, ends, at


class Matcher:
    """The lexicon's trie intersected with Levenshtein automata, as one table over classes of letters.

    A term that ends in * stands for every word that begins so. States are sets of
    (node, edits); state 0 is dead. accept gives the edits plus one of the best term
    that a word ending there matches, 0 for none; sure marks states that a longer
    word cannot change.
    """

    def __init__(self, terms: list[str]) -> None:
        self.terms = sorted(set(terms))
        letters = sorted({c for t in self.terms for c in t if c != "*"})
        self.classes = np.zeros(0x110000, np.int32)
        for i, c in enumerate(letters):
            self.classes[ord(c)] = i + 1
        for sign, letter in LOOKALIKES.items():
            if sign not in letters and letter in letters:
                self.classes[ord(sign)] = letters.index(letter) + 1
        children: list[dict[int, int]] = [{}]
        full, begins, allowed, own = [False], [False], [0], [0]
        for t in self.terms:
            body, node = t.rstrip("*"), 0
            most = 2 if len(body) >= TWO_EDITS else 1 if len(body) >= ONE_EDIT + t.endswith("*") else 0
            path = [0]
            for c in body:
                k = letters.index(c) + 1
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    full.append(False)
                    begins.append(False)
                    allowed.append(0)
                    own.append(0)
                node = children[node][k]
                path.append(node)
            for n in path:  # a node's automaton allows what the most tolerant term below it does
                allowed[n] = max(allowed[n], most)
            full[node] = True
            begins[node] |= t.endswith("*")
            own[node] = max(own[node], most)

        def closed(items: dict[int, int]) -> frozenset[tuple[int, int]]:
            """With letters of a term left out of the word."""
            todo, best = list(items.items()), dict(items)
            while todo:
                n, e = todo.pop()
                if begins[n]:
                    continue
                for m in children[n].values():
                    if e + 1 <= allowed[m] and e + 1 < best.get(m, 9):
                        best[m] = e + 1
                        todo.append((m, e + 1))
            return frozenset(best.items())

        def after(state: frozenset[tuple[int, int]], k: int) -> frozenset[tuple[int, int]]:
            best: dict[int, int] = {}
            for n, e in state:
                if begins[n] and e <= own[n]:
                    best[n] = min(e, best.get(n, 9))  # any ending
                    continue
                steps = [(n, e + 1)] + [(m, e + (c != k)) for c, m in children[n].items()]
                for m, f in steps:
                    if f <= allowed[m] and f < best.get(m, 9):
                        best[m] = f
            return closed(best)

        start = closed({0: 0})
        number = {frozenset(): 0, start: 1}
        todo, table = [start], {0: [0] * (len(letters) + 1)}
        while todo:
            state = todo.pop()
            row = []
            for k in range(len(letters) + 1):
                new = after(state, k)
                if new not in number:
                    number[new] = len(number)
                    todo.append(new)
                row.append(number[new])
            table[number[state]] = row
        self.table = np.array([table[i] for i in range(len(number))], np.int32)
        self.accept = np.zeros(len(number), np.int8)
        self.sure = np.zeros(len(number), bool)
        for state, i in number.items():
            hits = [e for n, e in state if full[n] and e <= own[n]]
            self.accept[i] = min(hits) + 1 if hits else 0
            self.sure[i] = any(begins[n] and e == 0 for n, e in state)

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word 0, or one more than the edits of the best term."""
        out = np.zeros(len(starts), np.int8)
        live, at = np.arange(len(starts)), starts.copy()
        state = np.ones(len(starts), np.int32)
        while len(live):
            state = self.table[state, self.classes[points[at]]]
            at = at + 1
            done = (at >= ends[live]) | self.sure[state]
            out[live[done]] = self.accept[state[done]]
            go = ~done & (state > 0)
            live, at, state = live[go], at[go], state[go]
        return out


class Matchers:
    """A lexicon of more than TERMS terms as several automata; the best of their matches counts."""

    def __init__(self, terms: list[str]) -> None:
        terms = sorted(set(terms))
        self.parts = [Matcher(terms[a : a + TERMS]) for a in range(0, len(terms), TERMS)]

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word 0, or one more than the edits of the best term."""
        out = np.zeros(len(starts), np.int8)
        for part in self.parts:
            found = part.match(points, starts, ends)
            out = np.where((out == 0) | ((found > 0) & (found < out)), found, out)
        return out


FEATURES = 6


#: What the words of a window say of a hit: positive where it is quoted.
Context = dict[str, float]


def hit_features(matcher: Matcher | Matchers, texts: list[str | None], context: Context) -> np.ndarray:
    """For each text the logarithms of counts of hits: exact and misspelled, in abuse and in quotation, and their share of words."""
    joined, points, starts, ends, at = split(texts)
    found = matcher.match(points, starts, ends)
    out = np.zeros((len(texts), FEATURES))
    hits = np.flatnonzero(found)
    owner = np.searchsorted(at, hits, "right") - 1
    for w, i in zip(hits.tolist(), owner.tolist(), strict=True):
        out[i, 2 * _quoted(joined, starts, ends, w, int(at[i]), int(at[i + 1]), context) + (found[w] > 1)] += 1
    n = np.maximum(np.diff(at), 1)
    abuse = out[:, :2].sum(1)
    out[:, 4] = abuse / n * 20
    out[:, 5] = abuse > 0
    out[:, :4] = np.log1p(out[:, :4])
    return out


def _window(joined: str, starts: np.ndarray, ends: np.ndarray, w: int, first: int, last: int) -> set[str]:
    """The other words up to WINDOW before and after a word of a text, whose words go from first to last."""
    near = range(max(first, w - WINDOW), min(last, w + WINDOW + 1))
    return {joined[starts[i] : ends[i]] for i in near if i != w}


def _quoted(joined: str, starts: np.ndarray, ends: np.ndarray, w: int, first: int, last: int, context: Context) -> bool:
    """Whether the window around a hit speaks for quotation: marks on both sides count 1, the weights of its words half, up to 1."""
    a, b = max(first, w - WINDOW), min(last, w + WINDOW + 1)
    left, right = joined[starts[a] : starts[w]], joined[ends[w] : ends[b - 1]]
    beyond = joined[ends[b - 1] : ends[b - 1] + 2]
    marks = any(c in QUOTES for c in left) and any(c in QUOTES for c in right + beyond)
    told = sum(context.get(x, 0.0) for x in _window(joined, starts, ends, w, first, last)) if context else 0.0
    return marks + min(1.0, max(-1.0, told / 2)) >= 0.5


def learn_context(rows: list[tuple[str, int]], matcher: Matcher | Matchers) -> Context:
    """Weights of the words around hits: the log-odds of windows in documents that aren't toxic against those in toxic ones.

    Near copies count as one document. Words whose log-odds are less than two standard
    errors from none have no weight.
    """
    groups = _groups_of_copies(text for text, _ in rows)
    seen: dict[str, tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
    with_hits: tuple[set[int], set[int]] = (set(), set())
    for (text, label), group in zip(rows, groups, strict=True):
        joined, points, starts, ends, at = split([text])
        for w in np.flatnonzero(matcher.match(points, starts, ends)).tolist():
            with_hits[bool(label)].add(group)
            for x in _window(joined, starts, ends, w, 0, int(at[1])):
                seen[x][bool(label)].add(group)
    n = [len(g) for g in with_hits]
    out = {}
    for word, own in seen.items():
        quoted, abusive = (len(g) + 0.5 for g in own)
        weight = math.log(quoted / (n[0] + 1)) - math.log(abusive / (n[1] + 1))
        if min(n) and abs(weight) > 2 * math.sqrt(1 / quoted + 1 / abusive):
            out[word] = weight
    return out


def _words(text: str) -> list[str]:
    joined, _, starts, ends, _ = split([text])
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _groups_of_copies(texts: Iterable[str]) -> list[int]:
    """A group for each text: texts that share a least hash of their word pairs are in one."""
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen: dict[tuple[int, int], int] = {}
    turns = np.random.default_rng(7).integers(1, 2**62, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for i, text in enumerate(texts):
        parent.append(i)
        words = _words(text)
        pairs = np.array([crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:] or words, strict=False)], np.uint64)
        if not len(pairs):
            continue
        for j, turn in enumerate(turns):
            key = j, int((pairs * turn >> np.uint64(16)).min())
            parent[find(i)] = find(seen.setdefault(key, i))
    return [find(i) for i in range(len(parent))]


def _terms(text: str) -> Iterator[str]:
    """The distinct words of a text, and their beginnings of four to eight letters with a * after them."""
    words = {w for w in _words(text) if 3 <= len(w) <= 30}
    yield from words
    yield from {w[:k] + "*" for w in words for k in range(4, min(len(w), 9))}


def learn_lexicon(rows: list[tuple[str, int]]) -> list[str]:
    """Terms that tell toxic documents from others.

    A candidate is a word, or a beginning of four letters or more with three endings
    or more. It is taken when it is in so many toxic documents and so few others
    that chance would hardly give it. Near copies count as one document, so that
    copies of a toxic document don't make terms of its other words.
    """
    groups = _groups_of_copies(text for text, _ in rows)
    n = [len({g for g, (_, y) in zip(groups, rows, strict=True) if bool(y) == t}) for t in (False, True)]
    if not n[0] or not n[1]:
        return []
    base = math.log(n[1] / sum(n))
    toxic: dict[str, set[int]] = defaultdict(set)
    for (text, label), group in zip(rows, groups, strict=True):
        if label:
            for t in _terms(text):
                toxic[t].add(group)
    need = math.log(max(len(toxic), 2)) + 2
    df = {t: len(g) for t, g in toxic.items() if -base * len(g) > need}
    del toxic
    endings: dict[str, set[str]] = defaultdict(set)
    clean: dict[str, set[int]] = defaultdict(set)
    for (text, label), group in zip(rows, groups, strict=True):
        if label:
            for w in _words(text):
                for k in range(4, min(len(w), 9)):
                    if w[:k] + "*" in df and len(w) <= 30:
                        endings[w[:k] + "*"].add(w[k:])
        else:
            for t in _terms(text):
                if t in df:
                    clean[t].add(group)

    def told(t: str) -> bool:
        share = df[t] / (df[t] + len(clean.get(t, ())))
        return share > 0.9 and df[t] * (math.log(share) - base) > need

    live = {t for t in df if (not t.endswith("*") or len(endings[t]) >= 3) and told(t)}
    longer = Counter()
    for t in live:  # a beginning that one longer term stands for almost always
        for p in [t[:-2] + "*"] if t.endswith("*") else [t[:k] + "*" for k in range(4, len(t))]:
            longer[p] = max(longer[p], df[t])
    begins = {t for t in live if t.endswith("*") and longer[t] < 0.95 * df[t]}
    begins = {t for t in begins if not any(t[:k] + "*" in begins for k in range(4, len(t) - 1))}
    words = {t for t in live if not t.endswith("*") and not any(t[:k] + "*" in begins for k in range(4, len(t)))}
    return sorted(begins | words)


class ToxicityModel:
    """A matcher, the weights of words in windows, and those of a logistic model of hits."""

    def __init__(self, lexicon: list[str], weights: np.ndarray, context: Context) -> None:
        self.lexicon, self.weights, self.context = lexicon, weights, context
        self._matcher: Matcher | Matchers | None = None

    def __getstate__(self) -> tuple:
        return self.lexicon, self.weights, self.context

    def __setstate__(self, state: tuple) -> None:
        self.lexicon, self.weights, self.context = state
        self._matcher = None

    @property
    def matcher(self) -> Matcher | Matchers:
        if self._matcher is None:
            key = tuple(self.lexicon)
            if key not in _matchers:
                _matchers[key] = (Matcher if len(key) <= TERMS else Matchers)(self.lexicon)
            self._matcher = _matchers[key]
        return self._matcher

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], extra: list[str] = ()) -> ToxicityModel:
        """Learn the lexicon, to which extra terms may be added, its context, and the weights by ridge-penalised Newton steps."""
        model = cls(sorted({*learn_lexicon(rows), *extra}), np.zeros(FEATURES + 1), {})
        model.weights[0] = -3.0
        if model.lexicon:
            model.weights[1:] = [2.0, 1.0, 0.0, 0.0, 1.0, 3.0]
        y = np.array([t for _, t in rows], float)
        if not len(rows) or y.min() == y.max():
            return model
        if model.lexicon:
            model.context = learn_context(rows, model.matcher)
        x = np.concatenate([hit_features(model.matcher, [t for t, _ in rows[a : a + 200]], model.context) for a in range(0, len(rows), 200)])
        x = np.hstack([np.ones((len(x), 1)), x])
        w = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], 0.5)
        ridge[0] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        model.weights = w
        return model

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = hit_features(self.matcher, texts, self.context)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


_matchers: dict[tuple[str, ...], Matcher | Matchers] = {}


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from a bounded sample of the labelled documents whose fold is not 0."""
    return ToxicityModel.fit(labelled(docs, labels.where(fold() != 0), "toxic"))


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, from its text alone.

    Null and empty texts have no hits and get the score of such texts. Rows with a
    null doc_id are scored and not held out; repeated rows are scored each; an empty
    table gives an empty result; other columns are ignored. Without labelled rows of
    both kinds there is no lexicon, and nothing is predicted toxic.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=CHUNK):
                s = model.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        tidy()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns as they were.

    Each row is judged by its own text: null and empty texts, repeated rows and rows
    without an id as any others. Equal texts have equal scores; one of exactly a half is toxic.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=CHUNK):
                yield part.filter(pa.array(model.scores(part.column(at).to_pylist()) < 0.5))
        tidy()

    return docs.mapInArrow(run, docs.schema)
