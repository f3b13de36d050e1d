"""BPE encoding by dynamic programming over the prefixes of each word, and decoding.

The encoding of a prefix of a word has exactly one last token. It is the token
that ends there (the automaton's suffix matches give all that do) and that stays
beside the last token of the prefix it starts from: no merge would have joined
anything across their border. Following the last tokens back gives the exact ids.

A vocabulary file is one of the tokenizers library: BPE with word ends, its text
lower-cased and split by a pattern. The file's path is a parameter. Letters of
scripts newer than the Unicode tables of the regex module or of Python, and
those only, may be split otherwise than by the library.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.scratch import small_batches
from lumenfold.llm.words import chunks, tidy

#: Words of each of two generations that a worker remembers; pairs and edges, which start anew when full.
WORDS, PAIRS, EDGES = 90_000, 150_000, 10_000
_FAR = 1 << 30
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
# Unicode's white space, as the body of a character class.
_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file. A word's symbols are its bytes; its last is 256 higher."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.text = [""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for t, i in ids.items():
            self.text[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.text[i] = t
        self._special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(pattern.replace(r"\s", _SPACE)).findall
        letters = _byte_letters()
        symbols: dict[int, str] = {}
        for letter, b in letters.items():
            symbols[ids[letter]] = chr(b)
            symbols[ids[letter + end]] = chr(256 + b)
        #: merged[left, right] = (rank, token); halves[token] = (rank, left, right)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merged[left, right] = rank, whole
            if whole not in self.halves:
                self.halves[whole] = rank, left, right
                symbols[whole] = symbols[left] + symbols[right]
        self._edges: dict[int, list[tuple[int, int]]] = {}
        self._machine = ahocorasick.Automaton()
        for t, s in symbols.items():
            if t not in self.halves or self._own(t):
                self._machine.add_word(s, (t, len(s)))
        self._machine.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, tuple[bytes, str]] = {}
        self._older: dict[str, tuple[bytes, str]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens on one edge of a token's tree from the symbol up, each with the rank at which it is merged away."""
        key = token << 2 | side
        out = self._edges.get(key)
        if out is None:
            if len(self._edges) >= EDGES:
                self._edges.clear()
            out = self._edges[key] = self._climb(token, side)
        return out

    def _climb(self, token: int, side: int) -> list[tuple[int, int]]:
        out, until = [], _FAR
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out[::-1]
            until = self.halves[token][0]
            token = self.halves[token][side]

    def _own(self, token: int) -> bool:
        """Whether the token's own symbols are encoded as the token: nothing crosses the border of its halves before they are joined."""
        rank, left, right = self.halves[token]
        return self._apart(left, right, rank) and all(t not in self.halves or self._own(t) for t in (left, right))

    def _apart(self, left: int, right: int, before: int = _FAR) -> bool:
        """Whether no merge of a rank below before crosses the border of two tokens."""
        xs, ys = self._edge(left, 2), self._edge(right, 1)
        i = j = 0
        while True:
            (a, gone_a), (b, gone_b) = xs[i], ys[j]
            hit = self.merged.get((a, b))
            # At one rank the pair further left is merged first.
            if hit and hit[0] < before and hit[0] < gone_a and hit[0] <= gone_b:
                return False
            if gone_a <= gone_b:
                if gone_a == _FAR:
                    return True
                i += 1
            else:
                j += 1

    def _fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            got = self._pairs[key] = self._apart(left, right)
        return got

    def word(self, piece: str) -> list[int]:
        """The ids of one piece of the split text."""
        raw = piece.encode()
        symbols = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        last = [-1] * (len(symbols) + 1)
        back = [0] * (len(symbols) + 1)
        fits = self._fits
        for end, (token, size) in self._machine.iter(symbols):
            end += 1
            if last[end] < 0:
                start = end - size
                if not start or (last[start] >= 0 and fits(last[start], token)):
                    last[end], back[end] = token, start
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _looked_up(self, piece: str) -> tuple[bytes, str]:
        """(ids, decoded) of a piece that a younger generation didn't hold; what is asked for again grows young."""
        got = self._words.get(piece) or self._older.get(piece)
        if got is None:
            ids = self.word(piece)
            got = array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes(), " ".join([self.text[i] for i in ids])
        if len(piece) <= 40:
            if len(self._words) >= WORDS:
                self._older, self._words = self._words, {}
            self._words[piece] = got
        return got

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, their tokens joined by spaces) of each piece of a text."""
        out: list[tuple[bytes, str]] = []
        for i, part in enumerate(self._special.split(text)) if self._special else [(0, text)]:
            if i % 2:
                out.append((np.array([self.special[part]], "<u4").tobytes(), part))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower-cased letter by letter
            known, other = self._words.get, self._looked_up
            out += [known(piece) or other(piece) for piece in self._pieces(part.lower())]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([p[0] for p in self.pieces(text)]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces: the file names no decoder that would do more. Unknown ids are left out."""
        return " ".join([self.text[i] for i in ids if i < len(self.text) and self.text[i]])


_bpes: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at path, read once in each worker."""
    if path not in _bpes:
        _bpes[path] = Bpe(path)
    return _bpes[path]


def _mapped(docs: DataFrame, path: str, schema: str, row: Callable[[Bpe, str], tuple], kinds: list[pa.DataType], names: list[str]) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in chunks(batch):
                rows = [row(bpe, t or "") for t in part.column(1).to_pylist()]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {schema}")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every row. See digests() for the cases."""

    def row(bpe: Bpe, text: str) -> tuple:
        ids = bpe.encode(text)
        return len(ids), ids.astype(np.int32), bpe.decode(ids)

    return _mapped(docs, path, "n_tokens long, ids array<int>, decoded string", row, [pa.int64(), pa.list_(pa.int32()), pa.string()], ["n_tokens", "ids", "decoded"])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text, for every row.

    A null text counts as empty: no ids, and digests of nothing. Special tokens
    that stand in a text are encoded as themselves. Repeated rows are encoded each;
    a null doc_id stays null; other columns are ignored; an empty table gives an
    empty result. Very long words are encoded but not remembered.
    """

    def row(bpe: Bpe, text: str) -> tuple:
        found = bpe.pieces(text)
        ids = b"".join([p[0] for p in found])
        # Each remembered piece carries its own decoding: the same tokens, joined.
        decoded = " ".join([p[1] for p in found])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _mapped(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"])
