import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenfold.llm.bpe import digests, encoded, load

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", " ", None, "Hello,  World! it's don't we'll I'd they've I'm you're 'SAM <|endoftext|>x<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|",
    "x123 \x00 é ünï ̈ ü ﬁ �日本 İ ΣΑΣ Σ ǅ", "aaaaaaaaaaaaaaaaaaaaaa" * 50, "</w> a</w>b </ w>", "\x1c\x1d a\x85b c　d᠎ e﻿", "%%%***$$$&&&### !!!??", "½ ² ٣ Ⅷ १२३", "🙂👩‍👩‍👧 emoji 🇩🇪",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def noise(seed, n):
    r = random.Random(seed)
    letters = "abcdefghijklmnoprstuvwxyzABCTHE  ''.,-éüßñ日本́\n0123"
    return ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(n)] + ["".join(c for c in (chr(r.choice([r.randrange(1, 0xD800), r.randrange(1, 0x250)])) for _ in range(30)) if unicodedata.category(c) != "Cn") for _ in range(n)]


def test_like_the_library(library):
    bpe = load(PATH)
    for text in [t or "" for t in TEXTS] + noise(1, 1500):
        want = library.encode(text, add_special_tokens=False).ids
        got = bpe.encode(text)
        assert got.tolist() == want, text
        assert bpe.decode(got) == library.decode(want, skip_special_tokens=False)


def test_every_token_of_the_vocabulary(library):
    bpe = load(PATH)
    for t in bpe.text[:49406:7]:
        word = t.replace("</w>", "")
        assert bpe.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids


def test_digests(spark, library):
    rows = [(i, t, "z") for i, t in enumerate(TEXTS + noise(2, 50))] + [(None, "a b", "z"), (1, " ", "z"), (7000, "word " * 200000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in digests(docs, PATH).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert digests(docs.where("false"), PATH).collect() == []
    some = encoded(docs.where("doc_id = 3"), PATH).first()
    assert hashlib.sha256(some.decoded.encode()).hexdigest() == next(w[3] for w in want if w[0] == 3)
