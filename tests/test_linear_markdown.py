"""Inline Markdown against the patterns that state it, and the time of long texts."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import markdown as M
from lumenfold.operators import markdown_parser, report_blocks

LINK = re.compile(r"\[([^\]]+)\]\([^)]+\)")
STRESS = re.compile(r"(?<![\w*])\*(?!\s)(.+?)(?<!\s)\*(?![\w*])")


def stated(line):
    out = LINK.sub(r"\1", line.strip())
    out = STRESS.sub(r"\1", re.sub(r"\*\*(.+?)\*\*", r"\1", out))
    return " ".join(re.sub("`([^`]+)`", r"\1", out).replace("*", "").split())


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="[]()*` a", max_size=40))
def test_inline_as_stated(line):
    assert markdown_parser.inline(line)[0] == stated(line)


def test_plain_as_stated(spark):
    import random

    r = random.Random(7)
    lines = ["".join(r.choice("[]()*` ab") for _ in range(r.randrange(40))) for _ in range(2000)] + [None, "[x]", "[a](b)c)", "[a](b", "a) [b](c) [d](e"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").select("i", M.plain(F.col("t")).alias("t")).collect()
    assert {x.i: x.t for x in got} == {i: None if x is None else stated(x) for i, x in enumerate(lines)}


HARD = ["[" * 100_000, "[a](" * 30_000, "[a]" * 30_000, "[" * 50_000 + "]x)", "](" * 50_000 + ")", " *a" * 30_000, "*a " * 30_000, "**" * 50_000, "`" * 50_000]


@pytest.mark.parametrize("text", HARD, ids=range(len(HARD)))
def test_time_of_a_line_is_linear(text):
    began = time.time()
    markdown_parser.inline(text)
    assert time.time() - began < 2


def test_time_of_lists_is_linear():
    began = time.time()
    blocks = report_blocks.from_markdown("\n".join(f"- item {i}\n" for i in range(100_000)))
    assert len(blocks) == 100_000 and time.time() - began < 20


def test_time_of_a_column_is_linear(spark):
    began = time.time()
    spark.createDataFrame([(x[:40_000],) for x in HARD[:5]], "t string").select(M.plain(F.col("t"))).collect()
    assert time.time() - began < 20
