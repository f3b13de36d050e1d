import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import markdown as M
from lumenfold.functions import tex
from lumenfold.functions import text as T
from lumenfold.operators import markdown_parser, report_blocks


def values(spark, f, rows):
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, x string").coalesce(1).orderBy("i").select(f(F.col("x"))).collect()]


def test_clean_text(spark):
    rows = [None, "", "a" + chr(0x200B) + "b", "a" + chr(0xA0) + " b\x1c\x85c ", chr(0x661) + chr(0x6F2), "x\n\ty"]
    assert values(spark, T.clean_text, rows) == ["", "", "ab", "a b c", chr(0x661) + chr(0x6F2), "x y"]
    assert values(spark, lambda c: T.clean_text(c, "latin"), [chr(0x661) + chr(0x6F2)]) == ["12"]
    assert values(spark, lambda c: T.clean_label(c, "latin"), [chr(0x661) + chr(0x6F2)]) == ["1" + chr(0x6F2)]


def test_clean_block(spark):
    rows = ["\n\n  a \t b\n\n\n\nc\n", "   x\n\ty"]
    assert values(spark, T.clean_block, rows) == ["a b\n\nc", "x\ny"]
    assert values(spark, lambda c: T.clean_block(c, indent=True), rows) == ["  a b\n\nc", "   x\ny"]


def test_native_and_python_clean_agree(spark):
    rows = ["a  b", " x\ty ", "q\n\n\n\nr", "  lead\n tail", "سلام  hello", ""]
    assert values(spark, T.clean_text, rows) == [report_blocks.clean(x) for x in rows]
    assert values(spark, T.clean_block, rows) == [report_blocks.clean(x, lines=True) for x in rows]
    assert values(spark, lambda c: T.clean_block(c, indent=True), rows) == [report_blocks.clean(x, lines=True, indent=True) for x in rows]


def test_fix_spacing(spark):
    rows = ["a , b", "( x )", "محلو ل", "نص12", "N2نص", "كتا ة", "a" + chr(0x2212) + "b", "  p  q  "]
    assert values(spark, T.fix_spacing, rows) == ["a, b", "(x)", "محلول", "نص 12", "N2 نص", "كتاة", "a-b", "p q"]


def test_split_lines(spark):
    got = values(spark, T.split_lines, ["a\nb\r\nc\x0bd\x85e\n", "", "x"])
    assert [list(x) for x in got] == ["a\nb\r\nc\x0bd\x85e\n".splitlines(), [], ["x"]]


def test_lang_info(spark):
    got = values(spark, T.lang_info, ["abc سلام", "سلام", "a", "12", "", "ab سل"])
    assert [tuple(x) for x in got] == [("mixed", "ltr"), ("ar", "rtl"), ("en", "ltr"), ("none", "ltr"), ("none", "ltr"), ("en", "ltr")]
    assert [tuple(x) for x in got] == [tuple(report_blocks.language(x).values()) for x in ["abc سلام", "سلام", "a", "12", "", "ab سل"]]


@pytest.mark.parametrize(
    ("line", "plain"),
    [("**b** *i* `c` [t](u)", "b i c t"), ("a*b*c", "abc"), ("* stray", "stray"), ("2 * 3 * 4", "2 3 4"), ("x_*y*", "x_y"), ("**a", "a")],
)
def test_markdown_plain(spark, line, plain):
    assert values(spark, M.plain, [line]) == [plain] == [markdown_parser.inline(line)[0]]


def _score(text):
    lines = text.split("\n")
    marked = sum(bool(re.match(r"\s*(#{1,6}\s|[*\-•]\s|\d+[.)]\s|\|)", x)) for x in lines)
    return 0.0 if len(lines) < 6 else marked / len(lines) * min(1, len(text) / 3000) + 0.5 * bool(re.search(r"(?m)^#{1,3}\s", text))


def test_cells_and_score(spark):
    rows = ["| a | b |", "a|b|", "|", "x", "| a \\| b |"]
    assert [list(x) for x in values(spark, M.row_cells, rows)] == [markdown_parser.cells(x) for x in rows]
    texts = ["# h\n" + "- x\n" * 10, "a\n" * 9, "short", "| a\n" * 2000]
    assert values(spark, M.score, texts) == pytest.approx([_score(x) for x in texts])


def test_presentation_forms():
    word = chr(0xFEFC) + "²"
    assert tex.plain_forms(word) == "لا²"
    assert tex.plain_forms(word, whole=True) == "لا2"
    assert tex.plain_forms("ﬁ²") == "ﬁ²"


@pytest.mark.parametrize(
    ("formula", "plain", "short"),
    [
        (r"$\frac{1}{2}$", "(1)/(2)", "1/2"),
        (r"\frac{a+b}{2}", "(a+b)/(2)", "(a+b)/(2)"),
        (r"x^{2}y_{1}", "x²y₁", "x²y₁"),
        (r"x^2_i", "x²_(i)", "x²_(i)"),
        (r"x^{ab}", "x^(ab)", "x^(ab)"),
        (r"\text{\mathrm{A}}\leq 5\%", "A≤ 5%", "A≤ 5%"),
        (r"\sqrt{x}\,y", "√(x) y", "√(x) y"),
        (r"\foo{1}", "foo1", "foo1"),
    ],
)
def test_tex(spark, formula, plain, short):
    assert tex.tex_to_text(formula) == plain
    assert values(spark, tex.quiz_tex, [formula, None]) == [short, None]


def test_marks(spark):
    assert tex.decode_marks("a\x01x^2\x02 b\x032\x04 c\x05q\x06") == "ax² b² c_(q)"
    assert values(spark, tex.quiz_marks, ["10^{-3} H_{2}O", "a\x01\\frac{1}{2}\n\x02b", "plain", "", None]) == ["10⁻³ H₂O", "a1/2b", "plain", "", None]
    assert values(spark, tex.without_forms, [chr(0xFEFC), "x", None]) == ["لا", "x", None]


def test_other_commands(spark):
    assert tex.tex_to_text(r"a\half b", {r"\half": "½"}) == "a½ b"
    assert values(spark, lambda c: tex.quiz_tex(c, {r"\half": "½"}), [r"\half\times"]) == ["½times"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\t|*`#>-1.─" + chr(0xA0) + chr(0x627), max_size=60))
def test_cleaning_and_parsing_properties(text):
    once = report_blocks.clean(text)
    assert report_blocks.clean(once) == once
    for b in report_blocks.from_markdown(text):
        if b["type"] == "table":
            assert {len(r) for r in b["rows"]} == {b["cols"]}
    report_blocks.to_markdown(report_blocks.from_markdown(text))


def test_strip_of_every_character_in_linear_time(spark):
    spaces = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and re.fullmatch(r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", chr(i))]
    others = [c for c in map(chr, range(1, 0x3100)) if c not in spaces]
    texts = [a + "x y" + a for a in spaces] + [c + "x" + c for c in others] + ["", " ", " \n\u3000", "\r\n a\x85\n"]
    assert values(spark, T.strip, texts) == [t.strip("".join(spaces)) for t in texts]
    began = time.time()
    assert values(spark, T.strip, ["x" + " " * 300_000 + "x"]) == ["x" + " " * 300_000 + "x"]
    assert time.time() - began < 10
