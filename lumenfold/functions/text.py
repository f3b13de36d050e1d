"""Cleaning of mixed Arabic and English text as Column expressions.

All functions map Column to Column and stay in the JVM. Presentation forms and TeX
need Unicode tables or functions of a match; those steps are in lumenfold.functions.tex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


# Classes of characters, as bodies of regular-expression classes.
SPACE = "\\t-\\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # SPACE, one by one
INVISIBLE = "\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff\xad"
ARABIC = "\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff"
ARABIC_LETTER = "\u0621-\u064a"
LINE_ENDS = "\\n\\x0b\\x0c\x1c-\x1e\x85\u2028\u2029"

# Digits of Arabic texts, in order.
_ARABIC_INDIC = "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669"
_PERSIAN = "\u06f0\u06f1\u06f2\u06f3\u06f4\u06f5\u06f6\u06f7\u06f8\u06f9"

# Fixed value: words that come apart in some sources, and how they are written.
WORD_FIXES = {"محلو ل": "محلول"}


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f takes it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def collapse(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def without_invisible(c: Column) -> Column:
    """Without zero-width and direction marks and soft hyphens."""
    return F.regexp_replace(c, f"[{INVISIBLE}]", "")


def plain_spaces(c: Column, thin: bool = True) -> Column:
    """No-break spaces, and thin ones too, as spaces."""
    return F.translate(c, "\xa0" + ("\u2009" if thin else ""), "  "[: 1 + thin])


def latin_digits(c: Column, persian: bool = True) -> Column:
    """Arabic-Indic digits, and Persian ones too, as 0-9."""
    return F.translate(c, _ARABIC_INDIC + (_PERSIAN if persian else ""), "0123456789" * (1 + persian))


def split_lines(c: Column) -> Column:
    """Lines ended by any Unicode line end; no empty line after the last end."""
    lines = F.split(F.regexp_replace(c, "\\r\\n?", "\n"), f"[{LINE_ENDS}]")
    return bound(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def clean_text(c: Column, digits: str = "keep") -> Column:
    """One line of report text: invisible characters dropped, spaces plain and single."""
    c = plain_spaces(without_invisible(F.coalesce(c, F.lit(""))))
    return collapse(latin_digits(c) if digits == "latin" else c)


def clean_block(c: Column, indent: bool = False, digits: str = "keep") -> Column:
    """Report text of several lines: blanks single within lines, at most one empty line in a row, none at the ends.

    With indent the spaces that begin a line stay.
    """
    c = plain_spaces(without_invisible(F.coalesce(c, F.lit(""))))
    c = latin_digits(c) if digits == "latin" else c

    def line(x: Column) -> Column:
        body = strip(F.regexp_replace(strip(x) if indent else x, r"[ \t]+", " "))
        return F.concat(F.regexp_extract(x, r"^( *)", 1), body) if indent else body

    joined = F.array_join(F.transform(F.split(c, "\n"), line), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def clean_label(c: Column, digits: str = "keep") -> Column:
    """A label of a map: invisible characters dropped, spaces single. Only Arabic-Indic digits are folded."""
    c = without_invisible(F.coalesce(c, F.lit("")))
    return collapse(latin_digits(c, persian=False) if digits == "latin" else c)


def fix_spacing(c: Column, digits: str = "keep", fixes: dict[str, str] | None = None) -> Column:
    """Quiz text: spaces as they belong around punctuation and between Arabic and Latin, split words joined (WORD_FIXES, or others)."""
    c = strip(F.regexp_replace(c, r"[ \t]+", " "))
    c = F.translate(c, "\u2212\u2009", "- ")
    c = latin_digits(c) if digits == "latin" else c
    for apart, whole in (WORD_FIXES if fixes is None else fixes).items():
        c = F.replace(c, F.lit(apart), F.lit(whole))
    closing, a = "؟،؛.,;:!?)\\]", ARABIC_LETTER
    c = F.regexp_replace(c, f"([{a}]{{2,}})[{SPACE}]+([لة])(?![{a}])", "$1$2")
    c = F.regexp_replace(c, f"[{SPACE}]+([{closing}])", "$1")
    c = F.regexp_replace(c, f"([(\\[])[{SPACE}]+", "$1")
    c = F.regexp_replace(c, f"([{a}])(?=[A-Za-z0-9])", "$1 ")
    c = F.regexp_replace(c, f"([A-Za-z0-9%)\\]])(?=[{a}])", "$1 ")
    return strip(F.regexp_replace(c, " {2,}", " "))


def is_icon_name(c: Column) -> Column:
    """Whether a line is the name of an icon, such as arrow_back."""
    return c.rlike("^[a-z]+(?:_[a-z]+)+$")


def is_icon_word(c: Column) -> Column:
    return F.lower(c).isin("close", "check", "cancel", "lightbulb", "done")


def content_lines(lines: Column) -> Column:
    """An array of lines, each with its spacing fixed, without empty lines and icons."""
    fixed = F.transform(lines, lambda x: fix_spacing(x))
    return F.filter(fixed, lambda x: (x != "") & ~is_icon_name(x) & ~is_icon_word(x))


def lang_info(c: Column) -> Column:
    """struct(lang, dir): mixed with three letters or more of either script; dir by the first strong character."""
    arabic, latin = F.regexp_count(c, F.lit(f"[{ARABIC}]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    lang = F.when((arabic >= 3) & (latin >= 3), "mixed").when(arabic > latin, "ar").when(latin > 0, "en").otherwise("none")
    first = F.regexp_extract(c, f"([{ARABIC}A-Za-z])", 1)
    return F.struct(lang.alias("lang"), F.when(first.rlike(f"[{ARABIC}]"), "rtl").otherwise("ltr").alias("dir"))


def main_language(c: Column) -> Column:
    """ar with more Arabic than Latin letters, else en."""
    return F.when(F.regexp_count(c, F.lit(f"[{ARABIC}]")) > F.regexp_count(c, F.lit("[A-Za-z]")), "ar").otherwise("en")


def word_set(c: Column) -> Column:
    """The distinct lower-cased words of two characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}_\u0600-\u06ff]{2,})"), F.lit(1)))


def coverage(a: Column, b: Column) -> Column:
    """The share of the words of set a that set b has, to three places, half to even; null for an empty a."""
    return F.when(F.size(a) > 0, F.bround(F.size(F.array_intersect(a, b)) / F.size(a), 3))


def ends_sentence(c: Column) -> Column:
    return c.rlike("[.؟?!:؛]$")


# Phrases that tell whether an answer was right.
RIGHT = "right answer|correct( answer)?|الإجابة الصحيحة|إجابة صحيحة"
WRONG = "not quite|incorrect|wrong( answer)?|your answer is incorrect|إجابتك غير صحيحة|إجابة غير صحيحة|غير صحيحة"


def says_right(c: Column) -> Column:
    return c.rlike(rf"(?i)^({RIGHT})[^\p{{L}}\p{{N}}_]*$")


def says_wrong(c: Column) -> Column:
    return c.rlike(rf"(?i)^({WRONG})[^\p{{L}}\p{{N}}_]*$")


def marks_right(attrs: Column) -> Column:
    """Whether an option's attributes mark it as the right one."""
    return F.coalesce(attrs, F.lit("")).rlike("(?i)(?<!in)correct|icon:(?:check|done)")


def counter(c: Column) -> Column:
    """struct(number, total) of a line such as 3 / 10, else nulls."""
    digits = latin_digits(c)
    part = lambda i: F.regexp_extract(digits, rf"^[{SPACE}]*(\d+)[{SPACE}]*/[{SPACE}]*(\d+)[{SPACE}]*$", i)
    return F.struct(F.nullif(part(1), F.lit("")).cast("int").alias("number"), F.nullif(part(2), F.lit("")).cast("int").alias("total"))


def joined_counters(c: Column) -> Column:
    """Text in which a counter that is split over lines stands in one."""
    return F.regexp_replace(c, rf"(?m)^[ \t]*(\d+)[{SPACE}]*/[{SPACE}]*(\d+)[ \t]*$", "$1 / $2")


def option_parts(first_line: Column) -> Column:
    """struct(letter, first): the letter of an option line such as B) text, ? without one."""
    pattern = rf"(?s)^[{SPACE}]*([A-F])[{SPACE}]*[.)][{SPACE}]*(.*)$"
    letter = F.regexp_extract(first_line, pattern, 1)
    first = F.when(letter == "", first_line).otherwise(strip(F.regexp_extract(first_line, pattern, 2)))
    return F.struct(F.when(letter == "", "?").otherwise(letter).alias("letter"), first.alias("first"))


def join_parts(parts: Column) -> Column:
    """Parts joined by spaces, none before closing punctuation."""
    step = lambda out, x: F.when(out == "", x).when(x.rlike("^[؟،؛.,;:!?)\\]]"), F.concat(out, x)).otherwise(F.concat(out, F.lit(" "), x))
    return F.aggregate(parts, F.lit(""), step)


def padded_id(prefix: str, n: Column) -> Column:
    """Ids such as b007; a null counts as 0."""
    return F.format_string(f"{prefix}%03d", F.coalesce(n.cast("int"), F.lit(0)))


def source_url(url: Column) -> Column:
    """A url without its query, 200 characters at most."""
    return F.substring(F.substring_index(url, "?", 1), 1, 200)


def page_title(title: Column, product: str = "") -> Column:
    """A page's title, without the name of the product that may stand before a dash."""
    return strip(F.regexp_replace(title, rf"^[{SPACE}]*\Q{product}\E[{SPACE}]*[-–][{SPACE}]*", "") if product else title)


def title_stem(title: Column) -> Column:
    """A title up to its first dash or bar."""
    return F.regexp_replace(title, rf"[{SPACE}]*[-–|].*$", "")


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]<>])", r"\\$1")
