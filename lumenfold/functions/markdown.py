"""Markdown at the level of lines, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import SPACE, collapse, strip

# Box-drawing characters and arrows of text diagrams.
BOX_STRONG = "─━│┃┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬═║"
BOX = BOX_STRONG + "▼▲◄►◀▶↓↑"

LIST_ITEM = rf"^([{SPACE}]*)([*+•\-–]|\d+[.)])[{SPACE}]+(.*)$"
TABLE_RULE = rf"^[{SPACE}]*\|?[{SPACE}]*:?-{{2,}}:?[{SPACE}]*(\|[{SPACE}]*:?-{{2,}}:?[{SPACE}]*)*\|?[{SPACE}]*$"
# Fixed value: a link, and what stands within it (group 2), or else all up to the next closing bracket (groups 1 and 3 stay), so that no bracket is tried twice.
LINK = r"([^\[\]]*)(?:\[([^\]]+)\]\([^)]+\)|([^\]]*(?:\]|$)))"


def _up_to_last(c: Column, mark: str, f: Callable[[Column], Column]) -> Column:
    """f of a text up to its last mark, and the rest as it is: what needs the mark later on isn't looked for there."""
    rest = F.substring_index(c, mark, -1)
    return F.when(F.contains(c, F.lit(mark)), F.concat(f(F.substring(c, F.lit(1), F.length(c) - F.length(rest))), rest)).otherwise(c)


def plain(md: Column) -> Column:
    """The text of a line of Markdown: links, emphasis and code unwrapped, stray stars dropped, spaces single."""
    t = strip(md)
    t = _up_to_last(t, ")", lambda x: F.regexp_replace(x, LINK, "$1$2$3"))
    t = F.regexp_replace(t, r"\*\*(.+?)\*\*", "$1")
    word = r"\p{L}\p{N}_"
    t = F.regexp_replace(t, rf"(?<![{word}*])\*(?![{SPACE}])(.+?)(?<![{SPACE}])\*(?![{word}*])", "$1")
    t = F.regexp_replace(t, "`([^`]+)`", "$1")
    return collapse(F.replace(t, F.lit("*"), F.lit("")))


def row_cells(line: Column) -> Column:
    """The cells of a table line between bars; a bar at either end is no cell."""
    body = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(body, r"\|"), strip)


def padded(rows: Column) -> Column:
    """Rows of cells, each as wide as the widest, filled with empty cells."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def is_ragged(rows: Column) -> Column:
    return F.array_max(F.transform(rows, F.size)) != F.array_min(F.transform(rows, F.size))


def is_diagram(line: Column) -> Column:
    """Whether a line belongs to a text diagram."""
    return line.rlike(f"[{BOX_STRONG}]") | (line.rlike("[▼▲◄►]|(?:─|-){2,}>|<(?:─|-){2,}") & line.rlike(f"[{BOX}]"))


def score(c: Column) -> Column:
    """How much a text looks like Markdown: the share of lines with a mark, less for short texts, and 0.5 for a heading."""
    lines = F.split(c, "\n")
    marks = F.size(F.filter(lines, lambda x: x.rlike(rf"^[{SPACE}]*(#{{1,6}}[{SPACE}]|[*\-•][{SPACE}]|\d+[.)][{SPACE}]|\|)")))
    heading = F.when(c.rlike(rf"(?m)^#{{1,3}}[{SPACE}]"), 0.5).otherwise(0.0)
    return F.when(F.size(lines) < 6, 0.0).otherwise(marks / F.size(lines) * F.least(F.lit(1.0), F.length(c) / 3000) + heading)
