"""Long texts inside captured JSON, without Python: bodies as VARIANT values that are opened level by level.

Each level is a narrow step: containers give their values by variant_explode, strings that hold JSON are parsed, and what is found
is written, so that a level is made once and lineage stays short. (A recursive common table expression would do the same, but
stops at a number of rows that only the session's settings can lift.)

Where this differs from json_mining, whose parser is Python's: an object with a key twice isn't JSON; NaN and Infinity aren't
either; the values of an object come in the order of their keys, which decides between texts of equal score; numbers beyond
decimal(38) are doubles, which no text depends on. Text after a value makes a part no JSON in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import markdown as M
from lumenfold.functions.text import SPACES, bound, split_lines, strip
from lumenfold.operators.json_mining import BARE, HIDDEN, LEAST_SCORE, TEXT, VALUE_LEVELS
from lumenfold.sources.tables import dropped, written

#: Stands after a text that is parsed, so that text after a value can't be passed over.
_END = "\\u0001end of value\\u0002"


def _pair(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))


def _first(pair: Column) -> Column:
    ended = F.try_variant_get(pair, "$[1]", "string") == F.lit("\x01end of value\x02")
    return F.when(ended, F.try_variant_get(pair, "$[0]", "variant"))


def parsed(text: Column) -> Column:
    """The VARIANT that a text is as a whole, null if it isn't JSON. Through arrays, so that it is parsed once."""
    return bound(bound(text, _pair), _first)


def _begins(text: Column) -> Column:
    return text.startswith("[") | text.startswith("{")


def documents(body: Column) -> Column:
    """What parses of a body as a whole and of each of its lines, equal ones once, without the prefix that guards against inclusion: an array with nulls for what doesn't."""
    whole = bound(strip(body), lambda x: F.when(x.startswith(")]}'"), F.substr(x, F.lit(5))).otherwise(x))
    parts = bound(whole, lambda x: F.array_distinct(F.filter(F.transform(F.concat(F.array(x), split_lines(x)), strip), _begins)))
    return F.transform(F.transform(parts, _pair), _first)


def _kept(v: Column) -> Column:
    """text and v of a value, one of them null, as an array: none for what is neither a string nor a container. A kind takes a look at all that a value holds, so it is made once."""

    def either(x: Column) -> Column:
        is_text = x["kind"] == "STRING"
        return F.struct(F.when(is_text, F.try_variant_get(x["v"], "$", "string")).alias("text"), F.when(~is_text, x["v"]).alias("v"))

    kinds = F.transform(F.array(v), lambda x: F.struct(F.schema_of_variant(x).alias("kind"), x.alias("v")))
    return F.transform(F.filter(kinds, lambda x: x["kind"].rlike("^(STRING$|OBJECT|ARRAY)")), either)


def texts_of_captures(bodies: DataFrame) -> DataFrame:
    """capture_id, seq, url, at, text: strings of over 300 characters and several lines in bodies (capture_id, seq, url, body), JSON within strings opened.

    at is the way to a text: the part of the body (whole or a line, equal ones once), then places in containers. A body in which nothing parses is a text itself if
    it is longer than 600. Null bodies have none; a body that repeats gives its texts again; an empty table has none.
    """
    own = bodies.where("body is not null").select(F.col("capture_id").cast("string").alias("capture_id"), F.col("seq").cast("long").alias("seq"), "url", "body", documents(F.col("body")).alias("found"))
    id_ = ["capture_id", "seq", "url"]
    first = F.transform(F.filter(F.transform("found", lambda v, i: F.struct(F.array(i).alias("at"), v.alias("v"))), lambda x: x["v"].isNotNull()), lambda x: x)
    rows = written(own.select(*id_, F.when(F.forall("found", lambda v: v.isNull()) & (F.length("body") > BARE) & F.contains("body", F.lit("\n")), F.col("body")).alias("bare"), first.alias("first")))
    texts = rows.where("bare is not null").select(*id_, F.array(F.lit(0)).alias("at"), F.col("bare").alias("text"))
    level = written(rows.select(*id_, F.inline("first")).select(*id_, "at", F.inline(_kept(F.col("v")))))
    done = [level]
    for _ in range(VALUE_LEVELS + 1):
        strings = level.where("text is not null").select(*id_, "at", "text")
        texts = texts.unionByName(strings.where((F.length("text") > TEXT) & F.contains("text", F.lit("\n"))))
        if len(done) > VALUE_LEVELS:
            break
        held = level.where("v is not null").select(*id_, "at", "v")
        inside = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*id_, F.concat("at", F.array("pos")).alias("at"), F.col("value").alias("v"))
        bare = strip(F.col("text"))
        json = strings.where(_begins(F.ltrim(F.col("text"), F.lit(SPACES))) & (F.length(bare) > HIDDEN))  # most strings are no JSON by their first character
        opened = json.select(*id_, F.concat("at", F.array(F.lit(0))).alias("at"), parsed(bare).alias("v"))
        level = written(inside.unionByName(opened).select(*id_, "at", F.inline(_kept(F.col("v")))))
        if level.isEmpty():
            break
        done.append(level)
    out = written(texts.select(*id_, "at", "text"))
    dropped(rows, *done, level)
    return out


def markdown_of_captures(bodies: DataFrame) -> DataFrame:
    """capture_id, markdown, url, score: the best Markdown of each capture's bodies, from 0.25 on; of equal scores the least seq counts, then the first text of a body."""
    scored = texts_of_captures(bodies).withColumn("score", M.score(F.col("text"))).where(F.col("score") >= LEAST_SCORE)
    first = F.struct("score", -F.col("seq"), F.concat(F.transform("at", lambda x: -x), F.array(F.lit(1))).alias("at"))
    return scored.groupBy("capture_id").agg(F.max_by("text", first).alias("markdown"), F.max_by("url", first).alias("url"), F.max("score").alias("score"))
