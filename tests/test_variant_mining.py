import json
import random

import pytest

from lumenfold.operators import json_mining, variant_mining
from lumenfold.plans import queries

from .oracles import SF

SCHEMA = "capture_id string, seq int, url string, body string, at string"


def made(seed):
    """Random JSON with long texts, some of them inside strings; keys in order."""
    r = random.Random(seed)
    long = lambda: "\n".join(["# é \"quoted\" \\ text"] * r.randrange(5, 30))

    def value(depth):
        kind = r.randrange(9)
        if depth > 5 or kind < 3:
            return r.choice([None, True, 1.5, 12345678901234567890, "short", long(), long(), "[broken" + "x" * 30, " " + json.dumps([long()]) + "\n"])
        if kind < 5:
            return [value(depth + 1) for _ in range(r.randrange(4))]
        if kind < 6:
            return json.dumps({"inner": value(depth + 1)}, sort_keys=True)
        return {f"k{i}": value(depth + 1) for i in range(r.randrange(4))}

    body = json.dumps(value(0), ensure_ascii=r.random() < 0.5)
    shape = r.randrange(5)
    if shape == 0:
        return ")]}'\n" + body
    if shape == 1:
        return body + "\n" + json.dumps({"line": value(2)}) + "\r\nno json\n"
    if shape == 2:
        return body + " trailing"
    if shape == 3:
        return "plain\n" + "text " * r.choice([10, 200])
    return "  " + body


def rows_of(spark, bodies):
    return spark.createDataFrame([(str(i), i, f"u{i}", b, "?") for i, b in enumerate(bodies)], SCHEMA)


def test_texts_like_pythons_parser(spark):
    bodies = [made(i) for i in range(120)] + [None, "", "[]", "{}", "[1] x", "[1],[2]", "[1]] [[2]", '[1],"\\u0001end of value\\u0002"] [', "[" * 60 + json.dumps("a\n" * 200) + "]" * 60, "[" * 20 + json.dumps("b\n" * 200) + "]" * 20]
    got = {}
    for r in variant_mining.texts_of_captures(rows_of(spark, bodies)).collect():
        got.setdefault(r.seq, []).append((r.at, r.text))
    want = {i: list(dict.fromkeys(t)) for i, b in enumerate(bodies) if b is not None and (t := json_mining.texts_of(b))}
    assert {i: list(dict.fromkeys(t for _, t in sorted(x))) for i, x in got.items()} == want  # a body of one line is read once here


def test_best_like_pythons_parser(spark):
    bodies = rows_of(spark, [made(i) for i in range(200, 260)]).withColumn("capture_id", (json_mining.F.col("seq") % 7).cast("string"))
    assert sorted(map(tuple, variant_mining.markdown_of_captures(bodies).collect())) == sorted(map(tuple, json_mining.markdown_of_captures(bodies).collect()))


@pytest.mark.parametrize(
    ("body", "here", "there"),
    [
        ('{"a": 1, "a": "T"}', 0, 1),  # a key twice
        ('[NaN, "T"]', 0, 1),
        ('[Infinity, "T"]', 0, 1),
        ('["T"] x', 0, 0),
        ('[1e999, "T"]', 1, 1),
    ],
)
def test_where_it_differs_from_pythons_parser(spark, body, here, there):
    text = "line\n" * 80
    body = body.replace('"T"', json.dumps(text))
    assert bool(json_mining.texts_of(body)) == bool(there)
    assert bool(variant_mining.texts_of_captures(rows_of(spark, [body])).count()) == bool(here)


def test_order_of_keys_decides_ties(spark):
    text = lambda c: f"# {c}\n" + "- item\n" * 60
    body = json.dumps({"z": text("z"), "a": text("a")})
    (here,), (there,) = (m.markdown_of_captures(rows_of(spark, [body])).collect() for m in (variant_mining, json_mining))
    assert (here.markdown, there.markdown) == (text("a"), text("z"))


def test_plan_has_no_python(spark):
    bodies = rows_of(spark, [made(1)])
    plan = spark._jvm.PythonSQLUtils.explainString(bodies.select(variant_mining.documents(json_mining.F.col("body")))._jdf.queryExecution(), "formatted")
    assert "Python" not in plan.replace("PythonRDD", "") and "ArrowEval" not in plan
    assert variant_mining.texts_of_captures(bodies.where("false")).collect() == []


def test_bodies_are_dealt_to_all_cores(spark):
    """A table of one small file must not be opened by one task."""
    assert queries._mined_bodies(spark, SF, deep=True).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_body_is_stripped_and_split_once(spark):
    """What a condition repeats is worked out anew each time."""
    plan = spark.range(1).select(variant_mining.documents(json_mining.F.lit(None).cast("string")).alias("found"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("btrim(") == 2  # the body, and each of its parts
    assert plan.count("split(") == 1
    assert plan.count("regexp_replace(") == 1
