"""Small captures, written by hand, for operators whose inputs no table holds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

def bodies(spark: SparkSession) -> DataFrame:
    small = {"name": "root", "children": [{"name": "a"}, {"name": "b"}]}
    tree = {"title": "Root", "nodes": [{"label": "A", "items": [{"text": "A1"}, {"no": 1, "children": [{"name": "lost"}]}]}, {"name": "B"}]}
    rows = [
        ("x", 1, "u1", "xhr", ")]}'\n" + json.dumps(small)),
        ("x", 2, "u2", "xhr", "noise\n" + json.dumps({"data": json.dumps(tree)}) + "\nmore"),
        ("y", 1, "u3", "document", json.dumps(small)),
        ("z", 1, "u4", "document", "no json"),
    ]
    return spark.createDataFrame(rows, "capture_id string, seq int, url string, resource_type string, body string")


def fragments_and_links(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A root at the left, two branches, and three leaves, one of them in two fragments."""

    def box(ord_: int, t: str, x: float, y: float, ui: bool = False) -> tuple:
        return ("m", ord_, t, float(x), float(y), float(x + 60), float(y + 20), 14.0, ui)

    rows = [box(0, "Root", 0, 100), box(1, "Left", 200, 50), box(2, "Right", 200, 150), box(3, "One", 400, 20), box(4, "Two", 400, 80), box(5, "Three", 400, 150), box(6, " more", 465, 150), box(7, "menu", 600, 0, True), box(8, ">", 300, 50)]
    links = [("m", 0, 60.0, 110.0, 200.0, 60.0), ("m", 1, 60.0, 110.0, 200.0, 160.0)]
    frame = spark.createDataFrame(rows, "capture_id string, ord int, t string, x0 double, y0 double, x1 double, y1 double, sz double, ui boolean")
    return frame, spark.createDataFrame(links, "capture_id string, ord int, ax double, ay double, bx double, by double")


def quiz_states(spark: SparkSession) -> DataFrame:
    mark = "@@OPT@@"
    root = f"1\n/ 3\nWhat is 2 + 2?\nكم يساوي 2 + 2؟\n{mark}\n{mark}\nHint"
    pre = [(0, "A. Three\nثلاثة", ""), (1, "B) Four\nأربعة", "")]
    told = [(0, "A. Three\nثلاثة\nNot quite\nToo small", ""), (1, "B) Four\nأربعة\nRight answer\nTwo and two", "")]
    by_mark = [(0, "A. x\nwhy", "aria-label correct"), (1, "B. y", "incorrect")]
    rows = [
        ("a", 1, "pre", root, pre),
        ("a", 1, "hint", root + "\nCount your fingers", pre),
        ("a", 1, "reveal", root, told),
        ("a", 2, "pre", f"2 / 3\n{mark}\n{mark}", [(0, "A. x", ""), (1, "B. y", "")]),
        ("a", 2, "reveal", f"2 / 3\n{mark}\n{mark}", by_mark),
        ("a", 3, "pre", root, pre),
        ("b", 1, "pre", "1 / 1\nNo options here", []),
    ]
    return spark.createDataFrame(rows, "capture_id string, step int, phase string, root string, options array<struct<i:int,raw:string,attrs:string>>")
