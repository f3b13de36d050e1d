import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.sources import bundles
from lumenfold.streaming.captures import run_through


@pytest.fixture(scope="module")
def known(spark):
    bundles.register(spark)
    return spark


def put(path, rows, packed=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    text = "\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n"
    with gzip.open(path, "wt") if packed else open(path, "w") as out:
        out.write(text)


def body(capture, seq, text="x", **more):
    return {"table": "net_bodies", "capture_id": capture, "seq": seq, "url": f"u{seq}", "resource_type": "xhr", "body": text} | more


def read(spark, path, table, **options):
    return spark.read.format("captures").options(table=table, **options).load(str(path))


def test_tables_types_and_odd_lines(known, tmp_path):
    rows = [
        {"table": "captures", "capture_id": "a", "kind": "report", "captured_at": "2024-05-01T10:00:00+02:00", "more": 1},
        {"table": "captures", "capture_id": "b", "kind": 7, "captured_at": "yesterday"},
        {"table": "quiz_states", "capture_id": "q", "step": 1, "options": [{"i": 0, "raw": "A) x"}, {"i": "zero"}, None]},
        body("a", 1, "é  \"net_bodies\""),
        body("a", "one", None),
        "not json",
        "[1]",
        "",
        {"table": "other", "capture_id": "net_bodies"},
    ]
    put(tmp_path / "kind=report" / "x.jsonl", rows)
    put(tmp_path / "_hidden" / "y.jsonl", [body("z", 1)])
    got = {r.capture_id: r for r in read(known, tmp_path, "captures").withColumn("captured_at", F.col("captured_at").cast("string")).collect()}
    assert got["a"].captured_at == "2024-05-01 08:00:00" and got["a"].share_url is None
    assert got["b"].kind == "7" and got["b"].captured_at is None
    assert sorted(map(tuple, read(known, tmp_path, "net_bodies").collect()), key=str) == sorted([("a", 1, "u1", "xhr", "é  \"net_bodies\""), ("a", None, "uone", "xhr", None)], key=str)
    (quiz,) = read(known, tmp_path, "quiz_states").collect()
    assert [o and tuple(o) for o in quiz.options] == [(0, "A) x", None), (None, None, None), None]
    assert read(known, tmp_path, "links").collect() == []
    with pytest.raises(Exception, match="not a JSON object"):
        read(known, tmp_path, "net_bodies", mode="FAILFAST").collect()
    with pytest.raises(Exception, match="no such table"):
        read(known, tmp_path, "nothing")


def test_every_line_once_however_files_are_cut(known, tmp_path):
    r = random.Random(3)
    want = []
    for i in range(5):
        rows = [body(f"c{i}", j, "é" * r.randrange(400)) for j in range(r.randrange(1, 60))]
        want += [(x["capture_id"], x["seq"], x["body"]) for x in rows]
        put(tmp_path / f"{i}.jsonl{'.gz' if i == 3 else ''}", rows, i == 3)
    for split in (2000, 7000, 1 << 20):
        got = read(known, tmp_path, "net_bodies", split=split).select("capture_id", "seq", "body")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_parts_of_a_file_share_out_its_lines(tmp_path):
    r = random.Random(5)
    for _ in range(200):
        lines = [b"x" * r.choice([0, 1, 2, 9]) for _ in range(r.randrange(1, 12))]
        data = b"\n".join(lines) + r.choice([b"", b"\n"])
        (tmp_path / "f").write_bytes(data)
        fs = bundles.pa.fs.LocalFileSystem()
        split = r.randrange(1, 12)
        got = [x for a in range(0, len(data), split) for x in bundles._lines(fs, str(tmp_path / "f"), a, min(a + split, len(data)))]
        assert [x for x in got if x] == [x for x in lines if x]


def test_filters_reach_the_source(known, tmp_path):
    put(tmp_path / "kind=report" / "x.jsonl", [{"table": "captures", "capture_id": "a", "kind": "report"}, {"table": "captures", "capture_id": "n", "kind": "report"}])
    put(tmp_path / "kind=quiz" / "broken.jsonl", ["no json"])
    all_of = read(known, tmp_path, "captures", mode="FAILFAST")
    one = all_of.where("kind = 'report' and capture_id in ('a', 'b')")
    assert [r.capture_id for r in one.collect()] == ["a"]  # the other folder isn't read, or it would fail
    plan = known._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(kind,report), In(capture_id, [a,b])]" in plan
    assert all_of.where("kind = 'report' and (kind = 'quiz' or capture_id like 'a%')").count() == 1
    assert all_of.where("kind = 'report' and kind = 'quiz'").count() == 0
    assert read(known, tmp_path, "captures", mode="FAILFAST", kind="report").count() == 2


def test_stream_takes_each_file_once(known, tmp_path):
    source = tmp_path / "in"
    put(source / "b.jsonl", [body("a", 1), body("b", 1)])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = known.readStream.format("captures").options(table="net_bodies", settle=0).load(str(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.capture_id, r.seq) for r in known.read.parquet(out).collect())

    assert run() == [("a", 1), ("b", 1)]
    put(source / "a.jsonl", [body("a", 2)])
    put(source / "_part.jsonl", [body("no", 2)])
    assert run() == [("a", 1), ("a", 2), ("b", 1)]
    assert run() == [("a", 1), ("a", 2), ("b", 1)]


def test_stream_through_a_stateful_operator(known, tmp_path):
    from lumenfold.streaming.captures import best_markdown

    text = "# T\n\n" + "- item\n" * 80
    put(tmp_path / "in" / "a.jsonl", [body("a", 1, json.dumps({"x": text})), body("a", 2, json.dumps({"x": "plain " * 100 + "\n"}))])
    stream = known.readStream.format("captures").options(table="net_bodies", settle=0).load(str(tmp_path / "in"))
    (row,) = run_through(best_markdown(stream), "complete").collect()
    assert (row.capture_id, row.markdown) == ("a", text)


def test_documents_as_files(known, tmp_path):
    rows = [("a/b", '{"x": 1}'), ("..", "{}"), ("_u", "[]"), ("é" * 100, "1"), (None, "{}"), ("n", None), ("", "0")]
    path = tmp_path / "out"
    docs = known.createDataFrame([(*r, i) for i, r in enumerate(rows)], "capture_id string, json string, n int")
    docs.write.format("captures").mode("append").save(str(path))
    docs.where("n = 0").select("json", "capture_id").write.format("captures").option("fan", 2).mode("append").save(str(path))
    names = sorted(str(p.relative_to(path)) for p in path.rglob("*.json"))
    assert len(names) == 6 and "a%2Fb.json" in names and "%2E%2E.json" in names
    assert json.loads((path / "a%2Fb.json").read_text()) == {"x": 1}
    assert json.loads((path / "_SUCCESS").read_text())["documents"] == 1
    docs.where("n = 1").write.format("captures").mode("overwrite").save(str(path))
    assert [p.name for p in path.rglob("*.json")] == ["%2E%2E.json"]


def test_written_documents_are_read_by_folders(known, tmp_path):
    path = tmp_path / "out"
    docs = known.range(0, 700, 1, 3).select(F.col("id").cast("string").alias("capture_id"), F.format_string('{"n": %d, "t": "é"}', "id").alias("json"))
    docs.write.format("captures").option("fan", 1).mode("append").save(str(path))
    docs.where("capture_id = '5'").write.format("captures").mode("append").save(str(path))
    (path / "0" / "_5.json.1").write_text("half")
    parts = bundles.DocumentReader(None, {"path": str(path)}).partitions()
    assert [(p.path.rsplit("/", 1)[1], p.deep) for p in parts] == [("out", False), *((x, True) for x in "0123456789abcdef")]
    found = known.read.format("captures").option("table", "documents").load(str(path))
    want = [(str(i), f'{{"n": {i}, "t": "é"}}') for i in (*range(700), 5)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.rdd.getNumPartitions() == 17
