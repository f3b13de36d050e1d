import datetime
import hashlib
import json

from pyspark.sql import functions as F

from lumenfold.plans import whole_queries, whole_results
from lumenfold.sources import captures as sources

from . import fixtures

AT = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def caps(spark, rows):
    return spark.createDataFrame([(c, kind, f"http://h/{c}?q", f"base-{c}", title, url, None) for c, kind, title, url in rows], sources.SCHEMAS["captures"])


def test_maps(spark):
    frags, links = fixtures.fragments_and_links(spark)
    boxes = [(0, "A", 0, 100), (1, "B", 0, 400), (2, "a", 200, 80), (3, "b", 200, 120), (4, "c", 200, 400)]
    two = spark.createDataFrame([("roots", i, t, float(x), float(y), x + 60.0, y + 20.0, 14.0, False) for i, t, x, y in boxes], frags.schema)
    frags = frags.unionByName(two).withColumn("frame_id", F.lit(1))
    ad = frags.where("capture_id = 'm' and ord < 2").withColumn("frame_id", F.lit(0))
    links = links.withColumn("frame_id", F.lit(1))
    short = links.withColumn("bx", F.col("ax") + 5)  # runs down, so it is no path of the map
    bodies = fixtures.bodies(spark)
    rows = [("m", "mindmap", "T", None), ("m", "mindmap", "T", None), ("x", "mindmap", None, None), ("y", "mindmap", None, None), ("roots", "mindmap", "Page - Maker", None), ("in", "mindmap", None, "http://accounts.h/"), ("r", "report", None, None)]
    nodes, meta, failed = whole_results.maps(caps(spark, rows), frags.unionByName(ad), links.unionByName(short), bodies, at=AT)
    docs = {r.capture_id: json.loads(r.json) for r in whole_results.map_json(nodes, meta).collect()}
    assert set(docs) == {"m", "x", "roots"}
    m = docs["m"]
    assert m["meta"] == {"title": "Root", "source_url": "http://h/m", "method": "dom", "extracted_at": "2024-01-01T00:00:00+00:00", "node_count": 6, "leaf_count": 3, "max_depth": 2, "quality": {"bilingual_nodes": 0, "ar_only": 0, "en_only": 6, "primary_en": 6, "primary_ar": 0, "untranslated_ids": ["1", "1.1", "1.1.1", "1.1.2", "1.2", "1.2.1"]}, "warnings": []}

    def walk(n):
        return [n, *(x for c in n["children"] for x in walk(c))]

    for d in docs.values():
        nested = walk(d["root"])
        assert [{k: v for k, v in n.items() if k != "children"} for n in nested] == [{k: v for k, v in n.items() if k not in ("parent", "order", "is_leaf")} for n in d["nodes"]]
        assert [[c["id"] for c in n["children"]] for n in nested] == [[k["id"] for k in d["nodes"] if k["parent"] == n["id"]] for n in nested]
    assert docs["x"]["meta"]["network_source"] == "u2" and docs["x"]["meta"]["method"] == "network"
    assert docs["roots"]["root"]["text"] == "Page" and "several_roots" in docs["roots"]["meta"]["warnings"]
    assert sorted(map(tuple, failed.collect())) == [("in", "mindmap", "sign_in"), ("y", "mindmap", "too_few_nodes")]


def test_quizzes(spark):
    rows = [("a", "quiz", None, None), ("a", "quiz", None, None), ("b", "quiz", None, None), ("none", "quiz", None, None), ("m", "mindmap", None, None)]
    documents, text, failed = whole_results.quizzes(caps(spark, rows), fixtures.quiz_states(spark), at=AT)
    ((capture, document),) = documents.collect()
    found = json.loads(document)
    assert capture == "a"
    assert found["meta"] == {"schema_version": "2.0", "title": "base-a", "source_url": "http://h/a", "extracted_at": "2024-01-01T00:00:00+00:00", "total_declared": 3, "total_extracted": 2, "answers_revealed": True, "languages": ["en", "ar"], "warnings_count": sum(len(q["warnings"]) for q in found["questions"])}
    assert found["meta"]["warnings_count"] > 0
    assert [q["number"] for q in found["questions"]] == [1, 2]
    assert [r.capture_id for r in text.collect()] == ["a"]
    assert sorted(map(tuple, failed.collect())) == [("b", "quiz", "no_questions"), ("none", "quiz", "no_questions")]


def test_empty_tables(spark):
    none = {t: spark.createDataFrame([], s) for t, s in sources.SCHEMAS.items()}
    nodes, meta, failed = whole_results.maps(none["captures"], none["frags"], none["links"], none["net_bodies"])
    assert nodes.count() == meta.count() == failed.count() == whole_results.map_json(nodes, meta).count() == 0
    assert [x.count() for x in whole_results.quizzes(none["captures"], none["quiz_states"])] == [0, 0, 0]


def test_lines_of_quizzes_are_their_documents(spark):
    rows = [("a", "quiz", None, None), ("b", "quiz", None, None), ("none", "quiz", None, None)]
    own, states = caps(spark, rows), fixtures.quiz_states(spark)
    lines = whole_results.quiz_lines(own, states, at=AT).orderBy("capture_id", "part", "step").collect()
    documents, _, _ = whole_results.quizzes(own, states, at=AT)
    assert {r.capture_id: r.json for r in documents.collect()} == {c: "".join(r.line for r in lines if r.capture_id == c) for c in {r.capture_id for r in lines}}
    assert [(r.part, r.step, r.line[:1]) for r in lines] == [(0, None, "{"), (1, 1, "{"), (1, 2, ","), (2, None, "]")]


def test_no_row_of_a_large_quiz_holds_its_document(spark, tmp_path):
    """The query's rows, but for those of the digests, are lines: nothing collects a brand's questions."""
    part = spark.range(0, 300, 1, 2).select(F.col("id").alias("p_partkey"), F.format_string("part %d", "id").alias("p_name"), F.lit("Brand").alias("p_brand"), F.lit("TYPE").alias("p_type"), (F.col("id") % 7).cast("int").alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    found = whole_queries.quiz_results(spark, str(tmp_path))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    (row,) = found.collect()
    answers = "\n".join(f"{'AB'[i % 7 % 2]} part {i}" for i in range(300))
    assert (row.total_extracted, row.answers) == (300, hashlib.md5(answers.encode()).hexdigest())
