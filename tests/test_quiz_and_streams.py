import datetime
import json
import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.operators import quiz, reconcile
from lumenfold.plans import reports
from lumenfold.plans.queries import QUERIES
from lumenfold.sources import captures
from lumenfold.streaming import captures as streams

from . import fixtures
from .oracles import SF


def added(before, after):
    out, rest = [], list(before)
    for x in after:
        if rest and rest[0] == x:
            rest.pop(0)
        else:
            out.append(x)
    return out


def test_added_lines(spark):
    cases = [(["a", "b"], ["a", "x", "b", "b"]), ([], ["q"]), (["a", "b"], ["b", "a", "b"]), (["a"], [])]
    rows = spark.createDataFrame(cases, "p array<string>, q array<string>").coalesce(1)
    assert [list(r[0]) for r in rows.select(quiz.added_lines(F.col("p"), F.col("q"))).collect()] == [added(*c) for c in cases]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6))
def test_nothing_is_added_to_itself(lines):
    assert added(lines, lines) == []


def test_quiz(spark):
    written, summary, text = reports.quizzes(fixtures.quiz_states(spark))
    rows = {(r.capture_id, r.step): r for r in written.collect()}
    first = rows["a", 1]
    assert (first.id, first.number, first.total) == ("q001", 1, 3)
    assert (first.question.en, first.question.ar) == ("What is 2 + 2?", "كم يساوي 2 + 2؟")
    assert first.hint.en == "Count your fingers"
    assert first.answer["keys"] == ["B"]
    assert first.answer.explanation.en == "Two and two"
    assert rows["a", 2].answer["keys"] == ["A"]
    assert rows["a", 2].warnings == ["empty_question", "missing_explanation"]
    assert rows["b", 1].warnings == ["options_lt_2", "no_correct_answer"]
    assert ("a", 3) not in rows
    assert {(s.capture_id, s.total_declared, s.total_extracted) for s in summary.collect()} == {("a", 3, 2), ("b", 1, 1)}
    assert "✓ B. Four" in {t.capture_id: t.text for t in text.collect()}["a"]


def test_quiz_without_reveal(spark):
    written, _, _ = reports.quizzes(fixtures.quiz_states(spark), reveal=False, hints=False)
    r = written.where("capture_id = 'a' and step = 1").first()
    assert r.answer["keys"] == []
    assert r.warnings == []
    assert r.hint.en == ""


def test_lone_letters_and_missing_arabic(spark):
    rows = spark.createDataFrame([("k", 1, "سؤال", [("A", "some words", ""), ("A", "5 % = x", ""), ("B", "", "كلمة ب و")])], "capture_id string, step int, ar string, o array<struct<l:string,en:string,ar:string>>")
    none = F.struct(F.lit("e").alias("en"), F.lit("").alias("ar"))
    built = rows.select(
        "capture_id", "step", F.lit(None).cast("int").alias("number"), F.lit(None).cast("int").alias("total"), F.struct(F.lit("").alias("en"), F.col("ar").alias("ar")).alias("stem"), F.lit(None).cast("struct<en:string,ar:string>").alias("hint"),
        F.transform("o", lambda x: F.struct(x["l"].alias("letter"), F.struct(x["en"].alias("en"), x["ar"].alias("ar")).alias("text"), F.lit("").alias("status"), none.alias("explanation"))).alias("options"), F.array(F.lit("A")).alias("correct"),
    )
    got = quiz.checked(built).first()
    assert got.id == "q000"
    assert [o.is_correct for o in got.options] == [True, True, False]
    assert got.warnings == ["option_B_lone_arabic_letter"]


def test_choice_of_method(spark):
    rows = [("1", "a1 b1 c1", None), ("2", "", "x1"), ("3", "a1 b1", "a1 b1 c1"), ("4", "a1 b1 c1", "a1 b1"), ("5", "a1 b1 c1", "z1")]
    got = reconcile.chosen_method(spark.createDataFrame(rows, "capture_id string, dom_text string, network_text string")).orderBy("capture_id").collect()
    assert [(r.method, r.coverage, r.warning) for r in got] == [("dom", None, None), ("network", None, None), ("network", 1.0, None), ("dom", 0.667, "network_mismatch"), ("dom", 0.0, None)]


def test_report_end_to_end(spark):
    caps = spark.createDataFrame([("c", "report", "http://h/x?q=1", "base", "Page - Site", "http://h", None), ("d", "report", "u", "b", "p", "u", None)], captures.SCHEMAS["captures"])
    page = "<body><h1>Title</h1><hr><p>" + "word " * 40 + "</p><p>" + "more " * 40 + "</p></body>"
    dom = spark.createDataFrame([("c", 0, 0, page), ("c", 1, 0, "<p>ad</p>"), ("d", 0, 0, "<p>short</p>")], captures.SCHEMAS["dom_html"])
    net = spark.createDataFrame([], captures.SCHEMAS["net_bodies"])
    blocks, meta, failed = reports.reports(caps, dom, net, at=datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC))
    assert [(r.id, r.type) for r in blocks.where(F.col("doc_id") == meta.first().doc_id).orderBy("pos").collect()] == [("b001", "heading"), ("b002", "paragraph"), ("b003", "paragraph")]
    m = meta.first()
    assert (m.capture_id, m.title, m.method, m.hr_dropped, m.page_title, m.source_url) == ("c", "Title", "dom", 1, "Page - Site", "http://h/x")
    assert [(f.capture_id, f.reason) for f in failed.collect()] == [("d", "too_short")]
    import json

    doc = json.loads(reports.report_json(blocks, meta).first().json)
    assert doc["schema"] == "report-1.0"
    assert doc["outline"] == [{"id": "b001", "level": 1, "text": "Title"}]
    assert [b["id"] for b in doc["blocks"]] == ["b001", "b002", "b003"]


def test_report_of_several_snapshots(spark):
    para = lambda i: f"<p>{f'word{i} ' * 30}</p>"
    page = lambda *ps: "<body><h1>Title</h1>" + "".join(map(para, ps)) + "</body>"
    caps = spark.createDataFrame([(c, "report", "http://h/x", "base", "Page", "http://h", None) for c in ("lazy", "few")], captures.SCHEMAS["captures"])
    shown = [(0, 1), (1, 2), (3, 4, 5), (5, 6), (6, 7)]
    rows = [("lazy", 0, i, page(*ps)) for i, ps in enumerate(shown)] + [("few", 0, 0, page(1)), ("few", 0, 1, page(1, 3, 4)), ("few", 0, 2, page(1, 2))]
    net = spark.createDataFrame([], captures.SCHEMAS["net_bodies"])
    blocks, meta, failed = reports.reports(caps, spark.createDataFrame(rows, captures.SCHEMAS["dom_html"]), net)
    metas = {m.capture_id: m for m in meta.collect()}
    words = {c: [r.text.split()[0] for r in blocks.where((F.col("doc_id") == m.doc_id) & (F.col("type") == "paragraph")).orderBy("pos").collect()] for c, m in metas.items()}
    # in the lazy capture 3, 4, 5 follow no known block but the title
    assert words == {"lazy": ["word3", "word4", "word5", "word6", "word7", "word0", "word1", "word2"], "few": ["word1", "word2", "word3", "word4"]}
    assert "lazy_merge" in metas["lazy"].warnings
    assert "lazy_merge" not in metas["few"].warnings
    assert failed.collect() == []


def test_others_than_the_largest_snapshot_are_merged_in_order_of_time():
    b = lambda *xs: [{"t": x} for x in xs]
    fold = reconcile._Fold(3, 400)
    for at, first, snap in [(2, True, b("a", "b", "c" * 99)), (0, False, b("b", "x")), (1, False, b("b", "y", "z"))]:
        fold.add(at, first, [json.dumps(x) for x in snap])
    merged, timed = fold.result()
    assert ([json.loads(x) for x in merged], timed) == (b("a", "b", "y", "z", "x", "c" * 99), False)


def test_body_bounds(spark):
    rows = [("a", i, "u", kind, "x" * n) for i, (kind, n) in enumerate([("document", 200), ("document", 201), ("image", 500), (None, 201), ("xhr", 21)])]
    bodies = spark.createDataFrame(rows, captures.SCHEMAS["net_bodies"])
    assert sorted(r.seq for r in captures.bodies_for(bodies, "report").collect()) == [1, 3]
    assert sorted(r.seq for r in captures.bodies_for(bodies, "map").collect()) == [0, 1, 3, 4]


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", 1, at), ("a", 1, at), ("a", 2, at)], "capture_id string, number int, t timestamp")
    rows.write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "q"))
    assert sorted((r.capture_id, r.number) for r in drain(streams.distinct_questions(stream, "t"), "distinct_q", "append")) == [("a", 1), ("a", 2)]
    bodies = spark.createDataFrame([("c", i, "u", "document", "# T\n" + "- item of a list\n" * n) for i, n in enumerate((40, 80))], captures.SCHEMAS["net_bodies"])
    bodies.write.parquet(str(tmp_path / "b"))
    best = drain(streams.best_markdown(captures.stream(spark, str(tmp_path / "b"), "net_bodies")), "best_md", "complete")
    assert [(r.capture_id, r.markdown.count("item")) for r in best] == [("c", 80)]
    counts = drain(streams.windowed_counts(stream, "t"), "counts", "complete")
    assert [r.n for r in counts] == [3]


def test_stable_scores_of_a_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([100, 500, 502, 504, 600])], "capture_id string, seq long, score double")
    rows.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    got = drain(streams.stable_scores(stream), "steady", "update")
    assert [r.stable for r in sorted(got, key=lambda r: r.seq)] == [False, False, False, True, False]


def test_stability(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([100, 500, 502, 504, 600])]
    got = reconcile.stable_since(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v").orderBy("i").collect()
    assert [r.stable for r in got] == [False, False, False, True, False]


def test_readers(spark, tmp_path):
    frags, links = fixtures.fragments_and_links(spark)
    frags.write.json(str(tmp_path / "f"))
    assert captures.read(spark, str(tmp_path / "f"), "frags", "json").count() == 9
    assert captures.links_of_paths(links).count() == 2
    rows = [("c", 0, 0.0, 0.0, 12.0, 0.0, 30.0), ("c", 1, 0.0, 0.0, 12.0, 0.0, 25.0), ("c", 2, 0.0, 0.0, 11.0, 50.0, 60.0), ("c", 3, 0.0, 0.0, 20.0, 20.0, None), ("c", 4, 0.0, 0.0, 20.0, 3.0, None)]
    assert [r.ord for r in captures.links_of_paths(spark.createDataFrame(rows, captures.SCHEMAS["links"])).orderBy("ord").collect()] == [0, 3]


def test_frames_of_maps_and_quizzes(spark):
    frags = spark.createDataFrame([("m", f, ui) for f, n, ui in ((0, 6, False), (1, 1, False), (1, 9, True), (2, 6, False)) for _ in range(n)] + [("u", 0, True)], "capture_id string, frame_id int, ui boolean")
    links = spark.createDataFrame([("m", 1)], "capture_id string, frame_id int")
    assert [tuple(r) for r in captures.best_map_frames(frags, links).collect()] == [("m", 0, 6)]
    assert [tuple(r) for r in captures.best_map_frames(frags, links.union(links)).collect()] == [("m", 1, 11)]
    pages = [("q", 0, 0, "<p>no</p>"), ("q", 1, 0, "<div>2<span> / </span>9</div>"), ("q", 2, 0, "<p>1 / 9</p>"), ("r", 0, 0, None)]
    dom = spark.createDataFrame(pages, captures.SCHEMAS["dom_html"])
    assert [tuple(r) for r in captures.quiz_frames(dom.select("capture_id", "frame_id", "snap_seq", "html")).collect()] == [("q", 0, 1)]


def test_diagnostics_and_lines(spark):
    caps = spark.createDataFrame([("c", "report", "s", "b", "t", "http://p", None)], captures.SCHEMAS["captures"])
    dom = spark.createDataFrame([("c", 0, 0, "<head><title>x</title></head><p>two words</p>"), ("x", 0, 0, "<p>other</p>")], captures.SCHEMAS["dom_html"])
    net = spark.createDataFrame([("c", 3, "u" * 200, "xhr", "12345")], captures.SCHEMAS["net_bodies"])
    got = {r.part: (r.ord, r.size, r.detail) for r in reports.diagnostics(caps, dom, net).collect()}
    assert got == {"page": (0, None, "http://p"), "frame": (0, 9, "snapshot 0"), "body": (3, 5, "u" * 150), "text": (0, 9, "two words")}
    _, summary, _ = reports.quizzes(fixtures.quiz_states(spark))
    assert {r.capture_id: r.line for r in reports.quiz_summary(summary).collect()} == {"a": "2 | 3 | incomplete | 2", "b": "1 | 1 | complete | 2"}
    flat = reports.maps(*fixtures.fragments_and_links(spark), fixtures.bodies(spark))
    assert {r.capture_id: r.line for r in reports.map_summary(flat).collect()} == {"m": "6 | 2 | 0", "x": "4 | 2 | 0"}


def test_pages_that_cannot_be_read(spark, monkeypatch):
    from lumenfold.operators import html_blocks

    caps = spark.createDataFrame([(c, "report", "s", "b", "t", "p", None) for c in ("bad", "good")], captures.SCHEMAS["captures"])
    page = "<body><h1>T</h1><p>" + "word " * 40 + "</p><p>more</p></body>"
    rows = [("good", 0, 0, page), ("bad", 0, 0, page), ("bad", 0, 1, "<![" + "x"), ("bad", 0, 2, None)]
    net = spark.createDataFrame([], captures.SCHEMAS["net_bodies"])
    unread = html_blocks._read_page("<![x")[1] is None
    _, meta, failed = reports.reports(caps, spark.createDataFrame(rows, captures.SCHEMAS["dom_html"]), net)
    told = {m.capture_id: "dom_failed" in m.warnings for m in meta.collect()}
    assert told == {"good": False, "bad": unread}
    assert failed.collect() == []


def test_late_content_and_best_tree_of_a_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    import json

    rows = [("c", 0, json.dumps([{"t": 1}, {"t": 2}])), ("c", 1, json.dumps([{"t": 2}, {"t": 3}])), ("c", 2, None), ("d", 0, json.dumps([{"t": 9}]))]
    snapshots = spark.createDataFrame(rows, "capture_id string, snap_seq int, blocks string")
    snapshots.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(snapshots.schema).parquet(str(tmp_path / "s"))
    got = {r.capture_id: (json.loads(r.blocks), r.snapshots) for r in streams.run_through(streams.late_content(stream), "update", stateful=True).collect()}
    assert got == {"c": ([{"t": 1}, {"t": 2}, {"t": 3}], 3), "d": ([{"t": 9}], 1)}
    fixtures.bodies(spark).write.parquet(str(tmp_path / "b"))
    trees = streams.run_through(streams.best_tree(captures.stream(spark, str(tmp_path / "b"), "net_bodies")), "complete")
    assert [(r.capture_id, r.url, r.score) for r in trees.collect()] == [("x", "u2", 6.0)]


@pytest.mark.parametrize("name", ["orc", "parquet"])
def test_formats(spark, tmp_path, name):
    _, links = fixtures.fragments_and_links(spark)
    links.write.format(name).save(str(tmp_path / "l"))
    assert captures.read(spark, str(tmp_path / "l"), "links", name).count() == 2


PAGE = """<body><header>1 / 9</header><main><div>2<span> / </span>3</div><p>What is <b>x<sup>2</sup></b>?</p>
<div class="opts"><div class="opt"><button data-state="incorrect"><span>A.</span> <span>one</span></button><i class="mat-icon">close</i></div>
<div class="opt"><button aria-label="x" aria-checked="true"><span>B.</span> two <span class="sr-only">hidden</span></button><p>ثلاثة</p><i class="mat-icon">check</i></div></div>
<button>Hint</button></main></body>"""


def test_state_of_a_page(spark):
    from lumenfold.operators import quiz_html

    root, options = quiz_html.state(PAGE)
    lines = [x.strip() for x in root.split("\n") if x.strip()]
    assert lines == ["2 / 3", "What is x^{2}?", "@@OPT@@", "@@OPT@@", "Hint"]
    assert [[x.strip() for x in raw.split("\n") if x.strip()] for _, raw, _ in options] == [["A. one"], ["B. two", "ثلاثة"]]
    assert "data-state=incorrect" in options[0][2]
    assert "icon:close" in options[0][2]
    assert "icon:check" in options[1][2]
    assert "aria-label" not in options[1][2]
    assert quiz_html.state(None)[0].strip() == ""
    assert quiz_html.state(None)[1] == []
    pages = spark.createDataFrame([("c", 1, "pre", PAGE), ("c", 1, "reveal", PAGE)], "capture_id string, step int, phase string, html string")
    written, _, _ = reports.quizzes(quiz_html.states_of(pages), hints=False)
    row = written.first()
    assert (row.number, row.total, row.question.en) == (2, 3, "What is x²?")
    assert row.answer["keys"] == ["B"]
    assert row.options[1].text.ar == "ثلاثة"


def test_map_document(spark):
    import json

    frags, links = fixtures.fragments_and_links(spark)
    flat = reports.maps(frags, links, fixtures.bodies(spark))
    documents = {r.capture_id: json.loads(r.json) for r in reports.map_json(flat).collect()}
    root = documents["m"]["root"]
    assert [c["text"] for c in root["children"]] == ["Left", "Right"]
    assert [n["id"] for n in documents["m"]["nodes"]] == ["1", "1.1", "1.1.1", "1.1.2", "1.2", "1.2.1"]
    assert documents["m"]["meta"]["leaf_count"] == 3


def test_titles(spark):
    from lumenfold.functions import text as T

    rows = spark.createDataFrame([("Maker - A | B",)], "t string")
    assert tuple(rows.select(T.title_stem(F.col("t")), T.page_title(F.col("t"), "Maker"), T.page_title(F.col("t"))).first()) == ("Maker", "A | B", "Maker - A | B")


def test_nothing_of_nothing(spark):
    """Empty tables, nulls in every column, and columns with names of results."""
    from lumenfold.operators import geometry, json_mining, quiz_html, trees

    none = {t: spark.createDataFrame([], captures.SCHEMAS[t]) for t in captures.SCHEMAS}
    nulls = {t: spark.createDataFrame([(None,) * len(none[t].columns)], captures.SCHEMAS[t]) for t in captures.SCHEMAS}
    blocks, meta, failed = reports.reports(none["captures"], none["dom_html"], none["net_bodies"])
    assert [df.count() for df in (blocks, meta, failed)] == [0, 0, 0]
    blocks, meta, failed = reports.reports(nulls["captures"], nulls["dom_html"], nulls["net_bodies"])
    assert [df.count() for df in (blocks, meta, failed)] == [0, 0, 0]
    assert reports.maps(none["frags"], none["links"], none["net_bodies"]).collect() == []
    assert geometry.maps_of_captures(none["frags"], none["links"]).collect() == []
    assert json_mining.trees_of_captures(nulls["net_bodies"]).collect() == []
    assert json_mining.markdown_of_captures(nulls["net_bodies"].withColumn("markdown", F.lit(1)).withColumn("score", F.lit(2))).collect() == []
    for states in (none["quiz_states"], nulls["quiz_states"]):
        written, summary, text = reports.quizzes(states)
        assert [df.count() for df in (written, summary, text)] == [0, 0, 0]
    pages = spark.createDataFrame([(None, None, None, None), ("c", 1, "pre", ""), ("c", 1, "pre", "")], "capture_id string, step int, phase string, html string")
    assert [(r.root.strip(), r.options) for r in quiz_html.states_of(pages.withColumn("root", F.lit(3))).collect()] == [("", [])] * 3
    assert trees.flattened(spark.createDataFrame([], "tree_id string, path array<int>, label string")).collect() == []
    assert reports.diagnostics(none["captures"], nulls["dom_html"], nulls["net_bodies"]).collect() == []
    assert reconcile.merged_captures(spark.createDataFrame([("c", 1, 1, None)], "capture_id string, snap_seq int, ord int, block string")).collect() == []
    assert reconcile.failures(spark.createDataFrame([(None,) * 8], "capture_id string, kind string, page_url string, blocks int, chars int, nodes int, tree_size int, questions int")).collect() == []
    assert captures.best_frames(nulls["dom_html"]).count() == captures.best_read(nulls["dom_html"]).count() == 1
    assert captures.links_of_paths(nulls["links"]).collect() == []


def _settling(spark, folder, clock, **more):
    arriving = spark.readStream.schema("capture_id string, at timestamp, seq long, score double").option("maxFilesPerTrigger", 1).json(str(folder))
    return streams.settled(arriving, clock=clock, **more)


def _arrive(folder, n, rows):
    folder.mkdir(exist_ok=True)
    path = folder / f"{n}.json"
    path.write_text("".join(json.dumps({"capture_id": c, "at": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z", "seq": i, "score": x}) + "\n" for c, s, i, x in rows))
    at = 1_700_000_000 + n
    os.utime(path, (at, at))


def test_a_stream_that_never_settles_times_out_by_the_clock_of_events(spark, tmp_path):
    folder = tmp_path / "in"
    _arrive(folder, 1, [("never", 0, 1, 500.0), ("never", 2, 2, 600.0), ("good", 0, 1, 500.0), ("good", 2, 2, 501.0), ("good", 4, 3, 502.0), ("good", 6, 4, 503.0), ("small", 0, 1, 9.0), ("small", 2, 2, 9.0), ("small", 4, 3, 9.0)])
    _arrive(folder, 2, [("never", 60, 3, 700.0), ("late", 119, 1, 400.0), ("good", 60, 5, 900.0), ("edge", 0, 1, 500.0), ("edge", 119, 2, 500.0), ("edge", 120, 3, 500.0), ("null", 0, 1, None)])
    _arrive(folder, 3, [("later", 200, 1, 800.0)])
    found = streams.run_through(_settling(spark, folder, "event"), "append", stateful=True).collect()
    start = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp() * 1000)
    got = {r.capture_id: (r.state, (r.at_ms - start) // 1000, r.seq, r.score) for r in found}
    assert len(found) == len(got)
    assert got == {"good": ("stable", 4, 3, 502.0), "never": ("timed_out", 120, None, 700.0), "small": ("timed_out", 120, None, 9.0), "edge": ("timed_out", 120, None, 500.0)}


def test_a_capture_without_further_rows_times_out_by_the_clock_of_processing(spark, tmp_path):
    folder = tmp_path / "in"
    _arrive(folder, 1, [("never", 0, 1, 500.0), ("good", 0, 1, 500.0), ("good", 0, 2, 500.0), ("good", 0, 3, 500.0)])
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = _settling(spark, folder, "processing", deadline=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        until, states = time.time() + 60, []
        while time.time() < until and len(states) < 2:
            time.sleep(1)
            assert query.exception() is None
            states = spark.read.schema("capture_id string, state string").parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
        query.stop()
    finally:
        spark.conf.unset(key)
    assert sorted(map(tuple, states)) == [("good", "stable"), ("never", "timed_out")]


def test_no_other_clock(spark):
    with pytest.raises(ValueError, match="no such clock"):
        streams.settled(spark.range(1), clock="wall")


def test_pages_of_quizzes_are_dealt_to_all_cores(spark):
    """A table of one small file must not be read as pages by one task."""
    assert QUERIES["quiz_pages"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_what_an_option_says_is_worked_out_once(spark):
    """A lambda's repeated parts are computed anew each time: each test of a line stands in the plan once for each of its uses."""
    plan = QUERIES["quiz_questions"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count("not quite") <= 2
