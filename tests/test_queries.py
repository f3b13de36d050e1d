import json
from collections import Counter

import pytest

from lumenfold.operators import html_blocks, report_blocks
from lumenfold.plans.queries import ORACLES, QUERIES

from .oracles import SF, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_blocks_of_markdown_one_by_one(spark):
    """markdown_blocks against the parser on each text by itself, rules left out and the rest numbered."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [(d.doc_id, i, f"b{i:03d}", b["type"], b.get("text"), b.get("cols")) for d in docs for i, b in enumerate((x for x in report_blocks.from_markdown(d.text) if x["type"] != "hr"), 1)]
    got = [(r.doc_id, r.pos, r.id, r.type, r.text, r.cols) for r in QUERIES["markdown_blocks"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_reports_of_pages_one_by_one(spark):
    """page_report against counts in plain Python."""
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        blocks = html_blocks.from_html(r.html)
        heads = [b["text"] for b in blocks if b["type"] == "heading"]
        counts = Counter(b["type"] for b in blocks)
        texts = [report_blocks.all_text([b]) for b in blocks if b["type"] not in ("hr", "image")]
        langs = Counter(b.get("lang") for b in blocks)
        want[r.page_id] = (heads[0] if heads else None, langs["ar"], langs["en"], langs["mixed"], sum(len(t) + 1 for t in texts) - 1, len(heads), dict(counts), [] if heads else ["no_headings"])
    got = {r.doc_id: (r.title, r.ar, r.en, r.mixed, r.chars, r.headings, json.loads(r.block_counts), json.loads(r.warnings)) for r in QUERIES["page_report"](spark, SF).collect()}
    assert got == {k: v for k, v in want.items() if sum(v[6].values())}


def test_which_queries_have_no_sql():
    # the first two are compared here, the others in test_blocks
    assert set(QUERIES) - set(ORACLES) == {"markdown_blocks", "page_report", "markdown_plain", "markdown_report"}


def test_entry_needs_no_llm():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
