import pytest

from lumenfold.llm.samples import LEAST, labelled, share


@pytest.mark.parametrize("rate", [1e-9, 3e-8])
def test_tiny_shares_keep_about_their_rows(spark, rate):
    """Rates below a millionth, as 10^10 labels need."""
    n = 1_000_000_000
    got = spark.range(n).withColumnRenamed("id", "doc_id").where(share(rate)).count()
    assert abs(got - n * rate) <= 5 * (n * rate) ** 0.5 + 1


def test_shares_nest_and_end_whole(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    less, more = ({r.doc_id for r in ids.where(share(x)).collect()} for x in (0.01, 0.02))
    assert less < more and abs(len(more) - 400) < 100
    assert ids.where(share(1.0)).count() == 20_000
    assert ids.where(share(0.0)).count() == 0


@pytest.mark.parametrize(("rows", "chars"), [(1e-6, 10**6), (1000, 1e-4), (1000, 10**6)])
def test_a_sample_of_labels_is_never_empty(spark, rows, chars):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 500, 2)] + [(None, 1), (7, None), (9999, 1)], "doc_id long, quality int")
    got = labelled(docs, labels, "quality", rows, chars)
    assert 0 < len(got) <= 250 and all(t.startswith("text ") for t, _ in got)
    if rows >= 1 and chars > 1:
        assert len(got) == 250


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert labelled(docs, spark.createDataFrame([], "doc_id long, toxic int"), "toxic") == []
    assert LEAST > 0
