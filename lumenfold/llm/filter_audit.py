"""How five filters interact: what each removes, in every order they can be applied in. DataFrame functions only.

Native expressions give each text a mask of the filters it fails. Equal texts share their mask but for the last filter,
so a group by the text's digest is enough to find its smallest doc_id. All that the report needs is how many documents
of a part have each of the 32 masks: every permutation is read off these cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"
#: Orders of all filters: a filter comes first of k in _ORDERS / k of them.
_ORDERS = 120


def failures(text: Column) -> Column:
    """The mask of filters A to D (bits 1, 2, 4, 8) that a text, null counting as empty, fails."""
    text = F.coalesce(text, F.lit(""))
    sizes = F.transform(F.array(F.array_remove(F.split(text, _SPACE), "")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    words = F.element_at(sizes, 1)  # through an array, so that words are split once
    of_words = F.transform(F.array(words), lambda w: F.when(w["n"] < 100, 1).otherwise(0) + F.when(F.lit(100) * w["d"] < F.lit(80) * w["n"], 2).otherwise(0))
    upper = F.when(F.lit(100).cast("long") * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(10) * F.length(text), 4).otherwise(0)
    signs = F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    return F.element_at(of_words, 1) + upper + signs


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: for each lang the documents with each mask that occurs, and how many of them are labelled good and toxic.

    Texts are equal when their SHA-256 digests are. Rows without a doc_id have no label, no smaller doc_id and are none.
    Of a repeated doc_id in labels any 1 counts.
    """
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        failures(F.col("text")).alias("mask"),
    )
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    kind = ["digest", "mask", "part", "good", "toxic"]
    named = marked.where("doc_id is not null").join(known, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # Equal rows first, so that of each kind of copy the rows with the smallest doc_id can be told by partial sums.
    rows = named.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    copies = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("firsts"))
    least = F.min("first").over(Window.partitionBy("digest"))  # over the kinds of a text, not over its copies
    firsts = F.when(F.col("first") == least, F.col("firsts")).otherwise(F.lit(0).cast("long"))
    split = copies.withColumn("firsts", firsts).select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))).alias("x")
    )
    split = split.select("part", F.col("x.mask").alias("mask"), F.col("x.n").alias("n"), (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic"))
    zero = F.lit(0).cast("long")
    unnamed = marked.where("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("toxic"))
    return split.unionByName(unnamed).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def orders(cells: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from (part, mask, n, good, toxic)."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    every = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    steps = parts.select("part", "cells", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    own = F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)")
    before = F.expr(f"aggregate(sequence(1, 5), 0, (a, i) -> a + if(i < step, shiftleft(1, instr('{FILTERS}', substr(filter_order, i, 1)) - 1), 0))")
    steps = steps.select("*", own.cast("int").alias("own"), before.cast("int").alias("before"))

    def total(value: str, where: str) -> Column:
        return F.expr(f"aggregate(cells, 0L, (a, x) -> a + if({where}, {value}, 0L))")

    here = "x.mask & before = 0 and x.mask & own <> 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("x.n", "x.mask & (before | own) = 0").alias("kept"),
        total("x.n", here).alias("removed"),
        total("x.n", "x.mask & before <> 0 and x.mask & own <> 0").alias("redundant"),
        total("x.n", "x.mask = own").alias("unique_fails"),
        total("x.good", here).alias("good_lost"),
        total("x.toxic", here).alias("toxic_lost"),
        total(f"x.n * ({_ORDERS} div bit_count(x.mask))", "x.mask & own <> 0").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of all 120 orders of five filters over docs (doc_id, text, lang) and labels (doc_id, quality, toxic).

    A document fails A with fewer than 100 words, B when fewer than 80 % of its words are distinct, C when over 10 % of its
    characters are A-Z, D when it holds any of #$%&*|, E when a smaller doc_id has the same text. Per part (a lang; null and
    '' are one part) and order there is a row for each step, with zeros where nothing is removed.

    A null text is an empty one, which fails A only, and E after the first. Rows without a doc_id fail no E, have no label and
    make no other row fail. Rows that repeat a doc_id count each, and no row fails E because of its own doc_id. Labels that
    no document has change nothing. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    return orders(masks(docs, labels))
