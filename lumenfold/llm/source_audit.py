"""How far the sources of a language diverge in their terms: every pair of sources, and each source's own top terms.

Tasks count terms in place and shuffle sums. Terms of a language with the same counts in the same sources have the same
share of every pair, so terms are grouped by their sparse vector of counts; each distinct vector is evaluated once for
every pair and counts as often as it has terms. Terms are ranked one by one. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.scratch import BROADCAST_KEYS, Scratch, small_batches
from lumenfold.llm.words import chunks, tidy

#: Documents of a language that a kept term is in, and ranks of terms that are returned.
LEAST_DOCS, TOP = 3, 200
#: Distinct terms that a task keeps before it hands its counts on.
HELD = 200_000
#: Distinct vectors of a part, and parts of a group that is joined by a shuffle.
VECTORS, PARTS = 20_000, 32
#: Pairs that a task evaluates at a time: of few sources for many vectors, of many in blocks of first sources.
PAIRS = 1 << 20

#: Letters A-Z in lower case, other bytes of terms as they are, all else as a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (texts that hold it), as partial sums."""
    most = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    columns = [[lang] * len(some), [source] * len(some)]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c, pa.string()) for c in columns], pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        for batch in batches:
            for part in chunks(batch):
                for lang, source, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    terms = text.encode().translate(_TERMS).split(b" ")
                    n, d = held.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(n)
                    n.update(terms)
                    d.update(set(terms))
                    del n[b""], d[b""]
                    size += len(n)
                    if size > most:
                        yield from out()
                        size = 0
        yield from out()
        tidy()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, _COUNTS)


def _probability(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / total), for 0 < n + 1 <= total: three digits at a time, so that nothing overflows."""
    left, found = n + 1, F.lit(0).cast("long")
    steps = F.struct(left.cast("long").alias("r"), found.alias("p"))
    for_each = lambda a, _: F.struct(F.pmod(a["r"] * 1000, total).alias("r"), (a["p"] * 1000 + F.call_function("div", a["r"] * 1000, total)).alias("p"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(3)), steps, for_each, lambda a: a["p"] + 1)


def probability(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same in numpy."""
    left, p = n.astype(np.int64) + 1, np.zeros(np.broadcast_shapes(n.shape, total.shape), np.int64)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, total)
        p = p * 1000 + digits
    return p + 1


def _pair_sums(pairs: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """A function of one part of a language's vectors, for the pairs whose first source is in one block."""

    def run(key: tuple, vectors: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, block, width = (k.as_py() for k in key)
        groups = groups.take(pa.array(np.argsort(np.array(groups.column("source").to_pylist(), object), kind="stable")))
        names, total = groups.column("source").combine_chunks().cast(pa.string()), groups.column("total").to_numpy()
        index = {s: i for i, s in enumerate(names.to_pylist())}
        a0, a1 = block * width, min((block + 1) * width, len(names))
        sums = np.zeros((a1 - a0, len(names)), np.int64)
        v, times = vectors.column("vector").combine_chunks(), vectors.column("times").to_numpy()
        if total[0] > 0:
            rows = np.repeat(np.arange(len(v)), v.value_lengths().to_numpy(zero_copy_only=False))
            flat = v.flatten()
            of = np.fromiter((index[s] for s in flat.field("source").to_pylist()), np.int64, len(flat))
            n = flat.field("n").to_numpy(zero_copy_only=False)
            step = max(1, pairs // sums.size)
            for at in range(0, len(v), step):
                lo, hi = np.searchsorted(rows, [at, at + step])
                dense = np.zeros((min(step, len(v) - at), len(names)), np.int64)
                dense[rows[lo:hi] - at, of[lo:hi]] = n[lo:hi]
                p = probability(dense, total[None, :])
                y = p[:, None, :]
                apart = p[:, a0:a1, None] - y
                sums += np.tensordot(times[at : at + step], apart * apart // y, 1)
        a, b = np.divmod(np.arange(sums.size), len(names))
        other = a + a0 != b
        return pa.table({"lang": pa.array([lang] * int(other.sum()), pa.string()), "source": names.take(pa.array(a[other] + a0)), "item": names.take(pa.array(b[other])), "value": sums.ravel()[other]})

    return run


def _split(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for docs (text, lang, source).

    Terms are runs of letters A-Z (in lower case), a-z and of characters beyond ASCII; those in at least `least_docs` texts of
    a language are kept there. With p = 1 + floor(10^9 * (count + 1) / (all counts + kept terms)), a source p and q diverge
    over a term by floor((p - q)^2 / q). Part `pair` has for each source every other source of the language with the sum over
    all kept terms, part `term` the source's `top` terms with a larger p than the language's.

    Null text, lang and source count as ''. Every source of a language is there, without terms too; where a language keeps no
    term, its pairs have 0. Equal values rank by item in the order of UTF-8. Repeated rows count each; an empty table gives an
    empty result; other columns, doc_id too, are ignored. Counts may reach 9 * 10^15 in a language.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    n = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = n.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    terms = scratch.table(terms.where(F.col("docs") >= least_docs).select("lang", "term", "n", "vector"))

    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    cells = terms.select("lang", F.inline("vector"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_sum"))
    groups = every.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["sum", "kept", "lang_sum"])
    groups = scratch.table(groups.select("lang", "source", (F.col("sum") + F.col("kept")).alias("total"), (F.col("lang_sum") + F.col("kept")).alias("lang_total")))

    # Each part of a language's vectors meets all its groups, for a block of first sources at a time.
    number = F.count("*")
    width = F.greatest(F.lit(1), F.least(number, F.floor(F.lit(PAIRS) / number))).cast("int")
    of_lang = groups.groupBy("lang").agg(width.alias("width"), F.ceil(number / width).cast("int").alias("blocks"))
    vectors = scratch.table(terms.groupBy("lang", "vector").agg(F.count("*").alias("times")))
    sizes = of_lang.join(vectors.groupBy("lang").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("parts")), "lang", "left").na.fill(1, ["parts"])
    sizes = scratch.table(sizes)
    spread = sizes.select("lang", "width", "parts", _split(F.col("blocks")).alias("block")).select("lang", "width", "block", _split(F.col("parts")).alias("part"))
    meeting = ["lang", "part", "block", "width"]
    nothing = spread.select(*meeting, F.array().cast("array<struct<source:string,n:bigint>>").alias("vector"), F.lit(0).cast("long").alias("times"))
    dealt = vectors.withColumn("h", F.xxhash64("vector")).join(_small(sizes), "lang").select("lang", F.pmod("h", "parts").cast("int").alias("part"), _split(F.col("blocks")).alias("block"), "width", "vector", "times")
    left = dealt.unionByName(nothing).groupBy(*meeting)
    right = groups.join(spread, "lang").select(*[F.col(c).alias(c) for c in meeting], "source", "total").groupBy(*meeting)
    pairs = left.cogroup(right).applyInArrow(_pair_sums(PAIRS), "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))

    cells = terms.select("lang", "term", F.col("n").alias("all"), F.inline("vector"))
    if groups.count() <= BROADCAST_KEYS // 10:
        placed = cells.join(F.broadcast(groups), ["lang", "source"])
    else:
        parted = groups.select("*", _split(F.lit(PARTS)).alias("part"))
        placed = cells.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).join(parted, ["lang", "source", "part"])
    p = placed.select("lang", "source", "term", _probability(F.col("n"), F.col("total")).alias("p"), _probability(F.col("all"), F.col("lang_total")).alias("q"))
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    over = p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(over)


def _small(sizes: DataFrame) -> DataFrame:
    """A row for each language: broadcast where they are few."""
    return F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS // 10 else sizes
