"""Quality rules per document, and verdicts per host from shrunken failure rates. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.scratch import BROADCAST_KEYS, Scratch

#: A host is rejected when its shrunken rate of documents that fail a rule is above this.
HOST_RATE = 0.5
#: Parts that a host's rows are dealt to where hosts are too many to broadcast.
PARTS = 32
#: Least and most documents' worth of the beta prior.
PRIOR = (2.0, 1e6)

_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(h: Column) -> Column:
    """Of the words with hashes h, how many lie in five-word windows that occur twice or more."""
    window = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)]))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(z: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(z, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(z, lambda x, j: ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))) | same(x, j + 1)), lambda x: x["i"]))

        def words(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_let(_let(placed, twice), words))

    return F.when(F.size(h) < 6, F.lit(0).cast("long")).otherwise(_let(_let(h, window), covered))


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts that the rules need, for every row."""
    text = F.coalesce("text", F.lit(""))
    line = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    hashed = F.transform(F.array_remove(F.split("text", _SPACE), ""), lambda w: F.xxhash64(w))
    length = F.length("text")
    lines = lambda x: F.array(F.size(x), F.size(x) - F.size(F.array_distinct(x)))
    words = lambda h: F.struct(F.size(h).cast("long").alias("n"), _repeated(h).alias("r"))
    wide = base.select(
        "doc_id",
        "source",
        F.length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(line.alias("l"), lines).alias("lines"),
        _let(hashed, words).alias("w"),
    )
    return wide.select("doc_id", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.get("lines", F.lit(1)).cast("long").alias("n_dup_lines"), F.get("lines", F.lit(0)).cast("long").alias("n_lines"), F.col("w.r").alias("n_repeat_words"))


def judged(docs: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate.

    A document fails its base rules with fewer than 10 words or with over 20 % of
    its words in repeated five-word windows. For hosts, symbols over a tenth of the
    word characters and over 30 % repeated lines count as failures too. A host's
    rate is shrunk towards the mean by a beta prior fitted to all hosts by moments;
    documents of a host above host_rate are not kept.

    Null and empty texts have no words and fail. Rows without a source belong to no
    host: only their own rules judge them. Repeated rows are judged each; an empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    failed = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
    host_failed = f"{failed} or 10 * n_symbols > word_chars or 10 * n_dup_lines > 3 * n_lines"
    rows = scratch.table(rule_counts(docs).withColumn("base_failed", F.expr(failed)).withColumn("failed", F.expr(host_failed)))
    hosts = rows.where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.count_if("failed").alias("f"))
    hosts = scratch.table(hosts)
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("q")).first()
    alpha, beta = prior(total["hosts"], total["n"] or 0, total["f"] or 0, total["q"] or 0.0)
    rate = (F.col("f") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    rates = hosts.select("source", rate.alias("host_rate"))
    if total["hosts"] <= BROADCAST_KEYS // 10:
        out = rows.join(F.broadcast(rates), "source", "left")
    else:  # one host may have a third of all rows: its rows are dealt to parts
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(PARTS)).cast("int"))
        out = dealt.join(rates.select("*", parts.alias("part")), ["source", "part"], "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= host_rate)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")


def prior(hosts: int, n: int, f: int, q: float) -> tuple[float, float]:
    """The beta prior (alpha, beta) from the hosts, their documents n, failures f and q = sum of f_i ** 2 / n_i."""
    if not n:
        return 1.0, 1.0
    mean = (f + 0.5) / (n + 1)
    spread = max(q / n - (f / n) ** 2, 0.0)  # of the hosts' rates, weighted by documents
    between = spread - mean * (1 - mean) * (hosts - 1) / n
    size = mean * (1 - mean) / between - 1 if between > 0 else PRIOR[1]
    size = min(max(size, PRIOR[0]), PRIOR[1])
    return mean * size, (1 - mean) * size
