"""URL filter: rules for hosts and paths, else naive Bayes over words that are segmented out of them.

A unigram model of words splits concatenated names by Viterbi's algorithm; the
words of host and path, marked by where they stand, are scored by multinomial
naive Bayes. Words have three letters or more and are parts of compound host labels
(cheap-pills), or stand alone in two hosts or more, of all urls. The classes of naive
Bayes are the verdicts of the rules, on all urls that a rule fits; the parts of host
and path by which rules choose are left out of the tokens, since they would only
tell the rules again, and both classes weigh the same.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.scratch import Scratch, small_batches

#: Words of the unigram model and tokens of the naive Bayes model that are held in memory; more are joined by a shuffle.
WORDS, TOKENS = 100_000, 200_000
#: A url is blocked by the model from this posterior on; without evidence it is 0.5.
BLOCK = 0.9

_RUN = re.compile(r"[^\W\d_]+|\d+")


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    """Verdicts by host and path: a rule is written host/path and holds for subdomains; the longest that fits wins."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        """rules: (verdict, rule)."""
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        self.labels: set[str] = set()
        self.depth = 0
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host.lower(), []).append(("/" + path, rule, verdict))
            self.labels.update(host.lower().split("."))
            self.depth = max(self.depth, path.count("/"))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equally long ones the first by name."""
        best, at = None, 0
        while True:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or (-len(rule), rule) < (-len(best[0]), best[0])):
                    best = rule, verdict
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1

    def rest(self, host: str, path: str) -> tuple[str, str]:
        """Host and path without the last labels that rules are made of, and without as many first folders as the deepest rule names.

        Folders go whatever they are called: else those that no rule names would tell which rule did not fit.
        """
        labels, folders = host.split("."), path.split("/")
        while labels and labels[-1] in self.labels:
            labels.pop()
        at = min(self.depth + 1, len(folders) - 1)
        return ".".join(labels), "/" + "/".join(folders[at:])


class Segmenter:
    """Viterbi over a unigram model; a run of letters that no word covers costs by its length."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        """counts: of all words, or of those that the names to split hold, with the total of all."""
        total = (sum(counts.values()) if total is None else total) + 1.0
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.lengths = sorted({len(w) for w in counts}, reverse=True)
        self.unknown = math.log(total) + 1.0

    def split(self, name: str) -> list[str]:
        """The words of one run of letters; unknown letters in a row stay together.

        Known words are looked up by their lengths; unknown letters cost the same from
        their start on, so the best start is carried along.
        """
        n = len(name)
        best, back = [0.0] * (n + 1), [0] * (n + 1)
        opened, low = 0, 0.0
        for end in range(1, n + 1):
            if best[end - 1] - 2.5 * (end - 1) < low:
                opened, low = end - 1, best[end - 1] - 2.5 * (end - 1)
            top, at = low + self.unknown + 2.5 * end, opened
            for size in self.lengths:
                if size <= end:
                    cost = self.cost.get(name[end - size : end])
                    if cost is not None and best[end - size] + cost < top:
                        top, at = best[end - size] + cost, end - size
            best[end], back[end] = top, at
        words, at = [], n
        while at:
            words.append(name[back[at] : at])
            at = back[at]
        return words[::-1]


def runs_of(rules: Rules, host: str, path: str) -> list[tuple[str, str | None]]:
    """The parts of a url without what rules choose by: a token (the host's suffix as t:, numbers as #) and None, or a mark (h:, p:) and letters to split."""
    names, folders = rules.rest(host, path)
    suffix = ""
    if host.endswith(names):  # no rule names the host's last label
        names, _, suffix = names.rpartition(".")
    out: list[tuple[str, str | None]] = [(f"t:{suffix}", None)] if suffix else []
    for mark, part in (("h:", names), ("p:", folders.lower())):
        out += [(f"{mark}#", None) if run.isdigit() else (mark, run) for run in _RUN.findall(part)]
    return out


def tokens_of(segmenter: Segmenter, rules: Rules, host: str, path: str) -> list[str]:
    """Words of the host (h:), its suffix (t:) and words of the path (p:); numbers count as #."""
    out = []
    for mark, run in runs_of(rules, host, path):
        out += [mark] if run is None else [mark + w for w in segmenter.split(run)]
    return out


class UrlModel:
    """Segmenter, rules and log-odds of tokens (positive: block)."""

    def __init__(self, words: dict[str, int], rules: Rules, odds: dict[str, float]) -> None:
        self.segmenter, self.rules, self.odds = Segmenter(words), rules, odds

    def score(self, host: str, path: str) -> float:
        """The posterior of block."""
        return posterior(sum(self.odds.get(t, 0.0) for t in tokens_of(self.segmenter, self.rules, host, path)))


class UrlTables:
    """The same beyond what memory holds: words (w, n) with their sum, and odds (t, odds), as tables."""

    def __init__(self, words: DataFrame, total: int, rules: Rules, odds: DataFrame, scratch: Scratch) -> None:
        self.words, self.total, self.rules, self.odds, self.scratch = words, total, rules, odds, scratch

    def scores(self, urls: DataFrame) -> DataFrame:
        """host, path and the sum of the tokens' odds (null without any) of distinct urls."""
        tokens = _tokens(urls, self.rules, self.words, self.total, self.scratch)
        return tokens.join(self.odds, "t").groupBy("host", "path").agg(F.sum("odds").alias("odds"))


def posterior(x: float) -> float:
    """The probability that log-odds stand for."""
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _tokens(urls: DataFrame, rules: Rules, words: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """host, path, t: the tokens of distinct urls, by joins with words (w, n), of which a run of letters takes those that it holds."""
    lengths = sorted(r[0] for r in words.select(F.length("w")).distinct().collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, *x) for h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in runs_of(rules, h, p)]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "path", "mark", "run"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0).to_pylist():
                own = sorted({run[a : a + n] for n in lengths for a in range(len(run) - n + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(own), pa.string()), pa.array(own, pa.string())], names=["run", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Segmenter({x["w"]: x["n"] for x in known or ()}, total).split(run) for run, known in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["run", "words"])

    parts = scratch.table(urls.select("host", "path").mapInArrow(cut, "host string, path string, mark string, run string"))
    runs = scratch.table(parts.where("run is not null").select("run").distinct())
    held = runs.mapInArrow(pieces, "run string, w string").join(words, "w").groupBy("run").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    splits = scratch.table(runs.join(held, "run", "left").mapInArrow(split, "run string, words array<string>"))
    whole = parts.where("run is null").select("host", "path", F.col("mark").alias("t"))
    made = parts.join(splits, "run").select("host", "path", "mark", F.explode("words").alias("w")).select("host", "path", F.concat("mark", "w").alias("t"))
    return whole.unionByName(made)


def _ruled(urls: DataFrame, rules: Rules) -> DataFrame:
    """host, path, n, bad of the distinct urls (host, path, n): whether the rule that fits blocks, null without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rules.find(h, p) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f and f[1] == "block" for f in found], pa.bool_())], names=["host", "path", "n", "bad"])

    return urls.select("host", "path", "n").mapInArrow(run, "host string, path string, n long, bad boolean")


def _names(urls: DataFrame) -> DataFrame:
    """w, n of the words of three letters or more: in how many hosts of urls (host, path) each stands alone.

    One host is enough for parts of a compound label, such as cheap-pills; others need
    two. The host's suffix is no word.
    """
    letters = r"[^\p{L}]+"
    labels = urls.select("host", F.explode(F.split(F.regexp_replace("host", r"\.?[^.]*$", ""), r"\.")).alias("label"))
    labels = labels.select("host", F.filter(F.split("label", letters), lambda w: w != "").alias("ws"))
    found = labels.select("host", F.explode("ws").alias("w"), (F.size("ws") > 1).alias("part"))
    found = found.unionByName(urls.select("host", F.explode(F.split(F.lower("path"), letters)).alias("w"), F.lit(False).alias("part")))
    each = found.where(F.length("w") >= 3).groupBy("host", "w").agg(F.max("part").alias("part"))
    return each.groupBy("w").agg(F.count("*").alias("n"), F.max("part").alias("part")).where("n > 1 or part").select("w", "n")


def train(pages: DataFrame, rules: list[tuple[str, str]]) -> UrlModel | UrlTables:
    """Learn words from all hosts and paths of pages (url), and tokens from all urls that a rule (verdict, rule) fits.

    Null urls, and those without a host, teach nothing; repeated rows count each. Where
    the rules that fit have one verdict, or none fits, there is nothing to tell apart:
    all other urls score 0.5 and are allowed.
    """
    small_batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession)
    chosen = Rules(rules)
    split = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    urls = scratch.table(_ruled(split.groupBy("host", "path").agg(F.count("*").alias("n")), chosen))
    known = scratch.table(_names(urls))
    size, letters = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    small = size <= WORDS
    words = {r["w"]: r["n"] for r in known.collect()} if small else {}
    segmenter = Segmenter(words)
    taught = urls.where("bad is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bad, times = [], [], []
            for host, path, n, is_bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tokens_of(segmenter, chosen, host, path)
                found += own
                bad += [is_bad] * len(own)
                times += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(bad, pa.bool_()), pa.array(times, pa.int64())], names=["t", "bad", "n"])

    if small:
        marked = taught.mapInArrow(cut, "t string, bad boolean, n long")
    else:
        marked = _tokens(taught, chosen, known, letters, scratch).join(taught, ["host", "path"]).select("t", "bad", "n")
    tokens = marked.groupBy("t").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
    tokens = scratch.table(tokens)
    total = tokens.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count("*").alias("v")).first()
    bad, good, v = total["bad"] or 0, (total["n"] or 0) - (total["bad"] or 0), total["v"]
    if not bad or not good:
        tokens = tokens.where("false")
    odds = F.log((F.col("bad") + 0.5) / (bad + 0.5 * v)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 0.5 * v))
    weights = tokens.select("t", odds.alias("odds"))
    if not small or v > TOKENS:
        return UrlTables(known, letters, chosen, weights, scratch)
    return UrlModel(words, chosen, {r["t"]: r["odds"] for r in weights.collect()})


def judged(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel | UrlTables) -> DataFrame:
    """page_id, host, path, rule, verdict and score for every row of pages (page_id, url).

    The longest rule that fits the url gives the verdict; without one, the model's
    posterior (score) does. A null url, or one without ://, has an empty host and
    path, fits no rule, scores 0.5 and is allowed. Repeated rows are judged
    each; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    known = Rules(rules)
    tables = model if isinstance(model, UrlTables) else None
    scorer = None if tables else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            given = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for host, path, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), given, strict=True):
                found, score = known.find(host, path), scorer.score(host, path) if scorer else posterior(x or 0.0)
                rows.append((found[0], found[1], score) if found else (None, "block" if score >= BLOCK else "allow", score))
            rule, verdict, score = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    rows = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if tables:
        rows = rows.join(tables.scores(rows.select("host", "path").distinct()), ["host", "path"], "left").select("page_id", "host", "path", "odds")
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
