"""Exact Jaccard join of word n-grams by prefixes whose length, and the matches they ask for, adapt to their cost.

1. A set keeps its lowest hashes: n - ceil(threshold * n) + m of them, so that two similar sets share m of what they keep.
2. How many sets keep each hash is counted. In the order of these counts, rarest first, a set lists all but m - l of what it
   keeps: two similar sets then share l of what they list, whatever the order. For l = 1 the list is shortest and any set
   met in it is a candidate; a longer list asks for more shared hashes. Each set takes the l with the least estimated cost
   of reading its lists and verifying its candidates; a pair must share the lesser of both its l.
3. Bounds on sizes, and parity bitmaps that bound from below in how many shingles two sets differ, come before the exact
   comparison of whole sets.

Lists are not multiplied out. Each member meets a few pivots of its lists first, which merges most of a group of near copies.
Then members outside a list's largest component meet its other components: directly in short lists, and in long ones over their
whole sets, by prefixes in the order of counts. A pair in different components is never left out, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm import near_dedup as nd
from lumenfold.llm.components import components
from lumenfold.llm.scratch import BROADCAST_KEYS, Scratch, small_batches
from lumenfold.llm.words import Texts, chunks, shingle_sets, tidy, to_lists

#: Most matches that a list asks for, and hashes read in lists that cost as much as to verify one candidate.
MATCHES, VERIFY = 8, 30
#: Members from which on a list is long, and members of a list or a shingle that one task may hold.
LONG, SPLIT = 32, 1000
#: Pivots of a list, and pivots that one member is compared with.
PIVOTS, TRIED = 8, 4
#: Shared hashes that sets of n shingles are sure to keep, if n allows: SPARE + n * (1 - threshold) / 2.
SPARE = 12

_SIGNATURE = "doc_id long, n long, s1 long, s2 long, low array<long>, bits array<long>"


def overlap(n: int, percent: int) -> int:
    """Shingles that a set of n has in common with any similar set, at least."""
    return -(-n * percent // 100)


def matches(n: int, percent: int) -> int:
    """m of a set of n: hashes that it is sure to share with a similar set that isn't smaller."""
    return min(overlap(n, percent), SPARE + (n - overlap(n, percent)) // 2)


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (shingles), the set's digest (s1, s2), its lowest hashes and its parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = list(shingle_sets(Texts(part.column(1)), words))
                s = np.array([nd._digest(u) for u in sets], np.uint64).reshape(-1, 2).view(np.int64)
                low = [u[: len(u) - overlap(len(u), percent) + matches(len(u), percent)] for u in sets]
                columns = [part.column(0), pa.array([len(u) for u in sets], pa.int64()), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), to_lists(low, pa.int64()), to_lists([nd._parity(u) for u in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "low", "bits"])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SIGNATURE)


def _counted(scratch: Scratch, posts: DataFrame, total: int) -> DataFrame:
    """posts with c, how many have the same v, where that is over 1.

    Of the values with more than a millionth of all posts there are under a million: they are broadcast, and no key of the shuffle
    join has more rows than that.
    """
    limit = max(SPLIT, total // BROADCAST_KEYS)
    counts = scratch.table(posts.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"))
    tagged = posts.join(F.broadcast(counts.where(F.col("c") > limit).withColumnRenamed("c", "often")), "v", "left")
    hot = tagged.where("often is not null").withColumnRenamed("often", "c")
    return hot.unionByName(tagged.where("often is null").drop("often").join(counts.where(F.col("c") <= limit), "v"))


def _listed(posts: DataFrame, percent: int) -> DataFrame:
    """node, n, l, own, v, c: what each set lists and how many of it a partner must share."""
    ranked = posts.groupBy("node", "n", "kept").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("r"))
    # A partner may have as few as this many shingles, and is sure to share no more than its own m.
    least = F.ceil(F.col("n") * percent / 100)
    of_least = F.ceil(least * percent / 100)
    sure = F.least(of_least, SPARE + F.floor((least - of_least) / 2)).cast("int")
    alone = F.col("kept") - F.size("r")
    read = F.expr(f"transform(sequence(1, least({MATCHES}, sure)), l -> struct(greatest(0, kept - sure + l - own) as take, l))")
    ranked = ranked.select("node", "n", "kept", sure.alias("sure"), alone.alias("own"), "r").withColumn("options", read)
    costs = F.expr(f"transform(options, o -> struct(aggregate(slice(r, 1, o.take), 0D, (a, x) -> a + x.c - 1) * (1 + {VERIFY} / o.l) as cost, o.l as l, o.take as take))")
    ranked = ranked.withColumn("best", F.array_min(costs)).where("best.take > 0")
    return ranked.select("node", "n", F.col("best.l").alias("l"), "own", F.explode(F.slice("r", F.lit(1), F.col("best.take"))).alias("x")).select("node", "n", "l", "own", "x.v", "x.c")


def _alike(percent: int) -> Column:
    """Whether bitmaps x and y of sets of n and pn shingles let them be similar."""
    apart = F.aggregate(F.zip_with("x", "y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return apart <= F.col("n") + F.col("pn") - 2 * F.ceil((F.col("n") + F.col("pn")) * percent / (100 + percent))


def _hopeful(scratch: Scratch, pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), written before, whose bitmaps let them be similar, written."""
    a = nodes.select(F.col("node").alias("a"), "n", F.col("bits").alias("x"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("pn"), F.col("bits").alias("y"))
    return scratch.table(pairs.join(a, "a").join(b, "b").where(_alike(percent)).select("a", "b"))


def _links(scratch: Scratch, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b), written before, that are similar by their whole sets, written."""
    full = nd._sets_of(scratch, docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words)
    links = nd._verified(scratch, pairs, full, percent)
    scratch.drop(full)
    return links


def _pair() -> list[Column]:
    return [F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")]


def _by_whole_sets(scratch: Scratch, docs: DataFrame, nodes: DataFrame, open_: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of open sets (node, n, c) in different components that may be similar, by prefixes of their whole sets."""
    full = nd._sets_of(scratch, docs, nodes, open_.select("node"), words)
    shingles = full.select("node", F.size("full").alias("n"), F.explode("full").alias("v"))
    total = full.agg(F.sum(F.size("full"))).first()[0] or 0
    ranked = _counted(scratch, shingles, total).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("r"))
    alone = F.col("n") - F.size("r")
    take = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    first = ranked.join(open_, "node").join(full.select("node", F.col("bits").alias("x")), "node").where(take > 0)
    first = first.select("node", "n", "c", "x", alone.alias("own"), F.posexplode(F.slice("r", F.lit(1), take)).alias("at", "r"))
    first = scratch.table(first.select("node", "n", "c", F.col("r.v").alias("v"), (F.col("own") + F.col("at")).alias("at"), "x"))
    scratch.drop(full)
    main = first.groupBy("v", "c").agg(F.count("*").alias("size")).groupBy("v").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("groups"), F.ceil(F.sum("size") / SPLIT).cast("int").alias("parts"))
    lists = first.join(main.where("groups > 1").drop("groups"), "v").withColumn("in_main", F.col("c") == F.col("main"))
    others = lists.where(~F.col("in_main")).select("v", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("at").alias("pat"), F.col("x").alias("y"), nd._split(F.col("parts")).alias("part"))
    o = F.ceil((F.col("n") + F.col("pn")) * percent / (100 + percent))
    within = (F.col("at") <= F.col("n") - o) & (F.col("pat") <= F.col("pn") - o)
    meet = (F.col("c") != F.col("pc")) & (F.col("in_main") | (F.col("node") > F.col("p")))
    pairs = lists.withColumn("part", nd._part("node", F.col("parts"))).join(others, ["v", "part"]).where(meet & within & _close(percent) & _alike(percent)).select(*_pair()).distinct()
    pairs = scratch.table(pairs)
    scratch.drop(first)
    return pairs


def _close(percent: int) -> Column:
    return F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")


def joined(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Documents are linked when 100 * |A and B| >= percent * |A or B| over their sets of `words`-word shingles; component_id is
    the smallest doc_id that links reach, the own one included. Every link between different sets is found or lies within a
    component that other links hold together.

    Null and empty texts, and texts without words, have no shingles and no links. A text with fewer words than a shingle has
    its whole sequence as one. Repeated rows are kept as rows; equal texts are linked; rows without a doc_id are linked with
    nothing and have a null component_id. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    sig = scratch.table(signatures(docs, words, percent))
    named = sig.where("n > 0 and doc_id is not null").groupBy("s1", "s2")
    nodes = named.agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "low", "bits")])
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()))
    ids = scratch.table(sig.select("doc_id", "n", "s1", "s2"))
    scratch.drop(sig)

    posts = nodes.select("node", "n", F.size("low").alias("kept"), F.explode("low").alias("v"))
    total = nodes.agg(F.sum(F.size("low"))).first()[0] or 0
    parts = F.ceil(F.col("c") / SPLIT).cast("int")
    members = _listed(_counted(scratch, posts, total), percent)
    members = scratch.table(members.select("node", "n", "l", "own", "v", parts.alias("parts"), nd._part("node", parts).alias("part")))

    by_value = Window.partitionBy("v", "part").orderBy("own", "node")
    best_of_part = members.withColumn("k", F.row_number().over(by_value)).where(F.col("k") <= PIVOTS)
    best = Window.partitionBy("v").orderBy("own", "node")
    pivots = best_of_part.withColumn("k", F.row_number().over(best)).where(F.col("k") <= PIVOTS)
    pivots = pivots.select("v", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("own").alias("po"), F.col("l").alias("pl"), nd._split(F.col("parts")).alias("part"))
    later = F.struct("own", "node") > F.struct("po", "p")
    met = members.join(pivots, ["v", "part"]).where(later & _close(percent)).groupBy("node", "p").agg(F.count("*").alias("c"), F.first("po").alias("po"), F.first(F.least("l", "pl")).alias("need"))
    tried = met.where("c >= need").withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "po", "p"))).where(F.col("k") <= TRIED)
    tried = scratch.table(tried.select(*_pair()).distinct())
    links = _links(scratch, docs, nodes, _hopeful(scratch, tried, nodes, percent), words, percent)
    scratch.drop(tried)
    first = components(scratch, links)

    placed = scratch.table(members.join(first, "node", "left").select("v", "part", "parts", "node", "n", "l", F.coalesce("root", "node").alias("c")))
    scratch.drop(members, first)
    mains = placed.groupBy("v", "c").agg(F.count("*").alias("size"), F.first("parts").alias("parts"), F.min("l").alias("l")).groupBy("v")
    mains = mains.agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("groups"), F.sum("size").alias("members"), F.first("parts").alias("parts"), F.min("l").alias("least")).where("groups > 1")
    mains = mains.select("v", "main", "least", (F.col("members") > LONG).alias("long"), nd._split(F.col("parts")).alias("part"))
    lists = scratch.table(placed.join(mains, ["v", "part"]).select("v", "node", "n", "l", "c", (F.col("c") == F.col("main")).alias("in_main"), "long", "least"))
    scratch.drop(placed)
    # Sets that share long lists only share as many as one of them asks for, so both are in at least as many as some member of these lists asks for.
    held = scratch.table(lists.where("long").groupBy("node", "n", "c").agg(F.count("*").alias("k"), F.min("least").alias("least")))
    n_held = held.count()
    in_long = held.select("node", "k")
    short = lists.where("not long").join(F.broadcast(in_long) if n_held <= BROADCAST_KEYS else in_long, "node", "left").na.fill(0, ["k"])
    others = short.where("not in_main").select("v", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("l").alias("pl"), F.col("k").alias("pk"))
    meet = (F.col("c") != F.col("pc")) & (F.col("in_main") | (F.col("node") > F.col("p")))
    need = F.least("l", "pl") - F.least("k", "pk")
    both = short.join(others, "v").where(meet & _close(percent)).select(*_pair(), need.alias("need"))
    by_lists = scratch.table(both.groupBy("a", "b", "need").agg(F.count("*").alias("shared")).where("shared >= need").select("a", "b"))
    rest = _hopeful(scratch, by_lists, nodes, percent)
    open_ = scratch.table(held.where("k >= least").select("node", "n", "c"))
    scratch.drop(lists, held, by_lists)
    pairs = scratch.table(rest.union(_by_whole_sets(scratch, docs, nodes, open_, words, percent)).distinct()) if open_.count() else rest
    final = components(scratch, links.union(_links(scratch, docs, nodes, pairs, words, percent)))

    ends = nodes.join(final, "node", "left").select("s1", "s2", "rep", F.coalesce("root", "node").alias("root"))
    least = ends.groupBy("root").agg(F.min("rep").alias("component"))
    where = scratch.table(ends.join(least, "root").select("s1", "s2", "component"))
    scratch.drop(nodes, links, final, pairs)
    out = ids.where("n > 0 and doc_id is not null").join(where, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    without = ids.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(without)
