"""MinHash near-duplicates: bottom-k sketches from one hash function.

1. One pass turns each text into the set of its shingle hashes, keeps the set's
   128-bit digest, its size and its bottom-k sketch. Equal sets become one node.
2. Inverted lists of retained values propose pairs. Of each sketch only the
   rarest values are listed: two sketches that share c values share one of the
   m - c + 1 rarest of either, so common values never make long lists.
3. The sketch of the union estimates the similarity and drops hopeless pairs.
4. The exact Jaccard similarity of the full sets confirms each link.

Long lists are not multiplied out. First every member meets a few pivots of its
lists, those with the fewest values of their own; links found there merge most of
a group of near copies. Then only members outside the largest component of a list
meet the list's other components, so every pair that could still join two
components is looked at. Sets that meet in long lists only are listed anew by
their whole shingles, of each set the rarest that a similar set cannot all miss:
rare edits keep the outer copies of a large group apart, and parity bitmaps, whose
distance bounds the sets' difference from below, drop most pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenfold.llm.components import components
from lumenfold.llm.scratch import BROADCAST_KEYS, Scratch, small_batches
from lumenfold.llm.words import Texts, chunks, mix, shingle_sets, tidy, to_lists

#: Values kept of each set; of these the lowest LISTED go to inverted lists.
SKETCH, LISTED = 64, 32
#: Listed values that two similar sets are sure to share: at similarity 0.8 fewer than
#: 12 of 32 come about with a probability of 2e-8.
SHARED = 0.375
#: Least part of a sketch's listed values that some other sketch holds, if the set has a similar one: fewer than 14 of 32 come about with 1e-6.
HELD = 0.4375
#: Least part of the union's sketch that is common. At 0.8, less than 34 of 64 come about with 1e-7.
ESTIMATE = 0.53
#: Listed values that similar sets share: overlap less the unlisted ones. For sketches of 32, fewer than 3 come about with 1e-6.
IN_COMMON = 3
#: 64-bit words of a set's parity bitmap: each shingle flips one bit, so two sets differ in at least as many shingles as their bitmaps do in bits.
PARITY = 16
#: Members of a list from which on it is long, and members of a list or a shingle that one task may hold.
LONG, SPLIT = 32, 1000
#: Pivots of a list, and pivots that one member is compared with, in the first round.
PIVOTS, TRIED = 8, 4

#: Of the sketch the listed values are whole; for estimates the upper 31 bits of all of them do.
_SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, low array<long>, high array<int>"


def _digest(u: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = int(mix(u).sum(dtype=np.uint64))
        b = int(mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return a, b


def _parity(u: np.ndarray) -> np.ndarray:
    flips = np.bincount((u % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, the digest (s1, s2) and the bottom-k sketch of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                n, digests, low, high = [], [], [], []
                for u in shingle_sets(Texts(part.column(1)), words):
                    n.append(len(u))
                    digests.append(_digest(u))
                    low.append(u[:LISTED])
                    high.append(u[LISTED:SKETCH] >> np.uint64(32))
                s = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), to_lists(low, pa.int64()), to_lists(high, pa.int32(), np.int32)],
                    names=["doc_id", "n_shingles", "s1", "s2", "low", "high"],
                )
        tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SIGNATURE)


def _full_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, words: int) -> DataFrame:
    """(node, full, bits): the full set and its parity bitmap of each wanted (node, rep, s1, s2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = list(shingle_sets(Texts(part.column(1)), words))
                s = np.array([_digest(u) for u in sets], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), to_lists(sets, pa.int64()), to_lists([_parity(u) for u in sets], pa.int64())], names=["doc_id", "s1", "s2", "full", "bits"])
        tidy()

    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if n_wanted <= BROADCAST_KEYS else ids
    sets = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, s1 long, s2 long, full array<long>, bits array<long>")
    keys = wanted.select("node", F.col("rep").alias("doc_id"), "s1", "s2")
    keys = F.broadcast(keys) if n_wanted <= BROADCAST_KEYS else keys
    # A repeated row gives its set twice; links are made distinct later.
    return sets.join(keys, ["doc_id", "s1", "s2"]).select("node", "full", "bits")


def _estimated(scratch: Scratch, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b), written before, whose union's sketch lets them be similar. Only sketches of their nodes are shuffled."""
    used = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    own = nodes.join(F.broadcast(used) if used.count() <= BROADCAST_KEYS else used, "node", "left_semi")
    own = own.select("node", F.concat(F.transform("low", lambda x: F.shiftright(x, 32).cast("int")), "high").alias("sketch"))
    a = own.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    b = own.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, SKETCH)
    both = pairs.join(a, "a").join(b, "b").select("a", "b", union.alias("u"), F.array_intersect("x", "y").alias("i"))
    out = scratch.table(both.where(F.size(F.array_intersect("u", "i")) >= ESTIMATE * F.size("u")).select("a", "b"))
    scratch.drop(used)
    return out


def _sets_of(scratch: Scratch, docs: DataFrame, nodes: DataFrame, used: DataFrame, words: int) -> DataFrame:
    """The full sets (node, full, bits) of the used nodes, written."""
    wanted = scratch.table(nodes.select("node", "rep", "s1", "s2").join(used, "node", "left_semi"))
    return scratch.table(_full_sets(docs, wanted, wanted.count(), words))


def _verified(scratch: Scratch, pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union, written."""
    a, b = full.select(F.col("node").alias("a"), F.col("full").alias("x")), full.select(F.col("node").alias("b"), F.col("full").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return scratch.table(
        pairs.join(a, "a")
        .join(b, "b")
        .select("a", "b", shared.alias("i"), (F.size("x") + F.size("y")).alias("n"))
        .where(F.col("i") * 100 >= percent * (F.col("n") - F.col("i")))
        .select("a", "b")
    )


def _split(parts: Column) -> Column:
    """One row for each part of a key that is split over tasks."""
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _part(node: str, parts: Column) -> Column:
    """The part of its key that a row is in."""
    return F.pmod(F.xxhash64(node), parts).cast("int")


def _parts(members: Column) -> Column:
    return F.ceil(members / SPLIT).cast("int")


def _rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (the set's digest) and component of every row; no component without shingles."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    sig = scratch.table(signatures(docs, words))
    named = sig.where("n_shingles > 0 and doc_id is not null")
    grouped = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))
    nodes = scratch.table(grouped.withColumn("node", F.monotonically_increasing_id()))
    ids = scratch.table(sig.select("doc_id", "n_shingles", "s1", "s2"))
    scratch.drop(sig)

    # Values of one set only need no shuffle: they are the rarest, and their number is what the others leave of the set's.
    values = nodes.select("node", "n", F.explode("low").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    ranked = values.join(often, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("r"))
    m = F.least("n", F.lit(LISTED)).cast("int")
    listed = m - F.greatest(F.lit(1), F.floor(m * SHARED)).cast("int") + 1
    own = m - F.size("r")
    members = ranked.where((F.size("r") >= HELD * m) & (listed > own)).select("node", "n", own.alias("own"), F.explode(F.slice("r", F.lit(1), listed - own)).alias("r"))
    parts = _parts(F.col("r.c"))
    members = scratch.table(members.select("node", "n", "own", F.col("r.v").alias("v"), parts.alias("parts"), _part("node", parts).alias("part")))

    close = F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")
    few = F.least("n", "pn") < 2 * IN_COMMON
    by_value = Window.partitionBy("v").orderBy("own", "node")
    pivots = members.withColumn("k", F.row_number().over(by_value)).where(F.col("k") <= PIVOTS).select("v", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("own").alias("po"), _split(F.col("parts")).alias("part"))
    later = F.struct("own", "node") > F.struct("po", "p")
    met = members.join(pivots, ["v", "part"]).where(later & close).groupBy("node", "p", "n", "pn").agg(F.count("*").alias("c"), F.first("po").alias("po")).where((F.col("c") >= IN_COMMON) | few)
    best = Window.partitionBy("node").orderBy(F.desc("c"), "po", "p")
    tried = met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= TRIED).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
    tried = scratch.table(tried)
    hopeful = _estimated(scratch, tried, nodes)
    full = _sets_of(scratch, docs, nodes, hopeful.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words)
    links = _verified(scratch, hopeful, full, percent)
    scratch.drop(full, tried, hopeful)
    first = components(scratch, links)

    placed = scratch.table(members.join(first, "node", "left").select("v", "part", "parts", "node", "n", F.coalesce("root", "node").alias("c")))
    scratch.drop(members, first)
    mains = placed.groupBy("v", "c").agg(F.count("*").alias("size"), F.first("parts").alias("parts")).groupBy("v")
    mains = mains.agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("groups"), F.sum("size").alias("members"), F.first("parts").alias("parts")).where("groups > 1")
    mains = mains.select("v", "main", (F.col("members") > LONG).alias("long"), _split(F.col("parts")).alias("part"))
    listed = scratch.table(placed.join(mains, ["v", "part"]).select("v", "node", "n", "c", (F.col("c") == F.col("main")).alias("in_main"), "long"))
    scratch.drop(placed)
    held = scratch.table(listed.where("long").groupBy("node", "n", "c").agg(F.count("*").alias("k")))
    n_held = held.count()
    # What two sets share: short lists that both are in, and at most the long lists of either.
    in_long = held.select("node", "k")
    short = listed.where("not long").join(F.broadcast(in_long) if n_held <= BROADCAST_KEYS else in_long, "node", "left").na.fill(0, ["k"])
    others = short.where("not in_main").select("v", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("k").alias("pk"))
    meet = (F.col("c") != F.col("pc")) & (F.col("in_main") | (F.col("node") > F.col("p")))
    both = short.join(others, "v").where(meet & close).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"), F.least("k", "pk").alias("k"), few.alias("few"))
    by_sketch = both.groupBy("a", "b", "k", "few").agg(F.count("*").alias("shared")).where(F.col("few") | (F.col("shared") + F.col("k") >= IN_COMMON)).select("a", "b")
    by_sketch = scratch.table(by_sketch)

    open_ = scratch.table(held.where((F.col("k") >= IN_COMMON) | (F.col("n") < 2 * IN_COMMON)).select("node", "n", "c"))
    scratch.drop(listed, held)
    full = _sets_of(scratch, docs, nodes, open_.select("node"), words)
    shingles = full.select("node", F.explode("full").alias("x"))
    common = shingles.groupBy("x").agg(F.count("*").alias("times")).where("times > 1")
    of_set = shingles.join(common, "x").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("times", "x"))).alias("r"))
    # Similar sets share at least t of the larger, and over both sizes 2 t / (1 + t) of their mean.
    alone = F.col("n") - F.size("r")
    first_of = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    words_of = [f"b{i}" for i in range(PARITY)]
    bits = [F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(PARITY)]
    rare = of_set.join(open_, "node").join(full.select("node", *bits), "node").where(first_of > 0).select("node", "n", "c", *words_of, alone.alias("alone"), F.posexplode(F.slice("r", F.lit(1), first_of.cast("int"))).alias("at", "r"))
    rare = scratch.table(rare.select("node", "n", "c", F.col("r.x").alias("x"), (F.col("alone") + F.col("at")).alias("at"), *words_of))
    scratch.drop(full, open_)
    sizes = rare.groupBy("x", "c").agg(F.count("*").alias("size"))
    main = sizes.groupBy("x").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("groups"), _parts(F.sum("size")).alias("parts")).where("groups > 1").select("x", "main", "parts")
    lists = rare.join(main, "x").withColumn("in_main", F.col("c") == F.col("main"))
    others = lists.where(~F.col("in_main")).select("x", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("at").alias("pat"), *[F.col(f"b{i}").alias(f"pb{i}") for i in range(PARITY)], _split(F.col("parts")).alias("part"))
    overlap = F.ceil((F.col("n") + F.col("pn")) * percent / (100 + percent))
    within = (F.col("at") <= F.col("n") - overlap) & (F.col("pat") <= F.col("pn") - overlap)
    apart = F.lit(0)
    for i in range(PARITY):
        apart = apart + F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"pb{i}")))
    alike = apart <= F.col("n") + F.col("pn") - 2 * overlap
    rest = (
        lists.withColumn("part", _part("node", F.col("parts")))
        .join(others, ["x", "part"])
        .where(meet & within & close & alike)
        .select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
        .distinct()
    )
    # Pairs by whole sets are few and close; only those by sketches are worth an estimate first.
    hopeful = _estimated(scratch, by_sketch, nodes)
    rest = scratch.table(hopeful.union(rest).distinct())
    scratch.drop(rare, by_sketch, hopeful)
    full = _sets_of(scratch, docs, nodes, rest.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words)
    found = _verified(scratch, rest, full, percent)
    scratch.drop(full, rest)
    final = components(scratch, links.union(found))

    ends = nodes.join(final, "node", "left").select("s1", "s2", "rep", F.coalesce("root", "node").alias("root"))
    least = ends.groupBy("root").agg(F.min("rep").alias("component"))
    where = scratch.table(ends.join(least, "root").select("s1", "s2", "component"))
    scratch.drop(nodes, links, found, final)
    with_sets = ids.where("n_shingles > 0").join(where, ["s1", "s2"], "left")
    without = ids.where("n_shingles = 0").withColumn("component", F.lit(None).cast("long"))
    names = ["doc_id", "n_shingles", "s1", "s2", "component"]
    return with_sets.select(names).union(without.select(names))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents are linked when 100 * |A and B| >= percent * |A or B| over their sets
    of shingles; component_id is the smallest doc_id that links reach.

    Null and empty texts, and texts without words, have no shingles and no links:
    component_id is their own doc_id. A text with fewer words than a shingle has
    its whole sequence as one. Repeated rows are kept as rows; equal texts are
    linked; rows without a doc_id are returned with a null component_id and kept
    (nothing stands for them). An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = _rows(docs, words, percent).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near copies, all columns as they were: of each group one row with the smallest doc_id stays.

    Where a doc_id repeats, each of its rows is judged by its own set of shingles:
    rows with other texts stay if nothing else stands for them. Rows without
    doc_id, and rows without words, stay.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(_rows(docs, words, percent))
    gone = scratch.table(rows.where("doc_id <> component").select("doc_id").distinct())
    again = scratch.table(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1").select("doc_id"))
    n_gone, n_again = gone.count(), again.count()
    if not n_again:
        return docs.join(F.broadcast(gone) if n_gone <= BROADCAST_KEYS else gone, "doc_id", "left_anti").select(docs.columns)
    again = F.broadcast(again) if n_again <= BROADCAST_KEYS else again
    gone = gone.join(again, "doc_id", "left_anti")
    once = docs.join(again, "doc_id", "left_anti").join(F.broadcast(gone) if n_gone <= BROADCAST_KEYS else gone, "doc_id", "left_anti").select(docs.columns)
    marked, a, b = _with_digests(docs.join(again, "doc_id", "left_semi").select(docs.columns), words)
    own = rows.join(again, "doc_id", "left_semi").where("component = doc_id").groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("s"))
    own = own.select(F.col("doc_id").alias(f"{a}_id"), F.col("s.s1").alias(f"{a}_1"), F.col("s.s2").alias(f"{a}_2"))
    same = (F.col("doc_id") == F.col(f"{a}_id")) & (F.col(a) == F.col(f"{a}_1")) & (F.col(b) == F.col(f"{a}_2"))
    standing = marked.join(own, same, "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    wordless = marked.where((F.col(a) == 0) & (F.col(b) == 0)).select(docs.columns)
    return once.unionByName(standing).unionByName(wordless)


def _with_digests(docs: DataFrame, words: int) -> tuple[DataFrame, str, str]:
    """docs with the digest of each row's set (0, 0 without words), and the names of both new columns, which no column has."""
    a = "s1"
    while a in docs.columns or f"{a}b" in docs.columns:
        a += "_"
    b, at = f"{a}b", docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(a, LongType()), StructField(b, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                s = np.array([_digest(u) for u in shingle_sets(Texts(part.column(at)), words)], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())], names=[*part.schema.names, a, b])
        tidy()

    return docs.mapInArrow(run, schema), a, b
