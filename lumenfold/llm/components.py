"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.scratch import Scratch

#: Links that one task contracts at a time.
LINKS_PER_TASK = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task; each node is then linked to the least of its part."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = np.array(list(parent), np.int64)
    roots = np.array([find(int(x)) for x in nodes], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): root is the least node that can be reached.

    Each round contracts the links of bounded tasks to stars and then joins the
    stars through the least neighbour; one round ends it when all links fit a task.
    """
    edges = scratch.table(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    count = edges.count()
    label = None
    while True:
        tasks = -(-count // LINKS_PER_TASK) or 1
        stars = edges.repartition(tasks).mapInArrow(_contract, "a long, b long")
        if tasks == 1:
            step = scratch.table(stars.select(F.col("a").alias("node"), F.col("b").alias("root")))
            rest = None
        else:
            stars = scratch.table(stars)
            step = scratch.table(stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
            x, y = step.alias("x"), step.alias("y")
            hop = lambda c: F.coalesce(F.col(f"{c}.root"), F.col(f"s.{'a' if c == 'x' else 'b'}"))
            rest = (
                stars.alias("s")
                .join(x, F.col("s.a") == F.col("x.node"), "left")
                .join(y, F.col("s.b") == F.col("y.node"), "left")
                .select(hop("x").alias("a"), hop("y").alias("b"))
                .where("a <> b")
                .distinct()
            )
        if label is None:
            label = step
        else:
            old, new = label.alias("o"), step.alias("n")
            label = scratch.table(old.join(new, F.col("o.root") == F.col("n.node"), "left").select("o.node", F.coalesce("n.root", "o.root").alias("root")))
        if rest is None:
            return label
        edges = scratch.table(rest)
        count = edges.count()
        if not count:
            return label
