"""Trees as tables: paths level by level, ids, order, leaves, outlines and their quality. Native."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.sources.tables import written


def paths(nodes: DataFrame, levels: int = 30) -> DataFrame:
    """nodes (tree_id, node_id, parent_id, ord, label) with path, an array of places from the root: tree_id, node_id, label, path.

    Level by level: each is joined to the nodes below it and written, until one is
    empty. Siblings are placed by ord, then node_id. Roots have a null parent and are
    placed among each other. Nodes that no root reaches are left out; an empty table has
    no paths; a repeated row is a sibling with the same children. A tree deeper than
    levels fails rather than being cut.
    """
    own = Window.partitionBy("tree_id", "parent_id").orderBy("ord", "node_id")
    placed = written(nodes.withColumn("place", F.row_number().over(own)).select("tree_id", "node_id", "parent_id", "label", "place"))
    names = ["tree_id", "node_id", "label", "path"]
    level = written(placed.where("parent_id is null").withColumn("path", F.array("place")).select(names))
    out = level
    below = placed.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("up"), "node_id", "label", "place")
    for _ in range(levels):
        above = level.select("tree_id", F.col("node_id").alias("up"), F.col("path").alias("up_path"))
        level = written(below.join(above, ["tree_id", "up"]).withColumn("path", F.concat("up_path", F.array("place"))).select(names))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a tree has more than {levels} levels")


def flattened(walked: DataFrame) -> DataFrame:
    """Paths as ids such as 1.2.3: tree_id, id, parent, order from 0, depth from 0, is_leaf, and the label.

    An empty table has no rows; null labels stay null; a repeated path gives its row again.
    """
    dotted = lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ".")
    up = F.slice("path", F.lit(1), F.size("path") - 1)
    rows = walked.withColumn("id", dotted(F.col("path"))).withColumn("parent", F.when(F.size("path") > 1, dotted(up)))
    parents = rows.select("tree_id", F.col("parent").alias("id")).where("id is not null").distinct().withColumn("has_child", F.lit(True))
    rows = rows.join(parents, ["tree_id", "id"], "left")
    return rows.select("tree_id", "id", "parent", (F.when(F.size("path") > 1, F.element_at("path", -1) - 1).otherwise(0)).alias("order"), (F.size("path") - 1).alias("depth"), F.col("has_child").isNull().alias("is_leaf"), "label", "path")


def outline(flat: DataFrame) -> DataFrame:
    """tree_id, outline: a line for each node, two spaces for each level, in the order of a walk; ar and en, where there, add the Arabic line."""
    pad = F.repeat(F.lit("  "), F.col("depth"))
    both = {"ar", "en"} <= set(flat.columns)
    shown = F.coalesce(F.nullif("en", F.lit("")), F.nullif("ar", F.lit("")), "label") if both else F.col("label")
    line = F.concat(pad, F.lit("- "), shown)
    if both:
        line = F.when((F.col("en") != "") & (F.col("ar") != ""), F.concat(line, F.lit("\n"), pad, F.lit("  ↳ "), "ar")).otherwise(line)
    lines = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    return flat.groupBy("tree_id").agg(lines.alias("l")).select("tree_id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("outline"))


def quality(flat: DataFrame) -> DataFrame:
    """Counts for each tree of nodes (path, depth, is_leaf, ar, en, primary): languages, leaves, depth, and 60 ids without translation."""
    ar, en = F.col("ar") != "", F.col("en") != ""
    missing = F.array_sort(F.collect_list(F.when(~(ar & en), F.struct("path", "id"))))
    return flat.groupBy("tree_id").agg(
        F.count("*").alias("node_count"),
        F.count_if("is_leaf").alias("leaf_count"),
        F.max("depth").alias("max_depth"),
        F.count_if(ar & en).alias("bilingual_nodes"),
        F.count_if(ar & ~en).alias("ar_only"),
        F.count_if(en & ~ar).alias("en_only"),
        F.count_if(F.col("primary") == "en").alias("primary_en"),
        F.count_if(F.col("primary") == "ar").alias("primary_ar"),
        F.transform(F.slice(missing, 1, 60), lambda x: x["id"]).alias("untranslated_ids"),
    )


def as_json(flat: DataFrame) -> DataFrame:
    """tree_id, nodes: the flat nodes of each tree as one JSON array, in the order of a walk."""
    rows = F.array_sort(F.collect_list(F.struct("path", "id", "parent", "order", "depth", "is_leaf", "label")))
    kept = F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in ("id", "parent", "order", "depth", "is_leaf", "label")]))
    return flat.groupBy("tree_id").agg(F.to_json(kept, {"ignoreNullFields": "false"}).alias("nodes"))
