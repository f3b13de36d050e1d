"""From captures to written reports, maps and quizzes."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import lang_info, page_title, source_url, title_stem
from lumenfold.operators import geometry, html_blocks, json_mining, labels, quiz, reconcile, report_blocks, trees
from lumenfold.sources.captures import best_frames, best_read, bodies_for
from lumenfold.sources.tables import small_batches, written


def stamp(at: datetime | None) -> str:
    return (at or datetime.now(UTC)).isoformat(timespec="seconds")


def reports(captures: DataFrame, dom_html: DataFrame, net_bodies: DataFrame, drop_rules: bool = True, product: str = "", at: datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, meta, failures) of report captures.

    Both candidates are built where there is input for them, and written once, for
    they are read for the choice, which falls by their words, and for the result. The
    page's candidate holds the raw blocks of all snapshots, merged; each page is parsed
    once. Captures with less than 80 characters go to failures. A page or a Markdown
    that can't be read has no blocks, which a warning tells; null pages and bodies are
    empty ones. Repeated rows of dom_html or net_bodies change nothing; captures are
    expected once.
    """
    small_batches(captures.sparkSession)
    pages = reconcile.merged_pages(best_read(dom_html).select("capture_id", "snap_seq", "blocks", "score"))
    mined = json_mining.markdown_of_captures(bodies_for(net_bodies, "report"))
    keyed = captures.where("kind = 'report'").select("capture_id", "share_url", "base", "page_title", "page_url").withColumn("doc_id", F.xxhash64("capture_id"))
    pages, mined = written(pages), written(mined)
    dom = report_blocks.blocks_of(keyed.join(pages, "capture_id"), "doc_id", "blocks", html_blocks.from_list)
    net = report_blocks.blocks_of(keyed.join(mined, "capture_id"), "doc_id", "markdown", report_blocks.from_markdown)
    all_blocks = written(dom.withColumn("method", F.lit("dom")).unionByName(net.withColumn("method", F.lit("network"))))
    texts = written(keyed.select("doc_id").join(_texts(all_blocks), "doc_id", "left"))
    # written, for the blocks, their statistics (twice) and meta each need it
    choice = written(reconcile.chosen_method(texts.select(F.col("doc_id").alias("capture_id"), "dom_text", "network_text")).withColumnRenamed("capture_id", "doc_id"))
    blocks = all_blocks.join(choice.select("doc_id", "method"), ["doc_id", "method"]).drop("method")
    stats = report_blocks.statistics(blocks)
    shown = report_blocks.without_rules(blocks) if drop_rules else blocks
    by_dom = F.col("method") == "dom"
    meta = keyed.join(stats, "doc_id").join(choice, "doc_id").join(texts, "doc_id").withColumn("all_text", F.when(by_dom, F.col("dom_text")).otherwise(F.col("network_text")))
    meta = meta.join(pages.select("capture_id", "visible", "reordered", "unread"), "capture_id", "left").join(mined.select("capture_id", F.col("url").alias("network_url")), "capture_id", "left")
    lost = by_dom & (F.col("chars") / F.greatest(F.col("visible"), F.lit(1)) < 0.8)
    unread = F.col("network_url").isNotNull() & F.col("network_text").isNull()
    codes = F.concat(F.array(F.when(F.col("unread"), "dom_failed"), F.when(F.col("reordered"), "lazy_merge"), F.when(unread, "markdown_failed"), F.col("warning")), "warnings", F.array(F.when(by_dom & F.col("diagrams"), "diagrams"), F.when(lost, "text_lost")))
    meta = meta.withColumn("all_info", lang_info(F.col("all_text"))).select(
        "capture_id",
        "doc_id",
        F.coalesce("title", F.nullif(title_stem(F.col("page_title")), F.lit("")), "base").alias("title"),
        source_url(F.col("share_url")).alias("source_url"),
        "method",
        F.lit(stamp(at)).alias("extracted_at"),
        page_title(F.col("page_title"), product).alias("page_title"),
        (F.col("rules") if drop_rules else F.lit(0)).alias("hr_dropped"),
        F.col("all_info.dir").alias("primary_dir"),
        F.col("all_info.lang").alias("primary_lang"),
        F.when(F.lit(drop_rules), F.map_filter("block_counts", lambda k, v: k != "hr")).otherwise(F.col("block_counts")).alias("block_counts"),
        F.struct("ar", "en", "mixed").alias("text_blocks_by_lang"),
        "chars",
        "headings",
        F.filter(codes, lambda x: x.isNotNull()).alias("warnings"),
        F.when(~by_dom, source_url(F.col("network_url"))).alias("network_source"),
        F.col("coverage").alias("dom_network_coverage"),
    )
    seen = captures.where("kind = 'report'").join(meta.select("capture_id", "chars", F.lit(1).alias("blocks")), "capture_id", "left")
    failed = reconcile.failures(seen.select("capture_id", "kind", "page_url", "blocks", "chars", *[F.lit(None).cast("int").alias(c) for c in ("nodes", "tree_size", "questions")]))
    return shown, meta.where("chars >= 80"), failed


def _texts(blocks: DataFrame) -> DataFrame:
    """doc_id, dom_text, network_text: the text of each candidate's blocks in their order, null without blocks."""

    def text(method: str) -> Column:
        own = F.col("method") == method
        ordered = F.array_sort(F.collect_list(F.when(own & (F.col("block_text") != ""), F.struct("pos", "block_text"))))
        return F.when(F.count_if(own) > 0, F.array_join(F.transform(ordered, lambda x: x["block_text"]), "\n"))

    return blocks.groupBy("doc_id").agg(text("dom").alias("dom_text"), text("network").alias("network_text"))


def report_summary(meta: DataFrame) -> DataFrame:
    """capture_id, line: a line for people, types in order."""
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("block_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    total = F.aggregate(F.map_values("block_counts"), F.lit(0), lambda a, x: a + x)
    return meta.select("capture_id", F.concat_ws(" | ", total.cast("string"), counts, F.col("headings").cast("string"), "method", F.col("chars").cast("string")).alias("line"))


def map_summary(flat: DataFrame) -> DataFrame:
    """capture_id, line: a line for people about each map: nodes, depth, nodes in both languages."""
    counts = trees.quality(flat)
    return counts.select(F.col("tree_id").alias("capture_id"), F.concat_ws(" | ", *[F.col(c).cast("string") for c in ("node_count", "max_depth", "bilingual_nodes")]).alias("line"))


def quiz_summary(summary: DataFrame) -> DataFrame:
    """capture_id, line: a line for people about each quiz: questions, how many there should be, and warnings."""
    declared = F.coalesce(F.col("total_declared").cast("string"), F.lit("?"))
    told = F.when(F.col("total_extracted") < F.col("total_declared"), "incomplete").otherwise("complete")
    return summary.select("capture_id", F.concat_ws(" | ", F.col("total_extracted").cast("string"), declared, told, F.col("warnings_count").cast("string")).alias("line"))


#: Characters of a body's url, and of the page's text, that diagnostics keep.
URL_CHARS, TEXT_CHARS = 150, 2500


def diagnostics(captures: DataFrame, dom_html: DataFrame, net_bodies: DataFrame) -> DataFrame:
    """capture_id, part, ord, size, detail of every capture: its page url, its frames with their scores, its bodies with their sizes, and how its text begins."""
    ids = captures.select("capture_id").distinct()
    page = captures.select("capture_id", F.lit("page").alias("part"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("long").alias("size"), F.col("page_url").alias("detail"))
    frames = dom_html.join(ids, "capture_id", "left_semi").select("capture_id", F.lit("frame").alias("part"), F.col("frame_id").cast("long").alias("ord"), html_blocks.score_of(F.col("html")).alias("size"), F.concat(F.lit("snapshot "), F.col("snap_seq").cast("string")).alias("detail"))
    bodies = net_bodies.join(ids, "capture_id", "left_semi").select("capture_id", F.lit("body").alias("part"), F.col("seq").cast("long").alias("ord"), F.length("body").cast("long").alias("size"), F.substring("url", 1, URL_CHARS).alias("detail"))
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1>|<[^>]*>", " "), r"\s+", " "))
    best = best_frames(dom_html.join(ids, "capture_id", "left_semi"))
    shown = best.select("capture_id", F.lit("text").alias("part"), F.col("snap_seq").cast("long").alias("ord"), F.col("score").alias("size"), F.substring(text, 1, TEXT_CHARS).alias("detail"))
    return page.unionByName(frames).unionByName(bodies).unionByName(shown)


def report_json(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """capture_id, json: one document for each report."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id", "type", "level", "text", "payload")))
    parts = blocks.groupBy("doc_id").agg(ordered.alias("b"))
    whole = F.transform("b", lambda x: F.concat(F.lit('{"id": "'), x["id"], F.lit('", '), F.substring(x["payload"], F.lit(2), F.length(x["payload"]))))
    heads = F.transform(F.filter("b", lambda x: x["type"] == "heading"), lambda x: F.to_json(F.struct(x["id"].alias("id"), x["level"].alias("level"), x["text"].alias("text"))))
    own = F.to_json(F.struct(*[c for c in meta.columns if c not in ("capture_id", "doc_id")]), {"ignoreNullFields": "false"})
    joined = meta.join(parts, "doc_id")
    return joined.select("capture_id", F.concat(F.lit('{"schema": "report-1.0", "meta": '), own, F.lit(', "outline": ['), F.array_join(heads, ", "), F.lit('], "blocks": ['), F.array_join(whole, ", "), F.lit("]}")).alias("json"))


def maps(frags: DataFrame, links: DataFrame, net_bodies: DataFrame) -> DataFrame:
    """tree_id, id, parent, order, depth, is_leaf, label and the parsed label's parts, of the better of both candidates.

    Captures with neither fragments that make a map nor a tree in a body have no rows;
    null texts and bodies are none; repeated bodies change nothing.
    """
    dom = geometry.maps_of_captures(frags, links).select("capture_id", "path", "label")
    net = json_mining.nodes_of_trees(json_mining.trees_of_captures(bodies_for(net_bodies, "map")))
    size = lambda t, name: t.groupBy("capture_id").agg(F.count("*").alias(name))
    choice = reconcile.preferred_tree(size(dom, "dom_size").join(size(net, "network_size"), "capture_id", "full"))
    both = dom.withColumn("method", F.lit("dom")).unionByName(net.withColumn("method", F.lit("network")))
    chosen = both.join(choice, ["capture_id", "method"]).withColumnRenamed("capture_id", "tree_id")
    return parsed_nodes(chosen)


def parsed_nodes(labelled: DataFrame) -> DataFrame:
    """tree_id, id, parent, order, depth, is_leaf, path, label and its parts of the nodes of trees (tree_id, path, label)."""
    flat = trees.flattened(labelled)
    return flat.withColumn("n", labels.node_of(F.col("label"))).select("tree_id", "id", "parent", "order", "depth", "is_leaf", "path", F.col("n.text").alias("label"), "n.primary", "n.ar", "n.en", "n.title_ar", "n.title_en", "n.desc_ar", "n.desc_en")


def map_json(flat: DataFrame, at: datetime | None = None) -> DataFrame:
    """capture_id, json: one document for each map, its root nested and its nodes flat, a tree at a time."""
    made_at = stamp(at)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made: dict[str, dict] = {}
        order = rows.assign(n=rows["path"].map(list)).sort_values("n")
        for r in order.to_dict("records"):
            node = {"id": r["id"], "depth": int(r["depth"]), "text": r["label"], "primary": r["primary"], "ar": r["ar"], "en": r["en"], "bilingual": bool(r["ar"] and r["en"])}
            node |= {side: {"ar": r[f"{side}_ar"], "en": r[f"{side}_en"]} for side in ("title", "desc")}
            made[r["id"]] = node | {"parent": r["parent"], "order": int(r["order"]), "is_leaf": bool(r["is_leaf"])}
        nodes = list(made.values())
        nested = {i: {k: v for k, v in n.items() if k not in ("parent", "order", "is_leaf")} | {"children": []} for i, n in made.items()}
        for n in nodes:
            if n["parent"] in nested:
                nested[n["parent"]]["children"].append(nested[n["id"]])
        root = nested[nodes[0]["id"]]
        meta = {"title": root["text"], "extracted_at": made_at, "node_count": len(nodes), "leaf_count": sum(n["is_leaf"] for n in nodes), "max_depth": max(n["depth"] for n in nodes)}
        document = {"schema": "mindmap-1.0", "meta": meta, "root": root, "nodes": nodes}
        return pd.DataFrame({"capture_id": [key[0]], "json": [json.dumps(document, ensure_ascii=False)]})

    return flat.groupBy("tree_id").applyInPandas(build, "capture_id string, json string")


def quizzes(states: DataFrame, reveal: bool = True, hints: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(written questions, summary, text) of quiz captures. Captures without a numbered question have no rows; see quiz.questions."""
    found = quiz.until_repeated(quiz.questions(states, reveal, hints))
    written = quiz.checked(found, reveal)
    return written, quiz.summary(written), quiz.as_text(found)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One line of text for each row, as JSON documents are."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
