"""Maps and quizzes as whole documents, with what tells how good they are, and the captures that fail."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import source_url, title_stem
from lumenfold.operators import geometry, json_mining, quiz, reconcile, trees
from lumenfold.plans import reports
from lumenfold.sources.captures import best_map_frames, bodies_for, links_of_paths
from lumenfold.sources.tables import written


def _failed(captures: DataFrame, kind: str, counts: dict[str, Column]) -> DataFrame:
    """The captures of a kind without enough content; counts has the columns that tell it."""
    names = ("blocks", "chars", "nodes", "tree_size", "questions")
    own = [counts.get(c, F.lit(None)).cast("long").alias(c) for c in names]
    return reconcile.failures(captures.where(F.col("kind") == kind).select("capture_id", "kind", "page_url", *own))


def _best_frame(frags: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments and links of the best frame of each capture, if both tables tell frames; links that are none of a map's paths go."""
    if "frame_id" in frags.columns and "frame_id" in links.columns:
        best = best_map_frames(frags, links).select("capture_id", "frame_id")
        frags, links = (t.join(best, ["capture_id", "frame_id"], "left_semi") for t in (frags, links))
    return frags, links_of_paths(links)


def maps(captures: DataFrame, frags: DataFrame, links: DataFrame, net_bodies: DataFrame, at: datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, meta, failures) of map captures.

    Of each capture the best frame's map and the largest tree of its bodies are made; the network's counts unless the page's is
    over a fifth larger. meta has capture_id, title, source_url, method, extracted_at, node_count, leaf_count, max_depth, quality
    (languages of the nodes), warnings and network_source. Warnings: many_columns and several_roots of the page's map whichever is
    taken, low_confidence only if it is. Several roots on a page get one that has the page's title. Captures with neither, or
    with too few nodes, are failures; captures of other kinds are left out; repeated captures, bodies and fragments change nothing.
    """
    own, frags, links, bodies = _own_maps(captures, frags, links, net_bodies)
    found = written(geometry.maps_of_captures(*_best_frame(frags, links)))
    mined = written(json_mining.trees_of_captures(bodies_for(bodies, "map")))
    failed = _failed_maps(own, found, mined)
    told = found.groupBy("capture_id").agg(F.first("confidence").alias("confidence"), F.first("warnings").alias("codes"), F.count("*").alias("dom_size"))
    net = json_mining.nodes_of_trees(mined)
    sizes = told.join(net.groupBy("capture_id").agg(F.count("*").alias("network_size")), "capture_id", "full").join(mined.select("capture_id", "url", F.col("score").alias("tree_size")), "capture_id", "left")
    choice = written(sizes.join(reconcile.preferred_tree(sizes), "capture_id").join(own, "capture_id"))
    titled = found.join(own.select("capture_id", F.nullif(title_stem(F.col("page_title")), F.lit("")).alias("title")), "capture_id")
    made = (F.size("path") == 1) & F.array_contains("warnings", "several_roots")
    dom = titled.select("capture_id", "path", F.when(made, F.coalesce("title", F.lit(geometry.UNTITLED))).otherwise(F.col("label")).alias("label"), F.lit("dom").alias("method"))
    both = dom.unionByName(net.withColumn("method", F.lit("network"))).join(choice.select("capture_id", "method"), ["capture_id", "method"])
    nodes = written(reports.parsed_nodes(both.drop("method").withColumnRenamed("capture_id", "tree_id")))

    by_dom = F.col("method") == "dom"
    codes = F.filter(F.coalesce("codes", F.array().cast("array<string>")), lambda c: c != "low_confidence")
    sure = F.when(by_dom & (F.col("confidence") < geometry.SURE), F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>"))
    roots = nodes.where(F.size("path") == 1).select(F.col("tree_id").alias("capture_id"), F.col("label").alias("title"))
    counts = trees.quality(nodes).withColumnRenamed("tree_id", "capture_id")
    parts = ("bilingual_nodes", "ar_only", "en_only", "primary_en", "primary_ar", "untranslated_ids")
    meta = choice.join(roots, "capture_id").join(counts, "capture_id").select(
        "capture_id",
        "title",
        source_url(F.col("share_url")).alias("source_url"),
        "method",
        F.lit(reports.stamp(at)).alias("extracted_at"),
        "node_count",
        "leaf_count",
        "max_depth",
        F.struct(*parts).alias("quality"),
        F.concat(codes, sure).alias("warnings"),
        F.when(~by_dom, source_url(F.col("url"))).alias("network_source"),
    )
    return nodes, meta, failed


def _failed_maps(own: DataFrame, found: DataFrame, mined: DataFrame) -> DataFrame:
    """Captures without enough nodes: by the sizes of the page's maps and the bodies' trees, whose nodes needn't be parsed for it."""
    sizes = found.groupBy("capture_id").agg(F.count("*").alias("dom_size")).join(mined.select("capture_id", F.col("score").alias("tree_size")), "capture_id", "full")
    return _failed(own.join(sizes, "capture_id", "left"), "mindmap", {"nodes": F.col("dom_size"), "tree_size": F.col("tree_size")})


def failed_maps(captures: DataFrame, frags: DataFrame, links: DataFrame, net_bodies: DataFrame) -> DataFrame:
    """The failures of maps() alone: capture_id, kind, reason. Neither documents nor their nodes are made."""
    own, frags, links, bodies = _own_maps(captures, frags, links, net_bodies)
    return _failed_maps(own, geometry.maps_of_captures(*_best_frame(frags, links)), json_mining.trees_of_captures(bodies_for(bodies, "map")))


def _own_maps(captures: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Captures that are maps, each once, and the rows of the tables that are theirs."""
    own = captures.where("kind = 'mindmap' and capture_id is not null").groupBy("capture_id").agg(*[F.min(c).alias(c) for c in ("kind", "share_url", "page_title", "page_url")])
    return own, *(t.join(own.select("capture_id"), "capture_id", "left_semi") for t in tables)


def map_json(nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """capture_id, json: one document for each map: schema, meta, the root with its children nested, and the nodes flat.

    In the order of a walk each node is followed by its children, so the nested text is every node's own text, opened, and as
    many ends as the walk goes up after it. Empty network_source is left out; other nulls stay.
    """
    side = lambda s: F.struct(F.coalesce(f"{s}_ar", F.lit("")).alias("ar"), F.coalesce(f"{s}_en", F.lit("")).alias("en")).alias(s)
    bilingual = ((F.coalesce("ar", F.lit("")) != "") & (F.coalesce("en", F.lit("")) != "")).alias("bilingual")
    fields = ["id", "depth", F.coalesce("label", F.lit("")).alias("text"), "primary", "ar", "en", bilingual, side("title"), side("desc")]
    whole = {"ignoreNullFields": "false"}
    rows = nodes.select("tree_id", "path", "depth", F.to_json(F.struct(*fields), whole).alias("own"), F.to_json(F.struct("parent", "order", "is_leaf"), whole).alias("place"))
    walk = rows.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("path", "depth", "own", "place"))).alias("w"))

    def nested(x: Column, i: Column) -> Column:
        after = F.get("w", i + 1)["depth"]
        ends = F.repeat(F.lit("]}"), (x["depth"] - F.coalesce(after, F.lit(0)) + 1).cast("int"))
        goes_on = F.when(after.isNotNull() & (after <= x["depth"]), ",").otherwise("")
        return F.concat(F.substring(x["own"], F.lit(1), F.length(x["own"]) - 1), F.lit(',"children":['), ends, goes_on)

    flat = F.transform("w", lambda x: F.concat(F.substring(x["own"], F.lit(1), F.length(x["own"]) - 1), F.lit(","), F.substring(x["place"], F.lit(2), F.length(x["place"]))))
    texts = walk.select(F.col("tree_id").alias("capture_id"), F.array_join(F.transform("w", nested), "").alias("root"), F.array_join(flat, ",").alias("nodes"))
    of_network = F.to_json(F.struct(*[c for c in meta.columns if c != "capture_id"]), whole)
    of_page = F.to_json(F.struct(*[c for c in meta.columns if c not in ("capture_id", "network_source")]), whole)
    own = F.when(F.col("network_source").isNull(), of_page).otherwise(of_network)
    joined = meta.select("capture_id", own.alias("meta")).join(texts, "capture_id")
    return joined.select("capture_id", F.concat(F.lit('{"schema":"mindmap-1.0","meta":'), "meta", F.lit(',"root":'), "root", F.lit(',"nodes":['), "nodes", F.lit("]}")).alias("json"))


def _quiz_meta(reveal: bool, at: datetime | None) -> Column:
    """The meta of a quiz's document as JSON."""
    meta = F.struct(
        F.lit("2.0").alias("schema_version"),
        F.col("base").alias("title"),
        source_url(F.col("share_url")).alias("source_url"),
        F.lit(reports.stamp(at)).alias("extracted_at"),
        "total_declared",
        "total_extracted",
        F.lit(reveal).alias("answers_revealed"),
        F.array(F.lit("en"), F.lit("ar")).alias("languages"),
        "warnings_count",
    )
    return F.to_json(meta, {"ignoreNullFields": "false"})


def _own_quizzes(captures: DataFrame, states: DataFrame, reveal: bool, hints: bool) -> tuple[DataFrame, DataFrame]:
    """Captures that are quizzes, each once, and their questions."""
    own = captures.where("kind = 'quiz' and capture_id is not null").groupBy("capture_id").agg(*[F.min(c).alias(c) for c in ("kind", "share_url", "base", "page_url")])
    return own, quiz.until_repeated(quiz.questions(states.join(own.select("capture_id"), "capture_id", "left_semi"), reveal, hints))


def quizzes(captures: DataFrame, states: DataFrame, reveal: bool = True, hints: bool = True, at: datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, text, failures) of quiz captures: capture_id and the JSON of meta (version 2.0) and questions; capture_id and text.

    A capture without a numbered question, or whose questions have no option, is a failure. Captures of other kinds are left out;
    repeated captures change nothing. title is the capture's base. A document and a text are one value each, which a task holds;
    quiz_lines() gives the documents of large quizzes.
    """
    own, made = _own_quizzes(captures, states, reveal, hints)
    found = written(made)
    checked = written(quiz.checked(found, reveal))
    usable = checked.groupBy("capture_id").agg(F.count_if(F.size("options") > 0).alias("usable"))
    good = usable.where("usable > 0").select("capture_id")
    joined = own.join(good, "capture_id").join(quiz.summary(checked), "capture_id").join(quiz.as_json(checked), "capture_id")
    documents = joined.select("capture_id", F.concat(F.lit('{"meta":'), _quiz_meta(reveal, at), F.lit(',"questions":'), "questions", F.lit("}")).alias("json"))
    text = quiz.as_text(found).join(good, "capture_id")
    return documents, text, _failed(own.join(usable, "capture_id", "left"), "quiz", {"questions": F.col("usable")})


def quiz_lines(captures: DataFrame, states: DataFrame, reveal: bool = True, hints: bool = True, at: datetime | None = None) -> DataFrame:
    """capture_id, part, step, line: the documents of quizzes() by lines, which joined in the order of part and step are the JSON.

    Part 0 is the line with meta, 1 a line for each question, with a comma before it unless it is the first, 2 the end. No row
    holds more than a question, however many a quiz has.
    """
    own, made = _own_quizzes(captures, states, reveal, hints)
    checked = written(quiz.checked(made, reveal))
    told = checked.groupBy("capture_id").agg(F.count_if(F.size("options") > 0).alias("usable"), F.min(F.struct("step")).alias("first"))
    good = told.where("usable > 0").select("capture_id", "first")
    line = lambda part, step, *text: ("capture_id", F.lit(part).alias("part"), step.alias("step"), F.concat(*text).alias("line"))
    none = F.lit(None).cast("int")
    heads = own.join(good, "capture_id").join(quiz.summary(checked), "capture_id").select(*line(0, none, F.lit('{"meta":'), _quiz_meta(reveal, at), F.lit(',"questions":[')))
    comma = F.when(F.struct("step").eqNullSafe(F.col("first")), "").otherwise(",")
    questions = checked.join(good, "capture_id").select(*line(1, F.col("step"), comma, quiz.question_json()))
    ends = own.join(good, "capture_id").select(*line(2, none, F.lit("]}")))
    return heads.unionByName(questions).unionByName(ends)
