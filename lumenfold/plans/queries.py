"""Queries that apply each operator to whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import markdown as M
from lumenfold.functions import text as T
from lumenfold.operators import dom_nodes, geometry, html_blocks, json_mining, quiz, reconcile, report_blocks, trees, variant_mining
from lumenfold.plans import built, bundle_queries, table_queries, whole_queries  # noqa: F401  (register their queries)
from lumenfold.plans.registry import ORACLES, QUERIES, query, read  # noqa: F401
from lumenfold.sources import captures
from lumenfold.streaming import captures as streams

# Text.


@query(r"select doc_id, length(c) as chars, md5(c) as digest from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as c from documents)")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.clean_text(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("chars"), F.md5(c).alias("digest"))


@query(r"""
select doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) as digest from documents""")
def text_clean_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_block(F.col("text"))).alias("digest"))


@query(r"""
with t as (select doc_id, len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) as a, len(regexp_extract_all(text, '[A-Za-z]')) as e, regexp_extract(text, '[\x{0600}-\x{06FF}A-Za-z]') as f from documents)
select doc_id, case when a >= 3 and e >= 3 then 'mixed' when a > e then 'ar' when e > 0 then 'en' else 'none' end as lang, case when regexp_matches(f, '[\x{0600}-\x{06FF}]') then 'rtl' else 'ltr' end as dir from t""")
def text_lang_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.lang_info(F.col("text")).alias("i")).select("doc_id", "i.lang", "i.dir")


@query(r"""
select conv_id, turn, md5(c) as digest from (select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ' || chr(10)), '\s+([.,;:!?)\]])', '\1', 'g'), '([(\[])\s+', '\1', 'g'), ' {2,}', ' ', 'g')) as c from conversations)""")
def text_fix_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.fix_spacing(F.col("text"))).alias("digest"))


@query(r"select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')))::bigint as n_words from documents")
def word_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.word_set(F.col("text"))).cast("long").alias("n_words"))


@query(r"select page_id, substr(split_part(url, '?', 1), 1, 200) as source_url, 'b' || lpad((page_id + 1)::varchar, greatest(3, length((page_id + 1)::varchar))::int, '0') as id from pages")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.source_url(F.col("url")).alias("source_url"), T.padded_id("b", F.col("page_id") + 1).alias("id"))


@query(r"select page_id, length(html)::bigint as chars from pages where length(html) > 200 and length(html) < 12000000")
def usable_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.where(json_mining.usable(F.lit("document"), F.col("html"), json_mining.REPORT_SIZE)).select("page_id", F.length("html").cast("long").alias("chars"))


# Markdown by lines.


@query(r"""
with l as (select doc_id, text, string_split(text, chr(10)) as l from documents)
select doc_id, case when len(l) < 6 then 0.0 else len(list_filter(l, lambda x: regexp_matches(x, '^\s*(#{1,6}\s|[*\-•]\s|\d+[.)]\s|\|)'))) / len(l) * least(1.0::double, length(text) / 3000) + case when regexp_matches(text, '(?m)^#{1,3}\s') then 0.5::double else 0.0::double end end as score from l""")
def markdown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", M.score(F.col("text")).alias("score"))


@query(r"""
with l as (select source, doc_id, length(text) as n from documents)
select source, arg_min(doc_id, doc_id) filter (n = m) as doc_id, m::bigint as score from (select *, max(n) over (partition by source) as m from l) group by source, m""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").cast("long").alias("score"))
    return reconcile.best_by(rows.withColumn("order", F.col("doc_id")), "source", "score", "order", "doc_id")


@query()
def markdown_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines; compared with a version by hand in the tests, since SQL knows no look-around."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), M.plain(F.col("t")).alias("plain"))


_TABLE_ROWS = r"""
with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')) as l from documents),
c as (select doc_id, list_transform(l, lambda x: list_transform(string_split(regexp_replace(regexp_replace(trim(x), '^\|', ''), '\|$', ''), '|'), lambda y: trim(y))) as r from l where len(l) > 0)
"""


@query(_TABLE_ROWS + "select doc_id, len(r)::bigint as n_rows, list_max(list_transform(r, lambda x: len(x)))::bigint as width, list_max(list_transform(r, lambda x: len(x))) <> list_min(list_transform(r, lambda x: len(x))) as ragged, md5(array_to_string(list_transform(r, lambda x: array_to_string(x, '¦') || repeat('¦', list_max(list_transform(r, lambda y: len(y))) - len(x))), chr(10))) as digest from c")
def table_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|"))).alias("l")).where(F.size("l") > 0)
    rows = docs.select("doc_id", F.transform("l", M.row_cells).alias("r"))
    full = rows.select("doc_id", "r", M.padded(F.col("r")).alias("p"))
    digest = F.md5(F.array_join(F.transform("p", lambda x: F.array_join(x, "¦")), "\n"))
    return full.select("doc_id", F.size("r").cast("long").alias("n_rows"), F.size(F.get("p", F.lit(0))).cast("long").alias("width"), M.is_ragged(F.col("r")).alias("ragged"), digest.alias("digest"))


# Report blocks.


_H1 = r"replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')".replace('\\"', '"')


@query(f"""select page_id as doc_id, 1 as level, trim(regexp_replace({_H1}, '\\s+', ' ', 'g')) as text from pages where regexp_matches(html, '<h1>')""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "pages")
    blocks = report_blocks.blocks_of(found, "page_id", "html", html_blocks.all_blocks)
    return report_blocks.outline(blocks).select("doc_id", "level", "text")


@query()
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = report_blocks.blocks_of(read(spark, sf_dir, "pages"), "page_id", "html", html_blocks.from_html)
    return report_blocks.statistics(blocks).select("doc_id", "title", "ar", "en", "mixed", "chars", "headings", "rules", F.to_json("block_counts").alias("block_counts"), F.to_json("warnings").alias("warnings"))


@query()
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; markdown_built has the SQL of each kind of block."""
    blocks = report_blocks.blocks_of(read(spark, sf_dir, "documents"), "doc_id", "text")
    return blocks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_blocks"), F.sum(F.length("block_text")).alias("chars"))


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = report_blocks.blocks_of(read(spark, sf_dir, "documents"), "doc_id", "text")
    return report_blocks.without_rules(blocks).select("doc_id", "pos", "id", "type", "level", "text", "lang", "dir", "cols", "payload")


@query(r"select sha256(substr(text, 1, 400)) as signature, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def first_of_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.first_of_signature(read(spark, sf_dir, "documents"), "text", "doc_id")


@query(r"""
with w as (select conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) filter (role = 'user'))) as d, list_distinct(flatten(list(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) filter (role <> 'user'))) as n from conversations group by conv_id),
x as (select conv_id, coalesce(d, []) as d, coalesce(n, []) as n, n is not null as has from w),
y as (select *, len(list_intersect(d, n)) / nullif(len(d), 0) as share from x),
z as (select *, case when not has then 'dom' when len(d) = 0 then 'network' when share >= 0.9 and len(n) >= 0.9 * len(d) then 'network' else 'dom' end as method from y)
select conv_id::varchar as capture_id, method, case when len(d) > 0 and len(n) > 0 then round_even(share, 3) end as coverage, case when method = 'dom' and has and len(d) > 0 and share >= 0.5 then 'network_mismatch' end as warning from z""")
def method_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda cond: F.array_join(F.collect_list(F.when(cond, F.col("text"))), "\n")
    user = F.col("role") == "user"
    both = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("capture_id")).agg(text(user).alias("dom_text"), F.when(F.count_if(~user) > 0, text(~user)).alias("network_text"))
    return reconcile.chosen_method(both)


# Columns, centres, windows.


_ISLANDS = """
with v as (select distinct p_brand, round_even(p_retailprice, 0) as v from part),
o as (select *, case when v - lag(v) over (partition by p_brand order by v) <= 10 then 0 else 1 end as o from v),
i as (select *, sum(o) over (partition by p_brand order by v) as island from o)
"""


@query(_ISLANDS + "select p_brand, island::bigint as island, min(v) as low, max(v) as high, avg(v) as center, count(*) as members from i group by p_brand, island")
def column_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.islands(read(spark, sf_dir, "part").select("p_brand", "p_retailprice"), "p_brand", "p_retailprice")


@query(_ISLANDS + """,
c as (select p_brand, island, avg(v) as center from i group by all),
d as (select p.p_brand, p_partkey, island, abs(center - p_retailprice) as d from part p join c using (p_brand))
select p_brand, p_partkey, arg_min(island, (d, island))::bigint as island from d group by p_brand, p_partkey""")
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return geometry.nearest_island(part, "p_brand", "p_partkey", "p_retailprice")


@query("""
select event_id, user_id, value, count(value) over w = 3 and max(value) over w - min(value) over w <= 5 and value >= 40 as stable from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and current row)""")
def stability_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.stable_since(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5, 40).select("event_id", "user_id", "value", "stable")


@query("""
with c as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders)
select o_custkey, o_orderkey, o_totalprice as score from c where r = 1""")
def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score")).withColumn("order", F.col("o_orderkey"))
    return reconcile.best_by(rows, "o_custkey", "score", "order", "o_orderkey")


# Trees.


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as one tree each region."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = region.select(F.col("r_regionkey").cast("long").alias("tree_id"), F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("label"))
    second = nation.select(F.col("n_regionkey").cast("long").alias("tree_id"), F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("label"))
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    third = customer.join(F.broadcast(home), "c_nationkey").select(F.col("n_regionkey").cast("long").alias("tree_id"), F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("label"))
    return top.union(second).union(third)


_TREE = """
with recursive nodes as (
  select r_regionkey::bigint as tree_id, 'r' || r_regionkey as node_id, null::varchar as parent_id, r_regionkey::bigint as ord, r_name as label from region
  union all select n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name from nation
  union all select n_regionkey, 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_name from customer join nation on n_nationkey = c_nationkey),
placed as (select *, row_number() over (partition by tree_id, parent_id order by ord, node_id) as place from nodes),
walk as (select tree_id, node_id, label, [place] as path from placed where parent_id is null
  union all select n.tree_id, n.node_id, n.label, list_append(w.path, n.place) from walk w join placed n on n.tree_id = w.tree_id and n.parent_id = w.node_id),
flat as (select tree_id, array_to_string(path, '.') as id, case when len(path) > 1 then array_to_string(path[:-2], '.') end as parent, case when len(path) > 1 then path[-1] - 1 else 0 end as ord, len(path) - 1 as depth, label, path from walk)
"""


@query(_TREE + """select tree_id, id, parent, ord::bigint as "order", depth::bigint as depth, id not in (select parent from flat f where f.tree_id = flat.tree_id and parent is not null) as is_leaf, label from flat""")
def tree_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = trees.flattened(trees.paths(_hierarchy(spark, sf_dir)))
    return flat.select("tree_id", "id", "parent", F.col("order").cast("long").alias("order"), F.col("depth").cast("long").alias("depth"), "is_leaf", "label")


@query(_TREE + "select tree_id, md5(string_agg(repeat('  ', depth) || '- ' || label, chr(10) order by path) || chr(10)) as digest, count(*) as n_lines from flat group by tree_id")
def tree_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trees.outline(trees.flattened(trees.paths(_hierarchy(spark, sf_dir))))
    return out.select("tree_id", F.md5("outline").alias("digest"), (F.size(F.split("outline", "\n")) - 1).cast("long").alias("n_lines"))


@query(_TREE + """select tree_id, count(*) as node_count, count(*) filter (depth = 2 or (depth = 1 and id not in (select parent from flat g where g.tree_id = flat.tree_id and parent is not null)) or (depth = 0 and not exists (select 1 from flat g where g.tree_id = flat.tree_id and g.depth = 1))) as leaf_count, max(depth)::bigint as max_depth,
  count(*) filter (depth = 1) as bilingual_nodes, count(*) filter (depth <> 1) as en_only, array_to_string(list(id order by path) filter (depth <> 1)[:60], ',') as untranslated_ids from flat group by tree_id""")
def tree_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = trees.flattened(trees.paths(_hierarchy(spark, sf_dir)))
    told = flat.withColumn("en", F.col("label")).withColumn("ar", F.when(F.col("depth") == 1, "بلد").otherwise("")).withColumn("primary", F.lit("en"))
    q = trees.quality(told)
    return q.select("tree_id", "node_count", "leaf_count", F.col("max_depth").cast("long").alias("max_depth"), "bilingual_nodes", "en_only", F.array_join("untranslated_ids", ",").alias("untranslated_ids"))


_MINED = r"""
with m as (select source, doc_id, '# ' || split_part(text, chr(10), 1) || chr(10) || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- ') as m from documents),
l as (select *, string_split(m, chr(10)) as l from m where length(m) > 300),
s as (select *, case when len(l) < 6 then 0.0 else len(list_filter(l, lambda x: regexp_matches(x, '^\s*(#{1,6}\s|[*\-•]\s|\d+[.)]\s|\|)'))) / len(l) * least(1.0::double, length(m) / 3000) + 0.5::double end as score from l)
select source as capture_id, source as url, max(score) as score, arg_min(md5(m), (-score, doc_id)) as digest from s group by source having max(score) >= 0.25"""


@query(_MINED)
def mined_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = json_mining.markdown_of_captures(_mined_bodies(spark, sf_dir))
    return found.select("capture_id", "url", "score", F.md5("markdown").alias("digest"))


def _mined_bodies(spark: SparkSession, sf_dir: str, deep: bool = False) -> DataFrame:
    """A body for each document with its text as a list, in a list; with deep inside a string that is JSON."""
    text = F.concat(F.lit("# "), F.substring_index("text", "\n", 1), F.lit("\n\n- "), F.regexp_replace("text", "\n", "\n- "))
    held = F.to_json(F.struct(F.array(text).alias("answers")))
    body = F.to_json(F.struct(F.lit(1).alias("n"), F.array(F.struct(held.alias("json"))).alias("parts"))) if deep else held
    docs = built.dealt(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select(F.col("source").alias("capture_id"), F.col("doc_id").alias("seq"), F.col("source").alias("url"), F.concat(F.lit(")]}'\n"), body).alias("body"))


@query(_MINED)
def variant_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts deep in JSON, found without Python."""
    found = variant_mining.markdown_of_captures(_mined_bodies(spark, sf_dir, deep=True))
    return found.select("capture_id", "url", "score", F.md5("markdown").alias("digest"))



# Quizzes.


@query(r"""
with t as (select conv_id, turn, string_split(text, chr(10)) as l, lead(string_split(text, chr(10))) over (partition by conv_id order by turn) as n from conversations)
select conv_id, turn, (list_reduce(list_prepend({'j': 0, 'k': 0, 'x': ''}, list_transform(list_concat(l, n), lambda x: {'j': 0, 'k': 0, 'x': x})), lambda a, y: case when l[a.j + 1] = y.x then {'j': a.j + 1, 'k': a.k, 'x': ''} else {'j': a.j, 'k': a.k + 1, 'x': ''} end)).k::bigint as n_added from t where n is not null""")
def ordered_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text that repeats the one before it adds to it."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("l"))
    both = turns.withColumn("n", F.lead("l").over(Window.partitionBy("conv_id").orderBy("turn"))).where("n is not null")
    return both.select("conv_id", "turn", F.size(quiz.added_lines(F.col("l"), F.concat("l", "n"))).cast("long").alias("n_added"))


# From captures to documents.


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as frames of captures, four each."""
    return read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 4).cast("string").alias("capture_id"), F.pmod("page_id", F.lit(4)).cast("int").alias("frame_id"), F.lit(0).alias("snap_seq"), "html")


_SCORES = r"""
with b as (select page_id, regexp_replace(regexp_replace(html, '(?s)^.*<body>', ''), '(?s)<nav>.*?</nav>', '', 'g') as body from pages),
t as (select page_id, unnest(regexp_split_to_array(body, '<[^>]*>')) as t from b),
s as (select page_id, sum(length(trim(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), ' ' || chr(10))))::bigint as score from t group by page_id)
"""


@query(_SCORES + "select page_id, score from s")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html_blocks.score_of(F.col("html")).alias("score"))


@query(_SCORES + "select (page_id // 4)::varchar as capture_id, arg_min(page_id % 4, (-score, page_id))::int as frame_id, max(score) as score, arg_min(md5(html), (-score, page_id)) as digest from s join pages using (page_id) group by 1")
def best_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.best_frames(_frames(spark, sf_dir)).select("capture_id", "frame_id", "score", F.md5("html").alias("digest"))


@query(_SCORES + "select page_id, score from s")
def dom_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of pages from tables of their nodes."""
    return dom_nodes.scores(dom_nodes.nodes_of_html(read(spark, sf_dir, "pages"), ["page_id"]), ["page_id"])


@query(_SCORES + "select (page_id // 4)::varchar as capture_id, 0 as snap_seq, arg_min(page_id % 4, (-score, page_id))::int as frame_id, max(score) as score from s group by 1")
def dom_best_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom_nodes.best_frames(dom_nodes.nodes_of_html(_frames(spark, sf_dir), ["capture_id", "snap_seq", "frame_id"]))


@query("""
with o as (select o_custkey as c_custkey, sum(length(o_orderkey::varchar)) as k, sum(length(o_orderkey::varchar) + length(o_orderstatus)) as t, count(*) as n from orders group by 1),
c as (select c_custkey, coalesce(5 * n + k, 0) as list, coalesce(9 + t, 0) as tab, 2 * length(c_name) + length(c_mktsegment) + 2 * length(c_custkey::varchar) + 3 + 10 + 8 + 7 + 11 + 16 as rest from customer left join o using (c_custkey))
select c_custkey as doc_id, case when 100 * tab >= 85 * (list + tab + rest) then 'table' else 'main' end as tag, (case when 100 * tab >= 85 * (list + tab + rest) then tab else list + tab + rest end)::bigint as size from c""")
def dom_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the content of a customer's page is, by the intervals of its nodes."""
    return dom_nodes.roots(dom_nodes.nodes_of_html(built.html(spark, sf_dir), ["doc_id"]), ["doc_id"]).select("doc_id", "tag", "size")


# Streams.


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")  # a pattern, since a stream's path can't be one file
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select date_trunc('hour', ts) as start, count(*) as n from events group by 1")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = streams.windowed_counts(_event_stream(spark, sf_dir), "ts")
    return streams.run_through(counts, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select distinct user_id::varchar as capture_id, length(event_type)::int as number from events")
def stream_distinct_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("capture_id"), F.length("event_type").alias("number"), "ts")
    return streams.run_through(streams.distinct_questions(events, "ts"), "append").select("capture_id", "number")


@query("""
select user_id::varchar as capture_id, event_id as seq, value as score, count(value) over w = 3 and max(value) over w - min(value) over w <= 5 and value >= 40 as stable
from events window w as (partition by user_id order by event_id rows between 2 preceding and current row)""")
def stream_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("capture_id"), F.col("event_id").alias("seq"), F.col("value").alias("score"))
    return streams.run_through(streams.stable_scores(scores, 5, 40), "update", stateful=True)


@query("""
with e as (select user_id, event_id, (epoch_us(ts) // 1000) as ms, value, min((epoch_us(ts) // 1000)) over (partition by user_id) + 172800000 as due, max((epoch_us(ts) // 1000)) over () - 10000 as late,
  count(value) over w as n, max(value) over w - min(value) over w as apart from events window w as (partition by user_id order by (epoch_us(ts) // 1000), event_id rows between 2 preceding and current row)),
u as (select user_id, due, late, max(ms) as latest, arg_max(value, (ms, event_id)) filter (ms < due) as score, arg_min((ms, event_id, value), (ms, event_id)) filter (ms < due and n = 3 and apart <= 60 and value >= 40) as s from e group by all)
select user_id::varchar as capture_id, case when s is null then 'timed_out' else 'stable' end as state, case when s is null then due else s[1] end as at_ms, case when s is null then null else s[2] end as seq, case when s is null then score else s[3] end as score
from u where s is not null or due <= late or latest >= due""")
def stream_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose values settle within two days, and those whose time is up."""
    rows = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("capture_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("value").alias("score"))
    return streams.run_through(streams.settled(rows, 60, 40, 172800), "append", stateful=True)
