"""Queries over captures that are built from whole tables, with the SQL of what has to come out."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import tex
from lumenfold.functions import text as T
from lumenfold.operators import geometry, html_blocks, json_mining, labels, quiz, quiz_html, reconcile, report_blocks
from lumenfold.plans import built, reports
from lumenfold.plans.registry import query, read
from lumenfold.sources import captures
from lumenfold.sources.tables import small_batches

AT = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def dotted(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ".")


# Text: marks that are put into texts have to go again.


@query(r"""select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as digest from documents""")
def text_marks_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invisible characters after every e, no-break and thin spaces, and digits of both Arabic kinds."""
    c = F.regexp_replace(F.col("text"), "([ea])", "$1\u200b\u2066\ufeff")
    c = F.regexp_replace(c, " ", "\xa0\u2009")
    c = F.translate(c, "0123456789", "\u0660\u0661\u0662\u0663\u0664\u06f5\u06f6\u06f7\u06f8\u06f9")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(c, "latin")).alias("digest"))


@query(r"""select doc_id, md5(replace(replace(text, 'e', 'لا'), 'n', 'الله²')) as digest, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as label from documents""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentation forms by themselves; labels without invisible characters."""
    forms = F.regexp_replace(F.regexp_replace("text", "e", "\ufefb"), "n", "\ufdf2\xb2")
    label = T.clean_label(F.regexp_replace("text", "([ea])", "$1\u200e\xad"))
    small_batches(spark)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tex.without_forms(forms)).alias("digest"), F.md5(label).alias("label"))


@query(r"""select page_id, regexp_replace(split_part(url, '?', 1), '([\\`*_\[\]<>])', '\\\1', 'g') as escaped, 'Page ' || page_id as title, 'Page ' || page_id as stem from pages""")
def titles_and_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("Maker - Page "), F.col("page_id").cast("string"), F.lit("  "))
    stem = F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(" | rest - more"))
    return read(spark, sf_dir, "pages").select("page_id", T.escape_markdown(F.substring_index("url", "?", 1)).alias("escaped"), T.page_title(title, "Maker").alias("title"), T.title_stem(stem).alias("stem"))


@query(r"""
with w as (select conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) filter (role = 'user'))) as u, list_distinct(flatten(list(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) filter (role = 'assistant'))) as a from conversations group by conv_id),
x as (select conv_id, coalesce(u, []) as u, coalesce(a, []) as a from w)
select conv_id, len(u)::bigint as n_words, case when len(u) > 0 then round_even(len(list_intersect(u, a)) / len(u), 3) end as coverage from x""")
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda who: T.word_set(F.array_join(F.collect_list(F.when(F.col("role") == who, F.col("text"))), "\n"))
    sides = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(said("user").alias("u"), said("assistant").alias("a"))
    return sides.select("conv_id", F.size("u").cast("long").alias("n_words"), T.coverage(F.col("u"), F.col("a")).alias("coverage"))


_RAISED = "translate({}::varchar, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')"


@query(f"""
select p_partkey, '(' || p_size || ')/(a+' || p_partkey || ') × x' || {_RAISED.format('p_size')} || ' ≤ √(y)_(ij) unknown ½%' as report,
  p_size || '/' || p_partkey || ' × x' || {_RAISED.format('p_size')} || 'y₁ of (a+b)/(2) H₂O' as quiz from part""".replace("½%", "5%"))
def tex_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    formula = F.concat(F.lit(r"$\frac{"), size, F.lit(r"}{a+"), key, F.lit(r"} \times x^{"), size, F.lit(r"} \leq \sqrt{y}_{ij} \unknown 5\%$"))
    marked = F.concat(F.lit("\x01\\dfrac{"), size, F.lit("}{"), key, F.lit("} \\times x^{"), size, F.lit("}y_1\x02 of \x01\\frac{\\text{a+b}}{2}\x02 H_{2}O"))
    return read(spark, sf_dir, "part").select("p_partkey", tex.tex(formula).alias("report"), tex.quiz_marks(marked).alias("quiz"))


@query("""
select o_orderkey, case when o_orderkey % 4 = 0 then (o_custkey % 1000)::int end as number, case when o_orderkey % 4 = 0 then (o_orderkey % 1000)::int end as total,
  o_orderkey % 4 = 1 as is_right, o_orderkey % 4 = 2 as is_wrong, o_orderkey % 8 = 1 as marked, 'B' as letter, 'x ' || o_orderkey as first from orders""")
def verdicts_and_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    number = F.concat(F.lit(" "), (F.col("o_custkey") % 1000).cast("string"), F.lit(" /"), F.translate((key % 1000).cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩"))
    right, wrong = F.element_at(F.array(*map(F.lit, ("Right answer!", "correct", "إجابة صحيحة"))), (key % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("Not quite.", "INCORRECT", "غير صحيحة"))), (key % 3 + 1).cast("int"))
    line = F.when(key % 4 == 0, number).when(key % 4 == 1, right).when(key % 4 == 2, wrong).otherwise("correct it / 3")
    attrs = F.when(key % 8 == 1, "x icon:check").when(key % 8 == 2, "incorrect")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"), attrs.alias("attrs"), F.concat(F.lit(" B . x "), key.cast("string")).alias("option"))
    return rows.select("o_orderkey", T.counter(F.col("line")).alias("c"), T.says_right(F.col("line")).alias("is_right"), T.says_wrong(F.col("line")).alias("is_wrong"), T.marks_right(F.col("attrs")).alias("marked"), T.option_parts(F.col("option")).alias("o")).select("o_orderkey", "c.number", "c.total", "is_right", "is_wrong", "marked", "o.letter", "o.first")


@query("""
select p_partkey, p_partkey % 5 as shape, case when p_partkey % 5 = 1 then 'ar' else 'en' end as primary_lang,
  case p_partkey % 5 when 0 then 'خلية: وحدة ' || p_size when 1 then 'خلية: وحدة' when 2 then 'عنوان: نص ' || p_size when 3 then '' else '' end as ar,
  case p_partkey % 5 when 0 then p_name || ': ' || p_type when 1 then p_name || ': a ' || p_type when 2 then p_name || ': ' || p_type when 3 then p_name || ' (II) at 10:30' else p_name || ' (a: b) end: ' || p_brand end as en from part""")
def label_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind, size, brand = F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string"), F.col("p_brand")
    shapes = [
        F.concat(name, F.lit(" (خلية): "), kind, F.lit(" (وحدة "), size, F.lit(")")),
        F.concat(F.lit("خلية ("), name, F.lit("):  وحدة (a "), kind, F.lit(")")),
        F.concat(name, F.lit(": "), kind, F.lit(" (عنوان: نص "), size, F.lit(")")),
        F.concat(name, F.lit(" (II) at 10:30")),
        F.concat(F.lit("\u200f"), name, F.lit(" (a: b) end: "), brand),
    ]
    label = F.element_at(F.array(*shapes), (F.col("p_partkey") % 5 + 1).cast("int"))
    found = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("shape"), labels.node_of(label).alias("n"))
    return found.select("p_partkey", "shape", F.col("n.primary").alias("primary_lang"), "n.ar", "n.en")


@query("""
select p_partkey, case p_partkey % 3 when 0 then p_name || '.' when 1 then p_name || ', ' || p_type else 'A sentence about the ' || p_name || ' that ends.' end as en,
  case p_partkey % 3 when 0 then 'أضف 0.' || p_size || ' N إلى الماء' when 1 then '' else 'سطر أول سطر ثان ' || p_size end as ar from part""")
def bilingual_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")
    lines = [
        F.array(F.concat(name, F.lit(".")), F.lit("أضف"), F.concat(F.lit("0."), size, F.lit(" N")), F.lit("إلى الماء")),
        F.array(name, F.concat(F.lit(", "), kind)),
        F.array(F.concat(F.lit("A sentence about the "), name, F.lit(" that ends.")), F.lit("سطر أول"), F.lit("سطر ثان"), size),
    ]
    shape = (F.col("p_partkey") % 3).cast("int")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(shape == 0, lines[0]).when(shape == 1, lines[1]).otherwise(lines[2]).alias("lines"))
    return rows.select("p_partkey", quiz.bilingual(F.col("lines")).alias("b")).select("p_partkey", "b.en", "b.ar")


# Blocks of documents.

_DOCUMENTS = """
with o as (select o_custkey, list(o_orderkey order by o_orderkey) as k, list(o_orderstatus order by o_orderkey) as s from orders group by 1),
c as (select c_custkey, c_name, c_mktsegment, coalesce(k, []) as k, coalesce(s, []) as s from customer left join o on o_custkey = c_custkey),
b as (
  select c_custkey as doc_id, 1 as part, 'heading' as type, 1 as level, c_name as text, 0 as cols from c
  union all select c_custkey, 2, 'paragraph', null, 'The ' || c_mktsegment || ' segment of customer ' || c_custkey, 0 from c
  union all select c_custkey, 3, 'list', null, array_to_string(list_transform(k, lambda x: 'order ' || x), chr(10)), 0 from c where len(k) > 0
  union all select c_custkey, 4, 'table', null, array_to_string(list_concat(['key', 'status'], flatten(list_transform(range(1, len(k) + 1), lambda i: [k[i]::varchar, s[i]]))), chr(10)), 2 from c where len(k) > 0
  union all select c_custkey, 5, 'code', null, 'select ' || c_custkey, 0 from c
  union all select c_custkey, 6, 'quote', null, 'said ' || c_name || ' twice', 0 from c
  union all select c_custkey, 8, 'paragraph', null, 'The end, at last.', 0 from c),
n as (select *, row_number() over (partition by doc_id order by part) as pos from b)
"""
_BLOCKS = _DOCUMENTS + "select doc_id, pos::int as pos, 'b' || lpad(pos::varchar, 3, '0') as id, type, level, md5(text) as digest, cols from n"


def _told(blocks: DataFrame) -> DataFrame:
    return report_blocks.without_rules(blocks).select("doc_id", "pos", "id", "type", "level", F.md5("block_text").alias("digest"), F.coalesce("cols", F.lit(0)).alias("cols"))


@query(_BLOCKS)
def markdown_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, words, lists, tables, fences, quotations and rules of Markdown."""
    return _told(report_blocks.blocks_of(built.markdown(spark, sf_dir), "doc_id", "text"))


@query(_BLOCKS)
def html_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of pages, whose content root is found."""
    return _told(report_blocks.blocks_of(built.html(spark, sf_dir), "doc_id", "html", html_blocks.from_html))


_ITEMS = """
with o as (select o_custkey as doc_id, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders)
select doc_id, i::int as i, 'order ' || k as text, 'order *' || k || '*' as md, (i % 3 = 2) as nested from o"""


@query(_ITEMS)
def list_items_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of Markdown lists, and whether they are in the list of another: read back from the rendering of the blocks."""
    lists = report_blocks.blocks_of(built.markdown(spark, sf_dir), "doc_id", "text").where("type = 'list'")
    inner = "array<struct<items:array<struct<text:string,md:string>>>>"
    item = F.from_json(F.get_json_object("payload", "$.items"), f"array<struct<text:string,md:string,children:{inner}>>")
    own = lambda x: F.struct(x["text"].alias("text"), x["md"].alias("md"), F.lit(False).alias("nested"))
    below = lambda x: F.transform(F.flatten(F.transform(F.coalesce(x["children"], F.array().cast(inner)), lambda c: c["items"])), lambda y: F.struct(y["text"].alias("text"), y["md"].alias("md"), F.lit(True).alias("nested")))
    flat = lists.select("doc_id", F.posexplode(F.flatten(F.transform(item, lambda x: F.concat(F.array(own(x)), below(x))))).alias("i", "x"))
    return flat.select("doc_id", "i", "x.text", "x.md", "x.nested")


@query(_DOCUMENTS + """
, m as (select doc_id, pos, case type when 'heading' then '# ' || text when 'paragraph' then replace(replace(text, 'The ' || (select c_mktsegment from c where c_custkey = doc_id) || ' segment of customer ' || doc_id, 'The **' || (select c_mktsegment from c where c_custkey = doc_id) || '** segment of `customer` [' || doc_id || '](http://h/x)'), '#', '#')
  when 'quote' then '> ' || text when 'code' then '```sql' || chr(10) || text || chr(10) || '```' end as md from n where type in ('heading', 'paragraph', 'code', 'quote'))
select doc_id, md5(string_agg(md, chr(10) || chr(10) order by pos) || chr(10)) as digest from m group by doc_id""")
def markdown_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of Markdown written as Markdown again, without lists and tables."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def rendered(s):
        return s.map(lambda text: report_blocks.to_markdown([b for b in report_blocks.from_markdown(text) if b["type"] not in ("list", "table", "hr")]))

    return built.markdown(spark, sf_dir).select("doc_id", F.md5(rendered("text")).alias("digest"))


@query(_DOCUMENTS + """
select doc_id, (array_agg(text order by pos))[1] as title, count(*) filter (type in ('heading', 'paragraph', 'quote')) as en, sum(length(text) + 1)::bigint - 1 as chars, 1::bigint as headings, 1::bigint as rules,
  '{' || case when bool_or(type = 'list') then '"code":1,"heading":1,"hr":1,"list":1,"paragraph":2,"quote":1,"table":1' else '"code":1,"heading":1,"hr":1,"paragraph":2,"quote":1' end || '}' as block_counts from n group by doc_id""")
def blocks_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the blocks of Markdown documents are, by type and language."""
    stats = report_blocks.statistics(report_blocks.blocks_of(built.markdown(spark, sf_dir), "doc_id", "text"))
    return stats.select("doc_id", "title", "en", "chars", "headings", "rules", F.to_json("block_counts").alias("block_counts"))


@query("""
with l as (select l_orderkey as doc_id, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'N' as bullet, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as i from lineitem),
g as (select *, case when bullet then i - row_number() over (partition by doc_id, bullet order by i) else -i end as g from l),
m as (select doc_id, bullet, min(i) as i, count(*) as n from g group by doc_id, bullet, g)
select doc_id, row_number() over (partition by doc_id order by i)::int as pos, case when bullet then 'list' else 'paragraph' end as type, case when bullet then n else 0 end as items from m""")
def adjacent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal bullets that follow each other are one list."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(order)).alias("l"))
    line = lambda x: F.concat(F.when(x["l_returnflag"] == "N", F.lit("• part ")).otherwise(F.lit("part ")), x["l_partkey"].cast("string"))
    raw = F.to_json(F.transform("l", lambda x: F.struct(F.lit("paragraph").alias("type"), line(x).alias("text"), line(x).alias("md"))))
    blocks = report_blocks.blocks_of(rows.select("doc_id", raw.alias("raw")), "doc_id", "raw", html_blocks.from_list)
    items = F.coalesce(F.size(F.from_json(F.get_json_object("payload", "$.items"), "array<struct<text:string>>")), F.lit(0))
    return blocks.select("doc_id", "pos", "type", F.when(F.col("type") == "list", items).otherwise(0).cast("long").alias("items"))


# Snapshots, frames and reports.


@query("""
with b as (select o_custkey, o_orderkey as k, false as pad from orders union all select distinct o_custkey, null, true from orders)
select o_custkey::varchar as capture_id, row_number() over (partition by o_custkey order by pad, k)::int as pos, k, false as reordered from b""")
def snapshots_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a customer's orders: one lacks every third order and has a long block at its end, so it is the base."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("capture_id"), F.col("o_orderkey").alias("k"))
    block = lambda k: F.to_json(F.struct(k.alias("k")))
    whole = rows.select("capture_id", F.lit(1).alias("snap_seq"), F.col("k").alias("ord"), block(F.col("k")).alias("block"))
    less = rows.where("k % 3 <> 0").select("capture_id", F.lit(0).alias("snap_seq"), F.col("k").alias("ord"), block(F.col("k")).alias("block"))
    pad = rows.select("capture_id").distinct().select("capture_id", F.lit(0).alias("snap_seq"), F.lit(1 << 60).alias("ord"), F.to_json(F.struct(F.repeat(F.lit("x"), F.lit(3000)).alias("pad"))).alias("block"))
    found = reconcile.merged_captures(whole.unionByName(less).unionByName(pad))
    return found.select("capture_id", "pos", F.get_json_object("block", "$.k").cast("long").alias("k"), "reordered")


@query("""
with o as (select o_custkey, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as i, count(*) over (partition by o_custkey) as n from orders)
select o_custkey::varchar as capture_id, i::int as pos, k, n - 2 > 3 as reordered from o""")
def snapshots_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three orders that slide over all orders of a customer: a page that shows a part at a time."""
    all_of = Window.partitionBy("capture_id")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("capture_id"), F.col("o_orderkey").alias("k"))
    numbered = rows.withColumn("i", F.row_number().over(all_of.orderBy("k")) - 1).withColumn("n", F.count("*").over(all_of))
    shown = numbered.withColumn("snap_seq", F.explode(F.sequence(F.greatest(F.col("i") - 2, F.lit(0)), F.least("i", F.greatest(F.col("n") - 3, F.lit(0))))))
    found = reconcile.merged_captures(shown.select("capture_id", F.col("snap_seq").cast("int"), F.col("i").alias("ord"), F.to_json(F.struct("k")).alias("block")))
    return found.select("capture_id", "pos", F.get_json_object("block", "$.k").cast("long").alias("k"), "reordered")


@query("""
with c as (select o_orderkey, o_orderkey::varchar as capture_id, case o_orderkey % 3 when 0 then 'report' when 1 then 'mindmap' else 'quiz' end as kind, o_orderkey % 50 = 7 as sign_in,
  nullif(o_orderkey % 7, 0) as blocks, o_orderkey % 160 as chars, case when o_orderkey % 11 > 0 then o_orderkey % 5 end as nodes, o_orderkey % 6 as tree_size, o_orderkey % 2 as questions from orders),
r as (select *, case when sign_in then 'sign_in' when kind = 'report' and (blocks is null or chars < 80) then 'too_short' when kind = 'mindmap' and coalesce(nodes, 0) < 3 and tree_size < 4 then 'too_few_nodes' when kind = 'quiz' and questions < 1 then 'no_questions' end as reason from c)
select capture_id, kind, reason from r where reason is not null""")
def failed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("report", "mindmap", "quiz"))), (key % 3 + 1).cast("int"))
    url = F.when(key % 50 == 7, "https://accounts.example.org/in").when(key % 2 == 0, "http://h/x")
    rows = read(spark, sf_dir, "orders").select(key.cast("string").alias("capture_id"), kind.alias("kind"), url.alias("page_url"), F.nullif(key % 7, F.lit(0)).alias("blocks"), (key % 160).alias("chars"), F.when(key % 11 > 0, key % 5).alias("nodes"), (key % 6).alias("tree_size"), (key % 2).alias("questions"))
    return reconcile.failures(rows)


def customer_captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as report captures: their page beside a smaller frame, in two snapshots; every second has its Markdown in a body."""
    pages = built.html(spark, sf_dir).withColumn("capture_id", F.col("doc_id").cast("string"))
    caps = pages.select("capture_id", F.lit("report").alias("kind"), F.concat(F.lit("http://h/"), "capture_id", F.lit("?q=1")).alias("share_url"), F.lit("report").alias("base"), F.lit("Maker - Page").alias("page_title"), F.lit("http://h").alias("page_url"), F.lit(None).cast("timestamp").alias("captured_at"))
    frame = lambda i, snap, page: F.struct(F.lit(i).alias("frame_id"), F.lit(snap).alias("snap_seq"), page.alias("html"))
    ad = F.lit("<p>an advertisement</p>")
    dom = pages.select("capture_id", F.explode(F.array(frame(0, 0, ad), frame(1, 0, F.col("html")), frame(1, 1, F.regexp_replace("html", "<hr>.*", "")), frame(2, 1, ad))).alias("f")).select("capture_id", "f.*")
    texts = built.markdown(spark, sf_dir).where("doc_id % 2 = 0")
    net = texts.select(F.col("doc_id").cast("string").alias("capture_id"), F.lit(1).alias("seq"), F.lit("http://h/body?x").alias("url"), F.lit("xhr").alias("resource_type"), F.concat(F.lit(")]}'\n"), F.to_json(F.struct(F.array("text").alias("a")))).alias("body"))
    return caps, dom, net


REPORT_SQL = _DOCUMENTS + r""",
t as (select c_custkey, k, '# ' || c_name || chr(10) || chr(10) || 'The **' || c_mktsegment || '** segment' || chr(10) || 'of `customer` [' || c_custkey || '](http://h/x)' || chr(10) || chr(10)
  || case when len(k) > 0 then array_to_string(list_transform(range(0, len(k)), lambda i: (case when i % 3 = 2 then '  - ' else '- ' end) || 'order *' || k[i + 1] || '*'), chr(10)) || chr(10) || chr(10)
    || '| key | status |' || chr(10) || '|---|---|' || chr(10) || array_to_string(list_transform(range(1, len(k) + 1), lambda i: '| ' || k[i] || ' | ' || s[i] || ' |'), chr(10)) || chr(10) || chr(10) else '' end
  || '```sql' || chr(10) || 'select ' || c_custkey || chr(10) || '```' || chr(10) || chr(10) || '> said ' || c_name || chr(10) || '> twice' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'The end, at last.' as text from c),
l as (select *, string_split(text, chr(10)) as l from t),
f as (select c_custkey, c_custkey % 2 = 0 and length(text) > 300 and len(list_filter(l, lambda x: regexp_matches(x, '^\s*(#{1,6}\s|[*\-•]\s|\d+[.)]\s|\|)'))) / len(l) * least(1.0::double, length(text) / 3000) + 0.5 >= 0.25 as net from l),
r as (select doc_id, min(text) filter (pos = 1) as title, sum(length(text) + 1)::bigint - 1 as chars, count(*) as blocks from n group by doc_id)
"""


REPORT_META_SQL = REPORT_SQL + """
select doc_id::varchar as capture_id, title, 'http://h/' || doc_id as source_url, case when net then 'network' else 'dom' end as method, 'Page' as page_title, 1::bigint as hr_dropped, 'ltr' as primary_dir, 'en' as primary_lang, chars, 1::bigint as headings,
  case when net then 'http://h/body' end as network_source, case when net then 1.0::double end as dom_network_coverage, '' as warnings from r join f on c_custkey = doc_id"""


def meta_columns(meta: DataFrame) -> DataFrame:
    return meta.select("capture_id", "title", "source_url", "method", "page_title", "hr_dropped", "primary_dir", "primary_lang", "chars", "headings", "network_source", "dom_network_coverage", F.array_join("warnings", ",").alias("warnings"))


@query(REPORT_META_SQL)
def report_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, meta, _ = reports.reports(*customer_captures(spark, sf_dir), product="Maker")
    return meta_columns(meta)


REPORT_DOCUMENTS_SQL = REPORT_SQL + """
select doc_id::varchar as capture_id, 'report-1.0' as schema, title, 'b001' as first_id, title as first_heading, 1 as last_level, blocks::int as n_blocks from r"""


def looked_into(documents: DataFrame) -> DataFrame:
    """What reports (capture_id, json) hold."""
    held = F.from_json("json", "struct<schema:string,meta:struct<title:string>,outline:array<struct<id:string,level:int>>,blocks:array<struct<id:string,text:string>>>")
    head, block = F.get("d.outline", F.lit(0)), F.get("d.blocks", F.lit(0))
    return documents.select("capture_id", held.alias("d")).select("capture_id", "d.schema", "d.meta.title", head["id"].alias("first_id"), block["text"].alias("first_heading"), head["level"].alias("last_level"), F.size("d.blocks").alias("n_blocks"))


@query(REPORT_DOCUMENTS_SQL)
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written reports, looked into as JSON."""
    blocks, meta, _ = reports.reports(*customer_captures(spark, sf_dir), product="Maker", at=AT)
    return looked_into(reports.report_json(blocks, meta))


@query(REPORT_SQL + """
select doc_id::varchar as capture_id, concat_ws(' | ', blocks::varchar, case when blocks = 7 then 'code=1, heading=1, list=1, paragraph=2, quote=1, table=1' else 'code=1, heading=1, paragraph=2, quote=1' end, '1', case when net then 'network' else 'dom' end, chars::varchar) as line
from r join f on c_custkey = doc_id""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_summary(reports.reports(*customer_captures(spark, sf_dir))[1])


@query("""
select c_custkey::varchar as capture_id, part, ord::bigint as ord, size::bigint as size from customer, (values ('page', 0, null), ('frame', 0, 16), ('frame', 2, 16)) as t(part, ord, size)
union all select c_custkey::varchar, 'body', 1, null from customer where c_custkey % 2 = 0""")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is of each capture; sizes of pages and bodies are left out, which other queries check."""
    found = reports.diagnostics(*customer_captures(spark, sf_dir)).where("part <> 'text' and not (part = 'frame' and ord = 1)")
    return found.select("capture_id", "part", "ord", F.when(F.col("part") == "frame", F.col("size")).alias("size"))


# Maps.

_PLACES = """
with n as (select n_nationkey, n_regionkey as r, n_name, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation),
s as (select r, k, s_name, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as j from supplier join n on n_nationkey = s_nationkey),
z as (select r, count(*) as boxes, count(*) filter (j is null or j % 2 = 0) as met, count(*) filter (k is not null and (j is null or j % 2 = 0)) as links from (select r_regionkey as r, null as k, null as j from region union all select r, k, null from n union all select r, k, j from s) group by r),
kept as (select r from z where links >= 3 and met >= greatest(3, 0.6 * boxes)),
"""
_MAP = _PLACES + """
m as (select r_regionkey as r, '1' as id, r_name as label from region union all select r, '1.' || k, n_name from n
  union all select r, '1.' || k || '.' || case when r in (select r from kept) then j // 2 + 1 else j + 1 end, s_name from s where j % 2 = 0 or r not in (select r from kept))
"""
_TREE = _PLACES + "m as (select r_regionkey as r, '1' as id, r_name as label from region union all select r, '1.' || k, n_name from n union all select r, '1.' || k || '.' || (j + 1), s_name from s)"


@query(_MAP + "select r::varchar as capture_id, id, label, 1.0::double as confidence, '' as warnings from m")
def map_from_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by links, suppliers by links and by their heights; where links meet most boxes, only boxes that they meet."""
    found = geometry.maps_of_captures(*built.fragments_and_links(spark, sf_dir))
    return found.select("capture_id", dotted("path").alias("id"), "label", "confidence", F.array_join("warnings", ",").alias("warnings"))


@query(_TREE + "select r::varchar as capture_id, id, label from m")
def mined_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = json_mining.nodes_of_trees(json_mining.trees_of_captures(built.bodies(spark, sf_dir)))
    return found.select("capture_id", dotted("path").alias("id"), "label")


@query(_MAP + ", t" + _TREE[_TREE.index("m as") + 1 :].replace(" as (", " as (", 1) + """,
c as (select r, case when (select count(*) from m x where x.r = region.r_regionkey) > 1.2 * (select count(*) from t x where x.r = region.r_regionkey) then 'dom' else 'network' end as method from region, (select r_regionkey as r from region) q where q.r = r_regionkey),
a as (select r, id, label from t)
select r::varchar as capture_id, 'mindmap-1.0' as schema, min(label) filter (id = '1') as title, count(*)::int as node_count, count(*) filter (not exists (select 1 from a x where x.r = a.r and starts_with(x.id, a.id || '.')))::int as leaf_count, max(len(string_split(id, '.')) - 1)::int as max_depth from a group by r""")
def map_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written maps, looked into as JSON; the tree in the body is never much smaller than the one on the page."""
    flat = reports.maps(*built.fragments_and_links(spark, sf_dir), built.bodies(spark, sf_dir))
    get = lambda path: F.get_json_object("json", path)
    return reports.map_json(flat, at=AT).select("capture_id", get("$.schema").alias("schema"), get("$.root.text").alias("title"), *[get(f"$.meta.{c}").cast("int").alias(c) for c in ("node_count", "leaf_count", "max_depth")])


@query("""
with f as (select s_nationkey::varchar as capture_id, s_suppkey % 4 as frame_id, s_suppkey % 3 <> 0 as plain from supplier),
l as (select c_nationkey::varchar as capture_id, c_custkey % 4 as frame_id from customer),
p as (select capture_id, frame_id, plain::int as n from f union all select capture_id, frame_id, 5 from l),
s as (select capture_id, frame_id, sum(n) as score from p group by all having sum(n) > 0)
select capture_id, arg_min(frame_id, (-score, frame_id))::int as frame_id, max(score)::bigint as score from s group by 1""")
def map_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frags = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("capture_id"), (F.col("s_suppkey") % 4).cast("int").alias("frame_id"), (F.col("s_suppkey") % 3 == 0).alias("ui"))
    links = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("capture_id"), (F.col("c_custkey") % 4).cast("int").alias("frame_id"))
    return captures.best_map_frames(frags, links)


@query("select c_custkey as ord from customer where abs(c_acctbal - c_nationkey * 100) >= 12 and case when c_custkey % 3 = 0 then c_custkey % 50 else sqrt((c_acctbal - c_nationkey * 100) ** 2 + 20 ** 2) end > 25")
def links_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("ax"), F.lit(0.0).alias("ay"), (F.col("c_nationkey") * 100.0).alias("bx"), F.lit(20.0).alias("by"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 50).cast("double")).alias("length"))
    return captures.links_of_paths(rows).select("ord")


@query("""
with c as (select c_nationkey as g, c_mktsegment as seg, c_custkey as id, c_acctbal as y, row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal, c_custkey) as i, count(*) over (partition by c_nationkey, c_mktsegment) as m from customer),
s as (select *, sum(y) over (partition by g, seg order by i) as total from c),
b as (select distinct g, seg, m, unnest(range(0, m + 1)) as cut, g * 100.0 as p, g * 100.0 + 4000 as q from s),
e as (select b.*, s1.y as y1, sa.y as ya, sa.total as ta, sb.y as yb, sm.y as ym, sm.total as tm from b join s as s1 on s1.g = b.g and s1.seg = b.seg and s1.i = 1 join s as sm on sm.g = b.g and sm.seg = b.seg and sm.i = b.m
  left join s as sa on sa.g = b.g and sa.seg = b.seg and sa.i = cut left join s as sb on sb.g = b.g and sb.seg = b.seg and sb.i = cut + 1),
k as (select *, case when cut = 0 then 0 else least(abs((y1 + ya) / 2 - p), abs(ta / cut - p)) end + case when cut = m then 0 else least(abs((yb + ym) / 2 - q), abs((tm - coalesce(ta, 0)) / (m - cut) - q)) end as cost from e),
w as (select g, seg, arg_min(cut, (cost, cut)) as cut from k group by g, seg)
select s.g as nation, s.seg as segment, id as child, case when i <= cut then 1 else 2 end as parent from s join w using (g, seg)""")
def level_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation and segment shared by two parents, by their balances. A group is as large as a screen may be, not a table."""
    import pandas as pd

    rows = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["c_acctbal", "c_custkey"])
        found = geometry.assign([key[0] * 100.0, key[0] * 100.0 + 4000], own["c_acctbal"].tolist())
        return pd.DataFrame({"nation": key[0], "segment": key[1], "child": own["c_custkey"], "parent": [j + 1 for j in found]})

    return rows.groupBy("c_nationkey", "c_mktsegment").applyInPandas(run, "nation int, segment string, child long, parent int")


# Quizzes.

_QUIZ = """
with q as (select p_brand as capture_id, row_number() over (partition by p_brand order by p_partkey)::int as step, count(*) over (partition by p_brand)::int as n, p_name, p_type, p_size, p_size % 2 as r from part)
"""


@query(_QUIZ + """
select capture_id, step, 'q' || lpad(step::varchar, greatest(3, length(step::varchar))::int, '0') as id, step as number, n as total, 'Which of both is the ' || p_name || '?' as question_en, 'أي منهما ' || step || '؟' as question_ar, 2 as n_options, chr((65 + r)::int) as keys,
  case when r = 0 then 'size ' || p_size else 'type ' || p_type end as answer_en, 'because (' || p_name || ')' as explanation_en, '' as warnings from q""")
def quiz_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quiz.checked(quiz.until_repeated(quiz.questions(built.quiz_states(spark, sf_dir))))
    parts = {"question_en": "question.en", "question_ar": "question.ar", "answer_en": "answer.text.en", "explanation_en": "answer.explanation.en"}
    lists = [F.size("options").alias("n_options"), F.array_join("answer.keys", ",").alias("keys"), F.array_join("warnings", ",").alias("warnings")]
    return found.select("capture_id", "step", "id", "number", "total", *[F.col(c).alias(name) for name, c in parts.items()], *lists)


@query(_QUIZ + "select capture_id, n as total_declared, count(*) as total_extracted, 0::bigint as warnings_count, count(*) || ' | ' || n || ' | complete | 0' as line from q group by capture_id, n")
def quiz_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = quiz.summary(quiz.checked(quiz.until_repeated(quiz.questions(built.quiz_states(spark, sf_dir)))))
    return summary.join(reports.quiz_summary(summary), "capture_id")


@query(_QUIZ + r""",
l as (select capture_id, step, '[' || step || '/' || n || ']' || chr(10) || 'Which of both is the ' || p_name || '?' || chr(10) || 'أي منهما ' || step || '؟' || chr(10) || chr(10)
  || case when r = 0 then '✓ ' else '✗ ' end || 'A. size ' || p_size || chr(10) || case when r = 0 then '      ← الإجابة الصحيحة' || chr(10) || '      ↳ because (' || p_name || ')' else '      ← إجابة غير صحيحة (الخيار المنقور)' || chr(10) || '      ↳ no' end || chr(10)
  || case when r = 1 then '✓ ' else '✗ ' end || 'B. type ' || p_type || chr(10) || case when r = 1 then '      ← الإجابة الصحيحة' || chr(10) || '      ↳ because (' || p_name || ')' else '      ← إجابة غير صحيحة (الخيار المنقور)' || chr(10) || '      ↳ no' end || chr(10)
  || chr(10) || 'الإجابة الصحيحة: ' || chr((65 + r)::int) || chr(10) || chr(10) || repeat('-', 40) || chr(10) as t from q)
select capture_id, md5(string_agg(t, chr(10) order by step)) as digest from l group by capture_id""")
def quiz_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = quiz.as_text(quiz.until_repeated(quiz.questions(built.quiz_states(spark, sf_dir))))
    return texts.select("capture_id", F.md5("text").alias("digest"))


@query(_QUIZ + "select capture_id, count(*)::int as n, min('Which of both is the ' || p_name || '?') filter (step = 1) as first, min(chr((65 + r)::int)) filter (step = 1) as first_key from q group by capture_id")
def quiz_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written quizzes, looked into as JSON."""
    rows = quiz.as_json(reports.quizzes(built.quiz_states(spark, sf_dir))[0])
    parsed = F.from_json("questions", "array<struct<id:string,question:struct<en:string>,answer:struct<keys:array<string>>>>")
    return rows.withColumn("q", parsed).select("capture_id", F.size("q").alias("n"), F.get("q", F.lit(0))["question"]["en"].alias("first"), F.get(F.get("q", F.lit(0))["answer"]["keys"], F.lit(0)).alias("first_key"))


@query("""
select p_partkey::varchar as capture_id, p_partkey % 50 + 1 || ' / 50¦Which ' || p_name || '?¦x^{2}¦@@OPT@@¦@@OPT@@¦Hint' as lines, 2 as n_options, 'A. size ' || p_size as first, 'B) type ' || p_type as second, p_size % 2 = 1 as second_marked from part""")
def quiz_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of quizzes: their text with option marks, the options and what marks the right one."""
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    mark = F.when(F.col("p_size") % 2 == 1, " data-state=correct").otherwise(" data-state=incorrect")
    page = t("<body><header>9 / 9</header><main><div>", F.col("p_partkey") % 50 + 1, "<span> / </span>50</div><p>Which <b>", F.col("p_name"), "</b>?<p>x<sup>2</sup></p><ul><li><button><span>A.</span> <i>size</i> ", F.col("p_size"), "</button></li><li", mark, "><div>B) type ", F.col("p_type"), "<i class=mat-icon>radio_button</i></div></li></ul><button>Hint</button></main></body>")
    parts = built.dealt(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    rows = parts.select(F.col("p_partkey").cast("string").alias("capture_id"), F.lit(1).alias("step"), F.lit("pre").alias("phase"), page.alias("html"))
    lines = lambda c: F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "¦")
    o = lambda i: F.get("options", F.lit(i))
    return quiz_html.states_of(rows).select("capture_id", lines("root").alias("lines"), F.size("options").alias("n_options"), lines(o(0)["raw"]).alias("first"), lines(o(1)["raw"]).alias("second"), T.marks_right(o(1)["attrs"]).alias("second_marked"))


@query("select page_id::varchar as capture_id, (page_id % 3)::int as frame_id from pages where page_id % 3 <> 1")
def quiz_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a page and two others the first that shows a counter."""
    page = F.col("page_id")
    counter = lambda i: F.when(page % 3 <= i, F.concat(F.lit("<p>a</p><div>"), (page % 7).cast("string"), F.lit("<b> / </b>9</div>"))).otherwise("<p>3 / 4 of it</p>")
    frames = F.array(*[F.struct(F.lit(i).alias("frame_id"), F.when(page % 3 != 1, counter(i)).otherwise("<p>none</p>").alias("html")) for i in range(3)])
    rows = read(spark, sf_dir, "pages").select(page.cast("string").alias("capture_id"), F.lit(0).alias("snap_seq"), F.explode(frames).alias("f")).select("capture_id", "snap_seq", "f.frame_id", "f.html")
    return captures.quiz_frames(rows).select("capture_id", "frame_id")
