"""The queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import filter_audit, jaccard_join, language, lm, quality_model, source_audit, toxicity, url_filter
from lumenfold.llm.bpe import digests
from lumenfold.llm.chat import formatted, read_back
from lumenfold.llm.decontaminate import find_leaks
from lumenfold.llm.near_dedup import near_duplicates
from lumenfold.llm.quality_rules import judged


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), words=2, percent=80)


#: The rules of the url filter: verdict and host/path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judged(pages, URL_RULES, url_filter.train(pages, URL_RULES))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_documents(spark, sf_dir))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return read_back(formatted(rows, *vocabulary), *vocabulary)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_documents(spark, sf_dir)).drop("host_rate")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language.identified(docs, language.train(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_model.scored(docs, quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(_documents(spark, sf_dir), words=3, percent=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_chat_format": op5_chat_format,
    "op6_quality_rules": op6_quality_rules,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_source_divergence": op11_source_divergence,
    "op12_filter_audit": op12_filter_audit,
    "op13_jaccard_join": op13_jaccard_join,
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op1_near_dedup": rf"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (
  select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) when len(w) = 1 then w else [] end as s from w),
e as (select doc_id, unnest(s) as v from s),
n as (select doc_id, len(s) as n from s),
i as (select x.doc_id as a, y.doc_id as b, count(*) as i from e x join e y on x.v = y.v and x.doc_id < y.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
pairs as (select a, b from l union select b, a from l),
reach as (select a, b from pairs union select r.a, l.b from reach r join pairs l on r.b = l.a)
select n.doc_id, n.n::bigint as n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) as component_id, n.doc_id = least(n.doc_id, coalesce(min(r.b), n.doc_id)) as kept
from n left join reach r on r.a = n.doc_id group by n.doc_id, n.n""",
    "op3_decontamination": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
ds as (select doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) as v from d where len(w) >= 5),
bs as (select item_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) as v from b where len(w) >= 5),
bn as (select item_id, count(*) as n from bs group by item_id)
select doc_id, item_id, n as item_shingles, count(*) as shared, count(*) / n as containment
from ds join bs using (v) join bn using (item_id) group by doc_id, item_id, n having 100 * count(*) >= 80 * n""",
    "op5_chat_format": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f as (select *, sha256(text) as tie, case when role in ('system', 'user') then 11 + 2 * (role = 'user')::int when role = 'assistant' then 9
    else 21 + length(replace(role, '\', '\\')) + len(regexp_extract_all(role, '<s>|</s>|\[/?INST\]|\[/?SYS\]|\[OUT\]|\[/?ROLE\]|\[/TURN\]')) end
  + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<s>|</s>|\[/?INST\]|\[/?SYS\]|\[OUT\]|\[/?ROLE\]|\[/TURN\]')) as chars from c)
select conv_id::bigint as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, tie)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, tie) filter (role = 'assistant'), '')) as loss_sha256, (3 + sum(chars))::bigint as formatted_chars
from f group by conv_id""",
    "op6_quality_rules": r"""
with t as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select doc_id, w[i:i + 4] as g, i from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w)),
p as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
r as (select doc_id, count(distinct i + j) as r from p, range(5) as x(j) group by doc_id),
c as (select w.doc_id, source, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l) as n_lines, coalesce(r, 0)::bigint as n_repeat_words
  from w left join r using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c),
h as (select source, count(*) as n, count(*) filter (base_failed or 10 * n_symbols > word_chars or 10 * n_dup_lines > 3 * n_lines) as f from b where source is not null group by source),
m as (select count(*) as k, sum(n) as n, (sum(f) + 0.5) / (sum(n) + 1) as mean, greatest(sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2, 0) as spread from h),
e as (select mean, spread - mean * (1 - mean) * (k - 1) / n as between_hosts from m),
s as (select mean, least(greatest(case when between_hosts > 0 then mean * (1 - mean) / between_hosts - 1 else 1e6 end, 2), 1e6) as size from e),
v as (select source, (f + mean * size) / (n + size) as rate from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(rate, 0) <= 0.5 as kept
from b left join v using (source)""",
    "op11_source_divergence": r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
c as (select id, lang, source, term, count(*) as n from (select id, lang, source, unnest(t) as term from d) group by all),
k as (select lang, term, sum(n)::hugeint as n from c group by lang, term having count(*) >= 3),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v, sum(n) as n from k group by lang),
gc as (select c.lang, c.source, c.term, sum(c.n)::hugeint as n from c join k using (lang, term) group by all),
gn as (select lang, source, sum(n) as n from gc group by all),
p as (select g.lang, g.source, k.term, coalesce(gc.n, 0) as c, 1 + 1000000000 * (coalesce(gc.n, 0) + 1) // (coalesce(gn.n, 0) + v.v) as p, 1 + 1000000000 * (k.n + 1) // (v.n + v.v) as q
  from g join k using (lang) join v using (lang) left join gc on gc.lang = g.lang and gc.source = g.source and gc.term = k.term left join gn on gn.lang = g.lang and gn.source = g.source),
ps as (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pairs as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(ps.value, 0)::bigint as value from g x join g y on x.lang = y.lang and x.source <> y.source
  left join ps on ps.lang = x.lang and ps.source = x.source and ps.item = y.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p where c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::int as rank from r where part = 'pair' or rank <= 200""",
    "op12_filter_audit": r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by text) as first from t),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), doc_id > first] as f from w left join l using (doc_id)),
c as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, f),
x as (select unnest(range(1, 6)) as x),
p as (select [a.x, b.x, c.x, d.x, e.x] as p from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
o as (select array_to_string(list_transform(p, lambda i: substr('ABCDE', i::bigint, 1)), '') as filter_order, x.x as step, p[x.x] as own, p[:x.x - 1] as before from p, x),
r as (select part, filter_order, step, own, n, good, toxic, f[own] as fails, len(list_filter(before, lambda i: f[i])) > 0 as gone, len(list_filter(f, lambda y: y)) as k from c, o),
s as (select part, filter_order, step, own, coalesce(sum(n) filter (not gone and not fails), 0)::bigint as kept, coalesce(sum(n) filter (not gone and fails), 0)::bigint as removed,
    coalesce(sum(n) filter (gone and fails), 0)::bigint as redundant, coalesce(sum(n) filter (fails and k = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (not gone and fails), 0)::bigint as good_lost, coalesce(sum(toxic) filter (not gone and fails), 0)::bigint as toxic_lost
  from r group by part, filter_order, step, own)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from s""",
    "op13_jaccard_join": rf"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
e as (select doc_id, unnest(s) as v from s),
n as (select doc_id, len(s) as n from s),
i as (select x.doc_id as a, y.doc_id as b, count(*) as i from e x join e y on x.v = y.v and x.doc_id < y.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
pairs as (select a, b from l union select b, a from l),
reach as (select a, b from pairs union select r.a, l.b from reach r join pairs l on r.b = l.a)
select n.doc_id, n.n::bigint as n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) as component_id from n left join reach r on r.a = n.doc_id group by n.doc_id, n.n""",
}
