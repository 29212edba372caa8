"""The operators applied to the given tables, one registered query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm import arrow_sequences, chat_format, decontamination, katz, language_id, lexical_search, licenses, ngram_join, packing, spelling_variants, toxicity, url_filters, vector_dedup
from mapweave.llm.common import table
from mapweave.session import scratch_path


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "sequences")
    manifest = arrow_sequences.write_sequences(table(spark, sf_dir, "documents"), folder)
    return arrow_sequences.read_documents(manifest, folder)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(table(spark, sf_dir, "conversations"))


# Host, path and verdict.
URL_RULES = "values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"select * from {URL_RULES} as rules(host, path, verdict)")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_katz, op2_ngram_join, op3_language_id, op4_best_fit_packing, op5_arrow_sequences, op6_decontamination, op7_vector_dedup,
        op8_toxicity, op9_licenses, op10_chat_format, op11_url_filters, op12_lexical_search, op13_spelling_variants,
    )
}
# Five-word sets, links by whole-number arithmetic, and the smallest id reachable.
_WORDS = """
list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')
"""
OP2_SQL = f"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
s as materialized (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i+4], ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
k as materialized (select doc_id, md5(string_agg(g, '|' order by g)) as k from s group by doc_id),
r as materialized (select min(doc_id) as rep, k from k group by k),
o as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.g = y.g and x.doc_id < y.doc_id
  where x.doc_id in (select rep from r) and y.doc_id in (select rep from r) group by all),
l as materialized (select a, b from o join n p on p.doc_id = a join n q on q.doc_id = b where 100 * shared >= 80 * (p.n + q.n - shared)),
e as materialized (select a, b from l union select b, a from l),
reach(a, b) as (select rep, rep from r union select reach.a, e.b from reach join e on e.a = reach.b),
c as (select a, min(b) as c from reach group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, w.doc_id) as component_id
from w left join n using (doc_id) left join k using (doc_id) left join r on r.k = k.k left join c on c.a = r.rep
"""
OP7_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as materialized (select *, sqrt(list_dot_product(e, e)) as size from v),
l as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.size * b.size) >= 93e-2),
reach(a, b) as (select vec_id, vec_id from embeddings union select reach.a, l.b from reach join l on l.a = reach.b),
c as (select a as vec_id, min(b) as component_id from reach group by a),
n as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings join c using (vec_id) left join n using (vec_id)
"""
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP11_SQL = f"""
with rules(host, path, verdict) as ({URL_RULES}),
p as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {_LOWER}) as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
b as (select p.*, (select arg_max({{'rule': r.host || r.path, 'verdict': r.verdict}}, 1000 * length(r.host || r.path) + length(r.host)) from rules r
  where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)) as best from p)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from b
"""
_TERMS = r"""translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), """ + _LOWER + ")"
OP12_SQL = f"""
with docs as (select row_number() over () as k, doc_id, text from documents),
t as (select k, doc_id, {_TERMS} as term from docs),
c as materialized (select k, doc_id, term, count(*) as tf from t group by all),
d as materialized (select k, sum(tf)::bigint as n from c group by k),
g as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from d),
q as materialized (select item_id, term, count(*) as times from (select item_id, {_TERMS} as term from benchmark) group by all),
f as (select term, count(*) as df from c where term in (select term from q) group by term),
w as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint as w from f, g),
s as (select item_id, k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::bigint as score
  from q join c using (term) join w using (term) join d using (k), g group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id, k) as rank, doc_id, score from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""
# crc32 byte by byte; near words by the forms with one letter left out.
OP13_SQL = f"""
with recursive c as (select list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, v) as v, v as i from (select unnest(range(256)) as v)),
tab as (select list(v order by i) as t from c),
r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), {_LOWER}) as run from documents),
u as (select doc_id, run, count(*) as times, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from r where length(run) >= 7 group by all),
h as (select u.*, xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) as h from u, tab),
o as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from h),
v as materialized (select word, sum(times)::bigint as n from o where length(word) >= 7 group by word having sum(times) >= 2),
g as materialized (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from v)),
s as (select distinct g.word as a, v.word as b from g join v on g.rest = v.word),
p as materialized (select g.word, o.word as near from g join g o on g.i = o.i and g.rest = o.rest and g.word <> o.word union select a, b from s union select b, a from s),
m as (select p.word, count(*) as n_near, min({{'minus': -v.n, 'near': p.near}}) as best from p join v on p.near = v.word group by p.word),
f as materialized (select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when -best.minus >= 10 * v.n then best.near end as form,
  case when -best.minus >= 10 * v.n then -best.minus end as form_n from v left join m using (word)),
w(word, root) as (select word, word from f union all select w.word, f.form from w join f on f.word = w.root where f.form is not null)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n from f join w using (word) join f e on e.word = w.root where e.form is null
"""
ORACLE: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op7_vector_dedup": OP7_SQL, "op11_url_filters": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_spelling_variants": OP13_SQL}
