"""Registered queries of the subpackage, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, stage
from . import (chat, divergence, hnsw, jaccard_join, license_scan, mixing, personal_data, quality_rules, sentencepieces,
               sharding, toxicity, vector_cells, warc)
from .text import read, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op1_hnsw_shards")
def op1_hnsw_shards(spark, sf_dir):
    return hnsw.nearest(read(spark, sf_dir, "embeddings"), k=20, every=20)


@query("op2_warc_salvage")
def op2_warc_salvage(spark, sf_dir):
    folder = f"{shared_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    warc.write_archives(read(spark, sf_dir, "pages"), folder, least_bytes=0)
    found = warc.resolve(stage(warc.read_archives(spark, folder), "records"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_license_compression")
def op3_license_compression(spark, sf_dir):
    return license_scan.scan(read(spark, sf_dir, "documents"))


@query("op4_snapshot_collapse", """with t as (select distinct conv_id, turn, role, text from conversations),
c as (select conv_id, list({'r': role, 'x': text} order by turn nulls first, role nulls first, text nulls first) as ts,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
    order by turn nulls first, role nulls first, text nulls first) as chat from t group by conv_id),
u as (select min(conv_id) as conv_id, ts, count(*) as copies, any_value(chat) as chat from c group by ts),
k as (select * from u where not exists (select 1 from u v where v.ts[1] = u.ts[1] and len(v.ts) > len(u.ts) and v.ts[:len(u.ts)] = u.ts))
select conv_id, cast(len(ts) as bigint) as n_turns, cast(copies as bigint) as copies, chat from k""")
def op4_snapshot_collapse(spark, sf_dir):
    return chat.collapse_and_render(read(spark, sf_dir, "conversations"))


@query("op5_automaton_toxicity")
def op5_automaton_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


RULES_SQL = f"""w as (select doc_id, source, coalesce(text, '') as text, {WORDS} as words from documents),
win as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as win
        from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w)),
rep as (select doc_id, count(distinct p) as n from (
          select doc_id, unnest(range(i, i + 8)) as p from (
            select doc_id, i, count(*) over (partition by doc_id, win) as c from win) where c > 1) group by doc_id),
counted as (
  select w.doc_id, source, cast(len(words) as bigint) as n_words,
    cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from w) w
  left join rep on rep.doc_id = w.doc_id),
based as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted),
hosts as (select source as host, count(*) as n, count(*) filter (base_failed) as f from based where source is not null group by source),
prior as (select m, case when v - m * (1 - m) * inv > 0 and m * (1 - m) > v - m * (1 - m) * inv
    then least(m * (1 - m) / (v - m * (1 - m) * inv) - 1, n) else n end as s
  from (select avg(f / n) as m, var_pop(f / n) as v, avg(1 / n) as inv, sum(n) as n from hosts)),
bad as (select host from hosts, prior where (f + m * s) / (n + s) > {quality_rules.MAX_HOST_RATE})"""


@query("op6_host_quality_rules", f"""with {RULES_SQL}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (source is null or source not in (select host from bad)) as kept from based""")
def op6_host_quality_rules(spark, sf_dir):
    report = quality_rules.quality_report(read(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_byte_balanced_shards", """with crc as (select list_transform(range(256), lambda i: list_reduce(
    list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
sized as (select doc_id, cast(strlen(text) + 1 as bigint) as size, md5(text) as g,
  xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(text)), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from d, crc),
placed as (select *, sum(size) over (order by g, doc_id) - size as start, row_number() over (order by g, doc_id) - 1 as r,
  sum(size) over () as total from sized),
grp as (select g, min(start) as first, max(start + size) as last, any_value(total) as total from placed group by g),
cuts as (select i, case when last - first > 0.001 * total / 8 then total * i / 8 when total * i / 8 - first <= last - total * i / 8
  then first else last end as cut from grp, range(1, 8) x(i) where first < total * i / 8 and last >= total * i / 8),
shards as (select doc_id, size, crc, r, (select count(*) from cuts where start >= cut) as shard from placed)
select doc_id, size, cast(crc as bigint) as text_crc32, 'bytes' as law, cast(shard as int) as shard,
  cast(r - min(r) over (partition by shard) as bigint) as slot, cast(null as int) as grown_shard from shards""")
def op7_byte_balanced_shards(spark, sf_dir):
    cut = sharding.shard_documents(read(spark, sf_dir, "documents"), 8)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op8_sentencepiece_chunks")
def op8_sentencepiece_chunks(spark, sf_dir):
    return sentencepieces.encode(read(spark, sf_dir, "documents"))


@query("op9_heavy_light_jaccard", r"""with recursive
w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') as words from documents),
sh as materialized (select distinct doc_id, array_to_string(words[i:i + 4], ' ') as s
  from (select doc_id, words, unnest(case when len(words) = 0 then [] else range(1, greatest(len(words) - 3, 2)) end) as i from w)),
n as materialized (select doc_id, count(*) as n from sh group by doc_id),
links as materialized (select a, b from (
    select x.doc_id as a, y.doc_id as b, count(*) as o from sh x join sh y on x.s = y.s and x.doc_id <> y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * o >= 80 * (na.n + nb.n - o)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles,
  cast(least(w.doc_id, coalesce((select min(b) from reach where a = w.doc_id), w.doc_id)) as bigint) as component_id
from w left join n on n.doc_id = w.doc_id""")
def op9_heavy_light_jaccard(spark, sf_dir):
    linked = jaccard_join.link_documents(read(spark, sf_dir, "documents"))
    return linked.select("doc_id", "n_shingles", "component_id")


def mixing_sql(sized: str) -> str:
    """CTEs ending in ``taken`` over a table of doc_id, source, size."""
    return f"""sized as (select doc_id, source, size, md5(concat_ws(':', cast(doc_id as varchar), '7')) as mixed from {sized}),
src as (select source, sum(size) as source_size, [5.0::double, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from sized group by source),
lim as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as lvl from src),
lev as (select *, coalesce(sum(cap) over b, 0) as used, coalesce(sum(weight) over b, 0) as heavy, sum(weight) over () as ws,
  1.5::double * sum(source_size) over () as words, row_number() over (order by lvl, source nulls last) as k from lim
  window b as (order by lvl, source nulls last rows between unbounded preceding and 1 preceding)),
pick as (select min_by((words - used) / (ws - heavy), k) as level from lev where (words - used) / (ws - heavy) <= lvl),
tgt as (select source, source_size, case when level is null then cap else least(cap, level * weight) end as target from lim, pick),
q as (select s.*, source_size, target, sum(size) over (partition by s.source order by mixed, doc_id) as ends
  from sized s join tgt t on s.source is not distinct from t.source),
tickets as (select *, (source_size * copy + ends)::double / target as finish from q, (values (0), (1)) c(copy) where size > 0),
run as (select *, sum(size) over (order by finish, source nulls last, mixed, doc_id, copy rows between unbounded preceding and current row) as upto,
  1.5::double * (select sum(size) from sized) as words from tickets),
stop as (select min(upto) as upto from run where upto > words),
took as (select doc_id, count(*) as copies from run, stop where stop.upto is null or run.upto < stop.upto group by doc_id),
taken as (select q.doc_id, q.size, q.source_size, q.target, coalesce(took.copies, 0) as copies from q left join took on took.doc_id = q.doc_id)"""


@query("op10_weighted_fair_queueing", f"""with counts as (select doc_id, source, cast(len({WORDS}) as bigint) as size from documents),
{mixing_sql('counts')}
select doc_id, size, cast(source_size as bigint) as source_size, target, cast(size * copies as bigint) as taken from taken""")
def op10_weighted_fair_queueing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    mix = mixing.queue(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query("op11_vote_personal_data")
def op11_vote_personal_data(spark, sf_dir):
    return personal_data.report(read(spark, sf_dir, "documents"))


@query("op12_skyband_audit", r"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
t as materialized (select r, lang, source, term, count(*) as n from (select r, lang, source, unnest(ts) as term from d) group by all),
kept as materialized (select lang, term, sum(n) as n from t group by lang, term having count(*) >= 10),
langs as (select lang, sum(n) as total, count(*) as v from kept group by lang),
grp as materialized (select distinct lang, source from d),
c as materialized (select g.lang, g.source, k.term, coalesce(sum(t.n), 0)::hugeint as n, any_value(k.n)::hugeint as lang_n
  from grp g join kept k using (lang) left join t on t.lang = g.lang and t.source = g.source and t.term = k.term group by all),
sizes as (select lang, source, sum(n) as total from c group by lang, source),
s as materialized (select c.*, 1 + 1000000000 * (c.n + 2) // (z.total + 2 * v) as p, 1 + 1000000000 * (lang_n + 2) // (l.total + 2 * v) as q
  from c join sizes z using (lang, source) join langs l using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
both_parts as (select g.lang, g.source, 'pair' as part, o.source as item, coalesce(value, 0) as value
  from grp g join grp o on o.lang = g.lang and o.source <> g.source
  left join pairs p on p.lang = g.lang and p.source = g.source and p.item = o.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from s where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from both_parts)
where part = 'pair' or rank <= 10""")
def op12_skyband_audit(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"))


def clustering_sql(rounds: int = 10) -> str:
    """The rounds of op13 as one query: a{r} assigns, c{r} holds the centroids after round r."""
    parts = ["""kept as materialized (select row_number() over () as r, vec_id, v from (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)),
c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), v) - 1 as c, v as m
  from (select * from kept order by sha256('3:' || vec_id), v limit 8))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (select r, min_by(c, (d, c)) as c, min(d) as d from (
  select r, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) as d from kept, c{r}) group by r)""")
        if r < rounds:
            parts.append(f"""c{r + 1} as materialized (select o.c, coalesce(n.m, o.m) as m from c{r} o left join (
  select c, list((s - ((s % n) + n) % n) // n order by i) as m from (
    select c, i, sum(v[i]) as s, count(*) as n from (select a.c, k.v, unnest(range(1, 65)) as i from kept k join a{r} a using (r)) group by c, i)
  group by c) n on n.c = o.c)""")
    body = ",\n".join(parts)
    return f"""with {body}
select vec_id, cast(a.c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from kept join a{rounds} a using (r) join c{rounds} c on c.c = a.c"""


@query("op13_cell_clustering", clustering_sql())
def op13_cell_clustering(spark, sf_dir):
    return vector_cells.cluster(read(spark, sf_dir, "embeddings"))
