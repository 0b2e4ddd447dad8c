"""The dealt operators as registered queries, with their oracle SQL where DuckDB can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.llm import bpe, common, decontaminate, language_model, line_dedup, mixing, ngram_join, prefix_trie, quality, token_counts, toxicity, turn_repair, url_filters, warc

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    cache = f"{common.checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    counted = token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op1_quality_rules", sql=r"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k
      from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
p as (select distinct doc_id, i + o as pos from (select doc_id, i, count(*) over (partition by doc_id, k) as c from g),
      (values (0), (1), (2)) v(o) where c > 1),
r as (select doc_id, count(*) as n_repeat_words from p group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n_dup_lines
      from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
      where regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') <> '' group by doc_id),
s as (select doc_id, source, len(ws)::bigint as n_words,
      length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join r using (doc_id) left join l using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
h as (select source, count(*) as n, sum(base_failed::int) as f from b group by source),
m as (select avg(f / n) as mean, var_samp(f / n) as v from h),
q as (select mean, case when v > 0 and mean > 0 and mean < 1 then least(greatest(mean * (1 - mean) / v - 1, 1), 1e6) else 10 end
      as weight from m),
k as (select source, (f + mean * weight) / (n + weight) <= 0.5 as host_ok from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host_ok as kept
from b left join k on b.source is not distinct from k.source""")
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents"))
    return judged.select("doc_id", *quality.SIGNALS, "base_failed", "kept")


URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _rank_sql(name: str, seeds: str, edges: str, rounds: int = 10) -> str:
    """The rounds of one PageRank written out, as names name_0 .. name_rounds."""
    steps = [f"{name}_0 as (select host, 1.0::double - 0.85::double as score from {seeds})"]
    for k in range(1, rounds + 1):
        steps.append(f"""{name}_{k} as (select host, sum(score) as score from (select * from {name}_0 union all
            select dst, 0.85::double / degree * score from {edges} join {name}_{k - 1} on src = host) group by host)""")
    return ",\n".join(steps)


@query("op6_url_filters", sql=rf"""
with u as (select page_id, coalesce(html, '') as html, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') as h,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
p as (select page_id, html, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from u),
f as (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
      when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from p),
v as (select *, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end as fit from f),
hosts as (select host, count(*) as n, count(*) filter (fit = 'allow') as a, count(*) filter (fit = 'block') as b
          from v where host <> '' group by host),
links as (select distinct host as src, translate(unnest(regexp_extract_all(html,
          '(?i)\bhref\s*=\s*["'']?[a-z][a-z0-9+.-]*://([^/?#"''\s<>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from p),
edges as (select src, dst from links where src <> dst and src <> ''),
fore as (select src, dst, count(*) over (partition by src) as degree from edges),
back as (select dst as src, src as dst, count(*) over (partition by dst) as degree from edges),
good as (select host from hosts where 2 * a > n), bad as (select host from hosts where 2 * b > n),
{_rank_sql('t', 'good', 'fore')},
{_rank_sql('d', 'bad', 'back')}
select page_id, v.host, path, rule,
  coalesce(fit, case when coalesce(d_10.score, 0) > coalesce(t_10.score, 0) + 0.05 then 'block' else 'allow' end) as verdict
from v left join t_10 on v.host = t_10.host left join d_10 on v.host = d_10.host""")
def op6_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.judge(table(spark, sf, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op5_warc")
def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{common.checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    written = warc.write_archives(table(spark, sf, "pages"), f"{folder}/whole")
    warc.normalise(written, f"{folder}/members")
    return warc.read_records(spark, f"{folder}/members").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_ngram_join")
def op10_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(table(spark, sf, "documents"), n=4, similarity=(85, 100))


@query("op2_line_dedup", sql=r"""
with raw as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents),
l as (select doc_id, no, line, trim(regexp_replace(lower(line), '[\x09-\x0D ]+', ' ', 'g')) as norm from raw),
d as (select norm, min((doc_id, no)) as first from l where norm <> '' group by norm),
w as (select first, norm, string_split(norm, ' ') as ws, len(string_split(norm, ' ')) as n from d),
h as (select first, ws, n, unnest([('p', n, ws[1:n // 2]), ('s', n, ws[n // 2 + 1:]), ('p', n - 1, ws[1:(n - 1) // 2]),
      ('s', n - 1, ws[(n - 1) // 2 + 2:])]) as k from w where n >= 8),
c as (select distinct a.first as spot, b.first as other, a.ws as x, b.ws as y from h a join h b on a.k = b.k and b.first < a.first
      where abs(a.n - b.n) <= 1),
near as (select distinct spot from c where
  (len(x) = len(y) and len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i])) <= 1)
  or (len(x) = len(y) + 1 and len(list_filter(range(0, len(x)), lambda i: list_concat(x[1:i], x[i + 2:]) = y)) > 0)
  or (len(y) = len(x) + 1 and len(list_filter(range(0, len(y)), lambda i: list_concat(y[1:i], y[i + 2:]) = x)) > 0)),
f as (select l.*, l.norm <> '' and (l.doc_id, l.no) <> d.first as again, l.norm <> '' and near.spot is not null as near
      from l left join d on l.norm = d.norm left join near on near.spot = (l.doc_id, l.no)),
g as (select doc_id, count(*) as n_lines, count(*) filter (again or near) as n_removed, count(*) filter (near and not again) as n_near,
      coalesce(string_agg(line, chr(10) order by no) filter (not (again or near)), '') as text from f group by doc_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_near, 0) as n_near,
  sha256(g.text) as text_sha256 from documents left join g using (doc_id)""")
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return left.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"), F.col("ld_near").alias("n_near"),
                       F.sha2("text", 256).alias("text_sha256"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op8_language_model")
def op8_language_model(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    docs = table(spark, sf, "documents").select("doc_id", "text", F.coalesce(~held_out, F.lit(True)).alias("train"))
    return language_model.train_and_score(docs, "train").withColumn("held_out", F.coalesce(held_out, F.lit(False)))


@query("op11_mixing", sql=r"""
with s as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           sha256(concat_ws('|', '11', doc_id, text)) as key from documents),
g as (select source, sum(size)::bigint as source_size from s group by source),
k as (select *, row_number() over (order by source nulls last) as no, 1.5::double * sum(source_size) over () as total, 2.0::double * source_size as cap from g),
w as (select *, ([3.0, 1.0, 2.0])[((no - 1) % 3 + 1)::int]::double as weight from k),
c as (select *, cap / weight as full_at, row_number() over o as fills, total - (sum(cap) over o - cap) as goes_on,
      sum(weight) over () - (sum(weight) over o - weight) as free from w window o as (order by cap / weight, no rows unbounded preceding)),
l as (select arg_min(goes_on / free, fills) as level from c where goes_on / free <= full_at),
t as (select source, source_size, coalesce(least(cap, level * weight), cap) as target from w, l),
d as (select s.*, source_size, target, sum(size) over (partition by s.source order by key rows unbounded preceding) as upto,
      coalesce(target / nullif(source_size, 0), 0) as rate from s join t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  ((floor(rate) + (upto - size / 2 < target - floor(rate) * source_size)::int) * size)::bigint as taken from d""")
def op11_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: unsigned CRC-32 of an ASCII string, by the table in bytes_of
CRC_TABLE = "bytes_of as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384))) as crcs)"


def _crc32_sql(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295)"


@query("op12_prefix_trie", sql=f"""
with {CRC_TABLE},
t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, md5(concat(length(coalesce(role, '')), ':', role, ':', text))) as i,
      {{'role': coalesce(role, ''), 'said': coalesce(text, '')}} as turn from conversations where conv_id is not null),
own as (select c, list(turn order by i) as turns from t group by c),
h as (select c, turns, {_crc32_sql("c::varchar")} % 6 as skip from own, bytes_of),
r as (select h.c, list_concat(coalesce(o.turns, [])[1:skip], h.turns[skip + 1:]) as path from h left join own o on o.c = h.c - h.c % 100),
m as (select c, len(path) as n, unnest(range(0, len(path) + 1)) as depth, path from r),
p as (select c, n, depth, path[1:depth] as node from m),
nodes as (select node, depth, min(c) as conv_id, count(*) as n_convs, case when depth = 0 then 0 else (count(*) - 1) * length(any_value(node[depth].said)) end as saved,
      coalesce(string_agg(c::varchar, ',' order by c) filter (where n = depth), '') as ends from p group by node, depth),
kids as (select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by 1),
flat as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (node)),
up as (select node[1:e] as node, saved, (n_children = 0)::int as leaf from (select *, unnest(range(0, depth + 1)) as e from flat)),
sums as (select node, sum(saved)::bigint as saved_tokens, sum(leaf)::bigint as n_leaves from up group by node)
select f.conv_id, f.depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(f.ends) as ends_sha256
from flat f join sums using (node) left join nodes q on f.depth > 0 and q.depth = f.depth - 1 and q.node = f.node[1:f.depth - 1]""")
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf, "conversations"))


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _edit(state: str, cost: str, letter: str, where: str = "true") -> str:
    return f"{{'cost': case when {where} then {state}.cost + {cost} else 1000000000 end, 'audit': {state}.audit || '{letter}'}}"


#: rows consumed one after the other; s0 nothing put out, s1 after s, s2 after u, s3 after a; inserts go before the next row
_REPAIR_STEP = f"""
b0 as (select c, 0::bigint as i, {{'cost': 0::bigint, 'audit': ''}} as s0, {{'cost': 1000000000::bigint, 'audit': ''}} as s1,
       {{'cost': 3::bigint, 'audit': 'I'}} as s2, {{'cost': 6::bigint, 'audit': 'II'}} as s3 from convs),
st as (select * from b0 union all
  select c, i, s0, s1, s2, {_least('s3', _edit('s2', '3', 'I'))} as s3 from (
    select c, i, s0, s1, s3, {_least('s2', _edit('s0', '3', 'I'), _edit('s1', '3', 'I'), _edit('s3', '3', 'I'))} as s2 from (
      select st.c, f.i, {_edit('s0', '4', 'D')} as s0, {_least(_edit('s1', '4', 'D'), _edit('s0', 'more', 'K', "free and first = 's'"))} as s1,
        {_least(_edit('s2', '4', 'D'), *[_edit(x, 'more', 'K', "free and first = 'u'") for x in ('s0', 's1', 's3')],
                *[_edit(x, 'more + 3', 'R', 'free') for x in ('s0', 's1', 's3')])} as s2,
        {_least(_edit('s3', '4', 'D'), _edit('s2', 'more', 'K', "free and first = 'a'"), _edit('s2', 'more + 3', 'R', 'free'))} as s3
      from st join f on f.c is not distinct from st.c and f.i = st.i + 1)))"""


@query("op13_turn_repair", sql=rf"""
with recursive {CRC_TABLE},
z as (select conv_id as c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
      {_crc32_sql("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 as z from conversations, bytes_of),
convs as (select distinct c from z),
d as (select c, turn, case when z = 4 then 'user' else role end as role, case when z = 1 then '' when z = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
      unnest(range(case z when 3 then 2 else 1 end)) as copy from z where z <> 0),
o as (select *, row_number() over (partition by c order by turn nulls first, role, sha256(text), copy) as i from d),
n as (select *, row_number() over (partition by c, role, text order by i) as again, left(role, 1) as first, lag(left(role, 1)) over (partition by c order by i) as prior from o),
f as (select *, case when not regexp_matches(text, '[^ 	-]') then 'blank' when again > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][ 	-]*\z') then 'truncated' else '' end as fault,
      fault not in ('blank', 'duplicate') as free, case when fault = 'truncated' then 3 else 0 end as more from n),
{_REPAIR_STEP},
best as (select st.c, {_least('s0', 's3')} as b from st join (select c, max(i) as i from st group by c) e on st.c is not distinct from e.c and st.i = e.i),
l as (select c, j, b.audit[j] as letter, length(replace(b.audit[1:j], 'I', '')) as i, length(replace(b.audit[1:j], 'D', '')) as place
      from (select c, b, unnest(range(1, length(b.audit) + 1)) as j from best)),
k as (select l.*, f.role, f.text, f.first from l left join f on f.c is not distinct from l.c and f.i = l.i where letter <> 'D'),
s as (select c, bool_or(place = 1 and letter = 'K' and first = 's') as system from k group by c),
x as (select k.c, string_agg(case when letter = 'K' then role when (place - system::int) % 2 = 1 then 'user' else 'assistant' end || ':' ||
      case when letter = 'I' then '' else text end, chr(10) order by j) as lines from k join s on k.c is not distinct from s.c group by k.c),
a as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
      count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
      count(*) filter (prior is not null and prior || first not in ('su', 'ua', 'au')) as illegal from f group by c)
select best.c as conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, b.cost as cost, b.audit as audit, sha256(coalesce(lines, '')) as repaired_sha256
from best left join a on a.c is not distinct from best.c left join x on x.c is not distinct from best.c""")
def op13_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(table(spark, sf, "conversations")), F.col("copies"))
