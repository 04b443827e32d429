"""The queries of this subpackage and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_ngrams, decision_list, mixing, near_duplicates, nn_descent, pieces_codec, prefix_trie, pseudonyms, rule_ensemble, secrets, source_divergence, toxicity, training_order
from .shared import documents
from .text_stats import with_counts

#: Vocabulary of the SentencePiece queries, a public file that is not part of this repository, where the session's
#: setting ``spark.casemill.pieceModel`` names no other.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def model_file(spark: SparkSession) -> str:
    return spark.conf.get("spark.casemill.pieceModel", MODEL_FILE)


def pseudonym_key(spark: SparkSession) -> str:
    """The setting ``spark.casemill.pseudonymKey``; without it a random key of this process, which nobody can use later."""
    return spark.conf.get("spark.casemill.pseudonymKey", _RANDOM_KEY)


_RANDOM_KEY = os.urandom(16).hex()


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngrams.scores(documents(spark, sf_dir, "doc_id", "text"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), near_duplicates.Settings(words=3, percent=85, rows=5))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_codec.encoded(documents(spark, sf_dir, "doc_id", "text"), model_file(spark))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.in_training_order(documents(spark, sf_dir, "doc_id", "text"), training_order.Settings(model_file(spark)))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_query(documents(spark, sf_dir))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonyms_query(documents(spark, sf_dir), pseudonym_key(spark))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.quality_query(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_query(documents(spark, sf_dir))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir, "doc_id", "text"), labels(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, sf_dir, "lang", "source", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_secret_scan that fixed patterns give, for comparison with SQL."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_quality_rules that no learning enters, for comparison with SQL."""
    counted = with_counts(documents(spark, sf_dir, "doc_id", "text"), "c_")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return counted.select("doc_id", *[F.col("c_" + n).alias(n) for n in names], decision_list.base_failed("c_").alias("base_failed"))


WORDS = r"[^\x20\x09-\x0D]+"

MIX_SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as size,
    ('0x' || substr(md5('20231|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as n from d group by 1),
w as (select *, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, 1.5::double * sum(n) over () as budget from s),
-- By cap over weight: the level that is left for this source and all later ones, if all earlier ones take their caps.
l as (select *, (budget - coalesce(sum(2 * n) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (o rows between current row and unbounded following) as level
  from w window o as (order by n / w, source nulls last)),
f as (select *, 2 * n <= w * level as clamped from l),
t as (select source, n, case when clamped then 2.0::double * n else least(w * (budget - coalesce(sum(2 * n) filter (clamped) over (), 0)) / (sum(w) filter (not clamped) over ()), 2.0::double * n) end as target from f),
p as (select d.*, t.n, t.target, case when t.n > 0 then floor(t.target / t.n)::bigint else 0 end as whole from d join t on d.source is not distinct from t.source),
r as (select *, target - whole * n as part, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as upto from p)
select doc_id, size::bigint as size, n as source_size, target, (whole * size + greatest(0, least(size, floor(part - upto))))::bigint as taken from r
"""

MARKED = lambda kind, pattern: f"""select doc_id, '{kind}' as kind, {['assign', 'access', 'hex'].index(kind)} as k, unnest(string_split(regexp_replace(coalesce(text, ''), '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1))) as piece, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), 1) as i from (select doc_id, replace(text, chr(1), chr(2)) as text from documents)"""
ASSIGN_SQL = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
SECRET_SQL = f"""
with pieces as ({MARKED("assign", ASSIGN_SQL + "[A-Za-z0-9+/_.=-]+")} union all {MARKED("access", "AKIA[A-Z0-9]+")} union all {MARKED("hex", "[0-9a-f]+")}),
placed as (select *, sum(length(piece)) over (partition by doc_id, kind order by i) as stop from pieces),
spans as (
  select doc_id, kind, k, stop - length(piece) as start, stop from placed
  where i % 2 = 0 and length(case kind when 'assign' then regexp_extract(piece, '^{ASSIGN_SQL}([A-Za-z0-9+/_.=-]+)$', 1) else piece end) >= case kind when 'assign' then 6 when 'access' then 20 else 24 end)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, k), '')) as base_sha256
from documents d left join spans s on d.doc_id = s.doc_id group by d.doc_id
"""

QUALITY_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w from documents),
g as (select doc_id, i, row(w[i], w[i + 1], w[i + 2]) as gram from d, lateral (select unnest(range(1, len(w) - 1)) as i)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as n from g) where n > 1),
c as (select doc_id, count(distinct i + k) as covered from r, (select unnest([0, 1, 2]) as k) group by 1),
l as (select doc_id, count(*) - count(distinct line) as dup from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
n as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(dup, 0)::bigint as n_dup_lines, coalesce(covered, 0)::bigint as n_repeat_words
  from d left join l on d.doc_id = l.doc_id left join c on d.doc_id = c.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from n
"""

DIVERGENCE_SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as lang_n from t group by all having count(distinct id) >= 10),
v as (select lang, count(*) as v, sum(lang_n)::hugeint as n from kept group by 1),
own as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
groups as (select lang, source, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from d) left join own using (lang, source) group by all),
p as (
  select g.lang, g.source, k.term, coalesce(o.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(o.n, 0) + 2) // (total + 2 * v) as p, 1 + 1000000000::hugeint * (lang_n + 2) // (v.n + 2 * v) as q
  from groups g join v on v.lang = g.lang join kept k on k.lang = g.lang left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term group by all) s on s.lang = a.lang and s.source = a.source and s.item = b.source),
ahead as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value::bigint as value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all select * from (select lang, source, 'term', item, value::bigint, (row_number() over (partition by lang, source order by value desc, item))::int as rank from ahead) where rank <= 10
"""

#: CRC-32 of a decimal number, byte by byte and bit by bit.
CRC_SQL = "xor(list_reduce([4294967295::bigint] || list_transform(string_split({0}::varchar, ''), lambda x: ascii(x)::bigint), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
TRIE_SQL = f"""
with own as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from conversations where conv_id is not null),
convs as (select c, {CRC_SQL.format("c")} % 6 as h from (select distinct c from own)),
rebuilt as (
  select convs.c, 1 as part, k, role, text from convs join own on own.c = convs.c - convs.c % 100 and k <= h
  union all select convs.c, 2, k, role, text from convs join own on own.c = convs.c and k > h),
placed as (select c, length(text) as n, sha256(length(role) || ':' || role || text) as turn, row_number() over (partition by c order by part, k) as d from rebuilt),
prefixes as (
  select c, d, n, sha256(string_agg(turn, '') over (partition by c order by d)) as node, case when d = 1 then '' else sha256(string_agg(turn, '') over (partition by c order by d rows between unbounded preceding and 1 preceding)) end as parent from placed
  union all select c, 0, 0, '', null from convs),
nodes as (select node, any_value(parent) as parent, any_value(d) as depth, any_value(n) as n, count(*) as members, min(c) as smallest from prefixes group by 1),
children as (select parent as node, count(*) as children from nodes where parent is not null group by 1),
ends as (select node, sha256(string_agg(c::varchar, ',' order by c)) as ends from (select *, max(d) over (partition by c) as last from prefixes) where d = last group by 1),
below as (select distinct a.node, b.node as inner_node from prefixes a join prefixes b on a.c = b.c and b.d >= a.d),
sums as (select below.node, count(*) filter (children is null) as leaves, sum((members - 1) * n) as saved from below join nodes i on i.node = inner_node left join children k on k.node = inner_node group by 1)
select v.smallest as conv_id, v.depth::bigint as depth, p.smallest as parent_conv_id, v.members::bigint as n_convs, coalesce(children, 0)::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens,
  coalesce(ends, sha256('')) as ends_sha256
from nodes v join sums on sums.node = v.node left join nodes p on p.node = v.parent left join children k on k.node = v.node left join ends e on e.node = v.node
"""


def queries() -> dict[str, Query]:
    return {
        "op1_class_ngrams": op1_class_ngrams,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_training_order": op5_training_order,
        "op6_secret_scan": op6_secret_scan,
        "op7_pseudonyms": op7_pseudonyms,
        "op8_quality_rules": op8_quality_rules,
        "op9_mix_sources": op9_mix_sources,
        "op10_nearest": op10_nearest,
        "op11_toxicity": op11_toxicity,
        "op12_source_divergence": op12_source_divergence,
        "op13_prefix_trie": op13_prefix_trie,
        "secret_base_spans": secret_base_spans,
        "quality_base_counts": quality_base_counts,
    }


def oracle_sql() -> dict[str, str]:
    """What SQL can tell: mixing, the divergence of sources and the prefix trie whole, and the parts of operators 6 and 8 that no model enters."""
    return {"op9_mix_sources": MIX_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_prefix_trie": TRIE_SQL, "secret_base_spans": SECRET_SQL, "quality_base_counts": QUALITY_SQL}
