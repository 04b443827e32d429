"""Queries of intake: submissions, payload leaves, context, facts, proposals, placeholders, dates; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import dates, text
from casemill.operators import context, evidence, redact
from casemill.queries import query
from casemill.sources import submissions

# --- submissions -----------------------------------------------------------------


def _submissions(t) -> DataFrame:
    """A conversation as a submission: the first turn is the body, the others are attachments."""
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("p"))
    more = F.transform(F.slice("p", 2, 1000), lambda x: F.struct(
        F.when(x["turn"] % 2 == 0, F.concat(F.lit("a"), x["turn"].cast("string"))).alias("id"), F.lit(None).cast("string").alias("mediaType"), F.lit(None).cast("string").alias("filename"),
        F.md5(x["text"]).alias("sha256"), x["text"].alias("text"), F.when(x["role"] == "user", "email").otherwise("unknown").alias("sourceType"),
    ))
    return turns.select(
        F.col("conv_id").cast("string").alias("submissionId"), F.when(F.col("conv_id") % 3 == 0, "scan").otherwise("email").alias("channel"), F.get("p", F.lit(0))["text"].alias("bodyText"),
        F.when(F.col("conv_id") % 2 == 0, "typed").alias("bodySourceType"), more.alias("attachments"),
    )


SUBMITTED = "with s as (select conv_id::varchar as submissionId, conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as i from conversations)"


@query(
    SUBMITTED + """, k as (select *, case when i = 0 then case when conv_id % 2 = 0 then 'typed' end when role = 'user' then 'email' end as declared from s where trim(coalesce(text, '')) <> ''),
 o as (select *, row_number() over (partition by conv_id order by i) as ordinal from k)
 select submissionId, 'part-text-' || ordinal as part_id, md5(text) as digest, coalesce(declared, case when conv_id % 3 = 0 then 'ocr' else 'typed' end) as source_type from o"""
)
def submission_parts(t):
    return submissions.text_parts(_submissions(t)).select("submissionId", "part_id", F.md5("text").alias("digest"), "source_type")


@query(SUBMITTED + " select submissionId, case when turn % 2 = 0 then 'a' || turn else submissionId || '-att-' || i end as ref_id, 'application/octet-stream' as media_type, md5(text) as sha256 from s where i > 0")
def submission_attachments(t):
    return submissions.attachment_refs(_submissions(t))


@query("""select c_custkey, sha256('{"a":{"n":' || c_nationkey || ',"x":"' || c_mktsegment || '"},"k":' || c_custkey || ',"z":[1,' || c_nationkey || ']}') as digest from customer""")
def payload_digests(t):
    k = lambda c: F.col(c).cast("string")
    raw = F.concat(F.lit('{ "z": [1, '), k("c_nationkey"), F.lit('], "k": '), k("c_custkey"), F.lit(', "a": {"x": "'), F.col("c_mktsegment"), F.lit('", "n": '), k("c_nationkey"), F.lit("}}"))
    return t("customer").select("c_custkey", submissions.payload_digest(raw).alias("digest"))


# --- payload leaves and identity paths -----------------------------------------------


def _payload(t) -> DataFrame:
    inner = F.struct(F.concat(F.lit("  "), F.col("c_name"), F.lit("\t")).alias("name"), F.struct(F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") < 0).alias("debt")).alias("more"))
    return t("customer").select("c_custkey", F.to_json(F.struct(inner.alias("a"), F.array("c_mktsegment", F.lit("x")).alias("list"), F.lit(" ").alias("blank"), F.lit("n").alias("last"))).alias("payload"))


@query(
    "select c_custkey, unnest(['payload.a.name', 'payload.a.more.nation', 'payload.a.more.debt', 'payload.last']) as path, unnest([trim(c_name), c_nationkey::varchar, (c_acctbal < 0)::varchar, 'n']) as value from customer"
)
def payload_fields(t):
    return _payload(t).select("c_custkey", F.inline(context.flat_fields(F.col("payload"))))


@query("select c_custkey, unnest(['a.name', 'list[0]', 'list[1]', 'blank', 'last']) as path, unnest(['  ' || c_name || chr(9), c_mktsegment, 'x', ' ', 'n']) as value from customer")
def payload_strings(t):
    return _payload(t).select("c_custkey", F.inline(context.string_leaves(F.col("payload"))))


@query("select n_nationkey, 'a,' || (n_nationkey % 3) || ',b,' || n_nationkey || ',c' as steps from nation")
def path_steps(t):
    k = F.col("n_nationkey")
    path = F.concat(F.lit("a["), (k % 3).cast("string"), F.lit("].b["), k.cast("string"), F.lit("].c"))
    return t("nation").select("n_nationkey", F.array_join(context.path_steps(path), ",").alias("steps"))


IDENTITY = (context.IdentityField("a.name", "NAME"), context.IdentityField("a.more", "ORG", subtree=True), context.IdentityField("lis", "AKTZ", subtree=True))


@query("select c_custkey, unnest(['a.name', 'a.more.nation', 'a.more.debt']) as path, unnest(['NAME', 'ORG', 'ORG']) as kind from customer")
def identity_paths(t):
    context.check_identity(IDENTITY)
    found = _payload(t).select("c_custkey", F.explode(context.leaves(F.col("payload"))).alias("x")).select("c_custkey", F.col("x.path").alias("path"))
    return found.withColumn("kind", context.covering(F.col("path"), IDENTITY)).where("kind is not null")


@query(
    "select c_custkey, case when c_custkey % 2 = 0 then c_nationkey end::bigint as n, case when c_custkey % 3 = 0 then c_mktsegment end as s from customer"
)
def defensive_casts(t):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = F.when(k % 2 == 0, n).when(k % 5 == 0, "true").otherwise(quoted(n))
    word = F.when(k % 3 == 0, quoted(F.col("c_mktsegment"))).otherwise(n)
    raw = F.concat(F.lit('{"p": {"n": '), number, F.lit(', "s": '), word, F.lit("}}"))
    return t("customer").select("c_custkey", context.as_int(raw, "p.n").alias("n"), context.as_text(raw, "p.s").alias("s"))


# --- context, facts, texts -----------------------------------------------------------


def _parts(t) -> DataFrame:
    return t("conversations").select("conv_id", F.col("turn").alias("ordinal"), "text", F.col("role").alias("source_type"))


@query(
    """with p as (select conv_id, string_agg(text, ' ' order by turn) as told, array_to_string(list_sort(list_distinct(list(role))), ',') as types from conversations where trim(coalesce(text, '')) <> '' group by 1),
 c as (select distinct conv_id from conversations)
 select c.conv_id, case when c.conv_id % 4 > 0 then 'h' || c.conv_id % 4 end as hint, md5(trim(regexp_replace(regexp_replace(told, '(\\p{L})-[\\s]*[\\r\\n]\\s*(\\p{L})', '\\1\\2', 'g'), '\\s+', ' ', 'g'))) as digest, coalesce(types, '') as types from c left join p using (conv_id)"""
)
def evaluation_context(t):
    k = F.col("conv_id")
    cases = t("conversations").select("conv_id").distinct().select("conv_id", F.when(k % 4 > 0, F.concat(F.lit("h"), (k % 4).cast("string"))).alias("h"), F.lit("email").alias("c"))
    out = context.evaluation_context(cases, _parts(t), "conv_id", "h", "c")
    return out.select("conv_id", "hint", F.md5("text_normalized").alias("digest"), F.array_join("source_types", ",").alias("types"))


@query(
    "select doc_id, md5(case when length(trim(text)) <= 1200 then trim(text) else regexp_extract(substr(trim(text), 1, 1200), '(?s)^(.*) ', 1) end) as digest from documents where regexp_matches(text, '^[ -~]*$') and trim(text) <> ''"
)
def item_text_prose(t):
    d = t("documents").where("text rlike '^[ -~]*$' and trim(text) <> ''")
    return d.select("doc_id", F.md5(context.item_text(F.col("text"), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))).alias("digest"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'nation: ' || c_nationkey || ' | segment: ' || c_mktsegment else 'name: ' || c_name || ' | nation: ' || c_nationkey || ' | segment: ' || c_mktsegment end as told from customer")
def item_text_facts(t):
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit("[[PII|NAME|BCDFGHJKMNPQ]]")).otherwise(F.col("c_name"))
    facts = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), name, F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("empty"), F.lit(" "))
    return t("customer").select("c_custkey", context.item_text(F.lit(None).cast("string"), facts).alias("told"))


@query(
    """with r as (select l_orderkey, 'f' || (l_partkey % 5) as field, l_linenumber::varchar as value, l_linenumber as n from lineitem), f as (select l_orderkey, field, arg_max(value, n) as value from r group by 1, 2)
 select l_orderkey, string_agg(field || '=' || value, ',' order by case field when 'f3' then 0 when 'f1' then 1 else 2 end, field) as facts from f group by 1"""
)
def ordered_facts(t):
    r = t("lineitem").select("l_orderkey", F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")).alias("field"), F.col("l_linenumber").cast("string").alias("value"), "l_linenumber")
    listed = context.ordered_facts(F.col("facts"), ("f3", "f1", "f9"))
    told = F.array_join(F.transform(listed, lambda x: F.concat(x["field"], F.lit("="), x["value"])), ",")
    return context.facts_from(r, "l_orderkey", "field", "value", "l_linenumber").select("l_orderkey", told.alias("facts"))


@query("select n_name as field, 'about ' || n_nationkey as description from nation where n_nationkey % 2 = 0 and n_nationkey in (select c_nationkey from customer where c_acctbal > 0)")
def field_descriptions(t):
    k = F.col("n_nationkey")
    required = t("nation").select(F.when(k % 2 == 0, "field").otherwise("document").alias("kind"), F.col("n_name").alias("field"), F.concat(F.lit("about "), k.cast("string")).alias("description"))
    mapped = t("customer").where("c_acctbal > 0").join(t("nation"), F.col("c_nationkey") == k).select(F.col("n_name").alias("field"))
    return context.field_descriptions(required, mapped)


@query("select r_regionkey, 'r' || r_regionkey as rules, 't2' as \"table\" from region")
def version_stamp(t):
    out = context.stamped(t("region"), {"rules": "r0", "table": "t2"}, {"rules": F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))})
    return out.select("r_regionkey", "versions.rules", "versions.table")


@query(
    "select conv_id, count(*) as n_parts, count(*) filter (trim(coalesce(text, '')) = '') as n_blank, sum(length(coalesce(text, '')))::bigint as n_chars, max(length(coalesce(text, '')))::bigint as longest, 0::bigint as n_placeholders from conversations group by 1"
)
def text_layer_stats(t):
    return context.layer_stats(t("conversations"), "conv_id", "text")


@query("select r_regionkey, any_value(r_name) || '. ' || string_agg(n_name, '. ' order by n_name) as text from region join nation on r_regionkey = n_regionkey where r_name <> 'ASIA' group by 1")
def unit_texts(t):
    duties = t("nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return context.unit_texts(t("region"), duties, "r_regionkey", "r_name", "n_name", ("ASIA",))


@query("select c_custkey, coalesce(n_name, 'unknown') as nation from customer left join (select * from nation where n_nationkey % 4 > 0) on c_nationkey = n_nationkey")
def display_names(t):
    names = t("nation").where("n_nationkey % 4 > 0").withColumnRenamed("n_nationkey", "c_nationkey")
    return context.displayed(t("customer"), names, "c_nationkey", "n_name", "nation", F.lit("unknown")).select("c_custkey", "nation")


@query("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def unit_in_list(t):
    return t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


# --- proposals -----------------------------------------------------------------------


def _text_parts(t) -> DataFrame:
    return t("conversations").select("conv_id", F.concat(F.lit("p"), F.col("turn").cast("string")).alias("part_id"), "text", "turn")


def _fixtures(t) -> DataFrame:
    """A quote of 20 characters from the 31st on of each text; every fourth names a part that is not there."""
    p = _text_parts(t).where("length(text) > 60")
    part = F.when(F.col("turn") % 4 == 3, F.lit("none")).otherwise(F.col("part_id"))
    return p.select("conv_id", part.alias("part_id"), "turn", F.concat(F.lit("f"), (F.col("turn") % 3).cast("string")).alias("field"), F.substring("text", 31, 20).alias("anchor"), F.lit("literal").alias("mode"), F.substring("text", 33, 8).alias("value"), F.substring("text", 31, 20).alias("quote"))


@query("select conv_id, count(*) as n, count(*) filter (turn % 4 = 3) as n_missed from conversations where length(text) > 60 group by 1")
def fixture_parts(t):
    return context.fixture_parts(_fixtures(t), _text_parts(t), "conv_id")


PROPOSED = "with p as (select conv_id, turn, text, substr(text, 31, 20) as q, substr(text, 33, 8) as v from conversations where length(text) > 60)"


@query(PROPOSED + " select conv_id, turn, case when turn % 4 < 3 then instr(text, q) - 1 end as start, case when turn % 4 < 3 then v end as value from p")
def replayed_proposals(t):
    out = context.replayed_proposals(_fixtures(t).withColumn("field", F.col("turn").cast("string")), _text_parts(t), "conv_id")
    return out.select("conv_id", F.col("field").cast(t("conversations").schema["turn"].dataType).alias("turn"), F.col("start").cast("long").alias("start"), "value")


def _offered(t) -> DataFrame:
    """Exact quotes, and broken ones: by turn a wrong offset, a wrong quote, a value from elsewhere, an unknown field or part, a blank value."""
    p = _text_parts(t).where("length(text) > 60")
    k = F.col("turn") % 8
    return p.select(
        "conv_id", "turn", F.when(k == 1, F.lit("none")).otherwise(F.col("part_id")).alias("part_id"), F.when(k == 2, "other").otherwise("f").alias("field"),
        F.when(k == 3, F.length("text") - 5).otherwise(F.lit(30)).alias("start"), F.when(k == 4, F.concat(F.lit("#"), F.substring("text", 32, 19))).otherwise(F.substring("text", 31, 20)).alias("quote"),
        F.when(k == 5, "#nowhere#").when(k == 6, " \t").otherwise(F.upper(F.substring("text", 33, 8))).alias("value"),
    )


@query(
    """with p as (select conv_id, turn, turn % 8 as k, text, substr(text, 33, 8) as v from conversations where length(text) > 60),
 f as (select *, case when k = 6 or trim(regexp_replace(v, '\\s', '', 'g')) = '' then 'empty_value' when k = 2 then 'unknown_field' when k = 1 then 'unknown_part' when k = 3 then 'offset_out_of_range' when k = 4 then 'quote_mismatch' when k = 5 then 'value_not_in_quote' end as f from p),
 d as (select *, coalesce(max((f is null)::int) over (partition by conv_id, k = 2 order by turn rows between unbounded preceding and 1 preceding), 0) = 1 as taken from f)
 select conv_id, turn, case when taken then 'duplicate_field' else f end as failure, case when f is null and not taken then 0.95::double end as confidence from d"""
)
def verified_spans(t):
    parts = _text_parts(t).select("conv_id", "part_id", "text", F.lit("typed").alias("source_type"))
    out = evidence.verified_spans(_offered(t), parts, "conv_id", "turn", ("f",), {"typed": evidence.MatchPolicy()})
    return out.select("conv_id", "turn", "failure", "confidence")


@query(
    """with p as (select conv_id, turn, turn % 8 as k from conversations where length(text) > 60), v as (select conv_id, min(turn) filter (k in (0, 7)) as first, count(*) as n from p group by 1),
 f as (select conv_id, count(*) filter (k in (0, 7) and p.turn = v.first) as ok, count(*) - count(*) filter (k in (0, 7) and p.turn = v.first) as refused from p join v using (conv_id) group by 1)
 select conv_id, 1 + ok as n_records, case when ok > 0 then 0.95::double else 1.0::double end as min_confidence, greatest(0, 1 + refused - ok) as discarded from f"""
)
def extraction_summary(t):
    parts = _text_parts(t).select("conv_id", "part_id", "text", F.lit("typed").alias("source_type"))
    known = _offered(t).where("turn % 8 not in (2)")
    out = evidence.verified_spans(known.unionByName(_offered(t).where("turn % 8 = 2")), parts, "conv_id", "turn", ("f",), {"typed": evidence.MatchPolicy()})
    mapped = _offered(t).select("conv_id").distinct().select("conv_id", F.inline(F.array(F.struct(F.lit("f").alias("field"), F.lit(None).cast("string").alias("value")), F.struct(F.lit("g").alias("field"), F.lit("x").alias("value")))))
    return evidence.extraction_summary(out, mapped, "conv_id").select("conv_id", "n_records", "min_confidence", "discarded")


@query("select c_custkey, case when c_custkey % 4 = 0 then 1 when c_custkey % 4 = 1 then 2 end::bigint as n from customer")
def answer_validation(t):
    k = F.col("c_custkey")
    one = F.concat(F.lit('[{"field":"f","part_id":"p1","offset":'), k.cast("string"), F.lit(',"quote":"q","value":"v"}'))
    more = F.when(k % 4 == 0, "]").when(k % 4 == 1, ',{"field":"g","part_id":"p2","offset":3,"quote":"q","value":"v"}]').when(k % 4 == 2, ',{"field":"g","part_id":"p2","offset":"3x","quote":"q","value":"v"}]').otherwise(',{"field":"g","part_id":"p2","quote":"q","value":"v"}]')
    found = context.answers(F.concat(one, more))
    return t("customer").select("c_custkey", F.when(found.isNotNull(), F.size(found)).cast("long").alias("n"))


# --- placeholders, dates ---------------------------------------------------------------


@query(
    """select c_custkey, (1 + c_custkey % 2)::bigint as n_found, true as held, c_custkey % 3 = 0 as imitated, c_custkey % 2 = 0 and c_custkey % 3 > 0 as whole from customer"""
)
def placeholder_scan(t):
    k = F.col("c_custkey")
    token = redact.token(F.lit("NAME"), k, F.col("c_name"), "s")
    told = F.concat(F.when((k % 2 == 0) & (k % 3 > 0), "").otherwise("x "), token, F.when(k % 2 == 1, F.concat(F.lit(" and "), redact.token(F.lit("ORG"), k, F.col("c_name"), "s"))).otherwise(""), F.when(k % 3 == 0, " [[ PII |NAME|bad]]").otherwise(""))
    return t("customer").select("c_custkey", F.size(text.placeholders(told)).cast("long").alias("n_found"), told.rlike(text.PLACEHOLDER).alias("held"), redact.imitated(told).alias("imitated"), text.is_placeholder(told).alias("whole"))


@query("select count(*) as n, count(*) as n_tokens, 0::bigint as n_present from customer")
def minted_tokens(t):
    """Tokens of all customers are different, and none stands in a text already."""
    minted = redact.minted(t("customer"), "c_custkey", F.lit("NAME"), F.col("c_name"), "salt", F.col("c_name"))
    return minted.agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_tokens"), F.count_if("present").alias("n_present"))


@query(
    """select o_orderkey, datediff('day', date '1995-06-17', o_orderdate::date)::bigint as days, strftime(o_orderdate, '%d.%m.%Y') as day,
 case when o_orderkey % 3 = 0 then try_cast(strftime(o_orderdate, '19%y-%m-%d') as date)::varchar end as born, case when s < 3600 then s // 60 || ' min' when s < 172800 then s // 3600 || ' h' else s // 86400 || ' d' end as age,
 greatest(0, 86400 * (o_orderkey % 5 - 2))::bigint as waited from (select *, (epoch(timestamp '1998-08-03 00:00:00') - epoch(o_orderdate))::bigint as s from orders)"""
)
def date_functions(t):
    at, k = F.col("o_orderdate"), F.col("o_orderkey")
    block = F.concat(F.date_format(at, "ddMMyy"), F.when(k % 3 == 0, "").otherwise("x"))
    return t("orders").select(
        "o_orderkey", F.round(dates.signed_years(F.lit("1995-06-17").cast("date"), at.cast("date")) * 365.25).cast("long").alias("days"), dates.rendered_day(at).alias("day"), dates.birth_block(block).cast("string").alias("born"),
        dates.age_label(at, F.lit("1998-08-03").cast("timestamp")).alias("age"), dates.waited_seconds(at, at + F.make_dt_interval((k % 5 - 2).cast("int"))).alias("waited"),
    )


@query("select s_suppkey, unnest(string_split('ab-' || s_suppkey || ' is. line ' || s_suppkey, '. ')) as sentence from supplier")
def tidy_lines(t):
    raw = F.concat(F.lit("ab-"), F.col("s_suppkey").cast("string"), F.lit(" \t is. \n\n\n\nline "), F.col("s_suppkey").cast("string"), F.lit("  "))
    return t("supplier").select("s_suppkey", F.explode(F.split(F.replace(text.normal_text(text.tidy(raw)), F.lit("  "), F.lit(" ")), r"\. ")).alias("sentence"))
