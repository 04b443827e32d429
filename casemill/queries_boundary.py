"""Queries of ingest, sealing and streams; registered with the others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import checksums, text
from casemill.functions.text import ALPHABET, TOKEN_LENGTH
from casemill.operators import boundary, context, evaluate, evidence, letters, recall, run
from casemill.plans import decisions
from casemill.queries import LABELLED, QUERIES, SQL, _labelled, query
from casemill.queries_intake import PROPOSED, _offered, _text_parts
from casemill.session import shared_folder, spread, stored
from casemill.sources import config, stores, submissions


def _token_sql(kind: str, case: str, value: str, salt: str) -> str:
    digest = f"sha256('{salt}|' || {case} || '|{kind}|' || {value})"
    letters_ = " || ".join(f"substr('{ALPHABET}', ('0x' || substr({digest}, {1 + 5 * i}, 5))::int % {len(ALPHABET)} + 1, 1)" for i in range(TOKEN_LENGTH))
    return f"'[[PII|{kind}|' || {letters_} || ']]'"


IDENTITY = (context.IdentityField("a.name", "NAME"), context.IdentityField("a.more", "ORG", subtree=True), context.IdentityField("a.gone", "AKTZ"))


@query(
    f"""with c as (select c_custkey, c_name, '{{"nation":' || c_nationkey || '}}' as more, c_mktsegment from customer)
 select c_custkey, md5('{{"a":{{"more":"' || {_token_sql("ORG", "c_custkey", "more", "s")} || '","name":"' || {_token_sql("NAME", "c_custkey", "c_name", "s")} || '"}},"list":["' || c_mktsegment || '"]}}') as digest, 2::bigint as n_entries from c"""
)
def seal_payload(t):
    payload = F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("more"), F.lit(" ").alias("gone")).alias("a"), F.array("c_mktsegment").alias("list")))
    sealed = boundary.sealed_payload(t("customer").withColumn("payload", payload), "c_custkey", "payload", IDENTITY, "s")
    whole = F.replace(F.col("sealed_payload"), F.lit('"gone":" ",'), F.lit(""))
    return sealed.select("c_custkey", F.md5(whole).alias("digest"), F.size("payload_entries").cast("long").alias("n_entries"))


@query(
    "select c_custkey, case c_custkey % 5 when 0 then 'sealed' when 1 then 'clean' when 2 then 'rejected' when 3 then 'sealed' else 'clean' end as outcome, case c_custkey % 5 when 0 then 1 when 3 then 2 else 0 end::bigint as n_entries from customer"
)
def boundary_rejects(t):
    k = F.col("c_custkey")
    told = F.when(k % 5 == 0, F.concat(F.lit("write to a"), k.cast("string"), F.lit("@b.example please"))).when(k % 5 == 1, "nothing here").when(k % 5 == 2, "an [[PII|forged]] token").when(k % 5 == 3, "10.0.0.1 and x@y.example").otherwise(F.lit(None))
    out = boundary.passed(spread(t("customer").select("c_custkey")).withColumn("told", told), "c_custkey", "told", "s")
    return out.select("c_custkey", "outcome", F.size("entries").cast("long").alias("n_entries"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'abcd ef' else 'x y' end as normal, case when c_custkey % 2 = 0 then 0 else 2 end::bigint as raw_start, case when c_custkey % 2 = 0 then 7 else 3 end::bigint as raw_end from customer")
def normalize_offsets(t):
    even = F.col("c_custkey") % 2 == 0
    raw = F.when(even, F.lit("ab-\n cd \t ef ")).otherwise(F.lit("  x\n\ny"))
    m = text.normal_text_map(raw)
    d = t("customer").withColumn("m", m).withColumn("span", text.raw_span(F.col("m"), F.lit(0), F.when(even, 4).otherwise(1)))
    return d.select("c_custkey", F.col("m.text").alias("normal"), F.col("span.start").cast("long").alias("raw_start"), F.col("span.end").cast("long").alias("raw_end"))


@query("select conv_id, turn, md5(trim(regexp_replace(regexp_replace(text, '(\\p{L})-[\\s]*[\\r\\n]\\s*(\\p{L})', '\\1\\2', 'g'), '\\s+', ' ', 'g'))) as digest from conversations where trim(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) <> ''")
def text_layer(t):
    return boundary.text_layer(t("conversations"), "text").select("conv_id", "turn", F.md5("normalized.text").alias("digest"))


# --- ingest -----------------------------------------------------------------------


@query(
    "select o_orderkey, 'case-' || o_orderkey as case_id, case when o_orderkey % 3 = 0 then '2030-01-01' else strftime(o_orderdate, '%Y-%m-%d') end as created, sequence::bigint as sequence, type from orders, (select unnest([0, 1]) as sequence, unnest(['RECEIVED', 'SEALED']) as type)"
)
def ingest_journal(t):
    s = t("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("submissionId"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate").cast("timestamp")).alias("submittedAt"))
    out = submissions.received_events(s, F.lit("2030-01-01").cast("timestamp"), ("RECEIVED", "SEALED"))
    return out.select(F.col("submissionId").cast("long").alias("o_orderkey"), "case_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "sequence", "type")


@query(
    "select c_custkey, array_to_string(list_filter(['debt', case when c_custkey % 4 = 0 then 'segment' end, 'zip'], lambda x: x is not null and (x <> 'debt' or c_acctbal >= 0)), ',') as discarded, (3 - (c_acctbal >= 0)::int - (c_custkey % 4 = 0)::int)::bigint as n_mapped from customer"
)
def mapped_payload(t):
    k = F.col("c_custkey")
    payload = F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), F.when(k % 4 == 0, F.lit(" \t")).otherwise(F.col("c_mktsegment")).alias("seg")).alias("p"), F.when(F.col("c_acctbal") < 0, True).alias("debt")))
    out = context.mapped_payload(t("customer").withColumn("payload", payload), "payload", {"debt": "debt", "name": "p.name", "segment": "p.seg", "zip": "p.zip.code"})
    return out.select("c_custkey", F.array_join("discarded", ",").alias("discarded"), F.size("records").cast("long").alias("n_mapped"))


@query("select doc_id, quality, toxic from documents join labels using (doc_id)")
def labelled_corpus(t):
    items = t("documents").join(t("labels").select("doc_id"), "doc_id", "left_semi")
    return stores.labelled(items, t("labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("select event_id, coalesce(props::json->>'$.k', '-') as k, '-' as other from events")
def report_panel(t):
    return t("events").select("event_id", context.panel_value(F.col("props"), "k").alias("k"), context.panel_value(F.col("props"), "a.b").alias("other"))


@query("select distinct c_nationkey as n_nationkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey > 0)")
def dangling_references(t):
    return config.dangling(t("customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct(), t("nation").where("n_regionkey > 0"), "n_nationkey")


# --- completeness, messages, histograms ---------------------------------------------

NUMBERS = """with c as (select c_custkey as k, date '1950-03-04' + (c_custkey * 11 % 20000)::int as born, c_custkey % 6 as m from customer),
 d as (select *, case when m = 0 then '12' || strftime(born, '%d%m%y') || 'A001' when m = 1 then '12310299A001' when m = 2 then '12' || strftime(born + 1, '%d%m%y') || 'A001' when m = 3 then '12' || strftime(born, '%d%m%y') || 'A001' else ' ' end as number,
 case when m = 3 then born + 4000 else born + 9000 end as start, case when m = 0 then date '1900-01-01' end as stop from c)"""


@query(
    NUMBERS + " select k as c_custkey, case when m > 3 then 'MISSING' when m in (1, 2) then 'birth_in_number' end as number, case when stop is not null then 'not_after' when m = 3 then 'min_years_after' end as start, case when k % 3 = 1 then 'unresolved' when k % 3 = 2 and c < 0 then 'one_of' end as sealed from d join (select c_custkey, c_acctbal as c from customer) on k = c_custkey"
)
def completeness_across_fields(t):
    k = F.col("c_custkey")
    born = F.date_add(F.lit("1950-03-04").cast("date"), (k * 11 % 20000).cast("int"))
    m = k % 6
    block = lambda d: F.concat(F.lit("12"), F.date_format(d, "ddMMyy"), F.lit("A001"))
    token = F.lit("[[PII|NAME|BCDFGHJKMNPQ]]")
    c = t("customer").withColumns({
        "born": born, "number": F.when((m == 0) | (m == 3), block(born)).when(m == 1, "12310299A001").when(m == 2, block(F.date_add(born, 1))).otherwise(" "), "start": F.date_add(born, F.when(m == 3, 4000).otherwise(9000)).cast("string"),
        "stop": F.when(m == 0, F.lit("1900-01-01")), "sealed": F.when(k % 3 > 0, token).otherwise("yes"), "held": F.when(k % 3 == 2, F.when(F.col("c_acctbal") < 0, "no").otherwise("yes")),
    })
    r = (
        evidence.Requirement("number", "number", birth_in_number="born"), evidence.Requirement("start", "start", is_date=True, not_after="stop", min_years_after=("born", 18)),
        evidence.Requirement("sealed", "sealed", one_of=("yes",), sealed="held"),
    )
    of = lambda n: F.get(F.filter("gaps", lambda g: g["requirement_id"] == n), F.lit(0))
    out = evidence.completeness(c, r)
    return out.select("c_custkey", *[F.coalesce(of(n)["failed"], F.when(of(n)["status"] == "MISSING", "MISSING")).alias(n) for n in ("number", "start", "sealed")])


@query("select c_custkey, case when c_acctbal < 0 then 'name failed min_length' when c_custkey % 2 = 0 then 'segment ' || c_mktsegment || ' failed one_of' end as message from customer")
def gap_messages(t):
    gaps = F.when(F.col("c_acctbal") < 0, F.struct(F.lit("name").alias("requirement_id"), F.lit("min_length").alias("failed"))).when(F.col("c_custkey") % 2 == 0, F.struct(F.lit("segment").alias("requirement_id"), F.lit("one_of").alias("failed")))
    return t("customer").select("c_custkey", letters.gap_message(gaps, {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}, hidden=("name",)).alias("message"))


@query("select c_custkey, c_mktsegment in ('BUILDING') as softened from customer")
def softened_gaps(t):
    gaps = F.array(F.struct(F.col("c_mktsegment").alias("requirement_id"), F.lit("MISSING").alias("status")))
    return t("customer").select("c_custkey", F.get(letters.softened(gaps, ("BUILDING",)), F.lit(0))["softened"].alias("softened"))


@query(
    PROPOSED + """, k as (select conv_id, turn, turn % 8 as k from p), f as (select *, case k when 6 then 'empty_value' when 2 then 'unknown_field' when 1 then 'unknown_part' when 3 then 'offset_out_of_range' when 4 then 'quote_mismatch' when 5 then 'value_not_in_quote' end as f from k),
 d as (select *, coalesce(max((f is null)::int) over (partition by conv_id, k = 2 order by turn rows between unbounded preceding and 1 preceding), 0) = 1 as taken from f)
 select case when taken then 'duplicate_field' else f end as failure, count(*) as n from d where taken or f is not null group by 1"""
)
def failure_histogram(t):
    parts = _text_parts(t).select("conv_id", "part_id", "text", F.lit("typed").alias("source_type"))
    out = evidence.verified_spans(_offered(t), parts, "conv_id", "turn", ("f",), {"typed": evidence.MatchPolicy()})
    return out.where("failure is not null").groupBy("failure").agg(F.count("*").alias("n"))


@query(
    LABELLED + ", b as (select ntile, max(n_chars) as u, avg(quality) as m from (select *, case when n_chars <= 300 then 0 when n_chars <= 900 then 1 else 2 end as ntile from x) group by 1) select doc_id, case when n_chars <= 300 then 10 when n_chars <= 900 then 60 else 90 end::bigint as calibrated from x"
)
def calibrated_scores(t):
    steps = [(300.0, 0.1), (900.0, 0.6), (1e9, 0.9)]
    return _labelled(t).select("doc_id", F.round(100 * evaluate.apply_calibration(F.col("n_chars"), steps)).cast("long").alias("calibrated"))


# --- streams -------------------------------------------------------------------------


@query(
    """with e as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over w) < 86400000000 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
 g as (select *, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as g from e)
 select user_id, epoch_us(min(ts)) as first_at, epoch_us(max(ts) + interval 1 day) as expires_at, count(*) as n from g group by user_id, g"""
)
def live_sessions(t):
    from casemill.streaming import folds

    found = folds.live_sessions(t("events"), "user_id", "ts", "1 day")
    return found.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_at", "expires_at")})


def _stream_owed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications owed for signups, stream by micro-batch into an outbox; the same files twice give each once."""
    from casemill.streaming import folds

    path = f"{sf_dir}/events.parquet"
    at = f"{shared_folder(spark)}/owed-{uuid.uuid4().hex}"
    for run in range(2):
        events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        owed = events.where("event_type = 'signup'").select(F.col("event_id").alias("source_event_id"), "user_id")
        folds.stream_append(owed, lambda batch: stores.append_missing(batch, f"{at}/outbox", "source_event_id"), f"{at}/checkpoint-{run}")
    return spark.read.parquet(f"{at}/outbox").select("source_event_id", "user_id")


QUERIES["stream_owed"] = _stream_owed
SQL["stream_owed"] = "select event_id as source_event_id, user_id from events where event_type = 'signup'"


@query("""with c as (select c_custkey as k from customer)
 select kind, n_labels, n_found, n_hits, n_right, n_found / n_labels as recall, n_right / n_hits as precision, kind <> 'NAME' as gated, true as passed from (
 select 'EMAIL' as kind, count(*) as n_labels, count(*) as n_found, count(*) as n_hits, count(*) as n_right from c union all select 'PHONE', count(*), count(*), count(*), count(*) from c
 union all select 'IBAN', count(*), count(*), count(*), count(*) from c where k % 5 > 0 union all select 'NAME', count(*), count(*) filter (k % 3 > 0), count(*) filter (k % 3 > 0), count(*) filter (k % 3 > 0) from c)""")
def recognizer_recall(t):
    """The recognizers on a letter for each customer whose spans are known by construction; every fifth IBAN has wrong check digits
    and no label, every third name has no salutation and so no hit."""
    k = F.col("c_custkey")
    account = F.lpad((k * 7919 % 1000000007).cast("string"), 18, "0")
    digits = checksums.iban_check_digits(F.lit("DE"), account)
    wrong = F.lpad(((digits.cast("int") + 1) % 97).cast("string"), 2, "0")
    parts = (
        (F.when(k % 3 > 0, "größe 😀 an Frau ").otherwise("größe 😀 an "), None, None), (F.concat(F.lit("Ada "), F.translate(k.cast("string"), "0123456789", "ABCDEFGHIJ")), "NAME", F.lit(True)),
        (F.lit(", IBAN "), None, None), (F.concat(F.lit("DE"), F.when(k % 5 > 0, digits).otherwise(wrong), account), "IBAN", k % 5 > 0),
        (F.lit(", mail "), None, None), (F.concat(F.lit("c."), k.cast("string"), F.lit("@mail.example")), "EMAIL", F.lit(True)),
        (F.lit(" oder +49 441 "), None, None), (F.lpad(k.cast("string"), 6, "7"), "PHONE", F.lit(True)), (F.lit(" anrufen"), None, None),
    )
    before, labels = F.lit(0), []
    for text, kind, labelled in parts:
        end = before + F.length(text)
        if kind:
            start = before - 8 if kind == "PHONE" else before
            labels.append(F.when(labelled, F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))))
        before = end
    items = spread(t("customer").select("c_custkey")).select(k.cast("string").alias("item_id"), F.concat(*[p[0] for p in parts]).alias("text"), F.filter(F.array(*labels), lambda x: x.isNotNull()).alias("labels"))
    return recall.measured(recall.checked(items), gated=("EMAIL", "IBAN", "PHONE"))


def _pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of personal data, as rows of a table function."""
    return boundary.span_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


QUERIES["pii_spans"] = _pii_spans


# --- from submission to decision -----------------------------------------------------------

RUN_PLAN = run.Plan(
    fields={"status": ("order.status", "string"), "total": ("order.total", "double"), "priority": ("order.priority", "string"), "segment": ("applicant.segment", "string")},
    signals={"fast": {"field": "priority", "op": "in", "value": ["1-URGENT", "2-HIGH"]}, "bulk": {"field": "total", "op": "gt", "value": 250000}},
    routes=(
        evidence.Route("r1", "north", 10, {"field": "segment", "op": "eq", "value": "BUILDING"}), evidence.Route("r2", "south", 10, {"field": "priority", "op": "eq", "value": "1-URGENT"}),
        evidence.Route("r3", "east", 20, {"field": "text_normalized", "op": "contains", "value": "machinery"}), evidence.Route("r4", "west", 30, {"field": "total", "op": "gt", "value": 200000}),
    ),
    requirements={"fast": (evidence.Requirement("has_total", "total"), evidence.Requirement("is_open", "status", one_of=("O", "F"))), "bulk": (evidence.Requirement("is_open", "status", one_of=("O", "F")),)},
    table=(
        decisions.Row("clear", {"all": [{"field": "verdict", "op": "eq", "value": "COMPLETE"}, {"field": "routing_confidence", "op": "ge", "value": 0.9}, {"field": "clear_cut", "op": "eq", "value": True}, {"field": "tier1_enabled", "op": "eq", "value": True}]}, 1),
        decisions.Row("contested", {"all": [{"field": "rule_hit", "op": "eq", "value": True}, {"field": "routing_confidence", "op": "lt", "value": 0.9}]}, 3),
        decisions.Row("routed", {"field": "rule_hit", "op": "eq", "value": True}, 2),
    ),
    downgrades=(decisions.Downgrade("flagged", "flagged", "eq", True),),
    identity=(context.IdentityField("applicant.name", "NAME"),), clear_cut={"field": "total", "op": "lt", "value": 150000}, tier1_procedures=("fast",),
    scorer=lambda df: F.col("total") / 500000, flag_from=0.28, salt="s",
)


def _submissions(t) -> DataFrame:  # noqa: ANN001
    """A submission for each order: some payloads are broken, some texts imitate placeholders, some totals are missing."""
    k = F.col("o_orderkey")
    order = F.struct(F.col("o_orderstatus").alias("status"), F.when(k % 13 > 0, F.col("o_totalprice")).alias("total"), F.col("o_orderpriority").alias("priority"))
    data = F.to_json(F.struct(order.alias("order"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("applicant")))
    told = F.concat(F.lit("For the  segment "), F.lower("c_mktsegment"), F.lit(", write to c"), F.col("c_custkey").cast("string"), F.lit("@mail.example"))
    return spread(t("orders"), "o_custkey").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        k.cast("string").alias("submissionId"), F.element_at(F.array(F.lit("fit_connect"), F.lit("email"), F.lit("scan")), (k % 3).cast("int") + 1).alias("channel"), F.col("o_orderdate").alias("submittedAt"),
        F.when(F.col("o_orderpriority").isin("2-HIGH", "4-NOT SPECIFIED"), "fast").when(F.col("o_orderpriority") == "3-MEDIUM", "other").alias("procedureHint"),
        F.when(k % 101 == 0, "{").when(k % 103 == 0, "[1]").otherwise(data).alias("data"), F.when(k % 97 == 0, "[[PII|forged]] text").when(k % 2 == 0, told).alias("bodyText"), F.lit(None).cast("string").alias("bodySourceType"),
        F.lit(None).cast(f"array<{submissions.ATTACHMENT}>").alias("attachments"),
    )


RUN_SQL = """with a as (select o_orderkey as k, o_orderstatus as status, case when o_orderkey % 13 > 0 then o_totalprice end as total, o_orderpriority as priority, c_mktsegment as segment, c_custkey, case when o_orderpriority in ('2-HIGH', '4-NOT SPECIFIED') then 'fast' when o_orderpriority = '3-MEDIUM' then 'other' end as hint,
  case when o_orderkey % 101 = 0 or o_orderkey % 103 = 0 then 'payload' when o_orderkey % 97 = 0 then 'boundary' end as error, o_orderkey % 97 > 0 and o_orderkey % 2 = 0 as told, ['fit_connect', 'email', 'scan'][o_orderkey % 3 + 1] as channel from orders join customer on o_custkey = c_custkey),
 b as (select *, priority in ('1-URGENT', '2-HIGH') as fast, coalesce(total > 250000, false) as bulk from a),
 c as (select *, case when fast and bulk then 'ambiguous' when hint = 'fast' and not bulk then 'hint' when hint = 'fast' then 'contradicted' when fast or bulk then 'content' else 'none' end as derivation from b),
 d as (select *, case derivation when 'hint' then 'fast' when 'content' then case when fast then 'fast' else 'bulk' end end as derived,
  list_filter([case when segment = 'BUILDING' then 'north' end, case when priority = '1-URGENT' then 'south' end, case when told and segment = 'MACHINERY' then 'east' end, case when total > 200000 then 'west' end], lambda x: x is not null) as units from c),
 e as (select *, case when len(units) = 0 then 0.0 when segment = 'BUILDING' and priority = '1-URGENT' then 0.6 else 1.0 end as conf,
  list_filter([case when derived = 'fast' and total is null then 'has_total' end, case when derived is not null and status not in ('O', 'F') then 'is_open' end], lambda x: x is not null) as gaps from d),
 f as (select *, case when derived is null then 'NOT_EVALUABLE' when len(gaps) = 0 then 'COMPLETE' else 'INCOMPLETE' end as verdict, total / 500000 >= 0.28 as flagged from e),
 g as (select *, case when verdict = 'COMPLETE' and conf >= 0.9 and coalesce(total < 150000, false) and derived = 'fast' then 'clear' when len(units) > 0 and conf < 0.9 then 'contested' when len(units) > 0 then 'routed' else 'default' end as row_id from f),
 h as (select *, case when error is not null then 3 else case row_id when 'clear' then 1 when 'routed' then 2 else 3 end end as pre from g)"""


@query(RUN_SQL + """ select 'case-' || k as case_id, error, case when error is null then derived end as derived, case when error is null then units[1] end as routed_unit, case when error is null then verdict end as verdict,
 case when error is null then array_to_string(gaps, ',') end as gaps, pre::int as pre_tier, (case when error is null and coalesce(flagged, false) then 3 else pre end)::int as tier, false as leaked from h""")
def run_cases(t):
    """Submissions to decisions, in one plan; no raw name or address is in the results."""
    found = _submissions(t)
    cases = run.run_cases(found, RUN_PLAN)
    ok = lambda c: F.when(F.col("error").isNull(), c)
    leaked = run.holds_raw(cases, F.array(F.lit("Customer#"), F.lit("@mail.example")))
    return cases.select("case_id", "error", ok(F.col("derived")).alias("derived"), ok(F.col("routed_unit")).alias("routed_unit"), ok(F.col("verdict")).alias("verdict"), ok(F.array_join(F.transform("gaps", lambda g: g["requirement_id"]), ",")).alias("gaps"), "pre_tier", "tier", leaked.alias("leaked"))


@query(RUN_SQL + """, t as (select k, unnest(case when error = 'payload' then ['RECEIVED', 'STAGE_FAILED', 'DECIDED'] when error = 'boundary' then ['RECEIVED', 'STAGE_FAILED', 'DECIDED']
 else ['RECEIVED', 'SEALED', 'TEXT_LAYER', 'EXTRACTED', 'EVIDENCE', case when total is null then 'SCORE_DEGRADED' else 'SCORED' end, 'DECIDED'] end) as type, generate_subscripts(case when error is not null then [1, 2, 3] else [1, 2, 3, 4, 5, 6, 7] end, 1) - 1 as sequence from h)
 select 'case-' || k as case_id, sequence::bigint as sequence, type, substr(sha256('case-' || k || '|' || sequence), 1, 32) as event_id from t""")
def run_journal(t):
    """The journal of a run that was made twice, as it is stored."""
    spark = t("nation").sparkSession
    path = f"{shared_folder(spark)}/casemill/journal-{uuid.uuid4().hex}"
    cases = stored(run.run_cases(_submissions(t), RUN_PLAN).select("case_id", "created_at", "events"), "cases")
    if not run.append_journal(cases, path) or run.append_journal(cases, path):
        raise ValueError("a repeated run must append nothing")
    return spark.read.parquet(path).select("case_id", "sequence", "type", "event_id")


# --- state that ends ------------------------------------------------------------------------


def _in_time(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The events as a stream of files in the order of time; returns the stream, whose times are timestamps."""
    from casemill.streaming import folds, live

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    live.replay_files(events, "at", f"{path}/in")
    return folds.event_stream(spark, f"{path}/in", events.schema).withColumn("ts", F.timestamp_micros(F.col("at").cast("long")))


def _live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user holds two events at most, for a day; what goes is told with its reason."""
    from casemill.streaming import live

    path = f"{shared_folder(spark)}/casemill/live-{uuid.uuid4().hex}"
    events = _in_time(spark, sf_dir, path)
    users = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.approx_count_distinct("user_id")).first()[0]
    return live.kept_stream(live.gone_entries(events, "user_id", "event_id", "ts", ttl_seconds=86_400, capacity=2, shelves=users // 64 + 16), path)


def _parties_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases of one user, six hours apart at most, met by two streams."""
    from casemill.streaming import live

    path = f"{shared_folder(spark)}/casemill/met-{uuid.uuid4().hex}"
    events = _in_time(spark, sf_dir, path)
    found = live.met(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), "user_id", "ts", ttl="6 hours")
    return live.kept_stream(found.select(F.col("token").alias("user_id"), F.unix_micros("left_at").alias("click_at"), F.unix_micros("right_at").alias("purchase_at")), path)


QUERIES["live_entries"], QUERIES["parties_met"] = _live_entries, _parties_met
SQL["live_entries"] = """with e as (select user_id::varchar as store, event_id::varchar as entry, epoch_us(ts) as put_at, epoch_us(lead(ts, 2) over (partition by user_id order by ts, event_id::varchar)) as pushed, epoch_us(max(ts) over ()) as last from events)
 select store, entry, put_at, case when pushed < put_at + 86400000000 then pushed else put_at + 86400000000 end as gone_at, case when pushed < put_at + 86400000000 then 'evicted' else 'expired' end as reason
 from e where pushed < put_at + 86400000000 or put_at + 86400000000 <= last // 1000 * 1000"""
SQL["parties_met"] = """select a.user_id, epoch_us(a.ts) as click_at, epoch_us(b.ts) as purchase_at from events a join events b on a.user_id = b.user_id
 where a.event_type = 'click' and b.event_type = 'purchase' and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000"""
