"""Queries on the driver's tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import checksums, dates, paths, text
from casemill.operators import actions, evaluate, evidence, journal, letters, redact, review, scoring, spans
from casemill.plans import decisions
from casemill.plans.rules import filter_rule
from casemill.session import shared_folder, stored
from casemill.sources import handover

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW = "2030-01-01 00:00:00"
HOLIDAYS = ("1995-05-01", "1996-12-25", "1997-01-01", "1998-10-03")


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable) -> Callable:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            SQL[name] = sql
        return f

    return register


def orders_customers(t) -> DataFrame:  # noqa: ANN001
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))


# --- predicates and decisions -------------------------------------------------

NESTED = {
    "all": [
        {"any": [{"field": "o_orderpriority", "op": "in", "value": ["1-URGENT", "2-HIGH"]}, {"field": "o_totalprice", "op": "gt", "value": 200000}]},
        {"field": "c_mktsegment", "op": "ne", "value": "BUILDING"},
        {"field": "o_orderstatus", "op": "ne", "value": None},
        {"field": "o_orderkey", "op": "ne", "value": "text"},
    ]
}


@query(
    "select o_orderkey, c_custkey from orders join customer on o_custkey = c_custkey where (o_orderpriority in ('1-URGENT', '2-HIGH') or o_totalprice > 200000)"
    " and c_mktsegment <> 'BUILDING' and o_orderstatus is not null"
)
def predicate_filter(t):
    return filter_rule(orders_customers(t), NESTED).select("o_orderkey", "c_custkey")


@query("select doc_id, contains(lower(text), 'the and') as has_words, regexp_matches(text, '(?i)[0-9]{4}') as has_number from documents")
def text_predicate(t):
    from casemill.plans.rules import compile_rule

    d = t("documents")
    of = lambda op, v: compile_rule({"field": "text", "op": op, "value": v}, d.schema)
    return d.select("doc_id", of("contains", "THE AND").alias("has_words"), of("matches", "[0-9]{4}").alias("has_number"))


TABLE = (
    decisions.Row("clear", {"all": [{"field": "o_orderpriority", "op": "eq", "value": "5-LOW"}, {"field": "o_totalprice", "op": "lt", "value": 100000}]}, 1),
    decisions.Row("machine", {"all": [{"field": "c_mktsegment", "op": "in", "value": ["MACHINERY", "AUTOMOBILE"]}, {"field": "o_totalprice", "op": "le", "value": 250000}]}, 2),
    decisions.Row("urgent", {"field": "o_orderpriority", "op": "eq", "value": "1-URGENT"}, 3),
    decisions.Row("rich", {"field": "c_acctbal", "op": "ge", "value": 5000}, 2),
)
CASES = """case when o_orderpriority = '5-LOW' and o_totalprice < 100000 then {0} when c_mktsegment in ('MACHINERY', 'AUTOMOBILE') and o_totalprice <= 250000 then {1}
 when o_orderpriority = '1-URGENT' then {2} when c_acctbal >= 5000 then {3} else {4} end"""


@query(f"select o_orderkey, {CASES.format(1, 2, 3, 2, 3)}::int as tier, {CASES.format(*map(repr, ('clear', 'machine', 'urgent', 'rich', 'default')))} as row_id from orders join customer on o_custkey = c_custkey")
def decision_first_match(t):
    return decisions.decide(orders_customers(t), TABLE).select("o_orderkey", "tier", "row_id")


@query(f"select {CASES.format(1, 2, 3, 2, 3)}::int as tier, count(*) as n from orders join customer on o_custkey = c_custkey group by 1")
def decision_count(t):
    return decisions.decide(orders_customers(t), TABLE).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"select o_orderkey, {CASES.format(0, 1, 2, 3, 4)}::bigint as n_failed from orders join customer on o_custkey = c_custkey")
def decision_reasons(t):
    return decisions.decide(orders_customers(t), TABLE, failed="n_failed").select("o_orderkey", "n_failed")


VALVE = (decisions.Downgrade("high-score", "score", "ge", 300000.0), decisions.Downgrade("flagged", "flagged", "eq", True))


@query(
    f"with d as (select o_orderkey, {CASES.format(1, 2, 3, 2, 3)}::int as tier, o_totalprice >= 300000 as a, o_orderstatus = 'P' as b from orders join customer on o_custkey = c_custkey)"
    " select o_orderkey, tier, tier as logged_tier, case when a or b then 3 else tier end as final_tier, (a::int + b::int)::bigint as n_fired from d"
)
def downgrade_valve(t):
    d = decisions.decide(orders_customers(t), TABLE).withColumns({"score": F.col("o_totalprice"), "flagged": F.col("o_orderstatus") == "P"})
    logged = decisions.downgrade(d, VALVE, "tier", enforcing=False).withColumnRenamed("final_tier", "logged_tier").drop("fired")
    return decisions.downgrade(logged, VALVE, "tier", enforcing=True).select("o_orderkey", "tier", "logged_tier", "final_tier", F.size("fired").cast("long").alias("n_fired"))


DRAW = "('0x' || substr(md5('s1' || o_orderkey::varchar), 1, 13))::ubigint / pow(2, 52)"


@query(f"with d as (select o_orderkey, case when o_orderpriority = '5-LOW' then 1 when o_orderpriority = '1-URGENT' then 3 else 2 end as t from orders) select o_orderkey, {DRAW} < 0.05 and t < 3 as sampled, (case when {DRAW} < 0.05 then 3 else t end)::int as tier from d")
def audit_sample(t):
    d = t("orders").withColumn("tier", F.when(F.col("o_orderpriority") == "5-LOW", 1).when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(2))
    return decisions.audit_sample(d, "o_orderkey", 0.05, "s1", "tier").select("o_orderkey", "sampled", "tier")


# --- routing, derivation, completeness ----------------------------------------

ROUTES = (
    evidence.Route("r1", "north", 10, {"field": "o_totalprice", "op": "gt", "value": 250000}),
    evidence.Route("r2", "south", 10, {"field": "o_orderpriority", "op": "eq", "value": "1-URGENT"}),
    evidence.Route("r3", "north", 20, {"field": "o_orderstatus", "op": "eq", "value": "F"}),
    evidence.Route("r4", "east", 20, {"field": "o_orderpriority", "op": "in", "value": ["2-HIGH", "3-MEDIUM"]}),
    evidence.Route("r5", "west", 30, {"field": "o_totalprice", "op": "lt", "value": 20000}),
    evidence.Route("r6", "south", 40, {"field": "o_orderstatus", "op": "eq", "value": "P"}),
)
ROUTED = """with hits as (select o_orderkey, p, r, u from orders, lateral (select * from (values (10, 'r1', 'north', o_totalprice > 250000), (10, 'r2', 'south', o_orderpriority = '1-URGENT'),
 (20, 'r3', 'north', o_orderstatus = 'F'), (20, 'r4', 'east', o_orderpriority in ('2-HIGH', '3-MEDIUM')), (30, 'r5', 'west', o_totalprice < 20000), (40, 'r6', 'south', o_orderstatus = 'P')) v(p, r, u, hit) where hit)),
 units as (select o_orderkey, u, min(p) as p, arg_min(r, {'p': p, 'r': r}) as r from hits group by all),
 ranked as (select *, row_number() over (partition by o_orderkey order by p, r) as k from units),
 best as (select o_orderkey, max(case when k = 1 then u end) as winner, max(case when k = 1 then p end) as p1, max(case when k = 2 then p end) as p2, count(*) as n from ranked group by 1)"""


@query(ROUTED + " select o.o_orderkey, winner, coalesce(p1 = p2, false) as unresolved, case when n is null then 0.0::double when p1 = p2 then 0.6::double else 1.0::double end as confidence from orders o left join best b on o.o_orderkey = b.o_orderkey")
def routing_arbitration(t):
    return evidence.route(t("orders"), ROUTES).select("o_orderkey", "winner", "unresolved", "confidence")


@query(ROUTED + " select o_orderkey, n::bigint as n_units from best where n >= 2")
def routing_conflicts(t):
    return evidence.route(t("orders"), ROUTES).where("conflict").select("o_orderkey", F.size("units").cast("long").alias("n_units"))


SIGNALS = {
    "1-URGENT": {"field": "n_lines", "op": "ge", "value": 6},
    "2-HIGH": {"field": "quantity", "op": "gt", "value": 180},
    "5-LOW": {"field": "n_lines", "op": "le", "value": 1},
}


@query(
    """with o as (select o_orderkey, any_value(o_orderpriority) as hint, count(*) as n, sum(l_quantity) as q from orders join lineitem on o_orderkey = l_orderkey group by 1),
 c as (select *, (n >= 6)::int + (q > 180)::int + (n <= 1)::int as k, case when n >= 6 then '1-URGENT' when q > 180 then '2-HIGH' when n <= 1 then '5-LOW' end as one, hint in ('1-URGENT', '2-HIGH', '5-LOW') as known from o),
 d as (select *, case when k >= 2 then 'ambiguous' when known and (k = 0 or one = hint) then 'hint' when known then 'contradicted' when k = 1 then 'content' else 'none' end as derivation from c)
 select o_orderkey, derivation, case derivation when 'hint' then hint when 'content' then one end as derived from d"""
)
def derive_class(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    o = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return evidence.derive(o, F.col("o_orderpriority"), SIGNALS).select("o_orderkey", "derivation", "derived")


REQUIRED = (
    evidence.Requirement("name", "c_name", pattern="Customer#0", min_length=10, max_length=40),
    evidence.Requirement("segment", "c_mktsegment", one_of=("BUILDING", "MACHINERY", "FURNITURE")),
    evidence.Requirement("balance", "balance", pattern=r"[0-9]"),
    evidence.Requirement("proof", document=True),
)
GAPS = """with g as (select c_custkey, case when coalesce(trim(c_name), '') = '' then 'MISSING' when not regexp_matches(trim(c_name), '^(?:Customer#0)') then 'pattern' when length(trim(c_name)) < 10 then 'min_length' when length(trim(c_name)) > 40 then 'max_length' end as name,
 case when coalesce(trim(c_mktsegment), '') = '' then 'MISSING' when c_mktsegment not in ('BUILDING', 'MACHINERY', 'FURNITURE') then 'one_of' end as segment,
 case when c_acctbal is null then 'MISSING' when c_acctbal < 0 then 'pattern' end as balance, 'MISSING' as proof from customer),
 u as (select c_custkey, unnest(['name', 'segment', 'balance', 'proof']) as requirement_id, unnest([name, segment, balance, proof]) as failed from g)"""


def _customers(t):
    return t("customer").withColumn("balance", F.when(F.col("c_acctbal") < 0, "minus").otherwise(F.when(F.col("c_acctbal").isNotNull(), "1")))


@query(GAPS + " select c_custkey, requirement_id, case when failed = 'MISSING' then 'MISSING' else 'INVALID' end as status, case when failed <> 'MISSING' then failed end as failed from u where failed is not null")
def completeness_gaps(t):
    return evidence.completeness(_customers(t), REQUIRED).select("c_custkey", F.explode("gaps").alias("g")).select("c_custkey", "g.*")


@query(GAPS + " select c_custkey, case when count(failed) filter (requirement_id <> 'proof') = 0 then 'COMPLETE' else 'INCOMPLETE' end as verdict from u group by 1")
def completeness_verdict(t):
    return evidence.completeness(_customers(t), REQUIRED[:3]).select("c_custkey", "verdict")


@query(
    """with d as (select l_orderkey, l_linenumber, l_shipdate::date as s, o_orderdate::date as o from lineitem join orders on l_orderkey = o_orderkey),
 e as (select *, year(s) - year(o) - case when month(s) * 100 + day(s) < month(o) * 100 + day(o) then 1 else 0 end as y from d)
 select l_orderkey, l_linenumber, case when s < o then 'not_before' when y > 0 then 'max_years_after' end as failed from e"""
)
def cross_field_dates(t):
    d = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")
    r = (evidence.Requirement("ship", "l_shipdate", is_date=True, not_before="o_orderdate", max_years_after=("o_orderdate", 0)),)
    return evidence.completeness(d, r).select("l_orderkey", "l_linenumber", F.get("gaps", F.lit(0))["failed"].alias("failed"))


WORKDAY = "list_filter([{0} + i::int for i in range(8)], lambda x: isodow(x) < 6 and x::date::varchar not in ('1995-05-01', '1996-12-25', '1997-01-01', '1998-10-03'))[1]::date"


@query(f"with a as (select o_orderkey, {WORKDAY.format('(o_orderdate::date + 4)')} as delivered from orders) select o_orderkey, delivered::varchar as delivered, {WORKDAY.format('(delivered + 21)')}::varchar as deadline from a")
def deadline_calc(t):
    sent = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", dates.delivery_date(sent, HOLIDAYS).cast("string").alias("delivered"), dates.response_deadline(sent, 21, HOLIDAYS).cast("string").alias("deadline"))


@query("select o_orderkey, (o_orderdate + interval 14 day)::date::varchar as due, floor(epoch(o_orderdate + interval 14 day - timestamp '1998-01-01') / 86400)::bigint as remaining from orders")
def due_days(t):
    due = F.col("o_orderdate") + F.expr("interval 14 days")
    return t("orders").select("o_orderkey", due.cast("date").cast("string").alias("due"), F.floor(dates.remaining_days(due, F.lit("1998-01-01").cast("timestamp"))).alias("remaining"))


# --- paths and projections ----------------------------------------------------


@query("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.a.b') as missing from events")
def json_path(t):
    return t("events").select("event_id", paths.json_path(F.col("props"), "k").alias("k"), paths.json_path(F.col("props"), "a.b").alias("missing"))


@query("select event_id, unnest(json_keys(props)) as path, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events")
def json_flatten(t):
    return t("events").select("event_id", F.explode(paths.flatten(F.col("props"))).alias("path", "value"))


@query(
    "select c_custkey, unnest(['name', 'segment', 'nation', 'debt']) as field, unnest([nullif(trim(c_name), ''), nullif(trim(c_mktsegment), ''), c_nationkey::varchar, case when c_acctbal < 0 then 'yes' end]) as value from customer"
)
def field_map_stack(t):
    fields = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"), "debt": F.when(F.col("c_acctbal") < 0, " yes ")}
    return paths.map_fields(t("customer"), "c_custkey", fields)


@query("select o_orderkey, 'Case ' || o_orderkey || ' (' || o_orderpriority || ') is due, {unknown}' as message from orders")
def render_message(t):
    return t("orders").select("o_orderkey", text.rendered("Case {id} ({priority}) is due, {unknown}", {"id": F.col("o_orderkey"), "priority": F.col("o_orderpriority")}).alias("message"))


@query("select conv_id, count(*) as n_parts, md5(string_agg(text, ' ' order by turn)) as digest from conversations where trim(coalesce(text, '')) <> '' group by 1")
def merged_text(t):
    parts = t("conversations").where("trim(coalesce(text, '')) <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return parts.select("conv_id", F.size("p").cast("long").alias("n_parts"), F.md5(F.concat_ws(" ", F.transform("p", lambda x: x["text"]))).alias("digest"))


# --- journal ------------------------------------------------------------------


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as sequence from events")
def journal_sequence(t):
    return journal.sequenced(t("events"), "user_id", "ts", "event_id").select("event_id", "user_id", "sequence")


@query(
    "with j as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as s from events), k as (select * from j where event_id % 97 > 0 union all select * from j where event_id % 89 = 0)"
    " select user_id, count(*) as n from k group by 1 having min(s) <> 0 or max(s) <> count(*) - 1 or count(distinct s) <> count(*) or count(distinct event_id) <> count(*)"
)
def journal_violations(t):
    j = journal.sequenced(t("events"), "user_id", "ts", "event_id").withColumn("case_id", F.col("user_id"))
    broken = j.where("event_id % 97 > 0").unionByName(j.where("event_id % 89 = 0"))  # lost events, and some that came twice
    return journal.violations(broken).select(F.col("case_id").alias("user_id"), "n")


KINDS = ("signup", "purchase", "error", "view", "click")


@query("select user_id, " + ", ".join(f"arg_max(value, (epoch_us(ts)::hugeint * 1000000000 + event_id)) filter (event_type = '{k}') as last_{k}" for k in KINDS) + " from events group by 1")
def case_state(t):
    latest = {f"last_{k}": (F.col("event_type") == k, F.col("value")) for k in KINDS}
    return journal.folded(t("events"), "user_id", latest, ("ts", "event_id"))


@query(
    """with e as (select *, epoch_us(ts)::hugeint * 1000000000 + event_id as k, case when event_type = 'error' then ['unit', 'tier', 'escalation', 'colour'][event_id % 4 + 1] end as field from events),
 o as (select user_id, arg_max({'u': case when event_id % 7 > 0 then event_id % 7 end}, k) filter (field = 'unit') as unit, arg_max((event_id % 3)::int, k) filter (field in ('tier', 'escalation') and event_id % 3 > 0) as tier, coalesce(bool_or(field = 'escalation'), false) as escalated,
 arg_max({'u': event_id % 5, 't': (event_id % 3 + 1)::int}, k) filter (event_type = 'view') as machine from e group by 1)
 select user_id, case when unit is not null then unit.u else machine.u end as unit, coalesce(tier, machine.t) as tier, escalated from o"""
)
def effective_state(t):
    k = F.col("event_id")
    field = F.when(F.col("event_type") == "error", F.get(F.array(*[F.lit(x) for x in ("unit", "tier", "escalation", "colour")]), (k % 4).cast("int")))
    return journal.effective(
        t("events"), "user_id", ("ts", "event_id"), decided=F.col("event_type") == "view", machine_unit=k % 5, machine_tier=(k % 3 + 1).cast("int"),
        field=F.coalesce(field, F.lit("")), to_unit=F.when(k % 7 > 0, k % 7), to_tier=F.when(k % 3 > 0, (k % 3).cast("int")),
    )


NEXT = "with n as (select *, min(case when event_type = 'purchase' then ts end) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as end_at from events)"


def _micros(name: str):  # noqa: ANN202
    return F.unix_micros(F.col(name).cast("timestamp"))


def _pairs(t):
    return journal.next_event(t("events"), "user_id", ("ts", "event_id"), is_start=F.col("event_type") == "signup", is_end=F.col("event_type") == "purchase", at="ts")


@query(NEXT + " select event_id, user_id from n where event_type = 'signup' and end_at is null")
def owed_events(t):
    return _pairs(t).where("end_at is null").select("event_id", "user_id")


@query("select event_id from events e where event_type = 'purchase' and not exists (select 1 from events d where d.event_type = 'view' and d.user_id = e.user_id and d.value > e.value + 60)")
def drafted_anti(t):
    e = t("events")
    best = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("m"))
    source = e.where("event_type = 'purchase'")
    done = source.join(best, "user_id").where("m > value + 60").select(F.col("event_id").alias("source_id"))
    return journal.owed(source, done, "event_id", "source_id").select("event_id")


#: A purchase is a notification of the event before it in its case; some name an event that is not there.
NOTIFIED = """with e as (select *, case when event_id % 5 = 0 then -event_id else lag(event_id) over (partition by user_id order by ts, event_id) end as source_id from events),
 p as (select n.event_id, s.event_type as trigger, (epoch_us(n.ts) - epoch_us(s.ts))::bigint as micros from e n join e s on n.user_id = s.user_id and n.source_id = s.event_id where n.event_type = 'purchase')"""


def _notified(t):
    from pyspark.sql import Window as W

    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t("events").withColumn("source_id", F.when(F.col("event_id") % 5 == 0, -F.col("event_id")).otherwise(before))
    pairs = journal.notified_pairs(e, "user_id", notified=F.col("event_type") == "purchase", event_id="event_id", source_id="source_id", kind="event_type", at="ts")
    return pairs.withColumn("micros", _micros("sent_at") - _micros("source_at"))


@query(NOTIFIED + " select event_id, trigger, micros from p")
def latency_pairs(t):
    return _notified(t).select("event_id", "trigger", "micros")


@query(NOTIFIED + " select trigger, count(*) as n, min(micros) as low, quantile_disc(micros, 0.5) as p50, quantile_disc(micros, 0.95) as p95, max(micros) as high from p group by 1")
def latency_percentiles(t):
    return journal.latency_summary(_notified(t), "micros", "trigger")


# --- review -------------------------------------------------------------------

OPEN = """with c as (select user_id as case_id, arg_max(event_type, epoch_us(ts)::hugeint * 1000000000 + event_id) as last, min(ts) as received, (user_id % 4)::int as tier,
 case when user_id % 5 > 0 then user_id % 5 end as unit from events group by user_id)"""


def _open_cases(t):
    c = t("events").groupBy(F.col("user_id").alias("case_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.min("ts").alias("received"))
    return c.withColumns({"tier": F.when(F.col("case_id") % 4 > 0, (F.col("case_id") % 4).cast("int")), "unit": F.when(F.col("case_id") % 5 > 0, F.col("case_id") % 5)}).where("last <> 'purchase'")


@query(OPEN + ", o as (select *, epoch(timestamp '2030-01-01' - received) / 3600.0 as age from c where last <> 'purchase') select coalesce(unit, -1) as queue, case_id, row_number() over (partition by coalesce(unit, -1) order by floor(epoch(timestamp '2030-01-01')) - floor(epoch(received)) desc, case_id) as position from o")
def queue_listing(t):
    c = _open_cases(t).withColumn("queue", F.coalesce("unit", F.lit(-1)))
    return review.queue(c, dates.age_hours(F.col("received"), F.lit(NOW).cast("timestamp"))).select("queue", "case_id", "position")


@query(
    OPEN + ", o as (select * from c where last <> 'purchase') select 'unit' as level, coalesce(unit::varchar, 'clearing') as key, count(*) as n from o group by 2 union all select 'tier', tier::varchar, count(*) from o where tier > 0 group by 2 union all select 'all', '', count(*) from o"
)
def queue_census(t):
    return review.census(_open_cases(t), "unit", "tier")


@query(OPEN + " select tier, count(*) as n, max(floor(epoch(timestamp '2030-01-01')) - floor(epoch(received)))::bigint as oldest, count(*) filter (floor(epoch(timestamp '2030-01-01')) - floor(epoch(received)) > tier * 3600) as n_over from c where last <> 'purchase' and tier > 0 group by 1")
def backlog_age(t):
    c = _open_cases(t).withColumn("age", F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("received"))
    return review.backlog(c, "tier", "age", {1: 3600.0, 2: 7200.0, 3: 10800.0})


@query(
    "select c_mktsegment as unit, c_nationkey as nation, count(*) as n_cases, case when count(*) >= 5 then count(*) filter (c_acctbal < 0) end as n_override, case when count(*) >= 5 then (count(*) filter (c_acctbal < 0))::double / count(*) end as override_rate from customer group by all"
)
def unit_metrics_suppressed(t):
    g = t("customer").groupBy(F.col("c_mktsegment").alias("unit"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_cases"), F.count_if(F.col("c_acctbal") < 0).alias("k"))
    n = F.col("n_cases")
    return g.select("unit", "nation", "n_cases", review.suppressed(F.col("k"), n).alias("n_override"), review.suppressed(F.col("k") / n, n).alias("override_rate"))


@query("select event_type as field, (user_id % 5) as unit, count(*) as n, count(distinct user_id) as n_cases from events where event_type in ('error', 'view') group by all")
def correction_pool(t):
    e = t("events").where("event_type in ('error', 'view')")
    return e.groupBy(F.col("event_type").alias("field"), (F.col("user_id") % 5).alias("unit")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_cases"))


# --- evaluation ---------------------------------------------------------------

LABELLED = "with x as (select doc_id, lang, source, n_chars, quality, toxic, (case when quality = 1 then 1 when toxic = 1 then 3 else 2 end)::int as e, (case when n_chars > 800 then 1 when n_chars > 300 then 2 else 3 end)::int as a from documents join labels using (doc_id))"


def _labelled(t):
    x = t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels"), "doc_id")
    expected = F.when(F.col("quality") == 1, 1).when(F.col("toxic") == 1, 3).otherwise(2)
    return x.withColumns({"e": expected, "a": F.when(F.col("n_chars") > 800, 1).when(F.col("n_chars") > 300, 2).otherwise(3)})


@query(LABELLED + " select count(*) as n, count(*) filter (e = a) as n_right, count(*) filter (e > 1 and a = 1) as n_false_clear, count(*) filter (e = 1 and a > 1) as n_false_flag, (count(*) filter (e = a))::double / count(*) as accuracy from x")
def accuracy_rates(t):
    return evaluate.tier_rates(_labelled(t), "e", "a")


@query(LABELLED + " select lang, count(*) as n, count(*) filter (e = a) as n_right, count(*) filter (e > 1 and a = 1) as n_false_clear, count(*) filter (e = 1 and a > 1) as n_false_flag, (count(*) filter (e = a))::double / count(*) as accuracy from x group by 1")
def breakdown(t):
    return evaluate.tier_rates(_labelled(t), "e", "a", "lang")


@query(
    LABELLED + """, s as (select list_filter(['q', case when toxic = 1 then 't' end, case when quality = 0 then 'z' end], lambda v: v is not null) as e, list_filter(['q', case when n_chars > 2000 then 't' end, case when n_chars < 500 then 'z' end], lambda v: v is not null) as a from x),
 c as (select sum(len(list_intersect(a, e)))::bigint as tp, sum(len(list_filter(a, lambda v: not list_contains(e, v))))::bigint as fp, sum(len(list_filter(e, lambda v: not list_contains(a, v))))::bigint as fn from s)
 select tp, fp, fn, tp::double / (tp + fp) as precision, tp::double / (tp + fn) as recall, 2.0::double * tp / (2 * tp + fp + fn) as f1 from c"""
)
def micro_prf(t):
    some = lambda **k: F.filter(F.array(*[F.when(c, F.lit(v)) for v, c in k.items()]), lambda x: x.isNotNull())
    x = _labelled(t)
    n = F.col("n_chars")
    x = x.withColumns({"es": some(q=F.lit(True), t=F.col("toxic") == 1, z=F.col("quality") == 0), "as": some(q=F.lit(True), t=n > 2000, z=n < 500)})
    return evaluate.micro_counts(x, "as", "es")


@query(LABELLED + " select e as expected, a as actual, count(*) as n from x group by all")
def confusion(t):
    return evaluate.confusion(_labelled(t), "e", "a")


@query("select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents group by grouping sets ((lang, source), (lang), (source), ())")
def grouping_levels(t):
    return review.grouped_levels(t("documents"), [["lang", "source"], ["lang"], ["source"], []], n=F.count("*"), chars=F.sum("n_chars"))


@query(
    LABELLED + ", r as (select lang, count(*) as n, avg((toxic = 1)::int::double) as rate from x group by 1 having count(*) >= 5)"
    " select count(*) as n_groups, max(rate) as high, min(rate) as low, arg_max(lang, {'r': rate, 'l': lang}) as highest, arg_min(lang, {'r': rate, 'l': lang}) as lowest, case when count(*) >= 2 and min(rate) > 0 then max(rate) / min(rate) end as skew from r"
)
def skew_ratio(t):
    return evaluate.skew(_labelled(t), "lang", F.col("toxic") == 1, 5)


@query(LABELLED + " select t::double as threshold, count(*) filter (n_chars >= t) as n_over, count(*) filter (n_chars >= t and toxic = 1) as n_hit, count(*) filter (n_chars < t) as n_under from x, (select unnest([100, 300, 500, 800, 1200, 2000, 4000, 8000]) as t) group by 1")
def threshold_sweep(t):
    return evaluate.threshold_sweep(_labelled(t), "n_chars", F.col("toxic") == 1, [100, 300, 500, 800, 1200, 2000, 4000, 8000])


@query("select least(floor(l_discount * 100 / 10 * 10), 9)::bigint as bin, count(*) as n from lineitem group by 1")
def score_histogram(t):
    return evaluate.histogram(t("lineitem"), F.col("l_discount") * 100 / 10)


@query("with s as (select list_sort(list(n_chars)) as v, count(*) as n from documents) select v[1] as low, v[n // 2 + 1] as median, v[least(n - 1, 9 * n // 10) + 1] as p90, v[n] as high from s")
def score_distribution(t):
    return evaluate.upper_median(t("documents"), "n_chars")


#: Rows are cut at i * n // 10; a group whose first score is the last one of the group before joins it.
BINS = LABELLED + """, r as (select *, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from x), c as (select *, floor(((i + 1) * least(10, n) - 1) / n) as g from r),
 g as (select g, min(n_chars) as low, max(n_chars) as high from c group by 1), m as (select g, sum(case when low = before then 0 else 1 end) over (order by g) - 1 as bin from (select *, lag(high) over (order by g) as before from g)),
 y as (select c.*, m.bin::bigint as bin from c join m using (g))"""


@query(BINS + " select bin, count(*) as n, min(n_chars) as low, max(n_chars) as high, count(*) filter (quality = 1) as n_right from y group by 1")
def calibration_bins(t):
    b = evaluate.equal_bins(_labelled(t), "n_chars", 10)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.count_if(F.col("quality") == 1).alias("n_right"))


@query(BINS + ", b as (select bin, count(*) as n, avg(least(n_chars / 4000.0, 1.0)::double) as c, avg(quality::double) as a from y group by 1) select round(sum(n * abs(c - a)) / sum(n), 9) as ece from b")
def ece(t):
    b = evaluate.equal_bins(_labelled(t), "n_chars", 10).withColumn("c", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)))
    return evaluate.calibration_error(b, "c", F.col("quality") == 1).select(F.round("ece", 9).alias("ece"))


@query("with r as (select l_extendedprice as v from lineitem where l_linenumber = 1), k as (select v, count(*) as c from r group by 1), u as (select v, sum(c)::bigint as c from (select * from k union all select distinct l_extendedprice, 0 from lineitem) group by 1), s as (select v, sum(c) over (order by v) as upto, sum(c) over () as n from u) select l_orderkey, l_linenumber, floor(upto::bigint * 1000000 / n::bigint)::bigint as rank_ppm from lineitem join s on l_extendedprice = v")
def ecdf_rank(t):
    lines = t("lineitem")
    ranked = scoring.share_up_to(lines, lines.where("l_linenumber = 1").select(F.col("l_extendedprice").alias("v0")), "l_extendedprice", "v0", "rank")
    n = lines.where("l_linenumber = 1").count()
    return ranked.select("l_orderkey", "l_linenumber", F.floor(F.round(F.col("rank") * n) * 1000000 / n).alias("rank_ppm"))


@query(
    "with k as (select p_size as v, count(*) as c from part group by 1), s as (select v, sum(c) over (order by v)::bigint as le, (sum(c) over () - sum(c) over (order by v) + c)::bigint as ge, sum(c) over ()::bigint as n from k) select p_partkey, round(1 - least(le, ge)::double / n, 9)::double as tail from part join s on p_size = v"
)
def tail_share(t):
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("s"), (-F.col("p_size")).cast("double").alias("m"))
    at_most = scoring.share_up_to(p, p.select(F.col("s").alias("r")), "s", "r", "le")
    both = scoring.share_up_to(at_most, p.select(F.col("m").alias("r")), "m", "r", "ge")
    return both.select("p_partkey", F.round(scoring.tail_share([(F.col("le"), F.col("ge"))]), 9).alias("tail"))


@query(
    "select l_orderkey, l_linenumber, unnest(['discount', 'quantity', 'tax']) as feature, unnest([(l_discount * 100)::int - 5, l_quantity::int - 25, (l_tax * 100)::int - 4])::bigint as contribution from lineitem"
)
def ablation(t):
    rounded = lambda c: F.round(F.col(c) * 100).cast("long")
    features = {"discount": rounded("l_discount"), "quantity": F.col("l_quantity").cast("long"), "tax": rounded("l_tax")}
    total = lambda f: f["discount"] + f["quantity"] + f["tax"]
    parts = scoring.ablation(features, {"discount": 5, "quantity": 25, "tax": 4}, total)
    return t("lineitem").select("l_orderkey", "l_linenumber", F.explode(parts).alias("p")).select("l_orderkey", "l_linenumber", "p.feature", F.col("p.contribution").cast("long").alias("contribution"))


@query()
def forest_score(t):
    import numpy as np

    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = t("lineitem")
    sample = lines.select(F.xxhash64("l_orderkey", "l_linenumber").alias("h"), *features).orderBy("h").limit(2000).collect()
    forest = scoring.Forest.fit(np.array([[float(r[f]) for f in features] for r in sample]), trees=200)
    return scoring.forest_score(lines, features, forest).select("l_orderkey", "l_linenumber", "forest")


@query(
    """with p as (select label, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) group by all), c as (select label, list(x order by i) as centre from p group by 1),
 s as (select vec_id, c.label as unit, list_cosine_similarity(embedding::double[], centre) as score from embeddings, c), k as (select *, row_number() over (partition by vec_id order by round(score, 6) desc, unit) as rank from s) select vec_id, unit as best_unit from k where rank = 1"""
)
def unit_topk_cosine(t):
    e = t("embeddings")
    return scoring.rank_units(e, scoring.centroids(e, "label", "embedding"), "vec_id", "embedding", "label").select("vec_id", "best_unit")


@query(
    """with p as (select label, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) group by all), c as (select label, list(x order by i) as centre from p group by 1),
 s as (select vec_id, list_cosine_similarity(embedding::double[], centre) as score from embeddings, c), k as (select vec_id, list_sort(list(score), 'desc') as v from s group by 1) select vec_id, round(v[1], 4) as best, round(v[1] - v[2], 4) as margin from k"""
)
def score_margin(t):
    e = t("embeddings")
    return scoring.rank_units(e, scoring.centroids(e, "label", "embedding"), "vec_id", "embedding", "label").select("vec_id", F.round("best_score", 4).alias("best"), F.round("margin", 4).alias("margin"))


# --- personal data, checksums, spans -------------------------------------------

EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@query(f"select doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) as email from documents")
def pii_scan_email(t):
    return t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({redact.SWEEP['EMAIL']})"), F.lit(1))).alias("email"))


@query()
def pii_counts_by_kind(t):
    found = redact.with_findings(t("documents").select("doc_id", "text"), "text", "found").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("with a as (select c_custkey, lpad((c_custkey * 7919 % 1000000007)::varchar, 18, '0') as acc from customer), m as (select *, (98 - ((acc || '131400')::hugeint % 97)::int) as k from a) select c_custkey, 'DE' || lpad(k::varchar, 2, '0') || acc as iban, true as valid from m")
def checksum_iban(t):
    acc = F.lpad(((F.col("c_custkey") * 7919) % 1000000007).cast("string"), 18, "0")
    iban = F.concat(F.lit("DE"), checksums.iban_check_digits(F.lit("DE"), acc), acc)
    return t("customer").select("c_custkey", iban.alias("iban"), (checksums.iban_mod97(iban) == 1).alias("valid"))


M11 = "list_reduce(list_prepend(10, list_transform(string_split(body, ''), lambda c: c::int)), lambda p, d: ((case when (p + d) % 10 = 0 then 10 else (p + d) % 10 end) * 2) % 11)"


@query(f"with b as (select s_suppkey, lpad((s_suppkey * 104729 % 10000000019)::varchar, 10, '0') as body from supplier) select s_suppkey, body, ((11 - {M11}) % 10)::int as digit, true as valid from b")
def checksum_mod11(t):
    body = F.lpad(((F.col("s_suppkey") * 104729) % 10000000019).cast("string"), 10, "0")
    digit = checksums.mod11_10_check(body)
    return t("supplier").select("s_suppkey", body.alias("body"), digit.cast("int").alias("digit"), checksums.mod11_10_valid(F.concat(body, digit.cast("string"))).alias("valid"))


SPANS = "with s as (select l_orderkey as k, (l_partkey % 200)::bigint as \"start\", (l_partkey % 200 + 1 + l_quantity)::bigint as \"end\", l_returnflag as kind, l_linenumber::bigint as line from lineitem)"


def _spans(t):
    start = F.col("l_partkey") % 200
    return t("lineitem").select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + 1 + F.col("l_quantity")).cast("long").alias("end"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").cast("long").alias("line"))


GROUPED = SPANS + ', m as (select *, max("end") over (partition by k order by "start", "end" desc, line rows between unbounded preceding and 1 preceding) as reach from s), g as (select *, sum(case when "start" < reach then 0 else 1 end) over (partition by k order by "start", "end" desc, line rows between unbounded preceding and current row)::bigint as span_group from m)'


@query(GROUPED + ' select k, span_group, min("start") as "start", max("end") as "end", count(*) as n from g group by 1, 2')
def interval_merge(t):
    return spans.merged(_spans(t), "k", "line")


@query(GROUPED + """, r as (select *, row_number() over (partition by k, span_group order by kind desc, "end" - "start" desc, "start", line) as b from g) select k, span_group, "start", "end", kind from r where b = 1""")
def strongest_span(t):
    s = _spans(t).withColumn("evidence", F.col("kind"))
    return spans.strongest(s, "k", "evidence", "kind").select("k", F.col("span_group"), "start", "end", "kind")


@query(SPANS + ' select k, line from s a where line % 2 = 0 and exists (select 1 from s b where b.line % 2 = 1 and a.k = b.k and a.kind = b.kind and b."start" <= a."start" and b."end" >= a."end")')
def span_containment(t):
    s = _spans(t)
    return spans.contained(s.where("line % 2 = 0"), s.where("line % 2 = 1"), "k").select("k", "line")


@query(SPANS + ' select k, line from s a where line % 2 = 0 and exists (select 1 from s b where b.line % 2 = 1 and a.k = b.k and a.kind = b.kind and a."start" < b."end" and b."start" < a."end")')
def span_overlap(t):
    s = _spans(t)
    return spans.overlapping(s.where("line % 2 = 0"), s.where("line % 2 = 1"), "k").select("k", "line")


@query(f"select doc_id, length(text) as n_chars, md5(regexp_replace(text, '[0-9]', ' ', 'g')) as digest from documents")
def mask_text(t):
    m = text.masked(F.col("text"), "[0-9]")
    return t("documents").select("doc_id", F.length(m).cast("long").alias("n_chars"), F.md5(m).alias("digest"))


@query("select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as digest from documents")
def normalize_text(t):
    return t("documents").select("doc_id", F.md5(text.normal_text(F.col("text"))).alias("digest"))


@query("select doc_id, item_id, true as found from documents d join benchmark b on b.text <> '' and contains(d.text, b.text)")
def quote_at_offset(t):
    d, b = t("documents").select("doc_id", "text"), t("benchmark").select("item_id", F.col("text").alias("quote"))
    return evidence.passages(d, b, "text", "quote").select("doc_id", "item_id", evidence.quoted(F.col("text"), F.col("quote"), F.col("start")).alias("found"))


@query()
def fuzzy_quote(t):
    c = t("conversations").select("conv_id", "turn", F.col("text").alias("a"))
    n = t("conversations").select("conv_id", (F.col("turn") - 1).cast(c.schema["turn"].dataType).alias("turn"), F.col("text").alias("b"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", text.similarity("a", "b").alias("ratio"))


@query(
    "(select 'both' as part, n_nationkey as k from nation where n_nationkey in (select c_nationkey from customer where c_acctbal > 9000)) union all (select 'left', n_nationkey from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9000)) union all (select distinct 'all', n_regionkey from nation)"
)
def set_ops(t):
    left = t("nation").select(F.col("n_nationkey").alias("k"))
    right = t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    name = lambda df, n: df.select(F.lit(n).alias("part"), "k")
    both, only = left.intersect(right), left.subtract(right)
    return name(both, "both").unionByName(name(only, "left")).unionByName(name(t("nation").select(F.col("n_regionkey").alias("k")).distinct(), "all"))


@query()
def seal_and_vault(t):
    s = redact.sealed(t("documents"), "doc_id", "text", "salt")
    return s.select("doc_id", F.md5("sealed_text").alias("digest"), F.size("entries").alias("n_entries"), "refused")


@query("select doc_id, md5(text) as digest from documents")
def rehydrate_roundtrip(t):
    s = stored(redact.sealed(t("documents").select("doc_id", "text"), "doc_id", "text", "salt").select("doc_id", "sealed_text", "entries"), "sealed")
    back = redact.rehydrated(s.select("doc_id", "sealed_text"), redact.vault(s, "doc_id"), "doc_id", "sealed_text")
    return back.select("doc_id", F.md5("plain").alias("digest"))


@query(
    LABELLED + """, a as (select count(*) filter (e > 1 and a = 1) as false_clear, count(*) filter (toxic = 1 and n_chars < 100) as missed, count(*) filter (quality = 0) as n_bad, count(*) filter (quality = 0 and source is null) as unknown from x)
 select unnest(['false_clear', 'recall', 'structured', 'reasons']) as gate, unnest([false_clear = 0, missed = 0, n_bad > 0, unknown = 0]) as passed from a"""
)
def gates(t):
    n = lambda c: F.count_if(c)
    return evaluate.gates(_labelled(t), {
        "false_clear": n((F.col("e") > 1) & (F.col("a") == 1)) == 0, "recall": n((F.col("toxic") == 1) & (F.col("n_chars") < 100)) == 0, "structured": n(F.col("quality") == 0) > 0,
        "reasons": n((F.col("quality") == 0) & F.col("source").isNull()) == 0,
    })


# --- actions, drafts, messages ---------------------------------------------------


@query(
    """with a as (select o_orderkey, o_custkey, case o_orderkey % 3 when 0 then 'confirm' when 1 then 'override' else 'escalate' end as action, case when o_orderkey % 4 = 0 then 'colour' when o_orderkey % 2 = 0 then 'unit' else 'tier' end as field,
 case when o_orderkey % 5 > 0 then 'why' else ' ' end as reason, (o_orderkey % 3)::varchar as new from orders), c as (select c_custkey, (c_custkey % 3)::varchar as unit, (c_custkey % 4)::int as tier, c_acctbal < 0 as confirmed from customer),
 j as (select *, confirmed or coalesce(max((action = 'confirm')::int) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) = 1 as done, case when field = 'unit' then unit else tier::varchar end as cur from a join c on o_custkey = c_custkey)
 select o_orderkey, case when done then 'already_confirmed' when action = 'override' and field = 'colour' then 'unknown_field' when action in ('override', 'escalate') and reason = ' ' then 'no_reason'
 when action = 'override' and new = cur then 'no_change' when action = 'escalate' and tier >= 3 then 'already_highest' end as refusal from j"""
)
def review_actions(t):
    k = F.col("o_orderkey")
    a = t("orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("case_id"),
        F.when(k % 3 == 0, "confirm").when(k % 3 == 1, "override").otherwise("escalate").alias("action"),
        F.when(k % 4 == 0, "colour").when(k % 2 == 0, "unit").otherwise("tier").alias("field"),
        F.when(k % 5 > 0, "why").otherwise(" ").alias("reason"),
        (k % 3).cast("string").alias("new"),
    )
    c = F.col("c_custkey")
    cases = t("customer").select(c.alias("case_id"), (c % 3).cast("string").alias("unit"), (c % 4).cast("int").alias("tier"), (F.col("c_acctbal") < 0).alias("confirmed"))
    return actions.judged(a, cases, "case_id", "o_orderkey").select("o_orderkey", "refusal")


@query(
    "select c_custkey, case when c_nationkey % 3 = 0 then 'decision' when c_nationkey % 3 = 1 and c_acctbal < 0 then 'request' end as kind,"
    " case when c_mktsegment <> 'BUILDING' then 'To ' || c_name || ': ' || c_mktsegment end as letter from customer"
)
def draft_letters(t):
    c = t("customer").withColumns({"segment": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))})
    kind = letters.draft_kind(F.col("c_nationkey") % 3 + 1, F.when(F.col("c_acctbal") < 0, 1).otherwise(0))
    return letters.letters(c.withColumn("kind", kind), "To {name}: {segment}", ("name", "segment"), {"name": F.col("c_name"), "segment": F.col("segment")}).select("c_custkey", "kind", "letter")


@query(GAPS + " select c_custkey, string_agg(case when failed = 'MISSING' then requirement_id || ' is missing' else requirement_id || ' failed ' || failed end, '; ' order by case requirement_id when 'name' then 1 when 'segment' then 2 when 'balance' then 3 else 4 end) as sentences from u where failed is not null group by 1")
def gap_sentences(t):
    templates = {"MISSING": "{requirement_id} is missing", "INVALID": "{requirement_id} failed {failed}"}
    return evidence.completeness(_customers(t), REQUIRED).select("c_custkey", F.array_join(letters.gap_sentences(F.col("gaps"), templates), "; ").alias("sentences"))


@query(
    "select event_id, case event_type when 'signup' then 'Received case ' || user_id else 'Case ' || user_id || ' failed' end as message from events where event_type in ('signup', 'error') and event_id % 3 > 0"
)
def owed_notifications(t):
    e = t("events").withColumnRenamed("event_type", "type")
    done = e.where("event_id % 3 = 0").select(F.col("event_id").alias("source_event_id"))
    return letters.notifications(e, done, {"signup": "Received case {id}", "error": "Case {id} failed"}, {"id": F.col("user_id")}).select("event_id", "message")


@query("select conv_id, turn, s as start, substr(text, s + 1, 100) as chunk from conversations, lateral (select unnest(range(0, length(text)::int, 100))::int as s)")
def text_chunks(t):
    return t("conversations").select("conv_id", "turn", F.inline(letters.chunks(F.col("text"), 100)))


@query("select s_suppkey, substr(sha256(s_suppkey || '|d'), 1, 16) || '.xml' as name, '<case><id>' || s_suppkey || '</id><name>' || s_name || ' &amp; co</name></case>' as xml from supplier")
def handover_stubs(t):
    k = F.col("s_suppkey")
    return t("supplier").select(k, handover.stub_name(k, F.lit("d")).alias("name"), handover.stub_xml("case", {"id": k, "name": F.concat("s_name", F.lit(" & co"))}).alias("xml"))


# --- streams --------------------------------------------------------------------


def _stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's table must equal the batch fold; the stream reads the same file."""
    import uuid

    from casemill.streaming import folds

    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return folds.stream_state(events, "user_id", F.struct("ts", "event_id"), F.col("event_type"), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


QUERIES["stream_state"] = _stream_state
SQL["stream_state"] = "select user_id, arg_max(event_type, epoch_us(ts)::hugeint * 1000000000 + event_id) as latest, count(*) as n from events group by 1"

#: Used by ``entry``: tiers of all orders.
FLAGSHIP = "decision_count"
