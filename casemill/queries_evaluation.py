"""Queries of decisions, anomaly scores, review and evaluation; registered with the others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import dates
from casemill.operators import anomaly, context, decide, evaluate, evidence, journal, letters, redact, reference, review, scoring, spans
from casemill.plans import decisions
from casemill.queries import CASES, LABELLED, ROUTED, ROUTES, _labelled, _open_cases, query
from casemill.session import shared_folder

# --- anomaly -----------------------------------------------------------------------

MARKS = (anomaly.Indicator("seg", ("building", "machinery")), anomaly.Indicator("note", ("yes",)))


def _featured(t) -> DataFrame:
    k = F.col("c_custkey")
    c = t("customer").select(
        "c_custkey", F.when(k % 4 > 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("seg"), F.when(k % 5 == 0, "Yes").when(k % 5 == 1, "no").when(k % 50 == 2, "[[PII|NAME|BCDFGHJKMNPQ]]").alias("note"),
        F.when(k % 3 > 0, F.concat((k % 250).cast("string"), F.lit(",5"))).when(k % 3 == 0, "about").alias("share"), F.when(k % 7 > 0, F.date_add(F.lit("2000-01-01").cast("date"), (k % 900).cast("int"))).alias("lead"),
        F.lit("2001-01-01").cast("timestamp").alias("received"), F.when(k % 6 == 0, "a letter").alias("prose"), (k % 9 == 0).alias("scan"),
    )
    return anomaly.features(c, fields=("seg", "note", "lead"), indicators=MARKS, share="share", leading="lead", received="received", prose="prose", scanned=F.col("scan"))


@query(
    """with c as (select c_custkey as k, case when c_custkey % 4 > 0 then c_mktsegment end as seg, case when c_custkey % 5 = 0 then 'Yes' when c_custkey % 5 = 1 then 'no' when c_custkey % 50 = 2 then 'sealed' end as note,
 case when c_custkey % 7 > 0 then date '2000-01-01' + (c_custkey % 900)::int end as lead from customer),
 p as (select *, (seg is not null)::int + (note is not null)::int as there, (coalesce(seg in ('BUILDING', 'MACHINERY'), false))::int + (coalesce(note = 'Yes', false))::int as hits from c)
 select k as c_custkey, coalesce(note, '') = 'sealed' as degraded, case when coalesce(note, '') <> 'sealed' then there + (lead is not null)::int end::bigint as filled, case when coalesce(note, '') <> 'sealed' then there end::bigint as present,
 case when coalesce(note, '') <> 'sealed' then case when there > 0 then hits * 2 / there else 0 end end::bigint as share2, case when coalesce(note, '') <> 'sealed' then coalesce(datediff('day', date '2001-01-01', lead), 0) end::bigint as days,
 case when coalesce(note, '') <> 'sealed' then case when k % 3 > 0 then least(1000, (k % 250) * 10 + 5) else 0 end end::bigint as revenue, case when coalesce(note, '') <> 'sealed' then (k % 6 = 0)::int + 2 * (k % 9 = 0)::int end::bigint as kinds,
 case when coalesce(note, '') <> 'sealed' then (there > 0)::int + 2 * (lead is not null)::int + 4 * (k % 3 > 0)::int end::bigint as known from p"""
)
def anomaly_features(t):
    f, a = (lambda n: F.col(f"features.{n}")), (lambda n: F.col(f"available.{n}").cast("long"))
    whole = lambda c: F.round(c).cast("long")
    return _featured(t).select(
        "c_custkey", F.col("degraded").isNotNull().alias("degraded"), whole(f("filled_share") * 3).alias("filled"), whole(f("indicators_present") * 2).alias("present"), whole(f("indicators_share") * 2).alias("share2"),
        whole(f("leading_years") * 365.25).alias("days"), whole(f("revenue_share") * 1000).alias("revenue"), whole(f("prose") + 2 * f("scanned")).alias("kinds"), (a("indicators_share") + 2 * a("leading_years") + 4 * a("revenue_share")).alias("known"),
    )


LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _line_reference(t) -> reference.Reference:  # noqa: ANN001
    """A reference population of lines, written as an artifact and read back."""
    spark = t("nation").sparkSession
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    fitted = reference.fit(t("lineitem"), key, LINE_FEATURES, ("l_quantity", "l_extendedprice"))
    path = f"{shared_folder(spark)}/casemill/reference-{uuid.uuid4().hex}"
    reference.write(spark, fitted, path)
    return reference.read(spark, path, LINE_FEATURES)


@query()
def combined_score(t):
    """Every line by a forest of 200 trees and by its tails, against a stored reference population."""
    return reference.scored(t("lineitem"), _line_reference(t)).select("l_orderkey", "l_linenumber", "forest_rank", "deviation", "score")


@query(
    """with k as (select *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id from lineitem), r as (select l_quantity as q, l_discount as p from k order by md5(id), id limit 2000),
 n as (select count(*) as n from r), i as (select l_orderkey, l_linenumber, l_quantity as q, l_discount as p from lineitem),
 v as (select 'q' as f, q as v from i union select 'p', p from i), c as (select 'q' as f, q as x from r union all select 'p', p from r),
 b as (select f, x, count(*) as c from c group by all), u as (select f, x as v, c from b union all select f, v, 0 from v), g as (select f, v, sum(c) as c from u group by all),
 s as (select f, v, sum(c) over (partition by f order by v) as le, sum(c) over (partition by f order by v desc) as ge from g)
 select l_orderkey, l_linenumber, (1000000 - round(1000000 * least(a.le, a.ge, b.le, b.ge) / n))::bigint as deviation_ppm from i, n join s a on a.f = 'q' and a.v = i.q join s b on b.f = 'p' and b.v = i.p"""
)
def deviation_reading(t):
    """The tails of every line in a stored reference population, as parts of a million."""
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    fitted = reference.fit(t("lineitem"), key, ("l_quantity", "l_discount"), ("l_quantity", "l_discount"), trees=1)
    found = reference.scored(t("lineitem"), reference.parsed(fitted.document(), fitted.names))
    return found.select("l_orderkey", "l_linenumber", F.round(F.col("deviation") * 1000000).cast("long").alias("deviation_ppm"))


@query(
    """with p as (select rid, l_orderkey, l_linenumber, unnest(['a', 'b', 'c']) as f, unnest([l_quantity::int - 25, (l_discount * 100)::int - 5, (l_tax * 100)::int - 4]) as c, unnest([50.0, 10.0, 8.0]) as s from (select *, row_number() over () as rid from lineitem)),
 k as (select *, row_number() over (partition by rid order by c desc, f) as i, row_number() over (partition by rid order by abs(c) / s desc, f) as j, max(c) over (partition by rid) as top from p)
 select l_orderkey, l_linenumber, string_agg(f, ',' order by i) filter (case when top >= 3 then c >= 3 and i <= 2 else j = 1 end) as reasons from k group by rid, 1, 2"""
)
def flag_reasons(t):
    whole = lambda c: F.round(F.col(c) * 100).cast("double")
    parts = {"a": (F.col("l_quantity").cast("double"), 25.0, 50.0), "b": (whole("l_discount"), 5.0, 10.0), "c": (whole("l_tax"), 4.0, 8.0)}
    rows = F.array(*[F.struct(F.lit(k).alias("feature"), (v - m).alias("contribution"), v.alias("observed"), F.lit(m).alias("expected"), F.lit(0.0).alias("q1"), F.lit(s).alias("q3")) for k, (v, m, s) in parts.items()])
    return t("lineitem").select("l_orderkey", "l_linenumber", F.array_join(scoring.top_reasons(rows, 3.0, 2), ",").alias("reasons"))


@query(
    """with o as (select l_orderkey, list_sort(list(l_quantity)) as v, count(*) as n from lineitem group by 1), h as (select *, v[1:n // 2] as lo, v[n - n // 2 + 1:n] as hi from o)
 select l_orderkey, coalesce(list_median(lo), v[1])::double as q1, list_median(v)::double as median, coalesce(list_median(hi), v[n])::double as q3 from h"""
)
def reference_quartiles(t):
    o = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    return o.select("l_orderkey", scoring.quartiles(F.col("v")).alias("q")).select("l_orderkey", F.col("q.q1").cast("double").alias("q1"), F.col("q.median").cast("double").alias("median"), F.col("q.q3").cast("double").alias("q3"))


@query("select c_custkey, c_acctbal >= 5000 as flagged, c_acctbal < 5000 or c_custkey % 10 > 1 as readable, case when c_custkey % 11 > 0 then 'scored' when c_custkey % 2 = 0 then 'no score' else 'failed' end as status from customer")
def flags_and_degradation(t):
    k = F.col("c_custkey")
    one = F.array(F.struct(F.lit("balance").alias("feature"), F.when(k % 10 == 1, "x").otherwise(F.col("c_acctbal").cast("string")).alias("observed"), F.lit("about 4000").alias("expected")))
    c = t("customer").withColumns({"reasons": F.when(k % 10 == 0, F.slice(one, 1, 0)).otherwise(one), "score": F.col("c_acctbal")})
    out = anomaly.flagged(c, "score", 5000.0, "reasons")
    out = out.withColumns({"s": F.when(k % 11 > 0, F.col("score")), "why": F.when((k % 11 == 0) & (k % 2 == 1), "failed")})
    return anomaly.evidence_or_degraded(out, "s", "why").select("c_custkey", "flagged", "readable", "anomaly.status")


@query(
    """with a as (select c_acctbal as v, row_number() over (order by c_acctbal) as i from customer), b as (select v, row_number() over (order by v) as i from (select case when c_custkey % 5 = 0 then c_acctbal / 2 else c_acctbal end as v from customer))
 select count(a.v) as n_recorded, count(b.v) as n_computed, max(abs(a.v - b.v)) as drift from a full join b using (i)"""
)
def reference_drift(t):
    """How far the balances of all customers move, rank by rank, when every fifth is halved."""
    s = t("customer").select(F.col("c_acctbal").alias("score"))
    changed = t("customer").select(F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") / 2).otherwise(F.col("c_acctbal")).alias("score"))
    return reference.drift_by_rank(s, changed, "score")


# --- decision ------------------------------------------------------------------------

DECISION = (
    decisions.Row("clear", {"all": [{"field": "verdict", "op": "eq", "value": "COMPLETE"}, {"field": "clear_cut", "op": "eq", "value": True}, {"field": "routing_confidence", "op": "ge", "value": 0.9}, {"field": "tier1_enabled", "op": "eq", "value": True}]}, 1),
    decisions.Row("contested", {"all": [{"field": "rule_hit", "op": "eq", "value": True}, {"field": "routing_confidence", "op": "lt", "value": 0.9}]}, 3),
    decisions.Row("gaps", {"all": [{"field": "rule_hit", "op": "eq", "value": True}, {"field": "gap_count", "op": "le", "value": 1}, {"field": "discarded_count", "op": "lt", "value": 4}]}, 2),
)
LOWER = (decisions.Downgrade("high-score", "score", "ge", 300000.0), decisions.Downgrade("flagged", "flagged", "eq", True))


def _decided(t, enforcing: bool = True) -> DataFrame:
    k = F.col("o_orderkey")
    o = evidence.route(t("orders"), ROUTES)
    o = decide.with_fallback(decide.suggestions(o), F.when(k % 3 > 0, "classified"), F.lit(0.7), calibrated=False)
    o = decide.minima(o)
    o = o.withColumns({
        "gap_count": (k % 4).cast("int"), "verdict": F.when(k % 4 == 0, "COMPLETE").otherwise("INCOMPLETE"), "discarded_count": (k % 5).cast("int"), "min_confidence": F.lit(0.9), "tier1_enabled": k % 7 > 0,
        "score": F.col("o_totalprice"), "flagged": F.col("o_orderstatus") == "P",
    })
    o = decide.clear_cut(o, {"field": "o_totalprice", "op": "lt", "value": 150000})
    return decide.decide(o, DECISION, LOWER, key="o_orderkey", enforcing=enforcing, audit_rate=0.05, audit_salt="s1", failed=k % 101 == 0)


DECIDED = ROUTED + """, f as (select o.o_orderkey as k, o_totalprice as price, o_orderstatus as status, winner, coalesce(n, 0) as n, case when n is null then 0.0 when p1 = p2 then 0.6 else 1.0 end as conf from orders o left join best b on o.o_orderkey = b.o_orderkey),
 r as (select *, case when k % 4 = 0 and price < 150000 and conf >= 0.9 and k % 7 > 0 then 0 when n > 0 and conf < 0.9 then 1 when n > 0 and k % 4 <= 1 and k % 5 < 4 then 2 else 3 end as place from f),
 d as (select *, [1, 3, 2, 3][place + 1] as pre, price >= 300000 as a, status = 'P' as b from r), e as (select *, case when a or b then 3 else pre end as t from d),
 s as (select *, ('0x' || substr(md5('s1' || k::varchar), 1, 13))::ubigint / pow(2, 52) < 0.05 and t < 3 as drawn, k % 101 = 0 as wrong from e)"""


@query(DECIDED + " select k as o_orderkey, (case when wrong or drawn then 3 else t end)::int as tier, (case when wrong then 3 else pre end)::int as pre_tier, case when not wrong then winner end as routed_unit, not wrong and drawn as sampled, case when wrong then 'error' else array_to_string(list_concat(['clear', 'contested', 'gaps'][1:place], [['clear', 'contested', 'gaps', 'default'][place + 1]], case when a then ['high-score'] else [] end, case when b then ['flagged'] else [] end, case when drawn then ['audit_sample'] else [] end), ',') end as reasons from s")
def decide_full(t):
    return _decided(t).select("o_orderkey", "tier", "pre_tier", "routed_unit", "sampled", F.array_join(F.transform("reasons", lambda r: r["rule_id"]), ",").alias("reasons"))


@query(DECIDED + " select (case when wrong then 3 else pre end)::int as tier, count(*) as n, count(*) filter (not wrong and (a or b)) as n_would from s group by 1")
def decide_log_only(t):
    """Downgrades that are only recorded move no tier (but for the audit sample, which is off here)."""
    out = _decided(t, enforcing=False)
    return out.withColumn("t", F.col("pre_tier")).groupBy(F.col("t").alias("tier")).agg(F.count("*").alias("n"), F.count_if((F.size("fired") > 0) & (F.col("o_orderkey") % 101 > 0)).alias("n_would"))


@query(ROUTED + ", c as (select o.o_orderkey, coalesce(n, 0) as n from orders o left join best b on o.o_orderkey = b.o_orderkey) select o_orderkey, case when c.n > 0 then 'rule' when o_orderkey % 3 > 0 then 'classifier' end as source, case when c.n = 0 and o_orderkey % 3 > 0 then 'classified' when c.n > 0 then winner end as unit from c left join best using (o_orderkey)")
def classifier_fallback(t):
    o = evidence.route(t("orders"), ROUTES)
    o = decide.with_fallback(decide.suggestions(o), F.when(F.col("o_orderkey") % 3 > 0, "classified"), F.lit(0.7), calibrated=False)
    o = decide.minima(o, ("rule", "classifier"))
    return o.select("o_orderkey", F.get("routing", F.lit(0))["source"].alias("source"), F.col("routed_unit").alias("unit"))


@query("select o_orderkey, o_orderkey % 4 in (1, 2) as sampled from orders")
def sampled_reasons(t):
    k = F.col("o_orderkey") % 4
    one = lambda kind, rule: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule_id")))
    reasons = F.when(k == 0, one("downgraded", "flagged")).when(k == 1, one("sampled", "audit_sample")).when(k == 2, one("downgraded", "audit_sample"))
    return t("orders").select("o_orderkey", decide.was_sampled(reasons).alias("sampled"))


@query(
    """with h as (select o_orderkey, v.r, v.u, v.p from orders, lateral (select * from (values (10, 'r1', 'north', o_totalprice > 250000), (10, 'r2', 'south', o_orderpriority = '1-URGENT'),
 (20, 'r3', 'north', o_orderstatus = 'F'), (20, 'r4', 'east', o_orderpriority in ('2-HIGH', '3-MEDIUM')), (30, 'r5', 'west', o_totalprice < 20000), (40, 'r6', 'south', o_orderstatus = 'P')) v(p, r, u, hit) where hit) v)
 select o_orderkey, u as unit, min(p)::int as priority, string_agg(r, ',' order by p, r) as rules from h group by 1, 2"""
)
def suggestions_by_unit(t):
    return evidence.suggestions_by_unit(t("orders"), ROUTES).select("o_orderkey", "s.unit", "s.priority", F.array_join("s.rule_ids", ",").alias("rules"))


# --- review ------------------------------------------------------------------------------


@query(
    """with c as (select o_orderkey as case_id, o_orderkey % 6 as unit, o_orderkey % 2 = 0 as confirmed, o_orderkey % 3 = 0 as overridden, (o_totalprice / 1000)::int as seconds from orders where o_orderkey % 6 > 0 or o_orderkey < 20),
 g as (select unit, count(*) filter (confirmed) as confirmed, count(*) filter (confirmed and not overridden) as without_edit, count(*) filter (overridden) as overridden, median(seconds) filter (confirmed) as median from c group by 1)
 select unit, confirmed, without_edit, overridden, case when confirmed >= 5 then without_edit::double / confirmed end as clean_rate, case when confirmed + overridden >= 5 then overridden::double / (confirmed + overridden) end as override_rate, case when confirmed >= 5 then median::double end as median_seconds from g"""
)
def unit_review_metrics(t):
    k = F.col("o_orderkey")
    c = t("orders").where("o_orderkey % 6 > 0 or o_orderkey < 20").select((k % 6).alias("unit"), (k % 2 == 0).alias("confirmed"), (k % 3 == 0).alias("overridden"), F.round(F.col("o_totalprice") / 1000).cast("int").alias("seconds"))
    return review.unit_metrics(c)


@query(
    """with e as (select *, epoch_us(ts)::hugeint * 1000000000 + event_id as k from events), s as (select user_id, arg_max(value, k) filter (event_type = 'view') as machine from e group by 1)
 select e.event_id, e.user_id, row_number() over (order by e.user_id, e.ts, e.event_id) as place, machine from e join s using (user_id) where event_type = 'error'"""
)
def correction_listing(t):
    """Corrections with the machine's state of their case, in the order of case and time."""
    e = t("events")
    state = journal.folded(e, "user_id", {"machine": (F.col("event_type") == "view", F.col("value"))}, ("ts", "event_id"))
    found = journal.corrections(e.where("event_type = 'error'"), state, "user_id", "ts", "event_id")
    return found.select("event_id", "user_id", "place", "machine")


@query("select user_id, string_agg(event_type || '=' || n, ',' order by event_type) as counts from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def sorted_counters(t):
    c = context.counter(t("events"), "event_type", "user_id")
    return c.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"))


@query("select user_id, string_agg(event_id::varchar, ',' order by ts, event_id) filter (event_type = 'error') as errors, arg_max(value, epoch_us(ts)::hugeint * 1000000000 + event_id) as last from events group by 1")
def case_state_lists(t):
    listed = journal.listed(t("events"), "user_id", F.col("event_type") == "error", F.col("event_id").cast("string"), ("ts", "event_id"))
    return t("events").groupBy("user_id").agg(F.nullif(F.array_join(listed, ","), F.lit("")).alias("errors"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query(
    """with c as (select user_id, arg_max(event_type, epoch_us(ts)::hugeint * 1000000000 + event_id) as last, floor(epoch(timestamp '2030-01-01')) - floor(epoch(min(ts))) as age, (user_id % 4)::int as tier, case when user_id % 5 > 0 then user_id % 5 end as unit from events group by 1),
 o as (select user_id, age / 3600.0 as h, tier, unit from c where last <> 'purchase')
 select user_id, array_to_string(list_concat(case when user_id % 3 = 0 then ['sampled'] else [] end, case when user_id % 7 = 0 then ['anomaly'] else [] end, case when user_id % 11 = 0 then ['escalated'] else [] end, case when unit = 3 then ['objection'] else [] end,
 case when unit = 3 and h > 200000 then ['objection_late'] else [] end, case when unit is null and h > 48 then ['clearing_late'] else [] end, case when tier > 0 and h > tier * 80000 then ['over_budget'] else [] end), ',') as flags from o"""
)
def queue_flags(t):
    k = F.col("case_id")
    c = _open_cases(t).withColumns({"sampled": k % 3 == 0, "flagged": k % 7 == 0, "escalated": k % 11 == 0, "unit": F.col("unit").cast("string")})
    age = dates.age_hours(F.col("received"), F.lit("2030-01-01").cast("timestamp"))
    found = decide.queue_flags(c, age_hours=age, budget_hours={1: 80000, 2: 160000, 3: 240000}, objection_unit="3", objection_hours=200000, clearing_hours=48)
    return c.select(k.alias("user_id"), F.array_join(found, ",").alias("flags"))


@query(
    """with a as (select event_id, user_id, ts from events where event_type = 'signup'), b as (select event_id, user_id, ts from events where event_type = 'purchase')
 select a.user_id, epoch_us(a.ts) as left_at, epoch_us(b.ts) as right_at from a join b on a.user_id = b.user_id and b.ts <= a.ts + interval 30 minute and a.ts <= b.ts + interval 30 minute"""
)
def two_party_pairs(t):
    e = t("events")
    found = context.correlated(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", "ts", "30 minutes").withColumnRenamed("token", "user_id")
    return found.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("left_at", "right_at")})


# --- evaluation ------------------------------------------------------------------------------


@query(
    LABELLED + """, t as (select doc_id, quality, toxic, unnest(case when n_chars > 800 then ['long', lang] else [lang] end) as kind from x)
 select kind, count(*) as n, count(*) filter (quality = 1) as n_verified, count(*) filter (quality = 0) as n_discarded from t group by 1"""
)
def span_counts(t):
    x = _labelled(t).withColumn("kinds", F.when(F.col("n_chars") > 800, F.array(F.lit("long"), F.col("lang"))).otherwise(F.array("lang")))
    return evaluate.span_counts(x, "kinds", F.col("quality") == 1)


@query(LABELLED + " select unnest(['n', 'right', 'clear', 'flag', 'toxic']) as metric, unnest([count(*) > 0, count(*) filter (e = a) = -1, count(*) filter (e > 1 and a = 1) = 0, true, count(*) filter (toxic = 1) > 0]) as held from x where n_chars > 500 and lang = 'en'")
def structured_subset(t):
    x = _labelled(t).where("n_chars > 500 and lang = 'en'")
    n = F.count_if
    return evaluate.invariants(x, {
        "n": F.count("*") > 0, "right": n(F.col("e") == F.col("a")) == -1, "clear": n((F.col("e") > 1) & (F.col("a") == 1)) == 0, "flag": n(F.lit(True)) == F.count("*"), "toxic": n(F.col("toxic") == 1) > 0,
    })


@query(
    """with s as (select l_orderkey as k, l_linenumber as line, (l_partkey % 200)::bigint as a, (l_partkey % 200 + 1 + l_quantity)::bigint as b, l_returnflag as kind from lineitem), l as (select * from s where line % 2 = 0), f as (select * from s where line % 2 = 1),
 r as (select kind, count(*) as n_labels, count(*) filter (exists (select 1 from f where f.k = l.k and f.kind = l.kind and f.a <= l.a and f.b >= l.b)) as n_found from l group by 1),
 p as (select kind, count(*) as n_hits, count(*) filter (exists (select 1 from l where f.k = l.k and f.kind = l.kind and f.a < l.b and l.a < f.b)) as n_right from f group by 1)
 select kind, n_labels, n_found, n_hits, n_right, n_found::double / n_labels as recall, n_right::double / n_hits as precision, n_found = n_labels as passed from r join p using (kind)"""
)
def redaction_recall(t):
    start = F.col("l_partkey") % 200
    s = t("lineitem").select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + 1 + F.col("l_quantity")).cast("long").alias("end"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line"))
    return spans.recall_by_kind(s.where("line % 2 = 0"), s.where("line % 2 = 1"), "k")


@query("select event_type as kind, count(*) as n, sum((props::json->>'$.k')::bigint)::bigint as tokens, count(*) filter ((props::json->>'$.k')::bigint > 50) as n_unresolved from events group by 1")
def notification_coverage(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum(k).alias("tokens"), F.count_if(k > 50).alias("n_unresolved"))


@query(
    LABELLED + """, c as (select *, n_chars > 300 as covered, quality = (n_chars > 600)::int as agrees, least(n_chars, 4000) as score from x)
 select count(*) as n, count(*) filter (covered) as n_covered, count(*) filter (covered and agrees) as n_agreed, avg(score) filter (covered and agrees) as mean_right, avg(score) filter (covered and not agrees) as mean_wrong, min(score) filter (covered)::bigint as low, max(score) filter (covered)::bigint as high from c"""
)
def classifier_agreement(t):
    n = F.col("n_chars")
    x = _labelled(t).withColumns({"covered": n > 300, "agrees": F.col("quality") == (n > 600).cast("int"), "score": F.least(n, F.lit(4000))})
    return evaluate.agreement(x, "covered", "agrees", "score")


@query("select 'f' || n_nationkey as flag, n_nationkey % 3 > 0 as calibrated, (date '2030-01-01' + (n_nationkey * 40)::int - date '2031-01-01')::bigint as days_left, n_nationkey * 40 < 365 as overdue from nation")
def threshold_register(t):
    k = F.col("n_nationkey")
    r = t("nation").select(F.concat(F.lit("f"), k.cast("string")).alias("flag"), F.when(k % 3 > 0, k * 0.1).alias("fitted"), F.date_add(F.lit("2030-01-01").cast("date"), (k * 40).cast("int")).alias("due"))
    return evaluate.register(r, F.lit("2031-01-01").cast("date")).select("flag", "calibrated", F.col("days_left").cast("long").alias("days_left"), "overdue")


@query(
    """with r as (select l_orderkey as item, 'f' || l_linenumber as field, l_quantity as v from lineitem), a as (select * from r where v > 5), b as (select item, field, case when v > 45 then v + 1 else v end as v from r where v < 48)
 select count(*) as n_expected, count(b.item) as n_found, count(*) filter (a.v = b.v) as n_equal from a left join b on a.item = b.item and a.field = b.field"""
)
def live_comparison(t):
    r = t("lineitem").select(F.col("l_orderkey").alias("item"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_quantity").alias("value"))
    live = r.where("value < 48").withColumn("value", F.when(F.col("value") > 45, F.col("value") + 1).otherwise(F.col("value")))
    return evaluate.compared(r.where("value > 5"), live, ("item", "field"), "value")


@query("select coalesce(a.k, b.k) as name, case when b.k is null then 'missing' when a.k is null then 'stale' else 'differs' end as state from (select c_custkey as k, c_nationkey as v from customer where c_custkey % 3 > 0) a full join (select c_custkey as k, c_nationkey % 20 as v from customer where c_custkey % 4 > 0) b on a.k = b.k where a.v is distinct from b.v")
def directory_diff(t):
    c = t("customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("digest"))
    return evaluate.directory_diff(c.where("name % 3 > 0"), c.where("name % 4 > 0").withColumn("digest", F.col("digest") % 20), "name", "digest")


@query("select c_custkey as k from customer where (c_custkey % 3 = 0) <> (c_custkey % 5 = 0)")
def symmetric_difference(t):
    k = t("customer").select(F.col("c_custkey").alias("k"))
    return evaluate.symmetric_difference(k.where("k % 3 = 0"), k.where("k % 5 = 0"))


@query("select user_id, list_slice(list_sort(list(event_id)), 1, 3)[-1]::bigint as third, least(count(*), 3)::bigint as n from events group by 1")
def capped_lists(t):
    first = F.slice(F.array_sort(F.collect_list("event_id")), 1, 3)
    return t("events").groupBy("user_id").agg(F.element_at(first, -1).alias("third"), F.size(first).cast("long").alias("n"))


# --- letters -----------------------------------------------------------------------------------


@query(
    "select c_custkey, case when c_nationkey % 3 = 0 and c_mktsegment = 'BUILDING' then 'segment' when c_nationkey % 3 = 2 then 'none' else 'ready' end as state, case when c_nationkey % 3 = 0 and c_mktsegment <> 'BUILDING' then 'Decision for ' || c_name || ', ' || c_mktsegment when c_nationkey % 3 = 1 then 'Request to ' || c_name || ': proof' end as letter from customer"
)
def draft_table(t):
    c = t("customer").withColumns({"segment": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), "kind": F.get(F.array(F.lit("decision"), F.lit("request"), F.lit(None)), (F.col("c_nationkey") % 3).cast("int"))})
    out = letters.drafts(c, {"decision": ("Decision for {name}, {segment}", ("name", "segment")), "request": ("Request to {name}: {what}", ("name", "what"))}, {"name": F.col("c_name"), "segment": F.col("segment"), "what": F.lit("proof")})
    state = F.when(F.col("kind").isNull(), "none").when(F.size("blocked") > 0, F.array_join("blocked", ",")).otherwise("ready")
    return out.select("c_custkey", state.alias("state"), "letter")


@query("select c_custkey, case c_custkey % 4 when 0 then null when 1 then 'unknown_token' when 2 then 'imitation' else 'kind_mismatch' end as refusal, case when c_custkey % 4 = 0 then 'Dear ' || c_name end as plain from customer")
def rehydration_refusals(t):
    k = F.col("c_custkey")
    held = redact.minted(t("customer"), "c_custkey", F.lit("NAME"), F.col("c_name"), "salt").select("c_custkey", F.lit("NAME").alias("kind"), F.col("c_name").alias("value"), "token")
    token = redact.token(F.lit("NAME"), k, F.col("c_name"), "salt")
    told = F.when(k % 4 == 0, token).when(k % 4 == 1, redact.token(F.lit("NAME"), k, F.lit("other"), "salt")).when(k % 4 == 2, F.lit("[[PII|NAME|xyz]]")).otherwise(F.replace(token, F.lit("|NAME|"), F.lit("|ORG|")))
    letter = t("customer").select("c_custkey", F.concat(F.lit("Dear "), told).alias("text"))
    return redact.rehydrated_or_refused(letter, held, "c_custkey", "text").select("c_custkey", "refusal", "plain")


WORKDAY = "list_filter([{0} + i::int for i in range(8)], lambda x: isodow(x) < 6 and x::date::varchar not in ('1995-05-01', '1996-12-25', '1997-01-01', '1998-10-03'))[1]::date"


@query(
    f"with a as (select o_orderkey, o_orderdate::date as sent, (o_orderdate::date + 4) as raw, {WORKDAY.format('(o_orderdate::date + 4)')} as delivered from orders where o_orderkey % 3 = 0), b as (select *, {WORKDAY.format('(delivered + 28)')} as deadline from a)"
    " select o_orderkey, sent::varchar as sent, delivered::varchar as delivered, deadline::varchar as deadline, ((delivered - raw) + (deadline - (delivered + 28)))::bigint as n_shifted from b"
)
def dispatch_facts(t):
    from casemill.queries import HOLIDAYS

    o = t("orders").withColumns({"kind": F.when(F.col("o_orderkey") % 3 == 0, "request").otherwise("decision"), "sent": F.col("o_orderdate").cast("date")})
    return letters.dispatch_facts(o, F.col("sent"), 28, HOLIDAYS).where("deadline is not null").select("o_orderkey", F.col("sent").cast("string").alias("sent"), F.col("delivered").cast("string").alias("delivered"), F.col("deadline").cast("string").alias("deadline"), F.size("shifted").cast("long").alias("n_shifted"))


@query("select c_custkey, c_name || chr(10) || 'Street ' || c_nationkey || case when c_custkey % 3 > 0 then chr(10) || c_mktsegment || ' City' else chr(10) || 'City' end as address, 'Label' as label from customer")
def address_blocks(t):
    from casemill.functions import text

    k = F.col("c_custkey")
    parts = {"name": F.col("c_name"), "blank": F.lit(" \t"), "street": F.concat(F.lit("Street "), F.col("c_nationkey").cast("string")), "zip": F.when(k % 3 > 0, F.col("c_mktsegment")), "city": F.lit("City ")}
    return t("customer").select("c_custkey", text.address_lines(parts, (("name",), ("blank",), ("street",), ("zip", "city"))).alias("address"), text.short_label(F.lit("Label (of a field). More")).alias("label"))


@query(f"select o_orderkey, {CASES.format(1, 2, 3, 2, 3)}::int as tier from orders join customer on o_custkey = c_custkey")
def decided_tiers(t):
    """Tiers as the replayed journal gives them: decisions are events, and the state is folded from the events."""
    from casemill.queries import TABLE, orders_customers

    d = decisions.decide(orders_customers(t), TABLE)
    events = d.select("o_orderkey", F.lit("DECIDED").alias("type"), F.lit(1).alias("sequence"), "tier").unionByName(d.select("o_orderkey", F.lit("RECEIVED").alias("type"), F.lit(0).alias("sequence"), F.lit(None).cast("int").alias("tier")))
    return journal.folded(events, "o_orderkey", {"tier": (F.col("type") == "DECIDED", F.col("tier"))}, ("sequence",))


@query("""with a as (select c_custkey, c_custkey % 5 as k, c_name, c_mktsegment, c_custkey % 10 as no, lpad((c_custkey % 10)::varchar || '0115', 5, '0') as zip from customer)
 select c_custkey, case when k in (1, 2) then 'lossy' end as refusal, case k when 0 then 'To ' || c_name || chr(10) || no || ' ' || zip when 3 then 'To ' || c_mktsegment when 4 then 'To ' || c_name || ' ' || zip || ' ' || no end as plain from a""")
def lossless_letters(t):
    """Letters whose values have a display form: whole ones are written, a form without the house number or with more text is refused."""
    k, no = F.col("c_custkey") % 5, (F.col("c_custkey") % 10).cast("string")
    zip_ = F.concat(no, F.lit("0115"))
    tree = F.to_json(F.struct(F.col("c_name").alias("name"), F.struct((F.col("c_custkey") % 10).alias("no"), zip_.alias("zip")).alias("home")))
    value = F.when(k == 3, F.col("c_mktsegment")).otherwise(tree)
    display = F.when(k == 0, F.concat("c_name", F.lit("\n"), no, F.lit(" "), zip_)).when(k == 1, F.concat("c_name", F.lit(" "), zip_)).when(k == 2, F.concat(no, F.lit(" "), zip_, F.lit(" c/o "), "c_name")).when(k == 3, F.col("c_mktsegment")).otherwise(F.concat("c_name", F.lit(" "), zip_, F.lit(" "), no))
    held = t("customer").select("c_custkey", value.alias("value"), display.alias("display"), redact.token(F.lit("ADDR"), F.col("c_custkey"), value, "salt").alias("token"))
    letter = held.select("c_custkey", F.concat(F.lit("To "), "token").alias("text"))
    return redact.rehydrated_or_refused(letter, held, "c_custkey", "text", "display").select("c_custkey", "refusal", "plain")
