"""Dashboards, reports and review filters; orders stand in for exception cases, lineitem for damages."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ledgerline.functions import scalars as S
from ledgerline.operators import filters, kpi
from ledgerline.queries.base import Tables, check

_E = """e as (select o_orderkey as id, cast(o_orderdate as date) as d, 'C'||(o_custkey%12) as company, 'emp'||(o_custkey%40) as emp, 'A'||(o_custkey%25) as account,
 case o_orderkey%4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as sev, case o_orderkey%3 when 0 then 'morning' when 1 then 'afternoon' else 'night' end as shift,
 case o_orderkey%6 when 0 then 'open' when 1 then 'clarifying' when 2 then 'answered' when 3 then 'damage' when 4 then 'closed' else 'approved' end as status,
 case o_orderkey%5 when 0 then 'missing_bo' when 1 then 'missing_stm' when 2 then 'amount_diff' when 3 then 'time_diff' else 'duplicate' end as type,
 cast(round(o_totalprice*100) as bigint) as risk, o_orderkey%7=0 as over, o_orderkey%50 as age from orders)"""
_D = """dm as (select l_orderkey, l_linenumber, cast(l_shipdate as date) as d, 'S'||(l_suppkey%20) as emp, case when l_linenumber%3=0 then 'C1' when l_linenumber%3=1 then 'C2' else 'C3' end as cycle,
 case l_linenumber%3 when 0 then 'morning' when 1 then 'afternoon' else 'night' end as shift, 'cause'||(l_partkey%9) as cause, cast(round(l_extendedprice*100) as bigint) as amt, l_returnflag<>'A' or l_linenumber%3<>0 as ev from lineitem)"""


def cases(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *v: S.case_of([(k % n == i, x) for i, x in enumerate(v[:-1])], F.lit(v[-1]))
    return t.orders.select(
        k.alias("id"), F.to_date("o_orderdate").alias("date"), F.concat(F.lit("C"), c % 12).alias("company"), F.concat(F.lit("emp"), c % 40).alias("employee"),
        F.concat(F.lit("A"), c % 25).alias("account"), pick(4, "critical", "high", "medium", "low").alias("severity"), pick(3, "morning", "afternoon", "night").alias("shift"),
        pick(6, "open", "clarifying", "answered", "damage", "closed", "approved").alias("status"), pick(5, "missing_bo", "missing_stm", "amount_diff", "time_diff", "duplicate").alias("type"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("risk_amount"), (k % 7 == 0).alias("over_sla"), (k % 50).cast("bigint").alias("age_hours"),
        F.lit("cause").alias("cause"), F.lit("t").alias("type_name"), F.lit("B").alias("bank"), F.when(k % 2 == 0, "ฝาก").otherwise("ถอน").alias("direction"))


def damages(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 3
    return t.lineitem.select(
        F.to_date("l_shipdate").alias("business_date"), F.concat(F.lit("S"), F.col("l_suppkey") % 20).alias("employee"), F.when(n == 0, "C1").when(n == 1, "C2").otherwise("C3").alias("cycle"),
        F.when(n == 0, "morning").when(n == 1, "afternoon").otherwise("night").alias("shift"), F.concat(F.lit("cause"), F.col("l_partkey") % 9).alias("cause"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"), ((F.col("l_returnflag") != "A") | (n != 0)).alias("has_evidence"))


@check("employee_kpi", f"""with {_E} select emp as employee, count(*) as cases, count(*) filter (where sev='critical') as critical, count(*) filter (where sev='high') as high, count(*) filter (where over) as over_sla, cast(sum(risk) as bigint) as risk,
 case when count(*) filter (where sev='critical') >= 4 or count(*) filter (where over) >= 5 then 'สูง' when count(*) filter (where sev='critical') >= 2 then 'กลาง' else 'ต่ำ' end as band from e group by 1
 union all select 'nobody', 0, 0, 0, 0, 0, 'ต่ำ'""")
def employee_kpi(t: Tables) -> DataFrame:
    c = cases(t)
    staff = c.select("employee").distinct().unionByName(t.spark.range(1).select(F.lit("nobody").alias("employee")))
    return kpi.employee_kpi(c, staff).select("employee", "cases", "critical", "high", "over_sla", F.col("risk_amount").alias("risk"), "band")


@check("top_accounts", f"with {_E} select account, count(*) as value from e group by 1 order by 2 desc, 1 limit 6")
def top_accounts(t: Tables) -> DataFrame:
    return kpi.top_k(cases(t), "account", 6)


@check("counts_by_severity", f"with {_E} select s as severity, (select count(*) from e where sev=s and company='C1') as n from (values ('critical'),('high'),('medium'),('low')) v(s)")
def counts_by_severity(t: Tables) -> DataFrame:
    return kpi.count_by(filters.exception_filter(cases(t), company="C1"), "severity", kpi.severities(t.spark)).select("severity", "n")


@check("counts_by_shift", f"with {_E} select s as shift, (select count(*) from e where shift=s and sev='low') as n from (values ('morning'),('afternoon'),('night')) v(s)")
def counts_by_shift(t: Tables) -> DataFrame:
    return kpi.count_by(filters.exception_filter(cases(t), severity="low"), "shift", kpi.shifts(t.spark)).select("shift", "n")


@check("type_catalog", f"""with {_E}, c as (select * from (values ('time_diff',72),('missing_bo',8),('missing_stm',8),('amount_diff',4),('cross_day',48),('backdated',8),('wrong_bank',48),('wrong_account',48),('duplicate',4),('unexplained_out',4)) v(type,sla))
select c.type, cast(sla as bigint) as sla, (select count(*) from e where e.type=c.type) as n from c""")
def type_catalog(t: Tables) -> DataFrame:
    return kpi.type_catalog(cases(t)).select("type", F.col("sla_hours").cast("bigint").alias("sla"), "n")


@check("exception_filter", f"""with {_E} select id, type from e where d between date '1996-01-01' and date '1997-12-31' and shift='night' and sev='critical' and over and contains(lower(id||' '||account||' '||emp||' t cause B'),'a1')""")
def exception_filter(t: Tables) -> DataFrame:
    f = filters.exception_filter(cases(t), "1996-01-01", "1997-12-31", shift="night", severity="critical", over_sla=True, query="A1")
    return f.select("id", "type")


@check("active_cases", f"with {_E} select company, count(*) as n from e where status not in ('closed','approved') group by 1")
def active_cases(t: Tables) -> DataFrame:
    return kpi.cases_per_company(cases(t)).withColumnRenamed("cases", "n")


@check("sort_page", f"with {_E} select id, risk from e order by risk desc, id limit 12 offset 24")
def sort_page(t: Tables) -> DataFrame:
    return filters.sort_page(cases(t), "risk_amount", ascending=False, page=3, size=12).select("id", F.col("risk_amount").alias("risk"))


@check("damage_by_cycle", f"""with {_D} select cycle, shift, cast(sum(amt) as bigint) as amount, count(*) filter (where not ev) as without_evidence, count(*) filter (where not ev)=0 as closable from dm group by 1, 2""")
def damage_by_cycle(t: Tables) -> DataFrame:
    d = damages(t)
    by = d.groupBy("cycle", "shift").agg(F.sum("amount").alias("amount"))
    return by.join(filters.cycle_closable(d), "cycle").select("cycle", "shift", "amount", "without_evidence", "closable")


@check("damage_top", f"""with {_D} (select 'employee' as dim, emp as name, cast(sum(amt) as bigint) as amount from dm group by emp order by 3 desc, 2 limit 6) union all (select 'cause', cause, cast(sum(amt) as bigint) from dm group by cause order by 3 desc, 2 limit 5)""")
def damage_top(t: Tables) -> DataFrame:
    d = damages(t)
    a = kpi.damage_by(d, "employee", 6).select(F.lit("employee").alias("dim"), F.col("employee").alias("name"), "amount")
    return a.unionByName(kpi.damage_by(d, "cause", 5, positive=True).select(F.lit("cause").alias("dim"), F.col("cause").alias("name"), "amount"))


@check("monthly_trend", f"""with {_D}, m as (select strftime(d,'%Y-%m') as ym, cast(sum(amt) as bigint) as damage, count(*) as cases from dm group by 1), p as (select strftime(cast(o_orderdate as date),'%Y-%m') as ym, count(*) as prevented from orders group by 1)
select m.ym, damage, cases, coalesce(prevented,0) as prevented, round(coalesce((damage - lag(damage) over (order by m.ym))*100.0 / lag(damage) over (order by m.ym), 0), 1) as change from m left join p using (ym)""")
def monthly_trend(t: Tables) -> DataFrame:
    prevented = t.orders.select(F.to_date("o_orderdate").alias("business_date"), F.lit(1).alias("amount"))
    return kpi.monthly_trend(damages(t), prevented).select("ym", "damage", "cases", "prevented", F.col("change_pct").cast("double").alias("change"))


@check("approval_counts", f"with {_E} select count(*) filter (where status='clarifying') as clarifying, count(*) filter (where status='answered') as answered, count(*) filter (where status='damage') as damage, count(*) filter (where status in ('closed','approved')) as closed from e")
def approval_counts(t: Tables) -> DataFrame:
    return kpi.approval_counts(cases(t))


@check("approval_queue", f"with {_E} select id, status from e where status in ('answered','clarifying','damage') order by d, id")
def approval_queue(t: Tables) -> DataFrame:
    return kpi.approval_queue(cases(t)).select("id", "status")


@check("clarify_groups", f"""with {_E}, x as (select *, case when cast(substr(company,2) as int)%3=0 then 'daily' else 'cycle' end as track from e where status not in ('closed','approved'))
select track, case when track='daily' then shift when day(d)<=15 then 'C1' when day(d)<=25 then 'C2' else 'C3' end as grp, count(*) as cases, cast(sum(risk) as bigint) as risk, count(*) filter (where sev='critical') as critical, count(*) filter (where sev='high') as high from x group by 1, 2""")
def clarify_groups(t: Tables) -> DataFrame:
    systems = cases(t).select("company").distinct().filter("cast(substring(company, 2) as int) % 2 = 0 or cast(substring(company, 2) as int) % 3 = 0").select(
        "company", F.lit("S").alias("system"), F.when(F.substring("company", 2, 9).cast("int") % 3 == 0, "daily").otherwise("cycle").alias("track"))
    g = kpi.clarify_groups(kpi.with_track(cases(t), systems))
    return g.select("track", F.col("group_key").alias("grp"), "cases", F.col("risk_amount").alias("risk"), "critical", "high")


@check("request_totals", f"with {_E} select 'REQ-'||company as doc_no, count(*) as items, cast(sum(risk) as bigint) as total from e group by 1")
def request_totals(t: Tables) -> DataFrame:
    items = cases(t).withColumn("doc_no", F.concat(F.lit("REQ-"), "company"))
    return kpi.request_totals(items).select("doc_no", F.col("item_count").alias("items"), F.col("total_amount").alias("total"))


@check("shift_share", f"""with {_E} select strftime(d,'%Y-%m-%d') as day, shift, count(*) as n, round(count(*)*100.0/sum(count(*)) over (partition by d), 1) as share, count(*) filter (where sev='critical') as critical from e group by d, shift""")
def shift_share(t: Tables) -> DataFrame:
    return kpi.shift_share(cases(t)).select(F.col("date").cast("string").alias("day"), "shift", "n", F.col("share_pct").cast("double").alias("share"), "critical")


@check("sla_breaches", f"with {_E} select sev as severity, count(*) as n, max(age) as oldest from e where over group by 1")
def sla_breaches(t: Tables) -> DataFrame:
    return kpi.sla_breaches(cases(t)).select("severity", "n", F.col("oldest_hours").alias("oldest"))


@check("match_share", """select cast(sum(n) as bigint) as total, cast(sum(m) as bigint) as matched, cast(sum(n)-sum(m) as bigint) as rest, round(sum(m)*100.0/sum(n),2) as pct from (select hour(ts) h, count(*) n, count(*) filter (where event_type<>'error') m from events group by 1)""")
def match_share(t: Tables) -> DataFrame:
    hourly = t.events.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("matched"))
    return kpi.match_share(hourly).select("total", "matched", "rest", F.col("match_pct").cast("double").alias("pct"))


@check("notification_rules", f"""with {_E}, {_D} select 'file_missing' as rule, count(*) as n, cast(0 as bigint) as amount from supplier where s_suppkey%4 in (1,3)
 union all select 'critical_exception', count(*), cast(sum(risk) as bigint) from e where sev='critical' and status not in ('closed','approved') union all select 'sla_breach', count(*), 0 from e where over and status not in ('closed','approved')
 union all select 'cycle_due', (select count(*) from dm where cycle='C2'), 0""")
def notification_rules(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 4
    files = t.supplier.select(F.when(k == 1, "missing").when(k == 3, "wrong_company").otherwise("received").alias("status"))
    cycles = damages(t).select("cycle").distinct().withColumn("status", F.when(F.col("cycle") == "C1", "locked").otherwise("open"))
    n = kpi.notification_rules(files, cases(t), cycles, damages(t))
    return n.select("rule", "n", F.col("amount").cast("bigint").alias("amount"))


@check("intake_status", """select count(*) filter (where s_suppkey%4=0) as received, count(*) filter (where s_suppkey%4=2) as late, count(*) filter (where s_suppkey%4=1) as missing, count(*) filter (where s_suppkey%4=3) as wrong_company, count(*) filter (where s_suppkey%4 in (1,3)) as blocked from supplier""")
def intake_status(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 4
    return kpi.intake_status(t.supplier.select(F.when(k == 0, "received").when(k == 1, "missing").when(k == 2, "late").otherwise("wrong_company").alias("status")))


@check("detection_report", f"with {_E}, f as (select type, count(*) n from e group by 1) select type, n + 40 as injected, n as found, n between (n+40)*0.8 and (n+40)*1.6 as in_band from f")
def detection_report(t: Tables) -> DataFrame:
    c = cases(t)
    injected = c.groupBy("type").agg((F.count(F.lit(1)) + 40).alias("injected"))
    return kpi.detection_report(injected, c).select("type", "injected", "found", "in_band")


@check("daily_report", f"""with {_E}, {_D} select (select count(*) from events) as total, (select count(*) from events where event_type<>'error') as matched, (select count(*) from events where event_type='error') as exceptions,
 (select count(*) from supplier where s_suppkey%4<>0) as problem_files, (select count(*) from e where over) as over_sla, (select cast(sum(amt) as bigint) from dm) as damage""")
def daily_report(t: Tables) -> DataFrame:
    error = F.col("event_type") == "error"
    hourly = t.events.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("total"), F.count_if(~error).alias("matched"), F.count_if(error).alias("exceptions"))
    files = t.supplier.select(F.when(F.col("s_suppkey") % 4 == 0, "received").otherwise("late").alias("status"))
    return kpi.daily_report(hourly, files, cases(t), damages(t))


@check("case_overlay", f"""with {_E}, o as (select l_orderkey as id, max(strftime(l_shipdate,'%Y-%m-%d')||lpad(cast(l_linenumber as varchar),2,'0')||lpad(cast(l_partkey as varchar),9,'0')) as k from lineitem group by 1)
select e.id, case when o.k is null then status when cast(substr(o.k,11,2) as int)%2=0 then 'closed' else 'answered' end as status, coalesce(cast(substr(o.k,11,2) as int)%3=0, false) as evidence from e left join o using (id)""")
def case_overlay(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    at = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lpad(n.cast("string"), 2, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    ev = t.lineitem.select(F.col("l_orderkey").alias("id"), at.alias("at"), F.when(n % 2 == 0, "closed").otherwise("answered").alias("status"), (n % 3 == 0).alias("has_evidence"), F.array(F.lit("n")).alias("notes"))
    return kpi.case_overlay(cases(t), ev).select("id", "status", F.col("has_evidence").alias("evidence"))


@check("three_point_check", f"""with {_E} select id, 1 + cast(age <= case when id%2=0 then 90 else 180 end as int) + cast(id%3<>0 and abs(id%5-2) < 1 as int) + cast(type not in ('missing_bo','missing_stm','duplicate') as int) as score,
 case type when 'amount_diff' then format('{{:,.2f}}', (id%5-2)*1.0) when 'time_diff' then age||' วิ' when 'missing_bo' then 'ไม่พบใน BO' when 'missing_stm' then 'ไม่พบใน STM' else 'ซ้ำ '||format('{{:,.2f}}', risk*1.0) end as label,
 '******'||right(account,4) as masked from e""")
def three_point_check(t: Tables) -> DataFrame:
    k = F.col("id")
    c = cases(t).withColumn("time_diff_sec", F.col("age_hours")).withColumn("amount_diff", (k % 5 - 2)).withColumn("system_amount", F.lit(1)).withColumn("bank_amount", F.when(k % 3 != 0, 1))
    return filters.three_point_check(c).select("id", F.col("score").cast("int").alias("score"), filters.diff_label().alias("label"), filters.mask_account("account", F.lit(True)).alias("masked"))


@check("close_checklist", f"with {_E} select id, id%2=0 and id%5<>0 and status in ('damage','approved','closed') as ready from e")
def close_checklist(t: Tables) -> DataFrame:
    k = F.col("id")
    c = cases(t).withColumn("has_evidence", k % 2 == 0).withColumn("notes", F.when(k % 5 != 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")))
    return filters.close_checklist(c).select("id", "ready")


@check("live_exceptions", f"""with {_E} select id, case when id%9=0 then 'medium' else sev end as severity, greatest(0, cast(floor((epoch(timestamp '1998-12-31 12:00:00') - epoch(cast(d as timestamp)))/3600) as bigint)) as age, '-' as bank from e""")
def live_exceptions(t: Tables) -> DataFrame:
    k = F.col("id")
    c = cases(t)
    raw = c.select("id", F.lit(None).cast("string").alias("code"), F.lit("r").alias("run_id"), F.col("date").alias("business_date"), F.lit("10:00:00").alias("occurred_at"), "company", F.lit("").alias("bank"), "account",
                   F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("member_code"), F.col("type").alias("ex_type"), F.lit(None).cast("string").alias("type_name"),
                   F.when(k % 9 != 0, F.col("severity")).alias("severity"), "status", F.lit(1).alias("system_amount"), F.lit(1).alias("bank_amount"), F.lit(None).cast("int").alias("amount_diff"), "risk_amount",
                   F.lit(None).cast("int").alias("time_diff_sec"), "employee", "shift", "cause", F.col("date").cast("timestamp").alias("created_at"))
    v = filters.live_exception_view(raw, F.lit("1998-12-31 12:00:00").cast("timestamp"))
    return v.select(F.col("id").cast("bigint").alias("id"), "severity", F.col("age_hours").alias("age"), "bank")


@check("audit_log_range", """select cast(l_shipdate as date)::varchar as day, count(*) as n from lineitem where cast(l_shipdate as date) between date '1997-03-01' and date '1997-04-30' group by 1""")
def audit_log_range(t: Tables) -> DataFrame:
    log = kpi.audit_log_range(t.lineitem.withColumn("at", F.col("l_shipdate")), "1997-03-01", "1997-04-30")
    return log.groupBy(F.to_date("at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@check("retention", """select count(*) as n from orders where cast(o_orderdate as date) >= date '1997-06-30'""")
def retention(t: Tables) -> DataFrame:
    kept = filters.retention_filter(t.orders.withColumn("business_date", F.to_date("o_orderdate")), F.lit("1998-06-30").cast("date"), 12)
    return kept.agg(F.count(F.lit(1)).alias("n"))


@check("seen_values", """select distinct 'C'||(o_custkey%12) as code, cast(o_custkey%12 < 5 as boolean) as configured from orders""")
def seen_values(t: Tables) -> DataFrame:
    seen = cases(t).select(F.col("company").alias("code"), F.col("company").alias("name"))
    configured = seen.distinct().filter("cast(substring(code, 2) as int) < 5")
    return filters.seen_values(configured, seen).select("code", "configured")


@check("companies_without_system", "select distinct 'C'||(o_custkey%12) as company from orders where o_custkey%12 >= 5")
def companies_without_system(t: Tables) -> DataFrame:
    systems = cases(t).select("company").distinct().select("company", F.when(F.substring("company", 2, 9).cast("int") < 5, "S").alias("system"))
    return filters.companies_without_system(cases(t), systems)


@check("damage_register", f"with {_E} select 'DMG-'||id as id, cast(risk as bigint) as amount, case when day(d)<=15 then 'C1' when day(d)<=25 then 'C2' else 'C3' end as cycle from e where status='damage' union all select 'X-'||s_suppkey, 1, 'C1' from supplier")
def damage_register(t: Tables) -> DataFrame:
    base = kpi.damages_from_cases(cases(t).withColumn("amount_diff", F.lit(0)).withColumn("has_evidence", F.lit(True))).select("id", "amount", "cycle")
    extra = t.supplier.select(F.concat(F.lit("X-"), "s_suppkey").alias("id"), F.lit(1).cast("bigint").alias("amount"), F.lit("C1").alias("cycle"))
    return kpi.extra_damages(base, extra.unionByName(base))


