"""Intake, completeness, job state and run views on orders (mails), lineitem (files), customer and nation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions import scalars as S
from ledgerline.operators import filters, jobs, paging
from ledgerline.queries.base import Tables, check
from ledgerline.settings import Settings

DAY = "strftime(bd,'%Y-%m-%d') as day"
_B = """b as (select o_orderkey as id, date_trunc('month', cast(o_orderdate as date)) as bd, n_name as company, case when n_nationkey%3=0 then null when n_nationkey%3=1 then 'SYS123' else 'XXX' end as sys,
 cast(o_orderdate as timestamp) + to_hours(o_orderkey%24) as received from orders join customer on c_custkey=o_custkey join nation on n_nationkey=c_nationkey)"""
_F = """f as (select l_orderkey as batch_id, l_linenumber, l_partkey, case l_linenumber%5 when 0 then 'stm.pdf' when 1 then 'รายงานบัญชีฝาก.xlsx' when 2 then 'x ATP.csv' when 3 then 'ชี้แจง.docx' else 'note.txt' end as name,
 case when l_linenumber%5=3 then 'doc_clarify' else 'unknown' end as kind, l_returnflag='R' as parsed, l_returnflag='A' as failed from lineitem)"""
_K = "case l_linenumber%5 when 0 then 'stm_pdf' when 1 then 'bo_main' when 2 then 'pm_statement' when 3 then 'doc_clarify' else 'unknown' end"


def mail_rows(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name")
    c = t.customer.select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("n_nationkey") % 3
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.trunc("o_orderdate", "month").alias("business_date"), F.col("n_name").alias("company"),
        F.when(k == 1, "SYS123").when(k == 2, "XXX").alias("business_system"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.col("o_orderkey").cast("int") % 24)).alias("received_at"))


def file_rows(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 5
    name = S.case_of([(k == 0, "stm.pdf"), (k == 1, "รายงานบัญชีฝาก.xlsx"), (k == 2, "x ATP.csv"), (k == 3, "ชี้แจง.docx")], F.lit("note.txt"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("batch_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), name.alias("file_name"),
        F.when(k == 3, "doc_clarify").otherwise("unknown").alias("kind"), (F.col("l_returnflag") == "R").alias("parsed"), F.lit(None).cast("string").alias("company"),
        F.when(F.col("l_returnflag") == "A", "bad").alias("parse_error"), F.xxhash64("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("path_no"))


def rule_rows(t: Tables) -> DataFrame:
    """The default rule and one of its own for every fifth nation."""
    groups = lambda *g: F.array(*[F.array(*[F.lit(k) for k in x]) for x in g])
    own = t.nation.filter("n_nationkey % 5 = 0").select(F.col("n_name").alias("company"), groups(["stm_pdf", "pm_statement"], ["bo_main"]).alias("required_groups"))
    default = t.spark.range(1).select(F.lit("*").alias("company"), groups(["stm_pdf"], ["bo_main"]).alias("required_groups"))
    return own.unionByName(default).select("*", F.lit("10:00:00").alias("close_time"), F.lit(1).alias("close_day_offset"), F.lit(True).alias("active"))


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("business_date", "yyyy-MM-dd"))


_C = f"""{_B}, {_F}, comp as (select bd, company, count(distinct b.id) mails, count(*) files, count(*) filter (where parsed) parsed, count(*) filter (where failed) errors, max(sys) sys,
 list_sort(list(distinct {_K})) kinds, max(cast(n_own as int)) own from b join f on f.batch_id=b.id join (select n_name, n_nationkey%5=0 as n_own from nation) on n_name=company group by bd, company),
miss as (select *, case when own=1 and not (list_contains(kinds,'stm_pdf') or list_contains(kinds,'pm_statement')) then 'stm_pdf / pm_statement' when own=0 and not list_contains(kinds,'stm_pdf') then 'stm_pdf' end as m1,
 case when not list_contains(kinds,'bo_main') then 'bo_main' end as m2 from comp)"""


COMPLETENESS_SQL = f"with {_C} select {DAY}, company, mails, files, parsed, errors, sys as system, array_to_string(kinds, ',') as kinds from comp"


@check("job_completeness", COMPLETENESS_SQL)
def job_completeness(t: Tables) -> DataFrame:
    return completeness_rows(jobs.job_completeness(mail_rows(t), file_rows(t)))


def completeness_rows(j: DataFrame) -> DataFrame:
    return _day(j).select("day", "company", F.col("mail_count").alias("mails"), F.col("file_count").alias("files"), F.col("parsed_count").alias("parsed"), F.col("error_count").alias("errors"),
                          F.col("business_system").alias("system"), F.array_join("present_kinds", ",").alias("kinds"))


@check("missing_groups", f"with {_C} select {DAY}, company, concat_ws(', ', m1, m2) as missing from miss")
def missing(t: Tables) -> DataFrame:
    j = jobs.missing_groups(jobs.with_requirement(jobs.job_completeness(mail_rows(t), file_rows(t)), rule_rows(t)))
    return _day(j).select("day", "company", jobs.missing_text("missing_groups").alias("missing"))


_BEFORE = _C.replace("b join f on f.batch_id=b.id join", "b join f on f.batch_id=b.id and b.id % 997 <> 5 join").replace("comp as", "comp0 as").replace("miss as", "miss0 as").replace("from comp)", "from comp0)")
#: Jobs complete without the files of every 997th mail whose number of files is another with them.
LATE_SQL = f"""with {_C}, {_BEFORE[_BEFORE.index("comp0 as"):]}
select strftime(n.bd,'%Y-%m-%d') as day, n.company, 'ready' as status, n.files from miss n join miss0 o on o.bd = n.bd and o.company = n.company where o.m1 is null and o.m2 is null and o.files <> n.files"""
_OLD = """old as (select *, cast(month(bd)%6 as int) as k, files - month(bd)%2 as of, month(bd)%6=2 as olate from miss),
st as (select *, k=1 as run, k in (2,3) as com, k=4 as err, month(bd)%2=0 as same, m1 is null and m2 is null as full_ from old where k<>0 union all
 select *, false, false, false, false, m1 is null and m2 is null from old where k=0),
st2 as (select *, case when run then 'running' when full_ and com and same then 'completed' when full_ and err and same then 'error' when full_ then 'ready' else 'waiting_files' end as s0,
 coalesce(olate and k<>0, false) or (full_ and com and not same) as late from st)"""


def _state(t: Tables) -> DataFrame:
    """Previous snapshot: running, completed, failed three times or absent by month; every other month had one file less."""
    j = jobs.missing_groups(jobs.with_requirement(jobs.job_completeness(mail_rows(t), file_rows(t)), rule_rows(t)))
    k = F.month("business_date") % 6
    old = j.filter(k != 0).select("business_date", "company", S.case_of([(k == 1, "running"), (k == 2, "completed"), (k == 3, "completed"), (k == 4, "error")], F.lit("ready")).alias("status"),
                                  (F.col("file_count") - F.month("business_date") % 2).alias("file_count"), F.lit(3).alias("attempt_count"), (k == 2).alias("late_file"))
    return jobs.job_status(j, old, F.lit("1998-06-15 00:00:00").cast("timestamp"), Settings())


@check("job_status", f"""with {_C}, {_OLD} select {DAY}, company, case when s0='waiting_files' and cast(bd as timestamp) + interval 1 day + interval 3 hour <= timestamp '1998-06-15 00:00:00' then 'needs_review' else s0 end as status,
 late, cast(case when k<>0 and same then 3 else 0 end as bigint) as attempts from st2""")
def job_status(t: Tables) -> DataFrame:
    return _day(_state(t)).select("day", "company", "status", F.col("late_file").alias("late"), F.col("attempt_count").cast("bigint").alias("attempts"))


@check("job_alerts", f"""with {_C}, {_OLD}, x as (select *, case when s0='waiting_files' and cast(bd as timestamp) + interval 27 hour <= timestamp '1998-06-15 00:00:00' then 'needs_review' else s0 end as status from st2 where month(bd)%4<>0)
select 'missing' as kind, count(*) as n from x where status='needs_review' having count(*) > 0 union all select 'retry-exhausted', count(*) from x where status='error' having count(*) > 0
union all select 'late', count(*) from x where late having count(*) > 0""")
def job_alerts(t: Tables) -> DataFrame:
    """Alerts of every fourth month were sent before; each alert is raised twice."""
    a = jobs.alerts(_state(t))
    sent = a.filter(F.month("business_date") % 4 == 0).select("dedupe_key")
    return jobs.notify_once(a.unionByName(a), sent).groupBy(F.substring_index("dedupe_key", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@check("daily_status", f"""with {_B}, {_F} select {DAY}, company, count(distinct b.id) as mails, count(f.batch_id) as files, count(*) filter (where parsed) as parsed, count(*) filter (where failed) as errors,
 strftime(max(received),'%Y-%m-%d %H:%M:%S') as last_mail from b left join f on f.batch_id=b.id group by bd, company""")
def daily_status(t: Tables) -> DataFrame:
    d = jobs.daily_status_files(mail_rows(t), file_rows(t))
    return _day(d).select("day", "company", F.col("mail_count").alias("mails"), F.col("file_count").alias("files"), F.col("parsed_count").alias("parsed"), F.col("error_count").alias("errors"),
                          F.date_format("last_mail_at", "yyyy-MM-dd HH:mm:ss").alias("last_mail"))


_R = """r as (select l_orderkey*10+l_linenumber as id, l_orderkey, l_linenumber, l_partkey, date_trunc('month', cast(l_shipdate as date)) as bd, cast(l_quantity as bigint) as stm, l_suppkey as matched,
 case when l_discount < 0.02 then 0 else cast(round(l_discount*1000) as bigint) end as rate, l_linenumber as exc, cast(l_shipdate as timestamp) as tat from lineitem)"""


def _runs(t: Tables) -> DataFrame:
    rate = F.when(F.col("l_discount") < 0.02, 0).otherwise(F.round(F.col("l_discount") * 1000))
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.trunc("l_shipdate", "month").alias("business_date"), F.col("l_quantity").cast("bigint").alias("stm_count"),
        F.col("l_suppkey").alias("matched"), rate.cast("decimal(9,3)").alias("match_rate"), F.col("l_linenumber").cast("bigint").alias("exception_count"), F.lit(5).alias("elapsed_ms"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"), F.col("l_partkey").alias("bo_count"),
        F.to_json(F.struct(F.col("l_orderkey").alias("job_id"))).alias("summary"), F.array(F.col("l_partkey")).alias("file_ids"))


@check("daily_status_runs", f"""with {_R}, fi as (select date_trunc('month', cast(o_orderdate as date)) as bd, count(*) n, count(*) filter (where o_orderstatus='F') p from orders group by 1)
select strftime(r.bd,'%Y-%m-%d') as day, count(distinct l_orderkey||'-'||l_linenumber||'-'||l_partkey) as runs, cast(sum(stm) as bigint) as stm, cast(sum(matched) as bigint) as matched, round(avg(nullif(rate,0)),3) as rate,
 coalesce(any_value(n),0) as received, coalesce(any_value(p),0) as parsed from r left join fi using (bd) group by r.bd""")
def daily_status_runs(t: Tables) -> DataFrame:
    files = t.orders.select(F.trunc("o_orderdate", "month").alias("business_date"), (F.col("o_orderstatus") == "F").alias("parsed"))
    d = jobs.daily_status_runs(_runs(t), files)
    return _day(d).select("day", "runs", F.col("stm_count").alias("stm"), "matched", F.col("avg_match_rate").cast("double").alias("rate"), F.col("files_received").alias("received"), F.col("files_parsed").alias("parsed"))


def _jobs(t: Tables) -> DataFrame:
    """Orders as jobs whose last run is line 1 of the order (the part with the smallest key)."""
    first = t.lineitem.filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.concat_ws("-", "l_orderkey", F.lit("1"), F.min("l_partkey")).alias("last_run_id"))
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("business_date"), F.concat(F.lit("C"), F.col("o_custkey") % 30).alias("company"),
                        F.when(F.col("o_custkey") % 2 == 0, "SYS123").alias("business_system"),
                        S.case_of([(F.col("o_orderstatus") == "F", "completed"), (F.col("o_orderstatus") == "O", "running")], F.lit("needs_review")).alias("status"),
                        F.col("o_orderdate").cast("timestamp").alias("claimed_at"), (F.col("o_orderkey") % 4).alias("error_count"), (F.col("o_orderkey") % 9).alias("file_count"),
                        F.array(F.when(F.col("o_orderkey") % 3 == 0, "stm_pdf").when(F.col("o_orderkey") % 3 == 1, "bo_main").otherwise("manual_credit")).alias("present_kinds"))
    return o.join(first, o["id"] == first["l_orderkey"], "left").drop("l_orderkey")


_J = """j as (select o_orderkey as id, cast(o_orderdate as date) as bd, 'C'||(o_custkey%30) as company, case when o_custkey%2=0 then 'SYS123' end as sys,
 case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'needs_review' end as status, cast(o_orderdate as timestamp) as claimed, lp as part, o_orderkey%4 as errs, o_orderkey%9 as files,
 case o_orderkey%3 when 0 then 'stm_pdf' when 1 then 'bo_main' else 'manual_credit' end as kind
 from orders left join (select l_orderkey, min(l_partkey) as lp from lineitem where l_linenumber=1 group by 1) on l_orderkey=o_orderkey)"""


@check("recon_operations", f"""with {_J}, u as (select l_orderkey as id, count(*) filter (where l_returnflag='N') as n from lineitem group by 1)
select j.id, status, (select min(l_suppkey) from lineitem l where l.l_orderkey=j.id and l.l_linenumber=1 and l.l_partkey=j.part) as matched, coalesce(u.n,0) as unread from j left join u on u.id=j.id""")
def recon_operations(t: Tables) -> DataFrame:
    notes = t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("read_at"))
    runs = _runs(t).groupBy("id").agg(*[F.min(c).alias(c) for c in ("match_rate", "matched", "exception_count", "elapsed_ms")])
    return jobs.recon_operations(_jobs(t), runs, notes).select("id", "status", "matched", F.col("unread_notification_count").alias("unread"))


@check("recon_quality", f"""with {_J} select id, status, part is not null as has_run, (select min(l_suppkey) from lineitem l where l.l_orderkey=j.id and l.l_linenumber=1 and l.l_partkey=j.part) as matched from j""")
def recon_quality(t: Tables) -> DataFrame:
    runs = _runs(t).groupBy("id").agg(*[F.min(c).alias(c) for c in ("created_at", "stm_count", "bo_count", "matched", "match_rate", "exception_count", "summary")])
    return jobs.recon_quality(_jobs(t), runs).select("id", "status", F.col("run_id").isNotNull().alias("has_run"), "matched")


@check("current_exceptions", f"""with {_J} select l_orderkey as ord, count(*) as n from lineitem l join j on j.id=l_orderkey where status='completed' and l_linenumber=1 and l_partkey=part group by 1""")
def current_exceptions(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("run_id"), F.col("l_orderkey").alias("ord"))
    return jobs.current_exceptions(_jobs(t), e).groupBy("ord").agg(F.count(F.lit(1)).alias("n"))


@check("latest_run", f"""with {_J}, {_R}, m as (select j.id, r.tat, l_orderkey||'-'||l_linenumber||'-'||l_partkey as rid from j join r on r.l_orderkey=j.id where status='running' and r.tat >= claimed)
select id as job, max(strftime(tat,'%Y-%m-%d')||'|'||rid) as run from m group by id""")
def latest_run(t: Tables) -> DataFrame:
    r = jobs.latest_run_per_job(_jobs(t), _runs(t))
    return r.select(F.col("job_id").cast("bigint").alias("job"), F.concat_ws("|", F.date_format("created_at", "yyyy-MM-dd"), "run_id").alias("run"))


@check("finished_files", f"""with {_J}, {_R}, m as (select j.id, r.tat, l_orderkey||'-'||l_linenumber||'-'||l_partkey as rid, l_partkey from j join r on r.l_orderkey=j.id where status='running' and r.tat >= claimed),
d as (select distinct arg_max(l_partkey, strftime(tat,'%Y-%m-%d')||'|'||rid) as p from m group by id) select p_partkey as id, p_size%2=0 or p_partkey in (select p from d) as parsed from part""")
def finished_files(t: Tables) -> DataFrame:
    files = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("parsed"), F.lit("e").alias("parse_error"))
    return jobs.mark_run_files(files, jobs.latest_run_per_job(_jobs(t), _runs(t))).select("id", "parsed")


@check("mark_files", """select p_partkey as id, case when n is null then p_size%2=0 else not bad end as parsed, coalesce(n, -1) as rows, case when n is not null and bad then 'e' when n is null then 'old' end as error
from part left join (select l_partkey, count(*) n, max(l_tax) > 0.07 bad from lineitem group by 1) on l_partkey=p_partkey""")
def mark_files(t: Tables) -> DataFrame:
    files = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("parsed"), F.lit(-1).cast("bigint").alias("row_count"), F.lit("old").alias("parse_error"))
    res = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("rows"), F.when(F.max("l_tax") > 0.07, "e").alias("error"))
    return jobs.mark_files(files, res).select("id", "parsed", F.col("row_count").alias("rows"), F.col("parse_error").alias("error"))


@check("notification_totals", f"with {_J} select id, (select count(*) from orders) as mails, (select count(*) from lineitem) as files from j")
def notification_totals(t: Tables) -> DataFrame:
    return jobs.notification_totals(_jobs(t), t.orders, t.lineitem).select("id", F.col("actual_mail_total").alias("mails"), F.col("actual_file_total").alias("files"))


@check("live_overview", f"""with {_J} select count(*) filter (where status='completed') as completed, count(*) filter (where status='needs_review') as needs_review, cast(0 as bigint) as waiting,
 count(*) filter (where errs > 0) as failed, (select count(*) from orders) as mails, (select cast(sum(o_custkey%5) as bigint) from orders) as files, (select cast(sum(cast(round(l_extendedprice*100) as bigint)) as bigint) from lineitem) as risk from j""")
def live_overview(t: Tables) -> DataFrame:
    daily = t.orders.select(F.lit(1).alias("mail_count"), (F.col("o_custkey") % 5).alias("file_count"), F.lit(0).alias("parsed_count"))
    ex = t.lineitem.select(F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("risk_amount"))
    o = jobs.live_overview(daily, _jobs(t), ex)
    return o.select("completed", "needs_review", "waiting", "failed", F.col("total_mail").alias("mails"), F.col("total_files").alias("files"), "risk")


@check("company_overview", f"""with {_J} select company, coalesce(sys,'{fixed.NO_SYSTEM}') as system, count(*) filter (where status='completed') as completed, count(*) filter (where status<>'completed') as review,
 cast(sum(files) as bigint) as files, strftime(max(bd),'%Y-%m-%d') as latest, array_to_string(list_sort(list(distinct kind)), ',') as kinds from j group by 1, 2""")
def company_overview(t: Tables) -> DataFrame:
    q = _jobs(t)
    ops = q.groupBy("business_date", "company", "business_system").agg(F.array_distinct(F.flatten(F.collect_set("present_kinds"))).alias("present_kinds"))
    c = jobs.company_overview(q.drop("present_kinds"), ops)
    return c.select("company", "system", "completed", "review", "files", F.col("latest").cast("string").alias("latest"), F.array_join("kinds", ",").alias("kinds"))


@check("work_mix", f"""with {_J}, g as (select * from (values ('STM / ฝาก-ถอนธนาคาร','stm_pdf'),('รายงาน BO','bo_main'),('PM / Payment','pm_statement'),('Manual / รายการพิเศษ','manual_credit'),('ชี้แจง / ยังจำแนกไม่ได้','unknown')) v(label,kind))
select label, (select count(*) from j where j.kind=g.kind) as jobs from g""")
def work_mix(t: Tables) -> DataFrame:
    return jobs.work_mix(_jobs(t))


@check("digest_hourly", f"""with {_J}, m as (select id from j where status='needs_review'), f as (select id from j where status='error')
select 'completed' as part, cast(null as bigint) as id, count(*) filter (where status='completed') as n from j union all select 'running', null, count(*) filter (where status='running') from j
union all select 'missing', id, 1 from m union all select 'failed', id, 1 from f""")
def digest_hourly(t: Tables) -> DataFrame:
    j = _jobs(t).withColumn("updated_at", F.col("claimed_at")).withColumn("actual_file_total", F.lit(10).cast("bigint"))
    d = jobs.digest_hourly(j, F.lit("1998-01-01").cast("timestamp"), 4)
    count = lambda s: d["counts"].select(F.lit(s).alias("part"), F.lit(None).cast("bigint").alias("id"), F.col(s).alias("n"))
    rows = lambda part: d[part].select(F.lit(part).alias("part"), F.col("id").cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("n"))
    return count("completed").unionByName(count("running")).unionByName(rows("missing")).unionByName(rows("failed"))


@check("digest_daily", f"""with {_J} select count(*) filter (where status='completed') as completed, count(*) filter (where status='needs_review') as review, cast(sum(errs) as bigint) as parse_errors,
 (select count(*) from orders where cast(cast(o_orderdate as timestamp) + to_hours(o_orderkey%24) + interval 7 hour as date) = date '1997-05-28') as mails from j""")
def digest_daily(t: Tables) -> DataFrame:
    mails = t.orders.select((F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.col("o_orderkey").cast("int") % 24)).alias("created_at"), F.lit(1).alias("file_count"))
    d = jobs.digest_daily(mails, _jobs(t), F.lit("1997-05-28").cast("date"))
    return d.select("completed", F.col("needs_review").alias("review"), "parse_errors", "mails")


@check("storage_status", f"""with {_F} select count(*) as total, count(*) filter (where l_linenumber%5<>3) as readable, count(*) filter (where parsed) as parsed, count(*) filter (where failed) as failed from f""")
def storage_status(t: Tables) -> DataFrame:
    return jobs.storage_file_status(file_rows(t)).select("total", "readable", "parsed", "failed")


@check("upsert_latest", """select l_orderkey as key, max(strftime(l_shipdate,'%Y-%m-%d')) as latest from lineitem group by 1""")
def upsert_latest(t: Tables) -> DataFrame:
    li = t.lineitem.select(F.col("l_orderkey").alias("key"), "l_shipdate", "l_returnflag")
    u = jobs.upsert_latest(li.filter("l_returnflag <> 'R'"), li.filter("l_returnflag = 'R'"), ["key"], "l_shipdate")
    return u.select("key", F.date_format("l_shipdate", "yyyy-MM-dd").alias("latest"))


@check("mail_sources", """select o_orderkey as id, 'user'||(o_custkey%50)||'@mail.test' as email, case when o_custkey%50 < 40 then 'Name'||(o_custkey%50) end as source_name,
 case when o_orderkey%3=0 then 'SYS123' when o_orderkey%3=1 then 'XXX' when o_custkey%50 < 40 and o_custkey%50%2=0 then 'SINGLE' end as system,
 case when o_orderkey%3=0 then 'AT4' when o_orderkey%3=1 then '3XB' when o_orderkey%2=0 then 'KEEP' when o_custkey%50 < 40 and o_custkey%50%2=0 then 'SINGLE' end as company from orders""")
def mail_sources(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 50
    m = t.orders.select(k.alias("id"), F.lit(None).cast("string").alias("source_email"), F.concat(F.lit("A <User"), c, F.lit("@Mail.test>")).alias("sender"),
                        S.case_of([(k % 3 == 0, "ส่ง AT4"), (k % 3 == 1, "ส่ง 3XB")], F.lit("ส่งไฟล์")).alias("subject"), F.lit(None).cast("string").alias("source_name"),
                        F.lit(None).cast("string").alias("business_system"), F.when((k % 3 == 2) & (k % 2 == 0), "KEEP").otherwise("STM").alias("company"))
    s = t.customer.filter("c_custkey < 40").select(F.concat(F.lit("user"), "c_custkey", F.lit("@mail.test")).alias("email"), F.concat(F.lit("Name"), "c_custkey").alias("display_name"),
                                                   F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("SINGLE"))).otherwise(F.array(F.lit("A"), F.lit("B"))).alias("business_systems"), F.lit(True).alias("active"))
    return jobs.normalize_mail_source(m, s).select("id", F.col("source_email").alias("email"), "source_name", F.col("business_system").alias("system"), "company")


@check("batch_listing", """select o_orderkey as batch, l_linenumber as line, l_partkey as part from (select * from orders order by o_orderdate desc, o_orderkey limit 50 offset 50) left join lineitem on l_orderkey=o_orderkey""")
def batch_listing(t: Tables) -> DataFrame:
    b = t.orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("business_date"), F.lit("C").alias("company"), F.col("o_orderdate").alias("received_at"), F.lit("new").alias("status"))
    f = t.lineitem.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("id"))
    out = jobs.batch_listing(b, f, page=1, size=50)
    return out.select(F.col("batch_id").alias("batch"), "line", F.col("file_id").alias("part"))


@check("rate_revisions", """with l as (select *, lag(l_quantity) over w as prior from lineitem window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice))
select l_suppkey as rate_key, count(*) as changes, cast(sum(prior) as bigint) as prior_sum from l where prior is not null and prior <> l_quantity group by 1""")
def rate_revisions(t: Tables) -> DataFrame:
    from ledgerline.operators.ranking import row_number_blocked
    li = row_number_blocked(t.lineitem, [], F.shiftright("l_orderkey", 10), ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "seq")
    log = li.select(F.col("l_suppkey").alias("rate_date"), "seq", F.col("l_quantity").alias("rate"), F.lit("n").alias("note"), F.lit("x").alias("by"), F.col("l_shipdate").alias("at"))
    return jobs.rate_revisions(log).groupBy(F.col("rate_date").alias("rate_key")).agg(F.count(F.lit(1)).alias("changes"), F.sum("prior.rate").cast("bigint").alias("prior_sum"))


@check("middle_date", """with d as (select distinct cast(ts as date) d from events), l as (select list_sort(list(d)) x from d) select strftime(x[1],'%Y-%m-%d') as first, strftime(x[len(x)],'%Y-%m-%d') as last, strftime(x[len(x)//2+1],'%Y-%m-%d') as middle from l""")
def middle_date(t: Tables) -> DataFrame:
    m = filters.middle_date(t.events.select(F.to_date("ts").alias("date")))
    return m.select(*[F.col(c).cast("string").alias(c) for c in ("first", "last", "middle")])


@check("deep_pages", """with r as (select *, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 as k from lineitem), n as (select count(*) as n from lineitem)
select l_orderkey as id, l_linenumber as line, l_partkey as part, k // 12 as page from r, n where k // 12 in (0, 7, n // 24, (n - 1) // 12)""")
def deep_pages(t: Tables) -> DataFrame:
    """The first, an early, a middle and the last page of a table in order of price."""
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]]
    table = paging.ranked(t.lineitem, *order, parts=64)
    pages = sorted({0, 7, table.count // 24, max(table.count - 1, 0) // 12})
    out = None
    for k in pages:
        page = table.page(k, 12).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.lit(k).cast("bigint").alias("page"))
        out = page if out is None else out.unionByName(page)
    return out
