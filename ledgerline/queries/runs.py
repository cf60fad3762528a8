"""Whole runs, the tables they leave, and operators that only show within them."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions import text as X
from ledgerline.operators import classify, jobs, rules
from ledgerline.operators.matching import pair_rows, with_job
from ledgerline.plans.reconcile import reconcile
from ledgerline.queries.base import SQL, Tables, check
from ledgerline.queries.kpis import cases, damages
from ledgerline.queries.rules import CENTS, _bo_orders, _commissions, _cuts
from ledgerline.queries.sides import bo_side, greedy_sql, stm_side
from ledgerline.schema import TXN, conform
from ledgerline.session import staging_path
from ledgerline.settings import Settings
from ledgerline.sources import rows as R
from ledgerline.sources import sinks


@check("csv_rows", "select doc_id as doc, case when doc_id % 50 = 0 then 302 else 2 end as cells, md5(text) as body from documents where trim(text) <> ''")
def csv_rows(t: Tables) -> DataFrame:
    """Documents as quoted CSV records with their line breaks, every fiftieth with 300 cells more, read back."""
    folder = staging_path(t.spark, "csv")
    wide = F.when(F.col("doc_id") % 50 == 0, F.repeat(F.lit(',"c ""x"", y"'), 300)).otherwise(F.lit(""))
    body = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'), wide)
    t.documents.filter("trim(text) <> ''").select(body.alias("value")).repartition(4).write.text(folder)
    back = R.read_csv_rows(t.spark, folder)
    return back.select(F.get("cells", F.lit(0)).cast("bigint").alias("doc"), F.size("cells").cast("bigint").alias("cells"), F.md5(F.get("cells", F.lit(1))).alias("body"))


def _order_run(t: Tables, threshold: float):
    """A rules-only run: orders as back-office rows of monthly jobs, exceptions for large withdrawals."""
    cfg = Settings(large_threshold=threshold)
    bo = _bo_orders(t).withColumn("date", F.trunc("date", "month")).withColumns({"job_date": F.col("date"), "job_company": F.concat(F.lit("C"), F.col("account").cast("bigint") % 3), "file_id": F.concat(F.lit("f"), F.col("account").cast("bigint") % 3)})
    found = rules.large_amount(bo, cfg)
    return reconcile(conform(bo).limit(0), conform(bo.withColumn("amount_cents", CENTS("amount"))), rule_exceptions=found, cfg=cfg)


@check("run_tables", """with o as (select date_trunc('month', cast(o_orderdate as date)) as d, 'C'||(o_custkey%3) as company, 'f'||(o_custkey%3) as f, o_totalprice >= 400000 and o_orderpriority like '1%' as hit from orders)
select strftime(d,'%Y-%m-%d') as day, company, count(*) filter (where hit) as exceptions, count(*) filter (where hit) as listed, count(*) as waiting, any_value(f) as files, true as rules_only, cast(7 as bigint) as elapsed from o group by d, company""")
def run_tables(t: Tables) -> DataFrame:
    """Write a run, then a rerun with fewer exceptions, and read both tables through the views of running and completed jobs."""
    folder = staging_path(t.spark, "runs")
    first = dt.datetime(2026, 8, 1, 12)
    sinks.write_run(_order_run(t, 100000), folder, created_at=first)
    sinks.write_run(_order_run(t, 400000), folder, created_at=first + dt.timedelta(hours=1), elapsed_ms=7)
    runs, found = t.spark.read.parquet(f"{folder}/runs"), t.spark.read.parquet(f"{folder}/exceptions")
    known = runs.select("business_date", "company").distinct().withColumn("id", F.concat_ws("/", F.col("business_date").cast("string"), "company"))
    latest = jobs.latest_run_per_job(known.withColumns({"status": F.lit("running"), "claimed_at": F.lit(first).cast("timestamp")}), runs)
    done = known.join(latest.select(F.col("job_id").alias("id"), F.col("run_id").alias("last_run_id"), "file_ids"), "id").withColumn("status", F.lit("completed"))
    live = jobs.current_exceptions(done, found).groupBy("run_id").agg(F.count(F.lit(1)).alias("listed"))
    out = done.join(runs.select(F.col("id").alias("last_run_id"), "exception_count", "no_stm_count", "elapsed_ms", "summary"), "last_run_id").join(live, F.col("last_run_id") == F.col("run_id"), "left")
    return out.select(F.col("business_date").cast("string").alias("day"), "company", F.col("exception_count").alias("exceptions"), F.coalesce("listed", F.lit(0)).cast("bigint").alias("listed"),
                      F.col("no_stm_count").alias("waiting"), F.array_join("file_ids", ",").alias("files"), (F.get_json_object("summary", "$.rules_only") == "true").alias("rules_only"), F.col("elapsed_ms").alias("elapsed"))


def _bonuses(t: Tables) -> DataFrame:
    p = F.col("o_totalprice").cast("decimal(16,2)")
    after = p * 2 + 50 + (F.col("o_orderkey") % 7 * 50).cast("decimal(16,2)") / 100
    day = F.to_date("o_orderdate")
    return t.orders.select(day.alias("job_date"), F.lit("ALL").alias("job_company"), day.alias("date"), F.lit(0).alias("sec"), F.col("o_orderkey").alias("seq"), p.alias("before"), p.alias("credit"),
                           F.lit(50).cast("decimal(16,2)").alias("bonus"), after.cast("decimal(16,2)").alias("after"), F.lit("p").alias("promo"), F.lit("x").alias("raw"))


def _rule_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    bo = conform(_bo_orders(t), TXN)
    no_credit = {c: F.lit(None).cast("decimal(16,2)") for c in ("before", "after")}
    return bo, _commissions(t), _cuts(t).withColumns(no_credit), _bonuses(t)


@check("rules_run", f"""select type, count(*) as n, cast(sum(risk) as bigint) as risk from ({SQL["commission_zip"]}) group by 1
union all select 'credit_orphan', count(*), cast(sum(risk) as bigint) from ({SQL["orphan_cuts"]}) having count(*) > 0 union all select 'bonus_math', count(*), cast(sum(risk) as bigint) from ({SQL["bonus_math"]})
union all select 'cross_day', count(*), 0 from ({SQL["cross_day_rule"]}) union all select 'large_amount', count(*), cast(sum(risk) as bigint) from ({SQL["large_amount"]})""")
def rules_run(t: Tables) -> DataFrame:
    return rules.rules_run(*_rule_inputs(t)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(CENTS("risk_amount")).alias("risk"))


@check("rule_input_counts", """with a as (select cast(o_orderdate as date) as d, 0 c, 0 k, 1 b, 1 o from orders union all select date_trunc('month', cast(o_orderdate as date)), 1, 0, 0, 0 from orders
 union all select date_trunc('month', cast(l_shipdate as date)), 0, 1, 0, 0 from lineitem)
select strftime(d,'%Y-%m-%d') as day, cast(sum(c) as bigint) as comm, cast(sum(k) as bigint) as credit_out, cast(sum(b) as bigint) as bonus, cast(sum(o) as bigint) as bo from a group by d""")
def rule_input_counts(t: Tables) -> DataFrame:
    bo, comms, cuts, bonus = _rule_inputs(t)
    return rules.rule_input_counts(bo, comms, cuts, bonus).select(F.col("job_date").cast("string").alias("day"), "comm", "credit_out", "bonus", "bo")


@check("wrong_counterparty", f"""with recursive {greedy_sql(False)}, x as (select s.seq, s.account, s.user_id%3 as sb, b.user_id%2 as bb, lpad(cast(s.seq%997 as varchar),4,'0') as st, lpad(cast(b.seq%997 as varchar),4,'0') as bt
 from p1 join s on s.seq=s_seq join b on b.seq=b_seq)
select seq, case when cast(account as int)%5=0 then 'wrong_account' when sb<>bb then 'wrong_bank' else 'wrong_account' end as type from x where cast(account as int)%5=0 or sb<>bb or st<>bt""")
def wrong_counterparty(t: Tables) -> DataFrame:
    """Accounts divisible by five are missing from the master list; slips name a bank and the last digits of an account."""
    user = lambda n: F.element_at(F.array(*[F.lit(b) for b in ("SCB", "KTB", "BBL")]), (F.regexp_extract("username", r"(\d+)", 1).cast("int") % n) + 1)
    tail = F.lpad((F.col("seq") % 997).cast("string"), 4, "0")
    stm = stm_side(t).withColumn("descr", F.concat(F.lit("ไป "), user(3), F.lit(" X"), tail))
    bo = bo_side(t).withColumn("cust_bank", user(2)).withColumn("cust_account", F.concat(F.lit("99-"), tail))
    known = stm.select("account").distinct().filter("cast(account as int) % 5 <> 0").withColumn("bank", F.lit("SCB"))
    found = classify.wrong_counterparty(stm, bo, with_job(pair_rows(stm, bo)), known)
    return found.select(F.col("stm_seq").alias("seq"), "type")


@check("kind_side", """select page_id as page, case page_id%9 when 0 then 'stm' when 1 then 'stm' when 2 then 'bo' when 3 then 'bo' when 4 then 'bo' when 5 then 'aux' when 6 then 'aux' when 7 then 'aux' else substr(url, 1, 5) end as side from pages""")
def kind_side(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in (*fixed.KIND_SIDE, "unknown")])
    kind = F.element_at(kinds, (F.col("page_id") % 9).cast("int") + 1)
    return t.pages.select(F.col("page_id").alias("page"), X.kind_side(kind, F.substring("url", 1, 5)).alias("side"))


@check("report_files", """select 'exceptions' as name, count(*) as n, cast(sum(round(o_totalprice*100)) as bigint) as total from orders where cast(o_orderdate as date) between date '1995-01-01' and date '1996-12-31'
union all select 'damage', count(*), cast(sum(round(l_extendedprice*100)) as bigint) from lineitem where cast(l_shipdate as date) between date '1995-01-01' and date '1996-12-31'
union all select 'kpi', count(distinct o_custkey%40), cast(sum(round(o_totalprice*100)) as bigint) from orders where cast(o_orderdate as date) between date '1995-01-01' and date '1996-12-31'""")
def report_files(t: Tables) -> DataFrame:
    """The report datasets of a date range as CSV files, read back."""
    empty = lambda ddl: t.spark.createDataFrame([], ddl)
    none = {c: F.lit(None).cast("string") for c in ("time", "member", "detail")} | {c: F.lit(0) for c in ("system_amount", "bank_amount", "amount_diff", "time_diff_sec", "sla_hours")}
    ex = cases(t).withColumns(none)
    lost = damages(t).withColumns({"id": F.monotonically_increasing_id(), "exception_id": F.lit("e"), "company": F.lit("C")})
    staff = ex.filter("date between '1995-01-01' and '1996-12-31'").select("employee").distinct()
    made = sinks.report_tables(ex, lost, staff, empty("matched bigint, total bigint"), empty("ym string, n bigint"), empty("x string"), empty("at timestamp, who string"), "1995-01-01", "1996-12-31")
    folder = staging_path(t.spark, "reports")
    sinks.write_reports({k: made[k] for k in ("exceptions", "damage", "kpi")}, folder)
    out = None
    for name, value in (("exceptions", "risk_amount"), ("damage", "amount"), ("kpi", "risk_amount")):
        back = t.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/reports/{name}")
        row = back.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("bigint")).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@check("report_files_others", """with l as (select *, cast(l_shipdate as date) as d from lineitem), h as (select l_linenumber as hour, count(*) filter (where l_returnflag='R') as matched, count(*) as total from l group by 1),
o as (select strftime(cast(o_orderdate as date), '%Y-%m') as ym, count(*) as n from orders group by 1)
select 'daily' as name, count(*) as n, cast(sum(round(round(matched*100.0/total, 2)*100)) as bigint) as total from h
union all select 'monthly', count(*), cast(sum(n) as bigint) from o where ym between '1995-01' and '1996-12'
union all select 'intake', count(distinct o_orderpriority), count(*) from orders
union all select 'audit', count(*), cast(sum(l_partkey) as bigint) from l where d between date '1995-01-01' and date '1996-12-31'""")
def report_files_others(t: Tables) -> DataFrame:
    """The other four report datasets, each with rows, as CSV files, read back."""
    ex = cases(t).withColumns({c: F.lit(None).cast("string") for c in ("time", "member", "detail")} | {c: F.lit(0) for c in ("system_amount", "bank_amount", "amount_diff", "time_diff_sec", "sla_hours")})
    lost = damages(t).withColumns({"id": F.lit(0), "exception_id": F.lit("e"), "company": F.lit("C")})
    hourly = t.lineitem.groupBy(F.col("l_linenumber").alias("hour")).agg(F.count_if(F.col("l_returnflag") == "R").alias("matched"), F.count(F.lit(1)).alias("total"))
    monthly = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.count(F.lit(1)).alias("n"))
    intake = t.orders.groupBy(F.col("o_orderpriority").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    log = t.lineitem.select(F.col("l_shipdate").cast("timestamp").alias("at"), F.concat(F.lit('a "quoted", '), "l_returnflag").alias("who"), F.col("l_partkey").alias("part"))
    made = sinks.report_tables(ex, lost, ex.select("employee").distinct(), hourly, monthly, intake, log, "1995-01-01", "1996-12-31")
    folder = staging_path(t.spark, "reports")
    names = {"daily": F.round(F.col("match_pct").cast("double") * 100), "monthly": F.col("n"), "intake": F.col("n"), "audit": F.col("part")}
    sinks.write_reports({k: made[k] for k in names}, folder)
    out = None
    for name, value in names.items():
        back = t.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/reports/{name}")
        row = back.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(value.cast("bigint")).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@check("file_deltas", """with n as (select cast(ts as date) as d, count(*) as n from events group by 1)
select strftime(d,'%Y-%m-%d') as day, n as total, greatest(0, n - coalesce(lag(n) over (order by d), n)) as delta from n""")
def file_deltas(t: Tables) -> DataFrame:
    totals = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("file_total")).withColumn("at", F.col("day").cast("timestamp"))
    return jobs.file_deltas(totals).select(F.col("day").cast("string").alias("day"), F.col("file_total").alias("total"), F.col("file_delta").alias("delta"))


@check("archive_entries", f"""with e as (select page_id, url || case page_id%5 when 0 then '.pdf' when 1 then '.XLSX' when 2 then '.exe' when 3 then '/__MACOSX/a.csv' else '/._b.pdf' end as path, split_part(url, '/', 3) as host from pages)
select page_id as page, regexp_matches(path, '{fixed.INGEST_EXT}') and not regexp_matches(path, '{fixed.OS_JUNK}') as kept, upper(host) = upper(substr(path, 8, length(host))) as same from e""")
def archive_entries(t: Tables) -> DataFrame:
    tails = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".XLSX", ".exe", "/__MACOSX/a.csv", "/._b.pdf")]), (F.col("page_id") % 5).cast("int") + 1)
    host = F.split("url", "/")[2]
    e = t.pages.select("page_id", F.concat("url", tails).alias("path"), host.alias("host")).withColumn("other", F.substring("path", F.lit(8), F.length("host")))
    return e.select(F.col("page_id").alias("page"), X.ingestible_entry("path").alias("kept"), X.same_company("host", "other").alias("same"))


@check("job_status_counts", """select count(*) as total, count(*) filter (where o_orderstatus='F') as completed, count(*) filter (where o_orderstatus='O') as queued, count(*) filter (where o_orderstatus='P') as error from orders""")
def job_status_counts(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("error")
    return jobs.status_counts(t.orders.select(status.alias("status"))).select("total", "completed", "queued", "error")
