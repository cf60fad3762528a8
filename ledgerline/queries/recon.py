"""Pairing, classification and summaries on the sides derived from events."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import classify
from ledgerline.operators.matching import candidates, pair_rows, with_job
from ledgerline.plans.reconcile import Run, reconcile
from ledgerline.queries.base import Tables, check
from ledgerline.queries.sides import bo_side, greedy_sql, one_account, sides_sql, stm_side
from ledgerline.settings import Settings

DAY = "cast(d as varchar)"


def _pairs(t: Tables, contested: bool) -> DataFrame:
    return with_job(pair_rows(stm_side(t, contested), bo_side(t, contested)))


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("job_date").cast("string"))


def run_of(t: Tables) -> Run:
    return reconcile(stm_side(t), bo_side(t))


@check("recon_candidates", f"""with {sides_sql(True)},
g as (select d, account, cents, sum(n_s) n_stm, sum(n_b) n_bo from (
 select d, account, cents, 1 n_s, 0 n_b from s union all select d, account, cents, 0, 1 from b) group by all)
select {DAY} as day, account, cents, cast(n_stm as bigint) n_stm, cast(n_bo as bigint) n_bo from g""")
def recon_candidates(t: Tables) -> DataFrame:
    out = candidates(stm_side(t, True), bo_side(t, True))
    return out.select(F.date_from_unix_date("job_day").cast("string").alias("day"), "account", "cents", "n_stm", "n_bo")


_PAIRS_SQL = f"select {DAY} as day, s_seq, b_seq, dt, pass from pairs join s on s.seq = pairs.s_seq"


@check("recon_match_greedy", f"with recursive {greedy_sql(True)} {_PAIRS_SQL}")
def recon_match_greedy(t: Tables) -> DataFrame:
    return _day(_pairs(t, True)).select("day", F.col("stm_seq").alias("s_seq"), F.col("bo_seq").alias("b_seq"),
                                        F.col("dt_sec").cast("bigint").alias("dt"), "pass")


@check("recon_match_passes", f"with recursive {greedy_sql(False)} {_PAIRS_SQL}")
def recon_match_passes(t: Tables) -> DataFrame:
    return _day(_pairs(t, False)).select("day", F.col("stm_seq").alias("s_seq"), F.col("bo_seq").alias("b_seq"),
                                         F.col("dt_sec").cast("bigint").alias("dt"), "pass")


@check("recon_match_untimed", f"with recursive {greedy_sql(True, one=True)} {_PAIRS_SQL}")
def recon_match_untimed(t: Tables) -> DataFrame:
    """One account a day with timed and untimed bank rows, in units of some hundred rows; lanes with untimed ones are cut at ``walk_rows``."""
    pairs = pair_rows(one_account(stm_side(t, True), True), one_account(bo_side(t, True), False), Settings(unit_rows=120))
    return _day(with_job(pairs)).select("day", F.col("stm_seq").alias("s_seq"), F.col("bo_seq").alias("b_seq"), F.col("dt_sec").cast("bigint").alias("dt"), "pass")


EXCEPTION_CTES = """
acc as (select distinct d, account from s),
mb as (select b.* from b join p1 on p1.b_seq = b.seq),
sl as (select * from s where seq not in (select s_seq from pairs)),
bl as (select b.*, exists(select 1 from acc where acc.d=b.d and acc.account=b.account) as has_stm,
 exists(select 1 from mb where mb.d=b.d and mb.account=b.account and mb.cents=b.cents and mb.dir=b.dir
  and abs(mb.sec-b.sec) <= case when b.dir='withdraw' then 180 else 120 end) as dup
 from b where seq not in (select b_seq from pairs)),
exc as (
 select 1 as phase, s.seq, s.d, s.sec, s.account, s.dir, s.cents as bank, b.cents as sys, dt, 'time_diff' as type, b.user_id as u from p2 join s on s.seq=s_seq join b on b.seq=b_seq
 union all select 2, s.seq, s.d, s.sec, s.account, s.dir, s.cents, b.cents, dt, 'amount_diff', b.user_id from p3 join s on s.seq=s_seq join b on b.seq=b_seq
 union all select 3, seq, d, sec, account, dir, cents, null, 0, 'missing_bo', user_id from sl
 union all select 4, seq, d, sec, account, dir, null, cents, 0,
  case when sec >= 82800 then 'cross_day' when dup then 'duplicate' else 'missing_stm' end, user_id from bl where has_stm),
excd as (select *, row_number() over (partition by d, type, account, sec, sys order by phase, seq) as k from exc),
excn as (select *, row_number() over (partition by d order by sec, phase, seq, type, account) + 3000 as n,
  case when type in ('time_diff','cross_day') then 0 when type='amount_diff' then abs(sys-bank) else coalesce(bank,sys) end as risk from excd where k = 1)"""

_SEV = """case when risk > 1000000 then 'critical' when type in ('amount_diff','duplicate') then 'critical'
 when type in ('missing_bo','missing_stm') then 'high' when type='cross_day' then 'medium' else 'low' end"""


@check("recon_exceptions", f"""with recursive {greedy_sql(False)}, {EXCEPTION_CTES}
select {DAY} as day, 'EX-' || n as id, type, account, cast(sec as bigint) as sec, cast(bank as bigint) as bank_cents, cast(sys as bigint) as system_cents,
 cast(risk as bigint) as risk_cents, cast(dt as bigint) as dt, {_SEV} as severity, 'user' || u as employee,
 case when sec < 28800 then 'night' when sec < 57600 then 'morning' else 'afternoon' end as shift,
 cast(1 + floor((86400 - sec) / 3600) as bigint) as age from excn""")
def recon_exceptions(t: Tables) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return _day(run_of(t).exceptions).select(
        "day", "id", "type", "account", F.col("sort_sec").cast("bigint").alias("sec"), cents("bank_amount").alias("bank_cents"),
        cents("system_amount").alias("system_cents"), cents("risk_amount").alias("risk_cents"), F.col("time_diff_sec").cast("bigint").alias("dt"),
        "severity", "employee", "shift", F.col("age_hours").cast("bigint").alias("age"))


_JOBS = f"""with recursive {greedy_sql(False)}, {EXCEPTION_CTES},
js as (select d, count(*) n from s group by d), jb as (select d, count(*) n from b group by d),
jm as (select s.d, count(*) n, count(*) filter (where dt > 0.6 * case when s.dir='withdraw' then 180 else 90 end) near from p1 join s on s.seq=s_seq group by s.d),
je as (select d, count(*) n from excn group by d), jw as (select d, count(*) n from bl where not has_stm group by d)"""


@check("recon_run_summary", f"""{_JOBS}
select cast(js.d as varchar) as day, js.n as stm_count, jb.n as bo_count, coalesce(jm.n,0) as matched, coalesce(jm.near,0) as near_tolerance,
 coalesce(je.n,0) as exception_count, coalesce(jw.n,0) as no_stm_count, round(coalesce(jm.n,0)*100.0/js.n, 3) as match_rate
from js join jb using (d) left join jm using (d) left join je using (d) left join jw using (d)""")
def recon_run_summary(t: Tables) -> DataFrame:
    return _day(run_of(t).summary()).select("day", "stm_count", "bo_count", "matched", "near_tolerance", "exception_count",
                                            "no_stm_count", F.round("match_rate", 3).cast("double").alias("match_rate"))


@check("recon_conservation", f"""with {sides_sql(True)}
select cast(d as varchar) as day, true as stm_conserved, true as bo_conserved, true as bo_used_once from s group by d""")
def recon_conservation(t: Tables) -> DataFrame:
    """Every row is in exactly one place: paired or left over, and no row is used twice."""
    stm, bo = stm_side(t, True), bo_side(t, True)
    pairs = with_job(pair_rows(stm, bo))
    job = ["job_date"]
    n = lambda df, name: df.groupBy(*job).agg(F.count(F.lit(1)).alias(name))
    left_s = classify.stm_unmatched(stm, pairs)
    left_b = classify.bo_unmatched(bo, stm, pairs)
    used = pairs.groupBy(*job).agg(F.count(F.lit(1)).alias("p"), F.countDistinct("stm_seq").alias("ds"), F.countDistinct("bo_seq").alias("db"))
    out = n(stm, "s").join(n(bo, "b"), job).join(used, job, "left").join(n(left_s, "ls"), job, "left").join(n(left_b, "lb"), job, "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return _day(out).select("day", (F.col("s") == z("p") + z("ls")).alias("stm_conserved"), (F.col("b") == z("p") + z("lb")).alias("bo_conserved"),
                            ((z("ds") == z("p")) & (z("db") == z("p"))).alias("bo_used_once"))


@check("hourly_profile", f"""{_JOBS}, h as (select d, unnest(range(24)) as hour from js)
select cast(h.d as varchar) as day, h.hour as hour, (select count(*) from s where s.d=h.d and s.sec//3600=h.hour) as total,
 (select count(*) from p1 join s on s.seq=s_seq where s.d=h.d and s.sec//3600=h.hour) as matched,
 (select count(*) from excn x where x.d=h.d and x.sec//3600=h.hour) as exceptions from h""")
def hourly_profile(t: Tables) -> DataFrame:
    return _day(run_of(t).hourly()).select("day", F.col("hour").cast("bigint").alias("hour"), "total", "matched", "exceptions")


@check("exceptions_by_type", f"""{_JOBS} select {DAY} as day, type, count(*) as n, cast(sum(risk) as bigint) as risk_cents from excn group by d, type""")
def exceptions_by_type(t: Tables) -> DataFrame:
    return _day(run_of(t).exceptions).groupBy("day", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("risk_amount") * 100).cast("bigint")).alias("risk_cents"))


# Statements exist for even accounts only on odd days, so back-office rows of other accounts wait for theirs.
_WAIT = "not (cast(account as int) % 2 = 1 and dayofmonth(d) % 2 = 1)"


@check("bo_no_stm_summary", f"""with {sides_sql(True)}, s0 as (select * from s where {_WAIT}), acc as (select distinct d, account from s0),
w as (select b.* from b where not exists (select 1 from acc where acc.d=b.d and acc.account=b.account))
select {DAY} as day, 'CH' || (cast(account as int) % 3) as channel, count(*) as n, cast(sum(cents) as bigint) as cents, count(distinct account) as accounts
from w group by d, cast(account as int) % 3""")
def bo_no_stm_summary(t: Tables) -> DataFrame:
    stm = stm_side(t, True).filter("not (cast(account as int) % 2 = 1 and dayofmonth(job_date) % 2 = 1)")
    bo = bo_side(t, True).withColumn("channel", F.concat(F.lit("CH"), (F.col("account").cast("int") % 3).cast("string")))
    left = classify.bo_unmatched(bo, stm, with_job(pair_rows(stm, bo)))
    return _day(classify.no_stm_summary(left)).select(
        "day", "channel", F.col("count").alias("n"), F.round(F.col("amount") * 100).cast("bigint").alias("cents"), "accounts")
