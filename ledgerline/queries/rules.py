"""Business rules and reference merging over orders, lineitem and events."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import rules
from ledgerline.operators.merge import merge_by_ref, refs_first
from ledgerline.operators.ranking import row_number_blocked
from ledgerline.queries.base import Tables, check
from ledgerline.queries.sides import event_base
from ledgerline.schema import row_identity

CENTS = lambda c: F.round(F.col(c) * 100).cast("bigint")
_FMT = "case l_linenumber%4 when 3 then 'bo_main' when 2 then 'manual_credit' when 1 then 'manual_payment' end"


@check("merge_by_ref", f"""with r as (select *, l_linenumber%4 as rk, {_FMT} as fmt, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as seq,
 case when l_quantity > 40 then null else l_returnflag||l_linenumber end as note, case when l_discount > 0.05 then 'A'||l_suppkey end as cust from lineitem),
m as (select *, rk > coalesce(max(rk) over (partition by l_orderkey order by seq rows between unbounded preceding and 1 preceding), -1) as rec from r)
select l_orderkey as ref, min(seq) as seq, arg_min(l_partkey, -rk*cast(1000000000 as bigint) + seq) as part,
 coalesce(arg_max(note, seq) filter (where rec and note is not null), arg_min(note, seq) filter (where note is not null)) as note,
 coalesce(arg_max(cust, seq) filter (where rec and cust is not null), arg_min(cust, seq) filter (where cust is not null)) as cust_account,
 case when count(*) > 1 then coalesce(max(l_tax > 0.06), false) else arg_min(case when l_tax > 0.06 then true end, seq) end as manual, count(*) as n from m group by l_orderkey""")
def merge_query(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    li = row_number_blocked(t.lineitem, [], F.shiftright("l_orderkey", 10), order, "seq")
    rows = li.select(
        F.col("l_orderkey").cast("string").alias("ref"), F.lit(1).alias("job"), "seq",
        F.when(F.col("l_linenumber") % 4 == 3, "bo_main").when(F.col("l_linenumber") % 4 == 2, "manual_credit").when(F.col("l_linenumber") % 4 == 1, "manual_payment").alias("format_code"),
        "l_partkey", F.when(F.col("l_tax") > 0.06, True).alias("manual"), F.lit(None).cast("string").alias("via"),
        F.when(F.col("l_quantity") <= 40, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("note"),
        F.when(F.col("l_discount") > 0.05, F.concat(F.lit("A"), "l_suppkey")).alias("cust_account"),
        *[F.lit(None).cast("string").alias(c) for c in ("cust_name", "bank", "credit_before", "credit_after", "member_code", "member_nick", "pay_order")])
    counts = rows.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    return merge_by_ref(rows, ["job"]).join(counts, "ref").select(
        F.col("ref").cast("bigint").alias("ref"), "seq", F.col("l_partkey").alias("part"), "note", "cust_account", "manual", "n")


@check("merge_identity", """with r as (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as k from lineitem),
i as (select *, case when l_linenumber%2=0 then l_orderkey||'' end as ref, (l_linenumber%4*cast(524288 as bigint)+9)*4398046511104 + k as seq from r),
m as (select ref, min(seq) as seq from i where ref is not null group by ref union all select ref, seq from i where ref is null)
select coalesce(ref,'-') as ref, seq, row_number() over (order by ref is null, seq) as place from m""")
def merge_identity(t: Tables) -> DataFrame:
    """Files far apart in number, half of the rows without a reference: all identities stay apart and rows with a reference come first."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    li = row_number_blocked(t.lineitem, [], F.shiftright("l_orderkey", 10), order, "k")
    file = F.col("l_linenumber") % 4 * 524288 + 9
    rows = li.select(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey").cast("string")).alias("ref"), F.lit(1).alias("job"), row_identity(file.cast("bigint"), F.col("k")).alias("seq"), F.lit("bo_main").alias("format_code"),
                     F.lit(True).alias("manual"), F.lit(None).cast("string").alias("via"),
                     *[F.lit(None).cast("string").alias(c) for c in ("note", "cust_account", "cust_name", "bank", "credit_before", "credit_after", "member_code", "member_nick", "pay_order")])
    merged = refs_first(merge_by_ref(rows, ["job"])).select("ref", "seq")
    placed = row_number_blocked(merged, [], F.shiftright("seq", 40), ["seq"], "place")
    return placed.select(F.coalesce("ref", F.lit("-")).alias("ref"), F.when(F.col("seq") < 0, F.col("seq") - F.lit(-(1 << 63)).cast("bigint")).otherwise(F.col("seq")).alias("seq"), "place")


def _commissions(t: Tables) -> DataFrame:
    """Orders as commission requests: member = customer group, day = order month start."""
    k = F.col("o_orderkey")
    return t.orders.select(
        F.to_date("o_orderdate").alias("job_date"), F.lit("ALL").alias("job_company"), F.trunc("o_orderdate", "month").alias("date"),
        F.concat(F.lit("M"), F.col("o_custkey") % 50).alias("member_code"), F.lit(None).cast("string").alias("member_nick"), k.alias("seq"), F.lit(0).alias("sec"),
        F.col("o_totalprice").cast("decimal(16,2)").alias("amount"), (F.col("o_orderstatus") != "P").alias("approved"),
        F.when(k % 3 == 0, (F.col("o_totalprice") - k % 100).cast("decimal(16,2)")).alias("entitled"),
        F.when(k % 3 == 1, (k % 100).cast("decimal(16,2)")).alias("excess"), F.lit("").alias("note"), F.concat(F.lit("o"), k).alias("raw"),
    ).withColumn("job_date", F.col("date"))


def _cuts(t: Tables) -> DataFrame:
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t.lineitem.select(
        F.trunc("l_shipdate", "month").alias("job_date"), F.lit("ALL").alias("job_company"), F.trunc("l_shipdate", "month").alias("date"),
        F.concat(F.lit("M"), F.col("l_suppkey") % 50).alias("member_code"), F.lit(None).cast("string").alias("member_nick"),
        (k * 1000000 + F.col("l_partkey")).alias("seq"), F.lit(0).alias("sec"), F.col("l_quantity").cast("decimal(16,2)").alias("amount"), F.lit(None).cast("decimal(16,2)").alias("entitled"),
        F.lit(None).cast("decimal(16,2)").alias("excess"), F.lit("").alias("note"), F.concat(F.lit("l"), k).alias("raw"))


_COMM = """c as (select date_trunc('month', cast(o_orderdate as date)) as d, 'M'||(o_custkey%50) as m, o_orderkey as seq, cast(round(o_totalprice*100) as bigint) as amt, o_orderstatus<>'P' as ok,
 case when o_orderkey%3=0 then cast(round((o_totalprice - o_orderkey%100)*100) as bigint) end as ent, case when o_orderkey%3=1 then (o_orderkey%100)*100 end as exc from orders),
k as (select date_trunc('month', cast(l_shipdate as date)) as d, 'M'||(l_suppkey%50) as m, (l_orderkey*10+l_linenumber)*1000000+l_partkey as seq, cast(l_quantity as bigint)*100 as amt from lineitem)"""


@check("commission_zip", f"""with {_COMM}, ca as (select *, row_number() over (partition by d, m order by seq) rn from c where ok),
ka as (select *, row_number() over (partition by d, m order by seq) rn from k),
z as (select ca.seq, ca.amt, coalesce(case when ent is not null then ca.amt-ent end, exc) as expect, ka.seq as kseq, ka.amt as kamt from ca left join ka using (d, m, rn))
select seq, case when kseq is null then 'comm_cut_missing' else 'comm_cut_mismatch' end as type, case when kseq is null then expect else abs(kamt-expect) end as risk, case when kseq is null then amt else kamt end as system
from z where expect is not null and (kseq is null or abs(kamt-expect) > 100)""")
def commission_zip(t: Tables) -> DataFrame:
    found = rules.commission_checks(_commissions(t), _cuts(t))
    return found.select("seq", "type", CENTS("risk_amount").alias("risk"), CENTS("system_amount").alias("system"))


@check("orphan_cuts", f"""with {_COMM} select strftime(d,'%Y-%m-%d') as day, m as member, seq, amt as risk from k where not exists (select 1 from c where c.d=k.d and c.m=k.m)""")
def orphan_cuts(t: Tables) -> DataFrame:
    return rules.credit_orphan(_commissions(t), _cuts(t)).select(F.col("date").cast("string").alias("day"), "member", "seq", CENTS("risk_amount").alias("risk"))


@check("credit_math", """select l_orderkey*10+l_linenumber as seq, l_partkey as part, cast(round(l_extendedprice*100) as bigint) - cast(l_quantity as bigint)*100 as expect,
 abs(cast(round(l_extendedprice*100) as bigint) - cast(l_quantity as bigint)*100 - (cast(round(l_extendedprice*100) as bigint) - cast(l_quantity as bigint)*100 + (cast(round(l_discount*100) as bigint)-5)*60)) as risk
from lineitem where abs((cast(round(l_discount*100) as bigint)-5)*60) > 100""")
def credit_math(t: Tables) -> DataFrame:
    price, qty = F.col("l_extendedprice").cast("decimal(16,2)"), F.col("l_quantity").cast("decimal(16,2)")
    drift = ((F.round(F.col("l_discount") * 100).cast("int") - 5) * 60).cast("decimal(16,2)") / 100
    cuts = t.lineitem.select(F.to_date("l_shipdate").alias("job_date"), F.lit("ALL").alias("job_company"), F.to_date("l_shipdate").alias("date"), F.lit(0).alias("sec"),
                             (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").cast("string").alias("member_code"), price.alias("before"),
                             qty.alias("amount"), (price - qty + drift).cast("decimal(16,2)").alias("after"), F.lit("x").alias("raw"))
    return rules.credit_math(cuts).select("seq", F.col("member").cast("bigint").alias("part"), CENTS("bank_amount").alias("expect"), CENTS("risk_amount").alias("risk"))


@check("bonus_math", """with b as (select o_orderkey, cast(round(o_totalprice*100) as bigint) as p, (o_orderkey%7)*50 as drift from orders)
select o_orderkey as seq, p*2 + 5000 as expect, drift as risk from b where drift > 100""")
def bonus_math(t: Tables) -> DataFrame:
    p = F.col("o_totalprice").cast("decimal(16,2)")
    after = p * 2 + 50 + (F.col("o_orderkey") % 7 * 50).cast("decimal(16,2)") / 100
    b = t.orders.select(F.to_date("o_orderdate").alias("job_date"), F.lit("ALL").alias("job_company"), F.to_date("o_orderdate").alias("date"), F.lit(0).alias("sec"),
                        F.col("o_orderkey").alias("seq"), p.alias("before"), p.alias("credit"), F.lit(50).cast("decimal(16,2)").alias("bonus"), after.cast("decimal(16,2)").alias("after"),
                        F.lit("p").alias("promo"), F.lit("x").alias("raw"))
    return rules.bonus_math(b).select("seq", CENTS("bank_amount").alias("expect"), CENTS("risk_amount").alias("risk"))


def _bo_orders(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select(d.alias("job_date"), F.lit("ALL").alias("job_company"), d.alias("date"), F.lit(3600).alias("sec"), F.date_sub(d, 1).alias("bo_date"), F.lit(86000).alias("bo_sec"),
                           F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("decimal(16,2)").alias("amount"), (F.col("o_orderstatus") == "F").alias("cross_day"),
                           F.when(F.col("o_orderpriority").startswith("1"), "withdraw").otherwise("deposit").alias("direction"), F.col("o_custkey").cast("string").alias("account"), F.lit("x").alias("raw"))


@check("cross_day_rule", """select o_orderkey as seq, cast(round(o_totalprice*100) as bigint) as system, cast(0 as bigint) as risk, 'medium' as severity,
 case when o_orderpriority like '1%' then 'ถอน' else 'ฝาก' end as direction from orders where o_orderstatus='F'""")
def cross_day_rule(t: Tables) -> DataFrame:
    from ledgerline.operators.exceptions import finish
    return finish(rules.cross_day_rule(_bo_orders(t))).select("seq", CENTS("system_amount").alias("system"), CENTS("risk_amount").alias("risk"), "severity", "direction")


@check("large_amount", """select o_orderkey as seq, cast(round(o_totalprice*100) as bigint) as risk, 'critical' as severity from orders where o_totalprice >= 100000 and o_orderpriority like '1%'""")
def large_amount(t: Tables) -> DataFrame:
    from ledgerline.operators.exceptions import finish
    return finish(rules.large_amount(_bo_orders(t))).select("seq", CENTS("risk_amount").alias("risk"), "severity")


_WIN = 30000


@check("manual_duplicates", f"""with r as (select event_id, cast(ts as date) d, hour(ts)*3600+minute(ts)*60+second(ts) as sec, cast(user_id%20 as varchar) a, cast(floor(value/10)*1000 as bigint) c,
 case when event_id%3=0 then 'w' else 'd' end dir, event_id%4 as ref from events),
l as (select *, lag(sec) over w as psec, lag(ref) over w as pref from r window w as (partition by d, a, c, dir order by sec, event_id))
select event_id as seq, strftime(d,'%Y-%m-%d') as day, c as risk from l where psec is not null and abs(sec-psec) <= {_WIN} and ref <> pref""")
def manual_duplicates(t: Tables) -> DataFrame:
    from ledgerline.settings import Settings
    e = event_base(t, contested=True)
    bo = e.select("job_date", F.lit("ALL").alias("job_company"), F.col("job_date").alias("date"), "sec", F.col("sec").alias("bo_sec"), "account", "amount_cents",
                  (F.col("amount_cents") / 100).cast("decimal(16,2)").alias("amount"), "direction", F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("member_code"),
                  F.lit(None).cast("string").alias("cust_account"), F.concat(F.lit("r"), F.col("event_id") % 4).alias("ref"), F.lit(True).alias("manual"),
                  F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("channel"), F.lit("x").alias("raw"))
    found = rules.manual_duplicates(bo, Settings(dup_window_sec=_WIN))
    return found.select("seq", F.col("date").cast("string").alias("day"), CENTS("risk_amount").alias("risk"))


@check("exception_dedupe_ids", """with e as (select event_id, cast(ts as date) d, hour(ts)*3600+(minute(ts)//20)*1200 as sec, event_type as type, cast(user_id%5 as varchar) as account, event_id%5=0 as has_detail from events),
f as (select *, row_number() over (partition by d, type, account, sec order by not has_detail, event_id) as k, min(event_id) over (partition by d, type, account, sec) as place from e)
select strftime(d,'%Y-%m-%d') as day, 'EX-'||(3000+row_number() over (partition by d order by sec, place)) as id, event_id as seq from f where k=1""")
def exception_dedupe_ids(t: Tables) -> DataFrame:
    from ledgerline.operators.exceptions import RAW, merge_exceptions, number_exceptions
    from ledgerline.schema import conform
    e = t.events.select(F.to_date("ts").alias("job_date"), F.lit("ALL").alias("job_company"), F.lit(1).alias("phase"), F.col("event_id").alias("seq"),
                        (F.hour("ts") * 3600 + F.floor(F.minute("ts") / 20) * 1200).alias("sort_sec"), F.col("event_type").alias("type"),
                        (F.col("user_id") % 5).cast("string").alias("account"), F.when(F.col("event_id") % 5 == 0, "x").alias("detail"))
    return number_exceptions(merge_exceptions(conform(e, RAW))).select(F.col("job_date").cast("string").alias("day"), "id", "seq")


@check("balance_direction", """with r as (select event_id, cast(user_id%20 as varchar)||'/'||cast(cast(ts as date) as varchar) as doc, cast(round(value*100) as bigint) c, event_id%3=0 as wd from events),
b as (select *, row_number() over (partition by doc order by event_id) as n, lag(c) over (partition by doc order by event_id) as pc from r)
select doc, event_id, case when n=1 then 'deposit' when wd then 'withdraw' else 'deposit' end as direction from b""")
def balance_direction(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    from ledgerline.operators.statements import apply_direction
    doc = F.concat((F.col("user_id") % 20).cast("string"), F.lit("/"), F.to_date("ts").cast("string"))
    amount = F.col("value").cast("decimal(16,2)")
    signed = F.when(F.col("event_id") % 3 == 0, -amount).otherwise(amount)
    running = F.sum(signed).over(Window.partitionBy(doc).orderBy("event_id"))
    rows = t.events.select(doc.alias("doc_id"), F.lit(0).alias("page_no"), F.col("event_id").alias("line_no"), "event_id", amount.alias("amount"), running.alias("balance"),
                           F.lit("").alias("code"), F.lit("").alias("descr"), F.lit("BBL").alias("bank"))
    return apply_direction(rows).select(F.col("doc_id").alias("doc"), "event_id", "direction")


@check("union_sides", """select case when event_type in ('view','click') then 'stm' else 'bo' end as part, count(*) as n from events where event_type <> 'signup' group by 1""")
def union_sides(t: Tables) -> DataFrame:
    from ledgerline.plans.reconcile import union_sides as split
    side = F.when(F.col("event_type") == "signup", "aux").when(F.col("event_type").isin("error", "purchase"), "bo").otherwise("pm")
    stm, bo = split(t.events.withColumn("side", side))
    return stm.select(F.lit("stm").alias("part")).unionByName(bo.select(F.lit("bo").alias("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


