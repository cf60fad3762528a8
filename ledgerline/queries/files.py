"""Normalisation round trips: events rendered as statement lines or report rows and read back; registry matching."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import registry, reports, statements
from ledgerline.operators.renormalize import changed_files, fingerprints, renormalize
from ledgerline.plans.files import reconcile_files
from ledgerline.queries.base import Tables, check
from ledgerline.queries.sides import bo_side, greedy_sql, stm_side
from ledgerline.rule_tables import SCHEMA as RULES
from ledgerline.rule_tables import compile_table, table_of
from ledgerline.session import stage
from ledgerline.settings import Settings
from ledgerline.sources import lines as L
from ledgerline.sources import rows as R

CENTS = lambda c: F.round(F.col(c) * 100).cast("bigint")


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _events(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    cents = F.round(F.col("value") * 100).cast("bigint") + 1000
    return t.events.select(
        "event_id", (F.col("user_id") % 20).cast("int").alias("acct"), F.to_date(ts).alias("d"), ts.alias("at"), cents.alias("cents"),
        F.format_number((cents / 100).cast("decimal(16,2)"), 2).alias("amt"), F.format_number((F.lit(1000000) + F.col("event_id") * 10000).cast("decimal(20,2)"), 2).alias("bal"),
        (F.col("event_id") % 3 == 0).alias("wd"))


# ------------------------------------------------------------------------------------------ statements
def _doc(t: Tables, head: list[str], body: list[Column]) -> DataFrame:
    """One document per account: a header page, then one page per day with the lines of each event."""
    e = _events(t)
    acct = F.lpad(F.col("acct").cast("string"), 10, "3")
    top = e.select("acct").distinct().select(
        acct.alias("doc_id"), F.lit(0).alias("page_no"),
        F.posexplode(F.array(*[_cat(*[acct if p == "{acct}" else p for p in h.partition("{acct}")]) for h in head])).alias("pos", "text"), F.lit(0).cast("bigint").alias("base"))
    rows = e.select(acct.alias("doc_id"), (F.dayofmonth("d") + 1).alias("page_no"), F.posexplode(F.array(*body)).alias("pos", "text"),
                    (F.col("event_id") * 4).alias("base"))
    both = top.unionByName(rows)
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return both.select("doc_id", "page_no", (F.col("base") + F.col("pos")).alias("line_no"), text.alias("text"), F.split(text, " ").alias("items"))


def _files(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id").distinct().select(
        F.col("doc_id").alias("file_id"), F.concat(F.lit("AT4 "), "doc_id", F.lit(".pdf")).alias("file_name"), F.lit(0).alias("file_seq"),
        F.lit(None).cast("date").alias("job_date"), F.lit("AT4").alias("job_company"))


def _read_back(t: Tables, head: list[str], body: list[Column]) -> DataFrame:
    docs = _doc(t, head, body)
    out = statements.normalize_statements(docs, _files(docs))
    return out.filter("drop_reason is null").select(
        "account", "bank", F.col("date").cast("string").alias("day"), F.col("sec").cast("bigint").alias("sec"), CENTS("amount").alias("cents"), "direction",
        F.coalesce("channel", F.lit("")).alias("channel"), "no_time", F.coalesce("descr", F.lit("")).alias("descr"))


def _expect(bank: str, sec: str, channel: str, descr: str, no_time: str = "false", direction: str | None = None) -> str:
    direction = direction or "case when event_id%3=0 then 'withdraw' else 'deposit' end"
    return f"""select lpad(cast(user_id%20 as varchar),10,'3') as account, '{bank}' as bank, strftime(ts,'%Y-%m-%d') as day, cast({sec} as bigint) as sec,
 cast(round(value*100) as bigint)+1000 as cents, {direction} as direction, {channel} as channel, {no_time} as no_time, {descr} as descr from events"""


_MIN, _SEC = "hour(ts)*3600+minute(ts)*60", "hour(ts)*3600+minute(ts)*60+second(ts)"


def _f(pattern: str) -> Column:
    return F.date_format("at", pattern)


@check("statement_lines_scb", _expect("SCB", _MIN, "'ENET'", "'จาก GSB X'||event_id"))
def scb(t: Tables) -> DataFrame:
    code = F.when(F.col("wd"), "X2").otherwise("X1")
    return _read_back(t, ["ธนาคารไทยพาณิชย์ SIAM COMMERCIAL", "เลขที่บัญชี {acct}"],
                      [_cat("จาก GSB X", F.col("event_id")), F.concat_ws(" ", _f("dd/MM/yy"), _f("HH:mm"), code, F.lit("ENET"), "amt", "bal")])


@check("statement_lines_kbank", _expect("KBANK", _MIN, "'K PLUS'", "'K PLUS จาก SCB X'||event_id"))
def kbank(t: Tables) -> DataFrame:
    kind = F.when(F.col("wd"), "โอนเงิน").otherwise("รับโอนเงิน")
    return _read_back(t, ["เลขที่บัญชีเงินฝาก {acct}"],
                      [F.concat_ws(" ", _f("dd-MM-yy"), F.lit("ยอดยกมา"), "bal"),
                       F.concat_ws(" ", _f("dd-MM-yy"), _f("HH:mm"), kind, "amt", "bal", F.lit("K PLUS จาก SCB"), _cat("X", F.col("event_id")))])


@check("statement_lines_lbk", _expect("LBK", _MIN, "'LBK'", "'LINE BK จาก BAY X'||event_id"))
def lbk(t: Tables) -> DataFrame:
    kind = F.when(F.col("wd"), "โอนเงิน").otherwise("รับโอนเงิน")
    return _read_back(t, ["เลขที่บัญชีเงินฝาก {acct}"],
                      [F.concat_ws(" ", _f("dd-MM-yy"), _f("HH:mm"), kind, "amt", "bal", F.lit("LINE BK จาก BAY"), _cat("X", F.col("event_id")))])


@check("statement_lines_tmn", _expect("TMN", _SEC, "'TMN'", "'09'||lpad(cast(event_id as varchar),8,'0')"))
def tmn(t: Tables) -> DataFrame:
    kind = F.when(F.col("wd"), "เงินออก").otherwise("เงินเข้า")
    sign = F.when(F.col("wd"), F.concat(F.lit("-"), "amt")).otherwise(F.col("amt"))
    return _read_back(t, ["ใบแสดงรายการ เงินเข้า เงินออก ยอดคงเหลือ", "เลขที่บัญชี {acct}"],
                      [F.concat_ws(" ", _f("dd/MM/yyyy"), _f("HH:mm:ss"), kind, sign, _cat("09", F.lpad(F.col("event_id").cast("string"), 8, "0")), "bal", "bal"),
                       F.concat_ws(" ", _f("dd/MM/yyyy"), _f("HH:mm:ss"), F.lit("เงินออก -0.29 fee_p2p_receive"), "bal", "bal")])


@check("statement_lines_bay", _expect("BAY", _SEC, "'MOBILE'", "'SCB NAME บัญชีปลายทาง : X'||event_id"))
def bay(t: Tables) -> DataFrame:
    kind = F.when(F.col("wd"), "ค่าโอน 5.50 โอนเงิน").otherwise("ฝากเงิน")
    return _read_back(t, ["เลขบัญชีเงินฝาก {acct}".replace("เงินฝาก", ""), "ธนาคารกรุงศรีอยุธยา กรุงเทพฯ"],
                      [F.concat_ws(" ", _f("dd/MM/yyyy"), _f("HH:mm:ss"), kind, "amt", "bal", F.lit("MOBILE SCB NAME")), _cat("บัญชีปลายทาง : X", F.col("event_id"))])


@check("statement_lines_ktb", _expect("KTB", f"case when event_id%5=0 then 0 else {_MIN} end", "'KTB'",
       "case when event_id%3=0 then 'โอนเงินออก (W) ' else 'เงินโอนเข้า (D) ' end || format('{:t,.2f}', (round(value*100)+1000)/100) || ' ' || format('{:t,.2f}', 1000000.0+event_id*10000) || ' 606'"
       .replace(":t,", ":,"), "event_id%5=0"))
def ktb(t: Tables) -> DataFrame:
    kind = F.when(F.col("wd"), "โอนเงินออก (W)").otherwise("เงินโอนเข้า (D)")
    be = F.concat(_f("dd/MM/"), F.lpad(((F.year("d") + 543) % 100).cast("string"), 2, "0"))
    return _read_back(t, ["บริษัท ธนาคารกรุงไทย จำกัด", "เลขที่บัญชี {acct}"],
                      [F.concat_ws(" ", be, kind, "amt", "bal", F.lit("606")), F.when(F.col("event_id") % 5 == 0, "-").otherwise(_f("HH:mm"))])


@check("statement_lines_bbl", _expect("BBL", "0", "'BBL'", "case when event_id%3=0 then 'TRF TO OTH BK mPhone' else 'TRF FR OTH BK mPhone' end", "true"))
def bbl(t: Tables) -> DataFrame:
    kind = F.when(F.col("wd"), "TRF TO OTH BK").otherwise("TRF FR OTH BK")
    return _read_back(t, ["ธนาคารกรุงเทพ จำกัด", "ชื่อ/Name เลขที่บัญชี/Account No. {acct}"], [F.concat_ws(" ", _f("dd/MM/yy"), kind, "amt", "bal", F.lit("mPhone"))])


@check("statement_lines_generic", """select lpad(cast(user_id%20 as varchar),10,'3') as account, '-' as bank, strftime(ts,'%Y-%m-%d') as day, cast(hour(ts)*3600+minute(ts)*60 as bigint) as sec,
 cast(round(value*100) as bigint)+1000 as cents, case when event_id%3=0 then 'withdraw' else 'deposit' end as direction from events""")
def generic_lines(t: Tables) -> DataFrame:
    word = F.when(F.col("wd"), "withdraw").otherwise("deposit")
    out = _read_back(t, ["Savings Account No. {acct}"], [F.concat_ws(" ", F.lit("#"), _f("dd/MM/yyyy"), _f("HH:mm"), word, "amt", "bal")])
    return out.select("account", F.coalesce("bank", F.lit("-")).alias("bank"), "day", "sec", "cents", "direction")


@check("statement_header", """select lpad(cast(user_id%20 as varchar),10,'3') as account, 'BBL' as bank, '2024-01-01 ถึง 2024-01-30' as period, 'นาย ทดสอบ' as holder from (select distinct user_id%20 as user_id from events)""")
def header(t: Tables) -> DataFrame:
    docs = _doc(t, ["ธนาคารกรุงเทพ จำกัด", "เลขที่บัญชี/Account No. {acct}", "ชื่อบัญชี นาย ทดสอบ", "01/01/2024 - 30/01/2024"], [F.col("bal")])
    return statements.statement_header(statements.with_neighbours(docs)).select("account", "bank", "period", "holder")


@check("fragment_lines", r"""with w as (select page_id, unnest(string_split(html, ' ')) as s, generate_subscripts(string_split(html, ' '), 1) - 1 as k from pages),
l as (select page_id, k, s, k // 3 * 2 + case when k % 3 = 2 then 1 else 0 end as line from w)
select page_id as doc, cast(line as bigint) as line, trim(regexp_replace(string_agg(s, ' ' order by k), '[\s\x{00A0}]+', ' ', 'g')) as text from l group by 1, 2""")
def fragment_lines(t: Tables) -> DataFrame:
    """Words of a page, three to a row whose y drifts by two units a word: the third is too far from the first."""
    f = t.pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page_no"), F.posexplode(F.split("html", " ")).alias("k", "s"))
    f = f.select("doc_id", "page_no", (F.col("k") % 3 * 50).alias("x"), (F.lit(700) - F.floor(F.col("k") / 3) * 20 - F.col("k") % 3 * 2).alias("y"), "s")
    return L.group_fragments(f).select(F.col("doc_id").alias("doc"), F.col("line_no").cast("bigint").alias("line"), "text")


@check("document_lines", r"""with p as (select doc_id, unnest(regexp_split_to_array(text, '\r?\n')) as s from documents)
select doc_id, count(*) as lines, cast(sum(length(trim(regexp_replace(s,'[\s\x{00A0}]+',' ','g')))) as bigint) as chars from p where trim(regexp_replace(s,'[\s\x{00A0}]+',' ','g')) <> '' group by doc_id""")
def document_lines(t: Tables) -> DataFrame:
    lines = L.split_lines(t.documents.select("doc_id", F.col("text").alias("body")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


# ------------------------------------------------------------------------------------------ report rows
def _raw(t: Tables, headers: list[str], cells: list[Column], title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One file per day: optional title row, header row, one row per event."""
    e = _events(t).withColumn("file_id", F.col("d").cast("string"))
    days = e.select("file_id").distinct()
    top = [] if title is None else [[title]]
    shift = len(top) + 1
    heads = days.select("file_id", F.posexplode(F.array(*[F.array(*[F.lit(c) for c in row]) for row in [*top, headers]])).alias("pos", "cells"))
    rows = heads.select("file_id", (F.col("pos") + 1).cast("int").alias("row_no"), "cells").unionByName(
        e.select("file_id", (F.col("event_id") + shift + 1).cast("int").alias("row_no"), F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("cells")))
    return rows, days


def _listed(days: DataFrame, name: str) -> DataFrame:
    return days.select("file_id", F.concat(F.lit(name), F.lit(" "), "file_id", F.lit(".xlsx")).alias("file_name"), F.lit(0).alias("file_seq"),
                       F.col("file_id").cast("date").alias("job_date"), F.lit("AT4").alias("job_company"))


def _be(pattern: str) -> Column:
    return _cat(F.year("d") + 543, _f(pattern))


@check("report_rows_bo_main", f"""select event_id, strftime(ts,'%Y-%m-%d') as day, {_SEC} as sec, cast(round(value*100) as bigint)+1000 as cents, case when event_id%3=0 then 'withdraw' else 'deposit' end as direction,
 case when user_id%20%2=0 then 'CYBERPLUS' else lpad(cast(user_id%20 as varchar),10,'6') end as account, case when user_id%20%2=0 then 'CYBERPLUS' else 'MANUAL' end as channel, user_id%20%2=0 as is_pm,
 'M'||(user_id%20) as member, event_id%10=0 as cross_day, 'AT4' as company, case when value*100 < 0 then 'x' end as dropped from events""")
def bo_main(t: Tables) -> DataFrame:
    pm = F.col("acct") % 2 == 0
    bank = F.when(pm, "Cyberplus-4 : Cynerplus").otherwise(_cat(F.lpad(F.col("acct").cast("string"), 10, "6"), " : Manual"))
    money = lambda hit: F.when(hit, F.col("amt")).otherwise("0")
    booked = F.when(F.col("event_id") % 10 == 0, F.date_format(F.date_sub("d", 1), "dd/MM/yyyy 23:59:59")).otherwise(_be("-MM-dd HH:mm:ss"))
    rows, days = _raw(t, ["วันที่ทำรายการ", "วันที่ธนาคาร", "จำนวนเงินฝากจริง (บาท)", "จำนวนเงินถอนจริง", "ชื่อธนาคาร", "สมาชิก", "รหัสอ้างอิง"],
                      [booked, _be("-MM-dd HH:mm:ss"), money(~F.col("wd")), money(F.col("wd")), bank, _cat("นิค | M", F.col("acct")), F.col("event_id")])
    out = reports.normalize_reports(rows, _listed(days, "AT4 รายงาน"))
    return out.select(F.col("ref").cast("bigint").alias("event_id"), F.col("date").cast("string").alias("day"), F.col("sec").cast("bigint").alias("sec"), "amount_cents", "direction", "account",
                      "channel", "is_pm", F.col("member_code").alias("member"), "cross_day", "company", F.col("drop_reason").alias("dropped")).withColumnRenamed("amount_cents", "cents")


@check("report_rows_manual", """select event_id, strftime(ts,'%Y-%m-%d') as day, cast(round(value*100) as bigint)+1000 as cents, lpad(cast(user_id%20 as varchar),10,'3') as account,
 'KBANK' as cust_bank, case when event_id%7=0 then 'รายการไม่สำเร็จ' end as dropped, true as manual from events""")
def manual_credit(t: Tables) -> DataFrame:
    rows, days = _raw(t, ["เวลาทำรายการ", "เวลาธนาคาร", "เลขบัญชีธนาคารสมาชิก", "เลขบัญชีธนาคารบริษัท", "จำนวน", "สถานะ", "ชื่อธนาคารสมาชิก", "รหัสรายการ"],
                      [_f("yyyy-MM-dd HH:mm:ss"), _f("yyyy-MM-dd HH:mm:ss"), F.lit("123"), F.lpad(F.col("acct").cast("string"), 10, "3"), F.col("amt"),
                       F.when(F.col("event_id") % 7 == 0, "ยกเลิก").otherwise("สำเร็จ"), F.lit("kbank"), F.col("event_id")])
    out = reports.normalize_reports(rows, _listed(days, "AT4 ฝากมือ_รายการเครดิต"))
    return out.select(F.col("ref").cast("bigint").alias("event_id"), F.col("date").cast("string").alias("day"), F.col("amount_cents").alias("cents"), "account", "cust_bank",
                      F.col("drop_reason").alias("dropped"), "manual")


@check("report_rows_payment", """select event_id, cast(round(value*100) as bigint)+1000 as cents, case when user_id%20%3=0 then 'MYPAY' else 'C'||(user_id%20) end as account,
 case when user_id%20%3=0 then 'MYPAY' else 'OTHER' end as channel, 'P'||event_id as pay_order from events""")
def manual_payment(t: Tables) -> DataFrame:
    rows, days = _raw(t, ["เวลาทำรายการ", "เลขคำสั่งชำระ", "ช่องทาง", "บัญชีบริษัท", "จำนวน", "รหัสรายการ"],
                      [_f("yyyy-MM-dd HH:mm:ss"), _cat("P", F.col("event_id")), F.when(F.col("acct") % 3 == 0, "t : MyPay").otherwise("t : other"), _cat("C", F.col("acct")), F.col("amt"), F.col("event_id")])
    out = reports.normalize_reports(rows, _listed(days, "AT4 ฝากมือ_รายการ Payment"))
    return out.select(F.col("ref").cast("bigint").alias("event_id"), F.col("amount_cents").alias("cents"), "account", "channel", "pay_order")


@check("report_rows_aux", """select 'bonus' as kind, event_id, cast(round(value*100) as bigint)+1000 as cents, cast(null as bigint) as entitled, true as approved from events
union all select 'comm', event_id, cast(round(value*100) as bigint)+1000, 2100, event_id%7<>0 from events
union all select 'cut', event_id, cast(round(value*100) as bigint)+1000, null, true from events""")
def aux_rows(t: Tables) -> DataFrame:
    at = _f("yyyy-MM-dd HH:mm:ss")
    member, status = _cat("M", F.col("acct")), F.when(F.col("event_id") % 7 == 0, "ยกเลิก").otherwise("สำเร็จ")
    b_rows, days = _raw(t, ["เวลาทำรายการ", "โปรโมชั่น", "ยอดก่อนเติม", "เครดิต", "โบนัส", "ยอดหลังเติม", "หมายเหตุ"], [at, F.lit("p"), F.lit("1"), F.lit("2"), F.col("amt"), F.lit("9"), F.col("event_id")])
    c_rows, _ = _raw(t, ["วัน/เวลา", "รหัสสมาชิก", "จำนวนเงิน", "สถานะ", "ดำเนินการโดย", "หมายเหตุ", "รหัสรายการ"],
                     [at, member, F.col("amt"), status, F.lit("op"), F.lit("ได้รับยอดภายในเดือน 21 บาท"), F.col("event_id")])
    k_rows, _ = _raw(t, ["เวลาทำรายการ", "รหัสสมาชิก", "เครดิตก่อน", "จำนวน", "เครดิตหลัง", "รหัสรายการ"], [at, member, F.lit("1,000"), F.col("amt"), F.lit("0"), F.col("event_id")])
    f = _listed(days, "AT4 aux")
    b, c, k = (reports.normalize_reports(r, f) for r in (b_rows, c_rows, k_rows))
    ent = F.lit(None).cast("bigint").alias("entitled")
    return (reports.bonuses(b).select(F.lit("bonus").alias("kind"), F.col("note").cast("bigint").alias("event_id"), CENTS("bonus").alias("cents"), ent, F.lit(True).alias("approved"))
            .unionByName(reports.commissions(c).select(F.lit("comm").alias("kind"), F.col("ref").cast("bigint").alias("event_id"), CENTS("amount").alias("cents"), CENTS("entitled").alias("entitled"), "approved"))
            .unionByName(reports.credit_cuts(k).select(F.lit("cut").alias("kind"), F.col("ref").cast("bigint").alias("event_id"), CENTS("amount").alias("cents"), ent, F.lit(True).alias("approved"))))


@check("report_rows_gateway", f"""select event_id, strftime(ts,'%Y-%m-%d') as day, {_SEC} as sec, cast(round(value*100) as bigint)+1000 as cents, case when event_id%3=0 then 'withdraw' else 'deposit' end as direction,
 'AUTOPEER' as account, '7M' as subco, 'stm' as side, event_id%7=0 as failed from events""")
def gateway(t: Tables) -> DataFrame:
    rows, days = _raw(t, ["id", "amount", "provider", "status", "requestTime", "customerId", "memo"],
                      [_cat(F.when(F.col("wd"), "WD-").otherwise("DEP-"), F.col("event_id")), F.col("amt"), F.lit("ATP-x"), F.when(F.col("event_id") % 7 == 0, "Failed").otherwise("Success"),
                       _f("yyyy-MM-dd HH:mm:ss"), F.lit("c"), F.lit("")], title="UFABET7M")
    out = reports.normalize_reports(rows, _listed(days, "gateway"))
    return out.select(F.regexp_extract("ref", r"(\d+)$", 1).cast("bigint").alias("event_id"), F.col("date").cast("string").alias("day"), F.col("sec").cast("bigint").alias("sec"),
                      F.col("amount_cents").alias("cents"), "direction", "account", "subco", "side", F.coalesce(F.col("drop_reason").startswith("รายการไม่สำเร็จ"), F.lit(False)).alias("failed"))


_GENERIC_HEAD = ["วันที่", "เวลา", "รายการ", "ถอน", "ฝาก", "ยอดคงเหลือ", "เลขที่บัญชี", "ref"]


def _generic_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("event_id")
    day = F.when(k % 11 == 0, F.date_format(F.date_sub("d", 1), "d/M/yyyy")).otherwise(_f("d/M/yyyy"))
    text = F.when(k % 13 == 0, "ยอดยกมา").when(k % 17 == 0, "XB ADJ").otherwise("X1 IN")
    rows, days = _raw(t, _GENERIC_HEAD, [day, F.when(k % 19 == 0, "-").otherwise(_f("HH:mm:ss")), text, F.lit(""), F.when(k % 23 == 0, "0").otherwise(F.col("amt")), F.col("bal"), _cat("SCB-", F.col("acct")), k])
    return rows, days.select("file_id", F.concat(F.lit("scb_stm_"), "file_id", F.lit(".csv")).alias("file_name"), F.lit(0).alias("file_seq"),
                             F.col("file_id").cast("date").alias("job_date"), F.lit("C").alias("job_company"))


_GENERIC_REASON = """case when event_id%13=0 then 'กรองบรรทัดยอดยกมา' when event_id%19=0 then 'ไม่มีเวลาที่อ่านได้' when event_id%11=0 then 'วันที่ไม่ตรงกับวันที่ตรวจ'
 when event_id%23=0 then 'ไม่มียอดเงิน' when event_id%17=0 then 'รายการปรับปรุงยอด (XB) แยกออกจากการจับคู่' end"""


@check("generic_rows", f"""select event_id, case when event_id%19<>0 then {_SEC} end as sec, 'deposit' as direction, 'SCB' as bank, 'SCB-'||(user_id%20) as account, {_GENERIC_REASON} as dropped,
 case when event_id%19<>0 then {_SEC} >= 82800 end as cross_day from events where event_id%17<>0 or event_id%13=0 or event_id%11=0 or event_id%19=0 or event_id%23=0
union all select event_id, {_SEC}, 'adjustment', 'SCB', 'SCB-'||(user_id%20), {_GENERIC_REASON}, {_SEC} >= 82800 from events
 where not (event_id%17<>0 or event_id%13=0 or event_id%11=0 or event_id%19=0 or event_id%23=0)""")
def generic_rows(t: Tables) -> DataFrame:
    rows, files = _generic_rows(t)
    out = reports.normalize_generic(rows, files)
    kept = F.col("drop_reason").isNull() | (F.col("direction") == "deposit") | F.col("drop_reason").startswith("รายการปรับปรุง")
    return out.select(F.col("ref").cast("bigint").alias("event_id"), F.col("sec").cast("bigint").alias("sec"), F.when(kept, F.col("direction")).otherwise("deposit").alias("direction"), "bank", "account",
                      F.col("drop_reason").alias("dropped"), "cross_day")


@check("rule_tables", f"""select event_id, {_SEC} as sec, case when event_id%3=0 then 'withdraw' else 'deposit' end as direction, cast(round(value*100) as bigint)+1000 as cents, 'BBVA' as bank, 'ES-'||(user_id%20) as account from events""")
def rule_tables(t: Tables) -> DataFrame:
    """A bank with headers in another language, known from rows added to the table of rules."""
    added = [("header", "date", ["fecha"], 1), ("header", "time", ["hora"], 2), ("header", "desc", ["concepto"], 3), ("header", "debit", ["cargo"], 4), ("header", "credit", ["abono"], 5),
             ("header", "balance", ["saldo"], 6), ("header", "account", ["cuenta"], 8), ("bank", "BBVA", ["bbva"], 99)]
    rules = compile_table(table_of(t.spark).unionByName(t.spark.createDataFrame(added, RULES)))
    rows, days = _raw(t, ["Fecha", "Hora", "Concepto", "Cargo", "Abono", "Saldo", "Cuenta", "Ref"],
                      [_f("d/M/yyyy"), _f("HH:mm:ss"), F.lit("pago"), F.when(F.col("wd"), F.col("amt")), F.when(~F.col("wd"), F.col("amt")), F.col("bal"), _cat("ES-", F.col("acct")), F.col("event_id")])
    files = days.select("file_id", F.concat(F.lit("bbva "), "file_id", F.lit(".csv")).alias("file_name"), F.lit(0).alias("file_seq"), F.col("file_id").cast("date").alias("job_date"), F.lit("C").alias("job_company"))
    out = reports.transactions(reports.normalize(rows, files, rules=rules))
    return out.select(F.col("ref").cast("bigint").alias("event_id"), F.col("sec").cast("bigint").alias("sec"), "direction", F.col("amount_cents").alias("cents"), "bank", "account")


@check("renormalized", f"""select strftime(ts,'%Y-%m-%d') as file, case when strftime(ts,'%d')='30' then 'new' when strftime(ts,'%d')='05' then 'changed' else 'kept' end as how,
 count(*) as n, count(*) filter (where {_GENERIC_REASON} is null) as good, cast(sum(event_id) as bigint) as refs from events where strftime(ts,'%d')<>'07' group by 1, 2""")
def renormalized(t: Tables) -> DataFrame:
    """A second run in which one file has lost and got back a row's value, one is new, and one is no longer listed."""
    rows, files = _generic_rows(t)
    first_rows = rows.filter(~F.col("file_id").endswith("-30")).withColumn("cells", F.when(F.col("file_id").endswith("-05") & (F.col("row_no") > 1), F.transform("cells", lambda c, i: F.when(i == 4, "1.00").otherwise(c))).otherwise(F.col("cells")))
    stored, _, _ = renormalize(first_rows, files.filter(~F.col("file_id").endswith("-30")), None, reports.normalize)
    listed = files.filter(~F.col("file_id").endswith("-07"))
    now, redo, _ = renormalize(rows.join(listed, "file_id", "left_semi"), listed, stage(stored, "renormalized"), reports.normalize)
    out = now.join(redo.select("file_id", "why"), "file_id", "left").groupBy("file_id", F.coalesce("why", F.lit("kept")).alias("how"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("drop_reason").isNull()).alias("good"), F.sum(F.col("ref").cast("bigint")).alias("refs")).withColumnRenamed("file_id", "file")


@check("renormalized_setting", """select how, count(distinct cast(ts as date)) as files from events, (values ('kept'), ('redone')) h(how) group by how""")
def renormalized_setting(t: Tables) -> DataFrame:
    """A setting that normalising does not use redoes no file; one that it uses redoes all."""
    rows, files = _generic_rows(t)
    before = stage(fingerprints(rows, files), "fingerprints")
    other, used = Settings(unit_rows=7), Settings(late_night_sec=80000)
    how = lambda cfg: fingerprints(rows, files, cfg).join(changed_files(fingerprints(rows, files, cfg), before), "file_id", "left").select(F.when(F.col("why").isNull(), "kept").otherwise("redone").alias("how"))
    return how(other).unionByName(how(used)).groupBy("how").agg(F.count(F.lit(1)).alias("files"))


@check("quarantine_counts", f"""select strftime(ts,'%Y-%m-%d') as file, {_GENERIC_REASON} as reason, count(*) as n from events where {_GENERIC_REASON} is not null group by 1, 2""")
def quarantine(t: Tables) -> DataFrame:
    rows, files = _generic_rows(t)
    return reports.quarantine_counts(reports.normalize(rows, files)).select(F.col("file_id").alias("file"), F.col("drop_reason").alias("reason"), "n")


@check("channel_stats", """select strftime(ts,'%Y-%m-%d') as file, case when user_id%20%3=0 then 'MYPAY' else 'OTHER' end as channel, count(*) as n, cast(sum(cast(round(value*100) as bigint)+1000) as bigint) as cents, user_id%20%3=0 as is_pm
from events group by 1, 2, 5""")
def channel_stats(t: Tables) -> DataFrame:
    rows, days = _raw(t, ["เวลาทำรายการ", "เลขคำสั่งชำระ", "ช่องทาง", "บัญชีบริษัท", "จำนวน"],
                      [_f("yyyy-MM-dd HH:mm:ss"), F.lit("P"), F.when(F.col("acct") % 3 == 0, "t : MyPay").otherwise("t : other"), F.lit("C"), F.col("amt")])
    out = reports.channel_stats(reports.normalize_reports(rows, _listed(days, "AT4 x")))
    return out.select(F.col("file_id").alias("file"), "channel", F.col("count").alias("n"), CENTS("amount").alias("cents"), "is_pm")


@check("file_warnings", """select strftime(ts,'%Y-%m-%d') as file, 'ช่องทาง PM ที่พบ: MYPAY '||count(*) filter (where user_id%20%3=0)||' รายการ — ต้องมีไฟล์ statement ของช่องทางนี้จึงจะจับคู่ได้' as warnings from events group by 1
having count(*) filter (where user_id%20%3=0) > 0""")
def file_warnings(t: Tables) -> DataFrame:
    rows, days = _raw(t, ["เวลาทำรายการ", "เลขคำสั่งชำระ", "ช่องทาง", "บัญชีบริษัท", "จำนวน"],
                      [_f("yyyy-MM-dd HH:mm:ss"), F.lit("P"), F.when(F.col("acct") % 3 == 0, "t : MyPay").otherwise("t : other"), F.lit("C"), F.col("amt")])
    files = _listed(days, "AT4 x")
    w = reports.file_warnings(files, reports.normalize_reports(rows, files))
    return w.filter(F.size("warnings") > 0).select(F.col("file_id").alias("file"), F.array_join("warnings", "; ").alias("warnings"))


@check("detect_formats", """select strftime(ts,'%Y-%m-%d') as file, 'stm' as source, 'SCB' as bank, cast(1 as bigint) as header_row, 'account,balance,credit,date,debit,desc,time,txid' as columns from events group by 1""")
def detect(t: Tables) -> DataFrame:
    from ledgerline.operators.detect import detect_format
    rows, files = _generic_rows(t)
    d = detect_format(rows, files)
    return d.select(F.col("file_id").alias("file"), "source", "bank", F.col("header_row").cast("bigint").alias("header_row"), F.array_join(F.array_sort(F.map_keys("map")), ",").alias("columns"))


@check("pick_sheet", r"""with l as (select page_id, unnest(string_split(html, '<')) as cell, generate_subscripts(string_split(html, '<'), 1) as i from pages), r as (select *, case when page_id%3<>0 or i=1 then 0 else 1 end as sheet from l),
n as (select page_id, sheet, count(*) as n from r group by 1, 2), p as (select page_id, coalesce(min(case when n>1 then sheet end), min(sheet)) as sheet from n group by 1)
select page_id as file, sheet, count(*) as n from r join p using (page_id, sheet) where trim(cell) <> '' group by 1, 2""")
def pick_sheet(t: Tables) -> DataFrame:
    """The tags of a page as rows; every third page has a single row on its first sheet and the rest on the second."""
    cells = t.pages.select(F.col("page_id").alias("file_id"), F.posexplode(F.split("html", "<")).alias("i", "cell"))
    cells = cells.select("file_id", F.when((F.col("file_id") % 3 != 0) | (F.col("i") == 0), 0).otherwise(1).alias("sheet_no"), (F.col("i") + 1).alias("row_no"), F.array("cell").alias("cells"))
    return R.pick_sheet(cells).groupBy(F.col("file_id").alias("file"), F.col("sheet_no").alias("sheet")).agg(F.count(F.lit(1)).alias("n"))


@check("links_import", """select s_suppkey as id, s_name as name, 'https://x/'||s_suppkey as url, case when s_suppkey%4=0 then 'ทั่วไป' else 'cat'||(s_suppkey%4) end as category, 'G'||(s_nationkey%5) as group_name, false as error
from supplier where s_suppkey%10<>0 union all select s_suppkey, null, null, null, null, true from supplier where s_suppkey%10=0""")
def links_import(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    head = t.spark.range(1).select(F.lit(1).alias("row_no"), F.array(*[F.lit(c) for c in ("ชื่อ", "URL", "หมวด", "ห้อง")]).alias("cells"))
    body = t.supplier.select((k + 2).cast("int").alias("row_no"), F.array(
        F.when(k % 10 == 0, "").otherwise(F.col("s_name")), _cat("https://x/", k), F.when(k % 4 == 0, "").otherwise(_cat("cat", k % 4)), _cat("G", F.col("s_nationkey") % 5)).alias("cells"))
    links, errors = R.read_links(head.unionByName(body).withColumn("file_id", F.lit("f")), "C1")
    none = [F.lit(None).cast("string").alias(c) for c in ("name", "url", "category", "group_name")]
    return links.select((F.col("row_no") - 2).cast("bigint").alias("id"), "name", "url", "category", "group_name", F.lit(False).alias("error")).unionByName(
        errors.select((F.col("row_no") - 2).cast("bigint").alias("id"), *none, F.lit(True).alias("error")))


# ------------------------------------------------------------------------------------------ registry
def _accounts(t: Tables) -> DataFrame:
    """Bank accounts named after suppliers, gateways per nation."""
    k = F.col("s_suppkey")
    bank = t.supplier.select(
        F.lpad(k.cast("string"), 10, "0").alias("account"), S.case_of([(k % 3 == 0, "SCB"), (k % 3 == 1, "KBANK")], F.lit("GSB")).alias("bank"),
        _cat("นาย", F.lower(F.regexp_replace("s_name", "#", "")), " สกุล", k % 7).alias("name"), F.lit("bank").alias("source"), F.lit(None).cast("string").alias("provider"),
        F.lit(None).cast("string").alias("channel"), _cat("S", k % 9).alias("subco"), k.alias("ord"))
    n = F.col("n_nationkey")
    pm = t.nation.select(F.lit("").alias("account"), F.lit("").alias("bank"), F.lit("").alias("name"), F.lit("pm").alias("source"), F.lit("MYPAY").alias("provider"),
                         F.lit("MYPAY").alias("channel"), _cat("NQ", F.lpad(n.cast("string"), 2, "0")).alias("subco"), (n + 1000000).alias("ord"))
    return bank.unionByName(pm)


@check("name_match", """select s_suppkey as id, case when s_suppkey%5=4 then 'NQ'||lpad(cast(s_nationkey as varchar),2,'0') when s_suppkey%5=3 then null else 'S'||(s_suppkey%9) end as subco,
 case when s_suppkey%5 in (3,4) then null else lpad(cast(s_suppkey as varchar),10,'0') end as account, case when s_suppkey%5=4 then 2 when s_suppkey%5<3 then 2 end as score,
 case when s_suppkey%5=3 then 'ไฟล์ PM ไม่มีชื่อบริษัทย่อยในชื่อไฟล์ (เพิ่มบริษัทย่อยในชื่อไฟล์)' end as reason, case when s_suppkey%2=0 then 'both' else 'withdraw' end as direction from supplier""")
def name_match(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    bank = S.case_of([(k % 3 == 0, "SCB"), (k % 3 == 1, "KB")], F.lit("GSB"))
    name = S.case_of([(k % 5 == 4, _cat("nq", F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), " mypay")), (k % 5 == 3, F.lit("mypay"))],
                     _cat(bank, " ", F.lower(F.regexp_replace("s_name", "#", "")), " สกุล", k % 7))
    files = t.supplier.select(k.alias("file_id"), _cat(name, F.when(k % 2 == 0, " ถอน-ฝาก").otherwise(" ถอน"), " วันที่.pdf").alias("file_name"))
    return registry.match_files(files, _accounts(t)).select(F.col("file_id").alias("id"), "subco", "account", "score", "reason", "direction")


@check("account_tagging", """select s_suppkey as id, case when s_suppkey%4=0 then 'CYBERPLUS' when s_suppkey%4=1 then '7'||lpad(cast(s_suppkey as varchar),9,'0') else lpad(cast(s_suppkey as varchar),10,'0') end as account,
 case when s_suppkey%4 in (2,3) then 'S'||(s_suppkey%9) end as reg_subco from supplier""")
def account_tagging(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    text = S.case_of([(k % 4 == 0, "cyber plus"), (k % 4 == 1, _cat("7-", F.lpad(k.cast("string"), 9, "0"))), (k % 4 == 2, F.lit("UNKNOWN"))], F.lpad(k.cast("string"), 10, "0"))
    txns = t.supplier.select(k.alias("file_id"), text.alias("account"), F.lit("").alias("bank"), F.when(k % 4 == 0, "cyber plus").alias("channel"), F.lit("").alias("subco"))
    matches = t.supplier.select(k.alias("file_id"), F.lit(None).cast("string").alias("subco"), F.lpad(k.cast("string"), 10, "0").alias("account"), F.lit("SCB").alias("match_bank"))
    tagged = registry.tag_records(txns, matches)
    return registry.account_lookup(tagged, _accounts(t)).select(F.col("file_id").alias("id"), "account", "reg_subco")


@check("unseen_accounts", """select lpad(cast(c_custkey as varchar),10,'0') as account, 'KTB' as bank from customer where lpad(cast(c_custkey as varchar),10,'0') not in (select lpad(cast(s_suppkey as varchar),10,'0') from supplier)""")
def unseen_accounts(t: Tables) -> DataFrame:
    heads = t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("account"), F.lit("KTB").alias("bank"), F.col("c_name").alias("holder"))
    return registry.register_unseen(heads, _accounts(t)).select("account", "bank")


# ------------------------------------------------------------------------------------------ from raw files to a run
def _raw_side(side: DataFrame, headers: list[str], cells: list[Column], prefix: str) -> DataFrame:
    """One file a day: header row, then the rows of ``side`` in order of ``seq``."""
    file = F.concat(F.lit(prefix), F.col("job_date").cast("string"))
    heads = side.select(file.alias("file_id")).distinct().select("file_id", F.lit(1).cast("int").alias("row_no"), F.array(*[F.lit(h) for h in headers]).alias("cells"))
    return heads.unionByName(side.select(file.alias("file_id"), (F.col("seq") + 2).cast("int").alias("row_no"), F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("cells")))


@check("files_to_run", f"""with recursive {greedy_sql(False, by_time=True)},
js as (select d, count(*) n from s group by d), jb as (select d, count(*) n from b group by d), jm as (select s.d, count(*) n from p1 join s on s.seq=s_seq group by s.d)
select cast(js.d as varchar) as day, js.n as stm_count, jb.n as bo_count, coalesce(jm.n,0) as matched from js join jb using (d) left join jm using (d)""")
def files_to_run(t: Tables) -> DataFrame:
    """Both sides written as the rows of daily files, read by header words and report format, and reconciled."""
    clock = F.date_format(F.timestamp_seconds(F.col("sec").cast("bigint")), "HH:mm:ss")
    account = F.concat(F.lit("60000000"), F.lpad("account", 2, "0"))
    amount, out = F.format_string("%.2f", F.col("amount").cast("double")), F.col("direction") == "withdraw"
    bank = _raw_side(stm_side(t), ["วันที่", "เวลา", "รายการ", "ถอน", "ฝาก", "เลขที่บัญชี", "ref"],
                     [F.date_format("date", "d/M/yyyy"), clock, F.lit("pago"), F.when(out, amount), F.when(~out, amount), account, F.col("seq")], "scb_stm_")
    at = F.concat_ws(" ", F.col("date").cast("string"), clock)
    office = _raw_side(bo_side(t), ["วันที่ทำรายการ", "วันที่ธนาคาร", "จำนวนเงินฝากจริง (บาท)", "จำนวนเงินถอนจริง", "ชื่อธนาคาร", "สมาชิก", "รหัสอ้างอิง"],
                       [at, at, F.when(out, "0").otherwise(amount), F.when(out, amount).otherwise("0"), F.concat(account, F.lit(" : Manual")), F.lit("n | M1"), F.col("seq")], "AT4 ")
    rows = bank.unionByName(office)
    day = F.to_date(F.substring("file_id", -10, 10))
    files = rows.select("file_id").distinct().select("file_id", F.concat("file_id", F.lit(".xlsx")).alias("file_name"), F.lit(0).alias("file_seq"), day.alias("job_date"), F.lit("AT4").alias("job_company"))
    run = reconcile_files(rows, files)
    return run.summary().select(F.col("job_date").cast("string").alias("day"), "stm_count", "bo_count", "matched")
