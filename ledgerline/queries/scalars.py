"""Scalar and text expressions over orders, lineitem, documents, conversations, pages, supplier and part."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions import scalars as S
from ledgerline.functions import text as X
from ledgerline.operators import text_search
from ledgerline.queries.base import Tables, check


def _iso(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


@check("be_dates", """select o_orderkey, strftime(d, '%Y-%m-%d') as generic, strftime(d, '%Y-%m-%d') as stamp_iso, strftime(d, '%Y-%m-%d') as stamp_short,
 cast(3600*(o_orderkey%24)+61 as bigint) as stamp_sec, strftime(make_date(case when year(d)%100 > 50 then 1957 + year(d)%100 else 2000 + year(d)%100 end, month(d), day(d)), '%Y-%m-%d') as statement,
 strftime(d, '%d-%m-') || lpad(cast((year(d)+543)%100 as varchar), 2, '0') as th_short,
 day(d) || ' ' || list_extract(['ม.ค.','ก.พ.','มี.ค.','เม.ย.','พ.ค.','มิ.ย.','ก.ค.','ส.ค.','ก.ย.','ต.ค.','พ.ย.','ธ.ค.'], cast(month(d) as int)) || ' ' || (year(d)+543) as th_long,
 'REQ-' || strftime(d, '%Y%m%d') || '-' || o_orderpriority as doc_no
from (select *, case when month(cast(o_orderdate as date))=2 and day(cast(o_orderdate as date))=29 then cast(o_orderdate as date) - 1 else cast(o_orderdate as date) end as d from orders)""")
def be_dates(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    o = t.orders.withColumn("d", F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29), F.date_sub(d, 1)).otherwise(d))
    clock = F.format_string(" %02d:01:01", F.col("o_orderkey") % 24)
    be = F.year("d") + 543
    texts = {"generic": F.date_format("d", "d/M/yyyy"), "iso": F.concat(be.cast("string"), F.date_format("d", "-MM-dd"), clock),
             "short": F.concat(F.date_format("d", "d/M/"), F.format_string("%02d", be % 100), clock), "stm": F.date_format("d", "dd-MM-yy")}
    o = o.withColumns({f"x_{k}": v for k, v in texts.items()})
    return o.select("o_orderkey", S.iso_date_generic("x_generic").alias("generic"), S.stamp("x_iso")["date"].alias("stamp_iso"),
                    S.stamp("x_short")["date"].alias("stamp_short"), S.stamp("x_iso")["sec"].cast("bigint").alias("stamp_sec"),
                    S.iso_of_statement("x_stm").alias("statement"), S.th_date_short("d").alias("th_short"), S.th_date_long("d").alias("th_long"),
                    S.doc_no("REQ", "d", "o_orderpriority").alias("doc_no"))


@check("num_parse", """select l_orderkey, l_linenumber, cast(round(l_extendedprice*100) as bigint) as cents, cast(round(l_quantity) as bigint) as qty, true as none_is_null, cast(0 as bigint) as none_is_zero from lineitem""")
def num_parse(t: Tables) -> DataFrame:
    text = F.concat(F.lit("฿ "), F.format_number(F.col("l_extendedprice").cast("decimal(16,2)"), 2))
    return t.lineitem.select("l_orderkey", "l_linenumber", S.cents_of(S.num_of(text)).alias("cents"),
                             S.num(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" ชิ้น"))).cast("bigint").alias("qty"),
                             S.num_of("l_returnflag").isNull().alias("none_is_null"), S.num("l_linestatus").cast("bigint").alias("none_is_zero"))


@check("note_hints", """select l_orderkey, l_linenumber, case when l_linenumber%3<>2 then cast(round(l_extendedprice*100) as bigint) end as entitled,
 case when l_linenumber%3<>1 then cast(l_quantity as bigint)*100 end as excess from lineitem""")
def note_hints(t: Tables) -> DataFrame:
    price = F.format_number(F.col("l_extendedprice").cast("decimal(16,2)"), 2)
    a = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("ได้รับยอดภายในเดือน "), price, F.lit(" บาท"))).when(
        F.col("l_linenumber") % 3 == 1, F.concat(F.lit("ได้รับจริง "), price))
    b = F.when(F.col("l_linenumber") % 3 != 1, F.concat(F.lit("สะสมเกินเดือน "), F.col("l_quantity").cast("int").cast("string"), F.lit(" บาท")))
    h = X.note_hints(F.concat_ws(" ", a, b))
    return t.lineitem.select("l_orderkey", "l_linenumber", S.cents_of(h["entitled"]).alias("entitled"), S.cents_of(h["excess"]).alias("excess"))


_RE = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"


@check("text_scan", rf"""select doc_id, case when regexp_matches(text, '{_RE}') then cast(regexp_extract(text,'{_RE}',1) as bigint)*3600
 + cast(regexp_extract(text,'{_RE}',2) as bigint)*60 + coalesce(try_cast(nullif(regexp_extract(text,'{_RE}',3),'') as bigint),0) end as sec,
 nullif(lower(regexp_extract(text,'([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}})',1)),'') as email,
 md5(lower(regexp_replace(text,'[\s\x{{200B}}\x{{00A0}}\x{{FEFF}}]','','g'))) as normed,
 contains(lower(text),'success') or contains(text,'สำเร็จ') or contains(text,'อนุมัติ') or trim(text)='' as ok_status from documents""")
def text_scan(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.sec_of("text").cast("bigint").alias("sec"), X.sender_email("text").alias("email"),
                              F.md5(X.header_norm("text")).alias("normed"), X.ok_status("text").alias("ok_status"))


@check("text_tokens", r"""select page_id, len(list_filter(regexp_split_to_array(regexp_replace(lower(html),'[._/\\()\-]',' ','g'),'[ \t\n\r\f\v]+'), lambda x: x<>'')) as tokens,
 coalesce(nullif(regexp_extract(html,'(?:^|[^A-Za-z0-9_])([A-Z]{2,4}[0-9]{0,2})(?:[^A-Za-z0-9_]|$)',1),''),'-') as company, contains(html,'ฝาก') as dep from pages""")
def text_tokens(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(X.name_tokens("html")).cast("bigint").alias("tokens"), F.coalesce(X.company_of("html"), F.lit("-")).alias("company"),
                          F.coalesce(X.direction_of_name("html").isin("deposit", "both"), F.lit(False)).alias("dep"))


@check("note_scan", r"""select conv_id, turn, case when regexp_matches(text,'[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') then
 case when cast(regexp_extract(text,'([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})',1) as int) > 2400 then cast(regexp_extract(text,'([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})',1) as int)-543
 else cast(regexp_extract(text,'([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})',1) as int) end end as iso_year,
 regexp_matches(text,'(?i)มือ|manual') as manual from conversations""")
def note_scan(t: Tables) -> DataFrame:
    date = S.stamp("text")["date"]
    iso = F.col("text").rlike(r"\d{4}-\d{1,2}-\d{1,2}")
    return t.conversations.select("conv_id", "turn", F.when(iso, F.split(date, "-")[0].cast("int")).alias("iso_year"),
                                  X.is_manual(F.lit(False), "text", F.lit(None).cast("string")).alias("manual"))


_NAMES = """(select page_id, case when page_id%9=0 then 'AT4 รายงานบัญชีฝาก '||page_id||'.xlsx' when page_id%9=1 then 'SCB สมชาย ฝาก-ถอน '||page_id||'.pdf'
 when page_id%9=2 then 'ชี้แจง '||page_id||'.pdf' when page_id%9=3 then 'FR8 ฝากมือ_รายการเครดิต.xlsx' when page_id%9=4 then 'sk8 ฝากมือ payment '||page_id||'.csv'
 when page_id%9=5 then 'ฝากมือ_รายการโบนัส.xlsx' when page_id%9=6 then 'UFABET7M ขอถอนค่าคอม.xls' when page_id%9=7 then 'MR9 CYNERPLUS '||page_id||'.csv'
 else regexp_replace(url,'^https?://','') end as name from pages)"""


def _file_names(t: Tables) -> DataFrame:
    p = F.col("page_id")
    k, n = p % 9, p.cast("string")
    cat = lambda *a: F.concat(*[x if isinstance(x, F.Column) else F.lit(x) for x in a])
    return t.pages.select("page_id", S.case_of([
        (k == 0, cat("AT4 รายงานบัญชีฝาก ", n, ".xlsx")), (k == 1, cat("SCB สมชาย ฝาก-ถอน ", n, ".pdf")), (k == 2, cat("ชี้แจง ", n, ".pdf")),
        (k == 3, "FR8 ฝากมือ_รายการเครดิต.xlsx"), (k == 4, cat("sk8 ฝากมือ payment ", n, ".csv")), (k == 5, "ฝากมือ_รายการโบนัส.xlsx"),
        (k == 6, "UFABET7M ขอถอนค่าคอม.xls"), (k == 7, cat("MR9 CYNERPLUS ", n, ".csv"))], F.regexp_replace("url", "^https?://", "")).alias("name"))


_TOK = "(^|[^A-Za-z0-9])"
_END = "([^A-Za-z0-9]|$)"


@check("file_kind", f"""select page_id, case when regexp_matches(name,'(?i)\\.pdf$') and regexp_matches(name,'(?i)ฝาก\\s*[-–—/]?\\s*ถอน|statement|{_TOK}stm{_END}') then 'stm_pdf'
 when regexp_matches(name,'(?i)\\.pdf$') or regexp_matches(name,'(?i)\\.docx?$') then 'doc_clarify' when regexp_matches(name,'รายงานบัญชี(ฝาก|ถอน)') then 'bo_main'
 when regexp_matches(name,'ฝากมือ.*เครดิต') then 'manual_credit' when regexp_matches(name,'(?i)ฝากมือ.*Payment') then 'manual_payment'
 when regexp_matches(name,'ฝากมือ.*โบนัส') then 'manual_bonus' when contains(name,'ขอถอนค่าคอม') then 'comm_req' when contains(name,'ถอนเครดิต') then 'credit_out' else 'unknown' end as kind,
 case when regexp_matches(name,'(?i)\\.pdf$') and regexp_matches(name,'(?i)ฝาก\\s*[-–—/]?\\s*ถอน|statement|{_TOK}stm{_END}') then 'stm_pdf'
 when regexp_matches(name,'(?i)ATP|AUTOPEER|AZPAY|12PAY|MYPAY|CYBER|CYNER|CBY|(^|[^A-Za-z])PM([^A-Za-z]|$)') then 'pm_statement' when regexp_matches(name,'(?i)\\.pdf$') then 'stm_pdf'
 when regexp_matches(name,'(?i)รายงานบัญชี(ฝาก|ถอน)|(^|[^A-Za-z])BO([^A-Za-z]|$)') then 'bo_main' else 'unknown' end as effective,
 case when regexp_matches(name,'(?i)รายงานบัญชี(ฝาก|ถอน)|(^|[^A-Za-z])BO([^A-Za-z]|$)') then 'bo_main'
 when regexp_matches(name,'(?i)CYBER|CYNER|CBY') then 'pm_statement' else 'unknown' end as historic,
 case when regexp_matches(name,'(?i){_TOK}AT4{_END}') then 'AT4' when regexp_matches(name,'(?i){_TOK}FR8{_END}') then 'FR8' when regexp_matches(name,'(?i){_TOK}SK8{_END}') then 'SK8'
 when regexp_matches(name,'(?i){_TOK}MR9{_END}') then 'MR9' when regexp_matches(name,'(?i){_TOK}MC8{_END}') then 'MC8' when regexp_matches(name,'(?i){_TOK}UR9{_END}') then 'UR9'
 when regexp_matches(name,'(?i){_TOK}PS8{_END}') then 'PS8' when regexp_matches(name,'(?i)UFABET7M|{_TOK}7M{_END}') then 'UFABET7M' when regexp_matches(name,'(?i){_TOK}3XB{_END}') then '3XB'
 when regexp_matches(name,'(?i){_TOK}XXX{_END}') then 'XXX' when regexp_matches(name,'(?i)SYS123|ระบบ\\s*123') then 'SYS123' end as company,
 regexp_matches(name,'(?i)\\.(xlsx|xlsm|xls|csv|txt|pdf)$') as eligible from {_NAMES}""")
def file_kind(t: Tables) -> DataFrame:
    n = F.lit("unknown")
    return _file_names(t).select("page_id", X.file_kind("name").alias("kind"), X.effective_kind("name", n).alias("effective"),
                                 X.fix_historic_kind("name", n).alias("historic"), X.file_company("name").alias("company"), X.eligible_file("name", n).alias("eligible"))


@check("ascii_key", f"""select page_id, 'd-'||(page_id%7)||'/'||'C_'||(page_id%3)||'/'||page_id||'/'||lpad(cast(page_id%12 as varchar),3,'0')||'.'||
 coalesce(nullif(lower(regexp_extract(name,'\\.([A-Za-z0-9]{{1,10}})$',1)),''),'bin') as key, cast(floor((page_id%100)/10.0*1048576+0.5) as bigint) as size from {_NAMES}""")
def ascii_key(t: Tables) -> DataFrame:
    p = F.col("page_id")
    text = F.concat(F.format_number((p % 100 / 10).cast("decimal(4,1)"), 1), F.lit(" MB"))
    return _file_names(t).select("page_id", X.ascii_storage_key(F.concat(F.lit("d-"), p % 7), F.concat(F.lit("C "), p % 3), p, p % 12, "name").alias("key"),
                                 X.size_bytes(text).alias("size"))


@check("parse_subject", """select o_orderkey, case when o_orderkey%4=0 then 'AT4' when o_orderkey%4=1 then 'ZZ7' when o_orderkey%4=2 then 'UFABET7M' end as company,
 strftime(cast(o_orderdate as date),'%Y-%m-%d') as business_date, o_orderkey%2=0 as supplement, case when o_orderkey%4=2 then 'UFABET7M' when o_orderkey%4=0 then 'SYS123' end as system
from orders""")
def parse_subject(t: Tables) -> DataFrame:
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    date = F.concat_ws("-", F.date_format(d, "dd"), F.date_format(d, "MM"), F.format_string("%02d", (F.year(d) + 543) % 100))
    head = S.case_of([(k % 4 == 0, "at4 ส่งบัญชี 99/99/99 "), (k % 4 == 1, "Fwd: ZZ7 "), (k % 4 == 2, "ส่งตรวจ ufabet7m ")], F.lit("ส่งบัญชี "))
    o = t.orders.withColumn("subject", F.concat(head, date, F.when(k % 2 == 0, " เพิ่มเติม").otherwise("")))
    p = X.parse_subject("subject")
    return o.select("o_orderkey", p["company"].alias("company"), p["business_date"].alias("business_date"), p["is_supplement"].alias("supplement"),
                    S.case_of([(F.col("subject").rlike(rx), name) for rx, name in fixed.MAIL_SYSTEMS]).alias("system"))


@check("channel_account", """select s_suppkey, case when s_suppkey%4=0 then 'CYBERPLUS' when s_suppkey%4=1 then 'MANUAL' when s_suppkey%4=2 then 'AUTOPEER' else 'KBANK' end as channel,
 s_suppkey%4=1 as is_account, case when s_suppkey%4=0 then 'Cyberplus-'||s_suppkey when s_suppkey%4=1 then lpad(cast(s_suppkey as varchar),10,'6') when s_suppkey%4=2 then 'x:ATP' else 'KBANK' end as terminal,
 lpad(cast(s_suppkey as varchar),10,'0') as wallet, s_name as left_part, 'M'||s_suppkey as right_part from supplier""")
def channel_account(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    text = S.case_of([(k % 4 == 0, F.concat(F.lit("Cyberplus-"), k, F.lit(" : Cynerplus"))), (k % 4 == 1, F.concat(F.lpad(k.cast("string"), 10, "6"), F.lit(" : Manual"))),
                      (k % 4 == 2, F.lit("x:ATP : atp pay"))], F.lit("kbank"))
    c = X.channel_of(text)
    wallet = X.normalize_account(F.regexp_replace(F.lpad(k.cast("string"), 9, "0"), r"^(\d{3})", "$1-"), F.lit("TMN"))
    pipe = X.pipe_split(F.concat(F.col("s_name"), F.lit(" | M"), k))
    terminal = F.when(k % 4 == 3, F.upper(c["terminal"])).otherwise(c["terminal"])
    return t.supplier.select("s_suppkey", F.coalesce(X.canonical_pm(c["channel"]), c["channel"]).alias("channel"), c["is_bank_account"].alias("is_account"),
                             terminal.alias("terminal"), wallet.alias("wallet"), pipe["left"].alias("left_part"), pipe["right"].alias("right_part"))


@check("severity_sla_age", """with e as (select event_id, cast(ts as date) d, hour(ts)*3600+minute(ts)*60+second(ts) as sec, cast(round(value*10000) as bigint) as risk,
 case event_type when 'view' then 'time_diff' when 'error' then 'missing_bo' when 'click' then 'cross_day' when 'purchase' then 'amount_diff' else 'wrong_bank' end as type from events)
select event_id, case when risk > 1000000 or type='amount_diff' then 'critical' when type='missing_bo' then 'high' when type='time_diff' then 'low' else 'medium' end as severity,
 cast(1+floor((86400-sec)/3600) as bigint) as age_end, greatest(1, cast(floor((epoch(timestamp '2024-02-01 05:00:00') - epoch(cast(d as timestamp)) - sec)/3600) as bigint)) as age_real,
 case when sec//3600 between 8 and 15 then 'morning' when sec//3600 >= 16 then 'afternoon' else 'night' end as shift,
 case when day(d)<=15 then 'C1' when day(d)<=25 then 'C2' else 'C3' end as cycle, cast(case when day(d)<=15 then 15 when day(d)<=25 then 25 else day(last_day(d)) end as bigint) as close_day,
 strftime(cast(case when day(d)<=15 then date_trunc('month',d)+interval 14 day when day(d)<=25 then date_trunc('month',d)+interval 24 day else last_day(d) end as date) + 3, '%Y-%m-%d') as due,
 lpad(cast(sec//3600 as varchar),2,'0')||':'||lpad(cast(sec%3600//60 as varchar),2,'0')||':'||lpad(cast(sec%60 as varchar),2,'0') as clock from e""")
def severity_sla_age(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.to_date("ts").alias("d"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("sec"),
                        (F.round(F.col("value") * 10000) / 100).alias("risk"),
                        S.case_of([(F.col("event_type") == a, b) for a, b in (("view", "time_diff"), ("error", "missing_bo"), ("click", "cross_day"), ("purchase", "amount_diff"))],
                                  F.lit("wrong_bank")).alias("type"), F.lit("cycle").alias("track"))
    return e.select("event_id", S.severity("type", "risk", fixed.MATCH_TYPES).alias("severity"), S.age_hours("d", "sec").cast("bigint").alias("age_end"),
                    S.age_hours("d", "sec", "2024-02-01 05:00:00").cast("bigint").alias("age_real"), S.shift_of(S.hour_of("sec")).alias("shift"),
                    S.cycle_of("d")["code"].alias("cycle"), S.cycle_of("d")["close_day"].cast("bigint").alias("close_day"), S.track_due("d", "track").alias("due"),
                    S.hhmmss("sec").alias("clock"))


@check("date_presets", """select o_orderkey, strftime(d-6,'%Y-%m-%d') as last7, strftime(d-29,'%Y-%m-%d') as last30, strftime(date_trunc('month',d),'%Y-%m-%d') as month_from, strftime(last_day(d),'%Y-%m-%d') as month_to,
 strftime(date_trunc('month',d)-interval 1 month,'%Y-%m-%d') as prev_from, strftime(date_trunc('month',d)-interval 1 day,'%Y-%m-%d') as prev_to,
 strftime(date_trunc('quarter',d),'%Y-%m-%d') as q_from, strftime(date_trunc('quarter',d)+interval 3 month-interval 1 day,'%Y-%m-%d') as q_to, year(d)||'-12-31' as y_to,
 strftime(cast(o_orderdate as timestamp)+interval 7 hour + to_hours(o_orderkey%24),'%Y-%m-%d') as local_day
from (select *, cast(o_orderdate as date) d from orders)""")
def date_presets(t: Tables) -> DataFrame:
    p = lambda name, end: _iso(S.date_preset("d", name)[end])
    return t.orders.withColumn("d", F.to_date("o_orderdate")).select(
        "o_orderkey", p("last7", "from").alias("last7"), p("last30", "from").alias("last30"), p("thisMonth", "from").alias("month_from"),
        p("thisMonth", "to").alias("month_to"), p("lastMonth", "from").alias("prev_from"), p("lastMonth", "to").alias("prev_to"),
        p("thisQuarter", "from").alias("q_from"), p("thisQuarter", "to").alias("q_to"), p("thisYear", "to").alias("y_to"),
        _iso(S.local_date(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.col("o_orderkey").cast("int") % 24), "Asia/Bangkok")).alias("local_day"))


@check("serial_minutes", """select o_orderkey, strftime(cast(o_orderdate as timestamp) + to_seconds((o_orderkey*37)%86400),'%Y-%m-%d %H:%M:%S') as ts, cast(o_orderkey%5000 as bigint) as minutes,
 case when o_orderkey%5000 < 60 then (o_orderkey%5000)||' นาที' when o_orderkey%5000%60=0 then (o_orderkey%5000//60)||' ชม.' else (o_orderkey%5000//60)||' ชม. '||(o_orderkey%5000%60)||' นาที' end as text from orders""")
def serial_minutes(t: Tables) -> DataFrame:
    base = F.col("o_orderdate").cast("timestamp")
    serial = F.unix_timestamp(base) / 86400 + 25569 + (F.col("o_orderkey") * 37 % 86400) / 86400
    m = S.minutes_between(base, F.timestamp_seconds(F.unix_timestamp(base) + F.col("o_orderkey") % 5000 * 60))
    return t.orders.select("o_orderkey", F.date_format(S.excel_serial_to_ts(serial), "yyyy-MM-dd HH:mm:ss").alias("ts"), m.alias("minutes"), S.fmt_minutes(m).alias("text"))


@check("indexed_search", """select w, page_id as id from pages, (values ('.org/en/'), ('/FR/'), ('#t'), ('no such text')) v(w) where contains(lower(url), lower(w))""")
def indexed_search(t: Tables) -> DataFrame:
    """Parts of addresses looked up through trigram filters."""
    index = text_search.indexed(t.pages.select("page_id", "url"), ["url"], [F.col("url"), F.col("page_id")], parts=16)
    out = None
    for word in (".org/en/", "/FR/", "#t", "no such text"):
        found = index.search(word).select(F.lit(word).alias("w"), F.col("page_id").alias("id"))
        out = found if out is None else out.unionByName(found)
    return out
