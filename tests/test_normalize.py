"""Files and statements read back from hand-made rows and lines."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import reports, statements
from ledgerline.operators.detect import map_headers
from ledgerline.operators.renormalize import renormalize
from ledgerline.plans.files import reconcile_files
from ledgerline.sources.lines import group_fragments, read_text_lines, split_lines
from ledgerline.sources.rows import link_groups, read_csv_rows, read_links

def _lines(*lines):
    return "\n".join(lines)


# Made-up statements in the layout of each bank.
DOCS = {
    "BAY": _lines("ธนาคารกรุงศรี ตัวอย่าง", "เลขบัญชีเงินฝาก 900-0-00001-1", "02/03/2025 08:01:05 โอนเงิน 40.00 960.00 APP KTB DEMO A", "บัญชีปลายทาง : X111222",
                  "02/03/2025 08:02:06 โอนเงิน 60.00 900.00 APP BBL DEMO B", "บัญชีปลายทาง : X333444", "รวม 2 รายการ 100.00"),
    "LBK": _lines("เลขที่บัญชีเงินฝาก 900-0-00002-2", "04-05-25 ยอดยกมา 500.00", "04-05-25 01:02 โอนเงิน 20.00 480.00 LINE BK โอนไป KTB X0001 ตัวอย่าง", "04-05-25 03:04 รับโอนเงิน 70.00 550.00 ต่างธนาคาร จาก BBL X0002"),
    "KTB": _lines("เลขที่บัญชี 9000000003 สาขา 1", "ธนาคารกรุงไทย ตัวอย่าง", "06/07/68 เงินโอนเข้า (AAA) 000-1 15.00 115.00 1", "11:12", "07/07/68 โอนเงินออก (BBB) 000-2 5.00 110.00 1", "13:14"),
    "KTB2": _lines("เลขที่บัญชี 9000000004", "ธนาคารกรุงไทย ตัวอย่าง", "08/09/68 เงินโอนเข้า (AAA) 000-1 25.00 225.00 1", "08/09/68 โอนเงินออก (BBB) 000-2 10.00 215.00 1"),
    "BBL": _lines("ธนาคารกรุงเทพ ตัวอย่าง", "Account No. 900-0-00005-5", "10/11/25 TRF FR OTH BK 8.00 308.00 App", "10/11/25 TRF TO OTH BK 9.00 299.00 App"),
    "SCB": _lines("ธนาคารไทยพาณิชย์ เลขที่บัญชี 9000000006", "จาก KTB X0003", "12/01/25 15:16 X1 ENET 33.00 333.00", "12/01/25 15:17 XB ENET 2.00 77.00"),
    "TMN": _lines("เงินเข้า เงินออก ยอดคงเหลือ เลขที่บัญชี 9000000007", "13/02/2025 17:18:19 เงินเข้า 44.00 9000000008 400.00 444.00", "13/02/2025 17:18:20 เงินออก -0.44 fee_demo 444.00 443.56"),
}


@pytest.fixture(scope="module")
def statement(spark):
    lines = split_lines(spark.createDataFrame(list(DOCS.items()), "doc_id string, body string"))
    files = spark.createDataFrame([(d, f"AT4 {d}.pdf", 0, None, "AT4") for d in DOCS], "file_id string, file_name string, file_seq int, job_date date, job_company string")
    out = {}
    for r in statements.normalize_statements(lines, files).orderBy("seq").collect():
        out.setdefault(r.file_id, []).append(r)
    return out


def test_bay(statement):
    rows = statement["BAY"]
    assert [(float(r.amount), r.direction, r.sec, r.channel, r.bank, r.account) for r in rows] == [
        (40.0, "withdraw", 28865, "APP", "BAY", "9000000011"), (60.0, "withdraw", 28926, "APP", "BAY", "9000000011")]
    assert rows[0].descr.endswith("บัญชีปลายทาง : X111222")


def test_lbk(statement):
    assert [(float(r.amount), r.direction, r.channel) for r in statement["LBK"]] == [(20.0, "withdraw", "LBK"), (70.0, "deposit", "LBK")]


def test_ktb(statement):
    assert [(str(r.date), r.sec, r.direction, r.no_time) for r in statement["KTB"]] == [
        ("2025-07-06", 40320, "deposit", False), ("2025-07-07", 47640, "withdraw", False)]
    assert [(r.sec, r.direction, r.no_time) for r in statement["KTB2"]] == [(0, "deposit", True), (0, "withdraw", True)]


def test_bbl(statement):
    assert [(str(r.date), r.sec, r.direction, r.no_time, float(r.amount)) for r in statement["BBL"]] == [
        ("2025-11-10", 0, "deposit", True, 8.0), ("2025-11-10", 0, "withdraw", True, 9.0)]


def test_scb_and_wallet(statement):
    scb = statement["SCB"]
    assert (scb[0].descr, scb[0].direction, scb[0].drop_reason) == ("จาก KTB X0003", "deposit", None)
    assert scb[1].drop_reason.startswith("รายการปรับปรุงยอด")
    assert [(float(r.amount), r.drop_reason is None) for r in statement["TMN"]] == [(44.0, True), (0.44, False)]


def test_bay_edge(spark):
    line = "02/03/2025 08:01:05 ค่าบริการ 3.50 โอนเงิน 40 960 APP KTB X"
    t = spark.createDataFrame([(line, line.split(" "), None)], "text string, items array<string>, next_text string")
    r = t.select(statements.parse_bay().alias("r")).select("r.*").collect()[0]
    assert (r.amount, r.balance) == (40, 960)


def raw(spark, table):
    data = [(f, i + 1, r) for f, rows in table.items() for i, r in enumerate(rows)]
    rows = spark.createDataFrame(data, "file_id string, row_no int, cells array<string>")
    return rows


def file_list(spark, names, day=None):
    return spark.createDataFrame([(f, n, i, day, "C") for i, (f, n) in enumerate(names.items())], "file_id string, file_name string, file_seq int, job_date date, job_company string")


def test_generic_and_gateway(spark):
    rows = raw(spark, {
        "g": [["วันที่", "เวลา", "ฝาก", "ถอน", "เลขที่บัญชี"], ["2026-08-01", "01:00:00", "100", "", "SCB-1"], ["2026-08-01", "02:00:00", "", "50", "SCB-1"],
              ["2026-07-31", "03:00:00", "70", "", "SCB-1"]],
        "p": [["id", "amount", "provider", "status", "requestTime"], ["DEP-1", "100", "Autopeer", "Success", "2026-08-01 10:00:00"]],
        "c": [["วันที่", "สถานะ", "จำนวนเงิน"], ["2026-08-01 10:00", "สำเร็จ", "5"]]})
    out = reports.normalize(rows, file_list(spark, {"g": "scb_stm.csv", "p": "AT4 Autopeer ฝาก.xlsx", "c": "any.csv"}, dt.date(2026, 8, 1))).collect()
    g = sorted((r for r in out if r.file_id == "g"), key=lambda r: r.row_no)
    assert [(float(r.amount), r.direction, r.account, r.drop_reason) for r in g] == [
        (100.0, "deposit", "SCB-1", None), (50.0, "withdraw", "SCB-1", None), (70.0, "deposit", "SCB-1", "วันที่ไม่ตรงกับวันที่ตรวจ")]
    p = [r for r in out if r.file_id == "p"][0]
    assert (p.side, p.account, p.direction) == ("stm", "AUTOPEER", "deposit")
    assert [r.format_code for r in out if r.file_id == "c"] == ["pm_provider"]


def test_map_headers_is_greedy(spark):
    df = spark.createDataFrame([(["Transaction Date", "Account_no", "ยอดเงิน", "x", "จำนวนเงิน"],)], "cells array<string>")
    assert df.select(map_headers("cells").alias("m")).collect()[0].m == {"date": 0, "account": 1, "amount": 2}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿a,"b,c"\n\n \n"x""y","two\nlines"\n', encoding="utf-8")
    rows = read_csv_rows(spark, str(tmp_path / "a.csv")).orderBy("row_no").collect()
    assert [r.cells for r in rows] == [["a", "b,c"], ['x"y', "two\nlines"]]
    assert [r.row_no for r in rows] == [1, 2]
    (tmp_path / "b.csv").write_text(",".join(f"c{i}" for i in range(300)) + '\r\nx,a"b,c"d,""\r\n"open\nend', encoding="utf-8")
    rows = read_csv_rows(spark, str(tmp_path / "b.csv")).orderBy("row_no").collect()
    assert [r.cells for r in rows] == [[f"c{i}" for i in range(300)], ["x", "ab,cd", ""], ["open\nend"]]


def test_csv_split_over_tasks(spark, tmp_path):
    body = [[str(i), 'q"' * (i % 4), "line\n" * (i % 3) + "end"] for i in range(400)]
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in body)
    (tmp_path / "c.csv").write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = read_csv_rows(spark, str(tmp_path / "c.csv")).orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.cells for r in rows] == body and [r.row_no for r in rows] == list(range(1, 401))


def test_fragments_fold_on_the_first_y(spark):
    f = spark.createDataFrame([("d", 0, 0.0, y, s) for y, s in ((700.0, "a"), (698.0, "b"), (696.0, "c"), (694.0, "d"))], "doc_id string, page_no int, x double, y double, s string")
    assert [(r.line_no, r.text) for r in group_fragments(f).orderBy("line_no").collect()] == [(0, "a b"), (1, "c d")]


def test_fragments_of_a_very_long_page(spark):
    """The fold costs nothing that grows with the square of the page, and equals serving one y after the other."""
    import random
    import time
    rnd = random.Random(6)
    ys, y = [], 10_000_000
    for _ in range(400):
        y -= rnd.choice([1, 1, 2, 2, 3, 5])
        ys.append(y)
    want, top, line = [], None, -1
    for y in ys:
        if top is None or top - y > 2:
            top, line = y, line + 1
        want.append((line, str(y)))
    near = spark.createDataFrame([("d", 0, 0.0, float(y), str(y)) for y in rnd.sample(ys, len(ys))], "doc_id string, page_no int, x double, y double, s string")
    assert [(r.line_no, w) for r in group_fragments(near).orderBy("line_no").collect() for w in r.items] == want
    far = spark.range(60_000).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page_no"), F.lit(0).alias("x"), (-3 * F.col("id")).alias("y"), F.lit("a").alias("s"))
    began = time.time()
    assert group_fragments(far).agg(F.max("line_no")).first()[0] == 59_999 and time.time() - began < 60


def test_text_file(spark, tmp_path):
    (tmp_path / "s.txt").write_text("one  two\n\nthree\fpage two", encoding="utf-8")
    assert [(r.page_no, r.line_no, r.text) for r in read_text_lines(spark, str(tmp_path)).orderBy("page_no", "line_no").collect()] == [
        (0, 0, "one two"), (0, 1, "three"), (1, 0, "page two")]


def test_links(spark):
    rows = raw(spark, {"f": [["ชื่อ", "ลิงก์", "ห้อง"], ["A", "http://a", "Room"], ["", "http://b", ""], ["C", "http://c", "room"]]})
    links, errors = read_links(rows, "X")
    assert [r.error for r in errors.collect()] == ["แถว 3: ขาดชื่อหรือ url"]
    groups = link_groups(links, spark.createDataFrame([], "company_id string, name string"))
    assert [(r.name, r.created) for r in groups.collect()] == [("Room", True)]
    assert links.filter(F.col("category") == "ทั่วไป").count() == 2


def test_files_to_run(spark):
    """A report and a statement of the same account: one pair, one row the bank does not have, one large withdrawal."""
    report = raw(spark, {"r": [["วันที่", "เวลา", "txid", "username", "ฝาก", "ถอน", "เลขที่บัญชี"], ["2025-01-12", "15:16:10", "t1", "u1", "33", "", "9000000006"],
                               ["2025-01-12", "20:00:00", "t2", "u2", "", "150000", "9000000006"]]})
    files = file_list(spark, {"r": "BO report.csv"}, dt.date(2025, 1, 12)).withColumn("kind", F.lit("bo_main"))
    docs = spark.createDataFrame([("SCB", "C SCB.pdf", 1, dt.date(2025, 1, 12), "C")], "file_id string, file_name string, file_seq int, job_date date, job_company string")
    lines = split_lines(spark.createDataFrame([("SCB", DOCS["SCB"])], "doc_id string, body string"))
    run = reconcile_files(report, files, lines, docs)
    assert [(r.stm_count, r.bo_count, r.matched) for r in run.summary().collect()] == [(1, 2, 1)]
    assert sorted(r.type for r in run.exceptions.collect()) == ["large_amount", "missing_stm"]


def _generic_file(spark, n):
    head = ["วันที่", "เวลา", "รายการ", "ถอน", "ฝาก", "ยอดคงเหลือ", "เลขที่บัญชี", "ref"]
    k = F.col("id")
    body = spark.range(0, n, 1, 8).select(F.lit("g").alias("file_id"), (k + 2).cast("int").alias("row_no"), F.array(
        F.lit("1/8/2026"), F.lit("10:00:00"), F.lit("X1 IN"), F.lit(""), F.lit("5.00"), F.lit("9.00"), F.lit("SCB-1"), k.cast("string")).alias("cells"))
    top = spark.range(1).select(F.lit("g").alias("file_id"), F.lit(1).alias("row_no"), F.array(*[F.lit(c) for c in head]).alias("cells"))
    files = spark.createDataFrame([("g", "scb_stm.csv", 0, dt.date(2026, 8, 1), "C")], "file_id string, file_name string, file_seq int, job_date date, job_company string")
    return top.unionByName(body), files


def test_rows_of_one_file_stay_spread(spark):
    rows, files = _generic_file(spark, 800)
    out = reports.normalize_generic(rows, files)
    assert out.filter("drop_reason is null").count() == 800
    assert out.select(F.input_file_name()).distinct().count() >= 8  # written by the tasks that read the rows
    head = spark.range(1).select(F.lit("r").alias("file_id"), F.lit(1).alias("row_no"), F.array(*[F.lit(c) for c in ("วัน/เวลา", "รหัสสมาชิก", "จำนวนเงิน", "สถานะ", "ดำเนินการโดย")]).alias("cells"))
    body = spark.range(0, 800, 1, 8).select(F.lit("r").alias("file_id"), (F.col("id") + 2).cast("int").alias("row_no"), F.array(*[F.lit(c) for c in ("2026-08-01 10:00:00", "m", "5.00", "ok", "x")]).alias("cells"))
    out = reports.normalize_reports(head.unionByName(body), files.withColumn("file_id", F.lit("r")))
    assert out.count() == 800 and out.select(F.input_file_name()).distinct().count() > 2


def test_files_to_read_again_are_worked_out_once(spark):
    rows, files = _generic_file(spark, 20)
    stored, redo, _ = renormalize(rows, files, None, reports.normalize)
    assert redo.inputFiles() and stored.count() == 20
    _, redo, _ = renormalize(rows, files, stored, reports.normalize)
    assert redo.inputFiles() and redo.count() == 0


def test_neighbours_in_one_pass(spark):
    lines = spark.createDataFrame([(d, 0, n, f"{d}{n}") for d in ("a", None) for n in (1, 2, 4096, 9000)], "doc_id string, page_no int, line_no int, text string")
    near = statements.with_neighbours(lines)
    got = [(r.text, r.prev_text, r.next_text) for r in near.filter("doc_id = 'a'").orderBy("line_no").collect()]
    assert got == [("a1", None, "a2"), ("a2", "a1", "a4096"), ("a4096", "a2", "a9000"), ("a9000", "a4096", None)]
    assert near.filter("prev_text is null").count() == 2
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5  # each text moves twice, not four times


def test_wallet_lines_keep_their_text(spark):
    text = "13/02/2025 17:18:19 เงินเข้า 44.00 a\u0001b c 400.00 444.00"
    lines = spark.createDataFrame([(text,), ("13/02/2025 x\u0001y",)], "text string").withColumn("items", F.split("text", " "))
    parsed = lines.select(statements.parse_tmn().alias("r"))
    assert [r.r and (r.r.date, r.r.sec, r.r.code, float(r.r.amount), float(r.r.balance), r.r.descr, r.r.is_fee) for r in parsed.collect()] == [
        ("2025-02-13", 62299, "เงินเข้า", 44.0, 444.0, "a\u0001b c", False), None]
    assert parsed._jdf.queryExecution().analyzed().toString().count("regexp_extract(text") == 0  # one match for all groups
