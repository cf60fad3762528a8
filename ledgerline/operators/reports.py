"""Row arrays to canonical transactions and auxiliary records: report formats, gateway exports, generic files.

One pass over the rows: the format of a file picks the expressions of its rows; reasons for dropping are a column.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions import scalars as S
from ledgerline.functions import text as X
from ledgerline.operators.detect import column_index, detect_format, detect_reports
from ledgerline.rule_tables import DEFAULT, Rules
from ledgerline.schema import TXN, row_identity
from ledgerline.session import stage
from ledgerline.settings import Settings
from ledgerline.sources.rows import not_blank

_MANUAL = ["เวลาทำรายการ", "เวลาธนาคาร", "จำนวน", "สถานะ", "รหัสสมาชิก", "ชื่อเล่นสมาชิก", "รหัสรายการ", "ดำเนินการโดย", "หมายเหตุ"]
_MEMBER = ["รหัสสมาชิก", "ชื่อเล่นสมาชิก", "ชื่อสมาชิก", "สถานะ", "ดำเนินการโดย", "หมายเหตุ", "รหัสรายการ"]
# Headers each format reads; a row's cells are reduced to these, in this order, before parsing.
_COLUMNS = {
    "bo_main": ["วันที่ทำรายการ", "วันที่ธนาคาร", "จำนวนเงินฝากจริง", "จำนวนเงินถอนจริง", "ชื่อธนาคาร", "สมาชิก", "บัญชีลูกค้า", "โบนัส/โปรโมชั่น",
                "ชื่อโปรโมชั่น", "รหัสอ้างอิง", "เกิดโดย", "ทำรายการโดย", "สร้างโดย", "หมายเหตุ"],
    "manual_credit": [*_MANUAL, "เลขบัญชีธนาคารบริษัท", "ชื่อธนาคารสมาชิก", "เลขบัญชีธนาคารสมาชิก", "ชื่อบัญชีธนาคารสมาชิก", "เครดิตก่อน", "เครดิตหลัง"],
    "manual_payment": [*_MANUAL, "ช่องทาง", "บัญชีบริษัท", "เลขคำสั่งชำระ"],
    "manual_bonus": [*_MEMBER, "เวลาทำรายการ", "โปรโมชั่น", "ยอดก่อนเติม", "เครดิต", "โบนัส", "ยอดหลังเติม"],
    "comm_req": [*_MEMBER, "วัน/เวลา", "จำนวนเงิน"],
    "credit_out": [*_MEMBER, "เวลาทำรายการ", "จำนวน", "เครดิตก่อน", "เครดิตหลัง", "สร้างโดย"],
    "pm_provider": list(dict.fromkeys(n for group in (
        fixed.PM_ROW_STATUS, fixed.PM_ROW_TIME, fixed.PM_ROW_ID, fixed.PM_ROW_PAID, fixed.PM_ROW_RECEIVED, fixed.PM_ROW_REQUESTED, fixed.PM_ROW_FEE,
        fixed.PM_ROW_MEMBER, fixed.PM_ROW_CUST_NAME, fixed.PM_ROW_CUST_BANK, fixed.PM_ROW_REF, ["provider"]) for n in group)),
}


def _layout(formats: DataFrame) -> DataFrame:
    """Resolve the headers of each file once: the cell index of every column its format reads."""
    code = F.col("format_code")
    return formats.withColumn("layout", S.case_of([
        (code == f, F.array(*[column_index("hdr", n) for n in names])) for f, names in _COLUMNS.items()]))


class _Values:
    """Accessors to the extracted cells of one format."""

    def __init__(self, code: str):
        self.at = {n: i for i, n in enumerate(_COLUMNS[code])}

    def val(self, name: str) -> Column:
        """Trimmed cell under a header, '' when the file has no such column."""
        return F.get("vals", F.lit(self.at[name]))

    def any(self, names: list[str]) -> Column:
        return F.coalesce(*[F.when(self.val(n) != "", self.val(n)) for n in names], F.lit(""))


def _or(*cols) -> Column:
    return F.coalesce(*[S.blank_to_null(c) for c in cols])


_TIMES = {"bo_main": ["วันที่ธนาคาร", "วันที่ทำรายการ"], "manual_credit": ["เวลาธนาคาร", "เวลาทำรายการ"], "manual_payment": ["เวลาธนาคาร", "เวลาทำรายการ"],
          "manual_bonus": ["เวลาทำรายการ"], "comm_req": ["วัน/เวลา"], "credit_out": ["เวลาทำรายการ"]}


def _with_times(df: DataFrame, code: str, v: _Values) -> DataFrame:
    """``t``: the time that counts (bank before back office); ``bo_t``: the back-office time."""
    if code == "pm_provider":
        return df.withColumn("t", S.stamp(v.any(fixed.PM_ROW_TIME)))
    names = _TIMES[code]
    if len(names) == 1:
        return df.withColumn("t", S.stamp(v.val(names[0])))
    df = df.withColumns({"bank_t": S.stamp(v.val(names[0])), "bo_t": S.stamp(v.val(names[1]))})
    return df.withColumn("t", F.coalesce("bank_t", "bo_t"))


def _booked(minute: bool = True) -> dict[str, Column]:
    t, b = F.col("t"), F.col("bo_t")
    out = {"date": F.coalesce(t["date"], b["date"]), "sec": t["sec"], "bo_date": b["date"], "bo_sec": b["sec"],
           "cross_day": F.coalesce((t["date"] != b["date"]), F.lit(False)), "late_night": t["sec"] >= 82800}
    if minute:
        out["minute_precision"] = ~t["sec_precision"]
    return out


def _drop(*pairs) -> Column:
    return S.case_of(pairs)


_NO_BO_TIME = lambda: (F.col("bo_t").isNull(), fixed.DROP_NO_TIME)
_NO_TIME = lambda: (F.col("t").isNull(), fixed.DROP_NO_TIME)


def _member(v: _Values) -> dict[str, Column]:
    return {"member_code": v.val("รหัสสมาชิก"), "member_nick": v.val("ชื่อเล่นสมาชิก")}


def _bo_main(v: _Values) -> dict[str, Column]:
    val = v.val
    dep, wit = S.num(val("จำนวนเงินฝากจริง")), S.num(val("จำนวนเงินถอนจริง"))
    amount = F.when(dep != 0, dep).otherwise(wit)
    ch = X.channel_of(val("ชื่อธนาคาร"))
    pm = X.canonical_pm(ch["channel"])
    mem, cust = X.pipe_split(val("สมาชิก")), X.pipe_split(val("บัญชีลูกค้า"))
    return {
        **_booked(), "amount": amount, "direction": F.when(dep != 0, "deposit").otherwise("withdraw"),
        "account": F.coalesce(pm, _or(ch["terminal"]), F.lit("UNKNOWN")), "channel": F.coalesce(pm, ch["channel"]), "is_pm": pm.isNotNull(),
        "bank": F.when(~ch["is_bank_account"], ch["channel"]), "member_code": _or(mem["right"], mem["left"]), "member_nick": mem["left"],
        "cust_account": cust["left"], "cust_name": cust["right"], "bonus": S.num(val("โบนัส/โปรโมชั่น")), "promo": val("ชื่อโปรโมชั่น"),
        "ref": val("รหัสอ้างอิง"), "via": val("เกิดโดย"), "username": _or(val("ทำรายการโดย"), val("สร้างโดย")), "note": val("หมายเหตุ"),
        "drop_reason": _drop(_NO_BO_TIME(), (amount == 0, fixed.DROP_ZERO))}


def _manual(v: _Values) -> dict[str, Column]:
    val = v.val
    amount = S.num(val("จำนวน"))
    bad_status = ~X.ok_status(val("สถานะ"))
    manual_drop = _drop(_NO_BO_TIME(), (amount == 0, fixed.DROP_ZERO), (bad_status, fixed.DROP_STATUS))
    return {**_member(v), "amount": amount, "direction": F.lit("deposit"), "ref": val("รหัสรายการ"), "username": val("ดำเนินการโดย"),
              "note": val("หมายเหตุ"), "manual": F.lit(True), "drop_reason": manual_drop}


def _manual_credit(v: _Values) -> dict[str, Column]:
    val = v.val
    return {
        **_booked(), **_manual(v), "account": F.coalesce(_or(val("เลขบัญชีธนาคารบริษัท")), F.lit("UNKNOWN")), "channel": F.lit("MANUAL"),
        "is_pm": F.lit(False), "cust_bank": F.upper(val("ชื่อธนาคารสมาชิก")), "cust_account": val("เลขบัญชีธนาคารสมาชิก"),
        "cust_name": val("ชื่อบัญชีธนาคารสมาชิก"), "credit_before": S.num(val("เครดิตก่อน")), "credit_after": S.num(val("เครดิตหลัง"))}


def _manual_payment(v: _Values) -> dict[str, Column]:
    val = v.val
    ch = X.channel_of(val("ช่องทาง"))
    pm = X.canonical_pm(ch["channel"])
    return {
        **_booked(minute=False), **_manual(v), "account": F.coalesce(pm, _or(val("บัญชีบริษัท"), ch["terminal"]), F.lit("UNKNOWN")),
        "channel": F.coalesce(pm, _or(ch["channel"]), F.lit("MANUAL")), "is_pm": pm.isNotNull(), "pay_order": val("เลขคำสั่งชำระ")}


def _when() -> dict[str, Column]:
    return {"date": F.col("t")["date"], "sec": F.col("t")["sec"]}


def _manual_bonus(v: _Values) -> dict[str, Column]:
    val = v.val
    return {
        **_when(), **_member(v), "promo": val("โปรโมชั่น"), "status": val("สถานะ"), "before": S.num(val("ยอดก่อนเติม")), "credit": S.num(val("เครดิต")),
        "bonus": S.num(val("โบนัส")), "after": S.num(val("ยอดหลังเติม")), "username": val("ดำเนินการโดย"), "note": val("หมายเหตุ"), "drop_reason": _drop(_NO_TIME())}


def _comm_req(v: _Values) -> dict[str, Column]:
    val = v.val
    hints = X.note_hints(val("หมายเหตุ"))
    return {
        **_when(), **_member(v), "member_name": val("ชื่อสมาชิก"), "amount": S.num(val("จำนวนเงิน")), "status": val("สถานะ"), "approved": X.ok_status(val("สถานะ")),
        "entitled": hints["entitled"], "excess": hints["excess"], "username": val("ดำเนินการโดย"), "ref": val("รหัสรายการ"), "note": val("หมายเหตุ"),
        "drop_reason": _drop(_NO_TIME())}


def _credit_out(v: _Values) -> dict[str, Column]:
    val = v.val
    hints = X.note_hints(val("หมายเหตุ"))
    return {
        **_when(), **_member(v), "member_name": val("ชื่อสมาชิก"), "amount": S.num(val("จำนวน")), "before": S.num(val("เครดิตก่อน")), "after": S.num(val("เครดิตหลัง")),
        "status": val("สถานะ"), "username": _or(val("สร้างโดย"), val("ดำเนินการโดย")), "ref": val("รหัสรายการ"), "note": val("หมายเหตุ"),
        "entitled": hints["entitled"], "excess": hints["excess"], "drop_reason": _drop(_NO_TIME())}


def _pm_provider(v: _Values) -> dict[str, Column]:
    t, val, val_any = F.col("t"), v.val, v.any
    status = F.lower(val_any(fixed.PM_ROW_STATUS))
    by_name = F.when(F.col("file_name").contains("ถอน"), "withdraw").when(F.col("file_name").contains("ฝาก"), "deposit")
    direction = F.coalesce(by_name, F.when(val_any(fixed.PM_ROW_ID).rlike(fixed.PM_WITHDRAW_ID), "withdraw").otherwise("deposit"))
    amount = F.when(direction == "withdraw", S.num(val_any(fixed.PM_ROW_PAID))).otherwise(S.num(val_any(fixed.PM_ROW_RECEIVED)))
    named = F.lower(val("provider"))
    provider = F.coalesce(X.pm_provider_of("file_name"), X.pm_provider_of(named), _or(F.upper(named)), F.lit("PM"))
    requested = S.num(val_any(fixed.PM_ROW_REQUESTED))
    failed = F.concat(F.lit("รายการไม่สำเร็จ (PM: "), F.when(status == "", "-").otherwise(status), F.lit(")"))
    return {
        **_when(), "amount": amount, "requested": F.when(requested != 0, requested), "fee": S.num(val_any(fixed.PM_ROW_FEE)), "direction": direction,
        "account": provider, "channel": provider, "is_pm": F.lit(True), "company": provider, "subco": X.subco_of("file_name", "title"),
        "member_code": val_any(fixed.PM_ROW_MEMBER), "cust_name": val_any(fixed.PM_ROW_CUST_NAME), "cust_bank": val_any(fixed.PM_ROW_CUST_BANK),
        "ref": val_any(fixed.PM_ROW_REF), "status": status, "partial": status.contains("partial"), "cross_day": F.lit(False),
        "late_night": t["sec"] >= 82800, "minute_precision": ~t["sec_precision"],
        "drop_reason": _drop((~status.rlike(fixed.PM_SUCCESS), failed), _NO_TIME(), (amount == 0, fixed.DROP_ZERO))}


_PARSERS = {"bo_main": _bo_main, "manual_credit": _manual_credit, "manual_payment": _manual_payment, "manual_bonus": _manual_bonus,
            "comm_req": _comm_req, "credit_out": _credit_out, "pm_provider": _pm_provider}


_TYPES = {f.name: f.dataType for f in TXN.fields} | {
    "member_name": "string", "before": S.MONEY, "credit": S.MONEY, "after": S.MONEY, "approved": "boolean", "entitled": S.MONEY, "excess": S.MONEY}


def _finish(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Project onto TXN + auxiliary columns; money is rounded half up, blank text becomes NULL."""
    cols = []
    for name, kind in _TYPES.items():
        c = values.get(name)
        if c is None:
            c = F.lit(None)
        elif str(kind) == "StringType()" and name != "raw":
            c = S.blank_to_null(c)
        elif name == "date" or name == "bo_date":
            c = c.try_cast("date")
        elif "16,2" in str(kind):
            c = F.round(c, 2)
        cols.append(c.cast(kind).alias(name))
    out = df.select(*cols)
    return out.withColumn("amount_cents", F.round(F.col("amount") * 100).cast("bigint"))


def _identity(cfg: Settings) -> dict[str, Column]:
    seq = row_identity(F.col("file_seq"), F.col("row_no"))
    return {"txn_id": F.concat_ws("-", "file_id", "row_no"), "job_date": F.col("job_date"), "job_company": F.col("job_company"),
            "file_id": F.col("file_id"), "file_seq": F.col("file_seq"), "row_no": F.col("row_no"), "seq": seq, "raw": F.col("raw")}


def _info(formats: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file, staged: its size is known, so that a list of usual length is sent to the rows.  Moving the rows to their file
    instead leaves all of them in as many tasks as there are files, or in one."""
    return stage(formats.join(files, "file_id"), "formats")


def normalize_reports(rows: DataFrame, files: DataFrame, cfg: Settings = Settings(), formats: DataFrame | None = None) -> DataFrame:
    """All report formats.  ``files``: file_id, file_name, file_seq, job_date, job_company.

    Rows are routed once: joined to their file, reduced to the cells their format reads and written partitioned by
    format.  Each format present is then parsed from its own partition by a small projection that fits generated code.
    Output (staged) is TXN plus auxiliary columns; rows that do not count carry a ``drop_reason``.
    """
    formats = _layout(detect_reports(rows, files) if formats is None else formats).drop("hdr", "file_name")
    info = _info(formats, files.select("file_id", "file_name", "file_seq", "job_date", "job_company"))
    codes = [r[0] for r in info.select("format_code").distinct().collect()]  # at most one per known format
    data = rows.drop("file_seq").join(info, "file_id").filter((F.col("row_no") > F.col("header_row")) & not_blank())
    data = data.select("file_id", "file_name", "file_seq", "job_date", "job_company", "row_no", "side", "title", F.array_join("cells", " | ").alias("raw"), F.transform(
        "layout", lambda i: F.trim(F.coalesce(F.get("cells", i), F.lit("")))).alias("vals"), "format_code")
    routed = stage(data, "routed", partition_by="format_code")
    out = None
    for code in sorted(codes):
        v = _Values(code)
        part = _with_times(routed.filter(F.col("format_code") == code), code, v)
        values = _identity(cfg) | {"format_code": F.col("format_code"), "side": F.col("side"), "company": X.company_of("file_name")} | _PARSERS[code](v)
        wrong = (F.col("job_date").isNotNull() & (values["date"] != F.date_format("job_date", "yyyy-MM-dd"))
                 & ~F.coalesce(values.get("cross_day", F.lit(False)), F.lit(False)))
        values["drop_reason"] = F.coalesce(values["drop_reason"], F.when(wrong, fixed.DROP_WRONG_DATE))
        parsed = _finish(part, values)
        out = parsed if out is None else out.unionByName(parsed)
    if out is None:
        return files.sparkSession.createDataFrame([], _finish(files, {}).schema)
    return stage(out, "normalized")


def normalize_generic(rows: DataFrame, files: DataFrame, cfg: Settings = Settings(), formats: DataFrame | None = None) -> DataFrame:
    """Files of no known report, read through the header dictionary."""
    formats = detect_format(rows, files) if formats is None else formats
    info = _info(formats.withColumnsRenamed({"bank": "file_bank", "company": "file_company"}), files.select("file_id", "file_seq", "job_date", "job_company"))
    data = rows.drop("file_seq").join(info, "file_id").filter(F.col("row_no") > F.col("header_row")).withColumn("raw", F.array_join("cells", " | "))

    def cell(k: str) -> Column:
        return F.get("cells", F.try_element_at("map", F.lit(k)))

    def text(k: str) -> Column:
        return F.trim(F.coalesce(cell(k), F.lit("")))

    has = lambda k: F.map_contains_key("map", k)
    joined = F.lower(F.array_join("cells", " "))
    contains = lambda words: F.lit(cfg.filter_carry_forward) & S.any_of([joined.contains(w.lower()) for w in words])
    date_value = F.when(has("datetime"), cell("datetime")).otherwise(cell("date"))
    data = (data.withColumn("iso", S.iso_date_generic(date_value)).withColumn("clock", S.sec_of(F.when(has("time"), cell("time")).otherwise(date_value)))
            .withColumn("dr", S.num_of(cell("debit"))).withColumn("cr", S.num_of(cell("credit"))).withColumn("desc_text", text("desc")))
    paid_in, paid_out = F.coalesce(F.col("cr") != 0, F.lit(False)), F.coalesce(F.col("dr") != 0, F.lit(False))
    amount = F.coalesce(F.when(paid_in, F.col("cr")).when(paid_out, F.col("dr")), S.num_of(cell("amount")))
    account, row_bank = text("account"), F.upper(text("bank"))
    own = F.coalesce(_or(row_bank), F.upper(F.substring_index(account, "-", 1)))
    bank = F.when(F.col("source") == "bo", own).otherwise(F.coalesce("file_bank", own))
    marker, low = F.upper("desc_text"), F.lower("desc_text")
    not_bo = F.col("source") != "bo"
    scb = S.case_of([(marker.contains("X1"), "deposit"), (marker.contains("X2"), "withdraw"), (marker.contains("XB"), "adjustment")])
    gsb = S.case_of([(low.contains("transfer sav deposit") | low.contains("transfer from sav"), "deposit"), (low.contains("sav withdraw"), "withdraw")])
    by_marker = F.when(not_bo & (bank == "SCB"), scb).when(not_bo & (bank == "GSB"), gsb)
    d = F.upper(text("direction"))
    by_column = F.when(has("direction"), F.when(d.contains("DEPOSIT") | d.contains("ฝาก"), "deposit").when(d.contains("WITHDRAW") | d.contains("ถอน"), "withdraw"))
    by_amount = F.when(paid_in, "deposit").when(paid_out, "withdraw")
    status = F.upper(text("status"))
    failed = has("status") & F.lit(cfg.pm_success_only) & ~status.isin("", "SUCCESS", "สำเร็จ")
    reason = S.case_of([
        (contains(fixed.CARRY_FORWARD), fixed.DROP_CARRY), (contains(fixed.CYCLE_LINE), fixed.DROP_CYCLE), (F.col("clock").isNull(), fixed.DROP_NO_TIME),
        (F.col("job_date").isNotNull() & (F.col("iso") != F.date_format("job_date", "yyyy-MM-dd")), fixed.DROP_WRONG_DATE),
        (amount.isNull() | (amount == 0), fixed.DROP_NO_AMOUNT), (F.coalesce(by_marker == "adjustment", F.lit(False)), fixed.DROP_ADJUSTMENT),
        (failed, fixed.DROP_PM_STATUS)])
    final_account = F.coalesce(_or(account), F.lit("UNKNOWN"))
    values = _identity(cfg) | {
        "side": F.when(F.col("source") == "bo", "bo").otherwise("stm"), "sec": F.col("clock"),
        "date": F.coalesce("iso", F.date_format("job_date", "yyyy-MM-dd")), "amount": amount,
        "direction": F.coalesce(by_column, by_marker, by_amount, F.lit("deposit")), "account": final_account,
        "bank": F.coalesce(_or(bank), F.upper(F.substring_index(final_account, "-", 1))), "company": F.coalesce("file_company", _or(text("company"))),
        "username": text("username"), "ref": text("txid"), "descr": F.col("desc_text"), "cross_day": F.col("clock") >= cfg.late_night_sec, "drop_reason": reason}
    return stage(_finish(data, values), "normalized")


def normalize(rows: DataFrame, files: DataFrame, cfg: Settings = Settings(), rules: Rules = DEFAULT) -> DataFrame:
    """Report formats first, the header dictionary for the remaining files; ``rules`` may add to either."""
    formats = stage(detect_reports(rows, files, rules), "formats")
    known = formats.select("file_id")
    rest = files.join(known, "file_id", "left_anti")
    others = rows.join(known, "file_id", "left_anti")
    return normalize_reports(rows, files, cfg, formats).unionByName(normalize_generic(others, rest, cfg, detect_format(others, rest, rules)))


def bonuses(normalized: DataFrame) -> DataFrame:
    return _kept(normalized, "manual_bonus")


def commissions(normalized: DataFrame) -> DataFrame:
    return _kept(normalized, "comm_req")


def credit_cuts(normalized: DataFrame) -> DataFrame:
    return _kept(normalized, "credit_out")


def transactions(normalized: DataFrame) -> DataFrame:
    return normalized.filter("drop_reason is null and side <> 'aux'").select(*TXN.fieldNames())


def _kept(normalized: DataFrame, code: str) -> DataFrame:
    return normalized.filter(F.col("drop_reason").isNull() & (F.col("format_code") == code))


# ------------------------------------------------------------------------------------------ per-file reports
def quarantine_counts(normalized: DataFrame) -> DataFrame:
    return normalized.filter("drop_reason is not null").groupBy("file_id", "drop_reason").agg(F.count(F.lit(1)).alias("n"))


def channel_stats(normalized: DataFrame) -> DataFrame:
    """Per file and channel: rows, amount, whether it is a gateway."""
    kept = normalized.filter("drop_reason is null and side <> 'aux'")
    channel = F.coalesce("channel", F.lit("ไม่ระบุ"))
    return kept.groupBy("file_id", channel.alias("channel")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("amount").alias("amount")).withColumn("is_pm", X.canonical_pm("channel").isNotNull())


def file_warnings(files: DataFrame, normalized: DataFrame, generic_formats: DataFrame | None = None) -> DataFrame:
    """Per file an array of warnings: nothing usable, unknown source, gateway channels that need a statement."""
    kept = normalized.groupBy("file_id").agg(F.count_if(F.col("drop_reason").isNull()).alias("kept"), F.max("format_code").alias("code"))
    gateways = channel_stats(normalized).filter("is_pm").groupBy("file_id").agg(F.array_join(F.array_sort(
        F.collect_set(F.concat("channel", F.lit(" "), F.col("count").cast("string"), F.lit(" รายการ")))), ", ").alias("pm"))
    out = files.select("file_id").join(kept, "file_id", "left").join(gateways, "file_id", "left")
    unknown = F.lit(None).cast("string")
    if generic_formats is not None:
        out = out.join(generic_formats.select("file_id", "source"), "file_id", "left")
        unknown = F.when(F.col("code").isNull() & (F.col("source") == "unknown"), fixed.WARN_UNKNOWN_SOURCE)
    none = F.coalesce("kept", F.lit(0)) == 0
    empty = F.when(none & F.col("code").isNull(), fixed.WARN_NO_ROWS).when(none, fixed.WARN_REPORT_EMPTY)
    gateway = F.when(F.col("pm").isNotNull() & F.col("code").isNotNull(), F.concat(
        F.lit(fixed.WARN_PM_PREFIX), "pm", F.lit(" — ต้องมีไฟล์ statement ของช่องทางนี้จึงจะจับคู่ได้")))
    return out.select("file_id", F.array_compact(F.array(empty, unknown, gateway)).alias("warnings"))
