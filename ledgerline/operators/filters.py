"""Row filters, review checks and masking."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions import scalars as S
from ledgerline.settings import Settings


def in_range(date, start, end) -> Column:
    """Inclusive; a missing or "-" date passes."""
    d = S.col(date).cast("string")
    return d.isNull() | (d == "") | (d == "-") | F.substring(d, 1, 10).between(str(start), str(end))


def _contains(columns: list[str], query: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).contains(query.lower())


def exception_filter(df: DataFrame, start=None, end=None, company="ALL", direction="ALL", shift="ALL", type_="ALL", severity="ALL",
                     status="ALL", over_sla: bool = False, query: str | None = None) -> DataFrame:
    """Conjunction of the review filters; plain predicates, so they reach the scan."""
    if start is not None:
        df = df.filter(in_range("date", start, end))
    for column, wanted in (("company", company), ("direction", direction), ("shift", shift), ("type", type_), ("severity", severity), ("status", status)):
        if wanted != "ALL":
            df = df.filter(F.col(column) == wanted)
    if over_sla:
        df = df.filter("over_sla")
    if query:
        df = df.filter(_contains(["id", "account", "employee", "type_name", "cause", "bank"], query))
    return df


def link_search(links: DataFrame, query: str | None = None, company: str | None = None) -> DataFrame:
    """Text search over name, url, category, company and group."""
    if company is not None:
        links = links.filter(F.col("company_id") == company)
    q = (query or "").strip().lower()
    if q:
        links = links.filter(S.any_of([F.lower(F.coalesce(c, F.lit(""))).contains(q) for c in ("name", "url", "category", "company_name", "group_name")]))
    return links


def open_incidents(incidents: DataFrame, company: str | None = None, newest: int | None = None) -> DataFrame:
    """Open incidents, newest first; ``newest`` limits a listing."""
    found = incidents.filter("status <> 'CLOSED'")
    if company is not None:
        found = found.filter(F.col("company_id") == company)
    found = found.orderBy(F.col("detected_at").desc(), "id")
    return found if newest is None else found.limit(newest)


def active_cases(exceptions: DataFrame) -> DataFrame:
    return exceptions.filter(~F.col("status").isin(fixed.CLOSED_STATES))


def three_point_check(exceptions: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Account, time, amount and business-rule checks with their score out of four."""
    tol = F.when(F.col("direction") == fixed.DIRECTION_WITHDRAW, cfg.tolerance_withdraw).otherwise(cfg.tolerance_deposit)
    both = F.col("bank_amount").isNotNull() & F.col("system_amount").isNotNull()
    checks = {"account_ok": F.lit(True), "time_ok": F.col("time_diff_sec") <= tol,
              "amount_ok": both & (F.abs("amount_diff") < cfg.diff_alert), "rule_ok": ~F.col("type").isin(fixed.RULE_BREACH_TYPES)}
    out = exceptions.withColumns(checks)
    return out.withColumn("score", sum((F.col(c).cast("int") for c in checks), F.lit(0)))


def diff_label() -> Column:
    """Typed difference text."""
    money = lambda c: F.format_number(F.col(c), 2)
    t, seconds = F.col("type"), F.concat(F.col("time_diff_sec").cast("string"), F.lit(" วิ"))
    return (F.when(t == "amount_diff", money("amount_diff")).when(t == "time_diff", seconds)
            .when(t == "cross_day", F.concat(F.lit("ข้ามวัน "), seconds)).when(t == "missing_bo", "ไม่พบใน BO").when(t == "missing_stm", "ไม่พบใน STM")
            .when(t == "duplicate", F.concat(F.lit("ซ้ำ "), money("risk_amount"))).otherwise(money("risk_amount")))


def close_checklist(cases: DataFrame) -> DataFrame:
    """Six conditions a case must meet before it may be closed."""
    text = lambda c: S.blank_to_null(c).isNotNull()
    checks = {"has_raw": F.lit(True), "has_cause": text("cause"), "has_owner": text("employee"), "has_evidence": F.coalesce("has_evidence", F.lit(False)),
              "has_note": F.size(F.coalesce("notes", F.array().cast("array<string>"))) > 0,
              "amount_settled": F.col("status").isin("damage", "approved", "closed")}
    out = cases.withColumns(checks)
    ready = F.lit(True)
    for c in checks:
        ready = ready & F.col(c)
    return out.withColumn("ready", ready)


def cycle_closable(damages: DataFrame) -> DataFrame:
    """A cycle closes only when no damage of it lacks evidence."""
    return damages.groupBy("cycle").agg(F.count_if(~F.coalesce("has_evidence", F.lit(False))).alias("without_evidence")).withColumn(
        "closable", F.col("without_evidence") == 0)


def mask_account(account, restricted) -> Column:
    """Account number, masked to its last four digits where ``restricted`` holds."""
    a = S.col(account)
    return F.when(restricted, F.concat(F.lit("******"), F.right(a, F.lit(4)))).otherwise(a)


def retention_filter(df: DataFrame, today: Column, months: int = 12, column: str = "business_date") -> DataFrame:
    """Keep the last N months; the predicate is on the partition column."""
    return df.filter(F.col(column) >= F.add_months(today, -months))


def live_exception_view(exceptions: DataFrame, now: Column) -> DataFrame:
    """Stored exceptions with defaults filled, age from creation and SLA breach."""
    text = lambda c, d: F.coalesce(S.blank_to_null(c), F.lit(d))
    severity = text("severity", "medium")
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("created_at", now))) / 3600)).cast("bigint")
    sla = F.coalesce(S.sla_hours(severity), F.lit(48))
    status = text("status", "open")
    return exceptions.select(
        F.coalesce(S.blank_to_null("code"), F.col("id").cast("string")).alias("id"), F.col("run_id"), F.col("business_date").alias("date"),
        F.substring(F.coalesce("occurred_at", F.lit("")), 1, 8).alias("time"), text("company", "ไม่ระบุ").alias("company"), text("bank", "-").alias("bank"),
        text("account", "-").alias("account"), text("direction", "-").alias("direction"), text("member_code", "-").alias("member"),
        text("ex_type", "unknown").alias("type"), F.coalesce(S.blank_to_null("type_name"), S.blank_to_null("ex_type"), F.lit("ยังไม่จำแนก")).alias("type_name"),
        severity.alias("severity"), status.alias("status"), "system_amount", "bank_amount", F.coalesce("amount_diff", F.lit(0)).alias("amount_diff"),
        F.coalesce("risk_amount", F.lit(0)).alias("risk_amount"), F.coalesce("time_diff_sec", F.lit(0)).alias("time_diff_sec"),
        text("employee", fixed.NO_EMPLOYEE).alias("employee"), text("shift", "day").alias("shift"), text("cause", "รอตรวจสอบสาเหตุ").alias("cause"),
        age.alias("age_hours"), sla.alias("sla_hours"), ((age > sla) & ~status.isin(fixed.CLOSED_STATES)).alias("over_sla"))


def sort_page(df: DataFrame, column: str, ascending: bool = True, page: int = 1, *, size: int, tie: str = "id") -> DataFrame:
    """One page in a total order; a page beyond the last shows the last one."""
    last = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size))
    page = min(page, df.agg(last.alias("n")).first()["n"]) if page > 1 else 1
    key = F.col(column).asc() if ascending else F.col(column).desc()
    return df.orderBy(key, tie).offset((page - 1) * size).limit(size)


def middle_date(dates: DataFrame, column: str = "date") -> DataFrame:
    """First, middle and last of the distinct dates.  Distinct dates are few, whatever the number of rows."""
    days = F.sort_array(F.collect_set(column))
    return dates.agg(days.alias("d")).select(F.element_at("d", 1).alias("first"), F.element_at("d", -1).alias("last"),
                                             F.element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int")).alias("middle"))


def seen_values(configured: DataFrame, *observed: DataFrame) -> DataFrame:
    """Configured values followed by unseen observed ones (code, name)."""
    both = observed[0]
    for o in observed[1:]:
        both = both.unionByName(o)
    new = both.filter("code is not null").groupBy("code").agg(F.min("name").alias("name")).join(configured.select("code"), "code", "left_anti")
    return configured.select("code", "name", F.lit(True).alias("configured")).unionByName(new.withColumn("configured", F.lit(False)))


def companies_without_system(seen: DataFrame, systems: DataFrame) -> DataFrame:
    assigned = systems.filter("system is not null").select("company")
    return seen.filter("company is not null and company <> '-'").select("company").distinct().join(assigned, "company", "left_anti")
