"""Dashboards and reports: counts, sums, shares and rankings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions import scalars as S


def _dim(spark: SparkSession, rows, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def shifts(spark: SparkSession) -> DataFrame:
    return _dim(spark, [(s, i) for i, s in enumerate(fixed.SHIFTS)], "shift string, ord int")


def severities(spark: SparkSession) -> DataFrame:
    return _dim(spark, [(c, h, i) for i, (c, h) in enumerate(fixed.SLA_HOURS)], "severity string, sla_hours int, ord int")


def types(spark: SparkSession) -> DataFrame:
    return _dim(spark, [(c, n, s, i) for i, (c, n, s) in enumerate(fixed.CATALOG_TYPES)], "type string, type_name string, base_severity string, ord int")


def count_by(df: DataFrame, column: str, dimension: DataFrame | None = None) -> DataFrame:
    """Counts per value; with a dimension every value appears, zero-filled."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if dimension is None:
        return counts
    return dimension.join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_k(df: DataFrame, column: str, k: int, amount: str | None = None) -> DataFrame:
    """Largest k values by count or by the sum of ``amount``; ties break on the value."""
    measure = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return df.groupBy(column).agg(measure.alias("value")).orderBy(F.col("value").desc(), column).limit(k)


def newest_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows in the given order."""
    return df.orderBy(*order).limit(n)


def damage_by(damages: DataFrame, column: str, k: int | None = None, positive: bool = False) -> DataFrame:
    out = damages.groupBy(column).agg(F.sum("amount").alias("amount"))
    if positive:
        out = out.filter("amount > 0")
    return out if k is None else out.orderBy(F.col("amount").desc(), column).limit(k)


def employee_kpi(exceptions: DataFrame, employees: DataFrame) -> DataFrame:
    """Per employee: cases, critical, high, over SLA, amount at risk, risk band.  Zero-filled."""
    e = exceptions.groupBy("employee").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if("over_sla").alias("over_sla"), F.sum("risk_amount").alias("risk_amount"))
    out = employees.join(e, "employee", "left").na.fill(0, ["cases", "critical", "high", "over_sla"]).withColumn("risk_amount", F.coalesce("risk_amount", F.lit(0)))
    return out.withColumn("band", F.when((F.col("critical") >= 4) | (F.col("over_sla") >= 5), fixed.RISK_HIGH)
                          .when(F.col("critical") >= 2, fixed.RISK_MID).otherwise(fixed.RISK_LOW))


def intake_status(files: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return files.agg(n("received").alias("received"), n("late").alias("late"), n("missing").alias("missing"), n("wrong_company").alias("wrong_company"),
                     (n("missing") + n("wrong_company")).alias("blocked"))


def monthly_trend(damages: DataFrame, prevented: DataFrame | None = None) -> DataFrame:
    """Per month damage, cases and the change against the previous month in percent (one decimal)."""
    month = F.date_format("business_date", "yyyy-MM").alias("ym")
    t = damages.groupBy(month).agg(F.sum("amount").alias("damage"), F.count(F.lit(1)).alias("cases"))
    if prevented is not None:
        t = t.join(prevented.groupBy(month).agg(F.sum("amount").alias("prevented")), "ym", "left").withColumn("prevented", F.coalesce("prevented", F.lit(0)))
    prev = F.lag("damage").over(Window.orderBy("ym"))  # one row per month: the window is as long as the retention period
    return t.withColumn("change_pct", F.round(F.coalesce(F.try_divide((F.col("damage") - prev) * 100, prev), F.lit(0)), 1))


def approval_counts(exceptions: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return exceptions.agg(n("clarifying").alias("clarifying"), n("answered").alias("answered"), n("damage").alias("damage"), n(*fixed.CLOSED_STATES).alias("closed"))


def approval_queue(exceptions: DataFrame, n: int | None = None) -> DataFrame:
    """Cases that wait for a decision, oldest first; ``n`` limits a listing."""
    waiting = exceptions.filter(F.col("status").isin("answered", "clarifying", "damage"))
    return waiting.orderBy("date", "id") if n is None else newest_n(waiting, [F.col("date"), F.col("id")], n)


def with_track(exceptions: DataFrame, systems: DataFrame) -> DataFrame:
    """Clarification track of the company's system; unassigned companies go to the cycle track and are flagged."""
    s = systems.select("company", "system", F.col("track").alias("system_track"))
    t = exceptions.drop("track").join(s, "company", "left")
    return t.withColumn("track", F.coalesce("system_track", F.lit("cycle"))).withColumn("system_unassigned", F.col("system").isNull()).drop("system_track")


def clarify_groups(cases: DataFrame) -> DataFrame:
    """Open cases per clarification group: the daily track by shift, the cycle track by cycle; counts and risk."""
    open_ = cases.filter(~F.col("status").isin(fixed.CLOSED_STATES))
    key = F.when(F.col("track") == "daily", F.col("shift")).otherwise(S.cycle_of("date")["code"])
    return open_.groupBy("track", key.alias("group_key")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("risk_amount").alias("risk_amount"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"))


def cases_per_company(cases: DataFrame) -> DataFrame:
    return cases.filter(~F.col("status").isin(fixed.CLOSED_STATES)).groupBy("company").agg(F.count(F.lit(1)).alias("cases"))


def request_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("doc_no").agg(F.count(F.lit(1)).alias("item_count"), F.coalesce(F.sum("risk_amount"), F.lit(0)).alias("total_amount"))


def shift_share(exceptions: DataFrame) -> DataFrame:
    """Per day and shift: cases, share of the day in percent (one decimal), amount at risk, critical."""
    per = exceptions.groupBy("date", "shift").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_amount").alias("risk_amount"),
                                                  F.count_if(F.col("severity") == "critical").alias("critical"))
    total = F.sum("n").over(Window.partitionBy("date"))  # three rows per day
    return per.withColumn("share_pct", F.round(F.col("n") * 100.0 / total, 1))


def sla_breaches(exceptions: DataFrame) -> DataFrame:
    return exceptions.filter("over_sla").groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.max("age_hours").alias("oldest_hours"))


def match_share(hourly: DataFrame) -> DataFrame:
    m, t = F.coalesce(F.sum("matched"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))
    return hourly.agg(t.alias("total"), m.alias("matched"), (t - m).alias("rest"),
                      F.round(F.coalesce(F.try_divide(m * 100.0, t), F.lit(0.0)), 2).alias("match_pct"))


def notification_rules(files: DataFrame, exceptions: DataFrame, cycles: DataFrame, damages: DataFrame) -> DataFrame:
    """Alert rows: files missing, open criticals, SLA breaches, open cycle.  A rule with nothing to say yields no row."""
    open_ = exceptions.filter(~F.col("status").isin(fixed.CLOSED_STATES))
    row = lambda df, rule, level, n, amount: df.agg(F.lit(rule).alias("rule"), F.lit(level).alias("level"), n.alias("n"), amount.alias("amount"))
    none, one = F.lit(0).cast("decimal(38,2)"), F.count(F.lit(1))
    out = row(files.filter(F.col("status").isin("missing", "wrong_company")), "file_missing", "bad", one, none)
    out = out.unionByName(row(open_.filter("severity = 'critical'"), "critical_exception", "bad", one, F.coalesce(F.sum("risk_amount"), F.lit(0)).cast("decimal(38,2)")))
    out = out.unionByName(row(open_.filter("over_sla"), "sla_breach", "warn", one, none))
    first = cycles.filter("status = 'open'").orderBy("cycle").limit(1)
    waiting = damages.join(first.select("cycle"), "cycle", "left_semi")
    due = first.select(F.lit("cycle_due").alias("rule"), F.lit("info").alias("level"),
                       waiting.agg(F.count(F.lit(1))).scalar().alias("n"), none.alias("amount"))
    return out.filter("n > 0").unionByName(due)


def detection_report(injected: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Injected against found counts per type; in band when found is within 0.8 to 1.6 times the injected."""
    found = exceptions.groupBy("type").agg(F.count(F.lit(1)).alias("found"))
    t = injected.join(found, "type", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return t.withColumn("in_band", F.col("found").between(F.col("injected") * 0.8, F.col("injected") * 1.6))


def daily_report(hourly: DataFrame, files: DataFrame, exceptions: DataFrame, damages: DataFrame) -> DataFrame:
    """One row of totals; scalar subqueries instead of joins of one-row tables."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (hourly.agg(z("total").alias("total"), z("matched").alias("matched"), z("exceptions").alias("exceptions"))
            .withColumn("problem_files", files.agg(F.count_if(F.col("status") != "received")).scalar())
            .withColumn("over_sla", exceptions.agg(F.count_if("over_sla")).scalar())
            .withColumn("damage", damages.agg(z("amount")).scalar()))


def type_catalog(exceptions: DataFrame) -> DataFrame:
    spark = exceptions.sparkSession
    t = count_by(exceptions, "type", types(spark))
    return t.withColumn("sla_hours", S.sla_hours("base_severity")).orderBy("ord")


def audit_log_range(log: DataFrame, start, end) -> DataFrame:
    return log.filter(F.to_date("at").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


# ------------------------------------------------------------------------------------------ case overlay
def case_overlay(exceptions: DataFrame, events: DataFrame) -> DataFrame:
    """Latest stored status, evidence and notes override the exceptions by id; the event log is append-only."""
    from ledgerline.operators.jobs import latest_per_key
    o = latest_per_key(events, ["id"], "at").select("id", F.col("status").alias("o_status"), F.col("has_evidence").alias("o_evidence"), F.col("notes").alias("o_notes"))
    t = exceptions.join(o, "id", "left")
    have = set(exceptions.columns)
    t = t.withColumn("status", F.coalesce("o_status", "status"))
    t = t.withColumn("has_evidence", F.coalesce("o_evidence", F.col("has_evidence") if "has_evidence" in have else F.lit(False)))
    return t.withColumn("notes", F.coalesce("o_notes", F.col("notes") if "notes" in have else F.lit(None).cast("array<string>"))).drop("o_status", "o_evidence", "o_notes")


def extra_damages(damages: DataFrame, extra: DataFrame) -> DataFrame:
    return damages.unionByName(extra.join(damages.select("id"), "id", "left_anti"), allowMissingColumns=True)


def damages_from_cases(cases: DataFrame) -> DataFrame:
    """Damage register rows of the cases settled as damage."""
    return cases.filter("status = 'damage'").select(
        F.concat(F.lit("DMG-"), "id").alias("id"), F.col("id").alias("exception_id"), F.col("date").alias("business_date"), "company", "employee", "shift",
        F.when(F.col("risk_amount") != 0, F.col("risk_amount")).otherwise(F.abs("amount_diff")).alias("amount"), "cause",
        S.cycle_of("date")["code"].alias("cycle"), "has_evidence")
