"""Run tables and report files."""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import filters, kpi
from ledgerline.schema import JOB


def exception_rows(exceptions: DataFrame, run_id_col: str = "run_id") -> DataFrame:
    """Persisted shape of an exception, evidence in full."""
    return exceptions.select(
        F.col(run_id_col).alias("run_id"), F.col("id").alias("code"), F.coalesce("date", "job_date").alias("business_date"), F.col("time").alias("occurred_at"),
        F.coalesce(S.blank_to_null("company"), F.col("job_company")).alias("company"), "bank", "account", "direction", S.blank_to_null("member").alias("member_code"),
        F.col("type").alias("ex_type"), "type_name", F.when(F.col("severity").isin("critical", "high", "medium", "low"), F.col("severity")).otherwise("medium").alias("severity"),
        F.coalesce("status", F.lit("open")).alias("status"), "system_amount", "bank_amount", "amount_diff", "risk_amount", "time_diff_sec", "employee", "shift",
        "cause", S.blank_to_null("detail").alias("detail"), "stm_raw", "bo_raw")


def run_rows(summary: DataFrame, run_by: str) -> DataFrame:
    """Persisted shape of a run; one per job.  ``summary`` has run_id, job_id, created_at, file_ids and elapsed_ms beside the counts."""
    return summary.select(
        F.col("run_id").alias("id"), F.col("job_date").alias("business_date"), F.col("job_company").alias("company"), F.lit(run_by).alias("run_by"), "created_at",
        "file_ids", "elapsed_ms", "stm_count", "bo_count", "matched", F.round("match_rate", 3).cast("decimal(6,3)").alias("match_rate"), "exception_count", "no_stm_count",
        F.to_json(F.struct("job_id", "rules_only", "near_tolerance")).alias("summary"))


def write_run(run, folder: str, run_by: str = "spark", jobs: DataFrame | None = None, created_at: dt.datetime | None = None, elapsed_ms: int | None = None,
              token: str | None = None) -> None:
    """Append a run to the tables ``exceptions`` and ``runs`` of ``folder``.

    Every run has an id of its own per job, so a rerun without exceptions leaves none in force: readers take the latest run of a job
    and the exceptions of that id.  ``jobs`` (id, business_date, company) gives the job ids; without it a job's date and company are
    its id.  The exceptions are written first, so a run that is listed is complete.
    """
    token = token or uuid.uuid4().hex
    run_id = F.concat_ws("/", F.col("job_date").cast("string"), "job_company", F.lit(token)).alias("run_id")
    ex = run.exceptions.withColumn("run_id", run_id)
    _appended(exception_rows(ex), f"{folder}/exceptions")
    files = run.stm.select(*JOB, "file_id").union(run.bo.select(*JOB, "file_id")).filter("file_id is not null").distinct()
    files = files.groupBy(*JOB).agg(F.array_sort(F.collect_list("file_id")).alias("file_ids"))  # the files of one job
    rows = run.summary().join(files, JOB, "left").withColumn("file_ids", F.coalesce("file_ids", F.array().cast("array<string>")))
    own = F.concat_ws("/", F.col("job_date").cast("string"), "job_company")
    if jobs is not None:
        ids = jobs.select(F.col("business_date").alias("job_date"), F.col("company").alias("job_company"), F.col("id").cast("string").alias("job_id"))
        rows = rows.join(ids, JOB, "left").withColumn("job_id", F.coalesce("job_id", own))
    else:
        rows = rows.withColumn("job_id", own)
    stamp = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    rows = rows.withColumns({"run_id": run_id, "created_at": stamp, "elapsed_ms": F.lit(elapsed_ms).cast("bigint")})
    _appended(run_rows(rows, run_by), f"{folder}/runs")


def _appended(df: DataFrame, path: str) -> None:
    """Files of the advisory size per day, however many rows a day has."""
    df.hint("rebalance", "business_date").write.mode("append").partitionBy("business_date").parquet(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    """Every cell quoted, CRLF line ends, byte-order mark ahead of the header."""
    names = [f"﻿{c}" if i == 0 else c for i, c in enumerate(df.columns)]
    df.toDF(*names).write.mode("overwrite").option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").option("header", True).csv(path)


def report_tables(exceptions: DataFrame, damages: DataFrame, employees: DataFrame, hourly: DataFrame, monthly: DataFrame, intake: DataFrame,
                  audit: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    """The seven report datasets of a date range."""
    ex = filters.exception_filter(exceptions, start, end)
    rate = F.round(F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("total")), F.lit(0.0)), 2)
    return {
        "exceptions": ex.select("id", "date", "time", "company", "account", "bank", "direction", "type_name", "system_amount", "bank_amount", "amount_diff",
                                "risk_amount", "time_diff_sec", "severity", "status", "employee", "shift", "member", "age_hours", "sla_hours", "over_sla", "cause", "detail"),
        "damage": damages.filter(filters.in_range("business_date", start, end)).select(
            "id", "exception_id", "business_date", "cycle", "company", "employee", "shift", "amount", "cause", F.when(F.col("has_evidence"), "ครบ").otherwise("รอ").alias("evidence")),
        "kpi": kpi.employee_kpi(ex, employees),
        "daily": hourly.withColumn("match_pct", rate),
        "monthly": monthly.filter(F.col("ym").between(start[:7], end[:7])),
        "intake": intake,
        "audit": kpi.audit_log_range(audit, start, end),
    }


def write_reports(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_csv_report(df, f"{folder}/reports/{name}")
