"""Mail intake, file completeness, job state and run views."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions import scalars as S
from ledgerline.functions import text as X
from ledgerline.operators.ranking import previous_row, seq_block
from ledgerline.settings import Settings

KEY = ["business_date", "company"]


def latest_per_key(df: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """Newest row per key.  ``max_by`` combines on the map side, so a key with very many versions is no problem."""
    order = [order] if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def upsert_latest(current: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Idempotent ingest on a natural key: the latest version of each row."""
    return latest_per_key(current.unionByName(incoming, allowMissingColumns=True), keys, order)


def normalize_mail_source(batches: DataFrame, sources: DataFrame) -> DataFrame:
    """Sender address, source name, business system and a repaired company."""
    b = batches.withColumn("source_email", F.coalesce(F.lower(S.blank_to_null("source_email")), X.sender_email("sender")))
    known = sources.filter("active").select(F.col("email").alias("source_email"), "display_name", "business_systems")
    b = b.join(known, "source_email", "left")
    subject = F.coalesce("subject", F.lit(""))
    single = F.when(F.size("business_systems") == 1, F.element_at("business_systems", 1))
    named = S.case_of([(subject.rlike(p), name) for p, name in fixed.MAIL_SYSTEMS])
    b = b.withColumn("source_name", F.coalesce("source_name", "display_name")).withColumn(
        "business_system", F.coalesce(named, "business_system", single))
    reserved = F.col("company").isNull() | F.upper("company").isin(fixed.RESERVED_COMPANIES)
    repaired = F.coalesce(S.case_of([(subject.rlike(p), name) for p, name in fixed.MAIL_COMPANIES]), F.col("business_system"))
    return b.withColumn("company", F.when(reserved, repaired).otherwise(F.col("company"))).drop("display_name", "business_systems")


def batch_files(batches: DataFrame, files: DataFrame) -> DataFrame:
    """Mails with their files, one row per file (one row for a mail without any)."""
    f = files.select(F.col("batch_id"), F.col("id").alias("file_id"), *[c for c in files.columns if c not in ("id", "batch_id", "company")])
    return batches.withColumnRenamed("id", "batch_id").withColumnRenamed("status", "batch_status").join(f, "batch_id", "left")


def batch_listing(batches: DataFrame, files: DataFrame, start=None, end=None, company: str | None = None, page: int = 0, size: int | None = None) -> DataFrame:
    """Mails with their files in long form; with ``size`` one page of them, newest first."""
    b = batches
    if start is not None:
        b = b.filter(F.col("business_date") >= F.lit(start).cast("date"))
    if end is not None:
        b = b.filter(F.col("business_date") <= F.lit(end).cast("date"))
    if company not in (None, "ALL"):
        b = b.filter(F.col("company") == company)
    if size is not None:
        b = b.orderBy(F.col("received_at").desc(), "id").offset(page * size).limit(size)
    return batch_files(b, files)


def _effective(batches: DataFrame, files: DataFrame) -> DataFrame:
    f = files.select("batch_id", F.col("id").alias("file_id"), "file_name", "kind", "parsed", "parse_error", F.col("company").alias("file_company"))
    b = batches.select(F.col("id").alias("batch_id"), "business_date", "business_system", F.col("company").alias("batch_company"))
    return f.join(b, "batch_id").withColumn("company", F.coalesce("file_company", "batch_company"))


def job_completeness(batches: DataFrame, files: DataFrame) -> DataFrame:
    """Per (date, company): mails, files, parsed, errors, kinds present, system."""
    t = _effective(batches, files).filter("business_date is not null and company is not null")
    return t.groupBy(*KEY).agg(
        F.count_distinct("batch_id").alias("mail_count"), F.count("file_id").alias("file_count"), F.count_if(F.col("parsed")).alias("parsed_count"),
        F.count_if(F.col("parse_error").isNotNull()).alias("error_count"),
        F.array_sort(F.collect_set(X.effective_kind("file_name", "kind"))).alias("present_kinds"), F.max("business_system").alias("business_system"))


def with_requirement(jobs: DataFrame, requirements: DataFrame) -> DataFrame:
    """The company's active rule, else the active '*' rule."""
    active = requirements.filter("active").drop("active")
    cols = [c for c in active.columns if c != "company"]
    own = active.filter("company <> '*'").select("company", F.struct(*cols).alias("own"))
    default = active.filter("company = '*'").limit(1).select(F.struct(*cols).alias("d"))
    t = jobs.join(own, "company", "left").withColumn("r", F.coalesce("own", default.scalar()))
    return t.select(*jobs.columns, "r.*")


def missing_groups(jobs: DataFrame) -> DataFrame:
    """Required groups (AND of ORs) none of whose kinds is present."""
    return jobs.withColumn("missing_groups", F.filter("required_groups", lambda g: ~F.arrays_overlap(g, F.col("present_kinds"))))


def missing_text(groups) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.array_join(g, " / ")), ", ")


def job_status(jobs: DataFrame, previous: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    """State of each job from its completeness and the previous snapshot (KEY, status, file_count, attempt_count, late_file)."""
    old = previous.select(*KEY, F.col("status").alias("old_status"), F.col("file_count").alias("old_files"),
                          F.col("attempt_count").alias("old_attempts"), F.col("late_file").alias("old_late"))
    t = jobs.join(old, KEY, "left")
    same = F.coalesce(F.col("file_count") == F.col("old_files"), F.lit(False))
    complete = (F.size("missing_groups") == 0) & (F.col("file_count") > 0)
    was = lambda s: F.coalesce(F.col("old_status") == s, F.lit(False))
    state = (F.when(was("running"), "running")
             .when(complete & was("completed") & same, "completed")
             .when(complete & was("error") & same & (F.coalesce("old_attempts", F.lit(0)) >= cfg.max_attempts), "error")
             .when(complete, "ready").otherwise("waiting_files"))
    late = complete & was("completed") & ~same & ~was("running")
    local = F.to_timestamp(F.concat_ws(" ", F.date_add("business_date", F.col("close_day_offset")).cast("string"), F.col("close_time")))
    t = (t.withColumn("cutoff_at", F.to_utc_timestamp(local, cfg.timezone)).withColumn("status", state)
         .withColumn("late_file", F.coalesce("old_late", F.lit(False)) | late)
         .withColumn("attempt_count", F.when(same, F.coalesce("old_attempts", F.lit(0))).otherwise(0)))
    overdue = (F.col("status") == "waiting_files") & (F.col("cutoff_at") <= now)
    return t.withColumn("status", F.when(overdue, "needs_review").otherwise(F.col("status"))).drop(
        "old_status", "old_files", "old_attempts", "old_late")


def refresh_jobs(batches: DataFrame, files: DataFrame, requirements: DataFrame, previous: DataFrame, now: Column, cfg: Settings = Settings()) -> DataFrame:
    return job_status(missing_groups(with_requirement(job_completeness(batches, files), requirements)), previous, now, cfg)


# ------------------------------------------------------------------------------------------ status views
def daily_status_files(batches: DataFrame, files: DataFrame) -> DataFrame:
    f = files.select("batch_id", F.col("id").alias("file_id"), "parsed", "parse_error")
    t = batches.withColumnRenamed("id", "batch_id").join(f, "batch_id", "left")
    return t.groupBy(*KEY).agg(
        F.count_distinct("batch_id").alias("mail_count"), F.count("file_id").alias("file_count"), F.count_if(F.col("parsed")).alias("parsed_count"),
        F.count_if(F.col("parse_error").isNotNull()).alias("error_count"), F.max("received_at").alias("last_mail_at"))


def daily_status_runs(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Per date: runs, sums, average of the non-zero match rates, files received and parsed."""
    per_file = files.groupBy("business_date").agg(F.count(F.lit(1)).alias("files_received"), F.count_if(F.col("parsed")).alias("files_parsed"))
    r = runs.groupBy("business_date").agg(
        F.count_distinct("id").alias("runs"), F.sum("stm_count").alias("stm_count"), F.sum("matched").alias("matched"),
        F.sum("exception_count").alias("exception_count"), F.round(F.avg(F.nullif("match_rate", F.lit(0))), 3).alias("avg_match_rate"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return r.join(per_file, "business_date", "left").select("business_date", "runs", z("stm_count"), z("matched"), z("exception_count"), "avg_match_rate",
                                                            z("files_received"), z("files_parsed"))


def recon_operations(jobs: DataFrame, runs: DataFrame, notifications: DataFrame) -> DataFrame:
    unread = notifications.groupBy("job_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))
    r = runs.select(F.col("id").alias("last_run_id"), "match_rate", "matched", "exception_count", "elapsed_ms")
    return (jobs.join(r, "last_run_id", "left").join(unread, jobs["id"] == unread["job_id"], "left").drop("job_id")
            .withColumn("unread_notification_count", F.coalesce("unread", F.lit(0))).drop("unread"))


def recon_quality(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    r = runs.select(F.col("id").alias("last_run_id"), F.col("created_at").alias("run_at"), "stm_count", "bo_count", "matched", "match_rate",
                    "exception_count", "summary")
    return jobs.join(r, "last_run_id", "left").withColumn("run_id", F.when(F.col("run_at").isNotNull(), F.col("last_run_id")))


def current_exceptions(jobs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Exceptions of the last run of completed jobs only; reruns never add up."""
    live = jobs.filter("status = 'completed'").select(F.col("last_run_id").alias("run_id"))
    return exceptions.join(live, "run_id", "left_semi")


def notification_totals(jobs: DataFrame, batches: DataFrame, files: DataFrame) -> DataFrame:
    """Job rows with the true number of mails and files; scalar subqueries, never sums of per-job counters."""
    return (jobs.withColumn("actual_mail_total", batches.agg(F.count(F.lit(1))).scalar())
            .withColumn("actual_file_total", files.agg(F.count(F.lit(1))).scalar()))


def latest_run_per_job(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest run of each running job that was created after the job was claimed."""
    r = runs.select(F.get_json_object("summary", "$.job_id").alias("job_id"), F.col("id").alias("run_id"), "created_at", "file_ids")
    j = jobs.filter("status = 'running'").select(F.col("id").cast("string").alias("job_id"), "claimed_at")
    t = r.join(j, "job_id").filter(F.col("claimed_at").isNull() | (F.col("created_at") >= F.col("claimed_at"))).drop("claimed_at")
    return latest_per_key(t, ["job_id"], ["created_at", "run_id"])


def mark_run_files(files: DataFrame, finished: DataFrame) -> DataFrame:
    """Files named by finished runs become parsed."""
    done = finished.select(F.explode("file_ids").alias("id")).distinct().withColumn("done", F.lit(True))
    t = files.join(done, "id", "left")
    hit = F.coalesce("done", F.lit(False))
    return t.withColumn("parsed", hit | F.col("parsed")).withColumn("parse_error", F.when(~hit, F.col("parse_error"))).drop("done")


def mark_files(files: DataFrame, results: DataFrame) -> DataFrame:
    """parsed / row_count / parse_error from per-file results (id, rows, error)."""
    r = results.select("id", F.col("rows").alias("new_rows"), S.blank_to_null("error").alias("new_error"), F.lit(True).alias("seen"))
    t = files.join(r, "id", "left")
    seen = F.coalesce("seen", F.lit(False))
    return (t.withColumn("parsed", F.when(seen, F.col("new_error").isNull()).otherwise(F.col("parsed")))
            .withColumn("row_count", F.when(seen, F.col("new_rows")).otherwise(F.col("row_count")))
            .withColumn("parse_error", F.when(seen, F.col("new_error")).otherwise(F.col("parse_error"))).drop("new_rows", "new_error", "seen"))


def ops_by_quality(quality: DataFrame, operations: DataFrame) -> DataFrame:
    """Quality rows with the kinds present, joined on (date, company, system with NULL as '')."""
    o = operations.select(*KEY, F.coalesce("business_system", F.lit("")).alias("sys"), F.col("present_kinds").alias("op_kinds"))
    return quality.withColumn("sys", F.coalesce("business_system", F.lit(""))).join(o, [*KEY, "sys"], "left").drop("sys")


# ------------------------------------------------------------------------------------------ overview and digests
def live_overview(daily: DataFrame, quality: DataFrame, exceptions: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = lambda s: F.count_if(F.col("status") == s)
    q = quality.agg(n("completed").alias("completed"), n("needs_review").alias("needs_review"), n("waiting_files").alias("waiting"),
                    F.count_if((F.col("status") == "error") | (F.coalesce("error_count", F.lit(0)) > 0)).alias("failed"))
    d = lambda c: daily.agg(z(c)).scalar()
    return (q.withColumn("total_mail", d("mail_count")).withColumn("total_files", d("file_count")).withColumn("parsed_files", d("parsed_count"))
            .withColumn("risk", exceptions.agg(z("risk_amount")).scalar()))


def company_overview(quality: DataFrame, operations: DataFrame) -> DataFrame:
    s = F.col("status")
    q = ops_by_quality(quality, operations)
    out = q.groupBy("company", F.coalesce("business_system", F.lit(fixed.NO_SYSTEM)).alias("system")).agg(
        F.count_if(s == "completed").alias("completed"), F.count_if(s == "waiting_files").alias("waiting"), F.count_if(s == "error").alias("error"),
        F.count_if(~s.isin("completed", "waiting_files", "error")).alias("review"), F.sum("file_count").alias("files"), F.max("business_date").alias("latest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("op_kinds")))).alias("kinds"))
    return out.orderBy(F.col("latest").desc(), (F.col("review") + F.col("waiting")).desc(), "company", "system")


def work_mix(operations: DataFrame) -> DataFrame:
    """Jobs that hold at least one kind of each group."""
    groups = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.array(*[F.lit(k) for k in kinds]).alias("kinds")) for label, kinds in fixed.WORK_MIX]))
    return operations.select("present_kinds", groups.alias("g")).groupBy(F.col("g.label").alias("label")).agg(
        F.count_if(F.arrays_overlap("present_kinds", "g.kinds")).alias("jobs"))


def status_counts(jobs: DataFrame) -> DataFrame:
    names = ["completed", "queued", "running", "needs_review", "waiting_files", "error"]
    return jobs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in names])


def digest_hourly(jobs: DataFrame, now: Column, previous_total: int | None = None, most_missing: int | None = None, most_failed: int | None = None) -> dict[str, DataFrame]:
    """Counts, the jobs with files missing and the failed ones, newest first; limits are for messages of bounded length."""
    total = F.max("actual_file_total")
    counts = jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "queued", "running", "error")],
                      F.count_if(F.col("status").isin("needs_review", "waiting_files")).alias("review"),
                      F.count_if(F.col("updated_at") >= now - F.expr("interval 1 hour")).alias("changed"), total.alias("file_total"),
                      F.greatest(F.lit(0), total - F.lit(previous_total) if previous_total is not None else F.lit(0)).alias("file_delta"))
    missing = jobs.filter(F.col("status").isin("needs_review", "waiting_files")).orderBy(F.col("business_date").desc(), "company")
    failed = jobs.filter("status = 'error'").orderBy(F.col("updated_at").desc(), "company")
    cut = lambda df, n: df if n is None else df.limit(n)
    return {"counts": counts, "missing": cut(missing, most_missing), "failed": cut(failed, most_failed)}


def file_deltas(totals: DataFrame) -> DataFrame:
    """Growth of the file total between consecutive digests (at, file_total)."""
    t = previous_row(totals, [], F.floor(F.unix_timestamp("at") / 86400), ["at"], F.col("file_total"), "before")
    return t.withColumn("file_delta", F.greatest(F.lit(0), F.col("file_total") - F.coalesce("before", "file_total"))).drop("before")


def digest_daily(batches: DataFrame, jobs: DataFrame, day: Column, cfg: Settings = Settings()) -> DataFrame:
    """Mails and files of one local day, jobs per status, parse errors."""
    today = batches.filter(S.local_date("created_at", cfg.timezone) == day)
    counts = jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "queued", "running", "needs_review", "error")],
                      F.coalesce(F.sum("error_count"), F.lit(0)).alias("parse_errors"))
    return (counts.withColumn("mails", today.agg(F.count(F.lit(1))).scalar())
            .withColumn("files", today.agg(F.coalesce(F.sum("file_count"), F.lit(0))).scalar()))


def storage_file_status(files: DataFrame) -> DataFrame:
    readable = X.eligible_file("file_name", "kind")
    failed = S.blank_to_null("parse_error").isNotNull()
    return files.agg(F.count(F.lit(1)).alias("total"), F.count_if(readable).alias("readable"), F.count_if(F.col("parsed")).alias("parsed"),
                     F.count_if(readable & ~F.coalesce("parsed", F.lit(False))).alias("remaining"), F.count_if(failed).alias("failed"))


def alerts(jobs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Alert rows with their dedupe key: missing files after cutoff, retries exhausted, late files."""
    text = F.to_json("missing_groups")
    row = lambda df, level, key, detail: df.select(key.alias("dedupe_key"), F.lit(level).alias("level"), "business_date", "company",
                                                   detail.alias("detail"))
    jid = F.concat_ws("/", F.col("business_date").cast("string"), "company")
    missing = row(jobs.filter("status = 'needs_review'"), "warning", F.concat_ws(":", F.lit("missing"), jid, text), F.concat(F.lit("กลุ่มไฟล์ที่ขาด: "), text))
    spent = row(jobs.filter((F.col("status") == "error") & (F.col("attempt_count") >= cfg.max_attempts)), "error",
                F.concat_ws(":", F.lit("retry-exhausted"), jid, F.col("attempt_count").cast("string")), F.lit("งานล้มเหลวซ้ำเกินกำหนด"))
    late = row(jobs.filter("late_file"), "warning", F.concat_ws(":", F.lit("late"), jid, F.col("file_count").cast("string")),
               F.concat(F.lit("จำนวนไฟล์เพิ่มเป็น "), F.col("file_count").cast("string")))
    return missing.unionByName(spent).unionByName(late)


def notify_once(new: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts not sent before, one per dedupe key."""
    return new.dropDuplicates(["dedupe_key"]).join(sent.select("dedupe_key"), "dedupe_key", "left_anti")


def rate_revisions(log: DataFrame) -> DataFrame:
    """Append log of rates (rate_date, seq, rate, note, by, at): the prior value where rate or note changed."""
    t = previous_row(log, ["rate_date"], seq_block(), ["seq"], F.struct("rate", "note", "by", "at"), "prior")
    changed = ~F.col("rate").eqNullSafe(F.col("prior.rate")) | ~F.col("note").eqNullSafe(F.col("prior.note"))
    return t.filter(F.col("prior").isNotNull() & changed)


