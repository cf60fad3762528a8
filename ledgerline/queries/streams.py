"""Streams over the events table in several micro-batches, with late and repeated rows, compared with the batch result."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import jobs
from ledgerline.queries.base import Tables, check
from ledgerline.queries.incidents import INTERVAL_ROWS, INTERVALS, interval_rows
from ledgerline.queries.operations import COMPLETENESS_SQL, LATE_SQL, completeness_rows, file_rows, mail_rows, rule_rows
from ledgerline.session import stage, staging_path
from ledgerline.streaming.deltas import completeness_deltas, completeness_so_far
from ledgerline.streaming.probes import incidents_so_far, probe_incidents_stream, probe_window_counts, window_counts_so_far
from ledgerline.streaming.tables import ingest_once, read_table


def _in_batches(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """``rows`` as a stream of about four micro-batches in an order that has nothing to do with time; the input sets the number of files."""
    folder = staging_path(rows.sparkSession, name)
    rows.repartition(max(4, rows.rdd.getNumPartitions()), F.xxhash64(*by)).write.parquet(folder)
    files = len(rows.sparkSession.read.parquet(folder).inputFiles())
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(folder)


def _stream(t: Tables, copies: int) -> DataFrame:
    """Events in several micro-batches; every third row comes ``copies`` times, in different files."""
    probes = t.events.select((F.col("user_id") % 20).cast("string").alias("link_id"), F.col("event_id").alias("probe_id"), F.col("ts").cast("timestamp").alias("ts"),
                             F.when(F.col("event_type") == "error", "DOWN").otherwise("UP").alias("status"))
    repeated = probes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("probe_id") % 3 == 0, copies).otherwise(1))))
    return _in_batches(repeated, "probe-files", ["probe_id", "copy"]).drop("copy")


@check("stream_incidents_equals_batch", f"with {INTERVALS} {INTERVAL_ROWS}")
def stream_incidents(t: Tables) -> DataFrame:
    folder = staging_path(t.spark, "incident-stream")
    probe_incidents_stream(_stream(t, 2), folder, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return interval_rows(incidents_so_far(t.spark, folder))


@check("stream_hourly_counts", """select strftime(date_trunc('hour', ts),'%Y-%m-%d %H:%M') as start, case when event_type='error' then 'DOWN' else 'UP' end as status, count(*) as n from events group by 1, 2""")
def stream_hourly(t: Tables) -> DataFrame:
    folder = staging_path(t.spark, "hourly-stream")
    probe_window_counts(_stream(t, 1), f"{folder}/counts", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = window_counts_so_far(t.spark, f"{folder}/counts")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "status", "n")


@check("stream_ingest_once", "select event_id as id, strftime(ts,'%Y-%m-%d %H:%M:%S') as at, case when event_type='error' then 'DOWN' else 'UP' end as status from events")
def stream_ingest(t: Tables) -> DataFrame:
    """Rows that come again in a later micro-batch are kept once, and rows older than all before are kept."""
    folder = staging_path(t.spark, "ingest-stream")
    ingest_once(_stream(t, 3), "probe_id", f"{folder}/rows", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = read_table(t.spark, f"{folder}/rows", "link_id string, probe_id bigint, ts timestamp, status string, bucket int")
    return out.select(F.col("probe_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "status")


_KEPT = "2024-01-10"


@check("stream_counts_retention", f"""select strftime(date_trunc('hour', ts),'%Y-%m-%d %H:%M') as start, case when event_type='error' then 'DOWN' else 'UP' end as status, count(*) as n
 from events where ts >= timestamp '{_KEPT}' group by 1, 2""")
def stream_retention(t: Tables) -> DataFrame:
    """Hourly counts whose epochs are folded after every micro-batch, without windows that have expired."""
    folder, keep = staging_path(t.spark, "retention-stream"), F.col("start") >= F.lit(_KEPT).cast("timestamp")
    probe_window_counts(_stream(t, 1), f"{folder}/counts", f"{folder}/checkpoint", keep=keep, fold_every=1).trigger(availableNow=True).start().awaitTermination()
    return window_counts_so_far(t.spark, f"{folder}/counts", keep).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "status", "n")


def _versions(t: Tables) -> DataFrame:
    """Files in two versions: every fourth was first in another mail, every third first unparsed; either version may come first."""
    files = file_rows(t).withColumn("storage_path", F.concat_ws("-", "batch_id", "id", "path_no"))
    now = files.withColumn("ingested_at", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    odd = F.pmod("path_no", F.lit(12))
    was = files.filter((odd % 4 == 1) | (odd % 3 == 0)).withColumns({
        "batch_id": F.when(odd % 4 == 1, F.col("batch_id") + 1).otherwise(F.col("batch_id")), "kind": F.lit("stm_pdf"), "parsed": F.lit(False), "parse_error": F.lit("later mended"),
        "ingested_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    return now.unionByName(was).drop("path_no")


@check("stream_completeness", COMPLETENESS_SQL)
def stream_completeness(t: Tables) -> DataFrame:
    """Completeness from signed changes over several micro-batches equals the batch view of the newest versions."""
    folder = staging_path(t.spark, "completeness-stream")
    files = _in_batches(_versions(t), "file-versions", ["storage_path", "ingested_at"])
    completeness_deltas(files, f"{folder}/sums", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return completeness_rows(completeness_so_far(t.spark, f"{folder}/sums", mail_rows(t)))


@check("stream_late_rerun", LATE_SQL)
def stream_late_rerun(t: Tables) -> DataFrame:
    """Jobs that were complete and run before files of a few more mails came: they are marked late and run again."""
    folder, mails = staging_path(t.spark, "late-stream"), mail_rows(t)
    files = file_rows(t).withColumn("storage_path", F.concat_ws("-", "batch_id", "id", "path_no")).withColumn("ingested_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).drop("path_no")
    late, now = F.col("batch_id") % 997 == 5, F.lit("1998-06-15 00:00:00").cast("timestamp")

    def arrive(rows: DataFrame, previous: DataFrame) -> DataFrame:
        rows.write.mode("append").parquet(f"{folder}/files")
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/files")
        completeness_deltas(stream, f"{folder}/sums", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        known = completeness_so_far(t.spark, f"{folder}/sums", mails)
        return stage(jobs.job_status(jobs.missing_groups(jobs.with_requirement(known, rule_rows(t))), previous, now), "late-jobs")

    none = t.spark.createDataFrame([], "business_date date, company string, status string, file_count bigint, attempt_count int, late_file boolean")
    first = arrive(files.filter(~late), none)
    done = first.select("business_date", "company", F.when(F.col("status") == "ready", "completed").otherwise(F.col("status")).alias("status"), "file_count", "attempt_count", "late_file")
    second = arrive(files.filter(late), done)
    return second.filter("late_file").select(F.date_format("business_date", "yyyy-MM-dd").alias("day"), "company", "status", F.col("file_count").alias("files"))
