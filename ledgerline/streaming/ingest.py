"""Streaming intake: completeness per micro-batch, alerts sent once, late files rerun."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import DateType, StructField, StructType

from ledgerline.operators.jobs import KEY, alerts, notify_once, refresh_jobs, upsert_latest
from ledgerline.session import stage
from ledgerline.settings import Settings
from ledgerline.streaming.tables import read_table, replace_partitions


def refresh_affected(batch: DataFrame, batches: DataFrame, files: DataFrame, requirements: DataFrame, previous: DataFrame, now: Column,
                     cfg: Settings = Settings()) -> DataFrame:
    """Job rows of the (date, company) pairs a set of new files touches; late files are never dropped."""
    touched = (batch.join(batches.select(F.col("id").alias("batch_id"), "business_date", F.col("company").alias("bc")), "batch_id")
               .select("business_date", F.coalesce("company", "bc").alias("company")).distinct())
    days = touched.select("business_date").distinct()
    near = batches.join(days, "business_date", "left_semi")
    return refresh_jobs(near, files.join(near.select(F.col("id").alias("batch_id")), "batch_id", "left_semi"), requirements, previous, now, cfg).join(touched, KEY, "left_semi")


def completeness_stream(files_stream: DataFrame, batches: Callable[[], DataFrame], requirements: DataFrame, folder: str, checkpoint: str, now: Column,
                        cfg: Settings = Settings(), rerun: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """Keep ``folder``/files, /jobs and /alerts current, and rerun jobs that get late files.

    ``batches`` is read again for each micro-batch.  A file whose mail is not known yet is parked in the partition without a date and
    placed once the mail is there, so no file is lost.  Only the partitions of affected dates are read and overwritten, and a repeated
    micro-batch gives the same tables.  ``rerun`` gets the (business_date, company) of completed jobs with new files, to reconcile them
    and write a run that replaces the former.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark, mails = batch.sparkSession, stage(batches(), "mails")
        dated = StructType([*batch.schema.fields, StructField("business_date", DateType())])
        known = read_table(spark, f"{folder}/files", dated)
        days = mails.select(F.col("id").alias("batch_id"), "business_date")
        waiting = known.filter("business_date is null").drop("business_date")
        fresh = stage(upsert_latest(waiting, batch, ["storage_path"], "ingested_at").select(*batch.columns).join(days, "batch_id", "left"), "fresh")
        changed = fresh.select("business_date").distinct()
        near = known.join(changed.filter("business_date is not null"), "business_date", "left_semi").select(*batch.columns)
        files = stage(upsert_latest(near, fresh.filter("business_date is not null").select(*batch.columns), ["storage_path"], "ingested_at").select(*batch.columns), "files")
        placed = files.join(days, "batch_id").unionByName(fresh.filter("business_date is null").select(*batch.columns, "business_date"))
        found_all = not waiting.isEmpty() and fresh.filter("business_date is null").isEmpty()
        replace_partitions(placed, f"{folder}/files", "business_date")
        if found_all:  # nothing is parked any more
            parked = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/files/business_date=__HIVE_DEFAULT_PARTITION__")
            parked.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parked, True)
        shape = refresh_jobs(mails.limit(0), files.limit(0), requirements, spark.createDataFrame(
            [], "business_date date, company string, status string, file_count bigint, attempt_count int, late_file boolean"), now, cfg).schema
        before = stage(read_table(spark, f"{folder}/jobs", shape).join(changed, "business_date", "left_semi"), "jobs")
        jobs = stage(refresh_affected(fresh.select(*batch.columns), mails, files, requirements, before, now, cfg), "jobs")
        rest = before.join(jobs.select("business_date").distinct(), "business_date", "left_semi").join(jobs.select(*KEY), KEY, "left_anti")
        replace_partitions(rest.unionByName(jobs), f"{folder}/jobs", "business_date")
        raised = alerts(jobs, cfg)
        stage(notify_once(raised, read_table(spark, f"{folder}/alerts", raised.schema)), "alerts").write.mode("append").parquet(f"{folder}/alerts")
        late = jobs.filter("late_file").select(*KEY)
        if rerun is not None and not late.isEmpty():
            rerun(late)

    return files_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
