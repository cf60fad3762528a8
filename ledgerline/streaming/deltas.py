"""File completeness kept as sums of signed changes.

The newest version of each file (by storage path) is kept in a table.  A newer version gives a row of minus one for the share of the
old one and of plus one for its own, so a file that moves to another mail, changes kind or gets parsed undoes what it counted
before; an older version that comes late gives nothing.  Sums of these rows by mail, company and kind are the result: no micro-batch
sums a day, a mail or a file again.  One join compares a micro-batch with the versions known; a state store would be asked, and would
call Python, once for each file.  Mails are joined when the sums are read, so a file may come before its mail and a mail may move.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ledgerline.functions import text as X
from ledgerline.operators.jobs import KEY
from ledgerline.streaming.epochs import compact, read_epoch, read_epochs, write_epoch

_SHARE = ["batch_id", "company", "kind", "parsed", "failed"]
_COUNTS = ["files", "parsed", "errors"]
#: Micro-batches after which the sums are folded.
FOLD_EVERY = 16


def _versions_schema(batch_type: str) -> str:
    version = f"struct<at: bigint, batch_id: {batch_type}, company: string, kind: string, parsed: boolean, failed: boolean>"
    return f"storage_path string, now {version}, was {version}"


def _newest(versions: DataFrame) -> DataFrame:
    """Newest version of each file; of equal times the larger share, and missing values are smallest."""
    return versions.groupBy("storage_path").agg(F.max("now").alias("now"))


def _kept(versions: DataFrame) -> DataFrame:
    return _newest(versions).withColumn("was", F.lit(None).cast(versions.schema["was"].dataType))


def newer_versions(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a micro-batch (storage_path, ingested_at, batch_id, company, file_name, kind, parsed, parse_error) whose version is newer
    than the one in ``known``: the version ``now`` and the one it replaces, ``was``."""
    version = files.filter("storage_path is not null").select("storage_path", F.struct(
        F.unix_micros("ingested_at").alias("at"), "batch_id", "company", X.effective_kind("file_name", "kind").alias("kind"),
        F.coalesce("parsed", F.lit(False)).alias("parsed"), F.col("parse_error").isNotNull().alias("failed")).alias("now"))
    held = _newest(known).withColumnRenamed("now", "was")
    return _newest(version).join(held, "storage_path", "left").filter("was is null or now > was")


def signed_shares(versions: DataFrame) -> DataFrame:
    """One row of minus one for the share of each version replaced, and one of plus one for that which replaces it."""
    signs = F.explode(F.array(F.struct(F.col("was").alias("v"), F.lit(-1).alias("sign")), F.struct(F.col("now").alias("v"), F.lit(1).alias("sign"))))
    return versions.select(signs.alias("c")).filter("c.v is not null").select(*[f"c.v.{c}" for c in _SHARE], "c.sign")


def _sums(changes: DataFrame) -> DataFrame:
    by = changes.groupBy("batch_id", "company", "kind").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return by.filter(" or ".join(f"{c} <> 0" for c in _COUNTS))


def schema_of(batch_type: str = "string") -> str:
    return f"batch_id {batch_type}, company string, kind string, files bigint, parsed bigint, errors bigint"


def completeness_deltas(files: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Keep the sums below ``folder`` current; old epochs are folded every :data:`FOLD_EVERY` micro-batches.

    The newest versions are kept beside Spark's own files below ``checkpoint``, again by epoch: a repeated micro-batch is compared with
    the epochs before it and rewrites its own.
    """
    kind = dict(files.dtypes)["batch_id"]
    schema, versions, held = schema_of(kind), _versions_schema(kind), f"{checkpoint}/newest"

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        write_epoch(newer_versions(batch, read_epochs(spark, held, versions, epoch)), held, epoch)
        changes = signed_shares(read_epoch(spark, held, versions, epoch))
        signed = changes.select("batch_id", "company", "kind", F.col("sign").alias("files"), (F.col("sign") * F.col("parsed").cast("int")).alias("parsed"),
                                (F.col("sign") * F.col("failed").cast("int")).alias("errors"))
        write_epoch(_sums(signed), folder, epoch)
        if epoch and epoch % FOLD_EVERY == 0:
            compact(spark, folder, schema, _sums, epoch - 1)
            compact(spark, held, versions, _kept, epoch - 1)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def completeness_so_far(spark: SparkSession, folder: str, batches: DataFrame) -> DataFrame:
    """The view of ``job_completeness`` from the sums and the mails as they are now."""
    sums = _sums(read_epochs(spark, folder, schema_of(dict(batches.dtypes)["id"]))).filter("files <> 0")
    mails = batches.select(F.col("id").alias("batch_id"), "business_date", "business_system", F.col("company").alias("mail_company"))
    t = sums.join(mails, "batch_id").withColumn("company", F.coalesce("company", "mail_company")).filter("business_date is not null and company is not null")
    return t.groupBy(*KEY).agg(
        F.count_distinct("batch_id").alias("mail_count"), F.sum("files").alias("file_count"), F.sum("parsed").alias("parsed_count"), F.sum("errors").alias("error_count"),
        F.array_sort(F.collect_set("kind")).alias("present_kinds"), F.max("business_system").alias("business_system"))
