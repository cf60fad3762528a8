"""Tables that micro-batches keep current."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not exist yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def ingest_once(stream: DataFrame, key: str, folder: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Every row of a stream once per natural key, however late or often it comes.

    The stored table is the memory: a micro-batch is compared with the buckets of the key that it touches.  No watermark, so no row is
    too late; a repeated micro-batch finds its rows stored.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        stored = read_table(batch.sparkSession, folder, fresh.schema).select("bucket", key)
        fresh.join(stored, ["bucket", key], "left_anti").write.mode("append").partitionBy("bucket").parquet(folder)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
