"""Tables that grow by one folder for each micro-batch, and their compaction.

``epoch=N`` holds what micro-batch N wrote; a repeated micro-batch rewrites its own folder.  Compaction folds all epochs up to one into
``base=N`` and then commits a marker; readers take the base of the newest marker and the epochs after it, so they never see half of a
compaction.  What a marker replaces stays until the next compaction, for readers that have begun before.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.streaming.tables import read_table


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """N of the entries ``prefix=N`` of a folder, in order."""
    files, place = _folder(spark, folder)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{prefix}="))


def write_epoch(df: DataFrame, folder: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def _live(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """Last epoch in the base, and the folders that make up the table."""
    marks = _numbers(spark, f"{folder}/markers", "upto")
    upto = marks[-1] if marks else -1
    return upto, ([f"{folder}/base={upto}"] if marks else []) + [f"{folder}/epoch={n}" for n in _numbers(spark, folder, "epoch") if n > upto]


def read_epoch(spark: SparkSession, folder: str, schema: str, epoch: int) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/epoch={epoch}")


def read_epochs(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """All rows written so far, or by the epochs ``before`` one that is not in the base; an empty table if there are none."""
    _, paths = _live(spark, folder)
    if before is not None:
        paths = [p for p in paths if not p.startswith(f"{folder}/epoch=") or int(p.rsplit("=", 1)[1]) < before]
        if not paths:
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths) if paths else read_table(spark, folder, schema)


def compact(spark: SparkSession, folder: str, schema: str, fold: Callable[[DataFrame], DataFrame], upto: int) -> None:
    """Fold everything up to epoch ``upto``, which must not be written again, into one base.

    ``fold`` merges rows and may drop expired ones.  If it dies before the marker, nothing has changed; then the next one starts over.
    """
    before, _ = _live(spark, folder)
    epochs = [n for n in _numbers(spark, folder, "epoch") if before < n <= upto]
    if not epochs:
        return
    paths = ([f"{folder}/base={before}"] if before >= 0 else []) + [f"{folder}/epoch={n}" for n in epochs]
    last = epochs[-1]
    fold(spark.read.schema(schema).parquet(*paths)).write.mode("overwrite").parquet(f"{folder}/base={last}")
    files, marker = _folder(spark, f"{folder}/markers/upto={last}")
    files.mkdirs(marker)
    replaced = [f"{folder}/markers/upto={n}" for n in _numbers(spark, f"{folder}/markers", "upto") if n < before]
    replaced += [f"{folder}/base={n}" for n in _numbers(spark, folder, "base") if n < before]
    replaced += [f"{folder}/epoch={n}" for n in _numbers(spark, folder, "epoch") if n <= before]
    for old in replaced:
        files, place = _folder(spark, old)
        files.delete(place, True)
