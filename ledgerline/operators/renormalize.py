"""Normalised rows kept up to date by fingerprints: only files whose rows or settings changed are read again.

The fingerprint of a file is an order-free sum of the hashes of its rows, their number, its entry in the file list and the settings that
normalising depends on.  Results and fingerprints are stored together by file, so a run that dies leaves every file either old or new.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import stage
from ledgerline.settings import Settings

#: Settings that normalising reports and header-mapped files depends on.
USED = ("filter_carry_forward", "pm_success_only", "late_night_sec", "default_company", "timezone")


def settings_fingerprint(cfg: Settings, used: tuple[str, ...] = USED) -> Column:
    values = asdict(cfg)
    return F.xxhash64(*[F.lit(f"{name}={values[name]!r}") for name in used])


def fingerprints(rows: DataFrame, files: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``file_id`` and ``fingerprint`` of every file of the list, those without rows too.

    Two hashes of each row are summed, so rows that swap places or values do not cancel out; sums combine before the shuffle.
    """
    entry = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(files.columns)])
    content = rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row_no", "cells").cast("decimal(38,0)")).alias("a"), F.sum(F.hash("cells", "row_no").cast("bigint")).alias("b"))
    listed = files.select("file_id", entry.alias("entry"))
    mark = F.concat_ws(":", F.coalesce("n", F.lit(0)), "a", "b", "entry", settings_fingerprint(cfg))
    return listed.join(content, "file_id", "left").select("file_id", F.md5(mark).alias("fingerprint"))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """``file_id``, ``fingerprint`` and ``why`` (new, changed) of files to read again, and ``gone`` for those no longer listed."""
    old = before.select("file_id", F.col("fingerprint").alias("was"))
    both = now.join(old, "file_id", "full_outer")
    why = F.when(F.col("fingerprint").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("fingerprint"), "changed")
    return both.withColumn("why", why).filter("why is not null").select("file_id", "fingerprint", "why")


def renormalize(rows: DataFrame, files: DataFrame, stored: DataFrame | None, normalize: Callable[[DataFrame, DataFrame, Settings], DataFrame],
                cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised rows with ``fingerprint``, the files that were read again, and the list of all fingerprints.

    ``stored`` is the first result of the last call (NULL at first); rows of files that did not change are taken from it as they are.
    A file without normalised rows has none in it either, so it is read again, which costs nothing.
    """
    now = fingerprints(rows, files, cfg)
    if stored is None:
        redo = now.withColumn("why", F.lit("new"))
    else:
        redo = changed_files(now, stored.select("file_id", "fingerprint").distinct())
    redo = stage(redo, "redo")  # one row per file, so that no reader hashes the rows again or moves them to their file
    again = redo.filter("why <> 'gone'").select("file_id", "fingerprint")
    fresh = normalize(rows.join(again, "file_id", "left_semi"), files.join(again, "file_id", "left_semi"), cfg).join(again, "file_id")
    kept = fresh if stored is None else stored.join(redo, "file_id", "left_anti").select(*fresh.columns).unionByName(fresh)
    return kept, redo, now
