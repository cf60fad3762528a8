"""Pages far into a sorted table, without sorting or carrying the rows before them.

The table is range-partitioned once by its order and stored by partition.  The number of rows of each partition says which ones hold a
page, so a page costs the partitions it lies in, however far in it is and however long the table.
"""
from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import stage

_PART = "__part"


@dataclass(frozen=True)
class RankedTable:
    """``rows`` stored by partition, the partitions in order, and the number of rows up to the end of each."""
    rows: DataFrame
    order: tuple[Column, ...]
    parts: tuple[int, ...]
    upto: tuple[int, ...]

    @property
    def count(self) -> int:
        return self.upto[-1] if self.upto else 0

    def parts_of(self, first: int, last: int) -> list[int]:
        """Positions of the partitions that hold rows ``first`` to ``last`` (exclusive)."""
        return list(range(bisect_right(self.upto, first), min(bisect_right(self.upto, last - 1) + 1, len(self.parts)))) if first < min(last, self.count) else []

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 0) in order; empty behind the end."""
        first = number * size
        held = self.parts_of(first, first + size)
        before = self.upto[held[0] - 1] if held and held[0] else 0
        near = self.rows.filter(F.col(_PART).isin([self.parts[k] for k in held]))  # partition pruning: other folders are not opened
        return near.orderBy(*self.order).offset(first - before if held else 0).limit(size if held else 0).drop(_PART)


def ranked(df: DataFrame, *order: Column, parts: int | None = None) -> RankedTable:
    """``df`` stored in ``order``, which should end in a key so that pages do not depend on the run; one small number a partition comes to
    the driver.  More partitions make pages cheaper and files smaller; the default is the number of shuffle partitions."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).withColumn(_PART, F.spark_partition_id())
    rows = stage(placed, "ranked", partition_by=_PART)
    counts = sorted((r[_PART], r["n"]) for r in rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).collect())
    return RankedTable(rows, order, tuple(p for p, _ in counts), tuple(accumulate(k for _, k in counts)))
