"""Search for a part of a text that opens only files which can hold it.

A table is stored in parts, and each part has a Bloom filter of the letter trigrams of its texts: bitmaps built by an aggregate that
combines before the shuffle.  A search looks up the trigrams of its word, reads the parts that have them all, and compares there.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import any_of
from ledgerline.session import stage

_PART = "__part"
#: Bits of a bitmap as Spark builds them, and bitmaps of a part.
BITMAP, BITMAPS = 32768, 16


def _trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case text; none if it is shorter."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(3))))


def _place(trigram: Column) -> tuple[Column, Column]:
    """Bitmap and bit of a trigram."""
    at = F.pmod(F.xxhash64(trigram), F.lit(BITMAP * BITMAPS))
    return F.floor(at / BITMAP).cast("int"), (at % BITMAP).cast("bigint")


@dataclass(frozen=True)
class TextIndex:
    """``rows`` stored in parts, the searched columns, and the bitmaps by part."""
    rows: DataFrame
    columns: tuple[str, ...]
    bitmaps: DataFrame

    def parts_for(self, word: str) -> list[int] | None:
        """Parts that may hold ``word``; None, for all, if it is too short to be looked up.  One number a part comes to the driver."""
        if len(word) < 3:
            return None
        spark = self.rows.sparkSession
        wanted = spark.range(1).select(F.explode(_trigrams(F.lit(word))).alias("gram"))
        bitmap, bit = _place(F.col("gram"))
        wanted = wanted.select("gram", bitmap.alias("bitmap"), bit.alias("bit"))
        octet = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = self.bitmaps.join(F.broadcast(wanted), "bitmap").filter(F.getbit(octet, (F.col("bit") % 8).cast("int")) == 1)  # a word's trigrams
        found = held.groupBy(_PART).agg(F.count_distinct("gram").alias("n"))
        return sorted(r[_PART] for r in found.filter(F.col("n") == F.size(_trigrams(F.lit(word)))).collect())

    def search(self, word: str) -> DataFrame:
        """Rows with ``word`` in one of the columns, in any case; an empty word finds all."""
        parts = self.parts_for(word)
        near = self.rows if parts is None else self.rows.filter(F.col(_PART).isin(parts))
        hit = any_of([F.coalesce(F.contains(F.lower(F.col(c)), F.lit(word.lower())), F.lit(False)) for c in self.columns])
        return (near if not word else near.filter(hit)).drop(_PART)


def indexed(df: DataFrame, columns: list[str], by: list[Column] | None = None, parts: int | None = None) -> TextIndex:
    """``df`` stored in parts, with filters over ``columns``.  ``by`` keeps rows that are searched together in one part."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *by) if by else df.repartition(n)
    rows = stage(placed.withColumn(_PART, F.spark_partition_id()), "text-index", partition_by=_PART)
    grams = rows.select(_PART, F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(_trigrams(F.col(c)), F.array().cast("array<string>")) for c in columns])))).alias("gram"))
    bitmap, bit = _place(F.col("gram"))
    bitmaps = grams.select(_PART, bitmap.alias("bitmap"), bit.alias("bit")).groupBy(_PART, "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return TextIndex(rows, tuple(columns), stage(bitmaps, "text-bitmaps"))
