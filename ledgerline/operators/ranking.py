"""Order-dependent operators that never put a whole key into one task.

A plain window over a key sorts all its rows in one task.  These helpers cut the order into blocks,
summarise each block with a partial aggregate, carry the summaries across blocks in a window whose
size is the number of blocks, and run the row-level window inside (key, block) only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import stage

BLOCK_BITS = 16


def seq_block(seq: str = "seq", bits: int = BLOCK_BITS) -> Column:
    """Block of an integer order; with distinct values a block holds at most 2**bits rows."""
    return F.shiftright(F.col(seq), bits)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` treating NULL as a value, keeping one copy of the keys."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def row_number_blocked(df: DataFrame, keys: list[str], block: Column, order: list, name: str) -> DataFrame:
    """``row_number`` over ``keys``; ``block`` must not decrease along ``order``."""
    tagged = df.withColumn("__blk", block)
    counts = tagged.groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__blk").orderBy(*order)
    return (_null_safe(tagged, offsets, [*keys, "__blk"], "left")
            .withColumn(name, (F.row_number().over(inside) + F.col("__off")).cast("bigint"))
            .drop("__blk", "__off"))


def row_number_ranged(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number`` over ``keys`` for an order of any spread.  Blocks are the ranges Spark cuts the rows into, so there are as many as
    tasks, while blocks of a fixed width have a row each where the order is sparse."""
    cut = stage(df.repartitionByRange(*keys, *order).withColumn("__blk", F.spark_partition_id()), "ranges")
    counts = cut.groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "offsets")
    inside = Window.partitionBy(*keys, "__blk").orderBy(*order)
    return (_null_safe(cut, offsets, [*keys, "__blk"], "left")
            .withColumn(name, (F.row_number().over(inside) + F.col("__off")).cast("bigint"))
            .drop("__blk", "__off"))


def neighbours(df: DataFrame, keys: list[str], block: Column, order: list[str], payload: Column, before: str | None = None,
               after: str | None = None) -> DataFrame:
    """``lag`` and ``lead`` of ``payload`` over ``keys`` under the names given; the payload must not be NULL itself."""
    tagged = df.withColumn("__blk", block).withColumn("__pay", payload)
    position = F.struct(*[F.col(c) for c in order])
    sides = [(n, edge, shift) for n, edge, shift in ((before, F.max_by, F.lag), (after, F.min_by, F.lead)) if n is not None]
    edges = tagged.groupBy(*keys, "__blk").agg(*[edge("__pay", position).alias(f"__edge_{n}") for n, edge, _ in sides])
    across = Window.partitionBy(*keys).orderBy("__blk")
    edges = edges.select(*keys, "__blk", *[shift(f"__edge_{n}").over(across).alias(f"__near_{n}") for n, _, shift in sides])
    inside = Window.partitionBy(*keys, "__blk").orderBy(*order)
    return (_null_safe(tagged, edges, [*keys, "__blk"], "left")
            .withColumns({n: F.coalesce(shift("__pay").over(inside), F.col(f"__near_{n}")) for n, _, shift in sides})
            .drop("__blk", "__pay", *[f"__near_{n}" for n, _, _ in sides]))


def previous_row(df: DataFrame, keys: list[str], block: Column, order: list[str], payload: Column, name: str,
                 forward: bool = False) -> DataFrame:
    """``lag`` (or ``lead``) of ``payload`` over ``keys``; the payload must not be NULL itself."""
    return neighbours(df, keys, block, order, payload, **{"after" if forward else "before": name})


def last_known(df: DataFrame, keys: list[str], block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Last non-NULL ``value`` strictly before each row."""
    tagged = df.withColumn("__blk", block)
    position = F.struct(*[F.col(c) for c in order])
    ends = tagged.groupBy(*keys, "__blk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias("__end"))
    across = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(across)).drop("__end")
    inside = Window.partitionBy(*keys, "__blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (_null_safe(tagged, ends, [*keys, "__blk"], "left")
            .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("__carry")))
            .drop("__blk", "__carry"))
