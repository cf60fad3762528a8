"""What the vector operators share."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, *extra: str) -> DataFrame:
    """``vec_id``, ``vec`` (array of doubles) and ``extra`` of the rows whose vector is neither NULL nor zero and holds finite components only."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), *extra)
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
