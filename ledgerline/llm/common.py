"""Small helpers shared by the corpus operators."""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import configure, stage

__all__ = ["prepare", "stage", "table", "fold", "text_slices", "arrow_rows", "block_pairs", "map_groups", "tree_sum", "lower_in_place", "crc", "tokenizer_path"]

#: Characters handled at once inside a task; bounds the memory of the vectorised kernels.
SLICE_CHARS = 500_000


#: Rows of an Arrow batch between Spark and Python: texts are long, and both sides hold whole batches.
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session up for long texts; safe to call again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return configure(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package is installed beside Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(modulus))


def text_slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts of about ``chars`` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def arrow_rows(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, without copying."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def tree_sum(parts: DataFrame) -> np.ndarray | None:
    """Sum of the double arrays (as bytes) in the only column of ``parts``, merged level by level on the executors; None without rows.

    Meant for one array of fixed length from each task.
    """
    got = parts.rdd.map(lambda r: bytes(r[0])).treeAggregate(b"", _add_bytes, _add_bytes)
    return np.frombuffer(got, "<f8") if got else None


def _add_bytes(a: bytes, b: bytes) -> bytes:
    if not a or not b:
        return a or b
    return (np.frombuffer(a, "<f8") + np.frombuffer(b, "<f8")).tobytes()


def lower_in_place(text: str) -> str:
    """Lower case with every character at its place: one whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def block_pairs(rows: DataFrame, group: list[str], spread: str, values: list[str]) -> DataFrame:
    """``rows`` placed into every pair of blocks (``x`` <= ``y``) of its group that it takes part in.

    ``rows`` has ``blocks``, the number of blocks of its group; a hash of ``spread`` chooses the block.  ``side`` is 1 for rows of the
    higher of two different blocks.  All pairs of rows of a group thus meet in tasks of two blocks, however large the group is.
    """
    own = rows.withColumn("__block", F.pmod(F.xxhash64(spread), F.col("blocks")))
    placed = own.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)))
    return placed.select(*group, F.least("__block", "__other").alias("x"), F.greatest("__block", "__other").alias("y"), (F.col("__block") > F.col("__other")).cast("int").alias("side"), *values)


def map_groups(rows: DataFrame, group: list[str], values: list[str], compare, schema: str) -> DataFrame:
    """``compare(key, rows)`` for each group, which must be of bounded size; yields tuples of ``schema``.

    Many small groups share a task, so a group costs no call of its own between Spark and Python.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    n, target = len(group), to_arrow_schema(StructType.fromDDL(schema))

    def pack(out):
        columns = zip(*out) if out else [[]] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches):
        held, key, out = [], None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    if held:
                        out.extend(compare(key, held))
                    held, key = [], row[:n]
                    if len(out) > 10_000:
                        yield pack(out)
                        out = []
                held.append(row[n:])
        if held:
            out.extend(compare(key, held))
        yield pack(out)

    return rows.select(*group, *values).repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)
