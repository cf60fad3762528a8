"""Fixed schemas: the canonical transaction and the exception table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DATE": T.DateType(),
          "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "DECIMAL(16,2)": T.DecimalType(16, 2)}


def struct_of(text: str) -> T.StructType:
    """Schema from "name TYPE" lines; usable before a session exists."""
    items = [i.split(None, 1) for i in text.replace("\n", " ").replace("(16,2)", "(16;2)").split(",")]
    return T.StructType([T.StructField(n, _TYPES[t.strip().replace(";", ",")]) for n, t in items])


TXN_DDL = """
txn_id STRING, job_date DATE, job_company STRING, side STRING, format_code STRING, file_id STRING,
file_seq INT, row_no INT, seq BIGINT, date DATE, sec INT, bo_date DATE, bo_sec INT, amount DECIMAL(16,2),
amount_cents BIGINT, balance DECIMAL(16,2), direction STRING, account STRING, bank STRING, channel STRING,
is_pm BOOLEAN, company STRING, subco STRING, username STRING, ref STRING, member_code STRING,
member_nick STRING, cust_account STRING, cust_name STRING, cust_bank STRING, credit_before DECIMAL(16,2),
credit_after DECIMAL(16,2), bonus DECIMAL(16,2), promo STRING, fee DECIMAL(16,2), requested DECIMAL(16,2),
pay_order STRING, via STRING, note STRING, status STRING, partial BOOLEAN, manual BOOLEAN,
cross_day BOOLEAN, late_night BOOLEAN, no_time BOOLEAN, minute_precision BOOLEAN, is_fee BOOLEAN,
code STRING, descr STRING, raw STRING, drop_reason STRING
"""
TXN: T.StructType = struct_of(TXN_DDL)
JOB = ["job_date", "job_company"]


def row_identity(file_seq: Column, row_no: Column, page_no: Column | None = None) -> Column:
    """``seq``: order over files, then pages, then rows.  The one layout of both sides: 21 bits of file, 14 of page, 28 of row, so that
    rows of different files never meet and a file's rows keep their order.  A part that does not fit fails instead of colliding."""
    parts = ((file_seq, 21, 42), (F.lit(0) if page_no is None else page_no, 14, 28), (row_no, 28, 0))
    fits = lambda c, bits: F.when((c >= 0) & (c < 1 << bits), c.cast("bigint")).when(c.isNotNull(), F.raise_error(F.lit("file, page or row number out of range")).cast("bigint"))
    shifted = [F.shiftleft(fits(c, bits), at) for c, bits, at in parts]
    return shifted[0] + shifted[1] + shifted[2]


def conform(df: DataFrame, schema: T.StructType = TXN) -> DataFrame:
    """Project onto ``schema``; absent columns become typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def fill_job(df: DataFrame) -> DataFrame:
    """Rows without a job belong to the job of their own date and of no company, so that job keys are never NULL."""
    day = F.coalesce("job_date", *(["date"] if "date" in df.columns else []), F.lit("1970-01-01").cast("date"))
    return df.withColumns({"job_date": day.cast("date"), "job_company": F.coalesce("job_company", F.lit("-"))})


def as_txn(df: DataFrame, side: str) -> DataFrame:
    """Fill the derived key columns and conform: cents, input order, row identity."""
    have = set(df.columns)
    if "file_seq" not in have:
        df = df.withColumn("file_seq", F.lit(0))
    if "seq" not in have:
        df = df.withColumn("seq", row_identity(F.col("file_seq"), F.col("row_no")))
    if "amount_cents" not in have:
        df = df.withColumn("amount_cents", F.round(F.col("amount") * 100).cast("bigint"))
    if "txn_id" not in have:
        df = df.withColumn("txn_id", F.concat_ws("-", F.lit(side), F.col("seq")))
    return conform(df.withColumn("side", F.lit(side)))
