"""Statement text: lines of text files or positioned fragments."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files to ``stm_lines``; line numbers count non-blank lines of a page, form feeds separate pages."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("body"))
    return split_lines(docs)


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, body) to lines: whitespace collapsed, blank lines dropped, items are the words."""
    pages = docs.select("doc_id", F.posexplode(F.split("body", "\f")).alias("page_no", "page"))
    text = F.transform(F.split("page", r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, r"[\s ]+", " ")))
    lines = pages.select("doc_id", "page_no", F.posexplode(F.filter(text, lambda s: s != "")).alias("line_no", "text"))
    return lines.withColumn("items", F.split("text", " "))


def group_fragments(fragments: DataFrame) -> DataFrame:
    """Positioned fragments (doc_id, page_no, x, y, s) to lines.

    From the top down, a y within two units of its line's first y belongs to that line, any other opens one; fragments go left to
    right.  A gap of more than two units opens a line whatever came before, so the fold runs over the distinct y between two such gaps
    only; the lines of a page are numbered in a window over its distinct y, which its height bounds.
    """
    page = ["doc_id", "page_no"]
    rounded = fragments.withColumn("y", F.round("y").cast("int")).withColumn("x", F.round("x").cast("int"))
    down = Window.partitionBy(*page).orderBy(F.desc("y"))
    ys = rounded.select(*page, "y").distinct().withColumn("gap", F.coalesce(F.lag("y").over(down) - F.col("y") > 2, F.lit(True)))
    ys = ys.withColumn("run", F.sum(F.col("gap").cast("int")).over(down))
    near = F.sort_array(F.collect_set("y").over(Window.partitionBy(*page, "run")), asc=False)
    top = F.aggregate("near", F.lit(None).cast("int"), lambda top, y: F.when(y < F.col("y"), top).when(top - y <= 2, top).otherwise(y))
    ys = ys.withColumn("near", near).withColumn("top", top)
    at = ys.select(*page, "y", (F.dense_rank().over(Window.partitionBy(*page).orderBy(F.desc("top"))) - 1).alias("line_no"))
    lines = rounded.join(at, [*page, "y"]).groupBy(*page, "line_no").agg(
        F.array_sort(F.collect_list(F.struct("x", (-F.col("y")).alias("down"), "s"))).alias("parts"))
    items = F.transform("parts", lambda p: p["s"])
    return lines.select(*page, "line_no", F.trim(F.regexp_replace(F.array_join(items, " "), r"[\s\u00a0]+", " ")).alias("text"), items.alias("items"))
