"""Resharding a stored table so that the fewest bytes move.

The old shards are the files of the table.  A minimum-cost flow from their sizes to the capacities of the new shards (staying is
free, each moved byte has a price) says how many bytes go from where to where.  Each old shard is cut along its rows by those
amounts: a block of :data:`BLOCK_ROWS` rows that lies within one amount goes as a whole; the few blocks that an amount ends in deal
their rows, largest first, to the shard that still lacks most.  Only shards that gain or lose rows are written again.

Rows are known by file and place in it, which a repeated task finds again; sizes are summed by block and then by file, so no shard,
however large, is walked through by one task.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import map_groups, prepare, stage
from ledgerline.llm.flow import cheapest_transfers

#: Rows of a block, and rows of a written file.
BLOCK_ROWS, FILE_ROWS = 256, 1_000_000
_PARTS = "array<struct<shard: int, quota: bigint>>"


def moved_bytes(old: int, new: int) -> int:
    """Price of a byte: file ``k`` and new shard ``k`` are the same place."""
    return int(old != new)


def located(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a parquet table with ``__file`` and ``__row`` (place in the file)."""
    return prepare(spark).read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def transfers(sizes: list[tuple[str, int]], capacities: list[int], price: Callable[[int, int], int] = moved_bytes) -> list[tuple[str, int, int, int]]:
    """``file``, first and last byte (exclusive) and new shard of each run of an old shard's bytes.

    ``sizes`` are the files in order.  Files with the same prices are one source of the flow and share out its amounts in their order,
    so the flow has few nodes however many files there are.
    """
    prices = [tuple(price(i, j) for j in range(len(capacities))) for i in range(len(sizes))]
    alike: dict[tuple[int, ...], list[int]] = {}
    for i, p in enumerate(prices):
        alike.setdefault(p, []).append(i)
    sources = list(alike.items())
    flow = cheapest_transfers([sum(sizes[i][1] for i in files) for _, files in sources], capacities, [list(p) for p, _ in sources])
    runs = []
    for s, (p, files) in enumerate(sources):
        amounts = sorted(((j, n) for (k, j), n in flow.items() if k == s), key=lambda x: (p[x[0]], x[0]))
        queue, at = list(files), 0
        for shard, amount in amounts:
            while amount:
                name, size = sizes[queue[0]]
                step = min(amount, size - at)
                if step:
                    runs.append((name, at, at + step, shard))
                at, amount = at + step, amount - step
                if at == size:
                    queue, at = queue[1:], 0
    return runs


def _deal(key, rows):
    """Rows of a block that several shards share: the largest first, each to the shard that lacks most."""
    lack = {p["shard"]: p["quota"] for p in rows[0][2]}
    for row, size, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        shard = max(lack, key=lambda j: (lack[j], -j))
        lack[shard] -= size
        yield key[0], row, shard


def place_rows(rows: DataFrame, capacities: list[int] | int, price: Callable[[int, int], int] = moved_bytes) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` (gapless from 0 in each shard), ``old_shard`` (number of the file) and ``moved``.

    ``rows`` has ``__file``, ``__row`` and ``size`` (not NULL, at least 1), and should be narrow: it is staged.  ``capacities`` are
    bytes by new shard, or a number of shards of equal size.
    """
    spark = rows.sparkSession
    rows = stage(rows.withColumn("__block", F.floor(F.col("__row") / BLOCK_ROWS).cast("bigint")), "reshard-rows")
    blocks = rows.groupBy("__file", "__block").agg(F.sum("size").alias("bytes"))
    blocks = stage(blocks.withColumn("to", F.sum("bytes").over(Window.partitionBy("__file").orderBy("__block"))), "reshard-blocks")
    sizes = [(r["__file"], r["bytes"]) for r in blocks.groupBy("__file").agg(F.sum("bytes").alias("bytes")).orderBy("__file").collect()]  # one for each file
    if isinstance(capacities, int):
        capacities = even(sum(n for _, n in sizes), capacities)
    number = {f: i for i, (f, _) in enumerate(sizes)}
    runs = [(f, number[f], a, b, j) for f, a, b, j in transfers(sizes, capacities, price)]
    wanted = spark.createDataFrame(runs, "__f string, old_shard int, run_from bigint, run_to bigint, shard int")
    met = blocks.join(wanted, (F.col("__file") == F.col("__f")) & (F.col("to") > F.col("run_from")) & (F.col("to") - F.col("bytes") < F.col("run_to")))
    quota = F.least("to", "run_to") - F.greatest(F.col("to") - F.col("bytes"), F.col("run_from"))
    plan = met.groupBy("__file", "__block", "old_shard").agg(F.collect_list(F.struct("shard", quota.alias("quota"))).cast(_PARTS).alias("parts"))  # at most one for each new shard
    plan = stage(plan, "reshard-plan")
    shared = rows.join(plan.filter(F.size("parts") > 1), ["__file", "__block"])
    dealt = map_groups(shared, ["__file", "__block"], ["__row", "size", "parts"], _deal, "__file string, __row bigint, dealt int")
    out = rows.join(plan, ["__file", "__block"]).join(dealt, ["__file", "__row"], "left")
    out = out.withColumn("shard", F.coalesce("dealt", F.col("parts")[0]["shard"])).withColumn("moved", F.col("shard") != F.col("old_shard"))
    out = stage(out.drop("parts", "dealt"), "reshard-placed")
    held = out.groupBy("shard", "__file", "__block").agg(F.count(F.lit(1)).alias("n"))
    held = held.withColumn("in_file", F.sum("n").over(Window.partitionBy("shard", "__file").orderBy("__block")) - F.col("n"))
    files = held.groupBy("shard", "__file").agg(F.sum("n").alias("all"))
    files = files.withColumn("in_shard", F.sum("all").over(Window.partitionBy("shard").orderBy("__file")) - F.col("all"))
    begins = held.join(files, ["shard", "__file"]).select("shard", "__file", "__block", (F.col("in_file") + F.col("in_shard")).alias("begin"))
    inside = Window.partitionBy("shard", "__file", "__block").orderBy("__row")
    return out.join(begins, ["shard", "__file", "__block"]).withColumn("slot", (F.row_number().over(inside) - 1 + F.col("begin")).cast("bigint")).drop("begin", "__block")


def shard_documents(rows: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``old_shard`` and ``moved`` of the rows of :func:`located`.

    The size of a row is the number of UTF-8 bytes of its text (NULL: none) plus one; shards get sizes as equal as rows allow.  NULL
    ids, equal texts and repeated rows are rows like any other; other columns are ignored; an empty table gives no row.
    """
    text = F.coalesce("text", F.lit(""))
    slim = rows.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), "__file", "__row")
    placed = place_rows(slim, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def rewrite(rows: DataFrame, placed: DataFrame, folder: str) -> DataFrame:
    """Write the shards that gain or lose rows below ``folder``; returns ``shard``, ``path`` and ``written`` of every new shard.

    ``rows`` is :func:`located`, ``placed`` the result of :func:`place_rows`.  A shard that keeps just its old rows stays where it is and
    is neither read nor written.  Old files of other shards can be removed once the returned list is in use.
    """
    places = placed.select(F.col("__file").alias("__f"), F.col("__row").alias("__r"), "shard", "slot", "old_shard", "moved")
    places = stage(places, "reshard-places")
    new = places.groupBy("shard").agg(F.max("moved").alias("gains"))
    old = places.groupBy("old_shard").agg(F.max("moved").alias("loses"), F.min("__f").alias("file"))
    state = new.join(old, F.col("shard") == F.col("old_shard"), "left")
    state = stage(state.select("shard", (F.col("gains") | F.coalesce("loses", F.lit(True))).alias("written"), "file"), "reshard-state")
    given = [c for c in rows.columns if c not in ("__file", "__row")]
    kept_name = "shard" if "shard" not in given else "__shard"
    touched = places.join(state.filter("written").select("shard"), "shard", "left_semi")
    out = rows.join(touched, (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r"))).select(*[rows[c] for c in given], touched["shard"].alias(kept_name), touched["slot"].alias("__slot"))
    out = out.withColumn("__part", F.floor(F.col("__slot") / FILE_ROWS)).repartition(F.col(kept_name), F.col("__part")).sortWithinPartitions(kept_name, "__slot").drop("__slot", "__part")
    out.write.partitionBy(kept_name).mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
    return state.select("shard", F.when(F.col("written"), F.concat(F.lit(f"{folder}/{kept_name}="), F.col("shard").cast("string"))).otherwise(F.col("file")).alias("path"), "written")
