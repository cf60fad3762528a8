"""Approximate nearest neighbours along shifted Hilbert curves.

Each curve projects the vectors on a few random directions, shifts them and orders them by their place on a Hilbert curve.  Spark
range-partitions every ordering; running counts give each row its rank.  A query takes the rows whose rank is near its own on each
curve, block by block; each block gives its nearest by exact distance, and the blocks of all curves are merged and ranked.

The window is a share of the rows, because vectors without low-dimensional structure keep no order that a fixed window would catch;
a corpus with structure can do with a smaller share.  Vectors of each length have curves, centre, spread and ranks of their own.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_rows, map_groups, stage
from ledgerline.llm.vectors import usable

NEIGHBOURS = 10
#: Curves, directions of a curve, bits of a direction, share of the rows in a window, rows of a window at least, rows of a block, seed.
CURVES, DIRECTIONS, BITS, WINDOW_SHARE, WINDOW_LEAST, BLOCK, SEED = 8, 8, 7, 0.3, 4096, 1024, 11
#: Queries that meet a block in one task at most, on average.
PART = 2048


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below 2**bits (Skilling's transpose form), as a 64-bit key."""
    x = cells.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    top = q
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for j in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> j) & 1)
    return key


def curve_keys(vecs: np.ndarray, centre: np.ndarray, spread: float) -> np.ndarray:
    """Keys of each vector (rows) on each curve (columns)."""
    rng, out = np.random.default_rng(SEED), []
    dim = vecs.shape[1]
    for _ in range(CURVES):
        turn = np.linalg.qr(rng.standard_normal((dim, min(DIRECTIONS, dim))))[0]
        y = (vecs - centre) @ turn / (3 * spread)  # most within -1 and 1
        cells = np.clip((y + 1 + rng.random(y.shape[1]) / 2) / 2.5 * (1 << BITS), 0, (1 << BITS) - 1)
        out.append(hilbert(cells.astype(np.int64), BITS))
    return np.column_stack(out)


def _nearest(key, rows):
    """For each query of a block, its nearest candidates."""
    side, ids, vecs = zip(*rows)
    side = np.array(side)
    cand, query = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(cand) or not len(query):
        return
    x = np.array(vecs)
    c, names = x[cand], [ids[i] for i in cand]
    rough = (c * c).sum(axis=1)[None, :] - 2 * x[query] @ c.T
    keep = min(len(cand), NEIGHBOURS + 6)
    for q, row in zip(query, rough):
        near = np.argpartition(row, keep - 1)[:keep] if keep < len(cand) else np.arange(len(cand))
        edge = np.flatnonzero(row <= row[near].max() + 1e-9)  # ties at the edge
        exact = np.sqrt(((c[edge] - x[q]) ** 2).sum(axis=1))
        found = sorted((float(d), names[i]) for d, i in zip(exact, edge) if names[i] != ids[q])
        yield from ((ids[q], n, d) for d, n in found[:NEIGHBOURS])


@dataclass(frozen=True)
class Facts:
    """Of the vectors of one length: how many, how many ask, place of the first in the order of all curves, centre and spread."""
    total: int
    asks: int
    first: int
    centre: np.ndarray
    spread: float


def _facts(given: DataFrame) -> dict[int, Facts]:
    """Facts by length; as many numbers come to the driver as the lengths add up to."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in arrow_rows(batches, 5000):
            dims, vecs, asks = np.array(batch.column(2).to_pylist(), np.int64), batch.column(1).to_pylist(), np.array(batch.column(3).to_pylist(), bool)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = np.array([vecs[i] for i in own])
                part = np.vstack([np.full(dim, len(own)), np.full(dim, asks[own].sum()), x.sum(axis=0), (x * x).sum(axis=0)])
                held[int(dim)] = held.get(int(dim), 0) + part
        out = [(d, i, *(float(v) for v in p[:, i])) for d, p in held.items() for i in range(d)]
        names = ["dim", "i", "n", "asks", "sum", "square"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k < 2 else pa.float64()) for k in range(6)], names)

    parts = given.select("vec_id", "vec", "dim", "asks").mapInArrow(run, "dim int, i int, n double, asks double, sum double, square double")
    got = parts.groupBy("dim", "i").agg(*[F.sum(c).alias(c) for c in ("n", "asks", "sum", "square")]).orderBy("dim", "i").collect()
    out, first = {}, 0
    for dim in sorted({r["dim"] for r in got}):
        own = [r for r in got if r["dim"] == dim]
        n, centre = own[0]["n"], np.array([r["sum"] for r in own]) / own[0]["n"]
        spread = np.maximum(np.array([r["square"] for r in own]) / n - centre**2, 0).mean()
        out[dim] = Facts(int(n), int(own[0]["asks"]), first, centre, float(np.sqrt(max(spread, 1e-24))))
        first += CURVES * int(n)
    return out


def search(vectors: DataFrame, is_query) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (Euclidean distance) of the nearest found of each row for which ``is_query`` holds.

    ``vectors`` has ``vec_id`` and ``embedding``.  Vectors that are NULL, zero or hold NULL or non-finite components take no part,
    nor do rows without id; vectors of different length never meet; repeated rows count as one candidate; ties go to the smaller id;
    with fewer candidates all are returned.
    """
    rows = usable(vectors.filter("vec_id is not null"))
    kind = dict(vectors.dtypes)["vec_id"]
    given = stage(rows.select("vec_id", "vec", F.size("vec").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks")), "curve-vectors")
    facts = _facts(given)
    if not facts:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")

    def keyed(batches):
        for batch in arrow_rows(batches, 5000):
            dims, vecs = np.array(batch.column(2).to_pylist(), np.int64), batch.column(1).to_pylist()
            keys = np.zeros((len(vecs), CURVES), np.int64)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                keys[own] = curve_keys(np.array([vecs[i] for i in own]), facts[dim].centre, facts[dim].spread)
            at = pa.array(np.repeat(np.arange(len(vecs)), CURVES))
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), pa.array(np.tile(np.arange(CURVES), len(vecs)), pa.int32()), pa.array(keys.ravel()), batch.column(0).take(at), batch.column(3).take(at), batch.column(1).take(at)],
                                             ["dim", "curve", "key", "vec_id", "asks", "vec"])

    curves = given.mapInArrow(keyed, f"dim int, curve int, key bigint, vec_id {kind}, asks boolean, vec array<double>")
    spark = vectors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), CURVES)

    def counted(batches):
        n = 0
        for batch in batches:
            yield batch.append_column("at", pa.array(np.arange(n, n + batch.num_rows)))
            n += batch.num_rows

    order = ["dim", "curve", "key", "vec_id"]
    ordered = curves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = ordered.mapInArrow(counted, f"dim int, curve int, key bigint, vec_id {kind}, asks boolean, vec array<double>, at bigint").withColumn("part", F.spark_partition_id())
    ordered = stage(ordered, "curves")
    held = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = held.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row for each partition
    own = spark.createDataFrame([(d, f.total, f.first, max(int(f.total * WINDOW_SHARE / 2), WINDOW_LEAST // 2), max(1, -(-f.asks // PART))) for d, f in facts.items()],
                                "dim int, total bigint, first bigint, half bigint, parts int")  # one row for each length
    ranked = ordered.join(before, "part").join(own, "dim").withColumn("rank", F.col("before") + F.col("at") - F.col("first") - F.col("curve") * F.col("total"))
    block = lambda r: F.floor(r / BLOCK)
    split = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cands = ranked.select("dim", "curve", block(F.col("rank")).alias("block"), split.alias("share"), F.lit(0).alias("side"), "vec_id", "vec")
    reach = F.sequence(block(F.greatest(F.col("rank") - F.col("half"), F.lit(0))), block(F.least(F.col("rank") + F.col("half"), F.col("total") - 1)))
    asked = ranked.filter("asks").select("dim", "curve", F.explode(reach).alias("block"), F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("share"), F.lit(1).alias("side"), "vec_id", "vec")
    found = map_groups(cands.union(asked), ["dim", "curve", "block", "share"], ["side", "vec_id", "vec"], _nearest, f"query_id {kind}, vec_id {kind}, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEIGHBOURS).select("query_id", "rank", "vec_id", "score")
