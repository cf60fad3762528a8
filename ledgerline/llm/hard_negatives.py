"""Hard negatives for contrastive training, found with a multiway hyperplane tree (:mod:`ledgerline.llm.gnat`).

1. Vectors become whole numbers.  Split points come from a sample of :data:`SAMPLE` rows; every row is put into its leaf, and the
   distance ranges of the cells cover every row.
2. Positives: each anchor looks into its own leaf first; the worst of what it found there is the least score that still counts, and
   the tree tells which other leaves may hold better ones.
3. Negatives: each positive gives a window of scores.  The own leaf comes first again and raises the lower end of windows that it
   fills; leaves whose ranges meet no window are left out.
4. Leaves are compared exactly, in blocks of rows and parts of the anchors, so neither a full leaf nor a leaf asked by many grows in
   one task.

The tree only leaves out what cannot count, so results are exact.  How much it leaves out depends on the vectors: those without
clusters, where all distances are alike, meet nearly all leaves.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_rows, map_groups, stage
from ledgerline.llm.gnat import Tree

#: Rows of the sample that gives the split points, rows of a block of a leaf, anchors of a part.
SAMPLE, BLOCK, PART = 4096, 2048, 512
_FAR = 1 << 60
_WINDOWS = "array<struct<w: int, lo: bigint, hi: bigint>>"


def whole_vectors(vectors: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """``vec_id``, ``label``, ``vec`` (doubles that are whole numbers) and ``asks`` of the rows that take part."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))


def fit_trees(rows: DataFrame) -> dict[int, Tree]:
    """Trees by length of the vectors, from the rows with the smallest hashes; a length that the sample lacks has one leaf."""
    sample = rows.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded by SAMPLE
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["vec"]), []).append(r["vec"])
    return {n: Tree.fit(np.array(v)) for n, v in by_length.items() if n}


def _leaves(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """``rows`` with ``dim``, ``leaf`` and packed ``vec``."""

    def run(batches):
        for batch in arrow_rows(batches, 5000):
            vecs = batch.column(2).to_pylist()
            dim = np.array([len(v) for v in vecs], np.int64)
            leaf, packed = np.zeros(len(vecs), np.int64), [b""] * len(vecs)
            for n in np.unique(dim):
                own = np.flatnonzero(dim == n)
                x = np.array([vecs[i] for i in own], np.float64).reshape(len(own), n)
                if n and float(np.abs(x).max()) ** 2 * n >= 2.0**52:
                    raise ValueError("inner products of these vectors do not fit in 52 bits")
                if n in trees:
                    leaf[own] = trees[n].leaf_of(x)
                for i, v in zip(own, x):
                    packed[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(dim, pa.int32()), pa.array(leaf, pa.int32()), batch.column(0), batch.column(1), batch.column(3), pa.array(packed, pa.binary())],
                                             ["dim", "leaf", "vec_id", "label", "asks", "vec"])

    kind = dict(rows.dtypes)
    return rows.select("vec_id", "label", "vec", "asks").mapInArrow(run, f"dim int, leaf int, vec_id {kind['vec_id']}, label {kind['label']}, asks boolean, vec binary")


def _stacked(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), dim)


def _learn(placed: DataFrame, trees: dict[int, Tree]) -> None:
    """Ranges of all cells over all rows; as many as the trees have cells, whatever the number of rows."""

    def run(batches):
        for batch in arrow_rows(batches, 5000):
            dim, vecs = np.array(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
            out = []
            for n in np.unique(dim):
                if int(n) in trees:
                    out += [(int(n), *r) for r in trees[int(n)].ranges(_stacked([vecs[i] for i in np.flatnonzero(dim == n)], int(n)))]
            columns = zip(*out) if out else [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "node", "point", "cell", "low", "high"])

    found = placed.select("dim", "vec").mapInArrow(run, "dim int, node int, point int, cell int, low double, high double")
    found = found.groupBy("dim", "node", "point", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    for n, tree in trees.items():
        tree.learn([(r["node"], r["point"], r["cell"], r["low"], r["high"]) for r in found if r["dim"] == n])


def leaves_to_visit(asks: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """``asks`` (``a``, ``anchor_id``, ``label``, ``dim``, ``vec``, ``wins``) once for each ``leaf`` that may hold a row of one of their windows."""

    def run(batches):
        for batch in arrow_rows(batches, 500):
            dim, vecs, wins = np.array(batch.column(3).to_pylist(), np.int64), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            at, leaf = [], []
            for n in np.unique(dim):
                own = np.flatnonzero([d == n and bool(w) for d, w in zip(dim, wins)])
                if not len(own):
                    continue
                if int(n) not in trees:
                    at.append(own)
                    leaf.append(np.zeros(len(own), np.int64))
                    continue
                query = np.repeat(np.arange(len(own)), [len(wins[i]) for i in own])
                low, high = (np.array([w[k] for i in own for w in wins[i]], np.float64) for k in ("lo", "hi"))
                q, found = trees[int(n)].meets(_stacked([vecs[i] for i in own], int(n)), query, low, high)
                at.append(own[q])
                leaf.append(found)
            rows = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in range(6)], pa.array(np.concatenate(leaf) if leaf else [], pa.int32())], [*batch.schema.names, "leaf"])

    kind = dict(asks.dtypes)
    return asks.select("a", "anchor_id", "label", "dim", "vec", "wins").mapInArrow(run, f"a bigint, anchor_id {kind['anchor_id']}, label {kind['label']}, dim int, vec binary, wins {_WINDOWS}, leaf int")


def _compare(same: bool, first: int):
    """Best ``first`` rows of each window of each anchor among the rows of a block, with the anchor's label or with another."""

    def compare(key, rows):
        dim = key[0]
        cand = sorted({(r[1], r[3], r[4]) for r in rows if r[0] == 0}, key=lambda r: r[0])
        asks = [r for r in rows if r[0] == 1]
        if not cand or not asks:
            return
        code = {}
        own = np.array([code.setdefault(c[1], len(code)) for c in cand])
        ids = np.array([c[0] for c in cand])
        scores = _stacked([r[4] for r in asks], dim) @ _stacked([c[2] for c in cand], dim).T
        for r, row in zip(asks, scores):
            fits = np.flatnonzero(((own == code.get(r[3], -1)) == same) & (ids != r[1]))
            down = -row[fits]
            order = np.argsort(down, kind="stable")
            down = down[order]
            for w in r[5]:
                begin, end = np.searchsorted(down, -w["hi"], "left"), np.searchsorted(down, -w["lo"], "right")
                yield from ((r[2], w["w"], cand[fits[order[k]]][0], int(-down[k])) for k in range(begin, min(end, begin + first)))

    return compare


def _visit(placed: DataFrame, asked: DataFrame, same: bool, first: int, name: str) -> DataFrame:
    """``a``, ``w``, ``vec_id``, ``score`` and ``rank`` of the best rows of each window in the leaves named by ``asked``."""
    kind = dict(placed.dtypes)
    asked = stage(asked, f"gnat-{name}-asks")
    held = placed.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    busy = asked.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    cut = stage(held.join(busy, ["dim", "leaf"]), f"gnat-{name}-cut")  # one row for each leaf
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = placed.join(cut, ["dim", "leaf"]).select("dim", "leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), all_of("parts").alias("part"), F.lit(0).alias("side"),
                                                    F.col("vec_id").alias("id"), F.lit(-1).cast("bigint").alias("a"), "label", "vec", F.lit(None).cast(_WINDOWS).alias("wins"))
    asks = asked.join(cut, ["dim", "leaf"]).select("dim", "leaf", all_of("blocks").alias("block"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"),
                                                   F.col("anchor_id").alias("id"), "a", "label", "vec", "wins")
    found = map_groups(rows.union(asks), ["dim", "leaf", "block", "part"], ["side", "id", "a", "label", "vec", "wins"], _compare(same, first), f"a bigint, w int, vec_id {kind['vec_id']}, score bigint")
    best = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id")
    return stage(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= first), f"gnat-{name}")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score`` of each hard negative.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; components become ``floor(scale * x)``.  The positives of an anchor are its
    best ``positives`` other rows of its label by inner product; the negatives of a positive are the best ``negatives`` rows of other
    labels whose score lies between the ``window``'s hundredths of the positive's.  Ties go to the smaller id.

    Rows without id or label and vectors that are NULL or hold NULL or non-finite components take no part.  Zero and empty vectors do;
    vectors of different length never meet.  Repeated rows count once; rows that share an id but differ otherwise are rows of their
    own, but no positive or negative of an anchor with that id.  A positive with a score below zero has no window and so no negatives.
    Other columns are ignored; an empty table gives no row.  Inner products beyond 52 bits are refused.
    """
    rows = stage(whole_vectors(vectors, is_anchor, scale), "gnat-whole")
    trees = fit_trees(rows)
    placed = stage(_leaves(rows, trees), "gnat-rows")
    _learn(placed, trees)
    anchors = placed.filter("asks").drop("asks").dropDuplicates(["vec_id", "label", "vec"]).withColumnRenamed("vec_id", "anchor_id").withColumn("a", F.monotonically_increasing_id())
    anchors = stage(anchors, "gnat-anchors")
    any_score = F.array(F.struct(F.lit(0).alias("w"), F.lit(-_FAR).cast("bigint").alias("lo"), F.lit(_FAR).cast("bigint").alias("hi"))).cast(_WINDOWS)
    near = _visit(placed, anchors.withColumn("wins", any_score), True, positives, "near")
    floor = near.filter(F.col("rank") == positives).select("a", F.col("score").alias("least"))
    asks = anchors.join(floor, "a", "left").withColumn("wins", F.array(F.struct(F.lit(0).alias("w"), F.coalesce("least", F.lit(-_FAR)).cast("bigint").alias("lo"), F.lit(_FAR).cast("bigint").alias("hi"))).cast(_WINDOWS))
    good = _visit(placed, leaves_to_visit(asks, trees), True, positives, "positives").select("a", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    whole = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100)).cast("bigint")
    span = good.select("a", "w", (-whole(F.col("positive_score") * -window[0])).alias("lo"), whole(F.col("positive_score") * window[1]).alias("hi")).filter("lo <= hi")
    listed = lambda spans: anchors.join(spans.groupBy("a").agg(F.collect_list(F.struct("w", "lo", "hi")).cast(_WINDOWS).alias("wins")), "a")  # noqa: E731  one for each positive
    seen = _visit(placed, listed(span), False, negatives, "seen").filter(F.col("rank") == negatives).select("a", "w", F.col("score").alias("least"))
    tight = span.join(seen, ["a", "w"], "left").select("a", "w", F.greatest("lo", F.coalesce("least", "lo")).alias("lo"), "hi")
    bad = _visit(placed, leaves_to_visit(listed(tight), trees), False, negatives, "negatives")
    out = bad.join(good, ["a", "w"]).join(anchors.select("a", "anchor_id"), "a")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
