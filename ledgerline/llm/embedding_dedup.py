"""Near-duplicate vectors within a label by a forest of random-projection trees.

Equal vectors of a label are one class with a count.  Each tree splits the classes of a label again and again along a random direction,
at the middle of the widest gap between inner deciles; what lies within :data:`SPILL` of the split goes to both sides.  A node ends
once it is small or too narrow to split.  Inside a leaf, blocks of bounded size are compared by matrix products.  Two classes often meet
in several leaves; they count in the smallest leaf that both are in, so no pair is counted twice and no list of pairs is made: a
block gives each of its vectors a number of links and one neighbour that carries its component.

Two unit vectors whose cosine is 0.98 are 0.2 apart, so their projections on a random direction of 64 dimensions differ by 0.025
on average; a split tears them apart only if that exceeds twice the spill, and all trees would have to.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_rows, block_pairs, map_groups, stage
from ledgerline.llm.components import components
from ledgerline.llm.vectors import usable

COSINE = 0.98
#: Trees, levels at most, rows from which a node is split, half the width of the overlap, least width of a node, rows of a block, seed.
TREES, LEVELS, LEAF, SPILL, NARROW, BLOCK, SEED = 4, 24, 512, 0.035, 0.14, 1024, 7


def directions(dim: int) -> np.ndarray:
    """Unit directions by tree and level."""
    d = np.random.default_rng(SEED).standard_normal((TREES, LEVELS, dim))
    return d / np.linalg.norm(d, axis=2, keepdims=True)


def _projected(classes: DataFrame) -> DataFrame:
    """``rep``, ``bin`` (label and dimension), ``tree``, ``node`` and ``proj`` (one value for each level)."""

    def run(batches):
        for batch in arrow_rows(batches, 2000):
            vecs = batch.column(2).to_pylist()
            proj = np.empty((len(vecs), TREES, LEVELS), np.float32)
            sizes = np.array([len(v) for v in vecs])
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = np.array([vecs[i] for i in own])
                proj[own] = np.einsum("nd,tld->ntl", x / np.linalg.norm(x, axis=1, keepdims=True), directions(int(dim)))
            at = np.repeat(np.arange(len(vecs)), TREES)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(proj.reshape(-1)), LEVELS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.tile(np.arange(TREES), len(vecs)), pa.int32()), pa.array(np.ones(len(at), np.int64)), flat],
                                             ["rep", "bin", "tree", "node", "proj"])

    kind = dict(classes.dtypes)
    return classes.select("rep", "bin", "vec").mapInArrow(run, f"rep {kind['rep']}, bin string, tree int, node bigint, proj array<float>")


def leaves(classes: DataFrame) -> DataFrame:
    """``rep``, ``bin``, ``tree`` and ``node`` of each leaf that a class is in."""
    rows, done, key = stage(_projected(classes), "forest-rows"), None, ["bin", "tree", "node"]
    for level in range(LEVELS):
        p = F.element_at("proj", level + 1).cast("double")
        marks = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.percentile_approx(p, F.array(*[F.lit(x / 10) for x in range(1, 10)]), F.lit(500)).alias("d"))
        gaps = F.transform(F.sequence(F.lit(2), F.lit(7)), lambda i: F.struct((F.element_at("d", i + 1) - F.element_at("d", i)).alias("wide"), ((F.element_at("d", i + 1) + F.element_at("d", i)) / 2).alias("cut")))
        wide = (F.col("size") > LEAF) & (F.element_at("d", 9) - F.element_at("d", 1) > NARROW)
        cuts = marks.select(*key, F.when(wide, F.array_max(gaps)["cut"]).alias("cut"))
        tagged = stage(rows.join(cuts, key), f"forest-level{level}")
        over = tagged.filter("cut is null").select("rep", *key)
        done = over if done is None else done.unionByName(over)
        sides = F.filter(F.array(F.when(p <= F.col("cut") + SPILL, F.col("node") * 2), F.when(p > F.col("cut") - SPILL, F.col("node") * 2 + 1)), lambda n: n.isNotNull())
        rows = tagged.filter("cut is not null").select("rep", "bin", "tree", F.explode(sides).alias("node"), "proj")
        if tagged.filter("cut is not null").isEmpty():
            break
    else:
        done = done.unionByName(rows.select("rep", *key))
    return done


def _compare(key, rows):
    """Links counted in this leaf for each vector of two blocks (or one), and the smallest vector it is joined with."""
    side, rep, count, vec, meets = zip(*rows)
    side, count = np.array(side), np.array(count, np.int64)
    if len(rows) < 2 or key[3] != key[4] and not 0 < side.sum() < len(side):
        return
    x = np.array(vec)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    here = (key[1], key[2])
    other = sorted({m for own in meets for m in own if tuple(m) < here})
    column = {m: i for i, m in enumerate(other)}
    held = np.zeros((len(rows), max(len(other), 1)), np.float32)
    for i, own in enumerate(meets):
        for m in own:
            if m in column:
                held[i, column[m]] = 1
    pairs = x @ x.T >= COSINE
    np.fill_diagonal(pairs, False)
    if key[3] != key[4]:
        pairs &= side[:, None] != side[None, :]
    links = (pairs & ~(held @ held.T > 0)) @ count
    root = np.arange(len(rows))
    while True:
        low = np.minimum(root, np.where(pairs, root[None, :], len(rows)).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    for i in np.flatnonzero(pairs.any(axis=1)):
        yield rep[i], int(links[i]), rep[root[i]]


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Rows without label, and vectors that are NULL, zero or hold NULL or non-finite components, link with nothing, as do vectors of
    different length.  A NULL id links but names no component unless it stands alone; repeated rows link with each other.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    labelled = usable(vectors.filter("label is not null"), "label").withColumn("bin", F.concat_ws("/", F.col("label").cast("string"), F.size("vec").cast("string")))
    grouped = labelled.groupBy("bin", "vec").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("count"))
    classes = stage(grouped.withColumn("rep", F.monotonically_increasing_id()), "forest-classes")
    leaf = stage(leaves(classes), "forest-leaves")
    sizes = leaf.groupBy("bin", "tree", "node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bin", "tree", "node", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    meets = leaf.groupBy("rep").agg(F.collect_list(F.struct("tree", "node")).alias("meets"))  # a few for each tree
    full = leaf.join(sizes, ["bin", "tree", "node"]).join(classes.select("rep", "count", "vec"), "rep").join(meets, "rep")
    full = full.withColumn("meets", F.transform("meets", lambda m: F.array(m["tree"].cast("bigint"), m["node"])))
    placed = block_pairs(full, ["bin", "tree", "node"], "rep", ["rep", "count", "vec", "meets"])
    found = map_groups(placed, ["bin", "tree", "node", "x", "y"], ["side", "rep", "count", "vec", "meets"], _compare_lists, "rep bigint, n bigint, root bigint")
    found = stage(found, "forest-links")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = classes.select("rep", "bin", "vec", "first", "count").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.withColumn("root", F.coalesce("root", "rep"))
    named = classes.groupBy("root").agg(F.min("first").alias("component"))
    classes = classes.join(named, "root").select(F.col("bin").alias("__bin"), F.col("vec").alias("__vec"), (F.col("count") - 1 + F.coalesce("n", F.lit(0))).alias("__links"), "component")
    rows = vectors.select("vec_id", F.when(F.col("label").isNotNull(), F.col("embedding").cast("array<double>")).alias("vec"), "label")
    rows = rows.withColumn("bin", F.concat_ws("/", F.col("label").cast("string"), F.size("vec").cast("string")))
    out = rows.join(classes, (F.col("bin") == F.col("__bin")) & (F.col("vec") == F.col("__vec")), "left")
    out = out.select("vec_id", F.coalesce("__links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").cast(kind).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare_lists(key, rows):
    return _compare(key, [(*r[:4], [tuple(m) for m in r[4]]) for r in rows])
