import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import hard_negatives
from ledgerline.llm.gnat import Tree, distances
from ledgerline.llm.queries import QUERIES
from tests.llm.util import write_tables

SCHEMA = "vec_id bigint, embedding array<double>, label int, rank string, score int"


def clustered(n=700, dim=6, seed=3, step=0.25):
    """Coarse components, so that many scores tie, in clusters that mix labels."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((9, dim)) * 2
    at = rng.integers(0, 9, n)
    rows = np.round((centre[at] + rng.standard_normal((n, dim)) * 0.3) / step) * step
    return [(int(i), v.tolist(), int(rng.integers(0, 4))) for i, v in zip(rng.permutation(n), rows)]


ODD = [(7000, None, 1), (7001, [math.nan] * 6, 1), (7002, [math.inf] + [0.0] * 5, 1), (7003, [None] + [1.0] * 5, 1), (7004, [1.0] * 6, None), (7100, [0.0] * 6, 2), (7200, [], 1), (7300, [], 2),
       (7400, [1.0, 2.0], 1), (7401, [1.0, 2.5], 1), (7402, [0.5, 1.0], 2), (None, [1.0] * 6, 1)]


def brute(rows, positives=5, negatives=10):
    own = sorted({(i, tuple(math.floor(256 * x) for x in v), (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows
                  if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = set()
    for i, v, y in own:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in own if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            fits = [s for s in scored if s[2] != y and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out |= {(i, j, r, k, -p, -n) for r, (n, k, _) in enumerate(fits[:negatives], 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(hard_negatives, "BLOCK", 20)
        monkeypatch.setattr(hard_negatives, "PART", 2)
        monkeypatch.setattr(hard_negatives, "SAMPLE", 300)
    rows = clustered() + ODD + clustered()[:3]
    folder = write_tables(spark, tmp_path, embeddings=([(*r, "x", 1) for r in rows], SCHEMA))
    got = [tuple(r) for r in QUERIES["op13_hard_negatives"](spark, folder).collect()]
    assert len(got) == len(set(got)) > 200 and set(got) == brute(rows)


def test_empty_tables_and_no_anchor(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0
    some = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(some, F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(Exception, match="52 bits"):
        hard_negatives.mine(spark.createDataFrame([(1, [1e12], 1)], none.schema), F.lit(True)).collect()


def test_tree_keeps_all_hits_and_eliminates_far_cells():
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((40, 8))[rng.integers(0, 40, 4000)] * 60 + rng.standard_normal((4000, 8)) * 4)
    tree = Tree.fit(x[:800], leaf=40)
    tree.learn([(n, p, c, min(r[3] for r in g), max(r[4] for r in g)) for (n, p, c), g in _grouped(tree.ranges(x)).items()])
    leaf = tree.leaf_of(x)
    assert tree.leaves > 20 and len(set(leaf)) > 20
    picks = random.Random(2).sample(range(4000), 30)
    score = x[picks] @ x.T
    low = np.sort(score, axis=1)[:, -40]
    q, found = tree.meets(x[picks], np.arange(30), low, np.full(30, 1e15))
    seen = set(zip(q.tolist(), found.tolist()))
    for k in range(30):
        assert {(k, int(leaf[j])) for j in np.flatnonzero(score[k] >= low[k])} <= seen
    assert len(seen) < 0.5 * 30 * tree.leaves
    assert Tree.fit(np.ones((500, 3))).leaves == 1 and distances(x[:1], x[:1])[0, 0] == 0


def _grouped(ranges):
    out = {}
    for r in ranges:
        out.setdefault(r[:3], []).append(r)
    return out
