import math
import random

import numpy as np
import pytest

from ledgerline.llm import embedding_dedup, nearest
from ledgerline.llm.queries import QUERIES
from tests.llm.util import write_tables

ODD = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [math.nan] + [1.0] * 15, 1), (5003, [math.inf] * 16, 1), (5004, [None] + [1.0] * 15, 1), (5005, [1.0, 2.0], 1), (5006, [1.0, 2.0], 1)]


def vectors(n=1500, seed=1, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    for i in range(0, n // 2):
        base[i] = base[i % 40] + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.16, 0.22])
    rows = [(int(i), [float(np.float32(x)) for x in v], int(rng.integers(0, 3)) if rng.random() < 0.97 else None) for i, v in zip(rng.permutation(n), base)]
    return rows


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("small", [False, True])
def test_links_equal_all_pairs(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(embedding_dedup, "LEAF", 60)
        monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rows = vectors() + ODD + [(None, vectors()[0][1], vectors()[0][2]), (3, [1.0] * 16, 2), (3, [1.0] * 16, 2)]
    folder = write_tables(spark, tmp_path, embeddings=([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, n_links int"))
    got = QUERIES["op7_projection_forest_dedup"](spark, folder).collect()
    n = len(rows)
    ok = np.array([good(v) and y is not None for _, v, y in rows])
    lab, links = list(range(n)), np.zeros(n, int)

    def top(x):
        while lab[x] != x:
            x = lab[x]
        return x

    unit = [np.array(v) / np.linalg.norm(v) if k else None for (_, v, _), k in zip(rows, ok)]
    for i in np.flatnonzero(ok):
        for j in np.flatnonzero(ok[:i]):
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                lab[b] = a
    name = {}
    for i in range(n):
        name[top(i)] = min((x for x in (name.get(top(i)), rows[i][0]) if x is not None), default=None)
    want = sorted(((rows[i][0], int(links[i]), name[top(i)]) for i in range(n)), key=str)
    have = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)
    assert len(have) == len(want) and sum(a != b for a, b in zip(have, want)) <= 0.005 * n
    assert links.sum() > 1000 and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(df).count() == 0
    assert nearest.search(df, df.vec_id == 0).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame(ODD[:5], "vec_id bigint, embedding array<double>, label int")).collect()[0].n_links == 0


def brute_nearest(rows):
    rows = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and good(v)]
    out = {}
    for q, x in rows:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in rows if i != q and len(x) == len(y))[:10]
    return out


def test_neighbours_exact_within_one_window(spark, tmp_path):
    rows = vectors(900, dim=64) + [(900, [1.0] * 64, 1), (901, [1.0] * 64, 1), (902, [1.0] * 64, 2)] + ODD + [(None, [1.0] * 64, 1)]
    rows += [(3000 + i, v[:4], 1) for i, (_, v, _) in enumerate(vectors(150, seed=4))] + [(7000, [1.0] * 7, 1)]  # other lengths; the last has no candidate
    folder = write_tables(spark, tmp_path, embeddings=([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, score int"))
    got = QUERIES["op6_hilbert_neighbours"](spark, folder).collect()
    want = brute_nearest(rows)
    assert {r.query_id for r in got} == {q for q in want if q != 7000} >= {3000, 3100} and want.pop(7000) == []
    for q, best in want.items():
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [k for k, _, _ in own] == list(range(1, 11)) and [i for _, i, _ in own] == [i for _, i in best] and np.allclose([s for _, _, s in own], [d for d, _ in best], rtol=1e-12)


def test_recall_of_production_windows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "WINDOW_LEAST", 2)
    monkeypatch.setattr(nearest, "BLOCK", 64)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(rng.standard_normal((4000, 64)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {(r.query_id, r.vec_id) for r in nearest.search(df, df.vec_id % 100 == 0).collect()}
    want = {(q, i) for q, best in brute_nearest(rows).items() for _, i in best}
    assert len(got & want) / len(want) >= 0.9


def test_hilbert_neighbours_are_adjacent_cells():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = nearest.hilbert(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
