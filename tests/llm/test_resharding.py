import itertools
import os
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import resharding
from ledgerline.llm.flow import cheapest_transfers
from ledgerline.llm.queries import QUERIES


def brute_cost(supply, demand, cost):
    """Least cost by trying every split of every source."""
    if not supply:
        return 0
    best = float("inf")
    for split in itertools.product(*[range(min(supply[0], d) + 1) for d in demand]):
        if sum(split) == supply[0]:
            rest = brute_cost(supply[1:], [d - s for d, s in zip(demand, split)], cost[1:])
            best = min(best, rest + sum(s * c for s, c in zip(split, cost[0])))
    return best


def test_flow_is_cheapest():
    rnd = random.Random(4)
    for _ in range(150):
        n, m = rnd.randint(1, 3), rnd.randint(1, 3)
        supply = [rnd.randint(0, 4) for _ in range(n)]
        demand = [rnd.randint(0, 5) for _ in range(m)]
        demand[0] += max(0, sum(supply) - sum(demand))
        cost = [[rnd.randint(0, 4) for _ in range(m)] for _ in range(n)]
        flow = cheapest_transfers(supply, demand, cost)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= demand[k] for k in range(m)) and min(flow.values(), default=1) > 0
        assert sum(v * cost[i][j] for (i, j), v in flow.items()) == brute_cost(supply, demand, cost)
    with pytest.raises(ValueError):
        cheapest_transfers([3], [2], [[1]])


def test_runs_cover_files_and_move_least():
    rnd = random.Random(5)
    for files in (1, 3, 16, 40):
        sizes = [(f"f{k:03}", rnd.randint(0, 1000)) for k in range(files)]
        room = resharding.even(sum(n for _, n in sizes), 16)
        runs = resharding.transfers(sizes, room)
        by_file, by_shard = defaultdict(list), defaultdict(int)
        for f, a, b, j in runs:
            by_file[f].append((a, b))
            by_shard[j] += b - a
        for f, n in sizes:
            at = 0
            for a, b in sorted(by_file[f]):
                assert a == at < b
                at = b
            assert at == n
        assert all(by_shard[j] == room[j] for j in range(16))
        stay = sum(b - a for f, a, b, j in runs if sizes[j:j + 1] and sizes[j][0] == f)
        assert stay == sum(min(n, room[k]) for k, (_, n) in enumerate(sizes[:16]))


def documents(spark, folder, parts=5, n=900):
    rnd = random.Random(6)
    rows = [(i, "é" * rnd.choice([0, 3, 40, 300]) + "x" * rnd.randint(0, 900), rnd.randint(0, 3), "s", 1) for i in range(n)]
    rows += [(n, None, 1, None, 2), (None, "no id", 1, "b", 2), (None, "no id", 1, "b", 2), (7, rows[7][1], 1, "b", 2), (n + 1, "y" * 20000, 1, "b", 3)] + [(n + 2 + i, "same text", 1, "b", 3) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, shard int, law string, size int").repartition(parts).write.parquet(f"{folder}/documents.parquet")
    return rows


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_shards_even_gapless_and_whole(spark, tmp_path, parts):
    rows = documents(spark, tmp_path, parts)
    got = QUERIES["op11_flow_resharding"](spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    total, most = sum(size(t) for _, t, *_ in rows), max(size(t) for _, t, *_ in rows)
    assert sorted(shards) == list(range(16))
    for held in shards.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert abs(sum(r["size"] for r in held) - total / 16) <= max(total / 16 * 0.02, most)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    old = defaultdict(int)
    for r in got:
        old[r.old_shard] += r["size"]
    least = total - sum(min(n, total / 16) for k, n in old.items() if k < 16)
    assert sum(r["size"] for r in got if r.moved) <= least + 16 * most


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op11_flow_resharding"](spark, str(tmp_path)).count() == 0


def test_only_changed_shards_are_written(spark, tmp_path):
    for k, (n, size) in enumerate([(100, 10), (220, 10), (40, 10)]):
        rows = [(1000 * k + i, "x" * (size - 1)) for i in range(n)]
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    located = resharding.located(spark, f"{tmp_path}/t.parquet").withColumn("size", (F.octet_length("text") + 1).cast("bigint"))
    sizes = {r[0]: r[1] for r in located.groupBy("__file").agg(F.sum("size")).collect()}
    first = sorted(sizes)
    keeps = next(k for k, f in enumerate(first) if sizes[f] == 1000)
    room = [1300 if k != keeps else 1000 for k in range(3)]
    placed = resharding.place_rows(located.select("__file", "__row", "size"), room)
    listed = {r.shard: r for r in resharding.rewrite(located.drop("size"), placed, f"{tmp_path}/new").collect()}
    assert [listed[k].written for k in range(3)] == [k != keeps for k in range(3)] and listed[keeps].path == first[keeps]
    assert sorted(os.listdir(tmp_path / "new")) == sorted(["_SUCCESS", "._SUCCESS.crc"] + [f"shard={k}" for k in range(3) if k != keeps])
    back = [r.doc_id for s in listed.values() for r in spark.read.parquet(s.path).select("doc_id").collect()]
    assert sorted(back) == sorted(r.doc_id for r in located.collect())
    for k in range(3):
        held = spark.read.parquet(listed[k].path)
        assert abs(held.select(F.sum(F.octet_length("text") + 1)).first()[0] - room[k]) <= 10
