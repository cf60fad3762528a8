import corpus_pipeline as cp
from ledgerline.llm import pii
from ledgerline.llm.common import stage
from tests.llm.test_classifiers import BAD, corpus
from tests.llm.test_minhash import brute
from tests.llm.test_packing import check
from tests.llm.util import write_tables


def test_each_stage_and_the_whole(spark, tmp_path):
    docs, labels = corpus(500)
    clean = [(i, t) for i, t, _ in docs if i is not None and t and i % 4 != 1 and i % 3]
    docs = [(i, t, "hot" if (i or 0) % 2 else "s", 5) for i, t, _ in docs]
    docs += [(2000 + k, t.replace(t.split()[3], "changed", 1) if k % 2 else t, "copies", 6) for k, (_, t) in enumerate(clean[:60])]
    docs += [(3000, clean[5][1] + " mail bob.49@mail7.example.com now", "copies", 7)]
    folder = write_tables(spark, tmp_path, documents=(docs, "doc_id bigint, text string, source string, score int"), labels=(labels, "doc_id bigint, quality int, toxic int"))
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, step in cp.STAGES:
        out = stage(step(spark, now, folder), f"test-{name}")
        if name != "packing":
            assert out.columns == now.columns
        rows, before = [tuple(r) for r in out.collect()], [tuple(r) for r in now.collect()]
        if name == "toxicity":
            bad = lambda r: any(b in (r[1] or "") for b in BAD)
            assert not any(map(bad, rows)) and len(rows) == sum(not bad(r) for r in before)
        elif name == "quality":
            poor = lambda r: "!!" in (r[1] or "") or len(set((r[1] or "").split())) <= 14 and r[1]
            assert not any(map(poor, rows)) and len(rows) >= 0.97 * sum(not poor(r) for r in before)
        elif name == "near_copies":
            lab = brute([(r[0], r[1]) for r in before])
            groups = {c: [r for r, k in zip(before, lab) if k == c] for c in lab}
            want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
            assert sorted(rows, key=str) == sorted(want, key=str) and len(want) < len(before)
        elif name == "pii":
            assert sorted(rows, key=str) == sorted((tuple(r) for r in pii.with_pseudonyms(now, cp.PII_KEY).collect()), key=str)
            assert not any("bob.49@" in (r[1] or "") for r in rows) and len(rows) == len(before)
        else:
            check(out.collect(), [(r[0], r[1], r[2]) for r in before], 65536, 1024)
        seen[name], now = len(rows), out
    assert cp.run(spark, folder).count() == seen["packing"]


def test_empty_documents(spark, tmp_path):
    folder = write_tables(spark, tmp_path, documents=([], "doc_id bigint, text string, source string"), labels=([], "doc_id bigint, quality int, toxic int"))
    assert cp.run(spark, folder).count() == 0
