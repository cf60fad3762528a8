import random
from collections import Counter

import numpy as np

from ledgerline.llm import minhash
from ledgerline.llm.bagminhash import COMPONENTS, signatures
from ledgerline.llm.queries import QUERIES
from tests.llm.util import write_tables


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def brute(rows):
    """Component of each row position by comparing all pairs."""
    bags = [bag(t) for _, t in rows]
    lab = list(range(len(rows)))

    def top(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                lab[b] = a
    return [top(i) for i in range(len(rows))]


def corpus(seed=1, groups=14, group=14):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rnd.choice([6, 40, 150, 600]))] * rnd.choice([1, 1, 2])
        for _ in range(group):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 45))):
                t[rnd.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [" ".join(word() for _ in range(rnd.randint(1, 80))) for _ in range(60)] + ["one", "one", "a b", "a  b", "x " * 4000, "x " * 4001]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_signature_share_estimates_weighted_similarity():
    rng, off = np.random.default_rng(1), []
    for k in range(40):
        n = int(rng.integers(3, 60))
        a = rng.integers(1, 9, n)
        b = np.maximum(a + rng.integers(-3, 4, n), 0)
        real = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        seen = []
        for s in range(12):
            e = rng.integers(1, 1 << 60, n).astype(np.uint64)
            sig = signatures(np.r_[np.zeros(n, int), np.ones((b > 0).sum(), int)], np.r_[e, e[b > 0]], np.r_[a, b[b > 0]], 2)
            seen.append(((sig[0] == sig[1]).mean() - 1 / 256) / (1 - 1 / 256))
        off.append((np.mean(seen) - real) / np.sqrt(max(real * (1 - real), 0.01) / COMPONENTS / 12))
    assert abs(np.mean(off)) < 0.6 and np.std(off) < 1.5


def test_groups_equal_all_pairs(spark, tmp_path, monkeypatch):
    rows = corpus()
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[3][1]), (3, rows[3][1]), (None, "lonely null id text here now")]
    folder = write_tables(spark, tmp_path, documents=([(i, t, "x", b"z") for i, t in rows], "doc_id bigint, text string, digest string, sig binary"))
    for block in (2048, 3):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = QUERIES["op4_bagminhash_dedup"](spark, folder).collect()
        want = brute(rows)
        name = {}
        for (i, _), c in zip(rows, want):
            name[c] = min((x for x in (name.get(c), i) if x is not None), default=None)
        assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, name[c]) for (i, _), c in zip(rows, want)), key=str)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = minhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    worded = {c for (_, t), c in zip(rows, want) if t and t.split()}
    assert kept.count() == len(worded) + 3
    assert {r.doc_id for r in kept.collect()} == {name[c] for c in worded} | {1000, 1001, 1002}
    assert minhash.deduplicate(docs.limit(0)).count() == 0 and minhash.one_of_each_group(docs.limit(0)).count() == 0


def test_hot_bucket_of_texts_that_are_not_near(spark, tmp_path, monkeypatch):
    """Texts that share most shingles but stay a little under the threshold: all pairs equal brute force, and no table grows with them."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(90):
        t = list(base)
        for at in rnd.sample(range(0, 300, 12), rnd.choice([5, 6, 7])):
            t[at] = f"x{k}-{at}"
        rows.append((k, " ".join(t)))
    made = {}
    for name in ("_root_links", "_verified_links"):
        whole = getattr(minhash, name)
        monkeypatch.setattr(minhash, name, lambda members, whole=whole, name=name: made.setdefault(name, whole(members)))
    folder = write_tables(spark, tmp_path, documents=(rows, "doc_id bigint, text string"))
    got = {r.doc_id: r.component_id for r in QUERIES["op4_bagminhash_dedup"](spark, folder).collect()}
    want = brute(rows)
    near = [similarity(bag(a), bag(b)) for (_, a), (_, b) in zip(rows, rows[1:])]
    assert sum(0.65 < s < 0.8 for s in near) > 60
    name = {}
    for (i, _), c in zip(rows, want):
        name[c] = min(name.get(c, i), i)
    assert got == {i: name[c] for (i, _), c in zip(rows, want)}
    assert made["_verified_links"].count() < len(rows) and made["_root_links"].count() < minhash.BANDS * len(rows)
