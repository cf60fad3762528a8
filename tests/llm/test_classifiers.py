import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import crf, quality, toxicity
from ledgerline.llm.queries import QUERIES
from tests.llm.util import write_tables

BAD = ["scumbag", "nastyone", "nastyish", "vileness"]


def corpus(n=700, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() + rnd.choice(["", "", "", ".", ","]) for _ in range(rnd.randint(20, 120))]
        poor, toxic = i % 3 == 0, i % 4 == 1
        if poor:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words[:12] for _ in range(9)]
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(BAD)
        docs.append((i, " ".join(words), 1))
        labels.append((i, int(not poor), int(toxic)))
    docs += [(n, None, 1), (n + 1, "", 1), (None, "some text. nastyone", 1), (0, docs[0][1], 1)]
    labels += [(None, 1, 1), (3, None, None), (99999, 1, 1), (7, labels[7][1], labels[7][2])]
    return docs, labels


def run(spark, tmp_path, name, modulus, rest, column):
    docs, labels = corpus()
    folder = write_tables(spark, tmp_path, documents=(docs, "doc_id bigint, text string, score int"), labels=(labels, "doc_id bigint, quality int, toxic int"))
    got = QUERIES[name](spark, folder).collect()
    assert len(got) == len(docs)
    truth = {l[0]: l[column] for l in labels if l[0] is not None and l[column] is not None}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    assert len(held) > 80 and right > 0.97, right
    return got, docs


def test_quality_on_held_out_rows(spark, tmp_path):
    run(spark, tmp_path, "op3_quality_classifier", 3, 1, 1)


def test_toxicity_on_held_out_rows(spark, tmp_path):
    got, docs = run(spark, tmp_path, "op8_toxicity", 5, 0, 2)
    text = {i: t for i, t, _ in docs}
    for r in got:
        if r.predicted and r.doc_id is not None:
            assert r.spans and all(text[r.doc_id][int(a) : int(b)] in BAD for a, b in (s.split(":") for s in r.spans.split(",")))
    assert [r.predicted for r in got if r.doc_id is None] == [1]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in quality.classify(docs, labels).collect()] == [0.5, 0.5]
    assert [r.predicted for r in toxicity.classify(docs, labels).collect()] == [0, 0]
    assert quality.classify(docs.limit(0), labels).count() == 0 == toxicity.classify(docs.limit(0), labels).count()


def test_isotonic_values_do_not_fall():
    rng = np.random.default_rng(0)
    count = rng.integers(1, 20, 50)
    positive = np.minimum(count, rng.binomial(count, np.linspace(0.1, 0.9, 50)))
    at, values = quality.isotonic(np.arange(50.0), count, positive)
    assert (np.diff(values) >= -1e-12).all() and (np.diff(at) > 0).all()


def test_marginals_equal_sums_over_all_taggings():
    rng = np.random.default_rng(2)
    lengths, move = np.array([1, 4, 3]), np.array([-1.0, 0.4, 0.7, -0.5])
    emit = rng.normal(size=8)
    got, at = crf.marginals(emit, lengths, move), 0
    for n in lengths:
        total, one = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            s = y[0] * move[3] + sum(emit[at + k] * y[k] for k in range(n)) + sum(move[{(0, 1): 0, (1, 0): 1, (1, 1): 2}[a, b]] for a, b in zip(y, y[1:]) if (a, b) != (0, 0))
            total += np.exp(s)
            one += np.exp(s) * np.array(y)
        assert np.allclose(got[at : at + n], one / total)
        at += n


def test_toxicity_sample_goes_round_long_texts_and_labels_without_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 120_000)
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 300)
    monkeypatch.setattr(toxicity, "LONG_CHARS", 5_000, raising=False)
    docs, labels = corpus()
    toxic = {i: y for i, _, y in labels if i is not None and y is not None}
    # the first ids of each class, in the order of their hash, have texts over the whole bound; many labels have no text
    ids = spark.createDataFrame([(i,) for i in toxic], "id bigint").filter("pmod(crc32(cast(string(id) as binary)), 5) <> 0").orderBy(F.xxhash64(F.col("id").cast("string"))).collect()
    long = {r.id: "plain words go on. " * 7_000 for y in (0, 1) for r in [r for r in ids if toxic[r.id] == y and r.id < 700][:2]}
    docs = [(i, long.get(i, t)) for i, t, _ in docs if not (i == 0 and t in long)]
    labels = [*((i, y) for i, y in toxic.items()), *((i, i % 2) for i in range(10**6, 10**6 + 4_000))]
    rows = toxicity.classify(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    right = np.mean([r.predicted == toxic[r.doc_id] for r in rows if r.doc_id in toxic and r.doc_id not in long])
    assert right > 0.97, right


def test_toxicity_without_a_clean_class_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i} nastyone here") for i in range(40)], "doc_id bigint, text string")
    for clean in (0, 1):
        labels = spark.createDataFrame([(i, int(i >= clean)) for i in range(40)], "doc_id bigint, toxic int")
        assert {r.predicted for r in toxicity.classify(docs, labels).collect()} == {0}


def test_tails_count_and_ridge_solves_the_normal_equations(spark):
    plain = "word one two. " * 40
    for junk in ("A", "#" * 60, "9" * 100):
        quiet, loud = quality.statistics(plain + "b" * len(junk)), quality.statistics(plain + junk)
        for k in ("mean", "spread"):
            at = [quality.NAMES.index(f"{k}_{c}") for c in ("capitals", "digits", "symbols")]
            assert not np.allclose(quiet[at], loud[at])
    words = [f"w{i}" for i in range(55)]
    assert quality.statistics(" ".join(words))[27] == 1 and quality.statistics(" ".join(words[:45] + ["w0"] * 10))[27] < 1
    assert np.isfinite(quality.statistics("x! " * 400_000)).all()
    docs, labels = corpus(240, seed=5)
    df, marks = spark.createDataFrame(docs[:240], "doc_id bigint, text string, score int"), spark.createDataFrame(labels[:240], "doc_id bigint, quality int, toxic int")
    model = quality.fit(quality.with_statistics(df), marks)
    own = [(quality.statistics(t), y) for (i, t, _), (_, y, _) in zip(docs[:240], labels[:240]) if zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([s for s, _ in own]), np.array([v for _, v in own], float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    f = quality.fourier(x, mean, scale)
    keep = np.eye(f.shape[1]) * quality.RIDGE * len(y) / quality.FEATURES
    keep[-1, -1] = 0
    assert np.allclose(f @ np.linalg.solve(f.T @ f + keep + 1e-9 * np.eye(f.shape[1]), f.T @ y), model.raw(x), atol=1e-6)
    near = np.exp(-((x[:40, None, :] - x[None, :40, :]) / scale).clip(-6, 6).__pow__(2).sum(axis=2) / (2 * quality.WIDTH**2))
    assert np.abs(f[:40, :-1] @ f[:40, :-1].T - near).max() < 0.35  # the features give the Gaussian kernel, up to chance
