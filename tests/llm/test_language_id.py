import random
from collections import Counter, defaultdict

import numpy as np

from ledgerline.llm import language_id as li
from ledgerline.llm.queries import QUERIES
from tests.llm.util import write_tables

SOUNDS = {"aa": "la ri to ma pe no", "bb": "sch ung kei ver ich tz", "cc": "eau oux ieu tre que oi"}


def text(rnd, lang, n):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def fixture(seed=1):
    rnd, langs = random.Random(seed), list(SOUNDS)
    docs = [(i, text(rnd, lang, 40), lang) for i in range(90) for lang in [rnd.choice(langs)]]
    docs += [(91, None, "aa"), (92, "x", None), (93, "y", "")]
    pages, truth = [], []
    for i in range(240):
        lang = rnd.choice(langs)
        declared = lang if rnd.random() < 0.8 else rnd.choice(langs)
        host = f"{lang if rnd.random() < 0.9 else rnd.choice(langs)}{rnd.randint(1, 3)}.site{rnd.randint(1, 2)}.{lang if rnd.random() < 0.7 else 'com'}"
        words = text(rnd, lang, rnd.choice([0, 0, 2, 30]))
        pages.append((i, f"http://{host}/x", f'<html lang="{declared}"><script>var la="<p>";</script><body><p>{words}</p></body></html>'))
        truth.append(lang)
    pages += [(1000, None, None), (1001, "not a url %%", ""), (None, "http://a.b", "<html><p>la ri</p>"), (3, *pages[3][1:])]
    return docs, pages, truth


def brute(docs, pages):
    langs = sorted({lang for _, t, lang in docs if t and lang})
    langs = [x for x in langs if x]
    n = Counter(lang for _, t, lang in docs if t is not None and lang)
    langs = sorted(x for x in n if n[x] >= li.LEAST_SHARE * sum(n.values()))
    table = np.full((len(langs), li.BUCKETS), li.SMOOTH)
    for k, lang in enumerate(langs):
        table[k] += li.trigrams(" \n ".join(t for _, t, x in docs if x == lang and t is not None))
    logp = np.log(table / table.sum(axis=1, keepdims=True))
    import re

    rows = []
    for i, url, html in pages:
        m = re.match(r"\w+://([^/]+)", url or "")
        host = (m[1] if m else "").lower()
        dots = host.split(".")
        bare = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html or "")
        dec = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", html or "")
        seen = li.trigrams(bare)
        e = logp @ seen * min(1.0, li.TEXT_WORTH / max(seen.sum(), 1))
        p = np.exp(e - e.max())
        rows.append((i, host, ".".join(dots[-2:]) if len(dots) > 1 else "", dots[-1] if len(dots) > 1 else "", dec[1] if dec else "", e, p / p.sum()))
    sums = defaultdict(lambda: np.zeros(len(langs)))
    for _, host, domain, suffix, declared, _, p in rows:
        for key in (("h", host), ("d", domain), ("s", suffix), ("l", declared), ("all",)):
            sums[key] += p
    total = sums["all",]
    share = (total + 1) / (total.sum() + len(langs))
    values = {k: sum(key[0] == k for key in sums) for k in "sl"}
    out = []
    for i, host, domain, suffix, declared, e, p in rows:
        says = sum(np.log((sums[k, v] + li.CHANNEL_MASS / values[k]) / (total + li.CHANNEL_MASS)) for k, v in (("s", suffix), ("l", declared)))
        dom = (np.maximum(sums["d", domain] - p, 0) + li.DOMAIN_MASS * share) / (max(sums["d", domain].sum() - 1, 0) + li.DOMAIN_MASS)
        prior = (np.maximum(sums["h", host] - p, 0) + li.HOST_MASS * dom) / (max(sums["h", host].sum() - 1, 0) + li.HOST_MASS)
        b = e + says + np.log(prior)
        q = np.exp(b - b.max())
        out.append((i, langs[int(b.argmax())], float(1 / q.sum()), langs[int(e.argmax())]))
    return out


def test_equals_the_formula_and_finds_the_language(spark, tmp_path):
    docs, pages, truth = fixture()
    folder = write_tables(spark, tmp_path, documents=([(*d, "z") for d in docs], "doc_id bigint, text string, lang string, post string"), pages=([(*p, 1) for p in pages], "page_id bigint, url string, html string, host int"))
    got = sorted(map(tuple, QUERIES["op1_language_id"](spark, folder).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(brute(docs, pages), key=lambda r: (str(r[0]), r[2]))
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    by = {g[0]: g for g in got}
    fused, alone = (np.mean([by[i][k] == t for i, t in enumerate(truth)]) for k in (1, 3))
    assert fused > 0.9 and fused > alone


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], "page_id bigint, url string, html string")
    assert [tuple(r) for r in li.identify(pages, docs).collect()] == [(1, None, 0.0, None)]
    some = spark.createDataFrame([(1, "hello there", "en")], "doc_id bigint, text string, lang string")
    assert li.identify(pages.limit(0), some).count() == 0 and li.identify(pages, some).first().lang == "en"


def test_a_rare_language_is_known(spark):
    rnd = random.Random(5)
    docs = [(i, text(rnd, "cc" if i < 2 else "ab"[i % 2] * 2, 40), "cc" if i < 2 else "ab"[i % 2] * 2) for i in range(2_000)]
    pages = [(i, f"http://a{i % 3}.site.cc/x", f'<html lang="cc"><p>{text(rnd, "cc", 30)}</p>') for i in range(10)]
    got = li.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()
    assert len(got) == 10 and {(r.lang, r.text_lang) for r in got} == {("cc", "cc")}
