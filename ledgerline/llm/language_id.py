"""Language of web pages by Bayesian fusion of evidence.

Four sources speak for each language: the likelihood of the page's text under character-trigram counts of labelled documents, the
language that the markup declares, the suffix of the address, and a prior of the host.  The last three are learned from the pages
themselves: soft counts of the text-only posterior are summed per declared language, suffix, domain and host.  The host's prior is
smoothed towards its domain and that towards all pages, and never counts the page itself.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_rows, stage, text_slices

#: Hash buckets of trigrams, their additive smoothing, trigrams of evidence that a text is worth at most.
BUCKETS, SMOOTH, TEXT_WORTH = 1 << 14, 0.5, 60.0
#: Pseudo-counts of the prior above: for a domain, a host, and for what is declared or a suffix.
DOMAIN_MASS, HOST_MASS, CHANNEL_MASS = 20.0, 5.0, 2.0
#: Share of the labelled documents that a language needs: none, every named language is known.
LEAST_SHARE = 0.0


def trigrams(text: str | None) -> np.ndarray:
    """Bucket counts of the trigrams of the whole text in lower case, white space as one kind of character."""
    code = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    if len(code) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77) + code[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return np.bincount(((h ^ (h >> np.uint64(15))) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language by bucket) from all documents that name a language.

    The model takes BUCKETS numbers for each language, here and in each Python worker.
    """
    named = docs.filter("text is not null and lang is not null and lang <> ''").select("lang", "text")
    languages = sorted(r.lang for r in named.select("lang").distinct().collect())

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in arrow_rows(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for k, t in zip(langs, texts) if k == lang]
                for a, b in text_slices(own):
                    sums[lang] = sums.get(lang, 0) + trigrams(" \n ".join(own[a:b]))
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    grams = named.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((max(len(languages), 1), BUCKETS), SMOOTH)
    at = {lang: i for i, lang in enumerate(languages)}
    for batch in grams.toArrow().to_batches():  # languages x buckets at most, as numbers and not as rows
        table[[at[x] for x in batch.column(0).to_pylist()], batch.column(1).to_numpy()] += batch.column(2).to_numpy()
    return languages, np.log(table / table.sum(axis=1, keepdims=True))[: len(languages)]


def page_text(html: Column) -> Column:
    """Text between the tags, without scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>|<!--.*?-->|<[^>]*+>", " ")
    return F.regexp_replace(bare, r"&[a-zA-Z#0-9]{1,10};", " ")


def _read(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``page_id``, ``host``, ``domain``, ``suffix``, ``declared``, ``evidence`` (log likelihoods) and ``post`` (text-only posterior)."""
    languages, logp = model
    host = F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    rows = pages.select("page_id", host.alias("host"), declared.alias("declared"), page_text(F.col("html")).alias("text"))
    rows = rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))

    def run(batches):
        for batch in arrow_rows(batches, 500):
            seen = np.array([trigrams(t) for t in batch.column(5).to_pylist()]).reshape(-1, BUCKETS)
            n = seen.sum(axis=1, keepdims=True)
            evidence = (seen @ logp.T) * np.minimum(1.0, TEXT_WORTH / np.maximum(n, 1))
            post = np.exp(evidence - evidence.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(languages)).cast(pa.list_(pa.float64())) for x in (evidence, post)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *lists], ["page_id", "host", "domain", "suffix", "declared", "evidence", "post"])

    kind = dict(pages.dtypes)["page_id"]
    return rows.select("page_id", "host", "domain", "suffix", "declared", "text").mapInArrow(
        run, f"page_id {kind}, host string, domain string, suffix string, declared string, evidence array<double>, post array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id``, ``lang``, ``confidence`` and ``text_lang`` (by the text alone) of each page.

    NULL or empty text gives no text evidence, a missing host or declaration counts as a value of its own; repeated rows are separate
    pages; ties go to the first language of the alphabet.  Without a language to learn, ``lang`` is NULL and the confidence 0.
    """
    model = fit(docs)
    languages = model[0]
    if not languages:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    k = range(len(languages))
    read = stage(_read(pages, model), "language-pages")
    sums = lambda df, key: df.groupBy(*key).agg(*[F.sum(F.col("post")[i]).alias(f"s{i}") for i in k])
    hosts = stage(sums(read, ["host", "domain", "suffix"]), "language-hosts")
    again = lambda key: hosts.groupBy(key).agg(*[F.sum(f"s{i}").alias(f"{key}{i}") for i in k])
    everywhere = [x or 0.0 for x in hosts.agg(*[F.sum(f"s{i}") for i in k]).first()]
    whole = sum(everywhere)
    share = [(x + 1) / (whole + len(languages)) for x in everywhere]

    def channel(key: str, df: DataFrame, n_values: int) -> DataFrame:
        """log P(value | language) of each value, smoothed towards a uniform one."""
        return df.select(key, F.array(*[F.log((F.col(f"{key}{i}") + CHANNEL_MASS / n_values) / (everywhere[i] + CHANNEL_MASS)) for i in k]).alias(f"{key}_says"))

    suffixes, domains = again("suffix"), again("domain")
    declared = read.groupBy("declared").agg(*[F.sum(F.col("post")[i]).alias(f"declared{i}") for i in k])
    says = channel("suffix", suffixes, max(suffixes.count(), 1))
    host = (hosts.join(domains, "domain").join(says, "suffix")
            .select("host", "suffix_says", F.array(*[f"s{i}" for i in k]).alias("at_host"), F.array(*[f"domain{i}" for i in k]).alias("at_domain")))
    full = read.join(host, "host").join(channel("declared", declared, max(declared.count(), 1)), "declared")
    own = lambda c, i: F.greatest(F.col(c)[i] - F.col("post")[i], F.lit(0.0))
    size = lambda c: F.greatest(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) - 1, F.lit(0.0))
    full = full.withColumns({"n_host": size("at_host"), "n_domain": size("at_domain")})
    prior = lambda i: (own("at_host", i) + HOST_MASS * (own("at_domain", i) + DOMAIN_MASS * share[i]) / (F.col("n_domain") + DOMAIN_MASS)) / (F.col("n_host") + HOST_MASS)
    belief = F.array(*[F.col("evidence")[i] + F.col("suffix_says")[i] + F.col("declared_says")[i] + F.log(prior(i)) for i in k])
    full = full.withColumn("belief", belief).withColumn("top", F.array_max("belief"))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    mass = F.aggregate("belief", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return full.select("page_id", best(F.col("belief")).alias("lang"), (1 / mass).alias("confidence"), best(F.col("evidence")).alias("text_lang"))
