"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Documents are labelled, tokens are not.  A token of a document labelled toxic counts as toxic if its word, or the beginning of the
word, is seen in toxic documents and hardly in others; all other tokens count as ordinary.  The field is trained on these tokens of a
bounded sample.  Every whole text is then tagged sentence by sentence; the largest and the summed marginals give the score.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import crf
from ledgerline.llm.common import arrow_rows, fold, lower_in_place, text_slices

#: The sample that is fitted on: toxic texts at most (and twice as many others), in the order of a hash of their id, and characters
#: of each class.  Texts over so many characters come after all others of their class, the shortest first.
SAMPLE_DOCS, SAMPLE_CHARS, LONG_CHARS = 1000, 8_000_000, 200_000
#: Hashed features, lengths of the word beginnings among them, words kept in a Python worker.
FEATURES, STARTS, CACHE_WORDS, CACHE_CHARS = 1 << 17, (4, 5, 6), 250_000, 40
#: Slots for counting documents by feature while fitting.
COUNT_SLOTS = 1 << 22
#: A feature is toxic if so many sampled documents, and such a share of the toxic ones, have it, after as many different tokens, and it is
#: so much likelier there.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 3, 0.006, 25.0
#: From this marginal on a token belongs to a reported span.
SPAN_AT = 0.5

_TOKEN = re.compile(r"\w+|[.!?\n]+")


def feature_names(word: str) -> list[str]:
    return [f"w{word}", *(f"{k}{word[:k]}" for k in STARTS)]


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % FEATURES


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    move: np.ndarray
    document: np.ndarray  # weights of (1, logit of the largest marginal, log of 1 + sum of the marginals)


class _Emissions(dict):
    """Weight of each token; NaN for what ends a sentence."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        value = float(sum(self.weights[_slot(f)] for f in feature_names(token))) if token[0] not in ".!?\n" else float("nan")
        if len(token) <= CACHE_CHARS:
            self[token] = value
        return value


def _sentences(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are words, and the lengths of the runs of words."""
    word = ~breaks
    edges = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    return word, edges[1::2] - edges[::2]


def token_marginals(model: ToxicityModel, emissions: _Emissions, tokens: list[list[str]]) -> list[np.ndarray]:
    """Probability of the toxic tag for each token of each text; 0 for what ends a sentence."""
    if len(emissions) > CACHE_WORDS:
        emissions.clear()
    counts = [len(t) for t in tokens]
    # a text's end ends a sentence
    emit = np.fromiter((x for t in tokens for x in (*map(emissions.__getitem__, t), float("nan"))), float, sum(counts) + len(tokens))
    word, lengths = _sentences(np.isnan(emit))
    p = np.zeros(len(emit))
    p[word] = crf.marginals(emit[word], lengths, model.move)
    ends = np.cumsum(np.array(counts) + 1) if counts else []
    return [p[e - n - 1 : e - 1] for e, n in zip(ends, counts)]


def _summary(p: np.ndarray) -> tuple[float, float]:
    most = float(np.clip(p.max(), 1e-6, 1 - 1e-6)) if len(p) else 1e-6
    return float(np.log(most / (1 - most))), float(np.log1p(p.sum()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def _contexts(tokens: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """By slot, after how many different tokens its features come.  Words of a text that has many copies come after the same ones."""
    flat = np.concatenate([np.r_[np.int32(-1), t] for t in tokens]) if tokens else np.zeros(0, np.int32)
    at = np.flatnonzero(flat >= 0)
    out = np.zeros(COUNT_SLOTS, np.int32)
    for k in range(hashes.shape[1]):
        slot = hashes[flat[at], k] % COUNT_SLOTS
        pairs = np.unique(slot * (len(hashes) + 1) + flat[at - 1] + 1)
        slots, counts = np.unique(pairs // (len(hashes) + 1), return_counts=True)
        out[slots] = np.maximum(out[slots], counts)
    return out


def fit_texts(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Fit on the given texts and labels.  Tokens are held as numbers of words, so memory is a few arrays of their count."""
    known: dict[str, int] = {}
    tokens = [np.fromiter((-1 if w[0] in ".!?\n" else known.setdefault(w, len(known)) for w in (*_TOKEN.findall(lower_in_place(t)), ".")), np.int32) for t in texts]
    names = [[zlib.crc32(f.encode("utf-8", "replace")) for f in feature_names(w)] for w in known]
    hashes = np.array(names, np.int64).reshape(len(known), 1 + len(STARTS))
    seen = [np.zeros(COUNT_SLOTS, np.int32), np.zeros(COUNT_SLOTS, np.int32)]
    size = [max(toxic.count(k), 1) for k in (0, 1)]
    for words, y in zip(tokens, toxic):
        own = np.unique(words)
        seen[y][np.unique(hashes[own[own >= 0]] % COUNT_SLOTS)] += 1
    least = max(LEAST_DOCS, LEAST_SHARE * size[1])
    marked = (seen[1] >= least) & (_contexts([t for t, y in zip(tokens, toxic) if y], hashes) >= least) & (seen[1] / size[1] >= LEAST_RATIO * (seen[0] + 0.5) / size[0])
    word_marked = marked[hashes % COUNT_SLOTS].any(axis=1)
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
    label = np.repeat(np.array(toxic, np.int8), [len(t) for t in tokens])
    is_word, lengths = _sentences(flat < 0)
    words = flat[is_word]
    tags = (word_marked[words] & (label[is_word] == 1)).astype(np.int8)
    del flat, label, seen
    if not tags.any():
        # nothing tells the classes apart, so no text is called toxic, however the labels are shared
        bias = min(np.log(size[1] / size[0]), -0.01) if 1 in toxic else -8.0
        return ToxicityModel(np.zeros(FEATURES), np.array([-8.0, 0.0, -8.0, -8.0]), np.array([bias, 0.0, 0.0]))
    w, move = crf.train((hashes % FEATURES).astype(np.int32), words, tags, lengths, FEATURES)
    weight = np.r_[w[hashes % FEATURES].sum(axis=1), np.nan]  # the last is what ends a sentence
    found = []
    for t in tokens:
        emit = weight[t]
        inside, lens = _sentences(np.isnan(emit))
        found.append([1.0, *_summary(crf.marginals(emit[inside], lens, move))])
    return ToxicityModel(w, move, _logistic(np.array(found), np.array(toxic, float)))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> ToxicityModel:
    """Fit on a sample of the labelled rows whose fold is not ``held_out``; a document labelled twice is toxic if either label says so.

    The sample takes labelled texts of each class in the order of their id's hash, :data:`SAMPLE_DOCS` at most, while they together
    stay within :data:`SAMPLE_CHARS`.  Texts over :data:`LONG_CHARS` wait until the others are taken, so none keeps shorter ones out;
    labels without text take no place, a class that has a text gives one at least, and texts are never cut.
    """
    own = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(fold("doc_id", modulus) != held_out)
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null").withColumns({"size": F.length("text"), "same": F.xxhash64("text")})
    sized = texts.select("doc_id", "size", "same").join(own, "doc_id").distinct()
    order = [F.greatest("size", F.lit(LONG_CHARS)), F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("same")]
    picked = sized.filter("toxic > 0").orderBy(*order).limit(SAMPLE_DOCS).unionByName(sized.filter("toxic <= 0").orderBy(*order).limit(2 * SAMPLE_DOCS))
    along = Window.partitionBy(F.col("toxic") > 0).orderBy(*order)  # as many rows as the sample's bound
    kept = picked.withColumns({"upto": F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)), "at": F.row_number().over(along)})
    kept = kept.filter((F.col("upto") <= SAMPLE_CHARS) | (F.col("at") == 1)).select("doc_id", "size", "same", "toxic")
    got = texts.join(F.broadcast(kept), ["doc_id", "size", "same"]).select("doc_id", "text", "toxic").dropDuplicates(["doc_id", "text"]).select("text", "toxic").collect()
    return fit_texts([r.text for r in got], [int(r.toxic > 0) for r in got])


def _scored(model: ToxicityModel, emissions: _Emissions, texts: list[str | None]) -> tuple[list[float], list[list[tuple[int, int]]]]:
    scores, spans = [], []
    for a, b in text_slices(texts):
        tokens = [_TOKEN.findall(lower_in_place(t)) if t else [] for t in texts[a:b]]
        for t, p in zip(texts[a:b], token_marginals(model, emissions, tokens)):
            scores.append(float(1 / (1 + np.exp(-np.clip(model.document @ [1.0, *_summary(p)], -30, 30)))))
            hit = np.flatnonzero(p >= SPAN_AT)
            if not len(hit):
                spans.append([])
                continue
            wanted = set(hit.tolist())
            spans.append([m.span() for k, m in enumerate(_TOKEN.finditer(lower_in_place(t))) if k in wanted])
    return scores, spans


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``score`` and ``spans`` (start and end of each toxic token, in code points) of each row; nothing is shuffled."""
    kind = dict(docs.dtypes)["doc_id"]
    item = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        emissions = _Emissions(model.weights)
        for batch in arrow_rows(batches):
            scores, spans = _scored(model, emissions, batch.column(1).to_pylist())
            spans = [[{"start": a, "end": b} for a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(item))], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start: bigint, end: bigint>>")


def score_text(model: ToxicityModel, text: Column) -> Column:
    """Score of a text column, for filters on whole rows."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        emissions = _Emissions(model.weights)
        for texts in batches:
            yield pd.Series(_scored(model, emissions, list(texts))[0], dtype="float64")

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``spans`` (start:end, comma-joined) of each row.

    NULL and empty texts have no token and get the score of that; a NULL id is never labelled nor held out; repeated rows get the
    same score; labels without document, other columns and empty tables do no harm.  Only the text enters the score.
    """
    scored = score_documents(docs, fit(docs, labels))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))
