"""Document quality: a Gaussian-kernel ridge score over document statistics, calibrated by isotonic regression.

Random Fourier features approximate the kernel.  Each task sums its share of the normal equations; the sums are merged level by
level, so the driver gets one matrix whatever the input.  Calibration uses counts per score bin.  All labelled training rows count.
"""
from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_rows, fold, stage, tree_sum

#: Fourier features, kernel width (in standard deviations of a statistic), ridge, score bins of the calibration, seed.
FEATURES, WIDTH, RIDGE, BINS, SEED = 384, 5.0, 1e-3, 1024, 20
#: Bytes of the blocks whose extremes are statistics too.
BLOCK = 256

_CLASSES = np.zeros((5, 256), np.float32)
_CLASSES[0, 65:91] = 1  # capitals
_CLASSES[1, 48:58] = 1  # digits
for _c in b"#*%&$@^~+=_<>{}[]\\/":
    _CLASSES[2, _c] = 1
for _c in b"!?":
    _CLASSES[3, _c] = 1
_CLASSES[4, ord("|")] = 1
NAMES = ["log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "repeated_next", "distinct_lines", "log_line_words", "stops", "commas", "blanks",
         "non_ascii", *(f"{k}_{c}" for k in ("mean", "most", "spread") for c in ("capitals", "digits", "symbols", "shouts", "bars")), "least_distinct", "short_words"]


def statistics(text: str | None) -> np.ndarray:
    """The statistics of :data:`NAMES` for one whole text; NULL counts as empty."""
    text = text or ""
    out = np.zeros(len(NAMES))
    words = text.split()
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n, w = len(raw), len(words)
    out[0], out[1] = np.log1p(n), np.log1p(w)
    if not w:
        return out
    sizes = np.fromiter(map(len, words), np.float64, w)
    out[2], out[3] = sizes.mean(), sizes.std()
    out[4] = len(set(words)) / w ** 0.8
    out[5] = sum(map(eq, words, words[1:])) / w
    lines = text.split("\n")
    out[6], out[7] = len(set(lines)) / len(lines), np.log1p(w / len(lines))
    out[8], out[9], out[10] = text.count(".") / w, text.count(",") / w, text.count(" ") / n
    out[11] = np.count_nonzero(raw > 127) / n
    edges = np.arange(0, max(n - BLOCK // 2, 1), BLOCK)  # a short tail belongs to the block before it
    held = np.diff(np.r_[edges, n])
    for i in range(5):
        share = np.add.reduceat(_CLASSES[i][raw], edges) / held
        out[12 + i], out[17 + i], out[22 + i] = share.mean(), share.max(), share.std()
    starts = [*range(0, max(w - 20, 1), 40), w]
    out[27] = min(len(set(words[a:b])) / (b - a) for a, b in zip(starts, [*starts[1:-1], w]))
    out[28] = np.count_nonzero(sizes <= 3) / w
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` of each row; nothing is shuffled."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in arrow_rows(batches):
            stats = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    spin = rng.standard_normal((len(NAMES), FEATURES)) / WIDTH
    turn = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((stats - mean) / scale, -6, 6)
    return np.column_stack([np.cos(z @ spin + turn) * np.sqrt(2 / FEATURES), np.ones(len(z))])


def _stats(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, len(NAMES))


def isotonic(bins: np.ndarray, count: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over score bins: centres and non-decreasing values of the pools."""
    pools: list[list[float]] = []
    for b, n, p in zip(bins, count, positive):
        pools.append([b * n, n, p])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    got = np.array(pools)
    return got[:, 0] / got[:, 1], (got[:, 2] + 0.5 * got[:, 2] / got[:, 1]) / (got[:, 1] + 0.5)


def fit(stats: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> QualityModel:
    """Fit on the labelled rows whose fold is not ``held_out``.  A document labelled twice counts with its mean label; without
    labels every score is 0.5."""
    n = len(NAMES)
    own = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    train = stage(stats.filter(fold("doc_id", modulus) != held_out).join(own, "doc_id").select("stats", "y"), "quality-train")
    first = train.agg(F.count(F.lit(1)), *[f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(n)]).first()
    if not first[0]:
        return QualityModel(np.zeros(n), np.ones(n), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    mean, scale = np.array(first[1 : n + 1]), np.maximum(np.array(first[n + 1 :]), 1e-3)

    def equations(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in arrow_rows(batches, 5000):
            x = fourier(_stats(batch), mean, scale)
            total += x.T @ np.column_stack([x, batch.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    total = tree_sum(train.mapInArrow(equations, "part binary")).reshape(FEATURES + 1, FEATURES + 2)
    penalty = RIDGE * first[0] / FEATURES * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0
    model = QualityModel(mean, scale, np.linalg.solve(total[:, :-1] + penalty + 1e-9 * np.eye(FEATURES + 1), total[:, -1]), np.zeros(1), np.zeros(1))

    def binned(batches):
        for batch in arrow_rows(batches, 5000):
            at = np.floor((np.clip(model.raw(_stats(batch)), -0.5, 1.5) + 0.5) / 2 * (BINS - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    bins = sorted(map(tuple, train.mapInArrow(binned, "bin bigint, y double").groupBy("bin").agg(F.count(F.lit(1)), F.sum("y")).collect()))
    at, count, positive = np.array(bins).T
    knots, values = isotonic((at + 0.5) / (BINS - 1) * 2 - 0.5, count, positive)
    return QualityModel(mean, scale, model.weights, knots, values)


def score_statistics(stats: DataFrame, model: QualityModel) -> DataFrame:
    kind = dict(stats.dtypes)["doc_id"]

    def run(batches):
        for batch in arrow_rows(batches, 5000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stats(batch, 1)))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")


def score_text(model: QualityModel, text: Column) -> Column:
    """Score of a text column, for filters on whole rows."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row.

    NULL and empty texts are scored by the statistics of an empty text; a NULL id is never labelled nor held out; repeated rows get
    the same score; labels without document, other columns and empty tables do no harm.  Only the text enters the score.
    """
    stats = stage(with_statistics(docs), "quality-stats")
    scored = score_statistics(stats, fit(stats, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
