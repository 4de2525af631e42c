"""Operator 3: quality classifier by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (see ``NAMES``). Class means and
covariances come from one Spark aggregation over all labelled rows outside the held-out
fold; covariances are shrunk towards the pooled one and towards a multiple of the unit
matrix. The score is the posterior of label 1 from the difference of the log densities,
whose Mahalanobis distances use Cholesky factors that are inverted once.

Cases: null and empty texts get the statistics of a text without words, and a score like
any other. With no labelled row of one class every score is 0.5. Repeated rows are scored
one by one; a label on several rows of a doc_id counts for each. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from . import _bytes as B

NAMES = (
    "log_words", "log_chars_per_word", "word_spread", "upper", "symbols", "exclaims", "stops",
    "other", "lines", "distinct", "repeats", "runs", "plain_ends",
)
#: Shares of the pooled and the unit matrix in a class covariance; how far log density differences count.
POOLED, UNIT, TEMPER = 0.15, 0.05, 0.5


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _class(*chars: int | range) -> np.ndarray:
    t = np.zeros(256, bool)
    for c in chars:
        t[list(c) if isinstance(c, range) else [c]] = True
    return t


_UPPER, _DIGIT = _class(range(65, 91)), _class(range(48, 58))
_SYMBOL, _EXCLAIM, _STOP = _class(*b"#*$%&|<>"), _class(*b"!?"), _class(*b".,;:")
_LETTER = _class(range(65, 91), range(97, 123), range(128, 256))


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n = len(bounds) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return (c[bounds[1:]] - c[bounds[:-1]]).astype(float)

    high = np.zeros(len(data), bool)  # capital letters of Latin-1 in UTF-8
    high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    s, e, row = B.words(data, bounds, B.WHITE)
    words = np.bincount(row, minlength=n).astype(float)
    size = (e - s).astype(float)
    chars = np.bincount(row, size, n)
    mean = chars / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(0, np.bincount(row, size * size, n) / np.maximum(words, 1) - mean * mean))
    h = B.word_hashes(data, s, e)

    def different(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, rows))
        k, r = keys[order], rows[order]
        new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]))[: len(k)]
        return np.bincount(r[new], minlength=n).astype(float)

    inner = row[2:] == row[:-2] if len(h) > 2 else np.zeros(0, bool)
    grams = (B.mix(h[:-2] * B.U64(3) + B.mix(h[1:-1] * B.U64(5) + h[2:])))[inner] if len(h) > 2 else h[:0]
    gram_row = row[2:][inner] if len(h) > 2 else row[:0]
    n_grams = np.bincount(gram_row, minlength=n).astype(float)
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1]) if len(h) > 1 else np.zeros(0, bool)
    plain = (_LETTER | _DIGIT)[data[e - 1]] if len(e) else np.zeros(0, bool)

    def share(part: np.ndarray, whole: np.ndarray, usual: float, weight: float = 20) -> np.ndarray:
        """Log of a share, drawn to its usual value in short texts."""
        return np.log((part + weight * usual) / (whole + weight))

    letters = per_row(_LETTER[data])
    out = [
        np.log1p(words),
        np.log((chars + 100) / (words + 20)),
        np.log((spread * words + 60) / (words + 20)),
        share(per_row(_UPPER[data] | high), letters, 0.03, 100),
        share(per_row(_SYMBOL[data]), chars, 0.002, 100),
        share(per_row(_EXCLAIM[data]), chars, 0.002, 100),
        share(per_row(_STOP[data]), words, 0.1),
        share(chars - letters - per_row(_DIGIT[data]), chars, 0.03, 100),
        share(per_row(data == 10), words, 0.03),
        share(different(h, row), words, 0.8),
        share(n_grams - different(grams, gram_row), n_grams, 0.01),
        share(np.bincount(row[1:][same], minlength=n).astype(float), words, 0.01) if len(h) > 1 else share(0 * words, words, 0.01),
        share(np.bincount(row, plain, n), words, 0.85),
    ]
    return np.stack(out, 1)


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = B.columns(batch)
        for i, j in B.chunks(offsets):
            x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            cells = pa.array(x.astype(np.float32).ravel())
            yield pa.record_batch([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), cells)], ["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_task, "doc_id long, x array<float>")


class Discriminant:
    """Two Gaussians with shrunk covariances."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """sums: per class the number of rows, the sum of vectors and the sum of their outer products."""
        self.parts = None
        if any(sums.get(k, (0,))[0] < 2 for k in (0, 1)):
            return
        n = sum(s[0] for s in sums.values())
        means = {k: s[1] / s[0] for k, s in sums.items()}
        covs = {k: s[2] / s[0] - np.outer(means[k], means[k]) for k, s in sums.items()}
        pooled = sum(s[0] / n * covs[k] for k, s in sums.items())
        scale = np.sqrt(np.diag(pooled) + 1e-9)  # the unit matrix in units of the pooled deviations
        self.parts = {}
        for k in (0, 1):
            cov = ((1 - POOLED - UNIT) * covs[k] + POOLED * pooled) / np.outer(scale, scale)
            cov += (UNIT * max(1e-6, np.trace(cov) / len(cov)) + 1e-6) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts[k] = (means[k], np.linalg.inv(factor) / scale, float(np.log(np.diag(factor)).sum()), float(np.log(sums[k][0] / n)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), 0.5)
        log = {}
        for k, (mean, root, log_det, prior) in self.parts.items():
            z = (x - mean) @ root.T
            log[k] = -0.5 * (z * z).sum(1) - log_det, prior
        diff = TEMPER * (log[1][0] - log[0][0]) + log[1][1] - log[0][1]
        return 1 / (1 + np.exp(-np.clip(diff, -60, 60)))


def fit(vectors: DataFrame, labels: DataFrame) -> Discriminant:
    """From all labelled rows outside the held-out fold; the driver gets two rows of sums."""
    d = len(NAMES)
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    rows = vectors.join(known.where(~held_out(F.col("doc_id"))), "doc_id").select("y", *(F.get("x", F.lit(i)).cast("double").alias(f"x{i}") for i in range(d)))
    first = [F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]
    second = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    sums = {}
    for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *first, *second).collect():
        outer = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
        sums[r.y] = (float(r.n), np.array([r[f"s{i}"] for i in range(d)]), outer)
    return Discriminant(sums)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    vectors = materialize(features(docs), "quality-features")
    model = fit(vectors, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(float).reshape(-1, len(NAMES))
            yield pa.record_batch([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    out = vectors.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
