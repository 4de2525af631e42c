"""Operator 9: toxicity by weak supervision.

1. Voters. Lexicon voters for kinds of abuse, a lexicon mined from a bounded sample of
   labelled rows outside the held-out fold (see ``mined_words``), pattern
   voters (address, density, repetition, shouting) and two voters for harmlessness. Each
   votes toxic, harmless or not at all.
2. Label model. Vote patterns are counted over all documents. A generative model with a
   tree of dependences between voters (largest conditional mutual information) is fitted
   to these counts by expectation maximisation: accuracies, correlations and the class
   share, without labels.
3. A linear classifier learns the model's posterior from text statistics on a bounded
   sample; its output is calibrated on the labelled sample.

Cases: null and empty texts have no votes but harmless ones, and a score. Without labels
the posterior itself calibrates. Repeated rows are scored one by one. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from . import _bytes as B
from ._rows import kept
from .quality import held_out
from .rules import let

#: Bounds of what is learnt from: labelled rows of each class, rows for the linear classifier, mined words.
FIT_ROWS, SAMPLE_ROWS, MINED = 4000, 20_000, 256
THRESHOLD = 0.3
#: Lengths of beginnings of words that are tried.
STEMS = (4, 5, 6, 7)
#: How many words of a text must begin so for the mark ``beginning*times``.
TIMES = (1, 2, 3)
#: Words of abuse by kind, and words of address.
LEXICON = {
    "intelligence": "idiot idiots idiotic stupid moron morons moronic imbecile dumb dumbass cretin halfwit dimwit brainless".split(),
    "worth": "worthless loser losers trash scum garbage filth vermin parasite scumbag lowlife".split(),
    "contempt": "pathetic disgusting clown clowns repulsive vile despicable ridiculous shameful disgrace".split(),
    "slurs": "bastard asshole bitch fuck fucking shit bullshit crap retard retarded freak pervert".split(),
}
ADDRESS = "you your youre are is am such a an the he she they these those what utter complete total".split()
VOTERS = (*LEXICON, "mined", "address", "dense", "repeated", "shouted", "clean", "sparse")
FEATURES = len(VOTERS) + 5


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = B.words(data, np.array([0, len(data)]), B.ALNUM)
    return B.word_hashes(data, s, e)


class _Words:
    """Code of each word: 1 + index of its kind in ``groups``, 0 for others."""

    def __init__(self, groups: list[list[str]]):
        h = np.concatenate([_hashes(g) for g in groups] or [np.zeros(0, B.U64)])
        kind = np.concatenate([np.full(len(g), i + 1) for i, g in enumerate(groups)] or [np.zeros(0, int)])
        self.h, at = np.unique(h, return_index=True)
        self.kind = kind[at]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.h, hashes), len(self.h) - 1)
        return np.where(self.h[at] == hashes, self.kind[at], 0)


def evidence(data: np.ndarray, bounds: np.ndarray, mined: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(votes, features) of the texts between ``bounds``; a vote is 1, -1 or 0."""
    n = len(bounds) - 1
    low = B.LOWER[data]
    s, e, row = B.words(low, bounds, B.ALNUM)
    h = B.word_hashes(low, s, e)
    k = len(LEXICON)
    kind = _Words([*LEXICON.values()]).of(h)
    is_mined = _Words([[w for w in mined if "*" not in w]]).of(h) > 0
    pre = B.prefix(low.astype(B.U64) + B.U64(1))
    for stem, times in (w.split("*") for w in mined if "*" in w):
        size = len(stem.encode())
        own = (_Words([[stem]]).of(B.span_hash(pre, s, np.minimum(s + size, e))) > 0) & (e - s > size)
        is_mined |= own & (np.bincount(row[own], minlength=n)[row] >= int(times))
    kind = np.where(is_mined & (kind == 0), k + 1, kind)
    address = _Words([ADDRESS]).of(h) > 0
    words = np.bincount(row, minlength=n)
    count = lambda flag: np.bincount(row[flag], minlength=n)
    abuse = kind > 0
    near = np.zeros(len(h), bool)
    for d in (1, 2):
        near[d:] |= abuse[d:] & address[:-d] & (row[d:] == row[:-d])
    upper = np.zeros(len(h), bool)
    if len(h):
        first = data[s]
        last = data[e - 1]
        after = data[np.minimum(e, len(data) - 1)]
        upper = abuse & (((first >= 65) & (first <= 90) & (last >= 65) & (last <= 90)) | ((after == 33) & (e < bounds[row + 1])))
    per_kind = [count(kind == i + 1) for i in range(k)]
    n_mined, n_abuse, n_near, n_loud = count(is_mined), count(abuse), count(near), count(upper)
    kinds = sum((c > 0).astype(int) for c in per_kind)
    rate = n_abuse / np.maximum(words, 1)
    votes = [*((c > 0).astype(int) for c in per_kind), (n_mined > 1).astype(int), (n_near > 0).astype(int), (rate > 0.004).astype(int), (n_abuse > 2).astype(int), (n_loud > 0).astype(int)]
    votes += [-(n_abuse == 0).astype(int), -((rate < 0.0005) | (n_abuse == 0)).astype(int)]
    x = [*(np.log1p(c) for c in per_kind), np.log1p(n_mined), np.log1p(n_near), np.log1p(n_abuse), np.log1p(n_loud), np.log1p(100 * rate), (n_abuse > 0).astype(float), (n_abuse > 1).astype(float)]
    x += [kinds.astype(float), (kinds > 1).astype(float), np.log1p(words) / 10, (n_mined > 0).astype(float), (n_mined > 1).astype(float)]
    return np.stack(votes, 1), np.stack(x[:FEATURES], 1)


def _task(mined: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = B.columns(batch)
            for i, j in B.chunks(offsets):
                votes, x = evidence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], mined)
                pattern = ((votes + 1) * 3 ** np.arange(votes.shape[1])).sum(1)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.astype(np.float32).ravel()))
                yield pa.record_batch([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(pattern), cells], ["doc_id", "pattern", "x"])

    return run


def labelled(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids of each class outside the held-out fold, chosen by hash."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    pick = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return pick(0).unionByName(pick(1))


def mined_words(docs: DataFrame, picked: DataFrame) -> list[str]:
    """At most MINED words, and beginnings of words (with a star and how often), that mark toxic texts.

    Candidates are frequent in toxic texts and rare in others; texts of the sample that are
    equal count once. Of these, one after the other is taken that explains most toxic texts
    without an earlier one, as long as it is mostly right on them: what merely goes along
    with abuse is not taken.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # at most 2 * FIT_ROWS ids
    words = F.filter(F.split(F.lower("text"), "[^0-9\\p{L}]+"), lambda w: w != "")
    stems = lambda w: F.array_compact(F.array(*(F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS)))
    often = lambda a, k: F.transform(F.filter(a, lambda x, i: (i >= k - 1) & (F.get(a, F.greatest(i - k + 1, F.lit(0))) == x)), lambda x: F.concat(x, F.lit(str(k))))
    ordered = own.dropDuplicates(["y", "text"]).select("y", words.alias("w")).select("y", "w", F.array_sort(F.flatten(F.transform("w", stems))).alias("s"))
    marks = let(F.col("s"), lambda a: F.array_distinct(F.concat(F.col("w"), *(often(a, k) for k in TIMES))))
    split = materialize(ordered.select("y", marks.alias("w")), "toxic-words")
    sizes = {r.y: r.n for r in split.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    counts = split.select("y", F.explode("w").alias("w")).groupBy("w").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good"))
    gain = F.col("bad") - F.col("good") * (3 * sizes[1] / sizes[0])
    found = [r.w for r in counts.where((F.col("bad") >= max(4, sizes[1] * 0.005)) & (gain > 0)).orderBy(F.desc(gain), "w").limit(MINED).collect()]
    if not found:
        return []
    # at most 2 * FIT_ROWS rows of at most MINED marks
    have = [(r.y, set(r.w)) for r in split.select("y", F.array_intersect("w", F.lit(found)).alias("w")).where(F.size("w") > 0).collect()]
    out: list[str] = []
    while True:
        tally = {1: Counter(), 0: Counter()}
        for y, w in have:
            tally[y].update(w)
        if not tally[1]:
            return out
        best = max(found, key=lambda w: (tally[1][w] - 3 * tally[0][w], len(w), w))
        if tally[1][best] < max(4, sizes[1] * 0.005) or tally[1][best] < 4 * tally[0][best] * max(1, sizes[1] / sizes[0]):
            return out
        out.append(best)
        have = [(y, w) for y, w in have if best not in w]


class LabelModel:
    """P(class) and P(vote | parent's vote, class) over a tree of voters."""

    def __init__(self, votes: np.ndarray, weight: np.ndarray, rounds: int = 30):
        self.m = votes.shape[1]
        self.parent: list[int | None] = [None] * self.m
        total = votes.sum(1)
        p = 1 / (1 + np.exp(-(total - 0.5) * 2.0))
        for r in range(rounds):
            if r in (0, 5):
                self.parent = self._tree(votes, weight, p)
            self._fit(votes, weight, p)
            p = self.posterior(votes)

    def _tree(self, votes, weight, p) -> list[int | None]:
        """Largest spanning tree by mutual information of two voters given the class."""
        info = np.zeros((self.m, self.m))
        for i in range(self.m):
            for j in range(i):
                for q in (weight * p, weight * (1 - p)):
                    joint = np.bincount((votes[:, i] + 1) * 3 + votes[:, j] + 1, q, 9).reshape(3, 3) + 1e-9
                    share = joint.sum() / max(weight.sum(), 1e-9)
                    joint /= joint.sum()
                    info[i, j] += share * (joint * np.log(joint / np.outer(joint.sum(1), joint.sum(0)))).sum()
        info += info.T
        parent: list[int | None] = [None] * self.m
        inside, outside = {0}, set(range(1, self.m))
        while outside:
            i, j = max(((i, j) for i in inside for j in outside), key=lambda x: info[x])
            parent[j] = i
            inside.add(j)
            outside.remove(j)
        return parent

    def _fit(self, votes, weight, p) -> None:
        self.prior = float(np.clip((weight * p).sum() / max(weight.sum(), 1e-9), 1e-3, 0.5))
        self.tables = []
        for j, par in enumerate(self.parent):
            key = (votes[:, par] + 1 if par is not None else 0) * 3 + votes[:, j] + 1
            t = [np.bincount(key, q, 9).reshape(3, 3) + 0.5 for q in (weight * (1 - p), weight * p)]
            self.tables.append([x / x.sum(1, keepdims=True) for x in t])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, par in enumerate(self.parent):
            key = votes[:, par] + 1 if par is not None else np.zeros(len(votes), int)
            for c in (0, 1):
                log[:, c] += np.log(self.tables[j][c][key, votes[:, j] + 1])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights, the last one constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


class Scorer:
    """Mined marks, linear weights and calibration; small enough to go with each task."""

    def __init__(self, mined: list[str], weights: np.ndarray, slope: float, shift: float):
        self.mined, self.weights, self.slope, self.shift = mined, weights, slope, shift

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _linear(x, self.weights) + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Scorer, DataFrame]:
    """The scorer, and the vote patterns and features of all documents."""
    picked = materialize(labelled(labels), "toxic-labels")
    mined = mined_words(docs, picked)
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_task(mined), "doc_id long, pattern long, x array<float>"), "toxic-votes")
    counts = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # voters answer together: a few hundred patterns
    if not counts:
        return Scorer(mined, np.zeros(FEATURES + 1), 1.0, 0.0), rows
    votes = np.array([[r.pattern // 3**j % 3 - 1 for j in range(len(VOTERS))] for r in counts])
    model = LabelModel(votes, np.array([float(r.n) for r in counts]))
    belief = dict(zip((r.pattern for r in counts), model.posterior(votes).tolist(), strict=True))
    part = min(1.0, SAMPLE_ROWS / sum(r.n for r in counts))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1
    sample = rows.where(draw).select("pattern", "x").take(2 * SAMPLE_ROWS)
    out = Scorer(mined, np.zeros(FEATURES + 1), 1.0, 0.0)
    if sample:
        out.weights = _logistic(np.array([r.x for r in sample]).reshape(-1, FEATURES), np.array([belief[r.pattern] for r in sample]), 1.0)
    known = rows.join(F.broadcast(picked), "doc_id").select("y", "x").collect()  # at most 2 * FIT_ROWS rows
    y = np.array([float(r.y) for r in known])
    if 0 < y.sum() < len(y):
        z = _linear(np.array([r.x for r in known]).reshape(-1, FEATURES), out.weights)[:, None]
        out.slope, out.shift = _logistic(z, y, 1e-3)
        learnt = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        share = {r.y: r.n for r in learnt.groupBy(F.col("toxic").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
        out.shift += np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum()))  # classes were sampled apart
    return out, rows


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scorer, rows = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().astype(float).reshape(-1, FEATURES)
            yield pa.record_batch([batch.column(0), pa.array(scorer.scores(x))], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all columns, whose score is below the threshold."""
    scorer, _ = fit(docs.select("doc_id", "text"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = B.columns(batch)
            for i, j in B.chunks(offsets):
                _, x = evidence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], scorer.mined)
                yield batch.slice(i, j - i).filter(pa.array(scorer.scores(x) < THRESHOLD))

    return kept(docs, run)
