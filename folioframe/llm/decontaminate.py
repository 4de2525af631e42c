"""Operator 2: benchmark decontamination with an FM-index per training shard.

Benchmark items are cut into windows of 13 words (an item of fewer words is one window).
The documents of a partition form shards of bounded size. For each shard an FM-index is
built over its word sequence: symbols are the benchmark's words, every other word ends a
run, and runs shorter than the shortest window are left out, because no window fits into
them. All windows are searched backwards at once through the ranks of a wavelet matrix,
occurrences are located by walking to sampled suffix positions, and the found spans are
merged per document.

The benchmark is a query set: it is read in blocks of ``block_items`` items or some
``BLOCK_BYTES`` characters, each of which goes to the tasks, so what a task gets is bounded
however large the benchmark is.

Cases: null and empty texts have no words and no hits. A null item text gives no window.
Windows that several items share count for each of them. Repeated document rows are
judged one by one, also with several blocks, where each row has a number. Empty tables
give empty results, an empty benchmark gives documents without hits. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from . import _bytes as B
from ._rows import kept

WINDOW = 13
#: Bytes of text per FM-index, and benchmark items and their bytes per pass.
SHARD_BYTES = 32 << 20
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 4 << 20
#: Every how many positions of a run a suffix position is kept.
SAMPLE_STEP = 8

SCHEMA = "doc_id long, n_words long, n_hit long, spans array<struct<first:long,last:long>>, items array<string>"


class FMIndex:
    """FM-index over ``seq``, a sequence of symbols >= 1 in runs, each ended by a 0."""

    def __init__(self, seq: np.ndarray, sigma: int):
        n = len(seq)
        self.n = n
        order = self._suffixes(seq)
        bwt = seq[order - 1]  # order 0 wraps to the last symbol, a 0
        self.first = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=sigma + 1), out=self.first[1:])
        self.bits = max(1, int(sigma).bit_length())
        self.ones, self.zeros, at = [], [], bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (at >> level) & 1
            ones = np.zeros(n + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[n]))
            at = np.concatenate([at[bit == 0], at[bit == 1]])
        begins = np.empty(n, bool)
        begins[0], begins[1:] = True, seq[:-1] == 0
        kept = begins | (np.arange(n) % SAMPLE_STEP == 0)
        self.sampled = kept[order]
        self.samples = np.where(self.sampled, order, -1)

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; each run's end differs from all others, so it stops within a run's length."""
        n, ends = len(seq), seq == 0
        rank = np.where(ends, np.cumsum(ends) - 1, seq + int(ends.sum()))
        k = 1
        while True:
            later = np.zeros(n, np.int64)
            later[: max(0, n - k)] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + later
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[1:] = np.cumsum(np.diff(key[order]) != 0)
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            k *= 2

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``at`` places of the BWT."""
        lo = np.zeros_like(at)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            up = ((symbols >> level) & 1) == 1
            at = np.where(up, zeros + ones[at], at - ones[at])
            lo = np.where(up, zeros + ones[lo], lo - ones[lo])
        return at - lo

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros_like(rows)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[rows + 1] - ones[rows]
            out = out * 2 + bit
            rows = np.where(bit == 1, zeros + ones[rows], rows - ones[rows])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of patterns of one length, one per row of ``patterns``."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, j]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows]
            out[open_[done]] = self.samples[rows[done]] + steps
            open_, rows = open_[~done], rows[~done]
            c = self.symbol(rows)
            rows = self.first[c] + self.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The windows of a block of items, as rows of symbols by window length."""

    def __init__(self, items: list[tuple[str, str | None]]):
        hashes = []
        for _, text in items:
            data = B.LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
            s, e, _ = B.words(data, np.array([0, len(data)]), B.ALNUM)
            hashes.append(B.word_hashes(data, s, e))
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, B.U64), *hashes]))
        sizes = np.array([min(WINDOW, len(h)) for h in hashes], np.int64)
        #: By length of window: distinct windows, and the names of their items in ``owners[ends[i] : ends[i + 1]]``.
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            cut = [sliding_window_view(np.searchsorted(self.vocabulary, hashes[k]).astype(np.int32) + 1, size) for k in own]
            owner = np.repeat(np.array([str(items[k][0]) for k in own], object), [len(c) for c in cut])
            patterns, which = np.unique(np.concatenate(cut), axis=0, return_inverse=True)
            order = np.argsort(which.reshape(-1), kind="stable")
            self.by_size[size] = patterns, owner[order], np.concatenate([[0], np.cumsum(np.bincount(which.reshape(-1)))])
        self.least = min(self.by_size, default=1 << 60)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class _Shard:
    """Word runs of some documents, then their hits."""

    def __init__(self, phrases: Phrases):
        self.p, self.ids, self.n_words, self.runs, self.bytes = phrases, [], [], [], 0

    def add(self, ids: list, offsets: np.ndarray, data: np.ndarray) -> None:
        for i, j in B.chunks(offsets):
            part = B.LOWER[data[offsets[i] : offsets[j]]]
            bounds = offsets[i : j + 1] - offsets[i]
            s, e, row = B.words(part, bounds, B.ALNUM)
            base = len(self.ids)
            self.ids += ids[i:j]
            count = np.bincount(row, minlength=j - i)
            self.n_words += count.tolist()
            self.bytes += len(part)
            if not len(s):
                continue
            sym = self.p.symbols(B.word_hashes(part, s, e))
            at = np.arange(len(s)) - (np.cumsum(count) - count)[row]  # number of the word in its document
            cut = np.ones(len(s) + 1, bool)
            cut[1:-1] = (row[1:] != row[:-1]) | (sym[1:] == 0) | (sym[:-1] == 0)
            edges = np.flatnonzero(cut)
            keep = (np.diff(edges) >= self.p.least) & (sym[edges[:-1]] > 0)
            for a, b in zip(edges[:-1][keep], edges[1:][keep], strict=True):
                self.runs.append((base + int(row[a]), int(at[a]), sym[a:b]))

    def hits(self) -> dict[int, tuple[list, set]]:
        """Per document number: (spans of words, items)."""
        if not self.runs:
            return {}
        sizes = np.array([len(r[2]) for r in self.runs])
        seq = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        for b, r in zip(begin, self.runs, strict=True):
            seq[b : b + len(r[2])] = r[2]
        index, out = FMIndex(seq, len(self.p.vocabulary)), {}
        for size, (patterns, owners, ends) in self.p.by_size.items():
            lo, hi = index.search(patterns)
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            n = (hi - lo)[found]
            rows = np.arange(int(n.sum())) + np.repeat(lo[found] - (np.cumsum(n) - n), n)
            at, which = index.locate(rows), np.repeat(found, n)
            run = np.searchsorted(begin, at, "right") - 1
            for r, a, w in zip(run.tolist(), at.tolist(), which.tolist(), strict=True):
                doc, word, _ = self.runs[r]
                first = word + a - int(begin[r])
                spans, items = out.setdefault(doc, ([], set()))
                spans.append((first, first + size))
                items.update(owners[ends[w] : ends[w + 1]].tolist())
        return out

    def rows(self) -> pa.RecordBatch:
        found = self.hits()
        n_hit, spans, items = [0] * len(self.ids), [[] for _ in self.ids], [[] for _ in self.ids]
        for doc, (raw, names) in found.items():
            spans[doc] = [{"first": a, "last": b} for a, b in merged(raw)]
            n_hit[doc], items[doc] = sum(s["last"] - s["first"] for s in spans[doc]), sorted(names)
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.record_batch(
            [pa.array(self.ids, pa.int64()), pa.array(self.n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
            ["doc_id", "n_words", "n_hit", "spans", "items"],
        )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _task(phrases: Phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(phrases)
        for batch in batches:
            ids, (offsets, data) = batch.column(0).to_pylist(), B.columns(batch)
            for i, j in B.chunks(offsets, SHARD_BYTES):
                shard.add(ids[i:j], offsets[i : j + 1], data)
                if shard.bytes >= SHARD_BYTES:
                    yield shard.rows()
                    shard = _Shard(phrases)
        if shard.ids:
            yield shard.rows()

    return run


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[str, str | None]]]:
    block, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        held += len(r.text or "")
        if len(block) >= size or held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each in a column of its own, written once so that the numbers stay."""
    key = "row"
    while key in map(str.lower, docs.columns):
        key = f"_{key}"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "decontamination-rows"), key


def _over_blocks(read: DataFrame, blocks: Iterable[list[tuple[str, str | None]]]) -> DataFrame:
    """Hits of rows (number, text) with all blocks, put together by the number, which stands as doc_id."""
    both = None
    for block in blocks:
        part = read.mapInArrow(_task(Phrases(block)), SCHEMA)
        both = part if both is None else both.unionByName(part)
    whole = both.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )

    def add(a, x):
        end = F.element_at(a, -1)
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))
        return F.when((F.size(a) > 0) & (x["first"] <= F.try_element_at(a, F.lit(-1))["last"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(longer))).otherwise(F.concat(a, F.array(x)))

    spans = F.aggregate("s", F.array().cast("array<struct<first:bigint,last:bigint>>"), add)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return whole.select("doc_id", "n_words", spans.alias("spans"), "items").select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _contaminated(found: DataFrame) -> DataFrame:
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of word numbers, merged), items (sorted), contaminated."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _blocks(benchmark, block_items)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _contaminated(read.mapInArrow(_task(Phrases(first)), SCHEMA))
    rows, key = _numbered(read)
    found = _over_blocks(rows.select(key, "text"), chain([first, second], blocks)).withColumnRenamed("doc_id", key)
    return _contaminated(found.join(rows.select(key, "doc_id"), key).select("doc_id", "n_words", "n_hit", "spans", "items"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents, with all columns, that aren't contaminated."""
    blocks = _blocks(benchmark, block_items)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:
        rows, key = _numbered(docs)
        bad = _contaminated(_over_blocks(rows.select(key, "text"), chain([first, second], blocks))).where("contaminated").select(F.col("doc_id").alias(key))
        return rows.join(bad, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    phrases = Phrases(first)

    def judged(shard: _Shard, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shard.hits()
        hit = [sum(b - a for a, b in merged(found[i][0])) if i in found else 0 for i in range(len(shard.ids))]
        keep = [not (h and 20 * h >= n) for h, n in zip(hit, shard.n_words, strict=True)]
        at = 0
        for part in held:
            yield part.filter(pa.array(keep[at : at + len(part)], pa.bool_()))
            at += len(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = _Shard(phrases), []
        for batch in batches:
            offsets, data = B.columns(batch)
            for i, j in B.chunks(offsets, SHARD_BYTES):
                shard.add([None] * (j - i), offsets[i : j + 1], data)
                held.append(batch.slice(i, j - i))
                if shard.bytes >= SHARD_BYTES:
                    yield from judged(shard, held)
                    shard, held = _Shard(phrases), []
        if held:
            yield from judged(shard, held)

    return kept(docs, run)
