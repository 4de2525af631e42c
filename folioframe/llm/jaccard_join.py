"""Operator 10: Jaccard self-join on 5-word shingles with adaptive multi-match prefixes.

Result: one row per document with its number of shingles, its component (the smallest
doc_id that links of similarity >= 0.8 reach) and its number of links. All links between
different sets are found; copies (equal sets) are one class, with its smallest doc_id as
representative.

1. One scan counts sets (size and 128-bit hash) and collects shingles that are frequent
   inside a task. Estimates for the most frequent ones overall go into a table of fixed
   size, which only guides the order of shingles: rare ones first, then by hash. Any order
   is exact, and so is the result whatever the table holds.
2. Prefixes: with overlap o = |A & B|, the first p shingles of A and the first q of B have
   at least o - max(|A| - p, |B| - q) in common, and similar sets an overlap of 4/9 of both
   sizes. The shortest prefix asks for one common shingle; each further shingle asks for
   one more. A document takes the length whose estimated cost is least: its records, the
   records they meet, and the texts to be compared, which fall with the number asked for.
3. Records meet by shingle in buckets. Groups up to GROUP members give pairs with their
   common shingles. Larger groups are cut into blocks; two blocks meet in a task, which
   counts the common shingles of large groups, in the first group a pair shares. Pairs
   that these alone admit leave the task as a spanning forest, open ones singly to be
   added up; the rest are dropped.
4. What is admitted forms candidate components. A component's texts meet in one tile, those
   of a large one in tiles of two blocks; there every pair with enough common prefix
   shingles is verified on the whole sets. A tile returns counts of links and a spanning
   forest, never its pairs.
5. Components by minimum labels with pointer jumping, each round written to shared storage.

Cases: null and empty texts have no shingles and link with nothing; texts under five words
are one shingle. Rows with one doc_id are one document if their texts are equal, and linked
by that id in any case. A null doc_id keeps its row, unlinked (component null). An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from . import _bytes as B

SIZE = 5
#: Similarity is at least PART / WHOLE.
PART, WHOLE = 80, 100
#: Bytes of text whose sets are looked at together; how often a shingle is frequent in a task, and overall.
FLUSH = 16 << 20
OFTEN_IN_TASK, OFTEN = 2, 8
#: Slots of the table of estimates, of which at most one in 8 is taken, by the most frequent shingles; longest prefixes ask for 1 + MORE.
SLOTS, MORE = 1 << 22, 7
#: Members of a group whose pairs are counted where they meet; members of a block of a larger group.
GROUP, BLOCK = 12, 2000
#: Bytes and documents of a tile; records and bytes that a task of the two shuffles should get.
TILE_BYTES, TILE_DOCS = 8 << 20, 2000
TASK_RECORDS, TASK_BYTES = 1 << 20, 32 << 20
SIGNATURE = 512
#: Bits of the map that keeps most texts without candidates out of the last shuffle.
ASKED_BITS = 1 << 23
RECORD = np.dtype([("h", "<u8"), ("set", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("m", "<i4")])
_STEP = [B.U64(pow(0xC2B2AE3D27D4EB4F, i, 1 << 64)) for i in range(SIZE)]


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), ordered by row and hash, each once."""
    s, e, row = B.words(data, bounds, B.WHITE)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, B.U64)
    w = B.word_hashes(data, s, e)
    n = len(w)
    words = np.bincount(row, minlength=len(bounds) - 1)
    at = np.arange(n) - (np.cumsum(words) - words)[row]
    left = words[row] - at  # words from here to the end of the text
    h = np.zeros(n, B.U64)
    for i in range(SIZE):
        part = np.zeros(n, B.U64)
        part[: max(n - i, 0)] = w[i:] * _STEP[i]
        h += np.where(left > i, part, B.U64(0))
    keep = (left >= SIZE) | (at == 0)
    h, row = B.mix(h[keep] + np.minimum(left[keep], SIZE).astype(B.U64)), row[keep]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
    return row[new], h[new]


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, bytes, size, two set hashes; row and hash of the shingles) of some rows at a time."""
    ids, (offsets, data) = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), B.columns(batch)
    for i, j in B.chunks(offsets):
        part = B.LOWER[data[offsets[i] : offsets[j]]]
        row, h = shingles(part, offsets[i : j + 1] - offsets[i])
        n = np.bincount(row, minlength=j - i)
        first = np.cumsum(n) - n
        sums = []
        for x in (B.mix(h), B.mix(h ^ B.U64(0x5851F42D4C957F2D))):
            c = np.concatenate([np.zeros(1, B.U64), np.cumsum(x, dtype=B.U64)])
            sums.append(c[first + n] - c[first])
        yield ids[i:j], np.diff(offsets[i : j + 1]), n, sums[0], sums[1], row, h


def _parities(row: np.ndarray, h: np.ndarray, n: int) -> pa.Array:
    """For each row SIGNATURE bits: whether an odd number of its shingles falls on each.

    Two such rows of bits differ in no more places than the sets have shingles apart.
    """
    odd = np.bincount(row * SIGNATURE + (h >> B.U64(40)).astype(np.int64) % SIGNATURE, minlength=n * SIGNATURE) & 1
    words = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, SIGNATURE // 64, dtype=np.int32)), pa.array(words))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: doc, size and hashes of a set, bytes of its text; kind 1: shingles that are frequent among the different sets of some text."""

    def out(kind, *cols, bits=None):
        bits = pa.nulls(len(cols[0]), pa.list_(pa.int64())) if bits is None else bits
        return pa.record_batch([pa.array(np.full(len(cols[0]), kind), pa.int32()), *(pa.array(c.astype(np.int64)) for c in cols), bits], ["kind", "a", "b", "c", "d", "e", "bits"])

    def frequent(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= OFTEN_IN_TASK
        zero = np.zeros(int(often.sum()), np.int64)
        return out(1, h[often], n[often], zero, zero, zero)

    held, size, seen = [], 0, set()
    for batch in batches:
        for doc, size_, n, x, y, row, h in _sets(batch):
            yield out(0, doc, n, x, y, size_, bits=_parities(row, h, len(doc)))
            keys = list(zip(x.tolist(), y.tolist(), strict=True))
            fresh = np.zeros(len(doc), bool)
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    fresh[i] = True
            held.append(h[fresh[row]])
            size += len(held[-1]) * 6
            if size >= FLUSH:
                yield frequent(held)
                held, size, seen = [], 0, set()
    if held:
        yield frequent(held)


def _ordered(row: np.ndarray, h: np.ndarray, n: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and shingles in the common order (estimate, hash), and the length and asked number of the prefix of each row."""
    level = table[(h & B.U64(SLOTS - 1)).astype(np.int64)]
    order = np.lexsort((h, level, row))
    row, h, level = row[order], h[order], level[order]
    others = np.concatenate([[0.0], np.cumsum(np.where(level > 0, np.exp2(level.astype(np.float64)), 0.0))])
    first = np.cumsum(n) - n
    least = n - (n * PART + WHOLE - 1) // WHOLE + 1
    best, length, asked = np.full(len(n), np.inf), np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    for m in range(1, MORE + 2):
        p = np.minimum(least + m - 1, n)
        met = others[first + p] - others[first]
        # a record has about the size of five words; met / m texts of n words at most share m shingles
        cost = np.where(least + m - 1 <= n, p + met * (1 + n / 5 / m), np.inf)
        better = cost < best
        best, length, asked = np.where(better, cost, best), np.where(better, p, length), np.where(better, m, asked)
    return row, h, length, asked


def _overlap(n_a, n_b):
    """The least overlap of similar sets of these sizes."""
    return -(-(n_a + n_b) * PART // (PART + WHOLE))


def _length(n, m):
    return n - (n * PART + WHOLE - 1) // WHOLE + m


def _need(n_a, m_a, n_b, m_b):
    """How many shingles the prefixes of similar sets have in common at least."""
    return np.maximum(np.minimum(m_a, m_b), _overlap(n_a, n_b) - np.maximum(n_a - _length(n_a, m_a), n_b - _length(n_b, m_b)))


def _prefixes(table: np.ndarray, n_buckets: int):
    """Packed records (shingle, set, doc, size, m) by bucket; equal sets of a task once, under their smallest doc."""

    def packed(held):
        r = np.concatenate(held)
        r = r[np.lexsort((r["doc"], r["set"], r["h"]))]
        r = r[np.append(True, (r["h"][1:] != r["h"][:-1]) | (r["set"][1:] != r["set"][:-1]))] if len(r) else r
        # prefixes are least hashes, crowded near 0: mixed again, so that buckets fill evenly
        bucket = ((B.mix(r["h"]) >> B.U64(32)) * B.U64(n_buckets) >> B.U64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        r, bucket = r[order], bucket[order]
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(r)]
        end = np.append(edge[1:], len(r))[: len(edge)]
        body = [np.ascontiguousarray(r[a:b]).view(np.uint8).reshape(b - a, -1).T.tobytes() for a, b in zip(edge, end, strict=True)]
        return pa.record_batch([pa.array(bucket[edge], pa.int32()), pa.array(body, pa.binary())], ["bucket", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, _, n, x, _, row, h in _sets(batch):
                row, h, length, m = _ordered(row, h, n, table)
                keep = np.arange(len(h)) - (np.cumsum(n) - n)[row] < length[row]
                rec = np.zeros(int(keep.sum()), RECORD)
                rec["h"], rec["set"], rec["doc"], rec["n"], rec["m"] = h[keep], x[row[keep]], doc[row[keep]], n[row[keep]], m[row[keep]]
                held.append(rec)
                size += rec.nbytes
                if size >= FLUSH:
                    yield packed(held)
                    held, size = [], 0
        if held and size:
            yield packed(held)

    return run


CANDIDATES = "a long, b long, common int, need int, token long, weight int, docs array<long>, needs array<int>"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of small groups with their common shingles; large groups as one row each. Rows come ordered by bucket."""

    def met(bodies):
        r = np.concatenate([np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(RECORD.itemsize, -1).T).reshape(-1).view(RECORD) for b in bodies])
        r = r[np.lexsort((r["doc"], r["set"], r["h"]))]
        r = r[np.append(True, (r["h"][1:] != r["h"][:-1]) | (r["set"][1:] != r["set"][:-1]))]
        edge = np.flatnonzero(np.append(True, r["h"][1:] != r["h"][:-1]))
        count = np.diff(np.append(edge, len(r)))
        pairs = []
        for k in range(2, GROUP + 1):
            at = edge[count == k]
            for i in range(k):
                for j in range(i + 1, k):
                    x, y = r[at + i], r[at + j]
                    fit = np.minimum(x["n"], y["n"]).astype(np.int64) * WHOLE >= np.maximum(x["n"], y["n"]).astype(np.int64) * PART
                    x, y = x[fit], y[fit]
                    need = _need(*(z[k].astype(np.int64) for z in (x, y) for k in ("n", "m")))
                    pairs.append(np.stack([np.minimum(x["doc"], y["doc"]), np.maximum(x["doc"], y["doc"]), need], 1))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        if len(pairs):
            pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
            new = np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(1))
            at = np.flatnonzero(new)
            common = np.diff(np.append(at, len(pairs)))
            pairs = pairs[at]
        else:
            common = np.zeros(0, np.int64)
        # groups of one bucket with the same members tell the same: one stands for them, with their number as weight
        alike: dict[tuple, list] = {}
        for e, c in zip(edge[count > GROUP], count[count > GROUP], strict=True):
            docs = r["doc"][e : e + c].tolist()
            alike.setdefault(tuple(docs), [docs, r["m"][e : e + c].tolist(), int(r["h"][e].astype(np.int64)), 0])[3] += 1
        large = list(alike.values())
        none, k = [None] * len(large), len(pairs)
        return pa.record_batch(
            [
                pa.array([*pairs[:, 0].tolist(), *none], pa.int64()),
                pa.array([*pairs[:, 1].tolist(), *none], pa.int64()),
                pa.array([*common.tolist(), *none], pa.int32()),
                pa.array([*pairs[:, 2].tolist(), *none], pa.int32()),
                pa.array([*[None] * k, *(x[2] for x in large)], pa.int64()),
                pa.array([*[None] * k, *(x[3] for x in large)], pa.int32()),
                pa.array([*[None] * k, *(x[0] for x in large)], pa.list_(pa.int64())),
                pa.array([*[None] * k, *(x[1] for x in large)], pa.list_(pa.int32())),
            ],
            ["a", "b", "common", "need", "token", "weight", "docs", "needs"],
        )

    now, held = None, []
    for batch in batches:
        for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and held:
                yield met(held)
                held = []
            now = bucket
            held.append(body)
    if held:
        yield met(held)


class _Forest:
    """Members of a cell that are connected, by labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Connects i with others; those of them that weren't connected with i, one of each tree."""
        labels, at = np.unique(self.label[others], return_index=True)
        new = labels != self.label[i]
        if not new.any():
            return others[:0]
        self.label[np.isin(self.label, labels)] = self.label[i]
        return others[at[new]]


def _crossed(g: int, crossing: bool, doc: np.ndarray, block: np.ndarray, n: np.ndarray, m: np.ndarray, bits: np.ndarray, owner: np.ndarray, tokens: np.ndarray) -> Iterator[np.ndarray]:
    """(a, b, common, need) of the pairs of two blocks of group g, or of one, whose first common large group is g; need 0: admitted.

    tokens are the large groups of the members, as often as they weigh, and owner their members.
    Of admitted pairs only a spanning forest is given.
    """
    order = np.argsort(n, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc, block, n, m, bits, owner = doc[order], block[order], n[order], m[order], bits[order], place[owner]
    singly = _length(n, m) - np.bincount(owner, minlength=len(doc))  # prefix shingles of small groups
    ids, at = np.unique(tokens, return_inverse=True)
    own, forest = None, _Forest(len(doc))
    for i in range(0, len(doc), 64):
        k = min(i + 64, len(doc))
        end = int(np.searchsorted(n, n[k - 1] * WHOLE // PART, "right"))
        apart = np.bitwise_count(bits[i:k, None, :] ^ bits[None, i:end, :]).sum(2, dtype=np.int64)
        x, y = n[i:k, None], n[None, i:end]
        fit = (apart * (WHOLE + PART) <= (x + y) * (WHOLE - PART)) & (x * WHOLE >= y * PART) & (np.arange(i, k)[:, None] < np.arange(i, end)[None, :])
        fit &= doc[i:k, None] != doc[None, i:end]
        if crossing:
            fit &= block[i:k, None] != block[None, i:end]
        p, q = np.nonzero(fit)
        if not len(p):
            continue
        if own is None:  # members by the groups that some two of them share
            count = np.zeros(len(ids), np.int64)
            np.add.at(count, np.unique(owner * len(ids) + at) % len(ids), 1)
            shared = np.flatnonzero(count > 1)
            column = np.full(len(ids), -1)
            column[shared] = np.arange(len(shared))
            keep = column[at] >= 0
            own = np.zeros((len(doc), len(shared)), np.float32)
            np.add.at(own, (owner[keep], column[at[keep]]), 1)
            has = (own > 0).astype(np.float32)
            before = int(np.searchsorted(ids[shared], g))
        first = (has[i:k, :before] @ has[i:end, :before].T)[p, q] == 0
        common = np.rint((has[i:k] @ own[i:end].T)[p, q]).astype(np.int64)[first]
        p, q = p[first] + i, q[first] + i
        need = _need(n[p], m[p], n[q], m[q])
        yes, maybe = common >= need, (common < need) & (common + np.minimum(singly[p], singly[q]) >= need)
        a, b, common, need = (np.concatenate([z[maybe], z[:0]]) for z in (p, q, common, need))
        for j in np.unique(p[yes]):
            new = forest.join(j, q[yes & (p == j)])
            if len(new):
                a, b = np.append(a, np.full(len(new), j)), np.append(b, new)
        zero = np.zeros(len(a) - len(need), np.int64)
        yield np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]), np.append(common, zero), np.append(need, zero)], 1)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of large groups; rows come ordered by (g, lo, hi)."""
    held: list[list[np.ndarray]] = []
    now = None

    def done():
        g, doc, block, n, m = (np.concatenate([h[k] for h in held]) for k in range(5))
        bits, size, tokens = (np.concatenate([h[k] for h in held]) for k in range(5, 8))
        for x in _crossed(int(g[0]), now[1] != now[2], doc, block, n, m, bits, np.repeat(np.arange(len(doc)), size), tokens):
            yield pa.record_batch([pa.array(x[:, k]) for k in range(4)], ["a", "b", "common", "need"])

    for batch in batches:
        col = [batch.column(k).to_numpy().astype(np.int64) for k in range(7)]  # g, lo, hi, doc, block, n, m
        bits = batch.column(7).flatten().to_numpy().view(B.U64).reshape(len(batch), SIGNATURE // 64)
        lists = batch.column(8)
        size, tokens = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(size)])
        new = np.append(True, (col[0][1:] != col[0][:-1]) | (col[1][1:] != col[1][:-1]) | (col[2][1:] != col[2][:-1]))
        edge = np.flatnonzero(new)[: len(batch)]
        for i, j in zip(edge, np.append(edge[1:], len(batch)), strict=True):
            key = (col[0][i], col[1][i], col[2][i])
            if key != now and held:
                yield from done()
                held.clear()
            now = key
            held.append([*(col[k][i:j] for k in (0, 3, 4, 5, 6)), bits[i:j], size[i:j], tokens[ends[i] : ends[j]]])
    if held:
        yield from done()


def _verified(crossing: bool, doc: np.ndarray, block: np.ndarray, sets: list[np.ndarray], length: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, count): a spanning forest of the links of a tile, and with b = a the number of links of each document."""
    n = np.array([len(x) for x in sets])
    order = np.argsort(n, kind="stable")
    doc, block, n, length, m, sets = doc[order], block[order], n[order], length[order], m[order], [sets[k] for k in order]
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    head = flat[np.arange(len(flat)) - np.repeat(at[:-1], n) < np.repeat(length, n)]
    head_at = np.concatenate([[0], np.cumsum(length)])
    mark = np.zeros(len(flat) + 1, np.int8)
    forest, tree, linked = _Forest(len(doc)), [], []
    for i in range(len(doc)):
        end = int(np.searchsorted(n, n[i] * WHOLE // PART, "right"))
        if end <= i + 1:
            continue
        mine = head[head_at[i] : head_at[i + 1]]
        mark[mine] = 1
        common = np.add.reduceat(mark[head[head_at[i + 1] : head_at[end]]], head_at[i + 1 : end] - head_at[i + 1], dtype=np.int64)
        mark[mine] = 0
        j = np.arange(i + 1, end)
        fit = (common >= _need(n[i], m[i], n[j], m[j])) & (doc[j] != doc[i])
        if crossing:
            fit &= block[j] != block[i]
        j = j[fit]
        if not len(j):
            continue
        mine = flat[at[i] : at[i + 1]]
        mark[mine] = 1
        common = np.add.reduceat(mark[np.concatenate([flat[at[k] : at[k + 1]] for k in j])], np.cumsum(n[j]) - n[j], dtype=np.int64)
        mark[mine] = 0
        j = j[common * WHOLE >= (n[i] + n[j] - common) * PART]
        if len(j):
            linked.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], 1))
            tree += [(doc[i], doc[k]) for k in forest.join(i, j)]
    pairs = np.concatenate(linked) if linked else np.zeros((0, 2), np.int64)
    if len(np.unique(doc)) < len(doc):
        pairs = np.unique(pairs, axis=0)
    ends, count = np.unique(pairs, return_counts=True)
    edges = np.array(tree, np.int64).reshape(-1, 2)
    return np.append(edges[:, 0], ends), np.append(edges[:, 1], ends), np.append(np.zeros(len(edges), np.int64), count)


def _compare(table: np.ndarray):
    """Links inside tiles; rows (label, lo, hi, doc, block, text) come ordered by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, held = None, set(), []

        def done():
            doc, block, sets, length, m = zip(*held, strict=True)
            return pa.record_batch([pa.array(c) for c in _verified(now[1] != now[2], np.array(doc), np.array(block), list(sets), np.array(length), np.array(m))], ["a", "b", "n"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            docs, blocks = (batch.column(k).to_pylist() for k in (3, 4))
            offsets, data = B.columns(batch)
            for i, j in B.chunks(offsets):
                row, h = shingles(B.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i])
                n = np.bincount(row, minlength=j - i)
                row, h, length, m = _ordered(row, h, n, table)
                at = np.concatenate([[0], np.cumsum(n)])
                for k in range(j - i):
                    if keys[i + k] != now:
                        if held:
                            yield done()
                        now, seen, held = keys[i + k], set(), []
                    own = h[at[k] : at[k + 1]]
                    if len(own) and (name := (docs[i + k], own.tobytes() if len(own) < 16 else (len(own), int(B.mix(own).sum(dtype=B.U64))))) not in seen:
                        seen.add(name)
                        held.append((docs[i + k], blocks[i + k], own.copy(), length[k], m[k]))
        if held:
            yield done()

    return run


def _tiles(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """doc, label, lo, hi, block, bytes: where the text of a document is compared; each pair of a component meets in one tile."""
    members = materialize(components(edges).withColumnRenamed("node", "doc").join(marks.select("doc", "bytes"), "doc"), "jaccard-members")
    size = members.groupBy("label").agg(F.sum("bytes").alias("total"), F.count(F.lit(1)).alias("c"))
    whole = (F.col("total") <= TILE_BYTES) & (F.col("c") <= TILE_DOCS)
    size = size.select("label", F.when(whole, 1).otherwise(F.greatest(F.ceil(F.col("total") * 2 / TILE_BYTES), F.ceil(F.col("c") * 2 / TILE_DOCS))).cast("long").alias("k"))
    rows = members.join(size, "label").withColumn("block", F.pmod(F.xxhash64("doc"), "k"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return materialize(rows.select("doc", "label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "bytes"), "jaccard-tiles")


def _asked(texts: DataFrame, tiles: DataFrame) -> DataFrame:
    """Texts whose documents may be in tiles, by a bit map of fixed size."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(ASKED_BITS))
    word, bit = F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = tiles.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))  # ASKED_BITS / 64 rows at most
    return texts.withColumn("word", word).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit) != 0).select("doc", "text")


def _links(edges: DataFrame, marks: DataFrame, texts: DataFrame, table: np.ndarray) -> DataFrame:
    """a, b, n: a spanning forest of the links, and with b = a numbers of links, to be added up."""
    spark = texts.sparkSession
    tiles = _tiles(edges, marks)
    rows = _asked(texts, tiles).join(tiles, "doc").select("label", "lo", "hi", "doc", "block", "text")
    parts = _tasks(spark, tiles.agg(F.sum("bytes")).first()[0], TASK_BYTES)
    rows = rows.repartition(parts, "label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")
    return materialize(rows.mapInArrow(_compare(table), "a long, b long, n long"), "jaccard-links")


def _edges(met: DataFrame, marks: DataFrame, n: int) -> DataFrame:
    """a, b: edges that connect all pairs with enough common prefix shingles."""
    groups = met.where("docs is not null").select(F.col("token").alias("g"), "weight", F.size("docs").alias("c"), F.explode(F.arrays_zip("docs", "needs")).alias("z"))
    groups = materialize(groups.select("g", "weight", "c", F.col("z.docs").alias("doc"), F.col("z.needs").alias("m")), "shingle-groups")
    own = groups.groupBy("doc").agg(F.flatten(F.collect_list(F.array_repeat("g", F.col("weight")))).alias("tokens"))
    known = groups.join(own.join(marks, "doc"), "doc")
    blocks = F.ceil(F.col("c") / BLOCK)
    known = known.withColumn("block", F.pmod(F.xxhash64("doc"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = known.select("g", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc", "block", "n", "m", "bits", "tokens")
    rows = rows.repartition(n, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    large = materialize(rows.mapInArrow(_cross, "a long, b long, common long, need long"), "jaccard-cells")
    small = met.where("a <> b").select("a", "b", F.col("common").cast("long").alias("common"), F.col("need").cast("long").alias("need"))
    counted = small.unionByName(large.where("need > 0")).groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("need").alias("need"))
    return materialize(counted.where("common >= need").select("a", "b").unionByName(large.where("need = 0").select("a", "b")), "jaccard-edges")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach, for every node with a link."""
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = materialize(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def _estimates(often: DataFrame) -> np.ndarray:
    """Rounded binary logarithms of the counts n of shingles a, for the most frequent ones that fit into one slot in 8."""
    often = often.select(F.col("a").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"), F.greatest(F.lit(1), F.round(F.log2("n"))).cast("int").alias("level"))
    room, lowest = SLOTS // 8, 64
    for level, n in sorted(((r.level, r["count"]) for r in often.groupBy("level").count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        lowest = level
    table = np.zeros(SLOTS, np.uint8)
    for r in often.where(F.col("level") >= lowest).groupBy("slot").agg(F.max("level").alias("level")).toArrow().to_batches():
        table[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return table


def _tasks(spark, total: int | None, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // each + 1)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: how many other classes the class of the document is linked with."""
    spark = docs.sparkSession
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    scan = materialize(texts.mapInArrow(_scan, "kind int, a long, b long, c long, d long, e long, bits array<long>"), "shingle-sets")
    sets = scan.where("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("n"), F.col("c").alias("x"), F.col("d").alias("y"))
    table = _estimates(scan.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= OFTEN))
    n = _tasks(spark, (sets.agg(F.sum("n")).first()[0] or 0) * (WHOLE - PART) // WHOLE, TASK_RECORDS)
    packed = texts.mapInArrow(_prefixes(table, 4 * n), "bucket int, body binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    met = materialize(packed.mapInArrow(_meet, CANDIDATES), "shingle-candidates")
    marks = scan.where("kind = 0").groupBy(F.col("a").alias("doc")).agg(F.first("b").alias("n"), F.sum("e").alias("bytes"), F.first("bits").alias("bits"))
    links = _links(_edges(met, marks, n), marks, texts, table)
    labels = components(links.where("a <> b").select("a", "b"))
    degree = links.where("a = b").groupBy("a").agg(F.sum("n").alias("n_links"))
    return _placed(docs, sets, labels, degree)


def _placed(docs: DataFrame, sets: DataFrame, labels: DataFrame, degree: DataFrame) -> DataFrame:
    classes = sets.where("n > 0").groupBy("n", "x", "y").agg(F.min("doc").alias("rep"))
    known = classes.join(labels, F.col("rep") == F.col("node"), "left").join(degree, F.col("rep") == F.col("a"), "left")
    known = known.select("n", "x", "y", F.least("rep", F.coalesce("label", "rep")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # written first, so that a join with very many copies of one set is a plain one that can be split
    out = sets.join(materialize(known, "jaccard-classes"), ["n", "x", "y"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    if "doc_id" in docs.columns:
        none = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
        out = out.unionByName(none)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns; rows without an id stay.

    Of rows that share the kept doc_id, with equal texts or not, one stays. Columns may have any names.
    """
    heads = join(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    number = "row"
    while number in {c.lower() for c in docs.columns}:
        number += "_"
    w = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    kept = docs.join(heads, "doc_id", "left_semi").withColumn(number, F.row_number().over(w)).where(F.col(number) == 1).drop(number)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where(F.col("doc_id").isNull()))
