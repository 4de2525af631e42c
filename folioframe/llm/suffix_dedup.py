"""Operator 1: repeated 100-byte windows by a depth-limited radix sort of suffixes.

A suffix matters through its first 100 bytes only, its window. The sort is
most-significant-digit first, and a group that has shrunk to one suffix is done:

1. First digit: a window's anchor, the 24-byte string in it with the smallest hash.
   Neighbouring windows mostly share their anchor, so a run of them travels as one record
   (anchor hash, hash of the run's bytes, document, start, count). Records are first
   combined inside a task, so that a passage with thousands of copies leaves each task
   once, and are then dealt into buckets by the digit.
2. A bucket groups its records by anchor. An anchor seen once is done. If all runs of an
   anchor have the same bytes, their windows are equal pairwise: all but the earliest are
   repeats. Only runs of an anchor that differ, the ends of repeated passages, go on.
3. Their bytes are fetched, and their windows are sorted through depth 100 by digits of
   8 bytes, dropping single suffixes after every pass. What is still grouped at depth 100
   is exactly the repeated windows; all but the earliest of a group are repeats.
   Anchors with very many differing runs are spread by the windows' own hashes instead.
4. The windows of each document are merged to byte spans and cut out.

Runs are compared by two independent 64-bit hashes, windows of step 3 byte by byte.

Cases: null text counts as empty. Texts under 100 bytes keep all bytes. Rows of one doc_id
with equal texts are one document that is given several times: they get the same spans.
Rows of one doc_id with unlike texts, and rows without one, are documents of their own, those
without an id before all others; among equal ids a fixed order by hash says which is earlier.
An empty table gives an empty result. Extra columns are kept by ``cut`` and ignored by
``digests``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from . import _bytes as B

DEPTH = 100
GRAM = 24
WIDTH = DEPTH - GRAM + 1
#: Longer texts are looked at in pieces of so many windows.
PIECE = 1 << 19
#: Bytes of text whose records are combined before they are dealt out; records of an anchor from which on windows are dealt out singly.
FLUSH = 8 << 20
HOT = 2000
#: Bytes of all texts per shuffle partition, at most; a partition is settled in four buckets.
TASK_BYTES = 64 << 20
_POS = B.U64((1 << 22) - 1)
NO_ID = -(1 << 63)

RECORD = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i2"), ("many", "<i2")])
SPAN = np.dtype([("start", "<i4"), ("n", "<i4")])
#: kind 0: packed records of a bucket; 1: repeated windows of a document; 2: runs of a document whose windows are still open
ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("body", pa.binary())])
ROWS = "bucket int, kind int, doc long, body binary"


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window runs of the texts between ``bounds``: (row, first window, count, anchor hash, bytes' hash)."""
    n = len(data)
    if n < DEPTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(B.U64), z.astype(B.U64)
    pre = B.prefix(data.astype(B.U64) + B.U64(1))
    _, down = B.powers(n + 1)
    value = B.mix((pre[GRAM:] - pre[:-GRAM]) * down[: n - GRAM + 1])
    least = (value & ~_POS) | np.arange(len(value), dtype=B.U64)
    width = 1
    while width * 2 <= WIDTH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WIDTH - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & _POS).astype(np.int64)
    outside = np.zeros(n + 1, np.int32)
    np.add.at(outside, np.maximum(bounds[1:] - DEPTH + 1, bounds[:-1]), 1)
    np.add.at(outside, bounds[1:], -1)
    valid = np.cumsum(outside)[: len(anchor)] == 0
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(anchor)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    row = np.searchsorted(bounds, first, "right") - 1
    return row, first - bounds[row], count, value[anchor[first]], B.span_hash(pre, first, first + count + DEPTH - 1)


def pieces(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their start in the text, bytes, bounds); pieces of one text overlap by a window less one byte."""
    for i, j in B.chunks(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if j > i + 1 or b - a <= PIECE + DEPTH:
            yield np.arange(i, j), np.zeros(j - i, np.int64), data[a:b], offsets[i : j + 1] - a
        else:
            for p in range(0, b - a - DEPTH + 1, PIECE):
                part = data[a + p : min(b, a + p + PIECE + DEPTH - 1)]
                yield np.array([i]), np.array([p]), part, np.array([0, len(part)])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(buckets, kinds, docs, bodies) -> pa.RecordBatch:
    return pa.record_batch([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(docs, pa.int64()), pa.array(bodies, pa.binary())], schema=ROW)


def _planes(records: np.ndarray) -> bytes:
    """Byte by byte, so that equal high bytes lie together and compress."""
    return records.view(np.uint8).reshape(len(records), -1).T.tobytes()


def _records(body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8).reshape(RECORD.itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(RECORD)


def _marks(records: np.ndarray, kind: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its windows."""
    if not len(records):
        return
    records = records[np.lexsort((records["start"], records["doc"]))]
    spans = np.empty(len(records), SPAN)
    spans["start"], spans["n"] = records["start"], records["n"]
    docs = records["doc"]
    edge = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    ends = np.append(edge[1:], len(records))
    bodies = [spans[a:b].tobytes() for a, b in zip(edge, ends, strict=True)]
    yield _rows(n_buckets + docs[edge] % n_buckets, np.full(len(edge), kind), docs[edge], bodies)


def _grouped(records: np.ndarray, with_bytes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records ordered by (h, g, doc, start); new h; new (h, g); later: starts after the first one of its (h, g)."""
    r = records[np.lexsort((records["start"], records["doc"], records["g"], records["h"]))]
    new_h = np.append(True, r["h"][1:] != r["h"][:-1])
    new_g = new_h | np.append(True, r["g"][1:] != r["g"][:-1])
    first = r[np.flatnonzero(new_g)][np.cumsum(new_g) - 1]
    return r, new_h, new_g, (r["doc"] != first["doc"]) | (r["start"] != first["start"])


def combine(records: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Settles what the records of one task settle among themselves, and packs the rest by bucket."""
    if not len(records):
        return
    r, new_h, new_g, later = _grouped(records)
    yield from _marks(r[later], 1, n_buckets)
    group = np.cumsum(new_h) - 1
    kinds = np.bincount(group, weights=new_g).astype(np.int64)[group]
    yield from _marks(r[new_g & (kinds > 1)], 2, n_buckets)
    out = r[new_h]
    out["many"] = np.minimum(kinds[new_h], 30_000)
    # anchors are least hashes, crowded near 0: mixed again, so that buckets fill evenly
    bucket = ((B.mix(out["h"]) >> B.U64(32)) * B.U64(n_buckets) >> B.U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    out, bucket = out[order], bucket[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(edges[1:], len(out))
    yield _rows(bucket[edges], np.zeros(len(edges)), np.zeros(len(edges)), [_planes(out[a:b]) for a, b in zip(edges, ends, strict=True)])


def settle(records: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The same over all tasks' records of a bucket."""
    r, new_h, new_g, later = _grouped(records)
    group = np.cumsum(new_h) - 1
    n, kinds, many = np.bincount(group)[group], np.bincount(group, weights=new_g)[group], np.bincount(group, weights=r["many"] > 1)[group]
    differ = (kinds > 1) | (many > 0)
    yield from _marks(r[(n > 1) & ~differ & later], 1, n_buckets)
    yield from _marks(r[differ & (r["many"] == 1)], 2, n_buckets)


def _first_digit(n_buckets: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, (offsets, data) = _ids(batch), B.columns(batch)
            for rows, at, part, bounds in pieces(offsets, data):
                row, start, count, h, g = runs(part, bounds)
                rec = np.zeros(len(row), RECORD)
                rec["h"], rec["g"], rec["doc"], rec["start"], rec["n"] = h, g, ids[rows[row]], start + at[row], count
                held.append(rec)
                size += len(part)
                if size >= flush:
                    yield from combine(np.concatenate(held), n_buckets)
                    held, size = [], 0
        if held:
            yield from combine(np.concatenate(held), n_buckets)

    return run


def _settle_buckets(n_buckets: int):
    """Rows come ordered by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, kind, body in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if kind:
                    continue
                if bucket != now and held:
                    yield from settle(np.concatenate(held), n_buckets)
                    held = []
                now = bucket
                held.append(_records(body))
            marks = batch.filter(pa.compute.greater(batch.column(1), 0))
            if len(marks):
                yield marks
        if held:
            yield from settle(np.concatenate(held), n_buckets)

    return run


def _dealt(rows: DataFrame, n: int, n_buckets: int) -> DataFrame:
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle_buckets(n_buckets), ROWS)


def _open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc, start, bytes) of the open runs; columns: doc, text, bodies."""
    for batch in batches:
        ids, (offsets, data) = _ids(batch), B.columns(batch)
        wanted = batch.column(2).to_pylist()
        for rows, at, part, bounds in pieces(offsets, data):
            row, start, count, h, _ = runs(part, bounds)
            open_ = [(k, np.unique(np.concatenate([np.frombuffer(x, SPAN)["start"] for x in wanted[r]]))) for k, r in enumerate(rows)]
            asked = np.concatenate([(s.astype(np.int64) - at[k]) + (k << 32) for k, s in open_])
            hit = np.flatnonzero(np.isin(start + (row << 32), asked))
            if len(hit):
                row, start, count, h = row[hit], start[hit], count[hit], h[hit]
                a = bounds[row] + start
                raw = [part[x:y].tobytes() for x, y in zip(a, a + count + DEPTH - 1, strict=True)]
                yield pa.record_batch([pa.array(h.astype(np.int64)), pa.array(ids[rows[row]]), pa.array((start + at[row]).astype(np.int32)), pa.array(raw, pa.binary())], ["h", "doc", "start", "run"])


def sort_windows(group: np.ndarray, at: np.ndarray, buf: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: (windows, class) of those equal to another one of their group through ``depth``.

    The order of the input is kept inside a class.
    """
    word = np.zeros(len(buf) + 8, B.U64)
    word[: len(buf)] = buf
    for k in (1, 2, 4):
        word[:-k] = (word[:-k] << B.U64(8 * k)) | word[k:]
        word[-k:] = word[-k:] << B.U64(8 * k)
    live, cls = np.arange(len(at)), group
    for d in range(0, depth, 8):
        digit = word[at[live] + d]
        if depth - d < 8:
            digit = digit >> B.U64(8 * (8 - depth + d))
        order = np.lexsort((digit, cls))
        cls, digit, live = cls[order], digit[order], live[order]
        new = np.append(True, (cls[1:] != cls[:-1]) | (digit[1:] != digit[:-1]))[: len(live)]
        single = new & np.append(new[1:], True)[: len(live)]
        cls = (np.cumsum(new) - 1)[~single]
        live = live[~single]
        if not len(live):
            break
    return live, cls


def _radix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows among the runs of each anchor; rows come ordered by (h, doc, start)."""

    def settled(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        h, docs, start = (part.column(k).to_numpy() for k in range(3))
        col = part.column(3).chunk(0)
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        buf = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        n = np.diff(off) - DEPTH + 1
        owner = np.repeat(np.arange(len(n)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        live, cls = sort_windows(h[owner], off[owner] + k, buf)
        if not len(live):
            return
        doc, at = docs[owner[live]], start[owner[live]].astype(np.int64) + k[live]
        order = np.lexsort((at, doc, cls))
        doc, at, cls = doc[order], at[order], cls[order]
        new = np.append(True, cls[1:] != cls[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[lead]) | (at != at[lead])
        rec = np.zeros(int(later.sum()), RECORD)
        rec["doc"], rec["start"], rec["n"] = doc[later], at[later], 1
        yield from _marks(_joined(rec), 1, 1)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= 4 << 20:
            whole = pa.Table.from_batches(held)
            h = whole.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if cut:
                yield from settled(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
    if held and sum(map(len, held)):
        yield from settled(pa.Table.from_batches(held))


def _joined(records: np.ndarray) -> np.ndarray:
    """Neighbouring windows as one span."""
    if not len(records):
        return records
    r = records[np.lexsort((records["start"], records["doc"]))]
    new = np.append(True, (r["doc"][1:] != r["doc"][:-1]) | (r["start"][1:] > r["start"][:-1] + 1))
    first = np.flatnonzero(new)
    out = r[first].copy()
    last = np.append(first[1:], len(r)) - 1
    wide = out.astype([(n, "<i8") if n == "n" else (n, RECORD[n]) for n in RECORD.names])
    wide["n"] = r["start"][last] - r["start"][first] + 1
    return wide


def _single_windows(n_buckets: int):
    """Each window of a run as a record of its own, by two hashes of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, start, held = batch.column(1).to_numpy(), batch.column(2).to_numpy(), []
            for doc, at, raw in zip(docs, start, batch.column(3).to_pylist(), strict=True):
                data = np.frombuffer(raw, np.uint8).astype(B.U64)
                k = np.arange(len(data) - DEPTH + 1)
                rec = np.zeros(len(k), RECORD)
                rec["h"] = B.span_hash(B.prefix(data + B.U64(1)), k, k + DEPTH)
                rec["g"] = B.span_hash(B.prefix(B.mix(data + B.U64(7))), k, k + DEPTH)
                rec["doc"], rec["start"], rec["n"] = doc, at + k, 1
                held.append(rec)
            if held:
                yield from combine(np.concatenate(held), n_buckets)

    return run


def _keyed(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows (doc, text, rest) with one doc for each text, and the bytes of all texts.

    Ids that stand for one text each stay as they are. Otherwise (ids that texts share, rows
    without one) all texts are numbered in the order of their ids.
    """
    mark = F.xxhash64("text", F.octet_length("text"))  # a number, so that texts aren't sorted for the aggregate
    ids = rows.groupBy("doc").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    total, shared = ids.agg(F.sum("bytes"), F.max(F.col("lo") != F.col("hi"))).first()
    if not shared:
        return rows, total or 0
    marked = rows.withColumn("mark", mark)
    order = marked.select("doc", "mark").distinct().repartitionByRange("doc", "mark").sortWithinPartitions("doc", "mark")
    numbers = materialize(order.withColumn("number", F.monotonically_increasing_id()), "suffix-numbers")
    return materialize(marked.join(numbers, ["doc", "mark"]).select(F.col("number").alias("doc"), "text", "rest"), "suffix-texts"), total


def repeats(texts: DataFrame, total: int) -> DataFrame:
    """doc, bodies: packed spans (start, number of windows) of the repeated windows of each doc that has any; ``total`` bytes in all texts."""
    spark = texts.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)
    n_buckets = 4 * n
    marks = materialize(_dealt(texts.mapInArrow(_first_digit(n_buckets, FLUSH), ROWS), n, n_buckets), "suffix-marks")
    by_doc = lambda kind: marks.where(F.col("kind") == kind).groupBy("doc").agg(F.collect_list("body").alias("bodies"))
    open_ = materialize(texts.join(by_doc(2), "doc").select("doc", "text", "bodies").mapInArrow(_open_runs, "h long, doc long, start int, run binary"), "suffix-runs")
    hot = materialize(open_.groupBy("h").count().where(F.col("count") >= HOT).select("h"), "suffix-hot")
    found = [marks]
    if hot.isEmpty():
        cold = open_
    else:
        cold = open_.join(hot, "h", "left_anti")
        single = open_.join(hot, "h", "left_semi").select("h", "doc", "start", "run")
        found.append(_dealt(single.mapInArrow(_single_windows(n_buckets), ROWS), n, n_buckets))
    found.append(cold.repartition(n, "h").sortWithinPartitions("h", "doc", "start").mapInArrow(_radix, ROWS))
    spans = found[0].where("kind = 1").select("doc", "body")
    for f in found[1:]:
        spans = spans.unionByName(f.where("kind = 1").select("doc", "body"))
    return spans.groupBy("doc").agg(F.collect_list("body").alias("bodies"))


def kept_bytes(data: np.ndarray, bodies: list[bytes] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the removed spans of bytes."""
    if not bodies:
        return data.tobytes(), []
    spans = np.concatenate([np.frombuffer(b, SPAN) for b in bodies])
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, spans["start"], 1)
    np.add.at(cover, spans["start"] + spans["n"] + DEPTH - 1, -1)
    gone = np.cumsum(cover)[: len(data)] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return data[~gone].tobytes(), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _cut(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (offsets, data), bodies = B.columns(batch), batch.column(2).to_pylist()
            rows = []
            for i, own in enumerate(bodies):
                part = data[offsets[i] : offsets[i + 1]]
                left, spans = kept_bytes(part, own)
                rows.append((len(part), len(part) - len(left), len(spans), left.decode("utf-8", "ignore") if as_text else hashlib.sha256(left).hexdigest()))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.record_batch([*cols, batch.column(3)], ["n_bytes", "n_removed", "n_spans", "kept", "rest"])

    return run


def _applied(docs: DataFrame, as_text: bool, rest) -> DataFrame:
    wide = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*rest).alias("rest"))
    wide, total = _keyed(wide)
    joined = wide.join(repeats(wide.select("doc", "text"), total), "doc", "left").select("doc", "text", "bodies", "rest")
    kind = joined.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(_cut(as_text), f"n_bytes long, n_removed long, n_spans long, kept string, rest {kind}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _applied(docs, False, ["doc_id"]).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def cut(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without repeated spans; a character cut in two goes whole."""
    plain = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)]
    done = _applied(docs.toDF(*plain), True, [c for c in plain if c != "text"])
    return done.select(*(F.col("kept").alias("text") if c == "text" else F.col(f"rest.{c}") for c in plain)).toDF(*docs.columns)
