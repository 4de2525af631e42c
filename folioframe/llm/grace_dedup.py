"""Operator 13: exact duplicates by Grace hashing.

Texts are equal when they are the same after each run of ``[\\x20\\x09-\\x0D]`` became one space.

1. A task normalises its texts and puts some megabytes of them at a time into an
   open-addressing table, which compares complete contents. Each class of a table leaves
   it as one record: hash, the row that leads the class (smallest doc_id), number of rows,
   text. So a text with any number of copies leaves a table once. Records are the spill
   files of level 0, written to the shared folder.
2. Records are partitioned by their hash into buckets, and each bucket goes through such a
   table. A bucket that doesn't fit puts its classes into the spill files of the next level,
   which are partitioned by other digits of the hash, until every bucket fits.
3. A text whose records alone would fill a bucket can't be divided by its hash. Its records
   are dealt to pieces by their numbers; the classes of the pieces go to the next level.
4. Rows learn their group by the number of their record: one small join for each level.

Cases: a null text counts as empty, and empty texts are equal. Rows without an id come after
all others; a group of such rows only has no keep_id, yet one of its rows stays. Of repeated
rows (same doc_id, equal texts) one stays. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from . import _bytes as B

#: Bytes of text in a table: when a task writes its records, and when a bucket is too full.
FLUSH, FULL = 16 << 20, 32 << 20
#: Bytes of records per shuffle partition; a partition has so many buckets.
TASK_BYTES, BUCKETS = 64 << 20, 8
#: Records of one hash that are too many for one piece, or bytes of them; with many records a HOT-th of all, so that at most 2 * HOT hashes are.
PIECE_ROWS, PIECE_BYTES, HOT = 1000, 32 << 20, 100_000

#: What leaves a table: members (rows of the input) of level 0; answers (record, its leader, and the group's result once it is final); records for the next level.
ROW = pa.schema(
    [("kind", pa.int32()), ("slot", pa.int64()), ("leader", pa.int64()), ("doc", pa.int64()), ("first", pa.bool_()), ("n", pa.int64()), ("h", pa.int64()), ("size", pa.int64()), ("sha", pa.binary()), ("text", pa.binary())]
)
ROWS = "kind int, slot long, leader long, doc long, first boolean, n long, h long, size long, sha binary, text binary"
MEMBER, ANSWER, RECORD = 0, 1, 2


def normalised(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts between ``bounds`` with one space for each run of white space, and their new bounds."""
    white = ~B.WHITE[data]
    again = np.zeros(len(data), bool)
    again[1:] = white[1:] & white[:-1]
    starts = bounds[:-1][bounds[:-1] < len(data)]
    again[starts] = False
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(~again)])
    return np.where(white, np.uint8(0x20), data)[~again], ends[bounds]


def owners(h: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each text the first one with the same content, by an open-addressing table with linear probing."""
    size = 1 << max(1, 2 * len(h) - 1).bit_length()  # at most half full
    slots = np.full(size, -1, np.int64)
    owner = np.full(len(h), -1, np.int64)
    at = (B.mix(h) & B.U64(size - 1)).astype(np.int64)
    live = np.arange(len(h))
    while len(live):
        place = at[live]
        free = slots[place] < 0
        slots[place[free][::-1]] = live[free][::-1]  # the earliest of those that come to an empty slot takes it
        holder = slots[place]
        same = (holder == live) | (h[holder] == h[live])
        for k in np.flatnonzero(same & (holder != live)).tolist():
            same[k] = texts[holder[k]] == texts[live[k]]
        owner[live[same]] = holder[same]
        live = live[~same]
        at[live] = (at[live] + 1) & (size - 1)
    return owner


class _Table:
    """Records gathered for one table: hash, number, leading row, rows, digest and text."""

    def __init__(self):
        self.columns: list[list[np.ndarray]] = [[], [], [], [], []]  # h, slot, doc, has an id, n
        self.sha: list[bytes] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def add(self, h, slot, doc, has, n, sha: list[bytes], texts: list[bytes]) -> None:
        for held, new in zip(self.columns, (h, slot, doc, has, n), strict=True):
            held.append(new)
        self.sha += sha
        self.texts += texts
        self.bytes += sum(map(len, texts))

    def classes(self) -> tuple[_Table, np.ndarray, np.ndarray]:
        """One record for each content, under its leader; all numbers, and their leaders' numbers."""
        h, slot, doc, has, n = (np.concatenate(c) for c in self.columns)
        owner = owners(h, self.texts)
        order = np.lexsort((slot, doc, ~has, owner))
        new = np.append(True, owner[order][1:] != owner[order][:-1])
        lead, group = order[new], np.cumsum(new) - 1
        leader = np.empty_like(slot)
        leader[order] = slot[lead][group]
        out = _Table()
        out.add(h[lead], slot[lead], doc[lead], has[lead], np.add.reduceat(n[order], np.flatnonzero(new)), [self.sha[k] for k in lead], [self.texts[k] for k in lead])
        return out, slot, leader


def _batch(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    cells = [pa.array(np.full(n, kind), pa.int32()), *(columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ROW if f.name != "kind")]
    return pa.record_batch(cells, schema=ROW)


def _ids(doc: np.ndarray, has: np.ndarray) -> pa.Array:
    return pa.array(doc, pa.int64(), mask=~has)


def _answers(slot: np.ndarray, leader: np.ndarray, table: _Table, final: np.ndarray) -> pa.RecordBatch:
    _, own, doc, has, n = (np.concatenate(c) for c in table.columns)
    order = np.argsort(own)
    at = order[np.searchsorted(own, leader, sorter=order)]
    done = final[at]
    sha = [table.sha[k] if ok else None for k, ok in zip(at.tolist(), done.tolist(), strict=True)]
    return _batch(ANSWER, slot=slot, leader=leader, doc=_ids(doc[at], has[at] & done), n=pa.array(n[at], pa.int64(), mask=~done), sha=sha)


def _records(table: _Table, keep: np.ndarray) -> pa.RecordBatch:
    h, slot, doc, has, n = (np.concatenate(c)[keep] for c in table.columns)
    texts = [table.texts[k] for k in keep]
    return _batch(RECORD, slot=slot, doc=_ids(doc, has), n=n, h=h.view(np.int64), size=[len(t) for t in texts], sha=[table.sha[k] for k in keep], text=texts)


def _first_level(flush: int):
    """Members and records of a task's rows; input: doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        table = _Table()

        def emptied():
            records, row, leader = table.classes()
            doc, has = (np.concatenate(table.columns[k]) for k in (2, 3))
            yield _batch(MEMBER, slot=leader, doc=_ids(doc, has), first=row == leader)
            keep = np.arange(len(records.texts))
            for i in range(0, len(keep), 250):
                yield _records(records, keep[i : i + 250])

        for batch in batches:
            ids, (offsets, data) = batch.column(0), B.columns(batch)
            has, doc = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in B.chunks(offsets):
                part, at = normalised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                whole, at = part.tobytes(), at.tolist()
                texts = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                sha = [hashlib.sha256(t).digest() for t in texts]
                h = np.frombuffer(b"".join(x[:8] for x in sha), B.U64)
                table.add(h, number + np.arange(j - i), doc[i:j], has[i:j], np.ones(j - i, np.int64), sha, texts)
                number += j - i
                if table.bytes >= flush or len(table.texts) >= flush >> 7:
                    yield from emptied()
                    table = _Table()
        if table.texts:
            yield from emptied()

    return run


def _settle(full: int):
    """Each bucket through a table; rows come ordered by bucket. Input: bucket, whether the hash is hot, slot, doc, n, h, sha, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, hot, over = None, _Table(), set(), False
        gone = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # records that left the table, and their leaders

        def compacted(last: bool):
            nonlocal table, over, gone
            table, slot, leader = table.classes()
            order = np.argsort(slot)
            moved = leader[order][np.searchsorted(slot[order], gone[1])] if len(gone[1]) else gone[1]
            gone = np.append(gone[0], slot[slot != leader]), np.append(moved, leader[slot != leader])
            over = over or not last and table.bytes > full // 2 and len(table.texts) > 1
            if last or over:
                h, left = (np.concatenate(table.columns[k]) for k in (0, 1))
                final = np.full(len(h), not over) & ~np.isin(h, np.array(sorted(hot), B.U64))
                yield _answers(np.append(gone[0], left), np.append(gone[1], left), table, final)
                keep = np.flatnonzero(~final)
                if len(keep):
                    yield _records(table, keep)
                table, gone = _Table(), (gone[0][:0], gone[1][:0])

        for batch in batches:
            bucket, warm, slot, n, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4, 5))
            has, doc = batch.column(3).is_valid().to_numpy(zero_copy_only=False), batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
            for i, j in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist(), strict=True):
                if bucket[i] != now:
                    if table.texts:
                        yield from compacted(True)
                    now, hot, over = bucket[i], set(), False
                for k in range(i, j, 256):
                    m = min(k + 256, j)
                    sha, texts = (batch.column(c).slice(k, m - k).to_pylist() for c in (6, 7))
                    table.add(h[k:m].view(B.U64), slot[k:m], doc[k:m], has[k:m], n[k:m], sha, texts)
                    hot.update(h[k:m][warm[k:m]].view(B.U64).tolist())
                    if table.bytes > full:
                        yield from compacted(False)
        if table.texts:
            yield from compacted(True)

    return run


def _levels(records: DataFrame) -> Iterator[DataFrame]:
    """The answers of one level after the other."""
    spark, level = records.sparkSession, 0
    while True:
        total, count = records.agg(F.sum("size"), F.count(F.lit(1))).first()
        if not count:
            return
        rows, size = max(PIECE_ROWS, count // HOT), max(PIECE_BYTES, total // HOT)
        hot = records.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("bytes")).where((F.col("c") > rows) | (F.col("bytes") > size) & (F.col("c") > 3))
        pieces = F.least(F.col("c") / 2, F.greatest(F.col("c") / rows, F.col("bytes") / size) + 1).cast("long")
        hot = materialize(hot.select("h", pieces.alias("pieces")), "grace-hot")  # at most 2 * HOT rows, by its thresholds
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)
        dealt = records.join(F.broadcast(hot), "h", "left").withColumn("piece", F.pmod(F.xxhash64("slot"), F.coalesce("pieces", F.lit(1))))
        bucket = F.pmod(F.xxhash64("h", "piece", F.lit(level)), F.lit(BUCKETS * n)).cast("int")
        dealt = dealt.select(bucket.alias("bucket"), F.col("pieces").isNotNull().alias("hot"), "slot", "doc", "n", "h", "sha", "text")
        out = materialize(dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(FULL), ROWS), f"grace-{level + 1}")
        yield out.where(F.col("kind") == ANSWER)
        records, level = out.where(F.col("kind") == RECORD), level + 1


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    first = materialize(rows.mapInArrow(_first_level(FLUSH), ROWS), "grace-0")
    out = first.where(F.col("kind") == MEMBER).select(F.col("doc").alias("doc_id"), "slot", F.col("slot").alias("leader"), "first", *(F.lit(None).cast(t).alias(c) for c, t in (("keep_id", "long"), ("group_size", "long"), ("sha", "binary"))))
    for answers in _levels(first.where(F.col("kind") == RECORD)):
        one = answers.select(F.col("slot").alias("asked"), F.col("leader").alias("above"), F.col("doc").alias("keep"), F.col("n").alias("all"), F.col("sha").alias("digest"))
        known = lambda old, new: F.when(F.col("sha").isNotNull(), F.col(old)).otherwise(F.col(new)).alias(old)
        out = out.join(one, F.col("leader") == F.col("asked"), "left")
        out = out.select("doc_id", "slot", F.coalesce("above", "leader").alias("leader"), "first", known("keep_id", "keep"), known("group_size", "all"), F.coalesce("sha", "digest").alias("sha"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("slot") == F.col("leader"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """doc_id of the rows that stay."""
    return groups(docs).where("kept").select("doc_id")
