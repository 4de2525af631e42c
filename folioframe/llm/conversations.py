"""Operator 12: repairs the structure of conversations by Hirschberg's divide and conquer.

A row of a conversation may be kept, given another role, deleted, or have empty rows inserted
before it, so that the roles read ``(system? (user assistant)+)?``. Four states say how far
that pattern has come: nothing yet, after system, after user, after assistant.

1. Rows are dealt out by ranges of (conversation, turn) and sorted, so that a conversation is
   a run of rows, and one with very many rows lies in several tasks.
2. A conversation that lies inside a task and has at most BLOCK rows is repaired there:
   forward and backward cost vectors over the states meet in the middle, the crossing with
   the least cost and then the least audit so far is taken, and both halves follow. Ranks of
   the states' audits are carried beside the costs, so that no audit is built twice. The
   space is linear, the vectors are looked up in a table of all that occur.
3. Longer ones, and those cut by a range, are cut into blocks. A block's effect is a matrix
   of four by four costs with ranks, so blocks are crossed by the same function as rows, and
   each block is then repaired by itself between its two states. Only matrices, audits and
   the pieces of the digest meet in one task, read in order and not held.

Cases: a null text, role or conv_id is one space, and so is a null turn in the damage; rows
without a turn come first, equal turns in the order of the first 32 characters of role and
text, then of the table. Repeated rows are duplicates. A conversation without rows after damage
has zeros and an empty audit. An empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize

#: Rows of a block, and bytes of text in it.
BLOCK, BLOCK_BYTES = 1024, 1 << 20
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLE = {"u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: From each state: what may come next.
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The end of a conversation, as a kind of row.
END = ("", False, False)

RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@lru_cache(maxsize=None)
def _inserts(state: int) -> tuple[tuple[int, int], ...]:
    """(state, number) that inserted rows lead to, without coming back."""
    out, now, n = [(state, 0)], state, 0
    for _ in range(2):
        now, n = NEXT[now]["u" if now != USER else "a"], n + 1
        if now not in [s for s, _ in out]:
            out.append((now, n))
    return tuple(out)


@lru_cache(maxsize=None)
def matrix(kind: tuple[str, bool, bool]) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """For a row (initial of the role, to be deleted, truncated), from each state to each: cost and edits, or None."""
    initial, gone, cut = kind
    out = []
    for start in range(4):
        best: list[tuple[int, str] | None] = [None] * 4

        def offer(state, cost, edits, best=best):
            if best[state] is None or (cost, edits) < best[state]:
                best[state] = (cost, edits)

        for state, n in _inserts(start):
            cost, edits = n * INSERT, "I" * n
            if kind == END:
                if state in (NOTHING, ASSISTANT):
                    offer(state, cost, edits)
                continue
            offer(state, cost + DELETE, edits + "D")
            if not gone:
                more = TRUNCATED * cut
                if initial in NEXT[state]:
                    offer(NEXT[state][initial], cost + KEEP + more, edits + "K")
                for role in ("u", "a"):
                    if role in NEXT[state]:
                        offer(NEXT[state][role], cost + REROLE + more, edits + "R")
        out.append(tuple(best))
    return tuple(out)


#: Costs and ranks of the least audits from each state to each: what rows and blocks have in common.
Step = tuple[tuple[tuple[int, int] | None, ...], ...]


@lru_cache(maxsize=None)
def row_step(kind: tuple[str, bool, bool]) -> Step:
    out = []
    for cells in matrix(kind):
        ranks = {e: i for i, e in enumerate(sorted(c[1] for c in cells if c))}
        out.append(tuple((c[0], ranks[c[1]]) if c else None for c in cells))
    return tuple(out)


#: A vector over the states: None where a state can't be, else (cost above the least, rank of its audit).
Vector = tuple[tuple[int, int] | None, ...]


@lru_cache(maxsize=1 << 16)
def _ahead(vector: Vector, step: Step) -> tuple[Vector, int]:
    best: list[tuple | None] = [None] * 4
    for p, here in enumerate(vector):
        if here is None:
            continue
        for q, cell in enumerate(step[p]):
            if cell:
                offer = (here[0] + cell[0], here[1], cell[1])
                if best[q] is None or offer < best[q]:
                    best[q] = offer
    # of two audits that come from one state the step's rank decides, else the states' ranks
    ranks = {k: i for i, k in enumerate(sorted({b[1:] for b in best if b}))}
    least = min((b[0] for b in best if b), default=0)
    return tuple((b[0] - least, ranks[b[1:]]) if b else None for b in best), least


@lru_cache(maxsize=1 << 16)
def _back(vector: tuple[int | None, ...], step: Step) -> tuple[int | None, ...]:
    out = []
    for p in range(4):
        costs = [cell[0] + vector[q] for q, cell in enumerate(step[p]) if cell and vector[q] is not None]
        out.append(min(costs, default=None))
    least = min((c for c in out if c is not None), default=0)
    return tuple(c if c is None else c - least for c in out)


def _pruned(vector: Vector) -> Vector:
    """Without states that no least path goes through: after assistant all that is open after system, and but for a system row (worth a deletion at most) after nothing, is open, too."""
    last = vector[ASSISTANT]
    if last is None:
        return vector
    worse = lambda c, by: c is not None and c[0] > last[0] + by
    return (None if worse(vector[NOTHING], DELETE) else vector[NOTHING], None if worse(vector[SYSTEM], 0) else vector[SYSTEM], vector[USER], last)


def crossings(steps: list[Step], start: int, end: int) -> list[int]:
    """The state after each step on the least path, with the least audit of these, from start to end."""
    states = [0] * len(steps)
    todo = [(0, len(steps), start, end)]
    while todo:
        lo, hi, p, q = todo.pop()
        if hi - lo == 1:
            states[lo] = q
            continue
        mid = (lo + hi) // 2
        ahead: Vector = tuple((0, 0) if s == p else None for s in range(4))
        for k in range(lo, mid):
            ahead = _pruned(_ahead(ahead, steps[k])[0])
        back: tuple[int | None, ...] = tuple(0 if s == q else None for s in range(4))
        for k in range(hi - 1, mid - 1, -1):
            back = _back(back, steps[k])
        _, _, meet = min((a[0] + b, a[1], s) for s, (a, b) in enumerate(zip(ahead, back, strict=True)) if a is not None and b is not None)
        todo += [(lo, mid, p, meet), (mid, hi, meet, q)]
    return states


def closed(steps: list[Step]) -> list[int]:
    """The states after each step and the end of the conversation."""
    steps = [*steps, row_step(END)]
    ahead: Vector = ((0, 0), None, None, None)
    for s in steps:
        ahead = _pruned(_ahead(ahead, s)[0])
    end = min((c[0], c[1], s) for s, c in enumerate(ahead) if c)[2]
    return crossings(steps, NOTHING, end)


def joined(steps: list[Step]) -> Step:
    """Many steps as one."""
    out = []
    for p in range(4):
        vector: Vector = tuple((0, 0) if s == p else None for s in range(4))
        total = 0
        for s in steps:
            vector, more = _ahead(_pruned(vector), s)
            total += more
        out.append(tuple((c[0] + total, c[1]) if c else None for c in vector))
    return tuple(out)


def repaired(rows: list[tuple[str, str]], kinds: list[tuple], start: int, states: list[int]) -> tuple[str, int, list[str]]:
    """Audit, cost and ``role:text`` of the rows that are left, between the states."""
    audit, cost, left, now = [], 0, [], start
    for (role, text), kind, after in zip(rows, kinds, states, strict=True):
        price, edits = matrix(kind)[now][after]
        cost += price
        audit.append(edits)
        for e in edits:
            if e == "K":
                now = NEXT[now][kind[0]]
                left.append(f"{role}:{text}")
            elif e != "D":
                now = USER if now != USER else ASSISTANT
                left.append(f"{NAMES[now]}:{text if e == 'R' else ''}")
    return "".join(audit), cost, left


class Counts:
    """Figures of consecutive rows of a conversation, which add up with those of the next ones."""

    def __init__(self):
        self.turns: list[int] | None = None  # first, last, number of different ones
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initials: tuple[str, str] | None = None

    def add(self, turn: int | None, fault: int, initial: str) -> None:
        if turn is not None:
            self.turns = [turn, turn, 1] if self.turns is None else [self.turns[0], turn, self.turns[2] + (turn != self.turns[1])]
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        if self.initials is not None:
            self.illegal += self.initials[1] + initial not in ("su", "ua", "au")
        self.initials = (self.initials[0] if self.initials else initial, initial)

    def follow(self, other: Counts) -> None:
        if other.turns is not None:
            self.turns = other.turns if self.turns is None else [self.turns[0], other.turns[1], self.turns[2] + other.turns[2] - (self.turns[1] == other.turns[0])]
        self.blank, self.duplicate, self.truncated = self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated
        self.illegal += other.illegal
        if self.initials and other.initials:
            self.illegal += self.initials[1] + other.initials[0] not in ("su", "ua", "au")
        if other.initials:
            self.initials = (self.initials[0] if self.initials else other.initials[0], other.initials[1])

    @property
    def gaps(self) -> int:
        return self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0


def _kind(role: str, fault: int) -> tuple[str, bool, bool]:
    initial = role[:1]
    return (initial if initial in ("s", "u", "a") else "?", fault in (1, 2), fault == 3)


def repair(rows: list[tuple[int | None, str, str, int]]) -> tuple:
    """The figures of a whole conversation; rows are (turn, role, text, 1 blank or 3 truncated or 0), in order."""
    counts, seen, kinds = Counts(), set(), []
    for turn, role, text, fault in rows:
        if (role, text) in seen and fault != 1:
            fault = 2
        seen.add((role, text))
        counts.add(turn, fault, role[:1])
        kinds.append(_kind(role, fault))
    states = closed([row_step(k) for k in kinds])
    audit, cost, left = repaired([*(r[1:3] for r in rows), ("", "")], [*kinds, END], NOTHING, states)
    return counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage of the contract; a row that is dropped has no place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    how = F.crc32(key.cast("binary")) % 20
    new = F.when(how == 1, F.lit("")).when(how == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(how == 4, F.lit("user")).otherwise(role).alias("role"), new.alias("text"), how.alias("how"))
    times = F.when(F.col("how") == 0, F.array(F.lit(None).cast("int"))).when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.withColumn("place", F.explode(times)).drop("how")


def _fault() -> Column:
    """1 blank, 3 truncated."""
    tail = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return F.when(tail == "", 1).when(tail.isin(".", "!", "?"), 0).otherwise(3).cast("int")


def _runs(kind: pa.DataType):
    """Results of conversations that lie inside the task (kind 0); the rows of others, in blocks (kind 1). Rows come sorted."""
    schema = pa.schema(
        [("kind", pa.int32()), ("conv_id", kind), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
        + [("part", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        size, blocks = 0, 0
        now, held, long_, first = None, [], False, True

        def whole(conv, rows):
            return (0, conv, *repair([r for r in rows if r[1] is not None]), *[None] * 7)

        def opened(conv, rows):
            """A block of a conversation that isn't whole here."""
            nonlocal blocks
            blocks += 1
            return [(1, conv, *[None] * 8, part, blocks, k, *r) for k, r in enumerate(rows)]

        def batch():
            nonlocal out, size
            columns = list(zip(*out, strict=True))
            out, size = [], 0
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        held_bytes = 0
        for rows in batches:
            convs, turns, roles, texts, places, faults = (rows.column(k).to_pylist() for k in range(6))
            for conv, turn, role, text, place, fault in zip(convs, turns, roles, texts, places, faults, strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        out += opened(now[0], held) if first or long_ else [whole(now[0], held)]
                        first = False
                    now, held, held_bytes, long_ = (conv,), [], 0, False
                held.append((turn, role, text, fault) if place is not None else (None, None, None, None))
                held_bytes += len(text)
                size += len(text) + 64
                if len(held) >= BLOCK or held_bytes >= BLOCK_BYTES:
                    out += opened(conv, held)
                    held, held_bytes, long_ = [], 0, True
                if size >= 4 << 20 and out:
                    yield batch()
        if now is not None:
            out += opened(now[0], held)  # the next task may go on with it
        if out:
            yield batch()

    return run, schema


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The step and the counts of each block; rows come ordered by block."""
    for key, rows in _blocks(batches):
        counts, kinds = Counts(), []
        for turn, role, fault in zip(*(rows[c] for c in ("turn", "role", "fault")), strict=True):
            if role is not None:
                counts.add(turn, fault, role[:1])
                kinds.append(_kind(role, fault))
        step = joined([row_step(k) for k in kinds])
        cells = [v for line in step for c in line for v in (c or (-1, -1))]
        turns = counts.turns or [None] * 3
        yield pa.record_batch(
            [
                pa.array([key[0]], pa.int64()),
                pa.array([key[1]], pa.int64()),
                *(pa.array([v], pa.int64()) for v in (*turns, counts.blank, counts.duplicate, counts.truncated, counts.illegal)),
                *(pa.array([v], pa.string()) for v in (counts.initials or (None, None))),
                pa.array([cells], pa.list_(pa.int64())),
            ],
            ["part", "block", "first", "last", "n_turns", "blank", "duplicate", "truncated", "illegal", "head", "tail", "cells"],
        )


MATRICES = "part long, block long, first long, last long, n_turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, cells array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict[str, list]]]:
    """Rows of each (part, block), in order."""
    now, held = None, None
    for batch in batches:
        columns = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
        for k, key in enumerate(zip(columns["part"], columns["block"], strict=True)):
            if key != now:
                if held is not None:
                    yield now, held
                now, held = key, {n: [] for n in columns}
            for n, c in columns.items():
                held[n].append(c[k])
    if held is not None:
        yield now, held


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states between the blocks of each conversation, and its counts; rows come ordered by conversation, part and block."""

    def done(key, rows):
        counts, steps = Counts(), []
        for r in rows:
            one = Counts()
            one.turns = [r["first"], r["last"], r["n_turns"]] if r["first"] is not None else None
            one.blank, one.duplicate, one.truncated, one.illegal = r["blank"], r["duplicate"], r["truncated"], r["illegal"]
            one.initials = (r["head"], r["tail"]) if r["head"] is not None else None
            counts.follow(one)
            c = r["cells"]
            steps.append(tuple(tuple((c[8 * p + 2 * q], c[8 * p + 2 * q + 1]) if c[8 * p + 2 * q] >= 0 else None for q in range(4)) for p in range(4)))
        states = [NOTHING, *closed(steps)]
        n = len(rows)
        figures = (counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal)
        last = [k == n - 1 for k in range(n)]
        return pa.record_batch(
            [
                *(pa.array([r[c] for r in rows], pa.int64()) for c in ("part", "block")),
                pa.array(states[:n], pa.int64()),
                pa.array(states[1 : n + 1], pa.int64()),
                pa.array([states[-1] if x else -1 for x in last], pa.int64()),
                *(pa.array([f] * n, pa.int64()) for f in figures),
            ],
            ["part", "block", "before", "after", "end", "gaps", "blank", "duplicate", "truncated", "illegal"],
        )

    now, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["conv"] != now and held:
                yield done(now, held)
                held = []
            now = r["conv"]
            held.append(r)
    if held:
        yield done(now, held)


WALK = "part long, block long, before long, after long, end long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost and the repaired rows of each block."""
    for key, rows in _blocks(batches):
        own = [(t, r, x, f) for t, r, x, f in zip(rows["turn"], rows["role"], rows["text"], rows["fault"], strict=True) if r is not None]
        kinds, before, after, end = [_kind(r, f) for _, r, _, f in own], rows["before"][0], rows["after"][0], rows["end"][0]
        states = crossings([row_step(k) for k in kinds], before, after) if kinds else []
        pairs = [(r, x) for _, r, x, _ in own]
        if end >= 0:
            pairs, kinds, states = [*pairs, ("", "")], [*kinds, END], [*states, end]
        audit, cost, left = repaired(pairs, kinds, before, states)
        yield pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([cost], pa.int64()), pa.array([audit]), pa.array(["\n".join(left)]), pa.array([len(left)], pa.int64())], ["part", "block", "cost", "audit", "body", "n_left"])


REPAIRS = "part long, block long, cost long, audit string, body string, n_left long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost and digest of each conversation; rows come ordered by conversation, part and block."""
    now, digest, audit, cost, some = None, hashlib.sha256(), [], 0, False

    def done():
        return pa.record_batch([pa.array([now], pa.string()), pa.array([cost], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv", "cost", "audit", "repaired_sha256"])

    for batch in batches:
        for r in batch.to_pylist():
            if r["conv"] != now:
                if now is not None:
                    yield done()
                now, digest, audit, cost, some = r["conv"], hashlib.sha256(), [], 0, False
            audit.append(r["audit"])
            cost += r["cost"]
            if r["n_left"]:
                digest.update((b"\n" if some else b"") + r["body"].encode())
                some = True
    if now is not None:
        yield done()


def _long(open_: DataFrame, kind: str) -> DataFrame:
    """The results of conversations in several blocks; the order of blocks is (part, block)."""
    spark = open_.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one number for each conversation, null included; '' comes first, so that null differs from any id
    name = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("i"), F.col("conv_id").cast("string")))
    rows = open_.withColumn("conv", name)
    place = F.struct("part", "block", "at")
    real = rows.where("role is not null")
    # earlier in the conversation: only the first of a text in each block asks the other blocks
    text = F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256)
    firsts = real.groupBy("conv", "part", "block", text.alias("key")).agg(F.min("at").alias("at"))
    w = Window.partitionBy("conv", "key").orderBy("part", "block")
    firsts = firsts.withColumn("new", F.row_number().over(w) == 1).where("new").select("part", "block", "at", "new")
    rows = rows.join(firsts, ["part", "block", "at"], "left")
    fault = F.when((F.col("fault") != 1) & F.col("new").isNull() & F.col("role").isNotNull(), 2).otherwise(F.col("fault"))
    rows = materialize(rows.select("conv", "conv_id", "part", "block", "at", "turn", "role", "text", fault.alias("fault")), "conversation-rows")
    blocks = rows.select("part", "block", "at", "turn", "role", "fault").repartition(n, "part", "block").sortWithinPartitions("part", "block", "at")
    steps = blocks.mapInArrow(_matrices, MATRICES)
    convs = rows.groupBy("part", "block").agg(F.first("conv").alias("conv"))
    steps = steps.join(convs, ["part", "block"]).repartition(n, "conv").sortWithinPartitions("conv", "part", "block")
    walk = materialize(steps.mapInArrow(_walk, WALK), "conversation-walk")
    dealt = rows.select("part", "block", "at", "turn", "role", "text", "fault").join(walk.select("part", "block", "before", "after", "end"), ["part", "block"])
    dealt = dealt.repartition(n, "part", "block").sortWithinPartitions("part", "block", "at")
    pieces = dealt.mapInArrow(_repairs, REPAIRS).join(convs, ["part", "block"]).repartition(n, "conv").sortWithinPartitions("conv", "part", "block")
    digests = pieces.select("conv", "cost", "audit", "body", "n_left").mapInArrow(_digests, "conv string, cost long, audit string, repaired_sha256 string")
    ends = walk.where("end >= 0").join(convs, ["part", "block"]).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal")
    ids = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    return ids.join(ends, "conv").join(digests, "conv").select(*(f.split()[0] for f in RESULT.split(", ")))


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of (conv_id, turn, role, text), as it is."""
    return _repaired(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(0).alias("place")))


def damaged_repairs(rows: DataFrame) -> DataFrame:
    """The same after the damage of the contract."""
    return _repaired(damaged(rows))


def _repaired(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # beginnings only, as the sample of the ranges goes to the driver; the number also cuts very many rows that are alike
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 32), "number"]
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).select("conv_id", "turn", "role", "text", "place", _fault().alias("fault"))
    kind = dealt.schema["conv_id"].dataType.simpleString()
    run, schema = _runs(pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string())
    out = materialize(dealt.mapInArrow(run, f"kind int, {RESULT.format(kind)}, part long, block long, at int, turn long, role string, text string, fault int"), "conversations")
    short = out.where("kind = 0").select(*(f.split()[0] for f in RESULT.split(", ")))
    return short.unionByName(_long(out.where("kind = 1"), kind))
