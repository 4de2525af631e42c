"""Operator 11: phrases of two to four words that stand together more often than their parts.

1. Words are counted for each language, tasks adding up their own first. What is frequent
   marks a bit map of fixed size, and the words with the most occurrences are hot.
2. A suffix is the up to four words from a word to the end of its piece; it ends before a
   word that the bit map shows to be rare, as no frequent phrase goes on there. Tasks send
   each different suffix of some megabytes of text once, with its number.
3. Suffixes are routed by their leading words: by all hot ones and the first that isn't hot.
   So no bucket gets more than one word's share, and all occurrences of a phrase with a word
   that isn't hot meet in one bucket.
4. A bucket sorts pointers to its suffixes by multikey three-way quicksort, through depth
   four. Suffixes equal at the pivot are a phrase, their numbers add up to its count, and
   only they go one word deeper. Partitions with fewer than LEAST occurrences are abandoned.
   Phrases of hot words only are spread over buckets, and their parts are added up.
5. What lies inside longer candidates goes by a join of the frequent phrases.
6. The words known to be common carry a level, a lower bound of their number. A phrase's
   first and last word so bound its score from above. The best phrases by bound are scored
   first; the TOP-th score among them is one that every other phrase of the language must
   reach by its bound to be scored at all. No phrase of the result can be missed.

Within a task words are told apart by 64-bit hashes, between tasks by themselves.

Cases: a null text counts as empty, a null lang as ``und``. Texts of any length are read in
pieces that know the words behind them. Rows count as often as they stand; doc_id isn't
read. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from . import _bytes as B

LEAST, TOP, DEPTH = 30, 2000, 4
#: Bytes of text whose words or suffixes are counted before they are dealt out.
FLUSH = 4 << 20
#: Bits of the map of frequent words; hot words at most; occurrences per partition of suffixes, and buckets in it.
BITS, HOT, TASK_WORDS, BUCKETS = 1 << 24, 200_000, 4_000_000, 8
#: Set beside the level of a word that is hot; levels are steps of half a power of two.
HOT_MARK = 128
#: Phrases scored first, as a multiple of TOP; any number gives the same result.
SEEDS = 4
#: What ends a piece, and what else separates words.
ENDS = [*b".,;:!?", *range(0x0A, 0x0E)]
WORD = B.class_table([0x20, 0x09, *ENDS])
END = np.zeros(256, bool)
END[ENDS] = True
_STEP = B.U64(0xC2B2AE3D27D4EB4F)


def parts(offsets: np.ndarray, data: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end, lowered bytes, bounds, bytes in which words are counted); what follows these is looked at only."""
    for i, j in B.chunks(offsets, limit):
        a, end = int(offsets[i]), int(offsets[j])
        while j == i + 1 and end - a > 2 * limit:
            b = a + limit
            while b < end and WORD[data[b]]:  # to the end of a word
                step = np.flatnonzero(~WORD[data[b : min(b + 4096, end)]])
                b = b + int(step[0]) if len(step) else min(b + 4096, end)
            ahead, known = 1024, 0
            while b + ahead < end and known < DEPTH:
                w = WORD[data[b : b + ahead]]
                known, ahead = int((w[:-1] & ~w[1:]).sum()), ahead * 2
            part = data[a : min(b + ahead, end)]
            yield i, j, B.LOWER[part], np.array([0, len(part)]), b - a
            a = b
        yield i, j, B.LOWER[data[a:end]], offsets[i : j + 1] - a if j > i + 1 else np.array([0, end - a]), end - a


class Words:
    """The words of a part: start, end, hash with the language, language, whether a word follows in the same piece, whether it is counted."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, codes: np.ndarray, counted: int):
        self.data = data
        self.start, self.end, row = B.words(data, bounds, WORD)
        self.lang = codes[row]
        self.h = B.mix(B.word_hashes(data, self.start, self.end) ^ self.lang) if len(row) else np.zeros(0, B.U64)
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(END[data], dtype=np.int32)])
        self.follows = np.zeros(len(row), bool)
        if len(row):
            self.follows[:-1] = (row[1:] == row[:-1]) & (ends[self.start[1:]] == ends[self.end[:-1]])
        self.own = self.start < counted

    @staticmethod
    def of(parts_: list[Words]) -> Words:
        """Many parts as one."""
        out = Words.__new__(Words)
        base = np.cumsum([0, *(len(p.data) for p in parts_)])
        out.data = np.concatenate([p.data for p in parts_])
        out.start, out.end = (np.concatenate([getattr(p, k) + b for p, b in zip(parts_, base, strict=False)]) for k in ("start", "end"))
        out.lang, out.h, out.follows, out.own = (np.concatenate([getattr(p, k) for p in parts_]) for k in ("lang", "h", "follows", "own"))
        return out

    def named(self, at: np.ndarray) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def hash_of(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(B.span_hash(B.prefix(raw.astype(B.U64) + B.U64(1)), np.array([0]), np.array([len(raw)]))[0])


def gathered(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[Words, dict[int, str]]]:
    """The words of some megabytes of text at a time, and the names of their languages; input: lang, text."""
    held, size, known, codes_of = [], 0, {}, {}
    for batch in batches:
        names, (offsets, data) = batch.column(0).to_pylist(), B.columns(batch)
        for name in set(names) - codes_of.keys():
            codes_of[name] = int(B.mix(np.array([hash_of(name)], B.U64))[0])  # mixed again, as a word may be a language's name
            known[codes_of[name]] = name
        codes = np.array([codes_of[n] for n in names], B.U64)
        for i, j, part, bounds, counted in parts(offsets, data, min(flush, B.CHUNK)):
            held.append(Words(part, bounds, codes[i:j], counted))
            size += len(part)
            if size >= flush:
                yield Words.of(held), known
                held, size = [], 0
    if held:
        yield Words.of(held), known


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, hash and number in some megabytes of the task's texts."""
    for w, names in gathered(batches, FLUSH):
        own = np.flatnonzero(w.own)
        h, first, count = np.unique(w.h[own], return_index=True, return_counts=True)
        first = own[first]
        lang = [names[c] for c in w.lang[first].tolist()]
        yield pa.record_batch([pa.array(lang, pa.string()), pa.array(w.named(first), pa.binary()).cast(pa.string()), pa.array(h.view(np.int64)), pa.array(count)], ["lang", "word", "h", "n"])


def routes(h: np.ndarray, ids: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A hash of the leading words of each suffix, through the first that isn't hot; ids are places in h plus one, 0 for none."""
    out = h[ids[0] - 1]
    on = hot[ids[0] - 1]
    for k in ids[1:]:
        on = on & (k > 0)
        out = np.where(on, B.mix(out * _STEP + h[k - 1]), out)
        on = on & hot[k - 1]
    return out


def levels(n: np.ndarray) -> np.ndarray:
    """A step for each number of occurrences from 1 on; see ``at_least``."""
    return (np.floor(np.log2(n) * 2) + 1).astype(np.uint8)


def at_least(marks: np.ndarray) -> np.ndarray:
    """A number that no word of the mark falls short of; 0 for words without a level."""
    level = (marks & (HOT_MARK - 1)).astype(np.int64)
    return np.where(level > 0, np.floor(2.0 ** ((level - 1) / 2) * (1 - 1e-9)), 0).astype(np.int64)


def _suffixes(bitmap: np.ndarray, common: np.ndarray, marks: np.ndarray, n_buckets: int):
    """Rows (bucket, lang): words of the bucket with their marks (``common`` in order, with ``marks``), and its suffixes as numbers of words with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, lang_of in gathered(batches, FLUSH):
            n = len(w.h)
            if not n:
                continue
            h, first, ids = np.unique(w.h, return_index=True, return_inverse=True)
            slot = h % B.U64(BITS)
            often = ((bitmap[(slot >> B.U64(6)).astype(np.int64)] >> (slot & B.U64(63))) & B.U64(1)).astype(bool)
            goes_on = np.append(w.follows[:-1] & often[ids[1:]], False)  # to a frequent word of the piece
            alive = often[ids] & w.own
            columns = [np.where(alive, ids + 1, 0)]
            for k in range(1, DEPTH):
                alive = alive & np.append(goes_on[k - 1 :], np.zeros(k - 1, bool))[:n] if k < n else np.zeros(n, bool)
                columns.append(np.where(alive, np.append(ids[k:] + 1, np.zeros(min(k, n), np.int64))[:n], 0))
            matrix = np.stack(columns)[:, columns[1] > 0]
            if not matrix.shape[1]:
                continue
            base = len(h) + 1
            high, low = matrix[0] * base + matrix[1], matrix[2] * base + matrix[3]
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            edge = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
            count = np.diff(np.append(edge, len(order)))
            matrix = matrix[:, order[edge]]
            place = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
            mark = np.where(common[place] == h, marks[place], 0).astype(np.uint8) if len(common) else np.zeros(len(h), np.uint8)
            hot = mark >= HOT_MARK
            bucket = ((routes(h, matrix, hot) >> B.U64(32)) * B.U64(n_buckets) >> B.U64(32)).astype(np.int64)
            lang = w.lang[first][matrix[0] - 1]
            order = np.lexsort((lang, bucket))
            matrix, count, bucket, lang = matrix[:, order], count[order], bucket[order], lang[order]
            edge = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1])))
            cells: list[list] = [[], [], [], [], [], []]
            for a, b in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist(), strict=True):
                own, numbers = np.unique(matrix[:, a:b], return_inverse=True)
                some = own[own > 0]
                numbers = numbers.reshape(DEPTH, -1) + (own[0] > 0)
                body = (bucket[a], lang_of[int(lang[a])], b" ".join(w.named(first[some - 1])), mark[some - 1].tobytes(), numbers.astype("<u2" if len(own) < 1 << 16 else "<i4").tobytes(), count[a:b].astype("<i4").tobytes())
                for c, v in zip(cells, body, strict=True):
                    c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.string(), *[pa.binary()] * 4), strict=True)], ["bucket", "lang", "words", "marks", "ids", "counts"])

    return run


PACKED = "bucket int, lang string, words binary, marks binary, ids binary, counts binary"


def phrases(ids: np.ndarray, weight: np.ndarray, hot: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, int, bool]]:
    """(suffix, depth, occurrences, in part) of the phrases of two words and more, by multikey three-way quicksort.

    A phrase is given by one of the suffixes that begin with it. Phrases of hot words only are
    in part here and are given whatever their number, all others from ``least`` on.
    """
    todo = [(np.arange(ids.shape[1]), 0, True)]  # pointers equal in so many words, all of these hot
    while todo:
        at, depth, in_part = todo.pop()
        keys = ids[depth][at]
        total = int(weight[at].sum())
        if total < least and not (in_part and hot[keys].any()):
            continue
        pivot = keys[len(keys) >> 1] if len(keys) < 40 else np.partition(keys[:: len(keys) // 20], 10)[10]
        less, more = keys < pivot, keys > pivot
        for side in (less, more):
            if side.any():
                todo.append((at[side], depth, in_part))
        if pivot == 0:  # the suffixes end here
            continue
        same = at[~(less | more)]
        still = in_part and bool(hot[pivot])
        count = int(weight[same].sum())
        if count < least and not still:
            continue
        if depth:
            yield int(same[0]), depth + 1, count, still
        if depth + 1 < len(ids):
            todo.append((same, depth + 1, still))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, number of words, occurrences, in part, bounds of first and last word; rows come ordered by bucket and language."""

    def settled(lang: str, bodies: list[tuple]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        marks, matrices, counts = [np.zeros(1, np.uint8)], [], []
        for words, own, ids, count in bodies:
            names = words.split(b" ")
            before = len(known)
            place = np.array([0, *(known.setdefault(w, len(known) + 1) for w in names)], np.int32)
            marks.append(np.frombuffer(own, np.uint8)[place[1:] > before])
            wide = len(ids) // len(count) == DEPTH  # as wide as a count
            matrices.append(place[np.frombuffer(ids, "<i4" if wide else "<u2").reshape(DEPTH, -1)])
            counts.append(np.frombuffer(count, "<i4"))
        matrix, mark = np.concatenate(matrices, 1), np.concatenate(marks)
        found = list(phrases(matrix, np.concatenate(counts).astype(np.int64), mark >= HOT_MARK))
        at, depth = (np.array([f[i] for f in found], np.int64) for i in (0, 1))
        known_least = at_least(mark)
        names = [b"", *known]
        text = [b" ".join(names[k] for k in matrix[:depth, at].tolist()).decode() for at, depth, _, _ in found]
        return pa.record_batch(
            [pa.array([lang] * len(found), pa.string()), pa.array(text, pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.bool_()),
             pa.array(known_least[matrix[0, at]]), pa.array(known_least[matrix[depth - 1, at]])],
            ["lang", "phrase", "words", "n", "in_part", "first", "last"],
        )

    now, held = None, []
    for part in (batch.slice(i, 250) for batch in batches for i in range(0, len(batch), 250)):
        for bucket, lang, *body in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
            if (bucket, lang) != now:
                if held:
                    yield settled(now[1], held)
                now, held = (bucket, lang), []
            held.append(tuple(body))
    if held:
        yield settled(now[1], held)


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, n of all phrases of up to four words with LEAST occurrences or more, bounds of their first and last word; lang, total of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counts = texts.mapInArrow(_count_words, "lang string, word string, h long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.first("h").alias("h"))
    words = materialize(counts, "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = words.where(F.col("n") >= LEAST)
    slot = F.pmod(F.col("h"), F.lit(BITS))  # BITS divides 2 ** 64
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bits = often.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # BITS / 64 rows at most
    bitmap = np.zeros(BITS // 64, B.U64)
    bitmap[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(B.U64)
    total = words.agg(F.sum("n")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_WORDS + 1)
    share = max(total // HOT, 1)
    common = words.where(F.col("n") > share).select("h", "n").toArrow()  # by shares of all words, HOT at most
    h, count = common.column("h").to_numpy().view(B.U64), common.column("n").to_numpy()
    marks = levels(count) | np.where(count > max(total // (2 * n), share), HOT_MARK, 0).astype(np.uint8)
    order = np.argsort(h)
    packed = texts.mapInArrow(_suffixes(bitmap, h[order], marks[order], BUCKETS * n), PACKED).repartition(n, "bucket").sortWithinPartitions("bucket", "lang")
    found = materialize(packed.mapInArrow(_sorted, "lang string, phrase string, words int, n long, in_part boolean, first long, last long"), "phrase-counts")
    added = found.where("in_part").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"), F.max("first").alias("first"), F.max("last").alias("last")).where(F.col("n") >= LEAST)
    one = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n", F.col("n").alias("first"), F.col("n").alias("last"))
    return materialize(one.unionByName(found.where("not in_part").drop("in_part")).unionByName(added), "phrases"), totals


def _within(first: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of candidates (lang, phrase, words, a) at their lowest cut."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _within(F.lit(1), F.col("k")).alias("head"), _within(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("2000000 * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + r)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def within_reach(left: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose bound reaches the TOP-th score of those with the highest bounds, by language."""
    by_bound = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("bound"), F.desc("a"), "phrase"))
    seeds = left.withColumn("place", by_bound).where(F.col("place") <= SEEDS * TOP)  # each task sends its own first ones only
    by_score = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    reach = scored(seeds, known).withColumn("place", by_score).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("place") == TOP, F.col("score"))), F.lit(0)).alias("reach"))
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a language isn't one task
    reach = reach.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int"))
    return salted.alias("c").join(reach.alias("t"), (F.col("c.lang") == F.col("t.lang")) & (F.col("c.salt") == F.col("t.salt")) & (F.col("bound") >= F.col("reach"))).select("c.*")


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    known, totals = counted(docs)
    long_ = known.where("words > 1")
    # what lies inside longer candidates: every shorter phrase of two words or more at every place
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.struct(i.alias("i"), k.alias("k")))))
    inner = long_.where("words > 2").withColumn("z", F.explode(places)).groupBy("lang", _within(F.col("z.i"), F.col("z.k")).alias("phrase")).agg(F.max("n").alias("longer"))
    left = long_.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("n").cast("decimal(20,0)") * 80))
    # the cut after the first word has l >= first, that before the last word r >= last; the other part is a or more
    parts_ = F.expr("CASE WHEN words = 2 THEN cast(greatest(first, n) AS decimal(20,0)) + greatest(last, n) ELSE cast(greatest(first, last, n) AS decimal(20,0)) + n END")
    left = left.withColumn("parts", parts_).select("lang", "phrase", "words", F.col("n").alias("a"), F.expr("2000000 * cast(n AS decimal(20,0)) div parts").alias("bound"))
    left = materialize(left, "phrase-candidates")
    best = scored(within_reach(left, known), known)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = best.withColumn("rank", rank).where(F.col("rank") <= TOP)  # each task sends its own first ones only
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
