"""Operator 8, native: size-balanced shards by sampled splitters.

Law ``bytes``: shards hold nearly equal numbers of bytes (apart by about one document).

1. Every record gets a 64-bit range key: the high bits hash the text, so that equal
   texts lie together, the low bits hash the id, so that a hot group can be cut.
2. A size-weighted key sample (bounded by ``sample_per_range * ranges`` expected rows)
   gives quantile splitters; records are range-partitioned by binary search over them.
3. Exact bytes and counts per range follow from one aggregation of bounded size. Ranges
   that hold more than twice their share are subdivided at further cut points; where such
   a range is a single key (rows of one text and one id) its rows are divided by their number.
4. Inside a range a window orders records; the offset of the range plus the running sum
   places each record on the byte axis, which is cut into equal shards.

The sample only decides how the work is spread: the placement itself depends on all
records and on nothing random. Rows of one text and one id are alike, so their order is free;
of other ids with a hot key's text only those whose hash meets its low bits may change places
with them where the files are split in another way.

Cases: null text counts as empty (size 1, crc 0). Repeated rows each get a slot of their
own. A null id sorts first. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize

SALT_BITS = 20


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    low = (1 << SALT_BITS) - 1
    key = F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit(low)))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        key.alias("range_key"),
        F.monotonically_increasing_id().alias("row"),  # written with the keys, so it stays
    )


def _located(df: DataFrame, splitters: list[int]) -> DataFrame:
    """Adds ``rng``: how many splitters are at or below the key, by unrolled binary search."""
    df = df.withColumn("rng", F.lit(0))
    if not splitters:
        return df
    cuts = F.lit(splitters)
    step = 1 << (len(splitters).bit_length() - 1)
    while step:
        at = F.col("rng") + step
        go = (at <= len(splitters)) & (F.get(cuts, F.least(at, F.lit(len(splitters))) - 1) <= F.col("range_key"))
        df = df.withColumn("rng", F.when(go, at).otherwise(F.col("rng")))
        step >>= 1
    return df


def _splitters(keyed: DataFrame, total: int, ranges: int, sample_per_range: int) -> list[int]:
    wanted = ranges * sample_per_range
    chance = F.col("size") * F.lit(wanted / total)
    draw = F.pmod(F.xxhash64("range_key", "row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a record larger than one sample step stands for several steps
    sample = keyed.where(draw < chance).select("range_key", F.greatest(F.lit(1.0), chance).alias("w")).collect()
    sample.sort(key=lambda r: r.range_key)
    weight, cuts, seen = sum(r.w for r in sample), [], 0.0
    for r in sample:
        if seen * ranges >= (len(cuts) + 1) * weight:
            if not cuts or r.range_key > cuts[-1]:
                cuts.append(r.range_key)
            elif r.range_key == cuts[-1] < (1 << 63) - 1:  # a key of more than a range gets one of its own
                cuts.append(r.range_key + 1)
        seen += r.w
    return cuts


def _per_range(located: DataFrame) -> list:
    return sorted(
        located.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("range_key").alias("lo"), F.max("range_key").alias("hi")).collect(),
        key=lambda r: r.rng,
    )


def _divided(located: DataFrame, parts: list[int]) -> DataFrame:
    """Each range as so many ranges, its rows dealt by number."""
    base = [0]
    for p in parts[:-1]:
        base.append(base[-1] + p)
    own = F.pmod(F.xxhash64("row"), F.get(F.lit(parts), F.col("rng"))).cast("int")
    return located.withColumn("rng", F.get(F.lit(base), F.col("rng")) + own)


def shard(docs: DataFrame, n_shards: int = 16, ranges: int | None = None, sample_per_range: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; see the module's text."""
    keyed = materialize(_keyed(docs), "shard-keys")
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if ranges is None:  # a range has some 50,000 records; the driver never holds more than 65,536 ranges
        ranges = max(256, min(65536, 1 << max(0, rows // 50_000).bit_length()))
    cuts = _splitters(keyed, total, ranges, sample_per_range) if total else []
    stats = _per_range(_located(keyed, cuts))
    share = max(1, total // ranges)
    more = []
    for r in stats:
        parts = min(1024, r.bytes // share)
        if parts > 2 and r.hi > r.lo:
            width = (r.hi - r.lo) // parts
            more += [r.lo + width * i for i in range(1, parts) if width]
    if more:
        cuts = sorted({*cuts, *more})
        stats = _per_range(_located(keyed, cuts))
    parts = [1] * (len(cuts) + 1)
    for r in stats:
        if r.hi == r.lo and r.bytes > 2 * share and r.n > 1:
            parts[r.rng] = min(r.n, r.bytes // share)
    located = _located(keyed, cuts)
    if max(parts) > 1:
        located = _divided(located, parts)
        stats = _per_range(located)
    at_bytes, at_rows, b, n = [0] * sum(parts), [0] * sum(parts), 0, 0
    for r in stats:
        at_bytes[r.rng], at_rows[r.rng] = b, n
        b, n = b + r.bytes, n + r.n
    w = Window.partitionBy("rng").orderBy("range_key", "doc_id")
    before = F.get(F.lit(at_bytes), F.col("rng")) + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    place = F.get(F.lit(at_rows), F.col("rng")) + F.row_number().over(w) - 1
    # floor(before * n_shards / total), by the middle of the record so that a border record goes to the nearer side
    shard_no = F.least(F.lit(n_shards - 1), F.expr("0") if not total else ((before * 2 + F.col("size")) * n_shards / (2 * total)).cast("int"))
    placed = materialize(
        located.withColumn("place", place.cast("long")).withColumn("shard", shard_no.cast("int")).select("doc_id", "size", "text_crc32", "shard", "place"), "shard-placed"
    )
    first = {r.shard: r.at for r in placed.groupBy("shard").agg(F.min("place").alias("at")).collect()}
    starts = F.lit([first.get(i, 0) for i in range(n_shards)])
    slot: Column = F.col("place") - F.get(starts, F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
