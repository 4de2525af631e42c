"""Operator 5, native: quality rules as a short-circuit cascade.

Base figures are counted for every document with SQL functions only. The cascade's own
rules are then ordered by rejection per cost, both estimated on a bounded sample drawn by
hash from the whole table, and evaluated as one CASE expression, so that a document stops
at the first rule that rejects it. A rule's cost is what it reads of a document: the bytes
of the strings it goes over, as often as it does, and a few for its figures. This is the
same on every run, so the order is too. After each choice only the sample's documents that
no chosen rule rejects count for the next one. The verdict is the conjunction of all rules and does not depend on the order.

Cases: null and empty texts have no words and fail the base rule. One- and two-word
texts have no 3-word window. Repeated rows are judged one by one. An empty table gives an
empty result (the rules keep their written order). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six white-space characters, and the symbol characters.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows, on average, of the sample on which cost and selectivity are estimated; bytes that a rule reads in any case.
SAMPLE_ROWS = 1000
FIGURES = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array."""

    def counted(grams: Column) -> Column:
        def covered(sorted_pairs: Column) -> Column:
            n = F.size(sorted_pairs)
            same = lambda i, j: F.get(sorted_pairs, i)["g"] == F.get(sorted_pairs, j)["g"]
            at = F.filter(
                F.transform(
                    sorted_pairs,
                    lambda p, i: F.when(((i > 0) & same(i - 1, i)) | ((i + 1 < n) & same(i, i + 1)), p["i"]),
                ),
                lambda x: x.isNotNull(),
            )
            return let(
                F.array_sort(at),
                lambda s: F.aggregate(
                    F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            )

        pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(F.array_sort(pairs), covered))

    def grams(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(grams(w), counted)))


def _figures(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    counted = docs.select("doc_id", text.alias("text"), _words(text).alias("words"), bare.alias("bare"))
    return counted.select(
        "doc_id",
        "text",
        "bare",
        F.size("words").cast("long").alias("n_words"),
        F.length("bare").cast("long").alias("word_chars"),
        (F.length("bare") - F.length(F.translate("bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


#: The cascade's rules: what each goes over, and when it rejects a document.
RULES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "symbols": ((), lambda: F.col("n_symbols") * 10 > F.col("n_words")),
    "word_length": ((), lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    "dup_lines": ((), lambda: F.col("n_dup_lines") * 2 > F.col("n_lines")),
    "repeats": ((), lambda: F.col("n_repeat_words") * 10 > 3 * F.col("n_words")),
    "shouting": (("bare",), lambda: F.length(F.regexp_replace("bare", "[^A-ZÀ-ÖØ-Þ]+", "")) * 2 > F.col("word_chars")),
    "letters": (("bare",), lambda: F.length(F.regexp_replace("bare", "\\p{L}+", "")) * 10 > 4 * F.col("word_chars")),
    "exclaiming": (("bare", "bare"), lambda: (F.length("bare") - F.length(F.translate("bare", "!?", ""))) * 5 > F.col("n_words")),
    "bullets": (("text",), lambda: F.size(F.split(F.col("text"), "(?m)^[ \\t]*[-*\\u2022]")) * 10 > 9 * (F.col("n_lines") + 1)),
    "ellipses": (("text",), lambda: F.size(F.split(F.col("text"), "(?m)(?:\\.\\.\\.|\\u2026)[ \\t]*$")) * 10 > 3 * (F.col("n_lines") + 4)),
}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ordered_rules(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, best rejection per cost first, from one job over a sample of some ``sample_rows`` documents."""
    total = max(1, docs.count())
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(total)) < sample_rows)
    figures = _figures(drawn).where(~base_failed())
    size = lambda c: F.sum(F.octet_length(c).cast("long")).alias(f"bytes_{c}")
    verdicts = [F.coalesce(rule(), F.lit(False)).alias(name) for name, (_, rule) in RULES.items()]
    found = figures.select("text", "bare", *verdicts).groupBy(*RULES).agg(F.count(F.lit(1)).alias("n"), size("text"), size("bare")).collect()  # 2 ** rules rows at most
    n = max(1, sum(r.n for r in found))
    cost = {name: FIGURES + sum(sum(r[f"bytes_{c}"] for r in found) / n for c in read) for name, (read, _) in RULES.items()}
    order, left = [], found
    while len(order) < len(RULES):
        rejected = {name: sum(r.n for r in left if r[name]) for name in RULES if name not in order}
        order.append(max(rejected, key=lambda name: (rejected[name] / cost[name], -cost[name], -list(RULES).index(name))))
        left = [r for r in left if not r[order[-1]]]
    return order


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Base figures, base_failed, kept, and rejected_by: the first rule that rejected, if any."""
    figures = _figures(docs)
    order = order or ordered_rules(docs)
    cascade = F.when(base_failed(), F.lit("base"))
    for name in order:
        cascade = cascade.when(RULES[name][1](), F.lit(name))
    return figures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), cascade.alias("rejected_by")
    ).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
