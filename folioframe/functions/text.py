"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a Vietnamese diacritic, lower case.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
#: What a page's text must have to be trusted.
SAMPLE_CHARS, LEAST_LETTERS, LEAST_DIACRITICS, MOST_REPLACED = 2000, 50, 0.05, 0.02
PREVIEW_CHARS = 80
PAGE_NUMBER = "^\\s*(?:trang|Trang)?\\s*\\d{1,3}\\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_letters(text: Column) -> Column:
    """Letters left once everything between them is cut out: far fewer matches than letters."""
    return F.length(F.regexp_replace(text, "\\P{L}+", ""))


def count_of(text: Column, characters: str) -> Column:
    """How many of a text's characters are among some, none of them ASCII: runs of ASCII are cut out first."""
    other = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    return F.length(other) - F.length(F.translate(other, characters, ""))


def collapse(text: Column) -> Column:
    """Runs of white space, of any kind, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def folded(text: Column) -> Column:
    """Collapsed and without case, for comparisons."""
    return F.replace(F.lower(collapse(text)), F.lit("ß"), F.lit("ss"))


def clean_line(text: Column) -> Column:
    """No-break spaces and soft hyphens as plain ones, then collapsed."""
    return collapse(F.translate(text, " ­", " -"))


def diacritic_share(text: Column) -> Column:
    """Share of letters that carry a Vietnamese diacritic; 0 without letters."""
    letters = n_letters(text)
    marked = count_of(F.lower(text), VIETNAMESE)
    return F.when(letters == 0, F.lit(0.0)).otherwise(marked / letters)


def untrusted(text: Column) -> Column:
    """Too few letters, hardly any diacritics, or replacement characters, at the text's start."""
    start = F.substring(text, 1, SAMPLE_CHARS)
    replaced = count_of(start, "�")
    return (
        (n_letters(start) < LEAST_LETTERS)
        | (diacritic_share(start) < LEAST_DIACRITICS)
        | (replaced > MOST_REPLACED * F.length(start))
    )


def has_letter(text: Column) -> Column:
    return text.rlike("\\p{L}")


def is_upper(text: Column) -> Column:
    return (text == F.upper(text)) & has_letter(text)


def is_agency(text: Column) -> Column:
    return is_upper(text) & (F.length(text) <= 80)


def preview(text: Column) -> Column:
    return F.substring(collapse(text), 1, PREVIEW_CHARS)


def next_letter(letter: Column) -> Column:
    return F.when((letter == "") | letter.isNull(), F.lit("a")).otherwise(F.char(F.ascii(letter) + 1))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits per reference character; an empty reference counts as right or wholly wrong."""
    ref, hyp = F.regexp_replace(reference, "(?U)^\\s+|\\s+$", ""), F.regexp_replace(hypothesis, "(?U)^\\s+|\\s+$", "")
    return F.when(ref == "", F.when(hyp == "", F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def safe_filename(name: Column) -> Column:
    """Letters, digits and ``-_.()``; slashes become underscores; no dots or underscores at the ends."""
    kept = F.regexp_replace(F.regexp_replace(name, "[/\\\\]", "_"), "[^\\p{L}\\p{N}\\-_.() ]", "")
    return F.regexp_replace(F.replace(kept, F.lit(" "), F.lit("_")), "^[._]+|[._]+$", "")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def metric_key(name: Column, labels: Column) -> Column:
    """``name{k="v",...}`` with sorted labels, from a map."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.when(F.size(parts) == 0, name).otherwise(F.concat(name, F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def json_or_null(text: Column, schema: str) -> Column:
    """JSON inside an optional code fence; null if it isn't JSON."""
    bare = F.regexp_replace(F.trim(text), "^```[a-zA-Z]*\\s*|\\s*```$", "")
    return F.when(F.try_parse_json(bare).isNotNull(), F.from_json(bare, schema))
