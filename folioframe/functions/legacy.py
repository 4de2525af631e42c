"""Decoding of text that was set with TCVN3 or VNI fonts, as column expressions.

Composites (two characters) are first replaced by private-use characters, then one
``translate`` maps everything at once, so no replacement ever sees another's result.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import VIETNAMESE, count_of, n_letters

#: Least share of diacritics after decoding, and least gain.
HEALTHY, GAIN = 0.15, 0.10
#: First code and letters of each run of the TCVN3 table.
TCVN3_RUNS = (
    (161, "ĂÂÊÔƠƯĐăâêôơưđ"), (181, "àảãáạ"), (187, "ằẳẵắ"), (198, "ặầẩẫấậè"), (206, "ẻẽéẹềểễếệìỉ"),
    (220, "ĩíịò"), (225, "ỏõóọồổỗốộờởỡớợù"), (241, "ủũúụừửữứựỳỷỹýỵ"),
)
#: VNI letters of one character, and the marks that follow a base letter.
VNI_LETTERS = {"Æ": "Ỉ", "Ì": "Ì", "Í": "Í", "Î": "Ỵ", "Ñ": "Đ", "Ò": "Ị", "Ó": "Ĩ", "Ô": "Ơ", "Ö": "Ư"}
GRAVE, ACUTE, TILDE, HOOK, DOT, HAT, BREVE = "̀", "́", "̃", "̉", "̣", "̂", "̆"
VNI_TONES = {"Ø": GRAVE, "Ù": ACUTE, "Õ": TILDE, "Û": HOOK, "Ï": DOT}
VNI_HATS = {"Â": HAT, "Á": HAT + ACUTE, "À": HAT + GRAVE, "Å": HAT + HOOK, "Ã": HAT + TILDE, "Ä": HAT + DOT}
VNI_BREVES = {"Ê": BREVE, "É": BREVE + ACUTE, "È": BREVE + GRAVE, "Ú": BREVE + HOOK, "Ü": BREVE + TILDE, "Ë": BREVE + DOT}


@dataclass(frozen=True)
class Code:
    name: str
    single: dict[str, str]
    pairs: dict[str, str]


def _tcvn3() -> Code:
    single = {chr(first + i): letter for first, run in TCVN3_RUNS for i, letter in enumerate(run)}
    code = {letter: char for char, letter in single.items()}
    pairs = {}
    for char, letter in single.items():
        parts = unicodedata.normalize("NFD", letter)
        tones = [m for m in parts if m in VNI_TONES.values()]
        if letter.islower() and tones:  # a capital is its base, then the code of the small letter
            base = unicodedata.normalize("NFC", "".join(m for m in parts if m not in tones)).upper()
            pairs[code.get(base, base) + char] = letter.upper()
    return Code("TCVN3", single, pairs)


def _vni() -> Code:
    compose = lambda base, marks: unicodedata.normalize("NFC", base + marks)
    pairs = {}
    for base, marks in (("A", VNI_TONES | VNI_HATS | VNI_BREVES), ("E", VNI_TONES | VNI_HATS), ("O", VNI_TONES | VNI_HATS), ("U", VNI_TONES), ("Y", VNI_TONES)):
        pairs |= {base + m: compose(base, x) for m, x in marks.items() if base + m != "YÏ"}
    pairs |= {base + m: compose(VNI_LETTERS[base], x) for base in "ÔÖ" for m, x in VNI_TONES.items()}
    small = lambda table: table | {k.lower(): v.lower() for k, v in table.items()}
    return Code("VNI", small(VNI_LETTERS), small(pairs))


TCVN3, VNI = _tcvn3(), _vni()


def _private(n: int) -> str:
    return "".join(chr(0xE000 + i) for i in range(n))


def _marked(text: Column, code: Code) -> Column:
    for mark, pair in zip(_private(len(code.pairs)), code.pairs, strict=True):
        text = F.replace(text, F.lit(pair), F.lit(mark))
    return text


def _unmarked(marked: Column, code: Code) -> Column:
    return F.translate(marked, _private(len(code.pairs)) + "".join(code.single), "".join(code.pairs.values()) + "".join(code.single.values()))


def decoded(text: Column, code: Code) -> Column:
    return _unmarked(_marked(text, code), code)


def _may_gain(text: Column, code: Code) -> Column:
    """False only if too few characters could change for the share of diacritics to gain enough.

    With c characters that can change and n letters, the share gains at most (m + c) / (n - c) - m / n,
    which stays under 0.1 for c <= 0.045 n.
    """
    kinds = "".join(dict.fromkeys([*code.single, *(p[1] for p in code.pairs)]))
    return count_of(text, kinds) * 1000 > n_letters(text) * 45


def encoded(text: Column, code: Code) -> Column:
    """Inverse of ``decoded``; letters outside the table stay."""
    back = {v: k for k, v in code.single.items()} | {v: k for k, v in code.pairs.items()}
    two = {v: k for v, k in back.items() if len(k) == 2}
    marks = _private(len(two))
    text = F.translate(text, "".join(two), marks)
    one = {v: k for v, k in back.items() if len(k) == 1}
    text = F.translate(text, "".join(one), "".join(one.values()))
    for mark, pair in zip(marks, two.values(), strict=True):
        text = F.replace(text, F.lit(mark), F.lit(pair))
    return text


def _share(text: str) -> float:
    letters = [c for c in text.lower() if c.isalpha()]
    return sum(c in VIETNAMESE for c in letters) / len(letters) if letters else 0.0


@lru_cache(maxsize=4)
def _tools(name: str) -> tuple[re.Pattern, dict[str, str], dict[int, str], dict[int, str]]:
    """Pattern of the pairs, their letters, and both directions of the table."""
    code = {c.name: c for c in (TCVN3, VNI)}[name]
    back = {v: k for k, v in code.single.items()} | {v: k for k, v in code.pairs.items()}
    return re.compile("|".join(map(re.escape, code.pairs))), code.pairs, str.maketrans(code.single), str.maketrans(back)


def _lossless(text: str, name: str, healthy_from: float) -> tuple[int, str] | None:
    """(pairs, decoded) if the decoding is healthy enough and can be taken back exactly."""
    pattern, pairs, single, back = _tools(name)
    parts, n, at = [], 0, 0
    for m in pattern.finditer(text):
        parts += [text[at : m.start()].translate(single), pairs[m[0]]]
        n, at = n + 1, m.end()
    plain = "".join([*parts, text[at:].translate(single)])
    changed = n > 0 or any(ord(c) in single for c in set(text))
    if not changed or _share(plain) < healthy_from or plain.translate(back) != text:
        return None
    return n, plain


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
def _best(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = {}
        if text:
            least = max(HEALTHY, _share(text) + GAIN)
            found = {name: d for name in ("TCVN3", "VNI") if (d := _lossless(text, name, least))}
        best = max(found, key=lambda name: found[name][0], default=None)
        rows.append((best, found[best][1] if best else None))
    return pd.DataFrame(rows, columns=["encoding", "text"])


def best_decoding(text: Column) -> Column:
    """Struct (encoding, text) of the decoding that is provably lossless and clearly healthier; nulls in it if none is.

    Of two, the one with more pairs wins; equal counts go to TCVN3. Only texts in which
    enough could change reach Python: a hundred and seventy nested replacements of each
    such text cost ten times as much.
    """
    return _best(F.when(_may_gain(text, TCVN3) | _may_gain(text, VNI), text))
