"""Figures that the classifiers read, against plain Python on one text at a time."""

import random
import re
from collections import Counter
from math import log, log1p, sqrt

import numpy as np

from folioframe.llm import quality, toxicity

TOKENS = [
    "the", "The", "naïve", "ÀÉ×", "中文", "x1", "42", "you", "You", "are", "such", "an", "idiot", "IDIOT", "Idiot!", "trash!", "trash", "filth", "pathetic", "crap.", "crap",
    "gloomy", "gloomier", "glooms", "gloom", "wretch", "#tag", "$5", "<b>", "wow!!", "end.", "a;b:c", "*", "|", "é",
]
MINED = ["wretch", "gloom*1", "fil*2", "trash", "cra*1"]


def texts(seed, n=250):
    r = random.Random(seed)
    made = ["".join(r.choice(TOKENS) + r.choice([" ", " ", " ", "  ", "\n", "\t", "\x0b"]) for _ in range(r.choice([1, 2, 3, 4, 20, 200]))) for _ in range(n)]
    return ["", *made, " \n ", "idiot", "idiot!", "!", "", "you", "idiot", ""]


def joined(found):
    raw = [t.encode() for t in found]
    return raw, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def plain_statistics(raw):
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, sizes = len(words), [len(w) for w in words]
    chars, count = sum(sizes), lambda p: len(re.findall(p, raw))
    mean = chars / max(n, 1)
    spread = sqrt(max(0, sum(s * s for s in sizes) / max(n, 1) - mean * mean))
    letters, digits = count(rb"[A-Za-z\x80-\xff]"), count(rb"[0-9]")
    upper = count(rb"[A-Z]") + count(rb"(?<=\xc3)[\x80-\x9e]")
    grams = list(zip(words, words[1:], words[2:], strict=False))
    share = lambda part, whole, usual, weight=20: log((part + weight * usual) / (whole + weight))
    return [
        log1p(n), log((chars + 100) / (n + 20)), log((spread * n + 60) / (n + 20)), share(upper, letters, 0.03, 100), share(count(rb"[#*$%&|<>]"), chars, 0.002, 100),
        share(count(rb"[!?]"), chars, 0.002, 100), share(count(rb"[.,;:]"), n, 0.1), share(chars - letters - digits, chars, 0.03, 100), share(count(rb"\n"), n, 0.03), share(len(set(words)), n, 0.8),
        share(len(grams) - len(set(grams)), len(grams), 0.01), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n, 0.01), share(sum(bool(re.search(rb"[0-9A-Za-z\x80-\xff]$", w)) for w in words), n, 0.85),
    ]


def plain_evidence(raw):
    found = [(m.group().lower(), m.group(), raw[m.end() : m.end() + 1]) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    low = [w.decode() for w, _, _ in found]
    begins = {m: [w for w in low if w.startswith(m.split("*")[0]) and w != m.split("*")[0]] for m in MINED if "*" in m}
    mined = {m for m in MINED if "*" not in m} | {w for m, own in begins.items() if len(own) >= int(m.split("*")[1]) for w in own}
    kinds = [next((k for k, own in toxicity.LEXICON.items() if w in own), "mined" if w in mined else None) for w in low]
    abuse = [k is not None for k in kinds]
    near = sum(abuse[i] and any(low[i - d] in toxicity.ADDRESS for d in (1, 2) if i >= d) for i in range(len(low)))
    loud = sum(a and ((w[:1].isupper() and w[-1:].isupper()) or after == b"!") for a, (_, w, after) in zip(abuse, found, strict=True))
    each, n_mined, n = Counter(kinds), sum(w in mined for w in low), sum(abuse)
    per_kind = [each[k] for k in toxicity.LEXICON]
    rate, different = n / max(len(low), 1), sum(c > 0 for c in per_kind)
    votes = [*(int(c > 0) for c in per_kind), int(n_mined > 1), int(near > 0), int(rate > 0.004), int(n > 2), int(loud > 0), -int(n == 0), -int(rate < 0.0005 or n == 0)]
    x = [*map(log1p, per_kind), log1p(n_mined), log1p(near), log1p(n), log1p(loud), log1p(100 * rate), n > 0, n > 1, different, different > 1, log1p(len(low)) / 10, n_mined > 0, n_mined > 1]
    return votes, x


def test_statistics_of_quality():
    raw, data, bounds = joined(texts(1))
    got = quality.statistics(data, bounds)
    assert got.shape == (len(raw), len(quality.NAMES))
    np.testing.assert_allclose(got, [plain_statistics(r) for r in raw], atol=1e-9)
    for some in (["a"], ["a b"], ["", "a a a"], [""]):  # few words in all
        raw, data, bounds = joined(some)
        np.testing.assert_allclose(quality.statistics(data, bounds), [plain_statistics(r) for r in raw], atol=1e-9)


def test_evidence_of_toxicity():
    for some in (texts(2), ["idiot"], ["", "idiot"], ["you", "idiot"], ["", ""]):
        raw, data, bounds = joined(some)
        votes, x = toxicity.evidence(data, bounds, MINED)
        want = [plain_evidence(r) for r in raw]
        assert votes.tolist() == [v for v, _ in want]
        np.testing.assert_allclose(x, [np.array(f, float) for _, f in want], atol=1e-9)
