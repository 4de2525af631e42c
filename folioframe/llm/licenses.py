"""Operator 7, native: licence scan by Dice coefficient over word bigrams.

Texts are normalised (lower case, everything but letters and digits to one space) and
compared with templates: dice = 2 * |A & B| / (|A| + |B|) over the sets of word bigrams.
A pair can only reach the threshold t if 2 * min(|A|, |B|) >= t * (|A| + |B|); templates
outside these bounds are not compared. All comparisons are in whole numbers, so a match
at exactly the threshold counts.

``find`` goes over whole texts, wherever a notice stands, however it is wrapped and whatever
was put in or left out. For a template of n bigrams at m places, a window is any run of places
that begins and ends with one of its bigrams, of at most (2 - t) / t * m places; it needs at
least t / (2 - t) * n of the template's bigrams to match. These two bounds prune: a template
goes on for a text only from places where so many of its bigrams lie within so many places. As
a match shares more than two thirds of the bigrams (at 0.8), a text without any of a few of the
template's words, which a third of its bigrams contain, is left out before that.
Of windows that match and share words, the best is a find (highest dice, then shortest, then
first), the others are not; two notices that follow each other are two finds. Returns a row for
each find: doc_id, license, first_word and last_word (from 1), n_bigrams, n_common and dice.
A window with an at least as good one inside it is never a find, so they are not made: from
each place only ends that are better than all ends before. The others are settled stretch by
stretch of a text, so that a text of many notices holds the windows of a few stretches.

``scan`` compares single lines. Returns a row for each line and template at or above the
threshold: doc_id, line_no (from 1), license, n_bigrams, n_common, dice.

Cases: null and empty texts, and lines of one word, have no bigrams and never match.
Repeated rows are reported as often as they occur. Ties between templates all count. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import let

THRESHOLD = 0.8
#: Notices and texts of common licences.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def normalised(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams(text: str) -> list[str]:
    words = normalised(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _bigrams(words: Column) -> Column:
    pairs = lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    return let(words, lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs(w))))


def _exact(threshold: float) -> tuple[int, int]:
    t = Fraction(str(threshold))
    return t.numerator, t.denominator


def _reaches(common: Column, n: Column, size: Column, threshold: float) -> Column:
    """2 * common / (n + size) >= threshold, in whole numbers; also the size bound, with the lesser size as ``common``."""
    num, den = _exact(threshold)
    return 2 * den * common >= num * (n + size)


def marks(template: str, threshold: float) -> list[str]:
    """Words of a template of which each text that matches has one: more of its bigrams contain them than may be missing."""
    grams = bigrams(template)
    num, den = _exact(threshold)
    spare = len(grams) - -(-num * len(grams) // (2 * den - num))  # |A & B| >= t / (2 - t) * |B|
    chosen: list[str] = []
    left = list(grams)
    while len(grams) - len(left) <= spare:
        words = [w for g in left for w in g.split()]
        best = max(sorted(set(words)), key=lambda w: (len(w) > 4, words.count(w), len(w)))
        chosen.append(best)
        left = [g for g in left if best not in g.split()]
    return chosen


def bounds(template: str, threshold: float) -> tuple[int, int]:
    """How many of the template's bigrams a match has at least, and of how many places a window is at most."""
    num, den = _exact(threshold)
    return -(-num * len(bigrams(template)) // (2 * den - num)), (len(normalised(template)) - 1) * (2 * den - num) // num


_FIND = "struct<worse:double,places:int,first:int,last:int,n:int,common:int>"
_OPEN = 2**31 - 1


def _overlaps(x: Column, y: Column) -> Column:
    return (x["first"] <= y["last"]) & (y["first"] <= x["last"])


def _settled(windows: Column, edge: Column | int) -> Column:
    """Of windows in order, best first, those that are finds whatever begins at ``edge`` or later."""

    def step(a: Column, x: Column) -> Column:
        free = ~F.exists(a["taken"], lambda y: _overlaps(x, y))
        sure = x["last"] < a["front"]
        return F.struct(
            F.when(free & ~sure, F.least(a["front"], x["first"])).otherwise(a["front"]).alias("front"),
            F.when(free & sure, F.concat(a["taken"], F.array(x))).otherwise(a["taken"]).alias("taken"),
        )

    none = F.array().cast(f"array<{_FIND}>")
    start = F.struct((F.lit(edge) if isinstance(edge, int) else edge).cast("int").alias("front"), none.alias("taken"))
    return F.aggregate(windows, start, step, lambda a: a["taken"])


def _listed(values: list[str]) -> Column:
    """A constant array by way of one string: thousands of literals are slow to build."""
    return F.split(F.lit("|".join(values)), "[|]")


def find(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    num, den = _exact(threshold)
    known = {k: (bigrams(v), marks(v, threshold), *bounds(v, threshold)) for k, v in (TEMPLATES if templates is None else templates).items()}
    some = sorted({w for _, m, *_ in known.values() for w in m})
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^0-9a-z]+", " "))
    texts = docs.select("doc_id", clean.alias("clean")).where(F.col("clean").rlike(f"(?:^| )(?:{'|'.join(some)})(?: |$)"))
    words = texts.select("doc_id", F.split("clean", " ").alias("w"))
    grams = words.select("doc_id", "w", F.transform(F.slice("w", F.lit(1), F.size("w") - 1), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1))).alias("g"))

    def starts(b: list[str], need: int, span: int) -> Column:
        hits = F.filter(F.transform("g", lambda x, i: F.when(F.array_contains(_listed(b), x), i)), lambda i: i.isNotNull())
        return let(hits, lambda h: F.filter(F.transform(h, lambda p, k: F.when(F.get(h, k + need - 1) - p < span, p)), lambda p: p.isNotNull()))

    def fitting(k: str, b: list[str], m: list[str], need: int, span: int) -> Column:
        row = F.struct(F.lit(k).alias("license"), _listed(b).alias("b"), F.lit(span).alias("span"), starts(b, need, span).alias("starts"))
        return F.when(F.arrays_overlap("w", _listed(m)), row)

    candidates = F.filter(F.array(*(fitting(k, *v) for k, v in known.items())), lambda t: F.size(t["starts"]) > 0)
    rows = grams.select("doc_id", "g", F.explode(candidates).alias("t"))
    size, span = F.size("t.b"), F.col("t.span")
    in_order = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = lambda o, x, k: F.when(F.get(o, k - 1)["x"] == x["x"], F.get(o, k - 1)["i"])
    earlier = let(in_order, lambda o: F.sort_array(F.transform(o, lambda x, k: F.struct(x["i"].alias("i"), F.coalesce(same(o, x, k), F.lit(-1)).alias("earlier"), F.array_contains("t.b", x["x"]).alias("hit")))))

    def windows(cells: Column, first: Column) -> Column:
        """From one place, each end that matches and is better than those before."""

        def step(a: Column, x: Column) -> Column:
            new = (x["earlier"] < first).cast("int")
            n, common = a["n"] + new, a["common"] + F.when(x["hit"], new).otherwise(F.lit(0))
            worse = -(common.cast("double") / (n + size))
            better = x["hit"] & (2 * den * common >= num * (n + size)) & (worse < a["worse"])
            found = F.struct(worse.alias("worse"), (x["i"] - first + 1).alias("places"), first.alias("first"), (x["i"] + 1).alias("last"), n.alias("n"), common.alias("common"))
            return F.struct(n.alias("n"), common.alias("common"), F.when(better, worse).otherwise(a["worse"]).alias("worse"), F.when(better, F.concat(a["out"], F.array(found))).otherwise(a["out"]).alias("out"))

        nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("common"), F.lit(0.0).alias("worse"), F.array().cast(f"array<{_FIND}>").alias("out"))
        return F.aggregate(F.slice(cells, first + 1, span), nothing, step, lambda a: a["out"])

    def stretch(cells: Column, a: Column, k: Column) -> Column:
        own = F.flatten(F.transform(F.filter("t.starts", lambda p: F.floor(p / span) == k), lambda p: windows(cells, p)))

        def sorted_out(all_: Column) -> Column:
            taken = _settled(all_, (k + 1) * span)
            return let(taken, lambda t: F.struct(F.filter(all_, lambda x: ~F.exists(t, lambda y: _overlaps(x, y))).alias("open"), F.concat(a["done"], t).alias("done")))

        return let(F.sort_array(F.concat(a["open"], own)), sorted_out)

    none = F.array().cast(f"array<{_FIND}>")
    stretches = F.array_distinct(F.transform("t.starts", lambda p: F.floor(p / span)))
    finds = let(earlier, lambda cells: F.aggregate(stretches, F.struct(none.alias("open"), none.alias("done")), lambda a, k: stretch(cells, a, k), lambda a: F.concat(a["done"], _settled(a["open"], _OPEN))))
    out = rows.select("doc_id", F.col("t.license").alias("license"), F.explode(finds).alias("f"), size.alias("size"))
    return out.select(
        "doc_id",
        "license",
        (F.col("f.first") + 1).alias("first_word"),
        (F.col("f.last") + 1).alias("last_word"),
        F.col("f.n").alias("n_bigrams"),
        F.col("f.common").alias("n_common"),
        (2 * F.col("f.common") / (F.col("f.n") + F.col("size"))).alias("dice"),
    )


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    known = {k: bigrams(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    clean = F.trim(F.regexp_replace(F.lower("line"), "[^0-9a-z]+", " "))
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    words = lines.select("doc_id", (F.col("at") + 1).alias("line_no"), F.split(clean, " ").alias("words"))
    grams = words.select("doc_id", "line_no", _bigrams(F.col("words")).alias("grams")).withColumn("n_bigrams", F.size("grams")).where("n_bigrams > 0")
    fits = lambda b: _reaches(F.least(F.col("n_bigrams"), F.lit(len(b))), F.col("n_bigrams"), F.lit(len(b)), threshold)
    hits = F.array_compact(
        F.array(
            *(
                F.when(fits(b), F.struct(F.lit(k).alias("license"), F.lit(len(b)).alias("size"), F.size(F.array_intersect("grams", F.lit(b))).alias("n_common")))
                for k, b in known.items()
            )
        )
    )
    dice = 2 * F.col("hit.n_common") / (F.col("n_bigrams") + F.col("hit.size"))
    return (
        grams.select("doc_id", "line_no", "n_bigrams", F.explode(hits).alias("hit"))
        .where(_reaches(F.col("hit.n_common"), F.col("n_bigrams"), F.col("hit.size"), threshold))
        .select("doc_id", "line_no", F.col("hit.license").alias("license"), "n_bigrams", F.col("hit.n_common").alias("n_common"), dice.alias("dice"))
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """``find`` in SQL: all windows within the bounds that match, then the best of those that share words, one after the other."""
    num, den = _exact(threshold)
    rows = ", ".join(f"('{k}', {bounds(v, threshold)[1]}, ['{"', '".join(bigrams(v))}'])" for k, v in TEMPLATES.items())
    return f"""
WITH t(license, span, b) AS (VALUES {rows}),
w AS (SELECT row_number() OVER () AS id, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-z]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT id, doc_id, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] AS g FROM w WHERE len(w) >= 2),
x AS (SELECT id, unnest(g) AS x, generate_subscripts(g, 1) AS p FROM g),
u AS (SELECT license, unnest(b) AS x FROM t),
h AS (SELECT x.id, u.license, x.p FROM x JOIN u USING (x)),
c AS (SELECT a.id, license, a.p AS s, z.p AS e FROM h a JOIN h z USING (id, license) JOIN t USING (license) WHERE z.p BETWEEN a.p AND a.p + span - 1 AND {2 * den - num} * (z.p - a.p + 1) >= {num} * len(b)),
a AS (SELECT c.*, g.doc_id, b, list_distinct(g.g[s : e]) AS a FROM c JOIN g USING (id) JOIN t USING (license)),
d AS (SELECT id, doc_id, license, s, e + 1 AS e, len(b) AS size, len(a) AS n, len(list_intersect(a, b)) AS common FROM a),
m AS (SELECT id, doc_id, license, size, list(struct_pack(s := s, e := e, n := n, common := common) ORDER BY common / (n + size) DESC, e - s, s) AS m FROM d WHERE 2 * {den} * common >= {num} * (n + size) GROUP BY ALL),
f AS (SELECT doc_id, license, size, unnest(list_reduce(m[2:], lambda f, x: CASE WHEN len(list_filter(f, lambda y: y.s <= x.e AND x.s <= y.e)) > 0 THEN f ELSE list_append(f, x) END, [m[1]])) AS f FROM m)
SELECT doc_id, license, CAST(f.s AS INTEGER) AS first_word, CAST(f.e AS INTEGER) AS last_word, CAST(f.n AS INTEGER) AS n_bigrams, CAST(f.common AS INTEGER) AS n_common, CAST(2 * f.common / (f.n + size) AS DOUBLE) AS dice FROM f"""
