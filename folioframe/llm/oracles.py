"""The operators' results in DuckDB's SQL, where SQL can express them. Ids of documents are taken as unique."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: Windows of 100 bytes as hexadecimal strings; all but the first of equal ones remove what they cover.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, base, substr(h, 2 * base + 1, 1198) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99, 500)) AS base FROM d)),
w AS (SELECT doc_id, base + pos AS pos, substr(h, 2 * pos + 1, 200) AS win FROM (SELECT doc_id, base, h, unnest(range(0, len(h) // 2 - 99)) AS pos FROM pieces)),
firsts AS (SELECT win, min(doc_id::HUGEINT * 4294967296 + pos) AS head FROM w GROUP BY win HAVING count(*) > 1),
again AS (SELECT doc_id, pos FROM w JOIN firsts USING (win) WHERE doc_id::HUGEINT * 4294967296 + pos <> head),
marked AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER o <= 100 THEN 0 ELSE 1 END AS opens FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (SELECT doc_id, pos, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
runs AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

#: Windows as words joined by blanks, which no word holds.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM benchmark),
phrases AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM phrases)),
found AS (SELECT doc_id, i, k, item FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM places) JOIN phrases USING (k, phrase)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: The base figures and the conjunction of the cascade's nine rules.
QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORDS}) GROUP BY doc_id),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
f AS (
  SELECT doc_id, text, bare, len(w)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
    (length(bare) - length(translate(bare, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (
  base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_dup_lines * 2 > n_lines
  OR n_repeat_words * 10 > 3 * n_words
  OR length(regexp_replace(bare, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) * 2 > word_chars
  OR length(regexp_replace(bare, '\p{{L}}+', '', 'g')) * 10 > 4 * word_chars
  OR (length(bare) - length(translate(bare, '!?', ''))) * 5 > n_words
  OR (len(regexp_extract_all(text, '(?m)^[ \t]*[-*•]')) + 1) * 10 > 9 * (n_lines + 1)
  OR (len(regexp_extract_all(text, '(?m)(?:\.\.\.|…)[ \t]*$')) + 1) * 10 > 3 * (n_lines + 4)
) AS kept
FROM judged
"""

#: Equal sets are one class; classes meet by their shingles, components follow the links.
JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_WORDS}) AS w FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s FROM d),
classes AS (SELECT s, min(doc_id) AS class, len(s) AS n FROM shingled WHERE len(s) > 0 GROUP BY s),
parts AS (SELECT class, n, unnest(s) AS shingle FROM classes),
links AS (
  SELECT x.class AS a, y.class AS b FROM parts x JOIN parts y ON x.shingle = y.shingle AND x.class <> y.class
  GROUP BY x.class, y.class, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least_reached AS (SELECT a AS class, min(b) AS least_id FROM reached GROUP BY a),
degree AS (SELECT a AS class, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, len(shingled.s)::BIGINT AS n_shingles, coalesce(least(class, least_id), class, doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM shingled LEFT JOIN classes USING (s) LEFT JOIN least_reached USING (class) LEFT JOIN degree USING (class)
"""

#: Texts with one space for each run of white space, grouped.
EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def _least(*options: str) -> str:
    """The least of (cost, audit) structs, some of which may be null."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _edit(state: str, letter: str, cost: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}} END"


#: The four states' least (cost, audit) row by row; the letters of the least audit are then read back with the rows.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE polynomial AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS how
  FROM conversations, polynomial),
damaged AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE how WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
tailed AS (SELECT *, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS tail, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered),
r AS (SELECT *, left(role, 1) AS o, tail = '' AS blank, tail <> '' AND again AS dup, tail <> '' AND NOT again AND tail NOT IN ('.', '!', '?') AS cut FROM tailed),
convs AS (SELECT conv_id, (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c),
walk(conv_id, i, n, v0, v1, v2, v3) AS (
  SELECT conv_id, 0::BIGINT, n, {{'c': 0, 'a': ''}}, NULL::STRUCT(c INTEGER, a VARCHAR), NULL::STRUCT(c INTEGER, a VARCHAR), NULL::STRUCT(c INTEGER, a VARCHAR) FROM convs
  UNION ALL
  SELECT conv_id, i, n, {_edit('v0', 'D', '3')},
    {_least(_edit('v1', 'D', '3'), f"CASE WHEN ok AND o = 's' THEN {_edit('v0', 'K', 'cut')} END")},
    {_least(_edit('u2', 'D', '3'), f"CASE WHEN ok AND o = 'u' THEN {_edit('before', 'K', 'cut')} END", f"CASE WHEN ok THEN {_edit('before', 'R', '(2 + cut)')} END")},
    {_least(_edit('u3', 'D', '3'), f"CASE WHEN ok AND o = 'a' THEN {_edit('u2', 'K', 'cut')} END", f"CASE WHEN ok THEN {_edit('u2', 'R', '(2 + cut)')} END")}
  FROM (SELECT *, {_least('v0', 'v1', 'u3')} AS before FROM (SELECT *, {_least('v3', _edit('u2', 'I', '2'))} AS u3 FROM (
    SELECT w.conv_id, r.i, w.n, v0, v1, v3, NOT (r.blank OR r.dup) AS ok, r.cut::INTEGER AS cut, r.o, {_least('v2', *(_edit(v, 'I', '2') for v in ('v0', 'v1', 'v3')))} AS u2
    FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1)))
),
ended AS (SELECT conv_id, {_least('v0', 'v3', _edit('u2', 'I', '2'))} AS best FROM (SELECT conv_id, v0, v3, {_least('v2', *(_edit(v, 'I', '2') for v in ('v0', 'v1', 'v3')))} AS u2 FROM walk WHERE i = n)),
letters AS (SELECT conv_id, unnest(string_split(best.a, '')) AS e, unnest(range(1, length(best.a) + 1)) AS k FROM ended WHERE best.a <> ''),
placed AS (SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS i FROM letters),
joined AS (SELECT p.conv_id, p.k, p.e, r.role, CASE WHEN p.e = 'I' THEN '' ELSE r.text END AS text, p.e = 'K' AND r.o = 's' AS opens
  FROM placed p LEFT JOIN r ON p.e <> 'I' AND r.conv_id = p.conv_id AND r.i = p.i WHERE p.e <> 'D'),
roles AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) - max(opens::INTEGER) OVER (PARTITION BY conv_id) AS place FROM joined),
bodies AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS body FROM roles GROUP BY conv_id),
pairs AS (SELECT *, lag(o) OVER (PARTITION BY conv_id ORDER BY i) || o AS pair FROM r),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT) AS blank, sum(dup::BIGINT) AS duplicate, sum(cut::BIGINT) AS truncated,
  sum((pair NOT IN ('su', 'ua', 'au'))::BIGINT) AS illegal FROM pairs GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ended LEFT JOIN figures USING (conv_id) LEFT JOIN bodies USING (conv_id)
"""

#: All phrases as strings, counted; parts and longer candidates by joins.
COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS total FROM w GROUP BY lang HAVING sum(len(w)) > 0),
f AS (SELECT lang, phrase, k, count(*) AS n FROM (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)))
  GROUP BY lang, phrase, k HAVING count(*) >= 30),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k, n AS a FROM f WHERE k > 1),
inner_ AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k)) GROUP BY lang, phrase),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, cut, x.n AS l, y.n AS r, (2000000::HUGEINT * a) // (x.n + y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, total AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
