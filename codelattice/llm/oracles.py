"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from .quality import CHAR_LIMIT, CHAR_SLACK, CLASSES, COMMON, LEAST_CHARS, LEAST_WORDS, WORD_LIMIT, WORD_SLACK

_BLANK = r"\x20\x09-\x0D"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_FOLD.format("coalesce(text, '')")}, '[{_BLANK}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept FROM s LEFT JOIN least ON doc_id = x"""


def _quality() -> str:
    dropped = lambda p: f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))"
    classes = ", ".join(dropped(p) for p in CLASSES.values())
    part = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"
    return rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, lang, list_filter(string_split_regex(t, '[{_BLANK}]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS l,
  list_filter(string_split_regex(lower(t), '[^\p{{L}}]+'), lambda x: x <> '') AS p, length(t) - ({dropped(f"[{_BLANK}]+")}) AS word_chars, {dropped("[#*$%&|<>]+")} AS n_symbols, [{classes}] AS c FROM d),
drawn AS (SELECT b.lang, p FROM b JOIN documents d ON d.doc_id = b.doc_id WHERE b.lang IS NOT NULL AND d.text IS NOT NULL),
top AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM (SELECT lang, unnest(p) AS word FROM drawn) GROUP BY lang, word QUALIFY place <= {COMMON}),
wl AS (SELECT coalesce(list(word ORDER BY first_at), []) AS cw FROM (SELECT word, min((lang, place)) AS first_at FROM top GROUP BY word)),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) AS s FROM b WHERE len(w) > 2),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
f AS (SELECT b.doc_id, lang, len(w) AS n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  list_append(c, greatest(word_chars - list_sum(c), 0)) AS ch, list_append(list_transform(cw, lambda x: len(list_filter(p, lambda y: y = x))), len(list_filter(p, lambda y: NOT list_contains(cw, y)))) AS co FROM b CROSS JOIN wl LEFT JOIN cov ON b.doc_id = cov.doc_id),
u AS (SELECT doc_id, lang, 'ch' AS kind, unnest(range(1, len(ch) + 1)) AS i, unnest(ch) AS k, list_sum(ch) AS total FROM f UNION ALL SELECT doc_id, lang, 'co', unnest(range(1, len(co) + 1)), unnest(co), list_sum(co) FROM f),
ref AS (SELECT lang AS rl, kind, i, sum(k) / sum(sum(k)) OVER (PARTITION BY lang, kind) AS q FROM u WHERE lang IS NOT NULL GROUP BY lang, kind, i),
js AS (SELECT doc_id, rl, u.kind, any_value(total) AS total, round(sqrt(greatest(0, sum({part('(k / total)', 'q')} + {part('q', '(k / total)')}) / 2)), 6) AS dist FROM u JOIN ref ON u.kind = ref.kind AND u.i = ref.i WHERE total > 0 GROUP BY doc_id, rl, u.kind),
two AS (SELECT f.doc_id, l.rl, list_sum(ch) AS nc, list_sum(co) AS np, CASE WHEN list_sum(ch) < {LEAST_CHARS} THEN 0.0::DOUBLE ELSE a.dist END AS a, CASE WHEN list_sum(co) < {LEAST_WORDS} THEN 0.0::DOUBLE ELSE z.dist END AS z
  FROM f CROSS JOIN (SELECT DISTINCT rl FROM ref) l LEFT JOIN js a ON a.doc_id = f.doc_id AND a.rl = l.rl AND a.kind = 'ch' LEFT JOIN js z ON z.doc_id = f.doc_id AND z.rl = l.rl AND z.kind = 'co'),
o AS (SELECT *, greatest(a - {CHAR_LIMIT}::DOUBLE - {CHAR_SLACK}::DOUBLE / sqrt(greatest(nc, 1)), z - {WORD_LIMIT}::DOUBLE - {WORD_SLACK}::DOUBLE / sqrt(greatest(np, 1))) AS over FROM two),
near AS (SELECT doc_id, arg_min(a, (over, a, z)) AS char_distance, arg_min(z, (over, a, z)) AS word_distance, min(over) AS over FROM o GROUP BY doc_id)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND over <= 0 AS kept, char_distance, word_distance FROM f JOIN near ON f.doc_id = near.doc_id"""


QUALITY = _quality()

_RENDER = "array_to_string(list_transform({}, lambda x: '<|turn|>' || x.role || chr(10) || x.text || '<|end|>' || chr(10)), '')"


def _mask(t: str) -> str:
    before = f"length({_RENDER.format(f'list_slice({t}, 1, i - 1)')})"
    start = f"{before} + length('<|turn|>' || {t}[i].role || chr(10))"
    end = f"length({_RENDER.format(f'list_slice({t}, 1, i)')})"
    return f"array_to_string(list_transform(list_filter(range(1, len({t}) + 1), lambda i: {t}[i].role = 'assistant'), lambda i: CAST({start} AS VARCHAR) || ':' || CAST({end} AS VARCHAR)), ' ')"


_TEXT = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_ROLE = _TEXT.format(r"replace(replace(coalesce(role, 'unknown'), '\', '\\'), chr(10), '\n')")
_SAID = _TEXT.format("coalesce(text, '')")
PREFERENCES = f"""WITH c AS (SELECT conv_id, list(struct_pack(role := {_ROLE}, text := {_SAID}) ORDER BY turn, {_ROLE}, {_SAID}) AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id),
l AS (SELECT *, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) AS last FROM c),
p AS (SELECT a.conv_id, a.t AS a, list_concat(list_slice(a.t, 1, coalesce(a.last - 1, len(a.t))), CASE WHEN z.last IS NULL THEN [] ELSE [z.t[z.last]] END) AS b FROM l a LEFT JOIN l z ON z.conv_id = xor(a.conv_id, 1)),
n AS (SELECT *, coalesce(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])[1] - 1, len(a)) AS k FROM p),
q AS (SELECT conv_id, k, list_slice(a, 1, k) AS h, list_slice(a, k + 1, len(a)) AS a, list_slice(b, k + 1, len(b)) AS b FROM n)
SELECT conv_id AS pair_id, CAST(k AS BIGINT) AS n_common, coalesce({_RENDER.format("h")}, '') AS prompt, coalesce({_RENDER.format("a")}, '') AS chosen, coalesce({_RENDER.format("b")}, '') AS rejected,
  coalesce({_mask("a")}, '') AS chosen_mask, coalesce({_mask("b")}, '') AS rejected_mask, coalesce(len(a), 0) > 0 AND coalesce(len(b), 0) > 0 AS contrast FROM q"""

_H = "('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR)), {}, 8))::BIGINT"
INFILLING = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+') AS u,
  {_H.format(1)} AS h1, {_H.format(9)} AS h2, {_H.format(17)} AS h3, {_H.format(25)} AS h4 FROM documents),
f AS (SELECT *, len(u) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM f),
p AS (SELECT *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS x, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS y, coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

NEGATIVES = """WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT ar, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, k ORDER BY s.score DESC, s.id) AS place
  FROM p JOIN s ON s.ar = p.ar AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY place <= 3)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n"""

ORACLES = {"op6_preference_format": PREFERENCES, "op9_minhash_near_dedup": NEAR_DUPLICATES, "op10_quality_rules": QUALITY, "op11_fill_in_middle": INFILLING, "op12_hard_negatives": NEGATIVES}
