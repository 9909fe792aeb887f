"""SQL that gives the rows of those operators that SQL can express, from the tables alone."""

from __future__ import annotations

from retort.llm.chat import CLOSE, FINISH, HEAD, NEXT, OPEN
from retort.llm.quality import (
    _WORDS,
    CLASS_DEVIATIONS,
    CLASS_STEPS,
    CLASSES,
    COMMON_WORDS,
    LEAST_DOCUMENTS,
    MAX_CLASS_DISTANCE,
    MAX_WORD_DISTANCE,
    MIN_WORDS,
    NOISE,
    WORD_DEVIATIONS,
    WORD_STEPS,
)

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.node
"""


def _f(x: float) -> str:
    """A literal that DuckDB reads as this very double."""
    return f"{x!r}e0"


def _quality() -> str:
    words = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"
    chars = {k: v.replace("'", "''") for k, v in CLASSES.items()}
    counts = ", ".join(f"length(regexp_replace(t, '[^{c}]+', '', 'g'))::BIGINT AS {n}" for n, c in chars.items())
    classes = ", ".join(CLASSES)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, lang, w, len(w)::BIGINT AS n, length(array_to_string(w, ''))::BIGINT AS chars, {counts},
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, list_transform({words}, lambda c: len(list_filter(w, lambda x: x = c))::DOUBLE) AS common FROM d),
v AS (SELECT doc_id, unnest(range(1, n - 6)) AS i, unnest(list_transform(range(1, n - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM f WHERE n >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM v) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, nxt - i))::BIGINT AS n FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 8) AS nxt FROM twice) GROUP BY 1),
h AS (SELECT doc_id, lang, n, [{classes}, greatest(chars - ({" + ".join(CLASSES)}), 0)]::DOUBLE[] AS k, list_append(common, greatest(n - list_sum(common), 0.0)) AS m FROM f),
long AS (SELECT doc_id, lang, 'c' AS kind, generate_subscripts(k, 1) AS i, unnest(k) AS x FROM h UNION ALL SELECT doc_id, lang, 'w', generate_subscripts(m, 1), unnest(m) FROM h),
ref AS (SELECT lang, kind, i, sum(x) / sum(sum(x)) OVER (PARTITION BY lang, kind) AS q FROM long WHERE lang IN ({", ".join(f"'{x}'" for x in COMMON_WORDS)}) GROUP BY lang, kind, i),
share AS (SELECT doc_id, lang, kind, i, x / nullif(sum(x) OVER (PARTITION BY doc_id, kind), 0) AS p FROM long),
js AS (SELECT doc_id, share.lang AS own, ref.lang, share.kind, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6) AS far
       FROM share JOIN ref ON share.kind = ref.kind AND share.i = ref.i WHERE p IS NOT NULL GROUP BY doc_id, share.lang, ref.lang, share.kind),
far AS (SELECT doc_id, kind, coalesce(max(js.far) FILTER (WHERE own = lang), min(js.far)) AS far FROM js GROUP BY doc_id, kind),
j AS (SELECT f.doc_id, f.lang, f.n AS n_words, chars AS word_chars, symbol AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, c.far AS class_distance, w.far AS word_distance,
        CASE WHEN f.lang IN (SELECT lang FROM ref) THEN f.lang ELSE '' END AS g, length(bin(greatest(f.n, 1))) - 1 AS len
      FROM f LEFT JOIN rep ON f.doc_id = rep.doc_id LEFT JOIN far c ON f.doc_id = c.doc_id AND c.kind = 'c' LEFT JOIN far w ON f.doc_id = w.doc_id AND w.kind = 'w'),
u AS (SELECT DISTINCT g, len, n_words AS n, class_distance AS c, word_distance AS w FROM j WHERE n_words >= {MIN_WORDS}),
x AS (SELECT g, len, 'c' AS kind, floor(c * {_f(CLASS_STEPS)} + 0.5e0)::BIGINT AS x FROM u WHERE c IS NOT NULL UNION ALL SELECT g, len, 'w', floor(w * sqrt(n::DOUBLE) * {_f(WORD_STEPS)} + 0.5e0)::BIGINT FROM u WHERE w IS NOT NULL),
seen AS (SELECT g, len, kind, x, sum(count(*)) OVER (PARTITION BY g, len, kind ORDER BY x) AS seen, sum(count(*)) OVER (PARTITION BY g, len, kind) AS total FROM x GROUP BY g, len, kind, x),
spread AS (SELECT g, len, kind, (min(x) FILTER (WHERE 2 * seen >= total))::DOUBLE AS mid, (min(x) FILTER (WHERE 4 * seen >= total))::DOUBLE AS low, max(total) AS n FROM seen GROUP BY g, len, kind),
lim AS (SELECT g, len, c.mid / {_f(CLASS_STEPS)} AS c0, {_f(CLASS_DEVIATIONS)} * ((c.mid / {_f(CLASS_STEPS)} - c.low / {_f(CLASS_STEPS)}) / 0.6745e0) AS c1,
               w.mid / {_f(WORD_STEPS)} + {_f(WORD_DEVIATIONS)} * greatest((w.mid / {_f(WORD_STEPS)} - w.low / {_f(WORD_STEPS)}) / 0.6745e0, {_f(NOISE)}) AS w0
        FROM spread c JOIN spread w USING (g, len) WHERE c.kind = 'c' AND w.kind = 'w' AND least(c.n, w.n) >= {LEAST_DOCUMENTS}),
most AS (SELECT j.*, coalesce(least(c0 + greatest(c1, {_f(CLASS_DEVIATIONS * NOISE)} / sqrt(n_words::DOUBLE)), {_f(MAX_CLASS_DISTANCE)}), {_f(MAX_CLASS_DISTANCE)}) AS most_c,
                coalesce(least(w0 / sqrt(least(n_words::DOUBLE, pow(2.0e0, lim.len + 1))), {_f(MAX_WORD_DISTANCE)}), {_f(MAX_WORD_DISTANCE)}) AS most_w
         FROM j ASOF LEFT JOIN lim ON j.g = lim.g AND j.len >= lim.len)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words >= {MIN_WORDS} AND (coalesce(class_distance, 0) > most_c OR coalesce(word_distance, 0) > most_w)) AS kept, class_distance, word_distance FROM most
"""


CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS escaped,
             length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) AS named FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(escaped + CASE WHEN opens THEN named + {len(OPEN) + len(HEAD) + len(CLOSE)} ELSE {len(NEXT)} END) + {len(FINISH)})::BIGINT AS formatted_chars, count(*) FILTER (WHERE opens) AS n_blocks
FROM b GROUP BY conv_id
"""

ORACLES = {"op1_minhash_dedup": NEAR_DUPLICATES, "op2_distribution_quality": _quality(), "op7_chat_format": CHAT}
