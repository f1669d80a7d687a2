"""Registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from clausewright.llm.ann import op1_ann
from clausewright.llm.bpe import op7_bpe
from clausewright.llm.centroids import LARGEST, op11_centroids
from clausewright.llm.langid import op9_langid
from clausewright.llm.licence_texts import NOTICES, SPELLINGS, TEXTS
from clausewright.llm.licences import COPYRIGHT, PUNCTUATION, RIGHTS, op3_licences
from clausewright.llm.lm import op2_lm_score
from clausewright.llm.mixing import op6_mixing
from clausewright.llm.near_dup import op4_near_dup
from clausewright.llm.pii import op8_pii
from clausewright.llm.quality_rules import BULLET, ELLIPSIS, LETTER, MAX_REPEATED_PERCENT, MIN_WORDS, OTHER_SCRIPT, RULES, STOP_WORDS, UPPER, op10_quality_rules
from clausewright.llm.resample import BUCKETS, DRAWN_PERCENT, LEAST_WORDS, TABLE, op13_resample
from clausewright.llm.simhash import op12_simhash
from clausewright.llm.site_quality import op5_site_quality

QUERIES = {
    "op1_ann": op1_ann,
    "op2_lm_score": op2_lm_score,
    "op3_licences": op3_licences,
    "op4_near_dup": op4_near_dup,
    "op5_site_quality": op5_site_quality,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_langid": op9_langid,
    "op10_quality_rules": op10_quality_rules,
    "op11_centroids": op11_centroids,
    "op12_simhash": op12_simhash,
    "op13_resample": op13_resample,
}

_STOPS = ", ".join(f"'{x}'" for w in dict.fromkeys(STOP_WORDS) for x in dict.fromkeys((w, w.capitalize())))
_VERDICT = " AND ".join([f"coalesce({m} >= {a}, true)" for m, a, _ in RULES if a is not None] + [f"coalesce({m} <= {b}, true)" for m, _, b in RULES if b is not None])



def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:

    def spelt(t: str) -> str:
        t = f"' ' || replace(replace({t}, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' '"
        for a, b in SPELLINGS:
            t = f"replace({t}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"

    rows = lambda known: ", ".join(f"({_literal(k)}, {_literal(t)})" for k, t in known)
    line = lambda pattern: pattern.replace("(?md)", "(?m)")
    return rf"""
WITH src AS (SELECT 'd' AS kind, doc_id, CAST(NULL AS VARCHAR) AS license, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'k', NULL, l, t FROM (VALUES {rows(TEXTS)}) AS k(l, t) UNION ALL SELECT 'n', NULL, l, t FROM (VALUES {rows(NOTICES)}) AS n(l, t)),
cut AS (SELECT kind, doc_id, license, regexp_replace(regexp_replace(regexp_replace(lower(text), '{line(COPYRIGHT)}', '', 'g'), '{line(RIGHTS)}', '', 'g'), '{PUNCTUATION}', ' ', 'g') AS t FROM src),
lines AS (SELECT kind, doc_id, license, list_filter(list_transform(string_split({spelt('t')}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM cut),
whole AS (SELECT kind, doc_id, license, lines, sha256({spelt("array_to_string(lines, ' ')")}) AS digest FROM lines),
known AS (SELECT digest, min(license) AS license FROM whole WHERE kind = 'k' GROUP BY digest),
named AS (SELECT DISTINCT array_to_string(lines, ' ') AS line, license FROM whole WHERE kind = 'n'),
hits AS (SELECT u.doc_id, string_agg(DISTINCT n.license, ',' ORDER BY n.license) AS notices FROM (SELECT doc_id, unnest(lines) AS line FROM whole WHERE kind = 'd') u JOIN named n ON n.line = u.line GROUP BY u.doc_id)
SELECT w.doc_id AS doc_id, w.digest AS digest, k.license AS license, coalesce(h.notices, '') AS notices FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN hits h ON h.doc_id = w.doc_id WHERE w.kind = 'd'
"""


def _centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> str:
    """Distances to all centroids in each round, vectors and centroids as rows of one component."""
    steps = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(greatest({-LARGEST}, least({LARGEST}, floor({scale} * CAST(x AS DOUBLE)))) AS BIGINT)) AS c
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
e AS MATERIALIZED (SELECT r, unnest(c) AS x, unnest(range({dims})) AS j FROM kept),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, c) - 1 AS k FROM kept),
m0 AS MATERIALIZED (SELECT k, j, x FROM first JOIN e ON e.r = first.r WHERE k < {k})"""
    for i in range(rounds + 1):
        steps += f""",
d{i} AS (SELECT e.r AS r, m.k AS k, sum((e.x - m.x) * (e.x - m.x)) AS d FROM e JOIN m{i} m ON m.j = e.j GROUP BY e.r, m.k),
a{i} AS MATERIALIZED (SELECT r, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1),
s{i} AS (SELECT a.k AS k, e.j AS j, sum(e.x) AS s, count(*) AS n FROM a{i} a JOIN e ON e.r = a.r GROUP BY a.k, e.j),
m{i + 1} AS MATERIALIZED (SELECT m.k AS k, m.j AS j, CASE WHEN s.n IS NULL THEN m.x ELSE CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT) END AS x FROM m{i} m LEFT JOIN s{i} s ON s.k = m.k AND s.j = m.j)"""
    return f"""{steps},
named AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS digest FROM m{rounds} GROUP BY k)
SELECT v.vec_id AS vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, n.digest AS centroid_sha256
FROM a{rounds} a JOIN kept v ON v.r = a.r JOIN named n ON n.k = a.k
"""


def _resample_sql() -> str:
    """The CRC byte by byte, as a fold over a feature's bytes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH src AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT kind, r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM src),
f AS MATERIALIZED (SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
h AS MATERIALIZED (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM f)),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(0, length(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT)),
  lambda a, x: xor(a >> 8, {TABLE[0].tolist()}[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS b FROM h),
n AS (SELECT b.b AS b, CAST(count(*) FILTER (WHERE kind = 'd') AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE kind = 'b') AS DOUBLE) AS t FROM f JOIN b ON b.f = f.f GROUP BY b.b),
g AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM n) + {BUCKETS})))) AS BIGINT) AS gain FROM n),
v AS (SELECT f.r AS r, sum(g.gain) AS weight FROM f JOIN b ON b.f = f.f JOIN g ON g.b = b.b WHERE kind = 'd' GROUP BY f.r),
x AS (SELECT w.doc_id AS doc_id, len(w.w) AS words, CAST(len(w.w) + greatest(len(w.w) - 1, 0) + greatest(len(w.w) - 2, 0) AS BIGINT) AS n_features, CAST(coalesce(v.weight, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN v ON v.r = w.r WHERE w.kind = 'd'),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score, words >= {LEAST_WORDS} AS fit FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id, n_features, weight) AS place, count(*) OVER (PARTITION BY fit) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {DRAWN_PERCENT} * n // 100 THEN place END AS rank FROM z
"""


ORACLE_SQL = {
    "op13_resample": _resample_sql(),
    "op11_centroids": _centroid_sql(),
    "op3_licences": _licence_sql(),
    "op10_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w),
k AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(w, lambda x: list_contains([{_STOPS}], x))) AS stops, len(list_filter(w, lambda x: regexp_matches(x, '{LETTER}'))) AS alpha_words,
             length(t) - length(regexp_replace(t, '{LETTER}', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '{UPPER}', '', 'g')) AS uppers, length(t) - length(regexp_replace(t, '{OTHER_SCRIPT}', '', 'g')) AS others,
             len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}'))) AS bullets, len(list_filter(lines, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS ellipses
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
             CASE WHEN 2 * others > letters THEN NULL WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_share,
             CASE WHEN n_words > 0 THEN alpha_words / n_words ELSE 0 END AS alpha_word_share, CASE WHEN word_chars > 0 THEN letters / word_chars ELSE 0 END AS letter_share,
             CASE WHEN letters > 0 THEN uppers / letters ELSE 0 END AS upper_share, CASE WHEN n_lines > 0 THEN bullets / n_lines ELSE 0 END AS bullet_line_share,
             CASE WHEN n_lines > 0 THEN ellipses / n_lines ELSE 0 END AS ellipsis_line_share FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_VERDICT} AS kept FROM v
""",
}
