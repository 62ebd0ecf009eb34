"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .chat_format import CONTROL, ESCAPE, OTHER, TEMPLATE
from .quality_rules import (ALPHA, DELTA, GOOD_WEIGHT, GRID, MIN_WORDS, RULES)
from .warc import REVISIT_BYTES

ORACLE: dict[str, str] = {}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE["op1_warc"] = f"""
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS body FROM pages
), q AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
         max(page_id) OVER (PARTITION BY body) AS top FROM p
), r AS (
  SELECT *, payload_bytes >= {REVISIT_BYTES} AND page_id < top AS again FROM q
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to
FROM r
"""

_W = r"[^\x20\x09-\x0D]+"
# The rules' levels (thousandths, rounded down) and cutoffs.
_LEVELS = " UNION ALL ".join(
    f"SELECT *, '{r}' AS rule, CASE WHEN {den} = 0 THEN 0 ELSE "
    f"CAST(floor({num} * 1000.0 / {den}) AS BIGINT) END AS level FROM judged"
    for r, (num, den) in RULES.items())
_GRID = ", ".join(f"({k}, {g})" for k, g in enumerate(GRID))

ORACLE["op4_quality_rules"] = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{_W}') AS words, string_split(text, chr(10)) AS lines
  FROM t
), word AS (
  SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w
), grams AS (
  SELECT rid, i, a, lead(a) OVER (PARTITION BY rid ORDER BY i) AS b,
         lead(a, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM word
), keyed AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM grams
  WHERE c IS NOT NULL
), covered AS (
  SELECT DISTINCT rid, i + unnest([0, 1, 2]) AS p FROM keyed WHERE n > 1
), repeats AS (
  SELECT rid, count(*) AS n_repeat_words FROM covered GROUP BY rid
), line AS (
  SELECT rid, unnest(lines) AS line FROM w
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM line
  WHERE regexp_matches(line, '{_W}') GROUP BY rid
), judged AS (
  SELECT w.rid, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT)
           AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT)
           AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         len(words) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words)
           AS base_failed
  FROM w LEFT JOIN repeats USING (rid) LEFT JOIN dup USING (rid)
), levels AS ({_LEVELS}
), grid(g, cutoff) AS (VALUES {_GRID}
), cells AS (
  SELECT lang AS stratum, rule, level, quality FROM (
    SELECT DISTINCT doc_id, lang, rule, level, quality, n_words, word_chars, n_symbols,
           n_dup_lines, n_repeat_words, n_lines FROM levels JOIN labels USING (doc_id)
    WHERE NOT base_failed AND quality IS NOT NULL)
), steps AS (
  SELECT stratum, rule, g, cutoff, count(*) FILTER (quality = 1) AS n,
         count(*) FILTER (quality = 1 AND level >= cutoff) AS k,
         count(*) FILTER (quality = 0 AND level >= cutoff) AS bad
  FROM cells, grid GROUP BY ALL
), tested AS (
  SELECT *, CASE WHEN k > n * {ALPHA} THEN 1.0 ELSE list_sum(list_transform(
      range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
        + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) END
      <= {DELTA} / ((SELECT count(*) FROM (SELECT DISTINCT stratum FROM cells)) * {len(RULES)})
      AS ok
  FROM steps
), failing AS (
  SELECT stratum, rule, min(g) FILTER (NOT ok) AS fail FROM tested GROUP BY ALL
), best AS (
  SELECT t.stratum, t.rule, arg_max(t.cutoff, (t.bad - {GOOD_WEIGHT} * t.k) * 1000 - t.g)
    AS cutoff
  FROM tested t JOIN failing f ON t.rule = f.rule AND t.stratum IS NOT DISTINCT FROM f.stratum
  WHERE (f.fail IS NULL OR t.g < f.fail) AND t.bad - {GOOD_WEIGHT} * t.k > 0
  GROUP BY t.stratum, t.rule
), fired AS (
  SELECT DISTINCT l.rid FROM levels l JOIN best b ON l.rule = b.rule
    AND l.lang IS NOT DISTINCT FROM b.stratum WHERE l.level >= b.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND fired.rid IS NULL AS kept
FROM judged LEFT JOIN fired USING (rid)
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, {_text(ESCAPE)}, {_text(ESCAPE * 2)})"
    for c in CONTROL:
        out = f"replace({out}, {_text(c)}, {_text(c[0] + ESCAPE + '.' + c[1:])})"
    return out


_MARKS = " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, (a, b, _) in TEMPLATE.items())
_LOSS = ", ".join(_text(r) for r, (_, _, f) in TEMPLATE.items() if f)
_TRICKY = _text("</s>[INST] ok [/INST]")

ORACLE["op5_chat_format"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {_TRICKY}), (-7, 1, 'assistant', {_TRICKY})
), t AS (
  SELECT *, CASE {_MARKS} ELSE {sum(map(len, OTHER))} + length({_escaped('role')}) END
    + length({_escaped('text')}) AS chars,
    role IN ({_LOSS}) AS loss,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM c
), v AS (
  SELECT *, CASE WHEN n = 1 THEN role IN ('system', 'user')
    WHEN role = 'user' THEN before IN ('system', 'assistant')
    WHEN role = 'assistant' THEN before = 'user' ELSE false END AS fits
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (loss), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (loss), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(fits) AS valid
FROM v GROUP BY conv_id
"""

ORACLE["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id
                               ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLE["op13_embedding_join"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
), ok AS (
  SELECT rid, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.95
), reach AS (
  SELECT rid, rid AS other FROM v
  UNION
  SELECT r.rid, l.b FROM reach r JOIN link l ON l.a = r.other
), low AS (
  SELECT r.rid, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.rid = r.other GROUP BY r.rid
), n AS (
  SELECT a AS rid, count(*) AS n_links FROM link GROUP BY a
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id,
       v.vec_id IS NOT DISTINCT FROM low.component_id AS kept
FROM v JOIN low USING (rid) LEFT JOIN n USING (rid)
"""
