"""SQL that gives the same rows as the text operators' queries."""

from __future__ import annotations

from .decontaminate import NEAR_SLOP, NEAR_WORDS
from .decontaminate import WINDOW as ITEM_WORDS
from .quality import GRAM_LIMITS, LINE_CHAR_LIMIT, MIN_WORDS
from .substrings import WINDOW

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPLIT = r"""docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), listed AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs
), words AS (
  SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed
)"""


def _grams(n: int) -> str:
    """Words inside n-grams that a row has more than once."""
    ahead = f"ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING"
    return f"""seq{n} AS (SELECT r, i, w, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i {ahead}) AS g, count(*) OVER (PARTITION BY r ORDER BY i {ahead}) AS k FROM words),
rep{n} AS (SELECT r, i, w, CASE WHEN k = {n} AND count(*) OVER (PARTITION BY r, g, k) > 1 THEN 1 ELSE 0 END AS again FROM seq{n}),
in{n} AS (SELECT r, count(*) FILTER (WHERE hit = 1) AS n_words, coalesce(sum(length(w)) FILTER (WHERE hit = 1), 0) AS chars FROM (SELECT r, w, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM rep{n}) GROUP BY r)"""


_limits = " AND ".join(f"coalesce(in{n}.chars, 0) <= {limit}::DOUBLE * word_chars" for n, limit in GRAM_LIMITS.items())
QUALITY = f"""WITH {_SPLIT},
{", ".join(_grams(n) for n in (3, *GRAM_LIMITS))},
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
dups AS (SELECT r, count(*) FILTER (WHERE nth > 1) AS n, coalesce(sum(length(line)) FILTER (WHERE nth > 1), 0) AS chars, sum(length(line)) AS every
  FROM (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) GROUP BY r),
base AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM listed
)
SELECT doc_id, base.n_words, word_chars, n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(in3.n_words, 0)::BIGINT AS n_repeat_words,
  base.n_words < {MIN_WORDS} OR 100 * coalesce(in3.n_words, 0) > 50 * base.n_words AS base_failed,
  NOT (base.n_words < {MIN_WORDS} OR 100 * coalesce(in3.n_words, 0) > 50 * base.n_words) AND {_limits} AND coalesce(dups.chars, 0) <= {LINE_CHAR_LIMIT}::DOUBLE * coalesce(dups.every, 0) AS kept,
  {", ".join(f"coalesce(in{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in GRAM_LIMITS)}, coalesce(dups.chars, 0)::BIGINT AS dup_line_chars
FROM base LEFT JOIN dups USING (r) {" ".join(f"LEFT JOIN in{n} ON in{n}.r = base.r" for n in (3, *GRAM_LIMITS))}"""

_ahead = f"ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING"
REPEATS = f"""WITH {_SPLIT},
spans AS (SELECT r, doc_id, i, md5(string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i {_ahead})) AS g, count(*) OVER (PARTITION BY r ORDER BY i {_ahead}) AS k FROM words),
firsts AS (SELECT r, i, CASE WHEN k = {WINDOW} AND min(doc_id) OVER (PARTITION BY g, k) < doc_id THEN 1 ELSE 0 END AS again FROM spans),
gone AS (SELECT r, i, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM firsts),
kept AS (SELECT r, sum(hit) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE hit = 0) AS kept FROM gone JOIN words USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM listed LEFT JOIN kept USING (r)"""

_token = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_window = f"ROWS BETWEEN CURRENT ROW AND {ITEM_WORDS - 1} FOLLOWING"


def _spans(source: str, key: str) -> str:
    return f"SELECT {key}, i, n, string_agg(w, ' ') OVER (PARTITION BY {key} ORDER BY i {_window}) AS g, count(*) OVER (PARTITION BY {key} ORDER BY i {_window}) AS k FROM {source}"


#: Items of fewer words than a window are compared with all spans of their length.
DECONTAMINATION = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_token} AS ws FROM documents),
items AS (SELECT row_number() OVER () AS b, item_id, {_token} AS ws FROM benchmark),
iw AS (SELECT b, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM items),
windows AS (SELECT DISTINCT item_id, g, k FROM ({_spans("iw", "b")}) JOIN items USING (b) WHERE k = least(n, {ITEM_WORDS})),
sizes AS (SELECT DISTINCT k FROM windows),
dw AS (SELECT r, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM docs),
spans AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM dw JOIN sizes ON i + k - 1 <= n),
hits AS (SELECT r, i, k, item_id FROM spans JOIN windows USING (g, k)),
covered AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS x FROM hits) GROUP BY r),
placed AS (SELECT b, i AS s, i - s0 AS j, w FROM iw JOIN (SELECT b AS b0, i AS s0 FROM iw WHERE n - i >= {ITEM_WORDS - 1}) ON b = b0 AND i BETWEEN s0 AND s0 + {ITEM_WORDS - 1}),
met AS (SELECT r, b, s - j AS first, j, unnest(range(p - j - {NEAR_SLOP}, p - j + {NEAR_SLOP + 1})) AS begin FROM placed JOIN (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs) USING (w)),
near AS (SELECT r, count(DISTINCT coalesce(item_id::VARCHAR, 'null')) AS n_near FROM (SELECT r, b FROM met GROUP BY r, b, first, begin HAVING count(DISTINCT j) >= {NEAR_WORDS}) JOIN items USING (b) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT coalesce(item_id::VARCHAR, 'null'))) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r) LEFT JOIN near USING (r)"""

QUOTATIONS = r"""WITH RECURSIVE msgs AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), cut AS (
  SELECT r, conv_id, turn, i, line, length(regexp_replace(regexp_extract(line, '^\s*((?:>\s*)+)', 1), '[^>]', '', 'g')) AS level
  FROM (SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM msgs)
), said AS (
  SELECT r, conv_id, turn, i, level, CASE WHEN level > 0 THEN regexp_replace(line, '^\s*((?:>\s*)+)', '') ELSE line END AS line FROM cut
), bodies AS (
  SELECT r, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g') AS body FROM said GROUP BY r
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY r ORDER BY i) IS NOT DISTINCT FROM level THEN 0 ELSE 1 END AS new FROM said)
), quotes AS (
  SELECT r, conv_id, turn, level, trim(regexp_replace(lower(string_agg(line, chr(10) ORDER BY i)), '[^\p{L}\p{N}]+', ' ', 'g')) AS passage FROM runs WHERE level > 0 GROUP BY r, conv_id, turn, level, run
), told AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) AS passage FROM (
    SELECT r, body AS p FROM bodies UNION ALL SELECT r, unnest(string_split(body, chr(10))) FROM bodies) JOIN msgs USING (r) WHERE turn IS NOT NULL
), first AS (
  SELECT conv_id, passage, min(turn) AS original FROM told WHERE passage <> '' GROUP BY conv_id, passage
), links AS (
  SELECT r, count(*) AS n_linked, coalesce(max(original) FILTER (WHERE level = 1), max(original)) AS reply_to FROM quotes JOIN first USING (conv_id, passage) WHERE original < turn GROUP BY r
), up AS (
  SELECT conv_id, turn, max(reply_to) AS up FROM links JOIN msgs USING (r) GROUP BY conv_id, turn
), climb AS (
  SELECT conv_id, turn, up AS goal FROM up
  UNION ALL SELECT c.conv_id, c.turn, u.up FROM climb c JOIN up u ON u.conv_id = c.conv_id AND u.turn = c.goal
), roots AS (
  SELECT conv_id, turn, min(goal) AS root FROM climb GROUP BY conv_id, turn
)
SELECT m.conv_id, m.turn, role, reply_to, coalesce(root, m.turn) AS thread, coalesce(q.n, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked,
  '<|' || coalesce(role, '') || '|>' || chr(10) || body AS formatted
FROM msgs m JOIN bodies USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM quotes GROUP BY r) q USING (r) LEFT JOIN links USING (r) LEFT JOIN roots ON roots.conv_id = m.conv_id AND roots.turn = m.turn"""
