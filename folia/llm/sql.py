"""SQL of the operators that SQL can express, for the check of their rows."""

from __future__ import annotations


def _field(expr: str) -> str:
    return f"coalesce(strlen({expr})::varchar || ':' || {expr}, '-')"


def _leaf(*exprs: str) -> str:
    return "sha256(" + " || ".join(map(_field, exprs)) + ")"


#: Unsigned CRC-32 of doc_id in decimals, bit by bit.
CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(8 * strlen(coalesce(doc_id::varchar, ''))),
      lambda i: ((ascii(substr(doc_id::varchar, (i // 8 + 1)::int, 1))::bigint >> (i % 8)::int) & 1)::bigint)),
      lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""

MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS c FROM (
    SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf('doc_id::varchar', 'source', 'lang', 'n_chars::varchar', 'text')} AS leaf,
      CASE WHEN {CRC} % 2 = 0 THEN {_leaf('doc_id::varchar', 'source', 'lang', 'n_chars::varchar', "replace(text, chr(10), '')")} ELSE leaf END AS altered
    FROM documents)),
n(g, lvl, pos, node, c) AS (
  SELECT g, 0, pos, leaf, c FROM d
  UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (c + 2) // 3 FROM n WHERE c > 1 GROUP BY g, lvl, pos // 3, c),
s AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS spos, count(*) OVER () AS c FROM n WHERE c = 1),
u(lvl, pos, node, c) AS (
  SELECT 0, spos, subroot, c FROM s
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (c + 2) // 3 FROM u WHERE c > 1 GROUP BY lvl, pos // 3, c),
f(g, pos, lvl, ix, node) AS (
  SELECT g, pos, 0, pos, altered FROM d
  UNION ALL SELECT f.g, f.pos, f.lvl + 1, f.ix // 3, sha256(string_agg(CASE WHEN n.pos = f.ix THEN f.node ELSE n.node END, '' ORDER BY n.pos))
    FROM f JOIN n ON n.g = f.g AND n.lvl = f.lvl AND n.pos // 3 = f.ix // 3 AND n.c > 1 GROUP BY f.g, f.pos, f.lvl, f.ix // 3),
e(g, pos, lvl, ix, node) AS (
  SELECT g, pos, 0, spos, arg_max(node, lvl) FROM f JOIN s USING (g) GROUP BY g, pos, spos
  UNION ALL SELECT e.g, e.pos, e.lvl + 1, e.ix // 3, sha256(string_agg(CASE WHEN u.pos = e.ix THEN e.node ELSE u.node END, '' ORDER BY u.pos))
    FROM e JOIN u ON u.lvl = e.lvl AND u.pos // 3 = e.ix // 3 AND u.c > 1 GROUP BY e.g, e.pos, e.lvl, e.ix // 3),
p AS (
  SELECT d.g, d.pos, n.lvl, n.pos AS sib, n.node FROM d JOIN n ON n.g = d.g AND n.c > 1 AND n.pos // 3 = d.pos // (3 ** (n.lvl + 1))::bigint AND n.pos <> d.pos // (3 ** n.lvl)::bigint
  UNION ALL SELECT d.g, d.pos, 1000 + u.lvl, u.pos, u.node FROM d JOIN s USING (g)
    JOIN u ON u.c > 1 AND u.pos // 3 = spos // (3 ** (u.lvl + 1))::bigint AND u.pos <> spos // (3 ** u.lvl)::bigint),
h AS (SELECT g, pos, string_agg(node, '' ORDER BY lvl, sib) AS siblings FROM p GROUP BY g, pos)
SELECT d.doc_id, d.leaf, s.subroot, r.node AS root, sha256(coalesce(h.siblings, '')) AS proof_sha256, t.node AS folded_root, t.node = r.node AS verified
FROM d JOIN s USING (g) LEFT JOIN h ON h.g = d.g AND h.pos = d.pos
JOIN (SELECT g, pos, arg_max(node, lvl) AS node FROM e GROUP BY g, pos) t ON t.g = d.g AND t.pos = d.pos
CROSS JOIN (SELECT node FROM u WHERE c = 1) r
"""

WORD, LETTER = r"[^\x20\x09-\x0D]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LEDGER = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {BLANK}) <> '') AS lines FROM documents),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '{LETTER}'))) AS n_alpha_words,
    len(list_filter(lines, lambda x: regexp_matches(trim(x, {BLANK}), '^[-*•]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(trim(x, {BLANK}), '(\\.\\.\\.|…)$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN r USING (rid)),
f AS (SELECT *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (n_words > 100000)::bigint
    + 8 * (word_chars < 3 * n_words)::bigint + 16 * (word_chars > 10 * n_words)::bigint + 32 * (10 * n_symbols > n_words)::bigint
    + 64 * (100 * n_dup_lines > 30 * n_lines)::bigint + 128 * (100 * n_alpha_words < 80 * n_words)::bigint
    + 256 * (100 * n_bullet_lines > 90 * n_lines)::bigint + 512 * (100 * n_ellipsis_lines > 30 * n_lines)::bigint AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
