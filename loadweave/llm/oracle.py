"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BASE = {
    "assign": r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "(AKIA[A-Z0-9]+)",
    "hex": "([0-9a-f]+)",
}
_LEAST = {"assign": 6, "access": 20, "hex": 24}
_WEAK = {"key": "([A-Za-z0-9+/]{32,})", "endpoint": "(https?://[A-Za-z0-9.-]+)"}


def _found(kind: str, pattern: str, least: int) -> str:
    """Matches with their places: the lengths of all matches before and of the pieces between them."""
    pattern = pattern.replace("'", "''")
    return f"""
SELECT doc_id, '{kind}' AS kind, (g_to + m_to - length(m))::INT AS start, (g_to + m_to)::INT AS stop FROM (
  SELECT *, sum(length(g)) OVER w AS g_to, sum(length(m)) OVER w AS m_to FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(asked) AS a, unnest(gaps[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', 1) AS asked, string_split_regex(t, '{pattern}') AS gaps FROM texts))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i))
WHERE length(a) >= {least}"""


_FORM = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, list_position(['assign', 'access', 'hex', 'key', 'endpoint'], kind)){}, '')"

ORACLE = {
    "op2_decontaminate": r"""
WITH items AS (
  SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL)
), asked AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM items WHERE k > 0
), sizes AS (SELECT item_id, count(*) AS n_item FROM asked GROUP BY item_id), held AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), (SELECT DISTINCT k FROM asked) WHERE len(w) >= k
)
SELECT d.doc_id, i.item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM held d JOIN asked i USING (s) JOIN sizes USING (item_id) WHERE d.doc_id IS NOT NULL
GROUP BY d.doc_id, i.item_id, n_item HAVING count(*) >= 0.8 * n_item""",
    "op5_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS later
  FROM (SELECT doc_id, pos, array_to_string(w[pos:pos + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM docs))
), lost AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM windows WHERE later
), placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN (
  SELECT p.doc_id, count(l.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE l.pos IS NULL) AS kept
  FROM placed p LEFT JOIN lost l ON p.doc_id = l.doc_id AND p.pos = l.pos GROUP BY p.doc_id
) k ON d.doc_id = k.doc_id""",
    "op7_secret_scan": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_found(k, p, _LEAST[k]) for k, p in _BASE.items())}),
weak AS ({" UNION ALL ".join(_found(k, p, 1) for k, p in _WEAK.items())}),
linked AS (
  SELECT * FROM weak w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start < w.stop AND w.start < b.stop)
    AND EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.kind <> 'hex' AND b.start <= w.stop + 200 AND w.start <= b.stop + 200)
), every AS (SELECT *, true AS strong FROM base UNION ALL SELECT *, false FROM linked)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256({_FORM.format(" FILTER (WHERE strong)")}) AS base_sha256,
  {_FORM.format(" FILTER (WHERE kind IS NOT NULL)")} AS spans
FROM texts t LEFT JOIN every e ON t.doc_id = e.doc_id GROUP BY t.doc_id""",
    "op6_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
  FROM lines
), often AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, pos, line, owner IS NOT NULL AND doc_id <> owner AS lost FROM keyed LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op10_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS body FROM documents)
WINDOW same AS (PARTITION BY body)""",
    "op11_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b USING (s) JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT x AS doc_id, x AS y FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT doc_id, min(y) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op13_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM texts LEFT JOIN marks USING (doc_id)
), sets AS (
  SELECT part, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END, CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failed GROUP BY 1, 2
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT part, filter_order, step, n, good, toxic, fails, substr(filter_order, step::INT, 1) AS own,
    contains(fails, substr(filter_order, step::INT, 1)) AS bad, translate(fails, substr(filter_order, 1, (step - 1)::INT), '') <> fails AS gone
  FROM sets, orders, (SELECT unnest(range(1, 6)) AS step)
), per AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM per""",
}
