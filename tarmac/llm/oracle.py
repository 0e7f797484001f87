"""DuckDB SQL of those corpus queries that SQL can express."""

from __future__ import annotations

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EXACT = f"""
WITH cut AS (SELECT doc_id, {_NORM} AS norm FROM documents),
     grouped AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM cut GROUP BY norm)
SELECT c.doc_id, g.keep_id, g.group_size, c.doc_id = g.keep_id AS kept, sha256(c.norm) AS text_sha256
FROM cut c JOIN grouped g USING (norm)
"""

_MIX = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key, md5(coalesce(text, '')) AS text_key
    FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sums),
weighed AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM placed),
ordered AS (
    SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, CAST(cap AS DOUBLE) / weight AS ratio,
           CAST(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place) AS DOUBLE) - cap AS before,
           CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight DESC, place DESC) AS DOUBLE) AS weights_left
    FROM weighed),
levels AS (SELECT *, (total - before) / weights_left AS level FROM ordered),
shared AS (
    SELECT source, source_size,
           CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE)
                ELSE max(CASE WHEN ratio > level THEN level END) OVER () * weight END AS target
    FROM levels),
running AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
           CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.text_key
                                  ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS ahead
    FROM sized s JOIN shared t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) END AS taken
FROM running
"""

SQL = {"op5_exact_dedup": _EXACT, "op7_source_mix": _MIX}

_URLS = r"""
WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^?#]*') AS upto FROM cut),
     named AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(upto, length(raw) + 1) AS path FROM parts),
     rules(verdict, of, start) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
     best AS (SELECT n.page_id, n.host, n.path, max_by(r.of || r.start, length(r.of || r.start)) AS rule, max_by(r.verdict, length(r.of || r.start)) AS verdict
              FROM (SELECT DISTINCT page_id, host, path FROM named) n
              JOIN rules r ON (n.host = r.of OR ends_with(n.host, '.' || r.of)) AND starts_with(n.path, r.start) GROUP BY ALL)
SELECT n.page_id, n.host, n.path, b.rule,
       coalesce(b.verdict, CASE WHEN regexp_matches(n.host, '(^|\.)([^.]*-)?(ads|adult|bets|casino|pills|spam)(-[^.]*)?\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN best b ON n.page_id IS NOT DISTINCT FROM b.page_id AND n.host = b.host AND n.path = b.path
"""

_REPAIR = r"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations),
hashed AS (  -- CRC-32 of the name, bit by bit
    SELECT conv_id, turn, role, text,
           xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
               lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS h
    FROM named),
damaged AS (
    SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM hashed WHERE h <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
           CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial
    FROM damaged),
faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
           initial <> 'x' AND lag(initial) OVER w || initial IN ('su', 'ua', 'au') AS legal, lag(initial) OVER w IS NULL AS begins
    FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
-- states: 0 nothing kept yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn
moves(x, ahead) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
best AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS x, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS found FROM (SELECT DISTINCT conv_id FROM placed) c
    UNION ALL
    SELECT b.conv_id, b.i + 1, e.y, min({'cost': b.found.cost + e.cost, 'audit': b.found.audit || e.audit})
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
    JOIN (  -- from x, with or without an inserted turn first, by one edit of a turn with this initial
        SELECT p.x, t.initial, k.edit, k.y, p.cost + k.cost AS cost, p.audit || k.edit AS audit
        FROM (SELECT x, x AS now, 0 AS cost, '' AS audit FROM moves UNION ALL SELECT x, ahead, 2, 'I' FROM moves) p
        JOIN (SELECT x, 'D' AS edit, x AS y, 3 AS cost, '' AS kept FROM moves UNION ALL SELECT x, 'R', ahead, 2, '' FROM moves
              UNION ALL SELECT x, 'K', ahead, 0, CASE ahead WHEN 2 THEN 'u' ELSE 'a' END FROM moves UNION ALL SELECT 0, 'K', 1, 0, 's') k ON k.x = p.now
        JOIN (VALUES ('s'), ('u'), ('a'), ('x')) t(initial) ON k.kept IN ('', t.initial)) m ON m.x = b.x AND m.initial = f.initial
    CROSS JOIN LATERAL (SELECT m.y AS y, m.cost + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN 1 ELSE 0 END AS cost, m.audit AS audit
                        WHERE m.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate')) e
    GROUP BY b.conv_id, b.i + 1, e.y),
lengths AS (SELECT conv_id, max(i) AS n FROM placed GROUP BY conv_id),
ended AS (
    SELECT b.conv_id, min({'cost': b.found.cost + t.cost, 'audit': b.found.audit || t.audit}) AS found
    FROM best b JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.n = b.i
    JOIN (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) t(x, cost, audit) ON t.x = b.x GROUP BY b.conv_id),
steps AS (  -- the audit's edits with the number of the turn they edit
    SELECT conv_id, j, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS i
    FROM (SELECT conv_id, unnest(string_split(found.audit, '')) AS edit, generate_subscripts(string_split(found.audit, ''), 1) AS j FROM ended WHERE found.audit <> '') s),
written AS (
    SELECT s.conv_id, s.j, s.edit, f.role, f.text, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.j) AS place,
           first_value(s.edit = 'K' AND f.initial = 's') OVER (PARTITION BY s.conv_id ORDER BY s.j) AS led
    FROM steps s LEFT JOIN faulty f ON s.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i WHERE s.edit <> 'D'),
said AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place + CAST(led AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                               CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS lines
    FROM written GROUP BY conv_id),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (NOT begins AND NOT legal) AS illegal
    FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, CAST(coalesce(e.found.cost, 0) AS BIGINT) AS cost, coalesce(e.found.audit, '') AS audit, sha256(coalesce(s.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""

SQL |= {"op11_url_filter": _URLS, "op12_conversation_repair": _REPAIR}
