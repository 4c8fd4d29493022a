"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op7_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, translate(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >'), chr(13) || chr(10), '  ') AS name,
         replace(coalesce(text, ''), '<|', '< |') AS txt
  FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, txt) - 1 AS place FROM t),
p AS (SELECT DISTINCT conv_id AS c, name AS speaker FROM t WHERE name <> 'system'),
s AS (
  SELECT conv_id, place, place // 64 AS part, speaker, name, txt,
         CASE WHEN name = 'system' THEN '<|system|>' || chr(10)
              WHEN name = speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || name || '|>' || chr(10) END AS head
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.c),
w AS (SELECT *, length(head) + length(txt) + 8 AS n FROM s),
o AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id, speaker ORDER BY place) AS BIGINT) AS stop FROM w)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (name = speaker) AS n_own, min(stop - n) AS start,
       string_agg(head || txt || '<|end|>' || chr(10), '' ORDER BY place) AS rendered,
       coalesce(string_agg(CAST(stop - n + length(head) AS VARCHAR) || '-' || CAST(stop AS VARCHAR), ',' ORDER BY place) FILTER (name = speaker), '') AS masks
FROM o GROUP BY conv_id, speaker, part
"""

SQL["op13_interaction"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
l AS (SELECT doc_id AS id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, fails),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z),
o AS (
  SELECT a.z || b.z || c.z || d.z || e.z AS filter_order FROM a, a AS b, a AS c, a AS d, a AS e
  WHERE len(list_distinct([a.z, b.z, c.z, d.z, e.z])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS z, filter_order[:step] AS upto FROM o, range(1, 6) AS r(step)),
r AS (
  SELECT c.*, s.*, strpos(fails, z) > 0 AS own, (length(translate(fails, upto[:step - 1], '')) < length(fails)) AS gone FROM c, s),
p AS (
  SELECT part, filter_order, step, z,
         sum(n) - sum(CASE WHEN gone OR own THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = z THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT gone THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN x ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, z)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, z) AS BIGINT) AS shapley
FROM p
"""

SQL["op11_trie"] = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
         flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps
  FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, n, base, xor(list_reduce(list_prepend(4294967295, steps),
         lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 4 AS h
  FROM b),
h AS (SELECT c.*, least(c.h, coalesce(o.n, 0)) AS got FROM c LEFT JOIN c AS o ON c.base = o.conv_id),
r AS (
  SELECT h.conv_id, t.place - h.h + h.got AS place, said FROM h JOIN t USING (conv_id) WHERE t.place >= h.h
  UNION ALL SELECT h.conv_id, t.place, said FROM h JOIN t ON h.base = t.conv_id WHERE t.place < h.got),
q AS (SELECT conv_id, list(said ORDER BY place) AS path FROM r GROUP BY conv_id),
w AS (SELECT h.conv_id, coalesce(path, []) AS path FROM h LEFT JOIN q USING (conv_id)),
d AS (SELECT conv_id, path[:depth] AS path, depth, depth = len(w.path) AS ending FROM w, LATERAL (SELECT unnest(range(0, len(w.path) + 1)) AS depth)),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, count(*) FILTER (ending) AS n_ends,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256
  FROM d GROUP BY path, depth),
k AS (
  SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.path[:n.depth] = n.path) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].t, '[^\x20\x09-\x0D]+')) END AS spared
  FROM n),
s AS (
  SELECT a.path, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.spared) AS saved_tokens
  FROM k AS a JOIN k AS x ON x.depth >= a.depth AND x.path[:a.depth] = a.path GROUP BY a.path)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, k.n_ends, k.ends_sha256
FROM k JOIN s ON k.path = s.path LEFT JOIN k AS p ON p.depth = k.depth - 1 AND p.path = k.path[:k.depth - 1]
"""
