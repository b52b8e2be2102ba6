"""DuckDB SQL of the operators' queries, where SQL can say them. Ids are taken to be unique."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

DECONTAMINATE = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '{_PLAIN}') AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all({_LOWERED}, '{_PLAIN}') AS w
      FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
met AS (SELECT doc_id, i, n, item FROM doc_windows JOIN item_windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS c
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM met)) GROUP BY 1),
found AS (SELECT doc_id, list_sort(list(DISTINCT item) FILTER (WHERE item IS NOT NULL)) AS items FROM met GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

SUBSTRING_DEDUP = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM g) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '{_SPACED}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY 1) USING (doc_id)"""

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""

#: CRC-32 of a text of ASCII characters, bit by bit: after each byte come eight steps, marked -1.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''),
  lambda ch: list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

PREFIX_TRIE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id AS c, list(struct_pack(x := x, b := strlen(text)) ORDER BY turn NULLS FIRST, md5(x)) AS s
                     FROM said GROUP BY 1),
hashed AS (SELECT c, s, {_CRC.format('c::VARCHAR')} % 9 AS h FROM own),
r AS MATERIALIZED (SELECT a.c, list_concat(coalesce(b.s[1:h], []), a.s[h + 1:]) AS s FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 5),
nodes AS MATERIALIZED (
  SELECT d, s[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(s[d].b), 0) AS b,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(s) = d), '')) AS ends_sha256
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r) GROUP BY ALL),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS MATERIALIZED (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
below AS (SELECT p[1:up] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
            sum((n_convs - 1) * b)::BIGINT AS saved_tokens
          FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM full_nodes) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, CASE WHEN f.d > 0 THEN u.conv_id END AS parent_conv_id, f.n_convs, f.n_children,
  n_leaves, saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below USING (p) LEFT JOIN nodes u ON u.p = f.p[1:f.d - 1] AND u.d = f.d - 1"""
