"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UP}', '{LOW}') AS k FROM lines
), holders AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT x.doc_id, x.i, x.line, h.first_doc IS NOT NULL AND h.first_doc <> x.doc_id AS dropped
  FROM keyed x LEFT JOIN holders h ON h.k = x.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4 = """
WITH sizes AS (
  SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN (1.0::DOUBLE / (SELECT count(*) FROM sizes)) * (SELECT sum(size)::DOUBLE FROM sizes) / size ELSE 1.0::DOUBLE END AS rate FROM sizes
), terms AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) AS p
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates)
), cdf AS (
  SELECT source, list(c ORDER BY k) AS cs FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source
), counted AS (
  SELECT d.doc_id, d.source, d.text,
         len(list_filter(c.cs, lambda x: x <= ('0x' || substr(md5('17:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS n_copies
  FROM documents d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, source, n_copies::INTEGER AS n_copies, replica::INTEGER AS replica, text
FROM (SELECT *, unnest(range(0, n_copies)) AS replica FROM counted WHERE n_copies > 0)
"""

OP9 = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) +
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) + 16 AS chars
  FROM all_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), prefixed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM prefixed GROUP BY conv_id
"""


OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6 = f"""
WITH dw AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), iw AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0
), pat AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM iw)
), win AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw JOIN (SELECT DISTINCT n FROM pat) ON len(w) >= n)
), occ AS (
  SELECT doc_id, i, n, item_id FROM win JOIN pat USING (n, p)
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP12 = rf"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)
), counted AS (
  SELECT lang, m, g, count(*) AS f FROM grams GROUP BY lang, m, g HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), cand AS (
  SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM counted WHERE m > 1
), cuts AS (
  SELECT c.lang, c.m, c.g, c.a, c.w, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN counted x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:c.k], ' ')
  JOIN counted y ON y.lang = c.lang AND y.g = array_to_string(c.w[c.k + 1:], ' ')
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM cuts) WHERE o = 1
), inside AS (
  SELECT lang, g, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS g, a
    FROM (SELECT lang, w, a, m, s, unnest(range(1, m - s + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS s) WHERE s < m)
  ) GROUP BY lang, g
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.g) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a
)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

#: crc32 of an ASCII string, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
OP13 = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), planned AS (
  SELECT conv_id, ts, conv_id - conv_id % 5 AS base, {CRC} % 9 AS h FROM own
), rebuilt AS (
  SELECT p.conv_id, list_concat(coalesce(b.ts, [])[1:p.h], p.ts[p.h + 1:]) AS ts FROM planned p LEFT JOIN own b ON b.conv_id = p.base
), prefixes AS (
  SELECT conv_id, d AS depth, len(ts) AS n, CASE WHEN d = 0 THEN NULL ELSE sha256(ts[1:d]::VARCHAR) END AS node, CASE WHEN d > 1 THEN sha256(ts[1:d - 1]::VARCHAR) END AS parent,
    CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(ts[d].text)) END AS bytes
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, node
), kids AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.node IS NOT DISTINCT FROM n.node
), under AS (
  SELECT p.depth, p.node, sum((u.n_convs - 1) * u.bytes) AS saved, count(*) FILTER (u.n_children = 0) AS leaves
  FROM full_nodes u JOIN prefixes q ON q.conv_id = u.conv_id AND q.depth = u.depth JOIN prefixes p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node IS NOT DISTINCT FROM n.parent
LEFT JOIN under u ON u.depth = n.depth AND u.node IS NOT DISTINCT FROM n.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op4_source_mixing": OP4, "op5_top_k": OP5, "op6_decontamination": OP6, "op9_chat_format": OP9, "op12_collocations": OP12, "op13_prefix_trie": OP13}
