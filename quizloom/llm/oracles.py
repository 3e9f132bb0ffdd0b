"""SQL (DuckDB) for the rows of the operators that SQL can express, over whole tables."""

from __future__ import annotations

import string

_WORD = r"'[^\x20\x09-\x0D]+'"

#: The words of every text in turn, from 1.
_WORDS = f"SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS n, len(l) AS size FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS l FROM {{docs}})"

#: Windows of 20 words by their text; those that are not the first of their text cover words that go.
SUBSTRING_DEDUP = f"""WITH w AS ({_WORDS.format(docs="documents")}),
windows AS (SELECT *, CASE WHEN n <= size - 19 THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS words FROM w),
told AS (SELECT *, words IS NOT NULL AND row_number() OVER (PARTITION BY words ORDER BY doc_id, n) > 1 AS again FROM windows),
gone AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS removed FROM told),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY n) FILTER (NOT removed), '') AS words FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

_LOWER = f"SELECT doc_id, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents"

#: Shingles of five words, or the whole of a shorter text; links by the size of what two sets share; what links reach.
NEAR_DEDUP = f"""WITH RECURSIVE w AS ({_WORDS.format(docs=f"({_LOWER})")}),
grams AS (SELECT doc_id, size, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM w),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM grams WHERE n <= greatest(size - 4, 1)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT l.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, component_id = l.doc_id AS kept FROM lowest l LEFT JOIN sizes s ON s.doc_id = l.doc_id"""

#: Units of every text as a list; the forms and cuts by the hash of the id.
FILL_IN_MIDDLE = r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM h),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
 array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS t FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || t || '<M>' || m ELSE '<S>' || t || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""

#: SHA-1 in base 32 by groups of five hex digits; of equal payloads the largest page answers.
ARC_TO_WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, payload_bytes, h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to FROM b WINDOW w AS (PARTITION BY h)"""

_CRC32 = "xor(list_reduce(list_concat([4294967295], flatten([[ord(substr(conv_id::VARCHAR, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, length(conv_id::VARCHAR) + 1)])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"

#: Rebuilt conversations as lists of turns; nodes by the hash of a prefix; sums over the prefixes of each node's smallest member.
PREFIX_TRIE = rf"""WITH t AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS b, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(b ORDER BY turn NULLS FIRST, b) AS b, list(w ORDER BY turn NULLS FIRST, b) AS w FROM t GROUP BY conv_id),
f AS (SELECT conv_id, b, w, ({_CRC32} % 4)::BIGINT AS h FROM own),
c AS (SELECT f.conv_id, list_concat(coalesce(s.b[1:h], []), f.b[h + 1:]) AS b, list_concat(coalesce(s.w[1:h], []), f.w[h + 1:]) AS w FROM f LEFT JOIN own s ON s.conv_id = f.conv_id - f.conv_id % 20),
p AS MATERIALIZED (SELECT conv_id, d, md5(array_to_string(b[1:d], ',')) AS key, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, d = len(b) AS done FROM (SELECT conv_id, b, w, unnest(range(len(b) + 1)) AS d FROM c)),
n AS MATERIALIZED (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) * (count(*) - 1) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (done), '')) AS ends_sha256 FROM p GROUP BY d, key),
u AS (SELECT n.d, n.key, q.key AS up, m.conv_id AS parent_conv_id FROM n JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1 JOIN n m ON m.d = q.d AND m.key = q.key),
k AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM u GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children, parent_conv_id FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key LEFT JOIN u ON u.d = n.d AND u.key = n.key),
s AS (SELECT p.d, p.key, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM x JOIN p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY ALL)
SELECT conv_id, x.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM x JOIN s ON s.d = x.d AND s.key = x.key"""
