"""SQL of op11 to op13. DuckDB has no CRC-32, which is worked out here by half bytes."""

from __future__ import annotations

#: The CRC-32 (polynomial 0xEDB88320) of each half byte.
CRC_TABLE = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"


def crc32(codes: str) -> str:
    """CRC-32 of a list of bytes."""
    halves = f"flatten(list_transform({codes}, lambda y: [y & 15, y >> 4]))"
    return f"xor(list_reduce({halves}, lambda c, h: xor(({CRC_TABLE})[(xor(c, h) & 15) + 1], c >> 4), CAST(4294967295 AS BIGINT)), 4294967295)"


ASCII = "list_transform(string_split({0}, ''), lambda y: CAST(unicode(y) AS BIGINT))"
#: Letters up to U+00FF as UTF-8: one byte, or 195 and another.
LATIN = "flatten(list_transform(string_split({0}, ''), lambda y: CASE WHEN unicode(y) < 128 THEN [CAST(unicode(y) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(y) - 64 AS BIGINT)] END))"

BLANK = "[^\\x20\\x09-\\x0D]"

CONVERSATION_REPAIR = rf"""WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
 h AS (SELECT *, {crc32(ASCII.format("k"))} % 20 AS what FROM g),
 d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE what <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before FROM d),
 f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{BLANK}') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS a, row_number() OVER () AS id FROM o),
 n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CASE WHEN fault = 'blank' THEN 1 ELSE 0 END) AS blank, sum(CASE WHEN fault = 'duplicate' THEN 1 ELSE 0 END) AS duplicate, sum(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END) AS truncated,
  sum(CASE WHEN before IS NOT NULL AND left(before, 1) || a NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM f GROUP BY conv_id),
 s AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE 0 END AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cut FROM f),
 b AS (SELECT conv_id, n AS i, CAST(0 AS BIGINT) AS v0, CAST(10 AS BIGINT) AS v1, CAST(5 AS BIGINT) AS v2, CAST(0 AS BIGINT) AS v3 FROM n UNION ALL
  SELECT conv_id, i, least(u0, c2 + 5), least(u1, c2 + 5), c2, least(u3, u2 + 5) FROM (SELECT *, least(u2, u3 + 5) AS c2 FROM (SELECT b.conv_id, b.i - 1 AS i,
   least(2 + v0, gone + cut + least(1 + v2, CASE a WHEN 's' THEN v1 WHEN 'u' THEN v2 ELSE 1000000000 END)) AS u0, least(2 + v1, gone + cut + least(1 + v2, CASE a WHEN 'u' THEN v2 ELSE 1000000000 END)) AS u1,
   least(2 + v2, gone + cut + least(1 + v3, CASE a WHEN 'a' THEN v3 ELSE 1000000000 END)) AS u2, least(2 + v3, gone + cut + least(1 + v2, CASE a WHEN 'u' THEN v2 ELSE 1000000000 END)) AS u3
   FROM b JOIN s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i))),
 l AS (SELECT conv_id, i, [v0, v1, v2, v3] AS v FROM b),
 w AS (SELECT x.conv_id, x.i, x.v, y.v AS z, a, gone, cut, role, text, n.n FROM l x JOIN n ON n.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN l y ON y.conv_id IS NOT DISTINCT FROM x.conv_id AND y.i = x.i + 1 LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND s.i = x.i + 1),
 t AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, '' AS audit, '' AS made FROM n UNION ALL
  SELECT conv_id, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN CASE a WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE nx END, audit || e,
   CASE WHEN e = 'D' THEN made ELSE made || chr(10) || CASE WHEN e = 'K' THEN role WHEN nx = 2 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END END
  FROM (SELECT *, CASE WHEN z IS NOT NULL AND 2 + z[q + 1] = v[q + 1] THEN 'D' WHEN v[nx + 1] + 5 = v[q + 1] THEN 'I' WHEN gone + cut + CASE a WHEN 's' THEN CASE WHEN q = 0 THEN z[2] END WHEN 'u' THEN CASE WHEN q <> 2 THEN z[3] END WHEN 'a' THEN CASE WHEN q = 2 THEN z[4] END END = v[q + 1] THEN 'K' ELSE 'R' END AS e
   FROM (SELECT t.*, CASE WHEN q = 2 THEN 3 ELSE 2 END AS nx, v, z, a, gone, cut, role, text FROM t JOIN w ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.i WHERE t.i < n OR q IN (1, 2)))),
 r AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(made, length(audit)) AS made FROM t GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
 coalesce(v0, 0) AS cost, coalesce(audit, '') AS audit, sha256(substr(coalesce(made, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 0"""

VARIANTS = rf"""WITH RECURSIVE g AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
 h AS (SELECT run, CAST(m % length(run) AS INTEGER) AS pos, m % 31 = 0 AS short FROM (SELECT run, {crc32(LATIN.format("doc || ':' || run"))} AS m FROM g)),
 v AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN short THEN substr(run, 1, pos) || substr(run, pos + 2) ELSE run END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
 d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM v)),
 e AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
 b AS (SELECT e.word, count(*) AS n_near, max(v.n) AS most FROM e JOIN v ON v.word = e.near GROUP BY e.word),
 c AS (SELECT e.word, min(e.near) AS form FROM e JOIN v ON v.word = e.near JOIN b ON b.word = e.word AND b.most = v.n GROUP BY e.word),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN form END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN b ON b.word = v.word LEFT JOIN c ON c.word = v.word),
 r AS (SELECT word, word AS root, 0 AS far FROM f UNION ALL SELECT r.word, f.form, far + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
 z AS (SELECT word, arg_max(root, far) AS root FROM r GROUP BY word)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN z ON z.word = f.word"""

#: The search is approximate, the SQL exact: tests compare recall and scores with it, and it stands beside no query.
NEIGHBOURS = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""
