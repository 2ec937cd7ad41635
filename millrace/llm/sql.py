"""The same results in DuckDB's SQL, for the queries that SQL can express."""

from __future__ import annotations

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_LINES = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents
), said AS (
  SELECT doc_id, p, regexp_replace(s, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS s FROM line
), full_line AS (
  SELECT doc_id, p, s, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS j FROM said WHERE s <> ''
), win AS (
  SELECT a.doc_id, a.j, a.s || chr(10) || b.s || chr(10) || c.s AS w, [a.p, b.p, c.p] AS places
  FROM full_line a JOIN full_line b ON a.doc_id = b.doc_id AND b.j = a.j + 1 JOIN full_line c ON a.doc_id = c.doc_id AND c.j = a.j + 2
), later AS (
  SELECT doc_id, places, row_number() OVER (PARTITION BY w ORDER BY doc_id, j) AS k FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest(places) AS p FROM later WHERE k > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed, coalesce(string_agg(CASE WHEN g.p IS NULL THEN l.s END, chr(10) ORDER BY l.p), '') AS text
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id
)
"""

OP4 = _LINES + "SELECT doc_id, n_lines, n_removed, text FROM kept"

OP5 = r"""
WITH doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM doc GROUP BY source
), weighed AS (
  SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w, 3.0::DOUBLE * source_size AS cap FROM src
), tried AS (
  SELECT a.cap / a.w AS edge, sum(least(b.cap, a.cap / a.w * b.w)) AS used FROM weighed a, weighed b GROUP BY a.source, a.cap, a.w
), filled AS (
  SELECT coalesce(max(edge), -1) AS edge FROM tried WHERE used <= (SELECT sum(source_size) FROM src)
), level AS (
  SELECT ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(cap) FILTER (WHERE cap / w <= edge), 0)) / sum(w) FILTER (WHERE cap / w > edge) AS v FROM weighed, filled
), plan AS (
  SELECT source, source_size, least(cap, v * w) AS target, CASE WHEN source_size > 0 THEN floor(least(cap, v * w) / source_size) ELSE 0 END AS whole FROM weighed, level
), spared AS (
  SELECT *, greatest(0.0, target - whole * source_size)::DOUBLE AS spare FROM plan
), sized AS (
  SELECT source, size, count(*) AS n FROM doc WHERE size > 0 GROUP BY source, size
), down AS (
  SELECT z.source, size, spare - coalesce(sum(size::HUGEINT * n) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
    (sum(size::HUGEINT * size * n) OVER (PARTITION BY z.source ORDER BY size ROWS UNBOUNDED PRECEDING))::DOUBLE AS squares
  FROM sized z JOIN spared p ON z.source IS NOT DISTINCT FROM p.source WHERE spare > 0
), fit AS (
  SELECT source, max(size) AS tau, arg_max(rest, size) AS rest, arg_max(squares, size) AS squares FROM down WHERE rest * size < squares GROUP BY source
), ranked AS (
  SELECT doc_id, d.source, size, source_size, target, whole, spare, u, tau, rest, least(1 - 1e-9, greatest(1e-12, rest / squares * size))::DOUBLE AS chance
  FROM doc d JOIN spared p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN fit f ON d.source IS NOT DISTINCT FROM f.source
), ended AS (
  SELECT *, sum(CASE WHEN size <= tau THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY floor((ln(u / (1 - u)) - ln(chance / (1 - chance))) * 1048576.0), u, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM ranked
), taken AS (
  SELECT *, CASE WHEN size = 0 THEN 0 WHEN spare > 0 AND size > coalesce(tau, 0) THEN whole + 1 WHEN rest > 0 AND size <= tau AND upto - size / 2.0 <= rest THEN whole + 1 ELSE whole END::BIGINT AS copies FROM ended
)
SELECT doc_id, size, source_size, target, copies, (size * copies)::BIGINT AS taken FROM taken
"""

_HITS = rf"""
WITH item AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_ALNUM} AS w FROM benchmark
), item_window AS (
  SELECT item, least(10, len(w)) AS k, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS said FROM item WHERE len(w) > 0
), doc AS (
  SELECT doc_id, {_ALNUM} AS w FROM documents
), width AS (
  SELECT DISTINCT k FROM item_window
), doc_window AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS said FROM doc, width WHERE len(w) >= k
), hit AS (
  SELECT d.doc_id, d.i, d.k, m.item FROM doc_window d JOIN item_window m ON d.said = m.said AND d.k = m.k
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id
)
"""

OP8 = _HITS + """
SELECT doc.doc_id, len(w) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, word.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN word ON doc.doc_id = word.doc_id LEFT JOIN found ON doc.doc_id = found.doc_id
"""

_LINKED = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM doc
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), both_of AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM both_of m JOIN size p ON m.x = p.doc_id JOIN size q ON m.y = q.doc_id WHERE 100 * m.n >= 80 * (p.n + q.n - m.n)
), pair AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM doc UNION SELECT pair.y, reach.r FROM reach JOIN pair ON pair.x = reach.v
), least_of AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
)
"""

OP9 = _LINKED + """, partners AS (
  SELECT x, count(*) AS n FROM pair GROUP BY x
)
SELECT doc.doc_id, coalesce(size.n, 0) AS n_shingles, component_id, coalesce(partners.n, 0) AS n_links
FROM doc LEFT JOIN size ON doc.doc_id = size.doc_id JOIN least_of ON doc.doc_id = least_of.v LEFT JOIN partners ON doc.doc_id = partners.x
"""

OP3 = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""

OP11 = """
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM doc
), cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), piece AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM piece
"""

ORACLES: dict[str, str] = {"op3_exact_top_k": OP3, "op4_line_dedup": OP4, "op5_source_mix": OP5, "op8_decontamination": OP8, "op9_ngram_jaccard_join": OP9, "op11_fill_in_middle": OP11}
