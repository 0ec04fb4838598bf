"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce({WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS w FROM documents),
g AS (
  SELECT DISTINCT r, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
pair AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT a, b FROM pair JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT r AS s, r AS t FROM d UNION SELECT s, b FROM reach JOIN link ON a = t)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM d JOIN reach ON s = d.r JOIN d e ON e.r = t LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS.format("text")}, []) AS w FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, p + o AS i FROM (SELECT r, p, unnest(range(13)) AS o FROM win JOIN f USING (k) WHERE m < doc_id)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (
  SELECT doc_id, t, w, len(w) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
    ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b, w,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
s AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(w[b + 1:], ''), '') AS q FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m WHEN 'spm' THEN '<S>' || q || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""

ORACLES = {"op2_ngram_jaccard_join": NGRAM_JOIN, "op3_substring_dedup": SUBSTRING_DEDUP, "op11_fill_in_middle": FILL_IN_MIDDLE}
