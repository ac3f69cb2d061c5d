"""SQL that gives the rows of the queries SQL can express."""

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, text, CAST({WORDS} AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt,
      source_size * CAST(2 AS DOUBLE) AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER before, CAST(0 AS DOUBLE)) AS rest,
      sum(wt) OVER () - coalesce(sum(wt) OVER before, 0) AS open FROM w
      WINDOW before AS (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT first(rest ORDER BY cap / wt, source NULLS LAST) AS rest, first(open ORDER BY cap / wt, source NULLS LAST) AS open
      FROM f WHERE cap * open > wt * rest),
t AS (SELECT source, source_size, CASE WHEN cap * f.open <= wt * f.rest THEN cap
      ELSE least(cap, wt * ((SELECT rest FROM l) / (SELECT open FROM l))) END AS target FROM f),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE CAST(0 AS DOUBLE) END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  substr(md5(concat('mix|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(md5(text), ''))), 1, 13)
  < printf('%013x', CAST(floor((rate - floor(rate)) * CAST(4503599627370496 AS DOUBLE)) AS BIGINT)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j"""


def _coded(x: str) -> str:
    for raw, code in (("\\", "\\b"), ("[", "\\o"), ("<", "\\l"), ("]", "\\c")):
        x = f"replace({x}, '{raw}', '{code}')"
    return x


CHAT = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]') x),
c AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
  string_agg(concat(substr(role, 1, 1)), '' ORDER BY turn NULLS FIRST, role, text) AS roles,
  3 + sum(length({_coded('text')}) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
    ELSE length({_coded('role')}) + 14 END) AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_matches(roles, '^s?(ua)+$') AS valid FROM c"""

# cosine in double precision between equal labels; components by the smallest id reached in repeated steps
VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id"""

# every window of 100 bytes, as hexadecimal digits; the first of equal ones stays
SUFFIXES = """
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS INT), 200) AS s FROM (
  SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200) x),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) y WHERE k > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= 100 THEN 0 ELSE 1 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM g),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM p GROUP BY doc_id, part),
cuts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
kept AS (SELECT c.doc_id, string_agg(substr(d.h, CAST(2 * c.before + 1 AS INT), CAST(2 * (c.s - c.before) AS INT)), '' ORDER BY c.s) AS h,
  sum(c.e - c.s) AS gone, count(*) AS n, max(c.e) AS last FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(k.n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.h ELSE concat(k.h, substr(d.h, CAST(2 * k.last + 1 AS INT))) END)) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

# every anchor against every row
NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.s, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INT) AS rank, n AS negative_id, s AS positive_score, ns AS negative_score
FROM n WHERE rank <= 10"""

ORACLES: dict[str, str] = {"op1_mixing": MIXING, "op4_chat": CHAT, "op7_vectors": VECTORS, "op10_suffixes": SUFFIXES,
                           "op11_negatives": NEGATIVES}
