"""SQL counterparts of the queries that SQL can express, written from the contracts and not from the operators."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_sql(text: str) -> str:
    """Runs of digits, a-z and characters beyond ASCII."""
    return f"regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, {words_sql("lower(coalesce(text, ''))")} AS w FROM documents),
j AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM d WHERE len(w) > 0),
s AS (SELECT doc_id, array_to_string(w[j:j + 4], ' ') AS g, count(*) AS c FROM j GROUP BY 1, 2),
t AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m)),
reach(id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT id AS doc_id, min(r) AS class_id FROM reach GROUP BY 1"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), m AS (SELECT t, max(page_id) AS first FROM p GROUP BY 1),
h AS (SELECT page_id, first, octet_length(encode(t)) AS n, sha1(t) AS x FROM p JOIN m USING (t)),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
  4 * strpos('0123456789abcdef', substr(x, i, 1)) - 3, 4)), '') AS bits FROM h)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT
  + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {words_sql(LOW)} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {words_sql(LOW)} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM b)),
dw AS (SELECT doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS g FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
hits AS (SELECT doc_id, j, k, item_id FROM dw JOIN bw USING (k, g)),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(j, j + k)) AS place FROM hits) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, coalesce(i.x, sha256('')) AS items_sha256,
coalesce(20 * c.n >= len(w), false) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""

# the pages of the tables declare their article and hold headings and paragraphs only
MAIN_TEXT = """WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS article FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(article, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
  replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
  '\\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""

def terms_sql(text: str) -> str:
    """Runs of digits, A-Z, a-z and characters beyond ASCII, A-Z in lower case."""
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: translate(w, '{UPPER}', '{UPPER.lower()}'))"


RANKED_SEARCH = f"""WITH d AS (SELECT doc_id, {terms_sql("text")} AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest({terms_sql("text")}) AS t FROM benchmark),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
g AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM f, c),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM b JOIN p USING (t) JOIN g USING (t), c GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

HARD_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, k::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 3"""
