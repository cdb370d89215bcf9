"""SQL with the results of the registered queries, for those that SQL can express."""

from __future__ import annotations

from threadloom.llm import ranked_search, source_divergence, warc

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RANKED = rf"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT row, doc_id, len(terms) AS n, terms FROM doc WHERE len(terms) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
marked AS (SELECT row, doc_id, {ranked_search.MARK_BASE - ranked_search.MARK_SHARE}
    + ({ranked_search.MARK_SHARE} * n * docs) // total.terms AS m FROM sized, total),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")},
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighed AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM item JOIN df USING (term), total),
scored AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM weighed JOIN tf USING (term) JOIN marked USING (row) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

AUDIT = rf"""
WITH doc AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
tf AS (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(terms) AS term FROM doc) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM tf GROUP BY lang, term HAVING count(*) >= {source_divergence.MIN_DOCS}),
size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM doc),
here AS (SELECT lang, source, term, sum(tf.n) AS n FROM tf JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM here GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (coalesce(s.total, 0) + z.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (z.total + z.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN size z USING (lang) LEFT JOIN sums s USING (lang, source)
  LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
cells AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(c.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN cells c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= {source_divergence.TOP_TERMS}
"""

# base32: four letters for each five hexadecimal digits
LETTERS = " || ".join(
    f"""substr('{warc.BASE32}', CAST((CAST('0x' || substr(sha1(body), {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * k}) & 31 AS BIGINT) + 1, 1)"""
    for g in range(8) for k in range(4))

ARCHIVES = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
first AS (SELECT body, min(page_id) AS first FROM page GROUP BY body)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {LETTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM page JOIN first USING (body)
"""

VECTORS = """
WITH RECURSIVE usable AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)
    AND list_max([abs(x) FOR x IN embedding]) > 0),
linked AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
part(id, least) USING KEY (id) AS (SELECT vec_id, vec_id FROM embeddings
  UNION SELECT n.id, min(o.least) FROM recurring.part n JOIN linked ON u = n.id JOIN recurring.part o ON o.id = w
  WHERE o.least < n.least GROUP BY n.id)
SELECT e.vec_id, count(w) AS n_links, p.least AS component_id, e.vec_id = p.least AS kept
FROM embeddings e JOIN part p ON p.id = e.vec_id LEFT JOIN linked ON u = e.vec_id GROUP BY ALL
"""

COPIES = rf"""
WITH RECURSIVE worded AS (SELECT doc_id,
    regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS shingles FROM worded),
sized AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM sets),
held AS MATERIALIZED (SELECT doc_id, hash(shingle) AS h, shingle FROM (SELECT doc_id, unnest(shingles) AS shingle FROM sets)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM held a JOIN held b
  ON a.h = b.h AND a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS MATERIALIZED (SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS MATERIALIZED (SELECT a AS u, b AS w FROM linked UNION ALL SELECT b, a FROM linked),
part(id, least) USING KEY (id) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT n.id, min(o.least) FROM recurring.part n JOIN ways ON u = n.id JOIN recurring.part o ON o.id = w
  WHERE o.least < n.least GROUP BY n.id)
SELECT doc_id, n AS n_shingles, least AS component_id, doc_id = least AS kept FROM sized JOIN part ON id = doc_id
"""

ORACLE = {
    "op1_cover_tree_links": VECTORS,
    "op4_multi_index_minhash": COPIES,
    "op13_boundary_chains": ARCHIVES,
    "op11_bag_classes": RANKED,
    "op12_count_bitmaps": AUDIT,
}
