"""DuckDB SQL of the training-data queries that SQL can express, on whole tables."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
         r"'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"
# The word patterns of the contracts.
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(pattern=_ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(pattern=_ALNUM)} AS w FROM benchmark),
i AS (SELECT item_id, unnest([array_to_string(w[s:s + least(10, len(w)) - 1], ' ')
        FOR s IN range(1, len(w) - least(10, len(w)) + 2)]) AS win, least(10, len(w)) AS size
      FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, win, size FROM i),
sizes AS (SELECT DISTINCT size FROM items),
places AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS s, w FROM d, sizes WHERE len(w) >= size),
found AS (SELECT p.doc_id, p.s, p.size, items.item_id FROM
            (SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win FROM places) p
          JOIN items ON p.win = items.win AND p.size = items.size),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n FROM
           (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM
          (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids.items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP5 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(pattern=_SPACED)} AS w FROM documents),
sh AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
         WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[s:s + 2], ' ') FOR s IN range(1, len(w) - 1)] END) AS s FROM d),
flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same
           FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
           GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * same >= 85 * (na + nb - same)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
part AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT sh.doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, sh.doc_id) AS component_id,
       coalesce(component, sh.doc_id) = sh.doc_id AS kept
FROM sh LEFT JOIN part ON part.node = sh.doc_id
"""

OP6 = """
WITH RECURSIVE size AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
tot AS (SELECT sum(size) AS goal, count(*) FILTER (size > 0)::DOUBLE AS weight FROM size),
rate AS (SELECT source, CASE WHEN size > 0 THEN goal * 1.0::DOUBLE / weight / size ELSE 0 END AS rate FROM size, tot),
p(source, rate, k, p, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rate
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM p
  WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 24)),
cdfs AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM p GROUP BY source),
h AS (SELECT doc_id, source, text, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS h FROM documents),
d AS (SELECT *, (('0x' || substr(md5('17|' || h), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM h),
n AS (SELECT d.*, len(list_filter(cdf, lambda c: c < u)) AS n
      FROM d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source),
copies AS (SELECT doc_id, source, text, h, unnest(range(0, n))::INT AS copy FROM n WHERE n > 0)
SELECT doc_id, source, text, copy,
       (('0x' || substr(md5('18|' || h || '|' || copy), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS shuffle_key
FROM copies
"""

_HOST = "translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8 = f"""
WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
p AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT page_id, url, host, path,
        CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
        regexp_replace(host, '^(www|m)\\.', '') ||
          regexp_replace(regexp_replace(path, '/+$', ''), '\\.html?$', '') AS canonical FROM p),
listed AS (SELECT DISTINCT canonical FROM m WHERE contains(url, 'utm_source='))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""

OP9 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS n FROM
    (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
         AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
reach(node, seen) AS (SELECT a, a FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.seen),
part AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id,
       coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN part ON node = vec_id LEFT JOIN deg ON deg.a = vec_id
"""

OP10 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM
          (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos FROM win JOIN least_doc USING (h) WHERE doc_id > lo),
lost AS (SELECT doc_id, list(pos) AS pos FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, CASE WHEN pos IS NULL THEN w
          ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(pos, p)), lambda p: w[p]) END AS kept
      FROM d LEFT JOIN lost USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = f"""
WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         {_WORDS.format(pattern=_LETTERS)} AS w FROM documents),
kept AS MATERIALIZED (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL
         HAVING count(*) >= 10),
occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kc AS MATERIALIZED (SELECT occ.* FROM occ JOIN kept USING (lang, term)),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d)
         LEFT JOIN kc USING (lang, source) GROUP BY ALL),
prof AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
         FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN kc USING (lang, source, term)),
lang_prof AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q
         FROM (SELECT lang, term, sum(n) AS n FROM kc GROUP BY ALL) JOIN v USING (lang)
         JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM prof a JOIN prof b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT
      FROM prof JOIN lang_prof USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM r)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
top AS (SELECT h, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest,
       CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < holder THEN holder END AS refers_to
FROM p LEFT JOIN top ON p.h = top.h AND n >= 1000
"""

SQL = {"op2_decontamination": OP2, "op5_near_dedup": OP5, "op6_mixing": OP6, "op8_url_filter": OP8,
       "op9_embedding_dedup": OP9, "op10_substring_dedup": OP10, "op11_divergence": OP11, "op13_warc": OP13}
