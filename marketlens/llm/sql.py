"""SQL of the queries that SQL can express, by name. Tokens and learned models are beyond it."""

from __future__ import annotations

from marketlens.llm.license_scan import TEMPLATES

_LOWER = "translate(COALESCE({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
item AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, w[p : p + size - 1] AS words
  FROM (SELECT item_id, w, LEAST(len(w), 10) AS size, unnest(range(1, len(w) - LEAST(len(w), 10) + 2)) AS p FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (
  SELECT doc_id, p, size, w[p : p + size - 1] AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM doc JOIN sizes ON len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, p, spots.size, item_id FROM spots JOIN windows USING (words)),
covered AS (SELECT doc_id, COUNT(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n, 0) AS n_hit, CAST(COALESCE(len(ids), 0) AS BIGINT) AS n_items,
       sha256(COALESCE(array_to_string(ids, ','), '')) AS items_sha256, n IS NOT NULL AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_COPIES = f"""
WITH RECURSIVE doc AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, w[p : p + LEAST(len(w), 5) - 1] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - LEAST(len(w), 5) + 2)) AS p FROM doc WHERE len(w) > 0)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b, shared = x.n AND shared = y.n AS same
  FROM (SELECT l.doc_id AS a, r.doc_id AS b, COUNT(*) AS shared FROM grams l JOIN grams r USING (g) WHERE l.doc_id <> r.doc_id GROUP BY ALL)
  JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE shared * 10 >= 8 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
groups AS (SELECT a AS doc_id, LEAST(a, MIN(b)) AS root FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, COUNT(*) AS n, MIN(b) FILTER (same) AS twin FROM links GROUP BY a)
SELECT doc_id, COALESCE(n, 0) AS n_links, LEAST(doc_id, COALESCE(twin, doc_id)) AS class_id, COALESCE(root, doc_id) AS group_id,
       COALESCE(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN groups USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE fine AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT l.vec_id AS a, r.vec_id AS b FROM fine l JOIN fine r ON l.vec_id <> r.vec_id AND len(l.v) = len(r.v)
  WHERE list_cosine_similarity(l.v, r.v) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
roots AS (SELECT a AS vec_id, LEAST(a, MIN(b)) AS root FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, COUNT(*) AS n FROM links GROUP BY a)
SELECT vec_id, COALESCE(n, 0) AS n_links, COALESCE(root, vec_id) AS component_id, COALESCE(root, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN roots USING (vec_id)
"""

URL_RULES = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (
  SELECT page_id, {_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")} AS host,
         COALESCE(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, COALESCE(rule_verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (page_id)
"""

WARC = """
WITH payload AS (
  SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha1(COALESCE(html, '')) AS hex,
         MAX(page_id) OVER (PARTITION BY COALESCE(html, '')) AS last
  FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(1 + 10 * (k // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)),
         '') AS payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM payload
"""

def _spans(kind: int, pattern: str, least: int = 0, group: int = 0) -> str:
    """Matches of a pattern with their start: what was split off before them plus the matches before them."""
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS s,
         found[i] AS m, parts[i] AS g
  FROM (SELECT doc_id, gaps, found, parts, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS found,
                     regexp_extract_all(t, '{pattern}', {group}) AS parts FROM texts))
  WHERE length(found[i]) >= {least}"""


def _either_case(word: str) -> str:
    """ASCII letters in either case and no others, which (?i) would add."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS_OF_SECRETS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"(?:{_WORDS_OF_SECRETS})[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)"
SECRETS = f"""
WITH texts AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
found AS ({_spans(0, _ASSIGN, group=1)}
  UNION ALL {_spans(1, "AKIA[A-Z0-9]+", 20)}
  UNION ALL {_spans(2, "[0-9a-f]+", 24)}
  UNION ALL {_spans(3, "[A-Za-z0-9]+", 16)}
  UNION ALL {_spans(4, "[A-Za-z0-9+/]+=?=?", 32)}
  UNION ALL {_spans(5, "(?:https?|wss?|amqps?|postgres|mysql|redis|mongodb)://[A-Za-z0-9.-]+(?::[0-9]+)?")}),
parts AS (
  SELECT doc_id, kind, CAST(s AS BIGINT) AS a, CAST(s + length(m) AS BIGINT) AS b FROM found
  WHERE CASE kind WHEN 0 THEN length(g) >= 6 WHEN 1 THEN length(m) >= 20
        WHEN 3 THEN length(m) BETWEEN 16 AND 40 AND regexp_full_match(m, '[A-Z0-9]+') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]')
        WHEN 4 THEN length(rtrim(m, '=')) >= 32 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')
        ELSE true END),
near AS (
  SELECT w.doc_id, w.kind, w.a, w.b, bool_or(o.kind IN (1, 3)) AS ids, bool_or(o.kind IN (0, 2, 4)) AS secrets
  FROM parts w JOIN parts o ON o.doc_id = w.doc_id AND (o.kind, o.a, o.b) <> (w.kind, w.a, w.b) AND o.b >= w.a - 200 AND o.a <= w.b + 200
  WHERE w.kind >= 3 GROUP BY ALL),
spans AS (
  SELECT doc_id, kind, a, b FROM parts WHERE kind < 3
  UNION ALL
  SELECT doc_id, kind, a, b FROM near n
  WHERE CASE kind WHEN 3 THEN secrets WHEN 4 THEN ids ELSE ids AND secrets END
    AND NOT EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = n.doc_id AND p.kind < 3 AND p.a < n.b AND p.b > n.a)),
listed AS (
  SELECT doc_id, COUNT(*) FILTER (kind = 0) AS n_assign, COUNT(*) FILTER (kind = 1) AS n_access, COUNT(*) FILTER (kind = 2) AS n_hex,
         string_agg(word, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(word, ',' ORDER BY a, kind) AS spans
  FROM (SELECT *, ['assign', 'access', 'hex', 'id', 'secret', 'endpoint'][kind + 1] || ':' || a || ':' || b AS word FROM spans)
  GROUP BY doc_id)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
       sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""

_TEMPLATES = ",\n  ".join(
    f"('{label}', string_split('{sentence}', ' '), [{', '.join(f"string_split('{key}', ' ')" for key in keys)}])"
    for label, sentence, keys in TEMPLATES)
LICENSES = f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS.format("text")} AS w FROM documents),
padded AS MATERIALIZED (SELECT row, list_concat(list_resize([''], 60, ''), w, list_resize([''], 60, '')) AS w FROM doc),
phrase(p, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'),
  (['mit', 'license'], 'mit')),
word AS MATERIALIZED (SELECT row, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM doc),
places AS (SELECT word.row, i - 1 AS spot, label FROM word JOIN phrase ON x = p[1] JOIN doc USING (row) WHERE w[i : i + len(p) - 1] = p),
template(label, t, keys) AS (VALUES
  {_TEMPLATES}),
numbered AS (SELECT row_number() OVER () AS k, * FROM template),
keyed AS (SELECT k, key, list_filter(range(1, len(t) + 1), lambda i: t[i : i + len(key) - 1] = key)[1] AS spot
          FROM (SELECT k, t, unnest(keys) AS key FROM numbered)),
holders AS (SELECT x, COUNT(*) AS n FROM (SELECT DISTINCT k, unnest(t) AS x FROM numbered) GROUP BY x),
rarest AS (SELECT k, arg_min(x, (n, i)) AS x, arg_min(i, (n, i)) AS i
           FROM (SELECT k, unnest(key) AS x, spot + generate_subscripts(key, 1) - 1 AS i FROM keyed) JOIN holders USING (x) GROUP BY k),
spots AS (SELECT DISTINCT word.row, r.k, 60 + word.i - r.i AS o FROM word JOIN rarest r USING (x)),
standing AS (
  SELECT s.row, s.k, s.o FROM spots s JOIN padded p USING (row) JOIN keyed USING (k) GROUP BY ALL
  HAVING bool_and(len(list_filter(range(-3, 4), lambda d: p.w[s.o + keyed.spot + d : s.o + keyed.spot + d + len(keyed.key) - 1] = keyed.key)) > 0)),
shares AS (
  SELECT s.row, label, len(list_filter(range(1, len(t) + 1), lambda i: list_contains(p.w[s.o + i - 3 : s.o + i + 3], t[i]))) / len(t) AS share
  FROM standing s JOIN numbered USING (k) JOIN padded p USING (row)),
based AS (SELECT row, COUNT(*) AS n, MIN(spot) AS lo, MAX(spot) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY row),
named AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, MAX(share) AS score
  FROM (SELECT row, label, 1.0 AS share FROM places UNION ALL SELECT * FROM shares WHERE share >= 0.75) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n, 0) AS n_base, lo AS first_word, hi AS last_word, COALESCE(based.labels, '') AS base_labels,
       COALESCE(named.labels, '') AS labels, CAST(COALESCE(score, 0) AS DOUBLE) AS score
FROM doc LEFT JOIN based USING (row) LEFT JOIN named USING (row)
"""


def _nearest(books: str) -> str:
    return f"""
  SELECT row, p, MIN({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'e': e}}) AS best
  FROM parts JOIN {books} USING (p) GROUP BY ALL"""


def _means(near: str, books: str) -> str:
    mean = "((s - ((s % n) + n) % n) // n)"
    return f"""
  SELECT p, e, COALESCE(m, c) AS c FROM {books} LEFT JOIN (
    SELECT p, e, list(CAST({mean} AS BIGINT) ORDER BY i) AS m FROM (
      SELECT p, best.e AS e, i, SUM(x[i]) AS s, COUNT(*) AS n FROM {near} JOIN parts USING (row, p), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL)
    GROUP BY ALL) USING (p, e)"""


#: Vectors of one length, a multiple of the parts.
VECTOR_CODES = f"""
WITH fine AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM fine, unnest(range(16)) AS u(p)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS c FROM parts WHERE row <= 64),
near0 AS MATERIALIZED ({_nearest("book0")}),
book1 AS MATERIALIZED ({_means("near0", "book0")}),
near1 AS MATERIALIZED ({_nearest("book1")}),
book2 AS MATERIALIZED ({_means("near1", "book1")}),
near2 AS MATERIALIZED ({_nearest("book2")}),
codes AS (
  SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(SUM(best.d) AS BIGINT) AS error FROM near2 GROUP BY row),
digest AS (SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS sha FROM book2, unnest(range(1, len(c) + 1)) AS u(i))
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM fine JOIN codes USING (row), digest
"""

DIVERGENCE = f"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS row, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
         regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
each AS (SELECT row, lang, source, term, COUNT(*) AS n FROM (SELECT row, lang, source, unnest(w) AS term FROM doc) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, SUM(n) AS n FROM each GROUP BY lang, term HAVING COUNT(*) >= 10),
counts AS (SELECT lang, source, term, SUM(n) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, COUNT(*) AS v, SUM(n) AS total FROM kept GROUP BY lang),
groups AS MATERIALIZED (
  SELECT lang, source, COALESCE(v, 0) AS v, COALESCE(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM doc) LEFT JOIN langs USING (lang)),
totals AS (SELECT lang, source, SUM(n) AS own FROM counts GROUP BY ALL),
rates AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n, 1 + 1000000000 * (COALESCE(c.n, 0) + 2) // (COALESCE(t.own, 0) + 2 * v) AS p,
         1 + 1000000000 * (k.n + 2) // (total + 2 * v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, COALESCE(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, SUM((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
             FROM rates x JOIN rates y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM rates WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {
    "op1_benchmark_decontamination": DECONTAMINATION,
    "op2_ngram_jaccard_join": NEAR_COPIES,
    "op3_embedding_near_dedup": EMBEDDINGS,
    "op4_url_filters": URL_RULES,
    "op5_secret_scans": SECRETS,
    "op6_warc": WARC,
    "op11_license_scans": LICENSES,
    "op12_vector_code_compression": VECTOR_CODES,
    "op13_source_divergence_audit": DIVERGENCE,
}
