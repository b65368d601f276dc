-- query: gold_number_collect
WITH v AS (SELECT v FROM (UNPIVOT (SELECT CAST(COLUMNS(* EXCLUDE (quarter)) AS DOUBLE) FROM @five_revenues_by_quarter) ON COLUMNS(*) INTO NAME m VALUE v)
UNION ALL SELECT v FROM (UNPIVOT (SELECT CAST(COLUMNS(* EXCLUDE (year, category)) AS DOUBLE) FROM @category_gross_margin_by_year) ON COLUMNS(*) INTO NAME m VALUE v)
UNION ALL SELECT v FROM (UNPIVOT (SELECT CAST(COLUMNS(* EXCLUDE (month)) AS DOUBLE) FROM @monthly_marketing) ON COLUMNS(*) INTO NAME m VALUE v)
UNION ALL SELECT v FROM (UNPIVOT (SELECT CAST(COLUMNS(* EXCLUDE (month)) AS DOUBLE) FROM @monthly_subscriptions) ON COLUMNS(*) INTO NAME m VALUE v))
SELECT DISTINCT CASE WHEN v = floor(v) THEN CAST(CAST(v AS HUGEINT) AS VARCHAR) ELSE CAST(CAST(v AS DECIMAL(38,2)) AS VARCHAR) END AS number
FROM v WHERE (v = floor(v) AND ABS(v) >= 1000) OR (v <> floor(v) AND ABS(v) >= 100)
-- query: gold_number_leak_scan
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_.,]+')) AS run FROM documents),
n AS (SELECT doc_id, replace(regexp_extract(run, '^(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(?:$|[^\p{L}\p{N}_])', 1), ',', '') AS w,
             regexp_extract(run, '^(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(?:$|[^\p{L}\p{N}_])', 2) AS f FROM r),
m AS (SELECT doc_id, ltrim(w, '0') AS w, f, replace(f, '0', '') = '' AS whole, CAST(w || '.' || CASE f WHEN '' THEN '0' ELSE f END AS DECIMAL(38,12)) * 100 AS c FROM n WHERE w <> ''),
d AS (SELECT DISTINCT doc_id, CASE WHEN whole THEN CASE WHEN length(w) >= 4 THEN w END
        WHEN c >= 10000 THEN CAST(CAST((floor(c) + CASE WHEN c - floor(c) > 0.5 OR (c - floor(c) = 0.5 AND floor(c) % 2 = 1) THEN 1 ELSE 0 END) / 100 AS DECIMAL(28,2)) AS VARCHAR) END AS number FROM m)
SELECT doc_id, number, number IN (SELECT number FROM @gold_number_collect) AS is_gold FROM d WHERE number IS NOT NULL
-- query: path_pattern_scan
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS q FROM pages), s AS (SELECT page_id, rtrim(q, '/') AS path FROM p),
g AS (SELECT page_id, path, unnest(['*ground_truth*', 'evals/*', '*/evals/*', 'benchmarks/*', '*/benchmarks/*', 'eval_harness/*', '*/eval_harness/*', 'parity/*', '*/parity/*', '*measures.py', '*.html', 'fr/*']) AS pat,
             generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], 1) AS pos FROM s),
h AS (SELECT page_id, path, arg_min(pat, pos) AS pat FROM g WHERE path GLOB pat GROUP BY 1, 2)
SELECT page_id, path, 'eval-material' AS rule, 'matches ' || pat AS detail FROM h
UNION ALL SELECT page_id, path, 'instruction-file', 'auto-loaded by some agents' FROM s
WHERE split_part(path, '/', -1) IN ('CLAUDE.md', 'CLAUDE.local.md', 'AGENTS.md', 'AGENTS.override.md', 'GEMINI.md', '.cursorrules', 'copilot-instructions.md')
UNION ALL SELECT page_id, path, 'instruction-file', 'agent configuration directory' FROM s
WHERE list_has_any(string_split(path, '/')[:-2], ['.claude', '.codex', '.gemini', '.cursor', '.github'])
-- query: word_overlap_topk
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda t: length(t) > 2 AND NOT list_contains(string_split('a an and are as at be by did do does for from how in is it its many much of on or our that the their this to was we were what when which who why with you your', ' '), t)) AS w FROM documents),
iw AS (SELECT row_number() OVER () AS i, item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda t: length(t) > 2 AND NOT list_contains(string_split('a an and are as at be by did do does for from how in is it its many much of on or our that the their this to was we were what when which who why with you your', ' '), t)) AS w FROM benchmark),
sc AS (SELECT r, doc_id, i, item_id, CAST(len(list_intersect(dw.w, iw.w)) AS BIGINT) AS shared, len(dw.w) AS a, len(iw.w) AS b FROM dw, iw),
rk AS (SELECT *, COALESCE(CAST(shared AS DOUBLE) / NULLIF(a + b - shared, 0), 0) AS o FROM sc),
tp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY r ORDER BY o DESC, item_id NULLS LAST, shared DESC, i) AS rank FROM rk)
SELECT doc_id, rank, item_id, shared, ROUND(o, 6) AS overlap FROM tp WHERE rank <= 3
-- query: gold_number_text_collect
WITH r AS (SELECT item_id AS doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_.,]+')) AS run FROM benchmark),
n AS (SELECT doc_id, replace(regexp_extract(run, '^(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(?:$|[^\p{L}\p{N}_])', 1), ',', '') AS w,
             regexp_extract(run, '^(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(?:$|[^\p{L}\p{N}_])', 2) AS f FROM r),
m AS (SELECT doc_id, ltrim(w, '0') AS w, f, replace(f, '0', '') = '' AS whole, CAST(w || '.' || CASE f WHEN '' THEN '0' ELSE f END AS DECIMAL(38,12)) * 100 AS c FROM n WHERE w <> ''),
d AS (SELECT DISTINCT doc_id, CASE WHEN whole THEN CASE WHEN length(w) >= 4 THEN w END
        WHEN c >= 10000 THEN CAST(CAST((floor(c) + CASE WHEN c - floor(c) > 0.5 OR (c - floor(c) = 0.5 AND floor(c) % 2 = 1) THEN 1 ELSE 0 END) / 100 AS DECIMAL(28,2)) AS VARCHAR) END AS number FROM m)
SELECT DISTINCT number FROM d WHERE number IS NOT NULL
-- query: conversation_number_leaks
WITH r AS (SELECT conv_id AS doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_.,]+')) AS run FROM conversations),
n AS (SELECT doc_id, replace(regexp_extract(run, '^(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(?:$|[^\p{L}\p{N}_])', 1), ',', '') AS w,
             regexp_extract(run, '^(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(?:$|[^\p{L}\p{N}_])', 2) AS f FROM r),
m AS (SELECT doc_id, ltrim(w, '0') AS w, f, replace(f, '0', '') = '' AS whole, CAST(w || '.' || CASE f WHEN '' THEN '0' ELSE f END AS DECIMAL(38,12)) * 100 AS c FROM n WHERE w <> ''),
d AS (SELECT DISTINCT doc_id, CASE WHEN whole THEN CASE WHEN length(w) >= 4 THEN w END
        WHEN c >= 10000 THEN CAST(CAST((floor(c) + CASE WHEN c - floor(c) > 0.5 OR (c - floor(c) = 0.5 AND floor(c) % 2 = 1) THEN 1 ELSE 0 END) / 100 AS DECIMAL(28,2)) AS VARCHAR) END AS number FROM m)
SELECT doc_id, number FROM d WHERE number IN (SELECT number FROM @gold_number_collect UNION SELECT number FROM @gold_number_text_collect)
-- query: path_rule_scan
WITH s AS (SELECT row_number() OVER () AS row, page_id, rtrim(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/') AS path FROM pages),
f AS (SELECT unnest(['*ground_truth*', 'evals/*', '*/evals/*', 'benchmarks/*', '*/benchmarks/*', 'eval_harness/*', '*/eval_harness/*', 'parity/*', '*/parity/*', '*measures.py', '*.html']) AS pattern,
             generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], 1) AS priority),
b AS (SELECT DISTINCT substr(path, 1, 5) AS p FROM s WHERE length(path) >= 5),
h AS (SELECT row, pattern, priority FROM s JOIN f ON path GLOB pattern UNION ALL SELECT row, p || '*', 100 FROM s JOIN b ON substr(path, 1, 5) = p)
SELECT page_id, path, arg_min(pattern, (priority, pattern)) AS pattern FROM s JOIN h USING (row) GROUP BY row, page_id, path
