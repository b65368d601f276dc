-- query: identity_measures
WITH c AS (SELECT * FROM stg_app_customers WHERE created_date <= DATE '2001-06-30'),
x AS (SELECT * FROM stg_customer_id_crosswalk WHERE linked_date <= DATE '2001-06-30'),
a AS (SELECT 'app_db' AS s, app_db_customer_id AS id, created_date AS d FROM c
      UNION ALL SELECT 'stripe', stripe_customer_id, created_date FROM stg_stripe_customers WHERE created_date <= DATE '2001-06-30'
      UNION ALL SELECT 'shopify', shopify_customer_id, created_date FROM stg_shopify_customers WHERE created_date <= DATE '2001-06-30'
      UNION ALL SELECT 'salesforce', salesforce_customer_id, created_date FROM stg_salesforce_customers WHERE created_date <= DATE '2001-06-30'),
r AS (SELECT a.*, x.app_db_customer_id AS app FROM a LEFT JOIN x ON x.source_system = s AND x.source_customer_id = id),
o AS (SELECT * FROM stg_orders WHERE order_date <= DATE '2001-06-30'),
eo AS (SELECT o.* FROM o JOIN c ON c.app_db_customer_id = o.customer_id AND c.account_type = 'customer'),
ms AS (SELECT app FROM r WHERE app IS NOT NULL GROUP BY app HAVING COUNT(DISTINCT s) >= 2),
msr AS (SELECT app FROM ms JOIN c ON c.app_db_customer_id = app WHERE account_type = 'customer'),
safe AS (SELECT * FROM eo WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND customer_id IN (SELECT app FROM msr)),
fan AS (SELECT safe.gross_amount FROM safe JOIN r ON r.app = safe.customer_id)
SELECT (SELECT COUNT(*) FROM r) AS observed_source_id_count, (SELECT COUNT(DISTINCT id) FROM r) AS naive_distinct_source_id_count,
 (SELECT COUNT(app) FROM r) AS inner_join_retained_source_id_count, (SELECT COUNT(app) FROM r) AS resolved_source_id_count,
 (SELECT COUNT(*) - COUNT(app) FROM r) AS unresolved_source_id_count,
 (SELECT ROUND(CAST(COUNT(*) - COUNT(app) AS DOUBLE) / COUNT(*), 6) FROM r) AS resolution_null_rate,
 (SELECT COUNT(DISTINCT app) FROM r) AS distinct_resolved_canonical_id_count,
 (SELECT COUNT(DISTINCT customer_id) FROM eo) AS ordered_canonical_customer_count,
 (SELECT COUNT(*) FROM r WHERE s = 'shopify' AND d < DATE '1997-07-01') AS pre_migration_shopify_observed_count,
 (SELECT COUNT(app) FROM r WHERE s = 'shopify' AND d < DATE '1997-07-01') AS pre_migration_shopify_resolved_count,
 (SELECT COUNT(*) - COUNT(app) FROM r WHERE s = 'shopify' AND d < DATE '1997-07-01') AS pre_migration_shopify_missing_count,
 (SELECT COUNT(*) FROM msr) AS multi_source_canonical_customer_count,
 (SELECT COUNT(*) FROM safe) AS correct_multi_source_order_count,
 (SELECT CAST(COALESCE(SUM(gross_amount), 0) AS DOUBLE) FROM safe) AS correct_multi_source_gmv,
 (SELECT COUNT(*) FROM fan) AS unsafe_fanout_order_row_count, (SELECT CAST(COALESCE(SUM(gross_amount), 0) AS DOUBLE) FROM fan) AS unsafe_fanout_gmv,
 (SELECT COUNT(DISTINCT customer_id) FROM o) AS ordered_customer_count_including_test_internal,
 (SELECT CAST(COALESCE(SUM(gross_amount), 0) AS DOUBLE) FROM o WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
    AND customer_id IN (SELECT app FROM ms)) AS multi_source_gmv_including_test_internal
-- query: identity_ordered_customers
SELECT COUNT(DISTINCT o.customer_id) FILTER (account_type = 'customer') AS value,
       COUNT(DISTINCT o.customer_id) AS wrong_ordered_customer_count_including_test_internal,
       (SELECT COUNT(*) FROM int_customer_identity WHERE source_created_date <= DATE '2001-06-30') AS wrong_observed_source_id_count,
       (SELECT COUNT(DISTINCT app_db_customer_id) FROM stg_customer_id_crosswalk WHERE linked_date <= DATE '2001-06-30') AS wrong_distinct_resolved_canonical_id_count
FROM stg_orders o JOIN stg_app_customers c ON c.app_db_customer_id = o.customer_id WHERE order_date <= DATE '2001-06-30'
-- query: identity_premigration_missing
SELECT COUNT(*) - COUNT(x.app_db_customer_id) AS value, COUNT(*) AS pre_migration_shopify_observed_count,
       COUNT(x.app_db_customer_id) AS pre_migration_shopify_resolved_count,
       (SELECT COUNT(*) - COUNT(CASE WHEN linked_date <= DATE '2001-06-30' THEN 1 END) FROM int_customer_identity
         WHERE source_created_date <= DATE '2001-06-30') AS wrong_unresolved_source_id_count
FROM stg_shopify_customers s LEFT JOIN stg_customer_id_crosswalk x ON x.source_system = 'shopify'
 AND x.source_customer_id = s.shopify_customer_id AND x.linked_date <= DATE '2001-06-30'
WHERE s.created_date < DATE '1997-07-01'
-- query: identity_multi_source_gmv
WITH r AS (SELECT app_db_customer_id AS app, source_system AS s FROM int_customer_identity
           WHERE source_created_date <= DATE '2001-06-30' AND linked_date <= DATE '2001-06-30'),
m AS (SELECT app, COUNT(*) AS n FROM r GROUP BY app HAVING COUNT(DISTINCT s) >= 2),
o AS (SELECT gross_amount AS g, n, account_type = 'customer' AS real FROM stg_orders JOIN m ON app = customer_id
      JOIN stg_app_customers ON app_db_customer_id = customer_id WHERE year(order_date) = 2000)
SELECT CAST(COALESCE(SUM(g) FILTER (real), 0) AS DOUBLE) AS value, COUNT(*) FILTER (real) AS correct_multi_source_order_count,
       CAST(COALESCE(SUM(n) FILTER (real), 0) AS BIGINT) AS unsafe_fanout_order_row_count,
       CAST(COALESCE(SUM(g * n) FILTER (real), 0) AS DOUBLE) AS wrong_unsafe_fanout_gmv,
       CAST(COALESCE(SUM(g), 0) AS DOUBLE) AS wrong_multi_source_gmv_including_test_internal FROM o
-- query: identity_safe_vs_fanout_gmv
WITH e AS (SELECT app_db_customer_id FROM int_customer_identity WHERE resolution_status = 'resolved' GROUP BY 1 HAVING COUNT(DISTINCT source_system) >= 2),
o AS (SELECT customer_id, gross_amount FROM fct_orders WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31')
SELECT 'safe (deduplicated customer set)' AS path, COUNT(*) AS order_rows, CAST(SUM(gross_amount) AS DOUBLE) AS gmv
FROM o JOIN e ON app_db_customer_id = customer_id
UNION ALL
SELECT 'fanout (orders x alias bridge)', COUNT(*), CAST(SUM(gross_amount) AS DOUBLE)
FROM o JOIN int_customer_identity i ON i.app_db_customer_id = o.customer_id AND resolution_status = 'resolved'
JOIN e ON e.app_db_customer_id = o.customer_id
-- query: identity_quality
WITH i AS (SELECT source_system AS s, source_created_date AS d, CASE WHEN linked_date <= DATE '2001-06-30' THEN app_db_customer_id END AS app
           FROM int_customer_identity WHERE source_created_date <= DATE '2001-06-30'),
b AS (SELECT DISTINCT customer_id FROM fct_orders WHERE order_date <= DATE '2001-06-30'),
n AS (SELECT app, COUNT(*) AS ids FROM i WHERE app IS NOT NULL GROUP BY 1)
SELECT COUNT(*) AS alias_count, COUNT(*) FILTER (app IS NULL) AS unresolved_count,
       ROUND(CAST(COUNT(*) FILTER (app IS NULL) AS DOUBLE) / COUNT(*), 6) AS null_rate,
       (SELECT COUNT(*) FROM stg_app_customers WHERE created_date <= DATE '2001-06-30') AS canonical_profiles,
       (SELECT COUNT(*) FROM b) AS ordered_customers,
       (SELECT ROUND(AVG(ids), 3) FROM b JOIN n ON app = customer_id) AS avg_source_ids_per_ordered_customer,
       COUNT(*) FILTER (app IS NULL AND s = 'shopify' AND d < DATE '1997-07-01') AS pre_migration_shopify_missing,
       COUNT(*) FILTER (app IS NULL AND s = 'salesforce' AND d < DATE '1997-07-01') AS pre_migration_salesforce_missing FROM i
-- query: identity_quality_by_system
WITH i AS (SELECT source_system, source_created_date AS d, linked_date <= DATE '2001-06-30' AS ok
           FROM int_customer_identity WHERE source_created_date <= DATE '2001-06-30'),
j AS (SELECT source_system, CASE WHEN ok THEN 'r' WHEN source_system IN ('shopify', 'salesforce') AND d < DATE '1997-07-01' THEN 'g' ELSE 'l' END AS st FROM i)
SELECT source_system, COUNT(*) FILTER (st = 'r') AS resolved, COUNT(*) FILTER (st = 'g') AS unresolved_migration_gap,
       COUNT(*) FILTER (st = 'l') AS unresolved_sync_lag FROM j GROUP BY 1
-- query: naive_vs_canonical
SELECT 'Σ per-system profiles (naive)' AS label, COUNT(*) AS customers FROM int_customer_identity WHERE source_created_date <= DATE '2001-06-30'
UNION ALL SELECT 'Canonical app profiles', COUNT(*) FROM stg_app_customers WHERE created_date <= DATE '2001-06-30'
UNION ALL SELECT 'Ever-ordered customers', COUNT(DISTINCT customer_id) FROM fct_orders WHERE order_date <= DATE '2001-06-30'
-- query: identity_health
SELECT COUNT(*) AS source_aliases, COUNT(*) FILTER (app_db_customer_id IS NULL) AS unresolved_aliases,
       CAST(COUNT(*) FILTER (app_db_customer_id IS NULL) AS DOUBLE) / COUNT(*) AS resolution_null_rate,
       (SELECT COUNT(*) FROM dim_customers) AS canonical_profiles, (SELECT COUNT(*) FROM dim_customers WHERE has_order) AS ordered_customers,
       (SELECT AVG(resolved_source_id_count) FROM dim_customers WHERE has_order AND resolved_source_id_count > 0) AS avg_ids_per_ordered_customer,
       COUNT(*) FILTER (source_system = 'shopify' AND app_db_customer_id IS NULL AND source_created_date < DATE '1997-07-01') AS pre_migration_shopify_unlinked,
       COUNT(*) FILTER (source_system = 'salesforce' AND app_db_customer_id IS NULL AND source_created_date < DATE '1997-07-01') AS pre_migration_salesforce_unlinked
FROM int_customer_identity
-- query: identity_by_system
SELECT source_system, resolution_status, COUNT(*) AS aliases,
       CASE resolution_status WHEN 'resolved' THEN 'Resolved' WHEN 'unresolved_migration_gap' THEN 'Unresolved — 2021 migration gap'
            WHEN 'unresolved_sync_lag' THEN 'Unresolved — sync lag' END AS status_label
FROM int_customer_identity GROUP BY 1, 2
-- query: identity_null_rate_overall
SELECT CAST(SUM(observed_id_count) AS BIGINT) AS observed_source_ids, CAST(SUM(resolved_id_count) AS BIGINT) AS resolved_source_ids,
       CAST(SUM(unresolved_id_count) AS BIGINT) AS unresolved_source_ids,
       CAST(SUM(unresolved_id_count) AS DOUBLE) / CAST(SUM(observed_id_count) AS DOUBLE) AS resolution_null_rate FROM quality_mart
-- query: canonical_customer_count
SELECT COUNT(DISTINCT customer_id) AS ordered_canonical_customers FROM fct_orders
-- query: crosswalk_unmatched_by_signup_year
WITH b AS (SELECT DISTINCT customer_id FROM stg_orders WHERE order_date <= DATE '2001-06-30'),
f AS (SELECT CAST(year(created_date) AS BIGINT) AS signup_year, COALESCE(account_type = 'customer', false) AS real,
             customer_id NOT IN (SELECT app_db_customer_id FROM stg_customer_id_crosswalk WHERE linked_date <= DATE '2001-06-30') AS un
      FROM b LEFT JOIN (SELECT * FROM stg_app_customers WHERE created_date <= DATE '2001-06-30') ON app_db_customer_id = customer_id)
SELECT signup_year, COUNT(*) AS order_customers, COUNT(*) FILTER (un) AS unmatched_customers,
       CAST(COUNT(*) FILTER (un) AS DOUBLE) / COUNT(*) AS unmatched_rate, COUNT(*) FILTER (real) AS real_order_customers,
       COUNT(*) FILTER (real AND un) AS real_unmatched_customers,
       CAST(COUNT(*) FILTER (real AND un) AS DOUBLE) / NULLIF(COUNT(*) FILTER (real), 0) AS real_unmatched_rate FROM f GROUP BY 1
-- query: multi_stripe_id_customers
WITH al AS (SELECT stripe_customer_id, is_active OR deactivated_date > DATE '2001-06-30' AS act, x.app_db_customer_id AS app
            FROM stg_stripe_customers LEFT JOIN stg_customer_id_crosswalk x ON x.source_system = 'stripe'
             AND x.source_customer_id = stripe_customer_id AND linked_date <= DATE '2001-06-30' WHERE created_date <= DATE '2001-06-30'),
many AS (SELECT app FROM al WHERE app IS NOT NULL GROUP BY app HAVING COUNT(*) > 1),
manyr AS (SELECT app FROM many JOIN stg_app_customers ON app_db_customer_id = app WHERE account_type = 'customer'),
co AS (SELECT DISTINCT customer_id FROM fct_orders WHERE year(order_date) = 1999),
ret AS (SELECT customer_id, customer_id IN (SELECT customer_id FROM fct_orders WHERE year(order_date) = 2000) AS k FROM co),
br AS (SELECT k, act FROM ret JOIN al ON app = customer_id)
SELECT (SELECT COUNT(*) FROM manyr) AS value, (SELECT COUNT(*) FROM co WHERE customer_id IN (SELECT app FROM manyr)) AS multi_in_retention_cohort,
       (SELECT COUNT(*) FROM co) AS cohort_customers, (SELECT COUNT(*) FROM ret WHERE k) AS retained_customers,
       (SELECT ROUND(AVG(CASE WHEN k THEN 1.0::DOUBLE ELSE 0 END), 4) FROM ret) AS canonical_retention,
       (SELECT COUNT(*) FROM al WHERE app IS NULL) AS unresolved_stripe_ids, (SELECT COUNT(*) FROM many) AS including_test_and_internal,
       (SELECT COUNT(*) FROM al WHERE NOT act) AS deactivated_stripe_ids,
       (SELECT ROUND(AVG(CASE WHEN k THEN 1.0::DOUBLE ELSE 0 END), 4) FROM br) AS alias_bridge_retention,
       (SELECT ROUND(AVG(CASE WHEN k AND act THEN 1.0::DOUBLE ELSE 0 END), 4) FROM br) AS alias_is_active_retention
-- query: zendesk_tickets_unlinked
SELECT COUNT(*) AS value, MIN(created_date) AS first_created_date, MAX(created_date) AS last_created_date,
       COUNT(*) FILTER (vo) AS linked_via_order, COUNT(*) FILTER (vs) AS linked_via_subscription,
       COUNT(*) FILTER (NOT (vo OR vs)) AS completely_untraceable_tickets FROM unlinked
-- query: zendesk_tickets_unlinked_by_source
SELECT requester_source_system AS source_system, COUNT(*) AS tickets, MIN(created_date) AS first_created_date,
       MAX(created_date) AS last_created_date FROM unlinked GROUP BY 1
-- query: zendesk_tickets_unlinked_by_month
SELECT strftime(created_date, '%Y-%m') AS month, COUNT(*) AS tickets FROM unlinked GROUP BY 1
-- query: identity
WITH i AS (SELECT source_customer_id AS id, COALESCE(linked_date <= DATE '2001-06-30', false) AS ok FROM int_customer_identity WHERE source_created_date <= DATE '2001-06-30')
SELECT ROUND(CAST(COUNT(*) FILTER (NOT ok) AS DOUBLE) / COUNT(*), 6) AS value, COUNT(*) FILTER (NOT ok) AS unresolved_source_id_count,
       COUNT(*) FILTER (ok) AS wrong_inner_join_retained_source_id_count, COUNT(DISTINCT id) AS wrong_naive_distinct_source_id_count FROM i
