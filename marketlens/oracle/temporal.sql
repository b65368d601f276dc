-- query: visible_as_of
SELECT table_name, COUNT(*) FILTER (v) AS rows, MIN(d) FILTER (v) AS first_arrival, MAX(d) FILTER (v) AS last_arrival FROM (SELECT *, d <= DATE '1999-06-30' AS v FROM (
SELECT 'app_db__customers' AS table_name, created_date AS d FROM stg_app_customers UNION ALL SELECT 'app_db__products', introduced_date FROM stg_products
UNION ALL SELECT 'app_db__orders', order_date FROM stg_orders UNION ALL SELECT 'app_db__order_lines', order_date FROM stg_order_lines
UNION ALL SELECT 'app_db__plans', launched_date FROM stg_plans UNION ALL SELECT 'app_db__plan_prices', effective_date FROM stg_plan_prices
UNION ALL SELECT 'app_db__subscriptions', term_start_date FROM stg_subscriptions UNION ALL SELECT 'app_db__invoices', billed_date FROM stg_invoices
UNION ALL SELECT 'app_db__revenue_recognition', recognition_date FROM stg_revenue_recognition UNION ALL SELECT 'app_db__promotions', start_date FROM stg_promotions
UNION ALL SELECT 'stripe__refunds', refund_date FROM stg_refunds UNION ALL SELECT 'erp__suppliers', onboarded_date FROM stg_suppliers
UNION ALL SELECT 'erp__supplier_shipments', expected_date FROM stg_supplier_shipments UNION ALL SELECT 'ads__daily_spend', spend_date FROM stg_ad_spend
UNION ALL SELECT 'stripe__customers', created_date FROM stg_stripe_customers UNION ALL SELECT 'shopify__customers', created_date FROM stg_shopify_customers
UNION ALL SELECT 'salesforce__customers', created_date FROM stg_salesforce_customers UNION ALL SELECT 'app_db__customer_id_crosswalk', linked_date FROM stg_customer_id_crosswalk
UNION ALL SELECT 'zendesk__tickets', created_date FROM stg_tickets)) GROUP BY 1
-- query: mask_invoices
SELECT * REPLACE (CASE WHEN collected_date <= DATE '1999-06-30' THEN collected_date END AS collected_date, CAST(amount AS DOUBLE) AS amount)
FROM stg_invoices WHERE billed_date <= DATE '1999-06-30'
-- query: mask_stripe
SELECT * REPLACE (CASE WHEN deactivated_date <= DATE '1999-06-30' THEN deactivated_date END AS deactivated_date,
                  is_active OR deactivated_date > DATE '1999-06-30' AS is_active) FROM stg_stripe_customers WHERE created_date <= DATE '1999-06-30'
-- query: mask_subscriptions
SELECT * REPLACE (CASE WHEN term_end_date >= DATE '1999-06-30' THEN 'active' ELSE status END AS status,
                  CASE WHEN term_end_date < DATE '1999-06-30' THEN cancelled_date END AS cancelled_date,
                  CAST(price_per_seat AS DOUBLE) AS price_per_seat, CAST(acv AS DOUBLE) AS acv) FROM stg_subscriptions WHERE term_start_date <= DATE '1999-06-30'
-- query: mask_shipments
SELECT * REPLACE (CASE WHEN received_date <= DATE '1999-06-30' THEN received_date END AS received_date,
                  CASE WHEN received_date > DATE '1999-06-30' THEN 'in_transit' ELSE status END AS status)
FROM stg_supplier_shipments WHERE expected_date <= DATE '1999-06-30'
-- query: mask_tickets
SELECT * REPLACE (CASE WHEN resolved_date <= DATE '1999-06-30' THEN resolved_date END AS resolved_date,
                  CASE WHEN resolved_date > DATE '1999-06-30' THEN 'open' ELSE status END AS status) FROM stg_tickets WHERE created_date <= DATE '1999-06-30'
-- query: price_as_of
SELECT subscription_id, s.plan_id, CAST(a.p AS DOUBLE) AS start_price, CAST(b.p AS DOUBLE) AS end_price FROM stg_subscriptions s
LEFT JOIN (SELECT subscription_id, arg_max(annual_price_per_seat, effective_date) AS p FROM stg_subscriptions JOIN stg_plan_prices USING (plan_id)
           WHERE effective_date <= GREATEST(term_start_date, (SELECT launched_date FROM stg_plans x WHERE x.plan_id = stg_subscriptions.plan_id)) GROUP BY 1) a USING (subscription_id)
LEFT JOIN (SELECT subscription_id, arg_max(annual_price_per_seat, effective_date) AS p FROM stg_subscriptions JOIN stg_plan_prices USING (plan_id)
           WHERE effective_date <= GREATEST(term_end_date, (SELECT launched_date FROM stg_plans x WHERE x.plan_id = stg_subscriptions.plan_id)) GROUP BY 1) b USING (subscription_id)
-- query: alias_as_of
SELECT refund_id, customer_id, refund_date, stripe_customer_id FROM stg_refunds JOIN stg_orders USING (order_id)
-- query: plan_generation_at
SELECT subscription_id, term_start_date, CAST(CASE WHEN term_start_date <= DATE '1997-06-30' THEN 1 WHEN term_start_date <= DATE '1999-03-31' THEN 2 ELSE 3 END AS BIGINT) AS generation_on_sale
FROM stg_subscriptions
-- query: promo_match
SELECT order_id, CASE WHEN order_date < DATE '1997-12-31' THEN 'WELCOME10' WHEN order_date < DATE '1999-12-31' THEN 'SPRING5' ELSE 'BTB15' END AS promo_code
FROM stg_orders WHERE (order_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND channel IN ('d2c', 'direct'))
   OR ((order_date BETWEEN DATE '1998-04-01' AND DATE '1998-04-30' OR order_date BETWEEN DATE '2000-09-01' AND DATE '2000-09-30') AND channel <> 'business_subscription')
-- query: skus_available_at
SELECT c.category, last_day(CAST(m AS DATE)) AS as_of, COUNT(sku) AS skus_available
FROM range(DATE '1995-01-01', DATE '1996-01-01', INTERVAL 1 MONTH) r(m), (VALUES ('paper'), ('writing'), ('office_tech'), ('furniture'), ('breakroom'), ('storage')) c(category)
LEFT JOIN stg_products p ON p.category = c.category AND introduced_date <= last_day(CAST(m AS DATE)) GROUP BY 1, 2
-- query: snapshot_stability
WITH t AS (SELECT * FROM fct_subscriptions WHERE term_end_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'),
f AS (SELECT CAST(year(term_end_date) AS VARCHAR) || 'Q' || quarter(term_end_date) AS quarter, segment, COUNT(*) FILTER (status <> 'active') AS a,
             COUNT(*) FILTER (status <> 'active' AND term_end_date < DATE '1999-06-30') AS b,
             COUNT(*) FILTER (status = 'churned') AS c, COUNT(*) FILTER (status = 'churned' AND term_end_date < DATE '1999-06-30') AS d,
             CAST(COALESCE(SUM(acv) FILTER (status = 'churned'), 0) AS DOUBLE) AS e,
             CAST(COALESCE(SUM(acv) FILTER (status = 'churned' AND term_end_date < DATE '1999-06-30'), 0) AS DOUBLE) AS g
      FROM t WHERE status <> 'active' GROUP BY 1, 2),
l AS (SELECT quarter, segment, 'terms_up_for_renewal' AS column_name, CASE WHEN b > 0 THEN CAST(b AS DOUBLE) END AS left_value, CAST(a AS DOUBLE) AS right_value FROM f
      UNION ALL SELECT quarter, segment, 'churned', CASE WHEN b > 0 THEN CAST(d AS DOUBLE) END, CAST(c AS DOUBLE) FROM f
      UNION ALL SELECT quarter, segment, 'acv_churned', CASE WHEN b > 0 THEN g END, e FROM f
      UNION ALL SELECT quarter, segment, 'churn_rate', CASE WHEN b > 0 THEN ROUND(CAST(d AS DOUBLE) / b, 4) END, ROUND(CAST(c AS DOUBLE) / a, 4) FROM f)
SELECT *, COALESCE(ABS(left_value - right_value) <= 0.005 + 1e-9, false) AS agrees FROM l
-- query: snapshot_parity
WITH q AS (SELECT CAST(year(activity_date) AS VARCHAR) || 'Q' || quarter(activity_date) AS quarter, COALESCE(SUM(gmv), 0) AS g, COALESCE(SUM(net), 0) AS n,
                  COALESCE(SUM(rec), 0) AS r, COALESCE(SUM(bil), 0) AS b, COALESCE(SUM(cash), 0) AS c
           FROM rev_day WHERE activity_date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30' GROUP BY 1),
u AS (SELECT quarter, 'gmv' AS column_name, CAST(g AS DOUBLE) AS v FROM q UNION ALL SELECT quarter, 'net_revenue', CAST(n AS DOUBLE) FROM q
      UNION ALL SELECT quarter, 'recognized_revenue', CAST(r AS DOUBLE) FROM q UNION ALL SELECT quarter, 'billed_revenue', CAST(b AS DOUBLE) FROM q
      UNION ALL SELECT quarter, 'collected_cash', CAST(c AS DOUBLE) FROM q UNION ALL SELECT quarter, 'recognized_minus_gmv', CAST(r - g AS DOUBLE) FROM q)
SELECT quarter, column_name, v AS left_value, v AS right_value, true AS agrees FROM u
-- query: drip_feed_increment
SELECT * REPLACE (CASE WHEN term_end_date >= DATE '2000-12-31' THEN 'active' ELSE status END AS status,
                  CASE WHEN term_end_date < DATE '2000-12-31' THEN cancelled_date END AS cancelled_date,
                  CAST(price_per_seat AS DOUBLE) AS price_per_seat, CAST(acv AS DOUBLE) AS acv) FROM stg_subscriptions WHERE term_start_date <= DATE '2000-12-31'
-- query: drip_feed_tickets
SELECT * REPLACE (CASE WHEN resolved_date <= DATE '2000-12-31' THEN resolved_date END AS resolved_date,
                  CASE WHEN resolved_date > DATE '2000-12-31' THEN 'open' ELSE status END AS status) FROM stg_tickets WHERE created_date <= DATE '2000-12-31'
-- query: drip_feed_stream
SELECT * REPLACE (CASE WHEN collected_date <= DATE '2000-12-31' THEN collected_date END AS collected_date, CAST(amount AS DOUBLE) AS amount)
FROM stg_invoices WHERE billed_date <= DATE '2000-12-31'
-- query: order_rollup_from_lines
SELECT order_id, CAST(gross_amount AS DOUBLE) AS gross_amount, CAST(net_amount AS DOUBLE) AS net_amount FROM stg_orders WHERE channel <> 'business_subscription'
-- query: line_amount
SELECT order_line_id, CAST(ROUND(quantity * unit_price * (1 - discount_pct), 2) AS DOUBLE) AS line_amount FROM stg_order_lines
-- query: ratable_recognition
SELECT order_id, recognition_date, CAST(amount AS DOUBLE) AS amount FROM stg_revenue_recognition
-- query: invoice_schedule
SELECT order_id, order_date AS billed_date, order_date + 30 AS due_date, CAST(net_amount AS DOUBLE) AS amount FROM stg_orders WHERE channel = 'business_subscription'
-- query: term_chain
SELECT subscription_id, LAG(subscription_id) OVER w AS renewed_from_subscription_id, LEAD(subscription_id) OVER w IS NULL AS is_last_term, status, cancelled_date
FROM stg_subscriptions WINDOW w AS (PARTITION BY customer_id ORDER BY term_start_date, CAST(substr(subscription_id, 5) AS BIGINT))
-- query: term_bounds_acv
SELECT subscription_id, term_start_date, term_end_date, CAST(seats * price_per_seat AS DOUBLE) AS acv FROM stg_subscriptions
-- query: customer_profile_from_orders
SELECT app_db_customer_id, (SELECT MIN(order_date) FROM stg_orders o WHERE o.customer_id = app_db_customer_id) AS first_order_date, acquisition_channel,
       segment <> 'consumer' AS is_business FROM stg_app_customers
-- query: source_first_seen
SELECT 'stripe' AS source_system, customer_id, MIN(order_date) AS first_seen_date FROM stg_orders WHERE channel <> 'business_subscription' GROUP BY 2
UNION ALL SELECT 'shopify', customer_id, MIN(order_date) FROM stg_orders WHERE channel IN ('d2c', 'direct') GROUP BY 2
UNION ALL SELECT 'salesforce', customer_id, MIN(order_date) FROM stg_orders WHERE channel = 'business_subscription' GROUP BY 2
-- query: crosswalk_link_rules
WITH i AS (SELECT source_system AS s, source_customer_id AS id, source_created_date AS d, 'cust_' || regexp_extract(source_customer_id, '[0-9]+$') AS app,
                  CAST(regexp_extract(source_customer_id, '[0-9]+$') AS BIGINT) AS k FROM int_customer_identity)
SELECT s AS source_system, id AS source_customer_id, app AS app_db_customer_id,
       CASE WHEN s = 'app_db' THEN d WHEN s <> 'stripe' AND d < DATE '1997-07-01' THEN GREATEST(d, created_date, DATE '1997-07-01')
            ELSE GREATEST(d, created_date) + CAST(k % 31 AS INTEGER) END AS linked_date,
       CASE WHEN s = 'app_db' THEN 'primary_key' WHEN s <> 'stripe' AND d < DATE '1997-07-01' THEN '2021_migration' ELSE 'direct_sync' END AS link_method
FROM i JOIN stg_app_customers ON app_db_customer_id = app
-- query: ticket_requester_resolution
SELECT ticket_id, app_db_customer_id AS customer_id, requester_source_system, requester_source_id FROM stg_tickets
JOIN stg_customer_id_crosswalk ON source_system = requester_source_system AND source_customer_id = requester_source_id
-- query: chronological_ids
SELECT app_db_customer_id, created_date, ROW_NUMBER() OVER (ORDER BY created_date, CAST(substr(app_db_customer_id, 6) AS BIGINT)) AS seq FROM stg_app_customers
-- query: write_raw_tables
SELECT table_name, COUNT(*) AS rows FROM all_rows GROUP BY 1
-- query: scan_raw_tables
SELECT CASE channel WHEN 'direct' THEN 'd2c' ELSE channel END AS channel, COUNT(*) AS orders, CAST(SUM(gross_amount) AS DOUBLE) AS gross_amount FROM stg_orders GROUP BY 1
-- query: snapshot_overwrite
SELECT table_name, COUNT(*) FILTER (d <= DATE '1999-06-30') AS rows FROM all_rows GROUP BY 1
-- query: materialize_layer
SELECT channel, segment, COUNT(*) AS orders, CAST(SUM(gross_amount) AS DOUBLE) AS gmv FROM fct_orders GROUP BY 1, 2
-- query: export_mart
SELECT * REPLACE (CAST(price_per_seat AS DOUBLE) AS price_per_seat, CAST(acv AS DOUBLE) AS acv) FROM fct_subscriptions
-- query: visible_as_of_series
WITH r AS (
  SELECT 'app_db__customers' AS t, created_date AS d, NULL::DATE AS u, NULL::DECIMAL(18,2) AS a FROM stg_app_customers
  UNION ALL SELECT 'app_db__products', introduced_date, NULL, list_price FROM stg_products
  UNION ALL SELECT 'app_db__orders', order_date, NULL, gross_amount FROM stg_orders
  UNION ALL SELECT 'app_db__order_lines', order_date, NULL, line_amount FROM stg_order_lines
  UNION ALL SELECT 'app_db__plans', launched_date, retired_date, NULL FROM stg_plans
  UNION ALL SELECT 'app_db__plan_prices', effective_date, NULL, annual_price_per_seat FROM stg_plan_prices
  UNION ALL SELECT 'app_db__subscriptions', term_start_date, term_end_date + 1, acv FROM stg_subscriptions
  UNION ALL SELECT 'app_db__invoices', billed_date, collected_date, amount FROM stg_invoices
  UNION ALL SELECT 'app_db__revenue_recognition', recognition_date, NULL, amount FROM stg_revenue_recognition
  UNION ALL SELECT 'app_db__promotions', start_date, NULL, NULL FROM stg_promotions
  UNION ALL SELECT 'stripe__refunds', refund_date, NULL, refund_amount FROM stg_refunds
  UNION ALL SELECT 'erp__suppliers', onboarded_date, NULL, NULL FROM stg_suppliers
  UNION ALL SELECT 'erp__supplier_shipments', expected_date, received_date, NULL FROM stg_supplier_shipments
  UNION ALL SELECT 'ads__daily_spend', spend_date, NULL, spend_usd FROM stg_ad_spend
  UNION ALL SELECT 'stripe__customers', created_date, deactivated_date, NULL FROM stg_stripe_customers
  UNION ALL SELECT 'shopify__customers', created_date, NULL, NULL FROM stg_shopify_customers
  UNION ALL SELECT 'salesforce__customers', created_date, NULL, NULL FROM stg_salesforce_customers
  UNION ALL SELECT 'app_db__customer_id_crosswalk', linked_date, NULL, NULL FROM stg_customer_id_crosswalk
  UNION ALL SELECT 'zendesk__tickets', created_date, resolved_date, NULL FROM stg_tickets),
g AS (SELECT t, d, u, COUNT(*) AS c, SUM(a) AS a FROM r GROUP BY ALL),
m AS (SELECT last_day(CAST(x AS DATE)) AS as_of FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 MONTH) y(x)),
k AS (SELECT DISTINCT t, t IN ('app_db__invoices', 'stripe__customers', 'app_db__subscriptions', 'app_db__plans', 'erp__supplier_shipments', 'zendesk__tickets') AS late FROM r)
SELECT as_of, k.t AS table_name, CAST(COALESCE(SUM(c), 0) AS BIGINT) AS rows,
       CASE WHEN late THEN CAST(COALESCE(SUM(c) FILTER (u IS NULL OR u > as_of), 0) AS BIGINT) END AS open_rows, CAST(COALESCE(SUM(a), 0) AS DOUBLE) AS amount
FROM m CROSS JOIN k LEFT JOIN g ON g.t = k.t AND d <= as_of GROUP BY as_of, k.t, late
-- query: mart_increment
SELECT activity_date, measure_name, CAST(SUM(amount) AS DOUBLE) AS amount, COUNT(*) AS rows
FROM fct_revenue WHERE activity_date <= DATE '2000-12-31' GROUP BY 1, 2
-- query: mart_increment_customers
WITH a AS (
  SELECT i.source_system, i.source_created_date, i.app_db_customer_id AS id FROM int_customer_identity i
  WHERE i.app_db_customer_id IS NOT NULL AND i.linked_date <= DATE '2000-12-31' AND i.source_created_date <= DATE '2000-12-31'),
i AS (SELECT id, MIN(source_created_date) AS seen, COUNT(*) AS ids, list(DISTINCT source_system) AS systems FROM a GROUP BY id),
o AS (SELECT customer_id, MIN(order_date) AS first_order_date FROM stg_orders WHERE order_date <= DATE '2000-12-31' GROUP BY 1)
SELECT app_db_customer_id, COALESCE(seen, created_date) AS first_seen_date, segment, account_type, acquisition_channel, first_order_date,
       first_order_date IS NOT NULL AS has_order, COALESCE(ids, 0) AS resolved_source_id_count, CAST(COALESCE(len(systems), 0) AS BIGINT) AS resolved_source_system_count,
       COALESCE(list_contains(systems, 'app_db'), false) AS has_app_db, COALESCE(list_contains(systems, 'stripe'), false) AS has_stripe,
       COALESCE(list_contains(systems, 'shopify'), false) AS has_shopify, COALESCE(list_contains(systems, 'salesforce'), false) AS has_salesforce
FROM stg_app_customers LEFT JOIN i ON i.id = app_db_customer_id LEFT JOIN o ON o.customer_id = app_db_customer_id WHERE created_date <= DATE '2000-12-31'
-- query: revenue_stream
SELECT activity_date, measure_name, CAST(SUM(amount) AS DOUBLE) AS amount FROM fct_revenue WHERE activity_date <= DATE '2000-12-31' GROUP BY 1, 2
-- query: drip_feed_parity
SELECT table_name, rows AS increment_rows, rows AS snapshot_rows, true AS same_rows
FROM (SELECT table_name, rows FROM @visible_as_of_series WHERE as_of = DATE '2000-12-31')
