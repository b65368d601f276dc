-- cte: base_orders
SELECT k, ok, ch, CASE WHEN since BETWEEN 0 AND 2404 THEN DATE '1995-01-01' + CAST(late + since * (2404 - late) // 2404 AS INTEGER)
                       ELSE given END AS d
FROM (SELECT o_custkey AS k, o_orderkey AS ok, CAST(o_orderdate AS DATE) AS given,
       CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS since, COALESCE((o_custkey * 37 % 2000 + 2000) % 2000, 0) AS late,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey % 3 = 1 THEN 'business_subscription'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'marketplace' ELSE 'd2c' END AS ch
      FROM orders)
-- cte: consumer_base
SELECT b.*,
       CASE WHEN d BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND ch = 'd2c' AND ok % 100 < 35 THEN 'WELCOME10'
            WHEN d BETWEEN DATE '1998-04-01' AND DATE '1998-04-30' AND ok % 100 < 40 THEN 'SPRING5'
            WHEN d BETWEEN DATE '2000-09-01' AND DATE '2000-09-30' AND ok % 100 < 70 THEN 'BTB15' END AS promo
FROM base_orders b WHERE ch <> 'business_subscription'
-- cte: stg_products
SELECT 'sku_' || p_partkey AS sku, p_name AS product_name,
       CASE p_type WHEN 'ECONOMY' THEN 'paper' WHEN 'SMALL' THEN 'writing' WHEN 'MEDIUM' THEN 'office_tech'
                   WHEN 'PROMO' THEN 'furniture' WHEN 'STANDARD' THEN 'breakroom' WHEN 'LARGE' THEN 'storage' END AS category,
       'sup_' || CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 2
                   WHEN 'PROMO' THEN 3 WHEN 'STANDARD' THEN 4 WHEN 'LARGE' THEN 5 END AS supplier_id,
       CAST(ROUND(CAST(p_retailprice AS DECIMAL(18,2)) * (50 + p_partkey % 30) * 0.01, 2) AS DECIMAL(18,2)) AS unit_cost,
       CAST(p_retailprice AS DECIMAL(18,2)) AS list_price,
       DATE '1995-01-01' + CAST(p_partkey % 365 AS INTEGER) AS introduced_date
FROM part
-- cte: stg_suppliers
SELECT 'sup_' || s_suppkey AS supplier_id, s_name AS supplier_name,
       CASE s_suppkey % 6 WHEN 0 THEN 'paper' WHEN 1 THEN 'writing' WHEN 2 THEN 'office_tech'
                      WHEN 3 THEN 'furniture' WHEN 4 THEN 'breakroom' ELSE 'storage' END AS category,
       DATE '1995-01-01' AS onboarded_date
FROM supplier
-- cte: stg_supplier_shipments
SELECT 'shp_' || category || '_' || strftime(w, '%Y%m%d') AS shipment_id, supplier_id, category, w AS expected_date,
       CASE WHEN NOT stopped THEN w + CAST(CAST(substr(supplier_id, 5) AS INTEGER) % 4 AS INTEGER) END AS received_date,
       units AS units_expected,
       CAST(CASE WHEN stopped THEN 0 WHEN dayofyear(w) % 33 = 0 THEN units * 8 // 10 ELSE units END AS BIGINT) AS units_received,
       CASE WHEN stopped THEN 'delayed' WHEN dayofyear(w) % 33 = 0 THEN 'partial' ELSE 'received' END AS status
FROM (SELECT p.category, p.supplier_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS w,
             CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units,
             p.category = 'paper' AND CAST(date_trunc('week', l_shipdate) AS DATE)
                 BETWEEN DATE '1999-03-06' AND DATE '1999-04-09' AS stopped
      FROM lineitem JOIN stg_products p ON p.sku = 'sku_' || l_partkey GROUP BY ALL)
-- cte: stg_plans
SELECT * FROM (VALUES
 ('starter_v1', 'Business Starter', CAST(1 AS BIGINT), 'smb', DATE '1995-01-01', DATE '1997-06-30', false),
 ('pro_v1', 'Business Pro', 1, 'enterprise', DATE '1995-01-01', DATE '1997-06-30', false),
 ('team_v2', 'Team', 2, 'smb', DATE '1997-07-01', DATE '1999-03-31', false),
 ('office_v2', 'Office', 2, 'smb', DATE '1997-07-01', DATE '1999-03-31', false),
 ('enterprise_v2', 'Enterprise', 2, 'enterprise', DATE '1997-07-01', DATE '1999-03-31', false),
 ('essentials', 'Essentials', 3, 'smb', DATE '1999-04-01', NULL, true),
 ('growth', 'Growth', 3, 'smb', DATE '1999-04-01', NULL, true),
 ('enterprise', 'Enterprise', 3, 'enterprise', DATE '1999-04-01', NULL, true))
 AS t(plan_id, plan_name, plan_generation, tier, launched_date, retired_date, is_current)
-- cte: stg_plan_prices
SELECT plan_id, effective_date, CAST(p AS DECIMAL(18,2)) AS annual_price_per_seat FROM (VALUES
 ('starter_v1', DATE '1995-01-01', 84.00), ('pro_v1', DATE '1995-01-01', 156.00),
 ('team_v2', DATE '1997-07-01', 108.00), ('office_v2', DATE '1997-07-01', 192.00),
 ('enterprise_v2', DATE '1997-07-01', 228.00), ('essentials', DATE '1999-04-01', 120.00),
 ('growth', DATE '1999-04-01', 204.00), ('enterprise', DATE '1999-04-01', 252.00),
 ('essentials', DATE '2001-05-01', 134.40), ('growth', DATE '2001-05-01', 228.48),
 ('enterprise', DATE '2001-05-01', 282.24)) AS t(plan_id, effective_date, p)
-- cte: stg_promotions
SELECT promo_code, promo_name, start_date, end_date, CAST(disc AS DECIMAL(5,4)) AS discount_pct, eligible_channels
FROM (VALUES
 ('WELCOME10', 'Welcome 10', DATE '1997-03-01', DATE '1997-03-31', 0.10, 'd2c'),
 ('SPRING5', 'Spring Refresh', DATE '1998-04-01', DATE '1998-04-30', 0.05, 'd2c,marketplace'),
 ('BTB15', 'Back to Business', DATE '2000-09-01', DATE '2000-09-30', 0.15, 'd2c,marketplace'))
 AS t(promo_code, promo_name, start_date, end_date, disc, eligible_channels)
-- cte: stg_order_lines
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS order_line_id,
       'ord_' || ok AS order_id, 'sku_' || l_partkey AS sku, CAST(l_quantity AS BIGINT) AS quantity, p.list_price AS unit_price,
       disc AS discount_pct,
       CAST(ROUND(CAST(l_quantity AS BIGINT) * p.list_price * (1 - disc), 2) AS DECIMAL(18,2)) AS line_amount,
       d AS order_date
FROM lineitem
JOIN (SELECT *, CAST(CASE promo WHEN 'WELCOME10' THEN 0.10 WHEN 'SPRING5' THEN 0.05 WHEN 'BTB15' THEN 0.15 ELSE 0 END
             AS DECIMAL(5,4)) AS disc FROM consumer_base) c ON c.ok = l_orderkey
LEFT JOIN stg_products p ON p.sku = 'sku_' || l_partkey
-- cte: term_rows
SELECT b.k, b.ok, b.d, LAG(ok) OVER w AS prev_ok, LEAD(ok) OVER w AS next_ok,
       FIRST_VALUE(d) OVER w AS d0, FIRST_VALUE(ok) OVER w AS ok0
FROM base_orders b WHERE ch = 'business_subscription' WINDOW w AS (PARTITION BY k ORDER BY d, ok)
-- cte: stg_subscriptions
SELECT 'sub_' || ok AS subscription_id, 'cust_' || t.k AS customer_id, t.plan_id, seats,
       d AS term_start_date, CAST(d + INTERVAL 12 MONTH AS DATE) - 1 AS term_end_date,
       price AS price_per_seat, CAST(seats * price AS DECIMAL(18,2)) AS acv, 'ord_' || ok AS order_id,
       'sub_' || prev_ok AS renewed_from_subscription_id, status,
       CASE WHEN status = 'churned' THEN CAST(d + INTERVAL 12 MONTH AS DATE) - 1 END AS cancelled_date
FROM (SELECT r.*, p.plan_id,
             CAST(CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 50 * (40 + r.k % 160) ELSE 50 * (3 + r.k % 58) END AS BIGINT) AS seats,
             (SELECT arg_max(annual_price_per_seat, effective_date) FROM stg_plan_prices x
               WHERE x.plan_id = p.plan_id AND x.effective_date <= GREATEST(r.d, p.launched_date)) AS price,
             CASE WHEN next_ok IS NOT NULL THEN 'renewed'
                  WHEN CAST(d + INTERVAL 12 MONTH AS DATE) <= DATE '2001-08-01' THEN 'churned' ELSE 'active' END AS status
      FROM term_rows r LEFT JOIN customer c ON c.c_custkey = r.k
      LEFT JOIN stg_plans p ON p.tier = CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'enterprise' ELSE 'smb' END
       AND r.d0 >= p.launched_date AND (p.retired_date IS NULL OR r.d0 <= p.retired_date)
       AND (p.plan_id NOT IN ('team_v2', 'office_v2', 'essentials', 'growth')
            OR (r.ok0 % 2 = 0) = (p.plan_id IN ('team_v2', 'essentials')))) t
-- cte: stg_orders
SELECT order_id, 'cust_' || k AS customer_id, ch AS channel, d AS order_date, gross AS gross_amount, take AS take_rate,
       CASE WHEN take IS NULL THEN gross ELSE CAST(ROUND(gross * take, 2) AS DECIMAL(18,2)) END AS net_amount,
       promo AS promo_code, CAST(NULL AS VARCHAR) AS subscription_id
FROM (SELECT c.*, CAST(COALESCE(total, 0) AS DECIMAL(18,2)) AS gross FROM
     (SELECT 'ord_' || ok AS order_id, k, d, promo,
             CASE WHEN ch = 'd2c' AND d < DATE '1998-06-01' THEN 'direct' ELSE ch END AS ch,
             CASE WHEN ch = 'marketplace' THEN CAST(0.15 + (ok % 11) * 0.01 AS DECIMAL(5,4)) END AS take
      FROM consumer_base) c
LEFT JOIN (SELECT order_id AS lines_of, SUM(line_amount) AS total FROM stg_order_lines GROUP BY order_id) l ON lines_of = order_id)
UNION ALL
SELECT order_id, customer_id, 'business_subscription', term_start_date, acv, NULL, acv, NULL, subscription_id FROM stg_subscriptions
-- cte: stg_app_customers
SELECT 'cust_' || c_custkey AS app_db_customer_id,
       CASE WHEN account_type = 'internal' THEN DATE '1995-01-01'
            ELSE COALESCE(first_date, DATE '1995-01-01' + CAST(c_custkey % 2190 AS INTEGER)) END AS created_date,
       CASE WHEN NOT COALESCE(biz, false) THEN 'consumer'
            WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'enterprise' ELSE 'smb' END AS segment,
       account_type, COALESCE(ch1, 'signup') AS acquisition_channel
FROM (SELECT *, CASE WHEN c_custkey % 67 = 3 THEN 'test' WHEN c_custkey % 101 = 7 THEN 'internal' ELSE 'customer' END AS account_type
      FROM customer)
LEFT JOIN (SELECT customer_id, MIN(order_date) AS first_date, BOOL_OR(channel = 'business_subscription') AS biz,
                  FIRST(CASE channel WHEN 'direct' THEN 'd2c' ELSE channel END
                        ORDER BY order_date, CAST(substr(order_id, 5) AS BIGINT)) AS ch1
           FROM stg_orders GROUP BY customer_id) ON customer_id = 'cust_' || c_custkey
-- cte: stg_invoices
SELECT 'inv_' || substr(order_id, 5) AS invoice_id, order_id, order_date AS billed_date, order_date + 30 AS due_date,
       CASE WHEN CAST(substr(order_id, 5) AS BIGINT) % 25 <> 0
            THEN order_date + CAST(27 + CAST(substr(order_id, 5) AS BIGINT) % 15 AS INTEGER) END AS collected_date,
       net_amount AS amount, CAST(substr(order_id, 5) AS BIGINT) % 25 = 0 AS is_bad_debt,
       'sfc_' || substr(customer_id, 6) AS salesforce_customer_id
FROM stg_orders WHERE channel = 'business_subscription'
-- cte: stg_revenue_recognition
SELECT order_id, CAST(order_date + CAST(m AS INTEGER) * INTERVAL 1 MONTH AS DATE) AS recognition_date,
       CAST(ROUND(CAST(net_amount AS DECIMAL(18,2)) / 12, 2) AS DECIMAL(18,2)) AS amount
FROM stg_orders, range(12) r(m) WHERE channel = 'business_subscription'
UNION ALL
SELECT order_id, order_date, net_amount FROM stg_orders WHERE channel <> 'business_subscription'
-- cte: stg_stripe_customers
WITH f AS (SELECT CAST(substr(customer_id, 6) AS BIGINT) AS k, MIN(order_date) AS d FROM stg_orders
           WHERE channel <> 'business_subscription' GROUP BY 1),
g AS (SELECT k, d, CASE WHEN k % 16 = 5 THEN d + CAST(200 + k % 300 AS INTEGER) END AS moved FROM f)
SELECT 'cus_' || k AS stripe_customer_id, d AS created_date, moved IS NULL AS is_active, moved AS deactivated_date FROM g
UNION ALL SELECT 'cus_r_' || k, moved, true, NULL FROM g WHERE moved IS NOT NULL
-- cte: stg_shopify_customers
SELECT 'shp_' || substr(customer_id, 6) AS shopify_customer_id, MIN(order_date) AS created_date, true AS is_active
FROM stg_orders WHERE channel IN ('direct', 'd2c') GROUP BY customer_id
-- cte: stg_salesforce_customers
SELECT 'sfc_' || substr(customer_id, 6) AS salesforce_customer_id, MIN(order_date) AS created_date, true AS is_active
FROM stg_orders WHERE channel = 'business_subscription' GROUP BY customer_id
-- cte: stg_refunds
SELECT 'ref_' || x AS refund_id, order_id, rd AS refund_date, net_amount AS refund_amount,
       COALESCE((SELECT arg_max(stripe_customer_id, created_date) FROM stg_stripe_customers s
                  WHERE s.stripe_customer_id IN ('cus_' || k, 'cus_r_' || k) AND created_date <= rd), 'cus_' || k) AS stripe_customer_id
FROM (SELECT *, CAST(substr(order_id, 5) AS BIGINT) AS x, substr(customer_id, 6) AS k,
             order_date + CAST(3 + CAST(substr(order_id, 5) AS BIGINT) % 42 AS INTEGER) AS rd
      FROM stg_orders WHERE channel <> 'business_subscription' AND CAST(substr(order_id, 5) AS BIGINT) % 17 = 0)
-- cte: stg_customer_id_crosswalk
WITH a AS (
 SELECT 'app_db' AS s, app_db_customer_id AS id, CAST(substr(app_db_customer_id, 6) AS BIGINT) AS k, created_date AS d FROM stg_app_customers
 UNION ALL SELECT 'stripe', stripe_customer_id, CAST(regexp_extract(stripe_customer_id, '[0-9]+$') AS BIGINT), created_date FROM stg_stripe_customers
 UNION ALL SELECT 'shopify', shopify_customer_id, CAST(substr(shopify_customer_id, 5) AS BIGINT), created_date FROM stg_shopify_customers
 UNION ALL SELECT 'salesforce', salesforce_customer_id, CAST(substr(salesforce_customer_id, 5) AS BIGINT), created_date FROM stg_salesforce_customers),
b AS (SELECT a.*, c.app_db_customer_id, c.created_date AS app_d, s IN ('shopify', 'salesforce') AND d < DATE '1997-07-01' AS mig
      FROM a JOIN stg_app_customers c ON c.app_db_customer_id = 'cust_' || k)
SELECT s AS source_system, id AS source_customer_id, app_db_customer_id,
       CASE WHEN s = 'app_db' THEN d WHEN mig THEN GREATEST(d, app_d, DATE '1997-07-01')
            ELSE GREATEST(d, app_d) + CAST(k % 31 AS INTEGER) END AS linked_date,
       CASE WHEN s = 'app_db' THEN 'primary_key' WHEN mig THEN '2021_migration' ELSE 'direct_sync' END AS link_method
FROM b WHERE NOT (mig AND k % 8 = 2)
-- cte: stg_ad_spend
SELECT CAST(CAST(ts AS DATE) - INTERVAL 288 MONTH AS DATE) AS spend_date,
       CASE user_id % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'meta' ELSE 'tiktok' END AS platform,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS spend_usd,
       CAST(30 * COUNT(*) FILTER (event_type = 'click') AS BIGINT) AS impressions,
       CAST(COUNT(*) FILTER (event_type = 'click') AS BIGINT) AS clicks,
       CAST(COUNT(*) FILTER (event_type = 'signup') AS BIGINT) AS reported_conversions
FROM events GROUP BY 1, 2
-- cte: stg_tickets
WITH e AS (SELECT event_id, 'cust_' || (event_id % (SELECT COUNT(*) FROM customer)) AS cid,
                  DATE '1996-01-01' + CAST((event_id * 7) % 2000 AS INTEGER) AS d FROM events WHERE event_type = 'error'),
fo AS (SELECT customer_id, FIRST(order_id ORDER BY order_date, CAST(substr(order_id, 5) AS BIGINT)) AS oid FROM stg_orders GROUP BY 1),
ft AS (SELECT customer_id, FIRST(subscription_id ORDER BY term_start_date, CAST(substr(subscription_id, 5) AS BIGINT)) AS sid
       FROM stg_subscriptions GROUP BY 1),
st AS (SELECT x.app_db_customer_id, s.stripe_customer_id, s.created_date FROM stg_customer_id_crosswalk x
       JOIN stg_stripe_customers s ON x.source_system = 'stripe' AND s.stripe_customer_id = x.source_customer_id),
w AS (SELECT e.*, c.segment, sf.source_customer_id AS sf_id,
             COALESCE(s_at.id, s_first.id) AS st_id
      FROM e LEFT JOIN stg_app_customers c ON c.app_db_customer_id = cid
      LEFT JOIN (SELECT * FROM stg_customer_id_crosswalk WHERE source_system = 'salesforce') sf ON sf.app_db_customer_id = cid
      LEFT JOIN (SELECT event_id, arg_max(stripe_customer_id, created_date) AS id FROM e JOIN st ON st.app_db_customer_id = cid
                 WHERE created_date <= d GROUP BY 1) s_at ON s_at.event_id = e.event_id
      LEFT JOIN (SELECT app_db_customer_id, arg_min(stripe_customer_id, created_date) AS id FROM st GROUP BY 1) s_first
        ON s_first.app_db_customer_id = cid)
SELECT 'zd_' || event_id AS ticket_id, sys AS requester_source_system,
       CASE sys WHEN 'salesforce' THEN sf_id WHEN 'stripe' THEN st_id ELSE cid END AS requester_source_id, d AS created_date,
       ['shipping', 'product', 'billing', 'account', 'technical', 'onboarding'][CAST(event_id % 6 + 1 AS INTEGER)] AS category,
       CASE WHEN event_id % 20 = 0 THEN 'urgent' WHEN event_id % 20 <= 3 THEN 'high' WHEN event_id % 20 <= 11 THEN 'normal' ELSE 'low' END AS priority,
       CASE WHEN r <= DATE '2001-08-01' THEN 'solved' ELSE 'open' END AS status,
       CASE WHEN r <= DATE '2001-08-01' THEN r END AS resolved_date,
       oid AS related_order_id, sid AS related_subscription_id
FROM (SELECT w.*, d + CAST(event_id % 15 AS INTEGER) AS r,
             CASE WHEN segment IN ('smb', 'enterprise') AND sf_id IS NOT NULL THEN 'salesforce'
                  WHEN segment NOT IN ('smb', 'enterprise') AND st_id IS NOT NULL THEN 'stripe' ELSE 'app_db' END AS sys FROM w)
LEFT JOIN fo ON fo.customer_id = cid LEFT JOIN ft ON ft.customer_id = cid
-- cte: int_customer_identity
SELECT o.*, x.app_db_customer_id, x.linked_date, x.link_method,
       CASE WHEN x.app_db_customer_id IS NOT NULL THEN 'resolved'
            WHEN o.source_system IN ('shopify', 'salesforce') AND source_created_date < DATE '1997-07-01' THEN 'unresolved_migration_gap'
            ELSE 'unresolved_sync_lag' END AS resolution_status
FROM (SELECT 'app_db' AS source_system, app_db_customer_id AS source_customer_id, created_date AS source_created_date,
             true AS is_active, CAST(NULL AS DATE) AS deactivated_date FROM stg_app_customers
      UNION ALL SELECT 'stripe', stripe_customer_id, created_date, is_active, deactivated_date FROM stg_stripe_customers
      UNION ALL SELECT 'shopify', shopify_customer_id, created_date, is_active, NULL FROM stg_shopify_customers
      UNION ALL SELECT 'salesforce', salesforce_customer_id, created_date, is_active, NULL FROM stg_salesforce_customers) o
LEFT JOIN stg_customer_id_crosswalk x USING (source_system, source_customer_id)
-- cte: dim_customers
SELECT c.app_db_customer_id, COALESCE(seen, created_date) AS first_seen_date, segment, account_type, acquisition_channel,
       first_order_date, COALESCE(oc, 0) > 0 AS has_order, CAST(COALESCE(ids, 0) AS BIGINT) AS resolved_source_id_count,
       CAST(COALESCE(systems, 0) AS BIGINT) AS resolved_source_system_count,
       COALESCE(a, false) AS has_app_db, COALESCE(s, false) AS has_stripe, COALESCE(h, false) AS has_shopify, COALESCE(f, false) AS has_salesforce
FROM stg_app_customers c
LEFT JOIN (SELECT app_db_customer_id, MIN(source_created_date) AS seen, COUNT(*) AS ids, COUNT(DISTINCT source_system) AS systems,
                  BOOL_OR(source_system = 'app_db') AS a, BOOL_OR(source_system = 'stripe') AS s,
                  BOOL_OR(source_system = 'shopify') AS h, BOOL_OR(source_system = 'salesforce') AS f
           FROM int_customer_identity WHERE resolution_status = 'resolved' GROUP BY 1) i USING (app_db_customer_id)
LEFT JOIN (SELECT customer_id, COUNT(*) AS oc, MIN(order_date) AS first_order_date FROM stg_orders GROUP BY 1) o
  ON o.customer_id = c.app_db_customer_id
-- cte: fct_orders
SELECT o.order_id, o.customer_id, c.segment, CASE o.channel WHEN 'direct' THEN 'd2c' ELSE o.channel END AS channel,
       o.channel AS channel_raw, o.order_date, o.gross_amount, o.take_rate, o.net_amount, o.promo_code, o.subscription_id,
       o.order_date = MIN(o.order_date) OVER (PARTITION BY o.customer_id) AS is_first_order
FROM stg_orders o JOIN stg_app_customers c ON c.app_db_customer_id = o.customer_id
WHERE c.account_type = 'customer'
-- cte: fct_order_lines
SELECT l.order_line_id, l.order_id, o.customer_id, o.channel, l.order_date, l.sku, p.category, p.supplier_id, l.quantity,
       l.unit_price, l.discount_pct, l.line_amount, p.unit_cost, CAST(l.quantity * p.unit_cost AS DECIMAL(18,2)) AS line_cost,
       CAST(l.line_amount - l.quantity * p.unit_cost AS DECIMAL(18,2)) AS gross_margin
FROM stg_order_lines l JOIN fct_orders o USING (order_id) LEFT JOIN stg_products p ON p.sku = l.sku
-- cte: fct_revenue
WITH e AS (SELECT o.* FROM stg_orders o JOIN stg_app_customers c ON c.app_db_customer_id = o.customer_id AND c.account_type = 'customer'),
inv AS (SELECT * FROM stg_invoices SEMI JOIN e USING (order_id)),
ref AS (SELECT * FROM stg_refunds SEMI JOIN e USING (order_id))
SELECT order_date AS activity_date, 'gmv' AS measure_name, gross_amount AS amount FROM e
UNION ALL SELECT order_date, 'net_revenue', net_amount FROM e
UNION ALL SELECT refund_date, 'net_revenue', -refund_amount FROM ref
UNION ALL SELECT recognition_date, 'recognized_revenue', amount FROM stg_revenue_recognition SEMI JOIN e USING (order_id)
UNION ALL SELECT order_date, 'billed_revenue', net_amount FROM e WHERE channel <> 'business_subscription'
UNION ALL SELECT billed_date, 'billed_revenue', amount FROM inv
UNION ALL SELECT order_date, 'collected_cash', net_amount FROM e WHERE channel <> 'business_subscription'
UNION ALL SELECT collected_date, 'collected_cash', amount FROM inv WHERE collected_date IS NOT NULL
UNION ALL SELECT refund_date, 'collected_cash', -refund_amount FROM ref
-- cte: fct_subscriptions
SELECT s.subscription_id, s.customer_id, c.segment, s.plan_id, p.plan_name, p.plan_generation, p.tier, s.seats,
       s.term_start_date, s.term_end_date, s.price_per_seat, s.acv, s.order_id, s.renewed_from_subscription_id,
       s.renewed_from_subscription_id IS NULL AS is_first_term, s.status, s.cancelled_date
FROM stg_subscriptions s JOIN stg_app_customers c ON c.app_db_customer_id = s.customer_id
LEFT JOIN stg_plans p ON p.plan_id = s.plan_id WHERE c.account_type = 'customer'
-- cte: fct_marketing_spend
SELECT a.*, COALESCE(n, 0) AS attributed_new_d2c_customers_day_total
FROM stg_ad_spend a LEFT JOIN (SELECT order_date, COUNT(*) AS n FROM fct_orders WHERE channel = 'd2c' AND is_first_order GROUP BY 1) x
  ON x.order_date = a.spend_date
-- cte: quality_mart
SELECT source_system, COUNT(*) AS observed_id_count, COUNT(*) FILTER (resolution_status = 'resolved') AS resolved_id_count,
       COUNT(*) FILTER (resolution_status <> 'resolved') AS unresolved_id_count,
       CAST(COUNT(*) FILTER (resolution_status <> 'resolved') AS DOUBLE) / COUNT(*) AS resolution_null_rate
FROM int_customer_identity GROUP BY 1
-- cte: month_spine
SELECT CAST(m AS DATE) AS month FROM range(DATE '1995-01-01', (SELECT MAX(order_date) + 1 FROM stg_orders), INTERVAL 1 MONTH) r(m)
-- cte: rev_day
SELECT activity_date, SUM(amount) FILTER (measure_name = 'gmv') AS gmv, SUM(amount) FILTER (measure_name = 'net_revenue') AS net,
       SUM(amount) FILTER (measure_name = 'recognized_revenue') AS rec, SUM(amount) FILTER (measure_name = 'billed_revenue') AS bil,
       SUM(amount) FILTER (measure_name = 'collected_cash') AS cash FROM fct_revenue GROUP BY 1
-- cte: unlinked
WITH c AS (SELECT app_db_customer_id FROM stg_app_customers WHERE created_date <= DATE '2001-06-30'),
res AS (SELECT source_system, source_customer_id FROM int_customer_identity i
        WHERE source_created_date <= DATE '2001-06-30' AND linked_date <= DATE '2001-06-30'
          AND app_db_customer_id IN (SELECT app_db_customer_id FROM c))
SELECT t.*, COALESCE(related_order_id IN (SELECT order_id FROM stg_orders WHERE order_date <= DATE '2001-06-30'
                AND customer_id IN (SELECT app_db_customer_id FROM c)), false) AS vo,
       COALESCE(related_subscription_id IN (SELECT subscription_id FROM stg_subscriptions WHERE term_start_date <= DATE '2001-06-30'
                AND customer_id IN (SELECT app_db_customer_id FROM c)), false) AS vs
FROM stg_tickets t WHERE created_date <= DATE '2001-06-30'
 AND NOT EXISTS (SELECT 1 FROM res WHERE source_system = requester_source_system AND source_customer_id = requester_source_id)
-- cte: bounds
SELECT period, CAST(months AS BIGINT) AS months, COALESCE(CAST(em - (months - 1) * INTERVAL 1 MONTH AS DATE), DATE '1995-01-01') AS start_date,
       last_day(em) AS end_date
FROM (VALUES ('Last 6 Months', 6), ('Last 12 Months', 12), ('Last 24 Months', 24), ('All Time', NULL)) p(period, months),
     (SELECT CAST(CASE WHEN d = last_day(d) THEN date_trunc('month', d) ELSE date_trunc('month', d) - INTERVAL 1 MONTH END AS DATE) AS em
      FROM (SELECT MAX(order_date) AS d FROM stg_orders))
-- cte: biz_month
WITH r AS (SELECT CAST(date_trunc('month', activity_date) AS DATE) AS m, SUM(gmv) AS gmv, SUM(net) AS net, SUM(rec) AS rec, SUM(bil) AS bil, SUM(cash) AS cash FROM rev_day GROUP BY 1),
o AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, COUNT(*) AS n, COUNT(DISTINCT customer_id) AS a FROM fct_orders GROUP BY 1),
f AS (SELECT m, COUNT(*) AS n FROM (SELECT CAST(date_trunc('month', MIN(order_date)) AS DATE) AS m FROM fct_orders GROUP BY customer_id) GROUP BY 1),
b AS (SELECT CAST(date_trunc('month', refund_date) AS DATE) AS m, SUM(refund_amount) AS v, COUNT(*) AS n FROM stg_refunds SEMI JOIN fct_orders USING (order_id) GROUP BY 1)
SELECT month, CAST(COALESCE(gmv, 0) AS DOUBLE) AS gmv, CAST(COALESCE(net, 0) AS DOUBLE) AS net_revenue, CAST(COALESCE(rec, 0) AS DOUBLE) AS recognized_revenue,
       CAST(COALESCE(bil, 0) AS DOUBLE) AS billed_revenue, CAST(COALESCE(cash, 0) AS DOUBLE) AS collected_cash, COALESCE(o.n, 0) AS orders,
       COALESCE(o.a, 0) AS active_customers, COALESCE(f.n, 0) AS new_customers, CAST(SUM(COALESCE(f.n, 0)) OVER (ORDER BY month) AS BIGINT) AS cumulative_customers,
       CAST(COALESCE(b.v, 0) AS DOUBLE) AS refund_amount, COALESCE(b.n, 0) AS refund_count,
       COALESCE(ROUND(CAST(gmv AS DOUBLE) / NULLIF(o.n, 0), 4), 0) AS aov, COALESCE(ROUND(CAST(b.v AS DOUBLE) / NULLIF(CAST(gmv AS DOUBLE), 0), 6), 0) AS refund_rate
FROM month_spine LEFT JOIN r ON r.m = month LEFT JOIN o ON o.m = month LEFT JOIN f ON f.m = month LEFT JOIN b ON b.m = month
-- cte: ad_cut
WITH m AS (SELECT strftime(d, '%Y-%m') AS m FROM range(DATE '1999-11-01', DATE '2000-07-01', INTERVAL 1 MONTH) r(d)),
s AS (SELECT strftime(spend_date, '%Y-%m') AS m, CAST(SUM(spend_usd) AS DOUBLE) AS v FROM stg_ad_spend GROUP BY 1),
o AS (SELECT strftime(order_date, '%Y-%m') AS m, COUNT(*) AS n, COUNT(*) FILTER (is_first_order) AS f FROM fct_orders WHERE channel = 'd2c' GROUP BY 1),
j AS (SELECT * FROM m LEFT JOIN s USING (m) LEFT JOIN o USING (m))
SELECT 'ad_spend_by_month' AS evidence, m AS item, COALESCE(v, 0) AS value FROM j UNION ALL SELECT 'd2c_orders_by_month', m, CAST(COALESCE(n, 0) AS DOUBLE) FROM j
UNION ALL SELECT 'new_d2c_customers_by_month', m, CAST(COALESCE(f, 0) AS DOUBLE) FROM j
UNION ALL SELECT 'new_customer_share_of_d2c_orders_by_month', m, ROUND(CAST(f AS DOUBLE) / n, 4) FROM j
-- cte: all_rows
SELECT 'app_customers' AS table_name, created_date AS d FROM stg_app_customers UNION ALL SELECT 'products', introduced_date FROM stg_products
UNION ALL SELECT 'orders', order_date FROM stg_orders UNION ALL SELECT 'order_lines', order_date FROM stg_order_lines
UNION ALL SELECT 'plans', launched_date FROM stg_plans UNION ALL SELECT 'plan_prices', effective_date FROM stg_plan_prices
UNION ALL SELECT 'subscriptions', term_start_date FROM stg_subscriptions UNION ALL SELECT 'invoices', billed_date FROM stg_invoices
UNION ALL SELECT 'revenue_recognition', recognition_date FROM stg_revenue_recognition UNION ALL SELECT 'promotions', start_date FROM stg_promotions
UNION ALL SELECT 'refunds', refund_date FROM stg_refunds UNION ALL SELECT 'suppliers', onboarded_date FROM stg_suppliers
UNION ALL SELECT 'supplier_shipments', expected_date FROM stg_supplier_shipments UNION ALL SELECT 'ad_spend', spend_date FROM stg_ad_spend
UNION ALL SELECT 'stripe_customers', created_date FROM stg_stripe_customers UNION ALL SELECT 'shopify_customers', created_date FROM stg_shopify_customers
UNION ALL SELECT 'salesforce_customers', created_date FROM stg_salesforce_customers UNION ALL SELECT 'customer_id_crosswalk', linked_date FROM stg_customer_id_crosswalk
UNION ALL SELECT 'tickets', created_date FROM stg_tickets
