-- query: data_end_month
SELECT MAX(order_date) AS last_order_date, CAST(date_trunc('month', MAX(order_date)) AS DATE) AS data_end_month FROM stg_orders
-- query: last_elapsed_month
SELECT DISTINCT order_date AS as_of, CAST(CASE WHEN order_date = last_day(order_date) THEN date_trunc('month', order_date)
       ELSE date_trunc('month', order_date) - INTERVAL 1 MONTH END AS DATE) AS last_elapsed_month FROM stg_orders
-- query: period_bounds
SELECT period, months, start_date, end_date FROM bounds
-- query: prior_bounds
SELECT period, CAST(start_date - months * INTERVAL 1 MONTH AS DATE) AS prior_start, start_date - 1 AS prior_end FROM bounds WHERE months IS NOT NULL
-- query: business_kpis
WITH w AS (SELECT * FROM (VALUES ('Last 6 Months', 'c', DATE '2001-01-01', DATE '2001-06-30'), ('Last 6 Months', 'p', DATE '2000-07-01', DATE '2000-12-31'),
  ('Last 12 Months', 'c', DATE '2000-07-01', DATE '2001-06-30'), ('Last 12 Months', 'p', DATE '1999-07-01', DATE '2000-06-30'),
  ('Last 24 Months', 'c', DATE '1999-07-01', DATE '2001-06-30'), ('Last 24 Months', 'p', DATE '1997-07-01', DATE '1999-06-30'),
  ('All Time', 'c', DATE '1995-01-01', DATE '2001-06-30')) x(period, which, s, e)),
r AS (SELECT period, which, COALESCE(SUM(gmv), 0) AS gmv, COALESCE(SUM(net), 0) AS net, COALESCE(SUM(rec), 0) AS rec, COALESCE(SUM(bil), 0) AS bil, COALESCE(SUM(cash), 0) AS cash
      FROM w LEFT JOIN rev_day ON activity_date BETWEEN s AND e GROUP BY 1, 2),
o AS (SELECT period, which, COUNT(order_id) AS n, COUNT(DISTINCT customer_id) AS a FROM w LEFT JOIN fct_orders ON order_date BETWEEN s AND e GROUP BY 1, 2),
f AS (SELECT period, which, COUNT(d) AS n FROM w LEFT JOIN (SELECT MIN(order_date) AS d FROM fct_orders GROUP BY customer_id) ON d BETWEEN s AND e GROUP BY 1, 2),
b AS (SELECT period, which, COALESCE(SUM(refund_amount), 0) AS v FROM w LEFT JOIN (SELECT * FROM stg_refunds SEMI JOIN fct_orders USING (order_id))
        ON refund_date BETWEEN s AND e GROUP BY 1, 2),
k AS (SELECT w.*, CAST(rec AS DOUBLE) AS recognized_revenue, CAST(gmv AS DOUBLE) AS gmv, CAST(net AS DOUBLE) AS net_revenue, CAST(bil AS DOUBLE) AS billed_revenue,
        CAST(cash AS DOUBLE) AS collected_cash, a AS active_customers, f.n AS new_customers, o.n AS orders,
        COALESCE(ROUND(CAST(gmv AS DOUBLE) / NULLIF(o.n, 0), 2), 0) AS aov, CAST(v AS DOUBLE) AS refund_amount,
        COALESCE(ROUND(CAST(v AS DOUBLE) / NULLIF(CAST(gmv AS DOUBLE), 0), 4), 0) AS refund_rate
      FROM w JOIN r USING (period, which) JOIN o USING (period, which) JOIN f USING (period, which) JOIN b USING (period, which)),
c AS (SELECT * FROM k WHERE which = 'c'), p AS (SELECT * FROM k WHERE which = 'p')
SELECT c.period, c.s AS start_date, c.e AS end_date,
 c.recognized_revenue, p.recognized_revenue AS prior_recognized_revenue, ROUND((c.recognized_revenue - p.recognized_revenue) / NULLIF(ABS(p.recognized_revenue), 0), 6) AS recognized_revenue_delta,
 c.gmv, p.gmv AS prior_gmv, ROUND((c.gmv - p.gmv) / NULLIF(ABS(p.gmv), 0), 6) AS gmv_delta,
 c.net_revenue, p.net_revenue AS prior_net_revenue, ROUND((c.net_revenue - p.net_revenue) / NULLIF(ABS(p.net_revenue), 0), 6) AS net_revenue_delta,
 c.billed_revenue, p.billed_revenue AS prior_billed_revenue, ROUND((c.billed_revenue - p.billed_revenue) / NULLIF(ABS(p.billed_revenue), 0), 6) AS billed_revenue_delta,
 c.collected_cash, p.collected_cash AS prior_collected_cash, ROUND((c.collected_cash - p.collected_cash) / NULLIF(ABS(p.collected_cash), 0), 6) AS collected_cash_delta,
 c.active_customers, p.active_customers AS prior_active_customers, ROUND(CAST(c.active_customers - p.active_customers AS DOUBLE) / NULLIF(p.active_customers, 0), 6) AS active_customers_delta,
 c.new_customers, p.new_customers AS prior_new_customers, ROUND(CAST(c.new_customers - p.new_customers AS DOUBLE) / NULLIF(p.new_customers, 0), 6) AS new_customers_delta,
 c.orders, p.orders AS prior_orders, ROUND(CAST(c.orders - p.orders AS DOUBLE) / NULLIF(p.orders, 0), 6) AS orders_delta,
 c.aov, p.aov AS prior_aov, ROUND((c.aov - p.aov) / NULLIF(ABS(p.aov), 0), 6) AS aov_delta,
 c.refund_amount, p.refund_amount AS prior_refund_amount, ROUND((c.refund_amount - p.refund_amount) / NULLIF(ABS(p.refund_amount), 0), 6) AS refund_amount_delta,
 c.refund_rate, p.refund_rate AS prior_refund_rate, ROUND((c.refund_rate - p.refund_rate) / NULLIF(ABS(p.refund_rate), 0), 6) AS refund_rate_delta
FROM c LEFT JOIN p USING (period)
-- query: business_monthly
SELECT * FROM biz_month
-- query: business_monthly_by_period
SELECT period, biz_month.* FROM biz_month JOIN bounds ON month BETWEEN start_date AND end_date
-- query: event_supplier_outage
WITH m AS (SELECT strftime(d, '%Y-%m') AS m FROM range(DATE '1999-01-01', DATE '1999-07-01', INTERVAL 1 MONTH) r(d)),
l AS (SELECT strftime(order_date, '%Y-%m') AS m, COALESCE(SUM(line_amount) FILTER (category = 'paper'), 0) AS p, SUM(line_amount) AS t FROM fct_order_lines GROUP BY 1),
o AS (SELECT strftime(order_date, '%Y-%m') AS m, COUNT(*) AS n FROM fct_orders WHERE channel <> 'business_subscription' GROUP BY 1),
s AS (SELECT * FROM stg_supplier_shipments WHERE category = 'paper' AND expected_date BETWEEN DATE '1999-03-06' AND DATE '1999-04-09')
SELECT 'paper_line_revenue_by_month' AS evidence, m AS item, CAST(COALESCE(p, 0) AS DOUBLE) AS value FROM m LEFT JOIN l USING (m)
UNION ALL SELECT 'paper_share_of_line_revenue_by_month', m, ROUND(CAST(COALESCE(p, 0) AS DOUBLE) / CAST(NULLIF(t, 0) AS DOUBLE), 4) FROM m LEFT JOIN l USING (m)
UNION ALL SELECT 'consumer_orders_by_month', m, CAST(COALESCE(n, 0) AS DOUBLE) FROM m LEFT JOIN o USING (m)
UNION ALL SELECT 'paper_shipments_in_window', '1999-03-06..1999-04-09', CAST(COUNT(*) AS DOUBLE) FROM s
UNION ALL SELECT 'paper_units_expected_in_window', '1999-03-06..1999-04-09', CAST(COALESCE(SUM(units_expected), 0) AS DOUBLE) FROM s
UNION ALL SELECT 'paper_units_received_in_window', '1999-03-06..1999-04-09', CAST(COALESCE(SUM(units_received), 0) AS DOUBLE) FROM s
UNION ALL SELECT 'delayed_shipment_ids', shipment_id, 1.0::DOUBLE FROM s
-- query: event_promo
WITH m AS (SELECT strftime(d, '%Y-%m') AS m FROM range(DATE '2000-07-01', DATE '2000-12-01', INTERVAL 1 MONTH) r(d)),
o AS (SELECT strftime(order_date, '%Y-%m') AS m, COUNT(*) AS n, CAST(SUM(gross_amount) AS DOUBLE) AS g, COUNT(*) FILTER (promo_code = 'BTB15') AS p
      FROM fct_orders WHERE channel <> 'business_subscription' GROUP BY 1),
d AS (SELECT strftime(order_date, '%Y-%m') AS m, CAST(SUM(ROUND(quantity * unit_price * discount_pct, 2)) AS DOUBLE) AS v FROM fct_order_lines GROUP BY 1),
j AS (SELECT * FROM m LEFT JOIN o USING (m) LEFT JOIN d USING (m))
SELECT 'consumer_orders_by_month' AS evidence, m AS item, CAST(COALESCE(n, 0) AS DOUBLE) AS value FROM j
UNION ALL SELECT 'consumer_gmv_by_month', m, COALESCE(g, 0) FROM j UNION ALL SELECT 'consumer_aov_by_month', m, ROUND(g / NULLIF(n, 0), 2) FROM j
UNION ALL SELECT 'promo_orders_by_month', m, CAST(COALESCE(p, 0) AS DOUBLE) FROM j UNION ALL SELECT 'discount_dollars_by_month', m, COALESCE(v, 0) FROM j
-- query: event_price_increase
WITH m AS (SELECT strftime(d, '%Y-%m') AS m FROM range(DATE '2001-02-01', DATE '2001-09-01', INTERVAL 1 MONTH) r(d)),
n AS (SELECT *, strftime(term_start_date, '%Y-%m') AS m FROM stg_subscriptions WHERE renewed_from_subscription_id IS NULL),
a AS (SELECT m, COUNT(*) AS c, CAST(SUM(acv) AS DOUBLE) AS v, CAST(SUM(seats) AS DOUBLE) AS s FROM n GROUP BY 1),
j AS (SELECT * FROM m LEFT JOIN a USING (m)),
w AS (SELECT CASE WHEN m BETWEEN '2001-02' AND '2001-04' THEN '2001-02..2001-04' WHEN m BETWEEN '2001-05' AND '2001-07' THEN '2001-05..2001-07' END AS l, plan_id, SUM(seats) AS s
      FROM n GROUP BY 1, 2)
SELECT 'gen3_price_per_seat' AS evidence, plan_id || ' ' || effective_date AS item, CAST(annual_price_per_seat AS DOUBLE) AS value
FROM stg_plan_prices JOIN stg_plans USING (plan_id) WHERE plan_generation = 3
UNION ALL SELECT 'new_subscription_starts_by_month', m, CAST(COALESCE(c, 0) AS DOUBLE) FROM j
UNION ALL SELECT 'new_subscription_acv_per_seat_by_month', m, ROUND(v / s, 2) FROM j
UNION ALL SELECT 'new_subscription_acv_by_month', m, COALESCE(v, 0) FROM j
UNION ALL SELECT 'new_seat_share_by_plan', l || ' ' || plan_id, ROUND(CAST(s AS DOUBLE) / CAST(SUM(s) OVER (PARTITION BY l) AS DOUBLE), 4) FROM w WHERE l IS NOT NULL
-- query: event_enterprise_churn
WITH q AS (SELECT CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS q, seg FROM range(DATE '1998-04-01', DATE '1999-05-01', INTERVAL 3 MONTH) r(d), (VALUES ('smb'), ('enterprise')) x(seg)),
e AS (SELECT CAST(year(term_end_date) AS VARCHAR) || 'Q' || quarter(term_end_date) AS q, segment AS seg, COUNT(*) AS n, COUNT(*) FILTER (status = 'churned') AS c,
        COALESCE(SUM(acv) FILTER (status = 'churned'), 0) AS v FROM stg_subscriptions JOIN stg_app_customers ON app_db_customer_id = customer_id WHERE status <> 'active' GROUP BY 1, 2),
j AS (SELECT q || '_' || seg AS item, n, c, v FROM q LEFT JOIN e USING (q, seg)),
t AS (SELECT strftime(t.created_date, '%Y-%m') AS m, t.priority IN ('high', 'urgent') AS h, COALESCE(segment = 'enterprise' AND account_type = 'customer', false) AS ent,
        requester_source_system = 'salesforce' AS biz FROM stg_tickets t
      LEFT JOIN stg_customer_id_crosswalk x ON x.source_system = requester_source_system AND x.source_customer_id = requester_source_id
      LEFT JOIN stg_app_customers c USING (app_db_customer_id) WHERE category = 'billing'),
m AS (SELECT strftime(d, '%Y-%m') AS m FROM range(DATE '1998-07-01', DATE '1999-02-01', INTERVAL 1 MONTH) r(d))
SELECT 'terms_up_for_renewal' AS evidence, item, CAST(COALESCE(n, 0) AS DOUBLE) AS value FROM j UNION ALL SELECT 'churned', item, CAST(COALESCE(c, 0) AS DOUBLE) FROM j
UNION ALL SELECT 'churn_rate', item, COALESCE(ROUND(CAST(c AS DOUBLE) / n, 4), 0) FROM j UNION ALL SELECT 'acv_churned', item, CAST(COALESCE(v, 0) AS DOUBLE) FROM j
UNION ALL SELECT 'enterprise_billing_tickets_by_month', m, CAST(COUNT(*) FILTER (ent) AS DOUBLE) FROM m LEFT JOIN t USING (m) GROUP BY m
UNION ALL SELECT 'enterprise_high_priority_billing_tickets_by_month', m, CAST(COUNT(*) FILTER (ent AND h) AS DOUBLE) FROM m LEFT JOIN t USING (m) GROUP BY m
UNION ALL SELECT 'business_billing_tickets_by_month', m, CAST(COUNT(*) FILTER (biz) AS DOUBLE) FROM m LEFT JOIN t USING (m) GROUP BY m
UNION ALL SELECT 'business_high_priority_billing_tickets_by_month', m, CAST(COUNT(*) FILTER (biz AND h) AS DOUBLE) FROM m LEFT JOIN t USING (m) GROUP BY m
-- query: event_ad_spend_cut
SELECT * FROM ad_cut
-- query: event_category_margin
WITH c AS (SELECT category AS item, CAST(SUM(line_amount) AS DOUBLE) AS r, CAST(SUM(line_cost) AS DOUBLE) AS k, CAST(SUM(gross_margin) AS DOUBLE) AS g, CAST(SUM(quantity) AS DOUBLE) AS u
           FROM fct_order_lines WHERE year(order_date) = 2000 GROUP BY 1)
SELECT 'revenue' AS evidence, item, r AS value FROM c UNION ALL SELECT 'cogs', item, k FROM c UNION ALL SELECT 'gross_margin', item, g FROM c
UNION ALL SELECT 'gross_margin_pct', item, ROUND(g / r, 4) FROM c UNION ALL SELECT 'units', item, u FROM c
-- query: event_evidence
SELECT * FROM ad_cut WHERE evidence IN ('ad_spend_by_month', 'new_d2c_customers_by_month', 'new_customer_share_of_d2c_orders_by_month')
-- query: event_detectability
WITH sh AS (SELECT month(order_date) AS m, CAST(COALESCE(SUM(line_amount) FILTER (category = 'paper'), 0) AS DOUBLE) / CAST(SUM(line_amount) AS DOUBLE) AS v
            FROM fct_order_lines WHERE order_date BETWEEN DATE '1999-02-01' AND DATE '1999-03-31' GROUP BY 1),
pr AS (SELECT month(order_date) AS m, COUNT(*) AS n, ROUND(CAST(SUM(gross_amount) AS DOUBLE) / COUNT(*), 2) AS a FROM fct_orders
       WHERE channel <> 'business_subscription' AND order_date BETWEEN DATE '2000-08-01' AND DATE '2000-09-30' GROUP BY 1),
ch AS (SELECT quarter(term_end_date) AS q, segment, ROUND(AVG(CASE WHEN status = 'churned' THEN 1.0::DOUBLE ELSE 0 END), 4) AS v FROM stg_subscriptions
       JOIN stg_app_customers ON app_db_customer_id = customer_id WHERE status <> 'active' AND term_end_date BETWEEN DATE '1998-07-01' AND DATE '1998-12-31' GROUP BY 1, 2)
SELECT 'supplier_outage' AS event, 'paper share halves in the stockout month' AS assertion,
       COALESCE(ROUND((SELECT v FROM sh WHERE m = 3), 4) < 0.5 * ROUND((SELECT v FROM sh WHERE m = 2), 4), false) AS holds
UNION ALL SELECT 'supplier_outage', 'no paper unit received in the window', (SELECT COALESCE(SUM(units_received), 0) = 0 FROM stg_supplier_shipments
  WHERE category = 'paper' AND expected_date BETWEEN DATE '1999-03-06' AND DATE '1999-04-09')
UNION ALL SELECT 'promo_back_to_business', 'consumer orders above 1.25x the month before', COALESCE((SELECT n FROM pr WHERE m = 9), 0) > 1.25 * COALESCE((SELECT n FROM pr WHERE m = 8), 0)
UNION ALL SELECT 'promo_back_to_business', 'consumer AOV falls', COALESCE((SELECT a FROM pr WHERE m = 9) < (SELECT a FROM pr WHERE m = 8), false)
UNION ALL SELECT 'enterprise_churn', 'enterprise churn above 3x the quarter before',
  COALESCE((SELECT v FROM ch WHERE q = 4 AND segment = 'enterprise'), 0) > 3 * COALESCE((SELECT v FROM ch WHERE q = 3 AND segment = 'enterprise'), 0)
UNION ALL SELECT 'enterprise_churn', 'smb churn stays below 0.35', COALESCE((SELECT v FROM ch WHERE q = 4 AND segment = 'smb'), 0) < 0.35
UNION ALL SELECT 'ad_spend_cut', 'spend more than halves', (SELECT MAX(value) FROM ad_cut WHERE evidence = 'ad_spend_by_month' AND item = '2000-02')
  < 0.5 * (SELECT MAX(value) FROM ad_cut WHERE evidence = 'ad_spend_by_month' AND item = '2000-01')
UNION ALL SELECT 'ad_spend_cut', 'new-customer share falls below 0.8x', COALESCE((SELECT MAX(value) FROM ad_cut WHERE evidence LIKE 'new_customer_share%' AND item = '2000-03')
  < 0.8 * (SELECT MAX(value) FROM ad_cut WHERE evidence LIKE 'new_customer_share%' AND item = '2000-01'), false)
UNION ALL SELECT 'sub_price_increase', plan_id || ' price steps up', COUNT(*) = 2 AND arg_max(annual_price_per_seat, effective_date) > arg_min(annual_price_per_seat, effective_date)
FROM stg_plan_prices JOIN stg_plans USING (plan_id) WHERE plan_generation = 3 GROUP BY plan_id
