-- query: open_tickets_at
SELECT COUNT(*) FILTER (created_date <= DATE '2000-06-30' AND (resolved_date IS NULL OR resolved_date > DATE '2000-06-30')) AS value,
       COUNT(*) FILTER (status = 'open') AS status_open_at_snapshot,
       COUNT(*) FILTER (created_date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30') AS created_in_month FROM stg_tickets
-- query: shipments_in_transit_at
SELECT COUNT(*) FILTER (expected_date <= DATE '1999-03-31' AND (received_date IS NULL OR received_date > DATE '1999-03-31')) AS value,
       COUNT(*) FILTER (status = 'in_transit') AS status_in_transit_at_snapshot FROM stg_supplier_shipments
-- query: tickets_by_category
SELECT category, COUNT(*) AS tickets FROM stg_tickets WHERE year(created_date) = 2000 GROUP BY 1
-- query: tickets_vs_orders_monthly
WITH m AS (SELECT CAST(m AS DATE) AS m FROM range(DATE '1999-02-01', DATE '1999-05-01', INTERVAL 1 MONTH) r(m)),
o AS (SELECT date_trunc('month', order_date) AS m, COUNT(DISTINCT order_id) AS n, COUNT(DISTINCT order_id) FILTER (channel = 'd2c') AS d FROM fct_orders GROUP BY 1),
t AS (SELECT date_trunc('month', created_date) AS m, COUNT(DISTINCT ticket_id) AS n, COUNT(DISTINCT created_date) AS d, MIN(created_date) AS f, MAX(created_date) AS l
      FROM stg_tickets GROUP BY 1)
SELECT strftime(m.m, '%Y-%m') AS month, COALESCE(o.n, 0) AS orders, COALESCE(o.d, 0) AS d2c_orders, COALESCE(t.n, 0) AS tickets,
       COALESCE(t.d, 0) AS days_with_tickets, CAST(day(last_day(m.m)) AS BIGINT) AS calendar_days, f AS first_ticket, l AS last_ticket
FROM m LEFT JOIN o ON o.m = m.m LEFT JOIN t ON t.m = m.m
-- query: tickets_vs_orders_flags
WITH c AS (SELECT (SELECT COUNT(*) FROM fct_orders WHERE order_date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31') AS o1,
  (SELECT COUNT(*) FROM fct_orders WHERE order_date BETWEEN DATE '1999-02-01' AND DATE '1999-02-28') AS o0,
  (SELECT COUNT(*) FROM fct_orders WHERE channel = 'd2c' AND order_date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31') AS d1,
  (SELECT COUNT(*) FROM fct_orders WHERE channel = 'd2c' AND order_date BETWEEN DATE '1999-02-01' AND DATE '1999-02-28') AS d0,
  (SELECT COUNT(*) FROM stg_tickets WHERE created_date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31') AS t,
  (SELECT COUNT(DISTINCT created_date) FROM stg_tickets WHERE created_date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31') AS td)
SELECT '1999-03' AS target_month, o1 < o0 AS target_orders_below_previous_month, d1 < d0 AS target_d2c_orders_below_previous_month,
       t = 0 AS target_month_has_no_tickets, td = 31 AS target_has_tickets_every_day FROM c
-- query: billing_tickets_vs_enterprise_churn
WITH t AS (SELECT strftime(created_date, '%Y-%m') AS month, COUNT(*) FILTER (segment = 'enterprise' AND category = 'billing') AS b,
             COUNT(*) FILTER (segment = 'enterprise' AND category = 'billing' AND priority IN ('high', 'urgent')) AS h, COUNT(*) FILTER (segment = 'enterprise') AS a
           FROM stg_tickets LEFT JOIN int_customer_identity i ON i.source_system = requester_source_system AND i.source_customer_id = requester_source_id
           LEFT JOIN dim_customers c ON c.app_db_customer_id = i.app_db_customer_id WHERE created_date BETWEEN DATE '1998-06-01' AND DATE '1999-01-31' GROUP BY 1),
c AS (SELECT strftime(term_end_date, '%Y-%m') AS month, COUNT(*) FILTER (status = 'churned') AS n, CAST(COALESCE(SUM(acv) FILTER (status = 'churned'), 0) AS DOUBLE) AS v
      FROM fct_subscriptions WHERE segment = 'enterprise' AND status <> 'active' AND term_end_date BETWEEN DATE '1998-06-01' AND DATE '1999-01-31' GROUP BY 1)
SELECT month, b AS enterprise_billing_tickets, h AS of_which_high_urgent, a AS enterprise_tickets_all, n AS enterprise_terms_churned, v AS enterprise_acv_churned
FROM t LEFT JOIN c USING (month)
