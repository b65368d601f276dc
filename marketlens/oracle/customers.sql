-- query: current_customers
SELECT COUNT(DISTINCT customer_id) FILTER (r AND w) AS value, COUNT(DISTINCT customer_id) FILTER (w) AS including_test_and_internal,
       COUNT(DISTINCT customer_id || '/' || ch) FILTER (r AND w) AS sum_of_channel_counts,
       COUNT(DISTINCT customer_id) FILTER (r AND order_date BETWEEN DATE '2000-06-01' AND DATE '2001-05-31') AS window_ending_prior_month,
       (SELECT COUNT(*) FROM stg_app_customers WHERE created_date <= DATE '2001-06-30') AS all_profiles_created
FROM (SELECT *, CASE channel WHEN 'direct' THEN 'd2c' ELSE channel END AS ch, account_type = 'customer' AS r,
             order_date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30' AS w
      FROM stg_orders JOIN stg_app_customers ON app_db_customer_id = customer_id)
-- query: new_customers
SELECT (SELECT COUNT(*) FROM (SELECT MIN(order_date) AS d FROM fct_orders GROUP BY customer_id) WHERE year(d) = 2000) AS value,
       (SELECT COUNT(*) FROM (SELECT MIN(order_date) AS d FROM fct_orders GROUP BY customer_id, channel) WHERE year(d) = 2000) AS first_order_per_channel,
       (SELECT COUNT(*) FROM stg_app_customers WHERE year(created_date) = 2000) AS profiles_created
-- query: multi_channel_customers
SELECT COUNT(*) FILTER (a >= 2) AS value, COUNT(*) FILTER (b >= 2) AS raw_channel_labels
FROM (SELECT COUNT(DISTINCT channel) AS a, COUNT(DISTINCT channel_raw) AS b FROM fct_orders WHERE year(order_date) = 1998 GROUP BY customer_id)
-- query: current_sets
SELECT COUNT(DISTINCT customer_id) AS total, COUNT(DISTINCT customer_id) FILTER (channel = 'd2c') AS d2c,
       COUNT(DISTINCT customer_id) FILTER (channel = 'business_subscription') AS business_subscription,
       COUNT(DISTINCT customer_id) FILTER (channel = 'marketplace') AS marketplace
FROM fct_orders WHERE order_date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30'
-- query: monthly_customer_metrics
WITH o AS (SELECT customer_id, channel, CAST(date_trunc('month', order_date) AS DATE) AS m FROM fct_orders),
a AS (SELECT m, COUNT(DISTINCT customer_id) AS t, COUNT(DISTINCT customer_id) FILTER (channel = 'd2c') AS d,
             COUNT(DISTINCT customer_id) FILTER (channel = 'business_subscription') AS b,
             COUNT(DISTINCT customer_id) FILTER (channel = 'marketplace') AS k FROM o GROUP BY m),
f AS (SELECT m, COUNT(*) AS n FROM (SELECT MIN(m) AS m FROM o GROUP BY customer_id) GROUP BY m),
c AS (SELECT s.month AS m, COUNT(DISTINCT customer_id) AS t, COUNT(DISTINCT customer_id) FILTER (channel = 'd2c') AS d,
             COUNT(DISTINCT customer_id) FILTER (channel = 'business_subscription') AS b,
             COUNT(DISTINCT customer_id) FILTER (channel = 'marketplace') AS k
      FROM month_spine s JOIN o ON o.m <= s.month AND o.m >= s.month - INTERVAL 11 MONTH GROUP BY 1)
SELECT s.month, COALESCE(a.d, 0) AS active_d2c, COALESCE(a.b, 0) AS active_business_subscription, COALESCE(a.k, 0) AS active_marketplace,
       COALESCE(a.t, 0) AS active_customers, COALESCE(f.n, 0) AS new_customers, COALESCE(a.t, 0) - COALESCE(f.n, 0) AS returning_customers,
       COALESCE(c.t, 0) AS current_customers, COALESCE(c.d, 0) AS current_d2c, COALESCE(c.b, 0) AS current_subscribers,
       COALESCE(c.k, 0) AS current_marketplace
FROM month_spine s LEFT JOIN a ON a.m = s.month LEFT JOIN f ON f.m = s.month LEFT JOIN c ON c.m = s.month
-- query: customer_kpis
WITH w AS (SELECT *, order_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' AS p,
                  order_date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30' AS c,
                  MIN(order_date) OVER (PARTITION BY customer_id) AS f FROM fct_orders),
k AS (SELECT COUNT(DISTINCT customer_id) FILTER (c) AS current_customers,
             COUNT(DISTINCT customer_id) FILTER (c AND channel = 'business_subscription') AS current_subscribers,
             COUNT(DISTINCT customer_id) FILTER (c AND channel = 'd2c') AS current_d2c,
             COUNT(DISTINCT customer_id) FILTER (c AND channel = 'marketplace') AS current_marketplace,
             COUNT(DISTINCT customer_id) FILTER (p) AS active_customers,
             COUNT(DISTINCT customer_id) FILTER (f BETWEEN DATE '2001-01-01' AND DATE '2001-06-30') AS new_customers FROM w)
SELECT k.*, (SELECT COUNT(*) FROM (SELECT customer_id FROM w WHERE p GROUP BY 1 HAVING COUNT(DISTINCT channel) >= 2)) AS multi_channel_customers,
       COALESCE(ROUND(1 - CAST(new_customers AS DOUBLE) / NULLIF(active_customers, 0), 4), 0) AS returning_share FROM k
-- query: customer_kpis_by_channel
WITH w AS (SELECT *, order_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-30' AS p,
                  order_date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30' AS c,
                  order_date = MIN(order_date) OVER (PARTITION BY customer_id) AS f FROM fct_orders),
k AS (SELECT x.ch AS channel, COUNT(DISTINCT customer_id) FILTER (c) AS current_customers,
             COUNT(DISTINCT customer_id) FILTER (p) AS active_customers, COUNT(DISTINCT customer_id) FILTER (p AND f) AS new_customers
      FROM (VALUES ('d2c'), ('business_subscription'), ('marketplace')) x(ch) LEFT JOIN w ON w.channel = x.ch GROUP BY 1)
SELECT channel, current_customers, CASE WHEN channel = 'business_subscription' THEN current_customers END AS current_subscribers,
       (SELECT current_customers FROM k WHERE channel = 'd2c') AS current_d2c,
       (SELECT current_customers FROM k WHERE channel = 'marketplace') AS current_marketplace, active_customers, new_customers,
       COALESCE(ROUND(1 - CAST(new_customers AS DOUBLE) / NULLIF(active_customers, 0), 4), 0) AS returning_share FROM k
-- query: consumer_cohort_repeat_rate
WITH f AS (SELECT customer_id, MIN(order_date) AS d FROM fct_orders GROUP BY 1),
co AS (SELECT f.customer_id, f.d, CAST(year(f.d) AS VARCHAR) || 'Q' || quarter(f.d) AS q FROM f JOIN fct_orders o
       ON o.customer_id = f.customer_id AND o.order_date = f.d WHERE o.channel IN ('d2c', 'marketplace')
        AND f.d BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'),
rp AS (SELECT DISTINCT co.customer_id FROM co JOIN fct_orders o ON o.customer_id = co.customer_id AND o.order_date > co.d AND o.order_date <= co.d + 365)
SELECT q AS cohort_quarter, COUNT(*) AS customers_acquired, COUNT(rp.customer_id) AS repeated_within_12m,
       ROUND(CAST(COUNT(rp.customer_id) AS DOUBLE) / COUNT(*), 4) AS repeat_rate_12m FROM co LEFT JOIN rp USING (customer_id) GROUP BY 1
-- query: current_sets_any_window
WITH w AS (SELECT CAST(month - INTERVAL 1 MONTH * (k - 1) AS DATE) AS first_month, CAST(month AS DATE) AS last_month FROM month_spine, (VALUES (1), (3), (6), (12), (24)) x(k)),
o AS (SELECT DISTINCT customer_id, channel, CAST(date_trunc('month', order_date) AS DATE) AS m FROM fct_orders)
SELECT first_month, last_month, COUNT(DISTINCT customer_id) AS total, COUNT(DISTINCT customer_id) FILTER (channel = 'd2c') AS d2c,
       COUNT(DISTINCT customer_id) FILTER (channel = 'business_subscription') AS business_subscription,
       COUNT(DISTINCT customer_id) FILTER (channel = 'marketplace') AS marketplace
FROM w LEFT JOIN o ON m BETWEEN first_month AND last_month GROUP BY 1, 2
