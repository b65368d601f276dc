-- query: five_revenues
SELECT CAST(ROUND(SUM(gmv), 2) AS DOUBLE) AS gmv, CAST(ROUND(SUM(net), 2) AS DOUBLE) AS net_revenue,
       CAST(ROUND(SUM(rec), 2) AS DOUBLE) AS recognized_revenue, CAST(ROUND(SUM(bil), 2) AS DOUBLE) AS billed_revenue,
       CAST(ROUND(SUM(cash), 2) AS DOUBLE) AS collected_cash
FROM rev_day WHERE activity_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'
-- query: revenue_measure
SELECT 'recognized_revenue' AS measure_name, CAST(SUM(rec) AS DOUBLE) AS value, CAST(SUM(gmv) AS DOUBLE) AS wrong_gmv,
       CAST(SUM(net) AS DOUBLE) AS wrong_net_revenue, CAST(SUM(bil) AS DOUBLE) AS wrong_billed_revenue,
       CAST(SUM(cash) AS DOUBLE) AS wrong_collected_cash
FROM rev_day WHERE activity_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'
-- query: revenue_measure_hygiene
SELECT CAST((SELECT SUM(amount) FROM fct_revenue WHERE measure_name = 'gmv'
               AND activity_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31') AS DOUBLE) AS value,
       CAST((SELECT SUM(gross_amount) FROM stg_orders
              WHERE order_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31') AS DOUBLE) AS staging_including_test_and_internal
-- query: last_full_quarter_revenue
SELECT DATE '2001-01-01' AS quarter_start,
       CAST(COALESCE(SUM(rec) FILTER (q), 0) AS DOUBLE) AS value,
       CAST(COALESCE(SUM(rec) FILTER (activity_date BETWEEN DATE '2001-04-01' AND DATE '2001-05-31'), 0) AS DOUBLE) AS current_partial_quarter,
       CAST(COALESCE(SUM(rec) FILTER (activity_date BETWEEN DATE '2001-05-31' - 89 AND DATE '2001-05-31'), 0) AS DOUBLE) AS trailing_90_days,
       CAST(COALESCE(SUM(gmv) FILTER (q), 0) AS DOUBLE) AS same_quarter_gmv, CAST(COALESCE(SUM(net) FILTER (q), 0) AS DOUBLE) AS same_quarter_net_revenue,
       CAST(COALESCE(SUM(bil) FILTER (q), 0) AS DOUBLE) AS same_quarter_billed_revenue,
       CAST(COALESCE(SUM(cash) FILTER (q), 0) AS DOUBLE) AS same_quarter_collected_cash
FROM (SELECT *, activity_date BETWEEN DATE '2001-01-01' AND DATE '2001-03-31' AS q FROM rev_day)
-- query: ytd_growth
WITH s AS (SELECT SUM(rec) FILTER (activity_date BETWEEN DATE '2001-01-01' AND DATE '2001-05-31') AS ytd,
                  SUM(rec) FILTER (activity_date BETWEEN DATE '2000-01-01' AND DATE '2000-05-31') AS prior,
                  SUM(rec) FILTER (activity_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') AS py FROM rev_day)
SELECT ROUND(CAST(ytd AS DOUBLE) / CAST(prior AS DOUBLE) - 1, 4) AS value, CAST(ytd AS DOUBLE) AS ytd, CAST(prior AS DOUBLE) AS prior_ytd,
       ROUND(CAST(ytd AS DOUBLE) / CAST(py AS DOUBLE) - 1, 4) AS growth_vs_full_prior_year, CAST(py AS DOUBLE) AS prior_full_year FROM s
-- query: five_revenues_by_quarter
SELECT CAST(year(activity_date) AS VARCHAR) || 'Q' || quarter(activity_date) AS quarter,
       CAST(COALESCE(SUM(gmv), 0) AS DOUBLE) AS gmv, CAST(COALESCE(SUM(net), 0) AS DOUBLE) AS net_revenue,
       CAST(COALESCE(SUM(rec), 0) AS DOUBLE) AS recognized_revenue, CAST(COALESCE(SUM(bil), 0) AS DOUBLE) AS billed_revenue,
       CAST(COALESCE(SUM(cash), 0) AS DOUBLE) AS collected_cash,
       CAST(COALESCE(SUM(rec), 0) - COALESCE(SUM(gmv), 0) AS DOUBLE) AS recognized_minus_gmv
FROM rev_day WHERE activity_date BETWEEN DATE '1998-01-01' AND DATE '2001-06-30' GROUP BY 1
-- query: orders_count
SELECT (SELECT COUNT(*) FROM fct_orders WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') AS value,
       (SELECT COUNT(*) FROM stg_orders WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') AS staging_including_test_and_internal
-- query: marketplace_take
SELECT CAST(SUM(net_amount) AS DOUBLE) AS value,
       ROUND(CAST(SUM(net_amount) AS DOUBLE) / CAST(SUM(gross_amount) AS DOUBLE), 4) AS effective_take_rate,
       CAST(SUM(gross_amount) AS DOUBLE) AS marketplace_gmv
FROM fct_orders WHERE channel = 'marketplace' AND order_date BETWEEN DATE '2000-04-01' AND DATE '2000-06-30'
-- query: marketplace_gmv_take_rate
WITH m AS (SELECT SUM(net_amount) AS n, SUM(gross_amount) AS g FROM fct_orders
           WHERE channel = 'marketplace' AND order_date BETWEEN DATE '2000-04-01' AND DATE '2000-06-30')
SELECT CAST(g AS DOUBLE) AS value, ROUND(CAST(n AS DOUBLE) / CAST(g AS DOUBLE), 4) AS effective_take_rate, CAST(n AS DOUBLE) AS marketplace_take,
       ROUND(1 - CAST(n AS DOUBLE) / CAST(g AS DOUBLE), 4) AS seller_payout_share,
       (SELECT CAST(SUM(gross_amount) AS DOUBLE) FROM stg_orders WHERE channel = 'marketplace'
          AND order_date BETWEEN DATE '2000-04-01' AND DATE '2000-06-30') AS staging_gmv_including_test_and_internal FROM m
-- query: marketplace_take_rate_by_month
SELECT strftime(order_date, '%Y-%m') AS month, COUNT(*) AS marketplace_orders, CAST(SUM(gross_amount) AS DOUBLE) AS marketplace_gmv,
       CAST(SUM(net_amount) AS DOUBLE) AS marketplace_take,
       ROUND(CAST(SUM(net_amount) AS DOUBLE) / CAST(SUM(gross_amount) AS DOUBLE), 4) AS effective_take_rate
FROM fct_orders WHERE channel = 'marketplace' AND order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1
-- query: d2c_gmv_by_year
SELECT CAST(y AS BIGINT) AS year, CAST(COALESCE(SUM(gross_amount), 0) AS DOUBLE) AS d2c_gmv,
       CAST(COALESCE(SUM(gross_amount) FILTER (channel_raw = 'd2c'), 0) AS DOUBLE) AS raw_label_d2c_gmv,
       CAST(COALESCE(SUM(gross_amount) FILTER (channel_raw = 'direct'), 0) AS DOUBLE) AS raw_label_direct_gmv
FROM range(1995, 2001) r(y) LEFT JOIN fct_orders ON year(order_date) = y AND channel = 'd2c' GROUP BY 1
-- query: d2c_orders_by_year
SELECT CAST(year(order_date) AS BIGINT) AS year, COUNT(DISTINCT order_id) FILTER (channel = 'd2c') AS d2c_orders,
       COUNT(DISTINCT order_id) FILTER (channel_raw = 'direct') AS raw_label_direct_orders,
       COUNT(DISTINCT order_id) FILTER (channel_raw = 'd2c') AS raw_label_d2c_orders
FROM fct_orders WHERE year(order_date) IN (1996, 1998, 2000) GROUP BY 1
-- query: d2c_by_year_raw_vs_canonical
SELECT CAST(year(order_date) AS BIGINT) AS year, channel_raw, channel AS canonical_channel, COUNT(*) AS orders,
       CAST(SUM(gross_amount) AS DOUBLE) AS gmv
FROM fct_orders WHERE channel = 'd2c' AND order_date BETWEEN DATE '1995-01-01' AND DATE '2000-12-31' GROUP BY 1, 2, 3
-- query: orders_channel_step_change
WITH m AS (SELECT CAST(m AS DATE) AS m FROM range(DATE '1998-04-01', DATE '1998-09-01', INTERVAL 1 MONTH) r(m)),
a AS (SELECT strftime(m, '%Y-%m') AS month, CAST(day(last_day(m)) AS BIGINT) AS calendar_days,
             COUNT(DISTINCT order_id) AS total_orders, COUNT(DISTINCT order_id) FILTER (channel = 'd2c') AS d2c_orders,
             COUNT(DISTINCT order_id) FILTER (channel = 'marketplace') AS marketplace_orders,
             COUNT(DISTINCT order_id) FILTER (channel = 'business_subscription') AS subscription_orders,
             COUNT(DISTINCT order_id) FILTER (channel_raw = 'direct') AS raw_direct_orders,
             COUNT(DISTINCT order_id) FILTER (channel_raw = 'd2c') AS raw_d2c_orders,
             COUNT(DISTINCT order_date) AS days, COUNT(DISTINCT order_date) FILTER (channel = 'd2c') AS d2c_days
      FROM m LEFT JOIN fct_orders ON date_trunc('month', order_date) = m GROUP BY m)
SELECT month, calendar_days, total_orders, d2c_orders, marketplace_orders, subscription_orders, raw_direct_orders, raw_d2c_orders,
       calendar_days - days AS zero_order_days, calendar_days - d2c_days AS zero_d2c_days,
       ROUND(CAST(total_orders AS DOUBLE) / calendar_days, 4) AS orders_per_day,
       ROUND(CAST(d2c_orders AS DOUBLE) / calendar_days, 4) AS d2c_orders_per_day FROM a
-- query: orders_channel_label_ranges
SELECT channel_raw, MIN(order_date) AS first_date, MAX(order_date) AS last_date, COUNT(DISTINCT order_id) AS orders
FROM fct_orders WHERE channel = 'd2c' AND order_date BETWEEN DATE '1998-04-01' AND DATE '1998-08-31' GROUP BY 1
-- query: orders_channel_comparison
WITH c AS (SELECT COUNT(*) FILTER (month(order_date) = 5) AS b, COUNT(*) FILTER (month(order_date) = 6) AS a,
                  COUNT(*) FILTER (month(order_date) = 5 AND channel = 'd2c') AS bd,
                  COUNT(*) FILTER (month(order_date) = 6 AND channel = 'd2c') AS ad
           FROM fct_orders WHERE year(order_date) = 1998)
SELECT '1998-05' AS before_month, '1998-06' AS after_month,
       ROUND((CAST(a AS DOUBLE) / NULLIF(b, 0) - 1) * 100, 4) AS total_orders_change_pct,
       ROUND(((CAST(a AS DOUBLE) / 30) / (CAST(NULLIF(b, 0) AS DOUBLE) / 31) - 1) * 100, 4) AS total_orders_per_day_change_pct,
       ROUND((CAST(ad AS DOUBLE) / NULLIF(bd, 0) - 1) * 100, 4) AS d2c_orders_change_pct,
       ROUND(((CAST(ad AS DOUBLE) / 30) / (CAST(NULLIF(bd, 0) AS DOUBLE) / 31) - 1) * 100, 4) AS d2c_orders_per_day_change_pct FROM c
-- query: account_type_dollars
WITH t AS (SELECT account_type, COUNT(*) AS orders, SUM(gross_amount) AS g FROM stg_orders o
           JOIN stg_app_customers c ON c.app_db_customer_id = o.customer_id
           WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31' GROUP BY 1)
SELECT account_type, orders, CAST(g AS DOUBLE) AS gmv, CAST(SUM(g) OVER () AS DOUBLE) AS staging_total_gmv,
       (SELECT CAST(SUM(amount) AS DOUBLE) FROM fct_revenue WHERE measure_name = 'gmv'
          AND activity_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31') AS gmv_in_fct_revenue FROM t
-- query: recognized_by_channel
WITH rec AS (SELECT * FROM stg_revenue_recognition WHERE recognition_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'),
good AS (SELECT channel, SUM(amount) AS v FROM rec JOIN fct_orders USING (order_id) GROUP BY 1),
bad AS (SELECT CASE channel WHEN 'direct' THEN 'd2c' ELSE channel END AS channel, SUM(amount) AS v
        FROM rec JOIN stg_orders USING (order_id) GROUP BY 1),
net AS (SELECT channel, SUM(net_amount) AS v FROM fct_orders WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1)
SELECT good.channel, CAST(good.v AS DOUBLE) AS recognized_revenue, CAST(COALESCE(net.v, 0) AS DOUBLE) AS order_date_net_amount,
       CAST(bad.v AS DOUBLE) AS unfiltered_recognized
FROM good LEFT JOIN net USING (channel) LEFT JOIN bad USING (channel)
-- query: recognized_by_channel_by_quarter
WITH r AS (SELECT recognition_date AS d, channel, amount FROM stg_revenue_recognition JOIN fct_orders USING (order_id)),
a AS (SELECT date_trunc('quarter', d) AS q, channel, amount AS rec, 0 AS net, 0 AS gross FROM r WHERE year(d) = 2000
      UNION ALL SELECT date_trunc('quarter', order_date), channel, 0, net_amount, gross_amount FROM fct_orders WHERE year(order_date) = 2000),
g AS (SELECT q, channel, SUM(rec) AS rec, SUM(net) AS net, SUM(gross) AS gross FROM a GROUP BY 1, 2),
p AS (SELECT channel, SUM(amount) AS v FROM r WHERE d BETWEEN DATE '2001-04-01' AND DATE '2001-05-31' GROUP BY 1)
SELECT CAST(year(q) AS VARCHAR) || 'Q' || quarter(q) AS quarter, g.channel, CAST(rec AS DOUBLE) AS recognized_revenue,
       ROUND(CAST(rec AS DOUBLE) / CAST(NULLIF(SUM(rec) OVER w, 0) AS DOUBLE), 4) AS share_of_quarter,
       CAST(net AS DOUBLE) AS order_date_net_amount,
       ROUND(CAST(net AS DOUBLE) / CAST(NULLIF(SUM(net) OVER w, 0) AS DOUBLE), 4) AS order_date_net_share,
       ROUND(CAST(gross AS DOUBLE) / CAST(NULLIF(SUM(gross) OVER w, 0) AS DOUBLE), 4) AS gmv_share,
       CAST(COALESCE(p.v, 0) AS DOUBLE) AS partial_quarter_recognized
FROM g LEFT JOIN p USING (channel) WINDOW w AS (PARTITION BY q)
-- query: revenue_by_channel
SELECT channel, CAST(SUM(amount) AS DOUBLE) AS amount,
       CASE channel WHEN 'd2c' THEN 'Direct-to-Consumer' WHEN 'business_subscription' THEN 'Business Subscriptions'
                    WHEN 'marketplace' THEN 'Marketplace' ELSE channel END AS channel_label
FROM stg_revenue_recognition JOIN fct_orders USING (order_id)
WHERE recognition_date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30' GROUP BY 1
-- query: refund_key_violations
SELECT 'orders' AS table_name, order_id AS key, COUNT(*) AS rows FROM stg_orders GROUP BY 2 HAVING COUNT(*) > 1 OR order_id IS NULL
UNION ALL SELECT 'refunds', refund_id, COUNT(*) FROM stg_refunds GROUP BY 2 HAVING COUNT(*) > 1 OR refund_id IS NULL
-- query: refund_rate_by_quarter
WITH o AS (SELECT x.*, account_type = 'customer' AS real FROM stg_orders x JOIN stg_app_customers ON app_db_customer_id = customer_id
           WHERE order_date <= DATE '2001-05-31'),
r AS (SELECT f.refund_date, f.refund_amount, o.order_date, o.real FROM stg_refunds f JOIN o USING (order_id) WHERE refund_date <= DATE '2001-05-31'),
e AS (SELECT CAST(date_trunc('quarter', order_date) AS DATE) AS q, CASE WHEN real THEN gross_amount END AS gross, CASE WHEN real THEN net_amount END AS net,
             gross_amount AS rg, NULL AS ret, NULL AS rret, NULL AS byo FROM o
      UNION ALL SELECT CAST(date_trunc('quarter', refund_date) AS DATE), NULL, NULL, NULL, CASE WHEN real THEN refund_amount END, refund_amount, NULL FROM r
      UNION ALL SELECT CAST(date_trunc('quarter', order_date) AS DATE), NULL, NULL, NULL, NULL, NULL, refund_amount FROM r WHERE real),
s AS (SELECT q, CAST(SUM(gross) AS DOUBLE) AS gross, CAST(SUM(net) AS DOUBLE) AS net, CAST(SUM(net) - COALESCE(SUM(ret), 0) AS DOUBLE) AS after_ret,
             CAST(SUM(rg) AS DOUBLE) AS rg, CAST(COALESCE(SUM(ret), 0) AS DOUBLE) AS ret, SUM(ret) IS NOT NULL AS has_ret,
             CAST(COALESCE(SUM(rret), 0) AS DOUBLE) AS rret, CAST(COALESCE(SUM(byo), 0) AS DOUBLE) AS byo FROM e GROUP BY q)
SELECT q AS quarter_start, ret AS refund_amount, gross AS gmv, ROUND(ret / NULLIF(gross, 0), 9) AS refund_rate,
       DATE '2001-05-31' < CAST(q + INTERVAL 3 MONTH AS DATE) - 1 AS is_partial_quarter,
       ROUND(ret / NULLIF(after_ret, 0), 9) AS net_revenue_denominator, ROUND(ret / NULLIF(net, 0), 9) AS pre_refund_net_denominator,
       ROUND(byo / NULLIF(gross, 0), 9) AS refunds_at_order_date, ROUND(rret / NULLIF(rg, 0), 9) AS including_test_internal
FROM s WHERE gross IS NOT NULL OR has_ret
-- query: net_revenue_order_keyed
SELECT CAST((SELECT SUM(net_amount) FROM stg_orders WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31')
     - (SELECT SUM(refund_amount) FROM stg_refunds JOIN stg_orders USING (order_id)
         WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31') AS DOUBLE) AS value,
       (SELECT CAST(SUM(net) AS DOUBLE) FROM rev_day WHERE activity_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31') AS refund_date_net_revenue
-- query: revenue_for_persona
SELECT persona, p.measure_name, CAST(SUM(amount) AS DOUBLE) AS value
FROM (VALUES ('Dana', 'recognized_revenue'), ('Marcus', 'gmv'), ('Priya', 'billed_revenue'), ('Theo', 'collected_cash'),
             ('Sam', 'net_revenue'), ('unknown', 'recognized_revenue')) AS p(persona, measure_name)
LEFT JOIN fct_revenue f ON f.measure_name = p.measure_name AND activity_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'
GROUP BY 1, 2
-- query: metric_replay
WITH mo AS (SELECT CAST(d AS DATE) AS s, CAST(d + INTERVAL 1 MONTH AS DATE) - 1 AS e, strftime(d, '%Y-%m') AS l
            FROM range(DATE '1999-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) r(d)),
qu AS (SELECT CAST(d AS DATE) AS s, CAST(d + INTERVAL 3 MONTH AS DATE) - 1 AS e, CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS l
       FROM range(DATE '1999-01-01', DATE '2001-07-01', INTERVAL 3 MONTH) r(d)),
ye AS (SELECT CAST(d AS DATE) AS s, CAST(d + INTERVAL 12 MONTH AS DATE) - 1 AS e, CAST(year(d) AS VARCHAR) AS l
       FROM range(DATE '1999-01-01', DATE '2001-01-01', INTERVAL 12 MONTH) r(d)),
cases AS (SELECT 'recognized_revenue' AS m, * FROM mo UNION ALL SELECT 'recognized_revenue', * FROM qu WHERE s <= DATE '2001-01-01'
          UNION ALL SELECT 'gmv', * FROM mo WHERE s >= DATE '2000-08-01'
          UNION ALL SELECT x.m, qu.* FROM qu, (VALUES ('gmv'), ('billed_revenue'), ('collected_cash')) x(m)
          UNION ALL SELECT x.m, ye.* FROM ye, (VALUES ('gmv'), ('billed_revenue'), ('collected_cash')) x(m)
          UNION ALL SELECT 'net_revenue', * FROM qu WHERE s >= DATE '2000-07-01')
SELECT m || '_' || l AS case_name, m AS measure_name, s AS start_date, e AS end_date, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS value
FROM cases LEFT JOIN fct_revenue ON measure_name = m AND activity_date BETWEEN s AND e GROUP BY 1, 2, 3, 4
-- query: drift_check
WITH qu AS (SELECT CAST(d AS DATE) AS s, CAST(d + INTERVAL 3 MONTH AS DATE) - 1 AS e, 'net_revenue_' || year(d) || 'Q' || quarter(d) AS case_name
            FROM range(DATE '2000-07-01', DATE '2001-07-01', INTERVAL 3 MONTH) r(d)),
x AS (SELECT case_name,
        CAST((SELECT COALESCE(SUM(amount), 0) FROM fct_revenue WHERE measure_name = 'net_revenue' AND activity_date BETWEEN s AND e) AS DOUBLE) AS expected,
        CAST((SELECT COALESCE(SUM(net_amount), 0) FROM stg_orders WHERE order_date BETWEEN s AND e)
           - (SELECT COALESCE(SUM(refund_amount), 0) FROM stg_refunds JOIN stg_orders USING (order_id) WHERE order_date BETWEEN s AND e) AS DOUBLE) AS changed
      FROM qu)
SELECT case_name, expected, changed, ROUND(changed - expected, 2) AS delta FROM x WHERE ABS(ROUND(changed - expected, 2)) > 0.005
