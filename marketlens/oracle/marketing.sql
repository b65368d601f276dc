-- query: new_d2c_customers
SELECT (SELECT COUNT(*) FROM fct_orders WHERE is_first_order AND channel = 'd2c' AND order_date BETWEEN DATE '2000-01-01' AND DATE '2000-01-31') AS value,
       CAST(SUM(attributed_new_d2c_customers_day_total) AS BIGINT) AS fanned_out_marketing_spend_rows,
       CAST(SUM(reported_conversions) AS BIGINT) AS platform_reported_conversions
FROM fct_marketing_spend WHERE spend_date BETWEEN DATE '2000-01-01' AND DATE '2000-01-31'
-- query: d2c_cac
WITH s AS (SELECT CAST(SUM(spend_usd) AS DOUBLE) AS v, SUM(reported_conversions) AS r, SUM(attributed_new_d2c_customers_day_total) AS f
           FROM fct_marketing_spend WHERE spend_date BETWEEN DATE '2000-01-01' AND DATE '2000-01-31'),
n AS (SELECT COUNT(*) AS n FROM fct_orders WHERE is_first_order AND channel = 'd2c' AND order_date BETWEEN DATE '2000-01-01' AND DATE '2000-01-31')
SELECT ROUND(v / NULLIF(n, 0), 2) AS value, v AS ad_spend, n AS new_d2c_customers, ROUND(v / CAST(NULLIF(r, 0) AS DOUBLE), 2) AS per_platform_reported_conversions,
       ROUND(v / CAST(NULLIF(f, 0) AS DOUBLE), 2) AS fanned_out_attributed_customers FROM s, n
-- query: cac_reported_vs_attributed
WITH s AS (SELECT strftime(spend_date, '%Y-%m') AS month, CAST(SUM(spend_usd) AS DOUBLE) AS v, CAST(SUM(reported_conversions) AS BIGINT) AS r
           FROM stg_ad_spend WHERE year(spend_date) = 2000 GROUP BY 1),
a AS (SELECT strftime(order_date, '%Y-%m') AS month, COUNT(*) AS n FROM fct_orders WHERE is_first_order AND channel = 'd2c' AND year(order_date) = 2000 GROUP BY 1)
SELECT month, v AS ad_spend, r AS platform_reported_conversions, n AS new_d2c_customers, ROUND(v / NULLIF(r, 0), 2) AS cac_per_platform_claims,
       ROUND(v / NULLIF(n, 0), 2) AS cac_attributed FROM s LEFT JOIN a USING (month)
-- query: ad_spend_by_platform
SELECT platform, CAST(SUM(spend_usd) AS DOUBLE) AS spend_usd FROM stg_ad_spend WHERE year(spend_date) = 2000 GROUP BY 1
-- query: promo_usage
WITH m AS (SELECT * FROM fct_orders WHERE promo_code = 'BTB15' AND order_date BETWEEN DATE '2000-09-01' AND DATE '2000-09-30')
SELECT (SELECT COUNT(*) FROM m) AS value, (SELECT CAST(COALESCE(SUM(gross_amount), 0) AS DOUBLE) FROM m) AS promo_gmv,
       (SELECT CAST(ROUND(COALESCE(SUM(quantity * unit_price * discount_pct), 0), 2) AS DOUBLE) FROM stg_order_lines
         WHERE order_id IN (SELECT order_id FROM m)) AS discount_dollars
-- query: promo_lift
WITH o AS (SELECT strftime(order_date, '%Y-%m') AS month, COUNT(*) AS c, COUNT(*) FILTER (promo_code = 'BTB15') AS p, CAST(SUM(gross_amount) AS DOUBLE) AS g
           FROM fct_orders WHERE channel IN ('d2c', 'marketplace') AND order_date BETWEEN DATE '2000-07-01' AND DATE '2000-11-30' GROUP BY 1),
d AS (SELECT strftime(order_date, '%Y-%m') AS month, CAST(ROUND(SUM(quantity * unit_price * discount_pct), 2) AS DOUBLE) AS v
      FROM fct_order_lines WHERE order_date BETWEEN DATE '2000-07-01' AND DATE '2000-11-30' GROUP BY 1)
SELECT month, c AS consumer_orders, p AS promo_orders, g AS consumer_gmv, ROUND(g / c, 2) AS aov, v AS discount_dollars,
       ROUND(CAST(p AS DOUBLE) / c, 4) AS promo_attach_rate FROM o LEFT JOIN d USING (month)
-- query: campaigns
WITH o AS (SELECT * FROM fct_orders WHERE channel IN ('d2c', 'marketplace') AND order_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31')
SELECT promo_code, promo_name, start_date, end_date, CAST(discount_pct AS DOUBLE) AS discount_pct,
       (SELECT COUNT(*) FROM o WHERE o.promo_code = p.promo_code) AS orders,
       (SELECT CAST(COALESCE(SUM(gross_amount), 0) AS DOUBLE) FROM o WHERE o.promo_code = p.promo_code) AS gmv,
       (SELECT CAST(COALESCE(SUM(ROUND(quantity * unit_price * l.discount_pct, 2)), 0) AS DOUBLE) FROM stg_order_lines l JOIN o USING (order_id)
         WHERE o.promo_code = p.promo_code) AS discount_dollars
FROM stg_promotions p WHERE end_date >= DATE '1998-01-01' AND start_date <= DATE '2000-12-31'
-- query: category_margin
SELECT category, CAST(SUM(line_amount) AS DOUBLE) AS line_revenue, CAST(SUM(line_amount) - SUM(line_cost) AS DOUBLE) AS gross_margin,
       ROUND(CAST(SUM(line_amount) - SUM(line_cost) AS DOUBLE) / CAST(SUM(line_amount) AS DOUBLE), 4) AS margin_pct
FROM fct_order_lines WHERE year(order_date) = 2000 GROUP BY 1
-- query: category_mix
SELECT c.category, CAST(COALESCE(SUM(line_amount), 0) AS DOUBLE) AS line_revenue, CAST(COALESCE(SUM(quantity), 0) AS BIGINT) AS units,
       CAST(COALESCE(SUM(line_cost), 0) AS DOUBLE) AS cogs, CAST(COALESCE(SUM(gross_margin), 0) AS DOUBLE) AS gross_margin,
       COALESCE(ROUND(CAST(SUM(gross_margin) AS DOUBLE) / CAST(NULLIF(SUM(line_amount), 0) AS DOUBLE), 4), 0) AS margin_pct
FROM (VALUES ('paper'), ('writing'), ('office_tech'), ('furniture'), ('breakroom'), ('storage')) c(category)
LEFT JOIN (SELECT * FROM fct_order_lines WHERE order_date BETWEEN DATE '1999-03-10' AND DATE '1999-03-20') l USING (category) GROUP BY 1
-- query: category_gross_margin_by_year
SELECT CAST(year(order_date) AS BIGINT) AS year, category, CAST(SUM(line_amount) AS DOUBLE) AS line_revenue, CAST(SUM(line_cost) AS DOUBLE) AS cogs,
       CAST(SUM(gross_margin) AS DOUBLE) AS gross_margin,
       ROUND(CAST(SUM(gross_margin) AS DOUBLE) / CAST(SUM(line_amount) AS DOUBLE), 4) AS margin_pct, CAST(SUM(quantity) AS BIGINT) AS units
FROM fct_order_lines WHERE order_date BETWEEN DATE '1999-01-01' AND DATE '2001-06-30' GROUP BY 1, 2
-- query: supplier_product_sales_distribution
SELECT supplier_id, category, CAST(SUM(line_amount) AS DOUBLE) AS product_sales_usd,
       ROUND(CAST(SUM(line_amount) AS DOUBLE) / CAST(SUM(SUM(line_amount)) OVER () AS DOUBLE), 4) AS sales_share
FROM fct_order_lines WHERE order_date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30' GROUP BY 1, 2
-- query: gmv_of_orders_with_category
WITH o AS (SELECT * FROM fct_orders WHERE year(order_date) = 2000),
h AS (SELECT l.order_id, line_amount FROM stg_order_lines l JOIN stg_products p USING (sku) WHERE p.category = 'paper')
SELECT (SELECT CAST(COALESCE(SUM(gross_amount), 0) AS DOUBLE) FROM o WHERE order_id IN (SELECT order_id FROM h)) AS value,
       CAST(COALESCE(SUM(gross_amount), 0) AS DOUBLE) AS summed_per_matching_line, CAST(COALESCE(SUM(line_amount), 0) AS DOUBLE) AS category_line_amount_only
FROM h JOIN o USING (order_id)
-- query: monthly_marketing
WITH o AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, SUM(gross_amount) AS gmv, SUM(gross_amount) FILTER (channel = 'd2c') AS gd,
             SUM(gross_amount) FILTER (channel = 'business_subscription') AS gs, SUM(gross_amount) FILTER (channel = 'marketplace') AS gm,
             COUNT(*) FILTER (channel <> 'business_subscription') AS co, SUM(gross_amount) FILTER (channel <> 'business_subscription') AS cg,
             COUNT(*) FILTER (is_first_order) AS nc, COUNT(*) FILTER (is_first_order AND channel = 'd2c') AS nd, COUNT(promo_code) AS po
           FROM fct_orders GROUP BY 1),
a AS (SELECT CAST(date_trunc('month', spend_date) AS DATE) AS m, SUM(spend_usd) AS s, SUM(reported_conversions) AS r FROM stg_ad_spend GROUP BY 1),
l AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, SUM(ROUND(quantity * unit_price * discount_pct, 2)) AS d,
             SUM(line_amount) FILTER (category = 'paper') AS c1, SUM(line_amount) FILTER (category = 'writing') AS c2, SUM(line_amount) FILTER (category = 'office_tech') AS c3,
             SUM(line_amount) FILTER (category = 'furniture') AS c4, SUM(line_amount) FILTER (category = 'breakroom') AS c5, SUM(line_amount) FILTER (category = 'storage') AS c6
      FROM fct_order_lines GROUP BY 1)
SELECT month, CAST(COALESCE(gmv, 0) AS DOUBLE) AS gmv, CAST(COALESCE(gd, 0) AS DOUBLE) AS gmv_d2c, CAST(COALESCE(gs, 0) AS DOUBLE) AS gmv_subscription,
       CAST(COALESCE(gm, 0) AS DOUBLE) AS gmv_marketplace, COALESCE(co, 0) AS consumer_orders, CAST(COALESCE(cg, 0) AS DOUBLE) AS consumer_gmv,
       COALESCE(nc, 0) AS new_customers, COALESCE(nd, 0) AS new_d2c_customers, COALESCE(po, 0) AS promo_orders, CAST(COALESCE(s, 0) AS DOUBLE) AS ad_spend,
       CAST(COALESCE(r, 0) AS BIGINT) AS reported_conversions, CAST(COALESCE(d, 0) AS DOUBLE) AS discount_dollars, CAST(COALESCE(c1, 0) AS DOUBLE) AS cat_paper,
       CAST(COALESCE(c2, 0) AS DOUBLE) AS cat_writing, CAST(COALESCE(c3, 0) AS DOUBLE) AS cat_office_tech, CAST(COALESCE(c4, 0) AS DOUBLE) AS cat_furniture,
       CAST(COALESCE(c5, 0) AS DOUBLE) AS cat_breakroom, CAST(COALESCE(c6, 0) AS DOUBLE) AS cat_storage,
       COALESCE(ROUND(CAST(cg AS DOUBLE) / NULLIF(co, 0), 2), 0) AS aov, COALESCE(ROUND(CAST(s AS DOUBLE) / NULLIF(nd, 0), 2), 0) AS cac
FROM month_spine LEFT JOIN o ON o.m = month LEFT JOIN a ON a.m = month LEFT JOIN l ON l.m = month
-- query: marketing_kpis
WITH o AS (SELECT * FROM fct_orders WHERE order_date BETWEEN DATE '1999-07-01' AND DATE '2000-06-30'),
c AS (SELECT * FROM o WHERE channel <> 'business_subscription'),
s AS (SELECT CAST(COALESCE(SUM(spend_usd), 0) AS DOUBLE) AS v FROM stg_ad_spend WHERE spend_date BETWEEN DATE '1999-07-01' AND DATE '2000-06-30'),
n AS (SELECT COUNT(*) AS n FROM o WHERE is_first_order AND channel = 'd2c')
SELECT (SELECT CAST(COALESCE(SUM(gross_amount), 0) AS DOUBLE) FROM o) AS gmv, (SELECT CAST(COALESCE(SUM(gross_amount), 0) AS DOUBLE) FROM c) AS consumer_gmv,
       (SELECT COUNT(*) FROM c) AS consumer_orders, (SELECT COALESCE(ROUND(CAST(SUM(gross_amount) AS DOUBLE) / NULLIF(COUNT(*), 0), 2), 0) FROM c) AS aov,
       (SELECT COUNT(*) FROM o WHERE is_first_order) AS new_customers, n AS new_d2c_customers, v AS ad_spend, COALESCE(ROUND(v / NULLIF(n, 0), 2), 0) AS cac,
       (SELECT COUNT(promo_code) FROM c) AS promo_orders,
       (SELECT CAST(COALESCE(SUM(ROUND(quantity * unit_price * discount_pct, 2)), 0) AS DOUBLE) FROM stg_order_lines WHERE order_id IN (SELECT order_id FROM c)) AS discount_dollars
FROM s, n
