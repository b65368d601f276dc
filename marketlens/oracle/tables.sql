-- query: fct_revenue
SELECT activity_date, measure_name, CAST(amount AS DOUBLE) AS amount FROM fct_revenue
-- query: dim_products
SELECT sku, product_name, p.category, supplier_id, supplier_name, CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(list_price AS DOUBLE) AS list_price,
       introduced_date FROM stg_products p LEFT JOIN stg_suppliers USING (supplier_id)
-- query: dim_date
SELECT CAST(d AS DATE) AS date_day, CAST(year(d) AS BIGINT) AS year_number, CAST(quarter(d) AS BIGINT) AS quarter_number,
       CAST(month(d) AS BIGINT) AS month_number, CAST(date_trunc('month', d) AS DATE) AS month_start,
       CAST(date_trunc('quarter', d) AS DATE) AS quarter_start, CAST(date_trunc('year', d) AS DATE) AS year_start,
       CAST(year(d) AS VARCHAR) || 'Q' || quarter(d) AS year_quarter, strftime(d, '%Y-%m') AS year_month,
       CAST(isodow(d) AS BIGINT) AS day_of_week, isodow(d) >= 6 AS is_weekend
FROM range((SELECT date_trunc('year', MIN(order_date)) FROM stg_orders), (SELECT date_trunc('year', MAX(recognition_date)) + INTERVAL 12 MONTH FROM stg_revenue_recognition), INTERVAL 1 DAY) r(d)
-- query: fct_identity_resolution_quality
SELECT * FROM quality_mart
-- query: observed_aliases
SELECT source_system, source_customer_id, source_created_date, is_active, deactivated_date FROM int_customer_identity
-- query: eligible_order_ids
SELECT order_id FROM stg_orders WHERE customer_id IN (SELECT app_db_customer_id FROM stg_app_customers WHERE account_type = 'customer')
-- query: real_customers
SELECT * FROM stg_app_customers WHERE account_type = 'customer'
-- query: revenue_tables
WITH t AS (SELECT 'orders' AS table_name, order_id, gross_amount AS amount FROM stg_orders
           UNION ALL SELECT 'invoices', order_id, amount FROM stg_invoices
           UNION ALL SELECT 'revenue_recognition', order_id, amount FROM stg_revenue_recognition
           UNION ALL SELECT 'refunds', order_id, refund_amount FROM stg_refunds)
SELECT table_name, COUNT(*) AS rows, CAST(SUM(amount) AS DOUBLE) AS amount FROM t WHERE order_id IN (SELECT order_id FROM fct_orders) GROUP BY 1
-- query: in_window
SELECT order_id, order_date FROM stg_orders WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'
-- query: stg_app_customers
SELECT * FROM stg_app_customers
-- query: stg_stripe_customers
SELECT * FROM stg_stripe_customers
-- query: stg_shopify_customers
SELECT * FROM stg_shopify_customers
-- query: stg_salesforce_customers
SELECT * FROM stg_salesforce_customers
-- query: stg_customer_id_crosswalk
SELECT * FROM stg_customer_id_crosswalk
-- query: stg_orders
SELECT * REPLACE (CAST(gross_amount AS DOUBLE) AS gross_amount, CAST(take_rate AS DOUBLE) AS take_rate, CAST(net_amount AS DOUBLE) AS net_amount) FROM stg_orders
-- query: stg_order_lines
SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(discount_pct AS DOUBLE) AS discount_pct, CAST(line_amount AS DOUBLE) AS line_amount) FROM stg_order_lines
-- query: stg_products
SELECT * REPLACE (CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(list_price AS DOUBLE) AS list_price) FROM stg_products
-- query: stg_subscriptions
SELECT * REPLACE (CAST(price_per_seat AS DOUBLE) AS price_per_seat, CAST(acv AS DOUBLE) AS acv) FROM stg_subscriptions
-- query: stg_invoices
SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM stg_invoices
-- query: stg_revenue_recognition
SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM stg_revenue_recognition
-- query: stg_refunds
SELECT * REPLACE (CAST(refund_amount AS DOUBLE) AS refund_amount) FROM stg_refunds
-- query: stg_suppliers
SELECT * FROM stg_suppliers
-- query: stg_supplier_shipments
SELECT * FROM stg_supplier_shipments
-- query: stg_ad_spend
SELECT * REPLACE (CAST(spend_usd AS DOUBLE) AS spend_usd) FROM stg_ad_spend
-- query: stg_tickets
SELECT * FROM stg_tickets
-- query: int_customer_identity
SELECT * FROM int_customer_identity
-- query: dim_customers
SELECT * FROM dim_customers
-- query: fct_orders
SELECT * REPLACE (CAST(gross_amount AS DOUBLE) AS gross_amount, CAST(take_rate AS DOUBLE) AS take_rate, CAST(net_amount AS DOUBLE) AS net_amount) FROM fct_orders
-- query: fct_order_lines
SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(discount_pct AS DOUBLE) AS discount_pct, CAST(line_amount AS DOUBLE) AS line_amount, CAST(unit_cost AS DOUBLE) AS unit_cost, CAST(line_cost AS DOUBLE) AS line_cost, CAST(gross_margin AS DOUBLE) AS gross_margin) FROM fct_order_lines
-- query: fct_subscriptions
SELECT * REPLACE (CAST(price_per_seat AS DOUBLE) AS price_per_seat, CAST(acv AS DOUBLE) AS acv) FROM fct_subscriptions
-- query: fct_marketing_spend
SELECT * REPLACE (CAST(spend_usd AS DOUBLE) AS spend_usd) FROM fct_marketing_spend
