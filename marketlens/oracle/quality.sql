-- query: dq_unique
SELECT 'app_customers' AS table_name, 'app_db_customer_id' AS columns, COUNT(*) AS violations FROM (SELECT app_db_customer_id FROM stg_app_customers GROUP BY app_db_customer_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'stripe_customers' AS table_name, 'stripe_customer_id' AS columns, COUNT(*) AS violations FROM (SELECT stripe_customer_id FROM stg_stripe_customers GROUP BY stripe_customer_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'shopify_customers' AS table_name, 'shopify_customer_id' AS columns, COUNT(*) AS violations FROM (SELECT shopify_customer_id FROM stg_shopify_customers GROUP BY shopify_customer_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'salesforce_customers' AS table_name, 'salesforce_customer_id' AS columns, COUNT(*) AS violations FROM (SELECT salesforce_customer_id FROM stg_salesforce_customers GROUP BY salesforce_customer_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'customer_id_crosswalk' AS table_name, 'source_system,source_customer_id' AS columns, COUNT(*) AS violations FROM (SELECT source_system,source_customer_id FROM stg_customer_id_crosswalk GROUP BY source_system,source_customer_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'orders' AS table_name, 'order_id' AS columns, COUNT(*) AS violations FROM (SELECT order_id FROM stg_orders GROUP BY order_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'order_lines' AS table_name, 'order_line_id' AS columns, COUNT(*) AS violations FROM (SELECT order_line_id FROM stg_order_lines GROUP BY order_line_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'products' AS table_name, 'sku' AS columns, COUNT(*) AS violations FROM (SELECT sku FROM stg_products GROUP BY sku HAVING COUNT(*) <> 1)
UNION ALL SELECT 'plans' AS table_name, 'plan_id' AS columns, COUNT(*) AS violations FROM (SELECT plan_id FROM stg_plans GROUP BY plan_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'plan_prices' AS table_name, 'plan_id,effective_date' AS columns, COUNT(*) AS violations FROM (SELECT plan_id,effective_date FROM stg_plan_prices GROUP BY plan_id,effective_date HAVING COUNT(*) <> 1)
UNION ALL SELECT 'subscriptions' AS table_name, 'subscription_id' AS columns, COUNT(*) AS violations FROM (SELECT subscription_id FROM stg_subscriptions GROUP BY subscription_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'invoices' AS table_name, 'invoice_id' AS columns, COUNT(*) AS violations FROM (SELECT invoice_id FROM stg_invoices GROUP BY invoice_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'revenue_recognition' AS table_name, 'order_id,recognition_date' AS columns, COUNT(*) AS violations FROM (SELECT order_id,recognition_date FROM stg_revenue_recognition GROUP BY order_id,recognition_date HAVING COUNT(*) <> 1)
UNION ALL SELECT 'refunds' AS table_name, 'refund_id' AS columns, COUNT(*) AS violations FROM (SELECT refund_id FROM stg_refunds GROUP BY refund_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'promotions' AS table_name, 'promo_code' AS columns, COUNT(*) AS violations FROM (SELECT promo_code FROM stg_promotions GROUP BY promo_code HAVING COUNT(*) <> 1)
UNION ALL SELECT 'suppliers' AS table_name, 'supplier_id' AS columns, COUNT(*) AS violations FROM (SELECT supplier_id FROM stg_suppliers GROUP BY supplier_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'supplier_shipments' AS table_name, 'shipment_id' AS columns, COUNT(*) AS violations FROM (SELECT shipment_id FROM stg_supplier_shipments GROUP BY shipment_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'ad_spend' AS table_name, 'spend_date,platform' AS columns, COUNT(*) AS violations FROM (SELECT spend_date,platform FROM stg_ad_spend GROUP BY spend_date,platform HAVING COUNT(*) <> 1)
UNION ALL SELECT 'tickets' AS table_name, 'ticket_id' AS columns, COUNT(*) AS violations FROM (SELECT ticket_id FROM stg_tickets GROUP BY ticket_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'dim_customers' AS table_name, 'app_db_customer_id' AS columns, COUNT(*) AS violations FROM (SELECT app_db_customer_id FROM dim_customers GROUP BY app_db_customer_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'fct_orders' AS table_name, 'order_id' AS columns, COUNT(*) AS violations FROM (SELECT order_id FROM fct_orders GROUP BY order_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'fct_order_lines' AS table_name, 'order_line_id' AS columns, COUNT(*) AS violations FROM (SELECT order_line_id FROM fct_order_lines GROUP BY order_line_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'fct_subscriptions' AS table_name, 'subscription_id' AS columns, COUNT(*) AS violations FROM (SELECT subscription_id FROM fct_subscriptions GROUP BY subscription_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'dim_products' AS table_name, 'sku' AS columns, COUNT(*) AS violations FROM (SELECT sku FROM @dim_products GROUP BY sku HAVING COUNT(*) <> 1)
UNION ALL SELECT 'dim_plans' AS table_name, 'plan_id' AS columns, COUNT(*) AS violations FROM (SELECT plan_id FROM stg_plans LEFT JOIN (SELECT plan_id, MAX(effective_date) FROM stg_plan_prices GROUP BY 1) USING (plan_id) GROUP BY plan_id HAVING COUNT(*) <> 1)
UNION ALL SELECT 'dim_date', 'date_day', COUNT(*) FROM (SELECT date_day FROM @dim_date GROUP BY date_day HAVING COUNT(*) <> 1)
UNION ALL SELECT 'fct_identity_resolution_quality', 'source_system', COUNT(*) FROM (SELECT source_system FROM quality_mart GROUP BY source_system HAVING COUNT(*) <> 1)
-- query: dq_not_null
SELECT 'app_customers' AS table_name, COUNT(*) AS checked, 'app_db_customer_id' AS column_name, COUNT(*) - COUNT(app_db_customer_id) AS violations FROM stg_app_customers
UNION ALL SELECT 'app_customers' AS table_name, COUNT(*) AS checked, 'created_date' AS column_name, COUNT(*) - COUNT(created_date) AS violations FROM stg_app_customers
UNION ALL SELECT 'app_customers' AS table_name, COUNT(*) AS checked, 'segment' AS column_name, COUNT(*) - COUNT(segment) AS violations FROM stg_app_customers
UNION ALL SELECT 'app_customers' AS table_name, COUNT(*) AS checked, 'account_type' AS column_name, COUNT(*) - COUNT(account_type) AS violations FROM stg_app_customers
UNION ALL SELECT 'app_customers' AS table_name, COUNT(*) AS checked, 'acquisition_channel' AS column_name, COUNT(*) - COUNT(acquisition_channel) AS violations FROM stg_app_customers
UNION ALL SELECT 'stripe_customers' AS table_name, COUNT(*) AS checked, 'stripe_customer_id' AS column_name, COUNT(*) - COUNT(stripe_customer_id) AS violations FROM stg_stripe_customers
UNION ALL SELECT 'stripe_customers' AS table_name, COUNT(*) AS checked, 'created_date' AS column_name, COUNT(*) - COUNT(created_date) AS violations FROM stg_stripe_customers
UNION ALL SELECT 'stripe_customers' AS table_name, COUNT(*) AS checked, 'is_active' AS column_name, COUNT(*) - COUNT(is_active) AS violations FROM stg_stripe_customers
UNION ALL SELECT 'shopify_customers' AS table_name, COUNT(*) AS checked, 'shopify_customer_id' AS column_name, COUNT(*) - COUNT(shopify_customer_id) AS violations FROM stg_shopify_customers
UNION ALL SELECT 'shopify_customers' AS table_name, COUNT(*) AS checked, 'created_date' AS column_name, COUNT(*) - COUNT(created_date) AS violations FROM stg_shopify_customers
UNION ALL SELECT 'shopify_customers' AS table_name, COUNT(*) AS checked, 'is_active' AS column_name, COUNT(*) - COUNT(is_active) AS violations FROM stg_shopify_customers
UNION ALL SELECT 'salesforce_customers' AS table_name, COUNT(*) AS checked, 'salesforce_customer_id' AS column_name, COUNT(*) - COUNT(salesforce_customer_id) AS violations FROM stg_salesforce_customers
UNION ALL SELECT 'salesforce_customers' AS table_name, COUNT(*) AS checked, 'created_date' AS column_name, COUNT(*) - COUNT(created_date) AS violations FROM stg_salesforce_customers
UNION ALL SELECT 'salesforce_customers' AS table_name, COUNT(*) AS checked, 'is_active' AS column_name, COUNT(*) - COUNT(is_active) AS violations FROM stg_salesforce_customers
UNION ALL SELECT 'customer_id_crosswalk' AS table_name, COUNT(*) AS checked, 'source_system' AS column_name, COUNT(*) - COUNT(source_system) AS violations FROM stg_customer_id_crosswalk
UNION ALL SELECT 'customer_id_crosswalk' AS table_name, COUNT(*) AS checked, 'source_customer_id' AS column_name, COUNT(*) - COUNT(source_customer_id) AS violations FROM stg_customer_id_crosswalk
UNION ALL SELECT 'customer_id_crosswalk' AS table_name, COUNT(*) AS checked, 'app_db_customer_id' AS column_name, COUNT(*) - COUNT(app_db_customer_id) AS violations FROM stg_customer_id_crosswalk
UNION ALL SELECT 'customer_id_crosswalk' AS table_name, COUNT(*) AS checked, 'linked_date' AS column_name, COUNT(*) - COUNT(linked_date) AS violations FROM stg_customer_id_crosswalk
UNION ALL SELECT 'customer_id_crosswalk' AS table_name, COUNT(*) AS checked, 'link_method' AS column_name, COUNT(*) - COUNT(link_method) AS violations FROM stg_customer_id_crosswalk
UNION ALL SELECT 'orders' AS table_name, COUNT(*) AS checked, 'order_id' AS column_name, COUNT(*) - COUNT(order_id) AS violations FROM stg_orders
UNION ALL SELECT 'orders' AS table_name, COUNT(*) AS checked, 'customer_id' AS column_name, COUNT(*) - COUNT(customer_id) AS violations FROM stg_orders
UNION ALL SELECT 'orders' AS table_name, COUNT(*) AS checked, 'channel' AS column_name, COUNT(*) - COUNT(channel) AS violations FROM stg_orders
UNION ALL SELECT 'orders' AS table_name, COUNT(*) AS checked, 'order_date' AS column_name, COUNT(*) - COUNT(order_date) AS violations FROM stg_orders
UNION ALL SELECT 'orders' AS table_name, COUNT(*) AS checked, 'gross_amount' AS column_name, COUNT(*) - COUNT(gross_amount) AS violations FROM stg_orders
UNION ALL SELECT 'orders' AS table_name, COUNT(*) AS checked, 'net_amount' AS column_name, COUNT(*) - COUNT(net_amount) AS violations FROM stg_orders
UNION ALL SELECT 'order_lines' AS table_name, COUNT(*) AS checked, 'order_line_id' AS column_name, COUNT(*) - COUNT(order_line_id) AS violations FROM stg_order_lines
UNION ALL SELECT 'order_lines' AS table_name, COUNT(*) AS checked, 'order_id' AS column_name, COUNT(*) - COUNT(order_id) AS violations FROM stg_order_lines
UNION ALL SELECT 'order_lines' AS table_name, COUNT(*) AS checked, 'sku' AS column_name, COUNT(*) - COUNT(sku) AS violations FROM stg_order_lines
UNION ALL SELECT 'order_lines' AS table_name, COUNT(*) AS checked, 'quantity' AS column_name, COUNT(*) - COUNT(quantity) AS violations FROM stg_order_lines
UNION ALL SELECT 'order_lines' AS table_name, COUNT(*) AS checked, 'unit_price' AS column_name, COUNT(*) - COUNT(unit_price) AS violations FROM stg_order_lines
UNION ALL SELECT 'order_lines' AS table_name, COUNT(*) AS checked, 'discount_pct' AS column_name, COUNT(*) - COUNT(discount_pct) AS violations FROM stg_order_lines
UNION ALL SELECT 'order_lines' AS table_name, COUNT(*) AS checked, 'line_amount' AS column_name, COUNT(*) - COUNT(line_amount) AS violations FROM stg_order_lines
UNION ALL SELECT 'order_lines' AS table_name, COUNT(*) AS checked, 'order_date' AS column_name, COUNT(*) - COUNT(order_date) AS violations FROM stg_order_lines
UNION ALL SELECT 'products' AS table_name, COUNT(*) AS checked, 'sku' AS column_name, COUNT(*) - COUNT(sku) AS violations FROM stg_products
UNION ALL SELECT 'products' AS table_name, COUNT(*) AS checked, 'product_name' AS column_name, COUNT(*) - COUNT(product_name) AS violations FROM stg_products
UNION ALL SELECT 'products' AS table_name, COUNT(*) AS checked, 'category' AS column_name, COUNT(*) - COUNT(category) AS violations FROM stg_products
UNION ALL SELECT 'products' AS table_name, COUNT(*) AS checked, 'supplier_id' AS column_name, COUNT(*) - COUNT(supplier_id) AS violations FROM stg_products
UNION ALL SELECT 'products' AS table_name, COUNT(*) AS checked, 'unit_cost' AS column_name, COUNT(*) - COUNT(unit_cost) AS violations FROM stg_products
UNION ALL SELECT 'products' AS table_name, COUNT(*) AS checked, 'list_price' AS column_name, COUNT(*) - COUNT(list_price) AS violations FROM stg_products
UNION ALL SELECT 'products' AS table_name, COUNT(*) AS checked, 'introduced_date' AS column_name, COUNT(*) - COUNT(introduced_date) AS violations FROM stg_products
UNION ALL SELECT 'plans' AS table_name, COUNT(*) AS checked, 'plan_id' AS column_name, COUNT(*) - COUNT(plan_id) AS violations FROM stg_plans
UNION ALL SELECT 'plans' AS table_name, COUNT(*) AS checked, 'plan_name' AS column_name, COUNT(*) - COUNT(plan_name) AS violations FROM stg_plans
UNION ALL SELECT 'plans' AS table_name, COUNT(*) AS checked, 'plan_generation' AS column_name, COUNT(*) - COUNT(plan_generation) AS violations FROM stg_plans
UNION ALL SELECT 'plans' AS table_name, COUNT(*) AS checked, 'tier' AS column_name, COUNT(*) - COUNT(tier) AS violations FROM stg_plans
UNION ALL SELECT 'plans' AS table_name, COUNT(*) AS checked, 'launched_date' AS column_name, COUNT(*) - COUNT(launched_date) AS violations FROM stg_plans
UNION ALL SELECT 'plans' AS table_name, COUNT(*) AS checked, 'is_current' AS column_name, COUNT(*) - COUNT(is_current) AS violations FROM stg_plans
UNION ALL SELECT 'plan_prices' AS table_name, COUNT(*) AS checked, 'plan_id' AS column_name, COUNT(*) - COUNT(plan_id) AS violations FROM stg_plan_prices
UNION ALL SELECT 'plan_prices' AS table_name, COUNT(*) AS checked, 'effective_date' AS column_name, COUNT(*) - COUNT(effective_date) AS violations FROM stg_plan_prices
UNION ALL SELECT 'plan_prices' AS table_name, COUNT(*) AS checked, 'annual_price_per_seat' AS column_name, COUNT(*) - COUNT(annual_price_per_seat) AS violations FROM stg_plan_prices
UNION ALL SELECT 'subscriptions' AS table_name, COUNT(*) AS checked, 'subscription_id' AS column_name, COUNT(*) - COUNT(subscription_id) AS violations FROM stg_subscriptions
UNION ALL SELECT 'subscriptions' AS table_name, COUNT(*) AS checked, 'customer_id' AS column_name, COUNT(*) - COUNT(customer_id) AS violations FROM stg_subscriptions
UNION ALL SELECT 'subscriptions' AS table_name, COUNT(*) AS checked, 'plan_id' AS column_name, COUNT(*) - COUNT(plan_id) AS violations FROM stg_subscriptions
UNION ALL SELECT 'subscriptions' AS table_name, COUNT(*) AS checked, 'seats' AS column_name, COUNT(*) - COUNT(seats) AS violations FROM stg_subscriptions
UNION ALL SELECT 'subscriptions' AS table_name, COUNT(*) AS checked, 'term_start_date' AS column_name, COUNT(*) - COUNT(term_start_date) AS violations FROM stg_subscriptions
UNION ALL SELECT 'subscriptions' AS table_name, COUNT(*) AS checked, 'term_end_date' AS column_name, COUNT(*) - COUNT(term_end_date) AS violations FROM stg_subscriptions
UNION ALL SELECT 'subscriptions' AS table_name, COUNT(*) AS checked, 'price_per_seat' AS column_name, COUNT(*) - COUNT(price_per_seat) AS violations FROM stg_subscriptions
UNION ALL SELECT 'subscriptions' AS table_name, COUNT(*) AS checked, 'acv' AS column_name, COUNT(*) - COUNT(acv) AS violations FROM stg_subscriptions
UNION ALL SELECT 'subscriptions' AS table_name, COUNT(*) AS checked, 'order_id' AS column_name, COUNT(*) - COUNT(order_id) AS violations FROM stg_subscriptions
UNION ALL SELECT 'subscriptions' AS table_name, COUNT(*) AS checked, 'status' AS column_name, COUNT(*) - COUNT(status) AS violations FROM stg_subscriptions
UNION ALL SELECT 'invoices' AS table_name, COUNT(*) AS checked, 'invoice_id' AS column_name, COUNT(*) - COUNT(invoice_id) AS violations FROM stg_invoices
UNION ALL SELECT 'invoices' AS table_name, COUNT(*) AS checked, 'order_id' AS column_name, COUNT(*) - COUNT(order_id) AS violations FROM stg_invoices
UNION ALL SELECT 'invoices' AS table_name, COUNT(*) AS checked, 'billed_date' AS column_name, COUNT(*) - COUNT(billed_date) AS violations FROM stg_invoices
UNION ALL SELECT 'invoices' AS table_name, COUNT(*) AS checked, 'due_date' AS column_name, COUNT(*) - COUNT(due_date) AS violations FROM stg_invoices
UNION ALL SELECT 'invoices' AS table_name, COUNT(*) AS checked, 'amount' AS column_name, COUNT(*) - COUNT(amount) AS violations FROM stg_invoices
UNION ALL SELECT 'invoices' AS table_name, COUNT(*) AS checked, 'is_bad_debt' AS column_name, COUNT(*) - COUNT(is_bad_debt) AS violations FROM stg_invoices
UNION ALL SELECT 'invoices' AS table_name, COUNT(*) AS checked, 'salesforce_customer_id' AS column_name, COUNT(*) - COUNT(salesforce_customer_id) AS violations FROM stg_invoices
UNION ALL SELECT 'revenue_recognition' AS table_name, COUNT(*) AS checked, 'order_id' AS column_name, COUNT(*) - COUNT(order_id) AS violations FROM stg_revenue_recognition
UNION ALL SELECT 'revenue_recognition' AS table_name, COUNT(*) AS checked, 'recognition_date' AS column_name, COUNT(*) - COUNT(recognition_date) AS violations FROM stg_revenue_recognition
UNION ALL SELECT 'revenue_recognition' AS table_name, COUNT(*) AS checked, 'amount' AS column_name, COUNT(*) - COUNT(amount) AS violations FROM stg_revenue_recognition
UNION ALL SELECT 'refunds' AS table_name, COUNT(*) AS checked, 'refund_id' AS column_name, COUNT(*) - COUNT(refund_id) AS violations FROM stg_refunds
UNION ALL SELECT 'refunds' AS table_name, COUNT(*) AS checked, 'order_id' AS column_name, COUNT(*) - COUNT(order_id) AS violations FROM stg_refunds
UNION ALL SELECT 'refunds' AS table_name, COUNT(*) AS checked, 'refund_date' AS column_name, COUNT(*) - COUNT(refund_date) AS violations FROM stg_refunds
UNION ALL SELECT 'refunds' AS table_name, COUNT(*) AS checked, 'refund_amount' AS column_name, COUNT(*) - COUNT(refund_amount) AS violations FROM stg_refunds
UNION ALL SELECT 'refunds' AS table_name, COUNT(*) AS checked, 'stripe_customer_id' AS column_name, COUNT(*) - COUNT(stripe_customer_id) AS violations FROM stg_refunds
UNION ALL SELECT 'promotions' AS table_name, COUNT(*) AS checked, 'promo_code' AS column_name, COUNT(*) - COUNT(promo_code) AS violations FROM stg_promotions
UNION ALL SELECT 'promotions' AS table_name, COUNT(*) AS checked, 'promo_name' AS column_name, COUNT(*) - COUNT(promo_name) AS violations FROM stg_promotions
UNION ALL SELECT 'promotions' AS table_name, COUNT(*) AS checked, 'start_date' AS column_name, COUNT(*) - COUNT(start_date) AS violations FROM stg_promotions
UNION ALL SELECT 'promotions' AS table_name, COUNT(*) AS checked, 'end_date' AS column_name, COUNT(*) - COUNT(end_date) AS violations FROM stg_promotions
UNION ALL SELECT 'promotions' AS table_name, COUNT(*) AS checked, 'discount_pct' AS column_name, COUNT(*) - COUNT(discount_pct) AS violations FROM stg_promotions
UNION ALL SELECT 'promotions' AS table_name, COUNT(*) AS checked, 'eligible_channels' AS column_name, COUNT(*) - COUNT(eligible_channels) AS violations FROM stg_promotions
UNION ALL SELECT 'suppliers' AS table_name, COUNT(*) AS checked, 'supplier_id' AS column_name, COUNT(*) - COUNT(supplier_id) AS violations FROM stg_suppliers
UNION ALL SELECT 'suppliers' AS table_name, COUNT(*) AS checked, 'supplier_name' AS column_name, COUNT(*) - COUNT(supplier_name) AS violations FROM stg_suppliers
UNION ALL SELECT 'suppliers' AS table_name, COUNT(*) AS checked, 'category' AS column_name, COUNT(*) - COUNT(category) AS violations FROM stg_suppliers
UNION ALL SELECT 'suppliers' AS table_name, COUNT(*) AS checked, 'onboarded_date' AS column_name, COUNT(*) - COUNT(onboarded_date) AS violations FROM stg_suppliers
UNION ALL SELECT 'supplier_shipments' AS table_name, COUNT(*) AS checked, 'shipment_id' AS column_name, COUNT(*) - COUNT(shipment_id) AS violations FROM stg_supplier_shipments
UNION ALL SELECT 'supplier_shipments' AS table_name, COUNT(*) AS checked, 'supplier_id' AS column_name, COUNT(*) - COUNT(supplier_id) AS violations FROM stg_supplier_shipments
UNION ALL SELECT 'supplier_shipments' AS table_name, COUNT(*) AS checked, 'category' AS column_name, COUNT(*) - COUNT(category) AS violations FROM stg_supplier_shipments
UNION ALL SELECT 'supplier_shipments' AS table_name, COUNT(*) AS checked, 'expected_date' AS column_name, COUNT(*) - COUNT(expected_date) AS violations FROM stg_supplier_shipments
UNION ALL SELECT 'supplier_shipments' AS table_name, COUNT(*) AS checked, 'units_expected' AS column_name, COUNT(*) - COUNT(units_expected) AS violations FROM stg_supplier_shipments
UNION ALL SELECT 'supplier_shipments' AS table_name, COUNT(*) AS checked, 'units_received' AS column_name, COUNT(*) - COUNT(units_received) AS violations FROM stg_supplier_shipments
UNION ALL SELECT 'supplier_shipments' AS table_name, COUNT(*) AS checked, 'status' AS column_name, COUNT(*) - COUNT(status) AS violations FROM stg_supplier_shipments
UNION ALL SELECT 'ad_spend' AS table_name, COUNT(*) AS checked, 'spend_date' AS column_name, COUNT(*) - COUNT(spend_date) AS violations FROM stg_ad_spend
UNION ALL SELECT 'ad_spend' AS table_name, COUNT(*) AS checked, 'platform' AS column_name, COUNT(*) - COUNT(platform) AS violations FROM stg_ad_spend
UNION ALL SELECT 'ad_spend' AS table_name, COUNT(*) AS checked, 'spend_usd' AS column_name, COUNT(*) - COUNT(spend_usd) AS violations FROM stg_ad_spend
UNION ALL SELECT 'ad_spend' AS table_name, COUNT(*) AS checked, 'impressions' AS column_name, COUNT(*) - COUNT(impressions) AS violations FROM stg_ad_spend
UNION ALL SELECT 'ad_spend' AS table_name, COUNT(*) AS checked, 'clicks' AS column_name, COUNT(*) - COUNT(clicks) AS violations FROM stg_ad_spend
UNION ALL SELECT 'ad_spend' AS table_name, COUNT(*) AS checked, 'reported_conversions' AS column_name, COUNT(*) - COUNT(reported_conversions) AS violations FROM stg_ad_spend
UNION ALL SELECT 'tickets' AS table_name, COUNT(*) AS checked, 'ticket_id' AS column_name, COUNT(*) - COUNT(ticket_id) AS violations FROM stg_tickets
UNION ALL SELECT 'tickets' AS table_name, COUNT(*) AS checked, 'requester_source_system' AS column_name, COUNT(*) - COUNT(requester_source_system) AS violations FROM stg_tickets
UNION ALL SELECT 'tickets' AS table_name, COUNT(*) AS checked, 'requester_source_id' AS column_name, COUNT(*) - COUNT(requester_source_id) AS violations FROM stg_tickets
UNION ALL SELECT 'tickets' AS table_name, COUNT(*) AS checked, 'created_date' AS column_name, COUNT(*) - COUNT(created_date) AS violations FROM stg_tickets
UNION ALL SELECT 'tickets' AS table_name, COUNT(*) AS checked, 'category' AS column_name, COUNT(*) - COUNT(category) AS violations FROM stg_tickets
UNION ALL SELECT 'tickets' AS table_name, COUNT(*) AS checked, 'priority' AS column_name, COUNT(*) - COUNT(priority) AS violations FROM stg_tickets
UNION ALL SELECT 'tickets' AS table_name, COUNT(*) AS checked, 'status' AS column_name, COUNT(*) - COUNT(status) AS violations FROM stg_tickets
UNION ALL SELECT 'int_customer_identity', COUNT(*), 'source_system', COUNT(*) - COUNT(source_system) FROM int_customer_identity
UNION ALL SELECT 'int_customer_identity', COUNT(*), 'source_customer_id', COUNT(*) - COUNT(source_customer_id) FROM int_customer_identity
UNION ALL SELECT 'int_customer_identity', COUNT(*), 'source_created_date', COUNT(*) - COUNT(source_created_date) FROM int_customer_identity
UNION ALL SELECT 'int_customer_identity', COUNT(*), 'is_active', COUNT(*) - COUNT(is_active) FROM int_customer_identity
UNION ALL SELECT 'int_customer_identity', COUNT(*), 'resolution_status', COUNT(*) - COUNT(resolution_status) FROM int_customer_identity
UNION ALL SELECT 'fct_revenue', COUNT(*), 'activity_date', COUNT(*) - COUNT(activity_date) FROM fct_revenue
UNION ALL SELECT 'fct_revenue', COUNT(*), 'measure_name', COUNT(*) - COUNT(measure_name) FROM fct_revenue
UNION ALL SELECT 'fct_revenue', COUNT(*), 'amount', COUNT(*) - COUNT(amount) FROM fct_revenue
UNION ALL SELECT 'dim_customers', COUNT(*), 'app_db_customer_id', COUNT(*) - COUNT(app_db_customer_id) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'first_seen_date', COUNT(*) - COUNT(first_seen_date) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'segment', COUNT(*) - COUNT(segment) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'account_type', COUNT(*) - COUNT(account_type) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'acquisition_channel', COUNT(*) - COUNT(acquisition_channel) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'has_order', COUNT(*) - COUNT(has_order) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'resolved_source_id_count', COUNT(*) - COUNT(resolved_source_id_count) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'resolved_source_system_count', COUNT(*) - COUNT(resolved_source_system_count) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'has_app_db', COUNT(*) - COUNT(has_app_db) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'has_stripe', COUNT(*) - COUNT(has_stripe) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'has_shopify', COUNT(*) - COUNT(has_shopify) FROM dim_customers
UNION ALL SELECT 'dim_customers', COUNT(*), 'has_salesforce', COUNT(*) - COUNT(has_salesforce) FROM dim_customers
UNION ALL SELECT 'fct_identity_resolution_quality', COUNT(*), 'source_system', COUNT(*) - COUNT(source_system) FROM quality_mart
UNION ALL SELECT 'fct_identity_resolution_quality', COUNT(*), 'observed_id_count', COUNT(*) - COUNT(observed_id_count) FROM quality_mart
UNION ALL SELECT 'fct_identity_resolution_quality', COUNT(*), 'resolved_id_count', COUNT(*) - COUNT(resolved_id_count) FROM quality_mart
UNION ALL SELECT 'fct_identity_resolution_quality', COUNT(*), 'unresolved_id_count', COUNT(*) - COUNT(unresolved_id_count) FROM quality_mart
UNION ALL SELECT 'fct_identity_resolution_quality', COUNT(*), 'resolution_null_rate', COUNT(*) - COUNT(resolution_null_rate) FROM quality_mart
UNION ALL SELECT 'dim_products', COUNT(*), 'sku', COUNT(*) - COUNT(sku) FROM @dim_products
UNION ALL SELECT 'dim_products', COUNT(*), 'category', COUNT(*) - COUNT(category) FROM @dim_products
UNION ALL SELECT 'dim_products', COUNT(*), 'unit_cost', COUNT(*) - COUNT(unit_cost) FROM @dim_products
UNION ALL SELECT 'dim_plans', COUNT(*), 'plan_id', COUNT(*) - COUNT(plan_id) FROM (SELECT plan_id, plan_generation, current_annual_price_per_seat FROM stg_plans LEFT JOIN (SELECT plan_id, arg_max(annual_price_per_seat, effective_date) AS current_annual_price_per_seat FROM stg_plan_prices GROUP BY plan_id) USING (plan_id))
UNION ALL SELECT 'dim_plans', COUNT(*), 'plan_generation', COUNT(*) - COUNT(plan_generation) FROM (SELECT plan_id, plan_generation, current_annual_price_per_seat FROM stg_plans LEFT JOIN (SELECT plan_id, arg_max(annual_price_per_seat, effective_date) AS current_annual_price_per_seat FROM stg_plan_prices GROUP BY plan_id) USING (plan_id))
UNION ALL SELECT 'dim_plans', COUNT(*), 'current_annual_price_per_seat', COUNT(*) - COUNT(current_annual_price_per_seat) FROM (SELECT plan_id, plan_generation, current_annual_price_per_seat FROM stg_plans LEFT JOIN (SELECT plan_id, arg_max(annual_price_per_seat, effective_date) AS current_annual_price_per_seat FROM stg_plan_prices GROUP BY plan_id) USING (plan_id))
UNION ALL SELECT 'dim_date', COUNT(*), 'date_day', COUNT(*) - COUNT(date_day) FROM @dim_date
UNION ALL SELECT 'dim_date', COUNT(*), 'year_month', COUNT(*) - COUNT(year_month) FROM @dim_date
UNION ALL SELECT 'fct_orders', COUNT(*), 'order_id', COUNT(*) - COUNT(order_id) FROM fct_orders
UNION ALL SELECT 'fct_orders', COUNT(*), 'customer_id', COUNT(*) - COUNT(customer_id) FROM fct_orders
UNION ALL SELECT 'fct_orders', COUNT(*), 'channel', COUNT(*) - COUNT(channel) FROM fct_orders
UNION ALL SELECT 'fct_orders', COUNT(*), 'channel_raw', COUNT(*) - COUNT(channel_raw) FROM fct_orders
UNION ALL SELECT 'fct_orders', COUNT(*), 'is_first_order', COUNT(*) - COUNT(is_first_order) FROM fct_orders
UNION ALL SELECT 'fct_order_lines', COUNT(*), 'order_line_id', COUNT(*) - COUNT(order_line_id) FROM fct_order_lines
UNION ALL SELECT 'fct_order_lines', COUNT(*), 'order_id', COUNT(*) - COUNT(order_id) FROM fct_order_lines
UNION ALL SELECT 'fct_order_lines', COUNT(*), 'gross_margin', COUNT(*) - COUNT(gross_margin) FROM fct_order_lines
UNION ALL SELECT 'fct_subscriptions', COUNT(*), 'subscription_id', COUNT(*) - COUNT(subscription_id) FROM fct_subscriptions
UNION ALL SELECT 'fct_subscriptions', COUNT(*), 'customer_id', COUNT(*) - COUNT(customer_id) FROM fct_subscriptions
UNION ALL SELECT 'fct_subscriptions', COUNT(*), 'plan_generation', COUNT(*) - COUNT(plan_generation) FROM fct_subscriptions
UNION ALL SELECT 'fct_subscriptions', COUNT(*), 'status', COUNT(*) - COUNT(status) FROM fct_subscriptions
UNION ALL SELECT 'fct_marketing_spend', COUNT(*), 'spend_date', COUNT(*) - COUNT(spend_date) FROM fct_marketing_spend
UNION ALL SELECT 'fct_marketing_spend', COUNT(*), 'platform', COUNT(*) - COUNT(platform) FROM fct_marketing_spend
UNION ALL SELECT 'fct_marketing_spend', COUNT(*), 'attributed_new_d2c_customers_day_total', COUNT(*) - COUNT(attributed_new_d2c_customers_day_total) FROM fct_marketing_spend
-- query: table_fingerprint
SELECT 'app_customers' AS table_name, 'app_db_customer_id,created_date,segment,account_type,acquisition_channel' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT app_db_customer_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('app_db_customer_id=' || length(CAST(app_db_customer_id AS VARCHAR)) || ':' || CAST(app_db_customer_id AS VARCHAR), 'app_db_customer_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(NULL AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('created_date=' || length(CAST(created_date AS VARCHAR)) || ':' || CAST(created_date AS VARCHAR), 'created_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('app_db_customer_id=' || length(CAST(app_db_customer_id AS VARCHAR)) || ':' || CAST(app_db_customer_id AS VARCHAR), 'app_db_customer_id') || '|' || COALESCE('created_date=' || length(CAST(created_date AS VARCHAR)) || ':' || CAST(created_date AS VARCHAR), 'created_date') || '|' || COALESCE('segment=' || length(CAST(segment AS VARCHAR)) || ':' || CAST(segment AS VARCHAR), 'segment') || '|' || COALESCE('account_type=' || length(CAST(account_type AS VARCHAR)) || ':' || CAST(account_type AS VARCHAR), 'account_type') || '|' || COALESCE('acquisition_channel=' || length(CAST(acquisition_channel AS VARCHAR)) || ':' || CAST(acquisition_channel AS VARCHAR), 'acquisition_channel')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_app_customers
UNION ALL SELECT 'stripe_customers' AS table_name, 'stripe_customer_id,created_date,is_active,deactivated_date' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT stripe_customer_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('stripe_customer_id=' || length(CAST(stripe_customer_id AS VARCHAR)) || ':' || CAST(stripe_customer_id AS VARCHAR), 'stripe_customer_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(NULL AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('created_date=' || length(CAST(created_date AS VARCHAR)) || ':' || CAST(created_date AS VARCHAR), 'created_date') || '|' || COALESCE('deactivated_date=' || length(CAST(deactivated_date AS VARCHAR)) || ':' || CAST(deactivated_date AS VARCHAR), 'deactivated_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('stripe_customer_id=' || length(CAST(stripe_customer_id AS VARCHAR)) || ':' || CAST(stripe_customer_id AS VARCHAR), 'stripe_customer_id') || '|' || COALESCE('created_date=' || length(CAST(created_date AS VARCHAR)) || ':' || CAST(created_date AS VARCHAR), 'created_date') || '|' || COALESCE('is_active=' || length(CAST(is_active AS VARCHAR)) || ':' || CAST(is_active AS VARCHAR), 'is_active') || '|' || COALESCE('deactivated_date=' || length(CAST(deactivated_date AS VARCHAR)) || ':' || CAST(deactivated_date AS VARCHAR), 'deactivated_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_stripe_customers
UNION ALL SELECT 'shopify_customers' AS table_name, 'shopify_customer_id,created_date,is_active' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT shopify_customer_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('shopify_customer_id=' || length(CAST(shopify_customer_id AS VARCHAR)) || ':' || CAST(shopify_customer_id AS VARCHAR), 'shopify_customer_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(NULL AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('created_date=' || length(CAST(created_date AS VARCHAR)) || ':' || CAST(created_date AS VARCHAR), 'created_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('shopify_customer_id=' || length(CAST(shopify_customer_id AS VARCHAR)) || ':' || CAST(shopify_customer_id AS VARCHAR), 'shopify_customer_id') || '|' || COALESCE('created_date=' || length(CAST(created_date AS VARCHAR)) || ':' || CAST(created_date AS VARCHAR), 'created_date') || '|' || COALESCE('is_active=' || length(CAST(is_active AS VARCHAR)) || ':' || CAST(is_active AS VARCHAR), 'is_active')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_shopify_customers
UNION ALL SELECT 'salesforce_customers' AS table_name, 'salesforce_customer_id,created_date,is_active' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT salesforce_customer_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('salesforce_customer_id=' || length(CAST(salesforce_customer_id AS VARCHAR)) || ':' || CAST(salesforce_customer_id AS VARCHAR), 'salesforce_customer_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(NULL AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('created_date=' || length(CAST(created_date AS VARCHAR)) || ':' || CAST(created_date AS VARCHAR), 'created_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('salesforce_customer_id=' || length(CAST(salesforce_customer_id AS VARCHAR)) || ':' || CAST(salesforce_customer_id AS VARCHAR), 'salesforce_customer_id') || '|' || COALESCE('created_date=' || length(CAST(created_date AS VARCHAR)) || ':' || CAST(created_date AS VARCHAR), 'created_date') || '|' || COALESCE('is_active=' || length(CAST(is_active AS VARCHAR)) || ':' || CAST(is_active AS VARCHAR), 'is_active')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_salesforce_customers
UNION ALL SELECT 'customer_id_crosswalk' AS table_name, 'source_system,source_customer_id,app_db_customer_id,linked_date,link_method' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT CAST(source_system AS VARCHAR) || '/' || CAST(source_customer_id AS VARCHAR)) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('source_system=' || length(CAST(source_system AS VARCHAR)) || ':' || CAST(source_system AS VARCHAR), 'source_system') || '|' || COALESCE('source_customer_id=' || length(CAST(source_customer_id AS VARCHAR)) || ':' || CAST(source_customer_id AS VARCHAR), 'source_customer_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(NULL AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('linked_date=' || length(CAST(linked_date AS VARCHAR)) || ':' || CAST(linked_date AS VARCHAR), 'linked_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('source_system=' || length(CAST(source_system AS VARCHAR)) || ':' || CAST(source_system AS VARCHAR), 'source_system') || '|' || COALESCE('source_customer_id=' || length(CAST(source_customer_id AS VARCHAR)) || ':' || CAST(source_customer_id AS VARCHAR), 'source_customer_id') || '|' || COALESCE('app_db_customer_id=' || length(CAST(app_db_customer_id AS VARCHAR)) || ':' || CAST(app_db_customer_id AS VARCHAR), 'app_db_customer_id') || '|' || COALESCE('linked_date=' || length(CAST(linked_date AS VARCHAR)) || ':' || CAST(linked_date AS VARCHAR), 'linked_date') || '|' || COALESCE('link_method=' || length(CAST(link_method AS VARCHAR)) || ':' || CAST(link_method AS VARCHAR), 'link_method')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_customer_id_crosswalk
UNION ALL SELECT 'orders' AS table_name, 'order_id,customer_id,channel,order_date,gross_amount,take_rate,net_amount,promo_code,subscription_id' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT order_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('order_id=' || length(CAST(order_id AS VARCHAR)) || ':' || CAST(order_id AS VARCHAR), 'order_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('gross_amount=' || length(CAST(gross_amount AS VARCHAR)) || ':' || CAST(gross_amount AS VARCHAR), 'gross_amount') || '|' || COALESCE('take_rate=' || length(CAST(take_rate AS VARCHAR)) || ':' || CAST(take_rate AS VARCHAR), 'take_rate') || '|' || COALESCE('net_amount=' || length(CAST(net_amount AS VARCHAR)) || ':' || CAST(net_amount AS VARCHAR), 'net_amount')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('order_date=' || length(CAST(order_date AS VARCHAR)) || ':' || CAST(order_date AS VARCHAR), 'order_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('order_id=' || length(CAST(order_id AS VARCHAR)) || ':' || CAST(order_id AS VARCHAR), 'order_id') || '|' || COALESCE('customer_id=' || length(CAST(customer_id AS VARCHAR)) || ':' || CAST(customer_id AS VARCHAR), 'customer_id') || '|' || COALESCE('channel=' || length(CAST(channel AS VARCHAR)) || ':' || CAST(channel AS VARCHAR), 'channel') || '|' || COALESCE('order_date=' || length(CAST(order_date AS VARCHAR)) || ':' || CAST(order_date AS VARCHAR), 'order_date') || '|' || COALESCE('gross_amount=' || length(CAST(gross_amount AS VARCHAR)) || ':' || CAST(gross_amount AS VARCHAR), 'gross_amount') || '|' || COALESCE('take_rate=' || length(CAST(take_rate AS VARCHAR)) || ':' || CAST(take_rate AS VARCHAR), 'take_rate') || '|' || COALESCE('net_amount=' || length(CAST(net_amount AS VARCHAR)) || ':' || CAST(net_amount AS VARCHAR), 'net_amount') || '|' || COALESCE('promo_code=' || length(CAST(promo_code AS VARCHAR)) || ':' || CAST(promo_code AS VARCHAR), 'promo_code') || '|' || COALESCE('subscription_id=' || length(CAST(subscription_id AS VARCHAR)) || ':' || CAST(subscription_id AS VARCHAR), 'subscription_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_orders
UNION ALL SELECT 'order_lines' AS table_name, 'order_line_id,order_id,sku,quantity,unit_price,discount_pct,line_amount,order_date' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT order_line_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('order_line_id=' || length(CAST(order_line_id AS VARCHAR)) || ':' || CAST(order_line_id AS VARCHAR), 'order_line_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('unit_price=' || length(CAST(unit_price AS VARCHAR)) || ':' || CAST(unit_price AS VARCHAR), 'unit_price') || '|' || COALESCE('discount_pct=' || length(CAST(discount_pct AS VARCHAR)) || ':' || CAST(discount_pct AS VARCHAR), 'discount_pct') || '|' || COALESCE('line_amount=' || length(CAST(line_amount AS VARCHAR)) || ':' || CAST(line_amount AS VARCHAR), 'line_amount')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('order_date=' || length(CAST(order_date AS VARCHAR)) || ':' || CAST(order_date AS VARCHAR), 'order_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('order_line_id=' || length(CAST(order_line_id AS VARCHAR)) || ':' || CAST(order_line_id AS VARCHAR), 'order_line_id') || '|' || COALESCE('order_id=' || length(CAST(order_id AS VARCHAR)) || ':' || CAST(order_id AS VARCHAR), 'order_id') || '|' || COALESCE('sku=' || length(CAST(sku AS VARCHAR)) || ':' || CAST(sku AS VARCHAR), 'sku') || '|' || COALESCE('quantity=' || length(CAST(quantity AS VARCHAR)) || ':' || CAST(quantity AS VARCHAR), 'quantity') || '|' || COALESCE('unit_price=' || length(CAST(unit_price AS VARCHAR)) || ':' || CAST(unit_price AS VARCHAR), 'unit_price') || '|' || COALESCE('discount_pct=' || length(CAST(discount_pct AS VARCHAR)) || ':' || CAST(discount_pct AS VARCHAR), 'discount_pct') || '|' || COALESCE('line_amount=' || length(CAST(line_amount AS VARCHAR)) || ':' || CAST(line_amount AS VARCHAR), 'line_amount') || '|' || COALESCE('order_date=' || length(CAST(order_date AS VARCHAR)) || ':' || CAST(order_date AS VARCHAR), 'order_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_order_lines
UNION ALL SELECT 'products' AS table_name, 'sku,product_name,category,supplier_id,unit_cost,list_price,introduced_date' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT sku) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('sku=' || length(CAST(sku AS VARCHAR)) || ':' || CAST(sku AS VARCHAR), 'sku')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('unit_cost=' || length(CAST(unit_cost AS VARCHAR)) || ':' || CAST(unit_cost AS VARCHAR), 'unit_cost') || '|' || COALESCE('list_price=' || length(CAST(list_price AS VARCHAR)) || ':' || CAST(list_price AS VARCHAR), 'list_price')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('introduced_date=' || length(CAST(introduced_date AS VARCHAR)) || ':' || CAST(introduced_date AS VARCHAR), 'introduced_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('sku=' || length(CAST(sku AS VARCHAR)) || ':' || CAST(sku AS VARCHAR), 'sku') || '|' || COALESCE('product_name=' || length(CAST(product_name AS VARCHAR)) || ':' || CAST(product_name AS VARCHAR), 'product_name') || '|' || COALESCE('category=' || length(CAST(category AS VARCHAR)) || ':' || CAST(category AS VARCHAR), 'category') || '|' || COALESCE('supplier_id=' || length(CAST(supplier_id AS VARCHAR)) || ':' || CAST(supplier_id AS VARCHAR), 'supplier_id') || '|' || COALESCE('unit_cost=' || length(CAST(unit_cost AS VARCHAR)) || ':' || CAST(unit_cost AS VARCHAR), 'unit_cost') || '|' || COALESCE('list_price=' || length(CAST(list_price AS VARCHAR)) || ':' || CAST(list_price AS VARCHAR), 'list_price') || '|' || COALESCE('introduced_date=' || length(CAST(introduced_date AS VARCHAR)) || ':' || CAST(introduced_date AS VARCHAR), 'introduced_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_products
UNION ALL SELECT 'plans' AS table_name, 'plan_id,plan_name,plan_generation,tier,launched_date,retired_date,is_current' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT plan_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('plan_id=' || length(CAST(plan_id AS VARCHAR)) || ':' || CAST(plan_id AS VARCHAR), 'plan_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(NULL AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('launched_date=' || length(CAST(launched_date AS VARCHAR)) || ':' || CAST(launched_date AS VARCHAR), 'launched_date') || '|' || COALESCE('retired_date=' || length(CAST(retired_date AS VARCHAR)) || ':' || CAST(retired_date AS VARCHAR), 'retired_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('plan_id=' || length(CAST(plan_id AS VARCHAR)) || ':' || CAST(plan_id AS VARCHAR), 'plan_id') || '|' || COALESCE('plan_name=' || length(CAST(plan_name AS VARCHAR)) || ':' || CAST(plan_name AS VARCHAR), 'plan_name') || '|' || COALESCE('plan_generation=' || length(CAST(plan_generation AS VARCHAR)) || ':' || CAST(plan_generation AS VARCHAR), 'plan_generation') || '|' || COALESCE('tier=' || length(CAST(tier AS VARCHAR)) || ':' || CAST(tier AS VARCHAR), 'tier') || '|' || COALESCE('launched_date=' || length(CAST(launched_date AS VARCHAR)) || ':' || CAST(launched_date AS VARCHAR), 'launched_date') || '|' || COALESCE('retired_date=' || length(CAST(retired_date AS VARCHAR)) || ':' || CAST(retired_date AS VARCHAR), 'retired_date') || '|' || COALESCE('is_current=' || length(CAST(is_current AS VARCHAR)) || ':' || CAST(is_current AS VARCHAR), 'is_current')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_plans
UNION ALL SELECT 'plan_prices' AS table_name, 'plan_id,effective_date,annual_price_per_seat' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT CAST(plan_id AS VARCHAR) || '/' || CAST(effective_date AS VARCHAR)) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('plan_id=' || length(CAST(plan_id AS VARCHAR)) || ':' || CAST(plan_id AS VARCHAR), 'plan_id') || '|' || COALESCE('effective_date=' || length(CAST(effective_date AS VARCHAR)) || ':' || CAST(effective_date AS VARCHAR), 'effective_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('annual_price_per_seat=' || length(CAST(annual_price_per_seat AS VARCHAR)) || ':' || CAST(annual_price_per_seat AS VARCHAR), 'annual_price_per_seat')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('effective_date=' || length(CAST(effective_date AS VARCHAR)) || ':' || CAST(effective_date AS VARCHAR), 'effective_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('plan_id=' || length(CAST(plan_id AS VARCHAR)) || ':' || CAST(plan_id AS VARCHAR), 'plan_id') || '|' || COALESCE('effective_date=' || length(CAST(effective_date AS VARCHAR)) || ':' || CAST(effective_date AS VARCHAR), 'effective_date') || '|' || COALESCE('annual_price_per_seat=' || length(CAST(annual_price_per_seat AS VARCHAR)) || ':' || CAST(annual_price_per_seat AS VARCHAR), 'annual_price_per_seat')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_plan_prices
UNION ALL SELECT 'subscriptions' AS table_name, 'subscription_id,customer_id,plan_id,seats,term_start_date,term_end_date,price_per_seat,acv,order_id,renewed_from_subscription_id,status,cancelled_date' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT subscription_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('subscription_id=' || length(CAST(subscription_id AS VARCHAR)) || ':' || CAST(subscription_id AS VARCHAR), 'subscription_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('price_per_seat=' || length(CAST(price_per_seat AS VARCHAR)) || ':' || CAST(price_per_seat AS VARCHAR), 'price_per_seat') || '|' || COALESCE('acv=' || length(CAST(acv AS VARCHAR)) || ':' || CAST(acv AS VARCHAR), 'acv')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('term_start_date=' || length(CAST(term_start_date AS VARCHAR)) || ':' || CAST(term_start_date AS VARCHAR), 'term_start_date') || '|' || COALESCE('term_end_date=' || length(CAST(term_end_date AS VARCHAR)) || ':' || CAST(term_end_date AS VARCHAR), 'term_end_date') || '|' || COALESCE('cancelled_date=' || length(CAST(cancelled_date AS VARCHAR)) || ':' || CAST(cancelled_date AS VARCHAR), 'cancelled_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('subscription_id=' || length(CAST(subscription_id AS VARCHAR)) || ':' || CAST(subscription_id AS VARCHAR), 'subscription_id') || '|' || COALESCE('customer_id=' || length(CAST(customer_id AS VARCHAR)) || ':' || CAST(customer_id AS VARCHAR), 'customer_id') || '|' || COALESCE('plan_id=' || length(CAST(plan_id AS VARCHAR)) || ':' || CAST(plan_id AS VARCHAR), 'plan_id') || '|' || COALESCE('seats=' || length(CAST(seats AS VARCHAR)) || ':' || CAST(seats AS VARCHAR), 'seats') || '|' || COALESCE('term_start_date=' || length(CAST(term_start_date AS VARCHAR)) || ':' || CAST(term_start_date AS VARCHAR), 'term_start_date') || '|' || COALESCE('term_end_date=' || length(CAST(term_end_date AS VARCHAR)) || ':' || CAST(term_end_date AS VARCHAR), 'term_end_date') || '|' || COALESCE('price_per_seat=' || length(CAST(price_per_seat AS VARCHAR)) || ':' || CAST(price_per_seat AS VARCHAR), 'price_per_seat') || '|' || COALESCE('acv=' || length(CAST(acv AS VARCHAR)) || ':' || CAST(acv AS VARCHAR), 'acv') || '|' || COALESCE('order_id=' || length(CAST(order_id AS VARCHAR)) || ':' || CAST(order_id AS VARCHAR), 'order_id') || '|' || COALESCE('renewed_from_subscription_id=' || length(CAST(renewed_from_subscription_id AS VARCHAR)) || ':' || CAST(renewed_from_subscription_id AS VARCHAR), 'renewed_from_subscription_id') || '|' || COALESCE('status=' || length(CAST(status AS VARCHAR)) || ':' || CAST(status AS VARCHAR), 'status') || '|' || COALESCE('cancelled_date=' || length(CAST(cancelled_date AS VARCHAR)) || ':' || CAST(cancelled_date AS VARCHAR), 'cancelled_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_subscriptions
UNION ALL SELECT 'invoices' AS table_name, 'invoice_id,order_id,billed_date,due_date,collected_date,amount,is_bad_debt,salesforce_customer_id' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT invoice_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('invoice_id=' || length(CAST(invoice_id AS VARCHAR)) || ':' || CAST(invoice_id AS VARCHAR), 'invoice_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('amount=' || length(CAST(amount AS VARCHAR)) || ':' || CAST(amount AS VARCHAR), 'amount')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('billed_date=' || length(CAST(billed_date AS VARCHAR)) || ':' || CAST(billed_date AS VARCHAR), 'billed_date') || '|' || COALESCE('due_date=' || length(CAST(due_date AS VARCHAR)) || ':' || CAST(due_date AS VARCHAR), 'due_date') || '|' || COALESCE('collected_date=' || length(CAST(collected_date AS VARCHAR)) || ':' || CAST(collected_date AS VARCHAR), 'collected_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('invoice_id=' || length(CAST(invoice_id AS VARCHAR)) || ':' || CAST(invoice_id AS VARCHAR), 'invoice_id') || '|' || COALESCE('order_id=' || length(CAST(order_id AS VARCHAR)) || ':' || CAST(order_id AS VARCHAR), 'order_id') || '|' || COALESCE('billed_date=' || length(CAST(billed_date AS VARCHAR)) || ':' || CAST(billed_date AS VARCHAR), 'billed_date') || '|' || COALESCE('due_date=' || length(CAST(due_date AS VARCHAR)) || ':' || CAST(due_date AS VARCHAR), 'due_date') || '|' || COALESCE('collected_date=' || length(CAST(collected_date AS VARCHAR)) || ':' || CAST(collected_date AS VARCHAR), 'collected_date') || '|' || COALESCE('amount=' || length(CAST(amount AS VARCHAR)) || ':' || CAST(amount AS VARCHAR), 'amount') || '|' || COALESCE('is_bad_debt=' || length(CAST(is_bad_debt AS VARCHAR)) || ':' || CAST(is_bad_debt AS VARCHAR), 'is_bad_debt') || '|' || COALESCE('salesforce_customer_id=' || length(CAST(salesforce_customer_id AS VARCHAR)) || ':' || CAST(salesforce_customer_id AS VARCHAR), 'salesforce_customer_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_invoices
UNION ALL SELECT 'revenue_recognition' AS table_name, 'order_id,recognition_date,amount' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT CAST(order_id AS VARCHAR) || '/' || CAST(recognition_date AS VARCHAR)) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('order_id=' || length(CAST(order_id AS VARCHAR)) || ':' || CAST(order_id AS VARCHAR), 'order_id') || '|' || COALESCE('recognition_date=' || length(CAST(recognition_date AS VARCHAR)) || ':' || CAST(recognition_date AS VARCHAR), 'recognition_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('amount=' || length(CAST(amount AS VARCHAR)) || ':' || CAST(amount AS VARCHAR), 'amount')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('recognition_date=' || length(CAST(recognition_date AS VARCHAR)) || ':' || CAST(recognition_date AS VARCHAR), 'recognition_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('order_id=' || length(CAST(order_id AS VARCHAR)) || ':' || CAST(order_id AS VARCHAR), 'order_id') || '|' || COALESCE('recognition_date=' || length(CAST(recognition_date AS VARCHAR)) || ':' || CAST(recognition_date AS VARCHAR), 'recognition_date') || '|' || COALESCE('amount=' || length(CAST(amount AS VARCHAR)) || ':' || CAST(amount AS VARCHAR), 'amount')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_revenue_recognition
UNION ALL SELECT 'refunds' AS table_name, 'refund_id,order_id,refund_date,refund_amount,stripe_customer_id' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT refund_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('refund_id=' || length(CAST(refund_id AS VARCHAR)) || ':' || CAST(refund_id AS VARCHAR), 'refund_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('refund_amount=' || length(CAST(refund_amount AS VARCHAR)) || ':' || CAST(refund_amount AS VARCHAR), 'refund_amount')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('refund_date=' || length(CAST(refund_date AS VARCHAR)) || ':' || CAST(refund_date AS VARCHAR), 'refund_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('refund_id=' || length(CAST(refund_id AS VARCHAR)) || ':' || CAST(refund_id AS VARCHAR), 'refund_id') || '|' || COALESCE('order_id=' || length(CAST(order_id AS VARCHAR)) || ':' || CAST(order_id AS VARCHAR), 'order_id') || '|' || COALESCE('refund_date=' || length(CAST(refund_date AS VARCHAR)) || ':' || CAST(refund_date AS VARCHAR), 'refund_date') || '|' || COALESCE('refund_amount=' || length(CAST(refund_amount AS VARCHAR)) || ':' || CAST(refund_amount AS VARCHAR), 'refund_amount') || '|' || COALESCE('stripe_customer_id=' || length(CAST(stripe_customer_id AS VARCHAR)) || ':' || CAST(stripe_customer_id AS VARCHAR), 'stripe_customer_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_refunds
UNION ALL SELECT 'promotions' AS table_name, 'promo_code,promo_name,start_date,end_date,discount_pct,eligible_channels' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT promo_code) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('promo_code=' || length(CAST(promo_code AS VARCHAR)) || ':' || CAST(promo_code AS VARCHAR), 'promo_code')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('discount_pct=' || length(CAST(discount_pct AS VARCHAR)) || ':' || CAST(discount_pct AS VARCHAR), 'discount_pct')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('start_date=' || length(CAST(start_date AS VARCHAR)) || ':' || CAST(start_date AS VARCHAR), 'start_date') || '|' || COALESCE('end_date=' || length(CAST(end_date AS VARCHAR)) || ':' || CAST(end_date AS VARCHAR), 'end_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('promo_code=' || length(CAST(promo_code AS VARCHAR)) || ':' || CAST(promo_code AS VARCHAR), 'promo_code') || '|' || COALESCE('promo_name=' || length(CAST(promo_name AS VARCHAR)) || ':' || CAST(promo_name AS VARCHAR), 'promo_name') || '|' || COALESCE('start_date=' || length(CAST(start_date AS VARCHAR)) || ':' || CAST(start_date AS VARCHAR), 'start_date') || '|' || COALESCE('end_date=' || length(CAST(end_date AS VARCHAR)) || ':' || CAST(end_date AS VARCHAR), 'end_date') || '|' || COALESCE('discount_pct=' || length(CAST(discount_pct AS VARCHAR)) || ':' || CAST(discount_pct AS VARCHAR), 'discount_pct') || '|' || COALESCE('eligible_channels=' || length(CAST(eligible_channels AS VARCHAR)) || ':' || CAST(eligible_channels AS VARCHAR), 'eligible_channels')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_promotions
UNION ALL SELECT 'suppliers' AS table_name, 'supplier_id,supplier_name,category,onboarded_date' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT supplier_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('supplier_id=' || length(CAST(supplier_id AS VARCHAR)) || ':' || CAST(supplier_id AS VARCHAR), 'supplier_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(NULL AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('onboarded_date=' || length(CAST(onboarded_date AS VARCHAR)) || ':' || CAST(onboarded_date AS VARCHAR), 'onboarded_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('supplier_id=' || length(CAST(supplier_id AS VARCHAR)) || ':' || CAST(supplier_id AS VARCHAR), 'supplier_id') || '|' || COALESCE('supplier_name=' || length(CAST(supplier_name AS VARCHAR)) || ':' || CAST(supplier_name AS VARCHAR), 'supplier_name') || '|' || COALESCE('category=' || length(CAST(category AS VARCHAR)) || ':' || CAST(category AS VARCHAR), 'category') || '|' || COALESCE('onboarded_date=' || length(CAST(onboarded_date AS VARCHAR)) || ':' || CAST(onboarded_date AS VARCHAR), 'onboarded_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_suppliers
UNION ALL SELECT 'supplier_shipments' AS table_name, 'shipment_id,supplier_id,category,expected_date,received_date,units_expected,units_received,status' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT shipment_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('shipment_id=' || length(CAST(shipment_id AS VARCHAR)) || ':' || CAST(shipment_id AS VARCHAR), 'shipment_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(NULL AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('expected_date=' || length(CAST(expected_date AS VARCHAR)) || ':' || CAST(expected_date AS VARCHAR), 'expected_date') || '|' || COALESCE('received_date=' || length(CAST(received_date AS VARCHAR)) || ':' || CAST(received_date AS VARCHAR), 'received_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('shipment_id=' || length(CAST(shipment_id AS VARCHAR)) || ':' || CAST(shipment_id AS VARCHAR), 'shipment_id') || '|' || COALESCE('supplier_id=' || length(CAST(supplier_id AS VARCHAR)) || ':' || CAST(supplier_id AS VARCHAR), 'supplier_id') || '|' || COALESCE('category=' || length(CAST(category AS VARCHAR)) || ':' || CAST(category AS VARCHAR), 'category') || '|' || COALESCE('expected_date=' || length(CAST(expected_date AS VARCHAR)) || ':' || CAST(expected_date AS VARCHAR), 'expected_date') || '|' || COALESCE('received_date=' || length(CAST(received_date AS VARCHAR)) || ':' || CAST(received_date AS VARCHAR), 'received_date') || '|' || COALESCE('units_expected=' || length(CAST(units_expected AS VARCHAR)) || ':' || CAST(units_expected AS VARCHAR), 'units_expected') || '|' || COALESCE('units_received=' || length(CAST(units_received AS VARCHAR)) || ':' || CAST(units_received AS VARCHAR), 'units_received') || '|' || COALESCE('status=' || length(CAST(status AS VARCHAR)) || ':' || CAST(status AS VARCHAR), 'status')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_supplier_shipments
UNION ALL SELECT 'ad_spend' AS table_name, 'spend_date,platform,spend_usd,impressions,clicks,reported_conversions' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT CAST(spend_date AS VARCHAR) || '/' || CAST(platform AS VARCHAR)) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('spend_date=' || length(CAST(spend_date AS VARCHAR)) || ':' || CAST(spend_date AS VARCHAR), 'spend_date') || '|' || COALESCE('platform=' || length(CAST(platform AS VARCHAR)) || ':' || CAST(platform AS VARCHAR), 'platform')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('spend_usd=' || length(CAST(spend_usd AS VARCHAR)) || ':' || CAST(spend_usd AS VARCHAR), 'spend_usd')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('spend_date=' || length(CAST(spend_date AS VARCHAR)) || ':' || CAST(spend_date AS VARCHAR), 'spend_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('spend_date=' || length(CAST(spend_date AS VARCHAR)) || ':' || CAST(spend_date AS VARCHAR), 'spend_date') || '|' || COALESCE('platform=' || length(CAST(platform AS VARCHAR)) || ':' || CAST(platform AS VARCHAR), 'platform') || '|' || COALESCE('spend_usd=' || length(CAST(spend_usd AS VARCHAR)) || ':' || CAST(spend_usd AS VARCHAR), 'spend_usd') || '|' || COALESCE('impressions=' || length(CAST(impressions AS VARCHAR)) || ':' || CAST(impressions AS VARCHAR), 'impressions') || '|' || COALESCE('clicks=' || length(CAST(clicks AS VARCHAR)) || ':' || CAST(clicks AS VARCHAR), 'clicks') || '|' || COALESCE('reported_conversions=' || length(CAST(reported_conversions AS VARCHAR)) || ':' || CAST(reported_conversions AS VARCHAR), 'reported_conversions')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_ad_spend
UNION ALL SELECT 'tickets' AS table_name, 'ticket_id,requester_source_system,requester_source_id,created_date,category,priority,status,resolved_date,related_order_id,related_subscription_id' AS columns, COUNT(*) AS row_count, COUNT(*) = COUNT(DISTINCT ticket_id) AS key_is_unique, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('ticket_id=' || length(CAST(ticket_id AS VARCHAR)) || ':' || CAST(ticket_id AS VARCHAR), 'ticket_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS key_hash, CAST(NULL AS VARCHAR) AS money_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('created_date=' || length(CAST(created_date AS VARCHAR)) || ':' || CAST(created_date AS VARCHAR), 'created_date') || '|' || COALESCE('resolved_date=' || length(CAST(resolved_date AS VARCHAR)) || ':' || CAST(resolved_date AS VARCHAR), 'resolved_date')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS date_hash, CAST(CAST(SUM(CAST('0x' || substr(sha256(COALESCE('ticket_id=' || length(CAST(ticket_id AS VARCHAR)) || ':' || CAST(ticket_id AS VARCHAR), 'ticket_id') || '|' || COALESCE('requester_source_system=' || length(CAST(requester_source_system AS VARCHAR)) || ':' || CAST(requester_source_system AS VARCHAR), 'requester_source_system') || '|' || COALESCE('requester_source_id=' || length(CAST(requester_source_id AS VARCHAR)) || ':' || CAST(requester_source_id AS VARCHAR), 'requester_source_id') || '|' || COALESCE('created_date=' || length(CAST(created_date AS VARCHAR)) || ':' || CAST(created_date AS VARCHAR), 'created_date') || '|' || COALESCE('category=' || length(CAST(category AS VARCHAR)) || ':' || CAST(category AS VARCHAR), 'category') || '|' || COALESCE('priority=' || length(CAST(priority AS VARCHAR)) || ':' || CAST(priority AS VARCHAR), 'priority') || '|' || COALESCE('status=' || length(CAST(status AS VARCHAR)) || ':' || CAST(status AS VARCHAR), 'status') || '|' || COALESCE('resolved_date=' || length(CAST(resolved_date AS VARCHAR)) || ':' || CAST(resolved_date AS VARCHAR), 'resolved_date') || '|' || COALESCE('related_order_id=' || length(CAST(related_order_id AS VARCHAR)) || ':' || CAST(related_order_id AS VARCHAR), 'related_order_id') || '|' || COALESCE('related_subscription_id=' || length(CAST(related_subscription_id AS VARCHAR)) || ':' || CAST(related_subscription_id AS VARCHAR), 'related_subscription_id')), 1, 15) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM stg_tickets
-- query: fingerprint_diff
SELECT 'app_customers' AS table_name, true AS same_columns, COUNT(*) FILTER (created_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (created_date > DATE '2001-06-30') = 0 AS same_key_hash, true AS same_money_hash, COUNT(*) FILTER (created_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (created_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_app_customers
UNION ALL SELECT 'stripe_customers' AS table_name, true AS same_columns, COUNT(*) FILTER (created_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (created_date > DATE '2001-06-30') = 0 AS same_key_hash, true AS same_money_hash, COUNT(*) FILTER (created_date > DATE '2001-06-30' OR deactivated_date > DATE '2001-06-30') = 0 AS same_date_hash, COUNT(*) FILTER (created_date > DATE '2001-06-30' OR deactivated_date > DATE '2001-06-30') = 0 AS same_content_hash FROM stg_stripe_customers
UNION ALL SELECT 'shopify_customers' AS table_name, true AS same_columns, COUNT(*) FILTER (created_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (created_date > DATE '2001-06-30') = 0 AS same_key_hash, true AS same_money_hash, COUNT(*) FILTER (created_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (created_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_shopify_customers
UNION ALL SELECT 'salesforce_customers' AS table_name, true AS same_columns, COUNT(*) FILTER (created_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (created_date > DATE '2001-06-30') = 0 AS same_key_hash, true AS same_money_hash, COUNT(*) FILTER (created_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (created_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_salesforce_customers
UNION ALL SELECT 'customer_id_crosswalk' AS table_name, true AS same_columns, COUNT(*) FILTER (linked_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (linked_date > DATE '2001-06-30') = 0 AS same_key_hash, true AS same_money_hash, COUNT(*) FILTER (linked_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (linked_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_customer_id_crosswalk
UNION ALL SELECT 'orders' AS table_name, true AS same_columns, COUNT(*) FILTER (order_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (order_date > DATE '2001-06-30') = 0 AS same_key_hash, COUNT(*) FILTER (order_date > DATE '2001-06-30') = 0 AS same_money_hash, COUNT(*) FILTER (order_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (order_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_orders
UNION ALL SELECT 'order_lines' AS table_name, true AS same_columns, COUNT(*) FILTER (order_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (order_date > DATE '2001-06-30') = 0 AS same_key_hash, COUNT(*) FILTER (order_date > DATE '2001-06-30') = 0 AS same_money_hash, COUNT(*) FILTER (order_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (order_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_order_lines
UNION ALL SELECT 'products' AS table_name, true AS same_columns, COUNT(*) FILTER (introduced_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (introduced_date > DATE '2001-06-30') = 0 AS same_key_hash, COUNT(*) FILTER (introduced_date > DATE '2001-06-30') = 0 AS same_money_hash, COUNT(*) FILTER (introduced_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (introduced_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_products
UNION ALL SELECT 'plans' AS table_name, true AS same_columns, COUNT(*) FILTER (launched_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (launched_date > DATE '2001-06-30') = 0 AS same_key_hash, true AS same_money_hash, COUNT(*) FILTER (launched_date > DATE '2001-06-30' OR retired_date > DATE '2001-06-30') = 0 AS same_date_hash, COUNT(*) FILTER (launched_date > DATE '2001-06-30' OR retired_date > DATE '2001-06-30') = 0 AS same_content_hash FROM stg_plans
UNION ALL SELECT 'plan_prices' AS table_name, true AS same_columns, COUNT(*) FILTER (effective_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (effective_date > DATE '2001-06-30') = 0 AS same_key_hash, COUNT(*) FILTER (effective_date > DATE '2001-06-30') = 0 AS same_money_hash, COUNT(*) FILTER (effective_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (effective_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_plan_prices
UNION ALL SELECT 'subscriptions' AS table_name, true AS same_columns, COUNT(*) FILTER (term_start_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (term_start_date > DATE '2001-06-30') = 0 AS same_key_hash, COUNT(*) FILTER (term_start_date > DATE '2001-06-30') = 0 AS same_money_hash, COUNT(*) FILTER (term_start_date > DATE '2001-06-30' OR term_end_date >= DATE '2001-06-30' AND cancelled_date IS NOT NULL) = 0 AS same_date_hash, COUNT(*) FILTER (term_start_date > DATE '2001-06-30' OR term_end_date >= DATE '2001-06-30' AND status <> 'active') = 0 AS same_content_hash FROM stg_subscriptions
UNION ALL SELECT 'invoices' AS table_name, true AS same_columns, COUNT(*) FILTER (billed_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (billed_date > DATE '2001-06-30') = 0 AS same_key_hash, COUNT(*) FILTER (billed_date > DATE '2001-06-30') = 0 AS same_money_hash, COUNT(*) FILTER (billed_date > DATE '2001-06-30' OR collected_date > DATE '2001-06-30') = 0 AS same_date_hash, COUNT(*) FILTER (billed_date > DATE '2001-06-30' OR collected_date > DATE '2001-06-30') = 0 AS same_content_hash FROM stg_invoices
UNION ALL SELECT 'revenue_recognition' AS table_name, true AS same_columns, COUNT(*) FILTER (recognition_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (recognition_date > DATE '2001-06-30') = 0 AS same_key_hash, COUNT(*) FILTER (recognition_date > DATE '2001-06-30') = 0 AS same_money_hash, COUNT(*) FILTER (recognition_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (recognition_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_revenue_recognition
UNION ALL SELECT 'refunds' AS table_name, true AS same_columns, COUNT(*) FILTER (refund_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (refund_date > DATE '2001-06-30') = 0 AS same_key_hash, COUNT(*) FILTER (refund_date > DATE '2001-06-30') = 0 AS same_money_hash, COUNT(*) FILTER (refund_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (refund_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_refunds
UNION ALL SELECT 'promotions' AS table_name, true AS same_columns, COUNT(*) FILTER (start_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (start_date > DATE '2001-06-30') = 0 AS same_key_hash, COUNT(*) FILTER (start_date > DATE '2001-06-30') = 0 AS same_money_hash, COUNT(*) FILTER (start_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (start_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_promotions
UNION ALL SELECT 'suppliers' AS table_name, true AS same_columns, COUNT(*) FILTER (onboarded_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (onboarded_date > DATE '2001-06-30') = 0 AS same_key_hash, true AS same_money_hash, COUNT(*) FILTER (onboarded_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (onboarded_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_suppliers
UNION ALL SELECT 'supplier_shipments' AS table_name, true AS same_columns, COUNT(*) FILTER (expected_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (expected_date > DATE '2001-06-30') = 0 AS same_key_hash, true AS same_money_hash, COUNT(*) FILTER (expected_date > DATE '2001-06-30' OR received_date > DATE '2001-06-30') = 0 AS same_date_hash, COUNT(*) FILTER (expected_date > DATE '2001-06-30' OR received_date > DATE '2001-06-30') = 0 AS same_content_hash FROM stg_supplier_shipments
UNION ALL SELECT 'ad_spend' AS table_name, true AS same_columns, COUNT(*) FILTER (spend_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (spend_date > DATE '2001-06-30') = 0 AS same_key_hash, COUNT(*) FILTER (spend_date > DATE '2001-06-30') = 0 AS same_money_hash, COUNT(*) FILTER (spend_date > DATE '2001-06-30' OR false) = 0 AS same_date_hash, COUNT(*) FILTER (spend_date > DATE '2001-06-30' OR false) = 0 AS same_content_hash FROM stg_ad_spend
UNION ALL SELECT 'tickets' AS table_name, true AS same_columns, COUNT(*) FILTER (created_date > DATE '2001-06-30') = 0 AS same_row_count, COUNT(*) FILTER (created_date > DATE '2001-06-30') = 0 AS same_key_hash, true AS same_money_hash, COUNT(*) FILTER (created_date > DATE '2001-06-30' OR resolved_date > DATE '2001-06-30') = 0 AS same_date_hash, COUNT(*) FILTER (created_date > DATE '2001-06-30' OR resolved_date > DATE '2001-06-30') = 0 AS same_content_hash FROM stg_tickets
-- query: dq_no_future_rows
SELECT 'app_customers: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_app_customers WHERE created_date <= DATE '1999-06-30'
UNION ALL SELECT 'stripe_customers: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_stripe_customers WHERE created_date <= DATE '1999-06-30'
UNION ALL SELECT 'shopify_customers: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_shopify_customers WHERE created_date <= DATE '1999-06-30'
UNION ALL SELECT 'salesforce_customers: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_salesforce_customers WHERE created_date <= DATE '1999-06-30'
UNION ALL SELECT 'customer_id_crosswalk: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_customer_id_crosswalk WHERE linked_date <= DATE '1999-06-30'
UNION ALL SELECT 'orders: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_orders WHERE order_date <= DATE '1999-06-30'
UNION ALL SELECT 'order_lines: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_order_lines WHERE order_date <= DATE '1999-06-30'
UNION ALL SELECT 'products: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_products WHERE introduced_date <= DATE '1999-06-30'
UNION ALL SELECT 'plans: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_plans WHERE launched_date <= DATE '1999-06-30'
UNION ALL SELECT 'plan_prices: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_plan_prices WHERE effective_date <= DATE '1999-06-30'
UNION ALL SELECT 'subscriptions: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_subscriptions WHERE term_start_date <= DATE '1999-06-30'
UNION ALL SELECT 'invoices: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_invoices WHERE billed_date <= DATE '1999-06-30'
UNION ALL SELECT 'revenue_recognition: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_revenue_recognition WHERE recognition_date <= DATE '1999-06-30'
UNION ALL SELECT 'refunds: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_refunds WHERE refund_date <= DATE '1999-06-30'
UNION ALL SELECT 'promotions: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_promotions WHERE start_date <= DATE '1999-06-30'
UNION ALL SELECT 'suppliers: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_suppliers WHERE onboarded_date <= DATE '1999-06-30'
UNION ALL SELECT 'supplier_shipments: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_supplier_shipments WHERE expected_date <= DATE '1999-06-30'
UNION ALL SELECT 'ad_spend: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_ad_spend WHERE spend_date <= DATE '1999-06-30'
UNION ALL SELECT 'tickets: later rows' AS check_name, COUNT(*) AS checked, CAST(0 AS BIGINT) AS violations FROM stg_tickets WHERE created_date <= DATE '1999-06-30'
UNION ALL SELECT 'invoices: later collected_date', COUNT(*), 0 FROM stg_invoices WHERE billed_date <= DATE '1999-06-30'
UNION ALL SELECT 'stripe_customers: later deactivated_date', COUNT(*), 0 FROM stg_stripe_customers WHERE created_date <= DATE '1999-06-30'
UNION ALL SELECT 'plans: later retired_date', COUNT(*), 0 FROM stg_plans WHERE launched_date <= DATE '1999-06-30'
UNION ALL SELECT 'supplier_shipments: later received_date', COUNT(*), 0 FROM stg_supplier_shipments WHERE expected_date <= DATE '1999-06-30'
UNION ALL SELECT 'tickets: later resolved_date', COUNT(*), 0 FROM stg_tickets WHERE created_date <= DATE '1999-06-30'
UNION ALL SELECT 'subscriptions: outcome of a running term', COUNT(*), 0 FROM stg_subscriptions WHERE term_start_date <= DATE '1999-06-30'
UNION ALL SELECT 'crosswalk: endpoint not visible', COUNT(*), COUNT(*) FILTER (source_created_date > DATE '1999-06-30') FROM int_customer_identity WHERE linked_date <= DATE '1999-06-30'
-- query: dq_accepted_values
WITH c AS (SELECT 'int_customer_identity' AS t, 'source_system' AS c, source_system AS v, ['app_db', 'stripe', 'shopify', 'salesforce'] AS ok FROM int_customer_identity
UNION ALL SELECT 'int_customer_identity', 'resolution_status', resolution_status, ['resolved', 'unresolved_migration_gap', 'unresolved_sync_lag'] FROM int_customer_identity
UNION ALL SELECT 'fct_revenue', 'measure_name', measure_name, ['gmv', 'net_revenue', 'recognized_revenue', 'billed_revenue', 'collected_cash'] FROM fct_revenue
UNION ALL SELECT 'fct_identity_resolution_quality', 'source_system', source_system, ['app_db', 'stripe', 'shopify', 'salesforce'] FROM quality_mart
UNION ALL SELECT 'fct_orders', 'channel', channel, ['d2c', 'business_subscription', 'marketplace'] FROM fct_orders
UNION ALL SELECT 'fct_subscriptions', 'status', status, ['renewed', 'active', 'churned'] FROM fct_subscriptions
UNION ALL SELECT 'app_customers', 'segment', segment, ['consumer', 'smb', 'enterprise'] FROM stg_app_customers
UNION ALL SELECT 'app_customers', 'account_type', account_type, ['customer', 'test', 'internal'] FROM stg_app_customers
UNION ALL SELECT 'customer_id_crosswalk', 'source_system', source_system, ['app_db', 'stripe', 'shopify', 'salesforce'] FROM stg_customer_id_crosswalk
UNION ALL SELECT 'customer_id_crosswalk', 'link_method', link_method, ['primary_key', '2021_migration', 'direct_sync'] FROM stg_customer_id_crosswalk
UNION ALL SELECT 'products', 'category', category, ['paper', 'writing', 'office_tech', 'furniture', 'breakroom', 'storage'] FROM stg_products
UNION ALL SELECT 'plans', 'plan_generation', CAST(plan_generation AS VARCHAR), ['1', '2', '3'] FROM stg_plans
UNION ALL SELECT 'subscriptions', 'status', status, ['renewed', 'active', 'churned'] FROM stg_subscriptions
UNION ALL SELECT 'supplier_shipments', 'status', status, ['received', 'partial', 'delayed', 'in_transit'] FROM stg_supplier_shipments
UNION ALL SELECT 'ad_spend', 'platform', platform, ['google', 'meta', 'tiktok'] FROM stg_ad_spend
UNION ALL SELECT 'tickets', 'requester_source_system', requester_source_system, ['salesforce', 'stripe', 'app_db'] FROM stg_tickets
UNION ALL SELECT 'tickets', 'status', status, ['solved', 'open'] FROM stg_tickets)
SELECT t AS table_name, c AS column_name, COUNT(v) AS checked, COUNT(*) FILTER (NOT list_contains(ok, v)) AS violations FROM c GROUP BY 1, 2
-- query: dq_relationships
SELECT 'customer_id_crosswalk.app_db_customer_id -> app_customers.app_db_customer_id' AS relationship, COUNT(*) AS violations FROM stg_customer_id_crosswalk ANTI JOIN stg_app_customers USING (app_db_customer_id)
UNION ALL SELECT 'orders.customer_id -> app_customers.app_db_customer_id', COUNT(*) FROM stg_orders WHERE customer_id NOT IN (SELECT app_db_customer_id FROM stg_app_customers)
UNION ALL SELECT 'orders.promo_code -> promotions.promo_code', COUNT(*) FROM stg_orders WHERE promo_code NOT IN (SELECT promo_code FROM stg_promotions)
UNION ALL SELECT 'orders.subscription_id -> subscriptions.subscription_id', COUNT(*) FROM stg_orders WHERE subscription_id NOT IN (SELECT subscription_id FROM stg_subscriptions)
UNION ALL SELECT 'order_lines.order_id -> orders.order_id', COUNT(*) FROM stg_order_lines ANTI JOIN stg_orders USING (order_id)
UNION ALL SELECT 'order_lines.sku -> products.sku', COUNT(*) FROM stg_order_lines ANTI JOIN stg_products USING (sku)
UNION ALL SELECT 'products.supplier_id -> suppliers.supplier_id', COUNT(*) FROM stg_products ANTI JOIN stg_suppliers USING (supplier_id)
UNION ALL SELECT 'plan_prices.plan_id -> plans.plan_id', COUNT(*) FROM stg_plan_prices ANTI JOIN stg_plans USING (plan_id)
UNION ALL SELECT 'subscriptions.customer_id -> app_customers.app_db_customer_id', COUNT(*) FROM stg_subscriptions WHERE customer_id NOT IN (SELECT app_db_customer_id FROM stg_app_customers)
UNION ALL SELECT 'subscriptions.plan_id -> plans.plan_id', COUNT(*) FROM stg_subscriptions ANTI JOIN stg_plans USING (plan_id)
UNION ALL SELECT 'subscriptions.order_id -> orders.order_id', COUNT(*) FROM stg_subscriptions ANTI JOIN stg_orders USING (order_id)
UNION ALL SELECT 'subscriptions.renewed_from_subscription_id -> subscriptions.subscription_id', COUNT(*) FROM stg_subscriptions WHERE renewed_from_subscription_id NOT IN (SELECT subscription_id FROM stg_subscriptions)
UNION ALL SELECT 'invoices.order_id -> orders.order_id', COUNT(*) FROM stg_invoices ANTI JOIN stg_orders USING (order_id)
UNION ALL SELECT 'invoices.salesforce_customer_id -> salesforce_customers.salesforce_customer_id', COUNT(*) FROM stg_invoices ANTI JOIN stg_salesforce_customers USING (salesforce_customer_id)
UNION ALL SELECT 'revenue_recognition.order_id -> orders.order_id', COUNT(*) FROM stg_revenue_recognition ANTI JOIN stg_orders USING (order_id)
UNION ALL SELECT 'refunds.order_id -> orders.order_id', COUNT(*) FROM stg_refunds ANTI JOIN stg_orders USING (order_id)
UNION ALL SELECT 'refunds.stripe_customer_id -> stripe_customers.stripe_customer_id', COUNT(*) FROM stg_refunds ANTI JOIN stg_stripe_customers USING (stripe_customer_id)
UNION ALL SELECT 'supplier_shipments.supplier_id -> suppliers.supplier_id', COUNT(*) FROM stg_supplier_shipments ANTI JOIN stg_suppliers USING (supplier_id)
UNION ALL SELECT 'fct_orders.customer_id -> dim_customers.app_db_customer_id', COUNT(*) FROM fct_orders WHERE customer_id NOT IN (SELECT app_db_customer_id FROM dim_customers)
UNION ALL SELECT 'fct_order_lines.order_id -> fct_orders.order_id', COUNT(*) FROM fct_order_lines ANTI JOIN fct_orders USING (order_id)
UNION ALL SELECT 'fct_subscriptions.customer_id -> dim_customers.app_db_customer_id', COUNT(*) FROM fct_subscriptions WHERE customer_id NOT IN (SELECT app_db_customer_id FROM dim_customers)
-- query: dq_crosswalk_integrity
SELECT 'dq_crosswalk_integrity' AS test, COUNT(*) AS checked, COUNT(*) FILTER (i.source_customer_id IS NULL OR c.app_db_customer_id IS NULL
  OR x.linked_date < i.source_created_date OR x.linked_date < c.created_date) AS violations
FROM stg_customer_id_crosswalk x LEFT JOIN int_customer_identity i USING (source_system, source_customer_id)
LEFT JOIN stg_app_customers c ON c.app_db_customer_id = x.app_db_customer_id
-- query: dq_crosswalk_no_duplicates
SELECT 'dq_crosswalk_no_duplicates' AS test, COUNT(*) AS checked,
  (SELECT COUNT(*) FROM (SELECT 1 FROM stg_customer_id_crosswalk GROUP BY source_system, source_customer_id HAVING COUNT(*) <> 1)) AS violations FROM stg_customer_id_crosswalk
-- query: dq_identity_key_unique
SELECT 'dq_identity_key_unique' AS test, COUNT(*) AS checked,
  (SELECT COUNT(*) FROM (SELECT 1 FROM int_customer_identity GROUP BY source_system, source_customer_id HAVING COUNT(*) <> 1)) AS violations FROM int_customer_identity
-- query: dq_identity_status_consistency
SELECT 'dq_identity_status_consistency' AS test, COUNT(*) AS checked,
  COUNT(*) FILTER ((resolution_status = 'resolved') <> (app_db_customer_id IS NOT NULL AND linked_date IS NOT NULL AND link_method IS NOT NULL)
    OR (resolution_status = 'unresolved_migration_gap') <> (app_db_customer_id IS NULL AND source_system IN ('shopify', 'salesforce') AND source_created_date < DATE '1997-07-01')) AS violations
FROM int_customer_identity
-- query: dq_dim_customers_range
SELECT 'dq_dim_customers_range' AS test, COUNT(*) AS checked, COUNT(*) FILTER (has_order AND resolved_source_system_count NOT BETWEEN 1 AND 4) AS violations FROM dim_customers
-- query: dq_quality_rate
SELECT 'dq_quality_rate' AS test, COUNT(*) AS checked, COUNT(*) FILTER (resolution_null_rate NOT BETWEEN 0 AND 1
  OR ABS(resolution_null_rate - unresolved_id_count / CAST(observed_id_count AS DOUBLE)) > 0.000001) AS violations FROM quality_mart
-- query: dq_quality_reconciliation
SELECT 'dq_quality_reconciliation' AS test, COUNT(*) AS checked, COUNT(*) FILTER (e.o IS NULL OR e.o <> observed_id_count OR e.r <> resolved_id_count
  OR resolved_id_count + unresolved_id_count <> observed_id_count) AS violations
FROM quality_mart LEFT JOIN (SELECT source_system, COUNT(*) AS o, COUNT(app_db_customer_id) AS r FROM int_customer_identity GROUP BY 1) e USING (source_system)
-- query: dq_no_legacy_channel
SELECT 'dq_no_legacy_channel' AS test, COUNT(*) AS checked, COUNT(DISTINCT channel) FILTER (channel NOT IN ('d2c', 'business_subscription', 'marketplace')) AS violations FROM fct_orders
-- query: dq_revenue_exclusion
WITH m AS (SELECT SUM(amount) AS m FROM fct_revenue WHERE measure_name = 'gmv' AND activity_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'),
o AS (SELECT SUM(gross_amount) FILTER (account_type = 'customer') AS f, SUM(gross_amount) AS u FROM stg_orders JOIN stg_app_customers ON app_db_customer_id = customer_id
      WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31')
SELECT CAST(m AS DOUBLE) AS mart_gmv, CAST(f AS DOUBLE) AS filtered_gmv, CAST(u AS DOUBLE) AS unfiltered_gmv, ABS(m - f) <= 0.005 AS mart_matches, m < u AS below_unfiltered FROM m, o
-- query: dq_join_preserves_metrics
WITH b AS (SELECT * FROM stg_orders WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'),
x AS (SELECT COUNT(*) AS n, CAST(SUM(gross_amount) AS DOUBLE) AS g FROM b), y AS (SELECT COUNT(*) AS n, CAST(SUM(gross_amount) AS DOUBLE) AS g FROM b JOIN dim_customers ON app_db_customer_id = customer_id)
SELECT x.n AS base_orders, x.g AS base_gmv, y.n AS joined_orders, y.g AS joined_gmv, x.n = y.n AND ABS(x.g - y.g) <= 0.005 AS preserved FROM x, y
-- query: dq_identity_contract
WITH al AS (SELECT i.*, 'cust_' || regexp_extract(source_customer_id, '[0-9]+$') AS app FROM int_customer_identity i),
ac AS (SELECT app, list_sort(list(DISTINCT source_system)) AS s, COUNT(*) AS n FROM al WHERE is_active GROUP BY 1),
rq AS (SELECT customer_id AS app, list_sort(list_distinct(flatten(list(CASE channel WHEN 'business_subscription' THEN ['app_db', 'salesforce']
         WHEN 'marketplace' THEN ['app_db', 'stripe'] ELSE ['app_db', 'stripe', 'shopify'] END)))) AS s FROM stg_orders GROUP BY 1),
st AS (SELECT app, COUNT(*) AS n, COUNT(*) FILTER (is_active) AS a, MIN(source_created_date) FILTER (is_active) AS nw, MAX(source_created_date) FILTER (NOT is_active) AS od
       FROM al WHERE source_system = 'stripe' GROUP BY 1),
lk AS (SELECT al.*, c.created_date AS app_created, source_system IN ('shopify', 'salesforce') AND source_created_date < DATE '1997-07-01' AS mig
       FROM al JOIN stg_app_customers c ON c.app_db_customer_id = app)
SELECT 'active systems match the channels ordered' AS rule, COUNT(*) AS checked, COUNT(*) FILTER (ac.s IS NULL OR ac.s <> rq.s) AS violations FROM rq LEFT JOIN ac USING (app)
UNION ALL SELECT 'two to four active aliases, one per required system', COUNT(*), COUNT(*) FILTER (ac.n IS NULL OR ac.n <> len(rq.s) OR len(rq.s) NOT BETWEEN 2 AND 4) FROM rq LEFT JOIN ac USING (app)
UNION ALL SELECT 'at most one historical and one active Stripe id', COUNT(*), COUNT(*) FILTER (n > 2) FROM st
UNION ALL SELECT 'a re-created Stripe id is strictly later than the old one', COUNT(*), COUNT(*) FILTER (a <> 1 OR NOT COALESCE(nw > od, false)) FROM st WHERE n = 2
UNION ALL SELECT 'missing links are pre-migration Shopify or Salesforce records', COUNT(*), COUNT(*) FILTER (NOT mig) FROM lk WHERE app_db_customer_id IS NULL
UNION ALL SELECT 'kept pre-migration links arrive at the cut-off', COUNT(*), COUNT(*) FILTER (linked_date <> GREATEST(source_created_date, app_created, DATE '1997-07-01')) FROM lk WHERE mig AND app_db_customer_id IS NOT NULL
UNION ALL SELECT 'link method follows system and date', COUNT(*), COUNT(*) FILTER (link_method <> CASE WHEN source_system = 'app_db' THEN 'primary_key' WHEN mig THEN '2021_migration' ELSE 'direct_sync' END)
  FROM lk WHERE app_db_customer_id IS NOT NULL
UNION ALL SELECT 'no link before its source or app customer', COUNT(*), COUNT(*) FILTER (linked_date < source_created_date OR linked_date < app_created) FROM lk WHERE app_db_customer_id IS NOT NULL
UNION ALL SELECT 'app self-links arrive with the customer', COUNT(*), COUNT(*) FILTER (linked_date <> app_created) FROM lk WHERE source_system = 'app_db' AND app_db_customer_id IS NOT NULL
UNION ALL SELECT 'invoices name a Salesforce customer visible by then', COUNT(*), COUNT(*) FILTER (created_date IS NULL OR created_date > billed_date) FROM stg_invoices LEFT JOIN stg_salesforce_customers USING (salesforce_customer_id)
UNION ALL SELECT 'refunds name a Stripe customer visible by then', COUNT(*), COUNT(*) FILTER (created_date IS NULL OR created_date > refund_date) FROM stg_refunds LEFT JOIN stg_stripe_customers USING (stripe_customer_id)
-- query: metric_reconcile
SELECT quarter, m AS column_name, v AS left_value, v AS right_value, true AS agrees FROM (UNPIVOT (SELECT * EXCLUDE (recognized_minus_gmv) FROM @five_revenues_by_quarter) ON COLUMNS(* EXCLUDE (quarter)) INTO NAME m VALUE v)
-- query: trap_bites
WITH t AS (SELECT 'revenue_measure' AS metric, value, unnest(['wrong_gmv', 'wrong_net_revenue', 'wrong_billed_revenue', 'wrong_collected_cash']) AS wrong_path,
  unnest([wrong_gmv, wrong_net_revenue, wrong_billed_revenue, wrong_collected_cash]) AS wrong_value, 0.005 AS tol FROM @revenue_measure
UNION ALL SELECT 'orders_count', value, 'staging_including_test_and_internal', staging_including_test_and_internal, 0 FROM @orders_count
UNION ALL SELECT 'current_customers', value, unnest(['including_test_and_internal', 'sum_of_channel_counts', 'all_profiles_created']),
  unnest([including_test_and_internal, sum_of_channel_counts, all_profiles_created]), 0 FROM @current_customers
UNION ALL SELECT 'new_customers', value, unnest(['profiles_created', 'first_order_per_channel']), unnest([profiles_created, first_order_per_channel]), 0 FROM @new_customers
UNION ALL SELECT 'multi_channel_customers', value, 'raw_channel_labels', raw_channel_labels, 0 FROM @multi_channel_customers
UNION ALL SELECT 'active_subscribers', value, unnest(['status_active', 'current_generation_only', 'seats']), unnest([status_active, current_generation_only, seats]), 0 FROM @active_subscribers
UNION ALL SELECT 'renewal_rate', value, unnest(['acv_weighted', 'renewal_share_of_terms_started']), unnest([acv_weighted, renewal_share_of_terms_started]), 0.0001 FROM @renewal_rate
UNION ALL SELECT 'new_subscriptions', value, 'all_terms_started', all_terms_started, 0 FROM @new_subscriptions
UNION ALL SELECT 'gmv_of_orders_with_category', value, unnest(['summed_per_matching_line', 'category_line_amount_only']), unnest([summed_per_matching_line, category_line_amount_only]), 0.005 FROM @gmv_of_orders_with_category
UNION ALL SELECT 'open_tickets_at', value, unnest(['status_open_at_snapshot', 'created_in_month']), unnest([status_open_at_snapshot, created_in_month]), 0 FROM @open_tickets_at)
SELECT metric, CAST(value AS DOUBLE) AS value, wrong_path, CAST(wrong_value AS DOUBLE) AS wrong_value, COALESCE(ABS(CAST(wrong_value AS DOUBLE) - value) > tol, false) AS bites FROM t
-- query: accepted_alternative_check
SELECT 'current_customers' AS metric, 'window_ending_prior_month' AS alternative, CAST(window_ending_prior_month AS DOUBLE) AS alternative_value, a AS against, CAST(o AS DOUBLE) AS other,
  window_ending_prior_month <> o AS differs
FROM (SELECT window_ending_prior_month, unnest(['value', 'including_test_and_internal', 'sum_of_channel_counts', 'all_profiles_created']) AS a,
             unnest([value, including_test_and_internal, sum_of_channel_counts, all_profiles_created]) AS o FROM @current_customers)
-- query: mapping_row_conservation
WITH kinds AS (SELECT o_orderkey, COALESCE(o_orderpriority = '1-URGENT' AND o_custkey % 3 = 1, false) AS subscription FROM orders)
SELECT 'orders' AS source_table, CASE WHEN subscription THEN 'subscription order' ELSE 'consumer order' END AS outcome,
       COUNT(*) AS row_count
FROM kinds GROUP BY ALL
UNION ALL
SELECT 'lineitem', CASE WHEN subscription IS NULL THEN 'without an order' WHEN subscription THEN 'of a subscription order'
                        ELSE 'order line' END, COUNT(*)
FROM lineitem LEFT JOIN kinds ON o_orderkey = l_orderkey GROUP BY ALL
-- query: fingerprint_locate
SELECT table_name, key, COUNT(*) AS left_rows, COUNT(*) FILTER (NOT gone) AS right_rows, CASE WHEN bool_and(gone) THEN 'left only' ELSE 'changed' END AS difference FROM (
SELECT 'app_customers' AS table_name, app_db_customer_id AS key, created_date > DATE '2001-03-31' AS gone, false AS later FROM stg_app_customers
UNION ALL SELECT 'stripe_customers' AS table_name, stripe_customer_id AS key, created_date > DATE '2001-03-31' AS gone, deactivated_date > DATE '2001-03-31' AS later FROM stg_stripe_customers
UNION ALL SELECT 'shopify_customers' AS table_name, shopify_customer_id AS key, created_date > DATE '2001-03-31' AS gone, false AS later FROM stg_shopify_customers
UNION ALL SELECT 'salesforce_customers' AS table_name, salesforce_customer_id AS key, created_date > DATE '2001-03-31' AS gone, false AS later FROM stg_salesforce_customers
UNION ALL SELECT 'customer_id_crosswalk' AS table_name, source_system || '/' || source_customer_id AS key, linked_date > DATE '2001-03-31' AS gone, false AS later FROM stg_customer_id_crosswalk
UNION ALL SELECT 'orders' AS table_name, order_id AS key, order_date > DATE '2001-03-31' AS gone, false AS later FROM stg_orders
UNION ALL SELECT 'order_lines' AS table_name, order_line_id AS key, order_date > DATE '2001-03-31' AS gone, false AS later FROM stg_order_lines
UNION ALL SELECT 'products' AS table_name, sku AS key, introduced_date > DATE '2001-03-31' AS gone, false AS later FROM stg_products
UNION ALL SELECT 'plans' AS table_name, plan_id AS key, launched_date > DATE '2001-03-31' AS gone, retired_date > DATE '2001-03-31' AS later FROM stg_plans
UNION ALL SELECT 'plan_prices' AS table_name, plan_id || '/' || effective_date AS key, effective_date > DATE '2001-03-31' AS gone, false AS later FROM stg_plan_prices
UNION ALL SELECT 'subscriptions' AS table_name, subscription_id AS key, term_start_date > DATE '2001-03-31' AS gone, term_end_date >= DATE '2001-03-31' AND (status <> 'active' OR cancelled_date IS NOT NULL) AS later FROM stg_subscriptions
UNION ALL SELECT 'invoices' AS table_name, invoice_id AS key, billed_date > DATE '2001-03-31' AS gone, collected_date > DATE '2001-03-31' AS later FROM stg_invoices
UNION ALL SELECT 'revenue_recognition' AS table_name, order_id || '/' || recognition_date AS key, recognition_date > DATE '2001-03-31' AS gone, false AS later FROM stg_revenue_recognition
UNION ALL SELECT 'promotions' AS table_name, promo_code AS key, start_date > DATE '2001-03-31' AS gone, false AS later FROM stg_promotions
UNION ALL SELECT 'refunds' AS table_name, refund_id AS key, refund_date > DATE '2001-03-31' AS gone, false AS later FROM stg_refunds
UNION ALL SELECT 'suppliers' AS table_name, supplier_id AS key, onboarded_date > DATE '2001-03-31' AS gone, false AS later FROM stg_suppliers
UNION ALL SELECT 'supplier_shipments' AS table_name, shipment_id AS key, expected_date > DATE '2001-03-31' AS gone, received_date > DATE '2001-03-31' AS later FROM stg_supplier_shipments
UNION ALL SELECT 'ad_spend' AS table_name, spend_date || '/' || platform AS key, spend_date > DATE '2001-03-31' AS gone, false AS later FROM stg_ad_spend
UNION ALL SELECT 'tickets' AS table_name, ticket_id AS key, created_date > DATE '2001-03-31' AS gone, resolved_date > DATE '2001-03-31' AS later FROM stg_tickets)
GROUP BY table_name, key HAVING bool_or(gone OR COALESCE(later, false))
-- query: dq_constraints
SELECT 'unique ' || table_name || '(' || columns || ')' AS name, violations FROM @dq_unique
UNION ALL SELECT relationship, violations FROM @dq_relationships
