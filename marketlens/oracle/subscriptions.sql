-- query: active_subscribers
SELECT COUNT(DISTINCT customer_id) FILTER (a) AS value, COUNT(DISTINCT customer_id) FILTER (status = 'active') AS status_active,
       COUNT(DISTINCT customer_id) FILTER (a AND is_current) AS current_generation_only,
       CAST(COALESCE(SUM(seats) FILTER (a), 0) AS BIGINT) AS seats
FROM (SELECT s.*, p.is_current, DATE '2000-12-31' BETWEEN term_start_date AND term_end_date AS a FROM fct_subscriptions s JOIN stg_plans p USING (plan_id))
-- query: active_subscribers_by_generation
WITH a AS (SELECT * FROM fct_subscriptions WHERE DATE '2000-12-31' BETWEEN term_start_date AND term_end_date)
SELECT plan_generation, COUNT(DISTINCT customer_id) AS active_subscribers, CAST(SUM(acv) AS DOUBLE) AS acv_under_contract,
       (SELECT COUNT(DISTINCT customer_id) FROM a JOIN stg_plans USING (plan_id) WHERE is_current) AS current_generation_only_total
FROM a GROUP BY 1
-- query: active_by_quarter_end_generation
WITH q AS (SELECT last_day(CAST(d AS DATE)) AS e FROM range(DATE '1997-03-01', DATE '2001-01-01', INTERVAL 3 MONTH) r(d))
SELECT e AS snapshot_date, plan_generation, COUNT(DISTINCT customer_id) AS active_subscribers, CAST(SUM(acv) AS DOUBLE) AS acv_under_contract
FROM q JOIN fct_subscriptions ON e BETWEEN term_start_date AND term_end_date GROUP BY 1, 2
-- query: subscriptions_by_plan
SELECT plan_generation, plan_id, COUNT(DISTINCT customer_id) AS active_subscribers, CAST(SUM(seats) AS BIGINT) AS seats, CAST(SUM(acv) AS DOUBLE) AS acv
FROM fct_subscriptions WHERE DATE '2000-12-31' BETWEEN term_start_date AND term_end_date GROUP BY 1, 2
-- query: avg_price_per_seat_active
SELECT ROUND(CAST(SUM(acv) AS DOUBLE) / CAST(SUM(seats) AS DOUBLE), 2) AS value, CAST(228.48 AS DOUBLE) AS current_catalog_price
FROM fct_subscriptions WHERE plan_id = 'growth' AND DATE '2000-12-31' BETWEEN term_start_date AND term_end_date
-- query: renewal_rate
WITH s AS (SELECT *, year(term_end_date) = 2000 AND status <> 'active' AS e, year(term_start_date) = 2000 AS st FROM fct_subscriptions)
SELECT ROUND(CAST(COUNT(*) FILTER (e AND status = 'renewed') AS DOUBLE) / NULLIF(COUNT(*) FILTER (e), 0), 4) AS value,
       COUNT(*) FILTER (e) AS terms_decided, COUNT(*) FILTER (e AND status = 'churned') AS churned_terms,
       ROUND(CAST(SUM(acv) FILTER (e AND status = 'renewed') AS DOUBLE) / CAST(SUM(acv) FILTER (e) AS DOUBLE), 4) AS acv_weighted,
       ROUND(CAST(COUNT(*) FILTER (st AND NOT is_first_term) AS DOUBLE) / NULLIF(COUNT(*) FILTER (st), 0), 4) AS renewal_share_of_terms_started FROM s
-- query: new_subscriptions
SELECT COUNT(*) FILTER (is_first_term) AS value, CAST(COALESCE(SUM(acv) FILTER (is_first_term), 0) AS DOUBLE) AS new_acv, COUNT(*) AS all_terms_started
FROM fct_subscriptions WHERE year(term_start_date) = 2000
-- query: churn_by_segment_quarter
SELECT CAST(year(term_end_date) AS VARCHAR) || 'Q' || quarter(term_end_date) AS quarter, segment, COUNT(*) AS terms_up_for_renewal,
       COUNT(*) FILTER (status = 'churned') AS churned, CAST(COALESCE(SUM(acv) FILTER (status = 'churned'), 0) AS DOUBLE) AS acv_churned,
       ROUND(CAST(COUNT(*) FILTER (status = 'churned') AS DOUBLE) / COUNT(*), 4) AS churn_rate
FROM fct_subscriptions WHERE status IN ('renewed', 'churned') AND term_end_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' GROUP BY 1, 2
-- query: churned_acv_recovery
WITH e AS (SELECT * FROM fct_subscriptions WHERE segment = 'smb'),
act AS (SELECT d, (SELECT COALESCE(SUM(acv), 0) FROM e WHERE d BETWEEN term_start_date AND term_end_date) AS v
        FROM (VALUES (DATE '1998-12-31'), (DATE '1999-12-31'), (DATE '2000-03-31'), (DATE '2000-06-30'), (DATE '2000-09-30'),
                     (DATE '2000-12-31'), (DATE '2001-03-31'), (DATE '2001-06-30')) x(d)),
d AS (SELECT SUM(acv) AS t, SUM(acv) FILTER (status = 'churned') AS c, COUNT(*) AS n, COUNT(*) FILTER (status = 'churned') AS nc
      FROM e WHERE status <> 'active' AND year(term_end_date) = 1999),
p AS (SELECT CAST(SUM(acv) FILTER (status = 'churned') AS DOUBLE) / CAST(SUM(acv) AS DOUBLE) AS r FROM e WHERE status <> 'active' AND year(term_end_date) = 1998)
SELECT CAST(COALESCE(c, 0) AS DOUBLE) AS value, nc AS churned_terms, n AS terms_decided,
       (SELECT CAST(v AS DOUBLE) FROM act WHERE d = DATE '1998-12-31') AS acv_active_before,
       (SELECT CAST(v AS DOUBLE) FROM act WHERE d = DATE '1999-12-31') AS acv_active_at_end,
       (SELECT MIN(d) FROM act WHERE d >= DATE '1999-12-31' AND v >= (SELECT v FROM act WHERE d = DATE '1998-12-31')) AS recovered_at,
       ROUND(r, 4) AS prior_year_acv_churn_rate,
       (SELECT CAST(COALESCE(SUM(acv), 0) AS DOUBLE) FROM fct_subscriptions WHERE status = 'churned' AND year(term_end_date) = 1999) AS all_segments,
       ROUND(CAST(COALESCE(c, 0) AS DOUBLE) - r * CAST(t AS DOUBLE), 2) AS excess_over_prior_year_rate,
       (SELECT CAST(COALESCE(SUM(acv), 0) AS DOUBLE) FROM e WHERE status = 'churned' AND term_end_date BETWEEN DATE '1998-12-01' AND DATE '1999-12-31') AS window_one_month_early
FROM d, p
-- query: first_renewal_nrr
WITH RECURSIVE v AS (SELECT * FROM fct_subscriptions WHERE term_start_date <= DATE '2001-06-30'),
co AS (SELECT * FROM fct_subscriptions WHERE is_first_term AND year(term_start_date) = 1998),
fr AS (SELECT v.*, co.acv AS a0, co.customer_id AS c0 FROM v JOIN co ON v.renewed_from_subscription_id = co.subscription_id),
ch AS (SELECT subscription_id, acv FROM fr UNION ALL SELECT v.subscription_id, v.acv FROM v JOIN ch ON v.renewed_from_subscription_id = ch.subscription_id),
rc AS (SELECT * FROM stg_subscriptions WHERE renewed_from_subscription_id IS NULL AND year(term_start_date) = 1998),
rf AS (SELECT SUM(s.acv) AS v FROM stg_subscriptions s JOIN rc ON s.renewed_from_subscription_id = rc.subscription_id WHERE s.term_start_date <= DATE '2001-06-30'),
t AS (SELECT CAST(SUM(acv) AS DOUBLE) AS i, COUNT(DISTINCT customer_id) AS n FROM co)
SELECT ROUND((SELECT CAST(SUM(acv) AS DOUBLE) FROM fr) / i, 4) AS value, i AS initial_acv, (SELECT CAST(SUM(acv) AS DOUBLE) FROM fr) AS first_renewal_acv,
       n AS cohort_customers, (SELECT COUNT(DISTINCT c0) FROM fr) AS renewed_customers,
       (SELECT ROUND(CAST(SUM(acv) AS DOUBLE) / CAST(SUM(a0) AS DOUBLE), 4) FROM fr) AS renewers_only_denominator,
       ROUND((SELECT CAST(SUM(acv) AS DOUBLE) FROM ch) / i, 4) AS all_chain_renewals,
       ROUND((SELECT CAST(v AS DOUBLE) FROM rf) / (SELECT CAST(SUM(acv) AS DOUBLE) FROM rc), 4) AS including_test_and_internal FROM t
-- query: first_renewal_violations
SELECT 'term not yet due' AS reason, subscription_id FROM fct_subscriptions
WHERE is_first_term AND year(term_start_date) = 2000 AND term_end_date >= DATE '2001-06-30'
UNION ALL SELECT 'term renewed more than once', renewed_from_subscription_id FROM fct_subscriptions
WHERE term_start_date <= DATE '2001-06-30' AND renewed_from_subscription_id IS NOT NULL GROUP BY 2 HAVING COUNT(*) > 1
-- query: legacy_migration_violations
SELECT 'missing migration mapping' AS reason, plan_id AS item FROM (SELECT DISTINCT plan_id FROM fct_subscriptions
 WHERE DATE '2000-12-31' BETWEEN term_start_date AND term_end_date AND plan_generation < 3 AND plan_id IN ('pro_v1', 'enterprise_v2'))
UNION ALL SELECT 'destination outside the current generation', 'office_v2'
-- query: legacy_subscribers_migration
WITH a AS (SELECT s.*, CASE plan_id WHEN 'starter_v1' THEN 120 WHEN 'team_v2' THEN 120 WHEN 'office_v2' THEN 204 ELSE 252 END AS np
           FROM fct_subscriptions s WHERE DATE '2000-12-31' BETWEEN term_start_date AND term_end_date),
l AS (SELECT COUNT(DISTINCT customer_id) AS c, CAST(COALESCE(SUM(seats), 0) AS BIGINT) AS s, COALESCE(SUM(acv), 0) AS v,
             COALESCE(SUM(seats * np), 0) AS m FROM a WHERE plan_generation < 3)
SELECT c AS value, t AS total_active_subscribers, ROUND(CAST(c AS DOUBLE) / NULLIF(t, 0), 4) AS legacy_subscriber_share, s AS legacy_seats,
       CAST(v AS DOUBLE) AS legacy_acv, CAST(m AS DOUBLE) AS illustrative_migrated_acv, CAST(m - v AS DOUBLE) AS illustrative_annual_uplift,
       ROUND(CAST(m - v AS DOUBLE) / NULLIF(CAST(v AS DOUBLE), 0), 4) AS illustrative_uplift_ratio, s AS count_legacy_seats_as_subscribers
FROM l, (SELECT COUNT(DISTINCT customer_id) AS t FROM a)
-- query: legacy_subscribers_by_generation
SELECT plan_generation, COUNT(DISTINCT customer_id) AS active_subscribers, CAST(SUM(seats) AS BIGINT) AS seats, CAST(SUM(acv) AS DOUBLE) AS acv_under_contract
FROM fct_subscriptions WHERE DATE '2000-12-31' BETWEEN term_start_date AND term_end_date GROUP BY 1
-- query: monthly_subscriptions
WITH s AS (SELECT *, CAST(date_trunc('month', term_start_date) AS DATE) AS sm, CAST(date_trunc('month', term_end_date) AS DATE) AS em FROM fct_subscriptions),
b AS (SELECT month, COUNT(DISTINCT customer_id) AS n, SUM(acv) AS v, COUNT(DISTINCT customer_id) FILTER (plan_generation = 1) AS g1,
             COUNT(DISTINCT customer_id) FILTER (plan_generation = 2) AS g2, COUNT(DISTINCT customer_id) FILTER (plan_generation = 3) AS g3
      FROM month_spine JOIN s ON last_day(month) BETWEEN term_start_date AND term_end_date GROUP BY 1),
st AS (SELECT sm, COUNT(*) FILTER (is_first_term) AS f, COUNT(*) FILTER (NOT is_first_term) AS r,
              CAST(SUM(acv) FILTER (is_first_term) AS DOUBLE) / CAST(SUM(seats) FILTER (is_first_term) AS DOUBLE) AS ps FROM s GROUP BY 1),
en AS (SELECT em, COUNT(*) AS n, COUNT(*) FILTER (status = 'churned') AS c, SUM(acv) FILTER (status = 'churned') AS v,
              AVG(CASE WHEN status = 'churned' THEN 1.0::DOUBLE ELSE 0 END) FILTER (segment = 'smb') AS cs,
              AVG(CASE WHEN status = 'churned' THEN 1.0::DOUBLE ELSE 0 END) FILTER (segment = 'enterprise') AS ce FROM s WHERE status <> 'active' GROUP BY 1)
SELECT m.month, COALESCE(b.n, 0) AS active_subscribers, CAST(COALESCE(b.v, 0) AS DOUBLE) AS acv_under_contract, COALESCE(f, 0) AS new_starts,
       COALESCE(r, 0) AS renewals, COALESCE(en.n, 0) AS terms_ended, COALESCE(c, 0) AS churned_terms, CAST(COALESCE(en.v, 0) AS DOUBLE) AS acv_churned,
       COALESCE(ROUND(ps, 2), 0) AS acv_per_seat_new, COALESCE(g1, 0) AS active_gen1, COALESCE(g2, 0) AS active_gen2, COALESCE(g3, 0) AS active_gen3,
       ROUND(cs, 4) AS churn_rate_smb, ROUND(ce, 4) AS churn_rate_enterprise
FROM month_spine m LEFT JOIN b ON b.month = m.month LEFT JOIN st ON sm = m.month LEFT JOIN en ON em = m.month
-- query: subscription_kpis
WITH a AS (SELECT COUNT(DISTINCT customer_id) AS n, CAST(COALESCE(SUM(acv), 0) AS DOUBLE) AS v, COUNT(DISTINCT customer_id) FILTER (plan_generation <> 3) AS g
           FROM fct_subscriptions WHERE DATE '2001-06-30' BETWEEN term_start_date AND term_end_date),
w AS (SELECT COUNT(*) AS n, CAST(COALESCE(SUM(acv), 0) AS DOUBLE) AS v, CAST(SUM(seats) AS DOUBLE) AS s FROM fct_subscriptions
      WHERE is_first_term AND term_start_date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30'),
e AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (status = 'churned') AS c, CAST(COALESCE(SUM(acv) FILTER (status = 'churned'), 0) AS DOUBLE) AS v
      FROM fct_subscriptions WHERE status <> 'active' AND term_end_date BETWEEN DATE '2000-07-01' AND DATE '2001-06-30')
SELECT a.n AS active_subscribers, a.v AS acv_under_contract, w.n AS new_subscriptions, w.v AS new_acv,
       COALESCE(ROUND(CAST(e.n - e.c AS DOUBLE) / NULLIF(e.n, 0), 4), 0) AS renewal_rate, e.c AS churned_terms, e.v AS acv_churned,
       COALESCE(ROUND(w.v / w.s, 2), 0) AS acv_per_seat_new, COALESCE(ROUND(CAST(a.g AS DOUBLE) / NULLIF(a.n, 0), 4), 0) AS grandfathered_share FROM a, w, e
-- query: term_roots
WITH RECURSIVE chain AS (
  SELECT subscription_id, subscription_id AS root_id FROM fct_subscriptions
  WHERE renewed_from_subscription_id IS NULL OR renewed_from_subscription_id NOT IN (SELECT subscription_id FROM fct_subscriptions)
  UNION ALL
  SELECT t.subscription_id, chain.root_id FROM fct_subscriptions t JOIN chain ON t.renewed_from_subscription_id = chain.subscription_id)
SELECT subscription_id, root_id FROM chain
