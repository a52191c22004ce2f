-- Churn features in SQL. Bind :cutoff, :status and :min_orders; the tables are
-- given as orders, customers, order_items and order_payments. Days before the
-- cutoff bring features and later ones the label, in one pass over the orders.
WITH fulfilled AS (
  SELECT order_id, customer_id, CAST(order_purchase_timestamp AS DATE) AS day
  FROM {orders}
  WHERE order_status = :status
),
-- Equal payments of an order collapse; n counts the values that are left.
paid AS (
  SELECT order_id, sum(payment_value) AS spend, count(*) AS n
  FROM (SELECT DISTINCT order_id, payment_value FROM {order_payments})
  GROUP BY order_id
),
-- Before the cutoff an order counts if it has an item and a payment, later in any
-- case. Totals per login and day come before the customers are joined: a busy
-- customer brings as many rows as there are days, not as there are orders.
login_days AS (
  SELECT f.customer_id, f.day, count(*) AS n_orders, sum(p.n) AS n_rows, sum(p.spend) AS spend
  FROM fulfilled f
  LEFT JOIN (SELECT DISTINCT order_id FROM {order_items}) i ON i.order_id = f.order_id
  LEFT JOIN paid p ON p.order_id = f.order_id
  WHERE f.day >= CAST(:cutoff AS DATE)
    OR (f.day < CAST(:cutoff AS DATE) AND i.order_id IS NOT NULL AND p.order_id IS NOT NULL)
  GROUP BY f.customer_id, f.day
),
-- One row per person and day bounds the window; rows of a day are 0 days apart.
shopping_days AS (
  SELECT
    c.customer_unique_id AS person, l.day, l.day < CAST(:cutoff AS DATE) AS early,
    sum(l.n_orders) AS n_orders, sum(l.n_rows) AS n_rows, sum(l.spend) AS spend
  FROM login_days l
  JOIN {customers} c ON c.customer_id = l.customer_id
  GROUP BY c.customer_unique_id, l.day
),
-- Days after the cutoff come last, so they change no gap before it.
spaced AS (
  SELECT *, datediff(day, lag(day) OVER (PARTITION BY person ORDER BY day)) AS gap
  FROM shopping_days
),
habits AS (
  SELECT
    person,
    CAST(datediff(CAST(:cutoff AS DATE), max(day) FILTER (WHERE early)) AS BIGINT) AS recency_days,
    CAST(sum(n_orders) FILTER (WHERE early) AS BIGINT) AS frequency,
    CAST(round(sum(spend) FILTER (WHERE early), 2) AS DOUBLE) AS monetary,
    CAST(datediff(max(day) FILTER (WHERE early), min(day) FILTER (WHERE early)) AS BIGINT) AS customer_lifetime_days,
    round(
      try_divide(CAST(sum(gap) FILTER (WHERE early) AS DOUBLE), sum(n_rows) FILTER (WHERE early) - 1), 1
    ) AS mean_gap,
    -- NULL is a group, but as a key it matches nobody in the label window.
    person IS NOT NULL AND bool_or(NOT early) AS returned
  FROM spaced
  GROUP BY person
  HAVING sum(n_orders) FILTER (WHERE early) >= :min_orders
)
SELECT
  person AS customer_unique_id,
  recency_days,
  frequency,
  monetary,
  customer_lifetime_days,
  coalesce(mean_gap, 0.0D) AS avg_days_between_orders,
  if(returned, 0, 1) AS churn_label
FROM habits
ORDER BY recency_days, customer_unique_id
