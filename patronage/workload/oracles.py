"""What each query must return, as SQL over the star-schema tables.

The statements are the specification written out plainly (fan-out joins with
DISTINCT, a lag window per customer, one global rank); the library computes the
same results in other ways.
"""

from __future__ import annotations

from patronage.schemas import FEATURE_COLUMNS, MODEL_COLUMNS
from patronage.workload.queries import LOOKED_UP, SWEEP_DAYS

LAST_DAY = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderstatus = 'F')"

RETURNED = "item.l_returnflag = 'R'"

RFM_COLUMNS = (
    "customer_unique_id, recency_days, frequency, monetary, "
    "customer_lifetime_days, avg_days_between_orders, churn_label"
)


def steps(
    days: int = 180,
    payment: str = "l_extendedprice",
    per_person: int = 1,
    item_filter: str = "true",
    prefix: str = "",
) -> str:
    """Common table expressions from orders to labelled customers."""
    p = prefix
    return f"""
{p}placed AS (
  SELECT o_orderkey AS order_id, c_custkey // {per_person} AS person,
         CAST(o_orderdate AS DATE) AS day,
         {LAST_DAY} - {days} AS cutoff
  FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderstatus = 'F'
),
{p}paid AS (
  SELECT DISTINCT o.order_id, o.person, o.day, o.cutoff,
         CAST(pay.{payment} AS DECIMAL(12, 2)) AS amount
  FROM {p}placed o
  JOIN lineitem item ON item.l_orderkey = o.order_id AND {item_filter}
  JOIN lineitem pay ON pay.l_orderkey = o.order_id
  WHERE o.day < o.cutoff
),
{p}spaced AS (
  SELECT *, day - lag(day) OVER (PARTITION BY person ORDER BY day) AS gap FROM {p}paid
),
{p}measured AS (
  SELECT
    person AS customer_unique_id,
    CAST(any_value(cutoff) - max(day) AS BIGINT) AS recency_days,
    count(DISTINCT order_id) AS frequency,
    CAST(round(sum(amount), 2) AS DOUBLE) AS monetary,
    CAST(max(day) - min(day) AS BIGINT) AS customer_lifetime_days,
    CAST(((20 * sum(gap) + count(gap)) // (2 * nullif(count(gap), 0))) / 10.0 AS DOUBLE)
      AS avg_days_between_orders
  FROM {p}spaced GROUP BY person
),
{p}active AS (
  SELECT DISTINCT person AS customer_unique_id FROM {p}placed WHERE day >= cutoff
),
{p}everyone AS (
  SELECT m.* REPLACE (coalesce(m.avg_days_between_orders, 0.0) AS avg_days_between_orders),
         CAST(a.customer_unique_id IS NULL AS INTEGER) AS churn_label
  FROM {p}measured m LEFT JOIN {p}active a USING (customer_unique_id)
),
{p}repeaters AS (SELECT * FROM {p}everyone WHERE frequency >= 2)"""


def engineered(source: str) -> str:
    return f"""
engineered AS (
  SELECT *,
    round(ln(1 + monetary), 6) AS monetary_log,
    monetary / frequency AS avg_order_value,
    CASE WHEN frequency > 1 THEN customer_lifetime_days / frequency ELSE 0.0 END AS days_per_order,
    CAST(frequency = 1 AS INTEGER) AS is_one_time_buyer
  FROM {source}
)"""


COLUMNS = ", ".join(FEATURE_COLUMNS)
STORE = f"WITH {steps()}, {engineered('repeaters')}"
EVERYONE = f"WITH {steps()}, {engineered('everyone')}"
BASE = f"WITH {steps()}"
SPLIT = f"""{STORE},
shuffled AS (
  SELECT *,
    row_number() OVER (
      PARTITION BY churn_label
      ORDER BY md5(concat(CAST(customer_unique_id AS VARCHAR), '-42')), customer_unique_id
    ) AS place,
    count(*) OVER (PARTITION BY churn_label) AS n_class
  FROM engineered
),
sided AS (
  SELECT *, CASE WHEN place <= round(0.25 * n_class) THEN 'test' ELSE 'train' END AS side
  FROM shuffled
)"""
RATIO = "count(*) FILTER (churn_label = 0) / count(*) FILTER (churn_label = 1)"


def violations(source: str, rules: dict[str, str]) -> str:
    """(rule, n_violations) with one count per rule."""
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS rule, CAST({count} AS BIGINT) AS n_violations FROM {source}"
        for name, count in rules.items()
    )


def _breaks(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


def _present(*columns: str) -> dict[str, str]:
    return {f"{c} is present": _breaks(f"{c} IS NULL") for c in columns}


def _at_least(bound: int, *columns: str) -> dict[str, str]:
    return {f"{c} >= {bound}": _breaks(f"{c} < {bound}") for c in columns}


RFM_RULES = {
    "customer_unique_id is unique": "count(*) - count(DISTINCT customer_unique_id)",
    **_present("recency_days", "frequency", "monetary", "churn_label"),
    "churn_label in (0, 1)": _breaks("churn_label NOT IN (0, 1)"),
    **_at_least(1, "frequency"),
    **_at_least(0, "monetary", "recency_days"),
}
RAW_RULES = {
    **_present(*(c.strip() for c in RFM_COLUMNS.split(","))),
    **_at_least(0, "recency_days"),
    **_at_least(1, "frequency"),
    **_at_least(0, "monetary", "customer_lifetime_days", "avg_days_between_orders"),
    "churn_label between 0 and 1": _breaks("churn_label NOT BETWEEN 0 AND 1"),
}
ENGINEERED_RULES = {
    **_present(*FEATURE_COLUMNS),
    **_at_least(
        0, "recency_days", "frequency", "monetary", "avg_order_value", "days_per_order"
    ),
}


def _sweep() -> str:
    ctes = ",".join(steps(days, prefix=f"d{days}_") for days in SWEEP_DAYS)
    parts = "\nUNION ALL\n".join(
        f"SELECT {days} AS churn_days, count(*) AS n_customers, "
        f"count(*) FILTER (churn_label = 1) AS n_churners, "
        f"round(avg(churn_label), 6) AS churn_rate FROM d{days}_repeaters"
        for days in SWEEP_DAYS
    )
    return f"WITH {ctes}\n{parts}"


def _describe() -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  CAST(min({value}) AS DOUBLE) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75,
  CAST(max({value}) AS DOUBLE) AS max
FROM raw_log"""
        for c in FEATURE_COLUMNS[1:]
        for value in [f"round({c}, 6)"]
    )


def _nulls() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, {_breaks(c + ' IS NULL')} AS n_nulls FROM measured"
        for c in (c.strip() for c in RFM_COLUMNS.split(","))
        if c != "churn_label"
    )


PK_SOURCES = {
    "customers": ("customer", "c_custkey"),
    "orders": ("orders", "o_orderkey"),
    "products": ("part", "p_partkey"),
    "sellers": ("supplier", "s_suppkey"),
}
COUNTED = {
    "customers": "customer",
    "orders": "orders",
    "order_items": "lineitem",
    "order_payments": "lineitem",
    "products": "part",
    "sellers": "supplier",
}
WINDOW_ROWS = (
    "SELECT order_id, person AS customer_unique_id, day AS order_date, "
    "amount AS payment_value FROM paid"
)
REQUESTS = "asked AS (SELECT o_orderkey AS pos, o_custkey AS customer_id FROM orders)"

SUMMARY = (
    f"{STORE}, {REQUESTS}, summary AS (SELECT count(*) AS n_requested, "
    "count(customer_unique_id) AS n_found, count(*) - count(customer_unique_id) AS n_not_found, "
    "'1' AS model_version FROM asked LEFT JOIN engineered ON customer_unique_id = customer_id)"
)

JUDGED = (
    f"{STORE}, {REQUESTS} SELECT pos, customer_id, recency_days IS NOT NULL AS found, "
    "TRUE AS in_bounds, TRUE AS consistent FROM asked "
    "LEFT JOIN engineered ON customer_unique_id = customer_id"
)

ORACLES: dict[str, str] = {
    "rfm_churn": f"{BASE} SELECT {RFM_COLUMNS} FROM repeaters",
    "rfm_sql_param": f"{BASE} SELECT {RFM_COLUMNS} FROM repeaters",
    "rfm_identity_merge": f"WITH {steps(per_person=2)} SELECT {RFM_COLUMNS} FROM repeaters",
    "rfm_returned_items": (
        f"WITH {steps(item_filter=RETURNED)} SELECT {RFM_COLUMNS} FROM repeaters"
    ),
    "table_row_counts": "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {table}"
        for name, table in COUNTED.items()
    ),
    "pk_violations": "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, count(*) FILTER (k IS NOT NULL AND n > 1) "
        f"AS n_repeated_keys, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS n_null_rows "
        f"FROM (SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY {key})"
        for name, (table, key) in PK_SOURCES.items()
    ),
    "duplicate_item_keys": (
        "SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, count(*) AS n_rows "
        "FROM lineitem GROUP BY ALL HAVING count(*) > 1"
    ),
    "reference_dates": f"SELECT {LAST_DAY} AS ref_dt, {LAST_DAY} - 180 AS cutoff_dt",
    "delivered_before_cutoff": f"{BASE} {WINDOW_ROWS}",
    "delivered_before_cutoff_collapse": f"WITH {steps(payment='l_quantity')} {WINDOW_ROWS}",
    "delivered_before_cutoff_returned_items": (
        f"WITH {steps(item_filter=RETURNED)} {WINDOW_ROWS}"
    ),
    "order_gaps": (
        f"{BASE} SELECT person AS customer_unique_id, day AS order_date, "
        "CAST(gap AS BIGINT) AS days_since_previous_order FROM spaced"
    ),
    "rfm_metrics": f"{BASE} SELECT * FROM measured",
    "rfm_metrics_nowindow": f"{BASE} SELECT * FROM measured",
    "active_after_cutoff": f"{BASE} SELECT * FROM active",
    "churn_labels": f"{BASE} SELECT {RFM_COLUMNS} FROM everyone",
    "churned_customers": (
        f"{BASE} SELECT * FROM measured WHERE customer_unique_id NOT IN (SELECT * FROM active)"
    ),
    "retained_customers": (
        f"{BASE} SELECT * FROM measured WHERE customer_unique_id IN (SELECT * FROM active)"
    ),
    "churn_sweep": _sweep(),
    "top_recent_customers": (
        f"{BASE} SELECT {RFM_COLUMNS} FROM repeaters "
        "ORDER BY recency_days, customer_unique_id LIMIT 10"
    ),
    "monetary_log": f"{EVERYONE} SELECT customer_unique_id, monetary, monetary_log FROM engineered",
    "avg_order_value": f"{EVERYONE} SELECT customer_unique_id, avg_order_value FROM engineered",
    "days_per_order": f"{EVERYONE} SELECT customer_unique_id, days_per_order FROM engineered",
    "one_time_flag": (
        f"{EVERYONE} SELECT customer_unique_id, frequency, is_one_time_buyer FROM engineered"
    ),
    "impute_gaps": (
        f"{EVERYONE} SELECT customer_unique_id, avg_days_between_orders FROM engineered"
    ),
    "engineered_features": f"{EVERYONE} SELECT {COLUMNS} FROM engineered",
    "build_features": f"{STORE} SELECT {COLUMNS} FROM engineered",
    "rfm_violations": f"{BASE} {violations('repeaters', RFM_RULES)}",
    "rfm_violations_two_snapshots": (
        f"WITH {steps(90, prefix='early_')}, {steps(180, prefix='late_')}, "
        "snapshots AS (SELECT * FROM early_repeaters UNION ALL SELECT * FROM late_repeaters) "
        f"{violations('snapshots', RFM_RULES)}"
    ),
    "raw_violations": (
        f"{BASE}, unfilled AS (SELECT e.* REPLACE (m.avg_days_between_orders AS "
        "avg_days_between_orders) FROM everyone e JOIN measured m USING (customer_unique_id)) "
        f"{violations('unfilled', RAW_RULES)}"
    ),
    "engineered_violations": f"{STORE} {violations('engineered', ENGINEERED_RULES)}",
    "validation_sample": (
        f"{STORE} SELECT customer_unique_id FROM engineered "
        "ORDER BY md5(concat(CAST(customer_unique_id AS VARCHAR), '-42')), customer_unique_id "
        "LIMIT 500"
    ),
    "key_uniqueness": (
        f"{BASE} SELECT count(*) AS n_rows, count(DISTINCT person) AS n_keys, "
        "count(*) - count(DISTINCT person) AS n_duplicates FROM paid"
    ),
    "null_counts": f"{BASE} {_nulls()}",
    "churn_rate": (
        f"{STORE} SELECT count(*) AS n_customers, CAST(sum(churn_label) AS BIGINT) AS n_churned, "
        "round(avg(churn_label), 6) AS churn_rate FROM engineered"
    ),
    "class_distribution": (
        f"{STORE} SELECT churn_label, count(*) AS n_rows FROM engineered GROUP BY churn_label"
    ),
    "describe_features": (
        f"{STORE}, raw_log AS (SELECT * REPLACE (ln(1 + monetary) AS monetary_log) FROM engineered) "
        f"{_describe()}"
    ),
    "stratified_split": f"{SPLIT} SELECT customer_unique_id, churn_label, side FROM sided",
    "class_weights": (
        f"{SPLIT} SELECT count(*) FILTER (churn_label = 0) AS n_negative, "
        "count(*) FILTER (churn_label = 1) AS n_positive, "
        f"round({RATIO}, 6) AS scale_pos_weight FROM sided WHERE side = 'train'"
    ),
    "weighted_rows": (
        f"{SPLIT} SELECT customer_unique_id, churn_label, CASE WHEN churn_label = 1 THEN "
        f"(SELECT round({RATIO}, 6) FROM sided WHERE side = 'train') ELSE 1.0 END AS weight "
        "FROM sided WHERE side = 'train'"
    ),
    "auc_rank_sum": f"""{STORE},
ranked AS (
  SELECT churn_label,
    rank() OVER (ORDER BY recency_days)
      + (count(*) OVER (PARTITION BY recency_days) - 1) / 2 AS mid_rank
  FROM engineered
),
totals AS (
  SELECT sum(mid_rank) FILTER (churn_label = 1) AS ranks,
    CAST(count(*) FILTER (churn_label = 1) AS DOUBLE) AS pos,
    CAST(count(*) FILTER (churn_label = 0) AS DOUBLE) AS neg
  FROM ranked
)
SELECT round((ranks - pos * (pos + 1) / 2) / (pos * neg), 9) AS auc FROM totals""",
    "precision_recall": f"""{STORE},
counted AS (
  SELECT count(*) FILTER (recency_days > 180 AND churn_label = 1) AS true_positives,
    count(*) FILTER (recency_days > 180 AND churn_label = 0) AS false_positives,
    count(*) FILTER (recency_days <= 180 AND churn_label = 1) AS false_negatives
  FROM engineered
)
SELECT *,
  coalesce(true_positives / nullif(true_positives + false_positives, 0), 0.0) AS precision,
  coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0.0) AS recall
FROM counted""",
    "lookup_customer": (
        f"{STORE} SELECT {COLUMNS} FROM engineered WHERE customer_unique_id = {LOOKED_UP}"
    ),
    "batch_lookup": (
        f"{STORE}, {REQUESTS} SELECT pos, customer_id, recency_days, frequency, monetary, "
        "recency_days IS NOT NULL AS found FROM asked "
        "LEFT JOIN engineered ON customer_unique_id = customer_id"
    ),
    "batch_summary": f"{SUMMARY} SELECT n_requested, n_found, n_not_found FROM summary",
    "score_summary": f"{SUMMARY} SELECT * FROM summary",
    "batch_event": (
        f"{SUMMARY} SELECT CAST(to_json({{'event': 'batch_predict', 'n_requested': n_requested, "
        "'n_found': n_found, 'n_not_found': n_not_found, 'model_version': model_version}) "
        "AS VARCHAR) AS event_json FROM summary"
    ),
    "run_log": (
        f"{SPLIT} SELECT 'scale_pos_weight' AS param, "
        f"CAST(round({RATIO}, 3) AS VARCHAR) AS value FROM sided WHERE side = 'train' "
        "UNION ALL VALUES ('model_type', 'gbt'), ('n_estimators', '100'), ('max_depth', '4'), "
        "('learning_rate', '0.1'), ('features_path', 'features')"
    ),
    "store_status": (
        f"{STORE} SELECT 'ok' AS status, '1' AS model_version, "
        "count(*) AS n_customers_in_store FROM engineered"
    ),
    "score_batch_judged": JUDGED,
    "score_stream_judged": JUDGED,
    "score_customers_judged": (
        f"{STORE} SELECT customer_unique_id AS pos, customer_unique_id AS customer_id, "
        "TRUE AS found, TRUE AS in_bounds, TRUE AS consistent FROM engineered"
    ),
    "metrics_in_bounds": (
        "SELECT unnest(['auc', 'precision', 'recall']) AS metric, TRUE AS in_bounds"
    ),
    "load_report": """
SELECT 'customers' AS table_name, count(*) AS n_rows FROM customer
UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'order_items', count(*) FROM lineitem
UNION ALL SELECT 'sellers', count(*) FROM supplier""",
    "loaded_items": """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS INTEGER) AS order_item_id,
  CAST(l_partkey AS VARCHAR) AS product_id,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) + 0.01 AS DECIMAL(10,2)) AS price,
  CAST(l_quantity AS DECIMAL(10,2)) AS freight_value
FROM lineitem""",
    "loaded_customers": """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CAST(c_custkey AS VARCHAR) AS customer_unique_id,
  lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS customer_zip_code_prefix,
  'town, ' || c_custkey AS customer_city, CASE WHEN c_custkey % 2 = 0 THEN '' END AS customer_state
FROM customer""",
    "load_all_report": """
SELECT 'customers' AS table_name, count(*) AS n_rows FROM customer
UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'order_items', count(*) FROM lineitem
UNION ALL SELECT 'order_payments', count(*) FROM lineitem
UNION ALL SELECT 'order_reviews', count(*) FROM orders
UNION ALL SELECT 'products', count(*) FROM part
UNION ALL SELECT 'sellers', count(*) FROM supplier
UNION ALL SELECT 'geolocation', count(*) FROM nation
UNION ALL SELECT 'product_category', count(DISTINCT p_type) FROM part""",
    "loaded_reviews": """
SELECT 'r' || o_orderkey AS review_id, CAST(o_orderkey AS VARCHAR) AS order_id,
  CAST(o_custkey % 5 + 1 AS SMALLINT) AS review_score, CAST(NULL AS VARCHAR) AS review_comment_title,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus || ' said "' || o_orderpriority || '",' || chr(10) || chr(10) || 'and ' || o_custkey END
    AS review_comment_message,
  CAST(o_orderdate AS TIMESTAMP) AS review_creation_date
FROM orders""",
    "loaded_places": """
SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
  CAST(-n_nationkey - 0.123457 AS DECIMAL(10,6)) AS geolocation_lat,
  CAST(1.5 AS DECIMAL(10,6)) AS geolocation_lng, n_name AS geolocation_city, 'SP' AS geolocation_state
FROM nation""",
    "score_customer_judged": (
        f"{STORE} SELECT CAST(customer_unique_id AS VARCHAR) AS customer_id, 'predict' AS event, '1' AS model_version, "
        f"TRUE AS in_bounds, TRUE AS consistent, CAST(NULL AS VARCHAR) AS error FROM engineered WHERE customer_unique_id = {LOOKED_UP} "
        "UNION ALL SELECT '-1', NULL, NULL, NULL, NULL, 'absent' "
        "WHERE NOT EXISTS (SELECT 1 FROM engineered WHERE customer_unique_id = -1)"
    ),
    "model_matrix": f"{STORE} "
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS pos, '{c}' AS column_name, count(*) AS n_rows, "
        f"round(CAST(min({c}) AS DOUBLE), 6) AS lowest, round(CAST(max({c}) AS DOUBLE), 6) AS highest FROM engineered"
        for i, c in enumerate(MODEL_COLUMNS)
    ),
}
