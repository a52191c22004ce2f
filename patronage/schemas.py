"""Declared schemas and column contracts."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT = T.StringType()
INT = T.IntegerType()
SMALL = T.ShortType()
BIG = T.LongType()
DOUBLE = T.DoubleType()
MONEY = T.DecimalType(10, 2)
DEGREES = T.DecimalType(10, 6)
TIMESTAMP = T.TimestampNTZType()


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


# Names, order and types of the raw tables. The raw files bind by
# position, so the order is part of the contract ("lenght" is spelt that way).
RAW_TABLES: dict[str, T.StructType] = {
    "customers": _struct(
        ("customer_id", TEXT),
        ("customer_unique_id", TEXT),
        ("customer_zip_code_prefix", TEXT),
        ("customer_city", TEXT),
        ("customer_state", TEXT),
    ),
    "orders": _struct(
        ("order_id", TEXT),
        ("customer_id", TEXT),
        ("order_status", TEXT),
        ("order_purchase_timestamp", TIMESTAMP),
        ("order_approved_at", TIMESTAMP),
        ("order_delivered_carrier_date", TIMESTAMP),
        ("order_delivered_customer_date", TIMESTAMP),
        ("order_estimated_delivery_date", TIMESTAMP),
    ),
    "order_items": _struct(
        ("order_id", TEXT),
        ("order_item_id", INT),
        ("product_id", TEXT),
        ("seller_id", TEXT),
        ("shipping_limit_date", TIMESTAMP),
        ("price", MONEY),
        ("freight_value", MONEY),
    ),
    "order_payments": _struct(
        ("order_id", TEXT),
        ("payment_sequential", INT),
        ("payment_type", TEXT),
        ("payment_installments", INT),
        ("payment_value", MONEY),
    ),
    "order_reviews": _struct(
        ("review_id", TEXT),
        ("order_id", TEXT),
        ("review_score", SMALL),
        ("review_comment_title", TEXT),
        ("review_comment_message", TEXT),
        ("review_creation_date", TIMESTAMP),
        ("review_answer_timestamp", TIMESTAMP),
    ),
    "products": _struct(
        ("product_id", TEXT),
        ("product_category_name", TEXT),
        ("product_name_lenght", INT),
        ("product_description_lenght", INT),
        ("product_photos_qty", INT),
        ("product_weight_g", INT),
        ("product_length_cm", INT),
        ("product_height_cm", INT),
        ("product_width_cm", INT),
    ),
    "sellers": _struct(
        ("seller_id", TEXT),
        ("seller_zip_code_prefix", TEXT),
        ("seller_city", TEXT),
        ("seller_state", TEXT),
    ),
    "geolocation": _struct(
        ("geolocation_zip_code_prefix", TEXT),
        ("geolocation_lat", DEGREES),
        ("geolocation_lng", DEGREES),
        ("geolocation_city", TEXT),
        ("geolocation_state", TEXT),
    ),
    "product_category": _struct(
        ("product_category_name", TEXT),
        ("product_category_name_english", TEXT),
    ),
}

# The raw tables that declare a primary key.
PRIMARY_KEYS: dict[str, str] = {
    "customers": "customer_id",
    "orders": "order_id",
    "products": "product_id",
    "sellers": "seller_id",
    "product_category": "product_category_name",
}

CUSTOMER_KEY = "customer_unique_id"
TARGET = "churn_label"

# One row per customer, as it leaves the RFM query.
RFM_SCHEMA = _struct(
    (CUSTOMER_KEY, TEXT),
    ("recency_days", BIG),
    ("frequency", BIG),
    ("monetary", DOUBLE),
    ("customer_lifetime_days", BIG),
    ("avg_days_between_orders", DOUBLE),
    (TARGET, INT),
)

# The order of the engineered columns is what training and
# scoring agree on.
FEATURE_COLUMNS = [
    "customer_unique_id",
    "recency_days",
    "frequency",
    "monetary",
    "monetary_log",
    "avg_order_value",
    "days_per_order",
    "avg_days_between_orders",
    "customer_lifetime_days",
    "is_one_time_buyer",
    "churn_label",
]

# What the model sees: everything but the key and the label.
MODEL_COLUMNS = [c for c in FEATURE_COLUMNS if c not in (CUSTOMER_KEY, TARGET)]

_WHOLE = {"recency_days", "frequency", "customer_lifetime_days"}
_FLAG = {"is_one_time_buyer", TARGET}

FEATURE_SCHEMA = _struct(
    *(
        (c, TEXT if c == CUSTOMER_KEY else BIG if c in _WHOLE else INT if c in _FLAG else DOUBLE)
        for c in FEATURE_COLUMNS
    )
)

SCORE_SCHEMA = _struct(
    ("pos", INT),
    ("customer_id", TEXT),
    ("churn_probability", DOUBLE),
    ("churn_prediction", INT),
    ("found", T.BooleanType()),
)
