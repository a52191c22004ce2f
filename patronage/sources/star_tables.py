"""The shop's tables as views over a star schema of orders and line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order status that counts as delivered in the star schema.
FULFILLED = "F"

# The columns in use. Declared, so that opening a table reads no footer.
STAR_SCHEMAS = {
    "customer": "c_custkey bigint",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_returnflag string"
    ),
    "part": "p_partkey bigint",
    "supplier": "s_suppkey bigint",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def star_tables(
    spark: SparkSession,
    folder: str,
    payment: str = "l_extendedprice",
    logins_per_person: int = 1,
    items: Column | None = None,
    text_keys: bool = False,
) -> dict[str, DataFrame]:
    """Projections of the parquet tables in ``folder``; nothing is computed.

    ``payment`` names the line column paid. ``logins_per_person`` maps that
    many customer ids to one person. ``items`` keeps only some lines as items,
    so that orders exist which have payments but no item. ``text_keys`` gives
    persons the key type that stored features declare.
    """
    lines = _table(spark, folder, "lineitem")
    person = F.col("c_custkey")
    if logins_per_person > 1:
        person = F.expr(f"c_custkey div {int(logins_per_person)}")
    if text_keys:
        person = person.cast("string")
    return {
        "customers": _table(spark, folder, "customer").select(
            F.col("c_custkey").alias("customer_id"), person.alias("customer_unique_id")
        ),
        "orders": _table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
        ),
        "order_items": (lines if items is None else lines.where(items)).select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        ),
        "order_payments": lines.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("payment_sequential"),
            F.col(payment).cast("decimal(12,2)").alias("payment_value"),
        ),
    }


def keyed_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of ``star_tables`` and the two others that declare a key."""
    return {
        **star_tables(spark, folder),
        "products": _table(spark, folder, "part").select(F.col("p_partkey").alias("product_id")),
        "sellers": _table(spark, folder, "supplier").select(
            F.col("s_suppkey").alias("seller_id")
        ),
    }
