"""Adapter: generic retail tables (orders, line items, parts, ...) as the star schema."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendastat.operators.lookup import lookup_join
from vendastat.plans.fact import RENAMED
from vendastat.plans.orders import OF_PAYMENTS, OF_REVIEWS, with_order_totals
from vendastat.schemas import CUSTOMERS, ORDER_ITEMS, PAYMENTS, SELLERS, conform

SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_tax double",
    "events": "user_id bigint, event_type string, value double, props string",
}

# How the generic tables' codes are read.
STATUS_OF_CODE = {"F": "delivered", "O": "shipped", "P": "canceled"}
SCORE_OF_PRIORITY = {"1": 5.0, "2": 5.0, "3": 4.0, "5": 2.0}
PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card"]
ESTIMATED_DAYS = 45
UNDELIVERED_QUANTITY = 50
REVIEW_EVENT = "view"

# Per order, before the join with its items.
PURCHASED = "timestampadd(SECOND, cast((o_orderkey * 7919) % 86400 as int), o_orderdate)"
_DELIVERED = f"l_quantity < {UNDELIVERED_QUANTITY}"
_PRICE = "cast(l_extendedprice as decimal(12,2))"
_TAX = "cast(l_tax as decimal(4,2))"


def _case(column: str, values: dict[str, object]) -> str:
    branches = " ".join(f"when '{code}' then {value!r}" for code, value in values.items())
    return f"case {column} {branches} end"


ITEM_EXPRESSIONS = {
    "order_id": "o_orderkey",
    "order_item_id": "l_linenumber",
    "customer_id": "o_custkey",
    "product_id": "l_partkey",
    "seller_id": "l_suppkey",
    "order_status": _case("o_orderstatus", STATUS_OF_CODE),
    "order_purchase_timestamp": "purchased",
    "order_approved_at": "purchased + interval 1 hour",
    "order_delivered_carrier_date": "purchased + interval 1 day",
    "order_delivered_customer_date": f"case when {_DELIVERED} then timestampadd(DAY, cast(l_quantity as int), purchased) end",
    "order_estimated_delivery_date": f"purchased + interval {ESTIMATED_DAYS} days",
    "purchase_date": "cast(purchased as date)",
    "purchase_year": "year(purchased)",
    "purchase_month": "month(purchased)",
    "purchase_ym": "left(cast(cast(purchased as date) as string), 7)",
    "price": _PRICE,
    "freight_value": f"cast({_PRICE} * {_TAX} as decimal(18,4))",
    "item_total": f"cast({_PRICE} * (1 + {_TAX}) as decimal(18,4))",
    "delivery_days": f"case when {_DELIVERED} then cast(l_quantity as int) end",
    "delivery_status": f"case when {_DELIVERED} then if(l_quantity <= {ESTIMATED_DAYS}, 'On Time', 'Late') end",
    "days_vs_estimate": f"case when {_DELIVERED} then cast(l_quantity as int) - {ESTIMATED_DAYS} end",
    "avg_review_score": f"cast({_case('left(o_orderpriority, 1)', SCORE_OF_PRIORITY)} as double)",
    "category_en": "p_name",
    "primary_payment_type": f"element_at(array({', '.join(map(repr, PAYMENT_TYPES))}), cast(o_orderkey % 4 as int) + 1)",
    "max_installments": "cast(1 + o_orderkey % 10 as int)",
    "total_payment_value": "cast(o_totalprice as decimal(12,2))",
}

CUSTOMER_EXPRESSIONS = {
    "customer_id": "c_custkey",
    "customer_unique_id": "concat('CU', c_custkey - c_custkey % 2)",
    "customer_city": "c_mktsegment",
    "customer_state": "n_name",
}

# Item columns every order fact may need for its filter and joins.
JOIN_COLUMNS = {
    "order_id", "order_item_id", "order_status", "order_purchase_timestamp", "customer_id", "seller_id",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def order_items(spark: SparkSession, folder: str, columns: Iterable[str], status: str | None = None) -> DataFrame:
    """Line items with their order and, if the category is wanted, their part.

    ``status`` filters on the stored code, which the Parquet scan can skip by.
    """
    columns = [c for c in ITEM_EXPRESSIONS if c in set(columns)]
    orders = _table(spark, folder, "orders")
    if status is not None:
        code = next(c for c, s in STATUS_OF_CODE.items() if s == status)
        orders = orders.where(F.col("o_orderstatus") == code)
    orders = orders.withColumn("purchased", F.expr(PURCHASED)).drop("o_orderdate")
    lines = _table(spark, folder, "lineitem").withColumn("o_orderkey", F.col("l_orderkey"))
    spread = ["l_partkey", "l_suppkey", "l_linenumber"]
    joined = lookup_join(lines, orders, "o_orderkey", "inner", spread_by=spread)
    if "category_en" in columns:
        parts = _table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        spread = ["l_orderkey", "l_linenumber"]
        joined = lookup_join(joined, parts, "l_partkey", spread_by=spread, counted=lines)
    return joined.select(*[F.expr(ITEM_EXPRESSIONS[c]).alias(c) for c in columns])


def customers(spark: SparkSession, folder: str, columns: Iterable[str] = CUSTOMERS.fieldNames()) -> DataFrame:
    known = _table(spark, folder, "customer")
    if "customer_state" in columns:
        nations = _table(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
        known = lookup_join(known, nations, "c_nationkey")
    return known.select(*[F.expr(CUSTOMER_EXPRESSIONS[c]).alias(c) for c in columns])


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    nations = _table(spark, folder, "nation")
    regions = _table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    places = lookup_join(nations, regions, "n_regionkey").withColumnRenamed("n_nationkey", "s_nationkey")
    known = _table(spark, folder, "supplier")
    return lookup_join(known, places, "s_nationkey").select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("r_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").select(
        F.col("user_id").alias("order_id"),
        F.col("event_type").alias("payment_type"),
        F.get_json_object("props", "$.k").cast("int").alias("payment_installments"),
        F.col("value").cast("decimal(12,2)").alias("payment_value"),
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Several reviews per order: the events of one type, with a score from 1 to 5."""
    events = _table(spark, folder, "events").where(F.col("event_type") == REVIEW_EVENT)
    number = F.get_json_object("props", "$.k").cast("int")
    return events.select(F.col("user_id").alias("order_id"), (1 + number % 5).alias("review_score"))


class RetailStar:
    """The four tables of a ``StarSchema``, each built when first asked for.

    ``status`` limits the items to orders of that status. With ``fact_columns``, items and
    customers hold only what an order fact of those columns needs. With ``raw``, the payment and
    review columns of the items are reduced from the payments and reviews of their order. That is
    not the default, as few orders of the generic tables have any: the other items would have NULL.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        status: str | None = None,
        fact_columns: Iterable[str] | None = None,
        raw: bool = False,
    ):
        self.spark, self.folder, self.status, self.raw = spark, folder, status, raw
        self.fact_columns = None if fact_columns is None else list(fact_columns)

    def narrowed(self, fact_columns: Iterable[str]) -> RetailStar:
        return RetailStar(self.spark, self.folder, self.status, fact_columns, self.raw)

    def key_rows(self, key: str) -> DataFrame:
        """Customers are counted by orders, sellers by line items: one scan, no join."""
        table, column = {"customer_id": ("orders", "o_custkey"), "seller_id": ("lineitem", "l_suppkey")}[key]
        return _table(self.spark, self.folder, table).select(F.col(column).alias(key))

    @cached_property
    def items(self) -> DataFrame:
        wanted = set(ITEM_EXPRESSIONS)
        if self.fact_columns is not None:
            wanted = {RENAMED.get(c, c) for c in self.fact_columns} | JOIN_COLUMNS
        of_orders = wanted & {*OF_PAYMENTS, *OF_REVIEWS} if self.raw else set()
        items = order_items(self.spark, self.folder, wanted - of_orders, self.status)
        if of_orders:
            items = with_order_totals(items, self.payments, reviews(self.spark, self.folder))
        return conform(items, ORDER_ITEMS) if self.fact_columns is None else items

    @cached_property
    def customers(self) -> DataFrame:
        if self.fact_columns is None:
            return conform(customers(self.spark, self.folder), CUSTOMERS)
        wanted = [c for c in CUSTOMERS.fieldNames() if c == "customer_id" or c in self.fact_columns]
        return customers(self.spark, self.folder, wanted)

    @cached_property
    def sellers(self) -> DataFrame:
        return conform(sellers(self.spark, self.folder), SELLERS)

    @cached_property
    def payments(self) -> DataFrame:
        return conform(payments(self.spark, self.folder), PAYMENTS)
