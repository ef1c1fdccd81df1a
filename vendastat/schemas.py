"""Declared schemas of the star schema, and checks at the door."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MONEY = T.DecimalType(12, 2)
_MONEY4 = T.DecimalType(18, 4)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


ORDER_ITEMS = _schema(
    order_id=T.LongType(),
    order_item_id=T.IntegerType(),
    customer_id=T.LongType(),
    product_id=T.LongType(),
    seller_id=T.LongType(),
    order_status=T.StringType(),
    order_purchase_timestamp=T.TimestampNTZType(),
    order_approved_at=T.TimestampNTZType(),
    order_delivered_carrier_date=T.TimestampNTZType(),
    order_delivered_customer_date=T.TimestampNTZType(),
    order_estimated_delivery_date=T.TimestampNTZType(),
    purchase_date=T.DateType(),
    purchase_year=T.IntegerType(),
    purchase_month=T.IntegerType(),
    purchase_ym=T.StringType(),
    price=_MONEY,
    freight_value=_MONEY4,
    item_total=_MONEY4,
    delivery_days=T.IntegerType(),
    delivery_status=T.StringType(),
    days_vs_estimate=T.IntegerType(),
    avg_review_score=T.DoubleType(),
    category_en=T.StringType(),
    primary_payment_type=T.StringType(),
    max_installments=T.IntegerType(),
    total_payment_value=_MONEY,
)

CUSTOMERS = _schema(
    customer_id=T.LongType(),
    customer_unique_id=T.StringType(),
    customer_city=T.StringType(),
    customer_state=T.StringType(),
)

SELLERS = _schema(
    seller_id=T.LongType(),
    seller_city=T.StringType(),
    seller_state=T.StringType(),
)

PAYMENTS = _schema(
    order_id=T.LongType(),
    payment_type=T.StringType(),
    payment_installments=T.IntegerType(),
    payment_value=_MONEY,
)

# Names of the stored tables.
TABLES = {
    "fact_order_items": ORDER_ITEMS,
    "dim_customers": CUSTOMERS,
    "dim_sellers": SELLERS,
    "order_payments": PAYMENTS,
}

# Identifiers may be stored as text or as whole numbers.
ID_COLUMNS = frozenset({"order_id", "customer_id", "product_id", "seller_id"})


@dataclass(frozen=True)
class StarSchema:
    """The four input tables."""

    items: DataFrame
    customers: DataFrame
    sellers: DataFrame
    payments: DataFrame

    def narrowed(self, fact_columns: Iterable[str]) -> StarSchema:
        """The tables as needed for an order fact of these columns; stored tables need no change."""
        return self

    def key_rows(self, key: str) -> DataFrame:
        """Rows to count the keys of a join with the items on, without any join."""
        return self.items.select(key)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` reduced to the declared columns; raises if a column is missing or mistyped."""
    found = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    wrong = []
    for field in schema.fields:
        dtype = found[field.name]
        if field.name in ID_COLUMNS:
            fits = isinstance(dtype, (T.StringType, T.IntegralType))
        else:
            fits = dtype == field.dataType
        if not fits:
            wrong.append(f"{field.name} is {dtype.simpleString()}, expected {field.dataType.simpleString()}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(schema.fieldNames())


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once. A repeated dimension key would fan out the fact."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")
