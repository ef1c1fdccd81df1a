"""The order fact: delivered order items with customer and seller attributes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendastat.functions.dates import month_start
from vendastat.operators.lookup import lookup_join
from vendastat.schemas import StarSchema

DELIVERED = "delivered"

# Output column -> input column, where the two names differ.
RENAMED = {
    "year_month": "purchase_ym",
    "total_item_value": "item_total",
    "review_score": "avg_review_score",
    "product_category_english": "category_en",
}

FACT_COLUMNS = [
    "order_id",
    "order_item_id",
    "customer_id",
    "customer_unique_id",
    "customer_city",
    "customer_state",
    "product_id",
    "seller_id",
    "order_status",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "purchase_date",
    "purchase_year",
    "purchase_month",
    "year_month",
    "purchase_month_date",
    "price",
    "freight_value",
    "total_item_value",
    "delivery_days",
    "delivery_status",
    "days_vs_estimate",
    "review_score",
    "product_category_english",
    "primary_payment_type",
    "max_installments",
    "total_payment_value",
    "seller_city",
    "seller_state",
]
CUSTOMER_COLUMNS = ["customer_unique_id", "customer_city", "customer_state"]
SELLER_COLUMNS = ["seller_city", "seller_state"]
ITEM_KEY = ["order_id", "order_item_id"]


def _item_column(name: str):
    if name == "purchase_month_date":
        return month_start(F.col("order_purchase_timestamp")).alias(name)
    return F.col(RENAMED.get(name, name)).alias(name)


def order_fact(star: StarSchema, columns: Iterable[str] | None = None) -> DataFrame:
    """Delivered order items, left-joined with their customer and seller.

    With ``columns``, only those are produced and a dimension is joined only if one of its
    columns is wanted. Dimension keys must be unique (see ``schemas.duplicate_keys``).
    """
    wanted = [c for c in FACT_COLUMNS if columns is None or c in set(columns)]
    if columns is not None:
        star = star.narrowed(wanted)
    of_customer = [c for c in wanted if c in CUSTOMER_COLUMNS]
    of_seller = [c for c in wanted if c in SELLER_COLUMNS]
    of_item = [c for c in wanted if c not in CUSTOMER_COLUMNS + SELLER_COLUMNS]
    # Columns the joins may need besides.
    keys = ["customer_id"] * bool(of_customer) + ["seller_id"] * bool(of_seller)
    of_item += [k for k in [*ITEM_KEY, *keys] if keys and k not in of_item]

    fact = star.items.where(F.col("order_status") == DELIVERED).select([_item_column(c) for c in of_item])
    if of_customer:
        lookup = star.customers.select("customer_id", *of_customer)
        fact = lookup_join(fact, lookup, "customer_id", spread_by=ITEM_KEY, counted=star.key_rows("customer_id"))
    if of_seller:
        lookup = star.sellers.select("seller_id", *of_seller)
        fact = lookup_join(fact, lookup, "seller_id", spread_by=ITEM_KEY, counted=star.key_rows("seller_id"))
    return fact.select(wanted)
