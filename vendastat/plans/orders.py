"""Raw one-to-many tables reduced to one row per order, and joined with the order items.

Payments and reviews come as several rows per order. They are reduced before any join, so that an
item is never repeated, and by sums that combine inside the map tasks: an order with very many
rows costs one row per payment type and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendastat.operators.lookup import lookup_join
from vendastat.schemas import ORDER_ITEMS

ORDER = "order_id"
OF_PAYMENTS = ["primary_payment_type", "max_installments", "total_payment_value"]
OF_REVIEWS = ["avg_review_score"]


def payments_per_order(payments: DataFrame) -> DataFrame:
    """One row per order: primary type, most installments, total value, number of payments.

    The primary type is the one with the largest total in the order. Known types come before
    unknown ones, types with an amount before those without; equal totals go by name. An order
    without any amount has no total. Payments without an order are left out.
    """
    by_type = (
        payments.where(F.col(ORDER).isNotNull())
        .groupBy(ORDER, "payment_type")
        .agg(
            F.sum("payment_value").alias("value"),
            F.max("payment_installments").alias("installments"),
            F.count("*").alias("payments"),
        )
    )
    kind, value = F.col("payment_type"), F.col("value")
    best = F.min(F.struct(kind.isNull().alias("unknown"), value.isNull().alias("empty"), (-value).alias("v"), kind.alias("type")))
    totals = by_type.groupBy(ORDER).agg(
        best.alias("best"),
        F.max("installments").cast("int").alias("max_installments"),
        F.sum("value").alias("total"),
        F.sum("payments").alias("payments"),
    )
    total = F.col("total").cast(ORDER_ITEMS["total_payment_value"].dataType)
    return totals.select(
        ORDER, F.col("best.type").alias("primary_payment_type"), "max_installments", total.alias("total_payment_value"), "payments"
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    """One row per order: mean of the known scores, number of reviews."""
    score = F.col("review_score").cast("double")
    return (
        reviews.where(F.col(ORDER).isNotNull())
        .groupBy(ORDER)
        .agg(F.avg(score).alias("avg_review_score"), F.count("*").alias("reviews"))
    )


def with_order_totals(items: DataFrame, payments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Order items with what is known of the payments and reviews of their order.

    Columns of these names that ``items`` has already are replaced; orders without payments or
    reviews get NULL. All items stay, once each. A broadcast is only used for a reduced table that
    is small enough; otherwise items of orders with very many items are spread over several tasks.
    """
    plain = items.drop(*OF_PAYMENTS, *OF_REVIEWS)
    spread = [c for c in ("order_item_id", "product_id", "seller_id") if c in plain.columns]
    paid = lookup_join(plain, payments_per_order(payments).select(ORDER, *OF_PAYMENTS), ORDER, spread_by=spread)
    # Both joins are on the order, so rows are counted on the items and not on the first join.
    rated = lookup_join(
        paid, reviews_per_order(reviews).select(ORDER, *OF_REVIEWS), ORDER, spread_by=spread, counted=plain.select(ORDER)
    )
    return rated.select(*[c for c in ORDER_ITEMS.fieldNames() if c in rated.columns])
