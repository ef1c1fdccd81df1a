"""Monthly, category, seller, state and payment performance, and the data-quality profile.

Where orders and customers are both counted, items are first reduced to one row per order and
account. From the star schema, the customer table is joined there: on orders instead of items. Orders
are then counted as rows and customers as the only distinct count, so that no plan repeats its rows.
From a stored fact, which has the customer in every item, the row keeps the customer itself.

An order has one account. If a faulty fact has items of several in one order, sums and customers
still go to each account, and the order counts once for each; the months, which look at whole
orders, count it once, for the greatest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendastat.functions.numeric import exact_mean, percent_of_rows

ACCOUNT, CUSTOMER, STATE = "customer_id", "customer_unique_id", "customer_state"
ON_TIME = "On Time"


#: Adds the columns of the customer to rows with an account.
Lookup = Callable[[DataFrame], DataFrame]

# Fact column -> name of its sum in the reduced rows; the count of known values ends with "_n".
_SUMMED = {
    "total_item_value": "value",
    "price": "price",
    "freight_value": "freight",
    "review_score": "review",
    "delivery_days": "days",
}


def _orders(fact: DataFrame, customers: Lookup | None, *keys: Column | str, whole: bool = False) -> DataFrame:
    """Sums and counts per key, order and account, with the columns of the customer where they are to be had.

    ``whole`` gives one row per key and order, whatever its accounts.
    """
    summed = {c: name for c, name in _SUMMED.items() if c in fact.columns}
    status = F.col("delivery_status")
    flags = [F.count_if(status == ON_TIME).alias("on_time"), F.count_if(status != ON_TIME).alias("late")]
    who = [c for c in (ACCOUNT if customers else CUSTOMER, STATE) if c in fact.columns]
    by, found = ([], [F.max(c).alias(c) for c in who]) if whole else (who, [])
    orders = fact.groupBy(*keys, "order_id", *by).agg(
        F.count("*").alias("items"),
        *[F.sum(c).alias(name) for c, name in summed.items()],
        *[F.count(c).alias(f"{name}_n") for c, name in summed.items()],
        *(flags if "delivery_status" in fact.columns else []),
        *found,
    )
    return customers(orders) if customers else orders


def _mean(name: str) -> Column:
    """Mean over items, from reduced rows."""
    return F.try_divide(F.sum(name).cast("double"), F.sum(f"{name}_n"))


def _unique(rows: DataFrame, name: str) -> list[Column]:
    return [F.count_distinct(CUSTOMER).alias(name)] if CUSTOMER in rows.columns else []


def monthly_kpis(fact: DataFrame, customers: Lookup | None = None) -> DataFrame:
    """Order-grain KPIs per month.

    An order is on time if all its items with a known status are; an order without any known
    status counts as late. Ratings and delivery days are means of order means. Without customers,
    ``unique_customers`` is left out; the customer table is then not needed.
    """
    orders = _orders(fact, customers, F.col("purchase_month_date").alias("purchase_month"), "year_month", whole=True)
    on_time = (F.col("on_time") > 0) & (F.col("late") == 0)
    mean = lambda name: F.avg(F.try_divide(F.col(name).cast("double"), F.col(f"{name}_n")))
    return orders.groupBy("purchase_month", "year_month").agg(
        F.count("*").alias("total_orders"),
        *_unique(orders, "unique_customers"),
        F.sum("value").alias("gmv"),
        (F.sum("value").cast("double") / F.count("*")).alias("aov"),
        F.sum("price").alias("product_revenue"),
        F.sum("freight").alias("freight_revenue"),
        mean("review").alias("avg_review_score"),
        mean("days").alias("avg_delivery_days"),
        percent_of_rows(on_time).alias("on_time_pct"),
    )


def product_performance(fact: DataFrame, customers: Lookup | None = None) -> DataFrame:
    """Orders, items, revenue, freight, price, rating and buyers per category.

    Without customers, ``unique_buyers`` is left out.
    """
    category = F.col("product_category_english")
    orders = _orders(fact.where(category.isNotNull()), customers, category.alias("category"))
    return orders.groupBy("category").agg(
        F.count("*").alias("orders"),
        F.sum("items").alias("items_sold"),
        F.sum("price").alias("revenue"),
        F.sum("freight").alias("total_freight"),
        _mean("price").alias("avg_price"),
        _mean("review").alias("avg_rating"),
        *_unique(orders, "unique_buyers"),
    )


def seller_performance(fact: DataFrame) -> DataFrame:
    """Orders, items, revenue, rating, delivery days and item on-time share per seller."""
    return fact.groupBy("seller_id", "seller_city", "seller_state").agg(
        F.count_distinct("order_id").alias("orders_fulfilled"),
        F.count("*").alias("items_sold"),
        F.sum("price").alias("revenue"),
        F.avg("review_score").alias("avg_rating"),
        F.avg("delivery_days").alias("avg_delivery_days"),
        percent_of_rows(F.col("delivery_status") == ON_TIME).alias("on_time_pct"),
    )


def state_performance(fact: DataFrame, customers: Lookup | None = None) -> DataFrame:
    """Orders, customers, GMV, mean item value, delivery and rating per customer state."""
    orders = _orders(fact, customers)
    return (
        orders.where(F.col(STATE).isNotNull())
        .groupBy(STATE)
        .agg(
            F.count("*").alias("orders"),
            *_unique(orders, "customers"),
            F.sum("value").alias("gmv"),
            _mean("value").alias("aov"),
            _mean("days").alias("avg_delivery_days"),
            _mean("review").alias("avg_rating"),
            (F.sum("on_time") * F.lit(100.0) / F.sum("items")).alias("on_time_pct"),
        )
    )


def payment_analysis(payments: DataFrame) -> DataFrame:
    """Orders, mean installments, total and mean payment per payment type."""
    return payments.groupBy("payment_type").agg(
        F.count_distinct("order_id").alias("orders"),
        F.avg("payment_installments").alias("avg_installments"),
        F.sum("payment_value").alias("total_paid"),
        exact_mean(F.col("payment_value")).alias("avg_payment"),
    )


# Metric names of the profile, and the aggregate over categories each one shows.
UNIQUE_CUSTOMERS = "Unique customers"
PROFILE = [
    ("Total delivered order items", lambda: F.coalesce(F.sum("items"), F.lit(0))),
    (UNIQUE_CUSTOMERS, None),
    ("Date range start", lambda: F.min("first")),
    ("Date range end", lambda: F.max("last")),
    ("Categories with data", lambda: F.count("category")),
]


def data_quality(fact: DataFrame, customers: Lookup | None = None) -> DataFrame:
    """Five figures of the fact as text.

    One narrow pass reduces the items to a row per category, another to a row per customer (or
    account, before the customer table is joined): two counts without a repeated row.
    """
    purchased = "order_purchase_timestamp"
    by_category = fact.groupBy(F.col("product_category_english").alias("category")).agg(
        F.count("*").alias("items"), F.min(purchased).alias("first"), F.max(purchased).alias("last")
    )
    who = fact.select(ACCOUNT if customers else CUSTOMER).distinct()
    unique = (customers(who) if customers else who).agg(F.count_distinct(CUSTOMER)).scalar()
    figures = by_category.agg(*[figure().cast("string").alias(name) for name, figure in PROFILE if figure])
    figures = figures.withColumn(UNIQUE_CUSTOMERS, unique.cast("string"))
    rows = [F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name, _ in PROFILE]
    return figures.select(F.inline(F.array(*rows)))
