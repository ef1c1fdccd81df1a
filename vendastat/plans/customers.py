"""Per-customer metrics, RFM segments, cohorts, and new versus returning customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendastat.functions.dates import months_between_starts, whole_days
from vendastat.functions.numeric import exact_mean
from vendastat.functions.rules import rfm_segment
from vendastat.operators.tiles import SAMPLE_ROWS, global_ntile
from vendastat.plans.fact import DELIVERED
from vendastat.schemas import StarSchema

CUSTOMER = "customer_unique_id"


def customer_metrics(fact: DataFrame) -> DataFrame:
    """Orders, revenue, mean order value, first and last order, lifetime and recency in days.

    Recency counts from the newest purchase of the whole fact, also if that purchase has no
    known customer. The unknown customer is a group like others until then, so that the fact
    is read and joined once: the plan uses the reduced orders twice.
    """
    orders = fact.groupBy(CUSTOMER, "order_id", "order_purchase_timestamp").agg(
        F.sum("total_item_value").alias("order_value"),
        # Aggregated, as a filter on the key itself would move below and make two shuffles.
        F.max(F.col(CUSTOMER).isNotNull()).alias("known"),
    )
    # Of the whole row, so that both uses need the same columns and share one shuffle.
    newest = orders.agg(F.max(F.struct("order_purchase_timestamp", "order_value", "known")).alias("last"))
    newest = newest.select("last.order_purchase_timestamp").scalar()
    per_customer = orders.where("known").groupBy(CUSTOMER).agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("order_value").alias("total_revenue"),
        exact_mean(F.col("order_value")).alias("avg_order_value"),
        F.min("order_purchase_timestamp").alias("first_order_date"),
        F.max("order_purchase_timestamp").alias("last_order_date"),
    )
    return per_customer.select(
        "*",
        whole_days(F.col("last_order_date"), F.col("first_order_date")).alias("customer_lifetime_days"),
        whole_days(newest, F.col("last_order_date")).alias("recency_days"),
    )


def customer_count(star: StarSchema) -> Column:
    """Number of known customers with a delivered item, as a scalar.

    Items are reduced to one row per account before they meet the customer table.
    """
    star = star.narrowed([CUSTOMER])
    accounts = star.items.where(F.col("order_status") == DELIVERED).select("customer_id").distinct()
    known = star.customers.select("customer_id", CUSTOMER)
    return accounts.join(known, "customer_id").agg(F.count_distinct(CUSTOMER)).scalar()


def rfm_segments(
    metrics: DataFrame, high_is_good: bool = False, distributed: bool | None = None, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Recency, frequency and revenue quintiles of ``customer_metrics``, and the segment.

    By default a score of 1 marks the most recent, most frequent and highest-revenue
    customers, while the segment names read 5 as best; so "Champions" are in fact the
    weakest customers. ``high_is_good=True`` turns the scores around (5 is best), which
    gives the names their usual meaning. Ties are broken by customer.
    """
    scores = {
        "r_score": ("recency_days", "asc"),
        "f_score": ("total_orders", "desc"),
        "m_score": ("total_revenue", "desc"),
    }
    scored = global_ntile(metrics, scores, CUSTOMER, tiles=5, distributed=distributed, sample_rows=sample_rows)
    if high_is_good:
        scored = scored.withColumns({s: 6 - F.col(s) for s in scores})
    r, f, m = (F.col(s) for s in scores)
    return scored.select(
        CUSTOMER,
        "total_orders",
        "total_revenue",
        "avg_order_value",
        "recency_days",
        "first_order_date",
        "last_order_date",
        *scores,
        (r + f + m).alias("rfm_total"),
        rfm_segment(r, f, m).alias("rfm_segment"),
    )


def customer_months(fact: DataFrame) -> DataFrame:
    """One row per customer and purchase month, with the customer's first month.

    Item rows are reduced before the shuffle, so that a customer with very many items costs
    no more than one row per month.
    """
    return (
        fact.where(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER, F.col("purchase_month_date").alias("month"))
        .agg(F.count("*").alias("items"), F.sum("total_item_value").alias("revenue"))
        .withColumn("first_month", F.min("month").over(Window.partitionBy(CUSTOMER)))
    )


def cohort_retention(fact: DataFrame) -> DataFrame:
    """Customers of each first-purchase month still active 0, 1, 2, ... months later.

    Months without any active customer have no row. Every customer is active in month 0, so
    the cohort size is the count there. The rate is rounded half up to two decimals on whole
    numbers, hence exact.
    """
    month_number = months_between_starts(F.col("month"), F.col("first_month"))
    size = F.max(F.when(F.col("month_number") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month")
    )
    hundredths = F.expr("(20000 * active_customers + cohort_size) div (2 * cohort_size)")
    return (
        customer_months(fact)
        .where(F.col("month").isNotNull())
        .groupBy(F.col("first_month").alias("cohort_month"), month_number.alias("month_number"))
        .agg(F.count("*").alias("active_customers"))
        .withColumn("cohort_size", size)
        .withColumn("retention_rate", (hundredths.cast("decimal(9,0)") * F.expr("0.01BD")).cast("decimal(7,2)"))
    )


def new_vs_returning(fact: DataFrame) -> DataFrame:
    """Customers, items and revenue per month, split by first month or later month."""
    kind = F.when(F.col("month") == F.col("first_month"), "New").otherwise("Returning")
    return (
        customer_months(fact)
        .groupBy(F.col("month").alias("purchase_month"), kind.alias("customer_type"))
        .agg(
            F.count("*").alias("customers"),
            F.sum("items").alias("items"),
            F.sum("revenue").alias("revenue"),
        )
    )
