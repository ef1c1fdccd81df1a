"""The eleven views under their SQL names, the columns each needs, and result reuse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from vendastat.operators.lookup import lookup_join
from vendastat.plans import customers, performance
from vendastat.plans.fact import CUSTOMER_COLUMNS, FACT_COLUMNS, order_fact
from vendastat.plans.performance import ACCOUNT
from vendastat.schemas import StarSchema

_CUSTOMER = ["customer_unique_id", "order_id", "order_purchase_timestamp", "total_item_value"]
_MONTH = ["customer_unique_id", "purchase_month_date", "total_item_value"]


@dataclass(frozen=True)
class View:
    """How to build a view from the order fact, and the fact columns it reads.

    With ``by_order``, ``build`` also takes a function that joins the customer table later than the
    fact does, on reduced rows.
    """

    build: Callable[..., DataFrame]
    columns: list[str] = field(default_factory=list)
    by_order: bool = False


VIEWS = {
    "vw_order_fact": View(lambda fact: fact, FACT_COLUMNS),
    "vw_customer_metrics": View(customers.customer_metrics, _CUSTOMER),
    "vw_rfm_segments": View(lambda fact: customers.rfm_segments(customers.customer_metrics(fact)), _CUSTOMER),
    "vw_cohort_retention": View(customers.cohort_retention, _MONTH),
    "vw_monthly_kpis": View(
        performance.monthly_kpis,
        [
            "order_id", "customer_unique_id", "purchase_month_date", "year_month", "total_item_value",
            "price", "freight_value", "review_score", "delivery_days", "delivery_status",
        ],
        by_order=True,
    ),
    "vw_product_performance": View(
        performance.product_performance,
        [
            "order_id", "customer_unique_id", "product_category_english", "price", "freight_value",
            "review_score",
        ],
        by_order=True,
    ),
    "vw_seller_performance": View(
        performance.seller_performance,
        [
            "order_id", "seller_id", "seller_city", "seller_state", "price", "review_score",
            "delivery_days", "delivery_status",
        ],
    ),
    "vw_state_performance": View(
        performance.state_performance,
        [
            "order_id", "customer_unique_id", "customer_state", "total_item_value", "review_score",
            "delivery_days", "delivery_status",
        ],
        by_order=True,
    ),
    "vw_new_vs_returning": View(customers.new_vs_returning, _MONTH),
    "vw_data_quality": View(
        performance.data_quality,
        ["customer_unique_id", "order_purchase_timestamp", "product_category_english"],
        by_order=True,
    ),
}
PAYMENT_VIEW = "vw_payment_analysis"

# Order in which the rows of a view are shown and written; "-" means descending.
# Columns after the first ones only break ties.
VIEW_ORDER = {
    "vw_cohort_retention": ["cohort_month", "month_number"],
    "vw_monthly_kpis": ["purchase_month", "year_month"],
    "vw_product_performance": ["-revenue", "category"],
    "vw_seller_performance": ["-revenue", "seller_id", "seller_city", "seller_state"],
    "vw_state_performance": ["-gmv", "customer_state"],
    "vw_new_vs_returning": ["purchase_month", "customer_type"],
    "vw_payment_analysis": ["-total_paid", "payment_type"],
}


def build_view(name: str, star: StarSchema, count_customers: bool = True) -> DataFrame:
    """A view from the star schema, joining and reading only what it needs.

    Without ``count_customers``, the monthly and category views leave out their number of
    customers and with it the join with the customer table.
    """
    if name == PAYMENT_VIEW:
        return performance.payment_analysis(star.payments)
    view = VIEWS[name]
    columns = [c for c in view.columns if count_customers or c != performance.CUSTOMER]
    of_customer = [c for c in columns if c in CUSTOMER_COLUMNS]
    if not (view.by_order and of_customer):
        return view.build(order_fact(star, columns))
    narrow = star.narrowed([*columns, ACCOUNT])
    known = narrow.customers.select(ACCOUNT, *of_customer)

    def with_customers(rows: DataFrame) -> DataFrame:
        return lookup_join(rows, known, ACCOUNT, counted=star.key_rows(ACCOUNT))

    columns = [*[c for c in columns if c not in of_customer], ACCOUNT]
    return view.build(order_fact(star, columns), with_customers)


def register_views(
    spark: SparkSession, star: StarSchema, fact: DataFrame | None = None, names: list[str] | None = None
) -> list[str]:
    """Register the named views (default: all) for SQL, and return their names.

    With ``fact`` (a stored or cached order fact) the views share it; otherwise each one
    reads the star schema itself. On large input the RFM view searches its tile cuts here,
    so name only the views that are wanted.
    """
    names = names or [*VIEWS, PAYMENT_VIEW]
    if fact is not None:
        fact = fact.select(*[c for c in FACT_COLUMNS if c in fact.columns])  # stored ones end with the folder's column
    for name in names:
        shared = fact is not None and name != PAYMENT_VIEW
        df = VIEWS[name].build(fact) if shared else build_view(name, star)
        df.createOrReplaceTempView(name)
    return names


def cache_views(spark: SparkSession, names: list[str]) -> None:
    """Keep results of registered views; computed on first use, spilled to disk if large."""
    for name in names:
        spark.sql(f"CACHE LAZY TABLE {name} OPTIONS ('storageLevel' 'MEMORY_AND_DISK')")


def refresh_views(
    spark: SparkSession, star: StarSchema, fact: DataFrame | None = None, names: list[str] | None = None
) -> list[str]:
    """Drop kept results and define the views anew over freshly read tables."""
    for name in names or [*VIEWS, PAYMENT_VIEW]:
        spark.sql(f"UNCACHE TABLE IF EXISTS {name}")
    return register_views(spark, star, fact, names)
