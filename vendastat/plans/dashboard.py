"""All reports by name, from the star schema to the finished table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vendastat.operators.sampling import fixed_sample
from vendastat.plans import reports
from vendastat.plans.catalog import build_view
from vendastat.plans.customers import customer_count
from vendastat.schemas import StarSchema

# Size and seed of the customer sample.
SAMPLE_SIZE = 3000
SAMPLE_SEED = 42

Report = Callable[[StarSchema, int], DataFrame]


def _months(star: StarSchema, min_orders: int) -> DataFrame:
    return reports.eligible_months(build_view("vw_monthly_kpis", star, count_customers=False), min_orders)


def _of_months(report: Callable[[DataFrame], DataFrame]) -> Report:
    return lambda star, min_orders: report(_months(star, min_orders))


def _of_view(view: str, report: Callable[[DataFrame], DataFrame], count_customers: bool = True) -> Report:
    return lambda star, min_orders: report(build_view(view, star, count_customers))


def _of_rfm(report: Callable[[DataFrame], DataFrame]) -> Report:
    return _of_view("vw_rfm_segments", report)


REPORTS: dict[str, Report] = {
    # months
    "eligible_months": lambda star, n: reports.eligible_months(build_view("vw_monthly_kpis", star), n),
    "gmv_mom_change": _of_months(
        lambda m: reports.gmv_change(m).select(
            "purchase_month", "year_month", "gmv", "previous_gmv", "gmv_change_pct"
        )
    ),
    "executive_kpis": lambda star, n: reports.executive_kpis(_months(star, n), customer_count(star), n),
    "business_health": lambda star, n: reports.business_health(_months(star, n), customer_count(star)),
    "delivery_kpis": _of_months(reports.delivery_kpis),
    "status_by_month": _of_months(reports.status_by_month),
    # segments
    "rfm_segment_summary": _of_rfm(reports.segment_summary),
    "rfm_segment_map": _of_rfm(reports.segment_map),
    "rfm_segment_revenue": _of_rfm(reports.segment_revenue),
    "rfm_kpis": _of_rfm(lambda rfm: reports.rfm_kpis(reports.segment_summary(rfm))),
    "rfm_sample": _of_rfm(lambda rfm: fixed_sample(rfm, "customer_unique_id", SAMPLE_SIZE, SAMPLE_SEED)),
    # cohorts
    "retention_m1_m3": _of_view("vw_cohort_retention", reports.retention_kpis),
    "cohort_first6_curves": _of_view("vw_cohort_retention", reports.retention_curves),
    "cohort_matrix": _of_view("vw_cohort_retention", reports.cohort_matrix),
    # categories
    "top_categories": _of_view("vw_product_performance", reports.top_categories),
    "leading_categories": _of_view("vw_product_performance", reports.leading_categories, count_customers=False),
    "product_kpis": _of_view("vw_product_performance", reports.product_kpis, count_customers=False),
    # sellers
    "top_sellers": _of_view("vw_seller_performance", reports.top_sellers),
    "sellers_to_review": _of_view(
        "vw_seller_performance", lambda s: reports.sellers_to_review(reports.flag_sellers(reports.top_sellers(s)))
    ),
    "seller_kpis": _of_view("vw_seller_performance", reports.seller_kpis),
    "status_by_seller": _of_view("vw_seller_performance", reports.status_by_seller),
    # states
    "geo_kpis": _of_view("vw_state_performance", reports.geo_kpis),
    # new versus returning
    "new_returning_kpis": _of_view("vw_new_vs_returning", reports.new_returning_kpis),
    "returning_share_by_month": _of_view("vw_new_vs_returning", reports.returning_share_by_month),
}


# Order of the reports that are lists, as in ``catalog.VIEW_ORDER``.
REPORT_ORDER = {
    "eligible_months": ["purchase_month", "year_month"],
    "gmv_mom_change": ["purchase_month", "year_month"],
    "status_by_month": ["purchase_month", "year_month"],
    "rfm_segment_summary": ["-total_revenue", "rfm_segment"],
    "rfm_segment_revenue": ["-total_revenue", "rfm_segment"],
    "rfm_segment_map": ["-customers", "rfm_segment"],
    "cohort_first6_curves": ["cohort_month", "month_number"],
    "cohort_matrix": ["cohort_month"],
    "top_categories": ["-revenue", "category"],
    "leading_categories": ["-revenue", "category"],
    "top_sellers": ["-revenue", "seller_id", "seller_city", "seller_state"],
    "sellers_to_review": ["-revenue", "seller_id", "seller_city", "seller_state"],
    "returning_share_by_month": ["purchase_month"],
}


def build_report(name: str, star: StarSchema, min_orders: int = reports.MIN_MONTHLY_ORDERS) -> DataFrame:
    """A report from the star schema; ``min_orders`` is the limit for a month to be counted."""
    return REPORTS[name](star, min_orders)
