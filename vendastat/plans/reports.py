"""Second-stage reports on top of the views: rankings, pivots, flags and KPI bundles.

The inputs are report tables (months, categories, sellers, states, segments), so windows
over all their rows are small. Anything that can grow with the data is cut to its top rows
first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendastat.functions.numeric import (
    coerce_numeric,
    exact_mean,
    normalize_percent,
    pct_change,
    rounded,
    share_pct,
    weighted_mean,
    weighted_mean_all,
)
from vendastat.functions.rules import ON_TIME_TARGET, RATING_TARGET, health_status, needs_review
from vendastat.session import materialize

# Default limits of the reports.
MIN_MONTHLY_ORDERS = 100
TOP_CATEGORIES = 30
TOP_SELLERS = 50
SELLERS_TO_REVIEW = 20
LEADING_CATEGORIES = 5
COMPARED_COHORTS = 6

# Decimals each bundle shows.
DISPLAY_DIGITS = {
    "executive_kpis": {
        "total_gmv": 2,
        "weighted_average_order_value": 2,
        "weighted_average_review_score": 3,
        "weighted_on_time_pct": 3,
        "latest_vs_previous_gmv_pct": 2,
    },
    "rfm_kpis": {"top_segment_revenue_share_pct": 2},
    "retention_kpis": {"month_1_average_retention_pct": 2, "month_3_average_retention_pct": 2},
    "product_kpis": {
        "top_category_revenue": 2,
        "top_5_revenue_share_of_loaded_categories_pct": 2,
        "top_5_average_rating": 2,
    },
    "seller_kpis": {
        "flagged_seller_revenue": 2,
        "top_seller_revenue": 2,
        "top_seller_on_time_pct": 2,
        "top_seller_rating": 2,
    },
    "geo_kpis": {"highest_gmv": 2, "lowest_on_time_pct": 2, "overall_state_gmv": 2},
    "new_returning_kpis": {
        "total_revenue": 2,
        "new_revenue": 2,
        "returning_revenue": 2,
        "returning_revenue_share_pct": 2,
    },
    "business_health": {"gmv": 2, "weighted_aov": 2, "weighted_on_time_pct": 2},
    "delivery_kpis": {"weighted_on_time_pct": 2, "weighted_delivery_days": 2},
}

SELLER_KEYS = ["seller_id", "seller_city", "seller_state"]


def _everything() -> Window:
    return Window.partitionBy(F.lit(0))


def _ascending(names: list[str]) -> list[Column]:
    return [F.asc_nulls_last(n) for n in names]


def for_display(bundle: DataFrame, report: str) -> DataFrame:
    """A bundle rounded the way it is shown."""
    return rounded(bundle, DISPLAY_DIGITS[report])


# Months -------------------------------------------------------------------------------


def eligible_months(monthly: DataFrame, min_orders: int = MIN_MONTHLY_ORDERS) -> DataFrame:
    """Months with enough orders, the on-time share on a 0-100 scale."""
    monthly = normalize_percent(coerce_numeric(monthly, "avg_review_score"), "on_time_pct", small=True)
    return monthly.where(F.col("total_orders") >= min_orders)


def gmv_change(months: DataFrame) -> DataFrame:
    """Each eligible month with the previous eligible one and the GMV change in percent."""
    previous = F.lag("gmv").over(_everything().orderBy(*_ascending(["purchase_month", "year_month"])))
    return months.withColumn("previous_gmv", previous).withColumn(
        "gmv_change_pct", pct_change(F.col("gmv"), F.col("previous_gmv"))
    )


def _latest(value: str) -> Column:
    """Value in the last month of the order; an unknown month sorts last."""
    month = F.col("purchase_month")
    return F.max_by(value, F.struct(month.isNull(), month, F.col("year_month")))


def executive_kpis(months: DataFrame, customers: Column, min_orders: int = MIN_MONTHLY_ORDERS) -> DataFrame:
    """Totals and order-weighted means over the eligible months; no row if there are none.

    ``customers`` is the number of customers of the whole fact, not of the eligible months.
    """
    orders = F.col("total_orders")
    bundle = gmv_change(months).agg(
        F.count("*").alias("eligible_months"),
        F.lit(min_orders).alias("minimum_monthly_orders_filter"),
        F.sum("gmv").alias("total_gmv"),
        F.sum("total_orders").alias("total_orders"),
        F.try_divide(F.sum("gmv").cast("double"), F.sum("total_orders")).alias("weighted_average_order_value"),
        weighted_mean(F.col("avg_review_score"), orders).alias("weighted_average_review_score"),
        weighted_mean(F.col("on_time_pct"), orders).alias("weighted_on_time_pct"),
        _latest("year_month").alias("latest_eligible_month"),
        _latest("gmv_change_pct").alias("latest_vs_previous_gmv_pct"),
    )
    status = health_status(F.col("weighted_on_time_pct"), F.col("weighted_average_review_score"))
    return bundle.where("eligible_months > 0").withColumns({"unique_customers": customers, "status": status})


def business_health(months: DataFrame, customers: Column) -> DataFrame:
    """Headline figures over the eligible months."""
    return months.agg(
        F.sum("gmv").alias("gmv"),
        F.sum("total_orders").alias("orders"),
        F.try_divide(F.sum("gmv").cast("double"), F.sum("total_orders")).alias("weighted_aov"),
        weighted_mean_all(F.col("on_time_pct"), F.col("total_orders")).alias("weighted_on_time_pct"),
    ).withColumn("customers", customers)


def delivery_kpis(months: DataFrame) -> DataFrame:
    """Order-weighted on-time share and delivery days; NULL if a month has no value."""
    return months.agg(
        weighted_mean_all(F.col("on_time_pct"), F.col("total_orders")).alias("weighted_on_time_pct"),
        weighted_mean_all(F.col("avg_delivery_days"), F.col("total_orders")).alias("weighted_delivery_days"),
    )


def status_by_month(months: DataFrame) -> DataFrame:
    return months.select(
        "purchase_month",
        "year_month",
        "on_time_pct",
        "avg_review_score",
        health_status(F.col("on_time_pct"), F.col("avg_review_score")).alias("status"),
    )


# Segments -----------------------------------------------------------------------------


def segment_summary(rfm: DataFrame) -> DataFrame:
    """Customers, revenue, means and revenue share per segment."""
    segments = rfm.groupBy("rfm_segment").agg(
        F.count("customer_unique_id").alias("customers"),
        F.sum("total_revenue").alias("total_revenue"),
        exact_mean(F.col("total_revenue")).alias("avg_revenue"),
        F.avg("total_orders").alias("avg_orders"),
    )
    share = share_pct(F.col("total_revenue"), F.sum("total_revenue").over(_everything()))
    return segments.withColumn("revenue_share_pct", F.coalesce(share, F.lit(0.0)))


def segment_revenue(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("rfm_segment").agg(F.sum("total_revenue").alias("total_revenue"))


def segment_map(rfm: DataFrame) -> DataFrame:
    """Customers per segment, one row per entry of the map."""
    return rfm.groupBy("rfm_segment").agg(F.count("*").alias("customers"))


def rfm_kpis(segments: DataFrame) -> DataFrame:
    """One row: totals, per-segment maps, and the segment with the most revenue."""

    def by_segment(value: Column) -> Column:
        entries = F.sort_array(F.collect_list(F.struct(F.col("rfm_segment"), value)))
        return F.map_from_entries(entries)

    leader = F.struct(F.col("total_revenue"), F.col("rfm_segment"))
    return segments.agg(
        F.sum("customers").alias("customers_analyzed"),
        by_segment(F.col("customers")).alias("segment_customer_counts"),
        by_segment(F.round("total_revenue", 2)).alias("segment_revenue"),
        by_segment(F.round("revenue_share_pct", 2)).alias("segment_revenue_share_pct"),
        F.max_by("rfm_segment", leader).alias("top_segment_by_revenue"),
        F.max_by("revenue_share_pct", leader).alias("top_segment_revenue_share_pct"),
    )


# Cohorts ------------------------------------------------------------------------------


def retention_kpis(retention: DataFrame) -> DataFrame:
    """Plain means of the month-1 and month-3 rates, over the cohorts that have such a row."""

    def at(month: int) -> Column:
        return exact_mean(F.when(F.col("month_number") == month, F.col("retention_rate")))

    return retention.agg(
        at(1).alias("month_1_average_retention_pct"),
        at(3).alias("month_3_average_retention_pct"),
        F.count_distinct("cohort_month").alias("cohorts_analyzed"),
    ).withColumn("status", health_status(m1_retention=F.col("month_1_average_retention_pct")))


def retention_curves(retention: DataFrame, cohorts: list | None = None) -> DataFrame:
    """Rows of the chosen cohorts, by default the first six."""
    if cohorts is not None:
        return retention.where(F.col("cohort_month").isin(cohorts))
    number = F.dense_rank().over(_everything().orderBy("cohort_month"))
    return retention.withColumn("_n", number).where(F.col("_n") <= COMPARED_COHORTS).drop("_n")


def cohort_matrix(retention: DataFrame, months: int | None = None) -> DataFrame:
    """Retention rates with one row per cohort and columns ``m0 .. m<months>``.

    Cells without a row stay NULL. Without ``months`` the retention table is stored, the largest
    month number is read from there, and the stored rows are pivoted, so that the input is computed
    once. With ``months``, a month number above it is an error, never left out.
    """
    if months is None:
        retention = materialize(retention, "retention")
        months = retention.agg(F.max("month_number")).first()[0] or 0
    beyond = F.raise_error(F.concat(F.lit(f"month number above {months}: "), F.col("month_number").cast("string")))
    # The error is of the grouped column, so that it is raised in the same pass.
    cohort = F.when(F.col("month_number") > months, beyond.cast(retention.schema["cohort_month"].dataType))
    retention = retention.withColumn("cohort_month", cohort.otherwise(F.col("cohort_month")))
    wide = retention.groupBy("cohort_month").pivot("month_number", list(range(months + 1)))
    return wide.agg(F.first("retention_rate")).withColumnsRenamed({str(m): f"m{m}" for m in range(months + 1)})


# Categories ---------------------------------------------------------------------------


def top_categories(products: DataFrame, n: int | None = TOP_CATEGORIES) -> DataFrame:
    """Categories with the most revenue; all of them, in any order, if ``n`` is None."""
    if n is None:
        return products
    return products.orderBy(F.desc_nulls_first("revenue"), F.asc_nulls_last("category")).limit(n)


def product_kpis(products: DataFrame, n: int | None = TOP_CATEGORIES) -> DataFrame:
    """Leader and top-5 figures of the loaded categories: the first ``n``, or all if None."""
    place = F.row_number().over(
        _everything().orderBy(F.desc_nulls_first("revenue"), F.asc_nulls_last("category"))
    )
    leading = F.col("place") <= LEADING_CATEGORIES
    share = share_pct(F.sum(F.when(leading, F.col("revenue"))), F.sum("revenue"))
    return (
        top_categories(products, n)
        .withColumn("place", place)
        .agg(
            F.count("*").alias("categories_loaded"),
            F.min_by("category", "place").alias("top_category"),
            F.min_by("revenue", "place").alias("top_category_revenue"),
            F.coalesce(share, F.lit(0.0)).alias("top_5_revenue_share_of_loaded_categories_pct"),
            F.avg(F.when(leading, F.col("avg_rating"))).alias("top_5_average_rating"),
        )
    )


def leading_categories(products: DataFrame) -> DataFrame:
    return top_categories(products, LEADING_CATEGORIES).select("category", "revenue", "avg_rating")


# Sellers ------------------------------------------------------------------------------


def top_sellers(sellers: DataFrame, n: int | None = TOP_SELLERS) -> DataFrame:
    """Sellers with the most revenue, the on-time share on a 0-100 scale.

    All sellers, in any order, if ``n`` is None.
    """
    if n is None:
        return normalize_percent(sellers, "on_time_pct")
    top = sellers.orderBy(F.desc_nulls_first("revenue"), *_ascending(SELLER_KEYS)).limit(n)
    return normalize_percent(top, "on_time_pct", small=True)


def flag_sellers(
    sellers: DataFrame, on_time_target: float = ON_TIME_TARGET, rating_target: float = RATING_TARGET
) -> DataFrame:
    flag = needs_review(F.col("on_time_pct"), F.col("avg_rating"), on_time_target, rating_target)
    return sellers.withColumn("needs_review", flag)


def sellers_to_review(flagged: DataFrame, n: int = SELLERS_TO_REVIEW) -> DataFrame:
    """Flagged sellers with the most revenue."""
    by_revenue = [F.desc_nulls_last("revenue"), *_ascending(SELLER_KEYS)]
    return flagged.where("needs_review").orderBy(*by_revenue).limit(n)


def seller_kpis(
    sellers: DataFrame, on_time_target: float = ON_TIME_TARGET, rating_target: float = RATING_TARGET
) -> DataFrame:
    """Flag count over the loaded sellers, revenue of the listed ones, and the leader's figures."""
    loaded = flag_sellers(top_sellers(sellers), on_time_target, rating_target)
    keys = _ascending(SELLER_KEYS)
    place = F.row_number().over(_everything().orderBy(F.desc_nulls_first("revenue"), *keys))
    review_place = F.row_number().over(
        _everything().orderBy(F.desc("needs_review"), F.desc_nulls_last("revenue"), *keys)
    )
    listed = F.col("needs_review") & (F.col("review_place") <= SELLERS_TO_REVIEW)
    zero = F.lit(0).cast(sellers.schema["revenue"].dataType)
    return (
        loaded.withColumns({"place": place, "review_place": review_place})
        .agg(
            F.count("*").alias("sellers_loaded"),
            F.lit(float(on_time_target)).alias("on_time_target_pct"),
            F.lit(float(rating_target)).alias("good_rating_target"),
            F.count_if("needs_review").alias("sellers_flagged_for_review"),
            F.coalesce(F.sum(F.when(listed, F.col("revenue"))), zero).alias("flagged_seller_revenue"),
            F.min_by("revenue", "place").alias("top_seller_revenue"),
            F.min_by("on_time_pct", "place").alias("top_seller_on_time_pct"),
            F.min_by("avg_rating", "place").alias("top_seller_rating"),
        )
    )


def status_by_seller(sellers: DataFrame) -> DataFrame:
    status = health_status(F.col("on_time_pct"), F.col("avg_rating"))
    return sellers.select(*SELLER_KEYS, "on_time_pct", "avg_rating", status.alias("status"))


# States -------------------------------------------------------------------------------


def geo_kpis(states: DataFrame) -> DataFrame:
    """State with the highest GMV, state with the lowest on-time share, and the total."""
    states = normalize_percent(states, "on_time_pct", small=True)
    state = F.col("customer_state")
    highest = F.when(F.col("gmv").isNotNull(), F.struct(-F.col("gmv"), state))
    slowest = F.when(F.col("on_time_pct").isNotNull(), F.struct(F.col("on_time_pct"), state))
    return states.agg(
        F.count("*").alias("states_analyzed"),
        F.min_by("customer_state", highest).alias("highest_gmv_state"),
        F.max("gmv").alias("highest_gmv"),
        F.min_by("customer_state", slowest).alias("lowest_on_time_state"),
        F.min("on_time_pct").alias("lowest_on_time_pct"),
        F.sum("gmv").alias("overall_state_gmv"),
    )


# New versus returning -----------------------------------------------------------------


def returning_share_by_month(split: DataFrame) -> DataFrame:
    """Revenue of new and returning customers side by side, 0 where a month lacks one."""
    wide = split.groupBy("purchase_month").pivot("customer_type", ["New", "Returning"]).agg(F.sum("revenue"))
    zero = F.lit(0).cast("decimal(38,4)")
    wide = wide.withColumns({c: F.coalesce(F.col(c), zero) for c in ("New", "Returning")})
    return wide.withColumn(
        "returning_share", share_pct(F.col("Returning"), F.col("Returning") + F.col("New"))
    ).withColumnsRenamed({"New": "new_revenue", "Returning": "returning_revenue"})


def new_returning_kpis(split: DataFrame) -> DataFrame:
    """Total, new and returning revenue, the returning share, and the status it implies."""

    def revenue_of(kind: str) -> Column:
        return F.sum(F.when(F.col("customer_type") == kind, F.col("revenue")).otherwise(0))

    return (
        split.agg(
            F.sum("revenue").alias("total_revenue"),
            revenue_of("New").alias("new_revenue"),
            revenue_of("Returning").alias("returning_revenue"),
        )
        .withColumn("returning_revenue_share_pct", share_pct(F.col("returning_revenue"), F.col("total_revenue")))
        .withColumn("status", health_status(returning_share=F.col("returning_revenue_share_pct")))
    )
