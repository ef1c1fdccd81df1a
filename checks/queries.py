"""Every operator as a query over the generic retail tables.

Results are made comparable across engines at the very end only: decimals become doubles,
and means of inexact values are rounded to six places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.brief_documents import BRIEF_DOCUMENT, CHANGED_DOCUMENT
from vendastat.functions.numeric import coerce_numeric, normalize_percent, rounded
from vendastat.operators.ranks import global_places
from vendastat.operators.sampling import fixed_sample
from vendastat.plans import briefs, customers, orders, published, reports
from vendastat.plans.catalog import VIEW_ORDER, VIEWS, build_view, register_views
from vendastat.plans.dashboard import REPORT_ORDER, REPORTS, SAMPLE_SEED, build_report
from vendastat.plans.fact import DELIVERED, order_fact
from vendastat.session import shared_folder
from vendastat.sources.retail import RetailStar, payments, reviews
from vendastat.sources.sinks import json_payload, read_csv, read_documents, sort_columns, write_csv, write_documents
from vendastat.sources.tables import list_tables, register_tables, run_query, table_inventory

Query = Callable[[SparkSession, str], DataFrame]

# Gives both kept and dropped months at the scale the results are compared at.
MIN_ORDERS = 60
# Less than the number of customers at that scale.
SMALL_SAMPLE = 300
# Less than the number of customers at that scale, so that the search for tiles narrows; and so few
# that what is left is longer than the sample and ranked by ranges.
SEARCH_SAMPLE = 200
# Text that needs care in a CSV field, by the number of orders.
AWKWARD_NOTE = """case orders % 7 when 0 then 'plain' when 1 then 'a, b' when 2 then 'say "yes"' when 3 then 'two
lines' when 4 then '' when 5 then null else ' "quoted, and
more", back\\\\slash ' end"""
# Views with a declared order, and what tells their rows apart.
ORDERED_VIEWS = {
    "vw_cohort_retention": ["cohort_month", "month_number"],
    "vw_monthly_kpis": ["purchase_month"],
    "vw_state_performance": ["customer_state"],
    "vw_new_vs_returning": ["purchase_month", "customer_type"],
    "vw_payment_analysis": ["payment_type"],
}
GROWING_VIEWS = {"vw_product_performance": ["category"], "vw_seller_performance": ["seller_id"]}
INPUT_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def comparable(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Decimals as doubles; with ``digits``, columns that were doubles before are rounded."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    if digits is not None:
        df = rounded(df, dict.fromkeys(doubles, digits))
    return df.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else df


def star(spark: SparkSession, folder: str) -> RetailStar:
    return RetailStar(spark, folder, DELIVERED)


def view(name: str, digits: int | None = None) -> Query:
    return lambda spark, folder: comparable(build_view(name, star(spark, folder)), digits)


def report(name: str, digits: int | None = None) -> Query:
    return lambda spark, folder: comparable(build_report(name, star(spark, folder), MIN_ORDERS), digits)


def display(name: str, digits: str | None = None) -> Query:
    """A bundle rounded the way it is shown; maps as JSON text, since they cannot be compared."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        shown = reports.for_display(build_report(name, star(spark, folder), MIN_ORDERS), digits or name)
        maps = [f.name for f in shown.schema.fields if isinstance(f.dataType, T.MapType)]
        two = {"segment_revenue", "segment_revenue_share_pct"}
        as_text = {
            m: F.to_json(F.transform_values(m, lambda _, v: v.cast("decimal(38,2)")) if m in two else F.col(m)) for m in maps
        }
        return comparable(shown.withColumns(as_text) if maps else shown)

    return run


def rfm_distributed(high_is_good: bool, **options) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        metrics = build_view("vw_customer_metrics", star(spark, folder))
        return comparable(customers.rfm_segments(metrics, high_is_good, distributed=True, **options))

    return run


def monthly_by_sql(spark: SparkSession, folder: str) -> DataFrame:
    """Registered views queried as SQL text with a bound parameter."""
    register_views(spark, star(spark, folder), names=["vw_monthly_kpis"])
    query = "SELECT * FROM vw_monthly_kpis WHERE total_orders >= :min_orders ORDER BY purchase_month"
    return comparable(run_query(spark, query, {"min_orders": MIN_ORDERS}), 6)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in INPUT_TABLES}
    return table_inventory(tables).orderBy("table_name")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of a database made of the input files, with the rows of each."""
    database = "vendastat_inputs"
    register_tables(spark, database, {name: f"{folder}/{name}.parquet" for name in INPUT_TABLES})
    names = [r["table_name"] for r in list_tables(spark, database).collect()]
    return table_inventory({name: spark.table(f"{database}.{name}") for name in names}).orderBy("table_name")


def payments_as_text(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts of failed payments carry a currency code, so they are not numbers."""
    text = F.expr(
        "cast(payment_value as string) || case when payment_type = 'error' then ' BRL' else '' end"
    )
    typed = payments(spark, folder).select("order_id", "payment_type", text.alias("amount_text"))
    return coerce_numeric(typed.withColumn("amount", F.col("amount_text")), "amount")


def on_time_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The same figure stored as a 0-1 share and as a percentage."""
    frame = build_view("vw_seller_performance", star(spark, folder)).select(
        "seller_id", F.col("on_time_pct").alias("from_pct"), (F.col("on_time_pct") / 100).alias("from_share")
    )
    return comparable(normalize_percent(frame, "from_pct", "from_share"), 6)


def small_sample(spark: SparkSession, folder: str) -> DataFrame:
    rfm = build_view("vw_rfm_segments", star(spark, folder))
    return comparable(fixed_sample(rfm, "customer_unique_id", SMALL_SAMPLE, SAMPLE_SEED))


def all_flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Sellers to review among all of them, not only those with the most revenue."""
    sellers = reports.top_sellers(build_view("vw_seller_performance", star(spark, folder)), None)
    flagged = reports.flag_sellers(sellers).where("needs_review")
    return flagged.select("seller_id")


def rfm_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The per-segment maps as JSON text, since map columns cannot be compared."""
    bundle = build_report("rfm_kpis", star(spark, folder))
    return comparable(
        bundle.withColumns({
            "segment_customer_counts": F.to_json("segment_customer_counts"),
            "segment_revenue": F.to_json("segment_revenue"),
            "segment_revenue_share_pct": F.to_json(
                F.transform_values("segment_revenue_share_pct", lambda _, v: v.cast("decimal(5,2)"))
            ),
        }),
        6,
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One brief document per seller, some of them with planted defects."""
    sellers = build_view("vw_seller_performance", star(spark, folder))
    return sellers.select("seller_id", F.expr(BRIEF_DOCUMENT).alias("document"))


def validated(spark: SparkSession, folder: str) -> DataFrame:
    checked = briefs.validate_briefs_strictly(documents(spark, folder))
    return checked.select("seller_id", "is_valid", "error", "error_detail", "is_strict")


def broken(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule that a document breaks; one change planted in each."""
    sellers = build_view("vw_seller_performance", star(spark, folder))
    changed = sellers.select("seller_id", F.expr(CHANGED_DOCUMENT).alias("document"))
    return briefs.broken_paths(changed).select("seller_id", F.array_join("broken", "|").alias("broken"))


def rendered(spark: SparkSession, folder: str) -> DataFrame:
    accepted, _ = briefs.split_briefs(briefs.validate_briefs(documents(spark, folder)))
    named = briefs.parse_briefs(accepted).withColumns({
        "rule_status": F.lit("Stable"),
        "audience": F.lit("Operations"),
        "context": F.concat(F.lit("Seller "), F.col("seller_id")),
    })
    out = briefs.render_markdown(named, "rule_status", "audience", "context")
    return out.select("seller_id", "markdown")


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Typed fields of every document, NULL where it cannot be read."""
    brief = F.col("brief")
    return briefs.parse_briefs(documents(spark, folder)).select(
        "seller_id",
        brief["status"].alias("status"),
        brief["headline"].alias("headline"),
        F.array_size(brief["findings"]).cast("bigint").alias("findings"),
        F.array_join(brief["risks"], "|").alias("risks"),
        F.array_join(
            F.transform(briefs.actions_by_priority(brief["actions"]), lambda a: a["action"]), "|"
        ).alias("actions"),
    )


def published_views(name: str, digits: int | None = None) -> Query:
    """A lasting view of a database, read by a second session."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        database = f"vendastat_{uuid.uuid4().hex[:8]}"
        published.publish(spark, star(spark, folder), database)
        return comparable(spark.newSession().table(f"{database}.{name}"), digits)

    return run


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Fields with quotes, commas and line breaks, written as CSV and read back."""
    states = build_view("vw_state_performance", star(spark, folder))
    awkward = states.select("customer_state", "orders", "gmv", F.expr(AWKWARD_NOTE).alias("note"))
    path = f"{shared_folder(spark)}/vendastat/csv-{uuid.uuid4().hex}"
    write_csv(awkward, path, order=["-gmv", "customer_state"])
    return comparable(read_csv(spark, path, awkward.schema))


def document_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered documents, written as JSON lines and read back."""
    path = f"{shared_folder(spark)}/vendastat/documents-{uuid.uuid4().hex}"
    documents = rendered(spark, folder)
    write_documents(documents, path, "seller_id")
    return read_documents(spark, path, documents.schema)


def state_payload(spark: SparkSession, folder: str) -> DataFrame:
    states = build_view("vw_state_performance", star(spark, folder))
    return json_payload(states.select("customer_state", "orders", "customers", "gmv"))


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    retention = build_view("vw_cohort_retention", star(spark, folder))
    return comparable(reports.cohort_matrix(retention))


def payments_reduced(spark: SparkSession, folder: str) -> DataFrame:
    return comparable(orders.payments_per_order(payments(spark, folder)))


def reviews_reduced(spark: SparkSession, folder: str) -> DataFrame:
    return comparable(orders.reviews_per_order(reviews(spark, folder)), 6)


def fact_from_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered items with payments and reviews reduced from the raw tables."""
    columns = ["order_id", "order_item_id", "product_id", "price", "review_score", *orders.OF_PAYMENTS]
    return comparable(order_fact(RetailStar(spark, folder, DELIVERED, raw=True), columns), 6)


def ordered_at_any_size(name: str, keys: list[str]) -> Query:
    """The same for views that grow with the data: places by ranges of the order."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = build_view(name, star(spark, folder))
        order = VIEW_ORDER[name]
        return global_places(rows.select(*{*keys, *(c.lstrip("-") for c in order)}), sort_columns(order)).select(
            *keys, F.col("place").cast("int").alias("place")
        )

    return run


def ordered(name: str, keys: list[str], order: list[str], build: Callable) -> Query:
    """Keys of a view or report with the place each row has in its declared order."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*sort_columns(order)))
        return build(name, star(spark, folder)).select(*keys, place.alias("place"))

    return run


# Reports with means of inexact values.
INEXACT = {
    "eligible_months", "gmv_mom_change", "executive_kpis", "business_health", "delivery_kpis",
    "status_by_month", "rfm_segment_summary", "product_kpis", "seller_kpis", "geo_kpis",
    "new_returning_kpis", "returning_share_by_month",
}

QUERIES: dict[str, Query] = {
    **{name.removeprefix("vw_"): view(name, 6 if name == "vw_monthly_kpis" else None) for name in VIEWS},
    "payment_analysis": view("vw_payment_analysis"),
    "rfm_segments_distributed": rfm_distributed(high_is_good=False),
    "rfm_segments_high_is_good": rfm_distributed(high_is_good=True),
    "rfm_segments_searched": rfm_distributed(high_is_good=False, sample_rows=SEARCH_SAMPLE),
    "order_payments_reduced": payments_reduced,
    "order_reviews_reduced": reviews_reduced,
    "order_fact_from_raw": fact_from_raw,
    **{name: report(name, 6 if name in INEXACT else None) for name in REPORTS},
    "rfm_kpis": rfm_bundle,
    "rfm_sample_small": small_sample,
    "all_flagged_sellers": all_flagged,
    "cohort_matrix": matrix,
    "executive_display": display("executive_kpis"),
    "new_returning_display": display("new_returning_kpis"),
    "rfm_display": display("rfm_kpis"),
    "retention_display": display("retention_m1_m3", "retention_kpis"),
    "product_display": display("product_kpis"),
    "seller_display": display("seller_kpis"),
    "geo_display": display("geo_kpis"),
    "business_health_display": display("business_health"),
    "delivery_display": display("delivery_kpis"),
    "eligible_months_by_sql": monthly_by_sql,
    "percent_normalize": on_time_shares,
    "numeric_coercion": payments_as_text,
    "state_payload_json": state_payload,
    "brief_parse": parsed,
    "brief_validation": validated,
    "brief_broken_paths": broken,
    "brief_markdown": rendered,
    "published_monthly_kpis": published_views("vw_monthly_kpis", 6),
    "published_rfm_segments": published_views("vw_rfm_segments"),
    "csv_round_trip": csv_round_trip,
    "document_round_trip": document_round_trip,
    "list_tables": listed,
    "table_inventory": inventory,
    **{
        f"ordered_{name.removeprefix('vw_')}": ordered(name, keys, VIEW_ORDER[name], build_view)
        for name, keys in ORDERED_VIEWS.items()
    },
    **{f"ordered_{name.removeprefix('vw_')}": ordered_at_any_size(name, keys) for name, keys in GROWING_VIEWS.items()},
    **{
        f"ordered_{name}": ordered(name, ["rfm_segment"], REPORT_ORDER[name], build_report)
        for name in ("rfm_segment_summary", "rfm_segment_map")
    },
}
