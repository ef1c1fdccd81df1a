import datetime as dt
from decimal import Decimal

import pytest
from conftest import dicts, frame
from pyspark.sql import functions as F

from vendastat.operators.sampling import fixed_sample
from vendastat.plans import reports

D = Decimal
MONTHS = (
    "purchase_month date, year_month string, total_orders bigint, gmv decimal(38,4), "
    "avg_review_score double, avg_delivery_days double, on_time_pct double"
)
SELLERS = "seller_id bigint, seller_city string, seller_state string, revenue decimal(22,2), avg_rating double, on_time_pct double"
NAN = float("nan")


def months(spark, *rows):
    return frame(
        spark,
        [
            (dt.date(2020, m, 1) if m else None, f"2020-{m:02d}" if m else None, n, None if g is None else D(g), *rest)
            for m, n, g, *rest in rows
        ],
        MONTHS,
    )


def executive(spark, *rows, min_orders=1):
    eligible = reports.eligible_months(months(spark, *rows), min_orders)
    return dicts(reports.executive_kpis(eligible, F.lit(7).cast("bigint"), min_orders))


def test_executive_bundle_weights_by_orders(spark):
    (row,) = executive(
        spark, (1, 10, "100", 4.0, 5.0, 80.0), (2, 30, "200", None, 5.0, 100.0), (3, 0, "9", 1.0, 1.0, 1.0)
    )
    assert row["eligible_months"] == 2 and row["total_orders"] == 40 and row["unique_customers"] == 7
    assert row["weighted_average_review_score"] == 4.0  # February has no rating and no say
    assert row["weighted_on_time_pct"] == 95.0
    assert row["latest_eligible_month"] == "2020-02" and row["latest_vs_previous_gmv_pct"] == 100.0
    assert row["status"] == "Strong"


def test_executive_bundle_needs_a_month(spark):
    assert executive(spark, (1, 10, "100", 4.0, 5.0, 80.0), min_orders=100) == []


@pytest.mark.parametrize("previous", ["0", None])
def test_change_needs_a_previous_value(spark, previous):
    (row,) = executive(spark, (1, 10, previous, 4.0, 5.0, 80.0), (2, 10, "5", 4.0, 5.0, 80.0))
    assert row["latest_vs_previous_gmv_pct"] is None
    (row,) = executive(spark, (1, 10, "100", 4.0, 5.0, 80.0))
    assert row["latest_vs_previous_gmv_pct"] is None


def test_change_skips_months_below_the_limit(spark):
    (row,) = executive(
        spark, (1, 10, "100", 4.0, 5.0, 80.0), (2, 1, "1", 4.0, 5.0, 80.0), (3, 10, "150", 4.0, 5.0, 80.0), min_orders=5
    )
    assert row["latest_vs_previous_gmv_pct"] == 50.0


def test_unknown_month_comes_last(spark):
    (row,) = executive(spark, (1, 10, "100", 4.0, 5.0, 80.0), (None, 10, "50", 4.0, 5.0, 80.0))
    assert row["latest_eligible_month"] is None and row["latest_vs_previous_gmv_pct"] == -50.0


def test_shares_are_read_before_the_month_filter(spark):
    # One month dropped by the limit still shows that the column holds percentages.
    rows = [(1, 10, "1", 4.0, 5.0, 0.9), (2, 1, "1", 4.0, 5.0, 90.0)]
    assert dicts(reports.eligible_months(months(spark, *rows), 5))[0]["on_time_pct"] == 0.9
    assert dicts(reports.eligible_months(months(spark, rows[0]), 5))[0]["on_time_pct"] == 90.0


def test_strict_means_need_every_month(spark):
    m = months(spark, (1, 10, "1", 4.0, 5.0, 80.0), (2, 10, "1", 4.0, None, 60.0))
    assert dicts(reports.delivery_kpis(m)) == [{"weighted_on_time_pct": 70.0, "weighted_delivery_days": None}]
    assert dicts(reports.business_health(m, F.lit(1)))[0]["weighted_aov"] == 0.1


def test_segment_shares(spark):
    ddl = "customer_unique_id string, rfm_segment string, total_revenue decimal(20,2), total_orders bigint"
    rows = [("a", "X", D(30), 1), ("b", "X", D(30), 3), ("c", "Y", D(40), 2)]
    summary = reports.segment_summary(frame(spark, rows, ddl))
    got = {r["rfm_segment"]: (r["customers"], r["avg_revenue"], r["avg_orders"], r["revenue_share_pct"]) for r in dicts(summary)}
    assert got == {"X": (2, 30.0, 2.0, 60.0), "Y": (1, 40.0, 2.0, 40.0)}
    bundle = dicts(reports.rfm_kpis(summary))[0]
    assert bundle["segment_customer_counts"] == {"X": 2, "Y": 1} and bundle["top_segment_by_revenue"] == "X"
    zero = frame(spark, [("a", "X", D(0), 1)], ddl)
    assert dicts(reports.segment_summary(zero))[0]["revenue_share_pct"] == 0.0


def retention(spark, rows):
    return frame(
        spark,
        [(dt.date(2020, c, 1), m, 1, 1, D(r)) for c, m, r in rows],
        "cohort_month date, month_number int, active_customers bigint, cohort_size bigint, retention_rate decimal(7,2)",
    )


def test_retention_means_skip_cohorts_without_row(spark):
    df = retention(spark, [(1, 0, "100"), (1, 1, "30"), (2, 0, "100"), (2, 1, "20"), (3, 0, "100")])
    assert dicts(reports.retention_kpis(df)) == [
        {
            "month_1_average_retention_pct": 25.0,
            "month_3_average_retention_pct": None,
            "cohorts_analyzed": 3,
            "status": "Strong",
        }
    ]


def test_curves_and_matrix(spark):
    df = retention(spark, [(c, 0, "100") for c in range(1, 9)] + [(1, 2, "50")])
    assert reports.retention_curves(df).select("cohort_month").distinct().count() == 6
    assert reports.retention_curves(df, [dt.date(2020, 8, 1)]).count() == 1
    matrix = reports.cohort_matrix(df)
    assert matrix.columns == ["cohort_month", "m0", "m1", "m2"]
    assert tuple(matrix.orderBy("cohort_month").first())[1:] == (D(100), None, D(50))


def test_category_bundle(spark):
    ddl = "category string, revenue decimal(22,2), avg_rating double"
    rows = [(f"c{i:02d}", D(i), float(i % 5)) for i in range(1, 41)]
    (row,) = dicts(reports.product_kpis(frame(spark, rows, ddl)))
    assert row["categories_loaded"] == 30 and row["top_category"] == "c40"
    assert row["top_5_revenue_share_of_loaded_categories_pct"] == pytest.approx(190 / sum(range(11, 41)) * 100)
    assert row["top_5_average_rating"] == 2.0
    (empty,) = dicts(reports.product_kpis(frame(spark, [], ddl)))
    assert empty["top_5_revenue_share_of_loaded_categories_pct"] == 0.0 and empty["top_category"] is None


def test_seller_bundle_lists_at_most_twenty(spark):
    rows = [(i, "t", "S", D(i), 3.0 if i % 2 else 5.0, 95.0) for i in range(1, 101)]
    sellers = frame(spark, rows, SELLERS)
    flagged = reports.flag_sellers(reports.top_sellers(sellers))
    assert flagged.count() == 50 and flagged.where("needs_review").count() == 25
    listed = reports.sellers_to_review(flagged)
    assert [r["seller_id"] for r in listed.collect()] == list(range(99, 59, -2))
    (row,) = dicts(reports.seller_kpis(sellers))
    assert row["sellers_flagged_for_review"] == 25
    assert row["flagged_seller_revenue"] == sum(range(99, 59, -2))
    assert row["top_seller_revenue"] == 100 and row["top_seller_rating"] == 5.0
    (empty,) = dicts(reports.seller_kpis(frame(spark, [], SELLERS)))
    assert empty["sellers_loaded"] == 0 and empty["flagged_seller_revenue"] == 0


def test_state_bundle_ignores_unknown_shares(spark):
    ddl = "customer_state string, gmv decimal(38,4), on_time_pct double"
    rows = [("B", D(5), 70.0), ("A", D(5), 70.0), ("C", D(1), None), ("D", None, NAN)]
    (row,) = dicts(reports.geo_kpis(frame(spark, rows, ddl)))
    assert (row["highest_gmv_state"], row["lowest_on_time_state"]) == ("A", "A")
    assert (row["states_analyzed"], row["overall_state_gmv"]) == (4, 11)


def test_returning_share(spark):
    ddl = "purchase_month date, customer_type string, revenue decimal(38,4)"
    jan, feb, mar = (dt.date(2020, m, 1) for m in (1, 2, 3))
    rows = [(jan, "New", D(10)), (feb, "New", D(30)), (feb, "Returning", D(10)), (mar, "New", D(0))]
    df = frame(spark, rows, ddl)
    got = {r["purchase_month"]: r["returning_share"] for r in dicts(reports.returning_share_by_month(df))}
    assert got == {jan: 0.0, feb: 25.0, mar: None}
    (row,) = dicts(reports.new_returning_kpis(df))
    assert row["returning_revenue_share_pct"] == 20.0 and row["status"] == "At risk"
    (empty,) = dicts(reports.new_returning_kpis(frame(spark, [], ddl)))
    assert empty["returning_revenue_share_pct"] is None and empty["status"] == "Stable"


def test_sample_has_fixed_size_and_ignores_partitioning(spark):
    df = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("k"))
    one = [r["k"] for r in fixed_sample(df, "k", 100, 42).collect()]
    two = [r["k"] for r in fixed_sample(df.repartition(7), "k", 100, 42).collect()]
    assert one == two and len(set(one)) == 100
    assert [r["k"] for r in fixed_sample(df, "k", 100, 43).collect()] != one
    assert fixed_sample(df, "k", 5000, 42).count() == 1000


def test_matrix_refuses_to_drop_months(spark):
    ddl = "cohort_month date, month_number int, active_customers bigint, cohort_size bigint, retention_rate double"
    df = frame(spark, [(dt.date(2020, 1, 1), n, 1, 1, 100.0) for n in (0, 3)], ddl)
    with pytest.raises(Exception, match="month number above 2: 3"):
        reports.cohort_matrix(df, 2).collect()
    assert len(reports.cohort_matrix(df, 3).collect()) == 1
