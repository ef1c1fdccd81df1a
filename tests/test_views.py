"""Hand-made cases the driver tables do not contain: unknown values, ties, gaps."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import DATA, dicts, item, ts
from pyspark.sql import functions as F

from vendastat.plans import customers, performance
from vendastat.plans.catalog import VIEWS, build_view
from vendastat.plans.fact import FACT_COLUMNS, order_fact
from vendastat.schemas import CUSTOMERS, ID_COLUMNS, ORDER_ITEMS, StarSchema, conform, duplicate_keys
from vendastat.sources.retail import RetailStar

JAN, FEB, MAR = dt.date(2020, 1, 1), dt.date(2020, 2, 1), dt.date(2020, 3, 1)


def test_fact_keeps_delivered_items_and_unmatched_keys(make_fact):
    fact = make_fact([item(1), item(2, order_status="shipped"), item(3, customer=99, seller_id=None)])
    rows = sorted(dicts(fact), key=lambda r: r["order_id"])
    assert fact.columns == FACT_COLUMNS
    assert [r["order_id"] for r in rows] == [1, 3]
    assert rows[0]["customer_unique_id"] == "C1" and rows[0]["purchase_month_date"] == JAN
    assert rows[1]["customer_unique_id"] is None and rows[1]["seller_city"] is None


def test_fact_of_chosen_columns_joins_only_what_it_needs(make_star):
    star = make_star([item(1)])
    plan = order_fact(star, ["order_id", "price"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert order_fact(star, ["seller_state", "order_id"]).columns == ["order_id", "seller_state"]


BY_ORDER = [name for name, view in VIEWS.items() if view.by_order]


@pytest.mark.parametrize("name", BY_ORDER)
def test_distinct_counts_repeat_no_rows(spark, name):
    """No step that copies rows, no sorting aggregate, and three shuffles by key at most."""
    plan = build_view(name, RetailStar(spark, str(DATA), status="delivered"))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") <= 3


@pytest.mark.parametrize("name", BY_ORDER)
def test_customers_joined_early_or_late_give_the_same(make_fact, make_star, name):
    items = [item(n % 7, n, customer=n % 7 % 4 or None, category_en=["a", "b", None][n % 3]) for n in range(40)]
    people = [(1, "P", "t", "X"), (2, "P", "t", "Y"), (3, None, "t", None)]
    early = VIEWS[name].build(make_fact(items, customers=people))
    late = build_view(name, make_star(items, customers=people))
    assert "Expand" not in early._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, early.collect())) == sorted(map(repr, late.collect()))


def test_customer_metrics_join_the_fact_once(make_fact):
    metrics = customers.customer_metrics(make_fact([item(1), item(2, customer=None)]))
    assert metrics.count() == 1
    metrics.collect()
    final = metrics._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final


def test_order_is_on_time_if_all_known_items_are(make_fact):
    late, unknown = {"delivery_status": "Late"}, {"delivery_status": None}
    fact = make_fact([
        item(1), item(1, 2),
        item(2), item(2, 2, **late),
        item(3), item(3, 2, **unknown),
        item(4, **unknown), item(4, 2, **unknown),
    ])
    row = dicts(performance.monthly_kpis(fact))[0]
    assert row["total_orders"] == 4
    assert row["on_time_pct"] == 50.0  # orders 1 and 3; order 4 has no known item


def test_monthly_means_are_means_of_orders(make_fact):
    fact = make_fact([
        item(1, avg_review_score=1.0, delivery_days=2), item(1, 2, avg_review_score=3.0, delivery_days=None),
        item(2, avg_review_score=None, delivery_days=4, price="30.00"),
    ])
    row = dicts(performance.monthly_kpis(fact))[0]
    assert (row["avg_review_score"], row["avg_delivery_days"]) == (2.0, 3.0)
    assert row["gmv"] == Decimal("51.5") and row["aov"] == 25.75
    assert row["year_month"] == "2020-01" and row["purchase_month"] == JAN


def test_order_shared_by_two_customers_counts_for_the_greater(make_fact):
    fact = make_fact([item(1, customer=1), item(1, 2, customer=2), item(2, customer=1)])
    assert dicts(performance.monthly_kpis(fact))[0]["unique_customers"] == 2
    fact = make_fact([item(1, customer=1), item(1, 2, customer=2), item(2, customer=2)])
    assert dicts(performance.monthly_kpis(fact))[0]["unique_customers"] == 1


def test_order_shared_by_two_customers_counts_for_each_state(make_star):
    items = [item(1, customer=1), item(1, 2, customer=2), item(2, customer=2)]
    star = make_star(items, customers=[(1, "A", "t", "X"), (2, "B", "t", "Y")])
    rows = {r["customer_state"]: (r["orders"], r["customers"]) for r in dicts(build_view("vw_state_performance", star))}
    assert rows == {"X": (1, 1), "Y": (2, 1)}
    (toys,) = dicts(build_view("vw_product_performance", star))
    assert toys["unique_buyers"] == 2 and toys["items_sold"] == 3


def test_reports_without_customers_skip_their_join(make_star):
    star = make_star([item(1)])
    for name in ("vw_monthly_kpis", "vw_product_performance"):
        view = VIEWS[name]
        lean = view.build(order_fact(star, [c for c in view.columns if c != "customer_unique_id"]))
        assert "Join" not in lean._jdf.queryExecution().optimizedPlan().toString()
        full = view.build(order_fact(star, view.columns))
        left_out = set(full.columns) - set(lean.columns)
        assert left_out in ({"unique_customers"}, {"unique_buyers"})
        assert lean.collect() == full.select(lean.columns).collect()


def test_seller_share_counts_unknown_status_as_not_on_time(make_fact):
    fact = make_fact([item(1), item(2, delivery_status=None), item(3, seller_id=None)])
    rows = {r["seller_id"]: r for r in dicts(performance.seller_performance(fact))}
    assert rows[1]["on_time_pct"] == 50.0 and rows[1]["items_sold"] == 2
    assert rows[None]["orders_fulfilled"] == 1


def test_unknown_category_and_state_are_left_out(make_fact):
    fact = make_fact([item(1, category_en=None), item(2, customer=99)])
    assert [(r["category"], r["unique_buyers"]) for r in dicts(performance.product_performance(fact))] == [("toys", 0)]
    assert [(r["customer_state"], r["orders"]) for r in dicts(performance.state_performance(fact))] == [("ST", 1)]


def test_recency_counts_from_the_newest_row_of_anyone(make_fact):
    fact = make_fact([
        item(1, bought="2020-01-01T23:00:00"),
        item(2, bought="2020-01-03T01:00:00"),
        item(3, customer=99, bought="2020-01-10T00:00:00"),
    ])
    (row,) = dicts(customers.customer_metrics(fact))
    assert row["customer_lifetime_days"] == 1  # 26 hours over two midnights
    assert row["recency_days"] == 6
    assert (row["total_orders"], row["avg_order_value"]) == (2, 10.5)


def test_customer_metrics_of_several_accounts(make_fact):
    people = [(1, "P", "t", "S"), (2, "P", "t", "S")]
    fact = make_fact([item(1, customer=1), item(2, customer=2, price="20.00"), item(2, 2, customer=2)], customers=people)
    (row,) = dicts(customers.customer_metrics(fact))
    assert row["total_orders"] == 2
    assert row["total_revenue"] == Decimal("41.5") and row["avg_order_value"] == 20.75


def test_scores_and_their_turned_form(make_fact):
    fact = make_fact([
        item(o, customer=c, bought=f"2020-01-{10 + c:02d}T00:00:00", price=f"{c}0.00")
        for o, c in enumerate([1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 5])
    ])
    metrics = customers.customer_metrics(fact)
    plain = {r["customer_unique_id"]: r for r in dicts(customers.rfm_segments(metrics))}
    good = {r["customer_unique_id"]: r for r in dicts(customers.rfm_segments(metrics, high_is_good=True))}
    # C5 is best in all three: score 1 by default, 5 when turned.
    assert [plain["C5"][s] for s in ("r_score", "f_score", "m_score")] == [1, 1, 1]
    assert plain["C5"]["rfm_segment"] == "Lost / Hibernating" and plain["C1"]["rfm_segment"] == "Champions"
    assert good["C5"]["rfm_segment"] == "Champions" and good["C5"]["rfm_total"] == 15


def test_cohort_gaps_have_no_row(make_fact):
    fact = make_fact([
        item(1, bought="2020-01-05T00:00:00"), item(2, bought="2020-03-05T00:00:00"),
        item(3, customer=2, bought="2020-01-06T00:00:00"), item(4, customer=2, bought=None),
        item(5, customer=3, bought=None),
    ])
    rows = [tuple(r) for r in customers.cohort_retention(fact).orderBy("cohort_month", "month_number").collect()]
    assert rows == [(JAN, 0, 2, 2, Decimal("100.00")), (JAN, 2, 1, 2, Decimal("50.00"))]


def test_retention_rounds_half_up(spark, make_fact):
    first = [item(i, customer=i, bought="2020-01-05T00:00:00") for i in range(1, 10)]
    more = [(i, f"C{i}", "t", "S") for i in range(1, 801)]
    first += [item(i, customer=i, bought="2020-01-05T00:00:00") for i in range(10, 801)]
    fact = make_fact([*first, item(900, customer=1, bought="2020-02-05T00:00:00")], customers=more)
    rates = {r["month_number"]: r["retention_rate"] for r in dicts(customers.cohort_retention(fact))}
    assert rates[1] == Decimal("0.13")  # exactly 0.125


def test_new_and_returning(make_fact):
    fact = make_fact([
        item(1, bought="2020-01-05T00:00:00"), item(2, bought="2020-01-25T00:00:00"),
        item(3, bought="2020-02-05T00:00:00"), item(4, bought=None), item(5, customer=99),
    ])
    rows = {(r["purchase_month"], r["customer_type"]): r["items"] for r in dicts(customers.new_vs_returning(fact))}
    assert rows == {(JAN, "New"): 2, (FEB, "Returning"): 1, (None, "Returning"): 1}


def test_payments_of_unknown_type_are_kept(spark):
    df = spark.createDataFrame(
        [(1, None, 1, Decimal("5.00")), (1, None, 2, Decimal("6.00"))],
        "order_id bigint, payment_type string, payment_installments int, payment_value decimal(12,2)",
    )
    assert [tuple(r) for r in performance.payment_analysis(df).collect()] == [(None, 1, 1.5, Decimal("11.00"), 5.5)]


def test_profile_of_an_empty_fact(make_fact):
    rows = {r["metric"]: r["value"] for r in dicts(performance.data_quality(make_fact([])))}
    assert rows["Total delivered order items"] == "0" and rows["Date range start"] is None


def test_views_of_an_empty_fact(make_fact):
    fact = make_fact([])
    for name, view in VIEWS.items():
        if name != "vw_data_quality":
            assert view.build(fact).count() == 0, name


def test_repeated_dimension_keys_are_found(make_star):
    star = make_star([], customers=[(1, "A", "t", "S"), (1, "B", "t", "S"), (2, "C", "t", "S")])
    assert [tuple(r) for r in duplicate_keys(star.customers, "customer_id").collect()] == [(1, 2)]


def test_customer_count_is_that_of_the_fact(make_star):
    people = [(1, "P", "t", "S"), (2, "P", "t", "S"), (3, "Q", "t", "S"), (4, "R", "t", "S")]
    items = [item(1), item(2, customer=2), item(3, customer=3), item(4, customer=4, order_status="shipped"), item(5, customer=99)]
    star = make_star(items, customers=people)
    assert star.items.sparkSession.range(1).select(customers.customer_count(star)).first()[0] == 2
    assert order_fact(star).select("customer_unique_id").distinct().dropna().count() == 2


def test_identifiers_may_be_text(spark):
    star = RetailStar(spark, str(DATA), status="delivered")

    def text(df):
        ids = [c for c in df.columns if c in ID_COLUMNS]
        return df.withColumns({c: F.concat(F.lit("id"), F.col(c)) for c in ids})

    items, people = conform(text(star.items), ORDER_ITEMS), conform(text(star.customers), CUSTOMERS)
    textual = StarSchema(items, people, text(star.sellers), text(star.payments))
    for name in ("vw_monthly_kpis", "vw_rfm_segments", "vw_new_vs_returning"):
        exact = [c for c in build_view(name, star).columns if not c.startswith(("avg_", "on_time"))]
        one, two = build_view(name, star).select(exact), build_view(name, textual).select(exact)
        assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0, name


def test_schema_check(spark):
    with pytest.raises(ValueError, match="missing columns: customer_city"):
        conform(spark.createDataFrame([], "customer_id string, customer_unique_id string"), CUSTOMERS)
    with pytest.raises(ValueError, match="customer_city is int"):
        conform(
            spark.createDataFrame(
                [], "customer_id string, customer_unique_id string, customer_city int, customer_state string"
            ),
            CUSTOMERS,
        )


def test_invariants_on_the_test_tables(spark):
    star = RetailStar(spark, str(DATA), status="delivered")
    conform(star.items, ORDER_ITEMS)
    fact = order_fact(star)
    retention = customers.cohort_retention(fact)
    assert retention.where("month_number = 0 AND retention_rate <> 100").count() == 0
    monthly = performance.monthly_kpis(fact).agg(F.sum("total_orders")).first()[0]
    assert monthly == fact.select("order_id").distinct().count() == 4859
    split = customers.new_vs_returning(fact).agg(F.sum("revenue"), F.sum("items")).first()
    known = fact.where("customer_unique_id IS NOT NULL").agg(F.sum("total_item_value"), F.count("*")).first()
    assert tuple(split) == tuple(known)
    assert fact.count() == 19856


def test_timestamps_are_plain():
    assert ts("2020-01-01T00:00:00") == dt.datetime(2020, 1, 1)
    assert MAR > FEB
