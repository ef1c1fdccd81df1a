"""Lasting views: the same rows as the DataFrame views, readable from another session."""

import pytest
from conftest import item

from vendastat.plans import published
from vendastat.plans.catalog import PAYMENT_VIEW, VIEWS, build_view


@pytest.fixture(scope="module")
def months():
    return ["2020-01-05T10:00:00", "2020-01-31T23:00:00", "2020-03-01T01:00:00", None]


@pytest.fixture
def star(make_star, months):
    items = [
        item(n // 2, n, customer=n // 2 % 5 or None, bought=months[n % 4], category_en=["a", "b", None][n % 3],
             delivery_status=["On Time", "Late", None][n % 3], delivery_days=[3, 9, None][n % 3], avg_review_score=[5.0, None][n % 2])
        for n in range(60)
    ]
    return make_star(items, customers=[(1, "P", "t", "X"), (2, "P", "t", "Y"), (3, "Q", "t", None), (4, None, "t", "X")])


def rows(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_lasting_views_equal_the_others(spark, star):
    names = published.publish(spark, star, "vs_published")
    assert {*VIEWS, PAYMENT_VIEW} <= set(names)
    other = spark.newSession()
    for name in [*VIEWS, PAYMENT_VIEW]:
        want, got = build_view(name, star), other.table(f"vs_published.{name}")
        assert set(got.columns) == set(want.columns), name
        assert rows(got.select(want.columns)) == rows(want), name


def test_definitions_run_no_job_and_refresh_in_place(spark, star, make_star):
    database = "vs_refreshed"
    first = published.store_version(spark, star, database)
    spark.sparkContext.setJobGroup("definitions", "")
    published.define_views(spark, database, first)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("definitions")
    spark.sparkContext.setJobGroup("", "")
    reader = spark.newSession()
    assert reader.table(f"{database}.vw_order_fact").count() == 60
    second = published.store_version(spark, make_star([item(1), item(2)]), database)
    assert reader.table(f"{database}.vw_order_fact").count() == 60  # until the views are replaced
    published.define_views(spark, database, second)
    assert reader.table(f"{database}.vw_order_fact").count() == 2
    assert {r["total_orders"] for r in reader.table(f"{database}.vw_monthly_kpis").collect()} == {2}
    gone = published.drop_versions(spark, database, keep=second)
    assert len(gone) == 3 and all(g.endswith(first) for g in gone)
    assert reader.table(f"{database}.vw_rfm_segments").count() == 1
