"""The scale-safe forms against plain self-joins and windows, on random facts full of gaps."""

import random
from decimal import Decimal

import pytest
from conftest import item

from vendastat.plans import customers, performance

FIRST = "(SELECT customer_unique_id AS c, min(purchase_month_date) AS first FROM f WHERE customer_unique_id IS NOT NULL GROUP BY 1)"

NAIVE = {
    "cohort_retention": f"""
        SELECT first AS cohort_month, CAST(months_between(purchase_month_date, first) AS INT) AS month_number,
               count(DISTINCT c) AS active_customers, any_value(size) AS cohort_size,
               CAST(round(100BD * count(DISTINCT c) / any_value(size), 2) AS DECIMAL(7,2)) AS retention_rate
        FROM f JOIN {FIRST} ON c = customer_unique_id
        JOIN (SELECT first AS cohort, count(*) AS size FROM {FIRST} GROUP BY 1) ON cohort = first
        WHERE purchase_month_date IS NOT NULL GROUP BY first, purchase_month_date""",
    "new_vs_returning": f"""
        SELECT purchase_month_date AS purchase_month, if(purchase_month_date <=> first AND first IS NOT NULL, 'New', 'Returning') AS customer_type,
               count(DISTINCT c) AS customers, count(*) AS items, sum(total_item_value) AS revenue
        FROM f JOIN {FIRST} ON c = customer_unique_id GROUP BY 1, 2""",
    "customer_metrics": """
        WITH o AS (SELECT customer_unique_id AS c, order_id, order_purchase_timestamp AS t, sum(total_item_value) AS v
                   FROM f WHERE customer_unique_id IS NOT NULL GROUP BY ALL)
        SELECT c, count(DISTINCT order_id), sum(v), CAST(sum(v) AS DOUBLE) / count(v), min(t), max(t),
               CAST(extract(DAY FROM max(t) - min(t)) AS BIGINT),
               CAST(extract(DAY FROM (SELECT max(order_purchase_timestamp) FROM f) - max(t)) AS BIGINT)
        FROM o GROUP BY c""",
    "data_quality": """
        SELECT 'Total delivered order items', CAST(count(*) AS STRING) FROM f
        UNION ALL SELECT 'Unique customers', CAST(count(DISTINCT customer_unique_id) AS STRING) FROM f
        UNION ALL SELECT 'Date range start', CAST(min(order_purchase_timestamp) AS STRING) FROM f
        UNION ALL SELECT 'Date range end', CAST(max(order_purchase_timestamp) AS STRING) FROM f
        UNION ALL SELECT 'Categories with data', CAST(count(DISTINCT product_category_english) AS STRING) FROM f""",
    "rfm_segments": """
        SELECT customer_unique_id, ntile(5) OVER (ORDER BY recency_days NULLS LAST, customer_unique_id),
               ntile(5) OVER (ORDER BY total_orders DESC NULLS FIRST, customer_unique_id),
               ntile(5) OVER (ORDER BY total_revenue DESC NULLS FIRST, customer_unique_id) FROM metrics""",
}


@pytest.fixture(scope="module", params=[1, 2])
def fact(request, spark):
    from conftest import CUSTOMERS, ORDER_ITEMS, PAYMENTS, SELLERS, StarSchema, order_fact

    rnd = random.Random(request.param)
    rows = []
    for n in range(400):
        order = rnd.choice([0] * 3 + list(range(1, 150)))  # one order has many items
        month = None if rnd.random() < 0.05 else (order * 7) % 12 + 1
        when = month and f"2020-{month:02d}-{rnd.randint(1, 2):02d}T{order % 24:02d}:00:00"
        rows.append(
            item(
                order, n, customer=rnd.choice([None, 99, order % 40]), bought=when,
                price=str(Decimal(rnd.randint(100, 9999)) / 100),
                item_total=None if rnd.random() < 0.1 else Decimal(rnd.randint(100, 9999)),
                category_en=rnd.choice([None, "a", "b"]), delivery_status=rnd.choice([None, "On Time", "Late"]),
            )
        )
    people = [(i, None if i % 13 == 0 else f"C{i}" if i % 3 else "C1", "t", "S") for i in range(40)]
    star = StarSchema(
        spark.createDataFrame([tuple(r.get(c) for c in ORDER_ITEMS.fieldNames()) for r in rows], ORDER_ITEMS),
        spark.createDataFrame(people, CUSTOMERS),
        spark.createDataFrame([(1, "t", "S")], SELLERS),
        spark.createDataFrame([], PAYMENTS),
    )
    return order_fact(star).cache()


@pytest.mark.parametrize("name", list(NAIVE))
def test_same_as_plain_form(spark, fact, name):
    if name == "rfm_segments":
        metrics = customers.customer_metrics(fact).cache()
        metrics.createOrReplaceTempView("metrics")
        got = customers.rfm_segments(metrics, distributed=True, sample_rows=30)
        got = got.select("customer_unique_id", "r_score", "f_score", "m_score")
    else:
        got = getattr(customers, name, None) or getattr(performance, name)
        got = got(fact)
    fact.createOrReplaceTempView("f")
    want = spark.sql(NAIVE[name])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    for view in ("f", "metrics"):
        spark.catalog.dropTempView(view)
