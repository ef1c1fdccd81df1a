"""Payments and reviews reduced per order."""

from decimal import Decimal as D

from conftest import dicts, frame, item

from vendastat.plans import orders
from vendastat.schemas import ORDER_ITEMS, PAYMENTS

REVIEWS = "order_id bigint, review_score int"


def test_primary_type_has_the_largest_total(spark):
    rows = [
        (1, "card", 3, D("5.00")), (1, "voucher", 1, D("4.00")), (1, "voucher", 1, D("2.00")),  # 6 against 5
        (2, "b", 1, D("1.00")), (2, "a", 9, D("1.00")),  # a tie goes by name
        (3, None, 1, D("9.00")), (3, "card", None, D("0.01")),  # an unknown type is never preferred
        (4, None, None, None), (5, "card", 2, None), (5, "boleto", 1, D("0.00")), (None, "card", 1, D("1.00")),
        (6, "refund", 1, D("-3.00")), (6, "card", 1, D("-2.00")),
    ]
    got = {r["order_id"]: r for r in dicts(orders.payments_per_order(spark.createDataFrame(rows, PAYMENTS)))}
    told = {k: (r["primary_payment_type"], r["max_installments"], r["total_payment_value"], r["payments"]) for k, r in got.items()}
    assert told == {
        1: ("voucher", 3, D("11.00"), 3),
        2: ("a", 9, D("2.00"), 2),
        3: ("card", 1, D("9.01"), 2),
        4: (None, None, None, 1),
        5: ("boleto", 2, D("0.00"), 2),
        6: ("card", 1, D("-5.00"), 2),
    }


def test_reviews_without_score_do_not_count_for_the_mean(spark):
    rows = [(1, 5), (1, None), (1, 2), (2, None), (None, 1)]
    got = sorted(map(tuple, orders.reviews_per_order(frame(spark, rows, REVIEWS)).collect()))
    assert got == [(1, 3.5, 3), (2, None, 1)]


def test_items_are_never_repeated(spark):
    made = [item(o, n) for o in (1, 2, 3) for n in (1, 2)] + [item(None, 1)]
    items = spark.createDataFrame([tuple(r.get(c) for c in ORDER_ITEMS.fieldNames()) for r in made], ORDER_ITEMS)
    paid = spark.createDataFrame([(1, "card", 1, D("1.00"))] * 5 + [(2, "card", 1, D("2.00")), (None, "x", 1, D("1.00"))], PAYMENTS)
    out = orders.with_order_totals(items, paid, frame(spark, [(1, 4), (1, 5), (3, 1)], REVIEWS))
    assert out.columns == ORDER_ITEMS.fieldNames() and out.count() == 7
    totals = {(r["order_id"], r["total_payment_value"], r["primary_payment_type"], r["avg_review_score"]) for r in out.collect()}
    assert totals == {(1, D("5.00"), "card", 4.5), (2, D("2.00"), "card", None), (3, None, None, 1.0), (None, None, None, None)}


def test_an_order_with_very_many_payments_combines_before_the_shuffle(spark):
    many = spark.range(200_000).selectExpr(
        "if(id % 10 = 0, id, 7) AS order_id", "concat('t', id % 3) AS payment_type", "cast(id % 12 AS int) AS payment_installments",
        "cast(1 AS decimal(12,2)) AS payment_value",
    )
    out = orders.payments_per_order(many)
    plan = out._jdf.queryExecution().executedPlan().toString()
    first = plan[: plan.rindex("Exchange")]
    assert plan[len(first) :].count("HashAggregate") == 1  # before the first shuffle
    (hot,) = out.where("order_id = 7").collect()
    assert hot["payments"] == 180_000 and hot["total_payment_value"] == D("180000.00") and hot["max_installments"] == 11
