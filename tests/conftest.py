import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from vendastat.plans.fact import FACT_COLUMNS, order_fact  # noqa: E402
from vendastat.schemas import CUSTOMERS, ORDER_ITEMS, PAYMENTS, SELLERS, StarSchema  # noqa: E402
from vendastat.session import get_session  # noqa: E402

DATA = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text):
    return dt.datetime.fromisoformat(text) if text else None


def item(order, n=1, customer=1, bought="2020-01-10T10:00:00", price="10.00", **other):
    """One order item; unnamed columns get plain values."""
    when = ts(bought)
    row = {
        "order_id": order, "order_item_id": n, "customer_id": customer, "product_id": 1, "seller_id": 1,
        "order_status": "delivered", "order_purchase_timestamp": when,
        "purchase_date": when and when.date(), "purchase_year": when and when.year,
        "purchase_month": when and when.month, "purchase_ym": when and when.strftime("%Y-%m"),
        "price": Decimal(price), "freight_value": Decimal("0.5"), "item_total": Decimal(price) + Decimal("0.5"),
        "delivery_days": 5, "delivery_status": "On Time", "avg_review_score": 5.0, "category_en": "toys",
    }
    row.update(other)
    return row


@pytest.fixture
def make_star(spark):
    def frame(rows, schema):
        return spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in rows], schema)

    def build(items, customers=None, sellers=None):
        if customers is None:
            customers = [(i, f"C{i}", "town", "ST") for i in range(1, 10)]
        if sellers is None:
            sellers = [(i, "town", "ST") for i in range(1, 10)]
        return StarSchema(
            frame(items, ORDER_ITEMS),
            spark.createDataFrame(customers, CUSTOMERS),
            spark.createDataFrame(sellers, SELLERS),
            spark.createDataFrame([], PAYMENTS),
        )

    return build


@pytest.fixture
def make_fact(make_star):
    return lambda items, **dims: order_fact(make_star(items, **dims))


def dicts(df):
    return [r.asDict() for r in df.collect()]


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, T._parse_datatype_string(ddl))


assert len(FACT_COLUMNS) == 32
