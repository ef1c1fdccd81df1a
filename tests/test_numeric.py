import math
from decimal import Decimal

from conftest import frame
from pyspark.sql import functions as F

from vendastat.functions.dates import month_start, months_between_starts, whole_days
from vendastat.functions.numeric import (
    coerce_numeric,
    exact_mean,
    normalize_percent,
    pct_change,
    rounded,
    weighted_mean,
    weighted_mean_all,
)

NAN = float("nan")


def column(df, name):
    return [r[name] for r in df.collect()]


def test_text_to_number(spark):
    texts = ["12", " 12.5 ", "-3e2", ".5", "5.", "", "n/a", "1d", "0x1F", "12 BRL", "1,5", "nan", None]
    df = coerce_numeric(frame(spark, [(t,) for t in texts], "x string"), "x")
    assert column(df, "x") == [12.0, 12.5, -300.0, 0.5, 5.0] + [None] * 8
    infinite = coerce_numeric(frame(spark, [("-inf",), ("Infinity",)], "x string"), "x")
    assert column(infinite, "x") == [-math.inf, math.inf]
    assert column(coerce_numeric(frame(spark, [(NAN,), (1.0,)], "x double"), "x"), "x") == [None, 1.0]


def test_percent_column_is_scaled_as_a_whole(spark):
    for small in (True, False):

        def scaled(values, ddl="x double", small=small):
            return column(normalize_percent(frame(spark, [(v,) for v in values], ddl).coalesce(1), "x", small=small), "x")

        assert scaled([0.5, 1.0]) == [50.0, 100.0]
        assert scaled([0.5, 1.000001]) == [50.0, 1.000001 * 100]
        assert scaled([0.5, 90.0]) == [0.5, 90.0]
        assert scaled([0.5, NAN, None]) == [50.0, None, None]
        assert scaled([]) == []
        assert scaled([None, NAN]) == [None, None]
        assert scaled(["0.5", "x"], "x string") == [50.0, None]
    other = frame(spark, [(1,)], "y int")
    assert normalize_percent(other, "x") is other


def test_weighted_means(spark):
    def means(rows):
        df = frame(spark, rows, "x double, w bigint")
        r = df.agg(weighted_mean(F.col("x"), F.col("w")), weighted_mean_all(F.col("x"), F.col("w"))).first()
        return r[0], r[1]

    assert means([(4.0, 1), (2.0, 3)]) == (2.5, 2.5)
    assert means([(4.0, 1), (None, 3)]) == (4.0, None)
    assert means([(None, 3)]) == (None, None)
    assert means([(4.0, 0)]) == (None, None)


def test_change_in_percent(spark):
    rows = [(Decimal(3), Decimal(2)), (Decimal(3), Decimal(0)), (Decimal(3), None), (None, Decimal(2))]
    df = frame(spark, rows, "a decimal(10,2), b decimal(10,2)")
    assert column(df.select(pct_change(F.col("a"), F.col("b")).alias("x")), "x") == [50.0, None, None, None]


def test_mean_of_nothing(spark):
    df = frame(spark, [(None,)], "x decimal(10,2)")
    assert df.agg(exact_mean(F.col("x"))).first()[0] is None


def test_rounding_keeps_null(spark):
    df = rounded(frame(spark, [(1.23456,), (None,)], "x double"), {"x": 2})
    assert column(df, "x") == [1.23, None]


def test_whole_days_are_not_midnights(spark):
    df = spark.sql("SELECT timestamp_ntz'2020-01-03 01:00:00' AS b, timestamp_ntz'2020-01-01 23:00:00' AS a")
    assert df.select(whole_days(F.col("b"), F.col("a"))).first()[0] == 1
    assert df.select(F.datediff("b", "a")).first()[0] == 2


def test_months(spark):
    df = spark.sql("SELECT timestamp_ntz'2021-02-27 10:00:00' AS b, timestamp_ntz'2020-11-03 00:00:00' AS a")
    number = months_between_starts(month_start(F.col("b")), month_start(F.col("a")))
    assert df.select(number).first()[0] == 3
