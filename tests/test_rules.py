import itertools
from collections import Counter

from conftest import frame
from pyspark.sql import functions as F

from vendastat.functions.rules import health_status, needs_review, rfm_segment


def test_all_score_triples(spark):
    triples = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "r int, f int, m int")
    rows = df.select("r", "f", "m", rfm_segment(F.col("r"), F.col("f"), F.col("m")).alias("s")).collect()
    assert Counter(r["s"] for r in rows) == {
        "Need Attention": 36,
        "Lost / Hibernating": 20,
        "Promising / New": 20,
        "Loyal Customers": 19,
        "At Risk": 18,
        "Champions": 8,
        "Big Spenders": 4,
    }
    assert {(r["r"], r["f"], r["m"]) for r in rows if r["s"] == "Big Spenders"} == {
        (3, f, m) for f in (1, 2) for m in (4, 5)
    }


def test_status_of_every_combination(spark):
    # met, missed, unknown for on-time, rating, returning share, month-1 retention
    choices = [(95.0, 80.0, None), (4.5, 3.0, None), (30.0, 29.9, None), (20.0, 1.0, None)]
    rows = list(itertools.product(*choices))
    df = frame(spark, rows, "o double, a double, s double, m double")
    got = df.select("*", health_status(F.col("o"), F.col("a"), F.col("s"), F.col("m")).alias("status")).collect()
    assert len(got) == 81
    for row in got:
        made = [(row[i], choices[i]) for i in range(4) if row[i] is not None]
        met = sum(value == options[0] for value, options in made)
        if not made:
            want = "Stable"
        else:
            share = met / len(made)
            want = (
                "Strong" if share >= 0.8 else "Stable" if share >= 0.5 else "Watch closely" if share >= 0.25 else "At risk"
            )
        assert row["status"] == want, row


def test_status_reads_shares_and_nan(spark):
    df = frame(spark, [(0.95,), (0.5,), (float("nan"),), (1.0,)], "o double")
    assert [r[0] for r in df.select(health_status(F.col("o"))).collect()] == ["Strong", "At risk", "Stable", "Strong"]
    assert spark.range(1).select(health_status()).first()[0] == "Stable"


def test_review_flag_with_unknown_values(spark):
    nan = float("nan")
    rows = [(95.0, 4.5), (80.0, None), (None, 4.5), (None, None), (95.0, 3.9), (nan, 4.5), (nan, 1.0)]
    df = frame(spark, rows, "o double, a double")
    got = [r[0] for r in df.select(needs_review(F.col("o"), F.col("a"))).collect()]
    assert got == [False, True, False, False, True, False, True]
