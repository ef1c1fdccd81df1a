"""Join of a large table with a lookup table, safe for any size and any skew.

* A lookup whose files stay under Spark's broadcast limit is broadcast: no shuffle.
* Otherwise both sides are shuffled on the key. Keys that hold a large part of the rows
  are found first, by exact counts; their rows are spread over several salts and their
  lookup rows repeated once per salt. All other keys keep salt 0.
* Without such keys the plan is a plain shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendastat.session import materialize, scan_bytes

# A key is hot if it holds more than this share of all rows; so at most 1/HOT_SHARE keys are.
HOT_SHARE = 1 / 2000
# Keys are first counted in this many groups, to look closer at the few that can hold a hot key.
# More groups than 1/HOT_SHARE, so that evenly filled ones stay below it; few enough that the
# counters of all scan tasks together stay small.
KEY_GROUPS = 1 << 13


def broadcast_limit(spark: SparkSession) -> int:
    """Spark's own limit for broadcasting a table, in bytes; -1 if broadcasting is off."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def is_joined(df: DataFrame) -> bool:
    """Whether ``df`` is made from more than one table."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size() > 1


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> list[tuple[object, int]]:
    """Keys (NULL included) holding more than ``share`` of all rows, each with its number of salts.

    Two passes over the key column only. The first counts groups of keys, so that it
    shuffles a bounded number of counters; the second counts single keys inside the groups
    large enough to hold a hot one. Both are exact, and at most ``1 / share`` rows come back.
    """
    group = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)))
    keyed = rows.select(key, group.alias("group"))
    large = (
        keyed.groupBy("group")
        .agg(F.count("*").alias("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
        .where(F.col("n") > F.col("total") * share)
        .collect()
    )
    if not large:
        return []
    floor = max(int(large[0]["total"] * share), 1)
    found = (
        keyed.where(F.col("group").isin([r["group"] for r in large]))
        .groupBy(key)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > floor)
        .collect()
    )
    return [(r[key], -(-r["n"] // floor)) for r in found]


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "left",
    spread_by: list[str] | None = None,
    counted: DataFrame | None = None,
    share: float = HOT_SHARE,
) -> DataFrame:
    """``rows`` with the columns of ``lookup``, joined on ``key`` (``how``: left or inner).

    ``spread_by`` names columns that tell the rows of a hot key apart (default: all, which
    makes the plan read all of them). ``counted`` is a cheaper table to count the keys on,
    such as the scan ``rows`` was made from.
    """
    spark = rows.sparkSession
    if scan_bytes(lookup) <= broadcast_limit(spark):
        return rows.join(F.broadcast(lookup), key, how)
    if counted is None:
        # Counting takes two passes; the result of an earlier join is stored first.
        rows = materialize(rows, "joined") if is_joined(rows) else rows
        counted = rows
    salts = dict(hot_keys(counted, key, share))
    null_salts = salts.pop(None, 1)
    if not salts and (how == "inner" or null_salts == 1):
        return rows.join(lookup, key, how)

    columns = rows.columns + [c for c in lookup.columns if c != key]
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("_salts", T.LongType())])
    hot = F.broadcast(spark.createDataFrame(list(salts.items()), schema))
    one = F.lit(1).cast("bigint")
    # A salt drawn from the row itself stays the same when a lost task is run again.
    spread = F.xxhash64(*(spread_by or rows.columns))
    rows = rows.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), F.pmod(spread, F.lit(null_salts)))
        .when(F.col("_salts").isNotNull(), F.pmod(spread, "_salts"))
        .otherwise(one - 1),
    )
    lookup = lookup.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(one - 1, F.coalesce("_salts", one) - 1))
    )
    return rows.drop("_salts").join(lookup.drop("_salts"), [key, "_salt"], how).select(columns)
