"""Places of rows in a total order over the whole table, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendastat.session import materialize

# A row's number made at run time: its partition above these bits, its place inside below.
_PLACE_BITS = 33


def global_places(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order ``order``.

    Rows are dealt out by ranges of the order, sorted and stored with their place in the range;
    the row counts of the ranges before are then added. What meets in one place is one count for
    each range. Ranges are even as long as no single value of ``order`` holds most rows, so end it
    with a key of the rows. Rows with equal values get places in arbitrary order.
    """
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("_row", F.monotonically_increasing_id()), "ranges")
    split = dealt.withColumn("_range", F.shiftright("_row", _PLACE_BITS))
    before, shifts = 0, []
    for r in split.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        shifts.append((r["_range"], before))
        before += r["n"]
    schema = T.StructType([T.StructField("_range", T.LongType()), T.StructField("_before", T.LongType())])
    inside = F.col("_row").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    placed = split.join(F.broadcast(spark.createDataFrame(shifts, schema)), "_range")
    return placed.withColumn(name, F.col("_before") + inside).drop("_range", "_row", "_before")
