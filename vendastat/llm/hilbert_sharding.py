"""Sharding along a Hilbert curve over metadata, cut into runs of equal row counts.

Text columns are quantised by a hash, so all rows of one value share a coordinate; numbers
by quantiles of the whole table. Documents are put in order of the curve index of their
coordinates, and the order is cut into shards whose counts differ by one at most. Files of a
shard then hold narrow ranges of every dimension, which their Parquet statistics show.

Equal texts stay together: all rows of a text are placed by the metadata of the one with the
smallest id, so they are neighbours on the curve. As counts may differ by one only, a cut may
fall inside such a group; that divides at most one group per cut, and those larger than a shard.

Only ids, sizes and coordinates are moved; the text stays where it is unless the shards are
written. Within one cell of the curve texts are ordered by their hash, then by id.

Defined results: a null text has no bytes and checksum 0, and is equal to an empty one; a null in a
dimension has its lowest coordinate, null ids come first and never place a group that has others.
Repeated rows are rows of their own, in arbitrary order among themselves. With fewer rows than
shards some shards stay empty; an empty table gives an empty result. Very long texts count by their
whole length. No other columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import global_positions, store
from .hilbert import hilbert_index

SHARDS = 24
#: Added to the bytes of a text for its row.
ROW_BYTES = 8
BITS = 5
DIMENSIONS = ("source", "lang", "size")


def _coordinates(rows: DataFrame, dimensions, bits: int) -> list[Column]:
    """A number from 0 to 2**bits - 1 for each dimension; one pass for all quantiles."""
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    numeric = [d for d in dimensions if not isinstance(rows.schema[d].dataType, T.StringType)]
    cuts = rows.agg(*[F.percentile_approx(d, steps, 1000).alias(d) for d in numeric]).first() if numeric else {}
    out = []
    for d in dimensions:
        if d in numeric:
            bounds = F.array(*[F.lit(c) for c in cuts[d] or []]).cast(T.ArrayType(T.DoubleType()))
            value = F.col(d).cast("double")
            place = F.size(F.filter(bounds, lambda cut: cut <= value))  # noqa: B023
        else:
            place = F.pmod(F.xxhash64(d), F.lit(1 << bits))
        out.append(F.when(F.col(d).isNull(), 0).otherwise(place).cast("int").alias(f"at_{d}"))
    return out


def _placed_by_group(rows: DataFrame, at: list[Column]) -> DataFrame:
    """``rows`` with the coordinates ``at``, those of equal texts from the row with the smallest id.

    Only texts that occur more than once go through the join; a hot one combines before its count.
    """
    names = [f"at_{d}" for d in DIMENSIONS]
    own = rows.select("id", "size", "text_crc32", "content", *at)
    first = F.min(F.struct(F.col("id").isNull(), "id", *names)).alias("first")
    groups = own.groupBy("content").agg(F.count("*").alias("n"), first).where("n > 1")
    groups = store(groups.select("content", *[F.col(f"first.{n}").alias(f"of_{n}") for n in names]), "text-groups")
    joined = own.join(groups, "content", "left")
    shared = [F.coalesce(f"of_{n}", n).alias(n) for n in names]
    return joined.select("id", "size", "text_crc32", "content", *shared)


def curve_index(columns: list[Column], bits: int) -> Column:
    """The Hilbert index of columns of coordinates."""

    @F.pandas_udf(T.LongType())
    def index(*parts: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([p.to_numpy(dtype=np.int64) for p in parts], axis=1), bits))

    return index(*columns)


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    bits: int = BITS,
) -> DataFrame:
    """One row per document: id, size, text_crc32, curve, shard, slot."""
    text = F.col(text_col)
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = store(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.col(lang_col).alias("lang"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.unhex(F.md5(data)).alias("content"),
        ),
        "shard-rows",
    )
    placed = _placed_by_group(rows, _coordinates(rows, DIMENSIONS, bits))
    placed = placed.withColumn("curve", curve_index([F.col(f"at_{d}") for d in DIMENSIONS], bits))
    placed = placed.select("id", "size", "text_crc32", "content", "curve")
    placed = global_positions(placed, [F.col("curve"), F.col("content"), F.col("id")], "shards")
    total = rows.count()
    shard = F.expr(f"position * {shards} div {max(total, 1)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return placed.select(
        "id", "size", "text_crc32", "curve", "shard", (F.col("position") - first).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **options) -> None:
    """Write ``docs`` in folders ``shard=0``, ``shard=1``, ..., in curve order inside each.

    Rows are matched by id, which must be unique here. Each shard goes to as many tasks as
    its slots ask for, not to one.
    """
    assigned = assign_shards(docs, id_col=id_col, **options)
    joined = docs.join(assigned.select(F.col("id").alias(id_col), "shard", "slot"), id_col)
    (
        joined.repartitionByRange(F.col("shard"), F.col("slot"))
        .sortWithinPartitions("shard", "slot")
        .drop("slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
