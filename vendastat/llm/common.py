"""Helpers shared by the operators: stored intermediate tables and partition counts."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendastat.session import shared_folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The files replace the lineage, so a lost executor never makes Spark repeat what came
    before. They stay until the folder is cleaned, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A function over the batches of a task that hands its memory back to the machine at the end.

    Python workers outlive their task, and several of them share an executor: what idle ones still
    hold is missing from the others.
    """

    @wraps(run)
    def wrapped(batches: Iterable) -> Iterator:
        kept(None, None)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Give freed memory back to the machine, as far as it is to be had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def kept(name: str | None, make: Callable[[], object] | None) -> object:
    """What a Python worker keeps from task to task under ``name``; everything else goes."""
    store = sys.modules.setdefault("_vendastat_kept", types.ModuleType("_vendastat_kept"))
    if getattr(store, "name", None) != name:
        store.name, store.value = name, None
        store.value = make() if make else None
    return getattr(store, "value", None)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the knob by which a job is sized for its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def global_positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, stored, with ``position``: 0, 1, 2, ... in the total order ``order``.

    Rows are dealt out by range, numbered inside each part, and shifted by the rows of the
    parts before. Only the row count of each part meets in one place. Parts are balanced as
    long as no single value of ``order`` holds most rows, so end it with a key of the rows.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *order)
    dealt = store(dealt.withColumn("part_no", F.spark_partition_id()), name)
    counts = dealt.groupBy("part_no").agg(F.count("*").alias("part_rows"))
    before = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part_no", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("part_no").orderBy(*order)) - 1
    numbered = dealt.withColumn("inside", inside)
    # One row for each shuffle partition: a bounded table.
    return (
        numbered.join(F.broadcast(shifts), "part_no")
        .withColumn("position", (F.col("shift") + F.col("inside")).cast("long"))
        .drop("part_no", "inside", "shift")
    )


def matching_rows(docs: DataFrame, stays: DataFrame, id_col: str, hash_of_text: Column) -> DataFrame:
    """Rows of ``docs`` named by ``stays`` (id, hash, rows), each once, columns as they are.

    ``rows`` says how often a row is there; only repeated ones take a second step.
    """
    stays = stays.select(
        F.col("id").alias("__vs_id"), F.col("hash").alias("__vs_hash"), F.col("rows").alias("__vs_rows")
    )
    found = docs.withColumn("__vs_own", hash_of_text).join(
        stays, (F.col("__vs_own") == F.col("__vs_hash")) & F.col(id_col).eqNullSafe(F.col("__vs_id"))
    )
    order = Window.partitionBy("__vs_hash", "__vs_id").orderBy("__vs_rows")
    repeated = found.where("__vs_rows > 1").withColumn("__vs_nth", F.row_number().over(order)).where("__vs_nth = 1")
    return found.where("__vs_rows = 1").select(*docs.columns).unionByName(repeated.select(*docs.columns))


#: Bits of the filter below: a table of 131,072 words at most.
FILTER_BITS = 1 << 23


def possible_rows(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``, to spare a join's shuffle.

    A hashed bitmap of fixed size is broadcast. The more keys are wanted, the fewer rows it
    keeps out; it never keeps out one that is wanted.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    word, mask = F.shiftright(bit, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))")
    bitmap = wanted.groupBy(word.alias("__vs_word")).agg(F.bit_or(mask).alias("__vs_bits"))
    found = rows.join(F.broadcast(bitmap), word == F.col("__vs_word"))
    return found.where(F.col("__vs_bits").bitwiseAND(mask) != 0).select(*rows.columns)
