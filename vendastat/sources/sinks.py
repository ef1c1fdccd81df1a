"""Writers: CSV reports, text documents, JSON payloads, and the stored fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# A quote inside a field is doubled, an empty text is quoted and NULL is not there at all.
CSV = {
    "header": True, "encoding": "UTF-8", "escape": '"', "nullValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}

# What the reader gives for a quoted empty text, which it would take for NULL otherwise.
_EMPTY = "\x01empty\x01"


def sort_columns(order: list[str]) -> list[Column]:
    """Sort columns from names, "-" in front for descending.

    A missing value comes last where the order ascends and first where it descends.
    """
    return [F.desc_nulls_first(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order]


def write_csv(df: DataFrame, path: str, small: bool = False, order: list[str] | None = None) -> None:
    """CSV with a header, UTF-8, no index, in the given order (see ``sort_columns``).

    Ordered rows lie in files whose names follow the order. ``small=True`` gives a single file,
    for report tables: only the finished rows meet in one task, the steps before keep their
    partitions.
    """
    columns = sort_columns(order or [])
    if small:
        df = df.repartition(1)
        df = df.sortWithinPartitions(*columns) if columns else df
    elif columns:
        df = df.orderBy(*columns)
    df.write.options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_csv`` wrote, with the declared types; fields may hold quotes, commas and line breaks."""
    options = {**CSV, "multiLine": True, "enforceSchema": False, "mode": "FAILFAST", "emptyValue": _EMPTY}
    rows = spark.read.schema(schema).options(**options).csv(path)
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({c: F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)) for c in texts}) if texts else rows


def write_documents(
    df: DataFrame, path: str, key: str, text: str = "markdown", names: list | None = None
) -> None:
    """Documents as JSON lines of key and text, in as many files as there are partitions.

    Separate text files, one folder per key, are for a short list: ``names`` holds the keys, and
    only those are written.
    """
    if names is None:
        df.select(key, text).write.json(path)
    else:
        named = df.where(F.col(key).isin(names))
        named.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_documents`` wrote: JSON lines, or text files in one folder per key."""
    names = schema.fieldNames()
    if len(names) == 2 and "value" not in names:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.text(path, wholetext=True).select(*names)


def file_stem(context: Column) -> Column:
    """Lower-case file name part of a report title."""
    spaced = F.replace(F.lower(context), F.lit(" "), F.lit("_"))
    return F.replace(F.replace(spaced, F.lit("&"), F.lit("and")), F.lit("/"), F.lit("_"))


def json_payload(df: DataFrame, name: str = "payload") -> DataFrame:
    """Every row as one JSON object.

    Values JSON has no type for (dates, times, decimals) become strings; NULLs are kept.
    """
    plain = (T.StringType, T.BooleanType, T.IntegralType, T.DoubleType, T.FloatType)
    nested = (T.StructType, T.ArrayType, T.MapType)
    fields = [
        F.col(f.name) if isinstance(f.dataType, plain + nested) else F.col(f.name).cast("string").alias(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))


def save_fact(fact: DataFrame, path: str) -> None:
    """The order fact as Parquet, one folder per month, so that month filters skip files.

    Rows are gathered by month first, so that not every task writes a file into every
    folder. Rebalancing splits large months and merges small ones to the advisory size.
    """
    month = "purchase_month_date"
    fact.hint("rebalance", F.col(month)).write.partitionBy(month).parquet(path)
