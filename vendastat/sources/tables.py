"""Reading the star schema, running SQL text, and listing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendastat.schemas import ID_COLUMNS, TABLES, StarSchema, conform
from vendastat.session import shared_folder


def read_star(spark: SparkSession, path: str) -> StarSchema:
    """The four tables from Parquet folders ``<path>/<table>``."""
    return StarSchema(*[conform(spark.read.parquet(f"{path}/{t}"), schema) for t, schema in TABLES.items()])


def range_predicates(column: str, cuts: list) -> list[str]:
    """SQL conditions that part a table by the ranges between ``cuts``; each row meets exactly one.

    Rows without a value are in the first range. ``cuts`` are whole numbers or text, in the order
    the database sorts them.
    """

    def literal(value) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    bounds = [literal(c) for c in cuts]
    if not bounds:
        return ["1 = 1"]
    first = f"{column} < {bounds[0]} OR {column} IS NULL"
    inner = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(bounds, bounds[1:])]
    return [first, *inner, f"{column} >= {bounds[-1]}"]


def read_star_jdbc(
    spark: SparkSession,
    url: str,
    first_day: str,
    last_day: str,
    partitions: int,
    cuts: dict[str, tuple[str, list]] | None = None,
    **options: str,
) -> StarSchema:
    """The four tables from a database, each in parallel slices.

    The fact is read in ``partitions`` slices of the purchase time; ``first_day`` and ``last_day``
    only set the stride, rows outside are still read. ``cuts`` gives for other tables the column
    to slice by and where (see ``range_predicates``), such as ``{"dim_customers": ("customer_id",
    [10**6, 2 * 10**6])}``; a table without is read by one connection.
    """
    fixed = {"preferTimestampNTZ": "true", **options}
    slices = {
        "partitionColumn": "order_purchase_timestamp",
        "lowerBound": first_day,
        "upperBound": last_day,
        "numPartitions": str(partitions),
    }
    frames = []
    for table, schema in TABLES.items():
        typed = [f for f in schema.fields if f.name not in ID_COLUMNS]
        types = {"customSchema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in typed)}
        if cuts and table in cuts:
            loaded = spark.read.jdbc(url, table, predicates=range_predicates(*cuts[table]), properties={**fixed, **types})
        else:
            extra = slices if table == "fact_order_items" else {}
            loaded = spark.read.format("jdbc").options(url=url, dbtable=table, **fixed, **types, **extra).load()
        frames.append(conform(loaded, schema))
    return StarSchema(*frames)


def run_query(spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    """Result of SQL text; ``:name`` markers are bound from ``params``, never spliced in."""
    return spark.sql(query, args=params)


def register_tables(spark: SparkSession, database: str, paths: dict[str, str]) -> None:
    """A database of external tables over Parquet files; one of that name is replaced, no file is touched."""
    name = {"db": database}
    spark.sql("DROP DATABASE IF EXISTS IDENTIFIER(:db) CASCADE", name)
    where = f"{shared_folder(spark)}/databases/{database}"
    spark.sql("CREATE DATABASE IDENTIFIER(:db) LOCATION '" + where.replace("'", "\\'") + "'", name)
    for table, path in paths.items():
        spark.catalog.createTable(f"{database}.{table}", path=path, source="parquet")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Table and view names by name: of a database, or of the current one with the session's temporary views."""
    if database:
        # Temporary views belong to the session and are listed with every database.
        names = spark.sql("SHOW TABLES IN IDENTIFIER(:db)", {"db": database}).where("NOT isTemporary")
    else:
        names = spark.sql("SHOW TABLES")
    return names.select(F.col("tableName").alias("table_name")).distinct().orderBy("table_name")


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Name and row count of each given table."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts).select("table_name", "rows")
