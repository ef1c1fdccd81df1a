"""Aggregates and arithmetic with explicit handling of missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendastat.session import materialize

# Text accepted as a number; Java alone would also take suffixes such as "1d".
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"

# A percent column whose largest value does not exceed this is taken to be a 0-1 share.
SHARE_CEILING = 1.000001


def exact_mean(x: Column) -> Column:
    """Mean of a decimal column as a double, from the exact sum."""
    return F.try_divide(F.sum(x).cast("double"), F.count(x))


def percent_of_rows(condition: Column) -> Column:
    """Share of all rows of the group, unknown ones included, for which ``condition`` holds."""
    return F.count_if(condition) * F.lit(100.0) / F.count("*")


def weighted_mean(x: Column, weight: Column) -> Column:
    """Weighted mean over the rows where ``x`` is known; NULL without any weight."""
    return F.try_divide(F.sum(x * weight), F.sum(F.when(x.isNotNull(), weight)))


def weighted_mean_all(x: Column, weight: Column) -> Column:
    """Weighted mean that is NULL as soon as one value is unknown."""
    return F.when(F.count(x) == F.count("*"), F.try_divide(F.sum(x * weight), F.sum(weight)))


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent; NULL if the previous value is unknown or zero."""
    return F.try_divide((current - previous).cast("double"), previous.cast("double")) * 100


def share_pct(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; NULL if the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def known(x: Column) -> Column:
    """NaN turned into NULL. Spark orders NaN above every number, so comparisons need this."""
    return F.when(~F.isnan(x), x)


def to_number(text: Column) -> Column:
    """Text as a double; whatever is not a number becomes NULL."""
    return F.when(text.rlike(_NUMBER) | text.rlike(_INFINITY), text.try_cast("double"))


def coerce_numeric(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as doubles, missing where the value is not a number."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for name in columns:
        if isinstance(types[name], T.StringType):
            out[name] = to_number(F.col(name))
        else:
            out[name] = known(F.col(name).cast("double"))
    return df.withColumns(out)


def normalize_percent(df: DataFrame, *columns: str, small: bool = False) -> DataFrame:
    """Multiply each percent column by 100 if all of it looks like 0-1 shares.

    The rule looks at the whole column. ``small=True`` is for report tables (months,
    states, a top-N list), where a window over all rows costs nothing. Otherwise the table is
    stored once, its maxima are read from there, and the result reads it once more: the input is
    computed a single time and no step runs in one task.
    """
    columns = tuple(c for c in columns if c in df.columns)
    if not columns:
        return df
    df = coerce_numeric(df, *columns)
    if small:
        tops = {c: F.max(c).over(Window.partitionBy(F.lit(0))) for c in columns}
    else:
        df = materialize(df, "percent")
        largest = df.agg(*[F.max(c).alias(c) for c in columns]).first()
        tops = {c: F.lit(largest[c]) for c in columns}
    return df.withColumns(
        {c: F.when(top <= SHARE_CEILING, F.col(c) * 100).otherwise(F.col(c)) for c, top in tops.items()}
    )


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Columns rounded for display; NULL stays NULL."""
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})
