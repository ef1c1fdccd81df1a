"""Fixed-size sample without replacement, the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``min(size, rows)`` rows, drawn by the hash of a unique key and the seed."""
    ticket = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))
    return df.orderBy(ticket, key).limit(size)
