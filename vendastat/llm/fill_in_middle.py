"""Fill-in-the-middle transformation by rotating blocks of a bytearray in place.

Two cuts, drawn from a hash of the id, part a text into prefix, middle and suffix. The sentinels
are inserted where the parts begin, and the parts change places by rotation: two neighbouring
blocks are each reversed, then both together, which exchanges them without a second buffer of
the text. ``restore`` finds the sentinels, rotates back and takes them out.

Defined results: a null text counts as empty; an empty text, and one that holds a sentinel, stays
as it is (form ``plain``), so that every other output holds each sentinel once and can be
restored exactly. A null id is hashed as the empty string. Repeated rows are transformed alike.
Very long texts take a few copies of themselves at a time. An empty table gives an empty result;
only the id and the text are read. Cuts count code points, so no character is torn apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Share of texts that are transformed, and of those the share with the suffix first, in percent.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = 1


def rotate(buffer: bytearray, begin: int, middle: int, end: int) -> None:
    """Exchange the blocks [begin, middle) and [middle, end) by three reversals."""
    for a, b in ((begin, middle), (middle, end), (begin, end)):
        block = buffer[a:b]
        block.reverse()
        buffer[a:b] = block


def transform(text: str, prefix: int, middle: int, form: str) -> str:
    """``text`` with its first ``prefix`` and next ``middle`` characters marked and moved."""
    if form == "plain":
        return text
    buffer = bytearray(text.encode())
    first = len(text[:prefix].encode())
    second = first + len(text[prefix : prefix + middle].encode())
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):  # from the back, so that offsets hold
        buffer[at:at] = mark.encode()
    first += len(PREFIX)
    second += len(PREFIX) + len(MIDDLE)
    # Now prefix, middle, suffix, each behind its sentinel; the suffix changes places.
    rotate(buffer, first if form == "psm" else 0, second, len(buffer))
    return buffer.decode()


def restore(output: str, form: str) -> str:
    """The text that ``transform`` made ``output`` from."""
    if form == "plain":
        return output
    buffer = bytearray(output.encode())
    marks = {m: buffer.index(m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)}
    # The suffix goes back behind the middle: it lies before it alone, or before prefix and middle.
    begin, cut = marks[SUFFIX], marks[MIDDLE] if form == "psm" else marks[PREFIX]
    rotate(buffer, begin, cut, len(buffer))
    moved = cut - begin
    marks[SUFFIX] = len(buffer) - moved
    marks[MIDDLE] -= moved
    marks[PREFIX] = 0
    for mark in (SUFFIX, MIDDLE, PREFIX):
        del buffer[marks[mark] : marks[mark] + len(mark)]
    return buffer.decode()


@F.pandas_udf(T.StringType())
def transformed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series([transform(*row) for row in zip(*columns, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def restored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series([restore(*row) for row in zip(*columns, strict=True)], dtype=object)


def drawn(id_col: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits per row, from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    transformed_pct: int = TRANSFORMED,
    suffix_first_pct: int = SUFFIX_FIRST,
) -> DataFrame:
    """One row per document: id, text, n, form, prefix_chars, middle_chars, output.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); the numbers
    of characters are null for plain texts, whose output is the text.
    """
    cut_a, cut_b, whether, order = drawn("id", seed)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("n", F.char_length("text").cast("bigint"))
    holds = reduce(Column.__or__, [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    units = F.col("n") + 1
    form = (
        F.when((F.col("n") == 0) | holds | (whether % 100 >= transformed_pct), "plain")
        .when(order % 100 < suffix_first_pct, "spm")
        .otherwise("psm")
    )
    rows = rows.select(
        "id",
        "text",
        "n",
        form.alias("form"),
        F.least(cut_a % units, cut_b % units).alias("prefix"),
        F.abs(cut_a % units - cut_b % units).alias("middle"),
    )
    moved = F.col("form") != "plain"
    return rows.select(
        "id",
        "text",
        "n",
        "form",
        F.when(moved, F.col("prefix")).alias("prefix_chars"),
        F.when(moved, F.col("middle")).alias("middle_chars"),
        transformed("text", "prefix", "middle", "form").alias("output"),
    )
